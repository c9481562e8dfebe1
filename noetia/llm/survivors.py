"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noetia.session import cut, norm_id

AS_OF = "2024-01-31 00:00:00"
EARLIEST = "2000-01-01 00:00:00"
IMPORTANCE_SCALE = (0, 1, 3, 5, 6, 8, 10)
MOST_ACCESSES = 999_999
FIELDS = ("description", "importance", "accessed_at", "access_count")
GROUP = ("memory_id", "entity_type", "canonical_name")

# Marks for a missing value or description that are usual everywhere, in lower case, letters only. They matter
# for small tables; sentences that say nothing are not listed, the corpus shows them (:func:`empty_phrases`).
MARKS = (
    *("todo", "tbd", "tba", "n a", "na", "none", "null", "nil", "unknown", "no description", "description pending"),
    *("unbekannt", "keine beschreibung", "beschreibung folgt", "inconnu", "sans description", "desconocido", "sin descripción"),
)
#: A text that entities of different types share says nothing about any of them, if no type has more than this share of it.
TYPE_SHARE = 0.8
#: Phrases, groups or texts' ids up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
SPACES = r"[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def collapsed(c: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def _letters(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "))


def informative(description: Column, name: Column, kind: Column) -> Column:
    """Whether a description says something by itself: not empty, no mark or row of x, more than the entity's name or type."""
    d, n, t = (_letters(F.coalesce(x, F.lit(""))) for x in (description, name, kind))
    only = [n, t, F.concat_ws(" ", n, t), F.concat_ws(" ", t, n)]
    ok = (d != "") & ~d.isin(*MARKS) & ~d.rlike(r"^x+$")
    for x in only:
        ok = ok & (d != x)
    return ok


def empty_phrases(entities: DataFrame) -> DataFrame:
    """``phrase``: hashes of the descriptions (letters only) that say nothing about an entity, from the table itself.

    A description tells of the thing described. One that things of different types bear under different names can't; a
    formula such as "archivist since" stays with one type. A text counts as empty where at least two names bear it and no
    type has more than ``TYPE_SHARE`` of its bearers. Rows fold by (text, type) before the shuffle; redelivered rows of one
    name count once for the names and don't change the types' proportions by much.
    """
    d = _letters(F.coalesce(F.col("description"), F.lit("")))
    rows = entities.select(F.xxhash64(d).alias("phrase"), F.coalesce(F.lower(F.trim("entity_type")), F.lit("")).alias("kind"), F.xxhash64("canonical_name").alias("name")).where(d != "")
    per = rows.groupBy("phrase", "kind").agg(F.count("*").alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi"))
    whole = per.groupBy("phrase").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("kinds"))
    return whole.where((F.col("kinds") > 1) & (F.col("lo") != F.col("hi")) & (F.col("most") <= F.lit(TYPE_SHARE) * F.col("n"))).select("phrase")


def _values(entities: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """Every record with the rank value of each field, null where the value isn't usable."""
    as_of, earliest = (F.lit(x).cast("timestamp") for x in (AS_OF, EARLIEST))
    acc = F.col("accessed_at").cast("timestamp")
    says = informative(F.col("description"), F.col("name"), F.col("entity_type"))
    src = entities
    if phrases is not None:
        phrases = phrases.select(F.col("phrase").alias("_phrase"))
        key = F.xxhash64(_letters(F.coalesce(F.col("description"), F.lit(""))))
        src, says = entities.join(phrases, key == F.col("_phrase"), "left"), says & F.col("_phrase").isNull()
    return src.select(
        *GROUP,
        *(["group_id"] if "group_id" in entities.columns else []),
        norm_id("id").alias("entity_id"),
        F.when(says, F.length(collapsed(F.col("description"))).cast("bigint")).alias("description"),
        F.when(F.col("importance").isin(*IMPORTANCE_SCALE), F.col("importance").cast("bigint")).alias("importance"),
        F.when((acc >= earliest) & (acc <= as_of) & (F.col("created_at").isNull() | (acc >= F.col("created_at").cast("timestamp"))), F.unix_micros(acc)).alias("accessed_at"),
        F.when(F.col("access_count").between(0, MOST_ACCESSES), F.col("access_count")).alias("access_count"),
    ).where("entity_id is not null")


def _sized(df: DataFrame) -> DataFrame:
    """A written table, with a hint to broadcast it if it is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def group_values(entities: DataFrame) -> DataFrame:
    """group_id and the rank values of the records of every duplicate group, with the table's own empty phrases left out.

    A group has at least two different ids. Partial aggregation keeps a group with a large share of all rows small; records
    that are in no group leave before anything else is moved.
    """
    e = entities.select(*GROUP, "id", "name", "description", "importance", "accessed_at", "access_count", "created_at")
    ids = e.select(*GROUP, norm_id("id").alias("entity_id")).where("entity_id is not null")
    groups = ids.groupBy(*GROUP).agg(F.min("entity_id").alias("group_id"), F.max("entity_id").alias("last_id")).where("group_id <> last_id").drop("last_id")
    phrases = _sized(empty_phrases(e))
    return _values(e.join(_sized(groups), [*GROUP]), phrases)


def field_winners(entities: DataFrame) -> DataFrame:
    """group_id, field_name, entity_id: the record whose value survives for each field of each duplicate group.

    A group is at least two different ids with equal, non-null memory_id, entity_type and canonical_name; group_id is its
    smallest id. Per field the usable values are ranked by a window (best value first, smallest id on ties); the window's
    group limit drops all but the best before the shuffle. Fields without a usable value give no row. Redelivered rows
    have an id of their own group and change nothing; rows with a null id or group field and empty tables give none.
    """
    return _winners(group_values(entities)).select("group_id", "field_name", "entity_id")


def _winners(values: DataFrame) -> DataFrame:
    pick = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])).alias("x")
    long = values.select("group_id", "entity_id", pick).select("group_id", "entity_id", "x.field_name", "x.value").where("value is not null")
    w = Window.partitionBy("group_id", "field_name").orderBy(F.desc("value"), "entity_id")
    return long.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def survivors(entities: DataFrame) -> DataFrame:
    """One surviving record per duplicate group, built field by field.

    group_id, the three group fields, n_records, base_id (the record that is best as a whole: most usable fields, then
    highest importance as trust, then latest access, then smallest id), the surviving values and the ids they come from.
    Same rules as :func:`field_winners`.
    """
    values = cut(group_values(entities))
    n = values.select("group_id", "entity_id").distinct().groupBy("group_id").agg(F.count("*").alias("n_records"))
    filled = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    w = Window.partitionBy("group_id").orderBy(F.desc(filled), F.desc_nulls_last("importance"), F.desc_nulls_last("accessed_at"), "entity_id")
    base = values.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("group_id", *GROUP, F.col("entity_id").alias("base_id"))
    wins = cut(_winners(values))
    of = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    wide = wins.groupBy("group_id").agg(
        *[of(f, "entity_id").alias(f"{f}_from") for f in FIELDS],
        of("importance", "value").cast("int").alias("importance"),
        F.timestamp_micros(of("accessed_at", "value")).alias("accessed_at"),
        of("access_count", "value").alias("access_count"),
    )
    told = _sized(wins.where("field_name = 'description'").select("group_id", "entity_id"))
    texts = entities.select(norm_id("id").alias("entity_id"), collapsed(F.col("description")).alias("text")).join(told, "entity_id").groupBy("group_id").agg(F.max("text").alias("description"))
    return base.join(n, "group_id").join(wide, "group_id", "left").join(texts, "group_id", "left")
