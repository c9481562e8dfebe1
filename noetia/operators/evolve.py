"""Evolution of a memory: consolidation, decay, reinforcement and rehydration, each with a log of events."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noetia.functions import expr as X
from noetia.operators.components import connected_components
from noetia.operators.pairs import block_pairs, cosines
from noetia.operators.rank import pagerank
from noetia.session import cut

LN2 = 0.6931471805599453


def event(kind: str, memory, nodes: Column, edges: Column, before: Column, after: Column, reason: Column, now: Column) -> list[Column]:
    ident = X.hash_id(F.lit(kind), memory, F.array_join(nodes, ","), F.array_join(edges, ","), F.date_format(now, "yyyy-MM-dd HH:mm:ss"))
    return [ident.alias("id"), F.lit(kind).alias("evolution_type"), F.col(memory).alias("memory_id"), nodes.alias("affected_nodes"), edges.alias("affected_edges"), before.alias("before_state"), after.alias("after_state"), reason.alias("reason"), F.lit("{}").alias("metadata"), now.alias("ts"), F.lit(True).alias("success")]


def lcs_ratio(a: str | None, b: str | None) -> float:
    """Twice the longest common subsequence over both lengths in bytes, any case; 0 where one is empty."""
    if not a or not b:
        return 0.0
    x, y = a.lower().encode(), b.lower().encode()
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    # bit-parallel: one big integer holds a row of the table
    masks: dict[int, int] = {}
    for i, ch in enumerate(x):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(x)) - 1
    row = full
    for ch in y:
        m = row & masks.get(ch, 0)
        row = ((row + m) | (row - m)) & full
    return 2.0 * (len(x) - row.bit_count()) / (len(x) + len(y))


def _lcs_series(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([lcs_ratio(p, q) for p, q in zip(x, y)])


def name_similarity(a: str, b: str) -> Column:
    return F.pandas_udf(_lcs_series, "double")(a, b)


# -- consolidation -------------------------------------------------------------------------------------------------------
def similar_pairs(nodes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """memory_id, entity_type, id_a < id_b, similarity of active nodes of one memory and type: cosine where both have a
    vector, else the names' LCS ratio."""

    def kernel(left, right, same):
        def prep(rows):
            dims = [len(r["embedding"] or ()) for r in rows]
            return dims

        dl, dr = prep(left), prep(right)
        by_dim: dict[int, tuple[list[int], list[int]]] = {}
        for i, d in enumerate(dl):
            by_dim.setdefault(d, ([], []))[0].append(i)
        for j, d in enumerate(dr):
            by_dim.setdefault(d, ([], []))[1].append(j)
        for d, (li, rj) in by_dim.items():
            if d == 0 or not li or not rj:
                continue
            a = np.array([left[i]["embedding"] for i in li], float)
            b = np.array([right[j]["embedding"] for j in rj], float)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
            for p, q in zip(*np.nonzero(s >= threshold)):
                x, y = left[li[p]], right[rj[q]]
                if (not same) or x["id"] < y["id"]:
                    lo, hi = sorted((x["id"], y["id"]))
                    yield x["memory_id"], x["entity_type"], lo, hi, float(s[p, q])
        bare_l, bare_r = [r for r, d in zip(left, dl) if d == 0], [r for r, d in zip(right, dr) if d == 0]
        done = set()
        for xs, ys in ((bare_l, right), (left, bare_r)):
            for x in xs:
                for y in ys:
                    lo, hi = sorted((x["id"], y["id"]))
                    if lo == hi or (lo, hi) in done:
                        continue
                    n, m = len((x["name"] or "").encode()), len((y["name"] or "").encode())
                    if n and m and 2.0 * min(n, m) / (n + m) >= threshold and (v := lcs_ratio(x["name"], y["name"])) >= threshold:
                        done.add((lo, hi))
                        yield x["memory_id"], x["entity_type"], lo, hi, v

    d = nodes.where((F.col("state") == "ACTIVE") & F.col("entity_type").isNotNull()).select("memory_id", "entity_type", "id", "name", "embedding")
    return block_pairs(d, ["memory_id", "entity_type"], "id", kernel, "memory_id string, entity_type string, id_a string, id_b string, similarity double")


def are_similar(a: dict, b: dict, cos: float) -> bool:
    """Whether two nodes are duplicates; the rules in order of strength. The canonical name, where there is one, stands for
    the name; ``last`` and ``tokens`` are those of it. Blank names match nothing."""
    low = lambda s: (s or "").strip().lower()
    pa, pb = low(a["canonical_name"]) or low(a["name"]), low(b["canonical_name"]) or low(b["name"])
    if pa and pa in (pb, low(b["name"])) or pb and pb == low(a["name"]):
        return True
    aa, ab = {low(x) for x in a["aliases"] or () if low(x)}, {low(x) for x in b["aliases"] or () if low(x)}
    if aa & ab or pa in ab or pb in aa:
        return True
    if pa and pb and (pa in pb or pb in pa):
        return True
    if a["last"] and a["last"] == b["last"] and len(a["last"]) >= 3 and cos >= 0.65:
        return True
    ta, tb = set(a["tokens"] or ()), set(b["tokens"] or ())
    if ta and tb and len(ta & tb) / min(len(ta), len(tb)) >= 0.5 and cos >= 0.6:
        return True
    return cos >= 0.75


def duplicate_pairs(nodes: DataFrame) -> DataFrame:
    """memory_id, kind, id_a < id_b of nodes of one memory and type that the duplicate rules match (all states).

    All cosines of a pair of blocks come from one product; the names' rules are looked up by index (alias, name, last name,
    token) and only pairs that share something, or are near enough, are put to the rules. Containment is the exception: it
    is tried for each pair of different names of a block.
    """
    kind = F.coalesce(F.when(F.lower("entity_type") != "", F.lower("entity_type")), F.lit("unknown")).alias("kind")
    plain = F.coalesce(F.when(F.trim("canonical_name") != "", F.col("canonical_name")), F.col("name"))
    d = nodes.select("memory_id", kind, "id", "name", "canonical_name", "aliases", "embedding", X.last_name(plain).alias("last"), X.consolidation_tokens(plain).alias("tokens"))

    def keys(r):
        low = lambda s: (s or "").strip().lower()
        own = {low(r["canonical_name"]) or low(r["name"]), low(r["name"]), *(low(x) for x in r["aliases"] or ())} - {""}
        return {("n", x) for x in own}

    def kernel(left, right, same):
        cos = cosines(left, right)
        cand: set[tuple[int, int]] = set(zip(*(x.tolist() for x in np.nonzero(cos >= 0.6))))
        index: dict[tuple, list[int]] = {}
        for j, r in enumerate(right):
            for k in keys(r):
                index.setdefault(k, []).append(j)
        for i, r in enumerate(left):
            for k in keys(r):
                cand.update((i, j) for j in index.get(k, ()))
        plain = lambda r: ((r["canonical_name"] or "").strip() or (r["name"] or "").strip()).lower()
        by_name: tuple[dict, dict] = ({}, {})
        for side, rows in zip(by_name, (left, right)):
            for i, r in enumerate(rows):
                if p := plain(r):
                    side.setdefault(p, []).append(i)
        text = "\n".join(by_name[1])  # a name in some other one is found in all of them at once
        for p, at in by_name[0].items():
            if p in text:
                for q, to in by_name[1].items():
                    if p in q:
                        cand.update((i, j) for i in at for j in to)
        text = "\n".join(by_name[0])
        for q, to in by_name[1].items():
            if q in text:
                for p, at in by_name[0].items():
                    if q in p:
                        cand.update((i, j) for i in at for j in to)
        for i, j in sorted(cand):
            x, y = left[i], right[j]
            if (i < j or not same) and are_similar(x, y, float(cos[i, j])):
                lo, hi = sorted((x["id"], y["id"]))
                yield x["memory_id"], x["kind"], lo, hi

    return block_pairs(d, ["memory_id", "kind"], "id", kernel, "memory_id string, kind string, id_a string, id_b string", 1024)


def star_groups(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(center, id) of the duplicate groups: not transitive, every node in one group at most, the center included.

    In order of id, a node that is in no group yet takes all its duplicates that are in none and have a larger id. The order
    is resolved in rounds: a node is a center once every smaller duplicate of it is settled as a member, and a member once
    a smaller duplicate is a center; the smallest center takes it. Each round settles the smallest open node of every chain
    at least, so the rounds end; no group is ever in one task.
    """
    e = cut(pairs.select(F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi")).where("lo <> hi").distinct())
    open_ = cut(e.select(F.col("lo").alias("id")).union(e.select(F.col("hi").alias("id"))).distinct())
    done = None
    while open_.limit(1).count():
        left = e.join(open_.select(F.col("id").alias("hi")), "hi", "left_semi")
        waiting = left.join(open_.select(F.col("id").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("id")).distinct()
        centers = open_.join(waiting, "id", "left_anti")
        all_centers = cut(centers.select("id", F.col("id").alias("center")))
        taken = left.join(all_centers.select(F.col("id").alias("lo"), "center"), "lo").groupBy(F.col("hi").alias("id")).agg(F.min("center").alias("center"))
        new = cut(all_centers.unionByName(taken))
        done = new if done is None else done.unionByName(new)
        open_ = cut(open_.join(new, "id", "left_anti"))
    if done is None:
        return nodes.limit(0).select(F.col("id").alias("center"), "id")
    many = done.groupBy("center").count().where("count > 1").select("center")
    return done.join(many, "center").select("center", "id")


def consolidate_fully(nodes: DataFrame, edges: DataFrame, now: Column, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, inferred edges, events): duplicates merge by star groups (or ``groups(center, id)``, as of a model), then
    repeated edges fold into one, then links over a middle node are inferred."""
    from noetia.operators.graph import MERGED, merge_nodes, reinforce_edges, remap_endpoints, transitive_links

    g = cut(star_groups(duplicate_pairs(nodes), nodes) if groups is None else groups)
    member = nodes.join(g, "id")
    merged = cut(merge_nodes(member, "center"))
    moved = cut(member.select("center", F.col("id").alias("old_id")).join(merged.select("center", F.col("id").alias("new_id")), "center").where("old_id <> new_id").select("old_id", "new_id"))
    kept = nodes.join(moved.select(F.col("old_id").alias("id")), "id", "left_anti")
    m = merged.select("id", *[F.col(c).alias(f"_{c}") for c in MERGED], F.lit(True).alias("_hit"))
    j = kept.join(m, "id", "left")
    hit = F.col("_hit").isNotNull()
    for c in MERGED:
        j = j.withColumn(c, F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)))
    new_nodes = j.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).withColumn("accessed_at", F.when(hit, now).otherwise(F.col("accessed_at"))).select(nodes.columns)
    e = cut(remap_endpoints(edges, moved))
    r = cut(reinforce_edges(e))
    key = ["memory_id", "source_id", "target_id", "relation_type"]
    same = e.join(r.select(*key, "kept_id", F.col("weight").alias("_w"), F.col("confidence").alias("_c")), key, "left")
    folded = same.where(F.col("kept_id").isNull() | (F.col("kept_id") == F.col("id")))
    folded = folded.withColumn("weight", F.coalesce("_w", "weight")).withColumn("confidence", F.coalesce("_c", "confidence")).select(edges.columns)
    ids = member.groupBy("center").agg(F.min("memory_id").alias("memory_id"), F.sort_array(F.collect_list("id")).alias("ids")).join(merged.select("center", F.col("id").alias("new_id")), "center")
    none = F.array().cast("array<string>")
    ev = ids.select(*event("CONSOLIDATION", "memory_id", F.col("ids"), none, F.to_json(F.struct(F.size("ids").alias("node_count"))), F.to_json(F.struct(F.col("new_id").alias("merged_node"))), F.concat(F.lit("Merged "), F.size("ids").cast("string"), F.lit(" similar entities")), now))
    folds = r.select(*event("REINFORCEMENT", "memory_id", none, F.array("kept_id"), F.to_json(F.struct("n")), F.to_json(F.struct("weight", "confidence")), F.lit("repeated edges folded"), now))
    return new_nodes, folded, transitive_links(folded), ev.unionByName(folds)


def model_groups(nodes: DataFrame, model, most: int = 50) -> DataFrame:
    """(center, id) of the duplicates that a language model names, for every memory and type of up to ``most`` nodes.

    Each such list is one prompt of numbered lines; the answer has one group of numbers a line. A model that fails, and
    larger types, leave their nodes to :func:`star_groups`.
    """
    kind = F.coalesce(F.when(F.lower("entity_type") != "", F.lower("entity_type")), F.lit("unknown"))
    small = nodes.groupBy("memory_id", kind.alias("kind")).agg(F.count("*").alias("n")).where(F.col("n").between(2, most))
    others = F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ", ")
    line = F.concat(F.col("name"), F.lit(" (aliases: "), F.when(others == "", "none").otherwise(others), F.lit(") - "), X.byte_prefix(F.coalesce("description", F.lit("")), 100))
    rows = nodes.where("name is not null").select("memory_id", kind.alias("kind"), "id", line.alias("line")).join(small.drop("n"), ["memory_id", "kind"])
    lists = rows.groupBy("memory_id", "kind").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("x"))
    text = F.array_join(F.transform("x", lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["line"])), "\n")
    asked = lists.select("x", F.concat(F.lit("Which of these entities of type "), "kind", F.lit(" are the same? One group of numbers a line, with commas.\n"), text).alias("prompt"))

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        def one(p):
            try:
                return model.complete(p)
            except Exception:  # noqa: BLE001 - this list is left to the rules
                return None

        return prompts.map(one)

    g = asked.select("x", F.posexplode(X.parse_groups(ask("prompt"), F.size("x"))).alias("_g", "numbers"))
    ids = g.select(F.array_sort(F.transform("numbers", lambda k: F.element_at("x", k)["id"])).alias("ids"))
    return ids.select(F.element_at("ids", 1).alias("center"), F.explode(F.array_distinct("ids")).alias("id"))


def merged_nodes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(old_id, new_id) of nodes that merge into another: of every group of linked nodes the most accessed survives, then
    the most important, then the largest id."""
    comp = connected_components(pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
    n = nodes.select("id", F.coalesce("access_count", F.lit(0)).alias("a"), F.coalesce("importance", F.lit(0)).alias("i"))
    j = comp.join(n, comp.node == n.id)
    keep = j.groupBy("component").agg(F.max(F.struct("a", "i", "id")).alias("k")).select("component", F.col("k.id").alias("new_id"))
    return j.join(keep, "component").where("id <> new_id").select(F.col("id").alias("old_id"), "new_id")


def consolidate(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, events): survivors take over aliases, the longer description and the accesses; the others are
    DELETED and their edges follow the survivor."""
    m = merged_nodes(pairs, nodes)
    gone = m.join(nodes, m.old_id == nodes.id)
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    got = gone.groupBy("new_id").agg(F.flatten(F.collect_set(names)).alias("_al"), F.sum(F.coalesce("access_count", F.lit(0))).alias("_ac"), F.max(F.struct(F.octet_length("description").alias("n"), F.col("description").alias("d"))).alias("_d"), F.sort_array(F.collect_list("old_id")).alias("_old"))
    out = nodes.join(got, nodes.id == got.new_id, "left").join(m.select(F.col("old_id").alias("_o")), F.col("id") == F.col("_o"), "left")
    longer = F.coalesce(F.col("_d.n"), F.lit(0)) > F.coalesce(F.octet_length("description"), F.lit(0))
    new = out.withColumn("aliases", F.when(F.col("_al").isNotNull(), F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), "_al"))).otherwise(F.col("aliases")))
    new = new.withColumn("description", F.when(longer, F.col("_d.d")).otherwise(F.col("description"))).withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_ac", F.lit(0)))
    new = new.withColumn("state", F.when(F.col("_o").isNotNull(), F.lit("DELETED")).otherwise(F.col("state"))).withColumn("updated_at", F.when(F.col("_o").isNotNull() | F.col("_al").isNotNull(), now).otherwise(F.col("updated_at")))
    from noetia.operators.graph import remap_endpoints

    ev = out.where("_old is not null").select(*event("CONSOLIDATION", "memory_id", F.concat(F.array("new_id"), "_old"), F.array().cast("array<string>"), F.to_json(F.struct("_old")), F.to_json(F.struct("new_id")), F.lit("similar nodes merged"), now))
    return new.select(nodes.columns), remap_endpoints(edges, m), ev


# -- decay and reinforcement ---------------------------------------------------------------------------------------------
def facade_decay(nodes: DataFrame, now: Column, half_life: float = 30.0) -> DataFrame:
    """id, old and new importance, new state of active, not critical nodes whose importance falls by two or more."""
    s = F.col("importance") * F.exp(F.lit(-LN2) * X.age_days("accessed_at", now) / half_life)
    d = nodes.where((F.col("state") == "ACTIVE") & (F.col("importance") < 10) & F.col("accessed_at").isNotNull())
    d = d.withColumn("new_importance", X.importance_bucket(s)).where(F.col("importance") - F.col("new_importance") >= 2)
    return d.select("id", "memory_id", "importance", "new_importance", F.when(F.col("new_importance") == 0, "DECAYING").otherwise(F.col("state")).alias("new_state"))


def facade_reinforce(nodes: DataFrame, ranks: DataFrame, now: Column) -> DataFrame:
    """id, old and new importance of active nodes whose score moves them by two or more."""
    n = nodes.where((F.col("state") == "ACTIVE") & F.col("accessed_at").isNotNull() & F.col("importance").isNotNull()).join(ranks, "id", "left")
    s = 0.3 * X.recency_steps("accessed_at", now) + 0.3 * F.coalesce("access_count", F.lit(0)) / 100.0 + 0.2 * F.coalesce("pagerank", F.lit(0.0)) * 10 + 0.2 * F.col("importance")
    n = n.withColumn("new_importance", X.importance_bucket(s))
    return n.where(F.abs(F.col("new_importance") - F.col("importance")) >= 2).select("id", "memory_id", "importance", "new_importance")


def decay_nodes(nodes: DataFrame, scores: DataFrame, now: Column, half_life: float = 30.0, keep_from: int = 1, archive_below: float = 0.2, delete_below: float = 0.05) -> DataFrame:
    """id, strength, new_state, new_importance: weak nodes below ``keep_from`` are deleted or archived, the others take the
    importance of their score (``scores(id, score)``). Deleted nodes are left out, critical ones stay."""
    n = nodes.where((F.col("state") != "DELETED") & (F.col("importance") < 10) & F.col("accessed_at").isNotNull()).join(scores, "id", "left")
    n = n.withColumn("strength", X.node_strength("accessed_at", now, "importance", "access_count", half_life))
    low = F.col("importance") < keep_from
    state = F.when(low & (F.col("strength") <= delete_below), "DELETED").when(low & (F.col("strength") <= archive_below), "ARCHIVED").otherwise(F.col("state"))
    return n.select("id", "memory_id", "strength", state.alias("new_state"), F.when(state != F.col("state"), F.col("importance")).otherwise(X.importance_bucket("score")).alias("new_importance"))


def decay_edges(edges: DataFrame, nodes: DataFrame, now: Column, half_life: float = 30.0, delete_below: float = 0.05, weaken_below: float = 0.5) -> DataFrame:
    """id, strength, new_state, new_weight; an edge at a deleted node, or too weak, is deleted; critical ones stay."""
    gone = nodes.where(F.col("state") == "DELETED").select("id").distinct()
    e = edges.where((F.col("state") != "DELETED") & (F.coalesce("importance", F.lit(5)) < 10) & F.col("accessed_at").isNotNull() & F.col("confidence").isNotNull() & F.col("weight").isNotNull())
    e = e.join(gone.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")), "source_id", "left").join(gone.select(F.col("id").alias("target_id"), F.lit(True).alias("_t")), "target_id", "left")
    e = e.withColumn("strength", X.edge_strength("accessed_at", now, "weight", "confidence", half_life))
    dead = F.coalesce("_s", F.lit(False)) | F.coalesce("_t", F.lit(False)) | (F.col("strength") <= delete_below)
    return e.select("id", "memory_id", "strength", F.when(dead, "DELETED").otherwise(F.col("state")).alias("new_state"), F.when(~dead & (F.col("strength") < weaken_below), F.col("weight") * F.col("strength")).otherwise(F.col("weight")).alias("new_weight"))


def due(memories: DataFrame, now: Column, interval_seconds: int = 3600, force: bool = False) -> DataFrame:
    """Memories whose last evolution lies at least the interval back."""
    return memories if force else memories.where(F.col("updated_at").isNull() | (F.unix_micros(now) - F.unix_micros(F.col("updated_at").cast("timestamp")) >= interval_seconds * 1_000_000))


# -- rehydration ---------------------------------------------------------------------------------------------------------
def rehydrate(nodes: DataFrame, context: tuple[float, ...], threshold: float = 0.75, limit: int = 10) -> DataFrame:
    """id, relevance, new_state, action of the nodes most relevant to the context's vector, per memory. Archived and
    decaying ones are restored, active ones strengthened; deleted ones take a place but stay as they are."""
    v = F.array(*map(F.lit, context)).cast("array<float>")
    r = F.round(F.least(F.lit(1.0), X.cosine("embedding", v, single=True) * F.when(F.col("state") == "ARCHIVED", 1.1).otherwise(1.0)), 5)
    w = Window.partitionBy("memory_id").orderBy(F.desc("relevance"), "id")
    d = nodes.select("memory_id", "id", "state", r.alias("relevance")).where(F.col("relevance") >= threshold)
    d = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    restored = F.col("state").isin("ARCHIVED", "DECAYING")
    return d.select("memory_id", "id", "relevance", F.when(restored, "ACTIVE").otherwise(F.col("state")).alias("new_state"), F.when(restored, "restored").when(F.col("state") == "ACTIVE", "strengthened").otherwise("unchanged").alias("action"))


def rehydrated_edges(edges: DataFrame, rehydrated: DataFrame) -> DataFrame:
    """Edges that aren't active and touch a restored node; they become active."""
    from noetia.operators.graph import touching

    ids = rehydrated.where(F.col("action") == "restored").select("id")
    return touching(edges.where(F.col("state") != "ACTIVE"), ids, "any").withColumn("state", F.lit("ACTIVE"))


def evolve(nodes: DataFrame, edges: DataFrame, now: Column, steps: tuple[str, ...] = ("CONSOLIDATION", "DECAY", "REINFORCEMENT")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The steps in order, each on the result of the one before: (nodes, edges, events). Other step names do nothing."""
    log = None
    none = F.array().cast("array<string>")
    for step in steps:
        if step == "CONSOLIDATION":
            nodes, edges, ev = consolidate(nodes, edges, similar_pairs(nodes), now)
        elif step in ("DECAY", "REINFORCEMENT"):
            ch = facade_decay(nodes, now) if step == "DECAY" else facade_reinforce(nodes, pagerank(nodes, edges), now).withColumn("new_state", F.lit("ACTIVE"))
            ch = cut(ch)
            ev = ch.select(*event(step, "memory_id", F.array("id"), none, F.to_json(F.struct("importance")), F.to_json(F.struct("new_importance")), F.lit("importance changed"), now))
            j = nodes.join(ch.select("id", "new_importance", "new_state"), "id", "left")
            nodes = j.withColumn("importance", F.coalesce("new_importance", "importance")).withColumn("state", F.coalesce("new_state", "state")).select(nodes.columns)
        else:
            continue
        nodes, edges, ev = cut(nodes), cut(edges), cut(ev)
        log = ev if log is None else log.unionByName(ev)
    return nodes, edges, log


