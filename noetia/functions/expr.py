"""Scalar functions and predicates as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noetia.schemas import IMPORTANCE, IMPORTANCE_STEPS

# Fixed values
RESOLVER_STOPWORDS = "the a an of and inc ltd llc corp co company limited corporation".split()
CONSOLIDATION_STOPWORDS = "the dr mr ms mrs prof professor inc corp llc".split()
LAST_NAME_TITLES = "dr mr ms mrs prof professor jr sr phd md the".split()
DECAY_RATE = 0.693


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- ids ---------------------------------------------------------------------------------------------------------------
def hash_id(*parts: Column | str) -> Column:
    """First 32 hex digits of SHA-256 over the parts joined by colons; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def node_id(name="name", entity_type="entity_type", user_id="user_id", memory_id="memory_id") -> Column:
    return hash_id(name, entity_type, user_id, memory_id)


def edge_id(source="source_id", target="target_id", relation="relation_type", memory_id="memory_id") -> Column:
    return hash_id(source, target, relation, memory_id)


def resolver_key(name="name") -> Column:
    return hash_id(F.lower(clean_name(name)))


# -- strings -----------------------------------------------------------------------------------------------------------
def clean_name(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(col(c), r"\s+", " "), F.lit(" \"'"))


def entity_tokens(c: Column | str) -> Column:
    """Distinct [a-z0-9]+ tokens of the lower-cased text without the resolver's stopwords."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, RESOLVER_STOPWORDS)))


def consolidation_tokens(c: Column | str) -> Column:
    t = F.regexp_extract_all(F.lower(col(c)), F.lit("(?<![a-z0-9_])[a-z]{2,}(?![a-z0-9_])"), F.lit(0))  # word bounds in ASCII
    return F.array_except(F.array_distinct(t), F.array(*map(F.lit, CONSOLIDATION_STOPWORDS)))


def last_name(c: Column | str) -> Column:
    """Last word of at least two ASCII letters that is no title, lower case; the last word if all are titles."""
    words = F.transform(F.regexp_extract_all(col(c), F.lit("[A-Za-z]{2,}"), F.lit(0)), F.lower)
    plain = F.filter(words, lambda w: ~w.isin(*LAST_NAME_TITLES))
    return F.coalesce(F.try_element_at(plain, F.lit(-1)), F.try_element_at(words, F.lit(-1)))


def share_last_name(a: Column | str, b: Column | str) -> Column:
    x, y = last_name(a), last_name(b)
    return F.coalesce((x == y) & (F.octet_length(x) >= 3), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


#: White space as Unicode has it; ``\s`` alone is that of ASCII.
_SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def retrieval_tokens(c: Column | str) -> Column:
    """White-space words without punctuation at their ends, longer than two bytes, lower case, distinct."""
    words = F.transform(F.split(col(c), _SPACES), lambda w: F.btrim(w, F.lit(".,!?;:'\"")))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.octet_length(w) > 2), F.lower))


def clean_text(c: Column | str) -> Column:
    t = F.regexp_replace(F.regexp_replace(col(c), "\r\n", "\n"), "\r", "\n")
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \n\t"))


def byte_prefix(c: Column | str, n: int, tail: str = "") -> Column:
    """The first ``n`` bytes, a split character becoming a replacement character; ``tail`` is added where text is cut."""
    c = col(c)
    cut = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(c) > n, F.concat(cut, F.lit(tail))).otherwise(c)


def token_estimate(c: Column | str, per_byte: float = 0.25) -> Column:
    return F.floor(F.octet_length(col(c)) * per_byte).cast("bigint")


def search_key(query: Column, top_k: Column, min_similarity: Column, filters: Column) -> Column:
    return F.md5(F.format_string("%s:%d:%.6f:%s", query, top_k, min_similarity, filters))


def parse_date(c: Column | str) -> Column:
    """Dates as people write them: full, month, year, month name; else the first year from 1900 to 2099; else null."""
    s = F.lower(F.btrim(col(c)))

    def form(pattern: str, fmt: str, text: Column = s) -> Column:
        return F.when(s.rlike(pattern), F.try_to_timestamp(text, F.lit(fmt)))

    year = F.regexp_extract(s, r"\b((?:19|20)\d{2})\b", 1)
    full = "january|february|march|april|may|june|july|august|september|october|november|december"
    short = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    return F.when(
        ~s.isin("", "none", "present"),
        F.coalesce(
            form(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
            form(r"^\d{4}-\d{2}$", "yyyy-MM-dd", F.concat(s, F.lit("-01"))),
            form(r"^\d{4}$", "yyyy-MM-dd", F.concat(s, F.lit("-01-01"))),
            form(rf"^({full}) \d{{4}}$", "d MMMM yyyy", F.concat(F.lit("1 "), F.initcap(s))),
            form(rf"^({short}) \d{{4}}$", "d MMM yyyy", F.concat(F.lit("1 "), F.initcap(s))),
            F.when(year != "", F.try_to_timestamp(F.concat(year, F.lit("-01-01")), F.lit("yyyy-MM-dd"))),
        ),
    )


def split_list(c: Column | str, by: str = ",") -> Column:
    """Parts of a list written as text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(c), by), lambda x: F.trim(x)), lambda x: x != "")


def json_get(properties: Column | str, key: str, default) -> Column:
    """A typed property with a default; a value of another type counts as missing."""
    raw = F.get_json_object(col(properties), f"$.{key}")
    if isinstance(default, str):
        return F.coalesce(raw, F.lit(default))
    return F.coalesce(raw.try_cast("bigint" if isinstance(default, int) else "double"), F.lit(default))


def json_merge(a: Column | str, b: Column | str) -> Column:
    """Two flat JSON objects as one; the second's values win. Values come out as strings; null counts as {}."""
    m = "map<string,string>"
    x, y = (F.coalesce(F.from_json(col(c), m), F.from_json(F.lit("{}"), m)) for c in (a, b))
    keep = F.map_filter(x, lambda k, v: ~F.map_contains_key(y, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.concat(F.map_entries(keep), F.map_entries(y)))))


# -- importance --------------------------------------------------------------------------------------------------------
def importance_bucket(score: Column | str) -> Column:
    s = col(score)
    out = F.when(s >= IMPORTANCE_STEPS[0][0], F.lit(IMPORTANCE_STEPS[0][1]))
    for least, level in IMPORTANCE_STEPS[1:]:
        out = out.when(s >= least, F.lit(level))
    return out.otherwise(F.lit(0)).cast("int")


def importance_label(level: Column | str) -> Column:
    c = col(level)
    return reduce(lambda acc, kv: acc.when(c == kv[1], F.lit(kv[0])), IMPORTANCE.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.lit("UNKNOWN"))


def age_days(at: Column | str, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(col(at).cast("timestamp"))) / F.lit(86_400_000_000.0)


def recency(at: Column | str, now: Column, half_life: float = 30.0) -> Column:
    return F.exp(F.lit(-DECAY_RATE) * age_days(at, now) / half_life)


def recency_steps(at: Column | str, now: Column) -> Column:
    d = age_days(at, now)
    return F.when(d < 1, 10.0).when(d < 7, 8.0).when(d < 30, 5.0).when(d < 90, 3.0).otherwise(1.0)


def frequency(count: Column | str) -> Column:
    n = F.coalesce(col(count), F.lit(0)).cast("double")
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log(1 + n) / F.log(F.lit(101.0))))


def node_strength(at, now: Column, importance, count, half_life: float = 30.0) -> Column:
    n = F.greatest(F.coalesce(col(count), F.lit(0)), F.lit(0)).cast("double")
    life = F.lit(half_life) * (0.5 + col(importance) / 20.0) * F.least(F.lit(1.0), 0.5 + F.log(1 + n) / 10)
    return F.exp(F.lit(-DECAY_RATE) * age_days(at, now) / life)


def edge_strength(at, now: Column, weight, confidence, half_life: float = 30.0) -> Column:
    life = F.greatest(F.lit(1.0), F.lit(half_life) * F.least(F.lit(1.0), col(weight) / 5.0) * col(confidence))
    return F.exp(F.lit(-DECAY_RATE) * age_days(at, now) / life)


def connectivity(degree: Column | str) -> Column:
    return F.least(F.lit(1.0), F.log(1 + col(degree).cast("double")) / F.log(F.lit(51.0)))


# -- vectors -----------------------------------------------------------------------------------------------------------
def _dot(a: Column, b: Column, single: bool) -> Column:
    prod = (lambda x, y: (x * y).cast("float").cast("double")) if single else (lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(F.zip_with(a, b, prod), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str, single: bool = False) -> Column:
    """Cosine; 0 for empty vectors, unequal lengths, zero norms, nulls and what isn't finite. ``single``: products in single
    precision."""
    a, b = col(a), col(b)
    n = F.sqrt(_dot(a, a, single)) * F.sqrt(_dot(b, b, single))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(ok & (n > 0), F.nanvl(_dot(a, b, single) / n, F.lit(0.0))), F.lit(0.0))


# -- predicates --------------------------------------------------------------------------------------------------------
def valid_at(t: Column, start="valid_from", end="valid_until", half_open: bool = False, known_start: bool = False) -> Column:
    """Whether a period holds at ``t``: closed bounds, null open. ``half_open`` excludes the end; ``known_start`` excludes
    an unknown start."""
    s, e = col(start), col(end)
    from_ok = (s <= t) if known_start else (s.isNull() | (s <= t))
    return F.coalesce(from_ok, F.lit(False)) & (e.isNull() | ((e > t) if half_open else (e >= t)))


def tenant(user_id: str | Column, column="user_id") -> Column:
    """Rows of a user and those without one."""
    u = col(column)
    return u.isNull() | (F.trim(u) == "") | (u == (F.lit(user_id) if isinstance(user_id, str) else user_id))


def matches_filters(filters: dict, properties="properties") -> Column:
    """AND of entity_type (any case), min_importance, state, and property equality where the property exists."""
    ok = F.lit(True)
    for k, v in filters.items():
        if k == "entity_type":
            ok = ok & (F.lower("entity_type") == str(v).lower()) if isinstance(v, str) else ok
        elif k == "min_importance":
            ok = ok & (F.col("importance") >= v) if isinstance(v, int) else ok
        elif k == "state":
            ok = ok & (F.col("state") == v) if isinstance(v, str) else ok
        else:
            got = F.get_json_object(col(properties), f"$.{k}")
            ok = ok & (got.isNull() | (got == F.lit(str(v))))
    return F.coalesce(ok, F.lit(False))


# Modality of each file extension, language of each code extension
EXTENSIONS = {
    ".md": "markdown", ".markdown": "markdown",
    ".pdf": "pdf",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".gif": "image", ".webp": "image", ".bmp": "image",
    ".mp3": "audio", ".wav": "audio", ".m4a": "audio", ".flac": "audio", ".ogg": "audio",
    ".py": "code", ".go": "code", ".js": "code", ".ts": "code", ".java": "code", ".cpp": "code", ".c": "code", ".rs": "code",
    ".json": "json",
    ".csv": "csv",
    ".html": "webpage", ".htm": "webpage",
}
LANGUAGES = {".py": "python", ".go": "go", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".rs": "rust", ".rb": "ruby", ".php": "php"}


def extension(uri: Column | str) -> Column:
    return F.regexp_extract(F.lower(col(uri)), r"(\.[^./\\]+)$", 1)


def _lookup(c: Column, table: dict[str, str], other: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(""))).otherwise(other)


def detect_modality(uri: Column | str, content: Column | None = None) -> Column:
    """By extension, then URL prefix, then magic bytes of the content, else text."""
    u = F.coalesce(col(uri), F.lit(""))
    magic = F.lit("text")
    if content is not None:
        head = F.hex(F.substring(content, 1, 8))
        magic = F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E47") | head.startswith("FFD8"), "image").otherwise("text")
    return _lookup(extension(u), EXTENSIONS, F.when(u.rlike("^https?://"), "webpage").otherwise(F.coalesce(magic, F.lit("text"))))


def language(uri: Column | str) -> Column:
    return _lookup(extension(uri), LANGUAGES, F.lit(""))


def is_image(content: Column) -> Column:
    """PNG, JPEG, GIF or WEBP signature; false below eight bytes."""
    h = F.hex(F.substring(content, 1, 12))
    return F.coalesce((F.octet_length(content) >= 8) & (h.startswith("89504E47") | h.startswith("FFD8FF") | h.startswith("474946383761") | h.startswith("474946383961") | (h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"))), F.lit(False))


# What the tag stripper drops, the part it prefers, and the entities it knows, in the order it takes them
HTML_DROPPED = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<(?:nav|header|footer|aside)[^>]*>.*?</(?:nav|header|footer|aside)>")
HTML_MAIN = r"(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>"
HTML_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def html_text(c: Column | str) -> Column:
    """Text of a page by patterns: scripts, styles and navigation dropped, the main part preferred, tags as blanks.

    ``&amp;`` is decoded before the other signs, so a doubly escaped sign is decoded twice.
    """
    t = col(c)
    for pattern in HTML_DROPPED:
        t = F.regexp_replace(t, pattern, "")
    t = F.when(t.rlike(HTML_MAIN), F.regexp_extract(t, HTML_MAIN, 1)).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, "<!--.*?-->", ""), "<[^>]+>", " ")
    for name, ch in HTML_ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(ch))
    return F.btrim(F.regexp_replace(t, r"\s+", " "))


# -- answers of a language model -----------------------------------------------------------------------------------------
def parse_answer(c: Column | str) -> Column:
    """struct<answer, confidence>: strict JSON, else the first brace to the last, else the text with confidence 5."""
    c = col(c)
    kind = "answer string, confidence int"
    ok = lambda x: F.from_json(x, kind, {"mode": "PERMISSIVE"})
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    whole, part = ok(F.trim(c)), ok(F.when(inner != "", inner))
    good = lambda x: x["answer"].isNotNull() & x["confidence"].isNotNull()
    plain = F.struct(F.trim(c).alias("answer"), F.lit(5).alias("confidence"))
    return F.when(F.trim(c).startswith("{") & good(whole), whole).when(good(part), part).otherwise(plain)


def parse_groups(c: Column | str, n: Column) -> Column:
    """Lines of comma-separated item numbers: array<array<int>> of the lines with at least two valid ones (1..n)."""
    lines = F.transform(F.split(col(c), "\n"), lambda line: F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull() & (x >= 1) & (x <= n)))
    return F.filter(lines, lambda g: F.size(g) >= 2)


ENTITY_TUPLE = r'\("entity"\$\$\$\$([^$]*)\$\$\$\$([^$]*)\$\$\$\$([^$]*)\$\$\$\$([^)$]*)\)'
RELATION_TUPLE = r'\("relationship"\$\$\$\$([^$]*)\$\$\$\$([^$]*)\$\$\$\$([^$]*)\$\$\$\$([^$]*)\$\$\$\$([^$]*)\$\$\$\$([^)$]*)\)'


def parse_tuples(c: Column | str, pattern: str, names: tuple[str, ...]) -> Column:
    """array<struct> of the tuples that a model wrote in its delimited form."""
    parts = [F.transform(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(i + 1)), lambda x: F.trim(x)).alias(n) for i, n in enumerate(names)]
    zipped = F.arrays_zip(*parts)
    return F.transform(zipped, lambda x: F.struct(*[x[n].alias(n) for n in names]))
