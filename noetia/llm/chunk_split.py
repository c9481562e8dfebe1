"""Splitting oversized chunks at natural boundaries.

Balanced targets: the least number of pieces that can hold the text sets equally spaced targets for the cuts; each target
is moved to the strongest boundary near it, and where a limit fails the split is tried again with one piece more.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetia.session import cut, norm_id

LIMIT_BYTES, OVERLAP_BYTES = 1000, 200
#: Chunks of one document that are split in one task; a document with more goes to several.
CHUNKS_PER_TASK = 2048
#: Such documents that are broadcast at most; more are joined.
BROADCAST_SOURCES = 100_000
EDGE_BLANKS = " \t\r\n"

_SPACE = re.compile(rb"(?:[ \t\r\n\x0b\x0c]|\xc2\xa0|\xe3\x80\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf])+")
_INNER = re.compile(rb"(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)|(?:\xe3\x80\x81|\xef\xbc\x8c|\xef\xbc\x9b|\xef\xbc\x9a)|[,;|}\])>](?=[^\s,;|}\])>])")
_SENTENCE_END = re.compile(rb"(?:[.!?]|\xe2\x80\xa6|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[\"')\]]*(?:\xe2\x80[\x99\x9d]|\xc2\xbb)?$")
_CJK_STOPS = (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f")
#: Strengths: blank line, line end after a sentence, line end, sentence end, clause, blank, inner punctuation.
_PARAGRAPH, _FULL_LINE, _LINE, _SENTENCE, _CLAUSE, _WORD, _INSIDE = 7, 6, 5, 4, 3, 2, 1


def boundaries(b: bytes) -> tuple[list[int], list[int]]:
    """Places in ``b`` where a piece may end, in order, and how strong each is."""
    at: list[int] = []
    strength: list[int] = []
    found = {}
    for m in _SPACE.finditer(b):
        p, run = m.start(), m.group()
        if p == 0 or m.end() == len(b):
            continue
        lines = run.count(b"\n") or run.count(b"\r") or run.count(b"\xe2\x80\xa8") + 2 * run.count(b"\xe2\x80\xa9")
        ends = _SENTENCE_END.search(b, max(0, p - 8), p) is not None
        if lines > 1:
            s = _PARAGRAPH
        elif lines:
            s = _FULL_LINE if ends or b[m.end() : m.end() + 1] in (b"#", b"-", b"*") else _LINE
        elif ends:
            s = _SENTENCE
        else:
            s = _CLAUSE if b[p - 1 : p] in (b",", b";", b":") else _WORD
        found[p] = s
    for m in _INNER.finditer(b):
        if m.end() < len(b):
            s = _SENTENCE if m.group() in _CJK_STOPS else _CLAUSE if len(m.group()) > 1 else _INSIDE
            found[m.end()] = max(s, found.get(m.end(), 0))
    for p in sorted(found):
        at.append(p)
        strength.append(found[p])
    return at, strength


def _char_start(b: bytes, p: int) -> int:
    """The nearest place at or before ``p`` between two characters, not before a combining mark or joiner."""
    while 0 < p < len(b):
        if b[p] & 0xC0 == 0x80 or (b[p] == 0xCC and b[p + 1] >= 0x80) or (b[p] == 0xCD and b[p + 1] <= 0xAF) or b[p : p + 3] == b"\xe2\x80\x8d" or b[p : p + 2] == b"\xef\xb8":
            p -= 1
        else:
            break
    return p


def _code_point_start(b: bytes, p: int) -> int:
    while 0 < p < len(b) and b[p] & 0xC0 == 0x80:
        p -= 1
    return p


def split_bytes(b: bytes, limit: int = LIMIT_BYTES, overlap: int = OVERLAP_BYTES) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``b``: each at most ``limit`` bytes, each but the first starting ``overlap`` bytes
    before the end of the piece before (up to twelve more, to start at a character and not at a mark that belongs to it)."""
    if not 0 <= overlap < limit - 4:
        raise ValueError("overlap must be smaller than the limit by more than a character")
    n = len(b)
    if n <= limit:
        return [(0, n)]
    at, strength = boundaries(b)
    k = max(2, -(-(n - overlap) // (limit - overlap)))
    for extra in range(12):
        if (out := _balanced(b, at, strength, k + extra, limit, overlap)) is not None:
            return out
    return _greedy(b, at, limit, overlap)


def _next_start(b: bytes, end: int, limit: int, overlap: int) -> int:
    p = _char_start(b, end - overlap)
    return p if end - p <= min(overlap + 12, limit - 5) else _code_point_start(b, end - overlap)


def _hard(b: bytes, least: int, p: int) -> int:
    q = _char_start(b, p)
    return q if q >= least else _code_point_start(b, p)


def _balanced(b, at, strength, k, limit, overlap):
    n, s, prev, out = len(b), 0, 0, []
    piece = (n - overlap) / k + overlap
    near = max(60.0, min(piece - overlap, limit / 2) / 2)
    for i in range(1, k):
        target = overlap + i * (n - overlap) / k
        least, most = max(prev + 1, s + overlap + 1 if s else 1), min(s + limit, n - 1)
        if least > most:
            return None
        lo, hi = bisect_left(at, max(least, target - near)), bisect_right(at, min(most, target + near))
        if lo >= hi:
            lo, hi = bisect_left(at, least), bisect_right(at, most)
        if lo < hi:
            j = max(range(lo, hi), key=lambda j: (strength[j], -abs(at[j] - target)))
            e = at[j]
        else:
            e = _hard(b, least, min(most, max(least, round(target))))
            if e < least:
                return None
        out.append((s, e))
        prev, s = e, _next_start(b, e, limit, overlap)
    if n - s > limit:
        return None
    out.append((s, n))
    return out


def _greedy(b, at, limit, overlap):
    n, s, prev, out = len(b), 0, 0, []
    while n - s > limit:
        j = bisect_right(at, s + limit) - 1
        least = max(prev, s + overlap) + 1
        e = at[j] if j >= 0 and at[j] >= least else max(_hard(b, least, s + limit), prev + 1)
        out.append((s, e))
        prev, s = e, _next_start(b, e, limit, overlap)
    out.append((s, n))
    return out


def locate(doc: bytes | None, b: bytes, hint: int | None) -> int | None:
    """Where ``b`` is in ``doc``: at the hint, else at the occurrence nearest to it, else (without a hint) the first."""
    if doc is None:
        return None
    if hint is not None and 0 <= hint and doc[hint : hint + len(b)] == b:
        return hint
    best, p = None, doc.find(b)
    while p >= 0:
        if best is None or (hint is not None and abs(p - hint) < abs(best - hint)):
            best = p
        if hint is None or p >= hint:
            break
        p = doc.find(b, p + 1)
    return best


def _split_batches(limit: int, overlap: int):
    """Rows sorted by (part, is_chunk): the documents of a part come before its chunks and are held until the next part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, out = None, [], []
        for batch in batches:
            for part, is_chunk, cid, sid, modality, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    now, docs = part, []
                if not is_chunk:
                    docs.append(text)
                    continue
                b = text.strip(EDGE_BLANKS.encode())
                lead = len(text) - len(text.lstrip(EDGE_BLANKS.encode()))
                hint = None if start is None else start + lead
                base = next((at for d in docs if (at := locate(d, b, hint)) is not None), None)
                located = base is not None
                if base is None:
                    base = hint
                pieces = split_bytes(b, limit, overlap)
                for i, (s, e) in enumerate(pieces):
                    out.append((cid, sid, modality, i, len(pieces), s, None if base is None else base + s, None if base is None else base + e, located, b[s:e].decode()))
                if len(out) > 4000:
                    yield _rows(out)
                    out = []
        if out:
            yield _rows(out)

    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


PIECES = "chunk_id string, source_id string, modality string, piece_index int, n_pieces int, offset int, start_char bigint, end_char bigint, located boolean, content string"


def split_chunks(chunks: DataFrame, documents: DataFrame, limit: int = LIMIT_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """Pieces of every chunk whose content, without blanks at both ends, is longer than ``limit`` bytes.

    Returns chunk_id, source_id, modality, piece_index (from 0), n_pieces, offset (in the trimmed content), start_char,
    end_char (bytes in the document), located (found in the document; else the offsets rest on the chunk's own, or are
    null), content. Pieces joined with their overlaps dropped give the trimmed content again. Chunks with null, empty or
    short content, or a null id, give no rows; a redelivered chunk counts once (of different rows with one id the longest
    content holds). A chunk whose source_id names no document, or whose content isn't in it, is split all the same; one
    without a source_id counts as a source of its own. Of documents with one id any may hold the chunk. Text without any
    boundary is cut between characters.

    A document's text travels once, ahead of its chunks; one with very many chunks is sent to several tasks.
    """
    big = chunks.select(
        norm_id("id").alias("chunk_id"),
        norm_id("source_id").alias("source_id"),
        "modality",
        F.col("start_char").cast("bigint").alias("start_char"),
        "content",
    ).where(F.col("chunk_id").isNotNull() & (F.octet_length(F.btrim("content", F.lit(EDGE_BLANKS))) > limit))
    one = big.groupBy("chunk_id").agg(F.max(F.struct(F.octet_length("content").alias("n"), "content", "source_id", "modality", "start_char")).alias("c"))
    one = cut(one.select("chunk_id", "c.source_id", "c.modality", "c.start_char", "c.content"))
    many = one.where("source_id is not null").groupBy("source_id").agg(F.ceil(F.count("*") / F.lit(CHUNKS_PER_TASK)).cast("int").alias("salts")).where("salts > 1")
    docs = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("string").alias("source_id"), F.encode("text", "UTF-8").alias("text"))
    n_many = many.count()
    salted = lambda df, salt: df.withColumn("salt", F.lit(0)) if not n_many else df.join(F.broadcast(many) if n_many <= BROADCAST_SOURCES else many, "source_id", "left").withColumn("salt", salt)
    docs = salted(docs, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    one = salted(one, F.pmod(F.xxhash64("chunk_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    part = lambda source: F.concat_ws(":", "salt", source).alias("part")
    null = F.lit(None).cast("string")
    rows = docs.select(part(F.col("source_id")), F.lit(False).alias("is_chunk"), null.alias("chunk_id"), null.alias("source_id"), null.alias("modality"), F.lit(None).cast("bigint").alias("start_char"), "text")
    rows = rows.unionByName(one.select(part(F.coalesce("source_id", F.concat(F.lit("~"), "chunk_id"))), F.lit(True).alias("is_chunk"), "chunk_id", "source_id", "modality", "start_char", F.encode("content", "UTF-8").alias("text")))
    return rows.repartition("part").sortWithinPartitions("part", "is_chunk").mapInArrow(_split_batches(limit, overlap), PIECES)


def rejoined(pieces: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``chunk_id``, ``within_limit``, ``text_hash``: whether all pieces keep the limit, and the MD5 of the text that the pieces
    give when what overlaps is dropped. The pieces of one chunk are as many as its own length allows."""
    p = F.encode("content", "UTF-8")
    rows = pieces.groupBy("chunk_id").agg(F.max(F.octet_length("content")).alias("longest"), F.sort_array(F.collect_list(F.struct("offset", p.alias("b")))).alias("x"))
    start = F.struct(F.lit(0).alias("end"), F.encode(F.lit(""), "UTF-8").alias("b"))
    add = lambda a, x: F.struct((x["offset"] + F.octet_length(x["b"])).alias("end"), F.concat(a["b"], F.substring(x["b"], a["end"] - x["offset"] + 1, F.octet_length(x["b"]))).alias("b"))
    return rows.select("chunk_id", (F.col("longest") <= limit).alias("within_limit"), F.md5(F.aggregate("x", start, add)["b"]).alias("text_hash"))


def oversized_chunks(pieces: DataFrame) -> DataFrame:
    """Ids of the chunks that the splitter cut."""
    return pieces.where("n_pieces > 1 and piece_index = 0").select("chunk_id")
