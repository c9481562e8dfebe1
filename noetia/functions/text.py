"""Chunkers and text extraction. Each is a plain function over one text, run in Arrow batches by :func:`chunk_table`."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetia.functions import expr as X

Chunk = tuple[int, int, str, dict]  # start byte, end byte, content, metadata

# Where sentences, paragraphs, headers and symbols begin
SENTENCE = re.compile(rb"[.!?]\s+[A-Z]")
PARAGRAPH = re.compile(rb"\n\s*\n")
HEADER = re.compile(r"(?m)^(#{1,6})\s+(.+)$")
SYMBOLS = {
    "python": re.compile(r"(?m)^(?:def|class|async def)\s+\w+"),
    "javascript": re.compile(r"(?m)^(?:function|class|const|let|var)\s+\w+"),
    "typescript": re.compile(r"(?m)^(?:function|class|const|let|interface|type)\s+\w+"),
    "go": re.compile(r"(?m)^(?:func|type)\s+\w+"),
}


def text_of(b: bytes) -> str:
    """A byte slice as text; split characters become replacement characters."""
    return b.decode("utf-8", errors="replace")


def sentence_parts(b: bytes, lossless: bool = False) -> list[bytes]:
    """Split at a sentence end before a capital. The pattern's own characters are lost unless ``lossless``."""
    out, at = [], 0
    for m in SENTENCE.finditer(b):
        out.append(b[at : m.start() + 1] if lossless else b[at : m.start()])
        at = m.end() - 1 if lossless else m.end()
    return [*out, b[at:]]


def overlap_tail(b: bytes, overlap: int, sentences: bool) -> bytes:
    """What a chunk hands to the next: its last bytes, from a sentence start or a word start."""
    if overlap <= 0:
        return b""
    if len(b) <= overlap:
        return b
    tail = b[-overlap:]
    if sentences and (m := re.search(rb"[.!?]\s+", tail)):
        return tail[m.end() :]
    space = tail.find(b" ")
    return tail[space + 1 :] if space > 0 else tail


def pack_units(units: list[bytes], size: int, overlap: int, smallest: int, sentences: bool) -> list[Chunk]:
    """Units joined by blanks up to ``size`` bytes; offsets count in the joined text."""
    out: list[Chunk] = []
    cur, start = b"", 0
    for u in (x.strip() for x in units):
        if not u:
            continue
        if not cur or len(cur) + len(u) + 1 <= size:
            cur = cur + b" " + u if cur else u
            continue
        if len(cur) >= smallest:
            out.append((start, start + len(cur), text_of(cur), {}))
        tail = overlap_tail(cur, overlap, sentences)
        start += len(cur) - len(tail)
        cur = tail + b" " + u if tail else u
    if cur and (len(cur) >= smallest or not out):
        out.append((start, start + len(cur), text_of(cur), {}))
    return out


def by_characters(b: bytes, size: int, overlap: int, smallest: int) -> list[Chunk]:
    """Windows of ``size`` bytes that end at a sentence end within the last 200, if there is one."""
    out: list[Chunk] = []
    at = 0
    while at < len(b):
        end = min(at + size, len(b))
        if end < len(b):
            for p in range(end - 1, max(at + smallest, end - 200) - 1, -1):
                if b[p : p + 1] in (b".", b"!", b"?") and b[p + 1 : p + 2] in (b" ", b"\n", b"\t"):
                    end = p + 1
                    break
        if piece := b[at:end].strip():
            out.append((at, end, text_of(piece), {}))
        if end >= len(b):
            break
        at = max(end - overlap, at + 1)
    return out


def chunk_document(text: str, size: int = 1000, overlap: int = 200, smallest: int = 100, sentences: bool = True, paragraphs: bool = True) -> list[Chunk]:
    """Paragraphs if there are several, else sentences, else windows of bytes."""
    b = text.strip().encode()
    if not b:
        return []
    if paragraphs and len(parts := PARAGRAPH.split(b)) > 1:
        return pack_units(parts, size, overlap, smallest, sentences)
    if sentences and len(parts := sentence_parts(b)) > 1:
        return pack_units(parts, size, overlap, smallest, sentences)
    return by_characters(b, size, overlap, smallest)


def chunk_plain(text: str, size: int = 1000, overlap: int = 200) -> list[Chunk]:
    return chunk_document(text, size, overlap, 0, False, False)


def chunk_markdown(text: str, size: int = 1000, overlap: int = 200) -> list[Chunk]:
    """A chunk per section with its header level; long sections are cut further."""
    heads = list(HEADER.finditer(text))
    if not heads:
        return chunk_plain(text, size, overlap)
    bounds = [(0, heads[0].start(), 0, "")] + [(m.start(), n.start() if n else len(text), len(m.group(1)), m.group(2).strip()) for m, n in zip(heads, [*heads[1:], None])]
    out: list[Chunk] = []
    for lo, hi, level, title in bounds:
        part = text[lo:hi].strip()
        if not part:
            continue
        meta = {"header_level": str(level), "title": title}
        if len(part.encode()) > size:
            out.extend((s, e, c, {**m, **meta}) for s, e, c, m in chunk_document(part, size, overlap))
        else:
            out.append((0, 0, part, meta))
    return out


def chunk_code(text: str, language: str, size: int = 1000, overlap: int = 200) -> list[Chunk]:
    """A chunk per top-level symbol; text before the first is dropped; unknown languages are cut as documents."""
    found = list(SYMBOLS[language].finditer(text)) if language in SYMBOLS else []
    if not found:
        return chunk_document(text, size, overlap)
    out = []
    for m, n in zip(found, [*found[1:], None]):
        end = n.start() if n else len(text)
        part = text[m.start() : end].strip()
        out.append((len(text[: m.start()].encode()), len(text[:end].encode()), part, {"language": language, "symbol": m.group()}))
    return out


def chunk_sentences(text: str, size: int = 2048, overlap: int = 200) -> list[Chunk]:
    """For extraction: the whole text if it fits, else sentences (without their marks) packed with whole-sentence overlap."""
    if len(text.encode()) <= size:
        return [(0, len(text.encode()), text, {})] if text.strip() else []
    out: list[Chunk] = []
    cur: list[str] = []
    length = 0
    for s in re.split(r"[.!?]\s+", text):
        n = len(s.encode())
        if cur and length + n > size:
            out.append((0, 0, ". ".join(cur), {}))
            keep, kept = [], 0
            for x in reversed(cur):
                if kept >= overlap:
                    break
                keep.insert(0, x)
                kept += len(x.encode())
            cur, length = (keep, kept) if kept + n <= size else ([], 0)
        cur.append(s)
        length += n
    if cur:
        out.append((0, 0, ". ".join(cur), {}))
    return out


# -- extraction ------------------------------------------------------------------------------------------------------------
_SKIP = {"script", "style", "nav", "footer", "header", "aside"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip, self.title, self.meta, self.in_title = [], 0, "", "", False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and (a.get("name") or "").lower() == "description":
            self.meta = a.get("content") or ""

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip and data.strip():
            self.parts.append(data.strip())


def html_dom_text(html: str) -> tuple[str, str, str]:
    """(text, title, description) by walking the tags."""
    p = _Page()
    p.feed(html)
    p.close()
    return "\n".join(p.parts), p.title.strip(), p.meta


def json_to_text(value, depth: int = 0) -> str:
    """A value as indented lines, keys sorted; long arrays are cut with a note."""
    pad = "  " * depth
    if isinstance(value, dict):
        lines = []
        for k in sorted(value):
            v = value[k]
            lines.append(f"{pad}{k}:\n{json_to_text(v, depth + 1)}" if isinstance(v, (dict, list)) else f"{pad}{k}: {_scalar(v)}")
        return "\n".join(lines)
    if isinstance(value, list):
        lines = [f"{pad}- {json_to_text(v, depth + 1).lstrip() if isinstance(v, (dict, list)) else _scalar(v)}" for v in value[:100]]
        return "\n".join(lines + ([f"{pad}... and {len(value) - 100} more items"] if len(value) > 100 else []))
    return pad + _scalar(value)


def _scalar(v) -> str:
    return "null" if v is None else ("true" if v else "false") if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else str(v)


def json_text(text: str) -> tuple[str, dict]:
    try:
        return json_to_text(json.loads(text)), {"structured": "true"}
    except ValueError:
        return text, {}


def csv_text(text: str) -> tuple[str, dict]:
    """Rows as ``header: value`` lines; ragged or broken tables stay text."""
    try:
        rows = [r for r in csv.reader(io.StringIO(text), strict=True) if r]
    except csv.Error:
        return text, {}
    if not rows or any(len(r) != len(rows[0]) for r in rows):
        return text, {}
    head, out = rows[0], []
    for i, r in enumerate(rows[1:1001], 1):
        cells = [f"{h.strip() or f'col{j + 1}'}: {c}" for j, (h, c) in enumerate(zip(head, r)) if c.strip()]
        out.append(f"Row {i}: " + ", ".join(cells))
    if len(rows) > 1001:
        out.append(f"... and {len(rows) - 1001} more rows")
    return "\n".join(out), {"row_count": str(len(rows)), "structured": "true"}


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)


def pdf_text(content: bytes) -> str:
    """Strings in parentheses between text marks, page stream by page stream in their order, compressed ones inflated; a note
    where there are none."""
    streams = [m.group(1) for m in _STREAM.finditer(content)]
    pages = []
    for raw in streams or [content]:
        try:
            raw = zlib.decompressobj().decompress(raw)
        except zlib.error:
            pass  # not compressed
        out = []
        for block in re.findall(rb"BT(.*?)ET", raw, re.S):
            for m in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", block, re.S):
                out.append(re.sub(rb"\\([()\\])", rb"\1", m).decode("latin-1"))
        if text := " ".join(x for x in out if x.strip()):
            pages.append(text)
    return "\n".join(pages) or "[PDF without extractable text]"


def docx_text(content: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            xml = z.read("word/document.xml").decode("utf-8", errors="replace")
    except (zipfile.BadZipFile, KeyError):
        return ""
    return re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", " ", xml.replace("</w:p>", "\n"))).strip()


def process(text: str, modality: str, language: str = "") -> list[Chunk]:
    """Chunks of a document by modality; unknown ones are text."""
    if modality == "markdown":
        return chunk_markdown(text)
    if modality == "code":
        return chunk_code(text, language)
    if modality == "webpage":
        body, title, about = html_dom_text(text)
        return [(s, e, c, {**m, "title": title, "description": about}) for s, e, c, m in chunk_markdown(body)]
    if modality in ("json", "csv"):
        body, meta = (json_text if modality == "json" else csv_text)(text)
        return [(s, e, c, {**m, **meta}) for s, e, c, m in chunk_plain(body)]
    if modality == "image":
        return [(0, 0, f"[Image of {len(text)} bytes]", {"image_analysis": "true"})]
    if modality == "audio":
        return [(0, 0, "[Audio without transcript]", {"transcribed": "false"})]
    return chunk_plain(text)


TABLE = "id string, source_id string, chunk_index int, start_char int, end_char int, content string, modality string, metadata map<string,string>"


def chunk_table(docs: DataFrame, chunker: Callable[..., list[Chunk]], key: str = "doc_id", text: str = "text", modality: str = "modality", uri: str | None = None) -> DataFrame:
    """Chunks of every document as a table. ``chunker(text, modality)``, with the programming language of the file's name as
    a third argument where ``uri`` names its column; null texts give none. Ids are hashes of document and index, so a
    repeated task writes the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        names = [x.split()[0] for x in TABLE.split(", ")]
        for b in batches:
            rows = []
            for k, t, m, *language in zip(*(c.to_pylist() for c in b.columns)):
                if t is None:
                    continue
                for i, (s, e, c, meta) in enumerate(chunker(t, m or "text", *language)):
                    rows.append((hashlib.sha256(f"{k}:{i}".encode()).hexdigest()[:32], k, i, s, e, c, m, list(meta.items())))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    language = [] if uri is None else [X.language(uri).alias("l")]
    return docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(modality).alias("m"), *language).mapInArrow(run, TABLE)


def register_table_functions(spark) -> None:
    """The chunkers for SQL: ``LATERAL chunk_text(text, size, overlap)``, ``chunk_sections``, ``chunk_sentence_groups`` and
    ``chunk_symbols(text, language)``, each with chunk_index, start_char, end_char, content and metadata."""
    from pyspark.sql.functions import udtf

    columns = "chunk_index int, start_char int, end_char int, content string, metadata map<string,string>"

    def rows(chunks):
        for i, (s, e, c, m) in enumerate(chunks):
            yield i, s, e, c, m

    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            yield from rows(chunk_document(text, size, overlap) if text is not None else ())

    class ChunkSections:
        def eval(self, text: str, size: int, overlap: int):
            yield from rows(chunk_markdown(text, size, overlap) if text is not None else ())

    class ChunkSentenceGroups:
        def eval(self, text: str, size: int, overlap: int):
            yield from rows(chunk_sentences(text, size, overlap) if text is not None else ())

    class ChunkSymbols:
        def eval(self, text: str, language: str):
            yield from rows(chunk_code(text, (language or "").lower()) if text is not None else ())

    for name, f in (("chunk_text", ChunkText), ("chunk_sections", ChunkSections), ("chunk_sentence_groups", ChunkSentenceGroups), ("chunk_symbols", ChunkSymbols)):
        spark.udtf.register(name, udtf(f, returnType=columns))


def fixed_chunks(docs: DataFrame, size: int = 2000, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` bytes with ids ``doc_i``, each ``overlap`` bytes before the end of the one before; the last one
    ends with the text. Split characters become replacement characters in ``content``; ``raw`` has the bytes themselves."""
    n, step = F.octet_length(text), size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    d = docs.where(n > 0).select(F.col(key), F.encode(F.col(text), "UTF-8").alias("_bytes"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    raw = F.substring(F.col("_bytes"), F.col("i") * step + 1, F.lit(size))
    return d.select(F.concat_ws("_", F.col(key).cast("string"), F.col("i").cast("string")).alias("id"), F.col(key), F.col("i").alias("chunk_index"), F.make_valid_utf8(raw.cast("string")).alias("content"), raw.alias("raw"))


def sentence_split(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Parts of a text at the lossy sentence pattern, by Spark's own split."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), r"[.!?][ \t\n\f\r]+[A-Z]")).alias("part_index", "part"))


html_text = X.html_text
