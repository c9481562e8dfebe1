"""Encoding of whole texts with a public byte-level BPE as a streaming transducer, and incremental decoding.

A text is taken in blocks. Words of the pre-tokenizer are emitted once no further text can change them; what is left is
carried over, so memory is bounded by the block. A word longer than ``LONG_WORD`` bytes is encoded by a transducer over
its bytes: the last token of every prefix is found from the prefixes before it (it is the one that merges with its
predecessor no further), and a token is emitted once all prefixes that later bytes can build on have it in common. Later
bytes build on the last ``longest token`` prefixes only; that is the lookahead the merge list needs.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: how this vocabulary cuts a text into words
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text beyond a word's end that can change it (a contraction has three).
WORD_LOOKAHEAD = 3
BLOCK_CHARS = 8192
LONG_WORD = 256
#: Prefixes after which the long-word transducer looks for stable tokens.
STEP = 2048


class ByteBpe:
    """A byte-level BPE given as ranks (``token bytes -> id``, the id being the merge order)."""

    def __init__(self, path: str):
        lines = Path(path).read_bytes().splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._native = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._words = regex.compile(PATTERN)
        self.pair_is_stable = lru_cache(1 << 18)(self._pair_is_stable)

    # -- words ------------------------------------------------------------------------------------------------------
    def _merge(self, word: bytes) -> list[int]:
        return self._native._encode_single_piece(word)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty ones. Strings of special tokens are ordinary text."""
        if not text:
            return []
        return [i for part in self.encode_stream(text[at : at + BLOCK_CHARS] for at in range(0, len(text), BLOCK_CHARS)) for i in part]

    def encode_stream(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Ids as they become stable, from any cutting of the text into blocks."""
        held, word, kind = "", None, ""
        for block in blocks:
            held += block
            if word is not None:  # inside a word that may go on for ever
                run = regex.match(rf"{kind}*+", held).end()
                over = run < len(held)
                keep = int(kind == r"\s")  # the last blank of a run belongs to what follows
                yield word.push(held[: max(0, run - keep)].encode())
                held = held[max(0, run - keep) :]
                if not over:
                    continue
                yield word.finish()
                word = None
            if stable := self._stable(held):
                yield self._encode_stable(held[:stable])
                held = held[stable:]
            if len(held) > 2 * BLOCK_CHARS and (kind := self._open_word(held)):
                word = _LongWord(self)
                keep = int(kind == r"\s")
                yield word.push(held[: len(held) - keep].encode())
                held = held[len(held) - keep :]
        if word is not None:
            yield word.push(held.encode()) + word.finish()
        elif held:
            yield self._encode_stable(held)

    def _stable(self, text: str) -> int:
        """Length of the part of ``text`` whose words no further text can change."""
        # a blank after something else always starts a word, whatever follows; look near the end first
        for at in range(len(text) - WORD_LOOKAHEAD, max(0, len(text) - 512), -1):
            if text[at].isspace() and not text[at - 1].isspace() and self._is_blank(text[at]) and not self._is_blank(text[at - 1]):
                return at
        end = 0
        for m in self._words.finditer(text):
            if m.end() > len(text) - WORD_LOOKAHEAD:
                break
            if not self._is_blank(text[m.end() - 1]):  # blanks are read with what follows them
                end = m.end()
        return end

    @staticmethod
    @lru_cache(4096)
    def _is_blank(ch: str) -> bool:
        return regex.match(r"\s", ch) is not None

    _KINDS = (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s")

    def _open_word(self, text: str) -> str | None:
        """The class of characters of which ``text`` is one word so far."""
        for kind in self._KINDS:
            if regex.fullmatch(rf" ?{kind}{{2,}}+", text):
                return kind
        return None

    def _encode_stable(self, text: str) -> list[int]:
        longest = max((m.end() - m.start() for m in self._words.finditer(text)), default=0) if len(text) > LONG_WORD and self._has_long(text) else 0
        if longest <= LONG_WORD:
            return self._native.encode_ordinary(text)
        out: list[int] = []
        for m in self._words.finditer(text):
            word = m.group().encode()
            if len(word) > LONG_WORD:
                w = _LongWord(self)
                out += w.push(word) + w.finish()
            else:
                out += self._native.encode_ordinary(m.group()) if not m.group().isspace() else self._merge(word)
        return out

    @staticmethod
    def _has_long(text: str) -> bool:
        return max(map(len, text.split(" ")), default=0) > LONG_WORD or " " * LONG_WORD in text

    # -- long words -------------------------------------------------------------------------------------------------
    def _pair_is_stable(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side encode to themselves."""
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    # -- decoding ---------------------------------------------------------------------------------------------------
    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as its characters become complete; bytes that are no text come out as replacement characters."""
        state = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in ids:
            if piece := state.decode(self.bytes_of[i]):
                yield piece
        if piece := state.decode(b"", final=True):
            yield piece

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


class _LongWord:
    """Transducer over the bytes of one word. Keeps the last ``longest token`` bytes and what isn't emitted yet."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.tail = b""
        self.n = 0
        self.base = 0  # prefix up to which tokens are emitted
        self.last = {0: (-1, 0)}  # prefix length -> (last token, length of the prefix before it)

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        ranks, longest, stable = self.bpe.ranks, self.bpe.longest, self.bpe.pair_is_stable
        for at in range(0, len(data), STEP):
            for byte in data[at : at + STEP]:
                self.tail = (self.tail + bytes((byte,)))[-longest:]
                self.n += 1
                tail, n = self.tail, self.n
                for size in range(len(tail), 0, -1):
                    t = ranks.get(tail[-size:])
                    if t is None or (before := self.last.get(n - size)) is None:
                        continue
                    if before[0] < 0 or stable(before[0], t):
                        self.last[n] = (t, n - size)
                        break
            out += self._emit()
        return out

    def _emit(self) -> list[int]:
        """Tokens on which the last prefixes agree; forgets what lies before them."""
        live = {p for p in range(max(self.base, self.n - self.bpe.longest + 1), self.n + 1) if p in self.last}
        while len(live) > 1:  # the largest gives way to its predecessor until one prefix is left
            top = max(live)
            live.discard(top)
            live.add(max(self.last[top][1], self.base))
        return self._upto(live.pop()) if live else []

    def _upto(self, end: int) -> list[int]:
        ids, p = [], end
        while p > self.base:
            t, p = self.last[p]
            ids.append(t)
        if end > self.base:
            self.base = end
            self.last = {p: x for p, x in self.last.items() if p >= end}
            self.last[end] = (ids[0], end)
        return ids[::-1]

    def finish(self) -> list[int]:
        return self._upto(self.n)


@lru_cache(4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def vocabulary_path(name: str = VOCABULARY, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for all cores where a table comes in fewer files than there are cores; else the scan's own."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key``, ``ids`` (list of integers) of every row; null and empty texts give an empty list.

    Whole texts are encoded, without special tokens; each row keeps its key, repeated and null keys included. An empty
    table gives no rows. ``path`` names the vocabulary's rank file on the executors.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids, sizes, start, total = [], [], 0, 0
            for i, t in enumerate(b.column(1).to_pylist()):
                x = bpe.encode(t)
                ids.append(np.array(x, np.int32))
                sizes.append(len(x))
                total += len(x)
                if total > 1_000_000:
                    yield _lists(b.column(0).slice(start, i + 1 - start), ids, sizes)
                    ids, sizes, start, total = [], [], i + 1, 0
            if sizes:
                yield _lists(b.column(0).slice(start), ids, sizes)

    def _lists(keys, ids, sizes):
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; null and empty texts have none."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n = pa.array([len(bpe.encode(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
    return spread(df.select(*keep, text)).mapInArrow(run, f"{schema}, n_tokens bigint")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key``, ``n_tokens``, ``exact``: whether decoding the ids gives the text again (null counts as empty), and the MD5
    ``text_hash`` of what they give."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, ok, md5 = [], [], []
            for t in b.column(1).to_pylist():
                x = bpe.encode(t)
                back = bpe.decode(x)
                n.append(len(x))
                ok.append(back == (t or ""))
                md5.append(hashlib.md5(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ok, pa.bool_()), pa.array(md5, pa.string())], names=[key, "n_tokens", "exact", "text_hash"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"{key} {kind}, n_tokens bigint, exact boolean, text_hash string")
