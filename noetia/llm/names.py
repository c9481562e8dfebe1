"""Variant spellings of names of persons and organisations.

Metric-space partitioning: the pivots are the given names and the branch words that recur in the table; a name goes to
the cell of its pivot within its memory and type (a large cell is cut into blocks), and by the triangle inequality also to every pivot that a name within
the search radius could have chosen. A given name that is near no pivot goes to those pivots as well, and to one cell for
each string left of its surname by the deletions its radius allows, so two rare given names meet too. Inside a cell the distinctive part (surname, company core) is joined exactly within
a radius of the Damerau-Levenshtein metric. Forms that leave a part out (initials, acronyms, no branch) link only where
they fit one entity. The links' connected components are the entities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetia.operators.components import connected_components
from noetia.session import BLANKS, cut, norm_id

PERSON, ORGANISATION = "person", "organization"
#: A token is a pivot if it is in at least this share of a type's names and in so many memories; so there are at most
#: a few thousand, whatever the table's size (names have few tokens).
PIVOT_SHARE, PIVOT_MEMORIES = 0.001, 4
GIVEN_RADIUS = 1
#: A given name that no pivot and no table explains is learned as a short form of the one that shares its surname and memory
#: in at least so many places, and in this share of the places where any does; and in this share of all names, so that at
#: most a hundred thousand are learned.
LEARNED_PLACES, LEARNED_SHARE, LEARNED_LEAST = 2, 0.8, 1e-5
#: Nicknames that the table may hold at most; they are passed to every task.
MOST_NICKNAMES = 1_000_000
#: Rows of a cell above which it is cut into blocks by its parts, whose pairs are tasks of their own.
CELL_ROWS = 4096
#: Ids of one class in a block: the pairs of a larger class are spread over pairs of blocks.
BLOCK_IDS = 1024

# Fixed values
TITLES = frozenset("mr mrs ms miss dr prof professor herr frau sra sr mme mlle monsieur madame don dona ing sir lady".split())
SUFFIXES = frozenset("jr sr ii iii iv junior senior".split())
LEGAL = frozenset("inc incorporated llc ltd limited corp corporation gmbh ag sarl sa bv oy oyj plc kg se spa srl aktiengesellschaft".split())
FILLER = frozenset("the company co group holding and of und et y de".split())
_SPECIAL = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "'", "‐": "-", "–": "-"})
_OCR = str.maketrans("015348", "olseab")


def fold(s: str) -> str:
    """Lower case without marks; any white space as a blank."""
    s = unicodedata.normalize("NFKD", s).lower().translate(_SPECIAL)
    return " ".join("".join(ch for ch in s if not unicodedata.combining(ch) and (ch.isspace() or ch.isprintable())).split())


def _word(t: str) -> str:
    """Digits inside a word are read as the letters they look like."""
    return t.translate(_OCR) if not t.isdigit() and any(ch.isdigit() for ch in t) and sum(map(str.isalpha, t)) > 2 else t


def edit_distance(a: str, b: str, most: int = 99) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions (a true metric); ``most + 1`` if it is more."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    big = n + m
    d = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    last: dict[str, int] = {}
    for i in range(1, n + 1):
        seen = 0
        row, above, ca, low = d[i + 1], d[i], a[i - 1], big
        for j in range(1, m + 1):
            cb = b[j - 1]
            k, q = last.get(cb, 0), seen
            cost = 1
            if ca == cb:
                cost, seen = 0, j
            v = min(above[j] + cost, row[j] + 1, above[j + 1] + 1, d[k][q] + (i - k - 1) + 1 + (j - q - 1))
            row[j + 1] = v
            low = min(low, v)
        last[ca] = i
        if low > most + 1 and i > 2:
            return most + 1
    return min(d[n + 1][m + 1], most + 1)


def radius(s: str) -> int:
    """Edits allowed in a distinctive part of this length."""
    return 2 if len(s) >= 8 else 1 if len(s) >= 5 else 0


@dataclass(frozen=True)
class Form:
    """One spelling, taken apart. ``part``: surname or company core; ``lead``: given name or branch, None where left out."""

    part: str
    lead: str | None
    initial: str = ""
    middle: str = ""
    suffix: str = ""
    acronyms: tuple[str, ...] = ()


class Lexicon:
    """Pivots of both types and the nicknames; small and passed to every task."""

    def __init__(self, given: list[str], branch: list[str], nicknames: list[tuple[str, str]]):
        self.nick: dict[str, set[str]] = {}
        names = {fold(g) for g in given}
        for full, nick in nicknames:
            if full and nick:
                names.add(fold(full))
                self.nick.setdefault(fold(nick), set()).add(fold(full))
        shorts = set(self.nick)
        self.given = frozenset(g for g in names if len(g) > 1 and g not in shorts and g not in TITLES and g not in SUFFIXES)
        self.branch = frozenset(b for b in map(fold, branch) if len(b) > 2 and b not in LEGAL and b not in FILLER)
        self._caches()

    def _caches(self):
        self.by_length = sorted(self.given, key=lambda g: (-len(g), g))
        self.near_given = lru_cache(200_000)(self._near_given)
        self.far_given = lru_cache(200_000)(self._far_given)
        self.near_branch = lru_cache(200_000)(self._near_branch)

    def __getstate__(self):
        return {"nick": self.nick, "given": self.given, "branch": self.branch}

    def __setstate__(self, s):
        self.__dict__.update(s)
        self._caches()

    def with_nicknames(self, more: list[tuple[str, str]]) -> Lexicon:
        """The same with further (given name, nickname) pairs; given names stay what they are."""
        out = Lexicon([], [], [])
        out.given, out.branch, out.nick = self.given, self.branch, {k: set(v) for k, v in self.nick.items()}
        for full, nick in more:
            out.nick.setdefault(nick, set()).add(full)
        out._caches()
        return out

    def _near_given(self, t: str) -> tuple[tuple[str, ...], bool]:
        """Given names that ``t`` may stand for, nearest pivots first with their margin; whether it is one at all."""
        if t in self.given:
            close = [g for g in self.given if g != t and abs(len(g) - len(t)) <= 2 * GIVEN_RADIUS and edit_distance(g, t, 2 * GIVEN_RADIUS) <= 2 * GIVEN_RADIUS]
            return (t, *sorted(close)), True
        if t in self.nick:
            return tuple(sorted(self.nick[t])), True
        most = 2 if len(t) >= 6 else 1
        d = {g: x for g in self.given if (x := edit_distance(g, t, most + 2 * GIVEN_RADIUS)) <= most + 2 * GIVEN_RADIUS}
        out, known = [], False
        if d and (low := min(d.values())) <= most:
            out, known = [g for g, x in sorted(d.items(), key=lambda y: (y[1], y[0])) if x <= low + 2 * GIVEN_RADIUS], True
        stem = t.rstrip("yieao") if len(t) > 4 else t
        if len(t) >= 3 and not known:
            short = [g for g in sorted(self.given) if len(g) > len(t) and (t in g or (len(stem) >= 3 and g.startswith(stem)))]
            out, known = out + [g for g in short if g not in out], known or bool(short)
        return tuple(out), known

    def _far_given(self, t: str) -> tuple[str, ...]:
        """Pivots that a name within the radius of ``t``, which is near none itself, could have chosen."""
        out = {g for g in self.given if edit_distance(g, t, 2 + GIVEN_RADIUS) <= 2 + GIVEN_RADIUS}
        out |= {g for n, full in self.nick.items() if edit_distance(n, t, GIVEN_RADIUS) <= GIVEN_RADIUS for g in full}
        for g in self.given - out:  # short forms: a part of the pivot, or its beginning and an ending
            sizes = range(max(3, len(t) - GIVEN_RADIUS), min(len(g), len(t) + GIVEN_RADIUS) + 1)
            stem = t.rstrip("yieao")
            if any(edit_distance(g[i : i + k], t, GIVEN_RADIUS) <= GIVEN_RADIUS for k in sizes for i in range(len(g) - k + 1)) or (
                len(t) > 3 and any(edit_distance(g[:k], stem, GIVEN_RADIUS) <= GIVEN_RADIUS for k in range(3, min(len(g), len(stem) + GIVEN_RADIUS) + 1))
            ):
                out.add(g)
        return tuple(sorted(out))

    def _near_branch(self, t: str) -> tuple[str, ...]:
        if t in self.branch:
            return (t,)
        if len(t) >= 3 and (long := sorted(b for b in self.branch if b.startswith(t))):
            return tuple(long)
        most = 1 if len(t) < 6 else 2 if len(t) < 8 else 3
        d = sorted((x, b) for b in self.branch if abs(len(b) - len(t)) <= most and (x := edit_distance(b, t, most)) <= most)
        return tuple(b for x, b in d if x == d[0][0])

    def is_given(self, t: str, exact: bool = False) -> bool:
        return t in self.given or t in self.nick if exact else self.near_given(t)[1]


def parse_person(name: str, lex: Lexicon) -> Form | None:
    """None where the spelling has no surname (a given name, a role, a pronoun)."""
    s = fold(name)
    comma = s.count(",") == 1 and not s.endswith(",")
    if comma and re.sub(r"[^a-z]", "", s.split(",")[1]) in SUFFIXES:
        comma = False
    halves = s.split(",") if comma else [s.replace(",", " ")]
    parts = [[_word(t) for t in re.split(r"[\s._\-/]+", h) if t.strip("'\"()")] for h in halves]
    suffix, clean = "", []
    for ts in parts:
        ts = [t.strip("'\"()") for t in ts]
        if len(ts) > 1 and ts[-1] in SUFFIXES:
            suffix = {"junior": "jr", "senior": "sr"}.get(ts[-1], ts[-1])
            ts = ts[:-1]
        while len(ts) > 1 and ts[0] in TITLES:
            ts = ts[1:]
        clean.append(ts)
    if comma:
        if not clean[0] or not clean[1]:
            return None
        tokens = clean[1] + clean[0]
    else:
        tokens = clean[0]
    full = [t for t in tokens if len(t) > 1]
    initials = [t for t in tokens if len(t) == 1]
    if not full or not all(any(ch.isalpha() for ch in t) for t in full):
        return None
    if len(full) == 1:
        t = full[0]
        if initials:
            if lex.is_given(t, exact=True) or len(t) < 2:
                return None
            return Form(t, None, initials[0], "".join(initials[1:]), suffix)
        for g in lex.by_length:  # written together
            if len(t) - len(g) >= 5 and t.startswith(g) and not lex.is_given(t):
                return Form(t[len(g) :], g, suffix=suffix)
        return None
    if any(t in FILLER for t in full[:1]):  # a description ("the boss")
        return None
    if comma:
        given, surname = full[0], "".join(t for t in clean[0] if len(t) > 1) or full[-1]
    else:
        given, surname = full[0], "".join(full[1:])  # a surname broken by a blank or hyphen is read as one word
        if not lex.is_given(given, exact=True):
            last = full[-1]
            if lex.is_given(last, exact=True) or (lex.is_given(last) and not lex.is_given(given)):
                given, surname = last, "".join(full[:-1])
    middle = "".join(initials)
    return Form(surname, given, middle=middle, suffix=suffix) if len(surname) >= 2 else None


_SYLLABLE = re.compile(r"[^aeiouy]+(?=[aeiouy])")


def syllable_initials(core: str) -> str:
    """First letters of the syllables: a liquid or nasal before another consonant closes the syllable before."""
    out = core[0] if core and core[0] in "aeiouy" else ""
    for m in _SYLLABLE.finditer(core):
        g = m.group()
        out += g[1] if m.start() and len(g) > 1 and g[0] in "rlnm" else g[0]
    return out


def parse_organisation(name: str, lex: Lexicon) -> Form | None:
    """None where nothing distinctive is left (\"the company\", \"HQ\")."""
    raw = unicodedata.normalize("NFKC", name).strip()
    if re.fullmatch(r"[A-Z]{4,8}", raw):
        return Form("", None, acronyms=(raw.lower(),))
    s = re.sub(r"(?<=[a-zß-ÿ])(?=[A-Z])", " ", raw)
    s = fold(s)
    s = re.sub(r"\bs\.?\s*a\.?\s*r\.?\s*l\b\.?", "sarl", s)
    s = re.sub(r"\b([a-z])\.\s?([a-z])\.(?:\s?([a-z])\.)?", lambda m: "".join(x for x in m.groups() if x) + " ", s)
    s = re.sub(r"\bs\.a\b", "sa", s)
    tokens = [_word(t) for t in re.split(r"[^0-9a-z]+", s) if t]
    legal = [t for t in tokens if t in LEGAL]
    rest = [t for t in tokens if t not in LEGAL and t not in FILLER]
    if not rest:
        return None
    branch = [t for t in rest if t in lex.branch]
    other = [t for t in rest if t not in lex.branch]
    if len(other) > 1:  # abbreviated or misspelt branch words beside the core, which is the longest of what is unlike one
        like = {t: lex.near_branch(t) for t in other}
        cores = [t for t in other if not like[t]] or [max(other, key=len)]
        core = "".join(cores)  # a core broken by a blank or hyphen is read as one word
        for t in other:
            if t not in cores and like[t]:
                branch.append(like[t][0] if len(like[t]) == 1 else "|".join(like[t]))
    elif other:
        core = other[0]
    else:
        return None
    if len(core) < 2:
        return None
    if not branch:  # written together
        for b in sorted(lex.branch, key=len, reverse=True):
            if core.endswith(b) and len(core) - len(b) >= 4:
                core, branch = core[: -len(b)], [b]
                break
    first = syllable_initials(core) + "".join(b[0] for b in sorted(branch, key=lambda b: rest.index(b) if b in rest else 99))
    acr = (first, *(first + x[0] for x in legal[:1])) if branch else ()
    return Form(core, branch[0] if branch else None, acronyms=tuple(a for a in acr if len(a) >= 4))


#: Marks a lead that is near no pivot.
RARE = "~"


def deletions(s: str, most: int) -> set[str]:
    """What is left of ``s`` by up to ``most`` deletions. Strings within a distance of ``most`` have one in common."""
    out = edge = {s}
    for _ in range(most):
        edge = {x[:i] + x[i + 1 :] for x in edge for i in range(len(x))}
        out = out | edge
    return out


#: A row of a cell: who is written so, how it is written, whether a part is left out.
CELL = "memory_id string, kind string, pivot string, node string, part string, lead string, exact boolean, middle string, suffix string, weak boolean"


def cells_of(form: Form, kind: str, lex: Lexicon) -> list[tuple[str, str, str, bool, str, str, bool]]:
    """(pivot, part, lead, lead is the pivot itself, middle, suffix, weak) for each cell that a spelling goes to."""
    out = []
    for a in form.acronyms:
        out.append((f"={a}", form.part or a, a, True, "", "", not form.part))
    if not form.part:
        return out
    if kind == PERSON:
        if form.lead is None:
            pivots = [f"{form.initial}.", *(g for g in sorted(lex.given) if g[0] == form.initial)]
            return [(g, form.part, form.initial, False, form.middle, form.suffix, True) for g in pivots]
        pivots, known = lex.near_given(form.lead)
        if not known:
            rare = [f"{form.lead[0]}.", *lex.far_given(form.lead), *(f"~{x}" for x in sorted(deletions(form.part, radius(form.part))))]
            return [(g, form.part, RARE + form.lead, False, form.middle, form.suffix, False) for g in rare]
        if all(g[0] != form.lead[0] for g in pivots):  # an initial goes to the pivots of its letter
            out.append((f"{form.lead[0]}.", form.part, form.lead, False, form.middle, form.suffix, False))
        short = form.lead in lex.nick or (known and form.lead not in lex.given and any(form.lead in g for g in pivots))
        return out + [(g, form.part, form.lead, short or form.lead == g, form.middle, form.suffix, False) for g in pivots]
    if form.lead is None:
        return [*out, ("*", form.part, "", True, "", "", False), *((b, form.part, "", False, "", "", True) for b in sorted(lex.branch))]
    return out + [(b, form.part, b, True, "", "", False) for b in form.lead.split("|")]


def _forms(lex: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for memory, kind, node, form in zip(*(b.column(i).to_pylist() for i in range(4))):
                f = (parse_person if kind == PERSON else parse_organisation)(form, lex)
                if f is not None:
                    out.extend((memory, kind, c[0], node, *c[1:]) for c in cells_of(f, kind, lex))
            if out:
                yield _batch(out, _CELL_TYPES, CELL)

    return run


_S, _B = pa.string(), pa.bool_()
_CELL_TYPES = [_S, _S, _S, _S, _S, _S, _B, _S, _S, _B]
LINK = "kind string, pivot string, a string, b string, weak boolean"


def _batch(rows, types, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])


def _letters(parts: list[str]) -> np.ndarray:
    out = np.zeros(len(parts), np.uint32)
    for i, p in enumerate(parts):
        m = 0
        for ch in p:
            m |= 1 << (ord(ch) % 32)
        out[i] = m
    return out


def close_parts(parts: list[str], block: int = 2048, split: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(i, j, distance), i < j, of all pairs within their radius: an exact radius join; with ``split`` of the first so many
    parts with the others.

    The length (the distance to the empty string) and the letter sets bound the distance from below; what they leave is
    measured.
    """
    n = len(parts)
    size, mask = np.array([len(p) for p in parts], np.int16), _letters(parts)
    rad = np.array([radius(p) for p in parts], np.int16)
    for lo in range(0, n if split is None else split, block):
        hi = min(lo + block, n if split is None else split)
        for at in range(lo if split is None else split, n, block):
            to = min(at + block, n)
            r = np.minimum(rad[lo:hi, None], rad[None, at:to])
            ok = np.abs(size[lo:hi, None] - size[None, at:to]) <= r
            ok &= np.bitwise_count(mask[lo:hi, None] ^ mask[None, at:to]) <= 2 * r
            for i, j in zip(*np.nonzero(ok)):
                if lo + i < at + j:
                    most = int(r[i, j])
                    if (d := edit_distance(parts[lo + i], parts[at + j], most)) <= most:
                        yield lo + int(i), at + int(j), d


def _compatible(x: tuple, y: tuple, d: int) -> bool:
    """Whether two rows of a cell (lead, exact, middle, suffix, weak) whose parts are d edits apart may be the same."""
    (lx, ex, mx, sx, wx), (ly, ey, my, sy, wy) = x, y
    if sx != sy or (mx and my and mx[0] != my[0]):
        return False
    if wx or wy:
        return d <= 1
    if lx == ly or (ex and ey):
        return True
    if lx[:1] == RARE or ly[:1] == RARE:  # no pivot vouches for it: only a typo
        a, b = lx.removeprefix(RARE), ly.removeprefix(RARE)
        most = min(radius(a), radius(b), GIVEN_RADIUS)
        return edit_distance(a, b, most) <= most
    g = edit_distance(lx, ly, 3)
    return g <= (2 if max(len(lx), len(ly)) >= 5 else 1) + 1 and g + d <= 3 if not (ex or ey) else g + d <= 3 or ((ex or ey) and d <= 2)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and pair of blocks; the distinct spellings of two blocks at most are in memory at a time. Two
    different blocks give only the links between them."""
    now, held, side, out = None, {}, {}, []

    def flush():
        kind, pivot, cross = now[1], now[2], now[3] != now[4]
        acronym = pivot.startswith("=")
        if pivot.startswith(RARE):
            pivot = RARE  # the same link is found in many such cells
        if acronym:
            rows = [(node, k, side[k[0]]) for k, nodes in held.items() for node in nodes]
            short, full = sorted({(n, b) for n, k, b in rows if k[1][4]}), sorted({(n, b) for n, k, b in rows if not k[1][4]})
            for a, own in short:
                for b, other in full:
                    if not cross or own != other:
                        yield (kind, pivot, a, b, True)
                if not cross and a != short[0][0]:
                    yield (kind, pivot, a, short[0][0], False)
            return
        parts = sorted({p for p, _ in held}, key=lambda p: (side[p], p))
        by: dict[str, list] = {}
        for (p, x), nodes in held.items():
            by.setdefault(p, []).append((x, nodes))
        if cross:
            pairs = list(close_parts(parts, split=sum(side[p] == now[3] for p in parts)))
        else:
            pairs = [(i, i, 0) for i in range(len(parts))]
            pairs.extend(close_parts(parts))
        for i, j, d in pairs:
            for n, (x, xs) in enumerate(by[parts[i]]):
                for m, (y, ys) in enumerate(by[parts[j]]):
                    if i == j and m < n or not _compatible(x, y, d):
                        continue
                    weak = x[4] or y[4]
                    both = x[4] and y[4]
                    a, b = min(xs), min(ys)
                    if weak and not both:  # every entity with the short form must see which full forms it fits
                        short, long = (xs, b) if x[4] else (ys, a)
                        for s in short:
                            if s != long:
                                yield (kind, pivot, s, long, True)
                    elif a != b:
                        yield (kind, "" if both else pivot, a, b, both)
                    if i == j and m == n and not x[4]:
                        for z in xs:  # the same spelling, often of many entities: a star
                            if z != a:
                                yield (kind, pivot, z, a, False)
                    elif i == j and m == n:
                        for z in xs:
                            if z != a:
                                yield (kind, "", z, a, True)

    for batch in batches:
        for memory, kind, pivot, lo, hi, block, node, part, *x in zip(*(c.to_pylist() for c in batch.columns)):
            cell = (memory, kind, pivot, lo, hi)
            if cell != now:
                if now is not None:
                    out.extend(flush())
                now, held, side = cell, {}, {}
                if len(out) > 10_000:
                    yield _batch(out, [_S, _S, _S, _S, _B], LINK)
                    out = []
            held.setdefault((part, tuple(x)), set()).add(node)
            side[part] = block
    if now is not None:
        out.extend(flush())
    if out:
        yield _batch(out, [_S, _S, _S, _S, _B], LINK)


def fit_lexicon(names: DataFrame, nicknames: DataFrame) -> Lexicon:
    """Pivots from token counts over all names; ``names``: memory_id, kind, name; ``nicknames``: given_name, nickname."""
    tokens = F.explode(F.split(F.btrim(F.regexp_replace(F.lower("name"), r"[\s\p{Punct}\x{00A0}]+", " ")), " ")).alias("token")
    total = {r["kind"]: r["n"] for r in names.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    got = names.select("kind", "memory_id", tokens).where(F.length("token") > 2).groupBy("kind", "token").agg(F.count("*").alias("n"), F.approx_count_distinct("memory_id").alias("m"))
    share = F.when(F.col("kind") == PERSON, F.lit(total.get(PERSON, 0) * PIVOT_SHARE)).otherwise(F.lit(total.get(ORGANISATION, 0) * PIVOT_SHARE))
    rows = got.where((F.col("m") >= PIVOT_MEMORIES) & (F.col("n") >= share)).orderBy("kind", "token").collect()
    known = nicknames.select("given_name", "nickname").where("given_name is not null and nickname is not null").distinct()
    if (n := known.count()) > MOST_NICKNAMES:
        raise ValueError(f"{n} nicknames are more than the {MOST_NICKNAMES} that can be passed to every task")
    nick = sorted(tuple(r) for r in known.collect())
    return Lexicon([r["token"] for r in rows if r["kind"] == PERSON], [r["token"] for r in rows if r["kind"] == ORGANISATION], nick)


TAKEN = "memory_id string, kind string, node string, form string, alias boolean, own string, related boolean, part string, lead string, known boolean"


def _taken_apart(lex: Lexicon):
    """Each spelling's surname and given name, whether that is known, the distinctive part of the own name, and whether the
    spelling has anything of it. Spellings that can't be taken apart are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = lru_cache(50_000)(lambda kind, s: (parse_person if kind == PERSON else parse_organisation)(s, lex))
        for b in batches:
            out = []
            for memory, kind, node, name, form in zip(*(c.to_pylist() for c in b.columns)):
                f = parse(kind, form)
                if f is None:
                    continue
                own, related = parse(kind, name), True
                if form != name and own is not None:
                    most = min(radius(own.part), radius(f.part))
                    related = bool(set(own.acronyms) & set(f.acronyms)) or (bool(f.part) and edit_distance(own.part, f.part, most) <= most)
                lead = f.lead if kind == PERSON else None
                known = lead is not None and (lead in lex.given or lex.is_given(lead))
                exact = lead if lead is None or not known or lead in lex.given else None
                out.append((memory, kind, node, form, form != name, fold(name) if own is None else own.part, related, f.part, exact, known))
            if out:
                yield _batch(out, [_S, _S, _S, _S, _B, _S, _B, _S, _S, _B], TAKEN)

    return run


def learned_nicknames(taken: DataFrame, n_names: int) -> list[tuple[str, str]]:
    """(given name, short form) pairs from the table itself: a first name near no pivot whose bearers share surname and memory
    with one and the same given name again and again. Relatives share surnames too, but not always the same two names."""
    p = taken.where((F.col("kind") == PERSON) & F.col("lead").isNotNull()).select("memory_id", "part", "lead", "known").distinct()
    new = p.where(~F.col("known")).select("memory_id", "part", F.col("lead").alias("short"))
    met = new.join(p.where("known").select("memory_id", "part", "lead"), ["memory_id", "part"])
    places = met.groupBy("short").agg(F.count_distinct("memory_id", "part").alias("n"))
    least = max(LEARNED_PLACES, LEARNED_LEAST * n_names)
    pairs = met.groupBy("short", "lead").agg(F.count("*").alias("k")).where(F.col("k") >= least).join(places, "short").where(F.col("k") >= F.lit(LEARNED_SHARE) * F.col("n"))
    return sorted((r["lead"], r["short"]) for r in pairs.select("lead", "short").collect())


def vague_aliases(taken: DataFrame) -> DataFrame:
    """(kind, form) of the aliases that say nothing: they have nothing of their bearers' names, and these differ."""
    a = taken.where("alias and not related").groupBy("kind", "form").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
    return a.where(F.levenshtein("lo", "hi") > 2).select("kind", "form")


def _blocked(cells: DataFrame) -> DataFrame:
    """Cells with the pair of blocks that a row takes part in; one block where a cell is small."""
    key = ["memory_id", "kind", "pivot"]
    rest = [c for c in cells.columns if c not in key]
    size = cells.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    nb = size.select(*key, F.ceil(F.col("n") / F.lit(CELL_ROWS)).cast("int").alias("nb"))
    c = cells.join(nb, key, "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("part"), F.col("nb")).cast("int"))
    c = c.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return c.select(*key, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *rest)


def name_classes(entities: DataFrame, nicknames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``names`` (memory_id, kind, name, node) and ``classes`` (node, class): names that mean one entity share a class.

    ``node`` is the smallest id that bears the name in its memory and type; the entities that bear one and the same name
    fold together first, so a name that a large share of all rows bears is one node. Only Person and Organization are
    linked. Null or blank names and ids are left out; aliases count as spellings too, except those without a surname or a
    distinctive word, and those that bearers of different names share without having anything of their names. Names that fit several entities equally (an initial shared by relatives) link to none.
    """
    e = entities.select(norm_id("id").alias("id"), norm_id("memory_id").alias("memory_id"), F.lower(F.btrim("entity_type", F.lit(BLANKS))).alias("kind"), "name", "aliases")
    e = e.where(F.col("kind").isin(PERSON, ORGANISATION) & F.col("id").isNotNull() & (F.length(F.btrim("name", F.lit(BLANKS))) > 0))
    names = cut(e.groupBy("memory_id", "kind", "name").agg(F.min("id").alias("node")))
    lex = fit_lexicon(names, nicknames)
    own = names.select("memory_id", "kind", "node", "name", F.col("name").alias("form"))
    other = e.select("memory_id", "kind", "name", F.explode("aliases").alias("form")).where("form is not null and form <> name").distinct().join(names, ["memory_id", "kind", "name"])
    forms = own.unionByName(other.select(own.columns))
    taken = cut(forms.mapInArrow(_taken_apart(lex), TAKEN))
    lex = lex.with_nicknames(learned_nicknames(taken, names.count()))
    forms = taken.join(vague_aliases(taken).withColumn("alias", F.lit(True)), ["kind", "form", "alias"], "left_anti").select("memory_id", "kind", "node", "form")
    cells = cut(forms.mapInArrow(_forms(lex), CELL))
    by = ["memory_id", "kind", "pivot", "lo", "hi"]
    links = cut(_blocked(cells).repartition(*by).sortWithinPartitions(*by).mapInArrow(_links, LINK).distinct())
    strong = links.where(~F.col("weak"))
    sure = cut(connected_components(strong.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    comp = lambda c: F.coalesce(F.col("component"), F.col(c))
    # a short form links where all the full forms that it fits are one entity
    fits = links.where(F.col("weak") & (F.col("pivot") != "")).join(sure, F.col("b") == F.col("node"), "left").select("a", comp("b").alias("to"))
    one = fits.groupBy("a").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
    attached = one.where("lo = hi").select(F.col("a").alias("src"), F.col("lo").alias("dst"))
    # short forms alike link among themselves unless one of them fits several entities
    several = one.where("lo <> hi").select("a")
    alike = links.where(F.col("weak") & (F.col("pivot") == "")).select("a", "b")
    alike = alike.join(several, "a", "left_anti").join(several.withColumnRenamed("a", "b"), "b", "left_anti").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    classes = connected_components(sure.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(attached).union(alike))
    return names, cut(classes.select("node", F.col("component").alias("class")))


def _members(entities: DataFrame, names: DataFrame) -> DataFrame:
    """The ids that bear each of ``names(memory_id, kind, name, ...)``."""
    ids = entities.select(norm_id("id").alias("id"), norm_id("memory_id").alias("memory_id"), F.lower(F.btrim("entity_type", F.lit(BLANKS))).alias("kind"), "name").where("id is not null")
    return ids.join(names, ["memory_id", "kind", "name"]).distinct()


def classes_of_ids(entities: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``entity_id``, ``memory_id``, ``entity_type``, ``class_id``, ``n_links``: one row per person or organisation with its class
    (its smallest node's id) and the number of other ids in it; an entity without variants is a class of its own. The
    pairs of ids under different names of a class are those of :func:`name_pairs`."""
    names, classes = name_classes(entities, nicknames)
    m = _members(entities, names.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))).select("id", "memory_id", "kind", "class").distinct()
    size = m.groupBy("class").agg((F.count_distinct("id") - 1).alias("n_links"))
    return m.join(size, "class").select(F.col("id").alias("entity_id"), "memory_id", F.col("kind").alias("entity_type"), F.col("class").alias("class_id"), "n_links")


def name_pairs(entities: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``id_a`` < ``id_b``: entities of one memory and type that are the same under different names.

    See :func:`name_classes`. Every id is paired with every id under another name of its class, so the rows of a class grow
    with the product of its names' ids. A large class is spread over pairs of blocks. Empty tables give no rows.
    """
    names, classes = name_classes(entities, nicknames)
    named = names.join(classes, "node")
    size = named.groupBy("class").count().where("count > 1").select("class")
    named = named.join(size, "class")
    member = cut(_members(entities, named).select("class", "name", "id").distinct())
    blocks = member.groupBy("class").agg(F.ceil(F.count("*") / F.lit(BLOCK_IDS)).cast("int").alias("blocks"))
    member = member.join(blocks, "class").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = member.select("class", F.col("own").alias("block_a"), other.alias("block_b"), F.col("name").alias("name_a"), F.col("id").alias("id_a"))
    b = member.select("class", other.alias("block_a"), F.col("own").alias("block_b"), F.col("name").alias("name_b"), F.col("id").alias("id_b"))
    x = a.join(b, ["class", "block_a", "block_b"]).where((F.col("name_a") != F.col("name_b")) & (F.col("id_a") < F.col("id_b")))
    return x.select("id_a", "id_b").distinct()
