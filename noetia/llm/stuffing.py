"""Keyword-stuffed and link-list pages.

A page is a sequence of lines; long lines are taken sentence by sentence or in windows of words. A hidden Markov model
labels each as prose, link list, tag list, menu or record (code, logs, tables, contents, references: no sentences, but
honest). A page is flagged when link lists, tag lists and menus hold most of its words. The model is fitted on a bounded
sample: confident rules label some lines, their counts give the first model, and Viterbi training re-estimates it.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetia.llm.tokens import spread

STATES = ("prose", "links", "tags", "menu", "record")
PROSE, LINKS, TAGS, MENU, RECORD = range(5)
#: Documents the model is fitted on: about so many, chosen by a hash of id and text (twice as many at the very most).
FIT_DOCS, ROUNDS = 4000, 3
_SHARES = 2**30
MOST_NON_PROSE = 0.5
WINDOW, LONG = 16, 28

# Frequent function words, and words of offers, in the corpus' languages
FUNCTION_WORDS = frozenset(
    "a an the and or but of to in on at by for with from as is are was were be been it its this that these those he she they we you i not no who which what when how than then there his her your have had do will about into after before between until still nobody if though said"
    " le la les l un une des du de d et ou à au en dans sur pour par ce cet cette il elle on nous je ne pas que est sont était a selon chez son sa ses se si faut être avait après"
    " der die das den dem des ein eine einen einem einer und oder aber zu zum zur im am an auf bei mit von vom nach aus für über ist sind war waren wird wurde werden nicht kein keine er sie es sich dass wie als wenn hat haben wer niemand"
    " el los las lo al del y o pero con sin por para se su es son era ha han no que quien como cuando más este esta sobre entre hasta desde según otra nadie solo cerca".split()
)
OFFER_WORDS = frozenset(
    "buy cheap cheapest best price prices sale deal deals discount coupon coupons free shipping online review reviews original top near me order shop store offer offers promo code"
    " acheter cher prix promo soldes livraison avis meilleur réduction remise gratuit boutique commander ligne comparatif"
    " kaufen günstig billig preis preise angebot angebote rabatt gutschein versand bestellen test vergleich kostenlos beste"
    " comprar barato precio precios oferta ofertas descuento cupón envío gratis opiniones mejor tienda rebajas baratos".split()
)

_BREAK = re.compile(r"</?(?:li|ul|ol|br|p|div|tr|td|h\d|b|a)\b[^>]*>|[\r\n\u2028\u2029\x0b\x0c\x85]+|\s//\s", re.I)
_HREF = re.compile(r"""<a\b[^>]*href\s*=\s*["']?([^"'\s>]+)[^>]*>""", re.I)
_MARKDOWN = re.compile(r"!?\[([^\[\]\n]*)\]\(")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\"“«'(¿¡]*[A-ZÀ-ÞŁŒ0-9])|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LINK = re.compile(r"^[\W_]*(?:https?://|ftp://|www\.)|^[\W_]*[a-z0-9][a-z0-9-]{2,}\.(?:[a-z0-9-]+\.)*[a-z]{2,}(?:/\S*)?[\W_]*$", re.I)
_SEPARATORS = (",", "|", "·", "•", "»", "›", ";", "#", ">", "/", "\t", " - ", " – ", " — ")
_END = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
_OTHER_SCRIPT = re.compile(r"[\u0370-\u1fff\u2e80-\ua4cf\uac00-\ud7ff\uf900-\ufaff]")
_DENSE_SCRIPT = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7ff]")
_STAMP = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_YEAR = re.compile(r"\(\d{4}\)")
_CODE = re.compile(r"\b(?:def|func|class|return|import|package|type|struct|const|var|let|function|public|private)\b.*[({:;=]|\w+\([^)]*\)\s*[{:;]|\);\s*$")
_FIELD = re.compile(r"^\s*\w+\s+(?:string|int\d*|float\d*|bool|error|char|double)\b")
_ROW = re.compile(r"^[^,\s][^,]*(?:,[^,\s][^,]*){2,}$")
_NUMBER = re.compile(r"^\s*\d+(?:\.\d+)+\s")
_HEADER = re.compile(r"^(?:From|To|Cc|Bcc|Date|Sent|Reply-To|Subject|Von|An|Betreff|De|À|Objet|Para|Asunto):\s")
_PAIR = re.compile(r"\b\w+=\S+")


def _is_record(u: str) -> bool:
    """Code, logs, tables, contents and references; cheap tests for the characters come first."""
    if ":=" in u or "==" in u or '":' in u or "...." in u or ". . . ." in u or "`" in u:
        return True
    first, last = u[0], u[-1]
    if first in "[{}]@" or last in "{}" or u.startswith(("//", "#!", "/*", "*/")) or (first == "|" and last == "|"):
        return True
    if first.isdigit() and (_NUMBER.match(u) or _STAMP.search(u)):
        return True
    if "(" in u and (_YEAR.search(u) or _CODE.search(u)):
        return True
    if (":" in u or "=" in u) and (_STAMP.search(u) or _CODE.search(u)):
        return True
    if "," in u and u.count(", ") * 2 < u.count(",") and _ROW.match(u):
        return True
    return _FIELD.match(u) is not None or (":" in u and _HEADER.match(u) is not None)


#: Symbols of each feature: link share, function words, sentence end, separators, repetition, offers, record signs, length.
SIZES = (4, 5, 2, 3, 4, 3, 3, 3)


def units(text: str) -> list[str]:
    """Lines, sentences and windows of a text; the targets of links in tags are words of it."""
    if "<" in text:
        text = _HREF.sub(lambda m: f"\n{m.group(1) if '://' in m.group(1) else 'https://' + m.group(1)} ", text)
    if "](" in text:
        text = _MARKDOWN.sub(r"\1 ", text).replace("](", " ")
    out: list[str] = []
    for line in _BREAK.split(text):
        line = line.strip()
        if not line:
            continue
        if len(line) < 120:
            out.append(line)
            continue
        for part in _SENTENCE.split(line):
            if part.startswith("(") and len(part) < 60 and out:  # a remark on the sentence before
                out[-1] += " " + part
                continue
            words = part.split()
            if len(words) <= LONG:
                out.append(part)
            else:
                cuts = range(0, len(words), WINDOW)
                out.extend(" ".join(words[i : i + WINDOW]).strip("|·•»/,; ") for i in cuts)
    return [u for u in out if u.strip()]


def weight(unit: str) -> float:
    """Words of a unit; scripts without blanks count two characters as a word."""
    return unit.count(" ") + 1 if unit.isascii() else max(len(unit.split()), len(_DENSE_SCRIPT.findall(unit)) / 2)


def observe(us: list[str]) -> np.ndarray:
    """Feature symbols of each unit of a page."""
    words = [_WORD.findall(u.lower()) for u in us]
    contents = [[w for w in ws if len(w) > 2 and w not in FUNCTION_WORDS] for ws in words]
    count = Counter(chain.from_iterable(contents))
    least = max(3, 0.03 * sum(map(len, words)))
    often = {w for w, n in count.items() if n >= least}
    out = []
    for u, ws, content in zip(us, words, contents):
        raw = u.split()
        n = len(raw) or 1
        links, last_links = 0, False
        if "." in u[:-1] or "/" in u:
            hit = [("." in t or "/" in t) and _LINK.match(t) is not None for t in raw]
            if True in hit:
                links, last_links = hit.count(True), hit[-1]
                ws = [w for t, h in zip(raw, hit) if not h for w in _WORD.findall(t.lower())]
                content = [w for w in ws if len(w) > 2 and w not in FUNCTION_WORDS]
        m = len(ws) or 1
        link = links / n
        if not u.isascii() and len(_OTHER_SCRIPT.findall(u)) > 0.3 * len(u):
            fw = 4
        else:
            x = len([w for w in ws if w in FUNCTION_WORDS]) / m
            fw = 3 if x >= 0.25 else 2 if x >= 0.12 else 1 if x >= 0.01 else 0
        x = len([w for w in content if w in often]) / (len(content) or 1)
        rep = 3 if x >= 0.75 else 2 if x >= 0.45 else 1 if x >= 0.2 else 0
        x = len([w for w in content if w in OFFER_WORDS]) / m
        offer = 2 if x >= 0.15 else 1 if x >= 0.01 else 0
        x = sum([u.count(c) for c in _SEPARATORS]) / n
        if link <= 0.3 and _is_record(u):
            record = 2
        elif ("=" in u and _PAIR.search(u)) or (sum(map(len, ws)) < 0.6 * len(u) and sum(map(str.isdigit, u)) > 0.25 * len(u)):
            record = 1
        else:
            record = 0
        out.append(
            (
                3 if link >= 0.4 else 2 if link >= 0.15 else 1 if links else 0,
                fw,
                not last_links and _END.search(u[-6:]) is not None,
                2 if x >= 0.3 else 1 if x >= 0.1 else 0,
                rep,
                offer,
                record,
                2 if n >= 10 else 1 if n >= 4 else 0,
            )
        )
    return np.array(out, np.int8)


def confident(x: np.ndarray) -> np.ndarray:
    """Labels of the units about which simple rules are sure, -1 elsewhere."""
    link, fw, end, sep, rep, offer, record, size = x.T
    y = np.full(len(x), -1)
    loose = (fw <= 1) & (end == 0) & (link <= 1) & (record < 2)
    y[loose & (size == 0) & (sep == 0) & (rep <= 1) & (offer == 0)] = MENU
    y[loose & ((rep >= 2) | (offer == 2)) & ((sep == 2) | (rep == 3) | (offer >= 1))] = TAGS
    y[(fw == 4) & (end == 1)] = PROSE
    y[(fw >= 2) & (fw < 4) & (record < 2) & (link < 2) & ((end == 1) | (size == 2))] = PROSE
    y[(record == 2) & (link < 3)] = RECORD
    y[link == 3] = LINKS
    return y


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The most likely states of each page's units (Viterbi), all pages a step at a time."""
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        sizes = np.array([len(pages[i]) for i in order])
        flat = np.concatenate([pages[i] for i in order]).astype(np.intp)
        score = sum(e[:, flat[:, f]] for f, e in enumerate(self.emit)).T
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        back = np.zeros((len(flat), len(STATES)), np.int8)
        v = self.start + score[first]
        for t in range(1, sizes[0]):
            live = int(np.searchsorted(-sizes, -t, "left"))  # pages longer than t
            step = v[:live, :, None] + self.move
            back[first[:live] + t] = step.argmax(axis=1)
            v[:live] = step.max(axis=1) + score[first[:live] + t]
        y = np.empty(len(flat), int)
        state = v.argmax(axis=1)
        for t in range(sizes[0] - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, "left"))
            at = first[:live] + t
            y[at] = state[:live]
            state[:live] = back[at, state[:live]]
        out: list = [None] * len(pages)
        for k, i in enumerate(order):
            out[i] = y[first[k] : first[k] + sizes[k]]
        return out


def _estimate(pages: list[np.ndarray], labels: list[np.ndarray]) -> Model:
    k = len(STATES)
    start, move = np.ones(k), np.ones((k, k)) + 4 * np.eye(k)
    emit = [np.ones((k, s)) for s in SIZES]
    for x, y in zip(pages, labels):
        ok = y >= 0
        if len(y) and y[0] >= 0:
            start[y[0]] += 1
        both = ok[:-1] & ok[1:]
        np.add.at(move, (y[:-1][both], y[1:][both]), 1)
        for f, e in enumerate(emit):
            np.add.at(e, (y[ok], x[ok, f].astype(int)), 1)
    norm = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
    return Model(norm(start), norm(move), [norm(e) for e in emit])


def fit(texts: Iterable[str]) -> Model:
    """A model from the texts; units that the rules label stay so while the others are re-estimated."""
    pages = [observe(u) for t in texts if t and (u := units(t))]
    sure = [confident(x) for x in pages]
    model = _estimate(pages, sure)
    for _ in range(ROUNDS):
        model = _estimate(pages, [np.where(s >= 0, s, y) for y, s in zip(model.label(pages), sure)] if pages else [])
    return model


LABELS = "doc_id {}, n_words double, prose double, links double, tags double, menu double, record double, non_prose double"


def fit_model(docs: DataFrame, n: int, fit_docs: int = FIT_DOCS) -> Model:
    """The model of about ``fit_docs`` of the ``n`` rows of ``docs(doc_id, text)``.

    A row is in the sample if its hash is below a threshold, so only the sample leaves the scan. One task observes it text
    by text and fits the model; the driver gets the model alone, a few kilobytes whatever the size of the table.
    """
    share = int(_SHARES * min(1.0, fit_docs / max(n, 1)))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SHARES)) < share).select("text").limit(2 * fit_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(t for b in batches for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = chosen.repartition(1).mapInArrow(run, "model binary").first()
    return fit([]) if got is None else pickle.loads(got["model"])


def label_pages(documents: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Words of each kind per document with text: doc_id, n_words, one column per state, non_prose (share of link lists,
    tag lists and menus). Null, empty and blank texts give no rows; repeated texts are judged each; whole texts are read.
    An empty table gives no rows."""
    docs = documents.select("doc_id", "text").where("trim(text) <> ''")
    model = fit_model(docs, documents.count(), fit_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, pages, seen = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if us := units(t):
                    keep.append(i), pages.append(us), seen.append(observe(us))
            rows = []
            for us, y in zip(pages, model.label(seen) if seen else []):
                w = np.bincount(y, weights=[weight(u) for u in us], minlength=len(STATES))
                rows.append((w.sum(), *w, w[[LINKS, TAGS, MENU]].sum() / max(w.sum(), 1e-9)))
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), *(pa.array(c, pa.float64()) for c in zip(*rows))], names=["doc_id", "n_words", *STATES, "non_prose"])

    return spread(docs).mapInArrow(run, LABELS.format(documents.schema["doc_id"].dataType.simpleString()))


def stuffed_pages(labelled: DataFrame, least: float = MOST_NON_PROSE) -> DataFrame:
    """Ids of the pages of which more than ``least`` of the words are in link lists, tag lists and menus."""
    return labelled.where(F.col("non_prose") > least).select("doc_id").distinct()
