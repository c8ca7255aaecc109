"""License scans: matching statistics over a generalised suffix automaton of licence tokens, chained into template spans.

The automaton holds every run of words of all templates. A text streams through it once: at each word it knows the longest
run, ending there, that some template has, and along the suffix links the longest run of each other template. Runs that the next
word does not extend in their template are chained, in the order of the template, into the spans of it which the text covers;
a template that is covered enough adds its label.

The automaton is built from the templates, not from the data, and is a few thousand states; it travels with the function.

Defined cases: a null or empty text has no words, no places and no labels, and score 0; an empty table gives no rows. Texts are
read whole, long or not, one pass each. Equal rows give equal results. Only the text column is read; all others pass through,
unless a result takes their name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexgrid.llm.license_texts import TEMPLATES

#: Phrases of the base rules and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
MIN_RUN, MIN_COVER, MAX_GAP = 3, 0.8, 12

#: Bytes that stand within words are kept, A-Z lower-cased; all others become spaces.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text."""
    return (text or "").encode().translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton over the words of several templates."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.templates = [(label, words(t)) for label, t in templates]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, set[int]]] = [{}]
        self.marks = ends
        for k, (_, ws) in enumerate(self.templates):
            last = 0
            for i, w in enumerate(ws):
                last = self._extend(last, w)
                ends[last].setdefault(k, set()).add(i)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):  # what ends in a state also ends in its suffixes
            if self.link[s] > 0:
                for k, places in ends[s].items():
                    ends[self.link[s]].setdefault(k, set()).update(places)
        #: by state: template -> the places in it where the state's words end
        self.ends = [{k: sorted(x) for k, x in e.items()} for e in ends]
        del self.marks

    def _state(self, length: int, follow: dict[bytes, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.marks.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The part of q that is as long as p and one word; p and its suffixes lead there."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, w, self.next[p][w])
        return new

    def lengths(self, state: int, size: int) -> dict[int, tuple[int, int]]:
        """For each template the longest run, of MIN_RUN words or more, that ends where the automaton stands: (length, state)."""
        out: dict[int, tuple[int, int]] = {}
        while size >= MIN_RUN:
            for k in self.ends[state]:
                out.setdefault(k, (size, state))
            state = self.link[state]
            size = self.length[state]
        return out

    def runs(self, ws: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(place of the last word, template, length, state) of each template's runs that the next word does not extend."""
        follow, link, length = self.next, self.link, self.length
        state = size = 0
        root = follow[0]
        now: dict[int, tuple[int, int]] = {}
        for i, w in enumerate(ws):
            if not size:
                if w in root:
                    state, size = root[w], 1
                continue
            while state and w not in follow[state]:
                state = link[state]
                size = length[state]
            if w in follow[state]:
                state, size = follow[state][w], size + 1
            else:
                state = size = 0
            if now or size >= MIN_RUN:
                was, now = now, self.lengths(state, size)
                for k, (n, s) in was.items():
                    if now.get(k, (0,))[0] != n + 1:
                        yield i - 1, k, n, s
        for k, (n, s) in now.items():
            yield len(ws) - 1, k, n, s

    def spans(self, ws: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, template words covered): for each template, runs chained in its order.

        A run joins the open chain of its template if it starts MAX_GAP words after it at most and ends at a later place of the
        template, the next such; else it opens a new chain.
        """
        open_: dict[int, list[int]] = {}  # template -> [first, last, place in the template, covered]
        out = []
        for end, k, size, state in self.runs(ws):
            places = self.ends[state][k]
            c = open_.get(k)
            later = bisect_right(places, c[2]) if c else len(places)
            if c and end - size + 1 - c[1] <= MAX_GAP and later < len(places):
                c[3] += min(size, places[later] - c[2])
                c[1], c[2] = end, places[later]
            else:
                if c:
                    out.append((k, c[0], c[1], c[3]))
                open_[k] = [end - size + 1, end, places[0], size]
        out += [(k, c[0], c[1], c[3]) for k, c in open_.items()]
        return sorted(out, key=lambda x: (x[1], x[0]))


def standing(spans: list[tuple[int, int, float, int, int]]) -> list[tuple[int, int, float, int, int]]:
    """Of (first, last, cover, words covered, template): without spans inside one that covers more of its template, and as many words."""
    spans = sorted(spans, key=lambda x: (x[0], -x[1], -x[2]))
    out, near = [], []
    for x in spans:
        near = [y for y in near if y[1] >= x[1]]
        if not any(y[2] > x[2] and y[3] >= x[3] for y in near):
            out.append(x)
        near.append(x)
    return out


def places(ws: list[bytes], phrases: Sequence[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(start, label) wherever a phrase's words stand consecutively."""
    out = []
    for p, label in phrases:
        i = -1
        try:
            while True:
                i = ws.index(p[0], i + 1)
                if ws[i : i + len(p)] == p:
                    out.append((i, label))
        except ValueError:
            pass
    return out


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("cover", T.DoubleType())])
RESULT = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("license_spans", T.ArrayType(SPAN)),
]


def scan(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """All columns of docs but the text, plus the columns of RESULT.

    Base: places of the phrases. labels adds those of templates whose words are covered to MIN_COVER at least, but not by a part
    of a text that covers another template better; score is the largest cover of any template or phrase, from 0 to 1.
    """
    names = {f.name for f in RESULT}
    kept = [c for c in docs.columns if c != text and c not in names]
    machine = Automaton(templates)
    split = [(p.encode().split(), label) for p, label in phrases]
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def one(t: str | None) -> tuple:
        ws = words(t)
        base = places(ws, split)
        labels = {label for _, label in base}
        spans = [(first, last, min(1.0, n / len(machine.templates[k][1])), n, k) for k, first, last, n in machine.spans(ws)]
        score = max([1.0 if base else 0.0, *(x[2] for x in spans)])
        found = [{"label": machine.templates[k][0], "first": first, "last": last, "cover": cover} for first, last, cover, _, k in standing([x for x in spans if x[2] >= MIN_COVER])]
        starts = [i for i, _ in base]
        return len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x["label"] for x in found})), score, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [one(x.as_py()) for x in part.column(text)]
                new = [pa.array(list(x), t) for x, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + new, names=[*kept, *(f.name for f in RESULT)])

    return docs.select(*kept, text).mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + RESULT))
