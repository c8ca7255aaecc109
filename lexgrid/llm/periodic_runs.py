"""Periodic runs of words: every maximal stretch that repeats itself with a period of at most half its length.

Texts of a batch are put end to end, each with a separator of its own. Prefix doubling sorts their suffixes; the ranks of every
round name the windows of 1, 2, 4, ... words, so that common extensions to either side of two places are found in as many steps.
Suffix array and LCP array give each place's longest previous factor, and those the LZ blocks. A run that touches the boundary of
two blocks has a bounded period there, so extending each boundary for each such period finds it; a run inside a block has an
earlier copy in the block's source, and is copied from there, block by block, from buckets by starting place.

Why the periods are bounded: take the last boundary b that a run touches, blocks of u words before it and v after it. If the
run's part from b on holds a period, that is at most v. Otherwise the run's part before b does; if the run also held a period
before the block that ends at b, this block would have reached further, so the period is at most u + v.

Work runs in Arrow batches, without a shuffle: each text is a task's own. Time grows with n log n; memory with the words of a
batch, or of the longest text, times the rounds (the logarithm of its longest repetition).

Defined cases: a null, empty or blank text has no words, no runs and the collapsed text ''. Whole texts are read. Repeated rows
are judged one by one, an empty table gives no rows. Extra columns pass through, but for those named as a result (`n_words`,
`runs`, `collapsed`), which it replaces.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words that are sorted at once, if no text has more; rounds of vectorised jumps before the rest is walked one by one.
BATCH, JUMPS = 400_000, 48
SHORTEST = 12


class Suffixes:
    """The suffix array of texts put end to end, and the names of all windows of 2**k symbols."""

    def __init__(self, symbols: np.ndarray):
        """symbols: every value that stands last in a text stands nowhere else, and texts have no value in common."""
        n = len(symbols)
        self.sa = np.argsort(symbols)
        rank = np.empty(n, dtype=np.int32)
        slots = np.arange(n)
        keys = symbols[self.sa]
        self.names = []
        while True:
            act, new = self.sa[slots], np.empty(len(slots), dtype=bool)
            new[:1], new[1:] = True, keys[1:] != keys[:-1]
            rank[act] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            self.names.append(rank.copy())
            alone = new.copy()
            alone[:-1] &= new[1:]
            slots = slots[~alone]
            if not len(slots):
                return
            act = self.sa[slots]
            keys = rank[act].astype(np.int64) * (n + 1) + rank[act + (1 << (len(self.names) - 1))]
            order = np.argsort(keys)
            self.sa[slots], keys = act[order], keys[order]

    def ahead(self, x: np.ndarray, y: np.ndarray, rounds: int | None = None) -> np.ndarray:
        """Length of what stands alike from places x and y on."""
        n = np.zeros(len(x), dtype=np.int64)
        for k in reversed(range(len(self.names) if rounds is None else rounds)):
            n += (self.names[k][x + n] == self.names[k][y + n]).astype(np.int64) << k
        return n

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of what stands alike up to places x and y, x before y."""
        n = np.zeros(len(x), dtype=np.int64)
        for k, names in reversed(list(enumerate(self.names))):
            to = x - n - (1 << k)
            n += ((to >= 0) & (names[np.maximum(to, 0)] == names[np.maximum(to + y - x, 0)])).astype(np.int64) << k
        return n

    def common(self) -> np.ndarray:
        """The LCP array: what each suffix shares with the one before it in the suffix array."""
        out = np.zeros(len(self.sa), dtype=np.int64)
        at = np.arange(1, len(self.sa))
        for k, names in enumerate(self.names):  # pairs that agree in 2**k symbols, then those that agree in no more than twice that
            more = names[self.sa[at - 1]] == names[self.sa[at]]
            if k:
                done = at[~more]
                half = 1 << (k - 1)
                out[done] = half + self.ahead(self.sa[done - 1] + half, self.sa[done] + half, k - 1)
            at = at[more]
        return out


def nearest_lower(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in the array: the nearest place before it with a lower value, and the least lcp between; 0 if they share nothing."""
    at, low = np.arange(-1, len(sa) - 1), lcp.copy()
    act = np.flatnonzero(low)
    act = act[sa[at[act]] > sa[act]]
    for _ in range(JUMPS):
        if not len(act):
            return at, low
        to = at[act]
        low[act], at[act] = np.minimum(low[act], low[to]), at[to]
        act = act[low[act] > 0]
        act = act[sa[at[act]] > sa[act]]
    for r in act.tolist():  # in this order a place is passed over once
        while low[r] > 0 and sa[at[r]] > sa[r]:
            low[r], at[r] = min(low[r], low[at[r]]), at[at[r]]
    return at, low


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the text: the length of the longest factor that also starts earlier, and where."""
    sa, lcp = s.sa, s.common()
    at, low = nearest_lower(sa, lcp)
    at2, low2 = nearest_lower(sa[::-1], np.concatenate([lcp[:1], lcp[:0:-1]]))
    at2, low2 = len(sa) - 1 - at2[::-1], low2[::-1]
    length, source = np.empty(len(sa), dtype=np.int64), np.empty(len(sa), dtype=np.int64)
    length[sa] = np.maximum(low, low2)
    source[sa] = np.where(low >= low2, sa[at], sa[np.minimum(at2, len(sa) - 1)])
    return length, source


def pairs(starts: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places x and y of the periods y - x to be tried at each boundary: to its right within the block, to its left within both."""
    before = np.concatenate([[0], sizes[:-1]])

    def counted(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(starts, most)
        return at, np.arange(1, len(at) + 1) - np.repeat(np.cumsum(most) - most, most)

    right, p = counted(np.minimum(sizes, n - 1 - starts))
    left, q = counted(np.minimum(sizes + before, starts))
    return np.concatenate([right, left - q]), np.concatenate([right + p, left])


def find_runs(symbols: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of at least `shortest` symbols and two periods, by start, then period.

    symbols: as for Suffixes. end is the place behind the run's last; the period is the smallest.
    """
    s = Suffixes(symbols)
    least = -(-(-(-shortest // 2)) // 2)  # one of the two extensions has that many symbols
    k = least.bit_length() - 1
    if k >= len(s.names) - 1:  # no window of 2**k symbols occurs twice
        return []
    length, source = previous_factors(s)
    steps, starts, i = np.maximum(length, 1).tolist(), [], 0
    while i < len(steps):
        starts.append(i)
        i += steps[i]
    first = np.array(starts)
    sizes = np.diff(np.append(first, len(steps)))
    x, y = pairs(first, sizes, len(steps))
    names, w = s.names[k], 1 << k
    likely = (names[x] == names[y]) | ((x >= w) & (names[x - w] == names[y - w]))
    x, y = x[likely], y[likely]
    start, end = x - s.behind(x, y), y + s.ahead(x, y)
    runs = np.column_stack([start, end, y - x])[end - start >= np.maximum(shortest, 2 * (y - x))]
    runs = runs[np.lexsort(runs.T[::-1])]
    if len(runs):  # a stretch is found with multiples of its period, too
        runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))]
    by_start: dict[int, list[tuple[int, int]]] = {}
    for a, b, p in runs.tolist():
        by_start.setdefault(a, []).append((b, p))
    keys = sorted(by_start)
    for f in np.flatnonzero(sizes >= shortest + 2).tolist():
        to, frm, size = starts[f], int(source[starts[f]]), int(sizes[f])
        i = bisect_right(keys, frm)
        while i < len(keys) and keys[i] < frm + size:  # what is copied may be copied on, where a block overlaps its source
            inside = [(b + to - frm, p) for b, p in by_start[keys[i]] if b < frm + size]
            if inside:
                at = keys[i] + to - frm
                if at not in by_start:
                    insort(keys, at)
                by_start[at] = inside + by_start.get(at, [])
            i += 1
    return sorted(((a, b, p) for a, found in by_start.items() for b, p in found), key=lambda r: (r[0], r[2]))


def split(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` in UTF-8."""
    return text.encode().split() if text else []


def runs_of(texts: Sequence[list[bytes]], shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """For each text, given as words, its runs as (start, length, period)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = [i for i, t in enumerate(texts) if len(t) >= shortest]
    if not long:
        return out
    sizes = np.array([len(texts[i]) for i in long])
    codes = pa.array([w for i in long for w in texts[i]], pa.binary()).dictionary_encode()
    many = len(codes.dictionary) + 1
    ends = np.cumsum(sizes + 1)
    symbols = np.repeat(np.arange(len(long)) * many + many - 1, sizes + 1)  # the separators
    inner = np.ones(len(symbols), dtype=bool)
    inner[ends - 1] = False
    symbols[inner] += np.asarray(codes.indices) - (many - 1)
    found = find_runs(symbols, shortest)
    of = np.searchsorted(ends, [a for a, _, _ in found], side="right").tolist()
    for k, (a, b, p) in zip(of, found):
        out[long[k]].append((a - int(ends[k] - sizes[k] - 1), b - a, p))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, [a + p for a, _, p in runs], 1)
    np.add.at(change, [a + n for a, n, _ in runs], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def scan(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """All columns of docs but the text, plus n_words, runs (an array of start, length and period, in words, by start, then period) and collapsed."""
    if shortest < 2:
        raise ValueError("a run has two words at least")
    results = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c not in (text, *results)]
    row = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(row)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, begin = batch.column(text), 0
            while begin < batch.num_rows:
                texts, n = [], 0
                while begin + len(texts) < batch.num_rows and n < BATCH:
                    texts.append(split(column[begin + len(texts)].as_py()))
                    n += len(texts[-1])
                found = runs_of(texts, shortest)
                part = batch.slice(begin, len(texts))
                begin += len(texts)
                values = [
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], RUNS),
                    pa.array([collapse(t, rs).decode() for t, rs in zip(texts, found)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + values, names=[*kept, *results])

    return docs.select(*[f"`{c}`" for c in kept], f"`{text}`").mapInArrow(run, schema)
