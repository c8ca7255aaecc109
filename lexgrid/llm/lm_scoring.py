"""LM scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary and one smoothing; a document's score is the mean, over its
words, of its loss under the target less its loss under the background. Low scores are close to the target.

The models are matched. The background is all documents that aren't target ones, its counts scaled to the target's number of
words, so that smoothing weighs the same in both. No document is scored by a model that counted it: its own words and bigrams
are taken off the counts, so what it shares with others is all that lowers its loss.

The vocabulary is all words of all documents and every bigram is counted, so the models grow with the corpus and stay
distributed. Documents are packed into blocks, written once; a block's words and bigrams go to the bucket of their hash, the
buckets add up and answer with the totals, and the block scores its documents. They go in two steps, as a row from every block to
every bucket would be quadratic: blocks form groups, a block tells one row for each coarse range of hashes to its group, and
the group's blocks together tell the buckets of that range; answers come back the same way. With b blocks and k buckets that is
some 2 b sqrt(k) rows each way, and no task holds more than about a block or a bucket. A row carries sorted hashes, so a common
bigram is one number of a block and no task gets more of it than others. A group keeps where each block's hashes stand among
its own, in place of the hashes. The coarse ranges are worked off in PASSES, so that only a part of what is told lies on disk at
once; shuffles and tables are dropped as soon as the next step is written.

Words and bigrams are told apart by 64-bit hashes.

Defined cases: null and empty texts have no words and a null score. Repeated rows are counted and scored each. Without target
or background words the smoothing alone is left of that model; an empty table gives no rows. Whole texts are read. Extra columns
pass through, but for those that a result or the text takes the name of.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrid.llm.common import Workspace

WEIGHT, BATCH = 50.0, 256
#: Hashes kept by a process; when full, the cache starts anew.
CACHED = 100_000
#: Words, and rows, that end a block; words for each bucket.
BLOCK_WORDS, BLOCK_ROWS, BUCKET_WORDS = 500_000, 50_000, 1_000_000
#: Parts of the hashes that are told one after the other; the blocks are unpacked once for each.
PASSES = 2
TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The entry of the start of a text.
START = 1
PAIR = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            yield part, part.column(column).to_pylist()


class Hashes(dict):
    """Words to 64-bit hashes above START."""

    def __missing__(self, w: bytes) -> int:
        h = self[w] = max(2, int.from_bytes(blake2b(w, digest_size=8).digest(), "little"))
        return h


def squeeze(x: np.ndarray) -> bytes:
    """The array's bytes, first bytes first, as the upper bytes of small numbers compress to nothing; their number goes before."""
    plain = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def expand(data: bytes, kind: type) -> np.ndarray:
    plain = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(batches: Iterator[pa.RecordBatch], text: str, kept: list[str], flag: str) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: their kept columns, flags, numbers of words, distinct hashes with START, and each word's place among those."""
    hashes = Hashes()
    rows: list[pa.RecordBatch] = []
    lengths: list[int] = []
    near: list[bool] = []
    found: list[np.ndarray] = []
    n = 0

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        all_words = np.concatenate([np.array([START], np.uint64), *found])
        distinct, ids = np.unique(all_words, return_inverse=True)
        cells = [int.from_bytes(os.urandom(8), "little") >> 1, n, sink.getvalue().to_pybytes(), squeeze(np.array(near, np.int8)), squeeze(np.array(lengths, np.int32)), squeeze(np.diff(distinct, prepend=np.uint64(0))), squeeze(ids[1:].astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([x], f) for x, f in zip(cells, [pa.int64(), pa.int64(), *[pa.binary()] * 5])], names=["block", "n", "rows", "near", "lengths", "words", "ids"])

    for part, some in texts(batches, text):
        for t in some:
            w = words(t)
            lengths.append(len(w))
            found.append(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)))
            n += len(w)
        near += part.column(flag).to_pylist()
        rows.append(part.select(kept))
        if n >= BLOCK_WORDS or len(lengths) >= BLOCK_ROWS:
            yield out()
            rows, lengths, near, found, n = [], [], [], [], 0
        if len(hashes) > CACHED:
            hashes.clear()
    if lengths:
        yield out()


PACKED = "block bigint, n bigint, rows binary, near binary, lengths binary, words binary, ids binary"


class Block:
    def __init__(self, near: bytes, lengths: bytes, words: bytes, ids: bytes):
        self.lengths = expand(lengths, np.int32).astype(np.int64)
        self.words = np.cumsum(expand(words, np.uint64), dtype=np.uint64)
        self.next = expand(ids, np.int32)
        self.previous = np.roll(self.next, 1)
        full = self.lengths[self.lengths > 0]
        self.starts = np.cumsum(full) - full
        self.previous[self.starts] = np.searchsorted(self.words, np.uint64(START))
        self.pairs = self.words[self.previous] * PAIR + self.words[self.next]
        self.of = np.repeat(np.arange(len(self.lengths)), self.lengths)  # the document of each word
        self.near = expand(near, np.int8).astype(bool)[self.of]

    def own(self, places: np.ndarray, size: int) -> np.ndarray:
        """How often the word's own document has what stands at each word."""
        _, at, n = np.unique(self.of * size + places, return_inverse=True, return_counts=True)
        return n[at]


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among the sorted keys, and the end of the last."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def sums(keys: list[np.ndarray], counts: list[tuple[list[np.ndarray], list[np.ndarray]]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each of the counts, an array (distinct keys, 2) of the target's sums and the others'; and each row's places among the distinct keys."""
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
    place = np.empty(len(flat), np.int64)
    place[order] = np.cumsum(new) - 1
    size = int(new.sum())
    totals = [np.column_stack([np.bincount(place, np.concatenate(x), size) for x in both]).astype(np.int64) for both in counts]
    return totals, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def routes(n_words: int, n_blocks: int) -> tuple[int, int, int]:
    """Buckets in a coarse range, coarse ranges, and groups of blocks."""
    buckets = max(8, -(-n_words // BUCKET_WORDS))
    fan = max(2, round(buckets**0.5))
    return fan, -(-buckets // fan), max(1, -(-n_blocks // fan))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go as soon as it has ended, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(docs: DataFrame, target: Column, text: str = "text") -> DataFrame:
    """All columns of docs but the text, plus n_words, target_loss, background_loss (means a word) and lm_score, their difference.

    target: a condition that tells the target's rows; null is false.
    """
    added = [T.StructField("n_words", T.LongType()), T.StructField("target_loss", T.DoubleType()), T.StructField("background_loss", T.DoubleType()), T.StructField("lm_score", T.DoubleType())]
    names = [f.name for f in added]
    kept = [c for c in docs.columns if c != text and c not in names]
    flag = "_" * (1 + max(map(len, docs.columns)))
    work = Workspace(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in (*kept, text)], F.coalesce(target.cast("boolean"), F.lit(False)).alias(flag))
    blocks = work.keep(rows.mapInArrow(lambda batches: packed(batches, text, kept, flag), PACKED))
    n_words, n_blocks = blocks.agg(F.sum("n"), F.count("*")).first()
    fan, ranges, groups = routes(n_words or 0, n_blocks)
    tables = ("pairs_near", "pairs_far", "after_near", "after_far", "before_near", "before_far", "pairs", "words")

    def cut_up(pairs: np.ndarray, words: np.ndarray, counts: list[np.ndarray], parts: int, first: int, into: int) -> Iterator[tuple]:
        """The sorted hashes and their counts, cut at those of `into` ranges that are numbered first, first + 1, ..."""
        at, to = (bounds(x, into)[first : first + parts + 1] for x in (pairs, words))
        for k, i, j, v, w in zip(range(first, first + parts), at[:-1], at[1:], to[:-1], to[1:]):
            sides = [x[i:j] for x in counts[:2]] + [x[v:w] for x in counts[2:]]
            yield (k, *map(squeeze, (*sides, np.diff(pairs[i:j], prepend=np.uint64(0)), np.diff(words[v:w], prepend=np.uint64(0)))))

    places = ("pair_places", "word_places")

    def sent(rows: list[tuple], numbers: list[str], binaries: tuple[str, ...] = tables) -> pa.Table:
        kinds = [pa.int64()] * len(numbers) + [pa.binary()] * len(binaries)
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], f) for c, f in enumerate(kinds)], names=[*numbers, *binaries])

    def tell(batches: Iterator[pa.RecordBatch], first: int, end: int) -> Iterator[pa.RecordBatch]:
        """For each block and coarse range from first to before end: the block's bigrams and words there, and how often the target's and its other documents have them."""
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                b = Block(r["near"], r["lengths"], r["words"], r["ids"])
                pairs, place = np.unique(b.pairs, return_inverse=True)
                counts = [np.bincount(x[near], minlength=n).astype(np.int64) for x, n in ((place, len(pairs)), (b.next, len(b.words)), (b.previous, len(b.words))) for near in (b.near, ~b.near)]
                told = cut_up(pairs, b.words, counts, end - first, first, ranges)
                yield from sent([(r["block"] % groups * ranges + x[0], r["block"], *x[1:]) for x in told], ["cell", "block"]).to_batches()

    def hashes_of(rows: list[dict], column: str) -> list[np.ndarray]:
        return [np.cumsum(expand(r[column], np.uint64), dtype=np.uint64) for r in rows]

    def added_up(rows: list[dict]) -> tuple:
        """The distinct bigrams and words of rows, three arrays of their sums by model, and each row's places among the bigrams and words."""
        pairs, word = hashes_of(rows, "pairs"), hashes_of(rows, "words")
        count = lambda c: tuple([expand(r[f"{c}_{side}"], np.int64) for r in rows] for side in ("near", "far"))
        (n,), at = sums(pairs, [count("pairs")])
        (after, before), to = sums(word, [count("after"), count("before")])
        distinct = [np.zeros(size, np.uint64) for size in (len(n), len(after))]
        for into, keys, places in ((distinct[0], pairs, at), (distinct[1], word, to)):
            for k, place in zip(keys, places):
                into[place] = k
        return *distinct, n, after, before, at, to

    def pool(told: pa.Table) -> pa.Table:
        """What the blocks of a group together have in each bucket of a coarse range; and each block's places in that."""
        rows = told.to_pylist()
        pairs, word, n, after, before, at, to = added_up(rows)
        cell = rows[0]["cell"]
        out = [(x[0], cell, None, *x[1:], None, None) for x in cut_up(pairs, word, [*n.T, *after.T, *before.T], fan, cell % ranges * fan, ranges * fan)]
        steps = lambda x: squeeze(np.diff(x, prepend=0).astype(np.int32))
        out += [(None, cell, r["block"], *[None] * len(tables), steps(i), steps(j)) for r, i, j in zip(rows, at, to)]
        return sent(out, ["bucket", "cell", "block"], tables + places)

    def told_form(numbers: str, binaries: tuple[str, ...] = tables) -> str:
        return numbers + ", " + ", ".join(f"{x} binary" for x in binaries)

    def replies(rows: list[tuple]) -> pa.Table:
        kinds = [pa.int64()] * 5 + [pa.binary()] * 2
        return pa.Table.from_arrays([pa.array([x[c] for x in rows], f) for c, f in enumerate(kinds)], names=["reader", "part", "vocabulary", "near", "far", "pairs", "words"])

    def answer(told: pa.Table) -> pa.Table:
        """To each group in the bucket: both models' counts of what it told, in its order, and the bucket's words."""
        rows = told.to_pylist()
        _, word, n, after, before, at, to = added_up(rows)
        facts = int(((after.sum(1) > 0) & (word > START)).sum()), *(int(x) for x in after.sum(0))
        return replies([(r["cell"], r["bucket"], *facts, squeeze(n[i].ravel()), squeeze(np.column_stack([after[j], before[j]]).ravel())) for r, i, j in zip(rows, at, to)])

    def joined(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Counts of bigrams (near, far) and words (after: near, far; before: near, far) over all parts, and the sums of the facts."""
        rows = sorted(rows, key=lambda x: x["part"])
        n, counts = (np.concatenate([expand(x[c], np.int64) for x in rows]).reshape(-1, size) for c, size in (("pairs", 2), ("words", 4)))
        return n, counts, [sum(x[c] for x in rows) for c in ("vocabulary", "near", "far")]

    def hand_out(told: pa.Table, answered: pa.Table) -> pa.Table:
        """The answers to a group, to each of its blocks."""
        rows = told.to_pylist()
        n, counts, facts = joined(answered.to_pylist())
        part = rows[0]["cell"] % ranges
        found = lambda x, steps: squeeze(x[np.cumsum(expand(steps, np.int32), dtype=np.int64)].ravel())
        return replies([(r["block"], part, *facts, found(n, r["pair_places"]), found(counts, r["word_places"])) for r in rows])

    form = "reader bigint, part bigint, vocabulary bigint, near bigint, far bigint, pairs binary, words binary"
    edges = [ranges * i // PASSES for i in range(PASSES + 1)]
    parts = []
    for first, end in zip(edges[:-1], edges[1:]):
        with freed_shuffles(docs.sparkSession):
            told = blocks.select("block", "near", "lengths", "words", "ids").mapInArrow(lambda batches, first=first, end=end: tell(batches, first, end), told_form("cell bigint, block bigint"))
            pooled = work.keep(told.groupBy("cell").applyInArrow(pool, told_form("bucket bigint, cell bigint, block bigint", tables + places)))
            answers = work.keep(pooled.where("bucket IS NOT NULL").select("bucket", "cell", *tables).groupBy("bucket").applyInArrow(answer, form))
            stand = pooled.where("block IS NOT NULL").select("cell", "block", *places)
            parts.append(work.keep(stand.groupBy("cell").cogroup(answers.groupBy("reader")).applyInArrow(hand_out, form)))
        work.drop(pooled, answers)
    answered = reduce(DataFrame.unionByName, parts)
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def judge(block: pa.Table, told: pa.Table) -> pa.Table:
        (r,) = block.to_pylist()
        b = Block(r["near"], r["lengths"], r["words"], r["ids"])
        pairs, at = np.unique(b.pairs, return_inverse=True)
        n, counts, (vocabulary, *totals) = joined(told.to_pylist())
        entries = vocabulary + 2
        full = b.lengths > 0
        own, own_after, own_before = b.own(at, len(pairs)), b.own(b.next, len(b.words)), b.own(b.previous, len(b.words))
        means = []
        for k, mine in enumerate((b.near, ~b.near)):  # whether the model counted the word's document
            scale = totals[0] / totals[1] if k and totals[1] else 1.0
            p = (scale * (counts[b.next, k] - mine * own_after) + 1) / (scale * (totals[k] - mine * b.lengths[b.of]) + entries)
            loss = -np.log((scale * (n[at, k] - mine * own) + WEIGHT * p) / (scale * (counts[b.previous, 2 + k] - mine * own_before) + WEIGHT))
            mean = np.zeros(len(full))
            if full.any():
                mean[full] = np.add.reduceat(loss, b.starts) / b.lengths[full]
            means.append(mean)
        docs = pa.ipc.open_stream(r["rows"]).read_all()
        new = [pa.array(b.lengths), *(pa.array(x, mask=~full) for x in (*means, means[0] - means[1]))]
        return pa.Table.from_arrays([docs.column(c) for c in kept] + new, names=[*kept, *names])

    return blocks.drop("n").groupBy("block").cogroup(answered.groupBy("reader")).applyInArrow(judge, schema)
