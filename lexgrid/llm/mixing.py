"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. In the ideal, all sources that have blocks left are served at once, each at a rate
in proportion to its weight, so after t slots a source has had its exact share of t; when a source runs out, the others go on
at the same proportions. A block is released at the slot in which the ideal begins it and due by the slot in which the ideal
ends it; the released block due first gets the next slot. So after any number of slots a source has had what the ideal gave it,
give or take less than one block, over the whole table: every document comes once, none is dropped or repeated.

Weights are taken as the rational numbers that their floats are, and releases and deadlines are computed in integers: nothing
is rounded. The driver turns the sources' counts (one row a source) into slots, one row a block, in pieces: it holds some
numbers for each source, of which there may be any number, and one piece. Documents find their slots by an equi-join. A slot
costs the driver some 3 microseconds: take blocks of 1,024 for 10^10 documents.

DataFrame functions only on the data. Ranks within a source come from small hash buckets and their running counts, so a source
with a third of all rows is spread over as many tasks as its rows need.

Defined cases: a null source is a source of its own. Sources without a stated weight get `default`; those of weight 0 follow the
others, in equal parts. Equal rows keep one place each; rows that differ in a map only are different rows. An empty table gives no rows. Extra columns pass through, whatever
their names.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.llm.common import BROADCAST_ROWS, Workspace, shared_folder

#: Slots that the driver holds at once.
BLOCK, PIECE = 16, 2**20


def slots(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int]]:
    """The earliest-deadline-first schedule: (source's index, its block) for each slot. Weights are integers above 0."""
    ends = sorted((Fraction(n, w), n, w) for n, w in zip(blocks, weights) if n)
    # The ideal at time v, each source having v * weight blocks: past blocks of the sources that ran out, plus v times the
    # weight of the others. One such line holds between the ends of two sources, and the least of all holds everywhere.
    past, alive = [0], [sum(w for _, _, w in ends)]
    for _, n, w in ends:
        past.append(past[-1] + n)
        alive.append(alive[-1] - w)
    until = [float(v) for v, _, _ in ends]

    def ideal(j: int, w: int) -> int:
        """Slots, times w, after which the ideal has given a source of weight w its first j blocks."""
        v = j / w
        k = bisect_left(until, v)
        low, high = bisect_left(until, v * (1 - 1e-14)), bisect_left(until, v * (1 + 1e-14))
        if low == high:
            return past[k] * w + j * alive[k]
        return min(past[k] * w + j * alive[k] for k in range(low, high + 1))

    waiting = [(0, s) for s, n in enumerate(blocks) if n]  # (release, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    done, reached = [0] * len(blocks), [0] * len(blocks)
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            reached[s] = ideal(done[s] + 1, weights[s])
            heapq.heappush(ready, (-(-reached[s] // weights[s]), s))
        s = heapq.heappop(ready)[1]
        yield s, done[s]
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (reached[s] // weights[s], s))


def whole_weights(weights: list[float]) -> list[int]:
    """Integers in exactly these proportions."""
    parts = [Fraction(w) for w in weights]
    common = math.lcm(*(p.denominator for p in parts))
    return [int(p * common) for p in parts]


def cycle(weights: list[int]) -> list[tuple[int, int]]:
    """One cycle of the schedule, in which each source has as many blocks as its weight."""
    return list(slots(weights, weights))


def plan(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """(source's index, its block) for each slot; sources of weight 0 follow the others in equal parts."""
    whole = whole_weights(weights)
    yield from slots([n if w else 0 for n, w in zip(blocks, whole)], whole)
    yield from slots([0 if w else n for n, w in zip(blocks, whole)], [1] * len(whole))


def placed(spark: SparkSession, names: list[str | None], order: Iterator[tuple[int, int]]) -> DataFrame:
    """The plan as a table (s, b, slot); beyond one piece it is written piece by piece, so the driver never holds more."""
    folder, start = None, 0
    while True:
        rows = list(islice(order, PIECE))
        kinds = {"s": pa.string(), "b": pa.int64(), "slot": pa.int64()}
        values = [names[s] for s, _ in rows], [j for _, j in rows], range(start, start + len(rows))
        piece = spark.createDataFrame(pa.table([pa.array(x, t) for x, t in zip(values, kinds.values())], names=list(kinds)))
        start += len(rows)
        if folder is None and len(rows) < PIECE:
            return piece
        folder = folder or shared_folder(spark)
        piece.write.mode("append").parquet(folder)
        if len(rows) < PIECE:
            return spark.read.schema(piece.schema).parquet(folder)


def slotted(docs: DataFrame, source: str, key: str, weights: Mapping[str, float] | None, default: float, temper: float, block: int, seed: int) -> DataFrame:
    """(row, slot, seq): all columns of docs as a struct, and the row's place."""
    spark = docs.sparkSession
    counts = sorted(docs.groupBy(F.col(source).cast("string").alias("s")).count().toArrow().to_pylist(), key=lambda r: (r["s"] is None, r["s"] or ""))
    total = sum(r["count"] for r in counts)
    target = [float(weights.get(r["s"], default)) if weights is not None else r["count"] ** temper for r in counts]
    places = placed(spark, [r["s"] for r in counts], plan([-(-r["count"] // block) for r in counts], target))

    buckets = max(1, -(-total // max(1024, math.isqrt(total))))
    own = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    rows = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("src"), F.col(key).alias("key"), F.xxhash64(*own).alias("r"), F.xxhash64(F.lit(seed), *own).alias("r2"))
    # Places are found for the keys and hashes of rows, equal ones at once; the rows themselves are met with them once.
    d = rows.groupBy("src", "key", "r", "r2").agg(F.count("*").alias("copies"))
    d = d.withColumn("h", F.xxhash64(F.lit(seed), "key")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key", F.pmod("r", F.lit(64))), F.lit(buckets)))
    sizes = d.groupBy(F.col("src").alias("s"), F.col("bucket").alias("b")).agg(F.sum("copies").alias("size"))
    before = sizes.withColumn("off", F.sum("size").over(W.partitionBy("s").orderBy("b")) - F.col("size")).drop("size")
    local = F.sum("copies").over(W.partitionBy("src", "bucket").orderBy("h", "key", "r", "r2").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("i", local - F.col("copies"))
    d = d.join(before, F.col("src").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    d = d.select("key", "r", "r2", "src", "copies", (F.col("i") + F.col("off")).alias("i"))
    d = d.withColumn("j", F.explode(F.sequence(F.expr(f"i div {block}"), F.expr(f"(i + copies - 1) div {block}"))))
    d = d.join(places, F.col("src").eqNullSafe(F.col("s")) & (F.col("j") == F.col("b")))
    first = F.greatest(F.col("i") - F.col("j") * block, F.lit(0)).cast("int")
    last = F.least(F.col("i") + F.col("copies") - 1 - F.col("j") * block, F.lit(block - 1)).cast("int")
    found = Workspace(spark).keep(d.select(F.col("key").alias("k"), F.col("r").alias("q"), F.col("r2").alias("q2"), "slot", "copies", F.explode(F.sequence(first, last)).alias("seq")))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("r") == F.col("q")) & (F.col("r2") == F.col("q2"))
    small = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4 else df  # noqa: E731  five columns
    again = found.where("copies > 1").select("k", "q", "q2").distinct()
    if not again.isEmpty():  # equal rows: one of them takes all their places
        again = small(again)
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["key", "r", "r2"]))
    return rows.join(small(found), same).select("row", "slot", "seq")


def schedule(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: Mapping[str, float] | None = None, default: float = 1.0, temper: float = 0.5, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """All columns of docs plus `mix_slot` (long) and `mix_seq` (int), which take the place of any so named: the mixed order is the order by these two.

    weights: target weight by source; if none are given, a source's weight is its number of documents to the power `temper`.
    Within a source the order is by a seeded hash of the key, then the key, then a hash of the whole row.
    """
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("mix_slot", "mix_seq")]
    return slotted(docs, source, key, weights, default, temper, block, seed).select(*kept, F.col("slot").alias("mix_slot"), F.col("seq").alias("mix_seq"))


def in_order(scheduled: DataFrame, slot: str = "mix_slot", seq: str = "mix_seq") -> DataFrame:
    """Partitions and rows within them in the order of the schedule."""
    return scheduled.repartitionByRange(slot, seq).sortWithinPartitions(slot, seq)


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: Mapping[str, float] | None = None, default: float = 1.0, temper: float = 0.5, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The documents in mixed order, with the columns they came with: files and rows within them follow the schedule.

    A reader may take the files in any order; schedule() of the rows read gives the same slots again.
    """
    return in_order(slotted(docs, source, key, weights, default, temper, block, seed), "slot", "seq").select("row.*")
