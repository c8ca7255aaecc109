"""One large file read in parallel where records hold line breaks: JSON arrays and quoted CSV (S1-S3, F-9).

Spark's text reader cuts the file at a separator, in byte ranges: at `}` for JSON, at line ends for CSV. Whether a piece ends a
record depends on all before it: on the parity of the quotes, and for JSON on how many braces are open. Each range first tells
what it does to that state, whichever it starts in; running sums over the ranges, a row each, give every range its true start.
Then each range puts its pieces together, and only the records that cross a range's end are shuffled.

Files are read through Spark alone, whatever store they lie in. Records may be of any length; one is held whole by a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = ["file", "start"]


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, start, text) in the order of the file within each range, which begins at byte `start`."""
    raw = spark.read.text(path, lineSep=separator)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))


def effects(text: Column, braces: bool) -> list[Column]:
    """Quotes of a piece that are not escaped, how it changes the number of open braces if it starts outside a string, or within
    one, and whether it is an empty line."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    if not braces:
        return [count(text, '"').alias("quotes"), F.lit(0).alias("out"), F.lit(0).alias("in"), (F.trim(text, F.lit(" \r\t")) == "").alias("blank")]
    bare = F.regexp_replace(text, r"\\(?s:.)", "")
    quotes = count(bare, '"')
    plain = lambda x: count(F.regexp_replace(x, '"[^"]*("|$)', ""), "{")
    closes = lambda even: F.when(quotes % 2 == (0 if even else 1), 1).otherwise(0)  # noqa: E731  the } that ends the piece, unless within a string
    return [quotes.alias("quotes"), (plain(bare) - closes(True)).alias("out"), (plain(F.concat(F.lit('"'), bare)) - closes(False)).alias("in"), F.lit(False).alias("blank")]


def ranges(found: DataFrame) -> DataFrame:
    """(file, start, odd, and for a start outside and within a string: change, least, ends): what each range does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[list]] = {}
        for b in batches:
            for file, start, quotes, out, within, blank in zip(*(b.column(c).to_pylist() for c in ("file", "start", "quotes", "out", "in", "blank"))):
                for state in seen.setdefault((file, start), [[False, 0, 1 << 60, 0], [True, 0, 1 << 60, 0]]):
                    if blank and not state[0]:
                        continue
                    state[1] += within if state[0] else out
                    state[0] ^= bool(quotes % 2)
                    if not state[0]:
                        state[2], state[3] = min(state[2], state[1]), state[3] + 1
        rows = [(f, s, a[0], a[1], a[2], a[3], b[1], b[2], b[3]) for (f, s), (a, b) in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["file", "start", "odd", "change0", "least0", "ends0", "change1", "least1", "ends1"])

    return found.mapInArrow(run, "file string, start long, odd boolean, change0 long, least0 long, ends0 long, change1 long, least1 long, ends1 long")


def states(told: DataFrame) -> DataFrame:
    """(file, start, within, depth, opened, first): each range's true start, the range in which the record open there began, and the
    number of records that begin before it in all files, in the order of their names, but for the first of each (for records
    without braces)."""
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    rows = told.withColumn("within", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    for c in ("change", "least", "ends"):
        rows = rows.withColumn(c, F.when(F.col("within"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")))
    rows = rows.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    open_at, open_end = F.col("within") | (F.col("depth") > 0), (F.col("within") != F.col("odd")) | (F.col("depth") + F.col("change") > 0)
    anew = ~open_at | (F.col("depth") + F.col("least") <= 0)  # no record was open at some place in the range
    rows = rows.withColumn("opens", open_end & anew)
    rows = rows.withColumn("opened", F.when(open_at, F.last(F.when(F.col("opens"), F.col("start")), ignorenulls=True).over(before)))
    begun = F.col("ends") - (open_at & (F.col("ends") > 0)).cast("int") + F.col("opens").cast("int") - (F.col("start") == 0).cast("int")
    first = F.coalesce(F.sum("begun").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return rows.withColumn("begun", begun).select(*RANGE, "within", "depth", "opened", first.alias("first"))


def assembled(found: DataFrame, starts: DataFrame, separator: str) -> DataFrame:
    """(id, text) of whole records; ids count records without braces, from 0, but for the first of each file, which has -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, within, depth, owner, number, base = None, [], False, 0, None, 0, 0

        def part() -> list[tuple]:
            begun = now[1] if owner is None else owner
            return [(now[0], owner, now[1], -1 if begun == 0 and number < base else number, separator.join(parts))] if parts else []

        for b in batches:
            out = []
            names = ("file", "start", "text", "quotes", "out", "in", "blank", "within", "depth", "opened", "first")
            for file, start, text, quotes, d0, d1, blank, w, d, opened, first in zip(*(b.column(c).to_pylist() for c in names)):
                if now != (file, start):
                    if now and (within or depth > 0):
                        owner = now[1] if owner is None else owner
                        out += part()
                    now, parts, within, depth, owner, base = (file, start), [], w, d, opened, first
                    number = first - (opened is not None or start == 0)
                if blank and not within:
                    continue
                parts.append(text)
                depth += d1 if within else d0
                within ^= bool(quotes % 2)
                if not within and depth <= 0:
                    parts.append("")  # what follows the last separator
                    out += part()
                    parts, owner, number = [], None, number + 1
            yield of(out)
        if now and (within or depth > 0):
            owner = now[1] if owner is None else owner
            yield of(part())

    def of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["file", "owner", "start", "id", "text"])

    met = found.join(F.broadcast(starts), RANGE)  # a row a range: order within a range stays
    got = met.mapInArrow(run, "file string, owner long, start long, id long, text string")
    # A record that crosses ranges is a part in each of them, all of one owner; the separator stands between them.
    crossing = got.where("owner IS NOT NULL").groupBy("file", "owner").agg(F.max("id").alias("id"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    joined = crossing.select("id", F.array_join(F.transform("parts", lambda x: x["text"]), separator).alias("text"))
    return got.where("owner IS NULL").select("id", "text").unionByName(joined)


def records(spark: SparkSession, path: str, separator: str, braces: bool) -> DataFrame:
    found = pieces(spark, path, separator)
    found = found.select("*", *effects(F.col("text"), braces))
    return assembled(found, states(ranges(found)), separator)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that each hold one JSON array of objects (or objects one after the other), in no order.

    Objects may be nested, strings may hold anything. What isn't an object in the array is left out; an object that can't be read
    has nulls.
    """
    whole = records(spark, path, "}", True).select(F.regexp_extract("text", r"(?s)\{.*", 0).alias("text")).where("text <> ''")
    return whole.select(F.from_json("text", schema).alias("r")).select("r.*")


def read_csv_records(spark: SparkSession, path: str, schema: str, into: str = "query_id") -> DataFrame:
    """Rows of CSV files with a header, quotes doubled within quotes, and line breaks allowed in them, with their positions from 0.

    Columns are found by name. Files follow each other in the order of their names; empty lines have no row, and no position.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    header = spark.read.csv(path, header=True, quote='"', escape='"').columns
    raw = ", ".join(f"`{c}` string" for c in header)
    lines = records(spark, path, "\n", False).where("id >= 0").select("id", F.regexp_replace("text", r"\r?\n$", "").alias("text"))
    rows = lines.select(F.col("id").alias(into), F.from_csv("text", raw, {"quote": '"', "escape": '"', "multiLine": "true"}).alias("r"))
    kinds = dict(x.split() for x in schema.split(", "))
    return rows.select(into, *[F.col(f"r.`{n}`").cast(kinds[n]).alias(n) for n in names])
