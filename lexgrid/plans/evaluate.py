"""Evaluation: recall at k, parameter grids, the best method by language, result rendering."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions import weighting
from lexgrid.operators import index as ix
from lexgrid.operators import search as se
from lexgrid.operators.workspace import materialise

#: Tuned (lang, method, k1, b, d).
BEST = (
    ("ar", "DLITE", 1.6, 0.9, 1.0), ("de", "BM25_V1", 1.8, 0.9, 1.0), ("en", "TF_LDP", 1.5, 0.5, 0.8), ("es", "TF_LDP", 1.5, 0.8, 0.4),
    ("fr", "BM25_V2", 1.9, 0.8, 1.0), ("it", "BM25_V2", 1.4, 0.9, 1.0), ("ko", "BM25_V1", 1.5, 0.7, 1.0),
)
ALL = "*"


def best_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BEST), "lang string, method string, k1 double, b double, d double")


def grid_values() -> list[tuple[float, float, float]]:
    """The full grid of (k1, b, d): 11 x 13 x 2."""
    return [(round(1 + 0.1 * i, 10), round(0.3 + 0.05 * j, 10), d) for d in (1.0, 0.5) for j in range(13) for i in range(11)]


def hits(results: DataFrame, truth: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """truth (query_id, lang, doc_id) with `hit`: 1 if the document is among the results; keys: columns that tell runs apart."""
    on = ["query_id", "lang", "doc_id"]
    seen = results.select(*keys, *on).withColumn("hit", F.lit(1.0))
    if not keys:
        return truth.join(seen, on, "left").fillna(0.0, ["hit"])
    runs = results.select(*keys).distinct()
    return truth.crossJoin(F.broadcast(runs)).join(seen, [*keys, *on], "left").fillna(0.0, ["hit"])  # a row a run: the grid's size


def recall(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(lang, n_queries, recall) of each language."""
    return hits(results, truth).groupBy("lang").agg(F.count("*").alias("n_queries"), F.avg("hit").alias("recall"))


def recall_overall(results: DataFrame, truth: DataFrame) -> DataFrame:
    """As recall(), with a row for all languages under ALL, in one plan."""
    rolled = hits(results, truth).rollup("lang").agg(F.count("*").alias("n_queries"), F.avg("hit").alias("recall"), F.grouping("lang").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, ALL).otherwise(F.col("lang")).alias("lang"), "n_queries", "recall")


def corners(method: str, runs: list[tuple[float | None, ...]]) -> list[tuple[float | None, ...]]:
    """The (k1, b, d) among which a weight is largest of all runs: of a method not known to be monotone, all."""
    if weighting.METHODS[method][0] not in weighting.MONOTONE:
        return runs
    ends = [sorted({f(v) for f in (min, max)}) if v[0] is not None else [None] for v in zip(*runs)]
    return [(k1, b, d) for k1 in ends[0] for b in ends[1] for d in ends[2]]


def grid_search(docs: DataFrame, queries: DataFrame, truth: DataFrame, method: str, grid: list[tuple[float, float, float]], k: int = 10, digits: int | None = None) -> DataFrame:
    """(k1, b, d, lang, recall) for every (k1, b, d) of the grid.

    A document sought is among the k best at a point if fewer than k documents are before it there. So the documents sought are
    scored at all points first. For all others there is a bound of what they can gain, one for the points that share b and d; only
    those that reach the least score of the document sought at these points are scored at all points, which are columns of one
    aggregation, and counted. There is never a row a point before the counts. Points that differ in parameters the method ignores
    share one.
    """
    spark = docs.sparkSession
    used = weighting.METHODS[method][2]
    effective = lambda point: tuple(v if name in used else None for name, v in zip(("k1", "b", "d"), point))
    runs = sorted({effective(p) for p in grid}, key=str)
    points = spark.createDataFrame([(float(k1), float(b), float(d), runs.index(effective((k1, b, d)))) for k1, b, d in grid], "k1 double, b double, d double, run int")
    cells = sorted({run[1:] for run in runs}, key=str)
    within = [[i for i, run in enumerate(runs) if run[1:] == cell] for cell in cells]
    rounded = lambda x: F.round(x, digits) if digits is not None else x

    pair, keys = ["query_id", "lang"], ["query_id", "lang", "doc_id"]
    truth = materialise(truth.select(*keys))
    sought = truth.distinct()
    terms = se.query_terms(queries)
    terms = materialise(terms.join(truth.select(*pair).distinct(), [c for c in pair if c in terms.columns]).select(*pair, "term", "qtf"))
    packs = ix.pack(docs, terms.select("term").distinct())
    tf, df, of = packs.counted()
    rows = ix.joined(materialise(tf), df, of)
    about = {"c": F.col("c"), "length": F.col("dl"), "mean": F.col("avg_len"), "total": F.col("n_docs"), "n": F.col("n")}
    default = weighting.DEFAULTS
    weight = lambda run: weighting.weight(method, **about, **{x: F.lit(float(default[x] if v is None else v)) for x, v in zip(("k1", "b", "d"), run)})
    every = [F.sum(F.col("qtf") * weight(run)) for run in runs]

    def at_all_points(pairs: DataFrame, into: str) -> DataFrame:
        """(keys, into): the scores of some (query_id, lang, doc_id) at all points, null without a weight."""
        met = pairs.join(terms, pair).join(rows, ["lang", "doc_id", "term"])
        scored = met.groupBy(*keys).agg(*[x.alias(f"s{i}") for i, x in enumerate(every)])
        return scored.select(*keys, F.array(*[rounded(F.col(f"s{i}")) for i in range(len(runs))]).alias(into))

    goal = materialise(at_all_points(sought, "goal"))
    least = goal.groupBy(*pair).agg(*[F.min(F.array_min(F.array(*[F.get("goal", F.lit(i)) for i in own]))).alias(f"l{j}") for j, own in enumerate(within)])
    # A missing weight adds nothing, as 0 does.
    tops = [F.greatest(F.lit(0.0), *[weight(run) for run in corners(method, [runs[i] for i in own])]).alias(f"w{j}") for j, own in enumerate(within)]
    bounded = lambda rows: rows.select("lang", "term", "doc_id", *tops)
    near = se.near_queries(bounded(rows), df, terms, lambda tasks: bounded(ix.joined(packs.frequencies(tasks), df, of)))
    bounds = near.join(terms, ["lang", "term"]).groupBy(*keys).agg(*[F.sum(F.col("qtf") * F.col(f"w{j}")).alias(f"u{j}") for j in range(len(cells))])
    slack = lambda x: (10.0**-digits if digits is not None else 0.0) + 1e-9 * (1 + F.abs(x))  # noqa: E731, of roundings
    reach = [F.coalesce(F.col(f"u{j}") >= F.col(f"l{j}") - slack(F.col(f"l{j}")), F.lit(False)) for j in range(len(cells))]
    rivals = materialise(bounds.join(F.broadcast(least), pair).where(reduce(or_, reach)).select(*keys))  # a row a benchmark text and language

    met = at_all_points(rivals, "s").withColumnRenamed("doc_id", "other").join(goal, pair)
    one, own = (lambda i: F.get("s", F.lit(i))), (lambda i: F.get("goal", F.lit(i)))
    before = [F.sum(((one(i) > own(i)) | ((one(i) == own(i)) & (F.col("other") < F.col("doc_id")))).cast("int")).alias(f"b{i}") for i in range(len(runs))]
    counts = goal.join(met.groupBy(*keys).agg(*before), keys, "left")
    hit = F.array(*[(own(i).isNotNull() & (F.coalesce(f"b{i}", F.lit(0)) < k)).cast("int") for i in range(len(runs))])
    told = counts.select(*keys, F.posexplode(hit).alias("run", "hit"))
    hits_of = truth.join(told, keys).groupBy("lang", "run").agg(F.sum("hit").alias("hits"))
    asked = truth.groupBy("lang").agg(F.count("*").alias("asked"))
    all_runs = asked.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1))))
    recall = all_runs.join(hits_of, ["lang", "run"], "left").select("lang", "run", (F.coalesce("hits", F.lit(0)) / F.col("asked")).alias("recall"))
    return points.join(recall, "run").select("k1", "b", "d", "lang", "recall")


def submission(results: DataFrame) -> DataFrame:
    """(id, docids): the ranked ids of each query rendered as a list of quoted strings."""
    ranked = results.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    quoted = F.transform("r", lambda x: F.concat(F.lit("'"), x["doc_id"].cast("string"), F.lit("'")))
    return ranked.select("id", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("docids"))


def write_submission(results: DataFrame, path: str) -> None:
    """One CSV file with a header (K2): a row a query, so it stays small."""
    submission(results).orderBy("id").coalesce(1).write.mode("overwrite").csv(path, header=True)


def run_id(run: Mapping[str, object]) -> str:
    """A name for a run that is the same whenever it is repeated: a digest of what it was told to do."""
    return hashlib.sha256(json.dumps({k: str(v) for k, v in run.items()}, sort_keys=True).encode()).hexdigest()[:16]


def log_metrics(metrics: DataFrame, path: str, run: Mapping[str, object] | None = None, timings: Mapping[str, float] | None = None) -> str:
    """Write to a table of runs (K4), with the run's method, parameters and timings as columns, and return the run's id.

    The id is a partition, so a run that is repeated or retried replaces its own rows. Read the table with mergeSchema.
    """
    name = run_id(run or {})
    told = {k: F.lit(v) for k, v in {**(run or {}), **(timings or {})}.items() if k not in metrics.columns}
    rows = metrics.withColumns(told | {"logged_at": F.current_timestamp(), "run_id": F.lit(name)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return name
