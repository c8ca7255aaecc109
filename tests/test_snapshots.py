"""Saved indexes under failure, the log of runs, and byte ranges on the command line."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexgrid.functions.analysis import analyze
from lexgrid.operators import index as ix
from lexgrid.operators import search as se
from lexgrid.operators import snapshots
from lexgrid.plans import evaluate


@pytest.fixture
def two(spark):
    rows = [("xx", 0, "apple apple banana"), ("xx", 1, "banana cherry"), ("yy", 2, "apple")]
    docs = analyze(spark.createDataFrame(rows, "lang string, doc_id long, text string"))
    return ix.build_index(docs, "TFIDF"), ix.build_index(docs.where("doc_id <> 1"), "TFIDF")


def found(spark, path, **options):
    queries = analyze(spark.createDataFrame([(0, "apple banana")], "query_id long, text string"))
    return sorted(map(tuple, se.search(ix.load_index(spark, path, **options), queries, padded=True).collect()))


@pytest.mark.parametrize("table", ix.TABLES)
def test_a_failed_save_changes_nothing(spark, two, tmp_path, table):
    path = str(tmp_path / "i")
    ix.save_index(two[0], path)
    before = found(spark, path)
    broken = getattr(two[1], table).withColumn("lang", F.when(F.length("lang") < 9, F.raise_error(F.lit("lost"))).otherwise(F.col("lang")).cast("string"))
    if table == "meta":
        two[1].meta = two[1].meta.withColumn("k1", F.col("k1") + F.raise_error(F.lit("lost")).cast("double"))
    else:
        setattr(two[1], table, broken)
    with pytest.raises(PySparkException):
        ix.save_index(two[1], path)
    assert found(spark, path) == before
    assert (ix.clean_index(spark, path) > 0) == (table != "postings") and found(spark, path) == before  # the first write fails before it has files


def test_postings_meet_their_own_documents(spark, two, tmp_path):
    """A second method of other documents leaves the first as it was, and a later save replaces its own only."""
    path = str(tmp_path / "i")
    ix.save_index(two[0], path)
    before = found(spark, path)
    two[1].meta = two[1].meta.withColumn("method", F.lit("OTHER"))
    ix.save_index(ix.settle(two[1]), path)
    assert found(spark, path, method="TFIDF") == before
    assert {r[3] for r in found(spark, path, method="OTHER")} == {0, 2}
    two[1].meta = two[1].meta.withColumn("method", F.lit("TFIDF"))
    ix.save_index(two[1], path)
    assert {r[3] for r in found(spark, path, method="TFIDF")} == {0, 2}
    assert ix.clean_index(spark, path) == len(ix.TABLES) and {r[3] for r in found(spark, path, method="TFIDF")} == {0, 2}


def test_an_overtaken_save_fails(spark, tmp_path):
    path = str(tmp_path / "i")

    def write(snapshot):
        snapshots.publish(spark, path, ["b"], lambda s: None)

    with pytest.raises(RuntimeError):
        snapshots.publish(spark, path, ["a"], write)
    number, parts = snapshots.manifest(spark, path)
    assert number == 1 and set(parts) == {"b"}


def test_a_repeated_run_leaves_one_set_of_rows(spark, tmp_path):
    metrics = spark.createDataFrame([("en", 0.5), ("de", 0.25)], "lang string, recall double")
    path, run = str(tmp_path / "runs"), {"method": "TFIDF", "k1": 1.5}
    first = evaluate.log_metrics(metrics, path, run, {"build_seconds": 3.0})
    assert evaluate.log_metrics(metrics, path, run, {"build_seconds": 4.0}) == first
    other = evaluate.log_metrics(metrics, path, run | {"k1": 2.0})
    rows = spark.read.option("mergeSchema", "true").parquet(path).collect()
    assert sorted((r["run_id"], r["lang"], r["build_seconds"]) for r in rows if r["run_id"] == first) == [(first, "de", 4.0), (first, "en", 4.0)]
    assert len(rows) == 4 and other != first
