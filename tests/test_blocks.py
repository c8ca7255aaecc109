"""Blocked postings and the top k from them, against all postings."""

import random

import pytest
from pyspark.sql import functions as F

from lexgrid.operators import blocks, search
from lexgrid.operators.index import build_index


def corpus(spark, n=400, langs=("de", "en")):
    """Words of very uneven frequency, texts of very uneven length, string ids and empty texts."""
    rng = random.Random(3)
    words = [f"w{min(int(rng.paretovariate(0.7)), 90)}" for _ in range(4000)]
    rows = [(rng.choice(langs), f"d{i:04d}", [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 60, 300]))]) for i in range(n)]
    asked = [(q, [rng.choice(words) for _ in range(rng.randint(1, 9))]) for q in range(12)] + [(90, ["absent"]), (91, []), (92, ["w1", "w1", "w2", "w90"])]
    return spark.createDataFrame(rows, "lang string, doc_id string, tokens array<string>"), spark.createDataFrame(asked, "query_id long, tokens array<string>")


def rows_of(df):
    return sorted((r["query_id"], r["lang"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SIZE", 8), ("ZONES", 4), ("FREQUENT", 40), ("SEEDS", 1)):
        monkeypatch.setattr(blocks, name, value)


@pytest.mark.parametrize(("method", "k"), [("TFIDF", 5), ("DLITE", 1), ("BM25_PLUS_V2", 5), ("TF_LDP", 50)])
def test_top_k_is_that_of_all_postings(spark, small, method, k):
    docs, queries = corpus(spark)
    options = {"b": 0.8, "d": 0.4} if method == "TF_LDP" else {}
    want = search.search(build_index(docs, method, **options), queries, k, digits=6)
    got = blocks.search_blocks(blocks.build_blocks(docs, method, size=8, **options), queries, k, digits=6)
    assert rows_of(got) == rows_of(want)


def test_blocks_hold_all_postings(spark, small):
    docs, _ = corpus(spark)
    index = blocks.build_blocks(docs, "TFIDF", size=8)
    plain = build_index(docs, "TFIDF").postings
    unblocked = lambda df: sorted((r["lang"], r["term"], r["doc_id"], round(r["weight"], 9)) for r in df.collect())
    assert unblocked(blocks.postings(index)) == unblocked(plain)
    sizes = index.blocks.select("term", "n", "block", "shift", F.size("docs").alias("m"), F.array_max("docs").alias("last")).collect()
    assert all(r["m"] <= r["n"] and r["last"] < 1 << r["shift"] for r in sizes)
    often = [r for r in sizes if r["term"] == "w1"]
    assert len(often) > 8 and max(r["m"] for r in often) < max(r["n"] for r in often) / 3


def test_fewer_postings_are_read(spark, small):
    docs, _ = corpus(spark, 900, ("en",))
    queries = spark.createDataFrame([(1, ["w1", "w2", "w3", "w80", "w85"]), (2, ["w1", "w70"])], "query_id long, tokens array<string>")
    steps = blocks.TopK(blocks.build_blocks(docs, "BM25_V1", size=8), queries, 3, 6)
    steps.run().count()
    told = steps.reads().collect()
    assert len(told) == 2 and all(r["seeds"] + r["read"] + r["probed"] < r["postings"] for r in told)


def test_one_language_is_asked(spark, small):
    docs, queries = corpus(spark)
    asked = queries.withColumn("lang", F.lit("de"))
    want = search.search(build_index(docs, "BM25_PLUS"), asked, 4, digits=6)
    assert rows_of(blocks.search_blocks(blocks.build_blocks(docs, "BM25_PLUS", size=8), asked, 4, digits=6)) == rows_of(want)


def test_blocks_of_nothing(spark):
    docs, queries = corpus(spark)
    index = blocks.build_blocks(docs.limit(0), "DLITE")
    assert blocks.search_blocks(index, queries).count() == blocks.postings(index).count() == 0
    with pytest.raises(ValueError):
        blocks.search_blocks(index, queries, 0)


def test_saved_blocks_are_searched_as_built(spark, small, tmp_path):
    docs, queries = corpus(spark)
    path = str(tmp_path / "b")
    for method in ("BM25_V1", "TF_LDP"):
        index = blocks.build_blocks(docs, method, size=8)
        blocks.save_blocks(index, path)
    want = rows_of(blocks.search_blocks(index, queries, 5, digits=6))
    assert rows_of(blocks.search_blocks(blocks.load_blocks(spark, path, "TF_LDP"), queries, 5, digits=6)) == want
    only = blocks.load_blocks(spark, path, "TF_LDP", ["de"])
    assert rows_of(blocks.search_blocks(only, queries, 5, digits=6)) == [r for r in want if r[1] == "de"]
    with pytest.raises(ValueError):
        blocks.load_blocks(spark, path)
