"""What grows with the corpus is dealt out by document or range, and gives the same results."""

import random
import re
from collections import Counter

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from lexgrid import catalogue
from lexgrid.functions import stemming
from lexgrid.functions.analysis import analyze
from lexgrid.operators import blocks
from lexgrid.operators import index as ix
from lexgrid.operators import search as se
from lexgrid.operators import stats
from lexgrid.operators.workspace import materialise
from lexgrid.plans import evaluate


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt_by(plan):
    """The columns of each exchange by hash."""
    return [tuple(re.findall(r"(\w+)#", x)) for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]


@pytest.mark.parametrize("name", ["tf_saturating", "tf_plus", "idf_okapi"])
def test_languages_are_not_gathered(spark, sf, name):
    """Four languages are no key to deal term frequencies out by; the only exchange by it is that of the languages' own sums."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if nothing were told to be small by its file
    try:
        plan = plan_of(catalogue.queries()[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and dealt_by(plan).count(("lang",)) == 1


@pytest.mark.parametrize("name", ["search_dlite", "search_best_by_lang", "search_tf_ldp"])
def test_rows_of_queries_are_summed_where_they_arise(spark, sf, monkeypatch, name):
    monkeypatch.setattr(se, "ROWS", 1000, raising=False)
    plan = plan_of(catalogue.queries()[name](spark, sf))
    assert ("lang", "doc_id") in dealt_by(plan) and ("query_id", "lang", "doc_id") not in dealt_by(plan)


def test_tasks_grow_with_the_rows_of_queries(spark, monkeypatch):
    docs = analyze(spark.createDataFrame([("xx", i, "common " + "rare" * (i % 9 == 0)) for i in range(200)], "lang string, doc_id long, text string"))
    terms = se.query_terms(analyze(spark.createDataFrame([(i, "common rare common") for i in range(5)], "query_id long, text string")))
    index = ix.build_index(docs)
    monkeypatch.setattr(se, "ROWS", 100)  # of 5 * (200 + 23)
    assert se.near_queries(index.postings, index.vocabulary, terms).rdd.getNumPartitions() == 12


@pytest.mark.parametrize("few", [1, 1000])
def test_padding_beyond_the_limited_window(spark, sf, monkeypatch, few):
    monkeypatch.setattr(se, "FEW", few)
    docs = analyze(spark.createDataFrame([("xx", i, "rare " + "filler " * (90 * (i % 3))) for i in range(60)], "lang string, doc_id long, text string"))
    asked = analyze(spark.createDataFrame([(1, "rare"), (2, "zzzz"), (3, "rare filler")], "query_id long, text string"))
    rows = se.search(ix.build_index(docs, "TF_LDP", b=0.9, d=0.1), asked, 45, padded=True, digits=6).collect()
    got = {q: [(r["doc_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3)}
    assert all(len(x) == 45 for x in got.values()) and [x[0] for x in got[2]] == list(range(45))
    for found in got.values():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len({x[0] for x in found}) == 45
    same_rows(catalogue.queries()["search_ldp_negative"](spark, sf), catalogue.oracle_sql()["search_ldp_negative"], sf)


@pytest.mark.parametrize(("method", "digits"), [("BM25_V1", 2), ("TF_LDP", 6), ("BM25_PLUS", None)])
def test_grid_counts_as_searches_rank(spark, method, digits):
    """Ranks by counting, with ties, negative weights and documents that hold no word of a query, against a search for each point."""
    rng = random.Random(5)
    words = [f"w{min(int(rng.paretovariate(0.8)), 60)}" for _ in range(3000)]
    docs = spark.createDataFrame([(rng.choice("xy"), i % 90, [rng.choice(words) for _ in range(rng.choice([0, 2, 9, 60]))]) for i in range(90)] + [("x", 90 + i, ["w1", "w2", "w3"]) for i in range(9)], "lang string, doc_id long, tokens array<string>")
    queries = spark.createDataFrame([(q, [rng.choice(words) for _ in range(4)]) for q in range(12)] + [(20, ["w1", "w2", "w3"]), (21, ["none"])], "query_id long, tokens array<string>")
    truth = spark.createDataFrame([(q, g, rng.randrange(99)) for q in (*range(12), 20, 21) for g in "xy"] + [(20, "x", 95), (20, "x", 98)], "query_id long, lang string, doc_id long")
    points = [(1.0, 0.2, 0.3), (1.0, 0.9, 0.3), (2.0, 0.9, 0.3), (2.0, 0.2, 1.0)]
    got = {(r["k1"], r["b"], r["d"], r["lang"]): r["recall"] for r in evaluate.grid_search(docs, queries, truth, method, points, 4, digits).collect()}
    assert len(got) == 8 and len(set(got.values())) > 1
    for k1, b, d in points:
        found = se.search(ix.build_index(docs, method, k1=k1, b=b, d=d), queries, 4, digits=digits)
        for r in evaluate.recall(found, truth).collect():
            assert got[k1, b, d, r["lang"]] == pytest.approx(r["recall"])


def test_grid_has_no_row_a_point_and_document(spark, monkeypatch):
    """Of documents that cannot come before the one sought, none is scored at all points."""
    docs = analyze(spark.createDataFrame([("xx", i, "the " + ("red house by the sea" if i == 3 else "filler text")) for i in range(80)], "lang string, doc_id long, text string"))
    queries = analyze(spark.createDataFrame([(1, "the red house by the sea")], "query_id long, text string"))
    truth, written = spark.createDataFrame([(1, "xx", 3)], "query_id long, lang string, doc_id long"), []
    monkeypatch.setattr(evaluate, "materialise", lambda df: written.append(materialise(df)) or written[-1], raising=False)
    got = evaluate.grid_search(docs, queries, truth, "BM25_V1", [(1.0, 0.5, 1.0), (2.0, 0.9, 1.0)]).collect()
    assert [r["recall"] for r in got] == [1.0, 1.0]
    assert [r["doc_id"] for r in written[-1].collect()] == [3]


def test_saved_postings_are_shuffled_once(spark, sf, tmp_path):
    """After they are counted: neither a join by term nor another sort stands between term frequencies and the saved files."""
    index = ix.build_index(catalogue.docs(spark, sf), "DLITE")
    plan = plan_of(index.postings)
    assert plan.count("rangepartitioning") == 1 and "SortMergeJoin" not in plan and ("lang", "term") not in dealt_by(plan)
    ix.save_index(index, str(tmp_path / "i"))
    for f in (tmp_path / "i" / "postings").rglob("*.parquet"):
        rows = [(r["term"], r["doc_id"]) for r in spark.read.parquet(str(f)).collect()]
        assert rows == sorted(rows)


def test_blocks_are_summed_in_tasks_of_bounded_size(spark, sf, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 1000, raising=False)
    queries = catalogue.asked(spark, sf)
    steps = blocks.TopK(blocks.build_blocks(catalogue.docs(spark, sf), "TFIDF", terms=catalogue.terms_of(queries)), queries, 10, 6)
    steps.run()
    total = sum(r["postings"] for r in steps.reads().collect())
    assert steps.gains(steps.read).rdd.getNumPartitions() == -(-total // 1000)


def odd_documents(spark, again=False):
    rows = [("x", 1, ["b", "a", "b", "b"]), ("y", 1, ["a"]), ("x", 2, []), ("x", 3, None), ("x", 4, ["", "zz", ""]), ("x", 5, ["b", None, "b"]), (None, 6, ["a", "a"])]
    return spark.createDataFrame(rows + [("x", 1, ["b", "c", "b", "d"]), ("x", 7, ["a"])] * again, "lang string, doc_id long, tokens array<string>")


@pytest.mark.parametrize("again", [False, True])
@pytest.mark.parametrize("few", [False, True])
def test_words_are_counted_where_a_document_lies(spark, monkeypatch, again, few):
    """No term frequency is shuffled to be counted, unless a document comes in several rows; counts are the same."""
    written = []
    monkeypatch.setattr(ix, "materialise", lambda df: written.append(plan_of(df)) or materialise(df))
    docs = odd_documents(spark, again)
    terms = spark.createDataFrame([("b",), ("zz",), ("c",)], "term string") if few else None
    tf, df, of = ix.counted(docs, terms)
    if not again:
        assert not any({"doc_id", "doc"} & set(keys) for plan in written for keys in dealt_by(plan))
    told = lambda x: sorted((tuple(r[c] for c in sorted(x.columns)) for r in x.collect()), key=repr)
    want = stats.term_frequency(docs, terms)
    assert told(tf) == told(want) and told(df) == told(stats.document_frequency(want)) and told(of) == told(stats.corpus_stats(docs))


def test_blocks_come_from_one_shuffle_of_postings(spark, sf, monkeypatch):
    written = []
    monkeypatch.setattr(blocks, "materialise", lambda df: written.append((df.columns, plan_of(df))) or materialise(df))
    blocks.build_blocks(catalogue.docs(spark, sf), "DLITE")
    dealt = [keys for columns, plan in written for keys in dealt_by(plan) if "docs" in columns or "term" in columns]
    assert [k for k in dealt if {"term", "doc"} & set(k)] == [("term", "lang")] and ("lang", "doc_id", "term", "dl") not in dealt


@pytest.mark.parametrize("few", [False, True])
def test_blocks_of_documents_in_several_rows(spark, few):
    docs = odd_documents(spark, True)
    terms = spark.createDataFrame([("b",), ("a",)], "term string") if few else None
    told = lambda x: sorted((r["lang"], r["term"], r["doc_id"], round(r["weight"], 9)) for r in x.collect())
    got = told(blocks.postings(blocks.build_blocks(docs.where("doc_id <> 3"), "BM25_V1", terms=terms)))
    assert got == told(ix.build_index(docs.where("doc_id <> 3"), "BM25_V1", terms=terms).postings) and got


@pytest.mark.parametrize("name", ["search_bm25_v2", "recall_at_10"])
def test_documents_are_dealt_before_their_words_are_rows(spark, sf, monkeypatch, name):
    """What a task holds to send it is a row a document; a row a posting comes only where it is summed."""
    monkeypatch.setattr(se, "ROWS", 1000)
    plan = plan_of(catalogue.queries()[name](spark, sf))
    dealt = re.search(r"hashpartitioning\(lang#\d+, doc_id#\d+L?, \d+\), REPARTITION", plan).start()
    assert 0 <= plan.find("Generate explode(arrays_zip(terms") < dealt and "term#" not in plan[dealt:].split("Scan parquet")[0]


@pytest.mark.parametrize("again", [False, True])
@pytest.mark.parametrize("words", [1, 20_000])
def test_dealt_documents_have_the_same_counts(spark, monkeypatch, again, words):
    """Also with more words asked for than texts are restricted to, and of documents in several rows."""
    monkeypatch.setattr(ix, "WORDS", words)
    docs, terms = odd_documents(spark, again), spark.createDataFrame([("b",), ("zz",), ("c",)], "term string")
    told = lambda x: sorted((tuple(r[c] for c in sorted(x.columns)) for r in x.collect()), key=repr)
    packs = ix.pack(docs, terms)
    dealt = packs.frequencies(3)
    assert dealt.rdd.getNumPartitions() == 3 and told(dealt) == told(packs.frequencies()) == told(stats.term_frequency(docs, terms))
    assert told(packs.counted()[2]) == told(stats.corpus_stats(docs))


def test_other_postings_are_searched_as_they_are(spark):
    docs = analyze(spark.createDataFrame([("xx", i, "common " + "rare" * (i % 3 == 0)) for i in range(9)], "lang string, doc_id long, text string"))
    queries = analyze(spark.createDataFrame([(1, "common rare")], "query_id long, text string"))
    index = ix.build_index(docs, terms=se.query_terms(queries).select("term").distinct())
    index.postings = index.postings.where("doc_id > 5")
    assert {r["doc_id"] for r in se.search(index, queries).collect()} == {6, 7, 8}


def test_based_tokens_are_counted_where_a_document_lies(spark, sf):
    """Neither a look for a base nor the counts shuffle words."""
    assert dealt_by(plan_of(catalogue.queries()["tf_based_tokens"](spark, sf))) == []


@pytest.mark.parametrize("few", [0, 100])
def test_documents_in_several_rows_are_counted_as_one(spark, monkeypatch, few):
    """Also if its rows are of different length, and if there are too many such documents to be told to all tasks."""
    monkeypatch.setattr(stats, "FEW", few)
    for again in (False, True):
        docs, want = odd_documents(spark, again), Counter()
        for r in docs.collect():
            want.update((r["lang"], r["doc_id"], t) for t in r["tokens"] or () if t is not None)
        got = stats.frequencies(docs).collect()
        assert {(r["lang"], r["doc_id"], r["term"]): r["c"] for r in got} == want and len(got) == len(want)
    twice = spark.createDataFrame([(None, 6, ["a"]), (None, 6, ["a", "b"]), ("x", None, ["a"]), ("x", None, ["a"])], "lang string, doc_id long, tokens array<string>")
    assert sorted(map(str, stats.frequencies(twice).collect())) == sorted(map(str, stats.merged(stats.term_frequency(twice).drop("dl")).collect()))


@pytest.mark.parametrize("several", [False, True])
def test_few_bases_and_many_give_the_same_tokens(spark, monkeypatch, several):
    odd = ["it's", "a\\b", 'q"q', "l\nl", "中文", "", "x", "gone"]
    rows = [("x", 1, ["b", "a", None, "b", *odd]), ("y", 2, ["a", "b", "\U0001f642"]), (None, 3, ["a", "b"]), ("z", 4, ["a"]), ("x", 5, []), ("x", 6, None)]
    docs = spark.createDataFrame(rows, "lang string, doc_id long, tokens array<string>").withColumn("kept", F.lit(7))
    pairs = [("x", "b", "B"), ("x", "a", None), ("y", "a", "q"), ("y", "\U0001f642", "smile"), (None, "a", "n"), ("x", None, "m"), *(("x", w, f"<{w}>") for w in odd[:-1])] + [("x", "b", "C")] * several
    bases = spark.createDataFrame(pairs, "lang string, word string, base string")
    told = lambda: sorted((r["doc_id"], r["lang"] or "", r["tokens"], r["kept"]) for r in stemming.based_tokens(docs, bases).collect())
    few = told()
    monkeypatch.setattr(stemming, "FEW", 1)
    assert few == told() and few[1][2] == ["q", "b", "smile"] and few[5][2] == []
    assert few[0][2] == (["B", "C", "a", None, "B", "C"] if several else ["B", "a", None, "B"]) + [f"<{w}>" for w in odd[:-1]] + ["gone"]
