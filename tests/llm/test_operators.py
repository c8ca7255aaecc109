"""The operators against brute force, exact round trips and held-out labels, and on odd tables."""

import functools
import hashlib
import heapq
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from lexgrid.llm import html_extract, jaccard_join, license_scan, lm_scoring, mixing, nearest, queries, quality_classifier, quality_rules, sentencepiece_codec, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(60_000))
    texts = [None, "", " \t\n", "one", "a b c d", "Some plain words here.\n" * 30, long, "Ünïcode ▁ texts — 中文 🙂 " * 9, "x\x0by\x0cz\r\nq", "cc by all rights reserved general public license"]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[5], (None, "no id at all", None, None, None)], DOCS)


def clashing(df):
    """Extra columns with names that an operator might use within."""
    for name in ("h", "c", "n", "rules", "score", "ids", "w", "__h", "labels", "pos"):
        df = df.withColumn(name, F.lit(1))
    return df


def brute_rules(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_rules_against_brute_force(spark):
    df = odd_docs(spark)
    want = sorted(((r["doc_id"], *brute_rules(r["text"])) for r in df.collect()), key=repr)
    got = quality_rules.judge(clashing(df)).select("doc_id", "rules.*")
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got.collect()), key=repr) == want


def test_repeats_in_a_text_beyond_packing(spark):
    text = " ".join(map(str, range(40_000))) + " 5 6 7 8"
    row = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("rules.*").first()
    assert row["n_repeat_words"] == 8


def test_repeats_whose_hashes_collide(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(rng.choice(["a", "b", "cc", "dd", "eee"]) for _ in range(rng.randint(0, 40)))) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *cols: F.length(cols[0]).cast("long"))
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.judge(df).select("doc_id", "rules.n_repeat_words").collect()}
    assert got == {r["doc_id"]: brute_rules(r["text"])[4] for r in df.collect()}


def test_rules_leave_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)) + ".", 7), (2, None, 8)], "doc_id long, text string, rules int")
    assert [tuple(r) for r in quality_rules.clean(df).collect()] == [tuple(df.first())]
    assert quality_rules.clean(df.limit(0)).columns == df.columns and quality_rules.judge(df.limit(0)).count() == 0


def test_line_rules(spark):
    good = "A plain line of words that ends as it should."
    lines = {good: False, "Home | About | News | Contact | Search": True, "BUY NOW WHILE STOCKS LAST": True, "wow!! such!! deal!!": True, "short item": True, "Home About Products Services Contact Careers Blog Login": True, "Startseite Über uns Produkte Kontakt Datenschutz": True, "eins / zwei / drei / vier / und so weiter": True, "Ein langer Satz mit Wörtern, der hier ohne Punkt zu Ende geht": False, "Alle Rechte vorbehalten. Wir verwenden Cookies auf dieser Seite.": True, "Nous utilisons des cookies pour améliorer ce site.": True, "Todos los derechos reservados por la casa editorial.": True, "We use cookies to serve you better on this site.": True, "word### other*** more$$$": True}
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("fails", quality_rules.line_fails(F.col("line")))
    assert {r["line"]: r["fails"] for r in df.collect()} == lines


def test_clean_drops_failing_lines(spark):
    good = [" ".join(f"w{k}x{i}" for i in range(12)) + " ends." for k in range(6)]
    text = "\n".join([good[0], "Home | About | News", *good[1:], good[2], "We use cookies to serve you better on this site."])
    got = quality_rules.clean(spark.createDataFrame([(1, text, "x"), (2, "too short", "x")], "doc_id long, text string, lang string")).collect()
    assert [tuple(r) for r in got] == [(1, "\n".join(good), "x")]


def test_rules_keep_good_documents(spark, sf):
    got = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "rules.kept", "rules.base_failed").collect()
    assert not any(r["kept"] for r in got if r["quality"] == 0)
    assert all(r["kept"] or r["base_failed"] for r in got if r["quality"] == 1)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf, name):
    same_rows(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


# Mixing


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [500, *[26] * 19], [1, 999], [7, 0, 3]])
def test_cycle_deviates_by_less_than_a_block(weights):
    q, had = sum(weights), [0] * len(weights)
    order = mixing.cycle(weights)
    assert len(order) == q
    for t, (s, j) in enumerate(order, 1):
        assert had[s] == j
        had[s] += 1
        assert all(abs(h * q - w * t) < q for h, w in zip(had, weights))
    assert had == weights


@pytest.mark.parametrize("weights", [[3000**0.5, *[150**0.5] * 20], [0.0002, 1.0, 0.7, 0.3], [1.0, 1.0, 1e-9]])
def test_plan_stays_within_a_block_of_exact_shares(weights):
    blocks = [max(1, round(9000 * w / sum(weights))) for w in weights]
    blocks[1] *= 3
    whole = mixing.whole_weights(weights)
    had, t, left = [0] * len(blocks), 0, {s: Fraction(b) for s, b in enumerate(blocks)}
    for s, j in mixing.plan(blocks, weights):
        assert j == had[s]
        had[s] += 1
        t += 1
        need = Fraction(1)
        while need and left:  # the ideal: all that are left at once, in exact proportion
            w = sum(whole[x] for x in left)
            step = min(need, *(n * w / whole[x] for x, n in left.items()))
            left = {x: n - step * whole[x] / w for x, n in left.items()}
            left = {x: n for x, n in left.items() if n}
            need -= step
        assert all(abs(h - (b - left.get(x, 0))) < 1 for x, (h, b) in enumerate(zip(had, blocks)))
    assert had == blocks


def test_mixing_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 1000)
    rows = [(i, f"s{i % 3000}") for i in range(6500)] + [(i, "big") for i in range(6500, 7000)]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), block=2).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(7000))
    assert {r["mix_slot"] for r in got} == set(range(3500 + 250))
    assert len({(r["mix_slot"], r["source"]) for r in got}) == 3750


def test_mixing_keeps_all_and_follows_the_weights(spark):
    rows = [(i, "big" if i % 3 else None if i % 2 else "small") for i in range(3000)]
    df = clashing(spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, source string"))
    weights = {"big": 2.0, "small": 1.0, None: 1.0}
    got = mixing.schedule(df, weights=weights, block=4)
    assert set(df.columns) < set(got.columns)
    out = [tuple(r) for r in got.select("mix_slot", "mix_seq", "doc_id", "source").collect()]
    assert Counter(r[2] for r in out) == Counter([r[0] for r in rows] + [0, 0])
    places = [r[:2] for r in out]
    assert len(set(places)) == len(places)
    blocks = sorted({(slot, source or "") for slot, _, _, source in out})
    assert [b[0] for b in blocks] == list(range(len(blocks)))
    had = Counter()
    for t, (_, s) in enumerate(blocks[:400], 1):  # until a source runs out
        had[s] += 1
        assert all(abs(had[x] - t * w / 4) < 1.01 for x, w in (("big", 2), ("small", 1), ("", 1)))


def test_mixed_order_is_the_order_of_the_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 5}", "t") for i in range(500)], "doc_id long, source string, text string")
    mixing.mix(df).write.parquet(str(tmp_path / "m"))
    want = [r["doc_id"] for r in mixing.schedule(df).orderBy("mix_slot", "mix_seq").collect()]
    files = sorted((tmp_path / "m").glob("part-*"))
    assert [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).collect()] == want != sorted(want)
    assert mixing.mix(df).columns == df.columns
    assert mixing.schedule(df.limit(0)).count() == 0


def test_mixing_keeps_rows_that_differ_in_a_map(spark):
    rows = [(1, "a", {"k": "x"}), (1, "a", {"k": "y"}), (2, "a", None), (2, "a", None), (2, "a", None)]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string, m map<string,string>"), block=2).collect()
    assert sorted((r["doc_id"], str(r["m"])) for r in got) == sorted((i, str(m)) for i, _, m in rows)
    assert sorted((r["mix_slot"], r["mix_seq"]) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_mixing_of_one_row_many_times(spark):
    df = spark.createDataFrame([(7, "a")] * 1000 + [(i, "b") for i in range(500)], "doc_id long, source string")
    got = mixing.schedule(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([7] * 1001 + [i for i in range(500) if i != 7])
    assert len({(r["mix_slot"], r["mix_seq"]) for r in got}) == 1500
    assert all(len({r["source"] for r in got if r["mix_slot"] == s}) == 1 for s in range(95))


# Nearest neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 12)).astype(np.float32)
    x[100:700] = x[50]  # one common vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5020, [0.0] * 12, 0), (5040, [float("nan")] * 12, 0), (5060, [None] + [1.0] * 11, 0), (5080, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in nearest.search(df, F.col("vec_id") % 20 == 0, leaf=128).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20))
    y, hit = x.astype(float), 0
    for q, found in got.items():
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        hit += len({f[1] for f in found} & set(best.tolist()))
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[2] == s[f[1]] for f in found)
        assert [f[1:] for f in found] == sorted([f[1:] for f in found], key=lambda f: (-f[1], f[0]))
    assert hit / (20 * len(got)) >= 0.9


def test_nearest_of_grouped_vectors_opens_few_leaves(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 1, (40, 16)) * 5
    x = (centre[rng.integers(0, 40, 4000)] + rng.normal(0, 0.05, (4000, 16))).astype(np.float32)
    x[100:1500] = x[100]  # a third of all rows are one vector
    forest = nearest.grow(x.astype(float), float((x.astype(float) ** 2).sum(1).max()), 12, 64)
    assert nearest.share_for(forest, x[1500:].astype(float), 20, 0.9) < 0.6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest.search(df, F.col("vec_id") % 100 == 0, leaf=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == set(range(0, 4000, 100)) and all(len(v) == 20 == len(set(v)) and q not in v for q, v in got.items())
    y = x.astype(float)
    hit = 0
    for q, v in got.items():
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(4000), -s))[:20].tolist()) & set(v))
    assert hit >= 0.9 * 20 * len(got)


def spread_vectors(n, size=12, seed=3):
    return np.random.default_rng(seed).standard_normal((n, size)).astype(np.float32)


def test_nearest_opens_leaves_in_the_order_of_one_queue():
    x = spread_vectors(2000).astype(float)
    forest = nearest.grow(x, float((x * x).sum(1).max()), 5, 20)
    leaves = forest.leaves_of(forest.lift(x))
    sizes, base = np.bincount(leaves.ravel(), minlength=sum(forest.leaves)), np.cumsum([0, *forest.leaves])
    forest.sizes = np.split(sizes, base[1:-1])
    for enough in (1, 90, 700, 9_999, np.inf):
        for query, got in zip(x[:9], forest.probe(x[:9], enough)):
            queue, want, held = [(0.0, t, 0) for t in range(5)], [], 0
            while queue and held < enough:
                far, t, node = heapq.heappop(queue)
                while node >= 0:
                    gap = forest.directions[t][node, :-1] @ query - forest.cuts[t][node]
                    near = int(gap >= 0)
                    heapq.heappush(queue, (far + gap * gap, t, int(forest.children[t][node, 1 - near])))
                    node = int(forest.children[t][node, near])
                want.append(base[t] - node - 1)
                held += sizes[want[-1]]
            assert got.tolist() == want


def test_nearest_sends_a_query_once_to_a_tile(spark, monkeypatch):
    """Not once to each leaf, which would be a row for each query and some rows."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(spread_vectors(2000))], "vec_id long, embedding array<float>")
    met, sort = [], type(df).sortWithinPartitions
    monkeypatch.setattr(type(df), "sortWithinPartitions", lambda self, *columns: met.append(self) or sort(self, *columns))
    found = nearest.search(df, F.col("vec_id") % 20 == 0, leaf=32)
    assert met[0].where("kind = 1").count() == 100
    assert "array_distinct" not in found._jdf.queryExecution().executedPlan().toString()  # it compares all pairs of structs


def test_nearest_does_not_depend_on_tiles(spark, monkeypatch):
    x = spread_vectors(1500)
    x[700:1000] = x[700:1000] * 1e-3 + x[3]  # a leaf of many rows in a thin sample
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[i].tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(nearest, "SAMPLE", 300)
    told = lambda: sorted(map(tuple, nearest.search(df, F.col("vec_id") % 20 == 0, leaf=64).collect()))
    want = told()
    for most in (12 * 40, 12 * 200):
        monkeypatch.setattr(nearest, "CHUNK", most)
        assert told() == want
    assert len(want) == 78 * 20


def test_leaves_share_tiles():
    starts, chunks = nearest.tiles_of(np.array([3, 4, 9, 0, 25, 10, 1]), 10)
    assert starts.tolist() == [0, 0, 1, 1, 2, 5, 6] and chunks.tolist() == [1, 1, 1, 1, 3, 1, 1]


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert nearest.search(df.limit(0), F.col("vec_id") == 0).count() == 0


# Quality classifier


def test_classifier_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) / len(got) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_classifier_ignores_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.fit(docs, labels) == quality_classifier.fit(docs, turned)


def test_classifier_on_odd_tables(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    odd = clashing(odd_docs(spark))
    got = quality_classifier.score(odd, model).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in got)
    kept = quality_classifier.keep(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in got) and {r["score"] for r in kept.collect()} == {1}
    empty = quality_classifier.fit(docs.limit(0), labels.limit(0))
    assert quality_classifier.score(odd, empty).where("score = 0.5").count() == 13


def test_class_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(4)
    k = len(quality_classifier.FEATURES)
    for share in (0.2, 0.5, 0.85):
        positive = rng.normal(1, 1, (3000, k))
        far = rng.random(4000) > share
        unlabelled = np.where(far[:, None], rng.normal(-1, 1, (4000, k)), rng.normal(1, 1, (4000, k)))
        assert abs(quality_classifier.estimate_prior(positive, unlabelled) - (1 - far.mean())) < 0.08


def test_fit_takes_a_bounded_number_of_rows(spark, monkeypatch):
    rows = [(7, f"text number {i}") for i in range(500)] + [(i, "Some words that make a line.") for i in range(100, 160)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100, 130)] * 2 + [(None, 1), (100, None)], "doc_id long, quality int")
    seen = []
    plain = quality_classifier.fit_arrays
    monkeypatch.setattr(quality_classifier, "fit_arrays", lambda p, u, prior: seen.append((len(p), len(u))) or plain(p, u, prior))
    quality_classifier.fit(docs, labels, sample=20)
    assert max(p for p, _ in seen) <= 20 and max(u for _, u in seen) <= 20
    assert quality_classifier.fit(docs.where("doc_id < 130"), labels.where("doc_id > 99")).weight != (0.0,)
    everything = docs.select("doc_id").distinct().withColumn("quality", F.lit(1))
    assert set(quality_classifier.fit(docs, everything).weight) == {0.0}


# HTML


def test_extraction_of_an_article(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="cookie-notice">We use cookies.</div>
    <article><h1>Title &amp; more</h1><p><b>First   <i>line</i><br>goes on<p>Second&nbsp;one &lt;x&gt; a&#233;.</p><div class="ad">Buy this now.</div><ul><li>Item one<li>Item two</ul></article>
    <aside class="sidebar"><p>Other things to read here.</p></aside><section id="comments"><div class="comment"><p>Nice post, I agree with it.</p></div></section>
    <form><label>Mail</label></form><footer>&copy; site</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", page[: page.index("</article>")])], "page_id long, url string, html string").withColumn("n", F.lit(1))
    got = {r["page_id"]: r for r in html_extract.extract_text(df).collect()}
    want = "Title & more\nFirst line goes on\nSecond one <x> aé.\nItem one\nItem two"
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want) and got[4]["text"] == want
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0


trained = functools.cache(html_extract.train)


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<svg class="icon"/>', ""), ("<p>Sum <math/> ends.</p>", "Sum ends."), ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p>", "Let x=1 hold."), ("<button>", ""), ("<select>", ""), ("<video>", ""), ("<canvas>", ""), ('<iframe src="x">', ""),
        ("<svg><style/><script/><title/></svg>", ""), ("<svg><style>a{}</style></svg>", ""), ("<object><p>Fallback text here for all.</p></object>", "Fallback text here for all."), ("<noscript><p>Fallback text here for all.</p></noscript>", "Fallback text here for all."),
    ],
)
def test_extraction_around_embedded_elements(inner, want):
    page = f'<html><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><article><h1>Title</h1><p>First line of the text goes here.</p>{inner}<p>Last line of the text is here.</p></article><footer>Site <svg></svg></footer></body></html>'
    assert html_extract.extract([page], trained())[0].split("\n") == [x for x in ("Title", "First line of the text goes here.", want, "Last line of the text is here.") if x]


def test_extraction_on_unseen_layouts():
    model, rng = html_extract.train(), random.Random(77)
    right = wrong = missed = 0
    for _ in range(60):
        page, main = html_extract.layout(rng)
        nodes = html_extract.parse(page)
        got = html_extract.decode(nodes, model.odds(html_extract.describe([nodes])))
        assert all(got[x.parent.index] for x in nodes[1:] if got[x.index])
        truth = np.array([i == 0 or i in main for i in range(len(nodes))])
        right, wrong, missed = right + (got & truth).sum(), wrong + (got & ~truth).sum(), missed + (~got & truth).sum()
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98


def test_extraction_of_all_pages(spark, sf):
    import html

    for r in html_extract.extract_text(spark.read.parquet(f"{sf}/pages.parquet").withColumn("copy", F.col("html"))).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["copy"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)[^>]*>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


# URL filters


@pytest.mark.parametrize("text", ["<a " * 60_000, '<a x="' * 60_000, "<b>" * 20_000 + "x", "<b>" * 20_000 + "<hr>" * 20_000, "<div>" * 20_000 + "</b>" * 20_000, "<script>" + "</script " * 50_000, "<!" * 50_000, "<p><object><li>" + "<b>" * 20_000 + "<hr>" * 20_000])
def test_broken_pages_take_linear_time(text):
    import time

    model = html_model()
    began = time.perf_counter()
    html_extract.extract([text], model)
    assert time.perf_counter() - began < 20


@functools.cache
def html_model():
    return html_extract.train()


def test_inline_elements_stay_in_the_article():
    page = (
        "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>On mass</h1><p title=it's>The mass is <math>E=mc2</math> as known since long.</p>"
        "<p>Press <button>Save</button> to keep <code>x &lt; 1</code> and go on with the work of the day, for 3 < 4.</p></article><form><input><p>Send it</p></form><footer>Copyright</footer></body></html>"
    )
    want = "On mass\nThe mass is E=mc2 as known since long.\nPress Save to keep x < 1 and go on with the work of the day, for 3 < 4."
    assert html_extract.extract([page, "", page], html_model()) == [want, "", want]


def test_url_rules(spark):
    urls = {
        "http://WWW.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "https://m.example.com/en/x#t": ("m.example.com", "/en/x", "example.com/en/", "block"),
        "http://a.net/es/": ("a.net", "/es/", "net/es/", "block"), "http://a.com": ("a.com", "", None, None), "http://a.com/": ("a.com", "/", "com/", "allow"), "http://notcom/": ("notcom", "/", None, None), "nothing": ("", "", None, None), None: ("", "", None, None), "x://h?a://b/c": ("h", "", None, None),
    }
    df = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"))
    for r in url_filters.judge(df).select("url", "url_filter.*").collect():
        host, path, rule, verdict = urls[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    assert url_filters.judge(df.limit(0)).count() == 0


def test_wide_nodes_become_wildcards_at_any_depth(spark):
    urls = [f"http://a.org/u{chr(97 + i)}x/post/{chr(97 + j)}y{chr(97 + i)}/z/deep/er/still" for i in range(26) for j in range(3)] + ["http://a.org/", "http://a.org/one"]
    df = spark.createDataFrame([(u, "mine") for u in urls], "url string, url_filter string")
    out = url_filters.judge(df)
    assert out.columns == ["url", "url_filter"]
    got = {r["url"]: r["url_filter"]["template"] for r in out.collect()}
    assert {got[u] for u in urls[:78]} == {"/*/post/*/z/deep/er/still"} and got["http://a.org/"] == "/" and got["http://a.org/one"] == "/*"
    assert [c for c in url_filters.judge(df, name="found").columns] == ["url", "url_filter", "found"]


def test_similar_siblings_are_merged(spark):
    """Of four branches two are blocked at the same rate, away from their host's; a thin branch goes with them."""
    rules = (("block", "net", "/x/b"), ("allow", "net", "/x/a"), ("block", "net", "/y/b"), ("allow", "net", "/y/a"), ("allow", "net", "/z/a"), ("block", "net", "/t/b"))
    rows = [("x/b", 30), ("x/a", 10), ("y/b", 29), ("y/a", 11), ("z/a", 60), ("t/b", 1)]
    urls = [f"http://h.net/{p}c" for p, n in rows for _ in range(n)] + ["http://h.net/x/q", "http://h.net/z/q", "http://h.net/t/q"]
    got = {r["url"]: r["url_filter"] for r in url_filters.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules=rules).collect()}
    assert (got["http://h.net/x/q"]["verdict"], got["http://h.net/z/q"]["verdict"], got["http://h.net/t/q"]["verdict"]) == ("block", "allow", "block")


def test_templates_learn_from_labelled_urls(spark):
    urls = [f"http://a.net/fr/{i}" for i in range(50)] + [f"http://b.org/fr/{i}" for i in range(5)] + [f"http://c.com/news/{i}" for i in range(50)] + [f"http://d.org/news/{w}" for w in ("x", "y")]
    got = {r["url"]: r["url_filter"] for r in url_filters.judge(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got["http://b.org/fr/1"]["verdict"] == "block" and got["http://d.org/news/x"]["verdict"] == "allow"
    assert got["http://b.org/fr/1"]["template"] == "/fr/*"


# SentencePiece


def test_encoding_against_the_library(spark):
    import sentencepiece

    path = sentencepiece_codec.tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    df = odd_docs(spark)
    for r in sentencepiece_codec.encode(clashing(df), path, digest=True).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = [*lib.encode(r["text"] or ""), 2]
        assert r["n_tokens"] == len(ids) and r["covered_bytes"] == len((r["text"] or "").encode())
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_digest_is_taken_from_spans(monkeypatch):
    c = sentencepiece_codec.Codec(sentencepiece_codec.tokenizer_path("piece_bpe_32k.model"))
    text = "Some plain words, é too."
    ids = [*c.model.encode(text), 2]
    assert c.digest(text, [2])[:2] == (len(ids), len(text.encode()))
    monkeypatch.setattr(c, "normalise", lambda source: (source, np.zeros(3 * len(source) + 1, np.int64)))
    assert c.digest(text, [2])[:2] == (len(ids), 0)


def test_spans_and_round_trip(spark):
    path = sentencepiece_codec.tokenizer_path("piece_bpe_32k.model")
    df = odd_docs(spark).where("doc_id IS NOT NULL AND doc_id <> 7")
    encoded = sentencepiece_codec.encode(df, path)
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in encoded.collect():
        at = 0
        for s in r["spans"]:
            assert s["begin"] == at <= s["end"]
            at = s["end"]
        assert at == len(texts[r["doc_id"]].encode()) and len(r["ids"]) == len(r["spans"])
    assert all(r["text"] == texts[r["doc_id"]] for r in sentencepiece_codec.decode(encoded, path).collect())


def test_chunks_against_whole_texts():
    c = sentencepiece_codec.codec(sentencepiece_codec.tokenizer_path("piece_bpe_32k.model"))
    rng, letters = random.Random(1), [*" ▁ab\n\té中🙂.\x00 ", " ", "the", "ing", "  "]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        ids, spans = c.encode_text(text)
        assert ids == c.model.encode(text) and spans == [tuple(x) for x in c.encode_one(text)[1].tolist()]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_spans_through_a_character_map(tmp_path, rule):
    """The public model with another normaliser: ids and spans against the library's own offsets."""
    import sentencepiece

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    with open(sentencepiece_codec.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = [(n, v) for n, v in sentencepiece_codec.fields(f.read()) if n != 3]
    model += [(n, v) for n, v in sentencepiece_codec.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if n == 3]
    path = tmp_path / "own.model"
    path.write_bytes(b"".join(varint(n << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(n << 3) + varint(v) for n, v in model))
    c = sentencepiece_codec.Codec(str(path))
    assert c.normalise.map.units and not c.by_chunks
    rng, letters = random.Random(2), ["Ａ", "b", "ﬁ", "½", "é", "e\u0301", "①", "㍿", "ｶﾞ", "  ", " ", "\u200b", "\u00a0", "ℌ", "x", "ing ", "the", "中", "🙂", "\n"]
    for _ in range(1000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 10)))
        ids, spans = c.encode_text(text)
        found = c.model.encode(text, return_type="proto").pieces
        assert ids == [p.id for p in found] and spans == [(p.begin, p.end) for p in found]


def test_unknown_pieces_do_not_stop_a_text(monkeypatch):
    c = sentencepiece_codec.Codec(sentencepiece_codec.tokenizer_path("piece_bpe_32k.model"))
    monkeypatch.setattr(c, "unknown", c.model.piece_to_id("▁the"))
    text = "one of the words é"
    ids, spans = c.encode_text(text)
    assert ids == c.model.encode(text) and spans[-1][1] == len(text.encode())
    assert c.digest(text, [2])[0] == len(ids) + 1


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHED", 3000)
    c = sentencepiece_codec.Codec(sentencepiece_codec.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.choice((2, 3, 300)))) for _ in range(12))
        assert c.encode_text(text)[0] == c.model.encode(text)
        assert len(c.cache) < 40 and all(len(p) <= sentencepiece_codec.LONG for p in c.cache)


def test_a_full_cache_takes_little_memory():
    c = sentencepiece_codec.Codec(sentencepiece_codec.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(60):
        c.encode_arrays(" ".join("".join(rng.choices("abcdefgh", k=10)) for _ in range(4000)) + " kept")
    kept = [x for x in vars(c).values() if isinstance(x, dict)]
    size = sum(map(sys.getsizeof, kept)) + sum(sys.getsizeof(k) + sys.getsizeof(v) + (sum(map(sys.getsizeof, v)) if isinstance(v, tuple) else 0) for x in kept for k, v in x.items())
    assert size < 40e6
    assert " kept" in c.cache or " kept" in c.older


def test_parts_hold_few_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "PART", 100)
    texts = ["a" * 60, "b" * 60, None, "", "é" * 300, "c", *["d"] * 600]
    parts = list(sentencepiece_codec.portions(pa.array(texts)))
    assert [i for start, n in parts for i in range(start, start + n)] == list(range(len(texts)))
    assert all(n == 1 or sum(len((t or "").encode()) for t in texts[start : start + n]) <= 100 for start, n in parts)
    monkeypatch.setattr(sentencepiece_codec, "PART", 2**20)
    assert [n for _, n in sentencepiece_codec.portions(pa.array(["d"] * 600))] == [256, 256, 88]
    assert list(sentencepiece_codec.portions(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_compiled_character_map_against_the_library(rule):
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = sentencepiece_codec.Normaliser(lib.serialized_model_proto())
    for text in ["Ａｂｃ  ﬁ ½ é é", "①②③ ㍿ ｶﾞ", "  x  y  ", "\u200bab\u00a0c", "ℌello", "", "ẞ ÀÉ"]:
        out, at = own(text.encode())
        assert out.decode().replace("▁", " ") == lib.normalize(text).replace("▁", " ").strip() if own.squeeze else True
        assert len(at) == len(out) + 1 and (np.diff(at) >= 0).all() and (len(at) == 1 or at[-1] <= len(text.encode()))


# Jaccard join


def brute_components(rows, percent=80):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            k = len(x & y)
            if k and 100 * k >= percent * (len(x) + len(y) - k):
                root[find(a)] = find(b)
    low = defaultdict(lambda: 10**18)
    for a, (i, _) in enumerate(sets):
        low[find(a)] = min(low[find(a)], i)
    return sorted((i, len(s), low[find(a)] if s else i) for a, (i, s) in enumerate(sets))


def near_copies(seed, long=False):
    """Groups of copies with growing edits, chains that link only step by step, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(20, 120))]
        if g % 3 == 0:
            base[5:5] = passage
        for k in range(rng.choice((1, 2, 9 if not long else 90))):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t).title() if rng.random() < 0.3 else " ".join(t))
        chain = list(base)
        for _ in range(8):
            chain[rng.randrange(len(chain))] = word()
            rows.append(" ".join(chain))
    for k in range(80 if long else 10):
        rows.append(" ".join(passage + [word() for _ in range(rng.randint(0, 9))]))
    rows += ["", None, "a b", "A b", "a b c d", " a\tb ", rows[0], rows[0]]
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "long"), [(1, False), (2, True)])
def test_components_against_brute_force(spark, seed, long):
    rows = near_copies(seed, long)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(clashing(df)).collect())
    assert got == brute_components(rows)


def test_components_with_short_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    rows = near_copies(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_join_on_odd_tables(spark):
    df = odd_docs(spark)
    got = jaccard_join.components(df).collect()
    assert len(got) == df.count()
    assert jaccard_join.components(df.limit(0)).count() == 0
    kept = jaccard_join.keep_one(df.where("doc_id IS NOT NULL"))
    assert kept.columns == df.columns and kept.count() == 10


# LM scoring


def lm_losses(texts, near):
    """(target loss, background loss) of each text by models of all the other texts, counted one by one."""
    entries = len({w for t in texts for w in t}) + 2
    n_near, n_far = (sum(len(t) for t, x in zip(texts, near) if x == side) for side in (True, False))

    def model(rest, scale):
        n = Counter(p for t in rest for p in zip([None, *t], t))
        single, before, total = Counter(), Counter(), sum(n.values())
        for (a, b), c in n.items():
            single[b] += c
            before[a] += c
        return lambda a, b: -np.log((scale * n[a, b] + lm_scoring.WEIGHT * (scale * single[b] + 1) / (scale * total + entries)) / (scale * before[a] + lm_scoring.WEIGHT))

    out = []
    for i, t in enumerate(texts):
        models = [model([u for j, u in enumerate(texts) if j != i and near[j] == side], s) for side, s in ((True, 1.0), (False, n_near / n_far if n_far else 1.0))]
        out.append([np.mean([m(a, b) for a, b in zip([None, *t], t)]) if t else None for m in models])
    return out


@pytest.mark.parametrize("target", ["doc_id IN (0, 5)", "doc_id < 0", "true"])
def test_lm_counts_against_brute_force(spark, target):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "b a B", "", None, "z z z q", "a b a b c"])]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in lm_scoring.score(df, F.expr(target)).collect()}
    near = [bool(r[0]) for r in df.orderBy("doc_id").select(F.expr(target)).collect()]
    texts = [(t or "").lower().split() for _, t in rows]
    for k, (t, want) in enumerate(zip(texts, lm_losses(texts, near))):
        assert got[k]["n_words"] == len(t)
        if t:
            assert (got[k]["target_loss"], got[k]["background_loss"]) == pytest.approx(tuple(want), rel=1e-9)
        else:
            assert got[k]["lm_score"] is None
    assert lm_scoring.score(df.limit(0), F.lit(None)).count() == 0


def test_lm_counts_all_words(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 2000)
    monkeypatch.setattr(lm_scoring, "BUCKET_WORDS", 700)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(0.3)), 10**6 + rng.randrange(10**6))}" for _ in range(rng.randint(0, 90)))) for i in range(90)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").repartition(3)
    of = [t.split() for _, t in [*rows, rows[3]]]
    want = lm_losses(of, [i % 3 == 0 for i, _ in [*rows, rows[3]]])
    got = lm_scoring.score(df, F.col("doc_id") % 3 == 0).collect()
    assert sorted(r["doc_id"] for r in got) == sorted([*range(90), 3])
    for r in got:
        if of[r["doc_id"]]:
            a, b = want[r["doc_id"]]
            assert (r["target_loss"], r["background_loss"], r["lm_score"]) == pytest.approx((a, b, a - b), rel=1e-9, abs=1e-9)
        else:
            assert r["lm_score"] is None


def test_lm_rows_stay_far_below_blocks_times_buckets():
    def rows(n_words):
        n_blocks = n_words // lm_scoring.BLOCK_WORDS
        fan, ranges, groups = lm_scoring.routes(n_words, n_blocks)
        assert fan * ranges * lm_scoring.BUCKET_WORDS >= n_words and groups * fan >= n_blocks
        return n_blocks * ranges + groups * ranges * fan

    for n in (5 * 10**9, 17 * 10**10):
        assert rows(10 * n) < 33 * rows(n)
    assert rows(17 * 10**10) < 3.2 * 10**8


def test_lm_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 1000)
    monkeypatch.setattr(lm_scoring, "BUCKET_WORDS", 500)
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(n)) for n in (120_000, 40, 3000, 1)]
    got = lm_scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), F.col("doc_id") < 2).collect()
    want = lm_losses([t.split() for t in texts], [True, True, False, False])
    assert len(got) == len(texts)
    for r in got:
        assert (r["target_loss"], r["background_loss"]) == pytest.approx(tuple(want[r["doc_id"]]), rel=1e-9)


# License scans


def license_runs(templates, ws):
    """(last, template, length, places of the end in the template) of runs that the next word does not extend."""
    out = []
    for k, t in enumerate(templates):
        has = lambda run: [j for j in range(len(run) - 1, len(t)) if t[j + 1 - len(run) : j + 1] == run]
        best = [max(n for n in range(i + 2) if n == 0 or has(ws[i + 1 - n : i + 1])) for i in range(len(ws))]
        out += [(i, k, n, has(ws[i + 1 - n : i + 1])) for i, n in enumerate(best) if n >= license_scan.MIN_RUN and (i + 1 == len(ws) or best[i + 1] != n + 1)]
    return sorted(out)


def license_spans(templates, ws):
    out = []
    for k in range(len(templates)):
        chain = None
        for end, n, ends in [(e, n, p) for e, x, n, p in license_runs(templates, ws) if x == k]:
            later = [p for p in ends if chain and p > chain[2]]
            if chain and later and end - n + 1 - chain[1] <= license_scan.MAX_GAP:
                chain = [chain[0], end, later[0], chain[3] + min(n, later[0] - chain[2])]
                out[-1] = (k, chain[0], chain[1], chain[3])
            else:
                chain = [end - n + 1, end, ends[0], n]
                out.append((k, chain[0], chain[1], chain[3]))
    return sorted(out)


def test_matching_statistics_against_brute_force():
    rng = random.Random(5)
    templates = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randint(3, 12)))) for k in range(6)] + [("n", "a b c d"), ("o", "x a b c d y z")]
    machine = license_scan.Automaton(templates)
    plain = [t.encode().split() for _, t in templates]
    for _ in range(200):
        ws = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 30))]
        assert sorted((i, k, n, machine.ends[s][k]) for i, k, n, s in machine.runs(ws)) == license_runs(plain, ws)
        assert sorted(machine.spans(ws)) == license_spans(plain, ws)
    assert {k for k, *_ in machine.spans(b"x a b c d y z".split())} >= {6, 7}


def test_license_scan_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "the", "mit", "under", "licensed", "4", "0", "Word", "\u00e9t\u00e9"]
    templates = [t for t in license_scan.TEMPLATES if len(t[1]) < 120]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randint(0, 12)):
            t += [rng.choice(pool)] if rng.random() < 0.7 else license_scan.TEMPLATES[rng.randrange(len(license_scan.TEMPLATES))][1].split()[: rng.randint(3, 40)] + [rng.choice(pool)]
        texts.append(rng.choice((" ", "\n", ", ")).join(t))
    df = spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df, templates=templates).collect()}
    split = [license_scan.words(t) for _, t in templates]
    for i, text in enumerate([*texts, "", None]):
        ws = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        base = [(j, label) for phrase, label in license_scan.PHRASES for j in range(len(ws)) if " ".join(ws[j : j + len(phrase.split())]) == phrase]
        spans = [(a, b, min(1.0, n / len(split[k])), n, templates[k][0]) for k, a, b, n in license_spans(split, [w.encode() for w in ws])]
        good = [x for x in spans if x[2] >= license_scan.MIN_COVER]
        good = [x for x in good if not any(y[0] <= x[0] and x[1] <= y[1] and y[2] > x[2] and y[3] >= x[3] for y in good)]
        labels = {x for _, x in base}
        starts = [j for j, _ in base]
        want = (len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[4] for x in good})), max([1.0 if base else 0.0, *(x[2] for x in spans)]))
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == want
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_lines(spark):
    texts = {
        "x y.\nLicensed under CC BY-NC 4.0.\nz": "cc-by,cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved. all RIGHTS reserved": "reserved", "the license of the work and version": "", "": "",
    }
    df = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for i, (t, labels) in enumerate(texts.items()):
        assert got[i]["labels"] == labels and 0 <= got[i]["score"] <= 1
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (2, 0, 3)
    assert got[5]["n_base"] == 0 and got[5]["first_word"] is None
    assert license_scan.scan(odd_docs(spark)).count() == 13


# The pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), docs.schema)
    base = quality_rules.judge(docs).select("doc_id", "text", "rules.kept").collect()
    good = [(r["doc_id"], r["text"]) for r in base if r["kept"]]
    firsts = {c for _, _, c in brute_components(good)}
    assert {r["doc_id"] for r in kept.collect()} == firsts
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == firsts and all(r["ids"][-1] == 2 for r in out)


def test_stages_on_odd_tables(spark, sf, tmp_path):
    """Null and empty texts, null ids, repeated rows, columns whose names operators use, and an empty table."""
    import corpus_pipeline

    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    judged = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet").join(good, "doc_id", "left_semi"))
    long = judged.where("rules.kept").orderBy("doc_id").first()["text"]
    odd = odd_docs(spark)
    more = spark.createDataFrame([(90, long, "en", "s", 1), (91, long, "en", None, 1), (91, long, "en", None, 1)], odd.schema)
    df = clashing(odd.unionByName(more)).withColumn("held_out", F.lit("x")).withColumn("mix_slot", F.lit("y"))
    for k, rows in enumerate((df, df.limit(0))):
        kept = rows
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, kept, sf)
            if i < 4:
                assert out.columns == df.columns
                out.write.parquet(str(tmp_path / f"{k}{i}"))
                kept = spark.read.schema(df.schema).parquet(str(tmp_path / f"{k}{i}"))
                assert kept.where("score <> 1 OR held_out <> 'x' OR mix_slot <> 'y'").isEmpty()
        got = out.collect()
        assert (len(got) > 0) == (k == 0) and kept.where("doc_id IN (90, 91)").count() == (k == 0)


def test_mixed_order_reaches_the_result(spark, tmp_path):
    import corpus_pipeline

    df = spark.createDataFrame([(i, "word " * (i % 50), f"s{i % 7 % 3}") for i in range(900)], "doc_id long, text string, source string")
    corpus_pipeline.mix(spark, df, "").repartition(5).write.parquet(str(tmp_path / "m"))
    want = [r["doc_id"] for r in mixing.schedule(df).orderBy("mix_slot", "mix_seq").collect()]
    out = corpus_pipeline.encode(spark, spark.read.parquet(str(tmp_path / "m")), "").collect()
    assert [r["doc_id"] for r in out] == want != sorted(want)
    places = [(r["mix_slot"], r["mix_seq"]) for r in out]
    assert places == sorted(set(places))


@pytest.mark.parametrize(("seed", "limit"), [(5, 3), (6, 8)])
def test_components_with_many_long_lists(spark, monkeypatch, seed, limit):
    """Texts mostly of shared passages: prefixes move, some beyond what was counted."""
    monkeypatch.setattr(jaccard_join, "SHORT", limit)
    monkeypatch.setattr(jaccard_join, "COMMON", limit)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 40)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passages = [[word() for _ in range(rng.randint(8, 40))] for _ in range(6)]
    texts = []
    for _ in range(60):
        t = [w for p in rng.sample(passages, rng.randint(1, 4)) for w in p] + [word() for _ in range(rng.randint(0, 25))]
        texts.append(" ".join(t))
        if rng.random() < 0.5:
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


#: Pages written by hand, apart from the generator of training pages; what is to be kept stands between « and ».
PAGES = (
    '<body><header>The Daily Something, since 1871</header><article><h1>«Rain.»</h1><p>«It rained.»</p></article><footer>&copy; 2024 The Daily Something. All our texts may be read but not be sold by others, as they are ours alone and will stay so.</footer></body>',
    '<body><nav><a href="/">Home</a> <a href="/b">Books</a></nav><main><h1>«Short»</h1><p>«No.»</p></main><footer><p>Write to us at the old mill, second floor, where the cat sleeps all day long and nobody answers.</p></footer></body>',
    '<body><div class="topbar">Call us today</div><div id="content"><h2>«On bees»</h2><p>«Bees are insects, and they fly from one flower to the next, all summer.»</p><p>«They sleep in winter.»</p></div><div class="sidebar"><h3>More</h3><ul><li><a href="/1">Wasps</a><li><a href="/2">Ants and what they carry</a></ul></div><div id="footer">Imprint of the bee society and its many friends</div></body>',
    '<body><div class="cookie-banner">We use cookies. <a href="#">Fine</a></div><article class="post"><h1>«A walk»</h1><p>«We went <em>out</em>.»</p></article><section class="comments"><h3>2 comments</h3><div class="comment"><p>What a lovely walk that must have been, I wish that I had come along with you.</p></div><div class="comment"><p>Me too.</p></div></section></body>',
    '<body><article><h1>«One word»</h1></article><footer>Some words about who made this page, and when, and why it was made at all.</footer></body>',
    '<body><aside><p>Our newsletter brings you a new text each week, free of charge and without adverts.</p></aside><article><p>«Yes.»</p></article><div class="ad">Buy two and pay for three of them, today only in our shop.</div></body>',
)


@pytest.mark.parametrize("page", PAGES)
def test_extraction_of_pages_written_by_hand(page):
    want = [" ".join(re.sub(r"<[^>]+>", "", x).split()) for x in re.findall("«(.*?)»", page)]
    assert html_extract.extract([page.replace("«", "").replace("»", "")], trained()) == ["\n".join(want)]


def test_extraction_on_odd_tables(spark):
    page = "<body><nav><a>Home</a></nav><article><h1>Title here</h1><p>Some words of a text.</p></article></body>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None)], "page_id long, url string, html string").withColumns({"text": F.lit("old"), "n_chars": F.lit("old"), "tag": F.lit(1)})
    got = html_extract.extract_text(df, model=trained())
    assert got.columns == ["page_id", "url", "tag", "text", "n_chars"]
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()) == [(1, "Title here\nSome words of a text.", 32)] * 2 + [(2, "", 0)]
    assert html_extract.extract_text(df.limit(0), model=trained()).count() == 0


def plain_features(text):
    """The classifier's features, in plain Python."""
    t = text or ""
    size, w, lines = max(1, len(t)), WORD.findall(t), t.split("\n")
    count = lambda chars: sum(c in chars for c in t)
    n, m = max(1, len(w)), len(lines)
    return [
        count("#$%&<>^~_=+@\\[]{}") / size, count("*") / size, count("|") / size, count("!?") / size, sum("A" <= c <= "Z" for c in t) / size, sum("0" <= c <= "9" for c in t) / size, count(".") / size, count(",;:") / size,
        n / size, sum(c <= "\x08" or "\x0e" <= c <= "\x1f" or c == "�" for c in t) / size, math.log1p(len(w)), sum(map(len, w)) / n, len(set(w)) / n, 1 - len(set(lines)) / m, math.log1p(size / m),
    ]


def test_classifier_query_against_plain_python(spark, sf):
    """Scores of the whole query from plain features, the fitted numbers and the logistic function."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality_classifier.fit(docs, labels)
    odd = odd_docs(spark).select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_quality_classifier"](spark, sf).collect()}
    got |= {r["doc_id"]: r for r in quality_classifier.score(odd, m).collect() if r["doc_id"]}
    k = len(quality_classifier.FEATURES)
    rows = docs.unionAll(odd).where("doc_id IS NOT NULL").collect()
    assert len(rows) > 200
    for r in rows:
        x = plain_features(r["text"])
        z = m.bias + sum(w / s * (v - mean) for w, s, v, mean in zip(m.weight, m.scale, x + [math.sqrt(abs(v)) for v in x], m.mean))
        want = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
        assert len(x) == k and got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-9)
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.3)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_the_risk_is_that_of_the_definition():
    """One step from zero goes against the gradient of the non-negative risk, taken by differences."""
    rng = np.random.default_rng(2)
    k = len(quality_classifier.FEATURES)
    p, u, prior = rng.normal(1, 1, (40, k)), rng.normal(0, 1, (60, k)), 0.4
    ep, eu = quality_classifier.expand(p), quality_classifier.expand(u)
    both = np.vstack([ep, eu])
    sp, su = (ep - both.mean(0)) / both.std(0), (eu - both.mean(0)) / both.std(0)

    def risk(w, b):
        loss = lambda z, y: np.log1p(np.exp(-z if y else z))
        positive, negative = prior * loss(sp @ w + b, 1).mean(), loss(su @ w + b, 0).mean() - prior * loss(sp @ w + b, 0).mean()
        return positive + max(0.0, negative)

    model = quality_classifier.fit_arrays(p, u, prior)
    w, b = np.array(model.weight), model.bias
    assert risk(w, b) < risk(np.zeros(len(w)), 0.0)
    for i in range(0, len(w), 5):  # near a minimum of the risk with its slight decay
        step = np.eye(len(w))[i] * 0.5
        assert risk(w, b) < max(risk(w + step, b), risk(w - step, b))
