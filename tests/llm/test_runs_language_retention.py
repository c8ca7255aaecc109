"""Periodic runs, language identification and cohort retention against brute force, and on odd tables."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from lexgrid.llm import language_id, periodic_runs, queries, retention

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, shortest):
    """(start, length, period) of every run, from all periods and places."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(shortest, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng):
    n = rng.choice([0, 1, 5, 12, 25, 60])
    w = [str(rng.randrange(rng.choice([1, 2, 3, 6]))).encode() for _ in range(n)]
    if n > 8 and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, n // 3)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.5:
            w += w[: rng.randrange(n)]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = b"x"
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(200):
        shortest, texts = rng.choice([2, 3, 4, 5, 7, 12]), [repetitive(rng) for _ in range(rng.randint(1, 4))]
        assert periodic_runs.runs_of(texts, shortest) == [brute_runs(w, shortest) for w in texts]


def test_runs_where_jumps_do_not_end(monkeypatch):
    monkeypatch.setattr(periodic_runs, "JUMPS", 1)
    rng = random.Random(9)
    for _ in range(200):
        texts = [repetitive(rng) for _ in range(3)]
        assert periodic_runs.runs_of(texts, 3) == [brute_runs(w, 3) for w in texts]


def test_blocks_come_from_longest_previous_factors():
    rng = random.Random(2)
    for _ in range(100):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        s = periodic_runs.Suffixes(np.array([*w, 99]))
        assert s.sa.tolist() == sorted(range(len(w) + 1), key=lambda i: [*w, 99][i:])
        length, source = periodic_runs.previous_factors(s)
        text = "".join(map(str, w)) + "x"
        for i in range(len(w)):
            want = max((k for k in range(len(text) - i) if k == 0 or text.find(text[i : i + k]) < i), default=0)
            assert length[i] == want and (not want or source[i] < i and text[source[i] :].startswith(text[i : i + want]))


def test_long_runs_in_little_time():
    assert periodic_runs.runs_of([[b"a"] * 200_000, [b"a", b"b", b"c"] * 70_000]) == [[(0, 200_000, 1)], [(0, 210_000, 3)]]


def odd_docs(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "a b " * 30, "x\x0by\x0cz\r\nq " * 9, "\xa0 \x85 " * 20, " ".join(rng.choice("abc") for _ in range(30_000)), "é\x1cn " * 12]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "no id at all", None)], "doc_id long, text string, runs string").withColumn("length", F.lit(1)).withColumn("start", F.lit("k"))


def test_runs_on_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH", 50)
    df = odd_docs(spark)
    got = periodic_runs.scan(df)
    assert got.columns == ["doc_id", "length", "start", "n_words", "runs", "collapsed"]
    want = []
    for r in df.collect():
        w = WORD.findall(r["text"] or "")
        runs = brute_runs(w[:200], 12) if len(w) < 200 else None
        want.append((r["doc_id"], len(w), runs, None if runs is None else brute_collapse(w, runs)))
    rows = [(r["doc_id"], r["n_words"], None if r["n_words"] >= 200 else [tuple(x) for x in r["runs"]], None if r["n_words"] >= 200 else r["collapsed"]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert got.limit(0).count() == periodic_runs.scan(df.limit(0)).count() == 0


def test_runs_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        w, h = WORD.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w, 12)
        start, length, period = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        x = got[r["doc_id"]]
        assert (x["n_runs"], x["start"], x["length"], x["period"], x["exponent_milli"]) == (len(runs), start, length, period, length and 1000 * length // period)
        assert x["runs_sha256"] == sha("".join("%d,%d,%d\n" % t for t in runs)) and x["collapsed_sha256"] == sha(brute_collapse(w, runs))


# Language identification


def brute_grams(text):
    bare = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} "
    return {bare[i : i + n] for n in (1, 2, 3) for i in range(len(bare) - n + 1)}


def test_grams_and_kernel_against_sets(monkeypatch):
    texts = ["Ab, ab 12 c!", "x", "ünï — Ünï 中文字", "a" * 40 + " b" * 30, "the cat sat on the mat"]
    sets = [brute_grams(t) for t in texts]
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    for piece in (1 << 20, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        for t, s in zip(texts, sets):
            assert language_id.grams(t).tolist() == sorted(map(code, s))
    marks = language_id.Landmarks.of([language_id.grams(t) for t in texts[:3]])
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets[:3]] for a in sets]
    assert np.allclose(marks.kernel([language_id.grams(t) for t in texts]), want)


def test_regression_is_the_plain_one_where_all_rows_are_landmarks():
    """With every row a landmark the Nyström map is exact: the margins are those of kernel ridge regression on centred kernels."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 40))
    k, langs = x @ x.T, [("b", "a", "c")[i % 3] for i in range(30)]
    names, w, b = language_id.regress(k, k, langs, ridge=0.1)
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    centre = np.eye(30) - 1 / 30
    want = centre @ k @ centre @ np.linalg.solve(centre @ k @ centre + 0.1 * 10 * np.eye(30), y - y.mean(0)) + y.mean(0)
    assert names == ("a", "b", "c") and np.allclose(k @ w + b, want)


def test_language_query_on_held_out_documents(spark, sf):
    got = queries.QUERIES["op12_language_id"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == got.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_languages_do_not_learn_from_held_out_rows(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the thing with the", "en"), ("der die das und", "de")] * 30)]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else g) for i, t, g in rows]
    for table in (rows, wrong):
        assert language_id.fit(spark.createDataFrame(table, "doc_id long, text string, lang string")).languages == ("de", "en")


def test_languages_on_odd_tables(spark):
    docs = spark.createDataFrame(
        [*[(i, "le la les une des " * 3, "fr") for i in range(20)], *[(i, "the of and that " * 3, "en") for i in range(20, 40)], (40, None, "en"), (41, " 12 !?", "fr"), (42, "", None), (None, "the of", "xx"), (43, "and that " * 300_000, None), (43, "une", None)],
        "doc_id long, text string, lang string",
    ).withColumns({"score": F.lit("s"), "held_out": F.lit(1), "place": F.lit(2)})
    model = language_id.fit(docs, sample=8, landmarks=4)
    assert model.languages == ("en", "fr") and len(model.landmarks.size) == 4
    got = language_id.predict(docs, model)
    assert got.columns == ["doc_id", "lang", "place", "held_out", "lang_pred", "score"]
    for r in got.collect():
        known = r["doc_id"] is not None and r["doc_id"] < 40
        if known:
            assert r["lang_pred"] == r["lang"]
        if r["doc_id"] in (40, 41, 42):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        if r["doc_id"] is None:
            assert r["lang_pred"] == "en" and r["held_out"] is False
    nothing = language_id.fit(docs.where("lang = 'none'"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert language_id.predict(docs.limit(0), model).count() == 0


# Retention

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLIENTS = "client_id long, source string, updated_at timestamp_ntz"


def brute_retention(clicks, clients, cuts):
    rows = [r for r in set(clicks) if r[1] is not None and r[3] is not None]
    newest = {}
    for c, s, at in clients:
        key = (at is not None, at or T0)
        if c is not None and (c not in newest or key > newest[c][0] or key == newest[c][0] and (s or "") < newest[c][1]):
            newest[c] = key, s or ""
    starts = []
    for cut in cuts:
        known = [r for r in rows if cut is None or r[2] is not None and r[2] < cut]
        first = {}
        for r in known:
            if r[4] == "error":
                first[r[3]] = min(first.get(r[3], r[1]), r[1])
        starts.append((known, first))
    cohort = lambda t: math.floor((t - dt.datetime(1970, 1, 1)) / DAY) // 7
    cells = defaultdict(lambda: [set(), 0, set()])
    for i, (known, first) in enumerate(starts):
        for r in known:
            if r[3] in first and r[1] >= first[r[3]]:
                s = first[r[3]]
                x = cells[i, newest.get(r[3], (0, ""))[1], cohort(s), (r[1] - s) // (7 * DAY)]
                x[0].add(r[3])
                x[1] += 0 if r[5] is None or not math.isfinite(r[5]) else math.floor(100 * r[5] + 0.5)
                if len({cohort(f[r[3]]) for _, f in starts if r[3] in f}) > 1:
                    x[2].add(r[3])
    return sorted((*k, len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(m), cents) for k, (u, cents, m) in cells.items())


def some_clicks(rng, n, users=12):
    out = []
    for i in range(n):
        ts = T0 + rng.random() * 40 * DAY
        ts = ts.replace(microsecond=0) if rng.random() < 0.3 else ts
        arrived = rng.choice([ts, ts + rng.random() * 30 * DAY, ts - DAY, ts.replace(microsecond=0), T0 + 9 * DAY])
        user = 0 if rng.random() < 0.4 else rng.choice([None, *range(users)])
        out.append((i, rng.choice([ts, ts, ts, T0 - 9 * DAY, None]) if rng.random() < 0.1 else ts, None if rng.random() < 0.05 else arrived, user, rng.choice(["error", "view", None]), rng.choice([None, 1.005, -2.5, 3.25, float("nan"), float("inf")]), "{}"))
    return out + out[: n // 4]


@pytest.mark.parametrize(("seed", "pieces"), [(1, 1024), (2, 3), (3, 50)])
def test_retention_against_brute_force(spark, monkeypatch, seed, pieces):
    monkeypatch.setattr(retention, "PIECES", pieces)
    rng = random.Random(seed)
    clicks = some_clicks(rng, 400)
    clients = [(c, rng.choice(["web", "crm", None]), rng.choice([T0, T0 + DAY, None])) for c in [*range(9), None] for _ in range(rng.randint(1, 3))]
    cuts = [T0 + 12 * DAY, None, T0 + 25 * DAY, T0 - 99 * DAY]
    df = spark.createDataFrame(clicks, CLICKS).repartition(5).withColumns({"u": F.lit(1), "piece": F.lit("x")})
    got = retention.retention(df, spark.createDataFrame(clients, CLIENTS).withColumn("at", F.lit(2)), [c and str(c) for c in cuts])
    assert sorted(tuple(r) for r in got.collect()) == brute_retention(clicks, clients, cuts)


def test_timeline_of_a_start(spark):
    """Versions begin where a later arrival lowers the minimum, however the arrivals fall into days and hours."""
    rng = random.Random(5)
    clicks = [(i, T0 + rng.random() * 3 * DAY, T0 + rng.random() * 3 * DAY, i % 3, "error", None, None) for i in range(300)]
    found = retention.events(spark.createDataFrame(clicks, CLICKS), "client_id", "ts", "arrived_at", "kind", "error", "value")
    got = sorted(tuple(r) for r in retention.timeline(found).select("u", "known_from", "start", "known_to").collect())
    micro = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    want = []
    for u in range(3):
        low, versions = math.inf, []
        for _, ts, at, *_ in sorted((c for c in clicks if c[3] == u), key=lambda c: c[2]):
            if micro(ts) < low:
                low = micro(ts)
                versions.append((u, micro(at), low))
        want += [(*v, w[1] if w else retention.ALL) for v, w in zip(versions, [*versions[1:], None])]
    assert got == want


def test_retention_of_empty_tables(spark):
    none = spark.createDataFrame([], CLICKS)
    assert retention.retention(none, spark.createDataFrame([], CLIENTS), [None]).count() == 0


def test_retention_query_against_sql(spark, sf):
    same_rows(queries.QUERIES["op13_retention"](spark, sf), queries.ORACLE_SQL["op13_retention"], sf)
