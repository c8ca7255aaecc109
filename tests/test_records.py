"""JSON arrays and quoted CSV read in many ranges, against Python's readers."""

import csv
import json
import random

import pytest

from lexgrid.sources import records

NASTY = ["plain", 'a "quoted" word', "}{", "back\\slash", '\\"', "line\nbreak", "\r\n", "{[,]}", "é 中 🙂", "", '}"{', "\\", '"', '""', "a,b", "tab\t"]


@pytest.fixture
def ranges(spark):
    """Files are cut into ranges of a few bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def texts(rng):
    return "".join(rng.choice(NASTY) for _ in range(rng.choice([0, 1, 3, 60])))


@pytest.mark.parametrize(("seed", "indent"), [(1, None), (2, 2)])
def test_json_array_in_ranges(spark, ranges, tmp_path, seed, indent):
    rng = random.Random(seed)
    rows = [{"docid": f"d{i}", "text": texts(rng), "lang": rng.choice(["en", None]), "more": {"x": [{"y": texts(rng)}, {}], "}": "{"}} for i in range(60)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text(json.dumps(rows[:50], indent=indent, ensure_ascii=seed == 1))
    (tmp_path / "c" / "b.json").write_text("[ " + " ,\n".join(json.dumps(r) for r in rows[50:]) + "\n]\n")
    schema = "docid string, text string, lang string, more struct<x: array<struct<y: string>>>"
    got = records.read_json_array(spark, str(tmp_path / "c"), schema)
    assert records.pieces(spark, str(tmp_path / "c"), "}").rdd.getNumPartitions() > 5
    want = sorted((r["docid"], r["text"], r["lang"], r["more"]["x"][0]["y"]) for r in rows)
    assert sorted((r["docid"], r["text"], r["lang"], r["more"]["x"][0]["y"]) for r in got.collect()) == want


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\r\n")])
def test_csv_in_ranges(spark, ranges, tmp_path, seed, end):
    rng = random.Random(seed)
    rows = [(f"q{i} {texts(rng)}".replace("\r", " ").replace("\\", "/"), rng.choice(["en", "de"]), f"p{i}") for i in range(80)]
    (tmp_path / "c").mkdir()
    for name, part in (("a.csv", rows[:50]), ("b.csv", rows[50:])):
        with (tmp_path / "c" / name).open("w", newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["lang", "query", "positive_docs"])
            for q, g, p in part:
                out.writerow([g, q, p])
                if rng.random() < 0.1:
                    f.write(end)
    got = records.read_csv_records(spark, str(tmp_path / "c"), "query string, positive_docs string, lang string")
    assert got.columns == ["query_id", "query", "positive_docs", "lang"]
    assert sorted((r["query_id"], r["query"], r["lang"], r["positive_docs"]) for r in got.collect()) == sorted((i, *r) for i, r in enumerate(rows))


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]\n")
    assert records.read_json_array(spark, str(tmp_path / "a.json"), "docid string").count() == 0
    (tmp_path / "a.csv").write_text("query,lang\n")
    assert records.read_csv_records(spark, str(tmp_path / "a.csv"), "query string, lang string").count() == 0
