"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm import html_extract, jaccard_join, language_id, license_scan, lm_scoring, mixing, nearest, periodic_runs, quality_classifier, quality_rules, retention, sentencepiece_codec, url_filters
from lexgrid.llm.common import flag_by_key, let, table, words


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", "rules.*").drop("cleaned")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).drop("text")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages).select("page_id", "url_filter.*")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, "piece_bpe_32k.model", digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_id")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id").distinct()
    return lm_scoring.score(flag_by_key(docs, good, "doc_id", "good"), F.col("good")).drop("good")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).drop("license_spans")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one in ten texts, by the id's checksum h, the words from a place on are made to repeat those that stand there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    g = F.call_function("div", F.col("h"), F.lit(10))

    def repeated(w: Column) -> Column:
        a = F.pmod(g, F.size(w))
        p = F.call_function("div", F.size(w) - a, F.pmod(g, F.lit(8)) + 3) + 1
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, (s["a"] + F.pmod(i - s["a"], s["p"])).cast("int")))), " "))

    text = F.when(F.col("h") % 10 == 0, let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, repeated(w)))).otherwise(F.col("text"))
    found = periodic_runs.scan(docs.select("doc_id", text.alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rendered = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.call_function("div", F.col("best.n") * 1000, -F.col("best.p")).alias("exponent_milli"), F.sha2(rendered, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs.select("doc_id", "text", "lang")))


def op13_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some clicks arrive up to 99 days later than they say; state 0 knows those before February 2024, state 1 all."""
    clicks = table(spark, sf_dir, "clicks")
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    late = F.when(F.pmod(h, F.lit(3)) == 0, F.pmod(h, F.lit(100))).otherwise(0)
    arrives = F.col("arrived_at") + F.make_dt_interval(days=late.cast("int"))
    return retention.retention(clicks.withColumn("arrives", arrives), table(spark, sf_dir, "clients"), ["2024-02-01 00:00:00", None], arrives="arrives")


QUERIES = {"op1_mixing": op1_mixing, "op2_quality_rules": op2_quality_rules, "op3_nearest": op3_nearest, "op4_quality_classifier": op4_quality_classifier, "op5_html_extract": op5_html_extract, "op6_url_filters": op6_url_filters, "op7_sentencepiece": op7_sentencepiece, "op8_jaccard_join": op8_jaccard_join, "op9_lm_scoring": op9_lm_scoring, "op10_license_scan": op10_license_scan, "op11_periodic_runs": op11_periodic_runs, "op12_language_id": op12_language_id, "op13_retention": op13_retention}

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw
  FROM documents
), pos AS (
  SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM d
), tri AS (
  SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), win AS (
  SELECT doc_id, unnest(list(i)) AS i FROM tri WHERE c IS NOT NULL GROUP BY doc_id, a, b, c HAVING count(*) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win) GROUP BY 1
), l AS (
  SELECT d.*, list_transform(raw, lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS lines FROM d
), f AS (
  SELECT l.*, list_filter(list_distinct(lines), lambda x: NOT (
      20 * length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) > length(x)
      OR (length(x) >= 12 AND 2 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > length(x))
      OR 10 * length(regexp_replace(x, '[^!]+', '', 'g')) > length(x)
      OR (NOT regexp_matches(x, '[.!?:;)\]"''\x{2026}\x{201d}\x{00bb}]$') AND (length(x) < 30
        OR (len(regexp_extract_all(x, '[^ \x09-\x0D]+')) >= 3 AND (10 * len(regexp_extract_all(x, '(^|[ \x09-\x0D])\p{Lu}')) >= 7 * len(regexp_extract_all(x, '[^ \x09-\x0D]+'))
          OR len(regexp_extract_all(x, ' [|/>\x{00b7}\x{2022}\x{203a}] ')) >= 2))))
      OR regexp_matches(lower(x), '@BOILERPLATE@')
    )) AS ok
  FROM l
), r AS (
  SELECT f.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(raw) - len(list_distinct(raw)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(lines) - len(ok) AS n_lost_lines,
    coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS total_chars,
    coalesce(list_sum(list_transform(ok, lambda x: length(x))), 0) AS left_chars
  FROM f LEFT JOIN rep ON f.doc_id IS NOT DISTINCT FROM rep.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_chars >= total_chars * 0.5::DOUBLE) AS kept,
  n_lost_lines::BIGINT AS n_lost_lines, (total_chars - left_chars)::BIGINT AS lost_chars
FROM r
""".replace("@BOILERPLATE@", "|".join(quality_rules.BOILERPLATE).replace("'", "''"))



def op6_sql(levels: int = 8, wide: int = 20) -> str:
    """The SQL of op6, for paths of up to so many segments; the operator itself knows no such bound."""
    star = "".join(f"""), w{k} AS (
  SELECT host, tpl[1:{k - 1}] AS pre FROM t{k - 1} WHERE len(tpl) >= {k} GROUP BY 1, 2 HAVING count(DISTINCT tpl[{k}]) > {wide}
), t{k} AS (
  SELECT t.host, seg, CASE WHEN w{k}.host IS NOT NULL AND len(tpl) >= {k} THEN list_concat(tpl[1:{k - 1}], ['*'], tpl[{k + 1}:]) ELSE tpl END AS tpl, n, b
  FROM t{k - 1} t LEFT JOIN w{k} ON t.host = w{k}.host AND t.tpl[1:{k - 1}] = w{k}.pre
""" for k in range(1, levels + 1))  # fmt: skip
    joins = " ".join(f"LEFT JOIN g g{k} ON g{k}.host = l.host AND g{k}.k = {k} AND len(l.tpl) >= {k} AND g{k}.node = l.tpl[1:{k}]" for k in range(levels + 1))
    purity = "(tb + 4.0::DOUBLE * ((ab + 1.0::DOUBLE) / (an + 2.0::DOUBLE))) / (tn + 4.0::DOUBLE)"
    steps, last = "", "q"
    for k in range(levels + 1):
        steps += f"), p{k} AS (SELECT *, CASE WHEN gn{k} IS NULL THEN {last} ELSE (gb{k} + 4.0::DOUBLE * {last}) / (gn{k} + 4.0::DOUBLE) END AS q{k} FROM {'c' if not k else f'p{k - 1}'}\n"
        last = f"q{k}"
    return rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), fit AS (
  SELECT h.*, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    list_filter(string_split(path, '/'), lambda x: x <> '') AS parts
  FROM h
), d AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rv,
    list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > 24 THEN '*' ELSE x END) AS seg
  FROM fit
), t0 AS (
  SELECT host, seg, seg AS tpl, sum(CASE WHEN rv IS NOT NULL THEN 1 ELSE 0 END) AS n, sum(CASE WHEN rv = 'block' THEN 1 ELSE 0 END) AS b FROM d GROUP BY 1, 2
{star}), l AS (
  SELECT host, tpl, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b FROM t{levels} GROUP BY 1, 2
), x AS (
  SELECT host, tpl, n, b, unnest(range(0, len(tpl) + 1)) AS k FROM l
), v AS (
  SELECT host, k, tpl[1:k] AS node, sum(n) AS n, sum(b) AS b FROM x GROUP BY 1, 2, 3 HAVING sum(n) > 0
), v1 AS (
  SELECT *, CASE WHEN k = 0 THEN [host] ELSE node[1:k - 1] END AS up, CASE WHEN k = 0 THEN '' ELSE node[k] END AS child FROM v
), v2 AS (
  SELECT *, lag(n) OVER o AS n0, lag(b) OVER o AS b0 FROM v1 WINDOW o AS (PARTITION BY host, k, up ORDER BY b / n, child)
), v3 AS (
  SELECT *, sum(CASE WHEN (b * n0 - b0 * n) * (b * n0 - b0 * n) * (n + n0) > 3.8416::DOUBLE * n * n0 * (b + b0) * ((n + n0) - (b + b0)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY host, k, up ORDER BY b / n, child) AS grp FROM v2
), g AS (
  SELECT host, k, node, sum(n) OVER (PARTITION BY host, k, up, grp) AS gn, sum(b) OVER (PARTITION BY host, k, up, grp) AS gb FROM v3
), a AS (
  SELECT *, sum(n) OVER (PARTITION BY tpl) AS tn, sum(b) OVER (PARTITION BY tpl) AS tb, sum(n) OVER () AS an, sum(b) OVER () AS ab FROM l
), c AS (
  SELECT l.*, {purity} AS q, {", ".join(f"g{k}.gn AS gn{k}, g{k}.gb AS gb{k}" for k in range(levels + 1))} FROM a l {joins}
{steps})
SELECT d.page_id, coalesce(d.host, '') AS host, coalesce(d.path, '') AS path, d.rule, coalesce(d.rv, CASE WHEN f.{last} > 0.5::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || array_to_string(f.tpl, '/') AS template, f.n::BIGINT AS n_labelled, f.b::BIGINT AS n_blocked
FROM d JOIN t{levels} t ON d.host = t.host AND d.seg = t.seg JOIN p{levels} f ON f.host = t.host AND f.tpl = t.tpl
"""


_SHINGLE = " || ' ' || ".join(["w[i]", *(f"w[i + {k}]" for k in range(1, 5))])
OP8_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: {_SHINGLE})) END AS sh FROM d
), x AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s
), links AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), edge AS (
  SELECT i, j FROM links UNION ALL SELECT j, i FROM links UNION ALL SELECT doc_id, doc_id FROM s
), reach AS (
  SELECT i, j FROM edge UNION SELECT r.i, b.j FROM reach r JOIN edge b ON r.j = b.i
), comps AS (SELECT i, min(j) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, CASE WHEN len(sh) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY list_sort(sh)) END AS class_id, component_id
FROM s JOIN comps ON comps.i = s.doc_id
"""

def sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {step}), 4294967295)"


OP13_SQL = f"""
WITH c AS (
  SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL
), h AS (
  SELECT click_id, {sql_crc32('click_id::VARCHAR')} AS h FROM (SELECT DISTINCT click_id FROM c)
), e AS (
  SELECT c.client_id, c.ts, c.kind, coalesce(floor(100 * c.value + 0.5::DOUBLE)::BIGINT, 0) AS cents,
    CASE WHEN h.h % 3 = 0 THEN c.arrived_at + to_days((h.h % 100)::INTEGER) ELSE c.arrived_at END AS arrives
  FROM c LEFT JOIN h ON c.click_id = h.click_id
), k AS (
  SELECT 0 AS state, * FROM e WHERE arrives < TIMESTAMP '2024-02-01 00:00:00' UNION ALL SELECT 1 AS state, * FROM e
), s AS (
  SELECT state, client_id, min(ts) AS start, floor((epoch_us(date_trunc('day', min(ts))) // 86400000000) / 7.0::DOUBLE)::BIGINT AS cohort FROM k WHERE kind = 'error' GROUP BY 1, 2
), m AS (
  SELECT client_id, min(cohort) <> max(cohort) AS moved FROM s GROUP BY 1
), u AS (
  SELECT k.state, coalesce(clients.source, '') AS segment, s.cohort, (epoch_us(k.ts) - epoch_us(s.start)) // 604800000000 AS period, k.client_id, m.moved, sum(k.cents) AS cents
  FROM k JOIN s ON k.state = s.state AND k.client_id = s.client_id AND k.ts >= s.start JOIN m ON m.client_id = k.client_id LEFT JOIN clients ON clients.client_id = k.client_id
  GROUP BY ALL
), n AS (
  SELECT client_id, {sql_crc32('client_id::VARCHAR')} AS crc FROM (SELECT DISTINCT client_id FROM s)
)
SELECT state, segment, cohort, period, count(*) AS users, sum(crc)::BIGINT AS users_crc32, sum(moved::BIGINT)::BIGINT AS moved, sum(cents)::BIGINT AS cents
FROM u JOIN n ON u.client_id = n.client_id GROUP BY 1, 2, 3, 4
"""

ORACLE_SQL = {"op2_quality_rules": OP2_SQL, "op6_url_filters": op6_sql(), "op8_jaccard_join": OP8_SQL, "op13_retention": OP13_SQL}
