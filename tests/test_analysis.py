import pytest

from lexgrid.functions import stemming
from lexgrid.functions.analysis import analyze
from lexgrid.sources.stopwords import ENGLISH, stopword_table, stopwords


def words_of(spark, text, **options):
    df = spark.createDataFrame([("en", 1, text)], "lang string, doc_id long, text string")
    return analyze(df, **options).first()["tokens"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a b1 c", ["b1"]), ("d_1 x 42", ["d_1", "42"]), ("l'eau", ["eau"]), ("ÉTÉ", ["été"]), ("كتَاب", ["كت", "اب"]), ("", []), (None, []), ("한국어 텍스트", ["한국어", "텍스트"])],
)
def test_tokens(spark, text, want):
    assert words_of(spark, text) == want


def test_stopwords_match_before_stemming(spark):
    assert words_of(spark, "running runs", stopwords=["running"], stemmer="snowball") == ["run"]


def test_stopword_table_by_language(spark):
    df = spark.createDataFrame([("de", 1, "und haus"), ("en", 2, "and house"), ("ko", 3, "and und")], "lang string, doc_id long, text string")
    table = stopword_table(spark, {"de": ["und"], "en": ["and"]})
    got = {r["doc_id"]: r["tokens"] for r in analyze(df, stopwords=table).collect()}
    assert got == {1: ["haus"], 2: ["house"], 3: ["and", "und"]}


def test_stopword_sources(spark):
    assert stopwords("en", "v2") == list(ENGLISH) and len(ENGLISH) == 33
    assert "und" in stopwords("de")
    assert stopwords("ko", own=["x", "x"]) == ["x"]
    with pytest.raises(ValueError):
        stopwords("en", "v3")
    with pytest.raises(ValueError):
        stopwords("ar")


@pytest.mark.parametrize(
    ("word", "want"),
    [("consistency", "consist"), ("consigned", "consign"), ("knightly", "knight"), ("generously", "generous"), ("skies", "sky"), ("happy", "happi"), ("hoping", "hope"), ("hopping", "hop"), ("national", "nation"), ("dying", "die"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("succeeding", "succeed"), ("relational", "relat"), ("conditional", "condit"), ("cement", "cement"), ("adoption", "adopt"), ("controll", "control"), ("by", "by"), ("say", "say")],
)
def test_english_stems(word, want):
    assert stemming.english(word) == want


@pytest.mark.parametrize(
    ("word", "want"),
    [("aufeinander", "aufeinand"), ("kategorischen", "kategor"), ("häuser", "haus"), ("aufgabe", "aufgab"), ("freundlichkeit", "freundlich"), ("ergebnisse", "ergebnis"), ("straße", "strass"), ("bedeutungen", "bedeut")],
)
def test_german_stems(word, want):
    assert stemming.german(word) == want


@pytest.mark.parametrize(
    ("word", "want"),
    [("cheques", "chequ"), ("chicharrones", "chicharron"), ("torneado", "torn"), ("chilenas", "chilen"), ("canciones", "cancion"), ("rápidamente", "rapid"), ("comprarlo", "compr"), ("lleguen", "lleg"), ("contribuyendo", "contribu"), ("toreado", "tor"), ("torres", "torr")],
)
def test_spanish_stems(word, want):
    assert stemming.spanish(word) == want


@pytest.mark.parametrize(
    ("word", "want"),
    [("continuait", "continu"), ("continuation", "continu"), ("continuellement", "continuel"), ("majesté", "majest"), ("majestueusement", "majestu"), ("contradictoirement", "contradictoir"), ("malades", "malad"), ("maladie", "malad"), ("maintenant", "mainten"), ("main", "main"), ("chevaux", "cheval"), ("fidèles", "fidel"), ("activités", "activ")],
)
def test_french_stems(word, want):
    assert stemming.french(word) == want


@pytest.mark.parametrize(
    ("word", "want"),
    [("abbandonata", "abbandon"), ("abbandonava", "abbandon"), ("abbandonerà", "abbandon"), ("pronto", "pront"), ("pronuncerà", "pronunc"), ("propaga", "propag"), ("propizio", "propiz"), ("amiche", "amic"), ("velocità", "veloc")],
)
def test_italian_stems(word, want):
    assert stemming.italian(word) == want


def test_language_without_stemmer_keeps_words():
    assert stemming.stem("ko", "학교에서") == "학교에서" and stemming.stem(None, "abc") == "abc"


@pytest.mark.parametrize(("lang", "n", "word"), [("de", 232, "über"), ("fr", 157, "êtes"), ("es", 313, "éramos"), ("it", 279, "è"), ("ko", 677, "￥")])
def test_v2_stopwords_of_other_languages(lang, n, word):
    got = stopwords(lang, "v2")
    assert len(got) == n and got[-1] == word


@pytest.mark.parametrize(
    ("word", "want"),
    [("الكتاب", "كتاب"), ("كتاب", "كتاب"), ("كتابها", "كتاب"), ("مكتبة", "مكتب"), ("وكتاب", "كتاب"), ("والد", "والد"), ("بالكتاب", "كتاب"), ("يكتبون", "يكتب"), ("سيكتب", "يكتب"), ("يستعمل", "استعمل"), ("المعلمين", "معلم"), ("كِتَابٌ", "كتاب"), ("علمى", "علمي"), ("من", "من"), ("أكل", "اكل"), ("ماء", "ماء"), ("hello", "hello"), ("", "")],
)
def test_arabic_stems(word, want):
    assert stemming.stem("ar", word) == want


def test_each_word_is_stemmed_once(spark):
    rows = [("en", i, ["runs", "the", "runs", "houses"]) for i in range(50)] + [("de", 99, ["häuser", "runs"]), ("ko", 98, ["runs"]), (None, 97, ["runs"]), ("en", 96, [])]
    df = spark.createDataFrame(rows, "lang string, doc_id long, tokens array<string>").repartition(7)
    words = stemming.dictionary(df.selectExpr("lang", "explode(tokens) AS word"))
    assert sorted(map(tuple, words.collect())) == [("de", "häuser", "haus"), ("de", "runs", "run"), ("en", "houses", "hous"), ("en", "runs", "run")] or words.where("lang = 'en'").count() == 2
    got = {r["doc_id"]: r["tokens"] for r in stemming.stem_tokens(df).collect()}
    assert got[0] == ["run", "the", "run", "hous"] and got[98] == got[97] == ["runs"] and got[96] == [] and len(got) == 54
    plan = stemming.stem_tokens(df)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan  # the dictionary was written before


def test_own_stems_go_first(spark):
    df = spark.createDataFrame([("en", 1, ["runs", "houses", "x"])], "lang string, doc_id long, tokens array<string>")
    own = spark.createDataFrame([("en", "runs", "go"), ("en", "x", "y"), ("de", "houses", "no")], "lang string, word string, base string")
    assert stemming.stem_tokens(df, own).first()["tokens"] == ["go", "hous", "y"]


def test_stopwords_with_quotes_and_backslashes(spark):
    assert words_of(spark, "l'eau it's a_b cc dd", stopwords=["it's", "c\\c", "eau", "a_b", "'", ""]) == ["it", "cc", "dd"]
    table = spark.createDataFrame([("en", ["cc", None, "o'clock"]), ("en", ["dd"]), (None, ["it"])], "lang string, words array<string>")
    df = spark.createDataFrame([("en", "it cc dd ee"), ("de", "it cc"), (None, "it cc")], "lang string, text string")
    assert sorted(r["tokens"] for r in analyze(df, stopwords=table).collect()) == [["it", "cc"], ["it", "cc"], ["it", "ee"]]
