"""Text analysis: lower-case, split into words of two characters or more, drop stopwords, stem (T1-T5, F-4, F-5, F-7)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.functions import stemming

#: Letters, digits and the underscore, without combining marks; a greedy run needs no word boundaries.
WORD = "[\\p{L}\\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def without(words: Iterable[str | None]) -> Column:
    """The tokens that are not among the words: a hashed set, looked into once a token."""
    quoted = ["'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted({w for w in words if w})]
    return F.expr(f"filter(tokens, t -> t NOT IN ({', '.join(quoted)}))") if quoted else F.col("tokens")


def analyze(df: DataFrame, text: str = "text", stopwords: Iterable[str] | DataFrame | None = None, stemmer: str = "identity", stems: DataFrame | None = None) -> DataFrame:
    """df without its text, with `tokens` instead. Stopwords are matched before stemming.

    stopwords: words for all languages, or a table (lang, words). stemmer: "identity", or "snowball" for the stemmer of the
    row's `lang` (languages without one keep their words, or take the bases of `stems`, a table (lang, word, base)).
    """
    out = df.withColumn("tokens", tokens(F.col(text))).drop(text)
    if isinstance(stopwords, DataFrame):
        kept = F.col("tokens")
        for r in stopwords.groupBy("lang").agg(F.flatten(F.collect_list("words")).alias("words")).collect():  # a row a language
            if r["lang"] is not None:
                kept = F.when(F.col("lang") == r["lang"], without(r["words"])).otherwise(kept)
        out = out.withColumn("tokens", kept)
    elif stopwords is not None:
        out = out.withColumn("tokens", without(stopwords))
    if stemmer == "snowball":
        out = stemming.stem_tokens(out, stems)
    elif stemmer != "identity":
        raise ValueError(f"unknown stemmer {stemmer!r}")
    return out
