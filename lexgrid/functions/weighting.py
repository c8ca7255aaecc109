"""Term weights (W1-W8): eight pairs of a term-frequency and an inverse-document-frequency expression, as built-in functions.

c: places of the term in the document; length: words of the document; mean: mean length in its language; total: documents
in its language; n: those that hold the term.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ln(x: Column) -> Column:
    """Natural logarithm; null outside its domain."""
    return F.when(x > 0, F.ln(x))


def _saturation(length: Column, mean: Column, k1: Column, b: Column) -> Column:
    return k1 * (1 - b * (1 - length / mean))


def tf_ratio(c, length, mean, k1, b, d):
    return c / length


def tf_saturating(c, length, mean, k1, b, d):
    return c / (c + _saturation(length, mean, k1, b))


def tf_plus(c, length, mean, k1, b, d):
    return d + (1 + k1) * c / (c + _saturation(length, mean, k1, b))


def tf_ldp(c, length, mean, k1, b, d):
    return 1 + safe_ln(1 + safe_ln(d + c / (1 - b + b * length / mean)))


def idf_smooth(total, n):
    return F.ln((1 + total) / (1 + n)) + 1


def idf_okapi(total, n):
    return F.ln((total - n + 0.5) / (n + 0.5) + 1)


def idf_logn1(total, n):
    return F.ln((total + 1) / n)


def idf_dlite(total, n):
    q = n / total
    return (1 - q) / 2 + (1 - q * (1 - F.ln(q))) - (1 - q * q * (1 - 2 * F.ln(q))) / (2 + 2 * q)


def idf_dlite_cbrt(total, n):
    return F.cbrt(idf_dlite(total, n))


TF: dict[str, Callable[..., Column]] = {"ratio": tf_ratio, "saturating": tf_saturating, "plus": tf_plus, "ldp": tf_ldp}
IDF: dict[str, Callable[..., Column]] = {"smooth": idf_smooth, "okapi": idf_okapi, "logn1": idf_logn1, "dlite": idf_dlite, "dlite_cbrt": idf_dlite_cbrt}
#: method -> (TF, IDF, the parameters that matter)
METHODS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "TFIDF": ("ratio", "smooth", ()),
    "BM25_V1": ("saturating", "okapi", ("k1", "b")),
    "BM25_V2": ("saturating", "smooth", ("k1", "b")),
    "BM25_PLUS": ("plus", "logn1", ("k1", "b", "d")),
    "BM25_PLUS_V2": ("plus", "okapi", ("k1", "b", "d")),
    "DLITE": ("saturating", "dlite", ("k1", "b")),
    "DLITE_CBRT": ("saturating", "dlite_cbrt", ("k1", "b")),
    "TF_LDP": ("ldp", "logn1", ("b", "d")),
}
#: Of these, each of k1, b and d by itself only raises or only lowers a weight, so the largest of a range is at a corner.
MONOTONE = {"ratio", "saturating", "plus", "ldp"}
DEFAULTS = {"k1": 1.5, "b": 0.75, "d": 1.0}


def check(method: str, k1: float, b: float, d: float) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    if k1 < 0 or not 0 <= b <= 1 or d < 0:
        raise ValueError("k1 and d must not be negative, b must lie between 0 and 1")


def weight(method: str, *, c: Column, length: Column, mean: Column, total: Column, n: Column, k1: Column, b: Column, d: Column) -> Column:
    tf, idf, _ = METHODS[method]
    whole = [x.cast("double") for x in (c, length, mean)]
    return TF[tf](*whole, k1, b, d) * IDF[idf](total.cast("double"), n.cast("double"))


def weight_by(method: Column, **of: Column) -> Column:
    """As weight(), with the method from a column."""
    c, length, mean, total, n = (of[k].cast("double") for k in ("c", "length", "mean", "total", "n"))

    def choose(part: int, values: dict[str, Column]) -> Column:
        out = F.lit(None).cast("double")
        for name, value in values.items():
            out = F.when(method.isin(*[m for m, of in METHODS.items() if of[part] == name]), value).otherwise(out)
        return out

    tf = choose(0, {k: f(c, length, mean, of["k1"], of["b"], of["d"]) for k, f in TF.items()})
    return tf * choose(1, {k: f(total, n) for k, f in IDF.items()})
