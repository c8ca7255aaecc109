"""Language identification by string kernels.

Two texts are as alike as the share of n-grams of 1 to SPECTRUM letters that both hold: a blended-spectrum presence kernel,
divided by the root of both texts' numbers of n-grams. A Nyström map from LANDMARKS training texts stands for the whole kernel
matrix, and kernel ridge regression on it, one language against the rest, is one small linear system. A batch of texts is scored
by two matrix products: presence of n-grams by landmarks, and likenesses by languages.

The fit sees a bounded sample: at most SAMPLE labelled rows, in equal parts by language (two of each at least), those with the
smallest seeded hashes of their ids; the landmarks are the first of these. n-grams are taken and kernels computed in tasks; the
driver gets a count for each language, the landmarks' n-grams and LANDMARKS numbers for each sampled row. Scoring covers all rows
and whole texts, in Arrow batches without a shuffle. n-grams are coded exactly, not hashed; texts of more than PIECE letters are
taken in pieces, so that memory is bounded by the text and its distinct n-grams.

Defined cases: texts count as lower case, with one space for what stands between words. Null texts and those without a letter are
`und` with score 0; so are all texts if there is nothing to learn from. Rows of a null id teach nothing and are not held out.
Ties go to the language that sorts first. Repeated rows are judged one by one, an empty table gives no rows. Extra columns pass
through, but for those named as a result, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrid.llm.common import Workspace

SPECTRUM, SAMPLE, LANDMARKS, RIDGE, SEED = 3, 4_000, 160, 0.03, 12
UNKNOWN = "und"
#: Texts scored at once, letters taken at once, and bits of a character's code: SPECTRUM of them fit into 63.
ROWS, PIECE, BITS = 64, 1 << 20, 21
BETWEEN, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def grams(text: str | None) -> np.ndarray | None:
    """The codes of a text's distinct n-grams, sorted; None if it has no letter."""
    if not text or not LETTER.search(text):
        return None
    bare = f" {BETWEEN.sub(' ', text.lower()).strip()} "
    found = None
    for at in range(0, len(bare), PIECE):
        c = np.frombuffer(bare[at : at + PIECE + SPECTRUM - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        codes, every = c, [c]
        for n in range(1, min(SPECTRUM, len(c))):
            codes = (codes[:-1] << BITS) | c[n:]
            every.append(codes)
        new = np.unique(np.concatenate(every))
        found = new if found is None else np.union1d(found, new)
    return found


@dataclass(frozen=True)
class Landmarks:
    """codes: all n-grams of the landmark texts, sorted; held: which landmark (column) holds them; size: how many each holds."""

    codes: np.ndarray
    held: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Landmarks:
        codes = np.unique(np.concatenate(sets))
        held = np.zeros((len(codes), len(sets)), dtype=np.float32)
        for j, s in enumerate(sets):
            held[np.searchsorted(codes, s), j] = 1
        return cls(codes, held, np.array([len(s) for s in sets], dtype=float))

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of likenesses to the landmarks for each set of n-grams."""
        present = np.zeros((len(sets), len(self.codes)), dtype=np.float32)
        for i, s in enumerate(sets):
            at = np.searchsorted(self.codes, s)
            at[at == len(self.codes)] = 0
            present[i, at[self.codes[at] == s]] = 1
        return (present @ self.held) / np.sqrt(np.outer([len(s) for s in sets], self.size))  # whole numbers, exact in single precision


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: Landmarks | None
    weight: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        sets = [grams(t) for t in texts]
        known = [i for i, s in enumerate(sets) if s is not None]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known and self.landmarks is not None:
            margins = self.landmarks.kernel([sets[i] for i in known]) @ self.weight + self.bias
            best = margins.argmax(axis=1)
            for i, k, m in zip(known, best.tolist(), margins[np.arange(len(known)), best].tolist()):
                names[i], scores[i] = self.languages[k], min(1.0, max(0.0, (1 + m) / 2))
        return names, scores


def regress(kernel: np.ndarray, between: np.ndarray, languages: list[str], ridge: float = RIDGE) -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
    """(languages, weight, bias): ridge regression on the Nyström map.

    kernel: likeness of each row to the landmarks; between: of the landmarks to each other; languages: of the rows.
    """
    names = tuple(sorted(set(languages)))
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    values, vectors = np.linalg.eigh(between)
    good = values > 1e-6 * values.max()
    to_map = vectors[:, good] / np.sqrt(values[good])
    x = kernel @ to_map
    mean, level = x.mean(axis=0), y.mean(axis=0)
    w = np.linalg.solve((x - mean).T @ (x - mean) + ridge * len(x) / len(names) * np.eye(x.shape[1]), (x - mean).T @ (y - level))
    return names, to_map @ w, level - mean @ w


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, key: str, text: str, language: str, sample: int) -> tuple[DataFrame, int]:
    """(text, lang, place) of the rows to learn from, and how many languages they have; place counts from 1 in each language."""
    k, g = F.col(f"`{key}`"), F.col(f"`{language}`")
    rows = docs.select(k.alias("k"), g.alias("lang"), F.col(f"`{text}`").alias("text")).where(k.isNotNull() & g.isNotNull() & ~held_out(k))
    counts = rows.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    each = max(2, sample // max(1, len(counts)))
    draw = F.xxhash64(F.lit(SEED), "k")
    bounds = [F.struct(F.lit(r["lang"]).alias("lang"), F.lit(min(2**63 - 1, -(2**63) + 2**64 * 3 * each // r["count"])).alias("bound")) for r in counts if r["count"] > 4 * each]
    if bounds:  # most rows are put aside before any is sorted; of those below the bound, some may have no letter
        bound = F.map_from_entries(F.array(*bounds))[F.col("lang")]
        rows = rows.where(F.coalesce(draw < bound, F.lit(True)))
    place = F.row_number().over(W.partitionBy("lang").orderBy(draw, "k", F.xxhash64("text")))
    return rows.where(F.col("text").rlike("\\p{L}")).withColumn("place", place).where(F.col("place") <= each).select("text", "lang", "place"), len(counts)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Learn from rows with a language whose key isn't held out."""
    space = Workspace(docs.sparkSession)
    rows, n = sampled(docs, key, text, language, sample)
    rows = space.keep(rows)
    first = rows.where(F.col("place") <= max(2, landmarks // max(1, n)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("place"), pa.array([grams(t) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["lang", "place", "grams"])

    chosen = first.mapInArrow(gather, "lang string, place int, grams array<bigint>").orderBy("lang", "place").toArrow()  # `landmarks` rows, or two a language
    if not chosen.num_rows:
        return Model((), None, np.zeros((0, 0)), np.zeros(0))
    marks = Landmarks.of([np.asarray(x.values) for x in chosen.column("grams")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                likeness = marks.kernel([grams(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), pa.array(list(likeness), pa.list_(pa.float64()))], names=["lang", "place", "k"])

    got = rows.mapInArrow(compare, "lang string, place int, k array<double>").orderBy("lang", "place").toArrow()  # `sample` rows of numbers
    kernel = np.asarray(got.column("k").combine_chunks().flatten()).reshape(got.num_rows, -1)
    between = (marks.held.T @ marks.held) / np.sqrt(np.outer(marks.size, marks.size))
    names, weight, bias = regress(kernel, between, got.column("lang").to_pylist())
    return Model(names, marks, weight, bias)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs but the text, plus `held_out`, `lang_pred` and `score`."""
    results = ("held_out", "lang_pred", "score")
    kept = [c for c in docs.columns if c not in (text, *results)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, scores = model.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in (*kept, "held_out")] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *results])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], held_out(F.col(f"`{key}`")).alias("held_out"), F.col(f"`{text}`"))
    return rows.mapInArrow(run, schema)
