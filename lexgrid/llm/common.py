"""Column expressions shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\x09-\\x0D]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def count_of(text: Column, characters: str) -> Column:
    """How many of the characters (as they stand in a regular expression's class) the text holds."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


#: A set of keys is broadcast up to so many rows (16 bytes each, some 50 MB as a hashed table); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: And so many bytes, where rows hold texts.
BROADCAST_BYTES = 32_000_000


def flag_by_key(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """df with a boolean column: whether the row's key is among the distinct keys; large texts stay where they are if the keys are few."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = keys.withColumn(flag, F.lit(True))
    return df.join(F.broadcast(keys) if few else keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def shared_folder(spark: SparkSession) -> str:
    """A folder for written tables under spark.checkpoint.dir; a local one only on a local master where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/lexgrid-checkpoints"
    return f"{root.rstrip('/')}/lexgrid-{uuid.uuid4().hex}"


class Workspace:
    """Tables written once in the shared folder and read again: they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_folder(spark), 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Remove tables that nothing still to be computed reads."""
        jvm = self.spark._jvm
        for df in kept:
            _, path = self.paths.pop(id(df))
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
