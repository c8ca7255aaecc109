"""Snapshots of saved tables, published whole by a manifest that is written last.

Under a path each table has a folder for each snapshot, and `manifests` a numbered file for each save: which snapshot holds which
part. A reader takes the manifest of the highest number. A save that stops anywhere before its manifest leaves everything as it
was; one that is overtaken by another fails instead of hiding it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def moved(spark: SparkSession, source: str, to: str) -> bool:
    """Move a folder, if both places are of one file system."""
    fs, make = files(spark, source)
    other, _ = files(spark, to)
    if fs.getUri().toString() != other.getUri().toString():
        return False
    fs.mkdirs(make(to).getParent())
    return fs.rename(make(source), make(to))


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The highest number and its parts, {part: snapshot}; (0, {}) if nothing was saved."""
    fs, make = files(spark, path)
    folder = make(f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
    if not numbers:
        return 0, {}
    text = spark.read.text(f"{path}/manifests/{max(numbers):08d}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def folder_of(path: str, table: str, snapshot: str) -> str:
    return f"{path}/{table}/snapshot={snapshot}"


def publish(spark: SparkSession, path: str, parts: list[str], write: Callable[[str], None]) -> None:
    """write(snapshot) writes all tables of a new snapshot, which then holds the given parts; other parts stay where they are."""
    number, held = manifest(spark, path)
    snapshot = uuid.uuid4().hex
    write(snapshot)
    fs, make = files(spark, path)
    draft, final = make(f"{path}/manifests/{snapshot}.draft"), make(f"{path}/manifests/{number + 1:08d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(held | dict.fromkeys(parts, snapshot), sort_keys=True).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another save to {path} was published meanwhile; save again")


def remove_unpublished(spark: SparkSession, path: str, tables: tuple[str, ...]) -> int:
    """Delete the folders of snapshots that the last manifest does not name, and return how many; not while a save is under way."""
    fs, make = files(spark, path)
    live, gone = set(manifest(spark, path)[1].values()), 0
    for table in tables:
        folder = make(f"{path}/{table}")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName().removeprefix("snapshot=") not in live:
                gone += fs.delete(s.getPath(), True)
    return gone
