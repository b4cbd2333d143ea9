"""File discovery, verified publication and appends."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def discover(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(name, path, length) of data files below ``root``; contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(root)
    )
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")


def _sums(df: DataFrame) -> list[Column]:
    """Row count and two order-free sums over all columns."""
    ordered = [F.col(f"`{c}`") for c in sorted(df.columns)]
    return [
        F.count("*").alias("rows"),
        F.sum(F.xxhash64(*ordered).cast("decimal(38,0)")).alias("first"),
        F.sum(F.xxhash64(F.lit(1), *ordered).cast("decimal(38,0)")).alias("second"),
    ]


def _mark(sums: Mapping) -> tuple[int, str]:
    return sums["rows"], "" if sums["first"] is None else f"{sums['first']}:{sums['second']}"


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count and an order-free digest of all columns."""
    sums = df.agg(*_sums(df))
    return sums.select("rows", F.concat_ws(":", F.col("first").cast("string"), F.col("second").cast("string")).alias("digest"))


# --- publication --------------------------------------------------------------------------------


class PublicationConflict(RuntimeError):
    """Another publication took the number in the meantime."""


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; False if it does. The store decides between two
    writers, as HDFS and local disks do; a store without exclusive creation needs one writer."""
    system, target = _file_system(spark, path)
    try:
        stream = system.create(target, False)
    except Py4JJavaError as error:
        if system.exists(target):
            return False
        raise error
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


_MANIFEST = "number bigint, version string, rows bigint, digest string"


def manifests(spark: SparkSession, root: str, name: str) -> DataFrame:
    """number, version, rows, digest of every publication of a name; empty before the first. A
    manifest that is not written to its end is none."""
    if not exists(spark, f"{root}/{name}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    found = spark.read.schema(_MANIFEST).json(f"{root}/{name}/manifest")
    return found.where(F.col("digest").isNotNull())


def publish(df: DataFrame, root: str, name: str, base: int | None = None) -> int:
    """Write a new version, compare it with the source, then switch the name to it; returns the
    number of the publication.

    The source is read once: its count and digest are observed while it is written. The version is
    read back before the switch and, through the name, after it; a difference before leaves the name
    alone, one after takes the new manifest back, so the old version stays readable. A manifest
    carries the number after ``base`` (the last one, unless the caller saw another), and only one
    publication can have a number: the other one raises ``PublicationConflict``. Readers see the old
    version or the new one, never a part.
    """
    spark = df.sparkSession
    before = _latest(spark, root, name)
    base = (before["number"] if before else 0) if base is None else base
    version = uuid.uuid4().hex
    target = f"{root}/{name}/versions/{version}"
    seen = Observation()
    df.observe(seen, *_sums(df)).write.parquet(target)
    wanted = _mark(seen.get)
    stored = spark.read.schema(df.schema).parquet(target)
    got = _mark(stored.agg(*_sums(stored)).first())
    if wanted != got:
        raise RuntimeError(f"{name}: written {got} differs from {wanted}")
    number = base + 1
    manifest = f"{root}/{name}/manifest/{number:012}.json"
    row = {"number": number, "version": version, "rows": wanted[0], "digest": wanted[1]}
    if (before and before["number"] != base) or not create_once(spark, manifest, json.dumps(row) + "\n"):
        raise PublicationConflict(f"{name}: publication {number} exists")
    after = published(spark, root, name)
    if _mark(after.agg(*_sums(after)).first()) != wanted:
        system, path = _file_system(spark, manifest)
        system.delete(path, False)
        raise RuntimeError(f"{name}: publication {number} reads back differently and is taken back")
    return number


def _latest(spark: SparkSession, root: str, name: str):
    return manifests(spark, root, name).orderBy(F.col("number").desc()).first()


def published(spark: SparkSession, root: str, name: str, verify: bool = False) -> DataFrame:
    """The version a name points at; with ``verify``, the last one that still equals its manifest."""
    last = None if verify else _latest(spark, root, name)
    tried = [last] if last else manifests(spark, root, name).orderBy(F.col("number").desc()).toLocalIterator()
    for row in tried:
        try:
            stored = spark.read.parquet(f"{root}/{name}/versions/{row['version']}")
            if not verify or _mark(stored.agg(*_sums(stored)).first()) == (row["rows"], row["digest"]):
                return stored
        except (PySparkException, Py4JJavaError) as error:  # files are gone or cannot be read
            if not verify:
                raise error
    raise LookupError(f"{name} has no readable publication")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one side holds; empty after a good round trip."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("only_in", F.lit("right"))
    )


def append_records(df: DataFrame, path: str) -> None:
    """Add records to a log; earlier files are never rewritten."""
    df.write.mode("append").json(path)
