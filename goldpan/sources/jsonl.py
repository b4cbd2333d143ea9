"""JSON and JSON-lines scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record per line, blank lines skipped; the read fails on the first bad line.

    ``jsonl_issues`` names the file and line of every bad record.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file documents: an object, or an array of objects, per file."""
    return (
        spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("slot"),
            F.col("value").alias("line"),
        )
    )


def _issue(line: Column) -> Column:
    """Why a line is not a record: 'invalid_json', 'not_an_object', or null."""
    valid = F.try_parse_json(line).isNotNull()
    is_object = F.startswith(F.ltrim(line), F.lit("{"))
    return F.when(~valid, "invalid_json").when(~is_object, "not_an_object")


def scan_strict_jsonl(
    spark: SparkSession, path: str, schema: T.StructType | str
) -> tuple[DataFrame, DataFrame]:
    """Records that are objects of the schema, and the rejected lines with their reason.

    An object with a value of another type than its field's is rejected as ``wrong_type``.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    filled = lines.where(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "_goldpan_bad"
    wide = T.StructType([*fields.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json("line", wide, {"columnNameOfCorruptRecord": bad})
    judged = filled.withColumn("issue", _issue(F.col("line"))).withColumn("r", parsed)
    wrong = F.when(F.col(f"r.{bad}").isNotNull(), "wrong_type")
    judged = judged.withColumn("issue", F.coalesce("issue", wrong))
    good = judged.where(F.col("issue").isNull()).select(*[F.col(f"r.`{f.name}`") for f in fields.fields])
    return good, judged.where(F.col("issue").isNotNull()).drop("r")


def jsonl_issues(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, issue, line) of every bad line.

    A line's number is its place in its file block plus the lines of the blocks before it,
    so large files are numbered without reading them in one task.
    """
    lines = _lines(spark, path)
    blocks = lines.groupBy("file", "block").agg(
        F.count("*").alias("_n"), F.min("slot").alias("_first")
    )
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block")) - F.col("_n")
    offsets = blocks.select("file", "block", "_first", before.alias("_before"))
    blank = F.regexp_replace("line", r"\s", "") == ""
    bad = lines.withColumn("issue", F.when(~blank, _issue(F.col("line")))).where(
        F.col("issue").isNotNull()
    )
    return bad.join(offsets, ["file", "block"]).select(
        "file",
        (F.col("_before") + F.col("slot") - F.col("_first") + 1).alias("line_number"),
        "issue",
        "line",
    )


def torn_files(spark: SparkSession, path: str) -> DataFrame:
    """Per file: lines, blank lines, bad lines and whether the last line is complete.

    A file whose lines, each with its newline, add up to one byte more than the file has
    ends without a newline. That needs no look at the file as a whole.
    """
    lines = _lines(spark, path)
    width = F.sum(F.octet_length("line") + 1)
    blank = F.regexp_replace("line", r"\s", "") == ""
    return lines.groupBy("file", "file_size").agg(
        F.count("*").alias("lines"),
        F.count_if(blank).alias("blank_lines"),
        F.count_if(~blank & _issue(F.col("line")).isNotNull()).alias("bad_lines"),
        (width > F.col("file_size")).alias("torn"),
    ).drop("file_size")
