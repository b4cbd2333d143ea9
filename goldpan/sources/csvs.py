"""Description CSV files and CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import one_line, strip
from ..session import cut

_BOM = "\ufeff"


def _windows_1252_table() -> tuple[str, str]:
    """Characters that windows-1252 puts where ISO-8859-1 has control codes."""
    pairs = []
    for code in range(0x80, 0xA0):
        try:
            pairs.append((chr(code), bytes([code]).decode("cp1252")))
        except UnicodeDecodeError:
            continue
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# A quote counts at the start of a field only, and is doubled inside a quoted one.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"[^,\r\n]*|[^,\r\n]*)'
_RECORD = rf"({_FIELD}(?:,{_FIELD})*)(?:\r\n|\n|\r|\z)"


def _fields(record: Column) -> Column:
    """Values of one record, without their quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf",({_FIELD})"), F.lit(1))
    return F.transform(
        raw,
        lambda v: F.when(
            F.startswith(v, F.lit('"')),
            F.replace(F.regexp_replace(v, r'(?s)\A"([^"]*(?:""[^"]*)*)"(.*)\z', "$1$2"), F.lit('""'), F.lit('"')),
        ).otherwise(v),
    )


def description_records(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(file, header, place, values): the records of all description files, in one pass over them.

    A file, which is small, is read as UTF-8 when all of its bytes are, else as windows-1252 (Spark
    knows ISO-8859-1; the 27 characters that differ are exchanged). Quoted values may hold line ends;
    empty lines are no records. A file without a record gives no row.
    """
    raw = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    ).select(F.col("path").alias("file"), "content")
    latin, windows = _windows_1252_table()
    unicode = F.is_valid_utf8(F.col("content").cast("string"))
    decoded = F.when(unicode, F.col("content").cast("string")).otherwise(
        F.translate(F.decode("content", "ISO-8859-1"), latin, windows)
    )
    texts = raw.select("file", F.regexp_replace(decoded, f"\\A{_BOM}", "").alias("_text"))
    records = texts.select(
        "file", F.filter(F.regexp_extract_all("_text", F.lit(_RECORD), F.lit(1)), lambda r: r != "").alias("_records")
    ).where(F.size("_records") > 0)
    header = F.transform(_fields(F.get("_records", F.lit(0))), strip)
    # In a step of its own, since each exploded row would carry all records to work its header out from.
    headed = records.select("file", header.alias("header"), "_records")
    rows = headed.select("file", "header", F.posexplode("_records").alias("place", "_record"))
    return rows.where("place > 0").select("file", "header", "place", _fields(F.col("_record")).alias("values"))


def scan_description_csv(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Rows of description files with their file path and one column per header name of any file.

    Header names are trimmed and values put on one line; a value that a record or file lacks is
    empty. A name that a header repeats means its last column. Only the distinct header names pass
    through the driver; files with other headers need no plan of their own.
    """
    records = cut(description_records(spark, path, glob))
    names = [r[0] for r in records.select(F.explode("header")).distinct().collect()]
    if not names:
        raise FileNotFoundError(f"no {glob} with records under {path}")

    def value(name: str) -> Column:
        last = F.array_position(F.reverse("header"), name)
        found = F.when(last > 0, F.get("values", (F.size("header") - last).cast("int")))
        return one_line(found).alias(name)

    return records.select("file", *[value(n) for n in sorted(names) if n.lower() != "file"])


def export_csv(df: DataFrame, path: str) -> None:
    """Every value quoted, quotes doubled, null as an empty value."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    (
        text.write.option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", '""')
        .csv(path)
    )


def blank_to_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.nullif(strip(F.col(c)), F.lit("")) for c in columns})
