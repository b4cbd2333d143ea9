"""Schema catalogs: reading, resolving, matching, checking and rendering.

A catalog is kept flat: one row per column with (split, db_id, table_name, table_display,
table_ordinal, column_name, column_display, ordinal, declared_type, is_primary_key), and one
row per foreign key with (db_id, source_table, source_column, target_table, target_column,
key_ordinal).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..session import cut, discard, shuffles_freed
from .ranks import top_per_group

METADATA_SCHEMA = (
    "db_id string, table_names_original array<string>, table_names array<string>, "
    "column_names_original array<array<string>>, column_names array<array<string>>, "
    "column_types array<string>, primary_keys array<string>, foreign_keys array<array<int>>"
)


# ---- databases and files -----------------------------------------------------------------


def database_ids(samples: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """Distinct usable ids per split, and the samples whose id is null or blank."""
    good = F.coalesce(text.strip(F.col("db_id")), F.lit("")) != ""
    return samples.where(good).select(split, "db_id").distinct(), samples.where(~good)


def has_user_table(tables: DataFrame, keys: Sequence[str] = ("db_id",)) -> DataFrame:
    """Whether a database has any table that is not internal ('sqlite_...')."""
    user = ~F.startswith(F.col("table_name"), F.lit("sqlite_"))
    return tables.groupBy(*keys).agg(F.bool_or(user).alias("has_user_table"))


def resolve_databases(expected: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every problem of every expected database; a database without rows here is usable.

    ``files`` has the keys, path, in_place, readable and user_tables.
    """
    found = files.groupBy(*keys).agg(
        F.count("*").alias("_files"),
        F.bool_and("in_place").alias("_in_place"),
        F.bool_and("readable").alias("_readable"),
        F.sum("user_tables").alias("_tables"),
    )
    joined = expected.join(found, list(keys), "left")
    single = F.col("_files") == 1
    issues = F.filter(
        F.array(
            F.when(F.col("_files").isNull(), "not_found"),
            F.when(F.col("_files") > 1, "multiple_files"),
            F.when(single & ~F.col("_in_place"), "wrong_location"),
            F.when(single & ~F.col("_readable"), "unreadable"),
            F.when(single & F.col("_readable") & (F.col("_tables") == 0), "no_user_tables"),
        ),
        lambda i: i.isNotNull(),
    )
    return joined.select(*keys, F.explode(issues).alias("issue"))


def shared_databases(samples: DataFrame, first: str, second: str) -> DataFrame:
    """Database ids that occur in both splits."""
    a = samples.where(F.col("split") == first).select("db_id")
    return a.intersect(samples.where(F.col("split") == second).select("db_id"))


def coverage_gaps(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side lacks, tagged with the side that lacks them."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (
        b.join(a, list(keys), "left_anti").withColumn("missing_from", F.lit("left"))
        .unionByName(
            a.join(b, list(keys), "left_anti").withColumn("missing_from", F.lit("right"))
        )
    )


def file_coverage(references: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Paths that are missing, unreferenced, referenced twice or listed twice."""
    refs = references.groupBy(path).agg(F.count("*").alias("_refs"))
    listed = files.groupBy(path).agg(F.count("*").alias("_files"))
    issues = F.filter(
        F.array(
            F.when(F.col("_files").isNull(), "missing_file"),
            F.when(F.col("_refs").isNull(), "extra_file"),
            F.when(F.col("_refs") > 1, "duplicate_reference"),
            F.when(F.col("_files") > 1, "duplicate_file"),
        ),
        lambda i: i.isNotNull(),
    )
    return refs.join(listed, path, "full_outer").select(path, F.explode(issues).alias("issue"))


# ---- metadata documents ------------------------------------------------------------------


def parse_metadata(docs: DataFrame, raw: str) -> DataFrame:
    """Parallel-array documents; the int-or-list primary keys become lists of ints."""
    parsed = docs.withColumn("_doc", F.from_json(raw, METADATA_SCHEMA)).select(
        *[c for c in docs.columns if c != raw], "_doc.*"
    )
    numbers = F.transform(
        "primary_keys",
        lambda k: F.transform(
            F.regexp_extract_all(k, F.lit(r"(-?\d+)"), F.lit(1)), lambda d: d.cast("int")
        ),
    )
    return parsed.withColumn("primary_keys", numbers)


def _index(pair: Column) -> Column:
    return pair[0].cast("int")


def _at(items: Column | str, index: Column) -> Column:
    """Element at a 0-based index; null outside of the array."""
    return F.try_element_at(items, F.nullif(index + 1, F.lit(0)))


def metadata_issues(parsed: DataFrame, key: str) -> DataFrame:
    """Rules a metadata document breaks: (key, rule)."""
    originals, shown = F.col("column_names_original"), F.col("column_names")
    tables = F.size("table_names_original")
    star = F.array(F.lit("-1"), F.lit("*"))
    named = F.slice(originals, F.lit(2), F.greatest(F.size(originals) - 1, F.lit(0)))
    pairs = F.arrays_zip(originals.alias("o"), shown.alias("d"))
    rules = {
        "table_lengths_differ": tables != F.size("table_names"),
        "column_lengths_differ": (F.size(originals) != F.size(shown))
        | (F.size(originals) != F.size("column_types")),
        "placeholder_missing": (F.try_element_at(originals, F.lit(1)) != star)
        | (F.try_element_at(shown, F.lit(1)) != star),
        "table_index_out_of_range": F.exists(
            named, lambda c: (_index(c) < 0) | (_index(c) >= tables)
        ),
        "table_index_differs": F.exists(pairs, lambda p: p["o"][0] != p["d"][0]),
        "star_used_as_name": F.exists(named, lambda c: c[1] == "*"),
    }
    # A rule that cannot be judged, as a field it needs is missing, counts as broken.
    broken = {name: F.coalesce(bad, F.lit(True)) for name, bad in rules.items()}
    fields = ["table_names_original", "table_names", "column_names_original", "column_names", "column_types"]
    unread = F.lit(True)
    for field in fields:
        unread = unread & F.col(field).isNull()
    listed = F.filter(
        F.array(*[F.when(bad, F.lit(name)) for name, bad in broken.items()]),
        lambda r: r.isNotNull(),
    )
    failed = F.when(unread, F.array(F.lit("unparsable"))).otherwise(listed)
    return parsed.select(key, F.explode(failed).alias("rule"))


def metadata_columns(parsed: DataFrame, key: str) -> DataFrame:
    """One row per real column of each document."""
    zipped = F.arrays_zip(
        F.col("column_names_original").alias("o"),
        F.col("column_names").alias("d"),
        F.col("column_types").alias("t"),
    )
    rows = parsed.select(
        key, "db_id", "table_names_original", "table_names", F.posexplode(zipped).alias("column_index", "c")
    ).where(F.col("column_index") > 0)
    at = _index(F.col("c.o"))
    return rows.select(
        key,
        "db_id",
        "column_index",
        at.alias("table_index"),
        _at("table_names_original", at).alias("table_name"),
        _at("table_names", at).alias("table_display"),
        F.col("c.o")[1].alias("column_name"),
        F.col("c.d")[1].alias("column_display"),
        F.col("c.t").alias("declared_type"),
    )


def metadata_primary_keys(parsed: DataFrame, key: str) -> DataFrame:
    """One row per key entry: its columns by name, and the rule it breaks, if any."""
    originals = F.col("column_names_original")
    rows = parsed.select(
        key, "db_id", "column_names_original", "table_names_original",
        F.posexplode("primary_keys").alias("key_ordinal", "columns"),
    )
    inside = F.forall("columns", lambda i: (i > 0) & (i < F.size(originals)))
    owners = F.array_distinct(
        F.transform("columns", lambda i: _at(originals, i)[0])
    )
    issue = (
        F.when(F.size("columns") == 0, "empty_key")
        .when(F.size(F.array_distinct("columns")) != F.size("columns"), "repeated_column")
        .when(~inside, "column_out_of_range")
        .when(F.size(owners) != 1, "columns_in_several_tables")
    )
    names = F.transform("columns", lambda i: _at(originals, i)[1])
    table = _at("table_names_original", F.try_element_at(owners, F.lit(1)).cast("int"))
    return rows.withColumn("issue", issue).select(
        key,
        "db_id",
        "key_ordinal",
        F.when(F.col("issue").isNull(), table).alias("table_name"),
        F.when(F.col("issue").isNull(), F.array_join(names, ",")).alias("key_columns"),
        "issue",
    )


def metadata_foreign_keys(parsed: DataFrame, key: str) -> DataFrame:
    """Resolved foreign keys, repeats dropped, and the rule a bad one breaks."""
    originals = F.col("column_names_original")
    names = F.col("table_names_original")

    def inside(i: Column) -> Column:
        return (i > 0) & (i < F.size(originals))

    def end(i: Column, role: str) -> list[Column]:
        column = _at(originals, i)
        table = _at(names, column[0].cast("int"))
        return [table.alias(f"{role}_table"), column[1].alias(f"{role}_column")]

    def resolve(pair: Column) -> Column:
        return F.struct(*end(pair[0], "source"), *end(pair[1], "target"))

    # A document holds its own keys, so repeats are found inside the row, without a shuffle.
    rows = parsed.select(
        key, "db_id", "column_names_original",
        F.transform("foreign_keys", resolve).alias("_ends"), "foreign_keys",
    ).select(
        key, "db_id", "column_names_original", "_ends",
        F.posexplode("foreign_keys").alias("key_ordinal", "pair"),
    )
    source, target = F.col("pair")[0], F.col("pair")[1]
    issue = (
        F.when(F.size("pair") != 2, "not_a_pair")
        .when(~inside(source), "source_out_of_range")
        .when(~inside(target), "target_out_of_range")
    )
    here = F.col("_ends")[F.col("key_ordinal")]
    first = F.array_position("_ends", here) == F.col("key_ordinal") + 1
    judged = rows.select(
        key, "db_id", "key_ordinal", here.alias("_end"), issue.alias("issue"), first.alias("_first")
    ).where(F.col("issue").isNotNull() | F.col("_first"))
    good = F.col("issue").isNull()
    ends = ["source_table", "source_column", "target_table", "target_column"]
    return judged.select(
        key, "db_id", *[F.when(good, F.col(f"_end.{e}")).alias(e) for e in ends], "key_ordinal", "issue"
    )


# ---- names -------------------------------------------------------------------------------


def duplicate_names(df: DataFrame, keys: Sequence[str], name: str, order: str) -> DataFrame:
    """Names used more than once, with the place of their second use."""
    second = top_per_group(
        df.select(*keys, name, order), [*keys, name], [F.col(order)], 2
    ).where(F.col("rank") == 2)
    return second.select(*keys, name, F.col(order).alias("second_use"))


def case_collisions(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct names that fall together when A-Z is folded."""
    names = df.select(*keys, name, text.ascii_fold(F.col(name)).alias("folded_name")).distinct()
    clashing = names.groupBy(*keys, "folded_name").agg(F.count("*").alias("spellings"))
    return names.join(clashing.where(F.col("spellings") > 1), [*keys, "folded_name"])


def match_names(catalog: DataFrame, live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, name, live_name, how): 'exact', then 'folded' where it is unique on both
    sides; leftovers come as 'missing_in_live' or 'missing_in_catalog'.

    Both sides meet in one grouping per name and one per folded name, whose names differ in case
    only. Null names and keys match nothing.
    """
    keys = list(keys)
    sides = catalog.select(*keys, "name", F.lit(True).alias("_ours")).unionByName(
        live.select(*keys, "name", F.lit(False).alias("_ours"))
    )
    known = F.col("name").isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    names = sides.groupBy(*keys, "name").agg(
        F.bool_or("_ours").alias("ours"), F.bool_or(~F.col("_ours")).alias("theirs")
    )
    folds = names.groupBy(*keys, text.ascii_fold(F.col("name")).alias("_fold")).agg(
        F.collect_list(F.struct("name", "ours", "theirs", known.alias("known"))).alias("_names")
    )
    none = F.lit(None).cast("string")

    def row(name: Column, live_name: Column, how: str) -> Column:
        return F.struct(name.alias("name"), live_name.alias("live_name"), F.lit(how).alias("how"))

    both = F.filter("_names", lambda n: n["ours"] & n["theirs"] & n["known"])
    # A null name that both sides have stands on each of them alone.
    ours = F.filter("_names", lambda n: n["ours"] & ~(n["theirs"] & n["known"]))
    theirs = F.filter("_names", lambda n: n["theirs"] & ~(n["ours"] & n["known"]))
    sorted_out = folds.select(*keys, both.alias("_both"), ours.alias("_ours"), theirs.alias("_theirs"))
    first_ours, first_theirs = F.get("_ours", F.lit(0)), F.get("_theirs", F.lit(0))
    pair = (F.size("_ours") == 1) & (F.size("_theirs") == 1) & first_ours["known"] & first_theirs["known"]
    rest = F.concat(
        F.transform("_ours", lambda n: row(n["name"], none, "missing_in_live")),
        F.transform("_theirs", lambda n: row(none, n["name"], "missing_in_catalog")),
    )
    matched = F.when(pair, F.array(row(first_ours["name"], first_theirs["name"], "folded"))).otherwise(rest)
    exact = F.transform("_both", lambda n: row(n["name"], n["name"], "exact"))
    return sorted_out.select(*keys, F.inline(F.concat(exact, matched)))


def apply_names(columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Catalog columns under their live spelling; ``mapping`` has db_id, table_name,
    column_name, live_table, live_column."""
    return (
        columns.join(mapping, ["db_id", "table_name", "column_name"])
        .withColumns({"table_name": F.col("live_table"), "column_name": F.col("live_column")})
        .drop("live_table", "live_column")
    )


def unmapped_names(columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """The columns that ``apply_names`` leaves out, as they have no live spelling."""
    names = ["db_id", "table_name", "column_name"]
    return columns.join(mapping, names, "left_anti").withColumn("issue", F.lit("unmapped_column"))


def apply_names_to_keys(foreign_keys: DataFrame, mapping: DataFrame) -> DataFrame:
    """Foreign keys under their live spelling, repeats dropped, first one kept."""
    def renamed(frame: DataFrame, role: str) -> DataFrame:
        names = mapping.select(
            "db_id",
            F.col("table_name").alias(f"{role}_table"),
            F.col("column_name").alias(f"{role}_column"),
            F.col("live_table").alias("_t"),
            F.col("live_column").alias("_c"),
        )
        return (
            frame.join(names, ["db_id", f"{role}_table", f"{role}_column"])
            .withColumns({f"{role}_table": F.col("_t"), f"{role}_column": F.col("_c")})
            .drop("_t", "_c")
        )

    both = renamed(renamed(foreign_keys, "source"), "target")
    ends = ["db_id", "source_table", "source_column", "target_table", "target_column"]
    return both.groupBy(*ends).agg(F.min("key_ordinal").alias("key_ordinal"))


# ---- live schemas, counts, search --------------------------------------------------------


def _type_name(dtype: T.DataType) -> str:
    return dtype.simpleString().upper()


def live_schema(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, declared_type, row_count) of live tables.

    Reads the schemas on the driver and counts the rows of every table as a job.
    """
    spark: SparkSession = next(iter(frames.values())).sparkSession
    fields = [
        (name, i, f.name, _type_name(f.dataType))
        for name, df in frames.items()
        for i, f in enumerate(df.schema.fields)
    ]
    schema = "table_name string, ordinal int, column_name string, declared_type string"
    counts = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return spark.createDataFrame(fields, schema).join(counts, "table_name")


def object_counts(columns: DataFrame) -> DataFrame:
    """Databases, tables and columns per split.

    Tables are reduced first, so the distinct counts see one row per table.
    """
    tables = columns.groupBy("split", "db_id", "table_name").agg(F.count("*").alias("_columns"))
    databases = tables.groupBy("split", "db_id").agg(
        F.count("*").alias("_tables"), F.sum("_columns").alias("_columns")
    )
    return databases.groupBy("split").agg(
        F.count("*").alias("databases"),
        F.sum("_tables").alias("tables"),
        F.sum("_columns").alias("columns"),
    )


def registry(columns: DataFrame, examples: DataFrame) -> DataFrame:
    """Public database list: split, table and column counts, number of example queries."""
    tables = columns.groupBy("split", "db_id", "table_name").agg(F.count("*").alias("_columns"))
    counts = tables.groupBy("split", "db_id").agg(
        F.count("*").alias("table_count"), F.sum("_columns").alias("column_count")
    )
    asked = examples.groupBy("db_id").agg(F.count("*").alias("example_count"))
    return counts.join(asked, "db_id", "left").withColumn(
        "example_count", F.coalesce("example_count", F.lit(0)).cast("bigint")
    )


def registry_examples(columns: DataFrame, examples: DataFrame) -> DataFrame:
    """Example queries of known databases, one row each; unknown ids are dropped."""
    known = columns.select("split", "db_id").distinct()
    return examples.select(
        "db_id", "question", F.coalesce("evidence", F.lit("")).alias("evidence")
    ).join(known, "db_id")


def search_tables(columns: DataFrame, needle: str) -> DataFrame:
    """Tables whose joined names, display names and types contain ``needle``.

    The columns of one table form one text, as a match may span two neighbours.
    """
    parts = F.concat_ws(" ", "column_name", "column_display", "declared_type")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", parts.alias("line"))))
    rendered = columns.groupBy("db_id", "table_name", "table_display").agg(
        F.array_join(F.transform(ordered, lambda c: c["line"]), " ").alias("_columns")
    )
    whole = F.concat_ws(" ", "table_name", "table_display", "_columns")
    return rendered.where(F.contains(F.lower(whole), F.lit(needle.lower()))).drop("_columns")


def search_databases(columns: DataFrame, needle: str) -> DataFrame:
    ids = columns.select("db_id").distinct()
    return ids.where(F.contains(F.lower("db_id"), F.lit(needle.lower())))


def integrity_issues(
    columns: DataFrame, foreign_keys: DataFrame, primary_keys: DataFrame | None = None
) -> DataFrame:
    """(db_id, issue, name): repeated columns, blank names, broken or repeated keys.

    ``primary_keys`` (db_id, table_name, column_name) is given when keys are kept apart from
    the columns.
    """
    place = ["db_id", "table_name", "column_name"]

    def tagged(at: DataFrame, tag: str, table: str, column: str, blank: Column) -> DataFrame:
        return at.select(
            "db_id", F.col(table).alias("table_name"), F.col(column).alias("column_name"),
            F.lit(tag).alias("_tag"), blank.alias("_blank"),
        )

    no = F.lit(False)
    empty = (text.strip(F.col("column_name")) == "") | (text.strip(F.col("declared_type")) == "")
    rows = tagged(columns, "column", "table_name", "column_name", F.coalesce(empty, no))
    roles = ["source", "target"]
    for role in roles:
        rows = rows.unionByName(tagged(foreign_keys, role, f"{role}_table", f"{role}_column", no))
    if primary_keys is not None:
        rows = rows.unionByName(tagged(primary_keys, "primary_key", "table_name", "column_name", no))
        roles.append("primary_key")
    # Columns and what refers to them meet in one grouping; null names refer to nothing.
    met = rows.groupBy(*place).agg(
        F.count_if(F.col("_tag") == "column").alias("column"), F.count_if("_blank").alias("blank"),
        *[F.count_if(F.col("_tag") == role).alias(role) for role in roles],
    )
    full = F.concat_ws(".", "table_name", "column_name")
    named = F.col("db_id").isNotNull() & F.col("table_name").isNotNull() & F.col("column_name").isNotNull()
    unknown = (F.col("column") == 0) | ~named

    def issue(name: str, what: Column, times: Column) -> Column:
        return F.array_repeat(F.struct(F.lit(name).alias("issue"), what.alias("name")), times.cast("int"))

    found = F.concat(
        issue("blank_name_or_type", F.col("table_name"), F.col("blank")),
        issue("duplicate_column", full, F.when(F.col("column") > 1, 1).otherwise(0)),
        *[issue(f"{role}_does_not_exist", full, F.when(unknown, F.col(role)).otherwise(0)) for role in roles],
    )
    ends = ["db_id", "source_table", "source_column", "target_table", "target_column"]
    twice = (
        foreign_keys.groupBy(*ends)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
        .select(
            "db_id",
            F.lit("duplicate_foreign_key").alias("issue"),
            F.concat_ws(".", "source_table", "source_column").alias("name"),
        )
    )
    return met.select("db_id", F.inline(found)).unionByName(twice)


# ---- rendering ---------------------------------------------------------------------------


def _with_display(head: Column, name: str, display: str) -> Column:
    shown = F.col(display)
    differs = shown.isNotNull() & (shown != "") & (shown != F.col(name))
    return F.concat(head, F.when(differs, F.concat(F.lit(" -- "), text.one_line(shown))).otherwise(""))


def _in_order(order: Sequence[str], line: str) -> Column:
    """Lines of a group joined in the order of ``order``."""
    items = F.array_sort(F.collect_list(F.struct(*order, line)))
    return F.transform(items, lambda i: i[line])


def render(columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """(db_id, schema): one text per database.

    Lines are gathered per table first and per database last: the text of a database is one
    value, so its lines have to meet, but each step only carries finished lines.
    """
    primary = F.col("is_primary_key")
    keys_sql = F.count_if(primary)
    counted = columns.groupBy("db_id", "table_ordinal", "table_name", "table_display").agg(
        keys_sql.alias("_keys"),
        F.array_sort(
            F.collect_list(
                F.struct("ordinal", "column_name", "column_display", "declared_type", primary.alias("pk"))
            )
        ).alias("_cols"),
    )

    def line(c: Column) -> Column:
        only = (F.col("_keys") == 1) & c["pk"]
        differs = c["column_display"].isNotNull() & (c["column_display"] != "") & (
            c["column_display"] != c["column_name"]
        )
        return F.concat(
            F.lit("- "),
            text.quote_identifier(c["column_name"]),
            F.lit(" "),
            F.upper(c["declared_type"]),
            F.when(only, F.lit(" [PRIMARY KEY]")).otherwise(""),
            F.when(differs, F.concat(F.lit(" -- "), text.one_line(c["column_display"]))).otherwise(""),
        )

    header = _with_display(
        F.concat(F.lit("TABLE "), text.quote_identifier(F.col("table_name"))),
        "table_name",
        "table_display",
    )
    key_names = F.transform(
        F.filter("_cols", lambda c: c["pk"]), lambda c: text.quote_identifier(c["column_name"])
    )
    composite = F.when(
        F.col("_keys") > 1, F.concat(F.lit("PRIMARY KEY ("), F.array_join(key_names, ", "), F.lit(")"))
    )
    tables = counted.select(
        "db_id",
        F.lit(0).alias("part"),
        F.col("table_ordinal").cast("bigint").alias("place"),
        F.concat_ws("\n", header, F.array_join(F.transform("_cols", line), "\n"), composite).alias(
            "section"
        ),
    )
    arrow = F.concat(
        text.quote_identifier(F.col("source_table")), F.lit("."),
        text.quote_identifier(F.col("source_column")), F.lit(" -> "),
        text.quote_identifier(F.col("target_table")), F.lit("."),
        text.quote_identifier(F.col("target_column")),
    )
    keys = (
        foreign_keys.withColumn("line", arrow)
        .groupBy("db_id")
        .agg(F.array_join(_in_order(["table_ordinal", "key_ordinal"], "line"), "\n").alias("_lines"))
        .select(
            "db_id",
            F.lit(1).alias("part"),
            F.lit(0).cast("bigint").alias("place"),
            F.concat(F.lit("FOREIGN KEY\n"), "_lines").alias("section"),
        )
    )
    return (
        tables.unionByName(keys)
        .groupBy("db_id")
        .agg(F.array_join(_in_order(["part", "place"], "section"), "\n\n").alias("schema"))
    )


# ---- descriptions ------------------------------------------------------------------------

# Table names whose description file is spelt differently.
DESCRIPTION_ALIASES = {("student_loan", "filed_for_bankrupcy"): "filed_for_bankruptcy"}


def _file_stem() -> Column:
    stem = F.col("table_name")
    for (db, table), alias in DESCRIPTION_ALIASES.items():
        stem = F.when((F.col("db_id") == db) & (F.col("table_name") == table), alias).otherwise(stem)
    return text.casefold(stem)


def _choices(tables: Column) -> Column:
    """Tables in order, each with its (score, file) candidates, folded into (table, file, ties): the
    files taken so far are the state, and a table takes the best free one if it is alone."""

    def step(state: Column, table: Column) -> Column:
        free = F.filter(table["candidates"], lambda c: ~F.array_contains(state["used"], c["file"]))
        best = F.filter(free, lambda c: c["score"] == F.array_max(F.transform(free, lambda x: x["score"])))
        file = F.when(F.size(best) == 1, F.get(best, F.lit(0))["file"])
        taken = F.when(file.isNotNull(), F.array(file)).otherwise(F.array().cast("array<string>"))
        row = F.struct(table["table_name"].alias("table_name"), file.alias("file"), F.size(best).alias("ties"))
        return F.struct(
            F.concat(state["used"], taken).alias("used"), F.concat(state["rows"], F.array(row)).alias("rows")
        )

    start = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.array().cast("array<struct<table_name:string,file:string,ties:int>>").alias("rows"),
    )
    return F.aggregate(tables, start, step, lambda state: state["rows"])


def description_choices(columns: DataFrame, described: DataFrame) -> DataFrame:
    """(db_id, table_name, file, how) for every table: how is 'name', 'overlap', or, without a file,
    'ambiguous' (several free files share most column names) or 'no_match'.

    ``columns`` is the catalog; ``described`` has db_id, file and original_column_name. A file whose
    name equals the table's wins. The other tables take, in table order, the unused file that shares
    most column names, if that file is unique. Since a choice depends on those before it, the open
    tables of one database and their candidates are one value.
    """
    with shuffles_freed(columns.sparkSession):
        names = F.collect_set(text.casefold(F.col("column_name"))).alias("_columns")
        tables = cut(columns.groupBy("db_id", "table_name").agg(F.min("table_ordinal").alias("table_ordinal"), names))
        texts = F.collect_set(text.casefold(F.col("original_column_name"))).alias("_columns")
        files = cut(described.groupBy("db_id", "file").agg(texts))
        named = tables.select("db_id", "table_name", "table_ordinal", _file_stem().alias("_stem")).join(
            files.select("db_id", "file", text.casefold(F.col("file")).alias("_stem")), ["db_id", "_stem"]
        )
        single = named.groupBy("db_id", "table_name", "table_ordinal").agg(
            F.count("*").alias("_n"), F.min("file").alias("file")
        )
        exact = cut(
            single.where(F.col("_n") == 1)
            .groupBy("db_id", "file")
            .agg(F.min_by("table_name", "table_ordinal").alias("table_name"))
            .select("db_id", "table_name", "file", F.lit("name").alias("how"))
        )
        open_tables = cut(tables.join(exact, ["db_id", "table_name"], "left_anti"))
        discard(tables)
        open_files = cut(files.join(exact, ["db_id", "file"], "left_anti"))
        discard(files)
        wanted = open_tables.select("db_id", "table_name", "table_ordinal", F.explode("_columns").alias("_column"))
        offered = open_files.select("db_id", "file", F.explode("_columns").alias("_column")).where(F.col("_column") != "")
        scores = wanted.join(offered, ["db_id", "_column"]).groupBy("db_id", "table_name", "table_ordinal", "file").agg(
            F.count("*").alias("score")
        )
        candidates = scores.groupBy("db_id", "table_name", "table_ordinal").agg(
            F.collect_list(F.struct("score", "file")).alias("candidates")
        )
        in_order = candidates.groupBy("db_id").agg(
            F.sort_array(F.collect_list(F.struct("table_ordinal", "table_name", "candidates"))).alias("_tables")
        )
        chosen = in_order.select("db_id", F.inline(_choices(F.col("_tables"))))
        missed = F.when(F.col("ties") > 1, "ambiguous").otherwise("no_match")
        rest = cut(
            open_tables.drop("_columns").join(chosen, ["db_id", "table_name"], "left").select(
                "db_id", "table_name", "file", F.when(F.col("file").isNotNull(), "overlap").otherwise(missed).alias("how")
            )
        )
        discard(open_tables, open_files)
    return exact.unionByName(rest)


def map_description_files(columns: DataFrame, described: DataFrame) -> DataFrame:
    """``description_choices`` of the tables that get a file."""
    return description_choices(columns, described).where(F.col("file").isNotNull())


DESCRIPTION_FIELDS = ["column_description", "value_description", "data_format"]


#: Columns of a catalog that are matched in one go; a larger one is taken in so many slices of its databases.
AT_ONCE, SLICES = 1_000_000, 4


def column_descriptions(
    columns: DataFrame, mapping: DataFrame, described: DataFrame
) -> DataFrame:
    """Catalog columns with their descriptions; the last row of a repeated name counts.

    A table has one file at most in ``mapping``. Its columns and the rows of that file are shuffled
    once, as lists, and matched where they meet. A large catalog is taken slice by slice, so that
    the shuffle files of one slice are gone before the next begins.
    """
    found = []
    with shuffles_freed(columns.sparkSession):
        slices = SLICES if columns.count() > AT_ONCE else 1
        for n in range(slices):
            some = [t.where(F.pmod(F.xxhash64("db_id"), F.lit(slices)) == n) if slices > 1 else t for t in (columns, mapping, described)]
            placed = cut(_placed(*some[:2]))
            rows = _matched(placed, some[2])
            if slices > 1:
                rows = cut(rows)
                discard(placed)
            found.append(rows)
    return reduce(DataFrame.unionByName, found)


def _placed(columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """The columns with the ``file`` of their table."""
    files = mapping.select("db_id", "table_name", "file")
    return columns.join(files, ["db_id", "table_name"], "left").select(*columns.columns, "file")


def _matched(placed: DataFrame, described: DataFrame) -> DataFrame:
    own = [c for c in placed.columns if c != "file"]
    blank = placed.where("file IS NULL").select(*own, *(F.lit("").alias(f) for f in DESCRIPTION_FIELDS))
    asked = placed.where("file IS NOT NULL").select(
        "db_id", "file", F.struct(*(c for c in own if c != "db_id")).alias("_own"), F.lit(None).alias("_told")
    )
    given = described.where((F.col("original_column_name") != "") & F.col("db_id").isNotNull() & F.col("file").isNotNull()).select(
        "db_id", "file", F.lit(None).alias("_own"),
        F.struct(F.col("original_column_name").alias("column_name"), "row_ordinal", *DESCRIPTION_FIELDS).alias("_told"),
    )
    met = asked.unionByName(given).groupBy("db_id", "file").agg(
        F.collect_list("_own").alias("_owns"), F.collect_list("_told").alias("_tolds")
    )
    # Both go through one list, each with the other's field as null.
    own_kind, told_kind = asked.schema["_own"].dataType, given.schema["_told"].dataType

    def item(row: Column, has: str) -> Column:
        return F.struct(
            text.casefold(row["column_name"]).alias("_name"),
            *((row if name == has else F.lit(None).cast(kind)).alias(name) for name, kind in (("_own", own_kind), ("_told", told_kind))),
        )

    both = F.concat(F.transform("_owns", lambda r: item(r, "_own")), F.transform("_tolds", lambda r: item(r, "_told")))
    return (
        met.where(F.size("_owns") > 0).select("db_id", "file", F.inline(both))
        .groupBy("db_id", "file", "_name")
        .agg(F.collect_list("_own").alias("_owns"), F.max_by("_told", "_told.row_ordinal").alias("_last"))
        .select("db_id", "_last", F.inline("_owns"))
        .select(*own, *(F.coalesce(F.col("_last")[f], F.lit("")).alias(f) for f in DESCRIPTION_FIELDS))
        .unionByName(blank)
    )
