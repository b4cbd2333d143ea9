"""A stored positional index of column texts, and exact BM25 retrieval from it.

The index is a folder of tables partitioned by split and db_id, so that a question reads its own
database only and a changed database is written alone:

- ``rows``: what a row of the index stands for (table, column, kind, value);
- ``postings``: term, row, length of the row, and the sorted positions of the term in it;
- ``terms``: per term the rows that hold it, its largest count, its shortest row, and occurrences;
- ``state``: one numbered version after another of the databases' fingerprints and sizes.

Every row carries the number of the refresh that wrote it, and the state the number that counts for
each database, so nothing is read of a refresh that broke off or of rows that lost their partition.

A phrase matches where its tokens stand next to each other. The best rows of a question are found
with bounds from ``terms``: the rarest terms first give a score that the n-th row reaches for sure;
terms that together cannot reach it are only added to rows that can.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..session import cut
from .index import BM25_B, BM25_K1, HIT_SCORE_DIGITS, IDF_FLOOR
from .ranks import top_per_group

DATABASE = ["split", "db_id"]
#: Bounds are sums of doubles in another order than the scores they bound.
SLACK = 1e-6
#: Pairs of a query and a row that one task scores, if every row of a database meets its queries.
PAIRS = 1 << 20
#: Rows of query terms up to which they are sent to every task.
SMALL_QUERIES = 1 << 20
#: Rows of a file of the index rows. What a task reads to make postings is packed from whole files.
FILE_ROWS = 4000
#: Tokens whose postings are made at once.
BATCH_TOKENS = 200_000

_PLACE = "written_by bigint, split string, db_id string"
_ROWS = "row_id string, table_name string, column_name string, row_kind string, value string, search_text string"
_POSTINGS = "term string, row_id string, row_length int, tf int, positions array<int>"
_TERMS = "term string, df bigint, max_tf int, min_length int, occurrences bigint"
_STATE = f"fingerprint string, row_count bigint, token_count bigint, {_PLACE}"


def fingerprints(source: DataFrame) -> DataFrame:
    """One row per database: split, db_id and a fingerprint of its rows in any order.

    Two sums of 64-bit hashes of each row and the number of rows; a copy more or less counts.
    """
    row = [F.col(f"`{c}`") for c in sorted(source.columns)]
    first, second = F.xxhash64(F.lit(1), *row), F.xxhash64(F.lit(2), *row)
    return source.groupBy(*DATABASE).agg(
        F.concat_ws(
            "/", F.count("*").cast("string"),
            F.sum(first.cast("decimal(38,0)")).cast("string"), F.sum(second.cast("decimal(38,0)")).cast("string"),
        ).alias("fingerprint")
    )


class StoredIndex:
    """The tables of one index folder; the folder may not exist before the first ``refresh``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _table(self, name: str, schema: str, state: DataFrame | None = None) -> DataFrame:
        """Rows of databases that the last state (or the given one) knows."""
        live = (self.state() if state is None else state).select(*DATABASE, "written_by")
        whole = self._read(name, f"{schema}, {_PLACE}")
        return whole.join(live, [*DATABASE, "written_by"], "left_semi").drop("written_by")

    def rows(self) -> DataFrame:
        """search_text is null where it is the value."""
        return self._table("rows", _ROWS)

    def postings(self) -> DataFrame:
        return self._table("postings", _POSTINGS)

    def terms(self) -> DataFrame:
        return self._table("terms", _TERMS)

    def version(self) -> int:
        """Number of the last complete refresh; 0 before the first. Taken from the folder's names."""
        if not self._exists("state"):
            return 0
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("version=")]
        whole = [n for n in names if any(f.getPath().getName().endswith(".parquet") for f in system.listStatus(n))]
        return max((int(n.getName().removeprefix("version=")) for n in whole), default=0)

    def state(self) -> DataFrame:
        """fingerprint, row_count, token_count, written_by, split and db_id of the databases, as of the
        last complete refresh."""
        number = self.version()
        if not number:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/state/version={number}")

    def _write(self, df: DataFrame, name: str, number: int, *order: str, deal: bool = True, file_rows: int = 0) -> None:
        """Replaces the partitions that ``df`` has rows of. ``deal`` splits partitions of a large
        database and puts small ones together before writing, as their measured sizes ask.
        ``file_rows``: rows after which a task begins a new file; 0 for no limit."""
        dealt = df.withColumn("written_by", F.lit(number).cast("bigint"))
        if deal:
            dealt = dealt.hint("rebalance", *[F.col(c) for c in DATABASE])
        dealt.sortWithinPartitions(*DATABASE, *order).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).option("maxRecordsPerFile", file_rows).partitionBy(*DATABASE).parquet(f"{self.path}/{name}")

    def refresh(self, source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Bring the index up to ``source``; returns split, db_id of the databases written anew.

        ``source`` has split, db_id (neither null nor empty) and whatever ``build`` needs to make
        the index rows of some databases: split, db_id, row_id, table_name, column_name, row_kind,
        value and search_text. Only databases whose rows differ from the last refresh are built and
        written; databases no longer in ``source`` leave the index. The new state is written last,
        so a refresh that broke off is done again. One refresh runs at a time.
        """
        before, version = self.state(), self.version()
        known = before.select(*DATABASE, F.col("fingerprint").alias("_known"))
        differing = cut(
            fingerprints(source).join(known, DATABASE, "full_outer").where(~F.col("fingerprint").eqNullSafe(F.col("_known")))
        )
        changed = differing.where(F.col("fingerprint").isNotNull()).select(*DATABASE)
        if version and differing.isEmpty():
            return changed
        number = version + 1
        mine = changed.withColumn("written_by", F.lit(number).cast("bigint"))
        made = build(source.join(changed, DATABASE, "left_semi"))
        # Most rows are searched by their value, which is not stored twice.
        self._write(made.withColumn("search_text", F.nullif("search_text", "value")), "rows", number, "row_id", file_rows=FILE_ROWS)
        rows = self._table("rows", _ROWS, mine).withColumn("search_text", F.coalesce("search_text", "value"))
        # The rows lie by database already, in files of a fitting size: their postings stay with them,
        # in the order of their rows. Sorting them by term would cost more than all other steps.
        self._write(positions(rows, [*DATABASE, "row_id"]), "postings", number, deal=False)
        postings = self._table("postings", _POSTINGS, mine)
        terms = postings.groupBy(*DATABASE, "term").agg(
            F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("row_length").alias("min_length"),
            F.sum("tf").alias("occurrences"),
        )
        self._write(terms, "terms", number, "term")
        counts = rows.groupBy(*DATABASE).agg(F.count("*").alias("row_count"))
        tokens = self._table("terms", _TERMS, mine).groupBy(*DATABASE).agg(F.sum("occurrences").alias("token_count"))
        new = (
            differing.drop("_known").join(mine, DATABASE)
            .join(counts, DATABASE, "left").join(tokens, DATABASE, "left").fillna(0, ["row_count", "token_count"])
        )
        state = before.join(differing, DATABASE, "left_anti").unionByName(new)
        state.select(*StructType.fromDDL(_STATE).names).write.parquet(f"{self.path}/state/version={number}")
        return changed


def positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, row_length, tf, positions): the terms of each row's search_text and where they
    stand, from 0. Spark cuts the tokens; they are parted inside the row, so nothing is shuffled."""
    kinds = dict(rows.dtypes)

    # By value, so that executors need not have this package.
    def part(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(len(keys))), 0).to_pylist()
            start = 0
            while start < len(sizes):
                end, held = start, 0
                while end < len(sizes) and held < most:
                    held, end = held + sizes[end], end + 1
                piece = batch.slice(start, end - start)
                length = np.array(sizes[start:end], np.int64)
                of = np.repeat(np.arange(end - start), length)
                place = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
                coded = piece.column(len(keys)).flatten().dictionary_encode()
                code = coded.indices.to_numpy()
                both = of * max(1, len(coded.dictionary)) + code
                # Stable, so that the places of a term stay sorted.
                order = np.argsort(both, kind="stable")
                first = np.flatnonzero(np.diff(both[order], prepend=-1))
                heads = order[first]
                taken = pa.array(of[heads])
                bounds = np.append(first, len(of))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[piece.column(i).take(taken) for i in range(len(keys))],
                        coded.dictionary.take(pa.array(code[heads])).cast(pa.string()),
                        pa.array(length[of[heads]].astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(place[order].astype(np.int32))),
                    ],
                    [*keys, "term", "row_length", "tf", "positions"],
                )
                start = end

    most = BATCH_TOKENS
    tokens = rows.select(*keys, text.search_tokens(F.col("search_text")).alias("_tokens"))
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "term string, row_length int, tf int, positions array<int>"
    # No filter here: Spark would move it below and cut every text twice.
    return tokens.mapInArrow(part, schema)


# --- phrases ------------------------------------------------------------------------------------


def question_phrases(questions: DataFrame, key: str) -> DataFrame:
    """(key, split, db_id, term, phrase): one row per search term of a question; ``phrase`` is its
    tokens, joined by blanks, which have to stand next to each other."""
    found = F.explode(text.query_phrases(F.col("question"), F.coalesce("evidence", F.lit(""))))
    return questions.select(key, *DATABASE, found.alias("_found")).select(
        key, *DATABASE, "_found.term", F.array_join("_found.tokens", " ").alias("phrase")
    )


def phrase_postings(stored: StoredIndex, phrases: DataFrame) -> DataFrame:
    """(split, db_id, row_id, row_length, phrase, tf) of phrases of two tokens and more, over all
    databases: rows of the rarest token first, the others' positions only for these."""
    row = [*DATABASE, "row_id"]
    parts = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("_offset", "term"))
    wanted = parts.select("term").distinct()
    held = cut(stored.postings().join(wanted, "term", "left_semi"))
    rows_of = held.groupBy("term").agg(F.count("*").alias("_rows"))
    rated = parts.join(rows_of, "term", "left")
    rarest = rated.groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("_rows", F.lit(0)).alias("_rows"), "_offset", "term")).alias("_rare"),
        F.count("*").alias("_parts"),
    )
    shifted = F.transform("positions", lambda p: p - F.col("_offset"))
    anchors = rarest.select("phrase", "_parts", "_rare._offset", "_rare.term").join(held, "term").select(
        "phrase", "_parts", "_offset", *row, "row_length", shifted.alias("_starts")
    )
    others = anchors.select("phrase", *row, F.col("_offset").alias("_anchor")).join(parts, "phrase")
    found = others.where("_offset <> _anchor").join(held, [*row, "term"]).select(
        "phrase", *row, shifted.alias("_starts")
    )
    met = found.groupBy("phrase", *row).agg(F.collect_list("_starts").alias("_all"))
    starts = F.aggregate("_all", F.col("_starts"), lambda a, x: F.array_intersect(a, x))
    return (
        anchors.join(met, ["phrase", *row])
        .where(F.size("_all") == F.col("_parts") - 1)
        .withColumn("tf", F.size(starts))
        .where("tf > 0")
        .select(*row, "row_length", "phrase", "tf")
    )


# --- ranking ------------------------------------------------------------------------------------


def _saturated(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def best_rows(phrases: DataFrame, stored: StoredIndex, key: str, n: int) -> DataFrame:
    """Best ``n`` index rows per question: (key, row_id, score, hit_rank).

    ``phrases`` comes from ``question_phrases``; a phrase that a question asks in two spellings
    counts twice. Statistics cover the whole index, matches stay inside the question's database.
    Scores are negated, so smaller is better, and rounded so that the order of a distributed sum
    does not change the ranking; ties go to the smaller row_id. Questions that ask the same of the
    same database are scored once.
    """
    group = F.array_sort(F.collect_list("phrase"))
    asked = phrases.groupBy(key, *DATABASE).agg(group.alias("_phrases"))
    unlike = asked.groupBy(*DATABASE, "_phrases").agg(F.min(key).alias("_query"))
    members = asked.join(unlike, [*DATABASE, "_phrases"]).select(key, "_query")
    queries = cut(
        unlike.select("_query", *DATABASE, F.explode("_phrases").alias("phrase"))
        .groupBy("_query", *DATABASE, "phrase").agg(F.count("*").alias("_times"))
    )
    scored = scored_rows(queries, stored, n)
    order = [F.col("score"), F.col("row_id")]
    ranked = top_per_group(scored, ["_query"], order, n, "hit_rank")
    return members.join(ranked, "_query").select(key, "row_id", "score", "hit_rank")


def _matches(queries: DataFrame, stored: StoredIndex) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of the asked phrases: (split, db_id, row_id, row_length, phrase, tf)
    inside the databases that ask, of phrases of several tokens everywhere, and (split, db_id,
    phrase, df, max_tf, min_length) everywhere."""
    asked = queries.select("phrase").distinct()
    several = F.contains("phrase", F.lit(" "))
    inside = queries.where(~several).select(*DATABASE, "phrase").distinct()
    short = stored.postings().select(*DATABASE, "row_id", "row_length", F.col("term").alias("phrase"), "tf")
    postings = cut(
        short.join(inside, [*DATABASE, "phrase"], "left_semi").unionByName(phrase_postings(stored, asked.where(several)))
    )
    known = stored.terms().withColumnRenamed("term", "phrase").drop("occurrences")
    counted = postings.where(several).groupBy(*DATABASE, "phrase").agg(
        F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("row_length").alias("min_length")
    )
    return postings, known.join(asked.where(~several), "phrase", "left_semi").unionByName(counted)


def _by_row(postings: DataFrame, queries: DataFrame, state: DataFrame) -> DataFrame:
    """Postings dealt by row, so that the sums over the terms of a query and a row need no shuffle of
    their own; as many parts as the pairs of queries and rows ask."""
    asking = queries.groupBy(*DATABASE).agg(F.count_distinct("_query").alias("_asking"))
    pairs = state.join(asking, DATABASE).agg(F.sum(F.col("row_count") * F.col("_asking"))).first()[0] or 0
    return postings.repartition(max(1, -(-pairs // PAIRS)), *DATABASE, "row_id")


def scored_rows(queries: DataFrame, stored: StoredIndex, n: int) -> DataFrame:
    """(_query, row_id, score) of every row that can be among the ``n`` best of its query.

    A row's postings lie in one task and the terms of the queries, unless they are many, are sent
    there: what leaves a task are sums, at most ``n`` of a query."""
    row = ["_query", *DATABASE, "row_id"]
    found, statistics = _matches(queries, stored)
    postings = _by_row(found, queries, stored.state())
    few = queries.count() <= SMALL_QUERIES

    def sent(terms: DataFrame) -> DataFrame:
        return F.broadcast(terms) if few else terms

    sizes = stored.state().agg(F.sum("row_count").alias("n"), F.sum("token_count").alias("l")).first()
    rows_in_all, mean = F.lit(float(sizes["n"] or 0)), F.lit(float(sizes["l"] or 0) / max(sizes["n"] or 0, 1))
    everywhere = statistics.groupBy("phrase").agg(F.sum("df").alias("_rows"))
    idf = F.log((rows_in_all - F.col("_rows") + 0.5) / (F.col("_rows") + 0.5))
    weights = everywhere.select("phrase", F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("_idf"))
    terms = queries.join(statistics, [*DATABASE, "phrase"]).join(weights, "phrase").withColumn(
        "_weight", F.col("_times") * F.col("_idf")
    )
    terms = terms.withColumn("_most", F.col("_weight") * _saturated(F.col("max_tf"), F.col("min_length"), mean))
    part = F.col("_weight") * _saturated(F.col("tf"), F.col("row_length"), mean)

    # A score that the n-th row reaches for sure, from the rarest terms whose rows number n.
    rare = Window.partitionBy("_query").orderBy("df", "phrase")
    lead = cut(terms.withColumn("_before", F.sum("df").over(rare) - F.col("df")))
    sure = (
        postings.join(sent(lead.where(F.col("_before") < n)), [*DATABASE, "phrase"])
        .groupBy(*row).agg(F.sum(part).alias("_sure"))
    )
    place = F.row_number().over(Window.partitionBy("_query").orderBy(F.col("_sure").desc()))
    edge = sure.withColumn("_place", place).where(F.col("_place") <= n).where(F.col("_place") == n)
    edge = edge.select("_query", (F.col("_sure") - SLACK).alias("_edge"))

    # The terms that together stay below it add to rows that others have brought in.
    weak = Window.partitionBy("_query").orderBy("_most", "phrase")
    judged = cut(
        lead.join(edge, "_query", "left")
        .withColumn("_upto", F.sum("_most").over(weak))
        .withColumn("_extra", F.coalesce(F.col("_upto") < F.col("_edge"), F.lit(False)))
    )
    slack = judged.groupBy("_query").agg(
        F.coalesce(F.max(F.when(F.col("_extra"), F.col("_upto"))), F.lit(0.0)).alias("_slack"),
        F.coalesce(F.max("_edge"), F.lit(0.0)).alias("_edge"),
    )
    main = postings.join(sent(judged.where(~F.col("_extra"))), [*DATABASE, "phrase"]).groupBy(*row).agg(
        F.sum(part).alias("_main")
    )
    able = cut(
        main.join(sent(slack), "_query").where(F.col("_main") + F.col("_slack") >= F.col("_edge")).drop("_slack", "_edge")
    )
    extra = judged.where("_extra").select("_query", "phrase", "_weight")
    added = able.select("_query", *DATABASE, "row_id").join(extra, "_query").join(
        found, [*DATABASE, "row_id", "phrase"]
    ).groupBy("_query", "row_id").agg(F.sum(part).alias("_more"))
    total = F.col("_main") + F.coalesce("_more", F.lit(0.0))
    return able.join(added, ["_query", "row_id"], "left").select(
        "_query", "row_id", F.round(-total, HIT_SCORE_DIGITS).alias("score")
    )
