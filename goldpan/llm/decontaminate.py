"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of ten words (a shorter item is one window). A window is a set
of (position, shingle of up to three words). Shingles are ordered by rarity over all documents;
since a window must be contained whole, its rarest shingle alone is its necessary prefix. Places of
that shingle in the documents are the candidates; the window must fit between the first and the
last word (positional and length bounds), and then every shingle of the window must stand at its
place, which holds exactly when the document has the ten words there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Words: runs of ASCII letters and digits and of all characters above ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
SHINGLE = 3
#: A table of benchmark shingles up to this many bytes is sent to every task.
BROADCAST_BYTES = 32 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. ``lower`` does just that to an ASCII text, faster."""
    ascii_ = F.length(text) == F.octet_length(text)
    return F.when(ascii_, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(lower_ascii(text), F.lit("")), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(window_id, item) and (window_id, offset, length, shingle). Equal windows are one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("_w"))
    cuts = (
        items.where(F.size("_w") > 0)
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - window, F.lit(0)))))
        .select("item", F.slice("_w", F.col("_at") + 1, F.lit(window)).alias("_words"))
        .withColumn("window_id", F.md5(F.array_join("_words", " ")))
    )
    owners = cuts.select("window_id", "item").distinct()
    grams = (
        cuts.dropDuplicates(["window_id"])
        .select("window_id", F.size("_words").alias("length"), F.posexplode(_shingles(F.col("_words"), shingle)))
        # Windows shorter than a shingle have one shingle, the whole window.
        .where(F.col("pos") <= F.greatest(F.col("length") - shingle, F.lit(0)))
        .select("window_id", F.col("pos").alias("offset"), "length", F.col("col").alias("shingle"))
    )
    return owners, grams


def _shingles(words: Column, shingle: int) -> Column:
    """The shingle that starts at each word; the last ones are shorter."""
    return F.transform(
        words,
        lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, shingle)]),
    )


def _small_shingles(grams: DataFrame, shingle: int) -> DataFrame:
    """Distinct (shingle, words in it) of the benchmark."""
    size = F.least("length", F.lit(shingle))
    return grams.select("shingle", size.alias("_size")).distinct()


def occurrences(docs: DataFrame, grams: DataFrame, shingle: int) -> DataFrame:
    """(key, n_words, position, shingle): every place of a benchmark shingle in a text.

    ``key`` is a digest of the text, so copies give the same rows, which become one.
    """
    known = written(_small_shingles(grams, shingle), "shingles")
    kinds = sorted(r["_size"] for r in known.select("_size").distinct().collect())  # 3 at most
    weight = known.agg(F.sum(F.octet_length("shingle") + 64)).first()[0] or 0
    texts = docs.where(F.col("text").isNotNull()).select("text")
    placed = None
    for size in kinds:
        wanted = known.where(F.col("_size") == size).select("shingle")
        if weight <= BROADCAST_BYTES:
            wanted = F.broadcast(wanted)
        grown = (
            texts.select(F.md5("text").alias("key"), words_of(F.col("text")).alias("_w"))
            .select("key", F.size("_w").alias("n_words"), F.posexplode(_shingles(F.col("_w"), size)))
            .select("key", "n_words", F.col("pos").alias("position"), F.col("col").alias("shingle"))
            .where(F.col("position") <= F.col("n_words") - size)
            .join(wanted, "shingle")
        )
        placed = grown if placed is None else placed.unionAll(grown)
    if placed is None:
        spark = docs.sparkSession
        return spark.createDataFrame([], "shingle string, key string, n_words int, position int")
    return placed.distinct()


def matches(docs: DataFrame, grams: DataFrame, shingle: int) -> DataFrame:
    """(key, start, length, window_id): every occurrence of a window in a distinct text."""
    grams = written(grams, "windows")
    found = written(occurrences(docs, grams, shingle), "places")
    rarity = found.groupBy("shingle").agg(F.count("*").alias("_rows"))
    # A window with a shingle that no text has cannot occur.
    complete = (
        grams.join(rarity, "shingle", "left")
        .groupBy("window_id", "length")
        .agg(
            F.min(F.struct("_rows", "shingle", "offset")).alias("_rarest"),
            F.count("*").alias("_shingles"), F.count("_rows").alias("_known"),
        )
        .where("_known = _shingles")
    )
    prefix = complete.select(
        "window_id", "length", "_shingles", F.col("_rarest.shingle").alias("shingle"),
        F.col("_rarest.offset").alias("_offset"),
    )
    candidates = (
        found.join(prefix, "shingle")
        .withColumn("start", F.col("position") - F.col("_offset"))
        .where("start >= 0 and start + length <= n_words")
        .select("key", "start", "window_id", "length", "_shingles")
    )
    asked = candidates.join(
        grams.select("window_id", "offset", "shingle"), "window_id"
    ).withColumn("position", F.col("start") + F.col("offset"))
    return (
        asked.join(found.select("key", "position", "shingle"), ["key", "position", "shingle"])
        .groupBy("key", "start", "window_id", "length", "_shingles")
        .agg(F.count("*").alias("_met"))
        .where("_met = _shingles")
        .select("key", "start", "length", "window_id")
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """(key, n_hit, n_items, items_sha256) of each distinct text with an occurring window; ``key``
    is the MD5 of the text. A null item_id marks words but is no item."""
    owners, grams = item_windows(benchmark, window, shingle)
    hits = written(matches(docs, grams, shingle), "hits")
    # Words under overlapping windows count once: a window adds what lies past all before it.
    earlier = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("key", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    covered = (
        spans.withColumn("_reached", F.coalesce(F.max("end").over(earlier), F.lit(0)))
        .groupBy("key")
        .agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "_reached"), F.lit(0))).alias("n_hit"))
    )
    items = (
        hits.select("key", "window_id").distinct().join(owners, "window_id")
        .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("_items"))
        .select(
            "key", F.size("_items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        )
    )
    return covered.join(items, "key")


def mark_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row.

    A word is hit if it lies in an occurrence of a window of ``window`` consecutive item words (an
    item of fewer words is one window). Null and empty texts have no words; items without words do
    nothing; repeated items count once; repeated documents get equal rows. Without a hit the digest
    is that of the empty list.
    """
    found = contamination(docs.select("text"), benchmark, window)
    counted = F.regexp_count(F.coalesce(lower_ascii(F.col("text")), F.lit("")), F.lit(WORD))
    rows = docs.select("doc_id", F.md5("text").alias("key"), counted.cast("bigint").alias("n_words"))
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit word, all columns kept."""
    found = contamination(docs.select("text"), benchmark, window).select(F.col("key").alias("_goldpan_key"))
    return docs.join(found, F.md5(docs["text"]) == found["_goldpan_key"], "left_anti")
