"""Ranked lexical search without random access (NRA).

Documents become a compact forward table of the query terms they hold; counts cover every document.
Each task takes its documents in groups, inverts a group into one list per term, sorted by impact,
and answers every item from sequential reads of those lists. A document met in a list has a lower
score bound (what was read) and an upper one (plus, for each list it was not met in, the impact that
list is at). Reading goes on until no document outside the best ``k`` can reach them, ties included,
and the scores of the best are exact. Each group starts from the best of the groups before it in the
task; the lists of all tasks meet at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import with_position, with_running_total
from ..session import cut
from .package import ship

#: A group of documents is closed once it has so many rows or postings.
GROUP_ROWS = 1 << 15
GROUP_POSTINGS = 1 << 22
#: Terms of the items answered in one pass over the forward table (an item is never split).
PASS_TERMS = 500_000
#: Bytes of distinct item terms that go along with the tasks; more are met in a join.
TERM_BYTES = 8 << 20
#: Bytes of a text that are split at once.
STEP = 1 << 20
#: Entries of a list read in the first round; each round reads twice as far as the one before.
FIRST_READ = 64

# The separators of the contract and the letters that fold, by byte; in UTF-8 all bytes of other
# characters belong to terms.
_FOLD = bytes(
    32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F
    else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def counted(raw: bytes | None) -> Counter:
    """Terms of a whole text with their occurrences."""
    terms: Counter = Counter()
    folded = (raw or b"").translate(_FOLD)
    at = 0
    while at < len(folded):
        stop = folded.find(b" ", at + STEP)
        stop = len(folded) if stop < 0 else stop
        terms.update(folded[at:stop].split())
        at = stop
    return terms


# --- tables -------------------------------------------------------------------------------------


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, t.decode(), n) for item, raw in zip(*(c.to_pylist() for c in batch.columns)) for t, n in counted(raw).items()]
        yield pa.RecordBatch.from_pylist(
            [{"item": i, "term": t, "times": n} for i, t, n in rows],
            pa.schema([("item", pa.int64()), ("term", pa.string()), ("times", pa.int64())]),
        )


def _count_docs(terms: dict[bytes, int] | None):
    """Forward rows: doc_id, n, and the terms (numbers, or the terms themselves) with occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.keys() if terms is not None else None
        kind = pa.int32() if terms is not None else pa.binary()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first in range(0, len(ids), 256):
                totals, lists, times = [], [], []
                for text in texts.slice(first, 256):
                    found = counted(text.as_py())
                    totals.append(found.total())
                    held = found.keys() if wanted is None else found.keys() & wanted
                    lists.append([t if terms is None else terms[t] for t in held])
                    times.append([found[t] for t in held])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, 256), pa.array(totals, pa.int64()), pa.array(lists, pa.list_(kind)),
                        pa.array(times, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "terms", "times"],
                )

    return run


def _numbered(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """doc_id, n, terms, times: every row of ``docs`` with the numbers of the query terms it holds.

    A small vocabulary goes along with the task; a larger one meets the documents' terms in a join.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if small:
        known = {bytes(r.term): r.number for r in vocabulary.collect()}
        return cut(texts.mapInArrow(_count_docs(known), "doc_id long, n long, terms array<int>, times array<long>"))
    whole = cut(
        texts.mapInArrow(_count_docs(None), "doc_id long, n long, terms array<binary>, times array<long>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    pairs = whole.select("row", F.explode(F.arrays_zip("terms", "times")).alias("p")).select(
        "row", F.col("p.terms").alias("term"), F.col("p.times").alias("times")
    )
    held = pairs.join(vocabulary, "term").groupBy("row").agg(F.collect_list(F.struct("number", "times")).alias("p"))
    return cut(
        whole.select("row", "doc_id", "n").join(held, "row", "left").select(
            "doc_id", "n", F.coalesce("p.number", F.array().cast("array<int>")).alias("terms"),
            F.coalesce("p.times", F.array().cast("array<bigint>")).alias("times"),
        )
    )


# --- NRA ----------------------------------------------------------------------------------------


def best_of(
    lists: list[tuple[np.ndarray, np.ndarray]], rows: int, k: int, floor: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores of all documents that can be among the best ``k`` of ``lists``: those
    that score at least as much as the k-th best, and at least ``floor``.

    A list holds (row, impact) in descending order of impact, each row once. Impacts are positive
    integers whose sums stay below 2**53.
    """
    lists = [one for one in lists if len(one[0])]
    lower = np.zeros(rows)
    met = np.zeros((len(lists), rows), dtype=bool)
    at = np.zeros(len(lists), dtype=np.int64)
    frontier = np.array([float(impacts[0]) for _, impacts in lists])
    reach, pool = FIRST_READ, None
    while True:
        for i, (who, impacts) in enumerate(lists):
            stop = min(reach, len(who))
            if at[i] < stop:
                part = who[at[i] : stop]
                lower[part] += impacts[at[i] : stop]
                met[i, part] = True
                at[i] = stop
                frontier[i] = impacts[stop] if stop < len(who) else 0.0
        reach *= 2
        beyond = frontier.sum()
        if pool is None:
            seen = np.flatnonzero(lower)
            edge = max(np.partition(lower[seen], -k)[-k] if len(seen) >= k else 0.0, floor, 1.0)
            if beyond >= edge:
                continue  # a document in no list so far may still be among the best
            pool = seen  # from here on only these can be
        score = lower[pool]
        open_ended = ~met[:, pool] & (frontier > 0)[:, None]
        upper = score + frontier @ open_ended
        if len(pool) >= k:
            edge = max(np.partition(score, -k)[-k], edge)
        alive = upper >= edge
        pool, score, settled = pool[alive], score[alive], ~open_ended[:, alive].any(axis=0)
        if settled.all():
            if len(pool) > k:
                edge = max(np.partition(score, -k)[-k], edge)
            kept = score >= edge
            return pool[kept], score[kept].astype(np.int64)


class _Group:
    """Documents inverted into lists by impact."""

    def __init__(self, sizes: list[int], terms: list[np.ndarray], times: list[np.ndarray], law) -> None:
        counts = np.array([len(t) for t in terms], dtype=np.int64)
        rows = np.repeat(np.arange(len(sizes)), counts)
        number = np.concatenate(terms)
        impact = law(number, np.concatenate(times), np.repeat(np.array(sizes, dtype=np.int64), counts))
        order = np.lexsort((rows, -impact, number))
        number = number[order]
        self.rows, self.impact = rows[order], impact[order]
        self.at = dict(zip(*_runs(number)))

    def lists(self, wanted: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each (term, occurrences in the item), entries without impact left out."""
        out = []
        for number, times in wanted:
            if number in self.at:
                a, b = self.at[number]
                impact = self.impact[a:b]
                b = a + int(np.searchsorted(-impact, 0))
                out.append((self.rows[a:b], self.impact[a:b] * times))
        return out


def _runs(sorted_values: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    edges = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1], True])
    if not len(sorted_values):
        return [], []
    return sorted_values[edges[:-1]].tolist(), list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def impact_law(used: np.ndarray, weights: np.ndarray, documents: int, length: int):
    """Impact of a term in a document, in 64-bit integers: weight, saturation by occurrences, and a
    quarter of the length over the mean. Terms that are not among ``used`` (sorted) have none."""

    def law(number: np.ndarray, times: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * size * documents) // length
        at = np.minimum(np.searchsorted(used, number), len(used) - 1)
        weight = np.where(used[at] == number, weights[at], 0)
        return weight * ((1_000_000_000 * times) // (1000 * times + 12 * m))

    return law


def _search(items: dict[int, list[tuple[int, int]]], law, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {}  # (-score, id is null, id) per item

        def answer(ids, sizes, terms, times) -> None:
            group = _Group(sizes, terms, times, law)
            for item, wanted in items.items():
                had = best.get(item, [])
                floor = -had[k - 1][0] if len(had) >= k else 0
                lists = group.lists(wanted)
                if lists:
                    rows, scores = best_of(lists, len(ids), k, floor)
                    new = [(-s, ids[r] is None, ids[r] or 0) for r, s in zip(rows.tolist(), scores.tolist())]
                    best[item] = sorted(had + new)[:k]

        held: tuple[list, list, list, list] = ([], [], [], [])
        postings = 0
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (key, size) in enumerate(zip(ids, sizes)):
                terms = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                if not len(terms):
                    continue
                times = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                for column, value in zip(held, (key, size, terms.copy(), times.copy())):
                    column.append(value)
                postings += len(terms)
                if len(held[0]) >= GROUP_ROWS or postings >= GROUP_POSTINGS:
                    answer(*held)
                    held, postings = ([], [], [], []), 0
        if held[0]:
            answer(*held)
        rows = [(i, None if null else key, -minus) for i, found in best.items() for minus, null, key in found]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0.

    Rows of ``docs`` (doc_id, text) are documents of their own, repeated ones too; null or termless
    texts match nothing and do not count. Rows of ``items`` (item_id, text) are items of their own.
    Equal scores rank by ascending doc_id, a null one last. Empty tables give no rows. Items with
    more than ``PASS_TERMS`` terms together take more passes over the forward table; a vocabulary
    of more than ``TERM_BYTES`` meets the documents' terms in a join.
    """
    spark = docs.sparkSession
    ship(spark)
    named = cut(items.select("item_id", F.col("text").cast("binary").alias("text")).withColumn(
        "item", F.monotonically_increasing_id()
    ))
    asked = cut(named.select("item", "text").mapInArrow(_count_items, "item long, term string, times long"))
    distinct = asked.select(F.col("term").cast("binary").alias("term")).distinct()
    numbered = with_position(distinct, F.col("term"), name="number")
    vocabulary = cut(numbered.withColumn("number", F.col("number").cast("int")))
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    forward = _numbered(docs, vocabulary, small=size <= TERM_BYTES)
    n, length = forward.agg(
        F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    counts = forward.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    lines = asked.withColumn("term", F.col("term").cast("binary")).join(vocabulary, "term").join(counts, "number")
    wanted = cut(lines.select("item", "number", "times", "df"))
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for rows in _passes(wanted):
        found = found.unionByName(_one_pass(forward, rows, n, length, k))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).join(named.select("item", "item_id"), "item").select(
        "item_id", "rank", "doc_id", "score"
    )


def _passes(wanted: DataFrame) -> Iterator[list]:
    """The (item, number, times, df) rows of a bounded set of items after another."""
    sizes = wanted.groupBy("item").agg(F.count("*").alias("terms"))
    placed = with_running_total(sizes, [F.col("item")], F.col("terms"))
    ranges = placed.groupBy(F.expr(f"before div {PASS_TERMS}").alias("block")).agg(
        F.min("item").alias("first"), F.max("item").alias("last")
    )
    for some in ranges.orderBy("block").collect():
        yield wanted.where(F.col("item").between(some.first, some.last)).collect()


def _one_pass(forward: DataFrame, rows: list, n: int, length: int, k: int) -> DataFrame:
    df = {r.number: r.df for r in rows}
    used = sorted(df)
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[number] + 1))) for number in used]
    items: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(rows, key=lambda r: (r.item, r.number)):
        items.setdefault(r.item, []).append((r.number, r.times))
    law = impact_law(np.array(used), np.array(weights), n, length)
    return cut(forward.mapInArrow(_search(items, law, k), "item long, doc_id long, score long"))
