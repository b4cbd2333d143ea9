"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are added up by the set of sources they belong to. Tokens of a pattern flow to the
sources in it, up to each source's quota. The first pass over a pattern costs less than the second,
and so on (convex repetition costs), so no text is repeated before all texts of its pattern are
used once. The flow is solved on the aggregated graph only. Each pattern's flow is then filled with
whole documents in a seeded order: all documents for every full pass, then those up to a cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Words as runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Cycle of weights over the sources in code point order.
WEIGHTS = (3, 1, 2)
#: Distinct membership patterns (and sources) whose totals the driver may hold.
MAX_PATTERNS = 100_000
#: Bins of the seeded order that are summed before any row is ranked.
BINS = 4096


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0
) -> list[float]:
    """Targets in proportion to ``weights`` that add up to ``share`` of all sizes; a target above
    ``most`` times its source's size stops there and the excess goes to the others by weight."""
    left = share * sum(sizes)
    targets = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        trial = {i: left * weights[i] / total for i in sorted(open_)}
        over = [i for i in sorted(open_) if trial[i] > most * sizes[i]]
        if not over:
            for i, value in trial.items():
                targets[i] = value
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
            open_.discard(i)
    return targets


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a cheapest maximum flow, by shortest
    augmenting paths with potentials."""
    to, left, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, capacity, price in arcs:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)
    height = [0] * n
    while True:
        distance, by = {start: 0}, {}
        heap, settled = [(0, start)], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in settled:
                continue
            settled.add(x)
            for e in out[x]:
                reach = d + cost[e] + height[x] - height[to[e]]
                if left[e] > 0 and reach < distance.get(to[e], reach + 1):
                    distance[to[e]] = reach
                    by[to[e]] = e
                    heapq.heappush(heap, (reach, to[e]))
        if end not in settled:
            return [left[2 * i + 1] for i in range(len(arcs))]
        furthest = max(distance[x] for x in settled)
        for x in range(n):
            height[x] += distance[x] if x in settled else furthest
        path, x = [], end
        while x != start:
            path.append(by[x])
            x = to[by[x] ^ 1]
        pushed = min(left[e] for e in path)
        for e in path:
            left[e] -= pushed
            left[e ^ 1] += pushed


def pattern_quotas(
    patterns: Sequence[tuple[tuple[int, ...], int]], targets: Sequence[float], passes: int = 2
) -> list[int]:
    """Words to take of each pattern (members, size): the cheapest flow that fills the targets,
    pass k over a pattern costing k per word."""
    # Patterns that share no source, directly or through others, are networks of their own.
    part = list(range(len(targets)))

    def find(x: int) -> int:
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    for members, _ in patterns:
        for s in members[1:]:
            part[find(s)] = find(members[0])
    networks: dict[int, list[int]] = {}
    for p, (members, _) in enumerate(patterns):
        if members:
            networks.setdefault(find(members[0]), []).append(p)
    quotas = [0] * len(patterns)
    for own in networks.values():
        sources = sorted({s for p in own for s in patterns[p][0]})
        place = {s: 1 + len(own) + i for i, s in enumerate(sources)}
        end = 1 + len(own) + len(sources)
        arcs = []
        for i, p in enumerate(own):
            members, size = patterns[p]
            arcs += [(0, 1 + i, size, k + 1) for k in range(passes)]
            arcs += [(1 + i, place[s], passes * size, 0) for s in members]
        arcs += [(place[s], end, round(targets[s]), 0) for s in sources]
        for (a, b, _, _), f in zip(arcs, min_cost_flow(end + 1, arcs, 0, end)):
            if a == 0:
                quotas[own[b - 1]] += f
    return quotas


def plan(
    sized: DataFrame, *, share: float = 1.5, most: int = 2, weights: Sequence[float] = WEIGHTS,
) -> DataFrame:
    """One row per pattern: members, source_size, target (sums over its members), full (passes
    over all its documents), cut and extra (seeded order of the last and of one more document).

    ``sized``: members (array of source names, null for no name), size, order. Memory: the driver
    holds one row per pattern; more than ``MAX_PATTERNS`` raise an error.
    """
    spark = sized.sparkSession
    totals = (
        sized.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    )
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({s for r in totals for s in r["members"]}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    totals.sort(key=lambda r: [at[s] for s in r["members"]])
    patterns = [(tuple(sorted({at[s] for s in r["members"]})), r["size"]) for r in totals]
    sizes = [0] * len(names)
    for members, size in patterns:
        for s in members:
            sizes[s] += size
    targets = source_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most)
    quotas = pattern_quotas(patterns, targets, most)
    rows = []
    for r, (members, size), quota in zip(totals, patterns, quotas):
        full = min(quota // size, most) if size else 0
        rows.append(
            (r["members"], sum(sizes[s] for s in members), sum(targets[s] for s in members),
             int(full), int(quota - full * size))
        )
    schema = "members array<string>, source_size long, target double, full int, rest long"
    asked = spark.createDataFrame(rows, schema)
    # Where the rest ends in the seeded order: first among the sums of bins, then inside one bin,
    # so a pattern that holds most of the corpus is never sorted in one task. Tables of patterns
    # are broadcast: they have MAX_PATTERNS rows at most.
    shift = 64 - (BINS.bit_length() - 1)
    binned = sized.where("size > 0").withColumn("_bin", F.shiftright("order", shift))
    bins = binned.groupBy("members", "_bin").agg(F.sum("size").alias("_words"))
    before = F.sum("_words").over(Window.partitionBy("members").orderBy("_bin")) - F.col("_words")
    edges = (
        bins.withColumn("_before", before)
        .join(F.broadcast(asked.where("rest > 0").select("members", "rest")), "members")
        .where("_before <= rest and rest < _before + _words")
        .select("members", "_bin", "_before", "rest")
    )
    places = Window.partitionBy("members").orderBy("order")
    cuts = (
        binned.join(F.broadcast(edges), ["members", "_bin"])
        .groupBy("members", "_bin", "_before", "rest", "order").agg(F.sum("size").alias("_words"))
        .withColumn("_upto", F.col("_before") + F.sum("_words").over(places))
        .groupBy("members", "_bin", "_before", "rest")
        .agg(
            F.max(F.when(F.expr("_upto <= rest"), F.col("order"))).alias("_cut"),
            F.max(F.when(F.expr("_upto <= rest"), F.col("_upto"))).alias("_filled"),
        )
        .select(
            "members",
            # Without a document of this bin the cut is just below it (null: nothing is below).
            F.coalesce(
                "_cut",
                F.when(F.col("_bin") > -BINS // 2, F.shiftleft(F.col("_bin"), shift) - 1),
            ).alias("cut"),
            (F.col("rest") - F.coalesce("_filled", "_before")).alias("_gap"),
        )
    )
    cuts = written(cuts, "cuts")
    # One more document brings the sum nearest to the quota, if any does.
    nearest = (
        sized.where("size > 0").join(F.broadcast(cuts), "members")
        .where("(cut is null or `order` > cut) and size < 2 * _gap")
        .groupBy("members")
        .agg(F.min(F.struct(F.abs(F.col("size") - F.col("_gap")), F.col("order"))).alias("_best"))
        .select("members", F.col("_best.order").alias("extra"))
    )
    return written(
        asked.join(cuts.drop("_gap"), "members", "left").join(nearest, "members", "left").drop("rest"),
        "mix",
    )


def _sized(docs: DataFrame, members: Column | None, seed: int, *more: str) -> DataFrame:
    belongs = F.array("source") if members is None else F.array_sort(F.array_distinct(members))
    return docs.select(
        *more, belongs.alias("members"), word_count("text").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"),
    )


def mix_documents(
    docs: DataFrame, *, members: Column | None = None, seed: int = 42, share: float = 1.5, most: int = 2,
) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    A document belongs to its ``source``, or to all of ``members`` (an array column), in which case
    source_size and target are sums over them. ``taken`` is its size times the number of times the
    mix takes it (0 to ``most``). Nulls: a text has no words, a source is a source of its own that
    sorts last. Rows with equal doc_id and text share one place in the seeded order and are taken
    alike. Reruns agree: the order is a hash of seed, doc_id and text.
    """
    sized = written(_sized(docs, members, seed, "doc_id"), "sized")
    return _taken(sized, plan(sized, share=share, most=most)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def mixed_rows(
    docs: DataFrame, *, members: Column | None = None, seed: int = 42, share: float = 1.5, most: int = 2,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns kept.

    The choice depends on a row alone (its pattern, size and order against the pattern's cut), so
    texts are read once more and never shuffled. Rows without words are not taken.
    """
    chosen = plan(written(_sized(docs, members, seed), "sized"), share=share, most=most)
    belongs = F.array("source") if members is None else F.array_sort(F.array_distinct(members))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    placed = docs.select(
        row.alias("_row"), belongs.alias("members"), word_count("text").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"),
    )
    return (
        _taken(placed, chosen).where("size > 0 and times > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), "times"))).select("_row.*")
    )


def _taken(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds the columns of ``plan`` and ``times``, how often a row is taken."""
    below = F.coalesce(F.col("order") <= F.col("cut"), F.lit(False))
    one_more = F.coalesce(F.col("order") == F.col("extra"), F.lit(False))
    return placed.join(F.broadcast(chosen), "members").withColumn(  # at most MAX_PATTERNS rows
        "times", F.col("full") + (below | one_more).cast("int")
    )
