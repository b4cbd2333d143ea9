"""Sets of integers as bitmaps of 32,768 bits, built before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32_768
#: Bytes of a bitmap that are looked at as one number.
WORD = 4


def build(df: DataFrame, key: str, sets: Mapping[str, Column]) -> DataFrame:
    """bucket and one bitmap per set: the ids of the rows for which its condition holds. A shuffle
    carries one row per bucket and task. Null ids belong to no set."""
    whole = F.col(key).cast("bigint")
    place = F.bitmap_bit_position(whole)
    return df.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(whole).alias("bucket")).agg(
        *[F.bitmap_construct_agg(F.when(holds, place)).alias(name) for name, holds in sets.items()]
    )


def words(bitmaps: DataFrame, names: list[str]) -> DataFrame:
    """(bucket, word, sets): each set as numbers of 32 bits, words that are empty in all left out."""
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(BITS // 8 // WORD - 1)),
        lambda i: F.struct(
            i.alias("word"),
            *[
                F.conv(F.hex(F.substring(F.col(n), i * WORD + 1, F.lit(WORD))), 16, 10).cast("bigint").alias(n)
                for n in names
            ],
        ),
    )
    return bitmaps.select("bucket", F.inline(F.filter(parts, lambda w: _any(w, names))))


def _any(word: Column, names: list[str]) -> Column:
    held = word[names[0]] != 0
    for name in names[1:]:
        held = held | (word[name] != 0)
    return held


def ids(word: Column) -> Column:
    """The ids whose bits are set in a word of ``words``, as an array."""
    first = F.col("word") * (WORD * 8)
    places = F.filter(
        F.sequence(F.lit(0), F.lit(WORD * 8 - 1)),
        # Bytes stand in order, the lowest bit of a byte first.
        lambda p: F.getbit(word, (WORD - 1 - F.floor(p / 8).cast("int")) * 8 + p % 8) == 1,
    )
    up = (F.col("bucket") - 1) * BITS + 1
    return F.transform(
        places,
        lambda p: F.when(F.col("bucket") > 0, up + first + p).otherwise(F.col("bucket") * BITS - first - p).cast("bigint"),
    )
