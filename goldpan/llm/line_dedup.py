"""Substring dedup by line or paragraph hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import assemble, earliest, later_occurrences, unit_table
from .package import ship

#: A run of neighbouring repeated units is removed if it has so many words in all.
LEAST_WORDS = 50


def remove_repeated(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_units, n_removed, removed, kept, text of every row.

    Units (lines; paragraphs between blank lines; or sentences, which are lines cut further behind
    ``.``, ``!`` and ``?``) are normalised (lower case, white space as single spaces) and grouped by a
    128-bit digest over all documents. The occurrence with the smallest (doc_id, document, place)
    stays, nulls last. A later one is removed if the run of later ones that it stands in, blank units
    passed over, has ``least_words`` words: 0 removes every later unit, more leave short units alone
    that many documents share by chance. ``removed`` and ``kept`` are spans of the original text in
    code points.

    Null texts have no units and stay null; documents that are removed whole are empty; rows with
    equal doc_id and text are one document and are returned alike as often as they occur.
    """
    ship(docs.sparkSession)
    units = unit_table(docs, unit)
    kept = (
        units.groupBy("digest").agg(earliest().alias("keeper"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "keeper")
    )
    return assemble(docs, later_occurrences(units, kept), unit, least_words)
