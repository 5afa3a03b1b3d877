"""Rows of documents as the stages tell them apart: by doc_id and text.

Rows with the same id and text have the same fate, so they need no further name;
rows that share only the id, or have none, are still different rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def packed(docs: DataFrame) -> DataFrame:
    """One column, ``own``: each row as a struct, so that no name of docs meets a name used here."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))


def same_row(doc: str = "of_doc", row: str = "of_row") -> Column:
    """Whether (doc, row) name the packed row ``own``; null ids are alike."""
    own = F.col("own")
    return own["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (row_hash(own["text"]) == F.col(row))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that gone (doc_id, row) doesn't name."""
    gone = gone.select(F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row")).distinct()
    return packed(docs).join(gone, same_row(), "left_anti").select("own.*")
