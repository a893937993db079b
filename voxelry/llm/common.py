"""What the corpus operators share: the folder all executors see, written tables that cut lineage, and rows kept
whole beside an operator's own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.functions.graph import discard, shared_dir, written

__all__ = ["KEY", "discard", "packed", "row_key", "shared_dir", "unpacked", "written"]

#: Columns of a row's key.
KEY = ["k1", "k2"]


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``doc``, so that no name in it clashes with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``doc``, those in ``changed`` replaced."""
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits that name a row by its id and text: two hashes from unlike seeds. Rows that repeat both share a key;
    rows that repeat the id alone don't."""
    return [F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias(k) for seed, k in enumerate(KEY)]


def packed_by_key(docs: DataFrame) -> DataFrame:
    """``docs`` packed, each row beside its key."""
    return packed(docs).select("doc", *row_key("doc.doc_id", "doc.text"))
