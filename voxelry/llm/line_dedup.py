"""Line dedup: hashes are range-partitioned with a secondary sort by document and position, first
occurrences are found while streaming, and compressed keep bitmaps per document are returned, not text.

The range is over (hash, document descending, position), so a line that a third of all documents hold
is spread over several neighbouring partitions. Inside a partition a run of equal hashes is decided
while it streams by. A partition's first run may have begun in the partition before and its last run may
go on in the next one; their rows are settled by an aggregate over at most two hashes a partition.

A line's row carries its document's number, which decides which copy stays, and the key of its row (id and
text), to which the verdict goes: rows that repeat a doc_id with another text have verdicts of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, packed_by_key, row_key, unpacked, written

_SORT = ("h1", "h2", "d", "pos", *KEY)
_LINES = "h1 long, h2 long, d long, pos int, k1 long, k2 long"


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, digests = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for pos, line in enumerate((text or b"").split(b"\n")):
                    key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
                    if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        rows.append(row)
                        places.append(pos)
                        digests.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            doc, k1, k2 = (batch.column(i).take(pa.array(rows, pa.int32())) for i in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), doc, pa.array(places, pa.int32()), k1, k2], [*_SORT])

    return rows


#: kind of a row that the stream leaves: a dropped line; a line of a run that reaches over the
#: partition's edge; the head of a last run whose lines are decided already.
DROPPED, OPEN, HEAD = 0, 1, 2


def _stream(min_docs: int):
    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x: dict, at: np.ndarray, kind: int) -> pa.RecordBatch:
            cols = [pa.array(x[k][at]) for k in _SORT] + [pa.array(np.full(len(at), kind, np.int32))]
            return pa.RecordBatch.from_arrays(cols, [*_SORT, "kind"])

        rest: dict | None = None  # rows of the run that may go on; ghosts have been put out already
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {k: batch.column(i).to_numpy() for i, k in enumerate(_SORT)} | {"ghost": np.zeros(batch.num_rows, bool)}
            if rest is not None:
                x = {k: np.concatenate([rest[k], v]) for k, v in x.items()}
            first = first or (x["h1"][0], x["h2"][0])
            new_run = np.ones(len(x["d"]), bool)
            new_run[1:] = (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= x["d"][1:] != x["d"][:-1]
            starts = np.flatnonzero(new_run)
            run = np.cumsum(new_run) - 1
            n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            is_first = (x["h1"] == first[0]) & (x["h2"] == first[1])
            drop = ~is_first & (n_docs >= min_docs)[run] & (x["d"] != x["d"][starts][run]) & ~x["ghost"]
            yield out(x, np.flatnonzero(drop), DROPPED)
            yield out(x, np.flatnonzero(is_first & ~x["ghost"]), OPEN)
            tail = np.arange(starts[-1], len(x["d"]))
            if is_first[-1] or n_docs[-1] >= min_docs:
                # enough to know the largest document and that there are min_docs of them
                tail = np.unique(np.append(tail[new_doc[tail]][: min_docs - 1], len(x["d"]) - 1))
                rest = {k: v[tail] for k, v in x.items()} | {"ghost": np.ones(len(tail), bool)}
            else:
                rest = {k: v[tail] for k, v in x.items()}
        if rest is not None and (rest["h1"][0], rest["h2"][0]) != first:
            if len(np.unique(rest["d"])) >= min_docs:
                yield out(rest, np.array([0]), HEAD)
            else:
                yield out(rest, np.arange(len(rest["d"])), OPEN)

    return verdicts


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, position) of dropped lines -> a bitmap a row; lines past its end are kept."""

    def pack(k1: np.ndarray, k2: np.ndarray, p: np.ndarray, starts: np.ndarray, end: int) -> pa.RecordBatch:
        maps, counts = [], []
        for a, b in zip(starts, np.append(starts[1:], end)):
            keep = np.ones((p[b - 1] // 8 + 1) * 8, np.uint8)  # whole bytes; what pads them is kept
            keep[p[a:b]] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            counts.append(len(keep) - int(keep.sum()))
        return pa.RecordBatch.from_arrays(
            [pa.array(k1[starts]), pa.array(k2[starts]), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], [*KEY, "n_dropped", "keep"]
        )

    k1, k2, p = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    for batch in batches:
        if batch.num_rows:
            k1, k2, p = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((k1, k2, p)))
            starts = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            if cut := int(starts[-1]):
                yield pack(k1, k2, p, starts[:-1], cut)
                k1, k2, p = k1[cut:], k2[cut:], p[cut:]
    if len(p):
        yield pack(k1, k2, p, np.array([0]), len(p))


def line_keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(k1, k2, n_dropped, keep) for each row that loses lines; k1 and k2 are its key by id and text.

    A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Keys of
    ``min_chars`` code points or more found in ``min_docs`` documents lose all their lines except in the
    largest doc_id holding them. ``keep`` is a zlib-compressed bitmap, most significant bit first, 1 for a
    kept line; lines beyond its end are kept.

    Null doc_id: takes no part, keeps its lines. Null or empty text: one empty line, always kept. Rows that
    repeat a doc_id count as one document, but each text has its own verdict; rows that repeat the text too
    share one. Ties cannot arise: the largest doc_id is one document. Other columns are ignored; an empty
    table gives an empty table.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    lines = named.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *row_key()).mapInArrow(_line_rows(min_chars), _LINES)
    lines = written(lines, "lines")  # the ranges are drawn from a first pass; texts are split once
    order = [F.col("h1"), F.col("h2"), F.col("d").desc(), F.col("pos"), *map(F.col, KEY)]
    streamed = lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), f"{_LINES}, kind int")
    # Read twice below: the cut between partitions must be the same both times.
    rows = written(streamed, "line-dedup")
    edge = rows.where(F.col("kind") != DROPPED)
    heads = (
        edge.groupBy("h1", "h2", "d").agg(F.max("kind").alias("kind"))
        .groupBy("h1", "h2").agg(F.max("d").alias("top"), F.count("*").alias("n"), F.max("kind").alias("kind"))
        .where((F.col("n") >= min_docs) | (F.col("kind") == HEAD))
    )  # at most two hashes a partition, so it may be broadcast
    late = edge.where(F.col("kind") == OPEN).join(F.broadcast(heads.select("h1", "h2", "top")), ["h1", "h2"]).where("d <> top")
    dropped = rows.where(F.col("kind") == DROPPED).select(*KEY, "pos").unionByName(late.select(*KEY, "pos"))
    # distinct: rows that repeat id and text would all meet under one key
    return dropped.distinct().repartition(*KEY).sortWithinPartitions(*KEY, "pos").mapInArrow(_bitmaps, "k1 long, k2 long, n_dropped long, keep binary")


def keep_lines(text: str, keep: bytes | None) -> str:
    """``text`` without the lines whose bit in ``keep`` is 0."""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return "\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])


def kept_text(text: Column, keep: Column) -> Column:
    """The text after dropping lines; null stays null."""
    @F.pandas_udf("string")
    def apply(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or m is None else keep_lines(t, m) for t, m in zip(texts, maps)], dtype=object)

    return apply(text, keep)


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with its columns and rows, texts without repeated lines; ``n_chars``, if there, is brought
    up to date. Cases as in :func:`line_keep_bitmaps`; a text that loses all its lines becomes empty."""
    maps = line_keep_bitmaps(docs, min_chars, min_docs)
    out = packed_by_key(docs).join(maps, KEY, "left").withColumn("keep", F.when(F.col("doc.doc_id").isNotNull(), F.col("keep")))
    out = out.select("doc", "keep", kept_text(F.col("doc.text"), F.col("keep")).alias("kept"))
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("keep").isNull(), F.col("doc.n_chars")).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    return unpacked(out, docs, **changed)


def line_dedup_digest(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept_sha256 of what stays. A null text is one empty line."""
    import hashlib

    maps = line_keep_bitmaps(docs, min_chars, min_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key()).join(maps, KEY, "left")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            kept = [keep_lines(t, m) for t, m in zip(texts, b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t.count("\n") + 1 for t in texts], pa.int64()), b.column(2).fill_null(0), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept])],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return rows.select("doc_id", "text", "n_dropped", "keep").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
