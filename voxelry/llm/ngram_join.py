"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five words. Texts of the same words form one class first; one representative of
each goes on, under a number of its own, so that rows which repeat a doc_id with another text stay apart. Bands of its MinHash values propose candidates; the values of a candidate pair are compared
sixteen at a time, and the pair is dropped as soon as the posterior probability that its similarity reaches
the threshold is below a tolerance. What survives is verified exactly on the shingle sets.

Representatives that meet in a bucket are compared in tiles of two blocks, so no task gets a whole large
bucket, and pairs stay inside their tile: what leaves it is a row a representative (a spanning star of its
verified links and their number), never a row a pair. A pair that meets in several bands is handled in the
first of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.graph import connected_components

from .common import KEY, packed_by_key, row_key, unpacked, written

WORDS, THRESHOLD = 5, 0.8
HASHES, BAND = 128, 5
BANDS = HASHES // BAND
STEP, TOLERANCE = 16, 1e-5
BLOCK = 128
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_C = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_list(text: str | None) -> list[str]:
    """Lower-cased words: runs without white space."""
    return (text or "").lower().split()


def shingles(words: list[str]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words; of all words together where there are fewer."""
    digest = xxhash.xxh3_64_intdigest
    w = np.fromiter((digest(x) for x in words), np.uint64, len(words))
    k = min(WORDS, len(words))
    h = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _C[i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h ^ (h >> np.uint64(29)))


def minhash(h: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        low = np.minimum(low, ((h[at : at + 512, None] * _A + _B) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return low


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... compared values, the least number of equal ones at which, from a uniform prior, the
    posterior probability of a similarity of ``threshold`` or more is not below ``tolerance``."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:  # P(S >= t | m of n) = P(Binomial(n + 1, t) <= m)
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sigs = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
            words = word_list(text) if doc is not None else []
            if words:
                keys.append(xxhash.xxh3_128_digest(" ".join(words)))
                sigs.append(minhash(shingles(words)).tobytes())
            else:
                keys.append(None)
                sigs.append(None)
        h = [np.frombuffer(k, "<i8").tolist() if k else (None, None) for k in keys]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64()), pa.array(sigs, pa.binary())],
            ["doc_id", *KEY, "h1", "h2", "sig"],
        )


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows sorted by ``keys``, one after another; one group is held at a time."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new).tolist()
        for a, z in zip(starts, starts[1:]):
            yield t.slice(a, z - a)
        rest = t.slice(starts[-1])
    if rest is not None:
        yield rest


_TILE = ["b", "bh", "x", "y"]


def candidate_pairs(sig: np.ndarray, block: np.ndarray, band: int, diagonal: bool, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that survive the incremental comparison and don't share an earlier band."""
    if diagonal:
        i, j = np.triu_indices(len(sig), 1)
    else:
        first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
        i, j = np.repeat(first, len(second)), np.tile(second, len(first))
    equal = np.zeros(len(i), np.int64)
    for r, need in enumerate(least):
        at = slice(r * STEP, (r + 1) * STEP)
        equal += (sig[i, at] == sig[j, at]).sum(axis=1)
        alive = equal >= need
        i, j, equal = i[alive], j[alive], equal[alive]
        if not len(i):
            return i, j
    bands = np.ascontiguousarray(sig[:, : band * BAND]).reshape(len(sig), band, BAND)
    fresh = ~(bands[i] == bands[j]).all(axis=2).any(axis=1) if band else np.ones(len(i), bool)
    return i[fresh], j[fresh]


def _prune(least: list[int]) -> Callable:
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(7)]

        def flush() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], [*_TILE, "rid", "n", "partners"])
            for v in out:
                v.clear()
            return batch

        for g in by_group(batches, _TILE):
            if g.num_rows < 2:
                continue
            b, bh, x, y = (g.column(k)[0].as_py() for k in _TILE)
            rid, n = g.column("rid").to_numpy(), g.column("n").to_numpy()
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            block = g.column("block").to_numpy()
            if x != y and block.min() == block.max():
                continue
            i, j = candidate_pairs(sig, block, b, x == y, least)
            if not len(i):
                continue
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for d in np.union1d(i, j).tolist():
                a, z = np.searchsorted(i, [d, d + 1])
                for v, value in zip(out, (b, bh, x, y, int(rid[d]), int(n[d]), rid[j[a:z]].tolist())):
                    v.append(value)
            if len(out[0]) > 5000:
                yield flush()
        if out[0]:
            yield flush()

    return prune


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) of ``sets`` reach the threshold, exactly."""
    size = np.array([len(s) for s in sets])
    if len(i) <= 2 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
    else:  # products of incidence rows, a few thousand shingles at a time; what one set alone holds can't count
        owner = np.repeat(np.arange(len(sets)), size)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = times[column] > 1
        owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, z = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[a:z], column[a:z] - at] = 1
            common += part @ part.T
        both = np.rint(common[i, j]).astype(np.int64)
    return both >= threshold * (size[i] + size[j] - both) - 1e-9


def _verify(threshold: float) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["rid", "root", "links"])
            for v in out:
                v.clear()
            return batch

        for g in by_group(batches, _TILE):
            rows = {rid: (n, text, partners) for rid, n, partners, text in zip(*(g.column(c).to_pylist() for c in ("rid", "n", "partners", "text")))}
            ids = sorted(rows)
            at = {rid: k for k, rid in enumerate(ids)}
            pairs = [(at[a], at[b]) for a in ids for b in rows[a][2] if b in at]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            ok = verified([shingles(word_list(rows[a][1])) for a in ids], i, j, threshold)
            n = np.array([rows[a][0] for a in ids])
            links = np.zeros(len(ids), np.int64)
            root = list(range(len(ids)))
            for a, b in zip(i[ok].tolist(), j[ok].tolist()):
                links[a] += n[b]
                links[b] += n[a]
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                root[max(a, b)] = min(a, b)
            for k in np.flatnonzero(links).tolist():
                r = k
                while root[r] != r:
                    r = root[r]
                for v, value in zip(out, (ids[k], ids[r], int(links[k]))):
                    v.append(value)
            if len(out[0]) > 50_000:
                yield flush()
        if out[0]:
            yield flush()

    return verify


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, k1, k2, head, n_links) of every row. ``head`` is the row of its class with the smallest doc_id (then
    key), as (doc_id, k1, k2); null for rows without words or without an id."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text")
    signed = written(source.mapInArrow(_sign, "doc_id long, k1 long, k2 long, h1 long, h2 long, sig binary"), "join-signatures")
    copies = signed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", *KEY)).alias("head"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    reps = written(copies.withColumn("rid", F.monotonically_increasing_id()), "join-representatives")  # numbers are fixed once written
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("b"), F.xxhash64(b, F.substring(F.col("sig"), b * BAND * 4 + 1, F.lit(BAND * 4))).alias("bh"))))
    bands = reps.select("rid", band.alias("e")).select("rid", "e.b", "e.bh")
    shared = bands.groupBy("b", "bh").agg(F.count("*").alias("m")).where("m > 1")
    met = bands.join(shared, ["b", "bh"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = met.join(reps.select("rid", "n", "sig"), "rid").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    tiles = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("b", "bh", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rid", "n", "block", "sig")
    tile_row = "b int, bh long, x int, y int, rid long, n long, partners array<long>"
    pruned = tiles.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(_prune(least_matches(threshold, TOLERANCE)), tile_row)
    pruned = written(pruned, "join-candidates")
    # the text of a representative is that of its first row; rows that repeat id and text are one
    firsts = pruned.select("rid").distinct().join(reps.select("rid", "head.*"), "rid").select("rid", *KEY)
    texts = source.select(*KEY, "text").join(firsts, KEY).dropDuplicates(["rid"]).select("rid", "text")
    proof = pruned.join(texts, "rid").repartition(*_TILE).sortWithinPartitions(*_TILE)
    stars = written(proof.select(*_TILE, "rid", "n", "partners", "text").mapInArrow(_verify(threshold), "rid long, root long, links long"), "join-links")
    labels = connected_components(stars.select(F.col("rid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rid"), "component")
    names = reps.select("rid", "head").join(labels, "rid").groupBy("component").agg(F.min("head").alias("name"))
    links = stars.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = reps.select("h1", "h2", "rid", "n", "head").join(labels.join(names, "component").select("rid", "name"), "rid", "left").join(links, "rid", "left")
    return signed.select("doc_id", *KEY, "h1", "h2").join(classes, ["h1", "h2"], "left").select(
        "doc_id", *KEY, F.coalesce("name", "head").alias("head"), (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")
    )


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is ``threshold`` or
    more; a text of one to four words is one shingle. A class holds everything that links connect and is named
    after its smallest doc_id; n_links counts the other rows linked to a row, exact copies included.

    Null, empty and blank texts have no shingles and link to nothing. Null doc_ids take no part (class null,
    no links). Repeated rows are copies of each other; rows that share a doc_id alone are judged by their own
    texts. Other columns are ignored; an empty table gives none."""
    return _classes(docs, threshold).select("doc_id", F.coalesce("head.doc_id", "doc_id").alias("class_id"), "n_links")


def keep_one_per_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row with the smallest doc_id of each class, in the columns of ``docs``; of rows that repeat id and text,
    one. Rows without doc_id stay, and so do texts without words."""
    named = docs.where("doc_id IS NOT NULL")
    lost = _classes(named, threshold).where("head IS NOT NULL AND NOT (head.k1 = k1 AND head.k2 = k2)").select(*KEY).distinct()
    rest = packed_by_key(named).join(lost, KEY, "left_anti")
    one = rest.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*KEY))).where("n = 1")
    return unpacked(one, docs).unionByName(docs.where("doc_id IS NULL"))
