"""Exact top-k inner products with a pivot-distance index.

Inner product becomes distance by one more component: x gets sqrt(M2 - |x|^2), a query 0, with M2 the largest
squared norm; then d(q, x)^2 = |q|^2 + M2 - 2 <q, x>. Every vector is keyed by its nearest pivot and its
distance to it, which falls in one of the pivot's annuli. By the triangle inequality
d(q, x) >= |d(q, p) - d(x, p)|, so an annulus has a best score that nothing in it can pass. A query takes its annuli
in the order of these: first a block of the best one, whose k-th score is a bound; then the best few, which tighten
it; then all others whose best score reaches the bound. What is visited is searched exactly.

Vectors and queries meet in tiles of a block of an annulus and a block of queries, as whole numbers of two bytes a
component where they fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors that pivots and annuli are fitted on; the most pivots and annuli of a pivot; vectors and queries of a block.
SAMPLE, PIVOTS, ANNULI, BLOCK, QUERIES = 8192, 128, 32, 8192, 65_536
#: Annuli that a query visits before the rest.
FIRST = 4
#: Pairs of an annulus and a block of queries (8 bytes each) up to which they are broadcast.
SMALL = 1_000_000
_EXACT = float(1 << 53)


def _matrix(column: pa.Array, dim: int, quantum: int) -> np.ndarray:
    """Quantised components as doubles; short vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(sizes):
        return np.zeros((0, dim))
    if (sizes == dim).all():
        out = flat.reshape(-1, dim)
    else:
        out = np.zeros((len(sizes), dim))
        out[np.arange(dim) < sizes[:, None]] = flat
    return np.floor(quantum * out)


def _usable(c: Column) -> Column:
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return c.isNotNull() & F.coalesce(F.forall(c, whole), F.lit(True))


class Index:
    """Pivots and annuli, fitted on a sample; small whatever the number of vectors."""

    def __init__(self, sample: np.ndarray, n: int, m2: float):
        cells = int(np.clip(n // 2048, 1, PIVOTS * ANNULI))
        self.m2, rng = m2, np.random.default_rng(5)
        x = self.lift(sample)
        p = min(PIVOTS, len(x), max(1, round(cells**0.5 * 2)))
        self.pivots = x[rng.choice(len(x), p, replace=False)]
        for _ in range(6):
            near = self.distances(x).argmin(axis=1)
            self.pivots = np.array([x[near == i].mean(axis=0) if (near == i).any() else self.pivots[i] for i in range(p)])
        d = self.distances(x)
        near = d.argmin(axis=1)
        rings = max(1, -(-cells // p))
        self.edges = [np.quantile(d[near == i, i], np.arange(1, rings) / rings) if (near == i).any() else np.empty(0) for i in range(p)]
        self.rings = rings

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.m2 - (x * x).sum(axis=1)))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(self.lift(x))
        near = d.argmin(axis=1)
        own = d[np.arange(len(x)), near]
        ring = np.array([np.searchsorted(self.edges[p], r, side="right") for p, r in zip(near, own)], np.int64)
        return near * self.rings + ring, own


def _numbers(rows: list[bytes], dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(-1, dim).astype(np.float64)


def _best(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best k of a block for each query: (query, vector, score)."""
    if exact:
        score = (q @ x.T).astype(np.int64)
    else:  # beyond doubles: Python's integers
        score = (q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T).astype(np.int64)
    own = q_ids[:, None] == ids[None, :]
    for r in range(len(q_ids)):
        s, v = score[r][~own[r]], ids[~own[r]]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            s, v = s[s >= least], v[s >= least]
        order = np.lexsort((v, -s))[:k]
        yield np.full(len(order), q_ids[r]), v[order], s[order]


_ROW = ["cell", "sub", "qb", "kind", "id", "vec"]


def _search(dim: int, k: int, kind_of: str, exact: bool):
    """Rows sorted by (cell, sub, qb, kind): a block's vectors come first and are kept, queries stream by."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vecs, held = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            cell, sub, qb, kind, own = (b.column(i).to_numpy() for i in range(5))
            vec = b.column(5).to_pylist()
            new = np.append(True, (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]) | (qb[1:] != qb[:-1]) | (kind[1:] != kind[:-1]))
            starts = np.append(np.flatnonzero(new), len(cell))
            out: list[tuple] = []
            for a, z in zip(starts, starts[1:]):
                if key != (cell[a], sub[a], qb[a]):
                    key, ids, vecs, held = (cell[a], sub[a], qb[a]), [], [], None
                if kind[a] == 0:
                    ids += own[a:z].tolist()
                    vecs += vec[a:z]
                elif ids:
                    if held is None:
                        held, vecs = (np.array(ids), _numbers(vecs, dim, kind_of)), []
                    for at in range(a, z, 512):
                        part = slice(at, min(z, at + 512))
                        out += _best(*held, own[part], _numbers(vec[part], dim, kind_of), k, exact)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return search


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, quantum: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by ``every``, the ``k``
    highest inner products with the other rows (all, if fewer), ties to the smaller vec_id.

    Components are floor(quantum * x). Rows with a null vec_id, a null vector or a null or non-finite component
    take no part; shorter vectors count as ending in zeros. Rows that repeat a vec_id are candidates each, but
    never of their own id, and ask once. A vector without components is zero. Scores must fit 64 bits; beyond 2^53 they are computed with Python's
    integers. Extra columns are ignored; an empty table gives none."""
    spark = vectors.sparkSession
    v = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.floor(quantum * x).cast("double") * F.floor(quantum * x).cast("double"))
    n, dim, m2 = v.agg(F.count("*"), F.max(F.size("embedding")), F.max(square)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, m2 = max(1, dim), float(m2)  # vectors without components are zeros
    drawn = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    index = Index(_matrix(drawn, dim, quantum), n, m2)

    kind_of = "<i2" if m2 < float(1 << 30) else "<f8"

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim, quantum)
            cell, d = index.cells(x)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d), b.column(0), pa.array([r.tobytes() for r in x.astype(kind_of)], pa.binary())], ["cell", "d", "id", "vec"])

    keyed = written(v.select("vec_id", "embedding").mapInArrow(key, "cell int, d double, id long, vec binary"), "pivot-index")
    cells = sorted((r.cell, r.n, r.low, r.high) for r in keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect())
    cell_no, size, low, high = (np.array(c) for c in zip(*cells))
    subs = -(-size // BLOCK)
    slack = 1e-6 * (1 + m2)  # rounding of distances never hides a candidate
    of_cell = F.broadcast(spark.createDataFrame([(int(c), int(s)) for c, s in zip(cell_no, subs)], "cell int, subs int"))  # PIVOTS * ANNULI rows at most
    asked = written(keyed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec")), "pivot-queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    placed = keyed.join(of_cell, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int").alias("sub"), F.lit(0).alias("kind"), "id", "vec")

    def best_scores(q: np.ndarray) -> np.ndarray:
        """For each query and cell, the most a score can be."""
        lifted = np.column_stack([q, np.zeros(len(q))])
        d = index.distances(lifted)[:, cell_no // index.rings]
        gap = np.maximum(0, np.maximum(d - high, low - d))
        return ((q * q).sum(axis=1)[:, None] + m2 - gap * gap) / 2

    def chosen(vec: list[bytes], least: np.ndarray | None, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) places to visit: in the first step the best annulus, in the second the best few, in the third the
        others; of those, what the bound leaves."""
        most = best_scores(_numbers(vec, dim, kind_of))
        if step == 1:
            return np.arange(len(vec)), most.argmax(axis=1)
        place = (-most).argsort(axis=1, kind="stable").argsort(axis=1)
        return np.nonzero((most >= least[:, None] - slack) & ((place < FIRST) == (step == 2)))

    def parts(b: pa.RecordBatch, step: int):
        for begin in range(0, b.num_rows, 256):
            part = b.slice(begin, 256)
            ids, vec = part.column(0).to_numpy(), part.column(1).to_pylist()
            yield ids, vec, *chosen(vec, part.column(2).to_numpy() if step > 1 else None, step)

    def visited(step: int):
        """Queries -> the annuli that a block of queries visits; only these are shipped to it."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs = {(int(c), int(q)) for ids, _, r, at in parts(b, step) for c, q in np.unique(np.column_stack([cell_no[at], ids[r] // every % blocks]), axis=0)}
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.int32()), pa.array([q for _, q in pairs], pa.int32())], ["cell", "qb"])

        return rows

    def visit(step: int):
        """Queries -> a row for each block of vectors to visit: one of the best annulus in the first step, else all of each."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, vec, r, at in parts(b, step):
                    if step == 1:
                        sub = ids % subs[at]
                    else:
                        times = subs[at]
                        sub = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        r, at = np.repeat(r, times), np.repeat(at, times)
                    for a in range(0, len(r), 20_000):
                        z = slice(a, a + 20_000)
                        cols = [cell_no[at[z]], sub[z], ids[r[z]] // every % blocks, np.ones(len(r[z]))]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cols), pa.array(ids[r[z]]), pa.array([vec[i] for i in r[z]], pa.binary())], _ROW)

        return rows

    row, place = "cell int, sub int, qb int, kind int, id long, vec binary", ["cell", "sub", "qb"]

    def search(queries: DataFrame, step: int) -> DataFrame:
        pairs = queries.mapInArrow(visited(step), "cell int, qb int").distinct()
        # at most a row an annulus and block of queries; beyond what is known to be small, a shuffle
        stored = placed.join(F.broadcast(pairs) if len(cells) * blocks <= SMALL else pairs, "cell")
        meet = stored.select(*_ROW).unionByName(queries.mapInArrow(visit(step), row)).repartition(*place).sortWithinPartitions(*place, "kind")
        return meet.select(*_ROW).mapInArrow(_search(dim, k, kind_of, m2 < _EXACT), "query_id long, vec_id long, score long")

    def bounded(found: DataFrame) -> DataFrame:
        """Queries with the k-th score of what they have found, if they have found so many."""
        first = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") == k)
        bound = asked.join(first.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least")), "id", "left")
        return bound.select("id", "vec", F.coalesce("least", F.lit(float("-inf"))).alias("least"))

    few = written(search(written(bounded(search(asked, 1)), "pivot-bounds"), 2), "pivot-first")
    found = few.unionByName(search(written(bounded(few), "pivot-bounds"), 3))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
