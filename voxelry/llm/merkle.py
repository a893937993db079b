"""A Merkle manifest of a dataset: checkpoint and recompute.

Rows are the leaves of one tree a source, and the sources' roots those of one tree above. Of a tree only every
EVERY-th level is kept, so a kept node stands over an aligned subtree of 3^EVERY kept nodes at most. A proof is
extracted from the top down: each subtree's missing interior nodes are made again from its kept descendants, every
descendant's siblings are given out behind those of the subtree's root, and the interior nodes are dropped.

Rows are named by source and by their place in it. Places come from a range partition, and subtrees are groups of
bounded size, so a source with most of the rows is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Nodes of a run; levels from one that is kept to the next.
RUN, EVERY = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree above the sources' trees; a source's own begins with "s", a null source's is the "-" alone.
TOP = ""
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def leaf(**changed: Column) -> Column:
    """A row's leaf: of each field `-` if null, else its UTF-8 byte count, a colon and the value."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def _tree(source: Column) -> Column:
    """A tree's name; by name, a null source comes first and others in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))


@dataclass
class Manifest:
    """``levels``: the kept levels of all sources' trees, leaves first, (tree, at, node, n, depth); at is a node's place
    in its level, n the leaves of its tree, depth the tree's levels. ``top``: the same of the tree of sources, whose
    leaves also hold ``of``, the name of the source's tree. Leaves of ``levels`` hold what they were given besides."""

    levels: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """One row: the root; none for an empty table."""
        return self.top[-1].select(F.col("node").alias("root"))


def _placed(leaves: DataFrame) -> DataFrame:
    """Leaves (tree, key, node, ...) with at, their place by (key, node) in their tree, and n. Equal leaves of a tree are
    told apart by ``same``, which spreads them over the ranges and changes no digest."""
    order = ["key", "node", "same"]
    ranged = written(leaves.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    own = ranged.groupBy("part", "tree").agg(F.count("*").alias("own"))  # as many rows as there are partitions and trees
    tree = Window.partitionBy("tree")
    counts = own.withColumns({"before": F.sum("own").over(tree.orderBy("part")) - F.col("own"), "n": F.sum("own").over(tree)})
    place = ranged.withColumn("place", F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order)))
    return place.join(counts, ["part", "tree"]).withColumn("at", F.col("before") + F.col("place") - 1).drop("part", "place", "own", "before", "same")


def _depth(n: Column) -> Column:
    """Levels above n leaves: the least d with RUN^d >= n, in whole numbers."""
    return reduce(lambda d, p: F.when(n > RUN**p, p + 1).otherwise(d), range(40), F.lit(0))


def _up(nodes: Column) -> Column:
    """The level above: each run of RUN consecutive nodes becomes its digest."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN)), lambda i: F.sha2(F.array_join(F.slice(nodes, (i * RUN + 1).cast("int"), RUN), ""), 256))


def _subtrees(level: DataFrame, height: int, *carried: str) -> DataFrame:
    """(tree, block, n, depth, below, l0 .. l4): the kept nodes of each aligned subtree in order, and the interior levels
    made from them. Trees that end below the next kept level stop at their root. ``below`` holds (at, node) and what is
    carried; 3^EVERY at most."""
    below = F.sort_array(F.collect_list(F.struct("at", "node", *carried))).alias("below")
    blocks = level.groupBy("tree", F.floor(F.col("at") / RUN**EVERY).alias("block"), "n", "depth").agg(below)
    out = blocks.withColumn("l0", F.col("below.node"))
    for i in range(EVERY):
        out = out.withColumn(f"l{i + 1}", F.when(F.col("depth") > height + i, _up(F.col(f"l{i}"))).otherwise(F.col(f"l{i}")))
    return out


def _kept_levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Leaves (tree, at, node, n, ...) -> the kept levels, the last of which is the roots'."""
    levels = [written(leaves.withColumn("depth", _depth(F.col("n"))), f"{name}-0")]
    deepest = levels[0].agg(F.max("depth")).first()[0] or 0
    for height in range(0, deepest, EVERY):
        up = _subtrees(levels[-1].select("tree", "at", "node", "n", "depth"), height)
        levels.append(written(up.select("tree", F.col("block").alias("at"), F.col(f"l{EVERY}")[0].alias("node"), "n", "depth"), f"{name}-{height + EVERY}"))
    return levels


def manifest(docs: DataFrame, **carried: Column) -> Manifest:
    """The manifest of ``docs``; leaves keep the ``carried`` columns. Texts are read once and not moved.

    Any column may be null. A source's leaves ascend by doc_id (null first), rows of an equal doc_id by their leaf; equal
    rows are leaves each. Other columns are ignored. An empty table has no tree and no root."""
    leaves = docs.select(_tree(F.col("source").cast("string")).alias("tree"), F.col("doc_id").alias("key"), leaf().alias("node"), *[c.alias(k) for k, c in carried.items()], F.monotonically_increasing_id().alias("same"))
    levels = _kept_levels(_placed(leaves), "merkle")
    roots = levels[-1].select(F.lit(TOP).alias("tree"), F.col("tree").alias("key"), "node", F.lit(0).alias("same"), F.col("tree").alias("of"))
    return Manifest(levels, _kept_levels(_placed(roots), "merkle-top"))


def _siblings(at: Column, level: Column, i: int) -> Column:
    """Siblings of the node over place ``at`` of a subtree, on the subtree's level i, before and after it."""
    own = F.floor(at / RUN**i).cast("int")
    first = own - own % RUN
    return F.struct(F.array_join(F.slice(level, first + 1, own - first), "").alias("before"), F.array_join(F.slice(level, own + 2, first + RUN - 1 - own), "").alias("after"))


def _descend(levels: list[DataFrame], above: DataFrame, *carried: str) -> DataFrame:
    """(tree, at, node, path, ...) of the lowest level. ``above``: (tree, at, path, ...) of the last level's nodes. path
    holds, from a node to the root, what stands before and after it in its run."""
    passed = [c for c in above.columns if c not in ("tree", "at", "path")]
    for k in range(len(levels) - 2, -1, -1):
        subtrees = _subtrees(levels[k], k * EVERY, *(carried if k == 0 else ()))
        rows = subtrees.join(above.withColumnRenamed("at", "block"), ["tree", "block"]).select("tree", "depth", "path", *passed, *[f"l{i}" for i in range(EVERY)], F.posexplode("below").alias("place", "x"))
        steps = [F.when(F.col("depth") > k * EVERY + i, F.array(_siblings(F.col("place"), F.col(f"l{i}"), i))).otherwise(F.array().cast(_PATH)) for i in range(EVERY)]
        above = rows.select("tree", "x.*", F.concat(*steps, "path").alias("path"), *passed)
        if k:
            above = written(above.drop("node"), "merkle-paths")  # one row a kept interior node
    return above


def fold(node: Column, path: Column) -> Column:
    """The root that a node and the siblings on its way lead to."""
    return F.aggregate(path, node, lambda h, x: digest(x["before"], h, x["after"]))


def proofs(kept: Manifest, *carried: str) -> DataFrame:
    """(leaf, subroot, root, path, ...) of every row; path has the siblings level by level through subroot to root."""
    root = kept.root()  # one row
    top = kept.top[-1].select("tree", "at", F.array().cast(_PATH).alias("path"))
    if len(kept.top) == 1:  # one source or none
        sources = kept.top[0].select("of", F.col("node").alias("subroot"), F.array().cast(_PATH).alias("path"))
    else:
        sources = _descend(kept.top, top, "of").select("of", F.col("node").alias("subroot"), "path")
    sources = sources.crossJoin(F.broadcast(root))
    above = written(sources.select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("at"), "path", "subroot", "root"), "merkle-sources")
    if len(kept.levels) == 1:  # no source has two rows
        return kept.levels[0].join(above, ["tree", "at"]).select(F.col("node").alias("leaf"), "subroot", "root", "path", *carried)
    return _descend(kept.levels, above, *carried).select(F.col("node").alias("leaf"), "subroot", "root", "path", *carried)


def verified(rows: DataFrame) -> DataFrame:
    """Rows of proofs() with ``now``, the leaf as it is found now: adds folded_root and verified."""
    folded = rows.withColumn("folded_root", fold(F.col("now"), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``, each row's proof held
    against the row after a tampering: where crc32(doc_id) is even, text has lost its line ends. A null doc_id or text
    is not tampered with. proof_sha256 is of all siblings, of the empty string where there are none."""
    torn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    now = F.when(torn & F.contains("text", F.lit("\n")), leaf(text=F.replace("text", F.lit("\n"), F.lit(""))))
    kept = manifest(docs, doc_id=F.col("doc_id").cast("long"), changed=now)
    rows = verified(proofs(kept, "doc_id", "changed").withColumn("now", F.coalesce("changed", "leaf")))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)) + i)), 4294967295::BIGINT)"
_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(text if c == "text" else c) for c in FIELDS) + ")"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF("text")} AS leaf,
    CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS now
  FROM documents
), o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d
), t(source, level, pos, n, node) AS (
  SELECT source, 0, pos, n, leaf FROM o
  UNION ALL
  SELECT source, level + 1, pos // {RUN}, (n + {RUN - 1}) // {RUN}, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY source, level, pos // {RUN}, n
), s AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), u(level, pos, n, node) AS (
  SELECT 0, pos, n, subroot FROM s
  UNION ALL
  SELECT level + 1, pos // {RUN}, (n + {RUN - 1}) // {RUN}, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // {RUN}, n
), a AS (
  SELECT o.doc_id, o.source, o.leaf, o.pos AS place, o.now, t.level, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < o.pos // CAST(power({RUN}, t.level) AS BIGINT)), '') AS before,
    coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > o.pos // CAST(power({RUN}, t.level) AS BIGINT)), '') AS after
  FROM o JOIN t ON t.source IS NOT DISTINCT FROM o.source AND t.pos // {RUN} = o.pos // CAST(power({RUN}, t.level + 1) AS BIGINT) WHERE t.n > 1 GROUP BY ALL
), b AS (
  SELECT s.source, u.level, coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos < s.pos // CAST(power({RUN}, u.level) AS BIGINT)), '') AS before,
    coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos > s.pos // CAST(power({RUN}, u.level) AS BIGINT)), '') AS after
  FROM s JOIN u ON u.pos // {RUN} = s.pos // CAST(power({RUN}, u.level + 1) AS BIGINT) WHERE u.n > 1 GROUP BY s.source, s.pos, u.level
), p AS (
  SELECT source, place, list(before || ',' || after ORDER BY level) AS path FROM a GROUP BY source, place
), q AS (
  SELECT source, list(before || ',' || after ORDER BY level) AS path FROM b GROUP BY source
), f AS (
  SELECT o.doc_id, o.leaf, s.subroot, (SELECT node FROM u WHERE n = 1) AS root, o.now, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path
  FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source LEFT JOIN p ON p.source IS NOT DISTINCT FROM o.source AND p.place = o.pos LEFT JOIN q ON q.source IS NOT DISTINCT FROM o.source
), g AS (
  SELECT *, list_reduce(list_prepend(now, path), lambda h, x: sha256(split_part(x, ',', 1) || h || split_part(x, ',', 2))) AS folded_root FROM f
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), ',', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g
"""
