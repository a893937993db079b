"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source whose target is r times its size takes every document floor(r) times, and once more with the
fractional probability. Fractional documents are paired; words of probability mass move from one to the
other, in a random direction that keeps every expectation, until one of them is integral. Each pair keeps
the expected number of words, so what a source takes differs from its target by less than one document.
Fractional documents are numbered in range partitions, source by source in order of a hash, and pairs are made
inside buckets of 64 neighbours at most, however many rows are alike; the one residual a bucket leaves goes up to
the next level of a reduction tree whose depth is the logarithm of the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.ranking import global_rank

from .common import written

WEIGHTS, MOST = (1, 2, 3), 3
FAN_IN = 64
_EPS = "1e-9D"


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, target: weights 1, 2, 3, repeating over the sources by code point, null
    last, share all sizes; a target stops at 3 times its source's size and the excess is shared again."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "place")
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = s.withColumn("place", F.row_number().over(by_name))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", MOST * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything)).withColumn("weight", F.sum("w").over(everything))
    left = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("weight") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("cap") / F.col("w") <= left)
    full = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    used = F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("total") - full).cast("double") * F.col("w") / (F.col("weight") - used))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def _number(digest: str, digits: int) -> str:
    """The first hexadecimal digits of an MD5 digest as a number; a hash that any SQL engine has."""
    return f"CAST(conv(substring(md5({digest}), 1, {digits}), 16, 10) AS bigint)"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_UNIT = "struct<rnd: bigint, doc_id: bigint, size: bigint, p: double>"
_DONE = "array<struct<doc_id: bigint, size: bigint, more: int>>"


def _fold(seed: int) -> Column:
    """Pairs the units of a sorted bucket in turn. Gives (unit: the residual or null, done: decided documents)."""
    state = lambda unit, done: f"named_struct('unit', CAST({unit} AS {_UNIT}), 'done', {done})"
    decide = lambda x, p: f"named_struct('doc_id', {x}.doc_id, 'size', {x}.size, 'more', CAST(if({p} > 0.5D, 1, 0) AS int))"
    going = lambda x, p: f"named_struct('rnd', {x}.rnd, 'doc_id', {x}.doc_id, 'size', {x}.size, 'p', {p})"
    part = lambda p: f"({p} > {_EPS} AND {p} < 1 - {_EPS})"
    coin = _number(f"concat_ws(':', s.unit.rnd, u.rnd, {seed})", 7)
    # up: words that can move from u to s.unit; down: the other way
    moves = f"named_struct('up', least((1 - s.unit.p) * s.unit.size, u.p * u.size), 'down', least(s.unit.p * s.unit.size, (1 - u.p) * u.size), 'coin', {coin} / 268435456D)"
    moved = "named_struct('a', s.unit.p + m.by / s.unit.size, 'b', u.p - m.by / u.size)"
    after = (
        f"CASE WHEN {part('x.a')} THEN {state(going('s.unit', 'x.a'), f'concat(s.done, array({decide("u", "x.b")}))')} "
        f"WHEN {part('x.b')} THEN {state(going('u', 'x.b'), f'concat(s.done, array({decide("s.unit", "x.a")}))')} "
        f"ELSE {state('NULL', f'concat(s.done, array({decide("s.unit", "x.a")}, {decide("u", "x.b")}))')} END"
    )
    by = "named_struct('by', if(v.coin * (v.up + v.down) < v.down, v.up, -v.down))"
    pair = _let(moves, "v", _let(by, "m", _let(moved, "x", after)))
    step = f"CASE WHEN s.unit IS NULL THEN {state('u', 's.done')} ELSE {pair} END"
    return F.expr(f"aggregate(units, {state('NULL', f'CAST(array() AS {_DONE})')}, (s, u) -> {step})")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    size is the number of words (runs without ASCII white space), 0 for null. taken is a multiple of size, at
    most 3 times it; an empty document takes 0. Randomness comes from hashes of doc_id, text and ``seed``, so
    reruns agree. A null source is a source of its own, last in order. Null or repeated doc_ids are rows of
    their own. Other columns are ignored; an empty table gives an empty table."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.expr(_number(f"concat_ws(':', doc_id, text, {seed})", 15)).alias("rnd"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")  # tells equal rows apart
    targets = written(source_targets(rows), "mix-targets").select(F.col("source").alias("s"), "source_size", "n_docs", "target")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(ratio + F.lit(1e-12))).withColumn("p", ratio - F.col("whole"))
    split = (F.col("p") > 1e-9) & (F.col("size") > 0)
    row = rows.join(targets, F.col("source").eqNullSafe(F.col("s")))
    done = [row.where(~split).select("source", "doc_id", "size", F.lit(0).alias("more"))]
    ranked = global_rank(row.where(split).select("source", "rnd", "doc_id", "size", "p", "row"), "source", "rnd", "doc_id", "row")
    units = ranked.select("source", F.floor((F.col("rank") - 1) / FAN_IN).alias("bucket"), F.struct("rnd", "doc_id", "size", "p").alias("unit"))
    most, level = targets.agg(F.coalesce(F.sum("n_docs"), F.lit(1))).first()[0], 0
    buckets = -(-most // FAN_IN)
    while True:
        folded = units.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        folded = written(folded.select("source", "bucket", _fold(seed + level).alias("f")).select("source", "bucket", "f.*"), "mix-level")
        done.append(folded.select("source", F.inline("done")))
        rest = folded.where(F.col("unit").isNotNull())
        if buckets == 1:
            break
        buckets, level = -(-buckets // FAN_IN), level + 1
        units = rest.select("source", F.floor(F.col("bucket") / FAN_IN).alias("bucket"), "unit")
    coin = F.expr(_number("concat_ws(':', unit.rnd, 'last')", 7)) / float(1 << 28)
    done.append(rest.select("source", "unit.doc_id", "unit.size", (coin < F.col("unit.p")).cast("int").alias("more")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.join(targets, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("more")) * F.col("size")).cast("long").alias("taken")
    )


def _oracle(seed: int = 17, levels: int = 3) -> str:
    """The mix as SQL for DuckDB, in full for 64^levels documents. A level pairs the units of a bucket by a recursive
    walk along its order, the same steps as above."""
    number = lambda digest, digits: f"CAST('0x' || substr(md5({digest}), 1, {digits}) AS BIGINT)"
    part = lambda p: f"({p} > 1e-9 AND {p} < 1 - 1e-9)"
    ctes = []
    for k in range(levels):
        # t: the next unit's place; held: what goes on from the units before it
        ctes.append(f"o{k} AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY rnd, doc_id, size, p) AS t FROM u{k})")
        coin = number(f"concat_ws(':', h.rnd, o.rnd, {seed + k})", 7) + " / 268435456.0::DOUBLE"
        ctes.append(f"""w{k} AS (
  SELECT source, bucket, 1 AS t, rnd, doc_id, size, p, NULL::BIGINT AS d1, NULL::BIGINT AS s1, NULL::INT AS m1, NULL::BIGINT AS d2, NULL::BIGINT AS s2, NULL::INT AS m2 FROM o{k} WHERE t = 1
  UNION ALL
  SELECT source, bucket, t,
    CASE WHEN none THEN o_rnd WHEN keep_a THEN rnd WHEN keep_b THEN o_rnd END, CASE WHEN none THEN o_doc WHEN keep_a THEN doc_id WHEN keep_b THEN o_doc END,
    CASE WHEN none THEN o_size WHEN keep_a THEN size WHEN keep_b THEN o_size END, CASE WHEN none THEN o_p WHEN keep_a THEN a WHEN keep_b THEN b END,
    CASE WHEN none OR keep_a THEN NULL ELSE doc_id END, CASE WHEN none OR keep_a THEN NULL ELSE size END, CASE WHEN none OR keep_a THEN NULL ELSE (a > 0.5)::INT END,
    CASE WHEN none OR (keep_b AND NOT keep_a) THEN NULL ELSE o_doc END, CASE WHEN none OR (keep_b AND NOT keep_a) THEN NULL ELSE o_size END, CASE WHEN none OR (keep_b AND NOT keep_a) THEN NULL ELSE (b > 0.5)::INT END
  FROM (SELECT *, rnd IS NULL AS none, {part('a')} AS keep_a, {part('b')} AS keep_b FROM (
    SELECT *, p + move / size AS a, o_p - move / o_size AS b FROM (
      SELECT *, CASE WHEN coin * (up + down) < down THEN up ELSE -down END AS move FROM (
        SELECT h.source, h.bucket, o.t, h.rnd, h.doc_id, h.size, h.p, o.rnd AS o_rnd, o.doc_id AS o_doc, o.size AS o_size, o.p AS o_p, {coin} AS coin,
          least((1 - h.p) * h.size, o.p * o.size) AS up, least(h.p * h.size, (1 - o.p) * o.size) AS down
        FROM w{k} h JOIN o{k} o ON o.source IS NOT DISTINCT FROM h.source AND o.bucket = h.bucket AND o.t = h.t + 1)))))""")
        ctes.append(f"u{k + 1} AS (SELECT source, bucket // 64 AS bucket, rnd, doc_id, size, p FROM (SELECT * FROM w{k} QUALIFY t = max(t) OVER (PARTITION BY source, bucket)) WHERE rnd IS NOT NULL)")
    done = " UNION ALL ".join(f"SELECT source, d{i} AS doc_id, s{i} AS size, m{i} AS more FROM w{k} WHERE d{i} IS NOT NULL" for k in range(levels) for i in (1, 2))
    last = number("concat_ws(':', rnd, 'last')", 7) + " / 268435456.0::DOUBLE"
    return f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, {number(f"concat_ws(':', doc_id, text, {seed})", 15)} AS rnd FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM r GROUP BY source
), f AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER o, 0)) / (weight - coalesce(sum(w) OVER o, 0)) AS free
  FROM (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weight FROM s) WINDOW o AS (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, 3 * source_size / w <= free AS capped FROM f
), g AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (total - full_)::DOUBLE * w / (weight - used) END AS target
  FROM (SELECT *, sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS full_, sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS used FROM c)
), h AS (
  SELECT *, floor(ratio + 1e-12::DOUBLE) AS whole, ratio - floor(ratio + 1e-12::DOUBLE) AS p FROM (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0 END AS ratio FROM g)
), x AS (
  SELECT r.*, p FROM r JOIN h ON h.source IS NOT DISTINCT FROM r.source
), u0 AS (
  SELECT source, (row_number() OVER (ORDER BY source NULLS FIRST, rnd, doc_id) - 1) // 64 AS bucket, rnd, doc_id, size, p FROM x WHERE p > 1e-9 AND size > 0
), {', '.join(ctes)}, done AS (
  SELECT source, doc_id, size, 0 AS more FROM x WHERE NOT (p > 1e-9 AND size > 0) UNION ALL {done} UNION ALL SELECT source, doc_id, size, ({last} < p)::INT FROM u{levels}
)
SELECT doc_id, size, source_size, target, CAST((whole + more) * size AS BIGINT) AS taken FROM done d JOIN h ON h.source IS NOT DISTINCT FROM d.source
"""


ORACLE = _oracle()
