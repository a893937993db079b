"""Secrets in texts, told from examples by who owns them, in DataFrame functions only.

Base spans come from three patterns. Beside them, every run of a secret's characters that holds a digit and a letter is
a candidate. Of each candidate value, as a hash, the whole corpus tells the distinct repositories that hold it and their
distinct owners. A value of many owners is a widely copied example. One of few owners is their own; if it also looks
random it is live, and it is a span, of the kind `own`, wherever it stands without the words that a base pattern asks
for. So is a value of few owners that a base span has given away elsewhere.

A repository is a text (copies of it are forks, credited to the first of their owners), an owner is a source; other
columns can be named for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, row_key, unpacked, written

# The contract's patterns. What they match is the same; counts and look-arounds keep failing runs cheap.
_RUN = "A-Za-z0-9+/_.=-"
PATTERNS = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([{_RUN}]+)",
    "access": "AKIA[A-Z0-9]{14,}+",
    "hex": "(?<![0-9a-f])[0-9a-f]{16,}+",
}
KINDS = tuple(PATTERNS)
OWN = "own"
#: Group of a match that is the secret; least length of an assigned one.
_VALUE, ASSIGNED = {"assign": 1}, 12
_CANDIDATE = rf"(?<![{_RUN}])(?=[+/_.=0-9-]*+[A-Za-z])(?=[A-Za-z+/_.=-]*+[0-9])[{_RUN}]{{12,}}+"
#: Owners from which on a value counts as widely copied.
COPIED = 3
#: Least length and distinct characters of what looks random; a candidate without a base pattern around it also needs
#: small and capital letters, and more of both figures.
LIVE, ALONE = (16, 8), (20, 12)
#: A value with one of these in it is made up.
PLACEHOLDER = "(?i:example|sample|dummy|changeme|placeholder|redacted|your|xxxx|0000|1234567)"
_MATCH = "array<struct<kind:string,i:int,before:int,n:int,value:string>>"
_HASH = ["v1", "v2"]


def _key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.struct(*row_key(doc_id, text)).alias("k")


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """An array of (kind, i, before, n, value): before is the length of what lies between a match and the one before."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(_VALUE[kind])) if kind in _VALUE else whole
    row = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["1"]).alias("before"), F.length(x["0"]).alias("n"), x["2"].alias("value"))
    # a gap more than there are matches; names by place, as they would be those of the calls
    zipped = F.arrays_zip(whole.alias("0"), F.slice(gaps, F.lit(1), F.size(whole)).alias("1"), value.alias("2"))
    return F.when(text.rlike(pattern), F.transform(zipped, row)).otherwise(F.array().cast(_MATCH))


def _distinct(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def candidates(docs: DataFrame, owner: str = "source", repository: str | None = None) -> DataFrame:
    """(k, kind, i, before, n, valid, random, alone, v1, v2, owner, r1, r2) of all matches of all rows: k names a row by id and text,
    v1 and v2 the value, r1 and r2 the repository; random and alone say what the value looks like."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = lambda c, names: [F.xxhash64(F.lit(seed), c).alias(x) for seed, x in enumerate(names)]
    held = docs.select(_key(), F.col(owner).cast("string").alias("owner"), *hashed(F.col(repository) if repository else text, ["r1", "r2"]), text.alias("text"))
    every = F.concat(*[_matches(F.col("text"), kind, p) for kind, p in (PATTERNS | {OWN: _CANDIDATE}).items()])
    found = held.select("k", "owner", "r1", "r2", F.explode(every).alias("x")).select("k", "owner", "r1", "r2", "x.*")
    of = lambda least: (F.length("value") >= least[0]) & (_distinct(F.col("value")) >= least[1]) & ~F.col("value").rlike(PLACEHOLDER)
    mixed = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]")
    valid = (F.col("kind") != "assign") | (F.length("value") >= ASSIGNED)
    return found.select("k", "kind", "i", "before", "n", valid.alias("valid"), of(LIVE).alias("random"), (of(ALONE) & mixed).alias("alone"), *hashed(F.col("value"), _HASH), "owner", "r1", "r2")


def ownership(found: DataFrame) -> DataFrame:
    """(v1, v2, n_repositories, n_owners, given) of each candidate value; given says that a base span holds it. A null owner
    counts as one. Every step sums up what a task has before it is moved."""
    held = found.where("valid").groupBy(*_HASH, "r1", "r2").agg(F.min(F.coalesce("owner", F.lit(""))).alias("owner"), F.max(F.col("kind") != OWN).alias("given"))
    by_owner = held.groupBy(*_HASH, "owner").agg(F.count("*").alias("n"), F.max("given").alias("given"))
    return by_owner.groupBy(*_HASH).agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"), F.max("given").alias("given"))


def placed(found: DataFrame) -> DataFrame:
    """Valid matches with start and stop in code points, once a row however often it is repeated; candidates that overlap a
    base span are left out."""
    own = Window.partitionBy("k", "kind").orderBy("i")
    stop = F.sum(F.col("before") + F.col("n")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    once = found.drop("owner", "r1", "r2").dropDuplicates(["k", "kind", "i"])
    rows = once.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("n")).where("valid")
    line = Window.partitionBy("k").orderBy("start", F.col("kind") == OWN)
    base = F.col("kind") != OWN
    reach = F.max(F.when(base, F.col("stop"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(base, F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"reach": reach, "ahead": ahead}).where("kind <> 'own' OR (coalesce(reach <= start, true) AND coalesce(ahead >= stop, true))").drop("reach", "ahead", "i", "before", "n", "valid")


def secret_spans(docs: DataFrame, owner: str = "source", repository: str | None = None, copied: int = COPIED) -> DataFrame:
    """(k, kind, start, stop, n_repositories, n_owners, live) of base and added spans."""
    found = written(candidates(docs, owner, repository), "secret-candidates")
    # Both sides behind plain reads: Spark can split the join on a value that very many rows hold.
    owned, spans = written(ownership(found), "secret-ownership"), written(placed(found), "secret-places")
    rows = spans.join(owned, _HASH)
    few = F.col("n_owners") < copied
    live = few & (F.col("random") & F.col("given") | F.col("alone"))
    return rows.withColumn("live", live).where((F.col("kind") != OWN) | few & (F.col("given") | F.col("alone"))).select("k", "kind", "start", "stop", "n_repositories", "n_owners", "live")


def _by_row(spans: DataFrame, copied: int) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, (*KINDS, OWN))), F.col("kind"))
    span = F.struct("start", place.alias("o"), "stop", "kind", "live", (F.col("n_owners") >= copied).alias("copied"))
    return spans.groupBy("k").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def secret_digest(docs: DataFrame, owner: str = "source", repository: str | None = None, copied: int = COPIED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_own, n_live, n_copied, live for every row of ``docs``.

    Spans are kind:start:stop in code points, stop exclusive, by start, then kind (assign, access, hex, own), comma-joined;
    base_sha256 is of the base ones. n_live counts the spans whose value looks random and has few owners, n_copied those
    whose value has many; live lists the former. Null text is empty and has none. Spans belong to (doc_id, text): repeated
    rows get the same ones, rows that share a doc_id their own; null doc_ids are fine. Spans of different base kinds may
    overlap, added ones overlap none. Other columns are ignored. An empty table gives none."""
    rows = docs.select("doc_id", _key()).join(_by_row(secret_spans(docs, owner, repository, copied), copied), "k", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,o:bigint,stop:bigint,kind:string,live:boolean,copied:boolean>>"))
    rows = rows.select("doc_id", spans.alias("spans"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    those = lambda which: F.filter("spans", which)
    count = lambda which: F.size(those(which)).cast("long")
    of = lambda kind: count(lambda x: x["kind"] == kind)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(text(those(lambda x: x["kind"] != OWN)), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        of(OWN).alias("n_own"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: x["copied"]).alias("n_copied"),
        text(those(lambda x: x["live"])).alias("live"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: str | None = None, copied: int = COPIED) -> DataFrame:
    """``docs`` with live secrets in ``text`` replaced by [SECRET]; copied examples stay. Of overlapping spans the first by
    start goes, then the longer. Null stays null."""
    live = secret_spans(docs, owner, repository, copied).where("live")
    by_start = live.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("start", (-F.col("stop")).alias("end")))).alias("spans"))
    out = packed(docs).withColumn("k", _key("doc.doc_id", "doc.text")).join(by_start, "k", "left").withColumn("text", F.col("doc.text"))
    fold = F.expr(
        "aggregate(spans, named_struct('at', 0L, 'out', ''), (s, x) -> if(x.start < s.at, s, named_struct('at', -x.end, 'out', "
        "concat(s.out, substring(text, CAST(s.at + 1 AS int), CAST(x.start - s.at AS int)), '[SECRET]'))), s -> concat(s.out, substring(text, CAST(s.at + 1 AS int))))"
    )
    return unpacked(out, docs, text=F.when(F.col("spans").isNull(), F.col("text")).otherwise(fold))


_SQL_PATTERNS = {"assign": PATTERNS["assign"].replace("'", "''"), "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}", OWN: f"[{_RUN}]{{12,}}"}
_MATCHES = "\n  UNION ALL ".join(
    f"SELECT id, doc_id, source, text, '{kind}' AS kind, {o} AS o, unnest(list_zip(regexp_extract_all(text, '{p}'), regexp_extract_all(text, '{p}', {_VALUE.get(kind, 0)}), string_split_regex(text, '{p}')[:len(regexp_extract_all(text, '{p}'))])) AS x, unnest(range(0, len(regexp_extract_all(text, '{p}')))) AS i FROM d"
    for o, (kind, p) in enumerate(_SQL_PATTERNS.items(), 1)
)
_LOOKS = "length(value) >= {0} AND len(list_distinct(string_split(value, ''))) >= {1} AND NOT regexp_matches(value, '" + PLACEHOLDER + "')"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents
), a AS (
  {_MATCHES}
), m AS (
  SELECT id, doc_id, source, text, kind, o, i, x[2] AS value, sum(length(x[3]) + length(x[1])) OVER (PARTITION BY id, kind ORDER BY i) AS stop, length(x[1]) AS n FROM a
), v AS (
  SELECT id, doc_id, source, text, kind, o, value, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, {_LOOKS.format(*LIVE)} AS random,
    {_LOOKS.format(*ALONE)} AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]') AS alone
  FROM m WHERE CASE kind WHEN 'assign' THEN length(value) >= {ASSIGNED} WHEN '{OWN}' THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') ELSE true END
), h AS (
  SELECT value, text, min(coalesce(source, '')) AS owner, bool_or(kind <> '{OWN}') AS given FROM v GROUP BY value, text
), w AS (
  SELECT value, count(DISTINCT owner) AS owners, bool_or(given) AS given FROM h GROUP BY value
), s AS (
  SELECT v.*, owners >= {COPIED} AS copied, owners < {COPIED} AND (random AND given OR alone) AS live FROM v JOIN w USING (value)
  WHERE kind <> '{OWN}' OR owners < {COPIED} AND (given OR alone) AND NOT EXISTS (SELECT 1 FROM v b WHERE b.id = v.id AND b.kind <> '{OWN}' AND b.start < v.stop AND v.start < b.stop)
), t AS (
  SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (kind <> '{OWN}') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans,
    count(*) FILTER (kind = '{OWN}') AS n_own, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (live) AS live
  FROM s GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_own, 0) AS n_own, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(live, '') AS live
FROM d LEFT JOIN t USING (id)
"""
