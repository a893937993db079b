"""Finding and sanitising personal data, in DataFrame functions only.

Base spans come from four patterns. Then, information-theoretic sanitisation: from the terms that stand near
each protected entity (a base value), corpus co-occurrence estimates how much a term reveals of the entity.
With n(c, t) occurrences of term t near entity c, n(c) of any term near c, N(t) of t anywhere and T of all
terms (runs of letters, digits, ' and - with a letter or digit, of any length), the disclosure of t is PMI(c; t) / IC(c) = log2(n(c,t) T / (n(c) N(t))) / -log2(n(c) / T): 1 if t
occurs nowhere but near c. The same is counted in documents that hold c, t, both or anything, and the larger
disclosure counts. All documents are counted, copies and repeated rows too; but a term must be seen in SUPPORT documents
in which the entity's surroundings are unlike. Terms beyond a threshold are generalised, beyond a higher one removed, wherever they stand in
a document that holds the entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, row_key, unpacked, written

# Possessive repeats: the same matches, but no recursion on long runs. The look-behind keeps a run of
# local-part characters from being tried at each of its characters; \G is the end of the match before.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = "term"
_WORD = r"[\p{L}\p{N}'-]+"
_APART = r"[^\p{L}\p{N}'-]+"
#: Characters and terms on each side of an entity that count as near it.
REACH, NEAR = 120, 8
#: Least disclosure to generalise and to remove a term; least documents with unlike surroundings it must be seen in.
GENERALISE, REMOVE, SUPPORT = 0.9, 0.98, 3
#: Entities of a document beyond which its pairs of entities and terms are dealt to several tasks.
SPLIT = 64


def _key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A row's 128-bit key as one column."""
    return F.struct(*row_key(doc_id, text)).alias("k")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    term = lambda p, d: d if p % 2 == 0 else F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = [F.when(F.length(digits) > p, term(p, F.substring(back, p + 1, 1).cast("int"))).otherwise(0) for p in range(19)]
    return reduce(lambda a, b: a + b, total) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    n = F.length(_digits(m))
    return (
        F.when(kind == "ip", m.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", n.between(16, 19) & _luhn(F.substring(_digits(m), 1, 19)))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _matches(text: Column, kind: str) -> Column:
    """An array of (kind, i, before, m, left, right): before is the length of what lies between the match and
    the one before it, left and right are its surroundings."""
    pattern = F.lit(PATTERNS[kind])
    likely = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    parts = F.split(text, PATTERNS[kind], -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)), parts, F.slice(parts, F.lit(2), F.size(parts)))
    row = lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x["1"]).alias("before"), x["0"].alias("m"), F.right(x["1"], F.lit(REACH)).alias("left"), F.left(x["2"], F.lit(REACH)).alias("right")
    )
    some = F.transform(F.filter(zipped, lambda x: x["0"].isNotNull()), row)
    return F.when(likely & text.rlike(PATTERNS[kind]), some).otherwise(F.array().cast("array<struct<kind:string,i:int,before:int,m:string,left:string,right:string>>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(k, kind, start, stop, m, left, right) of the base spans; k is the row's key by id and text, places are code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(_key(), F.explode(F.concat(*[_matches(text, kind) for kind in KINDS])).alias("x")).select("k", "x.*")
    place = Window.partitionBy("k", "kind").orderBy("i")
    gone = F.sum("before").over(place) + F.coalesce(F.sum(F.length("m")).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = found.repartition("k", "kind").dropDuplicates(["k", "kind", "i"]).withColumn("start", gone)
    rows = rows.withColumn("stop", F.col("start") + F.length("m")).where(_valid(F.col("kind"), F.col("m")))
    return rows.select("k", "kind", "start", "stop", "m", "left", "right")


def _terms(side: str) -> Column:
    """An array of (term, start, stop) of the NEAR terms next to the entity on one side."""
    text = F.col(side)
    found, parts = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.split(text, _WORD, -1)
    length = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    begin = F.col("start") - F.length(text) if side == "left" else F.col("stop")
    # what REACH cuts off may be part of a longer term
    if side == "left":
        whole = lambda at, stop: (at > begin) | (F.length(text) < REACH)
    else:
        whole = lambda at, stop: (stop < begin + REACH) | (F.length(text) < REACH)
    at = F.transform(found, lambda m, i: F.struct(F.lower(m).alias("term"), (begin + length(F.slice(parts, F.lit(1), i + 1)) + F.when(i > 0, length(F.slice(found, F.lit(1), i))).otherwise(0)).alias("at"), F.length(m).alias("n")))
    some = F.filter(at, lambda x: whole(x["at"], x["at"] + x["n"]))
    some = F.slice(some, F.greatest(F.size(some) - NEAR + 1, F.lit(1)), F.lit(NEAR)) if side == "left" else F.slice(some, F.lit(1), F.lit(NEAR))
    return F.transform(some, lambda x: F.struct(x["term"].alias("term"), x["at"].cast("long").alias("start"), (x["at"] + x["n"]).cast("long").alias("stop")))


def _words() -> Column:
    """An array of a text's terms in lower case. What is lowered is a term, as everywhere: of a whole text, it may fall apart."""
    return F.transform(F.split("text", _APART), F.lower)


def _together(kept: DataFrame, said: DataFrame, n_docs: DataFrame, generalise: float) -> DataFrame:
    """(c, t, n_ct, seen, n_c, n_t, total): documents that hold both an entity of ``kept`` (k, c, n_c) and a term of ``said``
    (k, t, n_t), and of these the ones that are unlike. ``kept`` may have a document's ``rows`` (else one) and what it is
    ``like`` (else itself).

    As n_ct <= n_c, a disclosure of ``generalise`` needs n_t <= n_c (total / n_c)^(1 - generalise): of a page of many
    entities and many terms, only rare terms are paired. A document of many entities is split by its terms."""
    kept = kept.withColumns({name: of for name, of in (("rows", F.lit(1)), ("like", F.col("k"))) if name not in kept.columns})
    spread = kept.groupBy("k").agg((1 + F.floor(F.count("*") / SPLIT)).cast("int").alias("parts"))
    left = kept.join(spread, "k").select("k", "c", "n_c", "rows", "like", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = said.join(spread, "k").select("k", "t", "n_t", F.pmod("t", "parts").cast("int").alias("part"))
    most = F.col("n_c") * F.pow(F.col("total") / F.col("n_c"), F.lit(1 - generalise)) * (1 + 1e-9)  # rounding loses none
    pairs = left.crossJoin(F.broadcast(n_docs)).join(right, ["k", "part"]).where(F.col("n_t") <= most)  # n_docs is one row
    return pairs.groupBy("c", "t", "n_c", "n_t", "total").agg(F.sum("rows").alias("n_ct"), F.countDistinct("like").alias("seen"))


def revealing_terms(docs: DataFrame, base: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """(k, kind, start, stop, removed) of terms that disclose base spans of their document; none overlaps a base span."""
    entity = F.xxhash64("kind", F.lower("m")).alias("c")
    tokens = docs.where("text IS NOT NULL").select(_key(), "text")
    rows = tokens.join(base.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.count("*").alias("rows"))
    # documents are alike for an entity if all its surroundings in them are the same
    holds = base.select("k", entity, F.xxhash64("left", "m", "right").alias("around")).distinct()
    kept = written(holds.groupBy("k", "c").agg(F.bit_xor("around").alias("like")).join(rows, "k"), "pii-holds")
    near = base.select("k", entity, "left", "right", "start", "stop").join(kept, ["k", "c"]).select("c", "rows", "like", F.inline(F.concat(_terms("left"), _terms("right"))))
    near = near.where(F.col("term").rlike(r"[\p{L}\p{N}]")).withColumn("t", F.xxhash64("term"))
    by_pair = near.groupBy("c", "t").agg(F.sum("rows").alias("n_ct"), F.countDistinct("like").alias("seen"))
    by_entity = by_pair.groupBy("c").agg(F.sum("n_ct").alias("n_c"))
    d = F.log2(F.col("n_ct") * F.col("total") / (F.col("n_c") * F.greatest("n_t", "n_ct"))) / -F.log2(F.col("n_c") / F.col("total"))
    # every term of every text and, beside it, once a document: one pass; of a term, only its hash is moved
    words = docs.where("text IS NOT NULL").select(_words().alias("words"))
    row = lambda once: lambda w: F.struct(w.alias("term"), F.lit(1 - once).alias("n"), F.lit(once).alias("docs"))
    every = words.select(F.inline(F.concat(F.transform("words", row(0)), F.transform(F.array_distinct("words"), row(1)))))
    counts = every.where("term <> ''").groupBy(F.xxhash64("term").alias("t")).agg(F.sum("n").alias("n_t"), F.sum("docs").alias("n_docs"))
    counts = written(counts, "pii-terms")
    total = counts.agg(F.sum("n_t").alias("total"))
    disclosed = by_pair.where(F.col("seen") >= support).join(by_entity, "c").join(counts.select("t", "n_t"), "t").crossJoin(F.broadcast(total)).withColumn("d", d)  # total is one row
    # the same in documents; entities with too little support go first
    often = kept.groupBy("c").agg(F.sum("rows").alias("n_c"), F.countDistinct("like").alias("seen")).where(F.col("seen") >= support)
    often = written(kept.join(often.select("c", "n_c"), "c"), "pii-entities")
    said = tokens.join(often.select("k").distinct(), "k", "left_semi").select("k", F.explode(F.array_distinct(_words())).alias("term"))
    said = said.where(F.col("term").rlike(r"[\p{L}\p{N}]")).select("k", F.xxhash64("term").alias("t")).distinct()
    n_docs = docs.where("text IS NOT NULL").agg(F.count("*").alias("total"))
    said = said.join(counts.select("t", F.col("n_docs").alias("n_t")).where(F.col("n_t") >= support), "t")
    together = _together(often, said, n_docs, generalise)
    disclosed = disclosed.select("c", "t", "d").unionByName(together.where((F.col("seen") >= support) & (F.col("n_c") < F.col("total"))).select("c", "t", d.alias("d")))
    told = disclosed.where(F.col("d") >= generalise).groupBy("c", "t").agg(F.max("d").alias("d"))
    told = written(kept.join(told, "c").groupBy("k", "t").agg(F.max("d").alias("d")), "pii-told")
    # every place of those terms in their documents
    parts = F.arrays_zip(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("m"), F.split("text", _WORD, -1).alias("before"))
    found = tokens.join(told.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"]).select("k", F.posexplode(parts).alias("i", "x"))
    found = found.select("k", "i", F.xxhash64(F.lower("x.m")).alias("t"), F.length("x.m").alias("n"), F.length("x.before").alias("gap"))
    stop = F.sum(F.coalesce("n", F.lit(0)) + F.col("gap")).over(Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("stop", stop).where("n IS NOT NULL").select("k", "t", (F.col("stop") - F.col("n")).alias("start"), "stop")
    spans = found.join(told, ["k", "t"]).groupBy("k", "start", "stop").agg((F.max("d") >= remove).alias("removed"))
    # one pass over a document's spans in order: what reaches in from before, what begins inside
    line = spans.withColumn("base", F.lit(False)).unionByName(base.select("k", "start", "stop", F.lit(False).alias("removed"), F.lit(True).alias("base")))
    order = Window.partitionBy("k").orderBy("start", F.desc("base"))
    reach = F.max(F.when(F.col("base"), F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = line.withColumns({"reach": reach, "after": after}).where("NOT base AND coalesce(reach <= start, true) AND coalesce(after >= stop, true)")
    return free.select("k", F.lit(TERM).alias("kind"), "start", "stop", "removed")


def all_spans(docs: DataFrame) -> DataFrame:
    """(k, kind, start, stop, removed) of base and added spans."""
    base = written(base_spans(docs), "pii-base")
    return base.select("k", "kind", "start", "stop", F.lit(False).alias("removed")).unionByName(revealing_terms(docs, base))


def _by_row(docs: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, (*KINDS, TERM))), F.col("kind"))
    span = F.struct(order.alias("o"), F.col("start"), F.col("stop"), F.col("kind"), F.col("removed"))
    return all_spans(docs).groupBy("k").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for every row of ``docs``.

    Spans are kind:start:stop in code points, stop exclusive, by kind (email, ip, card, phone, term), then
    start, comma-joined; base_sha256 is of the base ones, n_spans counts all. Null text is empty and has none. Spans belong to
    (doc_id, text), so repeated rows get the same ones and rows that share a doc_id their own; null doc_ids
    are fine. Spans of different kinds may overlap. Other columns are ignored; an empty table gives none."""
    rows = docs.select("doc_id", _key()).join(_by_row(docs), "k", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<o:bigint,start:bigint,stop:bigint,kind:string,removed:boolean>>"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    rows = rows.select("doc_id", spans.alias("spans"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(text(F.filter("spans", lambda x: x["kind"] != TERM)), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind in brackets, disclosing terms by [TERM] or
    nothing. Where spans overlap, the first by start (then the longer) is replaced. Null stays null."""
    by_start = _by_row(docs).select("k", F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("a"), (-x["stop"]).alias("z"), F.when(x["removed"], "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("by")))).alias("spans"))
    out = packed(docs).withColumn("k", _key("doc.doc_id", "doc.text")).join(by_start, "k", "left").withColumn("text", F.col("doc.text"))
    fold = F.expr(
        "aggregate(spans, named_struct('at', 0L, 'out', ''), (s, x) -> if(x.a < s.at, s, named_struct('at', -x.z, 'out', "
        "concat(s.out, substring(text, CAST(s.at + 1 AS int), CAST(x.a - s.at AS int)), x.by))), s -> concat(s.out, substring(text, CAST(s.at + 1 AS int))))"
    )
    return unpacked(out, docs, text=F.when(F.col("spans").isNull(), F.col("text")).otherwise(fold))
