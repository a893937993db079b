"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed hashes tokens at fixed places of a span (0, 3, 6 and 9) and ignores the others, so substituted tokens
at ignored places don't hide an overlap; the shifts of the mask by 0, 1 and 2 share no place. Seeds of texts
are joined to seeds of items first; only documents with a hit are verified, token by token along the hit's
diagonal. What a verdict depends on is a hit's context, the few tokens around it on either side. Each pair of unlike
contexts is compared once, however many places of however many documents and items have them, so repeated words and
templates that items share cost no more than other text; contexts lead back to rows and to sets of items afterwards:

* items of 18 tokens or more: 16 equal tokens within 18 consecutive places. Two substitutions spoil two of
  the three shifts at most, so one always hits;
* items of 11 to 17 tokens: all tokens but one are equal. One substitution spoils one of two shifts;
* items of 5 to 10 tokens: all tokens are equal. Their seed is the hash of all of them, and only runs as long as
  some such item are hashed;
* shorter items, which any text may hold by chance: the whole text is the item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, packed_by_key, row_key, unpacked, written

LONG, LEAST_EQUAL, SHORT, PHRASE = 18, 16, 11, 5
MASK = (0, 3, 6, 9)
SPAN = MASK[-1] + 1
#: A context's tokens before a seed's place and from it on; places of a text that are cut out of it at a time.
BEFORE, FROM, PART = LONG - 1 - SPAN, LONG, 4096
#: Documents with a hit are broadcast up to this number (16 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000
#: Benchmark text up to which its seeds and items are broadcast; beyond it seeds are shuffled.
BROADCAST_BYTES = 16 << 20
_PLACES = "array<struct<seed:bigint,context:array<bigint>>>"


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.xxhash64(x))
    return F.filter(words, lambda x: x != F.xxhash64(F.lit("")))  # a text that begins or ends otherwise


def _seed(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + q) for q in MASK])


def _run(words: Column, at: Column, n: Column) -> Column:
    """Seed of a short item or of a run as long."""
    return F.xxhash64(n, F.slice(words, at + 1, n))


def _places(words: Column, span: int = SPAN) -> Column:
    """Where a seed can begin; 0 alone in a text shorter than its span."""
    return F.sequence(F.lit(0), F.greatest(F.size(words) - span, F.lit(0)))


def _text_seeds(words: Column, lengths: list[int]) -> Column:
    """An array of seeds, those of runs of each of the ``lengths`` of short items too."""
    none = F.array().cast("array<bigint>")

    def runs(n: int) -> Column:
        found = F.transform(_places(words, n), lambda j: _run(words, j, F.lit(n)))
        return F.when((F.size(words) >= n) if n >= PHRASE else (F.size(words) == n), found).otherwise(none)

    spaced = F.transform(_places(words), lambda j: _seed(words, j))
    return F.concat(spaced, *map(runs, lengths)) if lengths else spaced


def _parts(rows: DataFrame, words: str, *names: str) -> DataFrame:
    """(names, size, at, part): texts cut into PART places each, with what their contexts reach beyond; ``words`` must be a
    stored column. Token p of a part is the text's at + p - BEFORE."""
    size, a = F.size(words), F.col("at")
    blank = F.array_repeat(F.lit(None).cast("bigint"), F.greatest(BEFORE - a, F.lit(0)))
    begin = F.greatest(a - BEFORE, F.lit(0))
    cut = rows.select(*names, words, size.alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(PART))).alias("at"))
    return cut.select(*names, "size", "at", F.concat(blank, F.slice(words, begin + 1, F.lit(PART + BEFORE + FROM))).alias("part"))


def _place(p: Column, seed: Column) -> Column:
    return F.struct(seed.alias("seed"), F.slice("part", p + 1, BEFORE + FROM).alias("context"))


def _spaced_places() -> Column:
    """An array of (seed, context) of a part's spaced seeds."""
    last = F.least(F.col("size") - SPAN - F.col("at"), F.lit(PART - 1))
    found = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda p: _place(p, _seed(F.col("part"), p + BEFORE)))
    return F.when(last >= 0, found).otherwise(F.array().cast(_PLACES))


def _run_places(n: int) -> Column:
    """The same of runs of n tokens; of those that are shorter than a phrase, only a whole text is one."""
    last = F.least(F.col("size") - n - F.col("at"), F.lit(PART - 1))
    found = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda p: _place(p, _run(F.col("part"), p + BEFORE, F.lit(n))))
    return F.when((last >= 0) if n >= PHRASE else (F.col("size") == n), found).otherwise(F.array().cast(_PLACES))


def _item_places(items: DataFrame) -> DataFrame:
    """(item1, item2, seed, context, need): need is the number of tokens of a short item that must be equal, 0 for a long one."""
    parts = _parts(items, "item_words", "item1", "item2")
    spaced, short = parts.where(F.col("size") >= SHORT), parts.where(F.col("size") < SHORT)
    need = F.when(F.col("size") >= LONG, 0).otherwise(F.col("size") - 1)
    whole = _place(F.lit(0), _run(F.col("part"), F.lit(BEFORE), F.col("size")))
    found = spaced.select("item1", "item2", need.alias("need"), F.inline(_spaced_places()))
    return found.unionByName(short.select("item1", "item2", F.col("size").alias("need"), F.inline(F.array(whole))))


def _text_places(near: DataFrame, lengths: list[int]) -> DataFrame:
    """(k1, k2, seed, context) of every place."""
    every = [_spaced_places(), *map(_run_places, lengths)]
    return _parts(near, "words", *KEY).select(*KEY, F.inline(F.concat(*every)))


def _with_contexts(places: DataFrame, names: list[str], by: str, *more: str) -> DataFrame:
    """Places with their contexts' 128-bit names, in two columns."""
    named = [F.xxhash64(F.lit(x), "context", *more).alias(f"{by}{x}") for x in (1, 2)]
    return places.select(*names, "seed", "context", *more, *named)


def matching_contexts(spots: DataFrame, places: DataFrame) -> DataFrame:
    """(seed, t1, t2, c1, c2): the contexts of texts and of items that overlap at a seed. Of each context one is compared."""
    ours = spots.groupBy("seed", "t1", "t2").agg(F.first("context").alias("context"))
    theirs = places.groupBy("seed", "c1", "c2").agg(F.first("context").alias("item"), F.first("need").alias("need"))
    same = [F.coalesce((F.get("item", F.lit(p)) == F.get("context", F.lit(p))).cast("int"), F.lit(0)) for p in range(BEFORE + FROM)]
    total = lambda cols: reduce(lambda a, b: a + b, cols)
    inside = lambda p: F.get("item", F.lit(p)).isNotNull()
    # the windows of LONG places around a seed that begin 0, 1 and 2 before it share all but two places at either end
    windows = [F.when(inside(BEFORE - b) & inside(BEFORE - b + LONG - 1), total([*same[BEFORE - b : BEFORE], *same[BEFORE + LONG - 2 : BEFORE - b + LONG]])) for b in (0, 1, 2)]
    long = total(same[BEFORE : BEFORE + LONG - 2]) + F.greatest(*windows) >= LEAST_EQUAL
    pairs = lambda which, overlap: ours.join(theirs.where(which), "seed").where(overlap).select("seed", "t1", "t2", "c1", "c2")
    return pairs("need = 0", long).unionByName(pairs("need > 0", total(same) >= F.col("need")))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k1, k2, item_ids) of the rows that overlap an item; item_ids is an ascending list."""
    items = (
        benchmark.where(F.col("text").isNotNull())
        .select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item_words"))
        .select("item_id", "item_words", F.size("item_words").alias("len"), *[F.xxhash64(F.lit(x), "item_id", "item_words").alias(f"item{x}") for x in (1, 2)])
        .where(F.col("len") > 0)
        .dropDuplicates(["item1", "item2"])
    )
    items = written(items, "benchmark-items")
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    lengths = sorted(r.len for r in items.where(F.col("len") < SHORT).select("len").distinct().collect())  # ten at most
    small = F.broadcast if size <= BROADCAST_BYTES else (lambda x: x)
    places = written(_with_contexts(_item_places(items), ["item1", "item2"], "c", "need"), "benchmark-contexts")
    source = docs.where(F.col("text").isNotNull()).select(*row_key(), "text")
    words = source.select(*KEY, tokens(F.col("text")).alias("words"))
    # Arrays stay behind here: of a text, only its seeds are exploded. Outer, as an inferred filter would
    # tokenise every text once more.
    all_seeds = words.select(*KEY, F.explode_outer(_text_seeds(F.col("words"), lengths)).alias("seed"))
    seeds = small(places.select("seed").distinct())
    hit = written(all_seeds.join(seeds, "seed", "left_semi").select(*KEY).distinct(), "seed-hits")
    few = hit.count() <= BROADCAST_ROWS
    near = source.join(F.broadcast(hit) if few else hit, KEY, "left_semi").select(*KEY, tokens(F.col("text")).alias("words"))
    near = written(near.dropDuplicates(KEY), "seed-near")
    spots = written(_with_contexts(_text_places(near, lengths).join(seeds, "seed", "left_semi"), KEY, "t"), "seed-contexts")
    held = places.select("seed", "c1", "c2", "item1", "item2").distinct()
    # contexts that the same items hold: their number and hashes name the set, one of them stands for all
    sets = written(held.groupBy("seed", "c1", "c2").agg(F.count("*").alias("n"), F.bit_xor("item1").alias("s1"), F.bit_xor("item2").alias("s2")), "benchmark-sets")
    matches = written(matching_contexts(spots, places).join(sets, ["seed", "c1", "c2"]).select("seed", "t1", "t2", "n", "s1", "s2").distinct(), "seed-matches")
    rows = spots.select(*KEY, "seed", "t1", "t2").distinct().join(matches, ["seed", "t1", "t2"]).select(*KEY, "n", "s1", "s2").distinct()
    one = sets.groupBy("n", "s1", "s2").agg(F.min(F.struct("seed", "c1", "c2")).alias("x")).select("n", "s1", "s2", "x.*")
    members = one.join(held, ["seed", "c1", "c2"]).join(items.select("item1", "item2", "item_id"), ["item1", "item2"])
    members = members.select("n", "s1", "s2", F.coalesce("item_id", F.lit(-1)).alias("item_id")).distinct()
    found = rows.join(members, ["n", "s1", "s2"]).select(*KEY, "item_id").distinct()
    return found.groupBy(*KEY).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending, comma-joined) for every row of ``docs``.

    Null texts are clean. Null item texts and those without a word are skipped, a null item_id counts as -1. Rows are judged
    by (doc_id, text), so repeated rows get the same verdict and rows that share a doc_id their own. Extra
    columns are ignored; with an empty benchmark everything is clean."""
    hit = contaminated_rows(docs, benchmark)
    out = docs.select("doc_id", *row_key()).join(hit, KEY, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("item_ids").isNotNull().alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, in their own columns."""
    hit = contaminated_rows(docs, benchmark).select(*KEY)
    return unpacked(packed_by_key(docs).join(hit, KEY, "left_anti"), docs)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS j
  FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents)
), b AS (
  SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]'))
), m AS (
  SELECT doc_id, item_id, n, j - i AS diagonal, i FROM d JOIN b USING (word) WHERE n >= {PHRASE} OR size = n
), c AS (
  SELECT doc_id, item_id, n,
    count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i RANGE BETWEEN CURRENT ROW AND {LONG - 1} FOLLOWING) AS equal
  FROM m
), h AS (
  SELECT DISTINCT doc_id, item_id FROM c WHERE equal >= CASE WHEN n >= {LONG} THEN {LEAST_EQUAL} WHEN n >= {SHORT} THEN n - 1 ELSE n END
), g AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids FROM h GROUP BY doc_id
)
SELECT doc_id, n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(item_ids, '') AS item_ids
FROM documents LEFT JOIN g USING (doc_id)
"""
