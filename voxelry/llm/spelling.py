"""Spelling variants grouped by a dictionary of pairs of trie nodes.

Words are numbered by rank, commonest first. The nodes of the trie of the words and of the trie of the words reversed are
numbered too, in one pass over the sorted words. A word is then described by pairs of integers: for each of its
positions the node of what stands before it and the (reversed) node of what stands behind it, once with the position
skipped and once with nothing skipped. Two words share a pair of the first kind if and only if they differ in that one
position, and a pair of either kind if and only if one has one more letter there. A pair is shared by one word with
nothing skipped and by one word a letter of the alphabet at most, so groups are small whatever the corpus, and what a
word needs of a group are counts and its best rank: no pair of words is ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.ranking import global_rank

from .common import discard, written

#: Least code points and occurrences of a word; one run in MISSPELT loses a letter; times a word's n that its form must have.
LEAST, OFTEN, MISSPELT, RATIO = 5, 3, 97, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes of paths that a task gives out at a time.
_FLUSH = 500_000


def runs(docs: DataFrame, misspelt: int | None = MISSPELT) -> DataFrame:
    """(word): a row for each run of letters of each text, A-Z lower-cased. Where ``misspelt`` divides the crc32 of
    `<doc_id>:<run>`, the run has lost its code point at crc32 % length. A null doc_id spoils nothing."""
    run = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run")
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), run)
    if not misspelt:
        return found.select(F.col("run").alias("word"))
    found = found.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    torn = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % misspelt == 0, torn).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n, r): distinct words of ``least`` code points and ``often`` occurrences, by rank: the commonest is 1, ties in
    code-point order."""
    counts = words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)
    return written(global_rank(written(counts, "spelling-counts"), F.desc("n"), "word", name="r"), "spelling-words")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _crossing(bounds: list[tuple[int, str, str]]) -> dict[int, list[int]]:
    """bounds: (part, first word, last word) in order. For each part after the first, the numbers of the nodes that its
    first word shares with the last word of the part before, by depth. Such nodes are numbered here, below zero, by
    the first border that they cross; all others where they are met."""
    found, last, used = {}, None, 0
    for part, first, end in bounds:
        if last is not None:
            before, begin, word = last
            known = found.get(before, [])[: _common(begin, word) + 1]  # those that crossed the border before, too
            n = _common(word, first) + 1
            found[part] = known[:n] + [-used - i for i in range(1, n - len(known) + 1)]
            used += max(0, n - len(known))
        last = (part, first, end)
    return found


def _paths(bounds: list[tuple[int, str, str]]):
    """(part, r, word) sorted by (part, word) -> (r, path, fresh): the numbers of the nodes on a word's way from the root, and
    for each letter whether it differs from the one before."""
    crossing = _crossing(bounds)
    ends = {part: (first, end, crossing.get(part, []), crossing.get(after, [])) for (part, first, end), (after, _, _) in zip(bounds, [*bounds[1:], (-1, "", "")])}

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, word, path, number = None, "", [], 0
        out: list[tuple[int, list[int], list[bool]]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays(columns, ["r", "path", "fresh"])

        for b in batches:
            for p, r, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if p != part:
                    part, word, path, number = p, "", [], p << 40
                    first, end, behind, ahead = ends[p]
                kept = _common(word, w) + 1 if path else 0
                path = path[:kept]
                # what the word before didn't have: from a part before, into the part after, or new here
                into = min(len(behind), _common(first, w) + 1)
                onto = min(len(ahead), _common(end, w) + 1)
                path += behind[len(path) : into]
                path += ahead[len(path) : onto]
                new = len(w) + 1 - len(path)
                path += range(number, number + new)
                number, word = number + new, w
                out.append((r, path, [True, *(x != y for x, y in zip(w[1:], w))]))
                held += len(path)
                if held > _FLUSH:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    return paths


def trie_paths(words: DataFrame) -> DataFrame:
    """(r, path, fresh) of (r, word): path[i] is the number of the trie node of the word's first i letters. Words are sorted in
    ranges; of a range, the driver sees its first and its last word."""
    ranged = written(words.repartitionByRange("word").select(F.spark_partition_id().alias("part"), "r", "word"), "spelling-ranges")
    bounds = sorted(tuple(x) for x in ranged.groupBy("part").agg(F.min("word"), F.max("word")).collect())
    return ranged.repartition("part").sortWithinPartitions("part", "word").mapInArrow(_paths(bounds), "r long, path array<long>, fresh array<boolean>")


def node_pairs(words: DataFrame) -> DataFrame:
    """(before, after, r, fresh) of (r, word): the pairs of each word. fresh is null with nothing skipped, else whether the skipped
    letter begins a run of its like; words that differ by a letter of such a run meet at its first one alone."""
    both = trie_paths(words).join(trie_paths(words.select("r", F.reverse("word").alias("word"))).select("r", F.col("path").alias("back")), "r")
    n = F.size("fresh")
    pair = lambda i, skipped, fresh: F.struct(F.get("path", i).alias("before"), F.get("back", n - skipped - i).alias("after"), fresh.alias("fresh"))
    skipped = F.transform("fresh", lambda f, i: pair(i, 1, f))
    whole = F.transform("path", lambda _, i: pair(i, 0, F.lit(None).cast("boolean")))
    return both.select("r", F.inline(F.concat(skipped, whole)))


def near_words(words: DataFrame) -> DataFrame:
    """(r, n_near, best) of (r, word): the number of words at one inserted, deleted or replaced code point, and the least rank of
    those that come before the word. Words without such a neighbour are left out."""
    group = Window.partitionBy("before", "after")
    skips, fresh, whole = F.col("fresh").isNotNull(), F.coalesce("fresh", F.lit(False)), F.col("fresh").isNull()
    only = lambda where: F.when(where, F.col("r"))
    pairs = node_pairs(words).select("*", F.count(only(skips)).over(group).alias("skips"), F.count(only(fresh)).over(group).alias("longer"), F.min(only(skips)).over(group).alias("best_skip"), F.min(only(fresh)).over(group).alias("best_longer"), F.min(only(whole)).over(group).alias("shorter"))
    near = F.when(whole, F.col("longer")).otherwise(F.col("skips") - 1 + (fresh & F.col("shorter").isNotNull()).cast("long"))
    best = F.when(whole, F.col("best_longer")).otherwise(F.least("best_skip", F.when(fresh, F.col("shorter"))))
    found = pairs.select("r", near.alias("near"), F.when(best < F.col("r"), best).alias("best")).where("near > 0")
    return found.groupBy("r").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(r, root) of (r, form): forms followed to the last. Every step at least doubles n, so a way has 63 steps at most, and
    doubling them takes six rounds."""
    ways = written(forms.select("r", F.col("form").alias("root")), "spelling-ways")
    while True:
        on = ways.select(F.col("r").alias("root"), F.col("root").alias("next"))
        longer = written(ways.join(on, "root", "left").select("r", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-ways")
        discard(ways)
        ways = longer
        if ways.where("moved").isEmpty():
            return ways.select("r", "root")


def spelling_groups(docs: DataFrame, misspelt: int | None = MISSPELT, least: int = LEAST, often: int = OFTEN, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``. form is the near word of largest n (ties: the first in
    code-point order) if that is at least ``ratio`` (2 or more) times the word's own, else null.

    A near word that comes after the word by rank has no larger n and can't be its form, so the best rank before its own is
    all that is looked for. Null texts hold no words; runs of any length are whole words; repeated rows count each.
    Extra columns are ignored. An empty table gives an empty table."""
    words = vocabulary(runs(docs, misspelt), least, often)
    near = written(near_words(words), "spelling-near")
    n_of = words.select(F.col("r").alias("best"), F.col("n").alias("form_n"))
    found = words.join(near, "r", "left").join(n_of, "best", "left")
    is_form: Column = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    found = found.select("r", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form_r"), F.when(is_form, F.col("form_n")).alias("form_n"))
    found = written(found, "spelling-forms")
    last = roots(found.where("form_r IS NOT NULL").select("r", F.col("form_r").alias("form")))
    named = lambda r, word: words.select(F.col("r").alias(r), F.col("word").alias(word))
    out = found.join(last.withColumnRenamed("root", "root_r"), "r", "left").join(named("form_r", "form"), "form_r", "left").join(named("root_r", "root"), "root_r", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")


_HEX = "hex(encode(CAST(doc_id AS VARCHAR) || ':' || run))"
ORACLE = f"""
WITH RECURSIVE a AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents
), b AS (
  SELECT doc_id, run, count(*) AS c, {_HEX} AS x FROM a GROUP BY doc_id, run
), d AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)) + i)), 4294967295::BIGINT) AS h
  FROM b
), v AS (
  SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
  FROM d GROUP BY 1 HAVING length(word) >= {LEAST} AND sum(c) >= {OFTEN}
), s AS (
  SELECT word, n, substr(word, 1, i) AS p, substr(word, i + 2) AS q FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)
), e AS (
  SELECT x.word, y.word AS other, y.n AS m FROM s x JOIN s y USING (p, q) WHERE x.word <> y.word
  UNION SELECT s.word, v.word, v.n FROM s JOIN v ON v.word = p || q
  UNION SELECT v.word, s.word, s.n FROM s JOIN v ON v.word = p || q
), k AS (
  SELECT word, count(*) AS n_near, max(m) AS form_n, first(other ORDER BY m DESC, encode(other)) AS form FROM e GROUP BY word
), f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n
  FROM v LEFT JOIN k USING (word)
), w(word, root, step) AS (
  SELECT word, word, 0 FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM w GROUP BY word) USING (word)
"""
