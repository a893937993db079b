"""Spelling groups against comparing all words, and their cases."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from voxelry.llm import spelling


def words_of(rows):
    """As the contract says it."""
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            yield run


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    n = {w: c for w, c in Counter(words_of(rows)).items() if len(w) >= 5 and c >= 3}
    form, found = {}, {}
    for w in n:
        by = [o for o in n if near(w, o)]
        best = min(by, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        found[w] = len(by)
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], found[w], n.get(form[w])))
    return sorted(out)


def result(docs):
    return sorted(tuple(r) for r in spelling.spelling_groups(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_against_all_pairs(spark):
    """Few letters, so that most words are near many others, runs of one letter and chains of forms among them."""
    rng = random.Random(3)
    pool = ["".join(rng.choices("abÀé", [5, 3, 1, 1], k=rng.randint(4, 8))) for _ in range(500)] + ["a" * k for k in range(4, 12)]
    rows = [(i, " ".join(rng.choices(pool, [1 / (1 + j % 50) for j in range(len(pool))], k=60)).replace("a", "A", 3)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    expected = brute(rows)
    assert result(docs) == expected
    assert sum(r[1] is not None for r in expected) > 50 and any(r[2] != r[1] for r in expected if r[1])


def test_nodes_are_numbered_as_tries_number_them(spark):
    """Two prefixes have one number if and only if they are equal, over ranges of any size."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(150)} | {"b" * 40, "b" * 40 + "a"})
    df = spark.createDataFrame(list(enumerate(words)), "r bigint, word string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            number = {}
            for r in spelling.trie_paths(df).collect():
                w = words[r.r]
                assert len(r.path) == len(w) + 1 and r.fresh == [i == 0 or w[i] != w[i - 1] for i in range(len(w))]
                for i, x in enumerate(r.path):
                    assert number.setdefault(w[:i], x) == x
            assert len(set(number.values())) == len(number)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cases(spark):
    """Null and empty texts, a null doc_id, runs of very many letters, repeated rows, extra columns with names in use inside."""
    long = "abc" * 10_000
    rows = [(1, "Hello hello HELLO Hällo hällo hällo"), (1, "Hello hello HELLO Hällo hällo hällo"), (2, None), (3, ""), (None, f"hello {long} {long}x"), (4, f"{long} hell-hello {long}x"), (5, f"{long}! {long}x ÀÉÎÕÜ àéîõü abcde"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("word", "run", "h", "r", "n", "path", "part", "root", "best")})
    assert result(docs) == brute(rows)
    assert result(docs.limit(0)) == [] and result(docs.where("doc_id IN (2, 3)")) == []


def test_groups_are_small_however_common_a_word(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("common commonn commom " * 40).alias("text"))
    words = spelling.vocabulary(spelling.runs(docs, None))
    pairs = spelling.node_pairs(words)
    assert words.count() == 3 and pairs.count() == sum(2 * len(w) + 1 for w in ("common", "commonn", "commom"))
    assert sorted(tuple(r) for r in spelling.near_words(words).collect()) == [(1, 1, None), (2, 2, 1), (3, 1, 2)]
