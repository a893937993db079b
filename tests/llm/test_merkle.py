"""The Merkle manifest against a plain fold of lists, and its cases."""

import hashlib
import zlib

from pyspark.sql import functions as F

from voxelry.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    path = []
    for level in tree[:-1]:
        first = at - at % 3
        path.append((level[first:at], level[at + 1 : first + 3]))
        at //= 3
    return path


def brute(rows):
    found, trees = [], {}
    for r in rows:
        trees.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for members in trees.values():
        members.sort(key=lambda x: x[:3])
    own = {s: levels([x[2] for x in trees[s]]) for s in names}
    top = levels([own[s][-1][0] for s in names])
    for i, s in enumerate(names):
        for at, (_, _, node, r) in enumerate(trees[s]):
            path = siblings(own[s], at) + siblings(top, i)
            torn = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            folded = leaf(r, r["text"].replace("\n", "")) if torn else node
            for before, after in path:
                folded = h(*before, folded, *after)
            root = top[-1][0]
            found.append((r["doc_id"], node, own[s][-1][0], root, h(*(x for p in path for side in p for x in side)), folded, folded == root))
    return sorted(found, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_trees_of_many_sizes(spark):
    """Sizes about powers of 3 and of 81, one source with most rows, more sources than one kept level holds."""
    sizes = {None: 2, "": 1, "a": 3, "b": 4, "ü": 81, "z": 82, "hot": 800, "c": 27, "d": 28} | {f"s{i}": 1 + i % 3 for i in range(90)}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append({"doc_id": i * 7 % 1999, "text": f"line {i}\nand more" if i % 3 else "no end", "lang": "en", "source": s, "n_chars": i})
    df = spark.createDataFrame([tuple(r.get(c) for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    assert result(merkle.merkle_digest(df)) == brute(rows)


def test_cases(spark):
    """Nulls anywhere, empty texts, repeated rows and ids, extra columns with names in use inside."""
    text = "one\ntwo"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, "other", "en", "a", 1), (None, text, None, None, None), (None, None, None, None, None), (2, "", "en", None, 0), (3, None, "de", "a", 5), (-4, "\n", "", "", -1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "at", "node", "key", "same", "n", "part", "path", "of", "root")})
    assert result(merkle.merkle_digest(df)) == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    one = df.where("doc_id = 3")
    got = merkle.merkle_digest(one).first()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.verified and got.proof_sha256 == h()
    assert merkle.merkle_digest(df.limit(0)).count() == 0


def test_only_some_levels_are_kept(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    kept = merkle.manifest(df)
    assert [x.count() for x in kept.levels] == [1000, 13, 1]  # of 1000, 334, 112, 38, 13, 5, 2, 1
    assert kept.root().count() == 1
    assert result(merkle.merkle_digest(df)) == brute([r.asDict() for r in df.collect()])


def test_proof_tells_a_changed_row(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.lit(1).alias("n_chars"))
    rows = merkle.proofs(merkle.manifest(df, doc_id=F.col("doc_id")), "doc_id")
    assert merkle.verified(rows.withColumn("now", F.col("leaf"))).where("verified").count() == 300
    assert merkle.verified(rows.withColumn("now", F.sha2(F.col("leaf"), 256))).where("verified").count() == 0
