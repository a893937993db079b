"""The corpus operators against brute force, and their cases: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.llm import decontamination, html_extraction, language_id, line_dedup, mixing, ngram_join, pii, suffix_dedup, token_counts, topk
from voxelry.llm.queries import LINE_DEDUP

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls anywhere, empty and very long texts, repeated rows, a repeated id, extra columns with names in use inside."""
    text = "Some words that stand on a line by themselves\nand a second line of some length\nthe end"
    rows = [
        (1, text, "en", "a", 1), (2, text, "en", None, None), (3, text, None, "a", 1), (3, text, None, "a", 1), (None, text, "en", "b", 1), (None, None, None, None, None),
        (4, None, "en", "a", 1), (5, "", "en", "b", 1), (6, " \n\t ", "de", "b", 1), (7, LONG, "en", "b", 1), (8, "12345 !!", None, "c", 1), (5, "another text for five " * 30, "fr", "c", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("k", "_k", "keep", "_keep", "size", "rnd", "h1", "bucket", "target", "_spans", "digest", "seed", "lang_pred", "_doc", "class_id", "_n")
    return df.withColumns({n: F.lit("x") for n in names})


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id(rows):
    return {r.doc_id: r for r in rows.collect()}


# --- 1


def shingle_set(text):
    w = ngram_join.word_list(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows, threshold=0.8):
    sets = [shingle_set(t) if i is not None else set() for i, t in rows]
    root, links = list(range(len(rows))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((rows[i][0], least.get(find(i)) if rows[i][0] is not None else None, links[i]) for i in range(len(rows))), key=str)


def test_join_against_brute_force(docs):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()), key=str)
    assert got == brute_classes(plain(docs))
    assert any(n for _, _, n in got)


def test_join_cases(odd):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(odd).collect()), key=str)
    assert got == brute_classes(plain(odd))
    kept = ngram_join.keep_one_per_class(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, None, None, 4, 5, 5, 6, 7, 8])
    assert ngram_join.ngram_join(odd.limit(0)).count() == 0


def repeated_ids(spark):
    """Ids that stand for unlike texts: each text has its own copies, near copies and shared lines."""
    prose = lambda seed, n=60: " ".join(f"{random.Random(seed * 1000 + i).choice('abcdefgh')}w{seed}x{i}" for i in range(n))
    a, b = prose(1), prose(2)
    line = "a shared line of some length"
    texts = [(1, a), (1, b), (2, a + " tail"), (3, "tail " + b), (1, a), (4, prose(3)), (4, prose(4)), (1, b + " more of it"), (5, prose(4) + " end")]
    lines = [(11, line), (12, line), (13, line), (11, "precious unique line of one document\nanother one that only it has"), (13, f"{line}\nown words of the last document")]
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts + lines], SCHEMA)


def test_join_of_repeated_ids(spark):
    df = repeated_ids(spark)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df).collect()), key=str)
    assert got == brute_classes(plain(df)) and max(n for _, _, n in got) >= 2
    kept = Counter((r.doc_id, r.text[:6]) for r in ngram_join.keep_one_per_class(df).collect())
    first = {t: min(i for i, x in plain(df) if x[:6] == t) for t in {x[:6] for _, x in plain(df) if "w" in x[:6] and "x" in x[:6]}}
    assert all(sum(n for (_, x), n in kept.items() if x == t) == 1 and kept[i, t] == 1 for t, i in first.items())


def test_join_tiles_of_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df).collect()), key=str) == brute_classes([(r[0], r[1]) for r in rows])


def test_bayesian_bound():
    least = ngram_join.least_matches(0.8, 1e-5)
    assert len(least) == 8 and least == sorted(least) and least[0] < 8 and 64 < least[-1] < 103


# --- 2


def test_html_main_text(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extraction.html_extraction(pages).collect()}
    exact = 0
    for p in pages.collect():
        inside = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        exact += got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
    assert exact >= 0.95 * len(got)


def test_html_other_layouts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    trees = html_extraction.fit_trees(pages)
    prose = "Er in the and shoule ersta of thand. The onwha is and the, of erst inger anon thare with and to the shand. " * 3
    page = f"""<html><body><div class="site-header"><h1>Shop</h1></div><div class="menu"><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li><li><a href="/c">Six</a></li></ul></div>
    <div class="cookie-notice">We use cookies &amp; more.</div><div class="content"><h2>Title</h2><p>{prose}</p><p>{prose[:120]}<br>x &lt; y</p></div>
    <div class="sidebar"><h3>Related</h3><ul><li><a href="/d">Four</a></li><li><a href="/e">Five</a></li></ul></div><div id="comments"><div class="comment"><p>Nice words by a reader, thanks.</p></div></div>
    <form class="newsletter"><p>Sign up</p></form><div class="footer">&copy; all</div></body></html>"""
    (text,) = html_extraction.main_texts([page], trees)
    assert prose.strip() in text.split("\n") and "x < y" in text
    assert not any(w in text for w in ("cookies", "Related", "Nice words", "Sign up", "One", "©"))


def test_html_keeps_what_articles_hold():
    """Formulas and embedded objects' fallbacks are text; drawings are not, however nested."""
    said = lambda h: [t for _, t, _ in html_extraction.Page(h).blocks]
    assert said("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> hold.</p>") == ["Let x=2 hold."]
    assert said("<p>See <object data='a.pdf'><param name='p'>the report</object> there.</p>") == ["See the report there."]
    assert said("<p>a <svg><g><svg x='1'><text>in</text></svg><svg/><text>out</text></g></svg> b</p>") == ["a b"]
    assert said("<p>a <canvas>one<canvas>two</canvas>three</canvas> b</p><p>c <svg>never closed") == ["a b", "c"]
    page = html_extraction.Page("<p>x</p>" + "<svg>" * 20_000)
    assert len(page.blocks) == 1


def word_f1(text, expected):
    a, b = Counter(text.split()), Counter(expected.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


def test_html_layouts_that_training_has_not_seen(spark):
    """Three kinds of container are hidden from the fit and alone hold the main text of the pages judged."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    hidden = tuple(c for c in html_extraction.CONTAINERS if c in (("section", 'class="entry"'), ("td", ""), ("div", 'role="main"')))
    trees = html_extraction.fit_trees(pages, containers=tuple(c for c in html_extraction.CONTAINERS if c not in hidden))
    rng, texts = random.Random(21), [r.html for r in pages.orderBy("page_id").collect()]
    htmls, expected = [], []
    blocks = [[said for node, said, _ in p.blocks if p.labels()[node] == 1] for p in map(html_extraction.Page, texts)]
    prose = [x for b in blocks for x in b]
    for own in blocks:
        h = html_extraction._layout(rng, own[:12], [". ".join(rng.choice(prose).split(". ")[:3]) for _ in range(20)], hidden)
        page = html_extraction.Page(h)
        y = page.labels()
        expected.append("\n".join(said for node, said, _ in page.blocks if y[node] == 1))
        htmls.append(h.replace('data-y="1"', "").replace('data-y="0"', ""))
    got = html_extraction.main_texts(htmls, trees)
    exact = sum(a == b for a, b in zip(got, expected)) / len(got)
    f1 = sum(map(word_f1, got, expected)) / len(got)
    print(f"unseen layouts: {len(got)} pages, {exact:.3f} exact, word F1 {f1:.3f}")
    assert f1 > 0.85


def test_html_in_linear_time():
    began = time.time()
    broken = ['<div class="x' * 80_000, "<a " * 300_000, "<b>" * 80_000 + "</i>" * 80_000, "<!x" * 300_000, "<script>" + "</script " * 100_000, "<div>" * 40_000 + "<td></td>" * 40_000, "<b>" * 40_000 + "<p></p>" * 40_000, "</p " * 200_000]
    for h in broken:
        html_extraction.Page("<p>before</p>" + h).features()
    assert time.time() - began < 40  # about 1 MB each
    page = html_extraction.Page("""<p title=it's>one <a href="x>y">two</a> don't</p><p x='a"b'>three</p>4 < 5<p>six <a href="never closed>seven</p>""")
    assert [b[1] for b in page.blocks] == ["one two don't", "three", "4 < 5", "six"]


def test_html_without_labelled_pages(spark):
    """No page has an article or main element: layouts made of their texts teach the trees."""
    menu = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6))
    prose = lambda i: " ".join(f"word{(i * 7 + j) % 89}, and then" for j in range(40)) + "."
    rows = [(i, "u", f'<html><body><div class="nav menu"><ul>{menu}</ul></div><div class="content"><p>{prose(i)}</p><p>{prose(i + 1)}</p></div><div class="footer">&copy; 2020</div></body></html>') for i in range(40)]
    got = {r.page_id: r.text for r in html_extraction.html_extraction(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert sum(got[i] == f"{prose(i)}\n{prose(i + 1)}" for i in range(40)) >= 36
    assert (html_extraction.Page(rows[0][2]).labels() == -1).all()
    bare = spark.createDataFrame([(1, "u", "<p></p>")], "page_id bigint, url string, html string")
    assert [r.text for r in html_extraction.html_extraction(bare).collect()] == [""]


def test_html_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "   "), (3, "u", "<p>unclosed <b>bold<p>next"), (3, "u", "<p>unclosed <b>bold<p>next"), (4, "u", "<script>var a = '<p>'"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "a < b <> & c <!-- x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("mine"))
    got = html_extraction.html_extraction(df).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, 4)} == {""}
    assert html_extraction.html_extraction(df.limit(0)).count() == 0
    page = html_extraction.Page("<p>unclosed <b>bold<p>next")
    assert [b[1] for b in page.blocks] == ["unclosed bold", "next"]
    # a rejected ancestor rejects what it holds
    page = html_extraction.Page("<div><p>one</p></div><p>two</p>")
    assert page.decode(np.array([0, -5.0, 1.0, 1.0])) == "two"


# --- 3


def test_language_held_out(docs):
    got = by_id(language_id.language_id(docs))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert held and sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_cases(odd):
    got = language_id.language_id(odd).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (4, 6, 8)} == {"und"}
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert language_id.language_id(odd.limit(0)).count() == 0
    assert language_id.keep_known(odd).columns == odd.columns
    # nothing to learn from
    assert {r.lang_pred for r in language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_grams(text):
    """1- to 3-grams of a text whose runs of other characters are one space, as are its ends."""
    import unicodedata

    low = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower().replace("\u03c2", "\u03c3"))
    said = " " + " ".join(low.split()) + " "
    return Counter(said[i : i + n] for n in (1, 2, 3) for i in range(len(said) - n + 1) if said[i : i + n] != " ")


def test_language_against_brute_force(spark, docs):
    """Out-of-place distances, worked out character by character."""
    size = 120
    key = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    best = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))][:size]
    by_lang = defaultdict(Counter)
    held = {r.doc_id: r.h for r in docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect()}
    for r in docs.collect():
        if r.lang and not held[r.doc_id]:
            by_lang[r.lang] += brute_grams(r.text)
    profiles = {x: {g: i for i, g in enumerate(best(c))} for x, c in by_lang.items()}
    got = by_id(language_id.language_id(docs, size=size, docs_per_language=10**9))
    for r in docs.limit(120).collect():
        own = best(brute_grams(r.text))
        far = {x: sum(abs(i - p[g]) if g in p else size for i, g in enumerate(own)) for x, p in profiles.items()}
        lang = min(sorted(far), key=far.get)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (lang, pytest.approx(1 - far[lang] / (size * len(own))))


def test_letters(spark):
    rows = [(i, t, "en") for i, t in enumerate(["\u00bd\u00b2", "\u2460\u2461", "\u2167", "12 _ 3", "\u0663", "\u00e9", "\u4e2d", "\u216b a"])]
    got = by_id(language_id.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {0, 1, 2, 3, 4}
    kept = language_id.keep_known(spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id bigint, text string, lang string"))
    assert {r.doc_id for r in kept.collect()} == {5, 6, 7}  # nothing to learn from, yet no letters are lost


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 100])
def test_grams_do_not_depend_on_chunks(monkeypatch, chunk):
    unpack = lambda k: "".join(chr(k >> 21 * i & 0x1FFFFF) for i in (2, 1, 0) if k >> 21 * i)
    for text in ("O\u00f9 est la 3e maison, dit-il?!  " * 9, "\u039f\u0394\u039f\u03a3 \u03a3\u0391\u03a3 \u00bd x", "...a", "a...", "a"):
        monkeypatch.setattr(language_id, "_CHUNK", chunk)
        keys, n = language_id.grams(text)
        assert {unpack(k): c for k, c in zip(keys.tolist(), n.tolist())} == brute_grams(text)


# --- 4


def brute_repeats(rows):
    data = [(t or "").encode() for _, t in rows]
    times = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for (doc, _), b in zip(rows, data):
        spans = []
        for i in range(len(b) - 399):
            if times[b[i : i + 400]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 400
                else:
                    spans.append([i, i + 400])
        kept, at = b"", 0
        for a, z in spans:
            kept, at = kept + b[at:a], z
        out.append((doc, len(b), sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1024, 8, 0])
def test_suffix_dedup_against_brute_force(spark, docs, odd, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    periodic = spark.createDataFrame([(9001, "a" * 1500, None, None, None), (9002, "ab" * 600, None, None, None), (9003, "x" * 399, None, None, None), (9004, "y" * 400, None, None, None)], SCHEMA)
    short = odd.where("doc_id <> 7 OR doc_id IS NULL").select(*docs.columns)
    table = docs.where("n_chars < 6000").unionByName(periodic).unionByName(short)
    assert sorted((tuple(r) for r in suffix_dedup.suffix_dedup_digest(table).collect()), key=str) == brute_repeats(plain(table))


def test_suffix_dedup_of_many_unlike_segments(spark, monkeypatch):
    """One passage in very many surroundings: more unlike segments than one suffix array takes."""
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    passage, near = prose(700), prose(330)
    rows = [(i, prose(rng.randint(0, 300)) + (passage if i % 3 else near + passage[:60] + prose(9)) + prose(rng.randint(0, 300)), None, None, None) for i in range(1800)]
    table = spark.createDataFrame(rows, SCHEMA)
    made = []
    refine = suffix_dedup._refine
    monkeypatch.setattr(suffix_dedup, "_refine", lambda width: made.append(width) or refine(width))
    assert sorted((tuple(r) for r in suffix_dedup.suffix_dedup_digest(table).collect()), key=str) == brute_repeats([r[:2] for r in rows])
    assert made and made[0] == 64


def test_copies_of_one_segment_do_not_meet_in_one_task(spark):
    """Rows of a frequent kind are found without a shuffle by kind, rare kinds with one; singles are left out."""
    kind = F.when(F.col("id") < 4000, 0).when(F.col("id") < 8000, F.floor(F.col("id") / 2)).otherwise(F.col("id"))
    rows = spark.range(0, 9000, 1, 20).select(kind.alias("g1"), *(F.lit(0).cast("long").alias(x) for x in ("g2", "s1", "s2")), F.lit(1).cast("long").alias("times"), F.col("id").alias("k1"), *(F.lit(0).cast("long").alias(x) for x in ("k2", "p", "n", "back")))
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        again, _ = suffix_dedup._shared(rows)
        got = again.select("k1", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r.k1 for r in got) == list(range(8000))
    assert max(Counter(r.at for r in got if r.k1 < 4000).values()) == 450


def test_periodic_texts_make_few_rows():
    """A text that repeats itself has a row a kind of segment and a row a stretch of them, not a row a byte."""
    import pyarrow as pa

    for data in (b"a" * 200_000, b"abc" * 50_000, b"".join(b"%04d" % (i % 300) for i in range(40_000))):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([data])], ["k1", "k2", "data"])
        rows = pa.Table.from_batches(suffix_dedup._run_rows(iter([batch]))).to_pydict()
        assert len(rows["p"]) < 3000
        covered = np.zeros(len(data), bool)
        for times, p, n in zip(rows["times"], rows["p"], rows["n"]):
            if not times:
                covered[p : p + n + 399] = True
        assert covered[2000:-2000].all()


def test_refined_parts_stay_in_proportion():
    """A segment's parts in a round hold its windows once each, and no more parts than stretches."""
    import pyarrow as pa

    data = bytes(random.Random(1).randrange(256) for _ in range(672))
    row = {x: [1] for x in suffix_dedup._PIECE} | {"p": [5], "n": [273], "back": [272], "bytes": [data]}
    names = [*suffix_dedup._PIECE, "bytes"]
    parts = [pa.RecordBatch.from_pydict({x: row[x] for x in names})]
    for width in suffix_dedup.WIDTHS:
        parts = list(suffix_dedup._refine(width)(iter(parts)))
        got = pa.Table.from_batches(parts).to_pydict()
        assert sum(got["n"]) == 273 and len(got["n"]) == -(-273 // width)
        assert sorted(p + i for p, n in zip(got["p"], got["n"]) for i in range(n)) == list(range(5, 278))
        assert all(b == data[p - 5 : p - 5 + n + 399] for p, n, b in zip(got["p"], got["n"], got["bytes"]))


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        t = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 40))]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_cases(odd):
    out = suffix_dedup.suffix_dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and out.where("text IS NULL").count() == 2
    assert suffix_dedup.suffix_dedup_digest(odd.limit(0)).count() == 0


# --- 5


def test_line_dedup_against_sql(spark, docs):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(c.execute("SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (" + LINE_DEDUP + ")").fetchall())
    for n in (1, 7):  # runs that reach over the edges of partitions
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup_digest(docs).collect())
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == expected


def test_line_dedup_hot_line(spark):
    rows = [(i, "A line that every document holds\nown line of document number %d" % i, None, None, 0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    out = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert [i for i, r in out.items() if "every document" in r.text] == [499]
    assert all(r.n_chars == len(r.text) for i, r in out.items() if i != 499)


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    gone = lambda i, x: i is not None and len(holders.get(key(x), ())) >= min_docs and i != max(holders[key(x)])
    return Counter((i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in rows)


def test_line_dedup_of_repeated_ids(spark, odd):
    for df in (repeated_ids(spark), odd.select("doc_id", "text", "n_chars")):
        got = Counter((r.doc_id, r.text or "") for r in line_dedup.line_dedup(df).collect())
        assert got == brute_lines(plain(df))
    assert any("precious" in r.text for r in line_dedup.line_dedup(repeated_ids(spark)).collect())


def test_line_dedup_cases(odd):
    got = line_dedup.line_dedup_digest(odd).collect()
    assert len(got) == odd.count()
    drops = {(r.doc_id, r.n_lines): r.n_dropped for r in got}
    assert drops[1, 3] == drops[2, 3] == 2 and drops[3, 3] == 0 and drops[None, 3] == 0 and drops[4, 1] == drops[None, 1] == 0
    out = line_dedup.line_dedup(odd)
    assert out.columns == odd.columns and out.where("text IS NULL").count() == 2
    assert line_dedup.line_dedup_digest(odd.limit(0)).count() == 0
    assert line_dedup.keep_lines("a\nb\nc", None) == "a\nb\nc"


# --- 6


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(s):
        return sum(d if p % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for p, d in enumerate(map(int, reversed(s)))) % 10 == 0

    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            g = m.group()
            d = re.sub("[^0-9]", "", g)
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in g.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_pairs_of_entities_and_terms(spark, monkeypatch):
    """Counts of what can be disclosed equal those of all pairs; a directory of very many entities and terms pairs few."""
    rng = random.Random(4)
    total = 5_000
    held, said = [(k, c) for k in range(60) for c in rng.sample(range(30), 6)], [(k, t) for k in range(60) for t in rng.sample(range(80), 20)]
    n_c, n_t = Counter(c for _, c in held), {t: n + (0 if t % 3 else 900) for t, n in Counter(t for _, t in said).items()}
    kept = spark.createDataFrame([(k, c, n_c[c]) for k, c in held], "k bigint, c bigint, n_c bigint")
    terms = spark.createDataFrame([(k, t, n_t[t]) for k, t in said], "k bigint, t bigint, n_t bigint")
    docs = spark.createDataFrame([(total,)], "total bigint")
    d = lambda n, c, t: np.log2(n * total / (n_c[c] * max(n_t[t], n))) / -np.log2(n_c[c] / total)
    every = Counter((c, t) for k, c in held for q, t in said if k == q)
    for split in (64, 1):
        monkeypatch.setattr(pii, "SPLIT", split)
        got = {(r.c, r.t): r.n_ct for r in pii._together(kept, terms, docs, 0.7).collect()}
        assert all(every[x] == n for x, n in got.items())
        assert {x for x, n in every.items() if d(n, *x) >= 0.7} <= set(got) and len(got) < len(every)
    # one page with 400 entities, each in two other documents, and 400 terms that half of all documents have
    kept = spark.range(400).select(F.lit(0).cast("bigint").alias("k"), F.col("id").alias("c"), F.lit(3).cast("bigint").alias("n_c"))
    terms = spark.range(400).select(F.lit(0).cast("bigint").alias("k"), F.col("id").alias("t"), F.lit(total // 2).cast("bigint").alias("n_t"))
    assert pii._together(kept, terms, docs, 0.9).isEmpty()


def test_pii_against_brute_force(spark, docs, odd):
    tricky = [
        "a@b.c.d@e.f.g x@y", "a@b.c_d@e.fg", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.01", "4111 1111 1111 1111, 4111-1111-1111-1112 1  23", "+49 (0) 30 123-456 +1 2 3 +12345678901234567", "é" * 50 + " me@x.org é 10.0.0.1",
        "7" * 30_000, "a" * 30_000 + " @", "1 " * 20_000, "." * 1000 + "@" + "a." * 10_000 + "b", "+4111111111111111",
    ]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(tricky)], "doc_id bigint, text string")).unionByName(odd.select("doc_id", "text"))
    texts = Counter((i, hashlib.sha256(",".join(brute_spans(t)).encode()).hexdigest(), *(sum(s.startswith(k) for s in brute_spans(t)) for k in PLAIN)) for i, t in plain(table))
    got = pii.pii_spans(table).collect()
    assert Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == texts
    for r in got:
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in r.spans.split(",") if s][: r.n_email + r.n_ip + r.n_card + r.n_phone]


def test_pii_disclosing_terms(spark):
    filler = "the of and to in is was that for on with as by at from it be this are or"
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(filler.split()) for _ in range(n))
    rows = [(i, f"{some(9)} Zorblatt writes from zor@blatt.org {some(9)}") for i in range(6)] + [(100 + i, some(60)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(pii.pii_spans(df))
    for i in range(6):
        assert rows[i][1].index("Zorblatt") in [int(s.split(":")[1]) for s in got[i].spans.split(",") if s.startswith("term")]
    assert not any(r.spans for i, r in got.items() if i >= 100)
    clean = by_id(pii.sanitise(df))
    assert "zor@blatt" not in clean[0].text and "Zorblatt" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[100].text == rows[6][1]


def test_pii_disclosing_terms_far_from_the_entity(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("the of and to in is was that for on with as by at".split()) for _ in range(n))
    near = [(i, f"{some(9)} Zorblatt writes from zor@blatt.org {some(40)} zorblatt, {some(40)}") for i in range(6)]
    far = [(20 + i, f"{some(9)} writes to quux@corp.org {some(60)} Quuxington {some(9)}") for i in range(6)]
    df = spark.createDataFrame([*near, *far, *((100 + i, some(60)) for i in range(300))], "doc_id bigint, text string")
    got = by_id(pii.pii_spans(df))
    for i, text in near + far:
        places = {m.span() for m in re.finditer("zorblatt|quuxington", text, re.I)}
        assert places <= {tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s.startswith("term")}
    assert not any(r.spans for i, r in got.items() if i >= 100)
    clean = by_id(pii.sanitise(df))
    assert not any(re.search("zorblatt|quuxington", clean[i].text, re.I) for i, _ in near + far)


def plain_terms(rows):
    """Term spans of each row, by the rule as worded: texts hold an email at most."""
    word = lambda text: [(m.group().lower(), *m.span()) for m in re.finditer(r"[^\W_'-]*(?:['-]*[^\W_'-]+)+['-]*|['-]+", text)]
    n_t, docs, total = Counter(), Counter(), len(rows)
    near, both, holds, like_near, like_both, like = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set), defaultdict(set)
    for (doc_id, text), times in Counter(rows).items():
        said = [w for w, _, _ in word(text)]
        n_t.update({w: n * times for w, n in Counter(said).items()})
        docs.update(dict.fromkeys(said, times))
        if not (m := re.search(PLAIN["email"], text)):
            continue
        c, left, right = m.group().lower(), text[: m.start()][-120:], text[m.end() :][:120]
        around = (left, m.group(), right)
        holds[c] += times
        like[c].add(around)
        beside = [w for w, a, _ in word(left) if a > 0 or len(left) < 120][-8:] + [w for w, _, b in word(right) if b < 120 or len(right) < 120][:8]
        for seen, at, counts in ((beside, like_near, near), (set(said), like_both, both)):
            for t in seen:
                if re.search(r"[^\W_]", t):
                    counts[c, t] += times
                    at[c, t].add(around)
    words, by_c, told = sum(n_t.values()), Counter(), set()
    for (c, _), n in near.items():
        by_c[c] += n
    for counts, at, n_c, n_all, of in ((near, like_near, by_c, words, n_t), (both, like_both, holds, total, docs)):
        for (c, t), n in counts.items():
            if len(at[c, t]) >= 3 and n_c[c] < n_all and np.log2(n * n_all / (n_c[c] * max(of[t], n))) / -np.log2(n_c[c] / n_all) >= 0.9:
                told.add((c, t))
    out = {}
    for doc_id, text in set(rows):
        m = re.search(PLAIN["email"], text)
        free = [(a, b) for w, a, b in word(text) if m and (m.group().lower(), w) in told and (b <= m.start() or a >= m.end())]
        out[doc_id, text] = [f"term:{a}:{b}" for a, b in free]
    return out


def test_pii_terms_against_brute_force(spark):
    """Copies that differ far from the entity, copies under other ids, repeated rows, short terms and numbers."""
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice("the of and to in is was that for on with as by at 12 7 a".split()) for _ in range(n))
    rows = [(1000 + i, some(60)) for i in range(300)]
    head = [f"{some(60)} writes to one@corp.org {some(60)}" for _ in range(3)]
    # of the four that are alike, one alone has the term
    rows += [(i, head[0] + (" Quuxington" if i == 2 else "")) for i in range(4)] + [(10 + i, f"{head[1 + i]} quuxington") for i in range(2)]
    rows += [(20 + 3 * i + j, f"{text} Copied") for i, text in enumerate(f"{some(60)} via two@corp.org {some(60)}" for _ in range(3)) for j in range(3)]
    rows += [(40 + i, text) for i, text in enumerate(f"{some(60)} via three@corp.org {some(60)} again" for _ in range(3)) for _ in range(5)]
    rows += [(50 + i, f"{some(30)} Bo 77123 four@corp.org {some(60)}") for i in range(4)]
    # two unlike ones are too few, however many copies they have
    rows += [(60 + i, f"{text} seldom") for i, text in enumerate([f"{some(60)} five@corp.org {some(60)}" for _ in range(2)] * 3)]
    expected = plain_terms(rows)
    got = pii.pii_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert [x for x in r.spans.split(",") if x.startswith("term")] == expected[r.doc_id, text[r.doc_id]], text[r.doc_id]
    found = {(r.doc_id, text[r.doc_id][slice(*map(int, x.split(":")[1:]))].lower()) for r in got for x in r.spans.split(",") if x.startswith("term")}
    assert {(2, "quuxington"), (10, "quuxington"), (20, "copied"), (40, "again"), (50, "bo"), (50, "77123")} <= found and not any(t == "seldom" for _, t in found)


def test_pii_terms_that_fall_apart_in_lower_case(spark):
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice("the of and to in is was that for on with as by at".split()) for _ in range(n))
    rows = [(i, f"{some(9)} \u0130skender isk@corp.org {some(9)}") for i in range(4)] + [(100 + i, some(60)) for i in range(300)]
    got = by_id(pii.pii_spans(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for i, text in rows[:4]:
        at = text.index("\u0130")
        assert f"term:{at}:{at + 8}" in got[i].spans.split(",")


def test_pii_cases(odd):
    assert pii.pii_spans(odd).count() == odd.count() and pii.pii_spans(odd.limit(0)).count() == 0
    assert pii.sanitise(odd).columns == odd.columns


# --- 7


def test_topk_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = sorted(c.execute("SELECT query_id, rank, vec_id, score FROM (" + topk.ORACLE + ")").fetchall())
    assert sorted(tuple(r) for r in topk.exact_topk(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()) == expected


def brute_topk(rows, every, k):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({i: q for i, q in reversed(ok)}.items()):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_topk_cases(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(150)]
    rows += [(2000, None), (2050, [None] + [0.0] * 7), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [0.5, 0.5]), (None, [1.0] * 8), (7, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).withColumn("cell", F.lit(2))
    assert sorted(tuple(r) for r in topk.exact_topk(df, 50, 5).collect()) == brute_topk(rows, 50, 5)
    few = df.where("vec_id IN (50, 51)")
    assert topk.exact_topk(few).count() == 1 and topk.exact_topk(df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e7 + 1, 2.0]), (2, [1e7, 2.0])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.exact_topk(big).orderBy("rank").collect()] == [(j, -s) for s, j in sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip([1e7, 1.0], v)), j) for j, v in ((1, [1e7 + 1, 2.0]), (2, [1e7, 2.0])))]


# --- 8


def test_token_counts_and_cache(spark, docs, odd, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_file("byte_bpe_50k.json"))
    special = spark.createDataFrame([(9001, "a <|endoftext|> b<|endoftext|>", None, None, None), (9002, "  two  spaces\n\n\nand 'll's 12345 ünïcödé", None, None, None)], SCHEMA)
    table = docs.unionByName(special).unionByName(odd.select(*docs.columns))
    cache = token_counts.fresh_cache(docs)
    got = token_counts.token_counts(table, cache).collect()
    expected = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False)), len(t.encode(x or "", add_special_tokens=False)) > 1024) for i, x in plain(table))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == expected
    stored = spark.read.parquet(cache).count()
    assert stored == table.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = token_counts.token_counts(table, cache)
    assert again.count() == len(got) and spark.read.parquet(cache).count() == stored  # all hits: nothing was encoded or appended
    few = table.limit(7).unionByName(spark.createDataFrame([(9003, "a text that the cache lacks", None, None, None)], SCHEMA))
    for bits in (1 << 25, 64):  # a filter that tells all misses, and one that passes nearly everything
        monkeypatch.setattr(token_counts, "MOST_BITS", bits)
        half = token_counts.fresh_cache(docs)
        token_counts.token_counts(table.limit(5), half).count()
        assert token_counts.token_counts(few, half).count() == 8
        assert spark.read.parquet(half).groupBy("version", "digest").count().where("count > 1").isEmpty()
        assert spark.read.parquet(half).count() == table.limit(5).unionByName(few).select(F.coalesce("text", F.lit(""))).distinct().count()
    other = token_counts.token_counts(docs, cache, "piece_bpe_32k.model")
    assert other.count() == docs.count() and spark.read.parquet(cache).count() > stored  # another version is another key
    assert token_counts.token_counts(odd.limit(0), token_counts.fresh_cache(docs)).count() == 0


def test_token_counts_of_a_warm_cache_move_missing_texts_alone(spark):
    """Many misses beside many hits: the filter passes all misses and few others."""
    rows = spark.range(20_000).select(F.concat(F.lit("text "), "id").alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    lacking = rows.limit(4_000).select("digest").cache()
    passed = token_counts._likely(rows, lacking, 1 << 16).select("digest").cache()
    assert passed.join(lacking, "digest", "left_semi").count() == lacking.count()
    assert passed.count() - lacking.count() < 0.1 * 16_000
    assert token_counts._likely(rows, lacking.limit(0), 1 << 10).isEmpty()


def test_topk_of_empty_vectors(spark):
    df = spark.createDataFrame([(0, []), (50, []), (7, []), (8, None)], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in topk.exact_topk(df).collect()) == [(0, 1, 7, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 7, 0)]


def test_topk_ships_visited_annuli_alone(spark, monkeypatch):
    """Clusters, so that most annuli are out of reach; several blocks of queries; with and without broadcasts."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 8)) * 3
    x = centres[rng.integers(0, 12, 6000)] + rng.normal(0, 0.05, (6000, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    q = np.floor(256 * x)
    expected = []
    for i in range(0, 6000, 50):
        score = q @ q[i]
        score[i] = -np.inf
        order = np.lexsort((np.arange(6000), -score))[:5]
        expected += [(i, r, int(j), int(score[j])) for r, j in enumerate(order, 1)]
    monkeypatch.setattr(topk, "QUERIES", 40)
    for small in (1_000_000, 0):
        monkeypatch.setattr(topk, "SMALL", small)
        assert sorted(tuple(r) for r in topk.exact_topk(df).collect()) == expected


# --- 9


def test_decontamination_against_sql(spark, docs):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = sorted(c.execute("SELECT doc_id, contaminated, n_items, item_ids FROM (" + decontamination.ORACLE + ")").fetchall())
    got = sorted(tuple(r) for r in decontamination.decontamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect())
    assert got == expected and any(r[1] for r in got)


def test_decontamination_short_items(spark):
    """Items of 5 to 10 words are found whole, shorter ones as whole texts."""
    items = [(1, "which river runs through it"), (2, "yes"), (3, "the sum of two and two is four or five"), (4, "one two three four"), (5, "..."), (6, "")]
    texts = [
        "Q: Which river runs through it?", "which river runs under it", "Yes!", "yes it is", "so the sum of two and two is four or five then", "the sum of two and two is four or six", "one two three four",
        "one two three four five", "...", "", "which river runs", "through it which river runs through it it which river runs through it",
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.decontamination(rows, bench).collect()}
    assert {i: x for i, x in got.items() if x} == {0: "1", 2: "2", 4: "3", 6: "4", 11: "1"}
    c = duckdb.connect()
    for name, table in (("documents", rows), ("benchmark", bench)):
        own = table.toPandas()  # noqa: F841
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM own")
    assert dict(c.execute("SELECT doc_id, item_ids FROM (" + decontamination.ORACLE + ")").fetchall()) == got


def test_decontamination_substitutions(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    long_item, short_item = [word() for _ in range(24)], [word() for _ in range(12)]
    bench = spark.createDataFrame([(1, " ".join(long_item)), (2, " ".join(short_item)), (3, "too brief"), (4, None), (None, " ".join(word() for _ in range(20))), (1, " ".join(long_item))], "item_id bigint, text string")
    rows, expected = [], {}
    for i in range(60):
        item, most = (long_item, 2) if i % 2 else (short_item, 1)
        n = i // 2 % 4
        w = list(item)
        for p in rng.sample(range(len(w)), n):
            w[p] = word()
        rows.append((i, " ".join([word() for _ in range(i % 5)] + w + [word() for _ in range(3)]).upper() + "!"))
        best = max(sum(a == b for a, b in zip(w[s : s + 18], item[s : s + 18])) for s in range(max(1, len(item) - 17)))
        expected[i] = best >= (16 if i % 2 else len(item) - 1)
    got = by_id(decontamination.decontamination(spark.createDataFrame(rows, "doc_id bigint, text string"), bench))
    assert {i: r.contaminated for i, r in got.items()} == expected and any(expected.values()) and not all(expected.values())


def test_decontamination_cases(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert not any(r.contaminated for r in decontamination.decontamination(odd, bench).collect())
    assert decontamination.decontamination(odd.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.decontamination(odd, bench.limit(0)).collect())
    kept = decontamination.keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def brute_contaminated(text, items):
    """Item ids by comparing every diagonal."""
    split = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    w, out = split(text), []
    for item_id, t in items:
        v = split(t)
        n, hit = len(v), False
        for d in range(1 - n, len(w)):
            equal = [0 <= d + i < len(w) and w[d + i] == x for i, x in enumerate(v)]
            if n >= 18:
                hit |= any(sum(equal[i : i + 18]) >= 16 for i in range(n - 17))
            else:
                hit |= sum(equal) >= (n - 1 if n >= 11 else n) and (n >= 5 or len(w) == n)
        if hit and n:
            out.append(item_id)
    return ",".join(map(str, sorted(out)))


def test_decontamination_against_every_diagonal(spark, monkeypatch):
    """Few words, so that seeds repeat; items of all lengths, copied with substitutions; texts longer than a part."""
    monkeypatch.setattr(decontamination, "PART", 16)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 9, 10, 11, 14, 17, 18, 19, 30])))) for i in range(40)]
    rows = []
    for i in range(60):
        own = rng.choices(words, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = rng.choice(words)
            own += part + rng.choices(words, k=rng.randint(0, 20))
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.item_ids for r in decontamination.decontamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {i: brute_contaminated(t, items) for i, t in rows} and len(set(got.values())) > 10


def contexts(spark, rows, items):
    """Places of texts, pairs of contexts that are compared, and pairs that match."""
    near = spark.createDataFrame(rows, "doc_id bigint, text string").select(*decontamination.row_key(), decontamination.tokens(F.col("text")).alias("words")).cache()
    bench = spark.createDataFrame(items, "item1 bigint, text string").select("item1", F.lit(0).alias("item2"), decontamination.tokens(F.col("text")).alias("item_words")).cache()
    places = decontamination._with_contexts(decontamination._item_places(bench), ["item1", "item2"], "c", "need").cache()
    spots = decontamination._with_contexts(decontamination._text_places(near, []), ["k1", "k2"], "t").cache()
    compared = spots.select("seed", "t1", "t2").distinct().join(places.select("seed", "c1", "c2").distinct(), "seed").count()
    return spots.count(), compared, decontamination.matching_contexts(spots, places).count()


def test_decontamination_of_repeated_words_compares_few_contexts(spark):
    some = contexts(spark, [(1, "ab " * 100)], [(1, "ab " * 500)])
    many = contexts(spark, [(1, "ab " * 16_000), (2, "ab " * 9_000)], [(1, "ab " * 500)])
    assert many[0] > 100 * some[0] and many[1:] == some[1:] and many[1] < 700


def test_decontamination_of_template_items(spark):
    """Items and texts share 40 words: pairs inside the template are compared once, not once for each item and text."""
    template = " ".join(f"t{i}" for i in range(40))
    own = lambda a, i: " ".join(f"{a}{i}x{k}" for k in range(20))
    items, rows = [(i, f"{template} {own('q', i)}") for i in range(30)], [(i, f"{own('d', i)} {template} {own('e', i)}") for i in range(20)]
    _, compared, _ = contexts(spark, rows, items)
    assert compared <= 11 * len(items) * len(rows)  # of 31 seeds in the template
    got = decontamination.decontamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.n_items for r in got.collect()} == {30}


def test_decontamination_without_broadcasts(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.decontamination(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontamination.decontamination(docs, bench).collect())) == whole


# --- 10


def water_fill(sizes):
    """Targets by repeated sharing, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check_mix(df, rows):
    sizes = Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = [(r.source, words(r.text), r.doc_id) for r in df.collect()]
    for s, n, _ in source:
        sizes[s] += n
    target = water_fill(dict(sizes))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, n) for _, n, i in source)
    assert all(r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0) for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[round(r.target, 6), r.source_size].append(r)
    assert {k for k in by_source} == {(round(target[s], 6), sizes[s]) for s in sizes}
    for (t, size), own in by_source.items():
        n = sum(1 for s in sizes if (round(target[s], 6), sizes[s]) == (t, size))
        assert abs(sum(r.taken for r in own) - n * t) <= n * max([r.size for r in own] + [0]) + 1e-6


def test_mixing(docs, odd):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        check_mix(df, rows)
        key = lambda rs: sorted(map(tuple, rs), key=str)
        assert key(rows) == key(mixing.mix(df).collect())
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_of_equal_rows(spark):
    """A source of 64,000 equal rows: buckets stay small."""
    rows = spark.range(64_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("two words").alias("text"), F.lit("a").alias("source"))
    rows = rows.unionByName(spark.range(9000).select("id", F.lit("some more words").alias("text"), F.lit("b").alias("source")).withColumnRenamed("id", "doc_id"))
    began = time.time()
    got = mixing.mix(rows).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"), F.max("taken").alias("most")).collect()
    assert time.time() - began < 60
    assert sorted(r.n for r in got) == [9000, 64_000]
    assert all(abs(r.taken - r.target) <= 3 and r.most <= 9 for r in got)


def test_mixing_targets(spark):
    for sizes in ({"a": 100, "b": 1, "c": 5, "d": 900, None: 7}, {"a": 10}, {"a": 0, "b": 4}, {"é": 3, "z": 3, "A": 3}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(water_fill(sizes))


def test_mixing_tree_is_unbiased(spark):
    """Many equal documents at a ratio of 1.5: half of them twice, over several levels."""
    rows = [(i, "one two three", "a") for i in range(3000)] + [(10_000 + i, "one two three", "b") for i in range(9000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for source_size in (9000, 27000):
        own = [r for r in got if r.source_size == source_size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3
