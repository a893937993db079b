"""Main text of HTML pages: gradient-boosted trees over DOM nodes, then hierarchical decoding.

Every block element with text is scored by trees on its features (subtree density, attribute tokens, depth,
sibling statistics). Decoding chooses, over the whole tree, the best set of nodes such that whatever stands
in a rejected node is rejected too, so an ancestor and a descendant can't contradict each other.

The trees are trained here, by Spark ML, on a bounded sample of pages: as they are, labelled by their
semantic containers if they have any, and set anew in varied layouts whose labels are known.

Pages are read in time linear in their length, however broken: a tag, quote or comment that never ends takes
the rest of the page, as HTML has it, and an end tag finds its element by name.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas select button textarea".split())
NESTED = frozenset("svg canvas".split())  # of the raw ones, those that can hold their like
UNSEEN = frozenset("head title option datalist audio video annotation annotation-xml".split())
BLOCK = frozenset(
    "html body article main section div nav header footer aside form fieldset ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 "
    "blockquote pre table caption thead tbody tfoot tr td th figure figcaption address details summary hr dialog center menu".split()
)
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
TOKENS = {
    "main": "article content post main entry story text body prose page",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs links",
    "edge": "header footer masthead banner topbar bottom copyright colophon legal",
    "side": "sidebar side aside related widget widgets rail recommended trending popular tags more",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion commercial partner",
    "notice": "cookie cookies consent notice notices alert gdpr popup modal overlay warning subscribe newsletter paywall toast",
    "form": "form login signup search subscribe register contact input",
    "talk": "comment comments reply replies respond discussion disqus thread feedback review reviews",
    "share": "share sharing social follow like buttons toolbar meta byline",
}
TOKENS = {k: frozenset(v.split()) for k, v in TOKENS.items()}
TAG_GROUPS = {"p": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "li": 2, "ul": 3, "ol": 3, "dl": 3, "menu": 3, "div": 4, "section": 4, "article": 5, "main": 5, "nav": 6, "header": 7, "footer": 8, "aside": 9, "form": 10, "fieldset": 10, "dialog": 10, "blockquote": 11, "pre": 11, "table": 12, "tr": 12, "td": 12, "th": 12, "figure": 13, "figcaption": 13}
N_TAGS = 15

# Quotes count as such behind an equals sign only.
_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"']))|[\"'])*+)>|([^<]+|<)",
    re.S,
)
_raw_end = {tag: re.compile(rf"</{tag}(?![A-Za-z0-9-])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_nested = {tag: re.compile(rf"<(/?){tag}(?![A-Za-z0-9-])[^>]*?(/?)(?:>|\Z)", re.I) for tag in NESTED}
_attr = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_name = re.compile(r"[a-z]+")


def _raw_until(tag: str, text: str, at: int) -> int:
    """Where a raw element that begins before ``at`` ends; elements of its own kind inside it are counted."""
    if tag not in NESTED:
        close = _raw_end[tag].search(text, at)
        return close.end() if close else len(text)
    open_ = 1
    for m in _nested[tag].finditer(text, at):
        open_ += -1 if m[1] else not m[2]
        if not open_:
            return m.end()
    return len(text)


class Page:
    """The block elements of a page, each with its parent, and the text blocks in page order.

    Parents come before their children. A text block is what stands between two borders of block elements."""

    def __init__(self, text: str):
        self.tag, self.parent, self.names, self.label = ["html"], [-1], [frozenset()], [None]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._read(text)

    def _read(self, text: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # inline elements hold their block's node
        places: dict[str, list[int]] = {"html": [0]}  # of open elements in the stack, by name
        blocks = [0]  # of open block elements in the stack
        piece: list[str] = []
        links = linked = unseen = at = 0

        def flush() -> None:
            nonlocal linked
            if piece:
                said = " ".join(entities.unescape("".join(piece)).split())
                if said:
                    self.blocks.append((stack[-1][1], said, min(linked, len(said))))
                piece.clear()
            linked = 0

        def push(tag: str, node: int) -> None:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append((tag, node))

        def pop(to: int) -> None:
            nonlocal links, unseen
            if blocks[-1] >= to:
                flush()
            while len(stack) > to:
                tag, _ = stack.pop()
                places[tag].pop()
                links -= tag == "a"
                unseen -= tag in UNSEEN
                if tag in BLOCK:
                    blocks.pop()

        def top(tags: frozenset[str]) -> int:
            """The innermost open element of these names; 0 if there is none."""
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        while at < len(text):
            m = _token.match(text, at)
            at = m.end()
            end, start, attrs, said = m.groups()
            if said is not None:
                if said == "<" and text[at : at + 1].isalpha() and text[at : at + 1].isascii():
                    break  # a tag or quote that doesn't end
                if not unseen:
                    piece.append(said)
                    if links:
                        linked += len(said.strip())
            elif start is not None:
                tag = start.lower()
                if tag in RAW:
                    if not attrs.endswith("/"):
                        at = _raw_until(tag, text, at)
                    continue
                if tag in VOID:
                    if tag in ("br", "hr"):
                        flush() if tag == "hr" else piece.append(" ")
                    continue
                if tag == "html":
                    continue
                if tag in BLOCK and stack[blocks[-1]][0] == "p":  # an open paragraph ends before a block
                    pop(blocks[-1])
                if tag in CLOSES:
                    ends, stop = CLOSES[tag]
                    i = top(ends)
                    if i > top(stop):
                        pop(i)
                if tag in BLOCK:
                    flush()
                    found = {k.lower(): a or b or c for k, a, b, c in _attr.findall(attrs)} if attrs else {}
                    self.tag.append(tag)
                    self.parent.append(stack[-1][1])
                    self.names.append(frozenset(_name.findall(" ".join((found.get("class") or "", found.get("id") or "", found.get("role") or "")).lower())))
                    self.label.append(found.get("data-y"))
                    push(tag, len(self.tag) - 1)
                else:
                    if not attrs.endswith("/"):
                        links += tag == "a"
                        unseen += tag in UNSEEN
                        push(tag, stack[-1][1])
            elif end is not None:
                if (i := top(frozenset((end.lower(),)))) > 0:
                    pop(i)
        flush()

    def features(self) -> Callable[[int, int], np.ndarray]:
        """Rows of the nodes from one number to another; few of them are held as numbers at a time."""
        n = len(self.tag)
        chars, words, linked, stops, own, depth = (np.zeros(n) for _ in range(6))
        nodes, blocks, inner, before = np.ones(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)
        seen = 0
        for node, said, link in self.blocks:
            chars[node] += len(said)
            own[node] += len(said)
            words[node] += said.count(" ") + 1
            linked[node] += link
            stops[node] += said.count(".") + said.count(",")
            blocks[node] += 1
            if before[node] < 0:
                before[node] = seen
            seen += len(said)
        flags = np.zeros((n, len(TOKENS)), bool)
        for i, names in enumerate(self.names):
            if names:
                flags[i] = [bool(names & TOKENS[k]) for k in TOKENS]
        tags = np.zeros((n, N_TAGS), bool)
        tags[np.arange(n), [TAG_GROUPS.get(t, N_TAGS - 1) for t in self.tag]] = True
        above = np.zeros((n, len(TOKENS) + N_TAGS), bool)
        marks = np.column_stack([flags, tags])
        place, children = np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            above[i] = above[p] | marks[p]
            place[i] = children[p]
            children[p] += 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for x in (chars, words, linked, stops, blocks):
                x[p] += x[i]
            nodes[p] += nodes[i]
            if before[i] >= 0 and (before[p] < 0 or before[i] < before[p]):
                before[p] = before[i]
        p = np.maximum(0, np.array(self.parent))
        same = np.zeros(n)
        twins: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            twins[p[i], self.tag[i]] = twins.get((p[i], self.tag[i]), 0) + 1
        for i in range(1, n):
            same[i] = twins[p[i], self.tag[i]]
        total = max(1.0, chars[0])
        numbers = np.column_stack([
            np.log1p(chars), np.log1p(words), np.log1p(own), linked / np.maximum(1, chars), stops / np.maximum(1, words), chars / np.maximum(1, words),
            np.log1p(chars / nodes), words / np.maximum(1, blocks), np.log1p(nodes), depth, place, children[p], place / np.maximum(1, children[p]), same,
            chars / np.maximum(1, chars[p]), linked[p] / np.maximum(1, chars[p]), chars / total, np.maximum(0, before) / total,
        ])
        return lambda a, z: np.column_stack([numbers[a:z], marks[a:z], above[a:z]])

    def labels(self) -> np.ndarray:
        """1 where most of a node's text is main text, by ``data-y`` marks or, without any, by semantic containers;
        -1 where that isn't known: nodes without text, and pages that have neither."""
        n = len(self.tag)
        marked = any(x is not None for x in self.label)
        if not marked and not any(t in ("article", "main") for t in self.tag):
            return np.full(n, -1.0)
        state, main, chars = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(1, n):
            state[i] = state[self.parent[i]]
            if marked:
                state[i] = float(self.label[i]) if self.label[i] is not None else state[i]
            elif self.tag[i] in ("article", "main"):
                state[i] = 1
            elif self.tag[i] in ("nav", "aside", "footer", "form") or self.names[i] & (TOKENS["ad"] | TOKENS["talk"] | TOKENS["notice"]):
                state[i] = 0
        for node, said, _ in self.blocks:
            chars[node] += len(said)
            main[node] += len(said) * state[node]
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            main[self.parent[i]] += main[i]
        return np.where(chars > 0, main >= 0.5 * chars, -1).astype(float)

    def decode(self, logit: np.ndarray) -> str:
        """Text of the kept nodes. A node's gain is its own score and its children's gains, if that is positive;
        otherwise it is rejected with all that it holds."""
        n = len(self.tag)
        own = np.zeros(n, bool)
        for node, _, _ in self.blocks:
            own[node] = True
        gain = np.where(own, 1.0, 0.3) * logit
        gain[0] = 0
        for i in range(1, n):
            if self.tag[i] == "body":
                gain[i] = 0
        best = gain.copy()
        for i in range(n - 1, 0, -1):
            if best[i] > 0:
                best[self.parent[i]] += best[i]
        kept = np.zeros(n, bool)
        kept[0] = True
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and best[i] > 0
        # the root and body hold text of their own only by accident of markup; it follows its own score
        loose = [i for i in range(n) if (i == 0 or self.tag[i] == "body") and own[i]]
        for i in loose:
            own[i] = logit[i] > 0
        return "\n".join(said for node, said, _ in self.blocks if kept[node] and own[node])


#: Elements that hold the main text in the layouts that training sets pages in.
CONTAINERS = (
    ("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="post-body"'), ("section", 'class="entry"'), ("div", 'class="article-text"'), ("div", ""), ("td", ""), ("article", 'class="post"'), ("div", 'role="main"'),
)


def _layout(rng: random.Random, main: list[str], other: list[str], containers: tuple = CONTAINERS) -> str:
    """A page with known labels (``data-y``), in one of many layouts."""
    pick = rng.choice
    few = lambda a, b: [pick(other) for _ in range(rng.randint(a, b))]
    esc = lambda x: entities.escape(x, quote=False)
    short = lambda: " ".join(pick(other).split()[: rng.randint(1, 5)])
    link_list = lambda: "".join(f'<li><a href="/x">{esc(short())}</a></li>' for _ in range(rng.randint(3, 9)))
    links = lambda open_, close: f"{open_}<ul>{link_list()}</ul>{close}"
    paragraphs = lambda xs: "".join(f"<p>{esc(x)}</p>" for x in xs)

    def box(names: list[str], tags: list[str], inner: str) -> str:
        tag = pick(tags)
        name = pick(names)
        attr = pick(['class="{}"', 'id="{}"', 'class="box {} clear"']).format(name) if tag in ("div", "section", "ul", "p") or rng.random() < 0.5 else ""
        return f'<{tag} data-y="0" {attr}>{inner}</{tag}>'

    def ad() -> str:
        return box(["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot"], ["div", "aside", "section"], pick([esc(pick(other)), f"<p>{esc(pick(other))}</p>", f'<a href="/ad">{esc(short())}</a>']))

    def block(x: str) -> str:
        return pick(["<p>{}</p>"] * 8 + ["<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<p><b>{}<br>", "<div>{}</div>", "<pre>{}</pre>"]).format(esc(x))

    head = f"<h1>{esc(short())}</h1>" if rng.random() < 0.8 else ""
    body = [block(x) for x in main]
    if rng.random() < 0.4:
        body.insert(rng.randint(0, len(body)), ad())
    if rng.random() < 0.3:
        body.append(box(["share", "social-buttons", "share-bar"], ["div", "ul"], links("", "") if rng.random() < 0.5 else esc(short())))
    inner = head + "".join(body)
    tag, attr = pick(containers)
    article = f'<{tag} data-y="1" {attr}>{inner}</{tag}>'
    if tag == "td":
        article = f"<table><tr>{article}</tr></table>"
    if rng.random() < 0.3:
        article = f'<div class="{pick(["wrap", "container", "row", "page"])}">{article}</div>'
    top = [
        box(["site-header", "masthead", "header", "topbar"], ["header", "div"], f"<h1>{esc(short())}</h1>" + (f"<p>{esc(pick(other))}</p>" if rng.random() < 0.5 else "")),
        box(["nav", "menu", "navbar", "main-menu"], ["nav", "div"], links("", "")),
        box(["cookie-notice", "consent", "notice", "alert", "gdpr-banner"], ["div", "section", "p"], esc(" ".join(few(1, 2)))),
        ad(),
        box(["breadcrumb", "breadcrumbs"], ["div", "nav"], " &gt; ".join(f'<a href="/">{esc(short())}</a>' for _ in range(3))),
        box(["search", "login-form"], ["form"], f"<label>{esc(short())}</label><input>"),
    ]
    bottom = [
        box(["sidebar", "related", "widget", "side"], ["aside", "div"], f"<h3>{esc(short())}</h3>" + pick([links("", ""), paragraphs(few(1, 4))])),
        box(["comments", "comment-list", "replies", "discussion"], ["section", "div"], f"<h3>{esc(short())}</h3>" + pick([paragraphs(few(1, 6)), "".join(f'<div class="comment"><p>{esc(x)}</p></div>' for x in few(1, 6)), "<ul>" + "".join(f"<li>{esc(x)}</li>" for x in few(1, 6)) + "</ul>"])),
        box(["newsletter", "subscribe"], ["form", "div"], f"<p>{esc(pick(other))}</p><input>"),
        ad(),
        box(["footer", "site-footer", "copyright"], ["footer", "div"], pick([f"&copy; {esc(short())} &middot; {esc(pick(other))}", links("", ""), f"<p>{esc(pick(other))}</p>"])),
    ]
    keep = lambda xs: [x for x in xs if rng.random() < 0.6]
    return f'<html><body>{"".join(keep(top))}{article}{"".join(keep(bottom))}</body></html>'


def _training_rows(batches: Iterator[pa.RecordBatch], containers: tuple = CONTAINERS) -> Iterator[pa.RecordBatch]:
    htmls = [h for b in batches for h in b.column(1).to_pylist()]
    if not htmls:
        return
    pages, rng = [Page(h) for h in htmls if h], random.Random(11)
    main, other = [], []
    for p in pages:
        y = p.labels()
        own = [said for node, said, _ in p.blocks if y[node] == 1]
        main.append(own or [said for _, said, _ in p.blocks])
        other += [said for node, said, _ in p.blocks if y[node] == 0]
    if not any(main):  # no text to set anew: words without a meaning
        word = lambda: "".join(rng.choice("aeiou") if i % 2 else rng.choice("bdfklmnprst") for i in range(rng.randint(2, 9)))
        main += [[" ".join(word() for _ in range(rng.randint(8, 60))) + "." for _ in range(4)] for _ in range(60)]
    prose = [x for m in main for x in m]
    # comments, notices and footers may well be prose, so they borrow sentences of other pages
    other = [x for x in other if x] + [". ".join(x.split(". ")[:3]) for x in prose[::3]]
    if other:
        for m in main:
            for _ in range(3):
                own = [x for x in m if x] or [rng.choice(other)]
                rng.shuffle(own)
                pages.append(Page(_layout(rng, own[: rng.randint(1, 12)], other, containers)))
    for p in pages:
        x, y = p.features()(0, len(p.tag)), p.labels()
        x, y = x[y >= 0], y[y >= 0]
        if len(y):
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y)], ["x", "label"])


class Trees:
    """Boosted trees as arrays; a row's score is the log-odds that a node is main text."""

    def __init__(self, model):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights):
            feature, threshold, left, right, value = [], [], [], [], []

            def add(node) -> int:
                at = len(feature)
                for column in (feature, threshold, left, right, value):
                    column.append(0)
                value[at] = node.prediction()
                left[at] = right[at] = at
                if node.subtreeDepth():
                    feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
                    left[at], right[at] = add(node.leftChild()), add(node.rightChild())
                return at

            root = tree._call_java("rootNode")
            add(root)
            self.trees.append((np.array(feature), np.array(threshold, float), np.array(left), np.array(right), 2 * weight * np.array(value), tree.depth))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            out += value[at]
        return out


def fit_trees(pages: DataFrame, sample: int = 250, rounds: int = 12, depth: int = 4, containers: tuple = CONTAINERS) -> Trees | None:
    """Trees fitted on ``sample`` pages, drawn by a hash of page_id; None if the table has no html."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    drawn = pages.where("html IS NOT NULL").select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(sample)
    rows = drawn.mapInArrow(partial(_training_rows, containers=containers), "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        return Trees(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=32, seed=3).fit(rows))
    finally:
        rows.unpersist()


#: Nodes that are scored at once.
_ROWS = 20_000


def main_texts(htmls: list[str | None], trees: Trees | None) -> list[str]:
    """The main text of each page; without trees there is none to find."""
    out: list[str] = []
    held: list[tuple[Page, np.ndarray]] = []

    def score() -> None:
        if held:
            logit = np.split(trees(np.concatenate([x for _, x in held])), np.cumsum([len(x) for _, x in held])[:-1])
            out.extend(p.decode(s) for (p, _), s in zip(held, logit))
            held.clear()

    for h in htmls:
        page = Page(h or "")
        n = len(page.tag)
        if trees is None:
            out.append("")
        elif n > _ROWS:  # a page of very many elements: piece by piece
            score()
            rows = page.features()
            out.append(page.decode(np.concatenate([trees(rows(a, a + _ROWS)) for a in range(0, n, _ROWS)])))
        else:
            held.append((page, page.features()(0, n)))
            if sum(len(x) for _, x in held) > _ROWS:
                score()
    score()
    return out


def html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Blocks of the main text are in page order, joined by a line feed; character references are decoded and
    white space inside a block (Unicode's, so no-break spaces too) is one space. Null, empty or text-free html
    gives an empty text. Pages without semantic containers teach nothing about their own nodes, but their text is
    set in layouts like any other; so there is a model even if no page is labelled. Rows are judged one by one:
    null or repeated ids don't matter. Other columns are ignored; an empty table gives none."""
    trees = fit_trees(pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = main_texts(b.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
