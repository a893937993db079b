"""Language identification by rank-order profiles: a document's most frequent character n-grams are
compared with each language's profile by out-of-place distance."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, unpacked, written

UNKNOWN = "und"
_CHUNK = 1 << 20
_not_letters = re.compile(r"[\W\d_]+")
#: Characters of words that are neither letters, decimal digits nor underscores: number signs of other kinds.
_SIGNS = {c: " " for c in range(0x80, sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha()}
_is_sign = np.zeros(sys.maxunicode + 1, bool)
_is_sign[list(_SIGNS)] = True


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys and counts of all 1- to 3-grams of the letters of a whole text; None without letters.

    Case is folded and every run of characters that aren't letters (Unicode category L) is one space, as are the
    text's ends. A key holds 21 bits a character."""
    found = []
    tail = " "  # the last characters of what has been read
    for at in range(0, len(text or ""), _CHUNK):  # memory stays small on a very long text
        part = text[at : at + _CHUNK].lower()
        if not part.isascii():
            part = part.replace("\u03c2", "\u03c3")  # a final sigma depends on what follows
            if _is_sign[_codes(part)].any():
                part = part.translate(_SIGNS)
        part = _not_letters.sub(" ", part)
        part = tail + (part[1:] if tail[-1] == part[0] == " " else part)
        if at + _CHUNK >= len(text) and part[-1] != " ":
            part += " "
        own = len(tail)  # characters seen in the chunk before
        tail = part[-2:]
        c = _codes(part).astype(np.int64)
        two = (c[:-1] << 21) | c[1:]
        three = (two[:-1] << 21) | c[2:]
        one = c[own:]
        found.append(np.unique(np.concatenate([one[one != 32], two[max(0, own - 1) :], three[max(0, own - 2) :]]), return_counts=True))
    if not found:
        return None
    if len(found) == 1:
        keys, n = found[0]
    else:
        keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([x for _, x in found])).astype(np.int64)
    return (keys, n) if len(keys) and np.any((keys < 1 << 21) & (keys != 32)) else None


def ranked(keys: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, most frequent first; ties by key."""
    if len(keys) > 4 * size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keys, n = keys[n >= least], n[n >= least]
    return keys[np.lexsort((keys, -n))][:size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (g := grams(text)) is not None:
                by.setdefault(lang, []).append(g)
        for lang, found in by.items():
            keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([x for _, x in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])


def held_out(doc_id: Column) -> Column:
    """Documents that no profile may learn from: crc32 of the id as text is 1 modulo 3. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_profiles(docs: DataFrame, size: int = 300, docs_per_language: int = 2000) -> dict[str, np.ndarray]:
    """A profile of the ``size`` most frequent n-grams for each non-null ``lang``.

    Learned from a sample of the documents that aren't held out: whole texts, drawn by a hash of doc_id so
    that about ``docs_per_language`` of a language take part (all, if it has fewer)."""
    train = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    train = train.select("doc_id", "lang", "text")
    # A row a label; every task holds a profile a label anyway. Texts are drawn where they are read.
    sizes = train.groupBy("lang").count().collect()
    share = docs.sparkSession.createDataFrame([(r.lang, docs_per_language / r["count"]) for r in sizes], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    sample = train.join(F.broadcast(share), "lang").where(drawn).select("lang", "text")
    counts = written(sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).collect()  # languages times size
    profiles: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        profiles.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(keys, np.int64) for lang, keys in profiles.items()}


class Model:
    """Out-of-place distance to each profile."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.langs, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([profiles[x] for x in self.langs])) if profiles else np.empty(0, np.int64)
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        for j, x in enumerate(self.langs):
            self.rank[np.searchsorted(self.keys, profiles[x]), j] = np.arange(len(profiles[x]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        g = grams(text)
        if g is None or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(*g, self.size)
        at = np.searchsorted(self.keys, own)
        at[at < len(self.keys)] = np.where(self.keys[at[at < len(self.keys)]] == own[at < len(self.keys)], at[at < len(self.keys)], len(self.keys))
        rank = self.rank[at]
        far = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(far.argmin())  # ties: the first by name
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def predict_languages(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 300) -> DataFrame:
    """(doc, judged): each row of ``docs`` packed, and the language (lang) of its whole text with a score from 0 to 1.

    ``und`` and 0 where the text is null or has no letter, or no language was learned. Ties go to the
    language first by name. Rows are judged one by one, so nulls elsewhere and repeated rows don't matter."""
    model = Model(profiles, size)

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model(t) for t in texts], columns=["lang", "score"])

    return packed(docs).withColumn("judged", judge(F.col("doc.text")))


def language_id(docs: DataFrame, size: int = 300, docs_per_language: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document. Learns from ``text`` and ``lang`` of the
    documents that aren't held out; see :func:`fit_profiles` and :func:`predict_languages` for the cases."""
    profiles = fit_profiles(docs, size, docs_per_language)
    out = predict_languages(docs.select("doc_id", "text"), profiles, size)
    doc_id = F.col("doc.doc_id")
    return out.select(doc_id.cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("judged.lang").alias("lang_pred"), F.col("judged.score").alias("score"))


def keep_known(docs: DataFrame, size: int = 300, docs_per_language: int = 2000) -> DataFrame:
    """The documents that have a language, in their own columns: those without a letter are rejected. Where no
    language can be learned, documents with letters stay."""
    profiles = fit_profiles(docs, size, docs_per_language)
    judged = predict_languages(docs, profiles, size)
    known = F.col("judged.lang") != UNKNOWN
    return unpacked(judged.where(known if profiles else F.coalesce(F.col("doc.text").rlike(r"\p{L}"), F.lit(False))), docs)
