"""Token counts through a digest cache: digests of content and tokenizer version are joined to stored
counts, only distinct misses are encoded, and their counts are appended to the cache."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

_CACHE = "version string, digest binary, n_tokens long"
#: A worker's memo of pieces is emptied when it holds so many.
MEMO = 800_000
#: Bits of the filter of missing digests for each of them, and at most: 2^19 words of 64 bits, whatever is missing.
BITS_EACH, MOST_BITS = 16, 1 << 25
#: A worker process keeps its counters from task to task.
_counters: dict[str, Counter] = {}


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(name: str) -> str:
    """Digest of the vocabulary file and of the library's version: counts are stored under it."""
    import importlib.metadata

    library = "sentencepiece" if name.endswith(".model") else "tokenizers"
    with open(tokenizer_file(name), "rb") as f:
        return hashlib.sha256(f.read() + f"|{library} {importlib.metadata.version(library)}".encode()).hexdigest()


class Counter:
    """Counts tokens as the library does, without begin, end or added special tokens.

    For a byte-level vocabulary the library cuts a text into pieces by a fixed pattern and encodes each
    piece by itself, so counts of pieces add up and repeated pieces are looked up. A text that contains
    the string of an added token is cut otherwise and goes to the library whole.
    """

    def __init__(self, name: str):
        path = tokenizer_file(name)
        self.memo: dict[str, int] = {}
        self.pieces = None
        if name.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
            return
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.encode = lambda texts: [len(x) for x in t.encode_batch(texts, add_special_tokens=False)]
        if name.startswith("byte_bpe"):
            import public_tokenizers
            import regex

            self.pieces = regex.compile(public_tokenizers.PATTERN).findall
            self.special = [x.content for x in t.get_added_tokens_decoder().values()]

    def __call__(self, texts: list[str]) -> list[int]:
        if self.pieces is None:
            return self.encode(texts)
        out = []
        for text in texts:
            if any(s in text for s in self.special):
                out += self.encode([text])
                continue
            memo, new = self.memo, []
            pieces = self.pieces(text)
            n = 0
            for x in pieces:
                k = memo.get(x)
                if k is None:
                    new.append(x)
                else:
                    n += k
            if new:
                distinct = list(dict.fromkeys(new))
                found = dict(zip(distinct, self.encode(distinct)))
                n += sum(map(found.__getitem__, new))
                if len(memo) + len(found) > MEMO:
                    memo.clear()
                memo.update(list(found.items())[:MEMO])
            out.append(n)
        return out


def _encode(tokenizer: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            count = _counters.get(version) or _counters.setdefault(version, Counter(tokenizer))
            n = count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(n)), b.column(0).cast(pa.binary()), pa.array(n, pa.int64())], ["version", "digest", "n_tokens"]
            )

    return encode


def _likely(rows: DataFrame, lacking: DataFrame, bits: int) -> DataFrame:
    """The ``rows`` whose digest may be among the ``lacking``: all that are, and of the others a share that gets smaller
    with more bits. The filter is a bit for each hash of a digest, in words that are broadcast."""
    place = F.pmod(F.xxhash64("digest"), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(digest), {bits}L) % 64 AS INT))")
    words = lacking.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))
    return rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(words), "word").where(F.col("set").bitwiseAND(F.col("bit")) != 0)


def token_counts(docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of ``docs``.

    ``cache`` is a folder of Parquet files (version, digest, n_tokens) that all executors see; it is made
    if missing. Content is normalised only where counts cannot change by it: null becomes empty. Digests alone
    are compared with the cache; of the texts, only those move that a small filter of the missing digests lets pass where
    they are read, so a warm cache costs a scan however many misses there are. Rows of a repeated text are encoded once, whatever their number: one row a digest
    leaves each task before the shuffle. A run that dies before its files are committed leaves the cache as it was.

    Null text: 0 bytes, 0 tokens. Null or repeated doc_id: a row each. Other columns are ignored. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    # An empty first file makes the folder readable before anything is stored.
    spark.createDataFrame([], _CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(_CACHE).parquet(cache).where(F.col("version") == version)
    lacking = written(rows.select("digest").distinct().join(stored.select("digest"), "digest", "left_anti"), "token-counts-lacking")
    bits = min(MOST_BITS, 1 << max(10, (BITS_EACH * lacking.count()).bit_length()))
    misses = _likely(rows, lacking, bits).select("digest", "text").dropDuplicates(["digest"]).join(lacking, "digest", "left_semi")
    misses.mapInArrow(_encode(tokenizer, version), _CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(_CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Written: behind a plain read, Spark can split the join on a digest that very many rows have.
    counts = written(counts, "token-counts-now")
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return out.join(counts, "digest").select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def fresh_cache(docs: DataFrame) -> str:
    """A cache folder that nothing has been stored in."""
    return f"{shared_dir(docs.sparkSession)}/token-counts-{uuid.uuid4().hex}"
