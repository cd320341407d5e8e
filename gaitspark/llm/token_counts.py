"""Operator 2: token counts with a digest cache.

Texts become digests; the cache, a Parquet table keyed by content and tokenizer digest, answers those it knows. Only
distinct misses are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .bpe_automaton import WORDS, byte_letters
from .common import BROADCAST_IDS, arrow_map, batch, pick, slices, table, utf8_size

CACHE = "content string, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the libraries that may count its tokens."""
    import sentencepiece
    import tiktoken
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{tokenizers.__version__}|{sentencepiece.__version__}|{tiktoken.__version__}".encode()).hexdigest()


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts as the library of the vocabulary gives them.

    A byte-level BPE whose ids are in the order of its merges is the same vocabulary for both BPE libraries at hand, and
    the one that takes ranks is five times faster; others go to the library that reads the file.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if ranked := ranks(path):
        import tiktoken

        tokens, special = ranked
        fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=tokens, special_tokens=special)
        return lambda texts: [len(fast.encode(t, allowed_special="all", disallowed_special=())) for t in texts]
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(path)
    plain.no_truncation()
    plain.no_padding()
    return lambda texts: [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The file's byte strings by rank and its special tokens, if it is a plain byte-level BPE in order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or split != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or model.get("ignore_merges"):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab, letters = model["vocab"], byte_letters()
    made = [vocab[a + b] for a, b in merges]
    if made != list(range(256, 256 + len(made))) or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
        return None
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    return {bytes(letters[c] for c in s): i for s, i in vocab.items() if s not in special}, special


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, one row a key; an absent one is empty."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, content, n_bytes, n_tokens, over_limit) for each row of docs; appends to the cache at the path `cache`.

    Content is normalised to a null text being an empty one, and nothing else, for any other change would change the
    counts. Equal texts are encoded once in a run; rows that repeat each get a row; an empty table adds nothing. Only the
    id and text are read. Partial aggregation leaves a text once a task before the shuffle, so many copies of one text
    don't meet in one task. Writers may race: the cache may get a key twice, with the same count, and is read by key.
    """
    spark = docs.sparkSession
    version = tokenizer_version(vocabulary)
    slim = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = slim.withColumn("content", F.sha2("text", 256))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("content")
    # digests meet the cache, not texts: with few misses, only their texts are moved
    unknown = materialize(keyed.select("content").distinct().join(known, "content", "left_anti"), "token-misses")
    few = unknown.count() <= BROADCAST_IDS
    texts = keyed.join(F.broadcast(unknown), "content") if few else keyed
    distinct = texts.groupBy("content").agg(F.first("text").alias("text"))
    distinct = distinct if few else distinct.join(unknown, "content")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = counter(vocabulary)
        for b in slices(batches, 1):
            yield batch(content=b.column(0), n_tokens=pa.array(run(b.column(1).to_pylist()), pa.int64()))

    misses = arrow_map(distinct, count, "content string, n_tokens long")
    misses.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # a table, so that the join may split the rows of one text
    counts = materialize(read_cache(spark, cache).where(F.col("tokenizer") == version).select("content", "n_tokens"), "token-counts")
    out = keyed.select("id", "content", utf8_size(F.col("text")).alias("n_bytes")).join(counts, "content")
    return out.select(F.col("id").alias(id_col), "content", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; the cache is new, so that each run is whole."""
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
