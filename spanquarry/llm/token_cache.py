"""Token counts of whole texts through an appended table of counts, keyed by digests of content and tokenizer."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanquarry.llm.shared import cut, folder

_SCHEMA = "content binary, n_tokens long, tokenizer string"
_SLICE = 1 << 20  # characters encoded at once


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def version(path: str) -> str:
    """Digest of all that a count depends on beside the text: the vocabulary file and the library with its version."""
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    with open(path, "rb") as f:
        return sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """The text as far as the tokenizer tells texts apart; null counts as empty.

    A sentencepiece model that only writes blanks as U+2581 takes that character and a blank for the same. Every other
    tokenizer gets the text unchanged.
    """
    text = F.coalesce(text, F.lit(""))
    if path.endswith(".model"):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto.FromString(open(path, "rb").read()).normalizer_spec
        if spec.escape_whitespaces and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces:
            return F.replace(text, F.lit("▁"), F.lit(" "))
    return text


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by the library that the file is for: no added tokens, truncation or padding; loaded once a worker."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        return lambda texts: [len(x.ids) for x in found.encode_batch_fast(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in pieces.encode(texts, add_bos=False, add_eos=False, num_threads=1)]


def _slices(texts: pd.Series) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def opened(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """``content, n_tokens`` that ``cache`` holds for a tokenizer, one row a content; a cache that is not there is begun.

    Two writers may both have appended a content; their counts are equal.
    """
    spark.createDataFrame([], _SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
    rows = spark.read.schema(_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, cache: str, path: str, text: str = "text") -> None:
    """Encode each distinct content of ``docs`` that ``cache`` lacks once, and append the counts in one commit.

    Copies fold before the shuffle, so a content that a third of all rows share is sent once a task; only distinct
    texts are shuffled. A run that fails before its commit appends nothing.
    """
    tokenizer, plain = version(path), normalised(F.col(text), path)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in batches:
            yield pd.Series([n for some in _slices(texts) for n in count(some)], dtype="int64")

    distinct = docs.select(plain.alias("text")).groupBy(F.unhex(F.sha2("text", 256)).alias("content")).agg(F.first("text").alias("text"))
    misses = distinct.join(opened(docs.sparkSession, cache, tokenizer), "content", "left_anti")
    misses.select("content", counted("text").alias("n_tokens"), F.lit(tokenizer).alias("tokenizer")).write.mode("append").partitionBy("tokenizer").parquet(cache)


def with_counts(docs: DataFrame, cache: str, path: str | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with ``out``, the tokens of every whole text, from ``cache`` after it was filled.

    Defined results: a null text has the count of an empty one (0), equal texts are encoded once and every row of
    them has its count, other columns pass through (``out`` replaces one of its name), an empty table stays empty.
    The join shuffles digests, not texts; both its sides are tables, so a hot content is split as a skewed key.
    """
    path = path or default_path()
    fill(docs, cache, path, text)
    counts = cut(opened(docs.sparkSession, cache, version(path)).select(F.col("content").alias("__content"), F.col("n_tokens").alias("__n")))
    keyed = docs.withColumn("__content", F.unhex(F.sha2(normalised(F.col(text), path), 256)))
    return keyed.join(counts, "__content", "left").withColumn(out, F.col("__n")).drop("__content", "__n")


def report(docs: DataFrame, cache: str | None = None, path: str | None = None, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document; without ``cache`` a new one in the shared folder."""
    slim = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = with_counts(slim, cache or folder(docs.sparkSession, "token-counts"), path)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
