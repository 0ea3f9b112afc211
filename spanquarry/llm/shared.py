"""Lineage cuts, ids of distinct texts and connected components used by several operators."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for a local session that names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)  # the setting itself is fixed once a session runs
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path for a written table below the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside the block are deleted at its end; what is read later is cut with ``keep`` (or outside).

    A kept table is written in full by then, so later jobs need none of those it was made from.
    """
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read from there.

    Later jobs, also those that repeat tasks of a lost executor, start from these files. They go at the end of the
    innermost :func:`scratch` block, with ``keep`` of the one around it; without a block they stay as long as the shared
    folder does.
    """
    path = folder(df.sparkSession, "llm-table")
    if len(scopes := _scopes.get()) > keep:
        scopes[-1 - keep].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Hand Python workers batches of at most ``size`` bytes, in all later queries of the session (64 MB by default).

    Texts are long: executors otherwise hold a large batch for every task, in the JVM and in the worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "67108864").rstrip("b")) > size:
        spark.conf.set(name, str(size))


def slices(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """The batches in pieces of few rows, so that a Python worker holds little beside the batch it was given."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.iloc[lo:lo + rows]


def frugal(f: Callable) -> Callable:
    """An iterator function of a Python worker that gives memory back to the system when its task ends.

    Workers are kept for later tasks, several for every core; what their allocators hold on to would count against the
    executor while other stages run.
    """

    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def by_text(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``__node``, a number that rows share only if they share doc_id and text, and the numbers of split ids.

    An id with one text is its own number. Where an id has several, each of its texts gets a number below all ids; the
    second result lists them as ``__doc, __node`` (None if no id is split). Two hashes an id are compared, no texts.
    """
    h = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    keyed = docs.select(F.col("doc_id").alias("__doc"), h.alias("__h")).where("__doc is not null")
    several = cut(keyed.groupBy("__doc").agg(F.min("__h").alias("low"), F.max("__h").alias("high")).where("low < high").select("__doc"))
    if several.isEmpty():
        return docs.withColumn("__node", F.col("doc_id").cast("long")), None
    least = min(0, docs.agg(F.min("doc_id")).first()[0])
    split = cut(keyed.join(several, "__doc").distinct().withColumn("__node", F.lit(least) - 1 - F.monotonically_increasing_id()))
    named = docs.withColumns({"__doc": F.col("doc_id"), "__h": h}).join(split, ["__doc", "__h"], "left")
    return named.withColumn("__node", F.coalesce("__node", F.col("doc_id").cast("long"))).drop("__doc", "__h"), split.drop("__h")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an undirected graph given as ``(a, b)`` long pairs; component is the smallest node.

    Each round lets every node take the node of least salted hash within two steps, contracts the graph to the taken
    nodes and drops loops and repeats: a star of any size is one node after a round, a chain loses a constant factor.
    Nodes, edges and labels stay distributed; a star centre only takes part in minima that combine before the shuffle
    and in joins on distinct keys. Null ends are dropped. An empty input gives an empty result.
    """
    with scratch(edges.sparkSession):
        edges = cut(edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
        rank = lambda c, salt: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("id"))
        rounds: list[DataFrame] = []
        while not edges.isEmpty():
            both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            salt = len(rounds)
            near = both.groupBy("a").agg(F.least(F.min(rank("b", salt)), F.first(rank("a", salt))).alias("near"))
            two = both.join(near.toDF("b", "near"), "b").groupBy("a").agg(F.min("near")["id"].alias("to"))
            taken = cut(two)
            left, right = taken.toDF("a", "a2"), taken.toDF("b", "b2")
            edges = cut(
                edges.join(left, "a").join(right, "b").where("a2 != b2")
                .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
            rounds.append(taken)
        labels = (rounds[0] if rounds else edges).toDF("node", "root")
        for step in rounds[1:]:
            labels = labels.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        labels = cut(labels, keep=True)
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
