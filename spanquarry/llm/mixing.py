"""Temperature mixing of sources and its realisation as budgeted block permutations."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanquarry.llm.shared import cut


def bisect_exponent(sizes: dict[str, float], entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent a in [0, 1] of weights ~ size ** a that meets the target.

    ``entropy``: the weights' entropy as a share of the largest possible (1: uniform); it falls as a grows.
    ``repeats``: the most times any source is read; the smallest such a. Without a ``budget`` it is the least one that
    reads every source once. A target that no exponent meets gives the nearest end.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give one of entropy and repeats")

    def above(a: float) -> bool:
        w = weights(sizes, a)
        if entropy is not None:
            spread = -sum(x * math.log(x) for x in w.values() if x > 0)
            return spread > entropy * math.log(max(len(w), 2))
        return max(epochs(sizes, w, budget).values(), default=0) > repeats

    low, high = 0.0, 1.0
    if not above(low):
        return low
    if above(high):
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) else (low, mid)
    return high


def weights(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Normalised size ** exponent; sources without tokens weigh nothing."""
    whole = sum(sizes.values())
    raised = {s: (n / whole) ** exponent if n > 0 else 0.0 for s, n in sizes.items()}
    total = sum(raised.values())
    return {s: x / total if total else 0.0 for s, x in raised.items()}


def epochs(sizes: dict[str, float], weight: dict[str, float], budget: float | None = None) -> dict[str, float]:
    """How often each source is read to give its weight of the budget."""
    used = [s for s in sizes if sizes[s] > 0]
    if budget is None:
        budget = max((sizes[s] / weight[s] for s in used), default=0.0)
    return {s: weight[s] * budget / sizes[s] for s in used}


def mix(docs: DataFrame, tokens: Column, source: str = "source", key: str = "doc_id", entropy: float | None = None, repeats: float | None = None,
        budget: float | None = None, block: int = 4096, seed: int = 17, max_sources: int = 100_000, prefix: str = "") -> DataFrame:
    """Rows of ``docs`` as often as the mixture reads them, with ``epoch``, ``block`` and ``rank`` in the block (from 0), and
    ``epochs`` of the source; ``prefix`` stands before these four names.

    Token counts are summed per source (one row a source reaches the driver, at most ``max_sources``), the exponent is
    bisected, and every source gets its share of the budget. Each epoch of a source is a permutation: rows are
    dealt to blocks of about ``block`` rows by a hash of epoch and key, blocks follow each other, rows follow their
    hash within. All rows are read in the whole epochs; of the last, partial one those whose tokens before them stay
    below the rest of the budget. Positions are sums per block plus sums within a
    block, so no source, however large, is put in order by one task.

    Defined results: null sources form a source of their own; null or negative token counts are 0; rows of a source
    without tokens are read once; rows that share source and key are read equally often, at the same
    ranks. A column of ``docs`` that has one of the four names gives way to the mixture's; a prefix keeps both.
    """
    added = ("epoch", "block", "rank", "epochs")
    name = F.coalesce(F.col(source).cast("string"), F.lit("\0null"))
    slim = cut(docs.select(name.alias("__source"), F.col(key).alias("__key"), F.greatest(F.coalesce(tokens.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("__tokens"))
               .groupBy("__source", "__key").agg(F.sum("__tokens").alias("__tokens"), F.count(F.lit(1)).alias("__rows")))
    counted = slim.groupBy("__source").agg(F.sum("__tokens").alias("tokens"), F.sum("__rows").alias("rows")).limit(max_sources + 1).collect()
    if len(counted) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r["__source"]: r["tokens"] for r in sorted(counted, key=lambda r: r["__source"])}
    often = epochs(sizes, weights(sizes, bisect_exponent(sizes, entropy, repeats, budget)), budget)
    often |= {s: 1.0 for s, n in sizes.items() if n <= 0}
    blocks = {r["__source"]: max(1, r["rows"] // block) for r in counted}
    plan = docs.sparkSession.createDataFrame([(s, float(x), int(x + 1e-9), max(0.0, x - int(x + 1e-9)) * sizes[s], blocks[s]) for s, x in often.items()],
                                             "__source string, epochs double, __whole int, __rest double, __blocks long")
    last = F.when(F.col("__rest") > 0, F.col("__whole")).otherwise(F.col("__whole") - 1)
    dealt = (slim.join(F.broadcast(plan.where("__whole > 0 or __rest > 0")), "__source")  # one row a source, at most max_sources
             .withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
             .withColumn("__hash", F.xxhash64(F.lit(seed), F.col("epoch"), F.col("__key")))
             .withColumn("block", F.pmod(F.col("__hash"), F.col("__blocks"))))
    partial = dealt.where(F.col("epoch") == F.col("__whole"))
    sums = partial.groupBy("__source", "epoch", "block").agg(F.sum("__tokens").alias("__sum"))
    order = Window.partitionBy("__source").orderBy("block")  # one row per some thousand documents
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("__sum")
    inside = Window.partitionBy("__source", "epoch", "block").orderBy("__hash", "__key")
    ahead = F.coalesce(F.sum("__tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = (dealt.withColumns({"rank": F.row_number().over(inside) - 1, "__ahead": ahead})
              .join(before, ["__source", "epoch", "block"], "left")
              .where((F.col("epoch") < F.col("__whole")) | (F.col("__before") + F.col("__ahead") < F.col("__rest")))
              .select("__source", "__key", *[F.col(c).alias(f"__placed_{c}") for c in added]))
    read = docs.withColumn("__name", name).join(placed, (F.col("__name") == F.col("__source")) & F.col(key).eqNullSafe(F.col("__key")))
    own = [c for c in docs.columns if c not in [prefix + x for x in added]]
    return read.select(*own, *[F.col(f"__placed_{c}").alias(prefix + c) for c in added])


def words(text: str = "text") -> Column:
    """A stand-in for a token count: blanks and line ends plus one; 0 for null and empty texts.

    Indented text counts once a blank and text without spaces counts 1.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    blanks = 2 * F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", 0).otherwise(blanks + 1).cast("long")


def report(docs: DataFrame, repeats: float = 2.0) -> DataFrame:
    """``doc_id, source, n_words, copies, epochs, places`` (epoch, block and rank of each copy) of every document that the mixture reads."""
    slim = cut(docs.select("doc_id", "source", words().alias("n_words")))
    mixed = mix(slim, F.col("n_words"), repeats=repeats)
    return mixed.groupBy("doc_id", "source", "n_words").agg(F.count(F.lit(1)).alias("copies"), F.round(F.max("epochs"), 9).alias("epochs"),
                                                            F.array_sort(F.collect_list(F.struct("epoch", "block", "rank"))).alias("places"))
