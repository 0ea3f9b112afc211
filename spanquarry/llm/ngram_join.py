"""Documents whose word n-gram sets have a high Jaccard likeness, by a blocked product of the incidence matrix.

Rows are distinct n-gram sets, columns n-grams. Columns are cut by hash in so many blocks that, by the size-derived
bound on the symmetric difference, two linked rows must agree in a number of whole blocks. Blocks that a row shares are
counted first: a row that shares fewer than it needs for any link leaves the product, any other leaves out the most
frequent blocks it can spare. On the blocks that stay rows meet in a join, pairs outside the size bounds are discarded,
and the overlap of the pairs that are left is counted in full.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanquarry.llm.shared import by_text, components, cut, frugal, scratch, slices, small_batches

_BITS = 1024  # of the parity signature
_GROWTH = 1.5  # size classes
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def gram_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word n-grams; A-Z in lower case, words parted by ASCII space.

    A text with fewer words is one n-gram of all its words; a null or blank text has none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    grams = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        grams = _mix(grams + h[i:len(h) - n + 1 + i])
    return np.unique(grams)


def _size_class(n: int) -> int:
    j = max(0, int(np.log(max(n, 1)) / np.log(_GROWTH)))
    while _low(j + 1) <= n:
        j += 1
    while j and _low(j) > n:
        j -= 1
    return j


@lru_cache(maxsize=256)
def _low(j: int) -> int:
    return j + 1 if j < 4 else int(np.ceil(_GROWTH**j))


@lru_cache(maxsize=256)
def _blocks(j: int, share: int, whole: int) -> int:
    """Column blocks of size class j: more than two linked rows can differ in, the smaller of which is of the class."""
    small = _low(j + 1) - 1
    d = (small + small * whole // share) * (whole - share) // (whole + share)
    return d + 2 + d // 4


def block_keys(grams: np.ndarray, share: int, whole: int) -> tuple[np.ndarray, int, list[int]]:
    """Keys of the row's column blocks, its lowest size class, and for that class and each further one the blocks needed.

    A row takes part in its own class and in any lower one it can link into; the low byte of a key is the class. Linked
    rows a, b differ in at most (|a| + |b|)(whole - share)/(whole + share) n-grams and so in no more blocks: a row agrees
    with whatever it links to in at least its filled blocks less that number. A row with too few filled blocks for this
    is joined on its empty ones as well, and needs one.
    """
    n, keys, needs = len(grams), [], []
    if not n:
        return np.zeros(0, np.uint64), 0, []
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(grams), dtype=np.uint64)])
    low, own = _size_class(-(-n * share // whole)), _size_class(n)
    for j in range(low, own + 1):
        parts = _blocks(j, share, whole)
        partner = n * whole // share if j == own else _low(j + 1) - 1
        place = ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(place, np.arange(parts + 1))
        sums, kept = total[edges[1:]] - total[edges[:-1]], np.flatnonzero(np.diff(edges))
        need = len(kept) - (n + partner) * (whole - share) // (whole + share)
        if need < 1:
            kept, need = np.arange(parts), 1
        hashed = _mix(sums[kept] + _mix(kept.astype(np.uint64) + np.uint64(j << 40)))
        keys.append(hashed & ~np.uint64(255) | np.uint64(j))
        needs.append(need)
    return np.concatenate(keys), low, needs


def _parity(grams: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the n-grams in each of ``bits`` cells, 64 cells a number."""
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities in _BITS cells, and for larger sets in as many cells as the next power of two has."""
    bits = 1 << max(len(grams) - 1, 1).bit_length()
    return _parity(grams, _BITS), _parity(grams, bits) if bits > _BITS else np.zeros(0, np.int64)


def _may_link(na: str, nb: str, sa: str, sb: str, share: int, whole: int) -> Column:
    """The size bounds: of the sizes themselves, and of cells whose parity differs, never more than the difference."""
    a, b = F.col(na), F.col(nb)
    apart = reduce(add, (F.bit_count(F.get(F.col(sa), i).bitwiseXOR(F.get(F.col(sb), i))) for i in range(_BITS // 64)))
    return (a * whole >= b * share) & (b * whole >= a * share) & (apart * (whole + share) <= (a + b) * (whole - share))


def _may_link_wide(na: str, nb: str, wa: str, wb: str, share: int, whole: int) -> Column:
    """The parity bound on the wide signatures; the longer is folded to the shorter, whose cells are sums of its own."""
    least = F.least(F.size(wa), F.size(wb))
    fold = lambda c: F.when(F.size(c) == least * 2, F.zip_with(F.slice(c, F.lit(1), least), F.slice(c, least + 1, least), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(fold(wa), fold(wb), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = apart * (whole + share) <= (F.col(na) + F.col(nb)) * (whole - share)
    return (least == 0) | (F.greatest(F.size(wa), F.size(wb)) > least * 2) | near


def _per_text(docs: DataFrame, row, schema: str) -> DataFrame:
    """``doc_id`` and the columns of ``schema`` that ``row`` makes of each whole text."""
    names = [c.split()[0] for c in schema.split(", ")]

    @frugal
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            out = [row(text) for text in b["text"]]
            if out:
                yield pd.DataFrame({"doc_id": b["doc_id"], **{c: [r[i] for r in out] for i, c in enumerate(names)}})

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # a null would make the batch's ids floats
    return named.mapInPandas(rows, f"doc_id string, {schema}").withColumn("doc_id", F.col("doc_id").cast("long"))


def incidence(docs: DataFrame, width: int, share: int, whole: int) -> DataFrame:
    """``doc_id, n, set_key, signature, wide, low, needs`` of every document, from its whole text."""

    def row(text):
        g = gram_set(text, width)
        return len(g), xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None, *_signatures(g), *block_keys(g, share, whole)[1:]

    return _per_text(docs, row, "n long, set_key binary, signature array<long>, wide array<long>, low long, needs array<long>")


def blocked(docs: DataFrame, width: int, share: int, whole: int) -> DataFrame:
    """``doc_id, key`` for every column block that a document is joined on."""
    keys = _per_text(docs, lambda text: (block_keys(gram_set(text, width), share, whole)[0].view(np.int64),), "keys array<long>")
    return keys.where("doc_id is not null").select("doc_id", F.explode("keys").alias("key"))


def _needed(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the blocks ``key, c`` those that the row c has to be joined on, with the least row of each as its pivot.

    Two linked rows share at least as many blocks of a class as either needs. Let both leave out, of the blocks in the
    order of their frequency, one less than they need from the frequent end: the rarest block they share stays in both.
    """
    same, row = Window.partitionBy("key"), Window.partitionBy("c", "j")
    counted = shared.withColumn("rows", F.count("*").over(same)).where("rows > 1").withColumn("j", F.col("key").bitwiseAND(255))
    ranked = counted.join(rows.select("c", "low", "needs"), "c").withColumn("rank", F.row_number().over(row.orderBy(F.desc("rows"), "key")))
    kept = ranked.where(F.col("rank") >= F.get("needs", (F.col("j") - F.col("low")).cast("int"))).select("key", "c")
    return kept.withColumns({"pivot": F.min("c").over(same), "top": F.max("c").over(same)}).where("pivot < top").drop("top")


def _linked(pairs: DataFrame, texts: DataFrame, width: int, share: int, whole: int) -> DataFrame:
    """Of the pairs ``a, b`` those whose overlap, counted in full, reaches the threshold."""

    @F.pandas_udf("boolean")
    @frugal
    def overlaps(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held = ("", gram_set("", width))
        for ta, tb in batches:
            out = []
            for x, y in zip(ta, tb):
                if held[0] != x:
                    held = (x, gram_set(x, width))
                g = gram_set(y, width)
                both = len(np.intersect1d(held[1], g, assume_unique=True))
                out.append(whole * both >= share * (len(held[1]) + len(g) - both))
            yield pd.Series(out, dtype=bool)

    return (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .where(overlaps("ta", "tb")).select("a", "b"))


def jaccard_components(docs: DataFrame, width: int = 5, share: int = 80, whole: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document: components of Jaccard >= share/whole.

    Equal sets are one row of the matrix, joined on the blocks of :func:`_needed`. In every block the least row is the
    pivot: all rows of the block are first compared with it alone, which joins a group of copies in as many pairs as it has rows. Only rows of one block that
    are still in different components are then compared with each other, so no link between different texts is lost.

    Defined results: null and blank texts have no n-grams and stand alone; a text of fewer words than ``width`` is one
    n-gram; rows of one doc_id are one node, linked by what any of their texts links to, also where the texts differ;
    rows without a doc_id are listed with a null component. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    named, split = by_text(docs.select("doc_id", "text"))
    found = _components(named.select(F.col("__node").alias("doc_id"), "text"), width, share, whole, split)
    if split is None:
        return found
    # every text of a split id is a node below all ids: a component is named after the least id of its rows
    of_node = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__node")).agg(F.first("n_shingles").alias("n_shingles"), F.first("component_id").alias("g"))
    rows = cut(named.select("doc_id", "__node").join(of_node, "__node"))
    least = rows.groupBy("g").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "g").select("doc_id", "n_shingles", "component_id").unionByName(found.where("doc_id is null"))


def _components(docs: DataFrame, width: int, share: int, whole: int, split: DataFrame | None) -> DataFrame:
    """As :func:`jaccard_components` for ids that have one text each; the nodes ``split`` from one id are linked as well."""
    with scratch(docs.sparkSession):
        base = cut(incidence(docs, width, share, whole))
        classes = base.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("c"))
        of_doc = base.select("doc_id", "n", "set_key")
        # one shuffle of slim rows; a key has one row a document, so even a group of copies of a third of all rows is spread
        # over the many keys that each of its documents has
        same = Window.partitionBy("key")
        met = blocked(docs, width, share, whole).select("key", "doc_id", F.min("doc_id").over(same).alias("low"), F.max("doc_id").over(same).alias("high"))
        class_of = of_doc.join(classes, "set_key").select("doc_id", "c").dropDuplicates(["doc_id"])
        rows = base.join(classes.select(F.col("c").alias("doc_id"), "set_key"), ["doc_id", "set_key"]).dropDuplicates(["doc_id"])
        rows = rows.withColumnRenamed("doc_id", "c")
        with scratch(docs.sparkSession):
            met = cut(met.where("low < high").select("key", "doc_id"))
            blocks = cut(_needed(met.join(class_of, "doc_id").select("key", "c").distinct(), rows), keep=True)
        rows = cut(rows.select("c", "n", "signature", "wide").join(blocks.select("c").distinct(), "c"))
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
        of = lambda side: rows.toDF(side, f"n{side}", f"s{side}", f"w{side}")
        may, wide = _may_link("na", "nb", "sa", "sb", share, whole), _may_link_wide("na", "nb", "wa", "wb", share, whole)
        narrowed = lambda pairs: cut(pairs.join(of("a"), "a").join(of("b"), "b").where(may & wide).select("a", "b"))
        starred = blocks.where("c != pivot").select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct()
        first = _linked(narrowed(starred), texts, width, share, whole)
        if split is not None:
            star = split.join(split.groupBy("__doc").agg(F.min("__node").alias("a")), "__doc").select("a", F.col("__node").alias("doc_id"))
            named = class_of.join(star, "doc_id", "right").select(F.col("a").alias("doc_id"), F.coalesce("c", "doc_id").alias("b"))
            first = first.unionAll(class_of.join(named, "doc_id", "right").select(F.coalesce("c", "doc_id").alias("a"), "b"))
        first = cut(first)
        found = components(first)
        grouped = blocks.select("key", "c").join(found.toDF("c", "g"), "c", "left").select("key", "c", F.coalesce("g", "c").alias("g"))
        several = grouped.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("key")
        still = cut(grouped.join(several, "key").join(rows.drop("wide"), "c"))
        if not still.isEmpty():
            x = still.select("key", F.col("c").alias("a"), F.col("g").alias("ga"), F.col("n").alias("na"), F.col("signature").alias("sa"))
            y = still.select("key", F.col("c").alias("b"), F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
            crossed = x.join(y, (x["key"] == y["key"]) & (F.col("ga") < F.col("gb")) & may)
            more = crossed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            found = components(first.unionAll(_linked(narrowed(more), texts, width, share, whole)))
        labelled = (of_doc.join(classes, "set_key", "left").withColumn("c", F.coalesce("c", F.when(F.col("set_key").isNull(), F.col("doc_id"))))
                .join(found.toDF("c", "g"), "c", "left")
                .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("g", "c")).alias("component_id")))
        return cut(labelled, keep=True)
