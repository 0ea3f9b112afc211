"""Order MinHash fingerprints of whole texts, with built-in functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanquarry.llm.shared import cut

#: A sketch entry is one 64-bit number: 33 bits of hash above 30 bits of position, so that plain number order sorts it.
_POS = 30
_HASH = (1 << 33) - 1
_PLACE = (1 << _POS) - 1
#: Words end at white space; scripts that write without it have a word a character.
_PARTED = r"\s+|(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])(?=\S)"


def _pack(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(F.lit(_HASH)), _POS).bitwiseOR(place.cast("long"))


def _range(n: Column) -> Column:
    """0 .. n-1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def order_minhash(df: DataFrame, text: str, out: str, k: int = 3, ell: int = 2, lanes: int = 32) -> DataFrame:
    """Add ``out``: array<int> of ``lanes`` order-sensitive minima of the text's word k-mers.

    A text's words are its runs of non-space characters, or the single characters of scripts without spaces. Every k-mer of words is numbered by its occurrence (first,
    second, ...), and each (k-mer, number) is hashed. The hash picks one of ``lanes`` equal lanes and the rank within
    it (one permutation cut in lanes). Of every lane the ``ell`` least entries are selected, put back into the order in
    which they stand in the text, and hashed as a tuple. Two texts agree in a lane if they share the selected
    k-mers *and* their order, so moving text around lowers the likeness as an edit does.

    Defined results: null and blank texts have no k-mers, every lane is null; a text of fewer than k words is one
    k-mer; a lane with fewer than ``ell`` entries hashes those it has; a lane without any is null. Equal texts give
    equal arrays. Work is linear in the text but for two sorts of plain numbers.
    """
    if not 1 <= ell <= 2 or lanes < 1 or lanes & (lanes - 1) or lanes > 1 << 16:
        raise ValueError("ell must be 1 or 2, lanes a power of two")
    w, g, s, r, o, p = (f"__{out}_{x}" for x in "wgsrop")
    lane_bits = lanes.bit_length() - 1
    lane = lambda x: F.shiftrightunsigned(x, _POS + 33 - lane_bits)
    key = lambda x: F.shiftrightunsigned(x, _POS)
    at = lambda arr, i: F.get(F.col(arr), i)
    size = lambda arr: F.size(F.col(arr))
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    df = df.withColumn(w, F.when(trimmed != "", F.split(trimmed, _PARTED)).otherwise(F.array().cast("array<string>")))
    whole = F.array(F.shiftleft(F.xxhash64(F.array_join(F.col(w), " ")).bitwiseAND(F.lit(_HASH)), _POS))
    df = df.withColumn(g, F.sort_array(
        F.when(size(w) >= k, F.transform(_range(size(w) - (k - 1)), lambda i: _pack(F.xxhash64(*[at(w, i + j) for j in range(k)]), i)))
        .when(size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))))
    # equal k-mers stand together, in text order: where a run of them starts, and the number within the run
    df = df.withColumn(s, F.filter(_range(size(g)), lambda i: (i == 0) | (key(at(g, i)) != key(at(g, i - 1)))))
    numbered = lambda x, n: F.coalesce(_pack(F.xxhash64(key(x), n), x.bitwiseAND(F.lit(_PLACE))), F.lit(0).cast("long"))
    df = df.withColumn(r, F.sort_array(
        F.when(size(s) == size(g), F.transform(F.col(g), lambda x: numbered(x, F.lit(0))))
        .otherwise(F.flatten(F.transform(F.col(s), lambda start, i: F.when(
            F.coalesce(at(s, i + 1), size(g)) - start == 1, F.array(numbered(at(g, start), F.lit(0)))).otherwise(F.transform(
                F.slice(F.col(g), start + 1, F.coalesce(at(s, i + 1), size(g)) - start), lambda x, n: numbered(x, n))))))))
    df = df.withColumn(o, F.transform(
        F.filter(_range(size(r)), lambda i: (i < ell) | (lane(at(r, i)) != lane(at(r, i - ell)))), lambda i: at(r, i)))
    first = lambda i: (i == 0) | (lane(at(o, i)) != lane(at(o, i - 1)))
    place = lambda x: x.bitwiseAND(F.lit(_PLACE))

    def tuple_of(i):
        x, y = at(o, i), at(o, i + 1)
        paired = (y.isNotNull() & (lane(x) == lane(y))) if ell == 2 else F.lit(False)
        return F.struct(lane(x).cast("int").alias("lane"), F.when(paired, F.when(place(x) < place(y), F.hash(key(x), key(y))).otherwise(
            F.hash(key(y), key(x)))).otherwise(F.hash(key(x))).alias("v"))

    df = df.withColumn(p, F.map_from_entries(F.transform(F.filter(_range(size(o)), first), tuple_of)))
    # the map is bound once: a column used once inside a lambda would be computed anew for every lane
    spread = F.transform(F.array(F.col(p)), lambda m: F.transform(_range(F.lit(lanes)), lambda j: F.element_at(m, j)))
    return df.withColumn(out, spread[0]).drop(w, g, s, r, o, p)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of the lanes in use by either fingerprint that agree; 1 if neither uses any, 0 if only one does."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    lanes = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.when(x.eqNullSafe(y), 1).otherwise(0)))
    return F.aggregate(lanes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("same")),
                       lambda t, x: F.struct((t["n"] + x.isNotNull().cast("int")).alias("n"), (t["same"] + F.coalesce(x, F.lit(0))).alias("same")),
                       lambda t: F.when(t["n"] == 0, F.lit(1.0)).otherwise(t["same"] / t["n"]))


def as_text(fingerprint: str) -> Column:
    """Eight hex digits a lane, dashes for an unused one."""
    return F.array_join(F.transform(F.col(fingerprint), lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), F.lit("--------"))), "")


def next_ids(ids: DataFrame, key: str) -> DataFrame:
    """Distinct non-null ``key`` with ``next_key``, the following one in ascending order; the last is followed by the first.

    Range partitions are ordered each by itself; what crosses a border is settled on the first and last key of every
    partition, two rows each.
    """
    spread = cut(ids.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(key)
    stepped = spread.select(key, "__part", F.lead(key).over(inside).alias("next_key"))
    ends = spread.groupBy("__part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ring = Window.orderBy("low")  # as many rows as range partitions
    ends = ends.select(F.col("high").alias(key), F.coalesce(F.lead("low").over(ring), F.min("low").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__over"))
    return stepped.join(ends, key, "left").select(key, F.coalesce("next_key", "__over").alias("next_key"))


def edited_with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, text, edited, next_id``: every text with its last quarter replaced by the next document's head.

    Texts are shuffled once, by their id, and only the head that is needed travels to the document before. Null texts
    count as empty. Rows of one doc_id stay rows of their own; the next document is then the least text of the next id.
    Rows without a doc_id have no next document: they keep three quarters of their text.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = base.where("doc_id is not null").repartition("doc_id")  # the same rows and columns in both joins: one exchange
    sizes = base.select("doc_id", F.length("text").cast("long").alias("n"))
    order = cut(next_ids(sizes, "doc_id"))
    longest = sizes.groupBy("doc_id").agg(F.max("n").alias("n"))
    wanted = cut(order.join(longest, "doc_id").select(F.col("next_key").alias("doc_id"), F.col("doc_id").alias("before"), F.floor(F.col("n") / 4).cast("int").alias("take")))
    heads = (known.join(wanted, "doc_id").select(F.col("before").alias("doc_id"), F.col("doc_id").alias("next_id"), F.substring("text", F.lit(1), F.col("take")).alias("head"))
             .groupBy("doc_id").agg(F.min("next_id").alias("next_id"), F.min("head").alias("head")))
    without_id = base.where("doc_id is null").selectExpr("doc_id", "text", "cast(null as bigint) as next_id", "'' as head")
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    return known.join(heads, "doc_id", "left").unionByName(without_id).select(
        "doc_id", n.cast("long").alias("n_chars"), "text", "next_id",
        F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter)).alias("edited"))


def fingerprint_edits(docs: DataFrame, k: int = 3, ell: int = 2, lanes: int = 32) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with their likeness to the edit and to the next document."""
    both = edited_with_next(docs).withColumn("edited_sha256", F.sha2("edited", 256))
    both = order_minhash(order_minhash(both, "text", "fp", k, ell, lanes), "edited", "edited_fp", k, ell, lanes)
    both = cut(both.select("doc_id", "n_chars", "edited_sha256", "next_id", "fp", "edited_fp"))
    after = both.select(F.col("doc_id").alias("next_id"), F.col("fp").alias("next_fp")).dropDuplicates(["next_id"])
    return both.join(after, "next_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), F.when(F.col("next_fp").isNotNull(), likeness("fp", "next_fp")).alias("near_next"))
