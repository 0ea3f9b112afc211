"""A Merkle manifest of a dataset that stores every second level of its trees and recomputes the levels in between.

The rows of a source are the leaves of a tree of runs of ``FAN``; the roots of the sources are the leaves of a last one.
A stored row is an aligned subtree: up to ``SPAN`` consecutive nodes of a stored level, under one node of the next one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanquarry.llm.shared import cut

FAN = 16
SPAN = FAN * FAN  # nodes of a stored level under one node of the next stored level


def hashed(*fields: Column) -> Column:
    """sha256 in hex over the fields: ``-`` for a null, else UTF-8 byte count, ``:`` and value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``pos``, the rank from 0 within ``tree`` by ``order``, without a window over the rows of a tree.

    Sorted range partitions cut a tree of any size; a row's number in its partition and the sizes of the partitions
    before it (one row a partition and tree) give its rank. The last column of ``order`` must part equal rows.
    """
    ranged = cut(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33))  # the partition's number stands above 33 bits
    sizes = ranged.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return ranged.join(sizes, ["tree", "__part"]).select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"))


def stored(nodes: DataFrame) -> DataFrame:
    """``tree, grp, nodes``: the nodes of a level (``tree, pos, digest`` and more), ``SPAN`` consecutive ones a row, written."""
    grp = F.floor(F.col("pos") / SPAN).cast("long")
    more = [c for c in nodes.columns if c not in ("tree", "pos")]
    return cut(nodes.groupBy("tree", grp.alias("grp")).agg(F.sort_array(F.collect_list(F.struct("pos", *more))).alias("nodes")))


def _runs(digests: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FAN).cast("int")),
                       lambda i: F.sha2(F.array_join(F.slice(digests, i * FAN + 1, FAN), ""), 256))


def _recomputed(level: DataFrame) -> DataFrame:
    """Add ``low``, the digests of a stored subtree, and ``mid``, the level above that is not stored.

    Only a tree's first subtree can hold its top: one node of it is the top itself and has no ``mid``.
    """
    low = level.withColumn("low", F.transform("nodes", lambda x: x["digest"]))
    return low.withColumn("mid", F.when((F.col("grp") == 0) & (F.size("low") == 1), F.array().cast("array<string>")).otherwise(_runs(F.col("low"))))


def _mid_is_top() -> Column:
    return (F.col("grp") == 0) & (F.size("mid") == 1)


def raised(level: DataFrame) -> DataFrame:
    """``tree, pos, digest``: the node above every stored subtree, or the tree's root where that is reached before."""
    top = F.when(F.size("mid") == 0, F.col("low")[0]).when(_mid_is_top(), F.col("mid")[0]).otherwise(_runs(F.col("mid"))[0])
    return _recomputed(level).select("tree", F.col("grp").alias("pos"), top.alias("digest"))


def build(nodes: DataFrame) -> list[DataFrame]:
    """Stored levels 0, 2, 4, ... until every tree has a single subtree; a finished tree is carried as its root."""
    levels = [stored(nodes)]
    while not levels[-1].where("grp > 0").isEmpty():
        levels.append(stored(raised(levels[-1])))
    return levels


def proofs(level: DataFrame, above: DataFrame) -> DataFrame:
    """One row a node of a stored level, with its columns, those of ``above`` and its ``steps`` up to the last root.

    ``above`` has ``tree, grp``, the ``steps`` of the node over each subtree and what else is to be carried down. A step
    is the siblings to the ``left`` and ``right`` of a node in its run. The level in between is computed from the
    subtree, gives its siblings and is dropped; steps are shuffled once a subtree, not once a node.
    """
    j = F.col("__j")
    step = lambda digests, at: F.struct(
        F.array_join(F.slice(digests, at - at % FAN + 1, at % FAN), "").alias("left"), F.array_join(F.slice(digests, at + 2, FAN - 1 - at % FAN), "").alias("right"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    own = F.when(F.size("mid") == 0, none).when(_mid_is_top(), F.array(step(F.col("low"), j))).otherwise(
        F.array(step(F.col("low"), j), step(F.col("mid"), F.floor(j / FAN).cast("int"))))
    carried = [c for c in above.columns if c not in ("tree", "grp", "steps")]
    each = _recomputed(level.join(above, ["tree", "grp"])).select("tree", "grp", "low", "mid", "steps", *carried, F.posexplode("nodes").alias("__j", "__node"))
    return each.select("tree", *carried, "__node.*", F.concat(own, F.col("steps")).alias("steps"))


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """:func:`proofs` of level 0, from the steps ``above`` the roots, one stored level after the other."""
    for level in levels[:0:-1]:
        above = proofs(level, above).drop("digest").withColumnRenamed("pos", "grp")
    return proofs(levels[0], above)


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, digest, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(rows: DataFrame) -> DataFrame:
    """Proofs of all rows of ``tree, digest`` and more, ordered within a tree by the columns behind it in their order.

    Adds ``subroot`` (of the tree), ``root`` (over the subroots by tree, bytewise) and ``steps``. ``tree`` is not null.
    """
    levels = build(placed(rows, *[c for c in rows.columns if c != "tree"]))
    subroots = cut(raised(levels[-1]).select("tree", "digest"))
    tops = build(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), "key"))
    start = raised(tops[-1]).select("tree", F.lit(0).cast("long").alias("grp"), F.array().cast("array<struct<left:string,right:string>>").alias("steps"), F.col("digest").alias("root"))
    above = descend(tops, start).select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("grp"), "steps", F.col("digest").alias("subroot"), "root")
    return descend(levels, above)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def audit(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: the proof of every document, tried on a
    text whose A-Z are lower case where 5 divides the id's crc32.

    Defined results: a null in any column hashes as ``-``, a null source is the first tree, null ids come first in their
    source and are not tampered with; equal rows stand side by side, each with its own proof; rows of one id follow
    their leaf digest; a single document has no siblings, its proof is the digest of nothing and its leaf the root; an
    empty table gives no rows. Only digests and ids are shuffled, and a source of any size is cut into subtrees.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaves = cut(docs.select(
        F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("tree"), "doc_id", hashed(*columns, F.col("text")).alias("digest"),
        F.when(tampered(F.col("doc_id")), hashed(*columns, F.translate("text", upper, upper.lower()))).alias("other"),
        F.monotonically_increasing_id().alias("row")))  # parts equal rows; fixed once written
    proven = manifest(leaves.select("tree", "doc_id", "digest", "other", "row")).withColumnRenamed("digest", "leaf").withColumns({
        "proof_sha256": F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256),
        "folded_root": fold(F.coalesce("other", "leaf"), F.col("steps"))})
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels by recursion over all nodes; crc32 from its polynomial, as the SQL dialect has no function for it.
ORACLE = """WITH RECURSIVE
bits AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM range(256) AS t(i)),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits),
field AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, b: xor(t[CAST(xor(c, b) % 256 AS BIGINT) + 1], c // 256))) % 5 = 0 AS hit,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents, crc),
leaf AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || source, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN coalesce(hit, false) THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS other FROM field),
spot AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
low(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, n FROM spot
  UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM low WHERE n > 1 GROUP BY tree, level, pos // 16),
subroot AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM subroot
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM high WHERE n > 1 GROUP BY level, pos // 16),
climb(r, tree, level, pos, node, proof) AS (
  SELECT r, tree, 0, pos, coalesce(other, leaf), '' FROM spot
  UNION ALL SELECT c.r, c.tree, c.level + 1, c.pos // 16, sha256(string_agg(CASE WHEN l.pos = c.pos THEN c.node ELSE l.digest END, '' ORDER BY l.pos)),
    any_value(c.proof) || coalesce(string_agg(CASE WHEN l.pos <> c.pos THEN l.digest END, '' ORDER BY l.pos), '')
  FROM climb c JOIN low l ON l.tree = c.tree AND l.level = c.level AND l.pos // 16 = c.pos // 16 WHERE l.n > 1 GROUP BY c.r, c.tree, c.level, c.pos),
risen AS (SELECT c.r, s.pos, s.digest AS subroot, c.node, c.proof FROM climb c JOIN subroot s USING (tree) QUALIFY c.level = max(c.level) OVER (PARTITION BY c.r)),
top(r, level, pos, node, proof) AS (
  SELECT r, 0, pos, node, proof FROM risen
  UNION ALL SELECT c.r, c.level + 1, c.pos // 16, sha256(string_agg(CASE WHEN l.pos = c.pos THEN c.node ELSE l.digest END, '' ORDER BY l.pos)),
    any_value(c.proof) || coalesce(string_agg(CASE WHEN l.pos <> c.pos THEN l.digest END, '' ORDER BY l.pos), '')
  FROM top c JOIN high l ON l.level = c.level AND l.pos // 16 = c.pos // 16 WHERE l.n > 1 GROUP BY c.r, c.level, c.pos),
whole AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT spot.doc_id, spot.leaf, risen.subroot, whole.root, sha256(t.proof) AS proof_sha256, t.node AS folded_root, t.node = whole.root AS verified
FROM (SELECT * FROM top QUALIFY level = max(level) OVER (PARTITION BY r)) t JOIN spot USING (r) JOIN risen USING (r), whole"""
