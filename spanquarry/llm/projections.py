"""Near-duplicate vectors by counting collisions on many one-dimensional projections."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanquarry.llm.shared import components, cut


def calibrate(cosine: float, projections: int, half: float, recall: float) -> int:
    """The largest collision count that a pair at the threshold reaches with probability ``recall`` at least.

    Unit vectors at this cosine are ``r`` apart; on a Gaussian direction their distance is normal with deviation r, so
    collisions within ``half`` are binomial. Nearer pairs collide more often.
    """
    r = math.sqrt(max(2 - 2 * cosine, 1e-12))
    p = math.erf(half / r / math.sqrt(2))
    tail, count = 0.0, projections + 1
    while count > 0 and tail < recall:
        count -= 1
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
    return count


def near_vectors(vectors: DataFrame, cosine: float = 0.98, projections: int = 48, windows: float = 1.5, recall: float = 0.99999,
                 chunk: int = 1024, seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector; links join equal labels and cosine >= ``cosine``.

    Equal vectors of a label are one row first, with their number. All rows are projected on ``projections`` Gaussian
    directions and sorted along each. The first direction deals them out: cells of the width at which a pair at the
    threshold is lost with less than 1e-6, cut in chunks of ``chunk`` rows, each met with itself, its cell and the
    next one. In such a tile every row is the centre of a window of ``windows`` times the threshold distance on each
    sorted direction; collisions per pair are counted over all of them, and pairs that reach the calibrated count are
    verified in double precision. A tile returns the number of links of each row and a spanning set of them, never
    all pairs.

    Null labels, null, empty and zero vectors and those with null or non-finite parts link with nothing; vectors of
    different lengths do not link; rows of one vec_id are one node. Null vec_ids are listed without component.
    """
    r = math.sqrt(max(2 - 2 * cosine, 1e-12))
    half, width = windows * r, 5.0 * r
    least = calibrate(cosine, projections, half, recall)
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = ok & F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)
    listed = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = listed.where(ok & F.col("vec_id").isNotNull())
    keyed = cut(usable.select("vec_id", "label", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding")))
    same = keyed.groupBy("label", "embedding").agg(F.min("vec_id").alias("c"), F.countDistinct("vec_id").alias("size"))
    same = cut(same)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = np.zeros(len(b), np.int64)
            for n in {len(x) for x in b["embedding"]}:
                at = np.array([len(x) == n for x in b["embedding"]], bool)
                cells[at] = np.floor(_unit(b["embedding"][at]) @ _directions(n, 1, seed)[:, 0] / width)
            yield b.assign(cell=cells, dim=[len(x) for x in b["embedding"]])

    placed = same.mapInPandas(project, "label int, embedding array<double>, c long, size long, cell long, dim int") if dict(same.dtypes)["label"] == "int" else \
        same.withColumn("label", F.col("label").cast("string")).mapInPandas(project, "label string, embedding array<double>, c long, size long, cell long, dim int")
    placed = cut(placed)
    home = ["label", "dim", "cell"]
    counts = placed.groupBy(*home).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    after = counts.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("chunks").alias("next_chunks"))
    before = counts.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("chunks").alias("prior_chunks"))
    spread = placed.join(counts, home).withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
    spread = spread.join(after, home, "left").join(before, home, "left")
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda cell, a, step, b: F.struct(cell.alias("cell"), a.cast("int").alias("a"), F.lit(step).alias("step"), b.cast("int").alias("b"))
    own, cell = F.col("chunk"), F.col("cell")
    within = F.transform(steps(F.col("chunks")), lambda k: tile(cell, F.least(own, k), 0, F.greatest(own, k)))
    ahead = F.transform(steps(F.coalesce("next_chunks", F.lit(0))), lambda k: tile(cell, own, 1, k))
    behind = F.transform(steps(F.coalesce("prior_chunks", F.lit(0))), lambda k: tile(cell - 1, k, 1, own))
    dealt = spread.select("label", "dim", "c", "size", "embedding", F.col("cell").alias("home"), "chunk", F.explode(F.concat(within, ahead, behind)).alias("tile"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["tile"].iloc[0]
        first = ((pdf["home"] == t["cell"]) & (pdf["chunk"] == t["a"])).to_numpy()
        second = (((pdf["home"] == t["cell"] + t["step"]) & (pdf["chunk"] == t["b"])).to_numpy())
        x = _unit(pdf["embedding"])
        ids, sizes = pdf["c"].to_numpy(), pdf["size"].to_numpy()
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        i, j = _collisions(x, np.flatnonzero(first), np.flatnonzero(second), _directions(x.shape[1], projections, seed), half, least)
        near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine if len(i) else np.zeros(0, bool)
        i, j = i[near], j[near]
        np.add.at(links, i, sizes[j])
        np.add.at(links, j, sizes[i])
        for a, b in zip(i.tolist(), j.tolist()):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            while root[b] != b:
                root[b] = root[root[b]]
                b = root[b]
            root[max(a, b)] = min(a, b)
        for a in range(len(root)):
            root[a] = root[root[a]]
        on = links > 0
        return pd.DataFrame({"c": ids[on], "links": links[on], "other": ids[root[on]]})

    found = cut(dealt.groupBy("label", "dim", "tile").applyInPandas(meet, "c long, links long, other long"))
    graph = found.select(F.col("c").alias("a"), F.col("other").alias("b"))
    named = keyed.join(same.select("label", "embedding", "c", "size"), ["label", "embedding"]).select("vec_id", "c", "size")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    of_node = (named.join(links, "c", "left").join(components(graph).toDF("c", "component"), "c", "left")
               .groupBy("vec_id").agg(F.sum(F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "c")).alias("component_id")))
    return (listed.select("vec_id").join(of_node, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    """Direction k depends on the seed, the dimension and k only."""
    return np.stack([np.random.default_rng([seed, dim, k]).standard_normal(dim) for k in range(n)], axis=1)


def _collisions(x: np.ndarray, left: np.ndarray, right: np.ndarray, directions: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right), each once, that lie within ``half`` of each other on ``least`` of the directions at least."""
    shared = left is right or np.array_equal(left, right)
    counts = np.zeros((len(left), len(right)), np.uint16)
    lines = x @ directions
    for k in range(directions.shape[1]):
        order = np.argsort(lines[right, k], kind="stable")
        sorted_line = lines[right[order], k]
        lo, hi = np.searchsorted(sorted_line, lines[left, k] - half), np.searchsorted(sorted_line, lines[left, k] + half, "right")
        for q in range(len(left)):  # the window that is centred on this row
            counts[q, order[lo[q]:hi[q]]] += 1
    q, p = np.nonzero(counts >= least)
    i, j = left[q], right[p]
    once = i < j if shared else np.ones(len(i), bool)
    return i[once], j[once]
