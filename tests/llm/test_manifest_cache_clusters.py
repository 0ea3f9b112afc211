"""Merkle manifest, token counts by digest and centroid clustering against brute force, with edge rows."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [tuple(r) for r in df.collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(leaves):
    """All levels of a tree of runs of 16."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def steps_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        lo = at // 16 * 16
        out.append((nodes[lo:at], nodes[at + 1:lo + 16]))
        at //= 16
    return out


def audit_plain(docs):
    by_source = defaultdict(list)
    for d in docs:
        by_source[d[3]].append(d)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(*d)))
        trees[s] = tree_of([leaf_of(*d) for d in by_source[s]])
    top = tree_of([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for at, d in enumerate(by_source[s]):
            steps = steps_of(trees[s], at) + steps_of(top, n)
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1]) if d[1] is not None else None
            node = leaf_of(d[0], low, *d[2:]) if hit else leaf_of(*d)
            for left, right in steps:
                node = sha("".join(left) + node + "".join(right))
            out.append((d[0], leaf_of(*d), trees[s][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in steps)), node, node == top[-1][0]))
    return out


def text_key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 16, "": 17, "é": 1, "z": 2}, {"hot": 4100, None: 257, "b": 256, "B": 255, **{f"s{i}": 1 + i % 3 for i in range(300)}}])
def test_manifest_equals_plain_trees(spark, sizes):
    from spanquarry.llm.merkle import audit

    rng = random.Random(3)
    docs = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Mixed CASE É", "lower", "x" * 70000 if rng.random() < 0.01 else "Y"])
            docs.append((rng.choice([None, rng.randint(-5, 10**6)]), text, rng.choice([None, "en", "é"]), source, rng.choice([None, 7])))
        docs.append(docs[-1])  # a row that repeats
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as pos", "'q' as tree", "2 as digest", "3 as grp", "'s' as steps", "0 as row")
    assert sorted(rows(audit(df)), key=text_key) == sorted(audit_plain(docs), key=text_key)


def test_manifest_of_one_row_and_of_none(spark):
    from spanquarry.llm.merkle import audit

    one = [(4, "A", "en", "s", 1)]
    got = rows(audit(spark.createDataFrame(one, DOCS)))
    assert got == audit_plain(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")
    assert rows(audit(spark.createDataFrame([], DOCS))) == []


def test_only_every_second_level_is_stored(spark):
    from spanquarry.llm import merkle

    nodes = spark.range(70000).select(F.lit("t").alias("tree"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    levels = merkle.build(nodes)
    assert [x.select(F.sum(F.size("nodes"))).first()[0] for x in levels] == [70000, 274, 2]
    assert rows(merkle.raised(levels[-1])) == [("t", 0, tree_of([sha(str(i)) for i in range(70000)])[-1][0])]


TEXTS = [None, "", " ", "a b", "a▁b", "same text", "same text", "<s> </s> <unk>", "ｆｕｌｌ 漢字 é", "a\x00b", "tab\tnl\n", "word " * 60000]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library(spark, tmp_path, name):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from spanquarry.llm import token_cache

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        coder = SentencePieceProcessor(model_file=path)
        count = lambda t: len(coder.encode(t))
    else:
        coder = Tokenizer.from_file(path)
        count = lambda t: len(coder.encode(t, add_special_tokens=False).ids)
    docs = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, "same text", "k"), (5, "other", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, content string").selectExpr("*", "1 as n_tokens", "2 as tokenizer", "'x' as __n2")
    cache = str(tmp_path / "cache")
    got = rows(token_cache.report(df, cache, path, limit=1000))
    want = [(d, len((t or "").encode()), count(t or ""), count(t or "") > 1000) for d, t, _ in docs]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = token_cache.with_counts(df, cache, path)
    assert sorted(kept.columns) == sorted(df.columns) and kept.where("n_tokens is null").isEmpty()
    assert rows(token_cache.report(df.limit(0), str(tmp_path / "none"), path)) == []


def test_cache_encodes_only_distinct_misses(spark, tmp_path):
    import public_tokenizers

    from spanquarry.llm import token_cache

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    held = lambda: spark.read.parquet(cache)
    frame = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    token_cache.fill(frame(*["hot"] * 500, "a b", "a▁b", None, ""), cache, path)
    assert held().count() == 3  # the blank and U+2581 are one content, null and empty too
    token_cache.fill(frame("hot", "new", "new"), cache, path)
    assert held().count() == 4
    # counts come from the cache: a stored count is not computed anew, a second writer's row does not double results
    wrong = held().where(F.col("content") == F.unhex(F.sha2(F.lit("hot"), 256))).withColumn("n_tokens", F.lit(99).cast("long"))
    wrong.write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert sorted(rows(token_cache.report(frame("hot", "hot"), cache, path))) == [(0, 3, 99, False), (1, 3, 99, False)]
    assert held().count() == 5
    token_cache.fill(frame("hot"), cache, public_tokenizers.path("byte_bpe_50k.json"))
    assert held().select("tokenizer").distinct().count() == 2


def kmeans_plain(vectors, k, rounds):
    """Exact integers, all distances."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors
            if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    find = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[find(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(centroids)]
    found = [(i, *find(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, c in found:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, centroids[c])))) for i, d, c in found]


@pytest.mark.parametrize("n", [0, 3, 400])
def test_clusters_equal_plain_rounds(spark, n):
    from spanquarry.llm.orchard import cluster

    rng = random.Random(n)
    vectors = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(4)]) for i in range(n)]  # many ties
    if n == 400:
        vectors += vectors[:40] + [(None, [0.1, 0.2, 0.3, 0.4]), (900, None), (901, [1.0]), (902, [0.1, None, 0.2, 0.3]),
                                   (903, [0.1, float("nan"), 0.2, 0.3]), (904, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "'c' as cluster", "2 as distance")
    got = rows(cluster(df, k=16, rounds=3, dims=4))
    vectors = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert sorted(got, key=str) == sorted(kmeans_plain(vectors, 16, 3), key=str)


def test_search_measures_fewer_distances_and_finds_the_nearest():
    from spanquarry.llm.orchard import nearest

    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (40, 3))
    centroids[7] = centroids[3]
    vectors = np.concatenate([centroids[rng.integers(0, 40, 500)] + rng.integers(-20, 20, (500, 3)), rng.integers(-1000, 1000, (500, 3)), centroids])
    best, distance = nearest(vectors, centroids)
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_components_beyond_exact_distances_are_an_error(spark):
    from spanquarry.llm.orchard import cluster

    huge = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="scaled component"):
        cluster(huge, dims=2).collect()


def test_the_entry_lists_queries_and_sql_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) < set(q) and 'op13_orchard_clusters' in o and 'pipeline' in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
