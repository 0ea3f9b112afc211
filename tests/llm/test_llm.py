"""The training-data operators against brute force, exact round trips and edge rows."""
import hashlib
import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (None, "x y z w v u", "a"), (5, "wort " * 9000, "b"), (6, "same text here again", "b"),
         (7, "same text here again", "b"), (7, "same text here again", "b"), (8, "é漢字 ŝ <|endoftext|> it's", "c")]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string, source string")
    return df.selectExpr("*", "'q' as score", "1 as n", "2L as n_chars", "'k' as key", "0 as epochs_", "'w' as w")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_edge_rows_and_empty_tables(spark, edges):
    from spanquarry.llm import bpe, fingerprints, license_scan, line_dedup, mixing, ngram_join, quality

    labels = spark.createDataFrame([(1, 1), (None, 0), (6, None)], "doc_id long, quality int")
    for build in (fingerprints.fingerprint_edits, bpe.round_trip, ngram_join.jaccard_components, license_scan.scan, line_dedup.report,
                  lambda d: quality.assess(d, labels)):
        assert build(edges).count() == len(EDGES)
        assert rows(build(edges.limit(0))) == []
    assert mixing.mix(edges, mixing.words(), repeats=2.0).select("doc_id").distinct().count() == 8
    assert rows(mixing.mix(edges.limit(0), mixing.words(), repeats=2.0)) == []


def test_components_match_union_find(spark):
    from spanquarry.llm.shared import components

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(7, x) for x in range(3000, 3200)] + [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(None, 3), (4, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: find(x) for x in root}


def test_order_minhash(spark):
    from spanquarry.llm.fingerprints import fingerprint_edits, likeness, order_minhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [t for _, t in sorted(rows(docs.select("doc_id", "text")))]
    got = sorted(fingerprint_edits(docs).collect(), key=lambda r: r.doc_id)
    for t, after, r in zip(texts, texts[1:] + texts[:1], got):
        q = len(t) // 4
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[:len(t) - q] + after[:q]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and (t != after or r.near_next == 1.0)
    assert np.mean([r.near_edited for r in got]) > 0.25 > 0.05 > np.mean([r.near_next for r in got])
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    pair = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(words[:-4] + ["x"] * 4))], "a string, b string, c string")
    for c in "abc":
        pair = order_minhash(pair, c, f"f{c}")
    far, near = pair.select(likeness("fa", "fb"), likeness("fa", "fc")).first()
    assert near > 0.85 and far < 0.75  # moving a half keeps nearly all k-mers but not their order


def test_quality_learns_from_the_training_fold(spark):
    from spanquarry.llm.quality import GatedAttention, assess, passages

    sf = "/root/testdata/sf0.01"
    got = assess(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert len(right) > 40 and np.mean(right) > 0.9
    rng = np.random.default_rng(0)
    x, counts = passages([b"Some words here. " * 90, b"", b"AAA!! " * 200])
    net, y = GatedAttention.fresh(1), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := 1 / (1 + np.exp(-net.pooled(net.hidden(x.astype(float)), counts)["logit"]))) + (1 - y) * np.log(1 - p))
    grads = net.gradients(x.astype(float), counts, y)
    for name, g in grads.items():
        flat, at = net.p[name].reshape(-1), rng.integers(net.p[name].size)
        keep = flat[at]
        flat[at] = keep + 1e-5
        up = loss()
        flat[at] = keep - 1e-5
        down = loss()
        flat[at] = keep
        assert abs((up - down) / 2e-5 - g.reshape(-1)[at]) < 1e-6


def test_bpe_equals_the_library_and_streams():
    from tokenizers import Tokenizer

    from spanquarry.llm.bpe import Decoder, Encoder, default_path

    own, lib, rng = Encoder(default_path()), Tokenizer.from_file(default_path()), random.Random(2)
    decoder = Decoder(default_path())
    for alphabet in ("ab", "aeiou nrst", "\n \t", "!#$-=*_", "0123 9", "aéß漢字 ", "=-", "thea"):
        for n in (0, 1, 7, 300, 9000):
            text = "".join(rng.choice(alphabet) for _ in range(n)) + "<|endoftext|>" * (n == 7)
            packed = b"".join(own.encode(text))
            assert np.frombuffer(packed, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
            assert "".join(decoder.decode(packed, 5)) == text
    long = "thea" * 12_000
    pieces = [long[i:i + 997].encode() for i in range(0, len(long), 997)]
    assert b"".join(own.stream(pieces)) == np.array(own.m.merge(long.encode()), "<u4").tobytes()


@pytest.mark.parametrize("width,share", [(3, 90), (5, 80), (1, 90)])
def test_jaccard_components_match_all_pairs(spark, width, share):
    from spanquarry.llm.ngram_join import gram_set, jaccard_components

    rng, texts = random.Random(3), []
    for _ in range(25):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 8, 9, 10, 19, 20, 40, 120, 400]))]
        for v in range(6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = f"z{rng.randint(0, 99)}"
            texts.append(" ".join(own).upper() if v % 3 else "\n".join(own))
            base = own if v % 2 else base
    sets = [set(gram_set(t, width).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= share * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    got = rows(jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width, share, 100))
    assert sorted(got) == [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root))]


def test_mixture_gives_every_epoch_its_own_order(spark):
    from spanquarry.llm.mixing import mix

    docs = spark.createDataFrame([(i, "big" if i < 900 else "small", i % 7 + 1) for i in range(1000)], "doc_id long, source string, n long")
    read = mix(docs, F.col("n"), repeats=2.6, block=40)
    got = sorted((r.source, r.epoch, r.block, r.rank, r.h, r.doc_id, r.n, r.epochs) for r in read.withColumn("h", F.xxhash64(F.lit(17), "epoch", "doc_id")).collect())
    orders = {}
    for r in got:
        orders.setdefault(r[:2], []).append(r)
    assert {e for s, e in orders if s == "small"} == {0, 1, 2}
    for (source, epoch), rs in orders.items():
        size = 22 if source == "big" else 2
        assert [r[5] for r in rs] == [r[5] for r in sorted(rs, key=lambda r: (r[4] % size, r[4], r[5]))]
        assert all(r[2] == r[4] % size and (r[3] == 0 or r[3] == q[3] + 1) for q, r in zip([rs[0]] + rs, rs))
        whole = docs.where(F.col("source") == source).agg(F.sum("n"), F.count("n")).first()
        rest = (rs[0][7] - epoch) * whole[0]
        assert len({r[5] for r in rs}) == len(rs) and (len(rs) == whole[1] or sum(r[6] for r in rs[:-1]) < rest <= sum(r[6] for r in rs))
    first, second = ([r[5] for r in orders["small", e]] for e in (0, 1))
    assert sorted(first) == sorted(second) and first != second


def test_mixture_meets_its_target(spark):
    from spanquarry.llm.mixing import bisect_exponent, epochs, mix, weights, words

    sizes = {"a": 900.0, "b": 90.0, "c": 10.0}
    a = bisect_exponent(sizes, repeats=2.0)
    assert max(epochs(sizes, weights(sizes, a)).values()) == pytest.approx(2.0)
    w = weights(sizes, bisect_exponent(sizes, entropy=0.8))
    assert -sum(x * np.log(x) for x in w.values()) / np.log(3) == pytest.approx(0.8)
    docs = spark.createDataFrame([(i, "x " * (1 + i % 7), "abc"[(i > 40) + (i > 70)]) for i in range(80)], "doc_id long, text string, source string")
    got = mix(docs, words(), repeats=3.0, block=5).groupBy("source", "doc_id").agg(F.count("*").alias("k"), F.max("epochs").alias("e")).collect()
    assert {r.doc_id for r in got} == set(range(80)) and all(int(r.e) <= r.k <= int(r.e + 1e-9) + 1 for r in got)


def test_arc_versions_convert_and_read_back(spark):
    from spanquarry.llm.arc import FIELDS, archive_pages, parse_arc, warc_date

    head = f"2 0 o\n{FIELDS[2]}\n".encode()
    v2 = (b"filedesc://x 0.0.0.0 20010101000000 text/plain %d\n" % len(head) + head
          + b"\nhttp://a/ 1.2.3.4 2001 text/html 200 - - 9 x 5\nhe\nlo\n\nbroken line\nhttp://b/ 1.2.3.4 2001 text/html 200 - - 9 x 99\ncut")
    assert [(r["URL"], r["body"]) for r in parse_arc(v2)] == [("http://a/", b"he\nlo")]
    assert warc_date("2001") == "2001-01-01T00:00:00Z" and warc_date("x") == "1970-01-01T00:00:00Z"
    pages = [(1, "http://a b/", "x\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "u", "é"), (4, "v", "x\r\n\r\nWARC/1.1\r\n"), (5, "w", ""), (None, "n", "x\r\n\r\nWARC/1.1\r\n")]
    got = {r.page_id: r for r in archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == 6 and {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 4), 2: ("revisit", 5), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 4)}
    assert got[1].payload_bytes == 15 == got[4].payload_bytes and got[1].payload_digest == got[4].payload_digest
    assert rows(archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def test_vectors_match_all_pairs(spark):
    from spanquarry.llm.projections import near_vectors

    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    vectors = [(i, (base[i % 40] + rng.standard_normal(16) * 0.05 * (i % 3)).tolist(), int(i % 40 % 2)) for i in range(300)]
    vectors += [(300, vectors[0][1], 0), (301, [x * 3 for x in vectors[0][1]], 0), (302, vectors[0][1], None), (303, None, 0), (304, [0.0] * 16, 0), (305, [float("nan")] * 16, 0), (306, [1.0, None], 0), (None, vectors[0][1], 0)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"), chunk=32).collect()}
    usable = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in vectors if i is not None and i <= 301]
    unit = {i: v / np.linalg.norm(v) for i, v, _ in usable}
    label = {i: y for i, _, y in usable}
    near = {i: [j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.98] for i in unit}
    for i in unit:
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near[i]), min(seen), min(seen) == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(302, 307)) and len(got) == 308


def test_licenses(spark):
    from spanquarry.llm.license_scan import scan

    texts = ["GNU General\nPublic License; the MIT License. mit-license", "Licensed under CC BY-NC 4.0.", None, "--", "MITLicense gnu general public licence",
             "redistribution and use in source and binary forms, with or without changes, are permitted", "ÉCC BY cc  by"]
    got = [tuple(r)[1:] for r in sorted(scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]
    assert got[0] == (9, 3, 0, 7, "gpl,mit", "gpl,mit", 1.0)
    assert got[1] == (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc", 1.0)
    assert got[2] == got[3] == (0, 0, None, None, "", "", 0.0) and got[4][1] == 0
    assert got[5][4:6] == ("", "bsd") and 0.9 <= got[5][6] < 1 and got[6] == (4, 1, 2, 2, "cc-by", "cc-by", 1.0)


def test_repeated_runs_match_brute_force(spark):
    """Every later window of 50 words goes, wherever in a line it stands; what goes has an earlier equal; the rest stays."""
    from spanquarry.llm.line_dedup import drop_repeats

    rng = random.Random(8)
    passages = [" ".join(rng.choice(["ab", "cd\n", "ef", "gé"]) + str(rng.randint(0, 99)) for _ in range(n)) for n in (50, 51, 68, 140)] + ["in " * 130, "ja nein " * 45]
    texts = []
    for i in range(60):
        own = [f"own{i}x{k}" for k in range(rng.randint(0, 90))]
        for p in rng.choices(passages, k=rng.randint(0, 3)):
            own.insert(rng.randint(0, len(own)), p)
        texts.append(rng.choice([" ", "\n"]).join(own))
    texts += [texts[3], texts[7] + " end", "short text"]
    words = [t.split() for t in texts]
    must, first = [set() for _ in texts], {}
    for i, ws in enumerate(words):
        for a in range(len(ws) - 49):
            j, b = first.setdefault(tuple(ws[a:a + 50]), (i, a))
            if (j, b) != (i, a) and (j != i or a - b >= 50):
                must[i] |= set(range(a, a + 50))
    got = {r.doc_id: r for r in drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(map(len, must)) > 2000
    for i, ws in enumerate(words):
        kept = got[i].text.split()
        assert got[i].n_words == len(ws) and got[i].n_deleted == len(ws) - len(kept)
        assert i >= 60 or [w for w in kept if w.startswith("own")] == [w for w in ws if w.startswith("own")]
        plain = [k for k, w in enumerate(ws) if w not in ("in", "ja", "nein")]
        assert [w for w in kept if w not in ("in", "ja", "nein")] == [ws[k] for k in plain if k not in must[i]]
    seen = {w for r in got.values() for w in r.text.split()}
    assert seen == {w for ws in words for w in ws}


def test_line_dedup_with_a_shorter_first_place(spark):
    """The first text with a fingerprint shares too little, or only a part of what later texts share."""
    from spanquarry.llm.line_dedup import drop_repeats

    rng = random.Random(21)
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    p, q, loop = words("p", 130), words("q", 120), words("r", 12) * 14
    texts = [words("a", 20) + p[20:60] + words("b", 20), words("c", 9) + p + words("d", 9), words("e", 30) + p[5:] + words("f", 3),
             words("g", 5) + q[:75], words("h", 8) + q[30:] + words("i", 8), words("j", 4) + q, loop[:40] + words("k", 7), loop + words("l", 3) + loop[5:],
             words("m", 2) + loop[7:]]
    for i in range(60):
        own = words(f"x{i}y", rng.randint(0, 40))
        for _ in range(rng.randint(1, 3)):
            source, a = rng.choice([p, q, loop]), rng.randint(0, 70)
            k = rng.randint(0, len(own))
            own[k:k] = source[a:a + rng.randint(17, 90)]
        texts.insert(rng.randint(0, len(texts)), own)
    must, first = [set() for _ in texts], {}
    for i, ws in enumerate(texts):
        for a in range(len(ws) - 49):
            j, b = first.setdefault(tuple(ws[a:a + 50]), (i, a))
            if j != i or a - b >= 50:
                must[i] |= set(range(a, a + 50))
    assert sum(map(len, must)) > 1000
    data = [(i, " ".join(ws)) for i, ws in enumerate(texts)]
    got = {r.doc_id: r for r in drop_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, ws in enumerate(texts):
        assert got[i].text.split() == [w for k, w in enumerate(ws) if k not in must[i]]
        assert got[i].n_deleted == len(must[i])


def test_chats(spark):
    from spanquarry.llm.chat import escape, format_chats, parse, read_back, render, unescape

    nasty = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "\\[INST]\\n", "a\nb", "", "é漢字\\\\</s", "<|endoftext|>"]
    for t in nasty + ["".join(random.Random(n).choice(["\\", "[INST]", "</s>", "n", "\n"]) for _ in range(30)) for n in range(50)]:
        assert unescape(escape(t)) == t and unescape(escape(t, True), True) == t
        assert parse(render([("user", t), (t, t), ("assistant", t)])[0]) == [("user", t), (t, t), ("assistant", t)]
    turns = [(c, n, "assistant" if n % 2 else "user", t) for c in (1, 2) for n, t in enumerate(nasty)] + [(3, 0, None, None), (None, 1, "assistant", "x")]
    got = {r.conv_id: r for r in read_back(format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    said = "".join(nasty[1::2])
    assert got[1].n_turns == 8 and got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == len(said)
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{'assistant' if n % 2 else 'user'}\n{t}\n" for n, t in enumerate(nasty)).encode()).hexdigest()
    assert got[3].loss_chars == 0 and got[None].loss_chars == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for n, (_, stage) in enumerate(c.STAGES):
        docs = stage(spark, docs, SF)
        assert n == 4 or docs.columns == names
    assert 0 < docs.select("doc_id").distinct().count() < before
