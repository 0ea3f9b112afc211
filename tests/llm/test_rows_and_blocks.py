"""Repeated ids with different content, license blocks by brute force, and edge rows of the stages."""
import math
import random
import re
import time

import pytest

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def blocks_plain(words, templates, threshold):
    found = set()
    for n, (t, label) in enumerate(templates):
        own = set(t.split())
        for s, w in enumerate(words):
            if w in own:
                inside = len(own & set(words[s:s + 2 * len(own)]))
                if inside >= math.ceil(threshold * len(own)):
                    found.add((n, label, s, inside / len(own)))
    return found


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_license_blocks_equal_brute_force(spark, threshold):
    from spanquarry.llm.license_scan import blocks, tokens

    rng = random.Random(4)
    templates = [("a b c d e f", "x"), ("c d", "y"), ("b b g h i j k l m n", "z"), ("a b c d e f g h", "x")]
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz" if k % 2 else "abcdeghz") for _ in range(rng.randint(0, 90))) for k in range(120)]
    texts += ["a b c d e f " * 40, "", "c D"]
    scanned = tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates, {}, threshold)
    got = {}
    for doc, *rest in rows(blocks(scanned, templates, threshold, "doc_id")):
        got.setdefault(doc, []).append(tuple(rest))
    for i, t in enumerate(texts):
        found = got.get(i, [])
        assert len(found) == len(set(found)) and set(found) == blocks_plain(t.lower().split(), templates, threshold)


def test_whole_notices_and_a_long_license_text(spark):
    from spanquarry.llm.license_scan import TEMPLATES, scan

    notice = max((t for t, x in TEMPLATES if x == "mit"), key=len)
    long = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License. " + "word " * 8) * 3500
    texts = ["Copyright. " + notice.upper() + " End.", " ".join(notice.split()[:60]), long, "İMIT LICENSE Ka"]
    start = time.time()
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - start < 60 and got[2].n_words > 100_000
    assert got[0].labels == "mit" and got[0].score == 1.0 and got[0].n_base == 0
    assert got[1].labels == "mit"  # the first sentence is a template of its own
    assert got[2].labels == "gpl" and got[2].n_base == 3500
    assert (got[3].n_words, got[3].n_base) == (3, 0)  # only A-Z is folded: the first word keeps its dotted capital


def test_texts_of_one_id_are_linked_and_kept_apart(spark):
    from spanquarry.llm.ngram_join import jaccard_components

    words = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    a, b, c = words("a"), words("b"), words("c")
    docs = [(1, a), (2, b), (7, a), (7, b), (7, ""), (9, c), (3, c), (8, None), (8, words("d")), (11, words("d")), (None, a), (5, words("e")), (5, words("e"))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as c", "2 as __h", "'x' as g")
    got = sorted(rows(jaccard_components(df, 3, 90, 100)), key=str)
    n = lambda t: len((t or "").split()) - 2 if t else 0
    root = {1: 1, 2: 1, 7: 1, 9: 3, 3: 3, 8: 8, 11: 8, 5: 5, None: None}
    assert got == sorted([(i, n(t), root[i]) for i, t in docs], key=str)


def test_line_dedup_keeps_what_only_one_text_of_an_id_has(spark):
    from spanquarry.llm.line_dedup import drop_repeats

    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    p, q = words("p", 80), words("q", 80)
    docs = [(1, p, 5), (7, p, 5), (7, q, 5), (8, "x " + q, 5), (None, p, 5), (9, None, 5), (9, "", 5), (4, q, 5), (4, q, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").selectExpr("*", "'k' as __first", "0 as mark")
    got = sorted(rows(drop_repeats(df).select("doc_id", "text", "n_words", "n_deleted", "mark")), key=str)
    # the texts of 7 stand first: they stay, and what repeats them goes
    assert got == sorted([(1, "", 80, 80, 0), (7, p, 80, 0, 0), (7, q, 80, 0, 0), (8, "x", 81, 80, 0), (None, p, 80, 0, 0), (9, None, 0, 0, 0), (9, "", 0, 0, 0),
                          (4, "", 80, 80, 0), (4, "", 80, 80, 0)], key=str)


def test_records_with_one_id_or_none_keep_their_types(spark):
    from spanquarry.llm.arc import archive_pages

    pages = [(1, "u", "A"), (1, "u", "B"), (2, "v", "A"), (None, "u", "C"), (None, "u", "D"), (3, "w", "D"), (4, "x", "E"), (4, "y", "E"), (5, "z", "F" * 9_000_000), (6, "r", "G"), (6, "r", "G")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as size", "'d' as digest")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(df).collect()), key=str)
    assert got == sorted([(1, 1, "revisit", 2), (1, 1, "response", None), (2, 1, "response", None), (None, 1, "response", None), (None, 1, "revisit", 3), (3, 1, "response", None),
                          (4, 1, "response", None), (4, 1, "revisit", 4), (5, 9_000_000, "response", None), (6, 1, "response", None), (6, 1, "response", None)], key=str)


def test_mixture_with_clashing_columns(spark):
    from spanquarry.llm.mixing import mix

    docs = spark.createDataFrame([(i, "ab"[i > 20], i % 5 + 1) for i in range(30)], "doc_id long, source string, n long").selectExpr(
        "*", "'own' as block", "'own' as rank", "1 as epoch", "2 as epochs", "3 as tokens")
    both = mix(docs, F.col("n"), repeats=2.0, prefix="__mix_")
    assert both.where("block != 'own' or epoch != 1").isEmpty() and both.select("doc_id").distinct().count() == 30
    assert dict(mix(docs, F.col("n"), repeats=2.0).dtypes)["block"] == "bigint"


def test_unspaced_scripts_have_a_word_a_character(spark):
    from spanquarry.llm.fingerprints import likeness, order_minhash

    rng = random.Random(1)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(4000))
    pair = spark.createDataFrame([(text, text[:3000] + text[:1000], text[::-1])], "a string, b string, c string")
    for c in "abc":
        pair = order_minhash(pair, c, f"f{c}")
    near, far = pair.select(likeness("fa", "fb"), likeness("fa", "fc")).first()
    assert near > 0.3 > 0.05 > far


def test_streamed_digests_equal_whole_ones(spark):
    import hashlib

    from tokenizers import Tokenizer

    from spanquarry.llm.bpe import default_path, round_trip

    lib = Tokenizer.from_file(default_path())
    texts = [None, "", "a <|endoftext|> é漢", "thea" * 30_000, "word and 123 !? \n\n  x " * 9000, " 　 " * 50]
    got = {r.doc_id: r for r in round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_of_many_texts_are_merged_side_by_side(monkeypatch):
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from spanquarry.llm import bpe

    lib, own, rng = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.default_path()), random.Random(4)
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    texts = [" ".join(word("etaoinshrdlu", 14) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    alone, merge = [], bpe.Merges.merge
    monkeypatch.setattr(bpe.Merges, "merge", lambda m, raw: alone.append(raw) or merge(m, raw))
    ids = lambda: [np.frombuffer(b"".join(x), "<u4").tolist() for x in own.each(texts)]
    assert ids() == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert len({w for t in texts for w in t.split()}) > 2000 and not alone

    pieces = [word(a, 70).encode()[:63] for a in ("a", "ab", "thea ", "aß漢 ", "=-", "\n \t", "0123 9") for _ in range(150)]
    assert own.m.merge_each([b"", *pieces]) == [np.array(merge(own.m, p), "<u4").tobytes() for p in [b"", *pieces]]

    monkeypatch.setattr(bpe, "BLOCK", 500)  # blocks and a cache that end within texts, and words too long for the side by side
    monkeypatch.setattr(bpe, "CACHE", 2000)
    monkeypatch.setattr(bpe, "FEW", 1)
    texts = ["", *texts[:50], "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", word("xyzw", 1) * 64, "é" * 40 + " é", "漢" * 64, " ".join(texts[50:120]), ""]
    own = bpe.Encoder(bpe.default_path())
    assert ids() == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.known.held <= 3 * bpe.CACHE


def test_tables_that_are_no_longer_read_are_deleted(spark):
    from pathlib import Path

    from spanquarry.llm import line_dedup, ngram_join, shared

    def tables():
        return set(Path(shared.shared_dir(spark).removeprefix("file:")).glob("llm-table-*"))

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[a:a + 120]) for a in (0, 0, 40, 200)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = tables()
    cleaned = line_dedup.drop_repeats(docs)
    assert len(tables() - before) == 2  # the runs, and the list of ids with several texts
    assert [r.n_deleted for r in cleaned.orderBy("doc_id").collect()] == [0, 120, 80, 0, 0, 0]
    before = tables()
    groups = ngram_join.jaccard_components(docs, 5, 40, 100)
    assert len(tables() - before) == 2
    assert [r.component_id for r in groups.orderBy("doc_id").collect()] == [0, 0, 0, 3, 4, 5]
    before = tables()
    with shared.scratch(spark):
        kept = shared.components(spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a long, b long"))
        none = shared.components(spark.createDataFrame([], "a long, b long"))
        assert kept.count() == 5 and none.isEmpty()
    assert tables() == before
