"""Removal of runs of words that repeat an earlier place, found by winnowing over the hashes of rolled lines.

Repeated passages stand inside the lines of a text as often as on lines of their own, so a line break is not taken as
the border of a line: every word starts a line of ``LINE`` words, and runs begin and end at any word.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanquarry.llm.shared import by_text, cut, frugal, scratch, slices, small_batches

LINE = 16  # words of a rolled line
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_PIECE = 1 << 18  # bytes or words worked on at once, a longer text alone


@lru_cache(maxsize=8)
def _powers(base: np.uint64, bits: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full((1 << bits) - 1, base))])


def _power(base: np.uint64, k: int) -> np.ndarray:
    """The first ``k`` powers; those of usual lengths are kept by the worker."""
    bits = max(k - 1, 1).bit_length()
    return (_powers(base, 19) if bits <= 19 else _powers.__wrapped__(base, bits))[:k]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _BASE
    return h ^ (h >> np.uint64(29))


def _bytes_hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of some bytes, from differences of one running polynomial over them."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)), out=total[1:])
    return _mixed((total[ends] - total[starts]) * _power(_BACK, len(raw))[starts]), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (parted by ASCII white space) of the texts, one after the other, and how many each has.

    Texts are joined by a blank; long ones are cut at blanks, so that little more than the text is held.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    whole = np.frombuffer(b" ".join(raw), np.uint8)
    hashes, starts, lo = [], [], 0
    while lo < len(whole):
        hi = lo + _PIECE
        while hi < len(whole) and whole[hi] not in b" \t\n\v\f\r":
            hi += 1
        h, at = _bytes_hashed(whole[lo:hi])
        hashes.append(h)
        starts.append(at + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def line_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words that begin at each word, from differences of one running polynomial."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(_BASE, len(words)), out=total[1:])
    return _mixed((total[size:] - total[:n]) * _power(_BACK, n))


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least item in every ``width`` consecutive ones, from minima over spans that double."""
    value, place, span = h, np.arange(len(h)), 1

    def both(step: int) -> None:
        nonlocal value, place
        first = value[:len(value) - step] <= value[step:]
        value, place = np.where(first, value[:-step], value[step:]), np.where(first, place[:-step], place[step:])

    while span * 2 <= width:
        both(span)
        span *= 2
    if width > span:
        both(width - span)
    return place


def winnow(words: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints of each of the texts whose words stand in a row: hashes and places.

    A fingerprint is the least line hash of some of the windows of ``least`` consecutive words of a text. Two texts that
    share ``least`` consecutive words share the fingerprint of that window, wherever it stands. A place is one number:
    the position of the line, how far before it the first window starts that it is the least of, and how many more there are.
    """
    size, ends = min(LINE, least), np.cumsum(counts)
    h = line_hashes(words, size)
    lines = least_places(h, least - size + 1) if len(words) >= least else np.zeros(0, np.int64)
    for end, n in zip(ends.tolist(), counts.tolist()):
        lo = end - n
        own = lines[lo:max(lo, end - least + 1)]  # windows that lie in this text
        since = np.flatnonzero(np.diff(own, prepend=-1))  # the least line never moves back from window to window
        last = np.append(since[1:], len(own))[:len(since)] - 1
        yield h[own[since]], packed(own[since] - lo, since, last)


def packed(at: np.ndarray, since: np.ndarray, until: np.ndarray) -> np.ndarray:
    return at.astype(np.int64) << 32 | (at - since) << 16 | (until - since)


def unpacked(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = places >> 32
    since = at - (places >> 16 & 0xFFFF)
    return at, since, since + (places & 0xFFFF)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of ``a`` and ``b`` are equal."""
    n, lo, step = min(len(a), len(b)), 0, 64
    while lo < n:
        differs = a[lo:lo + step][:n - lo] != b[lo:lo + step][:n - lo]
        if differs.any():
            return lo + int(differs.argmax())
        lo, step = min(n, lo + step), step * 2
    return n


def runs_of_pair(own: np.ndarray, other: np.ndarray, seeds: list[tuple[int, int]], same: bool, least: int,
                 size: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """``(first, last)`` runs of ``own`` that contain a seed ``(place, place in other)`` and agree with ``other``, and all
    stretches ``(start, end)`` of ``least`` words or more that agree.

    In the same text no window of a run may overlap the window it repeats, so seeds nearer than ``least`` give no run.
    A seed of ``size`` words is passed over once every window of ``least`` words around it is in a run, so periodic
    texts cost a few extensions.
    """
    covered, runs, met = np.zeros(len(own), bool), [], []
    for at, origin in sorted(seeds):
        if covered[max(0, at + size - least):at + least].all():
            continue
        start, end = at - _agree(own[:at][::-1], other[:origin][::-1]), at + _agree(own[at:], other[origin:])
        if end - start < least:
            continue
        met.append((start, end))
        if not same or at - origin >= least:
            covered[start:end] = True
            runs.append((start, end - 1))
    return runs, met


def unmet(since: np.ndarray, until: np.ndarray, met: list[tuple[int, int]], least: int) -> np.ndarray:
    """Starts of the windows, given as ranges ``since`` to ``until``, that lie in none of the stretches ``(start, end)``."""
    starts = lambda a, b: np.repeat(a - np.cumsum(n := b - a + 1) + n, n) + np.arange(n.sum())
    if not met:
        return starts(since, until)
    begin, end = np.array(sorted(met)).T
    end = np.maximum.accumulate(end)

    def out(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        k = np.searchsorted(begin, first, "right") - 1
        return (k < 0) | (end[k] < last + least)

    some = out(since, until)
    found = starts(since[some], until[some])
    return found[out(found, found)]


def _later_places(marks: DataFrame) -> DataFrame:
    """``doc_id, place, origin, origin_place``: every place whose mark has an earlier one, with the first that has it."""
    place = F.struct("doc_id", "place")
    # a table of its own: its size is known to the planner, and a hot mark's join is split as a skewed one
    firsts = cut(marks.groupBy("mark").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "first"))
    later = marks.join(firsts, "mark").where(place > F.col("first"))
    return later.select("doc_id", "place", F.col("first.doc_id").alias("origin"), F.col("first.place").alias("origin_place"))


def _pairs(marks: DataFrame) -> DataFrame:
    """``doc_id, origin`` pairs with the places of their common marks, of which those in ``origin`` are the first."""
    with scratch(marks.sparkSession):
        return cut(_later_places(marks).groupBy("doc_id", "origin").agg(
            F.collect_list("place").alias("places"), F.collect_list("origin_place").alias("origin_places")), keep=True)


def _with_words(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """The pairs with the words of both texts; of the other only the part that the own text can reach from a seed."""
    ids = cut(pairs.select("doc_id").unionAll(pairs.select("origin")).distinct())
    words = read.select("doc_id", "words").join(ids, "doc_id", "left_semi")
    both = pairs.join(words.toDF("doc_id", "own"), "doc_id").join(words.toDF("origin", "other"), "origin")
    line = lambda place: F.shiftright(place, 32)
    start = F.greatest(F.lit(0), line(F.array_min("origin_places")) - line(F.array_max("places")))
    length = line(F.array_max("origin_places")) + F.length("own") / 4 - start
    part = F.col("other").substr((start * 4 + 1).cast("int"), (length * 4).cast("int"))
    return both.withColumns({"same": F.col("doc_id") == F.col("origin"), "other": part, "start": start}).drop("origin")


def repeated_runs(docs: DataFrame, least: int = 50) -> DataFrame:
    """``doc_id, first, last``: runs of words (from 0, both ends included) that repeat an earlier place.

    Places are ordered by (doc_id, word). The runs are exactly the windows of ``least`` words whose first place is in an
    earlier text, or in the same text without overlap. Every fingerprint is joined with the first place that has it, and
    the match is extended both ways as long as words agree. The first place of a fingerprint may share less than a
    window: windows of a fingerprint that do not lie in such a match are joined a second time, by the hash of all their
    words, with the first place of that window; equal hashes are taken as equal windows, so no words are read for this.
    The first place is always among them, as it does not lie in a match either. A deleted word always has an equal one at an earlier place, so the first of all stays. One row a fingerprint,
    one a window without a match of a repeated fingerprint and four bytes a word are shuffled, no text; a passage that
    any number of documents share is compared with its first place only.
    """

    @frugal
    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            texts, sizes = b["text"].to_list(), np.cumsum([len(t or "") for t in b["text"]])
            for _, group in groupby(range(len(texts)), lambda i: sizes[i] // _PIECE):
                rows = list(group)
                words, counts = word_hashes([texts[i] for i in rows])
                ends = np.cumsum(counts)
                out = [(b["doc_id"].iat[i], words[end - n:end].astype("<u4").tobytes(), marks.view(np.int64), places)
                       for i, end, n, (marks, places) in zip(rows, ends, counts, winnow(words, counts, least)) if len(marks)]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "words", "marks", "places"])

    def seeds(r) -> tuple[np.ndarray, list[tuple[int, int]]]:
        return r.places, list(zip((r.places >> 32).tolist(), ((r.origin_places >> 32) - r.start).tolist()))

    @frugal
    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            out = []
            for r in b.itertuples():
                own, (places, found) = np.frombuffer(r.own, "<u4"), seeds(r)
                runs, met = runs_of_pair(own, np.frombuffer(r.other, "<u4"), found, r.same, least, min(LINE, least))
                starts = unmet(*unpacked(places)[1:], met, least)
                h = line_hashes(own[starts.min():starts.max() + least].astype(np.uint64), least)[starts - starts.min()] if len(starts) else np.zeros(0, np.uint64)
                out.append((r.doc_id, [x for x, _ in runs], [x for _, x in runs], h.view(np.int64), starts.astype(np.int64) << 32))
            yield pd.DataFrame(out, columns=["doc_id", "first", "last", "marks", "places"])

    def each(df: DataFrame, **names: str) -> DataFrame:
        return df.select("doc_id", F.explode(F.arrays_zip(*names.values())).alias("m")).select("doc_id", *[F.col(f"m.{c}").alias(n) for n, c in names.items()])

    read = cut(docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(positions, "doc_id long, words binary, marks array<long>, places array<long>"))
    with scratch(docs.sparkSession):
        pairs = _pairs(each(read, mark="marks", place="places"))
        matches = cut(_with_words(pairs, read).mapInPandas(extend, "doc_id long, first array<int>, last array<int>, marks array<long>, places array<long>"), keep=True)
    line = lambda place: F.shiftright(place, 32).cast("int")
    again = _later_places(each(matches, mark="marks", place="places")).where(
        (F.col("doc_id") != F.col("origin")) | (line("place") - line("origin_place") >= least))
    rest = again.select("doc_id", line("place").alias("first"), (line("place") + (least - 1)).alias("last"))
    return each(matches, first="first", last="last").unionAll(rest)


def without(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
    """The texts without the words of their runs; white space before what follows a run goes with it."""
    out = []
    for text, begin, until in zip(texts, firsts, lasts):
        if text is None or begin is None:
            out.append((None, 0))
            continue
        raw = text.encode("utf-8", "replace")
        starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
        parts, at, gone = [], 0, 0
        for first, last in sorted(zip(begin.tolist(), until.tolist())):
            first, end = max(first, at), min(last + 1, len(starts) - 1)
            if first < end:
                parts.append(raw[starts[at] if at else 0:starts[first]])
                at, gone = end, gone + end - first
        parts.append(raw[starts[at] if at else 0:])
        kept = b"".join(parts)
        out.append(((kept.rstrip(b" \t\n\v\f\r") if at == len(starts) - 1 else kept).decode("utf-8"), gone))
    return pd.DataFrame(out, columns=["text", "n_deleted"])


def drop_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """``docs`` without the repeated runs; adds ``n_words`` (before) and ``n_deleted``. ``n_chars``, if there, follows the text.

    Defined results: null texts stay null, a text whose words all go becomes empty, rows without a doc_id are left
    alone, other columns pass through. Rows that share doc_id and text are one text and lose the same words, none for
    the other's sake; different texts of one doc_id are texts of their own, which stand before those of other ids.
    """
    small_batches(docs.sparkSession)
    named, _ = by_text(docs)
    with scratch(docs.sparkSession):
        found = repeated_runs(named.select(F.col("__node").alias("doc_id"), "text"), least)
        runs = cut(found.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct("first", "last")).alias("__runs")), keep=True)
    joined = named.join(runs, F.col("__node") == F.col("__doc"), "left")
    has = F.col("__runs").isNotNull() & F.col("text").isNotNull()

    @F.pandas_udf("text string, n_deleted long")
    @frugal
    def cleaned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield without(*b)

    out = joined.withColumn("__cut", cleaned(F.when(has, F.col("text")), "__runs.first", "__runs.last"))
    text = F.when(has, F.col("__cut.text")).otherwise(F.col("text"))
    changed = {"text": text, "n_words": F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long"), "n_deleted": F.col("__cut.n_deleted")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(has, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(changed).drop("__node", "__doc", "__runs", "__cut")


def report(docs: DataFrame, least: int = 50) -> DataFrame:
    """``doc_id, n_words, n_deleted, text_sha256`` (of what stays) of every document."""
    return drop_repeats(docs.select("doc_id", "text"), least).select("doc_id", "n_words", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
