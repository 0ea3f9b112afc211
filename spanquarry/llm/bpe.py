"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

The merge list gives a lookahead that suffices: a token whose end lies that many bytes before the end of what has been
read cannot change any more. The transducer reads pieces of text, emits every stable token and keeps the rest. Words
shorter than that are stable at their end only; those of many texts are merged side by side, a merge of each in one step.
"""
from __future__ import annotations

import codecs
import heapq
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, groupby, islice, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanquarry.llm.shared import frugal, small_batches

#: Fixed value: the pattern by which the public vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENT = 1 << 16  # characters split at once
CACHE = 1 << 22  # bytes of words and ids a coder remembers
BLOCK = 1 << 18  # characters of segments whose words are looked up together
SHORT = 64  # bytes below which words are merged side by side
FEW = 512  # words from which that takes less time than one word after the other
_TOKEN = 24
_MADE = (1 << _TOKEN) - 1
_NEVER = np.iinfo(np.int32).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 characters stand for themselves, the others for 256 onward."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Merges:
    """Token bytes, merge ranks and the sufficient lookahead of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1 and i not in self.special.values()}
        self.rank: dict[tuple[int, int], int] = {}  # rank above, made token in the low _TOKEN bits
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), n << _TOKEN | vocab[a + b])
        self.lookahead = self._lookahead()
        ranked, pairs = np.array([*self.rank.values()], np.int64), np.array([*self.rank], np.int64).reshape(-1, 2)
        keys, ranks = pairs[:, 0] << _TOKEN | pairs[:, 1], ranked >> _TOKEN
        order = keys.argsort()
        self.keys = np.append(keys[order], -1)  # pairs in order, for many at once
        self.ranks = np.append(ranks[order], _NEVER).astype(np.int32)
        self.made = np.zeros(ranks.max(initial=0) + 1, np.int32)
        self.made[ranks] = ranked & _MADE
        self.single = np.array([self.of_byte.get(b, -1) for b in range(256)], np.int32)
        self.first = self.ranks_of(self.single[:, None].repeat(256, 1), self.single[None].repeat(256, 0))

    def _lookahead(self) -> int:
        """Bytes after which nothing further right can move a token's end.

        New text on the right can take a token away from the merge it took part in; what then stands alone can only
        enter merges of a later rank, which may disturb the next token to the left, and so on. Going through the
        ranks from the last to the first gives, for every merge, how many bytes such a chain can reach to the left.
        """
        length = {i: len(b) for i, b in self.bytes_of.items()}
        from_right: dict[int, int] = {}  # reach of later merges with this token as right part, that part's left neighbour included
        from_left: dict[int, int] = {}
        most = 0
        for (a, b), ranked in sorted(self.rank.items(), key=lambda x: -x[1]):
            made = ranked & _MADE
            reach = max(max(d.get(t, 0) for t in (a, b, made)) for d in (from_right, from_left))
            from_right[b] = max(from_right.get(b, 0), reach + length[a])
            from_left[a] = max(from_left.get(a, 0), reach)
            most = max(most, reach + length[made])
        return most + max(length.values())

    def merge(self, raw: bytes) -> list[int]:
        """Token ids of one piece, merging the pair of least rank first, leftmost first."""
        ids = [self.of_byte[b] for b in raw]
        rank, n = self.rank, len(ids)
        if n < 64:
            get, never = rank.get, 1 << 62
            ranks = [get(p, never) for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) != never:
                i = ranks.index(best)
                ids[i] = best & _MADE
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), never)
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), never)
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank[p], i, p[0], p[1]) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = rank[a, b] & _MADE, False
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in rank:
                    heapq.heappush(heap, (rank[p], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in rank:
                heapq.heappush(heap, (rank[p], h, *p))
        return [t for t, x in zip(ids, alive) if x]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, ``_NEVER`` for those that do not merge."""
        key = a.astype(np.int64) << _TOKEN | b
        at = self.keys[:-1].searchsorted(key)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def merge_each(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces below ``SHORT`` bytes: what :meth:`merge` gives for each.

        Pieces are the rows of a matrix, one of a kind for similar lengths. A step merges the pair of least rank of every
        row, leftmost first, and looks up the two pairs that are new; rows without a pair to merge leave.
        """
        out, sizes, low = [b""] * len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces)), 0
        pad = bytes([next(iter(self.of_byte))])
        for high in (8, 11, 16, 32, SHORT):
            rows = ((sizes > low) & (sizes <= high)).nonzero()[0]
            low = high
            if not len(rows):
                continue
            left = sizes[rows]  # tokens of each row; what stands behind them is never read
            width = int(left.max())
            raw = np.frombuffer(b"".join([pieces[i].ljust(width, pad) for i in rows.tolist()]), np.uint8).reshape(-1, width)
            ids, ranks = self.single[raw], np.full(raw.shape, _NEVER, np.int32)
            if ids.min() < 0:
                raise KeyError("a byte without a token")
            ranks[:, :-1] = self.first[raw[:, :-1], raw[:, 1:]]
            ranks[np.arange(1, width + 1) >= left[:, None]] = _NEVER
            while True:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                on = best != _NEVER
                if not on.all():
                    packed, step = ids[~on].astype("<u4").tobytes(), 4 * width
                    for n, (i, size) in enumerate(zip(rows[~on].tolist(), left[~on].tolist())):
                        out[i] = packed[n * step:n * step + 4 * size]
                    if not on.any():
                        break
                    rows, left, ids, ranks, at, best = (x[on] for x in (rows, left, ids, ranks, at, best))
                every, made, keep = np.arange(len(rows)), self.made[best], np.ones(ids.shape, bool)
                width, left = width - 1, left - 1
                keep[every, at + 1] = False
                ids = ids[keep].reshape(-1, width)
                ids[every, at] = made
                keep[every, at + 1], keep[every, at] = True, False
                ranks = ranks[keep].reshape(-1, width)
                ranks[every, at] = _NEVER
                row = at.nonzero()[0]
                ranks[row, at[row] - 1] = self.ranks_of(ids[row, at[row] - 1], made[row])
                row = (at + 1 < left).nonzero()[0]
                ranks[row, at[row]] = self.ranks_of(made[row], ids[row, at[row] + 1])
        return out


@lru_cache(maxsize=1)
def merges(path: str) -> Merges:
    """The vocabulary of a task; a worker forgets it between tasks (:func:`digests`)."""
    return Merges(path)


class _Known(dict):
    """Packed ids of words seen; starts anew before a block when it holds ``CACHE`` bytes, within one at twice that."""

    def __init__(self, coder: Encoder):
        super().__init__()
        self.coder, self.held = coder, 0

    def __missing__(self, word: str) -> bytes:
        packed = self.coder.word(word)
        if len(word) <= 64:
            self.start_anew(2 * CACHE)
            self.keep(word, packed)
        return packed

    def start_anew(self, size: int) -> None:
        if self.held >= size:
            self.clear()
            self.held = 0

    def keep(self, word: str, packed: bytes) -> None:
        self[word] = packed
        self.held += 4 * len(word) + len(packed)

    def meet(self, words: Iterable[str]) -> None:
        """Learn the short words of a block together; others, and those of an endless segment, when they are asked for."""
        self.start_anew(CACHE)
        new = [w for w in set(islice(words, 2 * BLOCK)).difference(self) if len(w) < SHORT]
        if len(new) < FEW:
            return
        raw = [w.encode("utf-8", "replace") for w in new]
        short = [n for n, r in enumerate(raw) if len(r) < SHORT]
        for n, packed in zip(short, self.coder.m.merge_each([raw[n] for n in short])):
            self.keep(new[n], packed)


class Encoder:
    """Text in, packed ids (little-endian unsigned 32-bit) out; holds a bounded cache and a bounded buffer."""

    def __init__(self, path: str):
        self.m = merges(path)
        self.find = regex.compile(PATTERN).findall
        self.border = regex.compile(r"(?<=\S)\s").search
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.m.special, key=len, reverse=True))) or r"(?!)")
        self.known = _Known(self)

    def word(self, word: str) -> bytes:
        return b"".join(self.stream([word.encode("utf-8", "replace")]))

    def stream(self, pieces: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of one unsplit stretch of bytes that comes in pieces; a token leaves when the lookahead has passed it."""
        ahead, held = self.m.lookahead, b""
        for piece in pieces:
            for lo in range(0, len(piece), 2 * ahead):
                held += piece[lo:lo + 2 * ahead]
                if len(held) >= 3 * ahead:
                    ids, done, size = [], 0, len(held) - ahead
                    for t in self.m.merge(held):
                        if done + len(self.m.bytes_of[t]) > size:
                            break
                        ids.append(t)
                        done += len(self.m.bytes_of[t])
                    held = held[done:]
                    yield struct.pack(f"<{len(ids)}I", *ids)
        ids = self.m.merge(held)
        yield struct.pack(f"<{len(ids)}I", *ids)

    def segments(self, text: str) -> Iterator[str]:
        """Cut before white space that follows something else, where the pattern always ends a word."""
        lo = 0
        while len(text) - lo > SEGMENT:
            cut = self.border(text, lo + SEGMENT - 1)
            hi = cut.start() if cut else len(text)
            yield text[lo:hi]
            lo = hi
        yield text[lo:]

    def read(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """Number of the text and packed ids of one stretch after the other; every text has one at least."""
        block, held = [], 0
        for n, text in enumerate(texts):
            at = 0
            for stop in [*self.special.finditer(text), None]:
                for part in self.segments(text[at:stop.start() if stop else len(text)]):
                    block.append((n, self.find(part), b""))
                    held += len(part) + 1
                    if held >= BLOCK:
                        yield from self.leave(block)
                        block, held = [], 0
                if stop:
                    block.append((n, [], np.array([self.m.special[stop[0]]], "<u4").tobytes()))
                    at = stop.end()
        yield from self.leave(block)

    def leave(self, block: list[tuple[int, list[str], bytes]]) -> Iterator[tuple[int, bytes]]:
        self.known.meet(chain.from_iterable(words for _, words, _ in block))
        known = self.known.__getitem__
        for n, words, end in block:
            yield n, b"".join(map(known, words)) + end

    def each(self, texts: Iterable[str]) -> Iterator[Iterator[bytes]]:
        """The stretches of one text after the other, to be read in this order."""
        for _, stretches in groupby(self.read(texts), itemgetter(0)):
            yield map(itemgetter(1), stretches)

    def encode(self, text: str) -> Iterator[bytes]:
        yield from next(self.each([text]))


class Decoder:
    """Packed ids in, text out; a character that is split over tokens waits for its last byte, wrong bytes give U+FFFD."""

    def __init__(self, path: str):
        self.get = merges(path).bytes_of.get

    def start(self) -> codecs.IncrementalDecoder:
        return codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, state: codecs.IncrementalDecoder, packed: bytes) -> str:
        """What is certain of the text after the next ids."""
        return state.decode(b"".join(map(self.get, np.frombuffer(packed, "<u4").tolist(), repeat(b""))))

    def decode(self, packed: bytes, step: int = 1 << 16) -> Iterator[str]:
        state = self.start()
        for lo in range(0, len(packed), 4 * step):
            yield self.feed(state, packed[lo:lo + 4 * step])
        yield state.decode(b"", True)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``ids``: the whole text's token ids as packed little-endian unsigned 32-bit numbers.

    Null texts encode as empty ones. Rows are independent, so nothing is shuffled; a text is split in segments and a
    word longer than the lookahead streams through its buffer, so memory beside the row itself is bounded.
    """

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Encoder(path or default_path())
        for texts in batches:
            yield pd.Series([*map(b"".join, coder.each(t or "" for t in texts))], dtype=object)

    return df.withColumn(ids, encoded(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``out``: the text of packed ids; null ids give an empty text, unknown ids nothing."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Decoder(path or default_path())
        for packed in batches:
            yield pd.Series(["".join(coder.decode(p or b"")) for p in packed], dtype=object)

    return df.withColumn(out, decoded(F.col(ids)))


def transcode(df: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded", path: str | None = None, rows: int = 256) -> DataFrame:
    """Add ``ids`` and ``out`` as :func:`encode` and then :func:`decode` do, in one Python worker a task.

    Results leave ``rows`` at a time, so a worker holds one input batch and the coded form of few texts.
    """

    @F.pandas_udf("ids binary, decoded string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder, reader = Encoder(path or default_path()), Decoder(path or default_path())
        for texts in batches:
            for lo in range(0, len(texts), rows):
                packed = [*map(b"".join, coder.each(t or "" for t in texts.iloc[lo:lo + rows]))]
                yield pd.DataFrame({"ids": pd.Series(packed, dtype=object), "decoded": pd.Series(["".join(reader.decode(p)) for p in packed], dtype=object)})

    small_batches(df.sparkSession)
    both = df.withColumn("__coded", coded(F.coalesce(F.col(text), F.lit(""))))
    return both.withColumns({ids: F.col("__coded.ids"), out: F.col("__coded.decoded")}).drop("__coded")


def digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Add ``n_tokens, ids_sha256, decoded_sha256`` of every whole text, coded and decoded in one pass.

    Tokens leave the transducer as soon as they are stable, go into the digest of the ids and through the decoder into
    the digest of the decoded text, and are forgotten: beside the text, memory does not grow with it. Null texts count
    as empty ones.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    @frugal
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder, reader = Encoder(path or default_path()), Decoder(path or default_path())

        def row(stretches: Iterator[bytes]) -> tuple[int, str, str]:
            n, ids, out, state = 0, sha256(), sha256(), reader.start()
            for packed in stretches:
                n += len(packed) // 4
                ids.update(packed)
                out.update(reader.feed(state, packed).encode())
            out.update(state.decode(b"", True).encode())
            return n, ids.hexdigest(), out.hexdigest()

        for texts in batches:
            yield pd.DataFrame([*map(row, coder.each(t or "" for t in texts))], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        merges.cache_clear()

    small_batches(df.sparkSession)
    both = df.withColumn("__coded", coded(F.coalesce(F.col(text), F.lit(""))))
    return both.withColumns({c: F.col(f"__coded.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("__coded")


def n_tokens(ids: str = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    return digests(docs.select("doc_id", "text"), path=path).drop("text")
