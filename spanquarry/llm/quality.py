"""Document quality by attention-based multiple-instance learning over passages."""
from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanquarry.llm.shared import frugal, slices, small_batches

PASSAGE = 512  # bytes of UTF-8 in a passage
HIDDEN, GATE = 24, 12
_SLICE = 1 << 18  # bytes that are encoded at once

_CLASSES = 20
_CLASS_OF = np.full(256, 1, np.int64)
for _n, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",", b"!", b"?", b"'\"", b"()[]", b"{}<>", b"|", b"$", b"%", b"&#*", b":;/", bytes(range(128, 256)))):
    _CLASS_OF[list(_chars)] = _n + 2
FEATURES = _CLASSES * _CLASSES + 4


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encode every passage of the texts: root frequencies of neighbouring byte classes, mean word length, passage
    length, share of words that repeat the word before, and share of words that stand elsewhere in the passage.

    Returns the features (one row a passage) and how many passages each text has; an empty text has one, of zeros.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(counts) - counts
    offset = np.arange(raw.size, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.repeat(starts, lengths) + offset // PASSAGE
    kind = _CLASS_OF[raw]
    before = np.where(offset > 0, np.concatenate([[0], kind[:-1]]) if raw.size else kind, 0)
    n = int(counts.sum())
    pairs = np.bincount(place * _CLASSES**2 + before * _CLASSES + kind, minlength=n * _CLASSES**2).reshape(n, -1)
    size = np.maximum(pairs.sum(1, keepdims=True), 1)
    blank = np.isin(kind, (5, 6))
    words = np.bincount(place[blank], minlength=n) + 1
    rows = np.empty((n, FEATURES), np.float32)
    rows[:, :-4] = np.sqrt(pairs / size)
    rows[:, -4] = np.log1p(size[:, 0] / words) / 4
    rows[:, -3] = np.minimum(size[:, 0] / PASSAGE, 1)
    rows[:, -2:] = [_repeats(t[lo:lo + PASSAGE].split()) for t in texts for lo in range(0, max(len(t), 1), PASSAGE)]
    return rows, counts


def _repeats(words: list[bytes]) -> tuple[float, float]:
    n = max(len(words), 1)
    return sum(map(eq, words, words[1:])) / n, 1 - len(set(words)) / n


class GatedAttention:
    """h = tanh(W x); weight = softmax over a document of w.(tanh(V h) * sigmoid(U h)); score = sigmoid(c.sum(weight h) + b)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = weights

    @classmethod
    def fresh(cls, seed: int) -> GatedAttention:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        return cls({"W": draw(FEATURES, HIDDEN) * 3, "d": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
                    "w": draw(GATE), "c": draw(HIDDEN), "b": np.zeros(1)})

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["W"] + self.p["d"])

    def pooled(self, h: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """The weighted passage representation of each document and what its gradient needs."""
        at = np.cumsum(counts) - counts
        t, g = np.tanh(h @ self.p["V"]), 1 / (1 + np.exp(-(h @ self.p["U"])))
        e = (t * g) @ self.p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        a /= np.repeat(np.add.reduceat(a, at), counts)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"t": t, "g": g, "a": a, "z": z, "at": at, "logit": z @ self.p["c"] + self.p["b"][0]}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.01, decay: float = 1e-4, batch: int = 128, seed: int = 0) -> None:
        """Adam on the log loss of document labels, minibatches of whole documents."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        ends = np.cumsum(counts)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                docs = order[lo:lo + batch]
                rows = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in docs])
                grads, step = self.gradients(x[rows].astype(np.float64), counts[docs], y[docs]), step + 1
                for k, q in self.p.items():
                    gk = grads[k] + decay * q
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk * gk
                    q -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, self.hidden(x)
        o = self.pooled(h, counts)
        err = (1 / (1 + np.exp(-o["logit"])) - y) / len(y)
        dz = np.repeat(err[:, None] * p["c"], counts, axis=0)
        da = (dz * h).sum(1)
        de = o["a"] * (da - np.repeat(np.add.reduceat(o["a"] * da, o["at"]), counts))
        dt = de[:, None] * p["w"] * o["g"] * (1 - o["t"] ** 2)
        dg = de[:, None] * p["w"] * o["t"] * o["g"] * (1 - o["g"])
        dpre = (o["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dpre, "d": dpre.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (o["t"] * o["g"]).T @ de, "c": o["z"].T @ err, "b": np.array([err.sum()])}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts; passages are encoded a slice at a time, only their short hidden rows are kept."""
        hs, counts, chunk, held = [], np.zeros(len(texts), np.int64), [], 0

        def flush():
            nonlocal chunk, held
            if chunk:
                x, n = passages([t for _, t in chunk])
                hs.append(self.hidden(x))
                for (i, _), k in zip(chunk, n):
                    counts[i] += k
            chunk, held = [], 0

        for i, t in enumerate(texts):
            for lo in range(0, max(len(t), 1), _SLICE):  # a multiple of PASSAGE
                chunk.append((i, t[lo:lo + _SLICE]))
                held += len(chunk[-1][1])
                if held >= _SLICE:
                    flush()
        flush()
        return 1 / (1 + np.exp(-self.pooled(np.concatenate(hs), counts)["logit"])) if len(texts) else np.zeros(0)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, budget: int = 60_000, epochs: int = 25, seed: int = 7) -> GatedAttention | float:
    """Fit on at most ``sample`` labelled documents outside the held-out fold (least hashes of their ids).

    Of every one of them all passages are used; documents are taken in the order of their hashes as long as the passages
    stay within ``budget`` (one is always taken), and a document that is too long for what is left is passed over whole.
    ``sample`` and ``budget`` bound what reaches the driver. Rows that share doc_id and text are one document; of a
    doc_id with several labels the lower one holds. With labels of one class only, or none, the result is their mean,
    or 0.5.
    """
    small_batches(docs.sparkSession)
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
    sizes = (texts.join(F.broadcast(known), "doc_id").select("doc_id", "__h", "quality", F.ceil(F.octet_length("text") / PASSAGE).alias("n"))
             .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "__h").limit(sample).collect())
    taken, used = [], 0
    for r in sizes:
        if not taken or used + max(r["n"], 1) <= budget:
            taken.append((r["doc_id"], r["__h"], r["quality"]))
            used += max(r["n"], 1)
    taken = docs.sparkSession.createDataFrame(taken, "doc_id long, __h long, quality int")
    bags = texts.join(F.broadcast(taken), ["doc_id", "__h"]).groupBy("doc_id", "__h", "quality").agg(F.first("text").alias("text")).select("quality", "text")

    @frugal
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, 64):
            out = []
            for text in b["text"]:
                raw = text.encode("utf-8", "replace")
                parts = [passages([raw[lo:lo + _SLICE]])[0].astype(np.float16).tobytes() for lo in range(0, max(len(raw), 1), _SLICE)]
                out.append(b"".join(parts))
            yield pd.DataFrame({"quality": b["quality"], "x": out})

    found = bags.mapInPandas(encode, "quality int, x binary").toPandas()
    y = found["quality"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    bags_x = [np.frombuffer(x, np.float16).reshape(-1, FEATURES) for x in found["x"]]
    order = sorted(range(len(y)), key=lambda i: (found["x"][i], y[i]))  # the order of arrival must not matter
    bags_x, y = [bags_x[i] for i in order], y[order]
    model = GatedAttention.fresh(seed)
    model.p["b"][0] = np.log(y.mean() / (1 - y.mean()))
    model.fit(np.concatenate(bags_x), np.array([len(x) for x in bags_x]), y, epochs, seed=seed)
    return model


def score(docs: DataFrame, model: GatedAttention | float, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out`` (0 to 1) to every row, computed from the whole text alone; null texts score as empty ones."""
    small_batches(docs.sparkSession)
    weights = None if isinstance(model, float) else model.p
    if weights is None:
        return docs.withColumn(out, F.lit(model))

    @F.pandas_udf("double")
    @frugal
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = GatedAttention(weights)
        for texts in batches:
            parts = [net.scores([(t or "").encode("utf-8", "replace") for t in texts.iloc[lo:lo + 512]]) for lo in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, scored(F.col(text)))


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Defined results: null and empty texts get the score of a text without words, rows without a doc_id are scored and not
    held out, rows that repeat are scored each, other columns are ignored, an empty table gives no rows.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **how))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
