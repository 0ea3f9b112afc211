"""Conversations as training text with a loss mask that follows token offsets."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, OPEN_LOSS, SHUT_LOSS = "[INST]", "[/INST]", "<s>", "</s>"
#: Strings with a meaning of their own; inside a role or text a backslash parts their first character from the rest.
CONTROLS = (OPEN, SHUT, OPEN_LOSS, SHUT_LOSS, "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_CONTROL = regex.compile("|".join(map(regex.escape, CONTROLS)))
_TURN = regex.compile(r"(?:\[INST\]|<s>)(.*?)\n(.*?)(?:\[/INST\]|</s>)", regex.DOTALL)


def escape(text: str, head: bool = False) -> str:
    """Reversible: backslashes are doubled, then every control string is broken; in a role line ends become ``\\n``."""
    text = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))
    return text.replace("\n", "\\n") if head else text


def unescape(text: str, head: bool = False) -> str:
    return regex.sub(r"\\(\\|n)?" if head else r"\\(\\)?", lambda m: {None: "", "\\": "\\", "n": "\n"}[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        loss = role == "assistant"
        head, body = (OPEN_LOSS if loss else OPEN) + escape(role, True) + "\n", escape(text)
        if loss:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, SHUT_LOSS if loss else SHUT]
        at += len(head) + len(body) + len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1], True), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """``(token, start, end)`` of what every token shares with the spans; both are sorted, so two binary searches a span
    find its tokens. A token across a border keeps its part; of tokens that share a character the last one has it."""
    out = []
    for lo, hi in spans:
        if lo == hi:
            continue
        first, last = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left"))
        s, e = np.maximum(starts[first:last], lo), np.minimum(ends[first:last], hi)
        e[:-1] = np.minimum(e[:-1], s[1:])
        out += [(first + n, int(a), int(b)) for n, (a, b) in enumerate(zip(s, e)) if a < b]
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def format_chats(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row a conversation: ``conv_id, formatted, tokens`` and, aligned, ``loss_token, loss_start, loss_end``.

    The whole conversation is rendered, encoded once with offsets, and the assistant spans are intersected with the
    token spans. Turns follow ``turn`` (nulls first), ties follow role and text; null roles and texts count as empty;
    rows without a conv_id form one conversation. Only a conversation's own turns are gathered, since it is one row.
    """
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _tokenizer(path or default_path())
        for b in batches:
            for lo in range(0, len(b), 64):  # tokens of a few conversations at a time
                rows = []
                for conv, ts in b.iloc[lo:lo + 64].itertuples(index=False):
                    text, own = render([(t["role"], t["text"]) for t in ts])
                    coded = coder.encode(text, add_special_tokens=False)
                    at = np.array(coded.offsets, np.int64).reshape(-1, 2)
                    kept = np.array(mask(own, at[:, 0], at[:, 1]), np.int32).reshape(-1, 3)
                    rows.append((conv, text, np.array(coded.ids, np.int32), *kept.T))
                yield pd.DataFrame(rows, columns=["conv_id", "formatted", "tokens", "loss_token", "loss_start", "loss_end"])

    named = grouped.withColumn("conv_id", F.col("conv_id").cast("string"))  # a null would make the batch's ids floats
    chats = named.mapInPandas(formatted, "conv_id string, formatted string, tokens array<int>, loss_token array<int>, loss_start array<int>, loss_end array<int>")
    return chats.withColumn("conv_id", F.col("conv_id").cast("long"))


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what formatted conversations say: turns, and the text under the loss mask with escapes undone."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for b in batches:
            rows = []
            for conv, text, starts, ends in b.itertuples(index=False):
                turns = parse(text)
                under = unescape("".join(text[x:y] for x, y in zip(starts, ends)))
                rows.append((conv, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(under), sha256(under.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    named = chats.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss_start", "loss_end")
    return named.mapInPandas(
        digests, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumn("conv_id", F.col("conv_id").cast("long"))
