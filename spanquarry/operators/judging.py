"""Scores from supplied callables, prompt chains, and checks written as expressions."""
from __future__ import annotations

import difflib
import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanquarry.functions.common import as_col
from spanquarry.functions.scalars import reply_json, reply_score, substitute, with_contract

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Metrics a single judge call can grade.
SUPPORTED_METRICS = ["hallucination", "faithfulness", "relevance", "toxicity", "coherence", "completeness", "context_precision"]


def _call(df: DataFrame, prompt: str, fn: Callable[[str], str], out: str, error: str) -> DataFrame:
    """Apply ``fn`` to a text column, Arrow batch by batch; a raised error becomes text."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies, errors = [], []
            for text in pdf[prompt]:
                try:
                    replies.append(fn(text))
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - one failed call must not end the job
                    replies.append(None)
                    errors.append(str(exc) or type(exc).__name__)
            yield pdf.assign(**{out: pd.Series(replies, index=pdf.index, dtype=object), error: pd.Series(errors, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)


def judge(df: DataFrame, templates: dict[str, str], scorer: Callable[[str], str], keys: Sequence[str],
          known: Sequence[str] | None = None) -> DataFrame:
    """One score row per (row, metric): render, ask ``scorer``, parse, clamp.

    ``df`` has ``question``, ``answer`` and ``context``; a failed call is an error row
    with score 0, and metrics outside ``known`` are skipped.  Only the scorer itself
    runs in Python; the number of parallel calls is the number of partitions.
    """
    wanted = {m: t for m, t in templates.items() if (known is None or m in known) and t.strip()}
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), with_contract(F.lit(t)).alias("template")) for m, t in wanted.items()])
    context = F.coalesce(F.nullif("context", F.lit("")), "question")
    values = F.create_map(F.lit("question"), F.col("question"), F.lit("answer"), F.col("answer"), F.lit("context"), context)
    rows = df.withColumn("_values", values).select(*keys, "_values", F.inline(metrics)).select(
        *keys, "metric", substitute("template", "_values").alias("prompt"))
    replied = _call(rows, "prompt", scorer, "reply", "failure")
    parsed = replied.withColumn("_json", reply_json("reply"))
    failed = F.col("failure").isNotNull() | F.col("_json").isNull()
    return parsed.select(
        *keys, "metric", F.when(F.col("failure").isNotNull(), 0.0).otherwise(reply_score("_json")).alias("score"),
        F.when(F.col("failure").isNotNull(), F.concat(F.lit("judge error: "), "failure")).otherwise(
            F.coalesce(F.try_variant_get("_json", "$.reason", "string"), F.lit(""))).alias("reason"),
        F.coalesce(failed & F.col("failure").isNotNull(), F.lit(False)).alias("error"))


def run_chain(df: DataFrame, steps: Sequence[str], model: Callable[[str], str], values: str = "values") -> DataFrame:
    """A chain of prompts; each step sees ``previous`` and ``step_n``, errors stop only their row.

    ``values`` is a string map.  Adds ``output``, ``transcript`` and ``gen_error``.
    """
    rows = df.withColumns({"output": F.lit(None).cast("string"), "transcript": F.lit(""), "gen_error": F.lit(None).cast("string")})
    for i, template in enumerate(steps, 1):
        prompt = F.when(F.col("gen_error").isNull(), substitute(F.lit(template), values))
        guarded = lambda text, model=model: None if text is None else model(text)
        rows = _call(rows.withColumn("_prompt", prompt), "_prompt", guarded, "_reply", "_failure")
        live = F.col("gen_error").isNull() & F.col("_failure").isNull()
        extra = F.create_map(F.lit("previous"), F.coalesce("_reply", F.lit("")), F.lit(f"step_{i}"), F.coalesce("_reply", F.lit("")))
        names = ["previous", f"step_{i}"]
        rows = rows.withColumns({
            "transcript": F.when(F.col("_prompt").isNotNull(), F.concat_ws("\n\n", F.nullif("transcript", F.lit("")), F.concat(F.lit(f"[step {i}] "), "_prompt"))).otherwise(F.col("transcript")),
            values: F.map_concat(F.map_filter(F.col(values), lambda k, _: ~k.isin(names)), extra),
            "output": F.when(live, F.col("_reply")), "gen_error": F.coalesce("gen_error", "_failure"),
        }).drop("_prompt", "_reply", "_failure")
    return rows


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two texts, 0..1."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def contains(text, needle, case_sensitive: bool = False) -> Column:
    t, n = as_col(text), needle if isinstance(needle, Column) else F.lit(needle)
    return F.contains(t, n) if case_sensitive else F.contains(F.lower(t), F.lower(n))


def matches(text, pattern: str) -> Column:
    return as_col(text).rlike(f"(?s){pattern}")


def find_all(text, pattern: str) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(f"(?s){pattern}"), F.lit(0))


def is_json(text) -> Column:
    return F.try_parse_json(as_col(text)).isNotNull()


def word_count(text) -> Column:
    words = F.split(F.trim(F.regexp_replace(as_col(text), r"\s+", " ")), " ")
    return F.size(F.filter(words, lambda w: w != ""))


def clamp(value, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(as_col(value), F.lit(high)))


def score_checks(df: DataFrame, checks: dict[str, Column | str], keys: Sequence[str]) -> DataFrame:
    """User checks as score rows: a boolean is 1 or 0, a number must lie in 0..1, else an error.

    A check is a Column or Spark SQL text over ``output, expected, input, metadata``.
    """
    entries = []
    for name, check in checks.items():
        column = F.expr(check) if isinstance(check, str) else check
        kind = df.select(column.alias("_c")).schema["_c"].dataType
        usable = isinstance(kind, (T.BooleanType, T.NumericType))
        value = column.cast("double") if usable else F.lit(None).cast("double")
        fine = value.between(0.0, 1.0)
        entries.append(F.struct(
            F.lit(name).alias("metric"), F.when(fine, value).alias("score"),
            F.when(~F.coalesce(fine, F.lit(False)), F.lit("must return a number between 0 and 1, or true / false")).alias("error")))
    return df.select(*keys, F.inline(F.array(*entries)))
