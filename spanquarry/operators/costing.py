"""Prices and what calls cost."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import as_col
from spanquarry.functions.scalars import any_of, provider_of_price_name
from spanquarry.operators.versioned import pick_first

# Marks of models that are small already, and the cheaper siblings offered.
SMALL_MARKS = ["mini", "haiku", "flash", "nano", "lite", "small", "8b", "3b", "1b", "-lite"]
CHEAPER = {"claude": ("claude-haiku-4-5", 0.85), "gemini": ("gemini-2.5-flash", 0.88),
           "reasoning": ("o4-mini", 0.75), "gpt": ("gpt-4o-mini", 0.90)}
# Marks of models that are not plain chat models, and providers of chat models.
NON_CHAT_MARKS = [
    "audio", "realtime", "transcribe", "tts", "image", "embed", "moderation", "whisper", "search", "computer-use",
    "codex", "deep-research", "instruct", "guard", "native-audio", "live", "diarize", "dall", "vision", "video",
    "babbage", "davinci", "tuning", "preview",
]
CHAT_PROVIDERS = ["anthropic", "openai", "google", "moonshot"]

RATES = ["input_token_cost_per_million", "cached_input_token_cost_per_million", "output_token_cost_per_million",
         "long_context_consider_token_greater_than", "long_context_input_per_million",
         "long_context_cached_input_per_million", "long_context_output_per_million"]


def attach_price(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Price row of each call: exact modality first, else any modality, lowest id wins.

    The sheet is reduced to one row per key before the joins, so calls never multiply;
    whether the sheet is broadcast is decided from its measured size.
    """
    sheet = prices.select(
        F.lower("provider").alias("_p"), F.lower("model").alias("_m"), F.lower("modality").alias("_mod"), "id", *RATES)
    struct = F.struct("id", *RATES)
    exact = pick_first(sheet, ["_p", "_m", "_mod"], [F.col("id")]).select("_p", "_m", "_mod", struct.alias("_exact"))
    loose = pick_first(sheet, ["_p", "_m"], [F.col("id")]).select("_p", "_m", struct.alias("_any"))
    keyed = calls.withColumns({"_p": F.lower("provider"), "_m": F.lower("model"), "_mod": F.lower("modality")})
    return (
        keyed.join(exact, ["_p", "_m", "_mod"], "left").join(loose, ["_p", "_m"], "left")
        .withColumn("price", F.coalesce("_exact", "_any")).drop("_p", "_m", "_mod", "_exact", "_any")
    )


def estimate_cost(priced: DataFrame) -> DataFrame:
    """Cost of each call from its price, in exact decimals rounded half-even to 8 digits.

    Cached tokens have their own rate, long prompts have theirs, and a call without a
    price row costs null rather than nothing.
    """
    p = F.col("price")
    tokens = lambda c: F.coalesce(as_col(c), F.lit(0)).cast("decimal(12,0)")
    rate = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(16,8)")
    limit = p["long_context_consider_token_greater_than"]
    long = F.coalesce((limit != 0) & (F.col("input_tokens") > limit), F.lit(False))
    pick = lambda plain, wide: F.when(long, rate(p[wide])).otherwise(rate(p[plain]))
    billable = F.greatest(F.col("input_tokens") - F.col("cached_input_tokens"), F.lit(0))
    total = (
        tokens(billable) * pick("input_token_cost_per_million", "long_context_input_per_million")
        + tokens("cached_input_tokens") * pick("cached_input_token_cost_per_million", "long_context_cached_input_per_million")
        + tokens("output_tokens") * pick("output_token_cost_per_million", "long_context_output_per_million")
    ) * F.lit("0.000001").cast("decimal(6,6)")
    return priced.withColumns({"long_context": long, "cost_usd": F.when(p.isNotNull(), F.bround(total, 8).cast("double"))})


def _family(model) -> Column:
    m = F.lower(F.coalesce(as_col(model), F.lit("")))
    has = lambda s: F.contains(m, F.lit(s))
    return (
        F.when((m == "") | any_of([has(s) for s in SMALL_MARKS]), None)
        .when(has("sonnet") | has("opus"), "claude").when(has("gemini") & has("pro"), "gemini")
        .when(m.startswith("o1") | m.startswith("o3") | has("-o1") | has("-o3"), "reasoning")
        .when(has("gpt-4o") | has("gpt-4.1") | has("gpt-4-turbo") | m.startswith("gpt-4"), "gpt")
    )


def downgrade_hint(model) -> Column:
    """Cheaper sibling of a premium model with the share of spend it would save; null if none."""
    family, out = _family(model), None
    for k, (name, saving) in CHEAPER.items():
        hint = F.struct(F.lit(name).alias("model"), F.lit(saving).alias("savings"))
        out = F.when(family == k, hint) if out is None else out.when(family == k, hint)
    return out


def priced_models(prices: DataFrame) -> DataFrame:
    """Text models with both an input and an output price."""
    return prices.filter(
        (F.lower("modality") == "text") & F.col("input_token_cost_per_million").isNotNull()
        & F.col("output_token_cost_per_million").isNotNull())


def is_chat_model(model) -> Column:
    """Not a special-purpose model, not a legacy one, not a dated snapshot."""
    m = F.lower(as_col(model))
    return ~any_of([F.contains(m, F.lit(s)) for s in NON_CHAT_MARKS]) & ~m.startswith("gpt-3") & ~m.rlike(r"-\d{3,}")


def chat_models(prices: DataFrame) -> DataFrame:
    rows = prices.filter((F.col("modality") == "Text") & F.lower("provider").isin(CHAT_PROVIDERS) & is_chat_model("model"))
    return rows.select(F.col("model").alias("id"), provider_of_price_name("provider").alias("provider")).distinct()


def clean_price_rows(sheet: DataFrame) -> DataFrame:
    """Rows of a raw sheet that name a provider, a model and a modality."""
    for c in ("provider", "model", "modality"):
        sheet = sheet.filter(F.coalesce(F.col(c), F.lit("")) != "")
    return sheet


def load_prices(sheet: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the cleaned sheet; ``overwrite`` replaces the price table, ``append`` adds to it."""
    clean_price_rows(sheet).write.mode(mode).parquet(path)
