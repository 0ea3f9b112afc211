"""Scalar expressions over events, prompts, tags, scores and names."""
from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from spanquarry.functions.common import as_col, bind, lookup, strip

# Tag shape.
TAG_PATTERN = r"^[a-z0-9][a-z0-9._\-/]{0,62}$"
# Prefixes that producers put before a metric name.
METRIC_PREFIXES = ["ragas.", "auto.", "ragas_"]
# Fixed values: {{name}}, ${name} and $name.
PLACEHOLDER = r"\{\{\s*\w+\s*\}\}|\$\{\w+\}|\$\w+"
OUTPUT_CONTRACT = '\n\nReturn ONLY a JSON object: {"score": <float between 0 and 1>, "reason": "<short explanation>"}'
BULLET = "•"
ELLIPSIS = "…"

# Model prefix to provider.
PROVIDER_PREFIXES = {
    "gpt": "openai", "o1": "openai", "o3": "openai", "o4": "openai", "chatgpt": "openai",
    "claude": "anthropic", "gemini": "gemini",
    "mistral": "mistral", "magistral": "mistral", "codestral": "mistral", "ministral": "mistral",
    "groq/": "groq", "together/": "together", "accounts/fireworks": "fireworks", "sonar": "perplexity",
    "grok": "xai", "cerebras/": "cerebras", "deepseek": "deepseek", "kimi": "moonshot", "moonshot": "moonshot",
    "glm": "zai",
}
# Other accepted spellings of a provider.
PROVIDER_ALIASES = {
    "gpt": "openai", "claude": "anthropic", "google": "gemini", "togetherai": "together", "sonar": "perplexity",
    "pplx": "perplexity", "grok": "xai", "kimi": "moonshot", "z.ai": "zai", "glm": "zai", "zhipu": "zai",
    "bigmodel": "zai", "aws": "bedrock", "azure": "azure_openai", "vertexai": "vertex",
    "workers-ai": "cloudflare", "ai-gateway": "vercel",
}
# Provider to its name on the price sheet; the first provider of a name owns it.
PRICE_NAMES = {
    "openai": "OpenAI", "anthropic": "Anthropic", "gemini": "Google", "mistral": "Mistral", "groq": "Groq",
    "together": "Together", "fireworks": "Fireworks", "perplexity": "Perplexity", "xai": "xAI",
    "cerebras": "Cerebras", "deepseek": "DeepSeek", "moonshot": "Moonshot", "zai": "Z.AI",
    "azure_openai": "OpenAI", "vertex": "Google",
}
# Providers without a price sheet.
UNPRICED = ["bedrock", "databricks", "cloudflare", "openrouter", "vercel", "baseten", "deepinfra", "sambanova",
            "nebius", "novita", "hyperbolic"]


def json_field(event, path: str, kind: str = "string", default=None) -> Column:
    """Typed read of a JSON path, null on a type mismatch; ``event`` is a variant column."""
    value = F.try_variant_get(as_col(event), path, kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def preview(text, limit: int | None = None) -> Column:
    """Stripped text, whole unless a ``limit`` is given, then cut with an ellipsis; null when blank."""
    if limit is None:
        return F.nullif(strip(text), F.lit(""))
    cut = lambda s: F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit(ELLIPSIS))).when(F.length(s) > 0, s)
    return bind(strip(text), cut)


def normalize_metric(metric) -> Column:
    m = F.lower(F.coalesce(as_col(metric), F.lit("")))
    out = None
    for p in METRIC_PREFIXES:
        rest = F.substring(m, F.lit(len(p) + 1), F.length(m))
        out = F.when(m.startswith(p), rest) if out is None else out.when(m.startswith(p), rest)
    return out.otherwise(m)


def normalize_tags(tags, most: int | None = None) -> Column:
    """Lower-case, trimmed, well-formed, distinct in order; all of them, or the first ``most``."""
    clean = F.transform(F.coalesce(as_col(tags), F.array().cast("array<string>")),
                        lambda t: F.lower(strip(F.coalesce(t, F.lit("")))))
    kept = F.array_distinct(F.filter(clean, lambda t: t.rlike(TAG_PATTERN)))
    return kept if most is None else F.slice(kept, 1, most)


def placeholders(template) -> Column:
    """Names referenced by a template, in order of appearance."""
    found = F.regexp_extract_all(as_col(template), F.lit(f"(?U){PLACEHOLDER}"), F.lit(0))
    return F.transform(found, lambda p: F.regexp_replace(p, r"(?U)[{}$\s]", ""))


def substitute(template, values) -> Column:
    """Fill placeholders from a string map in one pass; unknown names stay as written.

    The text is cut at the placeholders, so an inserted value is never scanned again.
    """
    t = as_col(template)
    found = F.regexp_extract_all(t, F.lit(f"(?U){PLACEHOLDER}"), F.lit(0))
    literal = F.split(t, f"(?U){PLACEHOLDER}", -1)

    def piece(text: Column, i: Column) -> Column:
        mark = F.get(found, i)
        value = F.try_element_at(as_col(values), F.regexp_replace(mark, r"(?U)[{}$\s]", ""))
        return F.concat(text, F.coalesce(value, mark, F.lit("")))

    return F.array_join(F.transform(literal, piece), "")


def provider_for_model(model) -> Column:
    """Provider that serves a model id: the longest matching prefix."""
    m = F.lower(strip(model))
    out = None
    for prefix, provider in sorted(PROVIDER_PREFIXES.items(), key=lambda kv: -len(kv[0])):
        cond = m.startswith(prefix)
        out = F.when(cond, provider) if out is None else out.when(cond, provider)
    return out


def normalize_provider(name) -> Column:
    n = F.lower(strip(name))
    known = {p: p for p in [*PRICE_NAMES, *UNPRICED]}
    return lookup({**known, **PROVIDER_ALIASES}, n)


def price_name(provider) -> Column:
    return lookup(PRICE_NAMES, as_col(provider))


def provider_of_price_name(name) -> Column:
    first: dict[str, str] = {}
    for provider, sheet in PRICE_NAMES.items():
        first.setdefault(sheet.lower(), provider)
    return lookup(first, F.lower(as_col(name)))


def choice_score(answer, options) -> Column:
    """Score of a chosen label; ``options`` is ``array<struct<label, score>>``; null when unknown."""
    wanted = F.lower(strip(answer))
    hit = F.filter(as_col(options), lambda o: F.lower(strip(o.label)) == wanted)
    return F.get(F.transform(hit, lambda o: o.score.cast("double")), F.lit(0))


def choice_error(answer, options) -> Column:
    """Why an answer has no score: an unknown label is an error, never a zero."""
    raw = strip(F.coalesce(as_col(answer), F.lit("")))
    labels = F.array_join(F.transform(as_col(options), lambda o: o.label), ", ")
    return F.when(F.length(raw) == 0, "no choice").when(
        choice_score(raw, options).isNull(), F.concat(raw, F.lit(" is not one of: "), labels))


def rubric_score(kind, answer, options) -> Column:
    """Answer of a rubric question (as text) to a score; text answers have none."""
    k, a = as_col(kind), as_col(answer)
    number = F.expr("CAST(NULL AS DOUBLE)") if a is None else a.try_cast("double")
    return (
        F.when(k == "boolean", F.when(F.lower(a) == "true", 1.0).when(F.lower(a) == "false", 0.0))
        .when(k == "slider", F.when((number >= 0) & (number <= 1), number))
        .when(k == "choice", choice_score(a, options))
    )


def rubric_error(kind, answer, options) -> Column:
    return F.when((as_col(kind) != "text") & rubric_score(kind, answer, options).isNull(),
                  F.concat(F.coalesce(as_col(answer), F.lit("null")), F.lit(" is not accepted by a "), as_col(kind)))


def reply_json(raw) -> Column:
    """A judge's reply as a variant object: all of it, else the widest ``{...}`` in it."""
    whole = F.try_parse_json(strip(raw))
    inner = F.try_parse_json(F.nullif(F.regexp_extract(as_col(raw), r"(?s)\{.*\}", 0), F.lit("")))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.coalesce(F.when(is_object(whole), whole), F.when(is_object(inner), inner))


def reply_score(reply) -> Column:
    """The reply's score clamped to 0..1; 0 when there is none."""
    s = F.try_variant_get(as_col(reply), "$.score", "string").try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(s, F.lit(0.0)), F.lit(0.0))))


def with_contract(template) -> Column:
    """Ask for a score object unless the template mentions one already."""
    t = as_col(template)
    return F.when(F.instr(F.lower(t), "score") > 0, t).otherwise(F.concat(t, F.lit(OUTPUT_CONTRACT)))


def entropy(text) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(as_col(text), "")
    n = F.size(chars)

    def share(c: Column) -> Column:
        return F.size(F.filter(chars, lambda x: x == c)) / n

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def redact(text, keep: int = 4) -> Column:
    """First characters, the rest as at most 12 bullets."""
    s = strip(text)
    n = F.length(s)
    return F.when(n <= keep, F.repeat(F.lit(BULLET), n)).otherwise(
        F.concat(F.substring(s, 1, keep), F.repeat(F.lit(BULLET), F.least(n - keep, F.lit(12)))))


def question_of(event) -> Column:
    """Text of the last non-blank user message, else input, prompt or question (variant event)."""
    v = as_col(event)
    messages = F.try_variant_get(v, "$.messages", "array<struct<role:string,content:variant>>")
    text = lambda m: F.try_variant_get(m.content, "$", "string")
    is_text = lambda m: F.schema_of_variant(m.content) == "STRING"
    said = F.filter(messages, lambda m: (m.role == "user") & is_text(m) & (F.length(strip(text(m))) > 0))
    last = F.try_element_at(F.transform(said, text), F.lit(-1))
    rest = [F.try_variant_get(v, f"$.{k}", "variant") for k in ("input", "prompt", "question")]
    plain = [F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")) for x in rest]
    return F.coalesce(last, *[F.when(F.length(strip(p)) > 0, p) for p in plain], F.lit(""))


def text_of(value) -> Column:
    """A variant as text: strings as they are, anything else as JSON."""
    def text(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(
            F.schema_of_variant(v) != "VOID", F.to_json(v))

    return bind(value, text)


def truthy(value) -> Column:
    """Null for the values a "first of" chain skips: null, empty text, list, object, zero, false."""
    return bind(text_of(value), lambda t: F.when(~t.isin("", "[]", "{}", "0", "0.0", "false", "null"), t))


def event_input(event) -> Column:
    """First of messages, input, contents and prompts, as text; empty when there is none."""
    keys = ("messages", "input", "contents", "prompts")
    return F.coalesce(*[truthy(F.try_variant_get(as_col(event), f"$.{k}", "variant")) for k in keys], F.lit(""))


def event_output(event) -> Column:
    """Output, else response, as text."""
    return F.coalesce(*[text_of(F.try_variant_get(as_col(event), f"$.{k}", "variant")) for k in ("output", "response")])


def event_metadata(event, cost=None) -> Column:
    """Model, cost, source trace id and integration of an event, absent ones left out."""
    e = as_col(event)
    pairs = {
        "model": F.try_variant_get(e, "$.model", "string"),
        "cost": as_col(cost).cast("string") if cost is not None else F.lit(None).cast("string"),
        "source_trace_id": F.try_variant_get(e, "$.trace_id", "string"),
        "integration": F.try_variant_get(e, "$.integration", "string"),
    }
    whole = F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*pairs.values()))
    return F.map_filter(whole, lambda _, v: v.isNotNull() & (v != ""))


def step_agent(event) -> Column:
    """Agent of a step: graph node, then the agent fields; agent spans go by their name."""
    e = as_col(event)
    get = lambda p: F.try_variant_get(e, p, "string")
    named = [F.when(F.length(strip(get(f"$.{k}"))) > 0, get(f"$.{k}")) for k in ("agent", "agent_name", "crew_agent", "role")]
    own = F.coalesce(*[F.nullif(get(f"$.{k}"), F.lit("")) for k in ("function", "name", "api")])
    return F.coalesce(F.nullif(get("$.langgraph.langgraph_node"), F.lit("")), *named,
                      F.when(get("$.type") == "agent", own))


def slug(name, most: int | None = None) -> Column:
    """Lower-case letters and digits with hyphens between; whole, so that long names stay apart, or the first ``most``."""
    s = F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "-")
    whole = F.regexp_replace(s, "^-+|-+$", "")
    return whole if most is None else F.substring(whole, 1, most)


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))
