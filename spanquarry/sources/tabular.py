"""Spreadsheet-like files as dataset examples."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanquarry.functions.common import strip

# Header names that suggest a role.
INPUT_HINTS = ["input", "question", "prompt", "query", "user", "text", "message"]
EXPECTED_HINTS = ["expected_output", "expected output", "expected", "output", "answer", "response", "target", "label",
                  "gold", "reference", "ideal"]


def is_utf8(spark: SparkSession, path: str) -> bool:
    """No line of the file holds bytes that are not UTF-8."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()


def read_tabular(spark: SparkSession, path: str, encoding: str | None = None, multiline: bool = True, most: int | None = None) -> DataFrame:
    """CSV or TSV with a header: byte-order mark and blank rows dropped, headers trimmed, all columns or the first ``most``.

    Quoted fields may hold line ends, so a file is one split; ``multiline=False`` splits large files that hold none.
    """
    encoding = encoding or ("UTF-8" if is_utf8(spark, path) else "ISO-8859-1")
    raw = spark.read.csv(path, header=True, sep="\t" if path.lower().endswith(".tsv") else ",", encoding=encoding,
                         quote='"', escape='"', multiLine=multiline)
    names = [c.replace("\ufeff", "").strip() for c in raw.columns[:most]]
    df = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names)])
    return df.filter(F.length(strip(F.concat_ws("", *[F.col(f"`{n}`") for n in names]))) > 0)


def suggest_columns(headers: Sequence[str]) -> dict[str, str | None]:
    """Likely input and expected columns: an exact header name first, else one that contains a hint."""
    def find(hints: list[str]) -> str | None:
        exact = [h for h in headers if h.strip().lower() in hints]
        loose = [h for h in headers if any(x in h.strip().lower() for x in hints)]
        return (exact + loose + [None])[0]

    given = find(INPUT_HINTS) or (headers[0] if headers else None)
    expected = find(EXPECTED_HINTS)
    return {"input": given, "expected_output": None if expected == given else expected}


def number_rows(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Consecutive row numbers in file order without moving rows: counts per split give the offsets."""
    split_bits = 33
    rows = df.withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_split", F.shiftright("_id", split_bits)).withColumn("_pos", F.col("_id").bitwiseAND((1 << split_bits) - 1))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_split").agg(F.count("*").alias("_n")).select("_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return rows.join(offsets, "_split").withColumn(name, F.col("_pos") + F.col("_off") + start).drop("_id", "_split", "_pos", "_off")


def rows_to_examples(df: DataFrame, input_col: str, expected_col: str | None, source: str) -> DataFrame:
    """Rows with an input as examples; every other filled column stays as metadata."""
    rest = [c for c in df.columns if c not in (input_col, expected_col)]
    q = lambda c: F.col(f"`{c}`")
    extra = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[q(c) for c in rest])) if rest else F.create_map().cast("map<string,string>")
    rows = number_rows(df, "row", 2)
    expected = F.nullif(strip(q(expected_col)), F.lit("")) if expected_col else F.lit(None).cast("string")
    return rows.select(
        strip(F.coalesce(q(input_col), F.lit(""))).alias("input"), expected.alias("expected_output"), F.lit(source).alias("imported_from"), "row",
        F.map_filter(extra, lambda _, v: F.length(strip(F.coalesce(v, F.lit("")))) > 0).alias("columns"),
    ).filter(F.col("input") != "")
