"""What raw text columns hold: type profiles, schema type errors, coercion counts.

A profile is one row per (file, column) of counts, taken in one pass and
mergeable: profiles of a file's parts, or of more of its rows, add up.  The type
that a typed reader would infer, and the schema's type errors (V1), follow from
the counts alone.  Coercion counts (N6, N9) come from the marks that the
normaliser leaves beside its values, so nothing is parsed a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.dates import clean_date_text, parse_dates
from spendlens.functions.numeric import is_na_token, parse_number
from spendlens.operators.normalize import COERCED, resolve_columns
from spendlens.operators.quality import _TYPE_CHECKS
from spendlens.schema import (MSG_COERCED_DATE, MSG_COERCED_NUMBER,
                              PLATFORM_COLUMNS)

# A whole number as a typed reader takes it.
INTEGER_RE = r"^\s*[+-]?\d+\s*$"
COUNTS = ["rows", "missing", "integers", "numbers", "dates"]


def type_profile(raw: DataFrame, platform: str, strict_headers: bool = True,
                 source: str = "_source") -> DataFrame:
    """Counts per (file, platform, column): rows, missing, whole numbers, numbers,
    dates (of the date column).  One pass, partial counts before the shuffle."""
    cols = resolve_columns(raw.columns, platform, strict_headers)
    text = {u: F.col(f"`{c}`").cast("string") for u, c in cols.items()}
    # each text's classes are decided once, then counted
    staged = raw.select(F.col(source).alias("file"),
                        *[c.alias(f"__{u}") for u, c in text.items()],
                        clean_date_text(text["date"]).alias("__clean"))

    def marks(u: str) -> Column:
        c = F.col(f"__{u}")
        number = parse_number(c)
        return F.struct(
            is_na_token(c).cast("int").alias("missing"),
            (c.rlike(INTEGER_RE) & c.try_cast("bigint").isNotNull()).cast("int").alias("integers"),
            number.isNotNull().cast("int").alias("numbers"),
            (parse_dates(F.col("__clean"), cleaned=True).isNotNull().cast("int") if u == "date"
             else F.lit(0)).alias("dates"))

    marked = staged.select("file", *[marks(u).alias(u) for u in cols])
    counted = marked.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(F.col(u)[k]), F.lit(0)).cast("bigint").alias(f"{u}_{k}") for u in cols for k in COUNTS[1:]])
    per_column = F.array(*[F.struct(
        F.lit(u).alias("unified"), F.lit(c).alias("column"), F.col("rows"),
        *[F.col(f"{u}_{k}").alias(k) for k in COUNTS[1:]]) for u, c in cols.items()])
    return counted.select("file", F.lit(platform).alias("platform"), F.inline(per_column))


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of parts, put together: the counts add up."""
    return profiles.groupBy("file", "platform", "unified", "column").agg(
        *[F.sum(k).cast("bigint").alias(k) for k in COUNTS])


def inferred_types(profile: DataFrame) -> DataFrame:
    """``profile`` plus ``inferred``: what a typed reader makes of the column.

    All whole numbers and none missing: integer; numbers or missing only: float;
    a date column whose values are all known dates: datetime; else text.
    """
    rows = F.col("rows")
    return profile.withColumn(
        "inferred",
        F.when((F.col("unified") == "date") & (F.col("dates") > 0) & (F.col("dates") + F.col("missing") == rows), "datetime")
         .when((rows > 0) & (F.col("integers") == rows), "integer")
         .when((rows > 0) & (F.col("numbers") + F.col("missing") == rows), "float")
         .otherwise("text"))


# the inferred type that each unified column's schema check accepts
_WANTED = {"date": "datetime", "campaign_name": "text", "spend": "float", "revenue": "float",
           "clicks": "integer", "impressions": "integer", "conversions": "integer"}


def type_errors(profile: DataFrame) -> DataFrame:
    """V1 on raw files: (file, column, inferred, error) of the columns whose inferred type the schema
    does not accept, with the fixed texts of the schema check."""
    text = {col: msg for col, _, msg in _TYPE_CHECKS}
    error = F.lit(None).cast("string")
    for u, kind in _WANTED.items():
        error = F.when((F.col("unified") == u) & (F.col("inferred") != kind), F.lit(text[u])).otherwise(error)
    return (inferred_types(profile).withColumn("error", error).where("error is not null")
            .select("file", "column", "inferred", "error"))


def coercion_counts(normalized: DataFrame) -> DataFrame:
    """(file, channel, column, values, message) of the values that gave no number
    or date, per file and raw column, from the normaliser's ``_coerced`` marks (``flags=True``).

    Rows with equal marks are counted together first, so at most one row a file and
    mark leaves a task; no text is parsed again.
    """
    marks = normalized.groupBy(F.col("_source").alias("file"), "channel", "_coerced").agg(F.count(F.lit(1)).alias("n"))
    per_column = F.array(*[F.struct(
        F.lit(u).alias("unified"),
        F.when(F.col("_coerced").bitwiseAND(F.lit(1 << k)) != 0, F.col("n")).otherwise(F.lit(0)).alias("n"))
        for k, u in enumerate(COERCED)])
    flat = marks.select("file", "channel", F.inline(per_column))
    total = flat.groupBy("file", "channel", "unified").agg(F.sum("n").cast("bigint").alias("values")).where("values > 0")
    raw_name = F.lit(None).cast("string")
    for p, cols in PLATFORM_COLUMNS.items():
        for u in COERCED:
            raw_name = F.when((F.col("channel") == p) & (F.col("unified") == u), F.lit(cols[u])).otherwise(raw_name)
    named = total.withColumn("column", raw_name)

    def text(msg: str) -> Column:
        parts = F.lit("")
        for piece in msg.replace("{column}", "\0c\0").replace("{values}", "\0v\0").split("\0"):
            parts = F.concat(parts, F.col("column") if piece == "c" else F.col("values").cast("string") if piece == "v" else F.lit(piece))
        return parts

    return named.select("file", "channel", "column", "values",
                        F.when(F.col("unified") == "date", text(MSG_COERCED_DATE)).otherwise(text(MSG_COERCED_NUMBER)).alias("message"))


def observe_coercions(normalized: DataFrame, observation) -> DataFrame:
    """The same counts over all files as named metrics of whatever job runs ``normalized`` next."""
    return normalized.observe(observation, F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col("_coerced").bitwiseAND(F.lit(1 << k)) != 0).alias(u) for k, u in enumerate(COERCED)])
