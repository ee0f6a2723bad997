"""Validation (V1-V8): schema checks, coercion, row rules, quarantine.

Row rules are one boolean Column per rule; the messages of the failed rules
are collected per row with ``array_compact`` and the rows split into valid
and rejected sets by a filter — no per-row Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.dates import parse_dates
from spendlens.functions.labels import title_label
from spendlens.functions.numeric import coerce_numeric, nan_to_null
from spendlens.schema import (CHANNEL_ENUM, FACT_COLUMNS, MSG_CHANNEL,
                              MISSING_TEXT, MSG_DATE_MISSING, MSG_GE_ZERO_FLOAT,
                              MSG_GE_ZERO_INT, MSG_MISSING_COLUMNS,
                              PLATFORM_COLUMNS, ROW_REJECT_TEXT)
from spendlens.session import shared_dir

# FIXED VALUE: message for a count that is not a finite number.
MSG_FINITE = "Input should be a finite number"

_TYPE_CHECKS = [
    ("date", (T.TimestampNTZType, T.TimestampType, T.DateType), "Column 'date' is not a valid datetime type."),
    ("channel", (T.StringType,), "Column 'channel' is not a valid string type."),
    ("campaign_name", (T.StringType,), "Column 'campaign_name' is not a valid string type."),
    ("spend", (T.DoubleType, T.FloatType), "Column 'spend' is not a valid float type."),
    ("revenue", (T.DoubleType, T.FloatType), "Column 'revenue' is not a valid float type."),
    ("clicks", (T.LongType, T.IntegerType, T.ShortType), "Column 'clicks' is not a valid integer type."),
    ("impressions", (T.LongType, T.IntegerType, T.ShortType), "Column 'impressions' is not a valid integer type."),
    ("conversions", (T.LongType, T.IntegerType, T.ShortType), "Column 'conversions' is not a valid integer type."),
]


def schema_errors(df: DataFrame) -> list[str]:
    """V1 on a unified DataFrame: missing columns (sorted, then stop), else
    per-column type errors.  Inspects the schema only; runs no job."""
    missing = sorted(set(FACT_COLUMNS) - set(df.columns))
    if missing:
        return [MSG_MISSING_COLUMNS.format(cols=", ".join(missing))]
    types = {f.name: f.dataType for f in df.schema.fields}
    return [msg for col, ok, msg in _TYPE_CHECKS if not isinstance(types[col], ok)]


def missing_raw_columns(headers: DataFrame) -> DataFrame:
    """V1 as a job over a header table (``file``, ``platform``, ``names``):
    the raw columns each file's platform needs but lacks, sorted, and the
    message.  Files without a platform are not checked here."""
    req = F.create_map(*[x for p, m in PLATFORM_COLUMNS.items()
                         for x in (F.lit(p), F.array(*[F.lit(v) for v in m.values()]))])
    miss = F.array_sort(F.array_except(F.element_at(req, F.col("platform")), F.col("names")))
    return (headers.where(F.col("platform").isNotNull())
            .select("file", "platform", miss.alias("missing"))
            .where(F.size("missing") > 0)
            .withColumn("error", F.concat(F.lit(MSG_MISSING_COLUMNS.split("{")[0]),
                                          F.array_join("missing", ", "))))


def coerce_types(df: DataFrame) -> DataFrame:
    """V2: a final safe type pass; uncoercible values -> NULL date / 0."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        col = F.col(c)
        if c == "date" and isinstance(types[c], T.StringType):
            col = parse_dates(col)
        elif c in ("channel", "campaign_name"):
            col = F.coalesce(col.cast("string"), F.lit(MISSING_TEXT))
        elif c in ("spend", "revenue") and not isinstance(types[c], (T.DoubleType, T.FloatType)):
            col = coerce_numeric(col)
        elif c in ("clicks", "impressions", "conversions") and \
                not isinstance(types[c], (T.LongType, T.IntegerType, T.ShortType)):
            col = coerce_numeric(col).try_cast("bigint")
            col = F.coalesce(col, F.lit(0).cast("bigint"))
        out.append(col.alias(c))
    return df.select(*out)


def rule_messages(df: DataFrame) -> Column:
    """V3: array of failed-rule messages in field order (empty = valid).

    NaN compares as not >= 0, so a NaN money value fails like in a strict
    model; a NULL count (infinity in the export) fails as non-finite.
    """
    def ge0(c: str, msg: str) -> Column:
        v = nan_to_null(F.col(c).cast("double"))
        return F.when(v.isNull() | (v < 0), F.lit(msg))

    checks = [
        F.when(F.col("date").isNull(), F.lit(MSG_DATE_MISSING)),
        F.when(~F.coalesce(F.col("channel").isin(CHANNEL_ENUM), F.lit(False)), F.lit(MSG_CHANNEL)),
        ge0("spend", MSG_GE_ZERO_FLOAT),
        *[F.when(F.col(c).isNull(), F.lit(MSG_FINITE)).when(F.col(c) < 0, F.lit(MSG_GE_ZERO_INT))
          for c in ("clicks", "impressions", "conversions")],
        ge0("revenue", MSG_GE_ZERO_FLOAT),
    ]
    return F.array_compact(F.array(*checks))


def _fails(df: DataFrame) -> Column:
    """Whether a row fails any rule: what ``rule_messages`` would name, without its texts."""
    def ge0(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.isnan(v) | F.coalesce(v < 0, F.lit(True))

    bad = F.col("date").isNull() | ~F.coalesce(F.col("channel").isin(CHANNEL_ENUM), F.lit(False))
    for c in ("spend", "revenue"):
        bad = bad | ge0(c)
    for c in ("clicks", "impressions", "conversions"):
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(True))
    return bad


def row_rules(df: DataFrame) -> DataFrame:
    """V3: ``df`` plus ``errors`` (array<string>)."""
    return df.withColumn("errors", rule_messages(df))


def _row_id(df: DataFrame) -> Column:
    return F.col("_row") if "_row" in df.columns else F.lit(None).cast("bigint")


def _ruled(df: DataFrame) -> DataFrame:
    """``df`` plus ``__fails``, generated: a filter on it stays above, so that the parse
    beneath runs once and not again within the filter.  Only failing rows get messages."""
    return _flagged(df, _fails(df), "__fails")


def _flagged(df: DataFrame, flag: Column, name: str) -> DataFrame:
    return df.select("*", F.explode(F.array(flag)).alias(name))


def valid_rows(df: DataFrame) -> DataFrame:
    """V4: rows passing every rule (columns unchanged)."""
    return _ruled(df).where(~F.col("__fails")).drop("__fails")


def rejected_rows(df: DataFrame) -> DataFrame:
    """V4: failing rows as (source, row, message) with the fixed sentence."""
    bad = _ruled(df).where("__fails")
    src = F.col("_source") if "_source" in df.columns else F.lit(None).cast("string")
    return bad.select(src.alias("source"), _row_id(df).alias("row"), _reject_message(df, rule_messages(df)).alias("message"))


@dataclass
class ValidationResult:
    schema_errors: list[str]
    valid: DataFrame
    rejected: DataFrame
    rows: int = 0
    rejected_rows: int = 0

    def is_valid(self) -> bool:
        """Overall flag: no schema error and no rejected row (known from the pass; no job)."""
        return not self.schema_errors and not self.rejected_rows

    def combined(self) -> DataFrame:
        """Both sides as one table: (source, row, accepted, message, is_valid), a row per input row."""
        ok = self.valid
        src = F.col("_source") if "_source" in ok.columns else F.lit(None).cast("string")
        good = ok.select(src.alias("source"), _row_id(ok).alias("row"), F.lit(True).alias("accepted"),
                         F.lit(None).cast("string").alias("message"))
        bad = self.rejected.select("source", "row", F.lit(False).alias("accepted"), "message")
        return good.unionByName(bad).withColumn("is_valid", F.lit(self.is_valid()))


def _reject_message(df: DataFrame, errs: Column) -> Column:
    pre, post = ROW_REJECT_TEXT.split("{row}")
    mid, end = post.split("{errors}")
    return F.concat(F.lit(pre), _row_id(df).cast("string"), F.lit(mid), F.array_join(errs, "; "), F.lit(end))


def run_validation(df: DataFrame, path: str | None = None) -> ValidationResult:
    """V5: schema check -> coercion -> row rules -> split, in one pass over ``df``.

    Every row is judged once and written at ``path`` (by default below the shared
    checkpoint folder) in a folder by verdict, ``accepted=true`` with the facts or
    ``accepted=false`` with the message besides; the counts are metrics of the same job.
    """
    errs = schema_errors(df)
    if errs:
        return ValidationResult(errs, df, df.sparkSession.createDataFrame(
            [], "source string, row bigint, message string"))
    spark = df.sparkSession
    path = path or shared_dir(spark, "validated")
    judged = _ruled(coerce_types(df))
    ok = ~F.col("__fails")
    seen = Observation("validation")
    tagged = judged.select(*df.columns, F.when(~ok, _reject_message(df, rule_messages(df))).alias("__message"), ok.alias("accepted"))
    tagged = tagged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("accepted")).alias("rejected"))
    tagged.write.mode("overwrite").partitionBy("accepted").parquet(path)
    back = spark.read.schema(tagged.schema).parquet(path)
    src = F.col("_source") if "_source" in df.columns else F.lit(None).cast("string")
    return ValidationResult(
        [], back.where(F.col("accepted")).select(*df.columns),
        back.where(~F.col("accepted")).select(src.alias("source"), _row_id(df).alias("row"), F.col("__message").alias("message")),
        seen.get["rows"], seen.get["rejected"])


def validation_report(df: DataFrame) -> DataFrame:
    """V5 as one aggregate per source: rows, valid, rejected, is_valid."""
    src = F.col("_source") if "_source" in df.columns else F.lit(None).cast("string")
    co = coerce_types(df)
    co = co.withColumn("__bad", _fails(co))
    return co.groupBy(src.alias("source")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(~F.col("__bad"), 1).otherwise(0)).cast("bigint").alias("valid_rows"),
        F.sum(F.when(F.col("__bad"), 1).otherwise(0)).cast("bigint").alias("rejected_rows"),
    ).withColumn("is_valid", F.col("rejected_rows") == 0)


def facts_clean(df: DataFrame) -> DataFrame:
    """V6: rows with a date (the input to every analytics query).  The flag is generated, as in
    ``_ruled``: a plain filter would be pushed down and parse every date a second time."""
    return _flagged(df, F.col("date").isNotNull(), "__dated").where("__dated").drop("__dated")


def file_summary(df: DataFrame) -> DataFrame:
    """V7: per source file and platform: rows loaded and date span.

    Sources with zero rows produce no group (the reference warns and
    stores nothing).  ``date_range`` renders like a timestamp pair.
    """
    src = F.col("_source") if "_source" in df.columns else F.lit(None).cast("string")
    fmt = "yyyy-MM-dd HH:mm:ss"
    g = df.groupBy(src.alias("file"), F.col("channel")).agg(
        F.count(F.lit(1)).alias("rows_loaded"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    show = lambda c: F.coalesce(F.date_format(c, fmt), F.lit("NaT"))
    return g.select("file", title_label("channel").alias("platform"), "rows_loaded",
                    "date_min", "date_max",
                    F.concat(show(F.col("date_min")), F.lit(" to "),
                             show(F.col("date_max"))).alias("date_range"))
