"""Adapters from the driver's TPC-H-style tables to marketing inputs.

The driver tables hold no marketing data, so facts and raw exports are
derived deterministically from ``lineitem ⋈ orders ⋈ customer``.  Every
lineitem row feeds every derived table (no subsets), so the work grows with
the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.schema import PLATFORM_COLUMNS, PLATFORMS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to its order and customer, pruned to used columns.

    orders ⋈ customer is joined first: it is ~4x smaller than lineitem, so
    the big lineitem shuffle happens once, on l_orderkey.  Join strategy is
    left to AQE (broadcast only when runtime sizes allow it).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    oc = o.join(c, o.o_custkey == c.c_custkey)
    return li.join(oc, li.l_orderkey == oc.o_orderkey)


def _is_brand() -> Column:
    return (F.col("l_discount") == 0) & (F.col("l_returnflag") == "A")


def _money(c: Column) -> Column:
    return F.rint(c * F.lit(100.0)) / F.lit(100.0)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified fact table (schema of ``spendlens.schema.FACT_SCHEMA``)."""
    j = order_lines(spark, sf_dir)
    brand = _is_brand()
    qty = F.col("l_quantity").cast("bigint")
    return j.select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("date"),
        F.when(brand, F.lit("brand"))
         .when(F.col("l_discount") == 0, F.lit("organic"))
         .otherwise(F.lower("c_mktsegment")).alias("channel"),
        F.col("o_orderpriority").alias("campaign_name"),
        _money(F.col("l_extendedprice") * F.col("l_discount")).alias("spend"),
        F.when(brand, F.lit(0).cast("bigint")).otherwise(qty).alias("clicks"),
        (qty * (F.col("l_linenumber") + 1) * 10).cast("bigint").alias("impressions"),
        F.when((F.col("l_returnflag") == "N") & (F.col("c_mktsegment") != "HOUSEHOLD"),
               F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("conversions"),
        F.when(brand, F.lit(0.0))
         .otherwise(_money(F.col("l_extendedprice") * (1 - F.col("l_discount"))))
         .alias("revenue"),
    )


# ---------------------------------------------------------------------------
# Raw exports: the same rows rendered as text in each platform's layout, with
# dirty values injected by fixed rules on the source columns.
# ---------------------------------------------------------------------------

# FIXED VALUES: date layouts per platform (primary, alternate for line 5).
RAW_DATE_FORMATS = {
    "google_ads": ("yyyy-MM-dd", "yyyyMMdd"),
    "facebook": ("MM/dd/yyyy", "dd/MM/yyyy"),
    "email": ("dd-MMM-yyyy", "dd-MMM-yy"),
    "seo": ("yyyy/MM/dd", "MMM d, yyyy"),
}
# FIXED VALUES: campaign text per platform (prefix before the priority).
RAW_CAMPAIGN_PREFIX = {
    "google_ads": "",
    "facebook": "FB ",
    "email": "Newsletter, ",
    "seo": "/blog/",
}


def _money_text(cents: Column) -> Column:
    """Exact text of non-negative integer cents, e.g. 12345 -> '123.45'."""
    return F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def raw_rows(spark: SparkSession, sf_dir: str, platform: str,
             keep_priority: bool = False, base: DataFrame | None = None,
             by_file: bool = False) -> DataFrame:
    """One raw export (all text) in ``platform``'s layout over all rows; with ``by_file``
    many exports, one per quantity and ship month.

    Columns: the platform's exact header names plus ``_source`` and ``_row``
    lineage (the row ordinal a file reader would report).
    """
    if platform not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}")
    j = order_lines(spark, sf_dir) if base is None else base
    q = F.col("l_quantity").cast("bigint")
    ln = F.col("l_linenumber")
    prim, alt = RAW_DATE_FORMATS[platform]
    date_txt = (F.when(ln == 7, F.lit("INVALID"))
                 .when(ln == 6, F.lit("0000-00-00"))
                 .when(ln == 5, F.date_format("l_shipdate", alt))
                 .otherwise(F.date_format("l_shipdate", prim)))
    campaign = F.when(q == 26, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(RAW_CAMPAIGN_PREFIX[platform]), F.col("o_orderpriority")))
    spend_c = F.rint(F.col("l_extendedprice") * F.col("l_discount") * F.lit(100.0)).cast("bigint")
    spend = (F.when(q == 21, F.concat(F.lit("$"), _money_text(spend_c)))
              .when(q == 22, F.lit("nan"))
              .when(q == 23, F.concat(F.lit("1,"), _money_text(spend_c)))
              .when(q == 27, F.lit("0.575"))
              .otherwise(_money_text(spend_c)))
    qs = q.cast("string")
    clicks = (F.when(q == 13, F.lit(""))
               .when(q == 14, F.lit("n/a"))
               .when(q == 15, F.lit("1,234"))
               .when(q == 16, F.concat(qs, F.lit("d")))
               .when(q == 17, F.concat(F.lit(" "), qs, F.lit(" ")))
               .when(q == 18, F.lit("1e3"))
               .when(q == 19, F.lit("-3"))
               .when(q == 20, F.lit("10.7"))
               .otherwise(qs))
    impressions = F.when(q == 25, F.lit("inf")).otherwise(
        (q * (ln + 1) * 10).cast("string"))
    conversions = (F.when(q == 28, F.lit(""))
                    .when((F.col("l_returnflag") == "N") & (F.col("c_mktsegment") != "HOUSEHOLD"),
                          F.lit("1.0"))
                    .otherwise(F.lit("0.0")))
    rev_c = F.rint(F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.lit(100.0)).cast("bigint")
    revenue = F.when(q == 24, F.lit("")).otherwise(_money_text(rev_c))
    cols = PLATFORM_COLUMNS[platform]
    values = {"date": date_txt, "campaign_name": campaign, "spend": spend,
              "clicks": clicks, "impressions": impressions,
              "conversions": conversions, "revenue": revenue}
    source = F.lit(f"raw_{platform}")
    if by_file:
        source = F.concat(source, F.lit("_"), qs, F.lit("_"), F.date_format("l_shipdate", "yyyyMM"))
    extra = [F.col("o_orderpriority").alias("__prio"),
             F.col("l_returnflag").alias("__notes")] if keep_priority else []
    return j.select(
        *[values[u].alias(raw) for u, raw in cols.items()],
        source.alias("_source"),
        (F.col("l_orderkey") * 10 + ln).cast("bigint").alias("_row"),
        *extra,
    )


# FIXED VALUES: strftime equivalents of RAW_DATE_FORMATS (for SQL checks).
RAW_DATE_STRFTIME = {
    "google_ads": ("%Y-%m-%d", "%Y%m%d"),
    "facebook": ("%m/%d/%Y", "%d/%m/%Y"),
    "email": ("%d-%b-%Y", "%d-%b-%y"),
    "seo": ("%Y/%m/%d", "%b %-d, %Y"),
}

# FIXED VALUES: header variant of an export file, chosen by its campaign
# (order priority): exact header, one extra column, upper-cased names,
# 5 of 7 columns (spend and revenue dropped), 4 of 7 columns.
HEADER_VARIANTS = {
    "1-URGENT": "exact",
    "2-HIGH": "extra",
    "3-MEDIUM": "upper",
    "4-NOT SPECIFIED": "five",
    "5-LOW": "four",
}
EXTRA_COLUMN = "Notes"


def variant_columns(platform: str, variant: str) -> list[tuple[str | None, str]]:
    """(unified column or None for the extra column, header name) in order."""
    cols = list(PLATFORM_COLUMNS[platform].items())
    if variant == "exact":
        return cols
    if variant == "extra":
        return cols + [(None, EXTRA_COLUMN)]
    if variant == "upper":
        return [(u, n.upper()) for u, n in cols]
    if variant == "five":
        return [(u, n) for u, n in cols if u not in ("spend", "revenue")]
    if variant == "four":
        return [(u, n) for u, n in cols if u in ("date", "campaign_name", "clicks", "impressions")]
    raise ValueError(variant)


def _slug(s: str) -> str:
    return s.replace(" ", "_")


def header_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header table derived from the tables: one 'file' per (platform, account,
    campaign) present in the orders, its header names following the
    campaign's variant.  Columns: file, names (array<string>)."""
    keys = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    layout = spark.createDataFrame(
        [(p, prio, [n for _, n in variant_columns(p, v)])
         for p in PLATFORMS for prio, v in HEADER_VARIANTS.items()],
        "platform string, o_orderpriority string, names array<string>")
    j = keys.join(F.broadcast(layout), "o_orderpriority")
    return j.select(
        F.concat(F.lit("raw_"), F.col("platform"), F.lit("_"),
                 F.regexp_replace("o_orderpriority", " ", "_"), F.lit("_"),
                 F.col("o_custkey").cast("string"), F.lit(".csv")).alias("file"),
        "names")


def write_exports(spark: SparkSession, sf_dir: str, out_dir: str,
                  variants: bool = True, threads: int = 8, keep_source: bool = True) -> list[str]:
    """Write every raw export as CSV under ``out_dir`` and return the
    folders written.  With ``variants`` each platform's rows are split by
    campaign into folders whose header follows ``HEADER_VARIANTS``; every
    row is written exactly once either way.

    The joined source is written once, with ``variants`` in a folder per campaign,
    so that each write reads its own campaign's rows; unless ``keep_source`` it is
    deleted after the last write.
    """
    from spendlens.session import held, written
    source = order_lines(spark, sf_dir), "order-lines", ["o_orderpriority"] if variants else []
    if keep_source:
        return _write_from(written(*source), spark, sf_dir, out_dir, variants, threads)
    with held(*source) as base:
        return _write_from(base, spark, sf_dir, out_dir, variants, threads)


def _write_from(base: DataFrame, spark: SparkSession, sf_dir: str, out_dir: str,
                variants: bool, threads: int) -> list[str]:
    """The per-folder writes are independent jobs submitted concurrently (driver threads,
    no data on the driver), so small writes overlap instead of queueing."""
    from concurrent.futures import ThreadPoolExecutor

    jobs = []
    for platform in PLATFORMS:
        raw = raw_rows(spark, sf_dir, platform, keep_priority=True, base=base)
        if not variants:
            cols = [F.col(f"`{n}`") for n in PLATFORM_COLUMNS[platform].values()]
            jobs.append((f"{out_dir}/{platform}", raw.select(*cols)))
            continue
        for prio, v in HEADER_VARIANTS.items():
            cols = []
            for u, name in variant_columns(platform, v):
                src = F.col("__notes") if u is None else F.col(f"`{PLATFORM_COLUMNS[platform][u]}`")
                cols.append(src.alias(name))
            jobs.append((f"{out_dir}/{platform}_{_slug(prio)}",
                         raw.where(F.col("__prio") == prio).select(*cols)))

    def write(job):
        path, df = job
        df.write.option("header", True).option("escape", '"').csv(path)
        return path

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        return list(pool.map(write, jobs))
