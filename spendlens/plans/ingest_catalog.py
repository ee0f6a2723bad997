"""Catalog entries for ingest: scalar coercions, normalisation, validation,
detection, CSV scan, fact-table maintenance and streaming ingest.

Raw exports come from ``sources.testdata.raw_rows`` (every lineitem row in
every platform layout); file-based entries first write those exports as CSV
below the session's checkpoint root, then read them back like uploads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions import metrics as M
from spendlens.functions.dates import parse_dates
from spendlens.functions.numeric import coerce_numeric, round_money, to_count
from spendlens.operators import detect, profile, quality, reports, rollups, tables
from spendlens.operators.normalize import normalize, normalize_all
from spendlens.schema import FACT_COLUMNS, PLATFORM_COLUMNS, PLATFORMS
from spendlens.session import held, remove_dir, shared_dir
from spendlens.sources.exports import file_headers, read_exports
from spendlens.sources.testdata import facts, header_sets, order_lines, raw_rows, write_exports
from spendlens.streaming.ingest import IngestPaths, incremental_ingest, read_ingested
from spendlens.streaming.ledger import LedgerPaths, ingest_pending, read_loaded

LINEAGE = ["_source", "_row"]


def _raw(spark, sf, p):
    return raw_rows(spark, sf, p)


def _raws(spark, sf, by_file=False):
    """All four platform layouts over one written join (instead of one
    lineitem ⋈ orders ⋈ customer per layout)."""
    from spendlens.session import written
    base = written(order_lines(spark, sf), "order-lines")
    return {p: raw_rows(spark, sf, p, base=base, by_file=by_file) for p in PLATFORMS}


def _norm(spark, sf, p):
    return normalize(_raw(spark, sf, p), p)


def _norm_all(spark, sf):
    return normalize_all(_raws(spark, sf))


def _profile(spark, sf):
    out = None
    for p, raw in _raws(spark, sf, by_file=True).items():
        part = profile.type_profile(raw, p)
        out = part if out is None else out.unionByName(part)
    return out


def _scalar(spark, sf, fn, unified):
    """Apply a scalar coercion to one raw column of every platform export."""
    out = None
    raws = _raws(spark, sf)
    for p in PLATFORMS:
        raw_name = PLATFORM_COLUMNS[p][unified]
        part = raws[p].select(
            "_source", "_row", F.col(f"`{raw_name}`").alias("raw"),
            fn(F.col(f"`{raw_name}`")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _errors_text(df: DataFrame) -> DataFrame:
    return quality.row_rules(df).withColumn("errors", F.array_join("errors", "; "))


def _headers(spark, sf):
    return header_sets(spark, sf)


def _detected(spark, sf):
    h = _headers(spark, sf)
    return h.join(detect.detect_platform(h), "file")


def _exports(spark, sf, variants=True, keep_source=True):
    """Write the exports and return the folders (a folder list, not a glob)."""
    return write_exports(spark, sf, shared_dir(spark, "exports"), variants, keep_source=keep_source)


def _csv_scan(spark, sf):
    return read_exports(spark, _exports(spark, sf)).facts.select(*FACT_COLUMNS)


def _file_rejects(spark, sf):
    rej = read_exports(spark, _exports(spark, sf)).rejects
    # folder name identifies platform and campaign variant; part-file names vary
    return (rej.select(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("export"),
                       "stage", "reason")
            .groupBy("export", "stage", "reason").agg(F.count(F.lit(1)).alias("files"))
            .select("export", "stage", "reason"))


def _file_headers(spark, sf):
    h = file_headers(spark, _exports(spark, sf))
    return h.select(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("export"),
                    "header").distinct()


def _incremental(spark, sf):
    landing = _exports(spark, sf, variants=False, keep_source=False)[0].rsplit("/", 1)[0]
    base = shared_dir(spark, "ingest")
    paths = IngestPaths(landing, f"{base}/facts", f"{base}/rejects", f"{base}/_checkpoint")
    incremental_ingest(spark, paths)
    incremental_ingest(spark, paths)  # a re-run finds nothing new
    return read_ingested(spark, paths).select(*FACT_COLUMNS)


def _quoted_breaks(spark, sf):
    """Exports whose campaign names hold line breaks, quotes and commas, a file a platform and task.

    A platform's exports are deleted once they are read: facts come from the raw tables that read_exports
    wrote, so no two platforms' texts lie on disk at a time."""
    landing, found = shared_dir(spark, "quoted"), None
    with held(order_lines(spark, sf), "order-lines") as base:
        for p in PLATFORMS:
            cols, raw = PLATFORM_COLUMNS[p], raw_rows(spark, sf, p, base=base)
            name = F.concat(F.col(f"`{cols['campaign_name']}`"), F.lit('\nnote "\n", end'))
            out = raw.select(*[(name if u == "campaign_name" else F.col(f"`{c}`")).alias(c) for u, c in cols.items()])
            out.write.option("header", True).option("escape", '"').csv(f"{landing}/{p}")
            part = read_exports(spark, [f"{landing}/{p}"]).facts.select(*FACT_COLUMNS)
            remove_dir(spark, f"{landing}/{p}")
            found = part if found is None else found.unionByName(part)
    return found


def _ledger_ingest(spark, sf):
    """Strict headers refuse three of five layouts; a later run that takes any case loads one of those
    besides, and no file twice."""
    landing = _exports(spark, sf)[0].rsplit("/", 1)[0]
    base = shared_dir(spark, "ledger")
    paths = LedgerPaths(landing, f"{base}/facts", f"{base}/ledger")
    ingest_pending(spark, paths)
    ingest_pending(spark, paths, strict_headers=False)
    ingest_pending(spark, paths, strict_headers=False, retry="changed")  # nothing has changed
    return read_loaded(spark, paths).select(*FACT_COLUMNS)


def _weekly_incremental(spark, sf):
    """Facts in three batches, the last of late exports: totals of touched weeks only are made anew."""
    base, every = shared_dir(spark, "weekly"), facts(spark, sf)
    early, late = F.col("date") < F.lit("1995-06-01").cast("timestamp_ntz"), F.col("campaign_name") == "5-LOW"
    late = late & (F.col("date") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("date") < F.lit("1997-01-01").cast("timestamp_ntz"))
    for name, rows in (("1", every.where(early)), ("2", every.where(~early & ~late)), ("3", every.where(~early & late))):
        rollups.add_week_facts(rows, f"{base}/facts", name)
        rollups.refresh_weekly(spark, f"{base}/facts", f"{base}/totals", name, ["channel"])
    return rollups.read_weekly(spark, f"{base}/totals", ["channel"])


def _table_roundtrip(write):
    def q(spark, sf):
        path = shared_dir(spark, "facts_table")
        write(spark, sf, path)
        return tables.read_facts(spark, path)
    return q


def _append(spark, sf, path):
    for p, raw in _raws(spark, sf).items():
        tables.append_facts(normalize(raw, p), path)


def _append_once(spark, sf, path):
    raws = _raws(spark, sf)
    for p in [*PLATFORMS, *PLATFORMS[:2]]:  # two batches come in again, as after a failure
        tables.append_facts(normalize(raws[p], p), path, batch_id=p)


def _split(spark, sf, path):
    tables.split_by_channel(facts(spark, sf), path)


def _events_facts(spark, sf, scale=1.0):
    """Second source: events as a weekly channel series (event_type as
    channel, value as revenue)."""
    from spendlens.sources.testdata import table
    e = table(spark, sf, "events")
    return e.select(
        F.col("ts").cast("timestamp_ntz").alias("date"), F.col("event_type").alias("channel"),
        F.lit("events").alias("campaign_name"), F.lit(0.0).alias("spend"),
        F.lit(1).cast("bigint").alias("clicks"), F.lit(1).cast("bigint").alias("impressions"),
        F.lit(0).cast("bigint").alias("conversions"),
        round_money(F.col("value") * F.lit(scale)).alias("revenue"))


def _replace(spark, sf, path):
    tables.split_by_channel(facts(spark, sf).unionByName(_events_facts(spark, sf)), path)
    tables.replace_channels(_events_facts(spark, sf, 2.0), path)


def _unified_view(spark, sf):
    return tables.unified_view(spark, [facts(spark, sf), _events_facts(spark, sf)])


def _export(spark, sf):
    path = shared_dir(spark, "export")
    tables.export_facts(facts(spark, sf), path, "csv")
    return tables.read_export(spark, path, "csv")


def _export_parquet(spark, sf):
    path = shared_dir(spark, "export")
    tables.export_facts(facts(spark, sf), path, "parquet")
    return tables.read_export(spark, path, "parquet")


def _metric_rows(spark, sf):
    s = reports.channel_summary(facts(spark, sf), ("channel", "campaign_name"))
    return s.select("channel", "campaign_name",
                    M.cpa("total_spend", "total_conversions").alias("cpa"),
                    M.roas("total_revenue", "total_spend").alias("roas"),
                    M.ctr("total_clicks", "total_impressions").alias("ctr_pct"),
                    M.conversion_rate("total_conversions", "total_clicks").alias("conversion_rate_pct"))


def _metric_delta(spark, sf):
    from pyspark.sql import Window
    wk = reports.weekly_totals(facts(spark, sf), dims=["channel"])
    w = Window.partitionBy("channel").orderBy("week_start")
    return wk.select("channel", "week_start",
                     M.delta_pct("total_revenue", F.lag("total_revenue").over(w)).alias("revenue_delta_pct"),
                     M.delta_pct("total_conversions", F.lag("total_conversions").over(w)).alias("conversions_delta_pct"))


def ingest_queries():
    q = {
        "coerce_numeric": lambda s, d: _scalar(s, d, coerce_numeric, "clicks"),
        "coerce_int": lambda s, d: _scalar(s, d, lambda c: to_count(coerce_numeric(c)), "impressions"),
        "round_money": lambda s, d: _scalar(s, d, lambda c: round_money(coerce_numeric(c)), "spend"),
        "parse_dates": lambda s, d: _scalar(s, d, parse_dates, "date"),
        "normalize_google_ads": lambda s, d: _norm(s, d, "google_ads"),
        "normalize_facebook": lambda s, d: _norm(s, d, "facebook"),
        "normalize_email": lambda s, d: _norm(s, d, "email"),
        "normalize_seo": lambda s, d: _norm(s, d, "seo"),
        "normalize_all": _norm_all,
        "raw_facts": lambda s, d: tables.raw_facts(_norm_all(s, d)),
        "coerce_types": lambda s, d: quality.coerce_types(
            _raw(s, d, "google_ads").select(
                *[F.col(f"`{r}`").alias(u) for u, r in PLATFORM_COLUMNS["google_ads"].items()],
                F.lit("google_ads").alias("channel"), *LINEAGE)),
        "row_rules": lambda s, d: _errors_text(_norm_all(s, d)),
        "valid_rows": lambda s, d: quality.valid_rows(_norm_all(s, d)),
        "rejected_rows": lambda s, d: quality.rejected_rows(_norm_all(s, d)),
        "run_validation": lambda s, d: quality.validation_report(_norm_all(s, d)),
        "validation_result": lambda s, d: quality.run_validation(_norm_all(s, d)).combined(),
        "type_profile": _profile,
        "type_errors": lambda s, d: profile.type_errors(_profile(s, d)),
        "coercion_counts": lambda s, d: profile.coercion_counts(
            normalize_all(_raws(s, d, by_file=True), flags=True)),
        "facts_clean": lambda s, d: quality.facts_clean(_norm_all(s, d)),
        "file_summary": lambda s, d: quality.file_summary(_norm_all(s, d)),
        "metric_cpa": lambda s, d: _metric_rows(s, d).select("channel", "campaign_name", "cpa"),
        "metric_roas": lambda s, d: _metric_rows(s, d).select("channel", "campaign_name", "roas"),
        "metric_ctr": lambda s, d: _metric_rows(s, d).select("channel", "campaign_name", "ctr_pct"),
        "metric_cvr": lambda s, d: _metric_rows(s, d).select("channel", "campaign_name", "conversion_rate_pct"),
        "metric_delta": _metric_delta,
        "normalize_headers": lambda s, d: _headers(s, d).select(
            "file", F.array_join(detect.normalize_headers(F.col("names")), "|").alias("normalized")),
        "fingerprint": lambda s, d: _headers(s, d).select(
            "file", detect.fingerprint(F.col("names")).alias("fingerprint")),
        "confidence": lambda s, d: detect.platform_scores(_headers(s, d)).select(
            "file", "platform", "confidence"),
        "detect_platform": lambda s, d: detect.detect_platform(_headers(s, d)),
        "schema_errors": lambda s, d: quality.missing_raw_columns(_detected(s, d)).select(
            "file", "platform", "error"),
        "file_headers": _file_headers,
        "csv_scan": _csv_scan,
        "file_rejects": _file_rejects,
        "incremental_ingest": _incremental,
        "quoted_breaks": _quoted_breaks,
        "ledger_ingest": _ledger_ingest,
        "append_facts": _table_roundtrip(_append),
        "append_once": _table_roundtrip(_append_once),
        "weekly_incremental": _weekly_incremental,
        "split_by_channel": lambda s, d: _table_roundtrip(_split)(s, d).groupBy("channel").agg(
            F.count(F.lit(1)).alias("rows"),
            (F.sum(F.rint(F.col("spend") * 100).cast("bigint")).cast("double") / 100.0).alias("spend")),
        "replace_channel": _table_roundtrip(_replace),
        "unified_view": _unified_view,
        "export_facts": _export,
        "export_parquet": _export_parquet,
        "events_week_over_week": lambda s, d: reports.week_over_week(
            _events_facts(s, d), dims=["channel"]),
    }
    return q
