"""DuckDB oracle SQL for the ingest catalog entries."""

from __future__ import annotations

from spendlens.functions.dates import DATE_ARMS, SHORT_YEAR_ARMS, SHORT_YEAR_PIVOT
from spendlens.functions.numeric import INF_TOKENS, NUMBER_RE
from spendlens.operators.quality import MSG_FINITE
from spendlens.plans.oracle import ORDER_LINES, FACTS, q, title
from spendlens.schema import (CHANNEL_ENUM, EXPECTED_HEADERS, MISSING_TEXT,
                              MSG_CHANNEL, MSG_DATE_MISSING, MSG_GE_ZERO_FLOAT,
                              MSG_COERCED_DATE, MSG_COERCED_NUMBER,
                              MSG_GE_ZERO_INT, NA_TOKENS, PLATFORM_COLUMNS,
                              PLATFORMS, ROW_REJECT_TEXT)
from spendlens.sources.testdata import (HEADER_VARIANTS, RAW_CAMPAIGN_PREFIX,
                                        RAW_DATE_STRFTIME, variant_columns)


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lst(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def money_text(cents: str) -> str:
    return f"(CAST({cents} // 100 AS VARCHAR) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"


def raw_cte(p: str) -> str:
    prim, alt = RAW_DATE_STRFTIME[p]
    qty = "CAST(l_quantity AS BIGINT)"
    spend_c = "CAST(round_even(l_extendedprice * l_discount * 100, 0) AS BIGINT)"
    rev_c = "CAST(round_even(l_extendedprice * (1 - l_discount) * 100, 0) AS BIGINT)"
    qs = f"CAST({qty} AS VARCHAR)"
    vals = {
        "date": f"""CASE WHEN l_linenumber = 7 THEN 'INVALID' WHEN l_linenumber = 6 THEN '0000-00-00'
          WHEN l_linenumber = 5 THEN strftime(l_shipdate, {q(alt)}) ELSE strftime(l_shipdate, {q(prim)}) END""",
        "campaign_name": f"CASE WHEN {qty} = 26 THEN NULL ELSE {q(RAW_CAMPAIGN_PREFIX[p])} || o_orderpriority END",
        "spend": f"""CASE WHEN {qty} = 21 THEN '$' || {money_text(spend_c)} WHEN {qty} = 22 THEN 'nan'
          WHEN {qty} = 23 THEN '1,' || {money_text(spend_c)} WHEN {qty} = 27 THEN '0.575'
          ELSE {money_text(spend_c)} END""",
        "clicks": f"""CASE WHEN {qty} = 13 THEN '' WHEN {qty} = 14 THEN 'n/a' WHEN {qty} = 15 THEN '1,234'
          WHEN {qty} = 16 THEN {qs} || 'd' WHEN {qty} = 17 THEN ' ' || {qs} || ' '
          WHEN {qty} = 18 THEN '1e3' WHEN {qty} = 19 THEN '-3' WHEN {qty} = 20 THEN '10.7' ELSE {qs} END""",
        "impressions": f"CASE WHEN {qty} = 25 THEN 'inf' ELSE CAST({qty} * (l_linenumber + 1) * 10 AS VARCHAR) END",
        "conversions": f"""CASE WHEN {qty} = 28 THEN ''
          WHEN l_returnflag = 'N' AND c_mktsegment <> 'HOUSEHOLD' THEN '1.0' ELSE '0.0' END""",
        "revenue": f"CASE WHEN {qty} = 24 THEN '' ELSE {money_text(rev_c)} END",
    }
    cols = ",\n    ".join(f"{vals[u]} AS {ident(r)}" for u, r in PLATFORM_COLUMNS[p].items())
    return f"""raw_{p} AS (
  SELECT {cols},
    'raw_{p}' AS _source, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS _row,
    o_orderpriority AS __prio,
    'raw_{p}_' || {qs} || '_' || strftime(l_shipdate, '%Y%m') AS __file
  FROM order_lines)"""


def is_na(x: str) -> str:
    return f"({x} IS NULL OR {x} IN {lst(NA_TOKENS)})"


def parsed_number(x: str) -> str:
    parsed = (f"CASE WHEN NOT {is_na(x)} AND (regexp_full_match({x}, {q(NUMBER_RE)}) "
              f"OR lower(trim({x})) IN {lst(INF_TOKENS)}) THEN TRY_CAST({x} AS DOUBLE) END")
    return f"CASE WHEN isnan(({parsed})) THEN NULL ELSE ({parsed}) END"


def coerce(x: str) -> str:
    return f"COALESCE({parsed_number(x)}, CAST(0 AS DOUBLE))"


def money(x: str) -> str:
    return f"(round_even(({x}) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE))"


def count(x: str) -> str:
    return f"TRY_CAST(trunc({x}) AS BIGINT)"


def parse_date(x: str) -> str:
    s = f"regexp_replace(trim({x}), '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})T', '\\1 ')"
    arms = [f"CASE WHEN regexp_full_match({s}, {q(rx)}) THEN try_strptime({s}, {q(fmt)}) END"
            for rx, _, fmt in DATE_ARMS]
    wide = (f"(regexp_replace({s}, '\\d{{2}}$', '') || CASE WHEN CAST(right({s}, 2) AS INTEGER) "
            f">= {SHORT_YEAR_PIVOT} THEN '19' ELSE '20' END || right({s}, 2))")
    arms += [f"CASE WHEN regexp_full_match({s}, {q(rx)}) THEN try_strptime({wide}, {q(fmt)}) END"
             for rx, _, fmt in SHORT_YEAR_ARMS]
    return f"CAST(COALESCE({', '.join(arms)}) AS TIMESTAMP)"


def norm_cte(p: str) -> str:
    c = {u: ident(r) for u, r in PLATFORM_COLUMNS[p].items()}
    camp = c["campaign_name"]
    return f"""norm_{p} AS (
  SELECT {parse_date(c['date'])} AS date, {q(p)} AS channel,
    CASE WHEN {is_na(camp)} THEN {q(MISSING_TEXT)} ELSE {camp} END AS campaign_name,
    {money(coerce(c['spend']))} AS spend,
    {count(coerce(c['clicks']))} AS clicks,
    {count(coerce(c['impressions']))} AS impressions,
    {count(coerce(c['conversions']))} AS conversions,
    {money(coerce(c['revenue']))} AS revenue,
    _source, _row, __prio
  FROM raw_{p})"""


def with_raw(*ctes: str) -> str:
    parts = [ORDER_LINES, FACTS]
    parts += [raw_cte(p) for p in PLATFORMS] + [norm_cte(p) for p in PLATFORMS]
    parts.append("norm_all AS (" + " UNION ALL ".join(f"SELECT * FROM norm_{p}" for p in PLATFORMS) + ")")
    return "WITH " + ",\n".join(parts + list(ctes)) + "\n"


NORM_COLS = "date, channel, campaign_name, spend, clicks, impressions, conversions, revenue"


def rule_errors() -> str:
    def ge0(c: str, msg: str) -> str:
        return f"CASE WHEN {c} IS NULL OR isnan({c}) OR {c} < 0 THEN {q(msg)} END"
    parts = [
        f"CASE WHEN date IS NULL THEN {q(MSG_DATE_MISSING)} END",
        f"CASE WHEN channel IS NULL OR channel NOT IN {lst(CHANNEL_ENUM)} THEN {q(MSG_CHANNEL)} END",
        ge0("spend", MSG_GE_ZERO_FLOAT),
        *[f"CASE WHEN {c} IS NULL THEN {q(MSG_FINITE)} WHEN {c} < 0 THEN {q(MSG_GE_ZERO_INT)} END"
          for c in ("clicks", "impressions", "conversions")],
        ge0("revenue", MSG_GE_ZERO_FLOAT),
    ]
    return f"concat_ws('; ', {', '.join(parts)})"


def header_sets_cte() -> str:
    rows = []
    for p in PLATFORMS:
        for prio, v in HEADER_VARIANTS.items():
            names = "[" + ", ".join(q(n) for _, n in variant_columns(p, v)) + "]"
            rows.append(f"({q(p)}, {q(prio)}, {names})")
    return f"""layout(platform, prio, names) AS (VALUES {', '.join(rows)}),
hkeys AS (SELECT DISTINCT o_orderpriority AS prio, o_custkey AS account FROM orders),
headers AS (
  SELECT 'raw_' || platform || '_' || replace(prio, ' ', '_') || '_' || CAST(account AS VARCHAR) || '.csv' AS file,
         names, platform AS true_platform
  FROM hkeys JOIN layout USING (prio))"""


def norm_name(x: str) -> str:
    return (f"regexp_replace(regexp_replace(lower(regexp_replace({x}, '[[:punct:]]', '', 'g')), "
            f"'\\s+', ' ', 'g'), '^ | $', '', 'g')")


def sig_cte() -> str:
    rows = ", ".join(
        f"({q(p)}, {i}, [{', '.join(q(n) for n in sorted(EXPECTED_HEADERS[p]))}])"
        for i, p in enumerate(PLATFORMS))
    return f"""sigs(platform, ord, expected) AS (VALUES {rows}),
hnorm AS (
  SELECT file, names, list_transform(names, lambda n: {norm_name('n')}) AS nn FROM headers),
scores AS (
  SELECT file, platform, ord,
    CAST(len(list_intersect(list_distinct(nn), expected)) AS DOUBLE) / len(expected) AS confidence,
    array_to_string(list_sort(nn), '|') = array_to_string(expected, '|') AS exact
  FROM hnorm, sigs),
det AS (
  SELECT file,
    COALESCE(min(CASE WHEN exact THEN platform END),
             CASE WHEN max(confidence) >= 0.70 THEN arg_max(platform, confidence * 10 - ord) END) AS platform,
    max(confidence) AS confidence
  FROM scores GROUP BY file)"""


def profile_sql() -> tuple[str, str, str]:
    """Type profiles, type errors and coercion counts, per file and column."""
    kinds, lost = [], []
    for p in PLATFORMS:
        for u, r in PLATFORM_COLUMNS[p].items():
            c = ident(r)
            whole = f"(regexp_full_match({c}, '\\s*[+-]?\\d+\\s*') AND TRY_CAST({c} AS BIGINT) IS NOT NULL)"
            date = f"({parse_date(c)} IS NOT NULL)" if u == "date" else "FALSE"
            kinds.append(f"""SELECT __file AS file, {q(p)} AS platform, {q(u)} AS unified, {q(r)} AS "column",
  count(*) AS rows, count(*) FILTER ({is_na(c)}) AS missing, count(*) FILTER ({whole}) AS integers,
  count(*) FILTER ({parsed_number(c)} IS NOT NULL) AS numbers, count(*) FILTER ({date}) AS dates FROM raw_{p} GROUP BY __file""")
            if u == "campaign_name":
                continue
            gone = f"{parse_date(c)} IS NULL" if u == "date" else f"{parsed_number(c)} IS NULL"
            pre, post = (MSG_COERCED_DATE if u == "date" else MSG_COERCED_NUMBER).replace("{column}", r).split("{values}")
            lost.append(f"""SELECT file, channel, "column", values, {q(pre)} || CAST(values AS VARCHAR) || {q(post)} AS message FROM (
  SELECT __file AS file, {q(p)} AS channel, {q(r)} AS "column", count(*) AS values FROM raw_{p} WHERE {gone} GROUP BY __file)""")
    profile = "profile AS (" + "\nUNION ALL ".join(kinds) + "),"
    typed = """typed AS (SELECT *, CASE
  WHEN unified = 'date' AND dates > 0 AND dates + missing = rows THEN 'datetime'
  WHEN integers = rows THEN 'integer' WHEN numbers + missing = rows THEN 'float' ELSE 'text' END AS inferred FROM profile)"""
    base = with_raw(profile + "\n" + typed)
    names = {"date": "datetime", "campaign_name": "string", "spend": "float", "revenue": "float",
             "clicks": "integer", "impressions": "integer", "conversions": "integer"}
    checks = " ".join(
        f"WHEN unified = {q(u)} AND inferred <> {q('text' if k == 'string' else k)} THEN {q(f"Column '{u}' is not a valid {k} type.")}"
        for u, k in names.items())
    errors = base + f"""SELECT file, "column", inferred, error FROM (
  SELECT *, CASE {checks} END AS error FROM typed) WHERE error IS NOT NULL"""
    return (base + 'SELECT file, platform, unified, "column", rows, missing, integers, numbers, dates FROM profile',
            errors, with_raw() + "\nUNION ALL ".join(lost))


def ingest_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    for key, unified, fn in (("coerce_numeric", "clicks", coerce),
                             ("coerce_int", "impressions", lambda x: count(coerce(x))),
                             ("round_money", "spend", lambda x: money(coerce(x))),
                             ("parse_dates", "date", parse_date)):
        parts = [f"SELECT _source, _row, {ident(PLATFORM_COLUMNS[p][unified])} AS raw, "
                 f"{fn(ident(PLATFORM_COLUMNS[p][unified]))} AS value FROM raw_{p}" for p in PLATFORMS]
        s[key] = with_raw() + " UNION ALL ".join(parts)
    for p, key in (("google_ads", "normalize_google_ads"), ("facebook", "normalize_facebook"),
                   ("email", "normalize_email"), ("seo", "normalize_seo")):
        s[key] = with_raw() + f"SELECT {NORM_COLS}, _source, _row FROM norm_{p}"
    s["normalize_all"] = with_raw() + f"SELECT {NORM_COLS}, _source, _row FROM norm_all"
    s["raw_facts"] = s["normalize_all"]
    g = {u: ident(r) for u, r in PLATFORM_COLUMNS["google_ads"].items()}
    s["coerce_types"] = with_raw() + f"""SELECT {parse_date(g['date'])} AS date,
  'google_ads' AS channel, COALESCE(CAST({g['campaign_name']} AS VARCHAR), 'nan') AS campaign_name,
  {coerce(g['spend'])} AS spend,
  COALESCE({count(coerce(g['clicks']))}, 0) AS clicks,
  COALESCE({count(coerce(g['impressions']))}, 0) AS impressions,
  COALESCE({count(coerce(g['conversions']))}, 0) AS conversions,
  {coerce(g['revenue'])} AS revenue, _source, _row
FROM raw_google_ads"""
    s["row_rules"] = with_raw() + f"SELECT {NORM_COLS}, _source, _row, {rule_errors()} AS errors FROM norm_all"
    s["valid_rows"] = with_raw() + f"SELECT {NORM_COLS}, _source, _row FROM norm_all WHERE {rule_errors()} = ''"
    pre, post = ROW_REJECT_TEXT.split("{row}")
    mid, end = post.split("{errors}")
    s["rejected_rows"] = with_raw() + f"""SELECT _source AS source, _row AS row,
  {q(pre)} || CAST(_row AS VARCHAR) || {q(mid)} || {rule_errors()} || {q(end)} AS message
FROM norm_all WHERE {rule_errors()} <> ''"""
    s["run_validation"] = with_raw() + f"""SELECT _source AS source, CAST(COUNT(*) AS BIGINT) AS rows,
  CAST(SUM(CASE WHEN {rule_errors()} = '' THEN 1 ELSE 0 END) AS BIGINT) AS valid_rows,
  CAST(SUM(CASE WHEN {rule_errors()} <> '' THEN 1 ELSE 0 END) AS BIGINT) AS rejected_rows,
  SUM(CASE WHEN {rule_errors()} <> '' THEN 1 ELSE 0 END) = 0 AS is_valid
FROM norm_all GROUP BY _source"""
    s["validation_result"] = with_raw() + f"""SELECT _source AS source, _row AS row, {rule_errors()} = '' AS accepted,
  CASE WHEN {rule_errors()} <> '' THEN {q(pre)} || CAST(_row AS VARCHAR) || {q(mid)} || {rule_errors()} || {q(end)} END AS message,
  (SELECT COUNT(*) = 0 FROM norm_all WHERE {rule_errors()} <> '') AS is_valid
FROM norm_all"""
    s["type_profile"], s["type_errors"], s["coercion_counts"] = profile_sql()
    s["facts_clean"] = with_raw() + f"SELECT {NORM_COLS}, _source, _row FROM norm_all WHERE date IS NOT NULL"
    show = lambda c: f"COALESCE(strftime({c}, '%Y-%m-%d %H:%M:%S'), 'NaT')"
    s["file_summary"] = with_raw() + f"""SELECT _source AS file, {title('channel')} AS platform,
  CAST(COUNT(*) AS BIGINT) AS rows_loaded, MIN(date) AS date_min, MAX(date) AS date_max,
  {show('MIN(date)')} || ' to ' || {show('MAX(date)')} AS date_range
FROM norm_all GROUP BY _source, channel"""
    summ = """cs AS (
  SELECT channel, campaign_name,
    CAST(SUM(CAST(round_even(spend * 100, 0) AS BIGINT)) AS DOUBLE) / 100 AS s,
    CAST(SUM(CAST(round_even(revenue * 100, 0) AS BIGINT)) AS DOUBLE) / 100 AS r,
    CAST(SUM(clicks) AS DOUBLE) AS cl, CAST(SUM(impressions) AS DOUBLE) AS im,
    CAST(SUM(conversions) AS DOUBLE) AS cv
  FROM facts GROUP BY channel, campaign_name)"""
    base = "WITH " + ",\n".join([ORDER_LINES, FACTS, summ]) + "\n"
    s["metric_cpa"] = base + "SELECT channel, campaign_name, CASE WHEN cv <> 0 THEN s / cv END AS cpa FROM cs"
    s["metric_roas"] = base + "SELECT channel, campaign_name, CASE WHEN s <> 0 THEN r / s END AS roas FROM cs"
    s["metric_ctr"] = base + ("SELECT channel, campaign_name, CASE WHEN im <> 0 THEN cl / im END * "
                              "CAST(100 AS DOUBLE) AS ctr_pct FROM cs")
    s["metric_cvr"] = base + ("SELECT channel, campaign_name, CASE WHEN cl <> 0 THEN cv / cl END * "
                              "CAST(100 AS DOUBLE) AS conversion_rate_pct FROM cs")
    wk = """wk AS (
  SELECT channel, CAST(date_trunc('week', date) AS TIMESTAMP) AS week_start,
    CAST(SUM(CAST(round_even(revenue * 100, 0) AS BIGINT)) AS DOUBLE) / 100 AS r,
    CAST(SUM(conversions) AS DOUBLE) AS c
  FROM facts GROUP BY channel, week_start)"""

    def dl(m: str) -> str:
        prev = f"LAG({m}) OVER (PARTITION BY channel ORDER BY week_start)"
        return f"CASE WHEN {prev} <> 0 THEN ({m} - {prev}) / {prev} END * CAST(100 AS DOUBLE)"
    s["metric_delta"] = "WITH " + ",\n".join([ORDER_LINES, FACTS, wk]) + f"""
SELECT channel, week_start, {dl('r')} AS revenue_delta_pct, {dl('c')} AS conversions_delta_pct FROM wk"""
    hb = "WITH " + ",\n".join([ORDER_LINES, header_sets_cte()]) + "\n"
    s["normalize_headers"] = hb + (f"SELECT file, array_to_string(list_transform(names, lambda n: "
                                   f"{norm_name('n')}), '|') AS normalized FROM headers")
    s["fingerprint"] = hb + (f"SELECT file, array_to_string(list_sort(list_transform(names, lambda n: "
                             f"{norm_name('n')})), '|') AS fingerprint FROM headers")
    hs = "WITH " + ",\n".join([ORDER_LINES, header_sets_cte(), sig_cte()]) + "\n"
    s["confidence"] = hs + "SELECT file, platform, confidence FROM scores"
    s["detect_platform"] = hs + "SELECT file, platform, confidence FROM det"
    req = "CASE " + " ".join(
        f"WHEN d.platform = {q(p)} THEN [{', '.join(q(n) for n in PLATFORM_COLUMNS[p].values())}]"
        for p in PLATFORMS) + " END"
    s["schema_errors"] = hs + f"""SELECT file, platform, 'Missing required columns: ' || array_to_string(m, ', ') AS error
FROM (SELECT h.file, d.platform, list_sort(list_filter({req}, lambda x: NOT list_contains(h.names, x))) AS m
      FROM headers h JOIN det d USING (file) WHERE d.platform IS NOT NULL)
WHERE len(m) > 0"""
    layouts = []
    for p in PLATFORMS:
        for prio, v in HEADER_VARIANTS.items():
            names = [n for _, n in variant_columns(p, v)]
            raw = list(PLATFORM_COLUMNS[p].values())
            if v == "four":
                stage, reason = "detect", "platform not recognised from the header"
            elif v in ("upper", "five"):
                stage = "schema"
                reason = "Missing required columns: " + ", ".join(sorted(set(raw) - set(names)))
            else:
                stage, reason = None, None
            layouts.append((p, prio, ",".join(names), stage, reason))
    vals = ", ".join(f"({q(p)}, {q(prio)}, {q(h)}, {q(st) if st else 'NULL'}, {q(rs) if rs else 'NULL'})"
                     for p, prio, h, st, rs in layouts)
    lay = (f"exports(platform, prio, header, stage, reason) AS (VALUES {vals}),\n"
           "present AS (SELECT DISTINCT o_orderpriority AS prio FROM order_lines)")
    lb = "WITH " + ",\n".join([ORDER_LINES, lay]) + "\n"
    export = "platform || '_' || replace(prio, ' ', '_')"
    s["file_headers"] = lb + f"SELECT {export} AS export, header FROM exports JOIN present USING (prio)"
    s["file_rejects"] = lb + (f"SELECT {export} AS export, stage, reason FROM exports JOIN present USING (prio) "
                              "WHERE stage IS NOT NULL")
    accepted = [prio for prio, v in HEADER_VARIANTS.items() if v in ("exact", "extra")]
    s["csv_scan"] = with_raw() + f"SELECT {NORM_COLS} FROM norm_all WHERE __prio IN {lst(accepted)}"
    s["incremental_ingest"] = with_raw() + f"SELECT {NORM_COLS} FROM norm_all"
    s["append_facts"] = s["incremental_ingest"]
    s["append_once"] = s["incremental_ingest"]
    late = [prio for prio, v in HEADER_VARIANTS.items() if v in ("exact", "extra", "upper")]
    s["ledger_ingest"] = with_raw() + f"SELECT {NORM_COLS} FROM norm_all WHERE __prio IN {lst(late)}"
    s["quoted_breaks"] = with_raw() + f"""SELECT date, channel, CASE WHEN campaign_name = {q(MISSING_TEXT)} THEN campaign_name
  ELSE campaign_name || chr(10) || 'note "' || chr(10) || '", end' END AS campaign_name,
  spend, clicks, impressions, conversions, revenue FROM norm_all"""
    s["split_by_channel"] = "WITH " + ",\n".join([ORDER_LINES, FACTS]) + """
SELECT channel, CAST(COUNT(*) AS BIGINT) AS rows,
  CAST(SUM(CAST(round_even(spend * 100, 0) AS BIGINT)) AS DOUBLE) / 100 AS spend
FROM facts GROUP BY channel"""
    ev = """ev AS (
  SELECT CAST(ts AS TIMESTAMP) AS date, event_type AS channel, 'events' AS campaign_name,
    CAST(0 AS DOUBLE) AS spend, CAST(1 AS BIGINT) AS clicks, CAST(1 AS BIGINT) AS impressions,
    CAST(0 AS BIGINT) AS conversions,
    round_even(value * {scale} * 100, 0) / 100 AS revenue
  FROM events)"""
    fb = "WITH " + ",\n".join([ORDER_LINES, FACTS, ev.format(scale="CAST(2 AS DOUBLE)")]) + "\n"
    s["replace_channel"] = fb + f"SELECT {NORM_COLS} FROM facts UNION ALL SELECT {NORM_COLS} FROM ev"
    fb1 = "WITH " + ",\n".join([ORDER_LINES, FACTS, ev.format(scale="CAST(1 AS DOUBLE)")]) + "\n"
    s["unified_view"] = fb1 + f"SELECT {NORM_COLS} FROM facts UNION ALL SELECT {NORM_COLS} FROM ev"
    s["weekly_incremental"] = "WITH " + ",\n".join([ORDER_LINES, FACTS]) + """
SELECT channel, CAST(date_trunc('week', date) AS TIMESTAMP) AS week_start,
  CAST(SUM(CAST(round_even(spend * 100, 0) AS BIGINT)) AS DOUBLE) / 100 AS total_spend,
  CAST(SUM(CAST(round_even(revenue * 100, 0) AS BIGINT)) AS DOUBLE) / 100 AS total_revenue,
  CAST(SUM(conversions) AS BIGINT) AS total_conversions
FROM facts GROUP BY channel, week_start"""
    s["export_parquet"] = "WITH " + ",\n".join([ORDER_LINES, FACTS]) + f"\nSELECT {NORM_COLS} FROM facts"
    s["export_facts"] = "WITH " + ",\n".join([ORDER_LINES, FACTS]) + f"\nSELECT {NORM_COLS} FROM facts"
    from spendlens.plans.oracle import wow_select
    ewk = """ewk AS (
  SELECT channel, CAST(date_trunc('week', date) AS TIMESTAMP) AS week_start,
    CAST(SUM(CAST(round_even(spend * 100, 0) AS BIGINT)) AS DOUBLE) / 100 AS total_spend,
    CAST(SUM(CAST(round_even(revenue * 100, 0) AS BIGINT)) AS DOUBLE) / 100 AS total_revenue,
    CAST(SUM(conversions) AS BIGINT) AS total_conversions
  FROM ev GROUP BY channel, week_start)"""
    s["events_week_over_week"] = "WITH " + ",\n".join(
        [ev.format(scale="CAST(1 AS DOUBLE)"), ewk]) + "\n" + wow_select("channel", "ewk")
    return s
