"""DuckDB SQL that states, independently of Spark, what each catalog query
must return.  Tables available to it: the driver's parquet views.

Shared fragments mirror the adapters: ``facts`` and ``raw_<platform>`` are
derived from lineitem ⋈ orders ⋈ customer with the same fixed rules.
"""

from __future__ import annotations

from spendlens.schema import (FLOW_SINK, FLOW_SOURCE, KPI_LABELS,
                              MIN_ALLOCATION, ROAS_CAP, SCORE_WEIGHT_CVR,
                              SCORE_WEIGHT_ROAS, STRONG_MEAN_SCORE,
                              TEXT_GAINER, TEXT_LOSER, TEXT_NO_DATA,
                              TEXT_STRONG, TEXT_WEAK, WEAK_MEAN_SCORE)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def cents_sum(col: str) -> str:
    return f"CAST(SUM(CAST(round_even({col} * 100, 0) AS BIGINT)) AS DOUBLE) / 100"


def round9(expr: str) -> str:
    return f"(round_even(({expr}) * CAST(1000000000 AS DOUBLE), 0) / CAST(1000000000 AS DOUBLE))"


def round2(expr: str) -> str:
    return f"(round_even(({expr}) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE))"


def title(expr: str) -> str:
    """Title case words split on blanks after '_' -> ' ' (Spark initcap)."""
    return (f"array_to_string(list_transform(string_split(replace({expr}, '_', ' '), ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def money0(expr: str) -> str:
    return f"('$' || format('{{:,.0f}}', {expr}))"


def currency(expr: str) -> str:
    return f"(CASE WHEN {expr} IS NULL OR isnan({expr}) THEN 'N/A' ELSE {money0(expr)} END)"


def roas_lbl(expr: str) -> str:
    return (f"(CASE WHEN {expr} IS NULL OR isnan({expr}) OR {expr} >= 9999.0 THEN '∞' "
            f"ELSE format('{{:.2f}}', {expr}) || 'x' END)")


def delta_lbl(expr: str) -> str:
    return (f"(CASE WHEN {expr} IS NULL OR isnan({expr}) OR {expr} = 0 THEN '—' "
            f"WHEN {expr} > 0 THEN '▲ ' || format('{{:.1f}}', abs({expr}) * CAST(100 AS DOUBLE)) || '%' "
            f"ELSE '▼ ' || format('{{:.1f}}', abs({expr}) * CAST(100 AS DOUBLE)) || '%' END)")


BRAND = "(l_discount = 0 AND l_returnflag = 'A')"

ORDER_LINES = """order_lines AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         l_returnflag, l_shipdate, o_orderpriority, c_mktsegment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN customer ON o_custkey = c_custkey)"""

FACTS = f"""facts AS (
  SELECT CAST(l_shipdate AS TIMESTAMP) AS date,
    CASE WHEN {BRAND} THEN 'brand' WHEN l_discount = 0 THEN 'organic'
         ELSE lower(c_mktsegment) END AS channel,
    o_orderpriority AS campaign_name,
    round_even(l_extendedprice * l_discount * 100, 0) / 100 AS spend,
    CASE WHEN {BRAND} THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS clicks,
    CAST(CAST(l_quantity AS BIGINT) * (l_linenumber + 1) * 10 AS BIGINT) AS impressions,
    CAST(CASE WHEN l_returnflag = 'N' AND c_mktsegment <> 'HOUSEHOLD' THEN 1 ELSE 0 END AS BIGINT) AS conversions,
    CASE WHEN {BRAND} THEN CAST(0 AS DOUBLE)
         ELSE round_even(l_extendedprice * (1 - l_discount) * 100, 0) / 100 END AS revenue
  FROM order_lines)"""


def with_facts(*ctes: str) -> str:
    return "WITH " + ",\n".join([ORDER_LINES, FACTS, *ctes]) + "\n"


def summary_cte(name: str = "summary", dims: str = "channel", src: str = "facts") -> str:
    return f"""{name}_t AS (
  SELECT {dims}, {cents_sum('spend')} AS total_spend, {cents_sum('revenue')} AS total_revenue,
    CAST(SUM(clicks) AS BIGINT) AS total_clicks,
    CAST(SUM(impressions) AS BIGINT) AS total_impressions,
    CAST(SUM(conversions) AS BIGINT) AS total_conversions
  FROM {src} GROUP BY {dims}),
{name} AS (
  SELECT *,
    CASE WHEN total_conversions = 0 THEN NULL
         ELSE total_spend / CAST(total_conversions AS DOUBLE) END AS cpa,
    CASE WHEN total_spend = 0 AND total_revenue > 0 THEN CAST({ROAS_CAP} AS DOUBLE)
         WHEN total_spend = 0 THEN NULL ELSE total_revenue / total_spend END AS roas,
    CASE WHEN total_impressions = 0 THEN NULL
         ELSE CAST(total_clicks AS DOUBLE) / CAST(total_impressions AS DOUBLE) END AS ctr,
    CASE WHEN total_clicks = 0 THEN NULL
         ELSE CAST(total_conversions AS DOUBLE) / CAST(total_clicks AS DOUBLE) END AS conversion_rate
  FROM {name}_t)"""


def pct_rank(col: str) -> str:
    v = f"(CASE WHEN isnan({col}) THEN NULL ELSE {col} END)"
    return (f"((CAST(RANK() OVER (ORDER BY {v} ASC NULLS LAST) AS DOUBLE) - 1 "
            f"+ (CAST(COUNT(*) OVER (PARTITION BY {v}) AS DOUBLE) + 1) / 2) "
            f"/ CAST(COUNT(*) OVER () AS DOUBLE))")


def scored_cte(dims: str = "channel", src: str = "summary", name: str = "scored") -> str:
    wr, wc = SCORE_WEIGHT_ROAS, SCORE_WEIGHT_CVR
    return f"""{name}_r AS (
  SELECT *, {pct_rank('roas')} AS r_roas, {pct_rank('conversion_rate')} AS r_cvr FROM {src}),
{name} AS (
  SELECT * EXCLUDE (r_roas, r_cvr),
    round_even(((r_roas * CAST({wr} AS DOUBLE) + r_cvr * CAST({wc} AS DOUBLE)) * CAST(100 AS DOUBLE))
               * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE) AS efficiency_score
  FROM {name}_r)"""


def alloc_ctes(dims: str = "channel", src: str = "scored", floor: float = MIN_ALLOCATION) -> str:
    return f"""al_st AS (
  SELECT COUNT(*) AS n,
    SUM(CASE WHEN efficiency_score = 0 THEN 1 ELSE 0 END) AS nz,
    SUM(CASE WHEN efficiency_score IS NULL OR isnan(efficiency_score) THEN 1 ELSE 0 END) AS nm,
    SUM(efficiency_score) AS tot
  FROM {src}),
al_c AS (
  SELECT s.*, al_st.*,
    greatest(CASE WHEN nm > 0 OR NOT (tot > 0) THEN CAST(1 AS DOUBLE) / n ELSE efficiency_score / tot END,
             CAST({floor} AS DOUBLE)) AS cap
  FROM {src} s, al_st),
alloc AS (
  SELECT al_c.* EXCLUDE (n, nz, nm, tot, cap),
    CASE WHEN n = 1 THEN CAST(1 AS DOUBLE) WHEN nz = n OR nm = n THEN CAST(1 AS DOUBLE) / n
         ELSE cap / ctot END AS suggested_pct
  FROM al_c, (SELECT SUM(cap) AS ctot FROM al_c) ct)"""


def comparison_cte(dims: str = "channel") -> str:
    return f"""cmp_in AS (SELECT * RENAME (total_spend AS spend) FROM alloc),
cmp_tot AS (SELECT {cents_sum('spend')} AS total FROM cmp_in),
comparison AS (
  SELECT {dims}, spend, roas, efficiency_score,
    CASE WHEN total > 0 THEN spend / total ELSE CAST(0 AS DOUBLE) END AS current_pct,
    spend AS current_spend,
    COALESCE(suggested_pct, 0) AS suggested_pct,
    COALESCE(suggested_pct, 0) * total AS suggested_spend,
    COALESCE(suggested_pct, 0) - CASE WHEN total > 0 THEN spend / total ELSE CAST(0 AS DOUBLE) END AS delta_pct,
    COALESCE(suggested_pct, 0) * total - spend AS delta_spend
  FROM cmp_in, cmp_tot)"""


def comparison_select(dims: str = "channel") -> str:
    return f"""SELECT {dims}, spend, roas, efficiency_score,
  {round9('current_pct')} AS current_pct, current_spend,
  {round9('suggested_pct')} AS suggested_pct, {round2('suggested_spend')} AS suggested_spend,
  {round9('delta_pct')} AS delta_pct, {round2('delta_spend')} AS delta_spend
FROM comparison"""


def weekly_cte(where: str = "", dims: str = "", name: str = "weekly") -> str:
    d = f"{dims}, " if dims else ""
    return f"""{name} AS (
  SELECT {d}CAST(date_trunc('week', date) AS TIMESTAMP) AS week_start,
    {cents_sum('spend')} AS total_spend, {cents_sum('revenue')} AS total_revenue,
    CAST(SUM(conversions) AS BIGINT) AS total_conversions
  FROM facts {where} GROUP BY {d}week_start)"""


def wow_select(dims: str = "", src: str = "weekly") -> str:
    part = f"PARTITION BY {dims} " if dims else ""
    d = f"{dims}, " if dims else ""

    def ch(m: str) -> str:
        prev = f"CAST(LAG({m}) OVER ({part}ORDER BY week_start) AS DOUBLE)"
        return f"CASE WHEN {prev} = 0 THEN NULL ELSE (CAST({m} AS DOUBLE) - {prev}) / {prev} END"
    return f"""SELECT {d}week_start, total_spend, total_revenue, total_conversions,
  {ch('total_spend')} AS spend_wow_pct, {ch('total_revenue')} AS revenue_wow_pct,
  {ch('total_conversions')} AS conversions_wow_pct
FROM {src}"""


def insights_sql(src: str = "comparison") -> str:
    def tpl(t: str) -> str:
        parts = t.replace("'", "''")
        return parts
    g_txt = tpl(TEXT_GAINER).split("{name}")
    g_rest = g_txt[1].split("{amount}")
    g_rest2 = g_rest[1].split("{pct}")
    l_txt = tpl(TEXT_LOSER).split("{name}")
    l_rest = l_txt[1].split("{amount}")
    gain = (f"'{g_txt[0]}' || {title('g_name')} || '{g_rest[0]}' || format('{{:,.0f}}', g_d) "
            f"|| '{g_rest2[0]}' || format('{{:+.1f}}', g_p * CAST(100 AS DOUBLE)) || '{g_rest2[1]}'")
    loss = (f"'{l_txt[0]}' || {title('l_name')} || '{l_rest[0]}' || format('{{:,.0f}}', abs(l_d)) "
            f"|| '{l_rest[1]}'")
    return f"""ins_a AS (
  SELECT COUNT(*) AS n, AVG(efficiency_score) AS m FROM {src}),
ins_g AS (
  SELECT channel AS g_name, delta_spend AS g_d, delta_pct AS g_p FROM {src}
  ORDER BY delta_spend DESC, suggested_pct DESC, channel LIMIT 1),
ins_l AS (
  SELECT channel AS l_name, delta_spend AS l_d FROM {src}
  ORDER BY delta_spend ASC, suggested_pct DESC, channel LIMIT 1),
ins AS (
  SELECT 0 AS ord, {q(TEXT_NO_DATA)} AS insight FROM ins_a WHERE n = 0
  UNION ALL SELECT 1, {gain} FROM ins_g WHERE g_d > 0
  UNION ALL SELECT 2, {loss} FROM ins_l WHERE l_d < 0
  UNION ALL SELECT 3, CASE WHEN m > {STRONG_MEAN_SCORE} THEN {q(TEXT_STRONG)}
                          WHEN m < {WEAK_MEAN_SCORE} THEN {q(TEXT_WEAK)} END
            FROM ins_a WHERE n > 0 AND (m > {STRONG_MEAN_SCORE} OR m < {WEAK_MEAN_SCORE}))
SELECT CAST(ord AS INTEGER) AS ord, insight FROM ins"""


# ---------------------------------------------------------------------------
# Oracle queries, keyed like the catalog.
# ---------------------------------------------------------------------------

CAMPAIGN = "channel, campaign_name"


def deviation_ctes() -> str:
    """Exact medians and median distances by channel and week, and the bucket bounds that hold them."""
    def bounds(x: str, name: str) -> str:
        shift = f"greatest(length(bin(abs({x}))) - 8, 0)"
        low = f"((abs({x}) >> {shift}) << {shift})"
        high = f"({low} + (CAST(1 AS BIGINT) << {shift}) - 1)"
        return f"{low} AS {name}_low, {high} AS {name}_high, ({low} + {high}) // 2 AS {name}"
    return f"""cents AS (SELECT *, CAST(date_trunc('week', date) AS TIMESTAMP) AS week_start, CAST(round_even(spend * 100, 0) AS BIGINT) AS v FROM facts),
mid0 AS (SELECT channel, week_start, count(*) AS rows, quantile_disc(v, 0.5) AS m FROM cents GROUP BY channel, week_start),
mid AS (SELECT channel, week_start, rows, {bounds('m', 'median')} FROM mid0),
mad0 AS (SELECT channel, week_start, quantile_disc(abs(v - median), 0.5) AS m FROM cents JOIN mid USING (channel, week_start) GROUP BY channel, week_start),
mad AS (SELECT channel, week_start, {bounds('m', 'mad')} FROM mad0),
dev AS (SELECT * FROM mid JOIN mad USING (channel, week_start))"""


def analytics_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["channel_summary"] = with_facts(summary_cte()) + "SELECT * FROM summary"
    s["campaign_summary"] = with_facts(summary_cte(dims=CAMPAIGN)) + "SELECT * FROM summary"
    s["cpa_by_channel"] = with_facts() + f"""SELECT channel, {cents_sum('spend')} AS total_spend,
  CAST(SUM(conversions) AS BIGINT) AS total_conversions,
  CASE WHEN SUM(conversions) = 0 THEN NULL
       ELSE ({cents_sum('spend')}) / CAST(SUM(conversions) AS DOUBLE) END AS cpa
FROM facts GROUP BY channel"""
    s["roas_by_channel"] = with_facts(f"""t AS (SELECT channel, {cents_sum('spend')} AS total_spend,
  {cents_sum('revenue')} AS total_revenue FROM facts GROUP BY channel)""") + f"""SELECT channel,
  total_spend, total_revenue,
  CASE WHEN total_spend = 0 AND total_revenue > 0 THEN CAST({ROAS_CAP} AS DOUBLE)
       WHEN total_spend = 0 AND total_revenue = 0 THEN NULL
       ELSE total_revenue / NULLIF(total_spend, 0) END AS roas,
  (total_spend = 0 AND total_revenue > 0) AS is_infinite_roas
FROM t"""
    s["weekly_totals"] = with_facts(weekly_cte()) + "SELECT * FROM weekly"
    s["week_over_week"] = with_facts(weekly_cte()) + wow_select()
    s["week_over_week_by_channel"] = with_facts(weekly_cte(dims="channel")) + wow_select("channel")
    s["week_over_week_one"] = with_facts(weekly_cte(where="WHERE channel = 'machinery'")) + wow_select()
    s["spend_revenue_flow"] = with_facts(f"""t AS (SELECT channel, {cents_sum('spend')} AS s,
  {cents_sum('revenue')} AS r FROM facts GROUP BY channel)""") + f"""SELECT {q(FLOW_SOURCE)} AS source,
  channel AS target, s AS value FROM t
UNION ALL SELECT channel, {q(FLOW_SINK)}, r FROM t"""
    blended = f"""blended AS (
  SELECT {cents_sum('spend')} AS total_spend, {cents_sum('revenue')} AS total_revenue,
    CAST(SUM(conversions) AS BIGINT) AS total_conversions,
    CAST(COUNT(DISTINCT channel) AS BIGINT) AS n_groups FROM facts),
blended2 AS (
  SELECT total_spend, total_revenue, total_conversions,
    CASE WHEN total_spend > 0 THEN total_revenue / total_spend END AS blended_roas,
    CASE WHEN total_conversions > 0 THEN total_spend / CAST(total_conversions AS DOUBLE) END AS blended_cpa,
    n_groups FROM blended)"""
    s["blended_kpis"] = with_facts(blended) + "SELECT * FROM blended2"
    s["weekly_ratios"] = with_facts(weekly_cte()) + """SELECT week_start, total_spend, total_revenue,
  COALESCE(CASE WHEN total_spend <> 0 THEN total_revenue / total_spend END, 0) AS roas,
  COALESCE(CASE WHEN total_conversions <> 0 THEN total_spend / CAST(total_conversions AS DOUBLE) END, 0) AS cpa
FROM weekly"""
    latest = f"""wow AS ({wow_select()}),
latest AS (
  SELECT week_start, spend_wow_pct AS spend_delta, revenue_wow_pct AS revenue_delta,
    revenue_wow_pct AS roas_delta, spend_wow_pct AS cpa_delta
  FROM wow WHERE week_start = (SELECT MAX(week_start) FROM wow))"""
    s["latest_deltas"] = with_facts(weekly_cte(), latest) + "SELECT * FROM latest"
    cards = " UNION ALL ".join(
        f"SELECT {i + 1} AS ord, {q(lbl)} AS label, {val} AS value_label, {delta_lbl(dc)} AS delta_label "
        f"FROM blended2, latest WHERE n_groups > 0"
        for i, (lbl, val, dc) in enumerate([
            (KPI_LABELS[0], currency("total_spend"), "spend_delta"),
            (KPI_LABELS[1], currency("total_revenue"), "revenue_delta"),
            (KPI_LABELS[2], roas_lbl("blended_roas"), "roas_delta"),
            (KPI_LABELS[3], currency("blended_cpa"), "cpa_delta")]))
    s["kpi_cards"] = with_facts(weekly_cte(), latest, blended) + cards
    dev = "WITH " + ",\n".join([ORDER_LINES, FACTS, deviation_ctes()])
    s["spend_deviations"] = dev + "\nSELECT * FROM dev"
    s["spend_outliers"] = dev + """
SELECT channel, week_start, campaign_name, spend, median, mad FROM cents JOIN dev USING (channel, week_start)
WHERE mad > 0 AND abs(v - median) / (mad * CAST(1.4826 AS DOUBLE)) > 3.5"""
    s["pct_rank_avg"] = with_facts(summary_cte(dims=CAMPAIGN)) + \
        f"SELECT channel, campaign_name, roas, {pct_rank('roas')} AS pct_rank FROM summary"
    s["flag_underperformers"] = with_facts(summary_cte(dims=CAMPAIGN)) + \
        "SELECT *, COALESCE((CASE WHEN isnan(roas) THEN NULL ELSE roas END) < 18.0, false) " \
        "AS underperforming FROM summary"
    s["efficiency_score"] = with_facts(summary_cte(), scored_cte()) + "SELECT * FROM scored"
    s["efficiency_score_by_campaign"] = with_facts(summary_cte(dims=CAMPAIGN),
                                                   scored_cte(CAMPAIGN)) + "SELECT * FROM scored"
    s["suggest_allocation"] = with_facts(summary_cte(), scored_cte(), alloc_ctes()) + \
        f"SELECT channel, {round9('suggested_pct')} AS suggested_pct FROM alloc"
    for key, dims in (("run_optimization", "channel"), ("run_optimization_by_campaign", CAMPAIGN)):
        s[key] = with_facts(summary_cte(dims=dims), scored_cte(dims), alloc_ctes(dims),
                            comparison_cte(dims)) + comparison_select(dims)
    s["current_vs_suggested"] = s["run_optimization"]
    s["optimization_insights"] = with_facts(summary_cte(), scored_cte(), alloc_ctes(),
                                            comparison_cte()).rstrip() + ",\n" + insights_sql()
    rank_parts = []
    for metric, col, ttl, lbl in (
            ("roas", "roas", "ROAS by Channel", "format('{:.2f}', v) || 'x'"),
            ("cpa", "cpa", "Cost Per Acquisition by Channel", "'$' || format('{:,.2f}', v)"),
            ("spend", "total_spend", "Total Spend by Channel", "'$' || format('{:,.0f}', v)"),
            ("revenue", "total_revenue", "Total Revenue by Channel", "'$' || format('{:,.0f}', v)")):
        rank_parts.append(
            f"SELECT {q(metric)} AS metric, {q(ttl)} AS title, channel, {title('channel')} AS display_name, "
            f"v AS value, {lbl} AS value_label FROM (SELECT channel, {col} AS v FROM summary) "
            f"WHERE v IS NOT NULL AND NOT isnan(v)")
    s["metric_ranking"] = with_facts(summary_cte()) + "\nUNION ALL ".join(rank_parts)
    s["budget_share"] = with_facts(summary_cte(), f"""tot AS (SELECT {cents_sum('total_spend')}
  AS total_spend_all FROM summary)""") + f"""SELECT channel, {title('channel')} AS display_name,
  total_spend AS spend,
  {round9('CASE WHEN total_spend_all <> 0 THEN total_spend / total_spend_all END')} AS share,
  total_spend_all, {currency('total_spend_all')} AS total_label
FROM summary, tot"""
    cmp_pct = """cp AS (
  SELECT channel,
    round_even(current_pct * CAST(100 AS DOUBLE) * CAST(10 AS DOUBLE), 0) / CAST(10 AS DOUBLE) AS c1,
    round_even(suggested_pct * CAST(100 AS DOUBLE) * CAST(10 AS DOUBLE), 0) / CAST(10 AS DOUBLE) AS s1
  FROM comparison)"""
    s["comparison_pct"] = with_facts(summary_cte(), scored_cte(), alloc_ctes(), comparison_cte(),
                                     cmp_pct) + f"""SELECT channel, {title('channel')} AS display_name,
  c1 AS current_pct_display, s1 AS suggested_pct_display,
  format('{{:.1f}}', c1) || '%' AS current_label, format('{{:.1f}}', s1) || '%' AS suggested_label
FROM cp"""
    flow = f"""flow AS (
  SELECT {q(FLOW_SOURCE)} AS source, channel AS target FROM facts
  UNION SELECT channel, {q(FLOW_SINK)} FROM facts),
nodes AS (
  SELECT label, CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN label = {q(FLOW_SOURCE)} THEN 0
      WHEN label = {q(FLOW_SINK)} THEN 2 ELSE 1 END, label) - 1 AS INTEGER) AS node_index
  FROM (SELECT source AS label FROM flow UNION SELECT target FROM flow))"""
    s["flow_nodes"] = with_facts(flow) + "SELECT * FROM nodes"
    s["flow_links"] = with_facts(f"""t AS (SELECT channel, {cents_sum('spend')} AS s,
  {cents_sum('revenue')} AS r FROM facts GROUP BY channel),
edges AS (SELECT {q(FLOW_SOURCE)} AS source, channel AS target, s AS value FROM t
  UNION ALL SELECT channel, {q(FLOW_SINK)}, r FROM t),
nodes AS (
  SELECT label, CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN label = {q(FLOW_SOURCE)} THEN 0
      WHEN label = {q(FLOW_SINK)} THEN 2 ELSE 1 END, label) - 1 AS INTEGER) AS node_index
  FROM (SELECT source AS label FROM edges UNION SELECT target FROM edges))""") + """SELECT e.source,
  e.target, ns.node_index AS source_index, nt.node_index AS target_index, e.value
FROM edges e JOIN nodes ns ON e.source = ns.label JOIN nodes nt ON e.target = nt.label"""
    return s


__all__ = ["analytics_sql", "with_facts", "q", "cents_sum", "round9", "round2", "title"]
