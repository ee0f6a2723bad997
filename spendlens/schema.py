"""Unified fact schema and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Unified fact table: one row per (date, channel, campaign) record.
# ---------------------------------------------------------------------------
FACT_COLUMNS = ["date", "channel", "campaign_name", "spend", "clicks",
                "impressions", "conversions", "revenue"]

FACT_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampNTZType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("campaign_name", T.StringType(), True),
    T.StructField("spend", T.DoubleType(), True),
    T.StructField("clicks", T.LongType(), True),
    T.StructField("impressions", T.LongType(), True),
    T.StructField("conversions", T.LongType(), True),
    T.StructField("revenue", T.DoubleType(), True),
])

MONEY_COLUMNS = ["spend", "revenue"]
COUNT_COLUMNS = ["clicks", "impressions", "conversions"]

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------

# Platforms in their fixed tie-break order (first wins a confidence tie).
PLATFORMS = ["google_ads", "facebook", "email", "seo"]

# Valid channel values for the row rules.
CHANNEL_ENUM = ["google_ads", "facebook", "email", "seo"]

# Raw export header -> unified column, per platform, in export column order.
PLATFORM_COLUMNS: dict[str, dict[str, str]] = {
    "google_ads": {
        "date": "Day", "campaign_name": "Campaign", "spend": "Cost",
        "clicks": "Clicks", "impressions": "Impressions",
        "conversions": "Conversions", "revenue": "Conv. value",
    },
    "facebook": {
        "date": "Reporting starts", "campaign_name": "Campaign name",
        "spend": "Amount spent (USD)", "clicks": "Link clicks",
        "impressions": "Impressions", "conversions": "Results",
        "revenue": "Purchase value",
    },
    "email": {
        "date": "Send Date", "campaign_name": "Campaign", "spend": "Cost",
        "clicks": "Clicks", "impressions": "Opens",
        "conversions": "Conversions", "revenue": "Revenue",
    },
    "seo": {
        "date": "Date", "campaign_name": "Page/Campaign",
        "spend": "Organic Cost", "clicks": "Organic Clicks",
        "impressions": "Organic Impressions",
        "conversions": "Goal Completions", "revenue": "Assisted Revenue",
    },
}

# Expected normalised header names per platform (detection confidence).
EXPECTED_HEADERS: dict[str, list[str]] = {
    "google_ads": ["day", "campaign", "cost", "clicks", "impressions",
                   "conversions", "conv value"],
    "facebook": ["reporting starts", "campaign name", "amount spent usd",
                 "link clicks", "impressions", "results", "purchase value"],
    "email": ["send date", "campaign", "cost", "opens", "clicks",
              "conversions", "revenue"],
    "seo": ["date", "pagecampaign", "organic cost", "organic clicks",
            "organic impressions", "goal completions", "assisted revenue"],
}

# Minimum confidence for a fuzzy header match.
DETECT_THRESHOLD = 0.70

# Tokens the CSV reader treats as missing (pandas' default list).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
             "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
             "None", "n/a", "nan", "null"]

# Text a missing campaign name turns into.
MISSING_TEXT = "nan"

# ROAS shown for zero spend with positive revenue, and the label cut-off.
ROAS_CAP = 9999.99
ROAS_LABEL_INFINITE_AT = 9999.0

# Efficiency score weights and the underperformer threshold.
SCORE_WEIGHT_ROAS = 0.70
SCORE_WEIGHT_CVR = 0.30
UNDERPERFORM_ROAS = 1.0

# Budget floor per row and the narrative thresholds on the mean score.
MIN_ALLOCATION = 0.05
STRONG_MEAN_SCORE = 70.0
WEAK_MEAN_SCORE = 40.0

# Flow (Sankey) node names.
FLOW_SOURCE = "Total Budget"
FLOW_SINK = "Revenue Generated"

# Narrative texts ({name}, {amount}, {pct} are filled per row).
TEXT_NO_DATA = "No data available for optimization insights."
TEXT_GAINER = ("**{name}** shows the highest efficiency potential; increasing "
               "its budget by ${amount} ({pct}%) is recommended to capitalize "
               "on its performance.")
TEXT_LOSER = ("**{name}** is currently over-funded relative to its efficiency "
              "score; reallocating ${amount} from this channel will improve "
              "overall portfolio ROI.")
TEXT_STRONG = ("Overall portfolio efficiency is strong, suggesting current "
               "allocations are well-optimized.")
TEXT_WEAK = ("Portfolio efficiency indicates significant room for "
             "improvement; consider reviewing campaign-level tactics "
             "alongside budget shifts.")

# Row-rule messages and the rejected-row sentence.
MSG_DATE_MISSING = "Value error, Date is missing"
MSG_CHANNEL = "Input should be 'google_ads', 'facebook', 'email' or 'seo'"
MSG_GE_ZERO_FLOAT = "Input should be greater than or equal to 0"
MSG_GE_ZERO_INT = "Input should be greater than or equal to 0"
ROW_REJECT_TEXT = ("Row {row}: Some values did not meet validation criteria "
                   "({errors}). This row has been excluded from the final "
                   "dataset.")
MSG_MISSING_COLUMNS = "Missing required columns: {cols}"

# Warnings about values that the normaliser had to replace.
MSG_COERCED_NUMBER = ("Column '{column}' contained {values} missing/blank/non-numeric "
                      "values. These have been filled with 0.")
MSG_COERCED_DATE = ("Column '{column}' contained {values} unparseable or invalid "
                    "date values. These rows have been set to NaT (missing date) "
                    "rather than blocking the upload.")

# KPI card labels, in display order.
KPI_LABELS = ["Total Spend", "Total Revenue", "Blended ROAS", "Blended CPA"]

# Chart metric ranking: metric -> (column candidates, title, value format).
METRIC_DISPLAY = {
    "roas": (["roas"], "ROAS by Channel", "ratio"),
    "cpa": (["cpa"], "Cost Per Acquisition by Channel", "money2"),
    "spend": (["spend", "total_spend"], "Total Spend by Channel", "money0"),
    "revenue": (["revenue", "total_revenue"], "Total Revenue by Channel", "money0"),
}
