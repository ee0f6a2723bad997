"""Randomised checks against independent implementations."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from spendlens.functions.dates import parse_dates
from spendlens.functions.numeric import round_money
from spendlens.plans.ingest_oracle import parse_date as sql_parse_date


def _random_date_texts(n, seed=11):
    rnd = random.Random(seed)
    months = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    out = []
    for _ in range(n):
        y = rnd.choice([1969, 1999, 2000, 2023, 2024, 2068, 2100])
        m = rnd.randint(0, 13)
        d = rnd.randint(0, 32)
        yy = f"{y % 100:02d}"
        mon = months[(m - 1) % 12] if 1 <= m <= 12 else "Xyz"
        out.append(rnd.choice([
            f"{y}-{m:02d}-{d:02d}", f"{y}-{m}-{d}", f"{y}/{m:02d}/{d:02d}", f"{y}{m:02d}{d:02d}",
            f"{m:02d}/{d:02d}/{y}", f"{d}/{m}/{y}", f"{m}/{d}/{yy}", f"{d:02d}-{mon}-{y}",
            f"{d}-{mon}-{yy}", f"{mon} {d}, {y}", f"{y}-{m:02d}-{d:02d}T10:30:00",
            f"{y}-{m:02d}-{d:02d} 7:05", " " + f"{y}-{m:02d}-{d:02d}" + " ", "garbage", ""]))
    return out


def test_parse_dates_matches_duckdb_strptime(spark):
    texts = _random_date_texts(400)
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
           .orderBy("i").select(parse_dates(F.col("t")).alias("v")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want = [r[0] for r in con.execute(f"SELECT {sql_parse_date('t')} FROM t ORDER BY i").fetchall()]
    mismatches = [(t, a, b) for t, a, b in zip(texts, got, want) if a != b]
    assert not mismatches, mismatches[:5]


def test_round_money_equals_numpy(spark):
    rnd = random.Random(5)
    xs = [rnd.choice([rnd.uniform(-1e6, 1e6), rnd.randint(0, 10 ** 6) / 1000, rnd.randint(0, 10 ** 5) / 200])
          for _ in range(500)]
    got = [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
           .orderBy("i").select(round_money(F.col("x")).alias("v")).collect()]
    assert got == [float(np.round(x, 2)) for x in xs]
