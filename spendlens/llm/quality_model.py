"""Quality classifier: kernel ridge scores over document statistics.

Statistics of every whole text are made once; random Fourier features approximate a
Gaussian kernel over them.  Each partition sums its share of the normal equations, the
driver adds a bounded number of them and solves; isotonic calibration over a histogram
of raw scores turns them into probabilities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, fold, grouped_bytes, table, texts, written
from .words import BYTE_VALUES, mix, prefix, runs, spans, windows, word_hashes

NAMES = ("log_words", "word_mean", "word_spread", "upper", "digit", "mark", "symbol", "shout", "high",
         "variety", "same_next", "repeat", "dup_lines", "line_words", "marked_words", "long_words")
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 17
SUMS = 16  # partial normal equations that reach the driver
BINS = 400
HELD_PARTS, HELD = 3, 1

CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 upper, 2 digit, 3 mark, 4 symbol, 5 !, 6 high, 7 lower, 8 space
CLASS[65:91], CLASS[48:58], CLASS[97:123], CLASS[128:] = 1, 2, 7, 6
CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 3
CLASS[[ord(c) for c in "#*$%&|<>@^~_=+{}[]\\/"]] = 4
CLASS[ord("!")] = 5
CLASS[[9, 10, 11, 12, 13, 32]] = 8
BREAK = np.zeros(256, dtype=bool)
BREAK[10] = True


def repeated(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each owner, how many of its values equal an earlier one."""
    keys = mix(values ^ mix(owner, 3))
    first = np.unique(keys, return_index=True)[1]
    return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)


def statistics(found: list[bytes]) -> np.ndarray:
    """(texts x len(NAMES)) statistics; an empty text has zeros."""
    n = len(found)
    hashes, starts, ends, first, data = word_hashes(found)
    sizes = np.array([len(t) for t in found])
    owner = np.repeat(np.arange(n), sizes + 1)[: len(data)]
    c = np.bincount(owner * 9 + CLASS[data], minlength=n * 9).reshape(n, 9).astype(float)
    chars = np.maximum(c[:, :8].sum(axis=1), 1)
    word = np.repeat(np.arange(n), np.diff(first))
    long = (ends - starts).astype(float)
    count = np.bincount(word, minlength=n).astype(float)
    some = np.maximum(count, 1)
    mean = np.bincount(word, long, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(word, long * long, minlength=n) / some - mean**2, 0))
    same = np.bincount(word[1:][(hashes[1:] == hashes[:-1]) & (word[1:] == word[:-1])], minlength=n) if len(word) else np.zeros(n)
    grams = windows(hashes, 5)
    inside = word[: len(grams)] == word[4 : 4 + len(grams)] if len(grams) else np.zeros(0, dtype=bool)
    repeat = repeated(grams[inside], word[: len(grams)][inside], n) if len(grams) else np.zeros(n)
    s, e = spans(data, BREAK)
    line_owner = owner[s] if len(s) else np.zeros(0, dtype=np.int64)
    lines = np.bincount(line_owner, minlength=n)
    dup = repeated(runs(prefix(BYTE_VALUES[data]), s, e), line_owner, n) if len(s) else np.zeros(n)
    last = CLASS[data[ends - 1]] if len(ends) else np.zeros(0, dtype=np.int64)
    marked = np.bincount(word[(last == 4) | (last == 5)], minlength=n)
    out = np.stack([np.log1p(count), np.minimum(mean, 50), np.minimum(spread, 50), c[:, 1] / chars, c[:, 2] / chars, c[:, 3] / chars,
                    c[:, 4] / chars, c[:, 5] / chars, c[:, 6] / chars, (count - repeated(hashes, word, n)) / np.sqrt(some), same / some,
                    repeat / some, dup / np.maximum(lines, 1), np.log1p(count / np.maximum(lines, 1)), marked / some,
                    np.bincount(word[long > 20], minlength=n) / some], axis=1)
    return np.where(sizes[:, None] > 0, out, 0.0)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) of each (doc_id, text)."""
    import pyarrow as pa

    def run(batches):
        for ids, found in grouped_bytes(batches):
            x = statistics(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.mapInArrow(run, "doc_id long, stats array<double>")


class Lift:
    """Standardised statistics -> random Fourier features (and a constant)."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        g = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = g.normal(0, 1 / WIDTH, (len(NAMES), FEATURES))
        self.b = g.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], axis=1)


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to y, one value for each x (sorted)."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w2, k = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * w2) / (u[1] + w2), u[1] + w2, u[2] + k]
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.zeros(0)


class Scorer:
    def __init__(self, lift: Lift, beta: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.lift, self.beta, self.x, self.y = lift, beta, x, y

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.beta

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1) if len(self.x) else np.full(len(stats), 0.5)


def train(stats: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on the labelled rows outside the held-out fold, all of them."""
    spark = stats.sparkSession
    cols = [F.col("stats")[i] for i in range(len(NAMES))]
    row = stats.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    got = np.array([x or 0.0 for x in row])
    lift = Lift(got[: len(NAMES)], got[len(NAMES) :])
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter(
        F.col("y").isin(0.0, 1.0) & (fold(F.col("doc_id"), HELD_PARTS) != HELD)).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = written(stats.join(known, "doc_id").select("doc_id", "stats", "y").repartition(SUMS, "doc_id"), "quality-train")
    shared = Shared(spark, lift)

    def sums(batches):
        import pandas as pd

        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for pdf in batches:
            if len(pdf):
                z = shared.value(np.stack(pdf["stats"].to_numpy()))
                a += z.T @ z
                b += z.T @ pdf["y"].to_numpy()
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    parts = rows.coalesce(SUMS).mapInPandas(sums, "a binary, b binary").collect()
    a = sum((np.frombuffer(r.a).reshape(FEATURES + 1, FEATURES + 1) for r in parts), np.zeros((FEATURES + 1, FEATURES + 1)))
    b = sum((np.frombuffer(r.b) for r in parts), np.zeros(FEATURES + 1))
    n = a[-1, -1]
    if not n:
        return Scorer(lift, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    penalty = np.full(FEATURES + 1, RIDGE * max(n, 1.0))
    penalty[-1] = 1e-9
    beta = np.linalg.solve(a + np.diag(penalty), b)
    model = Shared(spark, Scorer(lift, beta, np.zeros(0), np.zeros(0)))

    def binned(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                raw = model.value.raw(np.stack(pdf["stats"].to_numpy()))
                yield pd.DataFrame({"k": np.clip(np.floor(raw * BINS / 2), -BINS, BINS).astype(np.int64), "raw": raw, "y": pdf["y"]})

    hist = sorted(rows.mapInPandas(binned, "k long, raw double, y double").groupBy("k").agg(
        F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).collect())
    x, y, w = (np.array([r[c] for r in hist], dtype=float) for c in ("x", "y", "n"))
    return Scorer(lift, beta, x, monotone(x, y, w))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, stats, score) of every row of ``docs``.

    NULL and empty texts have zero statistics and are scored like any other.  Labels that
    are NULL or not 0 or 1 teach nothing; of repeated labels the larger counts.  Without any
    label every score is 0.5.  Repeated rows score alike.
    """
    import pyarrow as pa

    stats = written(describe(texts(docs)), "quality-stats")
    shared = Shared(docs.sparkSession, train(stats, labels))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), dtype=float)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value(x))], names=["doc_id", "stats", "score"])

    return stats.mapInArrow(run, "doc_id long, stats array<double>, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the quality of every document; learns outside the held-out fold."""
    out = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id"), HELD_PARTS) == HELD, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
