"""Language identification by a byte convolutional network.

Filters of widths 2, 3 and 4 over bytes (ASCII capitals folded), a rectifier, the
largest response of each filter within a window of fixed length, then a softmax.  It is trained in
numpy on a bounded sample of labelled windows and applied to every window of every
whole text; a document's language is the one with the highest mean log-probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, fold, grouped_bytes, table, texts

WIDTHS, FILTERS, LENGTH = (2, 3, 4), 16, 192
#: Bound of the training sample: about so many windows of each language.
SAMPLE_PER_LANG = 1200
STEPS, BATCH, RATE = 400, 128, 0.02
HELD_PARTS, HELD = 4, 2

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def cut(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x LENGTH bytes padded with 0, number of the text, bytes in the window)."""
    sizes = np.array([len(t) for t in found], dtype=np.int64)
    per = -(-sizes // LENGTH)
    out = np.zeros((int(per.sum()), LENGTH), dtype=np.uint8)
    flat, at = out.reshape(-1), 0
    for t, n in zip(found, per):
        flat[at * LENGTH : at * LENGTH + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += int(n)
    doc = np.repeat(np.arange(len(found)), per)
    first = np.cumsum(per) - per
    filled = np.minimum(LENGTH, sizes[doc] - (np.arange(len(doc)) - first[doc]) * LENGTH)
    return LOWER[out], doc, filled


class Network:
    def __init__(self, langs: list[str], seed: int = 5):
        g = np.random.default_rng(seed)
        self.langs = langs
        self.conv = {w: g.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = g.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), dtype=np.float32)
        self.pairs: dict | None = None

    def params(self) -> list[np.ndarray]:
        return [*(self.conv[w] for w in WIDTHS), self.out, self.bias]

    def responses(self, x: np.ndarray, w: int) -> np.ndarray:
        n = LENGTH - w + 1
        z = self.conv[w][0][x[:, :n]]
        for j in range(1, w):
            z += self.conv[w][j][x[:, j : j + n]]
        return z

    def freeze(self) -> None:
        """Tables of the responses to byte pairs, for fast application."""
        two = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        c = self.conv
        self.pairs = {2: two(c[2][0], c[2][1]), 3: two(c[3][0], c[3][1]), 4: (two(c[4][0], c[4][1]), two(c[4][2], c[4][3]))}

    def pooled(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        p, out = self.pairs, []
        out.append(p[2][pair].max(axis=1))
        z = p[3][pair[:, :-1]]
        z += self.conv[3][2][x[:, 2:]]
        out.append(z.max(axis=1))
        z = p[4][0][pair[:, :-2]]
        z += p[4][1][pair[:, 2:]]
        out.append(z.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1), 0)

    def log_probs(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(windows: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 5) -> Network | None:
    """Adam on the cross-entropy; None without data."""
    langs = sorted(set(labels))
    if not langs:
        return None
    x, doc, _ = cut(windows)
    y = np.array([langs.index(v) for v in labels])[doc]
    net, g = Network(langs, seed), np.random.default_rng(seed)
    by_class = [np.flatnonzero(y == k) for k in range(len(langs))]
    by_class = [c for c in by_class if len(c)]
    first = [np.zeros_like(p) for p in net.params()]
    second = [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        pick = np.concatenate([g.choice(c, -(-BATCH // len(by_class))) for c in by_class])
        xb, yb = x[pick], y[pick]
        rows, best, hidden = np.arange(len(pick)), {}, []
        for w in WIDTHS:
            z = net.responses(xb, w)
            best[w] = z.argmax(axis=1)
            hidden.append(np.take_along_axis(z, best[w][:, None, :], axis=1)[:, 0])
        h = np.maximum(np.concatenate(hidden, axis=1), 0)
        d = np.exp(net.log_probs(h))
        d[rows, yb] -= 1
        d /= len(pick)
        dh = (d @ net.out.T) * (h > 0)
        grads = []
        for k, w in enumerate(WIDTHS):
            part, grad = dh[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(net.conv[w])
            for j in range(w):
                np.add.at(grad[j], (xb[rows[:, None], best[w] + j], np.arange(FILTERS)[None, :]), part)
            grads.append(grad)
        grads += [h.T @ d + 1e-4 * net.out, d.sum(axis=0)]
        for p, m, v, gr in zip(net.params(), first, second, grads):
            m += 0.1 * (gr - m)
            v += 0.01 * (gr * gr - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net.freeze()
    return net


def sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> tuple[list[bytes], list[str]]:
    """One window of each of about ``per_lang`` hashed documents a language, outside the held-out fold."""
    d = docs.filter((fold(F.col("doc_id"), HELD_PARTS) != HELD) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in d.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_lang / n)).otherwise(share)
    unit = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    start = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.length("text") - LENGTH, F.lit(1)).cast("long")).cast("int") + 1
    rows = d.filter(unit < share).select(F.substring(F.col("text"), start, F.lit(LENGTH)).alias("t"), "lang", "doc_id").collect()
    rows.sort(key=lambda r: (r.doc_id, r.t))
    kept = [(r.t.encode()[:LENGTH], r.lang) for r in rows if r.t]
    return [t for t, _ in kept], [v for _, v in kept]


def apply(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of (doc_id, text, letters)."""
    import pyarrow as pa

    shared = Shared(docs.sparkSession, net)

    def run(batches):
        model = shared.value
        for batch in batches:
            letters = batch.column(2).to_pylist()
            at = 0
            for ids, found in grouped_bytes([batch]):
                flags, at = letters[at : at + len(ids)], at + len(ids)
                sums, total = None, np.zeros(len(ids))
                if model is not None:
                    x, doc, filled = cut(found)
                    sums = np.zeros((len(ids), len(model.langs)))
                    for a in range(0, len(x), 256):
                        part = model.log_probs(model.pooled(x[a : a + 256])) * filled[a : a + 256, None]
                        np.add.at(sums, doc[a : a + 256], part)
                    np.add.at(total, doc, filled)
                names, scores = [], []
                for k in range(len(ids)):
                    if not flags[k] or sums is None or not total[k]:
                        names.append("und")
                        scores.append(0.0)
                    else:
                        best = int(sums[k].argmax())
                        names.append(model.langs[best])
                        scores.append(float(np.exp(sums[k][best] / total[k])))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Language of every row of (doc_id, text, lang).

    NULL texts and texts without a letter give ``und`` with score 0.  A NULL lang is no
    label.  Without any label all rows give ``und``.  Repeated rows are predicted alike.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = train(*sample(d))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return apply(texts(d).select("doc_id", "text", letters), net)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the language of every document; learns outside the held-out fold."""
    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), HELD_PARTS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
