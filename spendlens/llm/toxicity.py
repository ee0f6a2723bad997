"""Toxicity by multiple-instance learning.

Documents carry the labels, sentences are scored: a logistic model over a sentence's
words, joined by noisy-or to the document's probability 1 - prod(1 - p).  Training
(numpy, on a bounded sample of labelled documents) needs document labels only; the
sentence scores then locate what offends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, fold, grouped_bytes, table, texts
from .words import Vocabulary, spans, word_hashes

#: Bound of the training sample: about so many labelled documents of each class.
SAMPLE_PER_CLASS = 4000
#: A word counts as a feature from so many sampled documents on.
LEAST_DOCS = 5
#: ... and if toxic documents hold it more often than chance would, by so many standard deviations.
LEAST_DEVIATIONS = 5.0
EPOCHS, RATE, PENALTY = 60, 0.1, 1e-5
START = -7.0
HELD_PARTS, HELD = 4, 2
OFFENDS = 0.3

# letters and digits make words (ASCII capitals folded, all else is a gap); . ! ? and line breaks end sentences
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
GAP = np.ones(256, dtype=bool)
GAP[48:58] = GAP[97:123] = False
GAP[128:] = False
NO_END = np.zeros(256, dtype=bool)
NO_END[[10, 33, 46, 63]] = True


def sentences(found: list[bytes]):
    """(word hashes, sentence of each word, document of each sentence, starts, ends) of several texts."""
    hashes, starts, _, _, data = word_hashes(found, GAP, FOLD)
    s, e = spans(data, NO_END)
    offsets = np.cumsum([0, *(len(t) + 1 for t in found)])
    doc = np.searchsorted(offsets, s, side="right") - 1
    return hashes, np.searchsorted(s, starts, side="right") - 1, doc, s - offsets[doc], e - offsets[doc]


class Model:
    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    def sentence_logits(self, hashes: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        word = self.vocabulary.find(hashes)
        known = word >= 0
        return self.bias + np.bincount(sentence[known], self.weights[word[known]], minlength=n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def log_none(logits: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(logits))."""
    return -np.logaddexp(0, logits)


def train(found: list[bytes], labels: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam on the weighted log-loss of the noisy-or; without both classes nothing offends."""
    if not len(found) or labels.min() == labels.max():
        return Model(Vocabulary(np.zeros(0, dtype=np.uint64)), np.zeros(0), -30.0)
    parts, sents, docs, at_s = [], [], [], 0
    for k in range(0, len(found), 200):
        h, s, d, _, _ = sentences(found[k : k + 200])
        parts.append(h), sents.append(s + at_s), docs.append(d + k)
        at_s += len(d)
    h, s, d = np.concatenate(parts), np.concatenate(sents), np.concatenate(docs)
    kinds, word = np.unique(h, return_inverse=True)
    pairs = np.unique(word.astype(np.int64) * len(found) + d[s])
    df = np.bincount(pairs // len(found), minlength=len(kinds))
    toxic = np.bincount(pairs // len(found), labels[pairs % len(found)], minlength=len(kinds))
    base = labels.mean()
    excess = (toxic - df * base) / np.sqrt(df * base * (1 - base))
    keep = np.flatnonzero((df >= LEAST_DOCS) & (excess >= LEAST_DEVIATIONS))
    number = np.full(len(kinds), -1)
    number[keep] = np.arange(len(keep))
    word = number[word]
    s, word = s[word >= 0], word[word >= 0]
    share = weight / weight.sum()
    w = np.append(np.log((toxic[keep] + 0.5) / base) - np.log((df[keep] - toxic[keep] + 0.5) / (1 - base)), START)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        z = w[-1] + np.bincount(s, w[word], minlength=len(d))
        none = np.bincount(d, log_none(z), minlength=len(found))
        p = sigmoid(z)
        odds = np.exp(none) / np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(labels == 1, -np.minimum(odds, 1e3), 1.0) * share
        dz = pull[d] * p
        g = np.append(np.bincount(word, dz[s], minlength=len(keep)) + PENALTY * w[:-1], dz.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    used = np.flatnonzero(w[:-1])
    return Model(Vocabulary(kinds[keep][used]), w[:-1][used], float(w[-1]))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS):
    """Texts, labels and weights of about ``per_class`` hashed labelled documents a class, outside
    the held-out fold.  The bound on the sampled labels is what makes them safe to broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), HELD_PARTS) != HELD)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, per_class / n) for k, n in counts.items()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 20)) / float(1 << 20)
    some = known.filter(unit < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    rows = texts(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").collect()
    rows = sorted({(r.text or "", r.toxic): r for r in rows}.values(), key=lambda r: (r.doc_id, r.text or ""))  # copies teach once
    y = np.array([r.toxic for r in rows], dtype=np.int64)
    return [(r.text or "").encode() for r in rows], y, np.array([1 / share[k] for k in y.tolist()])


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, worst, worst_start, worst_end, n_offending) for each (doc_id, text):
    the noisy-or score, and the worst sentence's score and byte span."""
    import pyarrow as pa

    shared = Shared(docs.sparkSession, model)

    def run(batches):
        m = shared.value
        for ids, found in grouped_bytes(batches):
            hashes, sent, doc, start, end = sentences(found)
            z = m.sentence_logits(hashes, sent, len(doc))
            score = -np.expm1(np.bincount(doc, log_none(z), minlength=len(ids)))
            p = sigmoid(z)
            worst, a, e = np.zeros(len(ids)), np.full(len(ids), -1), np.full(len(ids), -1)
            order = np.lexsort((-start, p, doc))  # last of each document: highest score, then first place
            last = order[np.flatnonzero(np.append(doc[order][1:] != doc[order][:-1], True))] if len(order) else order
            worst[doc[last]], a[doc[last]], e[doc[last]] = p[last], start[last], end[last]
            n = np.bincount(doc[p >= OFFENDS], minlength=len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.clip(score, 0, 1)), pa.array(worst), pa.array(a, pa.int64()), pa.array(e, pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "score", "worst", "worst_start", "worst_end", "n_offending"])

    return docs.mapInArrow(run, "doc_id long, score double, worst double, worst_start long, worst_end long, n_offending long")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every row of ``docs``, learnt from ``labels`` outside the held-out fold.

    NULL and empty texts have no sentence: score 0, worst 0, places -1.  Rows with a NULL
    label or id teach nothing; of repeated labels the larger counts.  Repeated rows score alike.
    """
    return apply(texts(docs), train(*sample(docs, labels)))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: toxicity of every document, and its worst sentence."""
    out = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id"), HELD_PARTS) == HELD, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst", "worst_start", "worst_end", "n_offending")
