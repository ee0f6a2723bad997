"""Importance resampling towards a target distribution, with features hashed from running CRCs.

A text is lower-cased (A-Z) and its words are joined by single separators.  That string is scanned
once, and the CRC-32 of its prefix is kept at every word's end.  The CRC of a concatenation is the
first part's CRC, shifted over the second's bytes by a linear map over GF(2), xor the second's CRC;
so the CRC of any run of words follows from two prefixes, the shifted first cancelled from the
second.  A feature's bucket is its CRC modulo the number of buckets.  Counts of the buckets in the
corpus and in the target give each bucket a gain, a document's weight is the mean gain of its
features, and weights plus Gumbel noise, sorted, draw documents without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_bytes, table, texts, written
from .ranking import numbered

GRAMS, BUCKETS = 2, 10000
SEED, PERCENT, LEAST_WORDS = 7, 25, 20
#: The CRC-32 polynomial, bits reversed, and the word separator.
POLYNOMIAL, SEPARATOR = 0xEDB88320, 0x20
_FULL = np.uint32(0xFFFFFFFF)
_LOW = np.uint32(0xFF)
_EIGHT = np.uint32(8)


def byte_table() -> np.ndarray:
    """What one byte's low bits become after eight steps of the CRC register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


STEP = byte_table()


class Shift:
    """CRCs moved over any number of following zero bytes: a map linear over GF(2), one table a power of two."""

    def __init__(self):
        c = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.tables = [self.spread((c >> _EIGHT) ^ STEP[c & _LOW])]  # over one byte, of each single bit

    @staticmethod
    def spread(images: np.ndarray) -> np.ndarray:
        """(4 x 256) results of every byte of a CRC, from those of its 32 bits."""
        out = np.zeros((4, 256), dtype=np.uint32)
        for k in range(32):
            has = (np.arange(256) >> (k % 8)) & 1 == 1
            out[k // 8, has] ^= images[k]
        return out

    @staticmethod
    def apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return t[0][c & _LOW] ^ t[1][(c >> _EIGHT) & _LOW] ^ t[2][(c >> np.uint32(16)) & _LOW] ^ t[3][c >> np.uint32(24)]

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, k = crcs.copy(), 0
        while len(lengths) and int(lengths.max()) >> k:
            if len(self.tables) <= k:  # twice as far: the last map applied to its own images
                last = self.tables[-1]
                bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
                self.tables.append(self.spread(self.apply(last, self.apply(last, bits))))
            own = np.flatnonzero((lengths >> k) & 1)
            out[own] = self.apply(self.tables[k], out[own])
            k += 1
        return out


SHIFT = Shift()
#: A-Z to lower case; all that stands in no word becomes the separator.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else SEPARATOR if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


class Scan:
    """The prefix CRCs of several texts, each a run of words with a separator before every one."""

    def __init__(self, found: list[bytes]):
        own = [t.translate(FOLD).split() for t in found]
        self.first = np.cumsum([0, *map(len, own)])
        words = [w for t in own for w in t]
        run = lambda c, w: zlib.crc32(w, zlib.crc32(b" ", c))
        self.ends = np.fromiter(accumulate(words, run, initial=0), np.uint32, len(words) + 1)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        before = self.ends[:-1] ^ _FULL  # a word starts after its separator
        self.starts = (STEP[(before ^ np.uint32(SEPARATOR)) & _LOW] ^ (before >> _EIGHT)) ^ _FULL

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, text) of every run of k consecutive words of one text, joined by one separator."""
        n = np.maximum(np.diff(self.first) - k + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + self.first[:-1][text]
        until = np.concatenate([[0], np.cumsum(self.size + 1)])
        length = until[at + k] - until[at] - 1
        return self.ends[at + k] ^ SHIFT(self.starts[at], length), text


def features(found: list[bytes], grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of several texts, and the texts' word counts."""
    scan = Scan(found)
    parts = [scan.runs(k) for k in range(1, grams + 1)]
    bucket = np.concatenate([p[0] for p in parts]).astype(np.int64) % buckets
    return bucket, np.concatenate([p[1] for p in parts]), np.diff(scan.first)


def bucket_counts(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts: at most ``buckets`` rows leave a task or reach the driver."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for _, found in grouped_bytes(batches):
            total += np.bincount(features(found, grams, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    per_task = texts(docs).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the logarithm of its smoothed target share over its corpus share, floored."""
    size, s_all, t_all = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(corpus))
    ratio = lambda s, t: (float(t + 1) * s_all) / (float(s + 1) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(int(corpus[k]), int(target[k])))) for k in range(size)], dtype=np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise of a document in thousandths, from a hash of the seed and its id (a NULL id has no digits)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of (doc_id, text)."""
    import pyarrow as pa

    def run(batches):
        for ids, found in grouped_bytes(batches):
            bucket, text, words = features(found, grams, len(gain))
            n = np.bincount(text, minlength=len(ids))
            total = np.zeros(len(ids), dtype=np.int64)
            np.add.at(total, text, gain[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = weight + np.array([noise(i, seed) for i in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x.astype(np.int64)) for x in (words, n, weight, score))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``: ranks 1, 2, 3 ... are the
    draw of ``percent`` of the documents with at least ``least_words`` words, by the highest scores, ties to the
    smaller doc_id; the others' rank is NULL.

    ``target`` holds the texts (column ``text``) whose features the draw leans to.  NULL and empty
    texts have no features, a weight of 0 and no rank.  A NULL doc_id hashes as no digits and comes
    last among ties.  Rows that repeat an id are documents of their own; which of several equal ones has
    the lower rank is left open.  An empty target or corpus counts no features.  Other columns drop out.
    """
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(aim, grams, buckets))
    rows = written(scored(docs, gain, grams, seed), "scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = numbered(rows.filter(F.col("n_words") >= least_words), order, "drawn")
    drawn = placed.withColumn("rank", F.when(F.col("place") <= F.floor(F.col("total") * percent / 100), F.col("place")))
    short = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*out).unionByName(short.select(*out))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: a quarter of the documents drawn towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
