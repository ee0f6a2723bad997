"""Substring dedup over words: fixed-block anchors.

Every document is cut into non-overlapping blocks of 25 words, which are indexed; every
rolling window of 25 words of every document probes the index.  A run of 50 words holds a
whole block of any document it stands in, so a hit lies in every repeat of 50 words or
more.  About the hits the match is extended: the runs of 50 words there are compared
exactly (64-bit hashes of whole runs) to find those that start in a document with a
smaller id, and consecutive runs join to maximal repeats.

Hashes travel in packed rows (``packed``).  What repeats within a chunk of texts is
settled there and sent once, so that a passage that a third of all documents hold
costs each bucket one value a chunk.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_bytes, table, texts
from .packed import CHUNK, DONE, INDEX, PROBE, ROW, TEXTS, batch, by_bucket, chunk_numbers, dealt, rows_of, squeeze, unsqueeze
from .words import SPACE, spans, windows, word_hashes

WORDS, BLOCK = 50, 25
#: Hits are told in cells of so many words.
CELL = 32


def places(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of every run of k values that lies within one text; ``first`` as in word_hashes."""
    size = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    return np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + first[:-1][text], text


def anchors(batches, buckets: int):
    """Packed blocks and probes of (doc_id, text, key) rows, and each chunk's table of texts."""
    numbers = chunk_numbers()
    for ids, found, keys in with_keys(batches, CHUNK):
        hashes, _, _, first, _ = word_hashes(found)
        at, text = places(first, BLOCK)
        if not len(at):
            continue
        h = windows(hashes, BLOCK)[at]
        chunk = next(numbers)
        low = h.astype(np.uint32)
        block = (at - first[text]) % BLOCK == 0
        # a window that two texts of the chunk share is a hit already
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        out = [(int(chunk % buckets), TEXTS, chunk, np.array(ids, dtype=np.int64).tobytes(), np.array(keys, dtype=np.int64).tobytes(), squeeze(first)),
               (int(chunk % buckets), DONE, chunk, squeeze(np.unique(at[twice] // CELL)), None, None)]
        for k, own in by_bucket(h, buckets):
            blocks, probes = own[block[own]], own[~twice[own]]
            if len(blocks):
                values, counts = np.unique(low[blocks], return_counts=True)
                out.append((k, INDEX, chunk, values.tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), None))
            if len(probes):
                out.append((k, PROBE, chunk, low[probes].tobytes(), squeeze(at[probes] * 2 + block[probes]), None))
        yield batch(out)


def with_keys(batches, limit: int):
    """As grouped_bytes, of (doc_id, text, key) rows, with the keys."""
    keys: list = []

    def noted():
        for b in batches:
            keys.extend(b.column(2).to_pylist())
            yield b

    for ids, found in grouped_bytes(noted(), limit):
        yield ids, found, keys[: len(ids)]
        del keys[: len(ids)]


def hits(batches):
    """One bucket: the probes that meet a block other than their own, as cells of their chunk."""
    values, counts, parts = np.zeros(0, np.uint32), np.zeros(0, np.int64), []
    for _, kind, chunk, a, b, c in rows_of(batches):
        if kind == INDEX:
            parts.append((np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint8)))
            continue
        if parts:
            every = np.concatenate([p[0] for p in parts])
            values, inverse = np.unique(every, return_inverse=True)
            counts, parts = np.bincount(inverse, np.concatenate([p[1] for p in parts])), []
        if kind == PROBE:
            if len(values):
                probe, place = np.frombuffer(a, np.uint32), unsqueeze(b)
                at = np.minimum(np.searchsorted(values, probe), len(values) - 1)
                hit = (values[at] == probe) & (counts[at] > place % 2)
                cells = np.unique(place[hit] // 2 // CELL)
                if len(cells):
                    yield batch([(0, DONE, chunk, squeeze(cells), None, None)])
        else:
            yield batch([(0, kind, chunk, a, b, c)])


def by_text(pdf, width: int):
    """One chunk: what its buckets found (cells or places of ``width`` values), dealt to its texts as runs."""
    import pandas as pd

    head = pdf[pdf["kind"] == TEXTS]
    marks = [unsqueeze(a) for a in pdf.loc[pdf["kind"] == DONE, "a"]]
    marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
    rows = []
    if len(head) and len(marks):
        ids, keys = np.frombuffer(head["a"].iloc[0], np.int64), np.frombuffer(head["b"].iloc[0], np.int64)
        first = unsqueeze(head["c"].iloc[0])
        breaks = np.flatnonzero(np.diff(marks) > 1)
        lo = marks[np.concatenate([[0], breaks + 1])] * width
        hi = (marks[np.concatenate([breaks, [len(marks) - 1]])] + 1) * width
        for k in np.flatnonzero(np.diff(first)):  # a run may reach over several texts
            a, b = np.searchsorted(hi, first[k], side="right"), np.searchsorted(lo, first[k + 1])
            if a < b:
                rows.append((int(ids[k]), int(keys[k]), np.maximum(lo[a:b] - first[k], 0).tolist(), (np.minimum(hi[a:b], first[k + 1]) - first[k]).tolist()))
    return pd.DataFrame(rows, columns=["doc_id", "key", "lo", "hi"])


RUNS = "doc_id long, key long, lo array<int>, hi array<int>"


def runs_by_text(found: DataFrame, width: int) -> DataFrame:
    """Per (doc_id, key) the runs [lo, hi) found in its text; a repeated row's runs are the same twice."""
    per = found.groupBy("chunk").applyInPandas(lambda pdf: by_text(pdf, width), RUNS)
    return per.groupBy("doc_id", "key").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def extended(batches, buckets: int):
    """Runs of 50 words about the hits of (doc_id, text, key, lo, hi) rows, packed.

    Of equal runs in a chunk only that of the smallest id goes on; the others are repeats already.
    """
    numbers = chunk_numbers()
    for ids, found, keys, lo, hi in with_runs(batches):
        hashes, _, _, first, _ = word_hashes(found)
        at, text = places(first, WORDS)
        if not len(at):
            continue
        near = np.zeros(int(first[-1]) + 1, dtype=np.int32)
        for k in range(len(ids)):  # a run that may hold a window of 25 words that hit
            a, b = np.array(lo[k]), np.array(hi[k])
            np.add.at(near, np.clip(first[k] + a - (WORDS - BLOCK), first[k], None), 1)
            np.add.at(near, np.minimum(first[k] + b, first[k + 1]), -1)
        chosen = np.cumsum(near)[at] > 0
        at, text = at[chosen], text[chosen]
        h, doc = windows(hashes, WORDS)[at], np.array(ids, dtype=np.int64)[text]
        order = np.lexsort((doc, h))
        leads = np.ones(len(order), dtype=bool)
        leads[1:] = h[order][1:] != h[order][:-1]
        least = doc[order][np.maximum.accumulate(np.where(leads, np.arange(len(order)), 0))]
        settled = np.zeros(len(h), dtype=bool)
        settled[order] = doc[order] > least
        send = np.zeros(len(h), dtype=bool)
        send[order] = leads
        # a repeated row of the smallest document follows the first of them: both must be told
        send |= ~settled
        chunk = next(numbers)
        out = [(int(chunk % buckets), TEXTS, chunk, np.array(ids, dtype=np.int64).tobytes(), np.array(keys, dtype=np.int64).tobytes(), squeeze(first)),
               (int(chunk % buckets), DONE, chunk, squeeze(at[settled]), None, None)]
        send = np.flatnonzero(send)
        for k, own in by_bucket(h[send], buckets):
            own = send[own]
            docs, number = np.unique(doc[own], return_inverse=True)
            out.append((k, PROBE, chunk, h[own].tobytes(), squeeze(at[own]), docs.tobytes() + squeeze(number) + len(docs).to_bytes(4, "little")))
        yield batch(out)


def with_runs(batches):
    """(ids, texts, keys, lo, hi) of (doc_id, text, key, lo, hi) rows."""
    lo, hi = [], []

    def noted():
        for b in batches:
            lo.extend(b.column(3).to_pylist())
            hi.extend(b.column(4).to_pylist())
            yield b

    for ids, found, keys in with_keys(noted(), CHUNK):
        n = len(ids)
        yield ids, found, keys, lo[:n], hi[:n]
        del lo[:n], hi[:n]


def repeats(batches):
    """One bucket: the runs that a smaller id holds too, as places of their chunk."""
    held = []
    for _, kind, chunk, a, b, c in rows_of(batches):
        if kind != PROBE:
            yield batch([(0, kind, chunk, a, b, c)])
            continue
        n = int.from_bytes(c[-4:], "little")
        docs = np.frombuffer(c[: 8 * n], np.int64)
        held.append((chunk, np.frombuffer(a, np.uint64), docs[unsqueeze(c[8 * n : -4])], unsqueeze(b).astype(np.uint32)))
    if not held:
        return
    h, doc = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
    order = np.lexsort((doc, h))
    leads = np.ones(len(order), dtype=bool)
    leads[1:] = h[order][1:] != h[order][:-1]
    least = doc[order][np.maximum.accumulate(np.where(leads, np.arange(len(order)), 0))]
    gone = np.zeros(len(h), dtype=bool)
    gone[order] = doc[order] > least
    at = 0
    for chunk, own, _, place in held:
        marks = place[gone[at : at + len(own)]]
        at += len(own)
        if len(marks):
            yield batch([(0, DONE, chunk, squeeze(marks), None, None)])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lo, hi): starts [lo, hi) of the runs of 50 words that a document with a smaller id holds.

    ``docs`` has (doc_id, text, key); rows without an id take no part.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = docs.filter(F.col("doc_id").isNotNull())
    cells = runs_by_text(dealt(known.sortWithinPartitions("doc_id", "key").mapInArrow(lambda b: anchors(b, buckets), ROW), buckets).mapInArrow(hits, ROW), CELL)
    near = known.join(cells.hint("shuffle_hash"), ["doc_id", "key"]).select("doc_id", "text", "key", "lo", "hi").sortWithinPartitions("doc_id", "key")
    return runs_by_text(dealt(near.mapInArrow(lambda b: extended(b, buckets), ROW), buckets).mapInArrow(repeats, ROW), 1)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): the key tells the texts of rows that repeat an id apart."""
    return texts(docs).withColumn("key", F.xxhash64("text"))


def remaining(text: bytes, lo, hi) -> tuple[int, int, bytes]:
    """(words, words removed, the kept words joined by spaces) of a text, given its runs of repeats."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = spans(data, SPACE)
    gone = np.zeros(len(starts) + 1, dtype=np.int32)
    for a, b in zip(lo or (), hi or ()):
        gone[a] += 1
        gone[min(b + WORDS - 1, len(starts))] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    kept = b" ".join([text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])
    return len(starts), int(len(starts) - keep.sum()), kept


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row of ``docs`` without the words that a run of 50
    words shared with a smaller doc_id covers.

    NULL and empty texts have no words.  A NULL doc_id neither removes nor loses words.  Rows that
    repeat an id are one document.  Other columns drop out.
    """
    import pyarrow as pa

    every = keyed(docs)
    own = every.filter(F.col("doc_id").isNotNull())  # as in repeated_runs: the texts are shuffled once for both joins
    joined = own.join(repeated_runs(own).hint("shuffle_hash"), ["doc_id", "key"], "left").select("doc_id", "text", "lo", "hi")
    none = F.lit(None).cast("array<int>")
    joined = joined.unionByName(every.filter(F.col("doc_id").isNull()).select("doc_id", "text", none.alias("lo"), none.alias("hi")))

    def run(batches):
        for b in batches:
            ids, found, lo, hi = (b.column(k) for k in range(4))
            rows = [remaining(t or b"", x, y) for t, x, y in zip(found.cast(pa.binary()).to_pylist(), lo.to_pylist(), hi.to_pylist())]
            n, gone, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: what is left of every document, as a hash."""
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
