"""Byte-level dedup of long repeats: a logarithmic family of sorted hashes of sampled suffixes.

Suffixes are sampled by their content: of every 400-byte window, the 200-byte string with
the least hash in it is the window's anchor.  Equal windows have equal anchors at the same
offset, so only suffixes that start at anchors need indexing, about one in a hundred.

The suffixes are dealt to shards by their first 200 bytes.  In a shard, batches of
suffixes are sorted by the hashes of their first bytes, matched with the levels of the index for equal
hashes, and added as a level; levels of equal size merge, so that every suffix is merged
a logarithmic number of times.  Anchors whose whole windows' text recurs are settled at once.
Where only the 200 bytes recur, the match ends nearby: there the 400-byte windows are compared one by
one (64-bit hashes of whole windows).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .packed import DONE, PROBE, ROW, TEXTS, batch, by_bucket, chunk_numbers, dealt, rows_of, squeeze, unsqueeze
from .substrings import keyed, runs_by_text, with_keys, with_runs
from .words import BYTE_VALUES, mix, prefix, runs, windows

LENGTH, ANCHOR = 400, 200
#: Bytes of a chunk and of a piece of a longer text; places in a chunk take PLACE_BITS.
CHUNK, PLACE_BITS = 1 << 20, 21
#: Suffixes of one batch of a shard's index.
BATCH = 1 << 14
CONTESTED = 4
#: Stands for a NULL doc_id within the operator.
NO_ID = -(1 << 63)


def pieces(ids: list, found: list[bytes], keys: list):
    """(ids, keys, bases, texts) in chunks; longer texts in pieces that overlap by LENGTH - 1 bytes."""
    step, out, size = CHUNK - LENGTH + 1, [], 0
    for i, t, k in zip(ids, found, keys):
        for base in range(0, max(len(t) - LENGTH + 1, 0), step):
            part = t[base : base + CHUNK]
            if out and size + len(part) >= CHUNK:
                yield tuple(map(list, zip(*out)))
                out, size = [], 0
            out.append((i, k, base, part))
            size += len(part) + 1
    if out:
        yield tuple(map(list, zip(*out)))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones, from running minima of blocks."""
    n = len(values) - width + 1
    pad = np.full(-len(values) % width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks = np.concatenate([values, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def sampled(found: list[bytes]):
    """Anchors of several texts joined by line breaks: (key of the 200 bytes, identity of the text of
    all windows that the anchor stands for, first window, number of windows), and the texts' offsets."""
    data = np.frombuffer(b"\n".join(found), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t) + 1 for t in found)])
    values = BYTE_VALUES[data]
    h = windows(values, ANCHOR)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - ANCHOR + 1)
    anchor = (least & low).astype(np.int64)
    inside = np.ones(len(anchor), dtype=bool)
    for k in range(len(found)):  # windows within one text only
        inside[max(offsets[k + 1] - LENGTH, 0) : offsets[k + 1]] = False
    start = np.flatnonzero(inside)
    anchor = anchor[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    at, anchor = start[first], anchor[first]
    whole = runs(prefix(values), at, at + count + LENGTH - 1)
    # anchors are small hashes: mixed again, their leading bits spread over the shards
    return mix(h[anchor], 31), mix(whole ^ mix((anchor - at) * 1024 + count, 5)), at, count, offsets


def suffixes(batches, buckets: int):
    """Packed anchors of (doc_id, text, key) rows; what recurs within a chunk is settled there and sent once."""
    numbers = chunk_numbers()
    for ids, found, keys in with_keys(batches, CHUNK):
        for ids_, keys_, bases, parts in pieces(ids, found, keys):
            key, whole, at, count, offsets = sampled(parts)
            chunk = next(numbers)
            order = np.argsort(whole, kind="stable")
            leads = np.ones(len(order), dtype=bool)
            leads[1:] = whole[order][1:] != whole[order][:-1]
            times = np.diff(np.append(np.flatnonzero(leads), len(order)))
            many = np.zeros(len(whole), dtype=bool)
            many[order] = np.repeat(times, times) > 1
            send = np.sort(order[leads])
            out = [(int(chunk % buckets), TEXTS, chunk, np.array(ids_, np.int64).tobytes(), np.array(keys_, np.int64).tobytes(), squeeze(offsets) + b"|" + np.array(bases, np.int64).tobytes()),
                   (int(chunk % buckets), DONE, chunk, squeeze(at[many]), count[many].astype(np.uint8).tobytes(), None)]
            for k, own in by_bucket(key[send], buckets):
                own = send[own]
                out.append((k, PROBE, chunk, key[own].tobytes(), whole[own].tobytes(), squeeze(at[own]) + b"|" + (count[own] - 1).astype(np.uint8).tobytes() + many[own].tobytes() + len(own).to_bytes(4, "little")))
            yield batch(out)


class Levels:
    """Levels of falling size over one shard, in place of suffix arrays: (key, whole text) hashes sorted by value, with the number of the suffix."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        #: numbers of suffixes whose 200 bytes, or whole text, stand elsewhere
        self.alike: list[np.ndarray] = []
        self.equal: list[np.ndarray] = []

    @staticmethod
    def neighbours(*columns: np.ndarray) -> np.ndarray:
        """Which rows of sorted columns equal the one before or after."""
        same = np.ones(max(len(columns[0]) - 1, 0), dtype=bool)
        for c in columns:
            same &= c[1:] == c[:-1]
        out = np.zeros(len(columns[0]), dtype=bool)
        out[1:] |= same
        out[:-1] |= same
        return out

    def add(self, key: np.ndarray, whole: np.ndarray, number: np.ndarray) -> None:
        order = np.lexsort((whole, key))
        new = key[order], whole[order], number[order]
        self.alike.append(new[2][self.neighbours(new[0])])
        self.equal.append(new[2][self.neighbours(new[0], new[1])])
        for k, w, n in self.levels:  # merge-scan: both sides of every match are told
            for old, fresh, found in ((k, new[0], self.alike), (mix(k) ^ w, mix(new[0]) ^ new[1], self.equal)):
                found.append(new[2][np.isin(fresh, old)])
                found.append(n[np.isin(old, fresh)])
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1][0]) >= len(self.levels[-2][0]) // 2:
            (k1, w1, n1), (k2, w2, n2) = self.levels.pop(), self.levels.pop()
            k, w, n = np.concatenate([k1, k2]), np.concatenate([w1, w2]), np.concatenate([n1, n2])
            order = np.lexsort((w, k))
            self.levels.append((k[order], w[order], n[order]))


def index(batches):
    """One shard: settles the anchors whose whole text recurs, and tells which are to be compared by windows."""
    family, waiting, size = Levels(), [], 0
    chunks, at, count, done, keys, wholes, total = [], [], [], [], [], [], 0
    for _, kind, chunk, a, b, c in rows_of(batches):
        if kind != PROBE:
            yield batch([(0, kind, chunk, a, b, c)])
            continue
        n = int.from_bytes(c[-4:], "little")
        tail = len(c) - 4 - 2 * n
        key, whole = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        chunks.append((chunk, total, total + n))
        at.append(unsqueeze(c[: tail - 1]).astype(np.uint32))
        count.append(np.frombuffer(c[tail : tail + n], np.uint8))
        done.append(np.frombuffer(c[tail + n : tail + 2 * n], np.bool_))
        keys.append(key), wholes.append(whole)
        waiting.append((key, whole, np.arange(total, total + n)))
        total, size = total + n, size + n
        if size >= BATCH:
            family.add(*(np.concatenate(x) for x in zip(*waiting)))
            waiting, size = [], 0
    if waiting:
        family.add(*(np.concatenate(x) for x in zip(*waiting)))
    if not total:
        return
    equal, alike = np.concatenate(done), np.zeros(total, dtype=bool)
    equal = equal.copy()
    for x in family.equal:
        equal[x] = True
    for x in family.alike:
        alike[x] = True
    # of suffixes alike, those whose group holds more than one whole text; one speaks for each
    key, whole, near = np.concatenate(keys), np.concatenate(wholes), np.flatnonzero(alike)
    order = near[np.lexsort((whole[near], key[near]))]
    contested = np.zeros(total, dtype=bool)
    if len(order):
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = (whole[order][1:] != whole[order][:-1]) | (key[order][1:] != key[order][:-1])
        group = np.cumsum(np.append(True, key[order][1:] != key[order][:-1])) - 1
        kinds = np.bincount(group, lead)
        contested[order[lead & (kinds[group] > 1)]] = True
    at, count = np.concatenate(at), np.concatenate(count)
    for chunk, a, b in chunks:
        for kind, marks in ((DONE, equal), (CONTESTED, contested)):
            own = np.flatnonzero(marks[a:b]) + a
            if len(own):
                yield batch([(0, kind, chunk, squeeze(at[own]), (count[own].astype(np.int64) + 1).astype(np.uint8).tobytes(), None)])


def by_document(pdf):
    """One chunk: the settled (kind 3) and the contested (kind 4) windows of its texts, as runs of starts."""
    import pandas as pd

    rows, head = [], pdf[pdf["kind"] == TEXTS]
    if len(head):
        ids, keys = np.frombuffer(head["a"].iloc[0], np.int64), np.frombuffer(head["b"].iloc[0], np.int64)
        c, n = head["c"].iloc[0], len(ids)
        offsets, bases = unsqueeze(c[: len(c) - 8 * n - 1]), np.frombuffer(c[len(c) - 8 * n :], np.int64)
        for kind in (DONE, CONTESTED):
            own = pdf[pdf["kind"] == kind]
            if not len(own):
                continue
            at = np.concatenate([unsqueeze(x) for x in own["a"]])
            count = np.concatenate([np.frombuffer(x, np.uint8) for x in own["b"]]).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, count = at[order], count[order]
            text = np.searchsorted(offsets, at, side="right") - 1
            for k in np.unique(text):
                mine = text == k
                lo = at[mine] - offsets[k] + bases[k]
                rows.append((int(ids[k]), int(keys[k]), int(kind), lo.tolist(), (lo + count[mine]).tolist()))
    return pd.DataFrame(rows, columns=["doc_id", "key", "kind", "lo", "hi"])


def contested_windows(batches, buckets: int):
    """The 400-byte windows of the contested runs of (doc_id, text, key, lo, hi) rows, packed by hash."""
    numbers = chunk_numbers()
    for ids, found, keys, lo, hi in with_runs(batches):
        values = BYTE_VALUES[np.frombuffer(b"\n".join(found), dtype=np.uint8)]
        offsets = np.cumsum([0, *(len(t) + 1 for t in found)])
        near = np.zeros(len(values) + 2, dtype=np.int32)
        for k in range(len(ids)):
            np.add.at(near, offsets[k] + np.array(lo[k], dtype=np.int64), 1)
            np.add.at(near, offsets[k] + np.array(hi[k], dtype=np.int64), -1)
        at = np.flatnonzero(np.cumsum(near) > 0)
        if not len(at):
            continue
        h = runs(prefix(values), at, at + LENGTH)
        order = np.argsort(h, kind="stable")
        leads = np.ones(len(order), dtype=bool)
        leads[1:] = h[order][1:] != h[order][:-1]
        times = np.diff(np.append(np.flatnonzero(leads), len(order)))
        many = np.zeros(len(h), dtype=bool)
        many[order] = np.repeat(times, times) > 1
        send = np.sort(order[leads])
        chunk = next(numbers)
        out = [(int(chunk % buckets), TEXTS, chunk, np.array(ids, np.int64).tobytes(), np.array(keys, np.int64).tobytes(), squeeze(offsets)),
               (int(chunk % buckets), DONE, chunk, squeeze(at[many]), None, None)]
        for k, own in by_bucket(h[send], buckets):
            own = send[own]
            out.append((k, PROBE, chunk, h[own].tobytes(), squeeze(at[own]), None))
        yield batch(out)


def recurring(batches):
    """One bucket: the windows that stand in another chunk too, as places of their chunk."""
    held = []
    for _, kind, chunk, a, b, c in rows_of(batches):
        if kind == PROBE:
            held.append((chunk, np.frombuffer(a, np.uint64), unsqueeze(b).astype(np.uint32)))
        else:
            yield batch([(0, kind, chunk, a, b, c)])
    if not held:
        return
    h = np.concatenate([x[1] for x in held])
    order = np.argsort(h, kind="stable")
    many = np.zeros(len(h), dtype=bool)
    many[order] = Levels.neighbours(h[order])
    at = 0
    for chunk, own, place in held:
        marks = place[many[at : at + len(own)]]
        at += len(own)
        if len(marks):
            yield batch([(0, DONE, chunk, squeeze(marks), None, None)])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lo, hi): starts [lo, hi) of the 400-byte windows that start anywhere else too."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt(docs.sortWithinPartitions("doc_id", "key").mapInArrow(lambda b: suffixes(b, buckets), ROW), buckets).mapInArrow(index, ROW)
    told = written(rows.groupBy("chunk").applyInPandas(by_document, "doc_id long, key long, kind int, lo array<int>, hi array<int>"), "suffixes")
    joined = lambda df: df.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))  # noqa: E731  a text's own runs
    near = docs.join(joined(told.filter(F.col("kind") == CONTESTED)).hint("shuffle_hash"), ["doc_id", "key"])
    near = near.select("doc_id", "text", "key", "lo", "hi").sortWithinPartitions("doc_id", "key")
    rest = runs_by_text(dealt(near.mapInArrow(lambda b: contested_windows(b, buckets), ROW), buckets).mapInArrow(recurring, ROW), 1)
    return joined(told.filter(F.col("kind") == DONE).select("doc_id", "key", "lo", "hi").unionByName(rest))


def remaining(text: bytes, lo, hi) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, the bytes that stay)."""
    gone = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(gone, np.array(lo or (), dtype=np.int64), 1)
    np.add.at(gone, np.minimum(np.array(hi or (), dtype=np.int64) + LENGTH - 1, len(text)), -1)
    drop = np.cumsum(gone)[:-1] > 0
    spans = int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum())
    return int(drop.sum()), spans, np.frombuffer(text, dtype=np.uint8)[~drop].tobytes()


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): every row of ``docs`` without the bytes that a
    400-byte string covers which starts anywhere else too.

    NULL and empty texts have no bytes.  Rows count one by one: a repeated row is another place.
    A NULL doc_id is a document like any other.  Other columns drop out.
    """
    import pyarrow as pa

    own = keyed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    joined = own.join(repeated_windows(own).hint("shuffle_hash"), ["doc_id", "key"], "left").select("doc_id", "text", "lo", "hi")

    def run(batches):
        for b in batches:
            ids, found, lo, hi = (b.column(k) for k in range(4))
            found = [t or b"" for t in found.cast(pa.binary()).to_pylist()]
            rows = [remaining(t, x, y) for t, x, y in zip(found, lo.to_pylist(), hi.to_pylist())]
            gone, spans, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, found)), pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: what is left of every document, as a hash."""
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
