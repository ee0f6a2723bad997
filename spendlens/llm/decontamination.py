"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of 32 words, one every 16, and items of more than 64 words into
parts.  A vector holds a weight ln(N / df) for each word that the benchmark uses.  Passages are searched
for the items of which enough answer words (the rarest) stand about them.  A randomised SVD, summed over
partitions, of these passages and the parts (of the same total weight), together with the parts
themselves, spans a latent space for a bounded number of parts.  Items become candidates whose inner
product with the passage is a good share of the smaller of both squared norms there, which any verbatim
copy reaches.  A candidate counts if the longest common subsequence with the words about the passage
covers most of the item, and most of its answer words are there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, grouped_bytes, table, texts, written
from .toxicity import FOLD, GAP
from .words import Vocabulary, word_hashes

STEP = 16
#: Words of a passage.
WIDTH = 2 * STEP
#: Least overlap of a candidate.  A copy of a part reaches 1/3: it lies in five cells at most, so in three passages.
OVERLAP = 0.3
COVERED, ANSWERS = 0.6, 0.5
#: Most words of a part of an item.
PART = 2 * WIDTH
#: Rarest words of an item that stand for its answer.
ANSWER_WORDS = 4
RANK, SPARE, ROUNDS = 256, 8, 2
#: Parts that share a latent space: fewer than its rank.
SPACE = 240
#: Items searched for at once: bounds the broadcast; more items take more rounds.
ITEMS = 2000
#: Vocabulary rows of a partial sum that travel together, and parts that partitions' shares of a slice are added up in first.
SLICE, SUM_PARTS = 4096, 32


class Items:
    """A block of benchmark items: their words, the vocabulary and, once known, its weights."""

    def __init__(self, rows: list):
        self.ids = [r[0] for r in rows]
        hashes, _, _, first, _ = word_hashes([(r[1] or "").encode() for r in rows], GAP, FOLD)
        self.vocabulary = Vocabulary(np.unique(hashes))
        numbers = self.vocabulary.find(hashes).astype(np.int32)
        self.words = [numbers[a:b] for a, b in zip(first, first[1:])]
        self.longest = max(map(len, self.words), default=0)
        self.weights = np.zeros(len(self.vocabulary.hashes))
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.parts = [np.array_split(w, -(-len(w) // PART)) if len(w) else [] for w in self.words]
        self.space, n, k = np.zeros(len(self.words), dtype=np.int64), 0, 0
        for i, own in enumerate(self.parts):  # an item of more parts has a space, of a higher rank, of its own
            if n and n + len(own) > SPACE:
                n, k = 0, k + 1
            n, self.space[i] = n + len(own), k

    def weigh(self, total: int, df: dict[int, int]) -> None:
        n = np.array([df.get(k, 0) for k in range(len(self.weights))], dtype=float)
        self.weights = np.log((total + 2) / (n + 1))
        self.answers = []
        for w in self.words:
            kinds = np.unique(w)
            self.answers.append(frozenset(kinds[np.argsort(-self.weights[kinds], kind="stable")[:ANSWER_WORDS]].tolist()))
        self.need = np.array([max(1, math.ceil(ANSWERS * len(a))) for a in self.answers])
        rows = np.array(sorted((w, i, 1 << k) for i, a in enumerate(self.answers) for k, w in enumerate(sorted(a))), dtype=np.int64).reshape(-1, 3)
        self.answer_item, self.answer_bit = rows[:, 1], rows[:, 2]
        self.answer_first = np.searchsorted(rows[:, 0], np.arange(len(self.weights) + 1))

    def holding(self, key: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The keys (place times items, plus item) whose bits together are enough answer words of the item."""
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        if not len(start):
            return key
        return key[start][np.bitwise_count(np.bitwise_or.reduceat(bit[order], start)) >= self.need[key[start] % len(self.ids)]]

    def pairs(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, item): the passages, by the number of their first cell, and the items of which enough answer words
        stand among the passage's words and, on both sides of it, as many as the item has."""
        known, n = np.flatnonzero(word >= 0), len(self.ids)
        count = self.answer_first[word[known] + 1] - self.answer_first[word[known]]
        at = np.repeat(known, count)
        entry = np.repeat(self.answer_first[word[known]], count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        item, bit, text = self.answer_item[entry], self.answer_bit[entry], np.searchsorted(first, at, side="right") - 1
        own = np.isin(text * n + item, self.holding(text * n + item, bit))  # in the whole text first
        at, item, bit, text = at[own], item[own], bit[own], text[own]
        sizes = -(-np.diff(first) // STEP)
        place, reach = at - first[text], self.sizes[item]
        low = np.maximum((place - WIDTH - reach) // STEP + 1, 0)
        count = np.minimum((place + reach) // STEP, sizes[text] - 1) - low + 1
        cell = np.repeat((np.cumsum(sizes) - sizes)[text] + low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        key = self.holding(cell * n + np.repeat(item, count), np.repeat(bit, count))
        return key // n, key % n


def read_items(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of ITEMS; items without a word are left out."""
    rows = []
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == ITEMS:
            yield Items(rows)
            rows = []
    if rows:
        yield Items(rows)


def cells(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of STEP words that texts are cut into: number of each word's cell, text and first word of each cell."""
    sizes = -(-np.diff(first) // STEP)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * STEP
    ends = np.append(start, first[-1])
    return np.repeat(np.arange(len(text)), np.diff(ends)), text, start


def frequencies(docs: DataFrame, shared) -> tuple[int, dict[int, int]]:
    """Cells in all documents, and in how many of them each word of the vocabulary stands."""
    import pyarrow as pa

    def run(batches):
        total, vocabulary = 0, shared.value.vocabulary
        df = np.zeros(len(vocabulary.hashes), dtype=np.int64)
        for _, found in grouped_bytes(batches):
            hashes, _, _, first, _ = word_hashes(found, GAP, FOLD)
            cell, _, start = cells(first)
            total += len(start)
            word = vocabulary.find(hashes)
            known = np.flatnonzero(word >= 0)
            pairs = np.unique(cell[known] * np.int64(len(df) or 1) + word[known])
            df += np.bincount(pairs % max(len(df), 1), minlength=len(df))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], total))], names=["word", "n"])

    got = {r["word"]: r["n"] for r in docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(-1, 0), got


def passages(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, place, head, words, space, items): the passages and, for each latent space, the items of which
    enough answer words stand about them; with the words about them as numbers of the vocabulary, -1 for others."""
    import pyarrow as pa

    names = ["doc_id", "place", "head", "words", "space", "items"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        items = shared.value
        for ids, found in grouped_bytes(batches):
            hashes, _, _, first, _ = word_hashes(found, GAP, FOLD)
            _, text, start = cells(first)
            word = items.vocabulary.find(hashes)
            cell, item = items.pairs(word, first)
            if not len(cell):
                continue
            new = np.flatnonzero(np.append(True, (np.diff(cell) != 0) | (np.diff(items.space[item]) != 0)))
            rows: list[list] = [[] for _ in names]
            for x, y in zip(new, np.append(new[1:], len(cell))):
                k, a, reach = text[cell[x]], start[cell[x]], int(items.sizes[item[x:y]].max())
                lo, hi = max(first[k], a - reach), min(first[k + 1], a + WIDTH + reach)
                row = (ids[k], int(a - first[k]), int(a - lo), word[lo:hi].astype(np.int32).tobytes(), int(items.space[item[x]]), item[x:y].astype(np.int32).tobytes())
                for col, v in zip(rows, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(rows, kinds)], names=names)

    return docs.mapInArrow(run, "doc_id long, place long, head int, words binary, space int, items binary")


def vectors(items: Items, found: list[np.ndarray], scaled: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of passages, scaled to about length 1 if wanted: (row, word, value)."""
    row = np.repeat(np.arange(len(found)), [len(w) for w in found])
    word = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
    row, word = row[word >= 0], word[word >= 0]
    value = items.weights[word]
    if scaled:
        value = value / np.maximum(np.sqrt(np.bincount(row, value * value, minlength=len(found))), 1e-12)[row]
    return row, word, value


def summed(to: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """``rows`` added up by their number in ``to``, 0 .. n-1."""
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    if len(to):
        order = np.argsort(to, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(to[order]) > 0))
        out[to[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def times(row, word, value, basis: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sparse matrix times ``basis``."""
    return summed(row, basis[word] * value[:, None].astype(basis.dtype), n)


def latent_space(kept: DataFrame, items: Items, own: list[np.ndarray], n: int) -> np.ndarray:
    """Basis (vocabulary x rank) of the parts ``own`` and, as far as the rank goes, of the right singular
    vectors of the matrix of the ``n`` passages and the parts, by a randomised SVD.

    Each round multiplies by the matrix and its transpose: partitions sum their share, shares
    add up by slices of the vocabulary, in parts of the partitions first.
    """
    import pandas as pd
    from pyspark import TaskContext

    spark, size = kept.sparkSession, len(items.weights)
    width = min(RANK + SPARE, size)
    basis = np.random.default_rng(23).normal(size=(size, width))
    weight = max(1.0, n / len(own))
    for _ in range(ROUNDS):
        shared = Shared(spark, (items, basis.astype(np.float32)))

        def run(batches):
            it, q = shared.value
            total = np.zeros(q.shape)
            for pdf in batches:
                found = [np.frombuffer(w, np.int32)[h : h + WIDTH] for w, h in zip(pdf["words"], pdf["head"])]
                row, word, value = vectors(it, found)
                total += summed(word, times(row, word, value, q, len(found))[row] * value[:, None].astype(np.float32), len(total))
            for a in range(0, len(total), SLICE):
                if total[a : a + SLICE].any():
                    yield pd.DataFrame({"slice": [a // SLICE], "part": [TaskContext.get().partitionId() % SUM_PARTS], "data": [total[a : a + SLICE].tobytes()]})

        def add(pdf):
            out = np.zeros(len(pdf["data"].iloc[0]) // 8)
            for d in pdf["data"]:
                out += np.frombuffer(d)
            return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [pdf["part"].iloc[0]], "data": [out.tobytes()]})

        schema = "slice long, part long, data binary"
        sums = kept.select("head", "words").mapInPandas(run, schema).groupBy("slice", "part").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema).collect()
        row, word, value = vectors(items, own)
        y = weight * summed(word, times(row, word, value, basis, len(own))[row] * value[:, None], size)
        for r in sums:
            y[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] += np.frombuffer(r["data"]).reshape(-1, width)
        shared.unpersist()
        basis = np.linalg.qr(y)[0]
    parts = summed(word, np.eye(len(own))[row] * value[:, None], size)
    return np.linalg.qr(np.hstack([parts, basis]))[0][:, : max(RANK, len(own) + SPARE)]


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, on bits."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words.tolist():
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def search(kept: DataFrame, items: Items, basis: np.ndarray, mine: list[int]) -> DataFrame:
    """(doc_id, item_id, place, cosine, covered, answers) of the passages that hold one of the items ``mine``."""
    import pandas as pd

    own = [w for i in mine for w in items.parts[i]]
    row, word, value = vectors(items, own, scaled=False)
    shared = Shared(kept.sparkSession, (items, basis.astype(np.float32), times(row, word, value, basis, len(own)).astype(np.float32)))

    def run(batches):
        it, q, targets = shared.value
        column = np.full(len(it.ids), -1)
        column[mine] = np.arange(len(mine))
        first = np.cumsum([0, *(len(it.parts[i]) for i in mine)])[:-1]
        norms = (targets * targets).sum(axis=1)
        for pdf in batches:
            words, wanted = ([np.frombuffer(w, np.int32) for w in pdf[c]] for c in ("words", "items"))
            row, word, value = vectors(it, [w[h : h + WIDTH] for w, h in zip(words, pdf["head"])], scaled=False)
            latent = times(row, word, value, q, len(words))
            inner, own_norms = latent @ targets.T, (latent * latent).sum(axis=1)[:, None]
            overlap = np.maximum.reduceat(inner / np.maximum(np.minimum(own_norms, norms), 1e-9), first, axis=1)
            cosines = np.maximum.reduceat(inner / np.maximum(np.sqrt(own_norms * norms), 1e-9), first, axis=1)
            p = np.repeat(np.arange(len(words)), [len(w) for w in wanted])
            k = np.concatenate([*wanted, np.zeros(0, np.int32)])
            near = overlap[p, column[k]] >= OVERLAP
            found = []
            for p, k in zip(p[near].tolist(), k[near].tolist()):
                head, size = int(pdf["head"].iloc[p]), len(it.words[k])
                about = words[p][max(head - size, 0) : head + WIDTH + size]
                covered = common_subsequence(it.words[k], about) / size
                if covered >= COVERED:
                    answers = len(it.answers[k].intersection(about.tolist())) / len(it.answers[k])
                    found.append((pdf["doc_id"].iloc[p], it.ids[k], int(pdf["place"].iloc[p]), float(cosines[p, column[k]]), covered, answers))
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "place", "cosine", "covered", "answers"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return kept.mapInPandas(run, "doc_id long, item_id long, place long, cosine double, covered double, answers double")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds: the best passage's place (its first word),
    cosine, and shares of the item's words and answer words found.

    NULL and empty texts, on either side, hold nothing.  Repeated rows of a document count once, repeated
    items each.  An empty benchmark gives an empty result.
    """
    d, out = texts(docs), None
    spark = docs.sparkSession
    for items in read_items(benchmark):
        if not items.longest:
            continue
        shared = Shared(spark, items)
        items.weigh(*frequencies(d, shared))
        shared = Shared(spark, items)
        every = written(passages(d, shared), "passages")
        found = None
        for r in every.groupBy("space").count().orderBy("space").collect():
            kept = every.filter(F.col("space") == r["space"])
            mine = [i for i in np.flatnonzero(items.space == r["space"]).tolist() if len(items.words[i])]
            more = search(kept, items, latent_space(kept, items, [w for i in mine for w in items.parts[i]], r["count"]), mine)
            found = more if found is None else found.unionByName(more)
        if found is None:
            continue
        best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "cosine", "answers", (-F.col("place")).alias("back"))).alias("m"))
        rows = best.select("doc_id", "item_id", (-F.col("m.back")).alias("place"), "m.cosine", "m.covered", "m.answers")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, place long, cosine double, covered double, answers double")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows without an id stay if clean rows would, that is always."""
    return docs.join(contaminated(docs, benchmark).filter("doc_id is not null").select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the documents that hold benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
