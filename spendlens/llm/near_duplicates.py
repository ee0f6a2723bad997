"""Near duplicates: DartMinHash signatures, a banded join, exact verification.

A text is the weighted set of its five-word shingles.  Each unit of an element's weight is a
region at which hashed darts fall as a Poisson process over rank; the darts up to a rank
that yields about k (ln k + 2) of them are thrown, and of those that fall on one of the k
coordinates the earliest stays, so that two texts agree on a coordinate with the probability of their
weighted Jaccard similarity.  Texts that agree on all rows of a band share a bucket.

Links are found in two steps, both verified by the exact similarity.  Chains through each
bucket, in several orders, join most texts of a group at a cost that is linear in the
bucket; connected texts form a class.  Then every pair of a bucket whose classes still differ is
compared, so no link of a bucket is lost: buckets are cut into blocks of bounded size, a unit
of work is a pair of blocks, and only the links found leave it, one for each two classes.
The largest class of a bucket is never compared with itself, so that the pairs compared are at
most twice those of different classes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped_bytes, table, written
from .components import components, merged
from .substrings import keyed, places, with_keys
from .words import mix, prefix, runs, windows, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (math.log(COORDINATES) + 2)
#: Parts that a bucket's chain is made in.
SALTS = 32
#: Orders that a bucket is chained in.
ORDERS = 3
#: Texts of a block, and words of a block: a unit holds two blocks at most (one longer text may be a block).
BLOCK, BLOCK_WORDS = 512, 400_000
#: Elements whose occurrences in a unit are counted at a time.
COLUMNS = 2048


def elements(found: list[bytes]):
    """(element, text) for each unit of weight of the shingles of several texts, the identity of each
    text's words, and the number of its words.  A text of fewer than five words is one shingle."""
    hashes, _, _, first, _ = word_hashes(found)
    sizes = np.diff(first)
    at, text = places(first, SHINGLE)
    h = windows(hashes, SHINGLE)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    whole = runs(prefix(hashes), first[:-1], first[1:]) if len(hashes) else np.zeros(len(found), dtype=np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    h, text = np.concatenate([h, whole[short]]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    layer = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    return mix(h ^ mix(layer, 2), 9), text, mix(whole ^ mix(sizes, 4)), sizes


def signatures(element: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(n x COORDINATES) earliest darts; a text without elements has the largest value everywhere."""
    weight = np.bincount(text, minlength=n)
    none = np.iinfo(np.uint64).max
    best = np.full(n * COORDINATES, none, dtype=np.uint64)
    reach = DARTS / np.maximum(weight, 1)
    open_ = weight > 0
    while open_.any():  # texts with an empty coordinate throw on, twice as far
        own = open_[text]
        e, t = element[own], text[own]
        rank, k = np.zeros(len(e)), 0
        while len(e):
            u = (mix(e, 100 + k) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            rank = rank - np.log1p(-u)
            hit = rank <= reach[t]
            e, t, rank = e[hit], t[hit], rank[hit]
            where = (mix(e, 5000 + k) % np.uint64(COORDINATES)).astype(np.int64)
            dart = (np.minimum(rank * 2.0**30, 2.0**44 - 1).astype(np.uint64) << np.uint64(20)) | (mix(e, 9000 + k) >> np.uint64(44))
            np.minimum.at(best, t * COORDINATES + where, dart)
            k += 1
        open_ &= (best.reshape(n, COORDINATES) == none).any(axis=1)
        reach = reach * 2
    return best.reshape(n, COORDINATES)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """(texts x BANDS) hashes of the bands."""
    out = np.zeros((len(signature), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out ^ signature[:, r::ROWS], 60 + r)
    return mix(out ^ np.arange(BANDS, dtype=np.uint64), 77)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, key, words, n_words, bands) of each (doc_id, text, key); ``words`` identifies the word sequence."""
    import pyarrow as pa

    def run(batches):
        for ids, found, keys in with_keys(batches, 1 << 20):
            element, text, whole, sizes = elements(found)
            bands = bands_of(signatures(element, text, len(ids))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(whole.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(list(bands), pa.list_(pa.int64()))],
                names=["doc_id", "key", "words", "n_words", "bands"])

    return docs.mapInArrow(run, "doc_id long, key long, words long, n_words long, bands array<long>")


def chained(members: DataFrame, order: int) -> DataFrame:
    """(a, b) links through each bucket of (bucket, id): neighbours in a hashed order,
    within salted parts and then from part to part."""
    spot = members.select("bucket", "id", F.pmod(F.xxhash64("id", F.lit(order)), F.lit(SALTS)).alias("salt"), F.xxhash64("id", F.lit(order + 1000)).alias("place"))
    heads = spot.groupBy("bucket", "salt").agg(F.min(F.struct("place", "id")).alias("h")).select("bucket", "h.*")

    def neighbours(rows, w):
        found = rows.select("id", F.lag("id").over(w).alias("before")).filter("before is not null")
        return found.select(F.least("before", "id").alias("a"), F.greatest("before", "id").alias("b"))

    inner = neighbours(spot, Window.partitionBy("bucket", "salt").orderBy("place", "id"))
    across = neighbours(heads, Window.partitionBy("bucket").orderBy("place", "id"))  # at most SALTS rows a bucket
    return inner.union(across)


UNIT = ["bucket", "kind", "i", "j"]
#: Kinds of units: a whole bucket or two blocks of its lesser classes; a block of the main class and one of those.
AMONG, ACROSS = 0, 1


def units(members: DataFrame, of: DataFrame) -> DataFrame:
    """(bucket, kind, i, j, id, class, side): the units of work in which the texts of the buckets that still
    hold several classes are compared.  ``side`` is 1 for the main class's block in an ACROSS unit.

    A bucket of up to a block is one unit, and of several with the same texts one is enough.  Larger ones
    are cut by hash: blocks of the main class i, of the others j.
    """
    now = members.join(of, "id", "left").select("bucket", "id", "n_words", F.coalesce("component", "id").alias("class"))
    per_class = now.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
    per_bucket = per_class.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "class")).alias("main"))
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_WORDS)).cast("int")
    several = per_bucket.filter("classes > 1").select(
        "bucket", F.col("main.class").alias("main"), ((F.col("n") <= BLOCK) & (F.col("w") <= BLOCK_WORDS)).alias("small"),
        blocks(F.col("main.n"), F.col("main.w")).alias("mains"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("others"))
    rows = written(now.join(several, "bucket"), "open")
    sets = rows.filter("small").groupBy("bucket").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # BLOCK ids at most
    one = sets.groupBy(F.sha2(F.array_join("ids", ","), 256)).agg(F.min("bucket").alias("bucket")).select("bucket")
    zero = F.lit(0)
    small = rows.join(one, "bucket", "left_semi").select("bucket", F.lit(AMONG).alias("kind"), zero.alias("i"), zero.alias("j"), "id", "class", zero.alias("side"))
    large = rows.filter("not small").withColumn("own", F.pmod(F.xxhash64("id", "bucket"), F.when(F.col("class") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    each = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    main = large.filter("class = main").withColumn("j", each("others")).select("bucket", F.lit(ACROSS).alias("kind"), F.col("own").alias("i"), "j", "id", "class", F.lit(1).alias("side"))
    rest = large.filter("class <> main")
    facing = rest.withColumn("i", each("mains")).select("bucket", F.lit(ACROSS).alias("kind"), "i", F.col("own").alias("j"), "id", "class", zero.alias("side"))
    among = rest.withColumn("x", each("others")).select("bucket", F.lit(AMONG).alias("kind"), F.least("x", "own").alias("i"), F.greatest("x", "own").alias("j"), "id", "class", zero.alias("side"))
    return small.union(main).union(facing).union(among)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left x right) numbers of elements that two texts share; each text's elements are sorted and distinct."""
    both = [*left, *right]
    text = np.repeat(np.arange(len(both)), [len(x) for x in both])
    values = np.concatenate(both) if both else np.zeros(0, np.uint32)
    order = np.argsort(values, kind="stable")
    values, text = values[order], text[order]
    same = np.zeros(len(values) + 1, dtype=bool)
    same[1:-1] = values[1:] == values[:-1]
    keep = same[1:] | same[:-1]  # elements of one text only count for no pair
    column = np.cumsum(~same[:-1])[keep] - 1
    _, column = np.unique(column, return_inverse=True)
    text, out = text[keep], np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (c, c + COLUMNS))
        held = np.zeros((len(both), COLUMNS), dtype=np.float32)
        held[text[a:b], column[a:b] - c] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def across_classes(found: list[tuple], kind: int):
    """One unit's links, at most one for each two classes: ``found`` holds (id, class, side, elements)."""
    ids, classes = np.array([f[0] for f in found]), np.array([f[1] for f in found])
    n = np.array([len(f[3]) // 4 for f in found])
    sets = [np.unique(np.frombuffer(f[3], np.uint32)) for f in found]
    if kind == ACROSS:
        left = np.flatnonzero([f[2] == 1 for f in found])
        right = np.flatnonzero([f[2] == 0 for f in found])
    else:
        left = right = np.arange(len(found))
    if not len(left) or not len(right):
        return
    common = common_counts([sets[k] for k in left], [sets[k] for k in right])
    near = common >= SIMILARITY * (n[left][:, None] + n[right][None, :] - common)
    near &= classes[left][:, None] != classes[right][None, :]
    x, y = np.nonzero(near)
    pairs = np.sort(np.stack([classes[left[x]], classes[right[y]]], axis=1), axis=1)
    _, first = np.unique(pairs, axis=0, return_index=True)
    for k in first:
        a, b = int(ids[left[x[k]]]), int(ids[right[y[k]]])
        yield min(a, b), max(a, b)


def compared(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): the links between different classes in all units of ``rows``."""
    import pyarrow as pa

    def run(batches):
        key, held = None, []
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:4] != key:
                    if held:
                        out.extend(across_classes(held, key[1]))
                    key, held = row[:4], []
                held.append(row[4:])
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out = list(across_classes(held, key[1])) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = rows.join(own, "id").select(*UNIT, "id", "class", "side", "elements")
    return full.repartition(parts, *UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, "a long, b long").distinct()


def shingled(docs: DataFrame) -> DataFrame:
    """(id, elements binary) of each (id, text): the sorted elements as 32-bit values."""
    import pyarrow as pa

    def run(batches):
        for ids, found in grouped_bytes(batches):
            element, text, _, _ = elements(found)
            low = (element >> np.uint64(32)).astype(np.uint32)
            edges = np.searchsorted(text, np.arange(len(ids) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.sort(low[a:b]).tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], names=["id", "elements"])

    return docs.mapInArrow(run, "id long, elements binary")


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingles have a weighted Jaccard similarity of SIMILARITY or more."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                common = len(np.intersect1d(u, v, assume_unique=False))
                keep.append(common >= SIMILARITY * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = own.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    right = own.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row of (doc_id, text): the smallest id of its class.

    Texts with the same words are one class; different texts are linked by a shingle similarity of
    0.8 or more.  NULL and empty texts, without words, are classes of their own; a NULL doc_id has
    a NULL class unless its words are known.  Rows that repeat an id are judged by their texts.
    """
    d = keyed(docs)
    signed = written(sign(d), "signatures")
    some = signed.filter("n_words > 0 and doc_id is not null")
    # one text for all its copies
    spoken = written(some.groupBy("words").agg(F.min(F.struct("doc_id", "key")).alias("own"), F.first("bands").alias("bands"), F.first("n_words").alias("n_words")).select("words", "n_words", "bands", F.col("own.doc_id").alias("id"), F.col("own.key").alias("key")), "spoken")
    spread = spoken.select("id", "n_words", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = written(spread.join(shared, "bucket").select("bucket", "id", "n_words"), "buckets")
    pairs = chained(members, 0)
    for order in range(1, ORDERS):
        pairs = pairs.union(chained(members, order))
    pairs = written(pairs.distinct(), "pairs")
    # the texts that any bucket holds with others
    needed = members.select("id").distinct().join(spoken.select("id", "key"), "id").groupBy("id").agg(F.min("key").alias("key")).withColumnRenamed("id", "doc_id")
    rows = d.join(needed.hint("shuffle_hash"), ["doc_id", "key"]).select(F.col("doc_id").alias("id"), "text")
    own = written(shingled(rows).groupBy("id").agg(F.min("elements").alias("elements")), "shingles")
    of = components(written(verified(pairs, own), "links"))
    fresh = written(compared(units(members, of), own), "links")
    if fresh.limit(1).count():
        of = merged(of, fresh)
    named = spoken.join(of, "id", "left").select("words", "n_words", F.coalesce("component", "id").alias("class_id"))
    joined = signed.select("doc_id", "words", "n_words").join(named, ["words", "n_words"], "left")
    return joined.select("doc_id", F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each class, with all its columns; rows without an id stay,
    of rows that repeat an id one stays."""
    lead = classes(docs).filter("doc_id = class_id").select("doc_id").distinct()
    known = docs.join(lead, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the class of every document."""
    return classes(table(spark, sf_dir, "documents"))
