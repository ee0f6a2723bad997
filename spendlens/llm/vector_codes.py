"""Vector codes: one small codebook for each part of a vector, fitted by member-resident Lloyd rounds.

Vectors are cut into equal consecutive parts.  Every part lives with the owner of the entry that it is
nearest to: rows are partitioned by (position, entry, salt), the salt spreading an entry that
holds many parts.  In a round the owners look which of their members a newer codebook draws away;
only those migrate, in one shuffle, to a table of that round's arrivals, and the owners then make the
new entries from the members that live with them.

No member is rewritten for staying: a row lives in the table that it last arrived in for as long
as each codebook since then keeps it at that table's entry.  Codebooks are a few integers, so
all of a fit's travel with every task, and lost tasks are repeated from the written tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Owners of one entry at least; with more shuffle partitions, an eighth as many as those.
SALTS = 32
#: Rows that a task works on at a time.
BLOCK = 1 << 14
#: Integer components stay within this, so that squared distances fit 64 bits.
LARGEST = 1 << 26
#: Labels whose sums are broadcast; beyond, they are joined by salted shuffles.
LABELS, LABEL_SALTS = 100_000, 16


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = lambda v: v.cast("double")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """Components as integers."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each of (n x w) parts in a book of (entries x w); ties to the lower entry."""
    far = np.empty((len(parts), len(book)), dtype=np.int64)
    for e, entry in enumerate(book):
        gap = parts - entry
        far[:, e] = np.einsum("ij,ij->i", gap, gap)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(parts)), at]


def matrix(column, width: int) -> np.ndarray:
    """The vectors of an Arrow list column, all of ``width`` components, as integers."""
    return whole(np.asarray(column.flatten().to_numpy(zero_copy_only=False))).reshape(len(column), width)


def gathered(batches):
    """Arrow batches put together to some BLOCK rows, so that numpy has long arrays to work on."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


MEMBER = "position int, entry int, salt int, since int, part binary"


def members(position, entry, salt, since, part):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (position, entry, salt, since)] + [pa.array([r.tobytes() for r in part], pa.binary())],
                                      names=["position", "entry", "salt", "since", "part"])


def first_members(kept: DataFrame, book: np.ndarray, width: int, salts: int) -> DataFrame:
    """Every part of the vectors, with the entry of the first codebook that it is nearest to."""
    def run(batches):
        seen = TaskContext.get().partitionId() * 7919
        for b in gathered(batches):
            x = matrix(b.column(0), width).reshape(b.num_rows, len(book), width // len(book))
            salt = (seen + np.arange(b.num_rows)) % salts
            seen += b.num_rows
            for p in range(len(book)):
                entry, _ = nearest(x[:, p], book[p])
                yield members(np.full(b.num_rows, p), entry, salt, np.zeros(b.num_rows, dtype=int), x[:, p])

    return kept.select("vector").mapInArrow(run, MEMBER)


def unpacked(batch, width: int) -> tuple:
    position, entry, salt, since = (batch.column(k).to_numpy() for k in range(4))
    return position, entry, salt, since, np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.int64).reshape(batch.num_rows, width)


def resident(position, entry, since, part, books: list[np.ndarray]) -> np.ndarray:
    """Which members still live where they arrived: all ``books`` since then keep them."""
    stays = np.ones(len(part), dtype=bool)
    for k, book in enumerate(books):
        for p in range(len(book)):
            own = np.flatnonzero(stays & (position == p) & (since < k))
            stays[own] = nearest(part[own], book[p])[0] == entry[own]
    return stays


def leaving(held: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The members that the last of ``books`` draws to another entry, with that entry, as of this round."""
    def run(batches):
        for b in gathered(batches):
            position, entry, salt, since, part = unpacked(b, books[0].shape[2])
            here = resident(position, entry, since, part, books[:-1])
            to = entry.copy()
            for p in range(len(books[-1])):
                own = np.flatnonzero(here & (position == p))
                to[own] = nearest(part[own], books[-1][p])[0]
            go = np.flatnonzero(to != entry)
            if len(go):
                yield members(position[go], to[go], salt[go], np.full(len(go), len(books) - 1), part[go])

    return held.mapInArrow(run, MEMBER)


def updated(held: DataFrame, books: list[np.ndarray]) -> np.ndarray:
    """The next codebook: each entry's members' floored mean, by component; an entry without members stays.

    A task sends one row for each entry that it owns members of, and the driver gets one row an entry."""
    import pyarrow as pa

    book = books[-1]
    parts, entries, width = book.shape

    def run(batches):
        n, sums = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, width), dtype=np.int64)
        for b in gathered(batches):
            position, entry, _, since, part = unpacked(b, books[0].shape[2])
            own = np.flatnonzero(resident(position, entry, since, part, books))
            at = position[own] * entries + entry[own]
            n += np.bincount(at, minlength=len(n))
            np.add.at(sums, at, part[own])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["at", "n", "sums"])

    per_task = held.mapInArrow(run, "at int, n long, sums array<long>")
    # exact beyond 64 bits: sums of components times rows
    total = per_task.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width)]).alias("sums"))
    out = book.copy().reshape(parts * entries, width)
    for r in total.collect():
        out[r["at"]] = [int(s) // r["n"] for s in r["sums"]]
    return out.reshape(book.shape)


def fit(kept: DataFrame, lead: list, width: int, rounds: int = ROUNDS, parts: int = PARTS) -> np.ndarray:
    """The codebooks (parts x entries x width of a part) after ``rounds`` rounds over all of ``kept`` (vector)."""
    partitions = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(SALTS, partitions // 8)
    dealt = lambda rows, name: written(rows.repartition(partitions, "position", "entry", "salt"), name)
    first = whole(np.array(lead, dtype=np.float64)).reshape(len(lead), parts, width // parts).transpose(1, 0, 2)
    books = [first]
    held = dealt(first_members(kept, first, width, salts), "members")
    for k in range(rounds):
        if k:
            held = held.unionByName(dealt(leaving(held, books), "arrivals"))
        books.append(updated(held, books))
    return books[-1]


def coded(kept: DataFrame, book: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, code, error) of (vec_id, label, vector): each part's nearest entry and the distances' sum."""
    import pyarrow as pa

    def run(batches):
        for b in gathered(batches):
            x = matrix(b.column(2), width).reshape(b.num_rows, len(book), width // len(book))
            found = [nearest(x[:, p], book[p]) for p in range(len(book))]
            code = ["".join(f"{e:02x}" for e in row) for row in np.stack([f[0] for f in found], axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_errors(rows: DataFrame, labels: int = LABELS) -> DataFrame:
    """``rows`` (label, error, ...) plus ``label_error``: the errors' sum over equal labels, NULLs together."""
    sums = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= labels:
        return rows.join(F.broadcast(sums), rows["label"].eqNullSafe(sums["of"])).drop("of")
    sums = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
    salted = rows.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(LABEL_SALTS)).cast("int"))
    return salted.join(sums, salted["label"].eqNullSafe(sums["of"]) & (salted["own"] == sums["part"])).drop("of", "own", "part")


def compress(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, labels: int = LABELS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors of (vec_id, embedding, label).

    Rows whose vector is NULL or holds a NULL or non-finite component drop out.  The codebooks start from the
    vectors with the smallest ids (a NULL id comes last, equal ids go by components); with fewer vectors than
    entries they have as many entries as vectors.  The first of them gives the length: rows of another
    length, or of one that cannot be cut into equal parts, drop out too.  Integer components stay
    within +-2^26.  A missing ``label`` column is all NULL; rows that repeat an id are vectors of their own.
    No usable row gives no row.  Other columns drop out.
    """
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    rows = vectors.select("vec_id", label, F.col("embedding").alias("vector"))
    n = F.size("vector")
    good = rows.filter(usable(F.col("vector"))).filter((n > 0) & (n % parts == 0))
    lead = good.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).select("vector").collect()
    if not lead:
        return vectors.sparkSession.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    width = len(lead[0]["vector"])
    kept = good.filter(n == width)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    book = fit(kept, [r["vector"] for r in first], width, rounds, parts)
    digest = hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
    done = with_label_errors(written(coded(kept, book, width), "codes"), labels)
    return done.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the codes of all vectors."""
    return compress(table(spark, sf_dir, "embeddings"))
