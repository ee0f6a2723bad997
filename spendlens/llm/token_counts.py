"""Token counts of whole texts without their token ids.

Byte-pair merges only ever make pieces of the vocabulary, so no merge reaches over two characters
that no piece holds side by side.  Cut there, a text falls into pre-tokens that are tokenised alone
exactly as within the text.  Each distinct pre-token of the corpus is given to the tokenizer once,
its number of pieces is joined to the documents' pre-token frequencies, and products are summed.

Joins: the commonest pre-tokens, a bounded number of bounded length, are broadcast; so no pre-token left
for the shuffled join is held by more than a 65,536th of all (document, pre-token) rows, unless it
is longer than that bound, where the adaptive skew join splits its rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_bytes, table, texts, written

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: The broadcast pre-tokens: how many at most, and their length in characters.
COMMON, COMMON_LENGTH = 1 << 16, 64
MARK = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Cuts:
    """Where texts may be cut: plain values, from the pieces of a model."""

    def __init__(self, path: str):
        m = processor(path)
        whole = [p for p in map(m.id_to_piece, range(m.vocab_size())) if len(p) > 1]
        whole = [p for p in whole if not (m.is_byte(k := m.piece_to_id(p)) or m.is_control(k) or m.is_unknown(k))]
        chars = sorted({ord(c) for p in whole for c in p})
        self.number = np.zeros(0x110000, dtype=np.uint16)  # 0: in no piece of several characters
        self.number[chars] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for p in whole:
            at = self.number[[ord(c) for c in p]]
            self.beside[at[:-1], at[1:]] = True
        #: a character that merges with no other, to stand before a pre-token that starts no text
        self.apart = next(c for c in map(chr, [10, 9, *range(0x100, 0x3000)]) if not self.number[ord(c)])
        for raw, seen in (("a  b ", "a▁▁b▁"), ("ｱﬁ\t　é\n", "ｱﬁ\t　é\n"), ("", "")):
            if m.normalize(raw) not in (seen, MARK + seen if raw else ""):
                raise ValueError(f"{path}: a model that rewrites texts before it cuts them is not supported")
        self.prefix = m.normalize("a") == MARK + "a"

    def pre_tokens(self, found: list[str]) -> list[Counter]:
        """How often each pre-token stands in each text."""
        lead = MARK if self.prefix else ""
        own = [lead + t.replace(" ", MARK) if t else "" for t in found]
        joined = "".join(own)
        edges = np.cumsum([0, *map(len, own)])
        at = self.number[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
        cut = np.ones(len(at) + 1, dtype=bool)
        cut[1:-1] = ~self.beside[at[:-1], at[1:]]
        cut[edges] = True
        places = np.flatnonzero(cut)
        until = np.searchsorted(places, edges)
        places = places.tolist()
        out = []
        for a, b in zip(until, until[1:]):
            out.append(Counter([joined[x:y] for x, y in zip(places[a:b], places[a + 1 : b + 1])]))
        return out


def frequencies(docs: DataFrame, cuts: Cuts) -> DataFrame:
    """(row, doc_id, n_bytes, token, n): a row for each document, its distinct pre-tokens and how often each stands there."""
    import pyarrow as pa

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for ids, found in grouped_bytes(batches):
            counts = cuts.pre_tokens([t.decode() for t in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 33) + row + k for k in range(len(ids))], pa.int64()), pa.array(ids, pa.int64()), pa.array([len(t) for t in found], pa.int64()),
                 pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_bytes", "token", "n"])
            row += len(ids)

    return texts(docs).mapInArrow(run, "row long, doc_id long, n_bytes long, token array<string>, n array<long>")


def pieces_of(tokens: DataFrame, path: str, apart: str) -> DataFrame:
    """(token, docs, pieces) of (token, docs): how many pieces the model makes of each token within a text."""
    import pyarrow as pa

    def run(batches):
        m = None
        for b in batches:
            m = m or processor(path)
            alone = len(m.encode(apart))
            found = m.encode([apart + t for t in b.column(0).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) - alone for x in found], pa.int64())], names=["token", "docs", "pieces"])

    return tokens.mapInArrow(run, "token string, docs long, pieces long")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of (doc_id, text): the UTF-8 bytes, the
    tokens that the model at ``path`` makes of the text, and whether they are more than ``limit``.

    NULL and empty texts have none.  Rows that repeat an id, or have none, are counted each on their own.
    Spellings of special tokens are ordinary text.  Other columns drop out.
    """
    path = path or model_path()
    cuts = Cuts(path)
    held = written(frequencies(docs, cuts), "frequencies")
    distinct = held.select(F.explode("token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
    sizes = written(pieces_of(distinct, path, cuts.apart), "pieces")
    common = sizes.filter(F.length("token") <= COMMON_LENGTH).orderBy(F.col("docs").desc(), "token").limit(COMMON)
    common = written(common.select("token", F.col("pieces").alias("known")), "common")
    each = held.select("row", F.inline(F.arrays_zip("token", "n"))).join(F.broadcast(common), "token", "left")
    near = each.filter("known is not null").groupBy("row").agg(F.sum(F.col("n") * F.col("known")).alias("n_tokens"))
    rest = each.filter("known is null").select("row", "token", "n").join(sizes.join(F.broadcast(common.select("token")), "token", "left_anti"), "token")
    far = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_tokens"))
    none = F.lit(None).cast("long")
    every = held.select("row", "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens"))
    for part in (near, far):
        every = every.unionByName(part.select("row", none.alias("doc_id"), none.alias("n_bytes"), "n_tokens"))
    out = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
