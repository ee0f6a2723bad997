"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text holds every piece of a given model; a segmentation's score is the
sum of its pieces' scores.  A forward Viterbi pass gives the best score of each prefix,
which is an exact heuristic for the backward A* search that then lists segmentations
from the best on.  No piece holds a space mark after another character, nor a line break,
so a text's lattice falls apart at those places: parts are searched one by one and the
N best of the whole are the N best sums of their alternatives.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, table, texts
from .words import BASE, INVERSE, Vocabulary, mix, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
MARK = "▁"
#: Added to a piece's merge rank, from 1, before it is read as a frequency rank.
RANK_SHIFT = 10
#: Score of a character that is no piece and is spelt out in bytes.
BYTES_SCORE = -1e7
#: Parts kept in a worker's memory, and the longest part that is kept.
KEPT, KEPT_LENGTH = 300_000, 48
PUNCTUATION = ".,;:!?|#$%&*@\"()'-"
PARTS = re.compile(r" +[^ \n]*|[^ \n]+|\n")


def log_probabilities(ranks: dict[str, float]) -> dict[str, float]:
    """Scores that add up along a segmentation, from the order in which a byte-pair model made its pieces.

    Such a model's own scores are minus that order, which is no scale to add on: two early pieces
    would always beat one late one.  Pairs are merged from the most frequent on, so the order is read as a
    frequency rank, with probabilities that fall as its inverse (Zipf).  Scores are kept to 20 binary
    places, so that their sums are exact in any order and equal segmentations tie."""
    first = min(ranks.values(), default=0.0)
    share = {p: 1.0 / (r - first + 1.0 + RANK_SHIFT) for p, r in ranks.items()}
    total = sum(share.values())
    return {p: round(math.log(x / total) * 2**20) / 2**20 for p, x in share.items()}


class Pieces:
    """The pieces of a model: plain values that travel to the executors."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.surface = {}, {}, []
        self.byte_ids = [0] * 256
        for i in range(m.vocab_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                value = int(p[1:-1], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif m.is_control(i) or m.is_unknown(i):
                self.surface.append(b"")
            else:
                own = p.replace(MARK, " ")
                self.ids[own], self.scores[own] = i, float(m.get_score(i))
                self.surface.append(own.encode())
        self.scores = log_probabilities({p: -s for p, s in self.scores.items()})
        self.longest = max(map(len, self.ids), default=1)
        whole = all("\n" not in p and " " not in p.lstrip(" ") for p in self.ids)
        self.split = PARTS if whole else re.compile(r"(?s).+")
        spanned = any(a.isalpha() and b in PUNCTUATION for p in self.ids for a, b in zip(p, p[1:]))
        self.inner = None if spanned or not whole else re.compile(rf"(?<=[^\W\d_])(?=[{re.escape(PUNCTUATION)}])")
        keys = sorted(self.ids)
        sums = [(mix(np.array([ord(c) for c in p]), 41) * powers(BASE, len(p))).sum(dtype=np.uint64) for p in keys]
        self.known = Vocabulary(mix(np.array(sums, dtype=np.uint64)))
        self.known_scores = np.array([self.scores[p] for p in keys])
        self.found: dict[str, tuple] = {}
        self.several: dict[str, list] = {}

    def edges_to(self, text: str, end: int):
        """(start, ids, score) of every lattice edge that ends at ``end``."""
        scores = self.scores
        for start in range(max(0, end - self.longest), end):
            p = text[start:end]
            if p in scores:
                yield start, (self.ids[p],), scores[p]
            elif start == end - 1:
                yield start, tuple(self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")), BYTES_SCORE

    def forward(self, text: str) -> tuple[list[float], list[tuple]]:
        """Viterbi: the best score of every prefix, and its last edge."""
        best, last = [0.0] * (len(text) + 1), [()] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            top = None
            for edge in self.edges_to(text, end):
                s = best[edge[0]] + edge[2]
                if top is None or s > top:
                    top, last[end] = s, edge
            best[end] = top
        return best, last

    def best(self, part: str) -> tuple[bytes, float, float]:
        """(ids as 32-bit values, score, gap to the second best) of a part; no second gives an infinite gap.

        A part is cut further where a letter meets punctuation, if no piece spans that.
        """
        have = self.found.get(part)
        if have is None:
            cuts = self.inner.split(part) if self.inner else [part]
            if len(cuts) == 1:
                have = self.viterbi(part)
            else:
                own = [self.best(c) for c in cuts if c]
                have = (b"".join(o[0] for o in own), sum(o[1] for o in own), min(o[2] for o in own))
            if len(part) <= KEPT_LENGTH:
                self.found[part] = have
        return have

    def prepare(self, found: list[str]) -> list[list[str]]:
        """The parts of several texts; those not met before are searched together, by length."""
        if len(self.found) > KEPT:
            self.found.clear()
        parts = [self.parts(t) if t else [] for t in found]
        fresh = set().union(*parts) - self.found.keys() if parts else set()
        stems = set()
        for p in fresh:
            if len(p) <= KEPT_LENGTH:
                stems.update(self.inner.split(p) if self.inner else [p])
        by_length: dict[int, list[str]] = {}
        for p in stems - self.found.keys():
            by_length.setdefault(len(p), []).append(p)
        for n, group in by_length.items():
            if n:
                self.viterbi_many(group, n)
        return parts

    def viterbi_many(self, group: list[str], n: int) -> None:
        """``viterbi`` over many parts of n characters each, column by column."""
        chars = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(group), n)
        sums = np.zeros((len(group), n + 1), dtype=np.uint64)
        np.cumsum(mix(chars, 41) * powers(BASE, n), axis=1, out=sums[:, 1:])
        inverse, edge = powers(INVERSE, n + 1), []
        for length in range(1, min(n, self.longest) + 1):
            h = mix((sums[:, length:] - sums[:, : n - length + 1]) * inverse[: n - length + 1])
            at = self.known.find(h.reshape(-1))
            score = np.where(at >= 0, self.known_scores[at], BYTES_SCORE if length == 1 else -np.inf)
            edge.append(score.reshape(h.shape))
        best, lead = np.zeros((len(group), n + 1)), np.full((len(group), n + 1), np.inf)
        back = np.zeros((len(group), n + 1), dtype=np.int64)
        rows = np.arange(len(group))
        for end in range(1, n + 1):
            first = max(0, end - self.longest)
            options = np.stack([best[:, a] + edge[end - a - 1][:, a] for a in range(first, end)], axis=1)
            pick = options.argmax(axis=1)
            best[:, end], back[:, end] = options[rows, pick], first + pick
            if options.shape[1] > 1:
                options[rows, pick] = -np.inf
                lead[:, end] = best[:, end] - options.max(axis=1)
        for p, b, l, total in zip(group, back.tolist(), lead.tolist(), best[:, n].tolist()):
            self.found[p] = self.walk(p, b, l, total)

    def walk(self, part: str, back: list[int], lead: list[float], score: float) -> tuple[bytes, float, float]:
        """Follow the last edges back from the end."""
        at, ids, gap = len(part), [], float("inf")
        while at:
            start = back[at]
            if lead[at] < gap:
                gap = lead[at]
            i = self.ids.get(part[start:at])
            ids += [i] if i is not None else [self.byte_ids[b] for b in reversed(part[start:at].encode("utf-8", "surrogatepass"))]
            at = start
        return array("i", reversed(ids)).tobytes(), score, gap

    def viterbi(self, part: str) -> tuple[bytes, float, float]:
        """``best`` over one lattice: the second best leaves the best path at the node on it
        where another edge costs least."""
        n, get, longest, none = len(part), self.scores.get, self.longest, float("-inf")
        best, back, lead = [0.0] * (n + 1), [0] * (n + 1), [float("inf")] * (n + 1)
        for end in range(1, n + 1):
            top = second = none
            for start in range(end - longest if end > longest else 0, end):
                score = get(part[start:end])
                if score is None:
                    if start < end - 1:
                        continue
                    score = BYTES_SCORE
                value = best[start] + score
                if value > top:
                    top, second, back[end] = value, top, start
                elif value > second:
                    second = value
            best[end], lead[end] = top, top - second
        return self.walk(part, back, lead, best[n])

    def nbest(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Backward A*: up to n segmentations, best first; of equal scores the one nearer to the start of
        the part, so that ties are followed through and not spread over, then the one reached first."""
        best, _ = self.forward(part)
        heap, out, count = [(-best[-1], len(part), 0, 0.0, None)], [], 0
        while heap and len(out) < n:
            f, at, _, done, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((-f, tuple(ids)))
                continue
            for start, ids, score in self.edges_to(part, at):
                count += 1
                heapq.heappush(heap, (-(best[start] + score + done), start, count, done + score, (ids, path)))
        return out

    def parts(self, text: str) -> list[str]:
        """The independent parts of a text, the space before its first word included."""
        return self.split.findall(" " + text) if MARK not in text else [p for p in re.split(f"({MARK})", " " + text) for p in ([p] if p == MARK else self.split.findall(p))]

    def encode(self, text: str, n: int = NBEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations (score, ids); an empty text has one, without pieces."""
        own, chosen = self.search(text, n)
        best = [array("i", o[0]) for o in own]
        return [(score, [i for k, own in enumerate(best) for i in changes.get(k, own)]) for score, changes in chosen]

    def search(self, text: str, n: int, parts: list[str] | None = None) -> tuple[list[tuple], list[tuple[float, dict]]]:
        """``best`` of each part of a text, and of its n best segmentations the score and the ids of
        those parts that differ from the best (equal scores: the earlier change first)."""
        if not text:
            return [], [(0.0, {})]
        parts = parts or self.parts(text)
        get = self.found.get
        own = [get(p) or self.best(p) for p in parts]
        total = sum([o[1] for o in own])
        lead = [o[2] for o in own]
        gaps = [g for g in heapq.nsmallest(n - 1, lead) if g < float("inf")]
        if n < 2 or not gaps:
            return own, [(total, {})]
        places = sorted((g, k) for k, g in enumerate(lead) if g <= gaps[-1])[: n - 1]
        options = []
        for _, k in places:
            some = self.several.get(parts[k])
            if some is None:
                if len(self.several) > KEPT:
                    self.several.clear()
                some = self.several[parts[k]] = self.nbest(parts[k], n)
            options.append([(some[0][0] - s, ids) for s, ids in some])
        heap, out, seen = [(0.0, ())], [], {()}
        while heap and len(out) < n:  # choices: ((place, alternative), ...) over the few places that can matter
            gap, choice = heapq.heappop(heap)
            out.append((total - gap, {places[j][1]: options[j][a][1] for j, a in choice}))
            at = dict(choice)
            for j in range(len(places)):
                a = at.get(j, 0) + 1
                if a < len(options[j]):
                    more = tuple(sorted((at | {j: a}).items()))
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(heap, (sum(options[i][b][0] for i, b in more), more))
        return own, out

    def decode(self, ids) -> str:
        """The text of the ids, without the space that encoding puts first."""
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, path: str = MODEL, n: int = NBEST) -> DataFrame:
    """(doc_id, pieces, ids, score, scores) per row: the best segmentation's ids and the scores of the n best.

    NULL and empty texts have no pieces, score 0.  Repeated rows are encoded alike.
    """
    import pyarrow as pa

    shared = Shared(docs.sparkSession, Pieces(path))

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [t or "" for t in batch.column(1).to_pylist()]
            rows = [model.search(t, n, p) for t, p in zip(found, model.prepare(found))]
            ids = [array("i", b"".join([o[0] for o in own])) for own, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([[s for s, _ in c] for _, c in rows], pa.list_(pa.float64()))],
                names=["doc_id", "ids", "scores"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, scores array<double>")


def query(spark: SparkSession, sf_dir: str, n: int = NBEST) -> DataFrame:
    """op8: for every document the number of pieces and the hash of its ids (as
    32-bit little-endian values), the scores
    of the N best segmentations, and how many of them decode to the text again."""
    import pyarrow as pa

    shared = Shared(spark, Pieces(MODEL))

    def run(batches):
        model = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            found = [t or "" for t in batch.column(1).to_pylist()]
            for text, parts in zip(found, model.prepare(found)):
                own, chosen = model.search(text, n, parts)
                coded = b"".join([o[0] for o in own])
                ids = array("i", coded)
                good = model.decode(ids) == text
                # alternatives differ from the best in a few parts, which decode on their own
                alike = [good and all(model.decode(c) == model.decode(array("i", own[k][0])) for k, c in changes.items()) for _, changes in chosen]
                cols[0].append(len(ids))
                cols[1].append(hashlib.sha256(coded).hexdigest())
                cols[2].append([s for s, _ in chosen])
                cols[3].append(sum(alike))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.float64())), pa.array(cols[3], pa.int64())],
                names=["doc_id", "n_pieces", "ids_sha256", "scores", "n_round_trips"])

    out = texts(table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, scores array<double>, n_round_trips long")
    return out.select("doc_id", "n_pieces", "ids_sha256", F.get("scores", F.lit(0)).alias("score"), F.get("scores", F.lit(1)).alias("second_score"),
                      F.size("scores").cast("long").alias("n_segmentations"), "n_round_trips")
