"""Resampling, vector codes and token counts against plain versions, with odd rows among them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spendlens.llm import common, ranking, resampling, sql, token_counts, vector_codes

from .test_operators import SCHEMA, rows

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["x" * 50000, "ÉÀ ßé-Ab1  中文字 ｱ\0b", "<s> </s> <unk> <0x0A>", " lead", "trail ", "  ", "\n\n\t\n", "▁▁ a▁b", "é 　﻿", "🙂🙂 ok", "a" * 3 + " " * 700 + "b", "nul\0nul"]


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    more = [(1000 + k, t, "en", "s", len(t), 1, "x", "y", 2) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows() + more, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return [(r[0], r[1] or "") for r in rows()] + [(1000 + k, t) for k, t in enumerate(ODD)]


def plain_features(text):
    w = RUN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def test_crcs_of_runs_from_prefixes():
    found = [t.encode() for t in ODD] + [b"", b"one", b"A b\nC d e f-g", b"w" * 100000 + b" " + b"v" * 70000 + b" u"]
    scan = resampling.Scan(found)
    for k in (1, 2, 3, 5):
        crc, text = scan.runs(k)
        want = []
        for n, t in enumerate(found):
            w = RUN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t.decode()))
            want += [(zlib.crc32(" ".join(w[i:i + k]).encode()), n) for i in range(len(w) - k + 1)]
        assert list(zip(crc.tolist(), text.tolist())) == want


def plain_resample(texts, target):
    s, t = Counter(), Counter()
    made = [(i, *plain_features(x)) for i, x in texts]
    for _, _, f in made:
        s.update(zlib.crc32(x.encode()) % 10000 for x in f)
    for x in target:
        t.update(zlib.crc32(y.encode()) % 10000 for y in plain_features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (ns + 10000) / ((s[k] + 1) * (nt + 10000)))) for k in range(10000)]
    out = []
    for i, n, f in made:
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [(r[0], r[2], r[3], r[4], k + 1) for k, r in enumerate(able[:25 * len(able) // 100])]
    rest = [(r[0], r[2], r[3], r[4], None) for r in able[25 * len(able) // 100:] + [r for r in out if r[1] < 20]]
    return Counter(drawn + rest)


def test_resampling(spark, odd, texts):
    target = ["Ab1 é changed", None, "", texts[20][1]]
    aim = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = resampling.resample(odd, aim).collect()
    assert Counter(map(tuple, got)) == plain_resample(texts, [t or "" for t in target])
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 25 * sum(plain_features(t)[0] >= 20 for _, t in texts) // 100 + 1))


def test_resampling_of_empty_tables(spark, odd, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    empty = spark.createDataFrame([], SCHEMA)
    assert Counter(map(tuple, resampling.resample(odd, none).collect())) == plain_resample(texts, [])
    assert resampling.resample(empty, none).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert resampling.resample(empty, none).count() == 0


def test_equal_rows_spread_over_ranges(spark):
    """One key that holds most rows does not meet in one range, and every place is given once."""
    from pyspark.sql import functions as F
    rows = common.written(spark.range(8000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.lit(7)).alias("x")), "ties")
    got = ranking.numbered(rows, [F.col("x").desc()], "places")
    r = got.collect()
    assert sorted(x["place"] for x in r) == list(range(1, 8001)) and {x["total"] for x in r} == {8000}
    assert [x["x"] for x in sorted(r, key=lambda x: x["place"])] == sorted((x["x"] for x in r), reverse=True)


def plain_codes(vectors):
    """vectors: (vec_id, list of floats, label), usable ones, in the order that gives the first entries."""
    x = np.floor(np.array([v[1] for v in vectors], dtype=np.float64) * 4096).astype(np.int64).reshape(len(vectors), 8, -1)
    book = x[:16].transpose(1, 0, 2).copy()
    far = lambda: np.stack([((x[:, p, None] - book[p][None]) ** 2).sum(-1) for p in range(8)], axis=1)
    for _ in range(6):
        at = far().argmin(axis=2)
        for p in range(8):
            for e in range(book.shape[1]):
                own = x[at[:, p] == e, p]
                if len(own):
                    book[p, e] = own.sum(axis=0) // len(own)
    at, error, of = far().argmin(axis=2), far().min(axis=2).sum(axis=1), Counter()
    for v, d in zip(vectors, error):
        of[v[2]] += int(d)
    digest = hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
    return Counter((v[0], "".join(f"{e:02x}" for e in row), int(d), of[v[2]], digest) for v, row, d in zip(vectors, at, error))


def vectors(n=300, width=16):
    g = np.random.default_rng(3)
    center = g.normal(size=(20, width)) / 3
    made = [(int(i), (center[i % 20] + g.normal(size=width) * 0.1).astype(np.float32).tolist(), None if i % 7 == 0 else int(i % 3)) for i in range(n)]
    hot = made[5][1]
    made += [(int(n + k), hot, 1) for k in range(150)]  # a vector that a third of the rows hold
    made += [(made[40][0], made[40][1], made[40][2]), (None, made[41][1], 2)]  # a repeated row, a row without an id
    return made


VECTORS = "vec_id long, embedding array<float>, label int, part string, entry int"


def test_vector_codes(spark):
    good = vectors()
    bad = [(9001, None, 1), (9002, [1.0, None] * 8, 1), (-5, [float("nan")] * 16, 1), (-6, [float("inf")] + [0.0] * 15, 2), (9003, [], 1), (9004, [0.5] * 8, 1), (9005, [0.5] * 15, 1)]
    frame = spark.createDataFrame([(*v, "p", 3) for v in good + bad], VECTORS).repartition(4)
    want = plain_codes(sorted(good, key=lambda v: (v[0] is None, v[0] or 0)))
    assert Counter(map(tuple, vector_codes.compress(frame).collect())) == want
    assert Counter(map(tuple, vector_codes.compress(frame, labels=1).collect())) == want  # labels joined by salted shuffles


def test_vector_codes_of_few_rows(spark):
    few = vectors()[:5]
    frame = spark.createDataFrame([(*v, "p", 3) for v in few], VECTORS)
    assert Counter(map(tuple, vector_codes.compress(frame).collect())) == plain_codes(few)
    for some in ([], [(1, None, 2, "p", 3)]):
        out = vector_codes.compress(spark.createDataFrame(some, VECTORS))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


def test_members_migrate_and_stay(spark):
    """A member lives where it last arrived: tables of arrivals hold those only that changed their entry."""
    good = vectors()[:300]
    x = vector_codes.whole(np.array([v[1] for v in good])).reshape(300, 8, 2)
    first = x[:16].transpose(1, 0, 2)
    kept = spark.createDataFrame([(v[1],) for v in good], "vector array<float>")
    held = common.written(vector_codes.first_members(kept, first, 16, 4), "members")
    books = [first, vector_codes.updated(held, [first])]
    moved = vector_codes.leaving(held, books).collect()
    before = np.stack([vector_codes.nearest(x[:, p], first[p])[0] for p in range(8)])
    after = np.stack([vector_codes.nearest(x[:, p], books[1][p])[0] for p in range(8)])
    assert held.count() == 2400 and len(moved) == int((before != after).sum()) > 0
    assert Counter((r["position"], r["entry"]) for r in moved) == Counter((int(p), int(after[p, k])) for p, k in zip(*np.nonzero(before != after)))


def test_token_counts(spark, odd, texts, monkeypatch):
    m = token_counts.processor(token_counts.model_path())
    want = Counter((i, len(t.encode()), len(m.encode(t)), len(m.encode(t)) > 4096) for i, t in texts)
    assert Counter(map(tuple, token_counts.count_tokens(odd).collect())) == want
    monkeypatch.setattr(token_counts, "COMMON", 3)  # nearly all by the shuffled join
    assert Counter(map(tuple, token_counts.count_tokens(odd).collect())) == want
    empty = spark.createDataFrame([], SCHEMA)
    out = token_counts.count_tokens(empty)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


def test_cuts_hold_for_made_texts():
    """Pre-tokens' pieces, counted apart, sum to the whole text's, for texts of characters that pieces hold."""
    path = token_counts.model_path()
    m, cuts, g = token_counts.processor(path), token_counts.Cuts(path), random.Random(2)
    alphabet = [chr(c) for c in np.flatnonzero(cuts.number)] + list("  \n\t中ﬁ")
    found = ["".join(g.choice(alphabet[:60] if k % 2 else alphabet) for _ in range(g.randint(1, 120))) for k in range(400)]
    alone = len(m.encode(cuts.apart))
    for text, counts in zip(found, cuts.pre_tokens(found)):
        assert sum(n * (len(m.encode(cuts.apart + t)) - alone) for t, n in counts.items()) == len(m.encode(text))


def test_sql_is_given_for_what_it_can_state():
    from spendlens.llm import queries
    assert set(queries.oracle_sql()) == {"op11_resampling", "op12_vector_codes"}
    assert "bucket" in sql.resampling() and "book6" in sql.vector_codes()


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(rows):
    least, tokens = {}, [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in tokens:
        for k in range(len(w) - 49):
            if i is not None:
                least[tuple(w[k:k + 50])] = min(i, least.get(tuple(w[k:k + 50]), i))
    out = Counter()
    for i, w in tokens:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and least[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        out[i, len(w), sum(gone)] += 1
    return out


def plain_bytes(rows):
    every = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + 400] for _, b in every for k in range(len(b) - 399))
    out = Counter()
    for i, b in every:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        out[i, len(b), sum(gone)] += 1
    return out


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_chunks_of_one_partition_are_told_apart(spark, monkeypatch, ids):
    """Texts of equal lengths without ids, or of one id, in many chunks of one partition."""
    from spendlens.llm import packed, substrings, suffixes
    g = random.Random(5)
    words = ["".join(g.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    passage = [" ".join(g.choice(words) for _ in range(70)) for _ in range(6)]
    lead = [(-1 - k, p + " " + " ".join(g.choice(words) for _ in range(10))) for k, p in enumerate(passage)]
    rest = []
    for k in range(120):
        text = " ".join(g.choice(words) for _ in range(60))
        rest.append(({"null": None, "one": 5, "own": k}[ids], text + " " + passage[k % 6] if k % 3 == 0 else text + " " + " ".join(g.choice(words) for _ in range(70))))
    made = lead + rest
    for module in (packed, substrings, suffixes):
        monkeypatch.setattr(module, "CHUNK", 3000)
    frame = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.drop_repeats(frame).collect())
    assert got == plain_words(made) and (ids == "null" or sum(k[2] * n for k, n in got.items()) > 1000)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.drop_repeats(frame).collect())
    assert got == plain_bytes(made)
    assert sum(k[2] * n for k, n in got.items()) > 10000


def test_texts_larger_than_a_chunk_under_one_id(spark):
    """Two texts of over 4 MB that share an id: each loses what an earlier document holds."""
    from spendlens.llm import substrings
    g = random.Random(6)
    words = ["".join(g.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    passage = " ".join(g.choice(words) for _ in range(60))
    long = lambda s: " ".join(f"{s}{k}" for k in range(480000))
    rows = [(1, passage), (2, long("x") + " " + passage), (2, passage + " " + long("y"))]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == Counter({(1, 60, 0): 1, (2, 480060, 60): 2})


def test_scores_give_whole_words():
    from spendlens.llm import pieces
    m = pieces.Pieces(pieces.MODEL)
    shown = lambda t: [m.surface[i].decode() for i in m.encode(t)[0][1]]
    assert shown("The quality of the report was good.") == [" The", " quality", " of", " the", " report", " was", " good", "."]
    tied = "a" * 20000  # ties are followed through
    import time
    began = time.time()
    found = m.encode(tied, 4)
    assert time.time() - began < 20 and len(found) == 4 and all(m.decode(ids) == tied for _, ids in found)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_pieces_near_the_librarys_own(spark):
    """The best segmentations have about as many pieces as the tokenizer's own, and most boundaries in common."""
    from spendlens.llm import pieces
    from tests.conftest import SF001
    import sentencepiece
    sp, m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Pieces(pieces.MODEL)
    found = [r["text"] for r in common.table(spark, SF001, "documents").select("text").collect() if r["text"]]

    def edges(ids):
        return set(np.cumsum([len(m.surface[i]) for i in ids]).tolist())

    mine, theirs = [m.encode(t, 1)[0][1] for t in found], [sp.encode(t) for t in found]
    assert abs(sum(map(len, mine)) / sum(map(len, theirs)) - 1) < 0.02
    both = sum(len(edges(a) & edges(b)) for a, b in zip(mine, theirs))
    assert both > 0.9 * sum(len(edges(b)) for b in theirs) and both > 0.9 * sum(len(edges(a)) for a in mine)


def test_pii_time_is_linear_in_unbroken_runs():
    import time
    from spendlens.llm import pii
    g, began = random.Random(3), time.time()
    net = pii.Tagger()
    net.margin = -1e9
    for run in ("a" * 100000, "Zm9vYmFy" * 12500, "7" * 100000, "1 " * 50000, " " * 100000, "a." * 50000, "@a" * 50000, "at dot " * 15000):
        for tail in ("", " at host dot org", " x (at) y . com 4111 1111 1111 1111", "+1 555 123 4567"):
            text = run + tail
            pii.completed(text, 0, len(run), min(len(text), len(run) + 5))
            pii.completed(text, 2, len(run) // 2, len(run) // 2 + 4)
            pii.base_spans(text)
    pii.find(["b" * 100000 + " x (at) y . com and " + "".join(g.choice("0123456789abcdef") for _ in range(20000))], net)
    assert time.time() - began < 60


def test_pii_sample_is_bounded(spark, monkeypatch):
    from spendlens.llm import pii
    monkeypatch.setattr(pii, "SAMPLE_DRAWN", 40)
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 20)
    rows = [(k, f"text {k} " + "call +1 555 123 4567 " * (k % 3)) for k in range(3000)] + [(9, "one copy 7")] * 3000 + [(None, None), (1, ""), (2, "long 1 " * 9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.sample(frame)
    assert 0 < len(found) <= 20 and len(set(found)) == len(found) and all(len(t) <= pii.SAMPLE_EXCERPT for t in found)
    assert found == pii.sample(frame.repartition(7))
    assert pii.sample(frame.limit(0)) == []


def test_workers_need_no_copy_of_the_library(tmp_path):
    """Queries whose workers cannot import the package: its path is the driver's alone."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {root!r})
from spendlens.session import get_spark
spark = get_spark("local[4]", shuffle_partitions=4)
from spendlens.llm import queries
def seen(_):
    try:
        import spendlens
        return [1]
    except ImportError:
        return [0]
assert spark.sparkContext.parallelize([1], 1).mapPartitions(seen).collect() == [0]
for name in ("op7_decontamination", "op9_toxicity", "op10_language_id", "op11_resampling", "op12_vector_codes", "op13_token_counts", "op1_quality_model"):
    print(name, queries.queries()[name](spark, "/root/testdata/sf0.001").count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([x for x in done.stdout.splitlines() if x.startswith("op")]) == 7
