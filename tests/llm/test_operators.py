"""The operators against plain versions on small tables, with odd rows among them."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from spendlens.llm import (common, decontamination, language_id, near_duplicates, pieces, pii, quality_model, quality_rules, substrings, suffixes,
                           toxicity, words)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, `class` string, key string, words int"


def vocabulary(seed=1, n=800):
    g = random.Random(seed)
    return ["".join(g.choice("abcdefghilmnoprstuvéñ") for _ in range(g.randint(2, 9))) for _ in range(n)]


def rows():
    g, v = random.Random(7), vocabulary()
    text = lambda n: " ".join(g.choice(v) for _ in range(n))
    passage, near = text(90), text(120).split(" ")
    out = [None, "", " \n\t ", "a", "\n\n", "é" * 900, "ab " * 400, text(20000), text(60) + " " + passage, passage + "\n" + text(33), text(10) + "\t" + passage + " " + text(5)]
    out += [" ".join(near), " ".join(near), " ".join(near[:60] + ["changed"] + near[61:]), " ".join(near[:40] + ["other", "words"] + near[40:])]
    out += [text(g.randint(1, 200)) + g.choice([".", "\n", "! "]) + text(30) for _ in range(40)]
    out += [out[20], out[20], out[21] + " " + out[22], "write to a.b@c.example.com or +1 (555) 123-4567, 10.0.0.255 and 4111 1111 1111 1111."]
    made = [(i, t) for i, t in enumerate(out)]
    made += [(30, out[30]), (None, out[25]), (None, None)]  # a repeated row, rows without an id
    return [(i, t, g.choice(["en", "fr", None]), "s", len(t or ""), 1, "x", "y", 2) for i, t in made]


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 != 0, i % 5 == 0) for i in range(55)] + [(None, True, True), (3, None, None)], "doc_id long, q boolean, t boolean").selectExpr(
        "doc_id", "cast(q as int) quality", "cast(t as int) toxic")


def test_substrings(docs, empty):
    least = {}
    tokens = [(r[0], WORD.findall(r[1] or "")) for r in rows()]
    for i, w in tokens:
        for k in range(len(w) - 49):
            if i is not None:
                least[tuple(w[k:k + 50])] = min(i, least.get(tuple(w[k:k + 50]), i))
    want = []
    for i, w in tokens:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and least[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [tuple(r) for r in substrings.drop_repeats(docs).collect()]
    assert Counter(got) == Counter(want) and sum(w[2] for w in want) > 150
    assert substrings.drop_repeats(empty).count() == 0


def test_suffixes(docs, empty):
    every = [(r[0], (r[1] or "").encode()) for r in rows()]
    seen = Counter(b[k:k + 400] for _, b in every for k in range(len(b) - 399))
    want = []
    for i, b in every:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    got = [tuple(r)[:4] + (bytes(r.kept),) for r in suffixes.drop_repeats(docs).collect()]
    assert Counter(got) == Counter(want)
    assert suffixes.drop_repeats(empty).count() == 0


def test_suffixes_of_long_texts_in_pieces(spark, monkeypatch):
    g = random.Random(3)
    a = "".join(g.choice("abcdef") for _ in range(9000))
    d = spark.createDataFrame([(1, a), (2, a[2000:6000]), (3, "".join(g.choice("ghij") for _ in range(5000)))], "doc_id long, text string")
    monkeypatch.setattr(suffixes, "CHUNK", 1500)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.drop_repeats(d).collect()}
    assert got == {1: (4000, 1), 2: (4000, 1), 3: (0, 0)}


def test_near_duplicates(docs, empty):
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        sets[i] = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) or Counter([tuple(w)] if w else [])
    lead = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common_ = sum((sets[a] & sets[b]).values())
                if a < b and common_ and common_ >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - common_) and lead[a] != lead[b]:
                    lead[a] = lead[b] = min(lead[a], lead[b])
                    changed = True
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect() if r.doc_id is not None}
    assert got == lead and got[12] == 11
    kept = near_duplicates.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(lead.values()))
    assert near_duplicates.classes(empty).count() == 0


def test_near_duplicates_among_texts_of_one_template(spark):
    common.prepare(spark)
    g = random.Random(5)
    template = [f"w{g.randint(0, 5000)}" for _ in range(300)]

    def edited(w, m):
        w = list(w)
        for i in g.sample(range(len(w)), m):
            w[i] = f"x{g.randint(0, 10**7)}"
        return w

    made = [w for _ in range(80) for w in [edited(template, 4)] for w in (w, edited(w, 3))]
    sets = [Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) for w in made]
    lead = list(range(len(made)))
    for b in range(len(made)):
        for a in range(b):
            common_ = sum((sets[a] & sets[b]).values())
            if lead[a] != lead[b] and common_ >= 0.8 * (2 * 296 - common_):
                x, y = sorted((lead[a], lead[b]))
                lead = [x if z == y else z for z in lead]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    assert [r.class_id for r in near_duplicates.classes(docs).orderBy("doc_id").collect()] == lead


def test_pii_base_and_whole(docs, empty):
    t = rows()[-4][1]
    found = {(pii.KINDS[k], t[a:b]) for k, a, b in pii.base_spans(t)}
    assert found == {("email", "a.b@c.example.com"), ("phone", "+1 (555) 123-4567"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111")}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    g = random.Random(5)
    for _ in range(3000):
        s = "".join(g.choice("a1@.-+ 2") for _ in range(g.randint(0, 24)))
        own = pii.base_spans(s)
        assert [(a, b) for k, a, b in own if k == 0] == [m.span() for m in email.finditer(s)], s
        assert [(a, b) for k, a, b in own if k == 1] == [m.span() for m in ip.finditer(s) if all(int(p) <= 255 for p in m.group().split("."))], s
    assert pii.redact("x a@b.c y", [(0, 2, 7)]) == "x [EMAIL] y"
    clean = pii.redact_documents(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not [r for r in clean.collect() if r.text and "4111" in r.text]
    assert pii.redact_documents(empty).count() == 0


def test_pii_gradient():
    """The network's gradient against differences."""
    net, g = pii.Tagger(1), np.random.default_rng(0)
    x, y = g.integers(1, 98, (2, 6)), g.integers(0, pii.TAGS, (2, 6))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        s, _ = net.emissions(x)
        total = 0.0
        for b in range(2):
            a = s[0, b]
            for t in range(1, 6):
                a = s[t, b] + np.log(np.exp(a[:, None] + net.p["t"]).sum(axis=0))
            path = sum(s[t, b, y[b, t]] for t in range(6)) + sum(net.p["t"][y[b, t], y[b, t + 1]] for t in range(5))
            total += np.log(np.exp(a).sum()) - path
        return total / 2

    grads = net.gradient(x, y)
    for k in ("t", "o", "fh", "bx", "e"):
        i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        net.p[k][i] += 1e-3
        up = loss()
        net.p[k][i] -= 2e-3
        down = loss()
        net.p[k][i] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][i]) < 0.02 * abs(grads[k][i]) + 1e-3, k


def test_pii_network_adds_variants(spark):
    """Forms that the patterns miss, planted into texts that the network has not seen; clean texts stay as they are."""
    every = [r.text for r in common.table(spark, "/root/testdata/sf0.01", "documents").filter("length(text) between 200 and 6000").orderBy("doc_id").collect()]
    net, g = pii.train(every[:400]), random.Random(8)
    forms = {"email": ["anna.berg @ posthaus.org", "k.lind (at) nordmail dot net", "maria77 at webhost dot com", "joe [at] shop [dot] de"],
             "ip": ["192 . 168 . 14 . 7", "10. 0. 31. 255", "172[.]16[.]5[.]99"],
             "card": ["4111.1111.1111.1111", "5500  0000  0000  0004", "4012\n8888\n8888\n1881"],
             "phone": ["0049 170 555 1234", "0033-612-555-0198"]}
    plain = [t for t in every[400:] if not pii.base_spans(t)][:200]
    clean = plain + ["From 1999 to 2004 it rose 12.5 % in version 1.2.3; look at the dot, 4111 1111 1111 1112 is no card."] * 3
    assert sum(len(spans) for spans in pii.added_spans(clean, [[] for _ in clean], net)) <= 2
    for kind, some in forms.items():
        held, total = 0, 0
        for t in plain[:60]:
            w = t.split(" ")
            k, form = g.randint(1, len(w) - 1), g.choice(some)
            text = " ".join(w[:k] + [form] + w[k:])
            assert not any(form in text[a:b] for _, a, b in pii.base_spans(text))
            (_, spans), = pii.find([text], net)
            total += 1
            held += form not in pii.redact(text, spans) and f"[{kind.upper()}]" in pii.redact(text, spans)
        assert held >= 0.9 * total, (kind, held, total)


def test_quality_rules(docs, empty):
    want = []
    for r in rows():
        t = r[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = set()
        for k in range(len(w) - 7):
            if grams[tuple(w[k:k + 8])] > 1:
                covered.update(range(k, k + 8))
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = quality_rules.judge(docs.select("doc_id", "text")).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == Counter(want)
    assert not any(r.kept and r.base_failed for r in got) and sum(r.kept for r in got) > 20
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.filter_documents(empty).count() == 0


def test_quality_rules_estimate_agrees_with_sql_posterior(docs):
    got = quality_rules.judge(docs.select("doc_id", "text"))
    model = quality_rules.estimate(got)
    for r in got.collect():
        assert abs(quality_rules.probability(model, {k: r[f"v_{k}"] for k in quality_rules.RULES}) - r.p_good) < 1e-9


def test_decontamination(spark, docs, empty):
    v = vocabulary(9, 500)
    g = random.Random(2)
    items = [(i, " ".join(g.choice(v) for _ in range(g.randint(14, 60)))) for i in range(12)] + [(12, ""), (13, None)]
    w = items[3][1].split(" ")
    planted = [(1000, rows()[8][1] + " " + items[0][1].upper() + ". " + rows()[9][1]), (1001, items[1][1]), (1002, rows()[9][1] + " " + " ".join(w[:4] + ["quite"] + w[5:]) + " end")]
    plus = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(plus, bench).collect()}
    assert found == {(1000, 0), (1001, 1), (1002, 3)}
    assert decontamination.keep_clean(plus, bench).count() == plus.count() - 3
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.keep_clean(docs, bench.limit(0)).count() == docs.count()


def held(documents, items):
    """Brute force: (doc, item) with most of the item's words in order about one place, and half of its four rarest
    words; surely, and if words of one frequency are taken the other way."""
    of = lambda t: re.findall(r"[^\W_]+", t.lower())
    texts_, wanted = {i: of(t) for i, t in documents}, {i: of(t) for i, t in items}
    df = Counter(x for w in texts_.values() for a in range(0, len(w), 16) for x in set(w[a:a + 16]))
    sets, numbers = {d: set(t) for d, t in texts_.items()}, {}
    code = lambda w: np.array([numbers.setdefault(x, len(numbers)) for x in w])
    sure, possible = set(), set()
    for i, w in wanted.items():
        kinds = sorted(set(w), key=lambda x: df[x])
        n, last = min(4, len(kinds)), df[kinds[min(4, len(kinds)) - 1]]
        rarer, tied = {x for x in kinds if df[x] < last}, {x for x in kinds if df[x] == last}
        for d, t in texts_.items():
            if 2 * len(sets[d].intersection(kinds)) < len(kinds):
                continue
            for a in range(0, len(t), 16):
                about = t[max(a - len(w), 0):a + 32 + len(w)]
                if decontamination.common_subsequence(code(w), code(about)) >= 0.6 * len(w):
                    there, slots = len(rarer & set(about)), n - len(rarer)
                    if 2 * (there + min(slots, len(tied & set(about)))) >= n:
                        possible.add((d, i))
                    if 2 * (there + max(0, slots - len(tied - set(about)))) >= n:
                        sure.add((d, i))
    return sure, possible


def test_decontamination_of_more_items_than_the_rank(spark):
    """Each item of 600 stands whole in one document and with every fifth word changed in another."""
    common.prepare(spark)
    v, g = vocabulary(11, 3000), random.Random(4)
    text = lambda n: " ".join(g.choice(v) for _ in range(n))
    items = [(i, text(g.randint(16, 60))) for i in range(600)]
    changed = lambda t: " ".join("other" if k % 5 == 2 else w for k, w in enumerate(t.split(" ")))
    documents = [(i, f"{text(40)} {t} {text(40)}") for i, t in items] + [(1000 + i, f"{text(40)} {changed(t)} {text(40)}") for i, t in items]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i, _ in items} <= found
    sure, possible = held(documents, items)
    assert len(sure) > 900 and sure <= found <= possible


def test_decontamination_of_short_and_long_items(spark):
    """Copies amid words that the benchmark lacks, in a corpus of many cells, and items longer than a passage."""
    common.prepare(spark)
    v, g = vocabulary(13, 2000), random.Random(6)
    text = lambda n: " ".join(g.choice(v[:1000]) for _ in range(n))
    foreign = lambda n: " ".join(f"{g.choice(v[1000:])}q{g.randint(0, 9)}" for _ in range(n))
    items = [(i, text(3 + i % 20)) for i in range(40)] + [(40 + i, text(n)) for i, n in enumerate((65, 400, 1000, 2500))]
    documents = [(i, f"{foreign(g.randint(40, 60))} {t} {foreign(50)}") for i, t in items] + [(100 + i, f"{text(3000)} {foreign(3000)}") for i in range(10)]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    sure, possible = held(documents[:40], items[:40])
    assert {(i, i) for i, _ in items} <= found and sure <= found
    assert {x for x in found if x[0] < 40 and x[1] < 40} <= possible


def test_common_subsequence():
    g = random.Random(1)
    for _ in range(200):
        a, b = [[g.randint(0, 4) for _ in range(g.randint(1, 12))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.common_subsequence(np.array(a), np.array(b)) == t[-1][-1]


def test_pieces():
    m = pieces.Pieces()

    def every(part):
        out = []

        def go(end, score, ids):
            if end == 0:
                out.append((score, ids))
            for start, own, s in m.edges_to(part, end) if end else ():
                go(start, score + s, own + ids)

        go(len(part), 0.0, ())
        return sorted(out, key=lambda x: -x[0])

    for text in ("the cat", "hello,  wörld\nñue", "a", " ", "ab▁c é", "☃x", ""):
        best = m.encode(text, 4)
        full = [(0.0, ())]
        for p in m.parts(text) if text else ():
            full = sorted(((a + c, i + j) for a, i in full for c, j in every(p)[:30]), key=lambda z: -z[0])[:300]
        assert [s for s, _ in best] == [s for s, _ in full[:4]]
        assert all(m.decode(ids) == text for _, ids in best) and len({tuple(i) for _, i in best}) == len(best)
    group = [p for p in {" " + w for w in vocabulary()} if len(p) == 7]
    m.viterbi_many(group, 7)
    assert all(m.found[p] == m.viterbi(p) for p in group)


def test_pieces_of_documents(docs):
    m = pieces.Pieces()
    got = pieces.encode_documents(docs).collect()
    assert Counter((r.doc_id, m.decode(r.ids)) for r in got) == Counter((r[0], r[1] or "") for r in rows())
    assert all(list(r.scores) == sorted(r.scores, reverse=True) for r in got)


def test_learned_models(spark, docs, empty, labels):
    q = quality_model.score_documents(docs, labels).collect()
    assert len(q) == len(rows()) and all(0 <= r.score <= 1 for r in q)
    assert {r.score for r in quality_model.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score_documents(empty, labels).count() == 0
    x = toxicity.score_documents(docs, labels).collect()
    assert len(x) == len(rows()) and all(0 <= r.score <= 1 for r in x)
    assert toxicity.score_documents(docs, labels.limit(0)).filter("score > 0.01").count() == 0
    assert toxicity.score_documents(empty, labels).count() == 0
    one = language_id.identify(docs).collect()
    assert len(one) == len(rows()) and {r.lang_pred for r in one if r.doc_id in (0, 1, 2)} == {"und"}
    assert language_id.identify(empty).count() == 0


def test_held_out_accuracy(spark):
    """On the small table, outside what the models learnt from."""
    sf = "/root/testdata/sf0.01"
    d, y = (common.table(spark, sf, t) for t in ("documents", "labels"))
    lang = language_id.query(spark, sf).join(d, "doc_id").filter("held_out")
    assert lang.filter("lang = lang_pred").count() >= 0.95 * lang.count()
    quality = quality_model.query(spark, sf).join(y, "doc_id").filter("held_out")
    assert quality.filter("quality = predicted").count() >= 0.95 * quality.count()
    toxic = toxicity.query(spark, sf).join(y, "doc_id").filter("held_out and toxic = 0")
    assert toxic.filter("predicted = 0").count() >= 0.95 * toxic.count()


def test_words_and_monotone():
    found = [b"a bc\t d", b"", b"bc d"]
    h, _, _, first, _ = words.word_hashes(found)
    assert first.tolist() == [0, 3, 3, 5] and h[1] == h[3] and h[2] == h[4] and len(set(h.tolist())) == 3
    assert words.windows(h, 2)[1] == words.windows(h[1:3], 2)[0]
    fit = quality_model.monotone(np.arange(6), np.array([0, 1, 0, 1, 0.5, 1]), np.ones(6))
    assert (np.diff(fit) >= 0).all() and abs(fit.sum() - 3.5) < 1e-9
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = common.table(spark, sf, "documents")
    docs = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = common.written(stage(spark, docs, sf), "test")
        assert docs.columns == d.columns and 0 < docs.count() <= before, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
