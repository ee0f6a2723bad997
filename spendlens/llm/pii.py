"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds spans to theirs.

The network (numpy) reads characters in both directions; a linear-chain CRF over
outside / begin / inside tags of four kinds scores its outputs.  It learns from spans that the patterns
mark in a bounded sample of documents, and from made spans of every kind in forms that the
patterns miss.  Every kind holds a digit, an at sign or a spelt-out one, so only the windows about those
can hold a span: these are decoded, overlapping, and where two windows disagree
the tags of the one whose centre is nearer count.  A span of the network counts if it reads as one of its
kind, with a margin that rewritten spans held out from training set.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, table, texts

KINDS = ("email", "ip", "card", "phone")
DIGITS = re.compile(r"[0-9]")
LEFT = re.compile(r"[A-Za-z0-9._%+-]")
RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: An at sign, or a word for it.
AT = re.compile(r"@|[(\[{] ?at ?[)\]}]|\bat\b(?=[^@]{1,60}?\bdot\b)", re.IGNORECASE)
#: An address with its at sign and at least one dot written with spaces, brackets or words.
#: A name of at most 64 characters (as mail allows) and gaps of at most 5: time linear in an unbroken run.
LOOSE = re.compile(r"[A-Za-z0-9._%+-]{1,64}+(?:\s{0,5}[(\[{]\s{0,5}(?:at|@)\s{0,5}[)\]}]\s{0,5}|\s{1,5}at\s{1,5}|\s{0,5}@\s{0,5})[A-Za-z0-9-]++(?:(?:\s{0,5}[(\[{]\s{0,5}(?:dot|\.)\s{0,5}[)\]}]\s{0,5}|\s{1,5}dot\s{1,5}|\s{0,5}\.)[A-Za-z0-9-]++)+", re.IGNORECASE)
#: Digits of a number and what may stand between them, and the other characters of a number.
GROUPS = re.compile(r"[0-9]+")
RUN = re.compile(r"[0-9]+(?:(?:[\s.,:/()\[\]_-]{1,5}|\s?dot\s?)[0-9]+)*", re.IGNORECASE)
BETWEEN = re.compile(r"[0-9\s.,:/()\[\]+_-]|dot", re.IGNORECASE)

#: Bounds of the training sample: the documents that it is chosen from and that teach, about and at most, and the
#: characters of the excerpt that a longer text is represented by (at a place given by its hash).
SAMPLE_DRAWN, SAMPLE_DOCS, SAMPLE_EXCERPT = 3000, 1500, 8000
#: Digits beyond a tagged span's edge that are looked at; a longer number is of no kind.
NUMBER = 64
HIDDEN, EMBED = 24, 12
LENGTH, STRIDE = 96, 48
STEPS, BATCH, RATE = 320, 48, 0.02
#: Least mean margins (log-odds against "outside") of an added span to choose from, and the share of the
#: held-out spans added at it that must be right.
MARGINS, PRECISION = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0), 0.98
#: One in so many texts is held out to choose the margin.
HELD_OUT = 5
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begin, 2 + 2k inside


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:  # the leftmost match takes the whole run before an at sign, back to the last match
        start = at
        while start > end and LEFT.match(text[start - 1]):
            start -= 1
        m = RIGHT.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            end = m.end()
        else:
            end = max(end, at)
        at = text.find("@", at + 1 if not m else m.end())
    if not DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def codes(text: str) -> np.ndarray:
    """Character classes 1..: printable ASCII as itself, other letters, other characters; 0 is padding."""
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((u >= 32) & (u < 127), u - 31, np.where(u < 32, 96, 97)).astype(np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Tagger:
    """Bidirectional LSTM with CRF transitions."""

    def __init__(self, seed: int = 3):
        g = np.random.default_rng(seed)
        self.margin = MARGINS[-1]
        n = lambda *s: g.normal(0, 0.15, s).astype(np.float32)
        self.p = {"e": n(98, EMBED), "o": n(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"{d}x": n(EMBED, 4 * HIDDEN), f"{d}h": n(HIDDEN, 4 * HIDDEN), f"{d}c": bias}

    def lstm(self, x: np.ndarray, d: str, keep: bool = False):
        """States (time x batch x hidden) over x (time x batch x 4 hidden, inputs already projected)."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c, out, trace = h, np.empty((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in range(len(x)):
            z = x[t] + h @ self.p[f"{d}h"]
            s = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            old, c = c, f * c + i * g
            if keep:
                trace.append((h, old, i, f, o, g, np.tanh(c)))
            h = o * np.tanh(c)
            out[t] = h
        return out, trace

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Tag scores (time x batch x tags) of windows x (batch x time)."""
        e = self.p["e"][x.T]
        f, tf = self.lstm(e @ self.p["fx"] + self.p["fc"], "f", keep)
        b, tb = self.lstm((e @ self.p["bx"] + self.p["bc"])[::-1], "b", keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        return h @ self.p["o"] + self.p["ob"], (e, h, tf, tb)

    def back(self, dh: np.ndarray, trace: list, d: str) -> tuple[np.ndarray, dict]:
        dx, w = np.empty((len(dh), dh.shape[1], 4 * HIDDEN), np.float32), np.zeros_like(self.p[f"{d}h"])
        later, dc = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        for t in range(len(dh) - 1, -1, -1):
            h, old, i, f, o, g, tc = trace[t]
            dht = dh[t] + later
            dc = dc + dht * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dht * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dc = dc * f
            dx[t], later = dz, dz @ self.p[f"{d}h"].T
            w += h.T @ dz
        return dx, {f"{d}h": w, f"{d}c": dx.sum(axis=(0, 1))}

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Of the CRF's negative log-likelihood for windows x with tags y (batch x time)."""
        s, (e, h, tf, tb) = self.emissions(x, keep=True)
        s, tr = s.astype(np.float64), self.p["t"].astype(np.float64)
        n, m = s.shape[:2]
        a, b = np.empty_like(s), np.zeros_like(s)
        a[0] = s[0]
        join = lambda z, axis: (top := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - top).sum(axis=axis))
        for t in range(1, n):
            a[t] = s[t] + join(a[t - 1][:, :, None] + tr, 1)
        for t in range(n - 2, -1, -1):
            b[t] = join(tr + (s[t + 1] + b[t + 1])[:, None, :], 2)
        z = join(a[-1], 1)
        ds = np.exp(a + b - z[None, :, None])
        dt = np.zeros_like(tr)
        for t in range(n - 1):
            dt += np.exp(a[t][:, :, None] + tr + (s[t + 1] + b[t + 1])[:, None, :] - z[:, None, None]).sum(axis=0)
        rows = np.arange(m)
        for t in range(n):
            ds[t, rows, y[:, t]] -= 1
        np.subtract.at(dt, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        ds = (ds / m).astype(np.float32)
        grads = {"t": (dt / m).astype(np.float32), "o": np.einsum("tbh,tbk->hk", h, ds), "ob": ds.sum(axis=(0, 1))}
        dh = ds @ self.p["o"].T
        dxf, gf = self.back(dh[:, :, :HIDDEN], tf, "f")
        dxb, gb = self.back(dh[::-1, :, HIDDEN:], tb, "b")
        dxb = dxb[::-1]
        grads |= gf | gb | {"fx": np.einsum("tbe,tbh->eh", e, dxf), "bx": np.einsum("tbe,tbh->eh", e, dxb)}
        de = dxf @ self.p["fx"].T + dxb @ self.p["bx"].T
        grads["e"] = np.zeros_like(self.p["e"])
        np.add.at(grads["e"], x.T, de)
        return grads

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch x time) and their emission margin over "outside"."""
        s, _ = self.emissions(x)
        n, m = s.shape[:2]
        score, back = s[0], np.empty((n, m, TAGS), np.int8)
        for t in range(1, n):
            z = score[:, :, None] + self.p["t"]
            back[t] = z.argmax(axis=1)
            score = z.max(axis=1) + s[t]
        tags = np.empty((n, m), np.int64)
        tags[-1] = score.argmax(axis=1)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None], axis=1)[:, 0]
        margin = np.take_along_axis(s, tags[:, :, None], axis=2)[:, :, 0] - s[:, :, 0]
        return tags.T, margin.T


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(n, dtype=np.int64)
    for kind, a, b in sorted(spans, key=lambda s: (s[0] != 0, s[1])):
        if not y[a:b].any():
            y[a:b] = 2 + 2 * kind
            y[a] = 1 + 2 * kind
    return y


def loosened(kind: int, old: str, g: np.random.Generator) -> str:
    """A span in a form that the patterns miss."""
    pick = lambda *of: of[int(g.integers(len(of)))]
    if kind == 0:
        at, dot = pick((" @ ", "."), ("@ ", "."), (" (at) ", "."), (" (at) ", " dot "), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "))
        name, _, host = old.partition("@")
        return name + at + host.replace(".", dot)
    if kind == 1:
        return old.replace(".", pick(" . ", ". ", " .", "[.]", "(.)", " dot ", ".\n"))
    if kind == 2:
        d = "".join(GROUPS.findall(old))
        return pick(".", "  ", "\n", " - ", "/", "_", ". ").join(d[k : k + 4] for k in range(0, len(d), 4))
    return old.replace("+", "00", 1)


def made(kind: int, g: np.random.Generator) -> str:
    """A span of the kind, as the patterns find it."""
    word = lambda a, b: "".join(chr(97 + int(c)) for c in g.integers(0, 26, int(g.integers(a, b))))
    if kind == 0:
        return word(2, 9) + ("." + word(2, 9) if g.random() < 0.4 else "") + (str(g.integers(100)) if g.random() < 0.3 else "") + "@" + ".".join([word(3, 10), *([word(3, 8)] if g.random() < 0.3 else []), ("com", "org", "net", "de", "io")[int(g.integers(5))]])
    if kind == 1:
        return ".".join(str(x) for x in g.integers(0, 256, 4))
    if kind == 2:
        d = str(g.integers(3, 7)) + "".join(str(x) for x in g.integers(0, 10, 14))
        if g.random() < 0.4:  # many test numbers repeat a digit
            d = d[:4] + d[4] * 4 + d[int(g.integers(4, 6))] * 4 + d[12:]
        d += next(c for c in "0123456789" if luhn(d + c))
        return " ".join(d[k : k + 4] for k in range(0, 16, 4))
    return f"+{g.integers(1, 99)} " + (" ", "-")[int(g.integers(2))].join(str(x) for x in (g.integers(100, 1000), g.integers(100, 1000), g.integers(1000, 10000)))


def rewritten(text: str, spans: list, g: np.random.Generator) -> tuple[str, list, int]:
    """A labelled example, with its place: one span put into a form that the patterns miss, or one of a kind made."""
    if spans and g.random() < 0.4:
        kind, a, b = spans[int(g.integers(len(spans)))]
        old = text[a:b]
    else:  # between two words outside the spans
        kind = int(g.integers(len(KINDS)))
        gaps = [m.start() + 1 for m in re.finditer(" ", text) if not any(a <= m.start() + 1 <= b for _, a, b in spans)] or [len(text)]
        a = b = gaps[int(g.integers(len(gaps)))]
        old = made(kind, g)
    new, tail = loosened(kind, old, g), "" if b > a else " "
    shift = len(new) + len(tail) - (b - a)
    others = [s for s in spans if s[2] <= a] + [(k, s + shift, e + shift) for k, s, e in spans if s >= b]
    return text[:a] + new + tail + text[b:], [*others, (kind, a, a + len(new))], a


def train(found: list[str], steps: int = STEPS, seed: int = 3) -> Tagger | None:
    """Adam on windows around the spans that the patterns mark, rewritten and made ones, and others; None without any text."""
    g, xs, ys = np.random.default_rng(seed), [], []

    def take(text, spans, at):
        c, y = codes(text), tags_of(len(text), spans)
        a = max(0, min(at - int(g.integers(LENGTH // 4, 3 * LENGTH // 4)), len(c) - LENGTH))
        x, t = np.zeros(LENGTH, np.int64), np.zeros(LENGTH, np.int64)
        part = slice(a, a + LENGTH)
        x[: len(c[part])], t[: len(c[part])] = c[part], y[part]
        xs.append(x), ys.append(t)

    for text in [t for k, t in enumerate(found) if k % HELD_OUT or len(found) < HELD_OUT]:
        spans = base_spans(text)
        for s in spans[:6]:
            take(text, spans, s[1])
        for _ in range(2):
            take(*rewritten(text, spans, g))
        for m in list(DIGITS.finditer(text))[:40:8] + list(AT.finditer(text))[:2] or ([re.match("", text)] if g.random() < 0.3 else []):
            take(text, spans, m.start())
    if not any(y.any() for y in ys):
        return None
    x, y = np.stack(xs), np.stack(ys)
    net = Tagger(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = g.integers(0, len(x), BATCH)
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))  # the second half falls to nothing
        for k, grad in net.gradient(x[pick], y[pick]).items():
            grad = np.clip(grad, -1, 1)
            first[k] += 0.1 * (grad - first[k])
            second[k] += 0.01 * (grad * grad - second[k])
            net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    net.margin = least_margin(net, found[::HELD_OUT], g)
    return net


def least_margin(net: Tagger, held_out: list[str], g: np.random.Generator) -> float:
    """The least margin at which enough of the spans added to held-out texts, each also with a rewritten span, lie in marked ones."""
    plain = [(t, base_spans(t)) for t in held_out]
    pairs = plain + [rewritten(t, s, g)[:2] for t, s in plain for _ in range(2)]
    net.margin, margins = MARGINS[0], []
    added = added_spans([t for t, _ in pairs], [base_spans(t) for t, _ in pairs], net, margins)
    right = [any(s[0] == k and a < s[2] and s[1] < b for s in marked) for (_, marked), spans in zip(pairs, added) for k, a, b in spans]
    for least in MARGINS:
        kept = [r for r, m in zip(right, margins) if m >= least]
        if sum(kept) >= PRECISION * len(kept):
            return least
    return MARGINS[-1]


def reads_as(kind: int, span: str) -> tuple[int, int] | None:
    """Start and end within the span of what reads as its kind; None if nothing does."""
    if kind == 0:
        m = LOOSE.search(span)
        return m.span() if m else None
    groups = list(GROUPS.finditer(span))
    digits = "".join(m.group() for m in groups)
    if not groups:
        return None
    edges = groups[0].start() - (kind == 3 and span[: groups[0].start()].endswith("+")), groups[-1].end()
    if BETWEEN.sub("", span[edges[0] : edges[1]]):
        return None
    if kind == 1:
        return edges if len(groups) == 4 and all(len(m.group()) <= 3 and int(m.group()) <= 255 for m in groups) and "\n\n" not in span else None
    if kind == 2:
        return edges if 13 <= len(digits) <= 19 and luhn(digits) else None
    return edges if 9 <= len(digits) <= 15 else None


def completed(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """The span with what the network missed at its edges: the address that it is part of, or cut off digits."""
    if kind == 0:
        return next((m.span() for m in LOOSE.finditer(text, max(0, a - LENGTH), b + LENGTH) if m.start() < b and a < m.end()), (a, b))
    low, high = max(0, a - NUMBER), min(len(text), b + NUMBER)
    while a > low and text[a - 1] in "0123456789" and text[a] in "0123456789":
        a -= 1
    while b < high and text[b] in "0123456789" and text[b - 1] in "0123456789":
        b += 1
    cut = lambda k: 0 < k < len(text) and text[k - 1] in "0123456789" and text[k] in "0123456789"
    return (a, a) if cut(a) or cut(b) else (a, b)


def added_spans(found: list[str], base: list[list], net: Tagger | None, margins: list | None = None) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds beside the base spans, for several texts; their margins go to ``margins``."""
    out: list[list] = [[] for _ in found]
    if net is None:
        return out
    rows, owner, start, chars = [], [], [], {}
    for k, text in enumerate(found):
        free, hits = text, [m.start() for m in DIGITS.finditer(text)] if DIGITS.search(text) else []
        if "@" in text or "at" in text.lower():
            hits += [m.start() for m in AT.finditer(text)]
        if not hits:
            continue
        covered = np.zeros(len(free), dtype=bool)
        for _, a, b in base[k]:
            covered[a:b] = True
        open_ = np.array(hits)[~covered[hits]]  # what the patterns hold already needs no window
        if not len(open_):
            continue
        c = chars[k] = codes(text)
        for w in np.unique(np.concatenate([open_ // STRIDE, np.maximum(open_ // STRIDE - 1, 0)])):
            a = int(w) * STRIDE
            x = np.zeros(LENGTH, np.int64)
            x[: len(c[a : a + LENGTH])] = c[a : a + LENGTH]
            rows.append(x), owner.append(k), start.append(a)
    done: dict[int, tuple] = {}
    for a in range(0, len(rows), 1024):
        tags, margin = net.decode(np.stack(rows[a : a + 1024]))
        for t, m, k, s in zip(tags, margin, owner[a : a + 1024], start[a : a + 1024]):
            n = min(LENGTH, len(chars[k]) - s)
            if k not in done:
                size = len(chars[k])
                done[k] = (np.zeros(size, np.int64), np.zeros(size), np.full(size, LENGTH))
            y, g, far = done[k]
            away = np.abs(np.arange(n) - LENGTH // 2)
            near = away < far[s : s + n]
            for old, new in ((y, t[:n]), (g, m[:n]), (far, away)):
                old[s : s + n][near] = new[near]
    for k, (y, g, _) in done.items():
        text = found[k]
        kind = (y - 1) // 2
        edges = [i for i in np.flatnonzero(y) if y[i] % 2 or i == 0 or y[i - 1] == 0 or kind[i - 1] != kind[i]]
        for a in edges:
            b = a + 1
            while b < len(y) and y[b] == 2 + 2 * kind[a]:
                b += 1
            score = g[a:b].mean()
            lo, hi = completed(text, kind[a], a, b)
            read = [(k, lo, hi) for k in ((0,) if kind[a] == 0 else (kind[a], 2, 1))]  # a number can be of another kind
            if kind[a]:  # or tagged in pieces
                read += [(k, *m.span()) for m in RUN.finditer(text, max(0, lo - LENGTH // 2), hi + LENGTH // 2) if m.start() < hi and lo < m.end() for k in (2, 1)]
            part = next(((int(k), int(x + p[0]), int(x + p[1])) for k, x, y in read if (p := reads_as(k, text[x:y]))), None)
            if part and score >= net.margin:
                _, lo, hi = part
                if not any(s < hi and lo < e for _, s, e in base[k]):
                    out[k].append(part)
                    if margins is not None:
                        margins.append(score)
    return out


def find(found: list[str], net: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, all spans), each by kind, then start."""
    base = [sorted(base_spans(t)) for t in found]
    return [(b, sorted({*b, *more})) for b, more in zip(base, added_spans(found, base, net))]


def sample(docs: DataFrame) -> list[str]:
    """Excerpts of about SAMPLE_DRAWN distinct texts at most, those with the smallest hashes, of which the first
    SAMPLE_DOCS with a digit or at sign, then others: a share of the hashes by the row count, and each text once, so that
    neither the table's size nor a text's copies or length add to what reaches the driver."""
    rows = texts(docs)
    n = rows.count()
    unit = F.pmod(F.xxhash64("text", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    some = rows.select("text").filter(F.col("text").isNotNull() & (unit < SAMPLE_DRAWN / max(n, 1))).dropDuplicates(["text"])
    start = F.pmod(F.xxhash64("text", F.lit(32)), F.greatest(F.length("text") - SAMPLE_EXCERPT + 1, F.lit(1))).cast("int") + 1
    part = some.filter(F.col("text").rlike("[^ ]")).select(F.xxhash64("text", F.lit(31)).alias("at"), F.substring("text", start, SAMPLE_EXCERPT).alias("text"))
    found = part.withColumn("plain", ~F.col("text").rlike("[0-9@]")).orderBy("plain", "at", "text").limit(SAMPLE_DOCS).collect()
    return [r["text"] for r in found]


def learn(docs: DataFrame) -> Tagger | None:
    """Train on a bounded sample."""
    return train(sample(docs))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the spans of every document.

    NULL and empty texts have none (the hash is that of the empty string).  Repeated rows
    and documents give the same spans; an empty table gives an empty result.
    """
    import pyarrow as pa

    docs = table(spark, sf_dir, "documents")
    shared = Shared(spark, learn(docs))

    def run(batches):
        for batch in batches:
            found = [t or "" for t in batch.column(1).to_pylist()]
            cols: list[list] = [[] for _ in range(6)]
            for base, every in find(found, shared.value):
                for k in range(4):
                    cols[k].append(sum(s[0] == k for s in every))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list) -> str:
    """Each span, or run of overlapping spans, replaced by the kind of its first, in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; other columns stay (n_chars follows)."""
    shared = Shared(docs.sparkSession, learn(docs))

    @F.pandas_udf("string")
    def clean(column):
        kept = [t if t is not None else None for t in column]
        done = find([t or "" for t in kept], shared.value)
        return column.__class__([None if t is None else redact(t, every) for t, (_, every) in zip(kept, done)], dtype=object)

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
