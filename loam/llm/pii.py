"""Personal data: base patterns plus a character-level BiLSTM with CRF transitions.

The base patterns (email, ip, card, phone) are exact. The model adds spans that they miss, such as
phone numbers without a plus sign or addresses with spaces around the at sign. It reads one character
class per step, forward and backward; a linear chain over the tags O and B-/I- of each kind is
decoded by Viterbi. It is trained in numpy, by gradient descent on the chain's log likelihood, from
labelled spans that a seeded generator writes, among them decoys (dates, prices, hashes, versions).

A span of any kind must hold a digit or an at sign (``plausible``). So only windows around those characters are run
at first, and others where ``everywhere`` is asked for; tests compare both. Windows overlap by half. A span that touches a window's end inside the text, and lies in no
whole one, is decoded again in ever wider windows until it ends within, wherever that is; each document's
decodings are reconciled over the whole text (``reconcile``).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, in linear time; ordered by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        begin = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((1, begin, end))
            begin = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# --- the model ---------------------------------------------------------------------------------

N_TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_OTHER = 1  # 0 is padding
_CLASS = np.full(128, _OTHER, np.int64)
for _i, _c in enumerate("@.-_+()[]{}/=:;,%#\"' \n\t"):
    _CLASS[ord(_c)] = 2 + _i
_CLASS[48:58] = 30
for _i in range(26):
    _CLASS[97 + _i] = 31 + _i
    _CLASS[65 + _i] = 57 + _i
_LETTER = 83  # letters beyond ASCII
N_CLASSES = 84
WINDOW, STRIDE, MARGIN = 64, 32, 20


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], _LETTER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Parameters of both directions, the output layer and the chain; float32."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.hidden = hidden
        self.p = {"xf": f(N_CLASSES, 4 * hidden), "uf": f(hidden, 4 * hidden), "xb": f(N_CLASSES, 4 * hidden), "ub": f(hidden, 4 * hidden), "o": f(2 * hidden, N_TAGS), "ob": np.zeros(N_TAGS, np.float32), "t": np.zeros((N_TAGS, N_TAGS), np.float32), "s": np.zeros(N_TAGS, np.float32)}
        for k in ("xf", "xb"):
            self.p[k][:, hidden : 2 * hidden] += 1  # forget gates start open
        banned = np.zeros((N_TAGS, N_TAGS), np.float32)
        for i in range(2, N_TAGS, 2):  # I only after B or I of its kind
            banned[:, i] = -1e4
            banned[i - 1, i] = banned[i, i] = 0
        self.banned = banned
        self.start = np.where((np.arange(N_TAGS) % 2 == 0) & (np.arange(N_TAGS) > 0), -1e4, 0).astype(np.float32)

    def _run(self, ids: np.ndarray, x: np.ndarray, u: np.ndarray, keep: bool):
        """Hidden states of one direction over (batch, steps); with ``keep``, what the backward pass needs."""
        b, steps = ids.shape
        h = self.hidden
        hs = np.zeros((steps + 1, b, h), np.float32)
        cs = np.zeros((steps + 1, b, h), np.float32)
        gates = np.empty((steps, b, 4 * h), np.float32) if keep else None
        for t in range(steps):
            z = x[ids[:, t]] + hs[t] @ u
            g = np.empty_like(z)
            g[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cs[t + 1] = g[:, h : 2 * h] * cs[t] + g[:, :h] * g[:, 3 * h :]
            hs[t + 1] = g[:, 2 * h : 3 * h] * np.tanh(cs[t + 1])
            if keep:
                gates[t] = g
        return hs, cs, gates

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(steps, batch, tags)."""
        forward, _, _ = self._run(ids, self.p["xf"], self.p["uf"], False)
        back, _, _ = self._run(ids[:, ::-1], self.p["xb"], self.p["ub"], False)
        return np.concatenate([forward[1:], back[1:][::-1]], 2) @ self.p["o"] + self.p["ob"]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi tags, (batch, steps)."""
        e = self.emissions(ids)
        steps, b, _ = e.shape
        move = self.p["t"] + self.banned
        score = e[0] + self.p["s"] + self.start
        back = np.empty((steps, b, N_TAGS), np.int8)
        for t in range(1, steps):
            options = score[:, :, None] + move
            back[t] = options.argmax(1)
            score = options.max(1) + e[t]
        tags = np.empty((b, steps), np.int8)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(b)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the chain and its gradient, by forward-backward and through time."""
        p, h = self.p, self.hidden
        b, steps = ids.shape
        fh, fc, fg = self._run(ids, p["xf"], p["uf"], True)
        bh, bc, bg = self._run(ids[:, ::-1], p["xb"], p["ub"], True)
        hidden = np.concatenate([fh[1:], bh[1:][::-1]], 2)
        e = (hidden @ p["o"] + p["ob"]).astype(np.float64)
        move = (p["t"] + self.banned).astype(np.float64)
        first = (p["s"] + self.start).astype(np.float64)
        step = np.exp(move)  # sums over paths as matrix products, rescaled by each row's greatest term
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = first + e[0]
        for t in range(1, steps):
            m = alpha[t - 1].max(1, keepdims=True)
            alpha[t] = np.log(np.exp(alpha[t - 1] - m) @ step + 1e-300) + m + e[t]
        for t in range(steps - 2, -1, -1):
            ahead = e[t + 1] + beta[t + 1]
            m = ahead.max(1, keepdims=True)
            beta[t] = np.log(np.exp(ahead - m) @ step.T + 1e-300) + m
        m = alpha[-1].max(1, keepdims=True)
        norm = np.log(np.exp(alpha[-1] - m).sum(1)) + m[:, 0]
        rows = np.arange(b)
        gold = first[tags[:, 0]] + e[0, rows, tags[:, 0]]
        d_e = np.exp(alpha + beta - norm[None, :, None])
        d_t = np.zeros_like(move)
        for t in range(1, steps):
            gold += move[tags[:, t - 1], tags[:, t]] + e[t, rows, tags[:, t]]
            a, c = alpha[t - 1], e[t] + beta[t] - norm[:, None]
            m = a.max(1, keepdims=True)
            d_t += step * (np.exp(a - m).T @ np.exp(c + m))
            np.add.at(d_t, (tags[:, t - 1], tags[:, t]), -1)
        d_s = d_e[0].sum(0)
        np.add.at(d_s, tags[:, 0], -1)
        for t in range(steps):
            d_e[t, rows, tags[:, t]] -= 1
        d_e = (d_e / b).astype(np.float32)
        g = {"t": (d_t / b).astype(np.float32), "s": (d_s / b).astype(np.float32), "o": np.einsum("tbh,tbk->hk", hidden, d_e), "ob": d_e.sum((0, 1))}
        d_h = d_e @ p["o"].T
        for x, u, hs, cs, gs, i, d in (("xf", "uf", fh, fc, fg, ids, d_h[:, :, :h]), ("xb", "ub", bh, bc, bg, ids[:, ::-1], d_h[::-1, :, h:])):
            gu = np.zeros_like(p[u])
            dzs = np.empty((steps, b, 4 * h), np.float32)
            dh_next, dc_next = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
            for t in range(steps - 1, -1, -1):
                gi, gf, go, gg = gs[t][:, :h], gs[t][:, h : 2 * h], gs[t][:, 2 * h : 3 * h], gs[t][:, 3 * h :]
                dh = d[t] + dh_next
                tc = np.tanh(cs[t + 1])
                dc = dc_next + dh * go * (1 - tc * tc)
                dz = np.concatenate([dc * gg * gi * (1 - gi), dc * cs[t] * gf * (1 - gf), dh * tc * go * (1 - go), dc * gi * (1 - gg * gg)], 1)
                dzs[t] = dz
                gu += hs[t].T @ dz
                dh_next, dc_next = dz @ p[u].T, dc * gf
            hot = (i.T.reshape(-1, 1) == np.arange(N_CLASSES)).astype(np.float32)
            g[x], g[u] = hot.T @ dzs.reshape(-1, 4 * h), gu
        return float((norm - gold).mean()), g


def labelled_line(rng: np.random.Generator, length: int = WINDOW) -> tuple[str, np.ndarray]:
    """A line of invented words with labelled spans and decoys, and its tags."""
    pick = lambda s: s[int(rng.integers(len(s)))]
    digits = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    word = lambda: "".join(pick(("th", "er", "on", "an", "re", "é", "ü", "ción", "in", "st", "la", "de", "ou", "en")) for _ in range(int(rng.integers(1, 4))))
    name = lambda: "".join(pick("abcdefghijklmnoprstuvwyz") for _ in range(int(rng.integers(2, 9))))

    def card() -> str:
        n = digits(15)
        n += next(str(d) for d in range(10) if luhn(n + str(d)))
        s = pick(("", "", " ", "-"))
        return s.join(n[i : i + 4] for i in range(0, 16, 4))

    makers = (
        (0, lambda: f"{name()}{pick(('', '.', '_'))}{pick(('', digits(2)))}{pick(('@', '@', '@', ' @ ', '[@]'))}{name()}{pick(('', digits(1)))}.{pick(('example.com', 'org', 'net', 'co.uk'))}"),
        (1, lambda: ".".join(str(int(x)) for x in rng.integers(0, 256, 4))),
        (2, card),
        (3, lambda: pick((f"+1 ({digits(3)}) 555-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(11)}"))),
    )
    decoys = (
        lambda: f"{int(rng.integers(1900, 2100))}-{digits(2)}-{digits(2)}",
        lambda: f"{pick('$€')}{digits(int(rng.integers(1, 6)))}.{digits(2)}",
        lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: digits(int(rng.integers(1, 9))),
        lambda: "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(12, 40)))),
        lambda: f"password={''.join(pick('0123456789abcdef') for _ in range(18))}",
        lambda: f"@{name()}",
        lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"http://{name()}.example.com/{name()}/{digits(4)}",
    )
    text, tags = "", []
    # the window may begin anywhere, also within a span
    while len(text) < 2 * length:
        r = rng.random()
        if r < 0.17:
            kind, make = pick(makers)
            s = make()
            text += s
            tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
        else:
            s = pick(decoys)() if r < 0.27 else word().capitalize() if r < 0.34 else word()
            text += s
            tags += [0] * len(s)
        s = pick((" ", " ", " ", " ", ". ", ", ", "\n", ": "))
        text += s
        tags += [0] * len(s)
    at = int(rng.integers(0, len(text) - length + 1))
    out = np.array(tags[at : at + length])
    if out[0] and out[0] % 2 == 0:
        out[0] -= 1
    return text[at : at + length], out


@lru_cache(maxsize=2)
def train(lines: int = 6_000, rounds: int = 260, batch: int = 96, seed: int = 11) -> Tagger:
    """Fit by Adam on seeded labelled lines: the same parameters on every call."""
    rng = np.random.default_rng(seed)
    data = [labelled_line(rng) for _ in range(lines)]
    ids, tags = np.stack([classes(t) for t, _ in data]), np.stack([g for _, g in data])
    model = Tagger()
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step in range(1, rounds + 1):
        rows = rng.integers(0, lines, batch)
        _, g = model.gradient(ids[rows], tags[rows])
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.02 * min(1, step / 20) * (0.5 * (1 + np.cos(np.pi * step / rounds)) + 0.02)
        for k in model.p:
            d = g[k] * min(1.0, 10 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.98 * v[k] + 0.02 * d * d
            model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return model


def zones(text: str) -> list[tuple[int, int]]:
    """Merged stretches of the text within ``MARGIN`` of a digit or an at sign."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(text: str, everywhere: bool = False) -> list[tuple[int, int, bool, bool]]:
    """(start, end, the text goes on before, ... after): windows that overlap by half cover each zone, or the whole text."""
    out = []
    for a, b in [(0, len(text))] if everywhere else zones(text):
        at = a
        while True:
            end = min(at + WINDOW, b)
            out.append((at, end, at > 0, end < len(text)))
            if end == b:
                break
            at += STRIDE
    return out


def plausible(kind: int, s: str) -> bool:
    digits = sum(c.isdigit() for c in s)
    if kind == 0:
        return "@" in s and "." in s and len(s) >= 6
    if kind == 1:
        return digits >= 4 and s.count(".") >= 3 and all(c.isdigit() or c == "." for c in s)
    if kind == 2:
        return 13 <= digits <= 19 and all(c.isdigit() or c in " -" for c in s)
    return 8 <= digits <= 15 and all(c.isdigit() or c in "+()-. " for c in s) and s.count(" ") <= 6


def reconcile(text: str, base: list[Span], found: list[tuple[int, int, int, bool]]) -> list[Span]:
    """All spans of a text, ordered by kind, then start.

    found: (kind, start, end, cut) of every window, in any order; cut: it touches a side where its
    window ends but the text goes on. Cut spans give way to whole ones, which ``find`` has sought for each; of overlapping spans the longest stays
    (ties: earlier start, lesser kind). Base spans are never moved: what overlaps one is dropped.
    """
    taken = sorted((s, e) for _, s, e in base)
    out = list(base)
    ranked = sorted({f for f in found if plausible(f[0], text[f[1] : f[2]])}, key=lambda f: (f[3], f[1] - f[2], f[1], f[0]))
    for kind, s, e, cut in ranked:
        if cut or any(a < e and s < b for a, b in taken):
            continue
        taken.append((s, e))
        out.append((kind, s, e))
    return sorted(out)


def _wider(n: int, cut: list, found: list, base: list[Span], pad: int) -> list[tuple[int, int, bool, bool]]:
    """Merged windows, ``pad`` wider on both sides, around the cut spans that lie in no whole span and overlap no base span."""
    whole = [(s, e) for _, s, e, c in found if not c]
    taken = [(s, e) for _, s, e in base]
    out: list[list[int]] = []
    for s, e in sorted({(s, e) for _, s, e, _ in cut}):
        if any(a <= s and e <= b for a, b in whole) or any(a < e and s < b for a, b in taken):
            continue
        a, b = max(0, s - pad), min(n, e + pad)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b, a > 0, b < n) for a, b in out]


def _decoded(texts: list[str | None], jobs: list, model: Tagger):
    """(text, (kind, start, end, cut)) of each span that the model finds in windows of any length."""
    jobs = sorted(jobs, key=lambda j: max(WINDOW, j[1][1] - j[1][0]))
    at = 0
    while at < len(jobs):
        # as many as 1,024 windows of usual length have characters, and one at least
        stop = at + 1
        while stop < len(jobs) and (stop + 1 - at) * max(WINDOW, jobs[stop][1][1] - jobs[stop][1][0]) <= 1024 * WINDOW:
            stop += 1
        part, at = jobs[at:stop], stop
        ids = np.zeros((len(part), max(WINDOW, part[-1][1][1] - part[-1][1][0])), np.int64)
        for r, (i, (a, b, _, _)) in enumerate(part):
            ids[r, : b - a] = classes(texts[i][a:b])
        tags = model.decode(ids)
        for r in np.flatnonzero((tags > 0).any(1)):
            i, (a, b, before, after) = part[r]
            row = tags[r, : b - a]
            for s in np.flatnonzero(row % 2 == 1):
                e = s + 1
                while e < len(row) and row[e] == row[s] + 1:
                    e += 1
                t = texts[i][a + s : a + e]
                lead = len(t) - len(t.lstrip())
                yield i, ((int(row[s]) - 1) // 2, int(a + s + lead), int(a + e - (len(t) - len(t.rstrip()))), bool((s == 0 and before) or (e == len(row) and after)))


def find(texts: list[str | None], model: Tagger | None, everywhere: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each whole text; null counts as empty. Without a model both are the base.

    ``everywhere``: the first windows cover the whole text, not the zones alone, at many times the cost.
    """
    base = [sorted(base_spans(t)) if t else [] for t in texts]
    if model is None:
        return [(b, b) for b in base]
    found: dict[int, list] = {}
    jobs = [(i, w) for i, t in enumerate(texts) if t for w in windows(t, everywhere)]
    pad = WINDOW // 2
    while jobs:
        cut: dict[int, list] = {}
        for i, span in _decoded(texts, jobs, model):
            found.setdefault(i, []).append(span)
            if span[3]:
                cut.setdefault(i, []).append(span)
        jobs = [(i, w) for i, spans in cut.items() for w in _wider(len(texts[i]), spans, found[i], base[i], pad)]
        pad *= 2
    return [(b, reconcile(texts[i], b, found[i]) if i in found else b) for i, b in enumerate(base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, base_sha256, spans, n_added.

    One pass without a shuffle. Null texts count as empty, null and repeated ids are kept.
    """
    model = model or train()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = find(part.column(1).to_pylist(), model)
                counts = [[sum(s[0] == k for s in b) for b, _ in got] for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got], pa.string()), pa.array([written(a) for _, a in got], pa.string()), pa.array([len(a) - len(b) for b, a in got], pa.int64())],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans gives way to the name of its first kind in brackets."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The documents with personal data replaced; n_chars, where there is such a column, is counted anew."""
    model = model or train()

    def run(batches):
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            at_n = batch.schema.get_field_index("n_chars")
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(at_text).to_pylist()
                new = [redacted(t, a) if a else t for t, (_, a) in zip(texts, find(texts, model))]
                columns = list(part.columns)
                columns[at_text] = pa.array(new, part.schema.field(at_text).type)
                if at_n >= 0:
                    columns[at_n] = pa.array([n if t is s else len(t) for n, t, s in zip(columns[at_n].to_pylist(), new, texts)], part.schema.field(at_n).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return detect(table(spark, sf_dir, "documents"))
