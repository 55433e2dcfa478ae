"""Personal data: base patterns plus a character-level bidirectional LSTM with CRF transitions.

The network is written and trained in numpy, on labelled spans that ``examples`` generates from a
seed (plain and disguised addresses and numbers among words, dates, versions and ids).  Long texts
are read in overlapping windows.  Windows that overlap are reconciled globally: their emissions are
averaged, weighted by how central a character lies, and one Viterbi pass decodes the whole run of
adjoining windows, so a span is never cut where windows meet.

A span must hold a digit, an ``@``, a bracketed ``at`` or a lone ``dot`` (that is part of the label
scheme), so a window without one can only decode to nothing and isn't read; every other window of
the whole text is.  What the network adds must hold what its kind consists of (``valid``) and may
not touch a base span; base spans always stay.

Defined cases: a null text is empty and has no spans; rows that repeat a doc_id are read each on
its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spindrift.llm import textbytes as tb

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CHARS, EMBED, HIDDEN = 130, 12, 16
WINDOW, STRIDE = 96, 48

#: Base patterns, fixed by the contract.  A lookbehind pins a match to the start of its run of
#: digits, where the leftmost match starts anyway, so a long run is read once.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?(?i:at)\s?[\])}>]|(?<=\s)(?i:dot)(?=\s)")
#: Bytes without which a text can hold neither a base span nor a trigger, but for a lone ``dot``.
HOT = np.zeros(256, bool)
HOT[[*range(0x30, 0x3A), 0x40, 0x28, 0x5B, 0x7B, 0x3C]] = True
#: What an added address consists of: names around one sign for at, then names with a sign for dot
#: between them.  A sign is plain, bracketed, or a word of its own; one of them must be disguised.
NAME, LABEL = r"[A-Za-z0-9._%+-]+", r"[A-Za-z0-9-]+"
AT = r"(?: ?[\[({<] ?(?i:at) ?[\])}>] ?| (?i:at) | ?@ ?)"
DOT = r"(?: ?[\[({<] ?(?i:dot|\.) ?[\])}>] ?| (?i:dot) |\.| \. )"
ADDRESS = re.compile(rf"{NAME}{AT}{LABEL}(?:{DOT}{LABEL})+")
PLAIN = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
OCTETS = re.compile(r"[0-9]{1,3}(?: ?[\[({<]? ?\.(?: ?[\])}>])? ?[0-9]{1,3}){3}")
NUMBER = re.compile(r"[0-9(][0-9 ()./-]*[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@`` outwards."""
    out, free, at = [], 0, t.find("@")
    while at >= 0:
        begin = at
        while begin > free and LOCAL.match(t[begin - 1]):
            begin -= 1
        m = DOMAIN.match(t, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = t.find("@", at + 1)
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the contract's base, by kind, then start."""
    out = [(0, a, b) for a, b in emails(t)]
    for m in IP.finditer(t):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(t):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(t):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def examples(n: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled spans: character codes and labels, each of shape (length, n)."""
    rng = np.random.default_rng(seed)
    syllables = "an er on es en de la re ti st ou le ion ung che ent ar co mi ta ver lich".split()
    pick = lambda x: x[rng.integers(len(x))]
    num = lambda k: "".join(str(rng.integers(10)) for _ in range(k))
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick(["", " ", "-", ".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def octets() -> list[str]:
        return [str(rng.integers(256)) for _ in range(4)]

    def email() -> str:
        local = word() + pick(["", "", f".{num(1)}", f".{num(2)}", f"_{word()}", f".{word()}", num(3)])
        dot = pick([".", ".", "[dot]", "(dot)", " [dot] ", " (dot) ", " dot ", " dot "])
        at = " at " if dot == " dot " and rng.random() < 0.8 else pick(["@", " [at] ", "[at]", "(at)", " (at) ", "{at}"])
        case = pick([str.lower, str.lower, str.upper, str.title])
        return local + case(at) + word() + case(dot) + pick(["com", "org", "net", "de"])

    makers = (
        email,
        lambda: pick([".", ".", "[.]", "(.)"]).join(octets()),
        card,
        lambda: pick([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)}/{num(7)}", f"0{num(2)} {num(3)} {num(4)}", f"0{num(4)}-{num(6)}", f"00{num(2)} {num(3)} {num(6)}"]),
    )
    noise = (
        lambda: f"version {num(1)}.{num(1)}",
        lambda: f"19{num(2)}-0{num(1)}-1{num(1)}",
        lambda: f"{num(2)}:{num(2)}",
        lambda: num(int(rng.integers(1, 8))),
        lambda: f"{num(1)},{num(3)}.{num(2)}",
        lambda: f'"{num(3)}ab{num(4)}cd{num(3)}e"',
        lambda: f"@{word()}",
        lambda: f"({word()})",
        lambda: f"{word()} at {word()}",
        lambda: f"{word()} dot {word()}",
        lambda: f"{num(3)}/{num(3)}",
        lambda: f"{num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
    )
    chars, labels = np.zeros((length, n), np.int64), np.zeros((length, n), np.int64)
    for col in range(n):
        text, marks = "", []
        while len(text) < length:
            kind = int(rng.integers(0, 12))
            if kind < 4:
                s = makers[kind]()
                marks.append((kind, len(text), len(text) + len(s)))
            else:
                s = pick(noise)() if kind < 7 else word()
            text += s + pick([" ", " ", " ", ", ", ".\n", "### "])
        shift = int(rng.integers(0, len(text) - length + 1))
        chars[:, col] = encode(text[shift : shift + length])
        for kind, a, b in marks:
            a, b = a - shift, b - shift
            if a < length and b > 0:
                labels[max(0, a) : min(length, b), col] = 2 + 2 * kind
                if a >= 0:
                    labels[a, col] = 1 + 2 * kind
    return chars, labels


def encode(t: str) -> np.ndarray:
    """Character codes below ``CHARS``; what isn't ASCII falls into one of two."""
    cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(cp < 128, cp, 128 + (cp & 1))


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def lstm(x: np.ndarray, u: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, HIDDEN) for gate inputs x (time, batch, 4 * HIDDEN)."""
    steps, batch, n = x.shape[0], x.shape[1], HIDDEN
    h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    out = np.empty((steps, batch, n), np.float32)
    for t in range(steps):
        z = x[t] + h @ u
        gates, g = _sig(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        old = c
        c = gates[:, n : 2 * n] * c + gates[:, :n] * g
        tc = np.tanh(c)
        if tape is not None:
            tape.append((h, old, gates, g, tc))
        h = gates[:, 2 * n :] * tc
        out[t] = h
    return out


def lstm_grad(dout: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of u."""
    steps, batch, n = dout.shape
    dx, du = np.empty((steps, batch, 4 * n), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    for t in reversed(range(steps)):
        h, old, gates, g, tc = tape[t]
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        d = np.concatenate([dc * g, dc * old, dh * tc], 1) * gates * (1 - gates)
        dz = np.concatenate([d, dc * i * (1 - g * g)], 1)
        dx[t] = dz
        du += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dx, du


def crf_grad(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood per sequence and its gradients by emissions and transitions."""
    steps, batch, _ = e.shape

    def lse(x, axis):
        m = x.max(axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = lse(alpha[-1], 1)
    de = np.exp(alpha + beta - z[:, None])
    pair = alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]
    dtrans = np.exp(pair).sum((0, 1))
    cols = np.arange(batch)
    gold = e[0, cols, y[0]]
    for t in range(1, steps):
        gold = gold + e[t, cols, y[t]] + trans[y[t - 1], y[t]]
    np.subtract.at(de, (np.arange(steps)[:, None], cols[None, :], y), 1)
    np.subtract.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), 1)
    return float((z - gold).mean()), de / batch, dtrans / batch


class Tagger:
    """The network's parameters, float32."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {
            "emb": draw(CHARS, EMBED) * 3,
            "wf": draw(EMBED, 4 * HIDDEN), "uf": draw(HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN, np.float32),
            "wb": draw(EMBED, 4 * HIDDEN), "ub": draw(HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32),
            "out": draw(2 * HIDDEN, LABELS), "ob": np.zeros(LABELS, np.float32),
            "trans": np.zeros((LABELS, LABELS), np.float32),
        }
        for b in ("bf", "bb"):
            self.p[b][HIDDEN : 2 * HIDDEN] = 1

    def emissions(self, chars: np.ndarray, tapes: tuple[list, list] | None = None):
        p = self.p
        f = lstm((p["emb"] @ p["wf"] + p["bf"])[chars], p["uf"], tapes and tapes[0])
        b = lstm((p["emb"] @ p["wb"] + p["bb"])[chars[::-1]], p["ub"], tapes and tapes[1])[::-1]
        h = np.concatenate([f, b], 2)
        return h @ p["out"] + p["ob"], h

    def step(self, chars: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch."""
        p, tapes, g = self.p, ([], []), {}
        e, h = self.emissions(chars, tapes)
        loss, de, g["trans"] = crf_grad(e, y, p["trans"])
        de = de.astype(np.float32)
        g["out"], g["ob"] = np.einsum("tbh,tbl->hl", h, de), de.sum((0, 1))
        dh = de @ p["out"].T
        g["emb"] = np.zeros_like(p["emb"])
        for side, c, d, tape in (
            ("f", chars, dh[:, :, :HIDDEN], tapes[0]),
            ("b", chars[::-1], dh[::-1, :, HIDDEN:], tapes[1]),
        ):
            dx, g["u" + side] = lstm_grad(d, p["u" + side], tape)
            by_char = np.zeros((CHARS, 4 * HIDDEN), np.float32)
            np.add.at(by_char, c.ravel(), dx.reshape(-1, 4 * HIDDEN))
            g["w" + side], g["b" + side] = p["emb"].T @ by_char, by_char.sum(0)
            g["emb"] += by_char @ p["w" + side].T
        return loss, g

    def viterbi(self, e: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """The best labels (time, batch) for emissions e; a column is decoded up to its ``length``."""
        steps, batch, _ = e.shape
        back = np.empty((steps, batch, LABELS), np.int8)
        s = e[0]
        for t in range(1, steps):
            m = s[:, :, None] + self.p["trans"]
            back[t] = m.argmax(1)
            fresh = m.max(1) + e[t]
            if length is not None:  # past its end a column stands still
                over = t >= length
                back[t, over] = np.arange(LABELS)
                fresh[over] = s[over]
            s = fresh
        y = np.empty((steps, batch), np.int64)
        y[-1] = s.argmax(1)
        for t in range(steps - 1, 0, -1):
            y[t - 1] = back[t, np.arange(batch), y[t]]
        return y

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best labels (time, batch) of texts of one length."""
        return self.viterbi(self.emissions(chars)[0])


@lru_cache(maxsize=2)
def train(n: int = 3072, length: int = 56, epochs: int = 12, batch: int = 64, seed: int = 3) -> Tagger:
    """Adam over seeded examples; the same seed gives the same network."""
    chars, labels = examples(n, length, seed)
    net, rng = Tagger(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t, total = 0, epochs * (n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n - batch + 1, batch):
            _, g = net.step(chars[:, order[i : i + batch]], labels[:, order[i : i + batch]])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            t += 1
            rate = 0.012 * (1 - t / (total + 1)) + 0.0005
            for k, x in g.items():
                x = (x * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def windows_of(t: str) -> list[int]:
    """Numbers of the windows that hold a trigger; window k starts at STRIDE * k - STRIDE / 2."""
    out: set[int] = set()
    for m in TRIGGER.finditer(t):
        k = (m.start() + STRIDE // 2) // STRIDE
        out.update(x for x in (k - 1, k) if x >= 0)
    return sorted(out)


#: How much a window's emission counts at each of its places: most at its centre.
WEIGHT = (1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)
#: Windows that are decoded as one run at most; a longer run (over 12,000 characters without a
#: pause) is decoded in overlapping runs.
RUN = 256


def runs_of(t: str) -> list[tuple[int, int]]:
    """Runs of adjoining windows (first, last)."""
    out: list[tuple[int, int]] = []
    for k in windows_of(t):
        if out and k == out[-1][1] + 1 and k - out[-1][0] < RUN:
            out[-1] = (out[-1][0], k)
        elif out and k == out[-1][1] + 1:
            out.append((k - 1, k))  # goes on from the window before
        else:
            out.append((k, k))
    return out


def tag(net: Tagger, texts: list[str], chunk: int = 256) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) that the network sees in each text."""
    half = STRIDE // 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = [(last - first + 1, i, first) for i, t in enumerate(texts) for first, last in runs_of(t)]
    runs.sort()  # runs of about one length are decoded together
    at = 0
    while at < len(runs):
        end, windows = at, 0
        while end < len(runs) and (end == at or windows + runs[end][0] <= chunk):
            windows += runs[end][0]
            end += 1
        part, at = runs[at:end], end
        x = np.full((WINDOW, windows), 32, np.int64)
        col, codes = 0, {}
        for n, i, first in part:
            if i not in codes:
                codes[i] = encode(texts[i])
            for k in range(first, first + n):
                begin = k * STRIDE - half
                s = codes[i][max(0, begin) : begin + WINDOW]
                x[max(0, -begin) : max(0, -begin) + len(s), col] = s
                col += 1
        e, _ = net.emissions(x)
        length = np.array([(n - 1) * STRIDE + WINDOW for n, _, _ in part])
        mean = np.zeros((length.max(), len(part), LABELS), np.float32)
        weight = np.zeros((length.max(), len(part), 1), np.float32)
        col = 0
        for c, (n, _, _) in enumerate(part):
            for k in range(n):
                place = slice(k * STRIDE, k * STRIDE + WINDOW)
                mean[place, c] += e[:, col] * WEIGHT[:, None]
                weight[place, c] += WEIGHT[:, None]
                col += 1
        y = net.viterbi(mean / np.maximum(weight, 1e-9), length)
        for c, (_, i, first) in enumerate(part):
            out[i] += spans_in(y[: length[c], c], first * STRIDE - half, len(texts[i]))
    return [sorted(set(x), key=lambda v: v[1]) for x in out]


def spans_in(y: np.ndarray, begin: int, n: int) -> list[tuple[int, int, int]]:
    """The spans of a run of labels that starts at character ``begin`` of a text of ``n``."""
    out: list[tuple[int, int, int]] = []
    for p in np.flatnonzero(y).tolist():
        label, at = int(y[p]), begin + p
        if at < 0 or at >= n:
            continue
        if out and out[-1][2] == at and label == 2 + 2 * out[-1][0]:
            out[-1] = (*out[-1][:2], at + 1)
        else:
            out.append(((label - 1) // 2, at, at + 1))
    return out


def valid(t: str, kind: int, a: int, b: int) -> bool:
    """Whether an added span consists of what its kind does and stands on its own."""
    s = t[a:b]
    if (a and t[a - 1].isalnum()) or t[b : b + 1].isalnum():
        return False
    if kind == 0:
        return ADDRESS.fullmatch(s) is not None and not PLAIN.fullmatch(s)
    if kind == 1:
        return OCTETS.fullmatch(s) is not None and all(int(p) <= 255 for p in re.findall("[0-9]+", s))
    d = digits_of(s)
    if not NUMBER.fullmatch(s):
        return False
    return 13 <= len(d) <= 19 and luhn(d) if kind == 2 else 10 <= len(d) <= 15 and len(d) < len(s)


def snap(t: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """An address or a number that was seen in part is taken whole, at most 64 characters each way."""
    whole = (ADDRESS, OCTETS, NUMBER, NUMBER)[kind]
    low, high = max(0, a - 64), min(len(t), b + 64)
    for m in whole.finditer(t, low, high):
        if m.start() < b and a < m.end():
            return m.span()
    return a, b


class Taken:
    """Disjoint ranges of a text, in order."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.ends: list[int] = []
        self.starts: list[int] = []
        for _, a, b in sorted(spans, key=lambda x: x[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Take a range if it is free."""
        k = bisect.bisect_right(self.ends, a)
        if k < len(self.starts) and self.starts[k] < b:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def find(net: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base, added) spans of each text."""
    out = []
    for t, seen in zip(texts, tag(net, texts), strict=True):
        base = base_spans(t)
        taken = Taken(base)
        added = []
        for k, a, b in seen:
            for x, y in ((a, b), snap(t, k, a, b)):  # as it was seen, else whole
                if valid(t, k, x, y) and taken.add(x, y):
                    added.append((k, x, y))
                    break
        out.append((base, added))
    return out


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256, spans and n_added of every document."""
    net = train()
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            data, off = tb.arrow_bytes(batch.column("text"))
            n = batch.num_rows
            dots = np.flatnonzero(pc.match_substring(batch.column("text"), "dot", ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False))
            rows: list[tuple] = [(0, 0, 0, 0, empty, "", 0)] * n
            for i, j in tb.slices(off):
                hot = np.flatnonzero(HOT[data[off[i] : off[j]]]) + off[i]
                which = np.unique(np.concatenate([np.searchsorted(off, hot, "right") - 1, dots[(dots >= i) & (dots < j)]]))
                texts = [data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") for r in which]
                for r, (base, added) in zip(which.tolist(), find(net, texts), strict=True):
                    kinds = [k for k, _, _ in base]
                    digest = hashlib.sha256(_digest(base).encode()).hexdigest()
                    rows[r] = (*(kinds.count(k) for k in range(4)), digest, _digest(base + added), len(added))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds_ = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds_, strict=True))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )
