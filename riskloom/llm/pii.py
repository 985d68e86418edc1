r"""Operator 8, PII: character-level bidirectional LSTM with CRF transitions, in numpy.

Fixed expressions find the base spans.  They miss what is written otherwise (``name at host dot com``, numbers without a plus or with
other separators, dots in brackets) and what runs into a neighbour (a number right before another).  The network is there for these: it
learns from labelled spans, namely base spans of sampled windows and spans planted into sampled contexts in the forms of ``phrase``, among
them decoys such as dates, versions, prices and hashes.  It reads overlapping windows around every digit, at sign and spelt dot of every
text, and over every spelt address or spread number that the check of a kind could pass, so no position that may bear a span goes unread; Viterbi labels and marginals of the windows are reconciled over the whole text.  A span that it adds must be sure (SURE), lie outside
base spans, and pass a check of its kind once rewritten in plain form (``passes``), so clean texts stay as they are.

The sample is bounded: about MOST_DOCUMENTS documents by hash, and of their windows the MOST_WINDOWS with the smallest hashes.  A fitted network is kept
in the shared folder under a hash of its sample and settings, and fitted once.

Defined results: a null text is empty and has no spans; an empty table gives an empty result and an untrained network adds
nothing; repeated rows each get a result; other columns are kept, and those named base_spans or spans are replaced; a very long text is
read whole: its windows are decoded BLOCK at a time, and five bytes a character are held of the outcome.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import by_value
from riskloom.session import shared_dir, table

# Kinds in order, and the base expressions.  A match of IP can only begin where a run of digits begins.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")
TRIGGER = re.compile(r"[0-9]+|@|[\x20(\[{](?i:dot)[\x20)\]}]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Spelt signs, and plain forms of numbers that the network may add.
DIGITS = frozenset("0123456789")
SPELT_AT = re.compile(r"\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?|\x20(?i:at)\x20")
SPELT_DOT = re.compile(r"\x20?[(\[{]\x20?(?:(?i:dot)|\.)\x20?[)\]}]\x20?|\x20(?:(?i:dot)|\.)\x20")
AT = re.compile(rf"@|{SPELT_AT.pattern}")
HOST_PARTS = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{SPELT_DOT.pattern})[A-Za-z0-9-]+)+")
DOT_BEFORE = re.compile(rf"(?:{SPELT_DOT.pattern})\Z")
NUMBERS = re.compile(r"[0-9]+(?:[\x20().-]+[0-9]+)+")  # within them digits may lie any number of signs apart
PLAIN_CARD = re.compile(r"[0-9]+(?:[\x20._/-]{1,2}[0-9]+)*")
PLAIN_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]|00[\x20.-]?[0-9][\x20().0-9-]+[0-9]|(?:1[\x20.-])?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}")

WINDOW, STRIDE, AROUND = 64, 32, 20
MOST_DOCUMENTS, MOST_WINDOWS, PLANTED, BATCH, STEPS, HIDDEN, RATE, SURE = 20_000, 4000, 8000, 96, 500, 16, 0.02, 0.5
BLOCK = 1024  # windows decoded at once

by_value(__name__)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def valid_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def valid_card(text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def valid_phone(text: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", text)) <= 15


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches without going over a run of local characters more than once: each at sign looks back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = list(emails(text)) if "@" in text else []
    if TRIGGER.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if valid_ip(m[0])]
        out += [("card", *m.span()) for m in CARD.finditer(text) if valid_card(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if valid_phone(m[0])]
    return out


# ---- windows ----

# Characters that are a class of their own; 0 pads, then digit, small, capital, white space, other letter, other.
OWN = "@.+-()_%:,/#[]{}"
SPELLING = "atdo"  # letters of spelt signs, in either case
PAD, DIGIT, SMALL, CAPITAL, SPACE, LETTER, OTHER = range(7)
CLASSES = 7 + len(OWN) + len(SPELLING)


def _ascii_classes() -> np.ndarray:
    out = np.full(128, OTHER, np.uint8)
    for c in range(128):
        ch = chr(c)
        out[c] = DIGIT if ch.isdigit() else SMALL if ch.islower() else CAPITAL if ch.isupper() else SPACE if ch.isspace() else OTHER
    for k, ch in enumerate(OWN + SPELLING):
        out[ord(ch)] = out[ord(ch.upper())] = 7 + k
    return out


ASCII = _ascii_classes()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 128, ASCII[np.minimum(codes, 127)], LETTER).astype(np.uint8)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Where plain or spelt addresses may lie: about each at sign, also one that begins inside another, a host with a dot after it and a name before it."""
    m = AT.search(text)
    while m:
        end, a = HOST_PARTS.match(text, m.end()), m.start()
        if end:
            while a:
                if text[a - 1] in LOCAL:
                    a -= 1
                elif before := DOT_BEFORE.search(text, max(a - 9, 0), a):
                    a = before.start()
                else:
                    break
            if a < m.start():
                yield a, end.end()
        m = AT.search(text, m.start() + 1)


def stretches(text: str) -> list[tuple[int, int]]:
    """All places at which a span may lie that ``passes`` lets through, in order: it holds an address, or digits with signs between them."""
    found = [m.span() for m in TRIGGER.finditer(text)]
    found += [m.span() for m in NUMBERS.finditer(text)]
    return sorted(found + list(addresses(text)))


def window_starts(text: str, where: Iterable[tuple[int, int]] | None = None) -> list[int]:
    """Windows of WINDOW, STRIDE apart, that cover AROUND characters about every stretch.  Elsewhere no span can pass, whatever the network says."""
    spans: list[list[int]] = []
    for start, end in stretches(text) if where is None else where:
        a, b = max(start - AROUND, 0), min(end + AROUND, len(text))
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [s for a, b in spans for s in range(a, max(b - STRIDE, a + 1), STRIDE)]


def cut_windows(seq: np.ndarray, starts: list[int]) -> np.ndarray:
    at = np.asarray(starts)[:, None] + np.arange(WINDOW)
    return np.where(at < len(seq), seq[np.minimum(at, len(seq) - 1)], np.uint8(0))


def tags(text: str, spans: list[Span]) -> np.ndarray:
    out = np.zeros(len(text), np.uint8)
    for kind, a, b in reversed(spans):
        out[a:b] = KINDS.index(kind) + 1
    return out


# ---- network ----

LABELS = len(KINDS) + 1


class Tagger:
    """Windows of character classes (n, WINDOW) to labels, 0 for none and 1 to 4 for the kinds.  ``p`` holds all there is to know of
    a fitted one, as plain arrays, and is what goes to executors."""

    def __init__(self, seed: int = 0, hidden: int = HIDDEN, p: dict[str, np.ndarray] | None = None):
        if p is not None:
            self.hidden, self.p = p["h"].shape[1], p
            return
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden = h
        self.p = {
            "out": rng.normal(0, 0.2, (2 * h, LABELS)), "bias": np.zeros(LABELS), "move": np.zeros((LABELS, LABELS)), "first": np.zeros(LABELS),
            "x": rng.normal(0, 0.3, (2, CLASSES, 4 * h)), "h": rng.normal(0, 0.3 / np.sqrt(h), (2, h, 4 * h)), "b": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], h), (2, 1, 1)),
        }

    def hidden_states(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Both directions side by side; gates in order in, forget, out, candidate.  A logistic gate is a hyperbolic tangent of half its input.
        Windows are the last axis, so that a gate of all of them lies together."""
        n, t, k = len(x), x.shape[1], self.hidden
        half = np.repeat([0.5, 1.0], [3 * k, k]).astype(self.p["h"].dtype)
        said, wh = ((self.p["x"] + self.p["b"]) * half).transpose(0, 2, 1), (self.p["h"] * half).transpose(0, 2, 1)
        g = np.empty((t, 2, 4 * k, n), wh.dtype)  # inputs, then gates
        g[:, 0], g[:, 1] = said[0][:, x.T].transpose(1, 0, 2), said[1][:, x.T[::-1]].transpose(1, 0, 2)
        c, tc, out = np.zeros((t + 1, 2, k, n), wh.dtype), np.empty((t, 2, k, n), wh.dtype), np.empty((t, 2, k, n), wh.dtype)
        for i in range(t):
            own = g[i]
            if i:
                own += wh @ out[i - 1]
            np.tanh(own, out=own)
            gates = own[:, : 3 * k]
            gates *= 0.5
            gates += 0.5
            c[i + 1] = own[:, k : 2 * k] * c[i] + own[:, :k] * own[:, 3 * k :]
            np.tanh(c[i + 1], out=tc[i])
            np.multiply(own[:, 2 * k : 3 * k], tc[i], out=out[i])
        if trace is not None:
            trace += [g, c, tc, out]
        return np.concatenate([out[:, 0], out[::-1, 1]], 1).transpose(2, 0, 1)

    def _back(self, x: np.ndarray, trace: list, dh_out: np.ndarray, grad: dict) -> None:
        k, n, t = self.hidden, len(x), x.shape[1]
        (g, c, tc, out), wh = trace, self.p["h"]
        into, every = dh_out.transpose(1, 2, 0), np.empty_like(g)
        into = np.stack([into[:, :k], into[::-1, k:]], 1)
        dc = np.zeros((2, k, n), g.dtype)
        for i in range(t - 1, -1, -1):
            own, d, dh = g[i], every[i], into[i]
            gi, gf, go, u = own[:, :k], own[:, k : 2 * k], own[:, 2 * k : 3 * k], own[:, 3 * k :]
            if i < t - 1:
                dh += wh @ every[i + 1]
                dc *= g[i + 1, :, k : 2 * k]
            held = dh * go
            dc += held * (1 - tc[i] * tc[i])
            np.multiply(held * tc[i], 1 - go, out=d[:, 2 * k : 3 * k])
            np.multiply(dc * c[i], gf * (1 - gf), out=d[:, k : 2 * k])
            held = dc * gi
            np.multiply(held * u, 1 - gi, out=d[:, :k])
            np.multiply(held, 1 - u * u, out=d[:, 3 * k :])
        one = np.eye(CLASSES, dtype=g.dtype)[x.T]  # (t, n, classes)
        grad["x"] = np.stack([(every[:, 0] @ one).sum(0).T, (every[:, 1] @ one[::-1]).sum(0).T])
        grad["h"] = (out[:-1] @ every[1:].transpose(0, 1, 3, 2)).sum(0)
        grad["b"] = every.sum((0, 3))[:, None]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.hidden_states(x) @ self.p["out"] + self.p["bias"]

    def _marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-partition and label marginals of the CRF, and how often each move is expected.  Messages are scaled to a sum of one at each place."""
        (n, t, _), most = s.shape, self.p["move"].max()
        move = np.exp(self.p["move"] - most)
        s = s.transpose(1, 0, 2).copy()
        s[0] += self.p["first"]
        top = s.max(2, keepdims=True)
        e = np.exp(s - top)
        alpha, beta, size = np.empty_like(e), np.ones_like(e), np.empty((t, n, 1), e.dtype)
        for i in range(t):
            own = (alpha[i - 1] @ move) * e[i] if i else e[i]
            size[i] = own.sum(1, keepdims=True)
            np.divide(own, size[i], out=alpha[i])
        e /= size
        for i in range(t - 1, 0, -1):
            e[i] *= beta[i]
            np.matmul(e[i], move.T, out=beta[i - 1])
        pairs = move * (alpha[:-1].reshape(-1, LABELS).T @ e[1:].reshape(-1, LABELS))
        return (np.log(size) + top).sum(0)[:, 0] + most * (t - 1), (alpha * beta).transpose(1, 0, 2), pairs

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of labels y and its gradient."""
        n, t = x.shape
        trace: list = []
        h = self.hidden_states(x, trace)
        s = h @ self.p["out"] + self.p["bias"]
        z, m, pair = self._marginals(s)
        rows, cols = np.arange(n)[:, None], np.arange(t)[None]
        gold = s[rows, cols, y].sum(1) + self.p["first"][y[:, 0]] + self.p["move"][y[:, :-1], y[:, 1:]].sum(1)
        ds = m.copy()
        ds[rows, cols, y] -= 1
        pair -= np.bincount((y[:, :-1] * LABELS + y[:, 1:]).ravel(), minlength=LABELS * LABELS).reshape(LABELS, LABELS).astype(pair.dtype)
        ds /= n
        grad = {"move": pair / n, "first": ds[:, 0].sum(0), "bias": ds.sum((0, 1)), "out": h.reshape(n * t, -1).T @ ds.reshape(n * t, -1)}
        self._back(x, trace, ds @ self.p["out"].T, grad)
        return float((z - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> list[float]:
        """Adam on random batches, in single precision; returns the losses."""
        self.p = {k: w.astype(np.float32) for k, w in self.p.items()}
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in "mv")
        x, y = x.astype(np.int64), y.astype(np.int64)
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, len(x)))
            loss, grad = self.step(x[pick], y[pick])
            losses.append(loss)
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - np.float32(rate * (1 - 0.8 * t / steps)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels and label marginals of every window."""
        s = self.scores(x)
        n, t, _ = s.shape
        best, back = s[:, 0] + self.p["first"], np.zeros((n, t, LABELS), np.int64)
        for i in range(1, t):
            step = best[:, :, None] + self.p["move"]
            back[:, i] = step.argmax(1)
            best = step.max(1) + s[:, i]
        path = np.zeros((n, t), np.int64)
        path[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            path[:, i - 1] = back[np.arange(n), i, path[:, i]]
        return path, self._marginals(s)[1]


#: Weight of a window's say at each of its places: most in the middle.
WEIGHT = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])


class Reconciled:
    """The label of each character of a text from the weighted votes of all windows on it; windows come in order, any number at a time.
    Votes are held only where a later window may still add to them."""

    def __init__(self) -> None:
        self.at = 0  # where the held votes begin
        self.votes = self.sure = np.zeros((0, LABELS))
        self.runs: list[tuple[int, int, int, float, int]] = []  # start, end, label, sum of marginals, characters

    def add(self, starts: list[int], path: np.ndarray, marginal: np.ndarray, following: int | None) -> None:
        """``following`` is the start of the text's next window."""
        low = starts[0] if not len(self.votes) else self.at
        high = max(starts[-1] + WINDOW, low + len(self.votes))
        votes, sure = np.zeros((high - low, LABELS)), np.zeros((high - low, LABELS))
        votes[: len(self.votes)], sure[: len(self.votes)] = self.votes, self.sure
        at = (np.asarray(starts) - low)[:, None] + np.arange(WINDOW)
        np.add.at(votes, (at, path), WEIGHT[None])
        np.add.at(sure, at, marginal * WEIGHT[:, None])
        done = high if following is None or following >= high else following
        n = done - low
        self._settle(low, votes[:n], sure[:n])
        self.at, self.votes, self.sure = done, votes[n:], sure[n:]

    def _settle(self, low: int, votes: np.ndarray, sure: np.ndarray) -> None:
        total = votes.sum(1)
        label = np.where(total > 0, votes.argmax(1), 0)
        own = np.take_along_axis(sure, label[:, None], 1)[:, 0] / np.maximum(total, 1e-9)
        edge = np.flatnonzero(np.diff(label, prepend=-1))
        for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(label)], strict=True):
            if not label[s]:
                continue
            k, score = int(label[s]), float(own[s:e].sum())
            last = self.runs[-1] if self.runs else None
            if last and last[1] == low + s and last[2] == k:
                self.runs[-1] = (last[0], low + e, k, last[3] + score, last[4] + e - s)
            else:
                self.runs.append((low + s, low + e, k, score, e - s))

    def spans(self, size: int) -> list[tuple[str, int, int, float]]:
        return [(KINDS[k - 1], a, min(b, size), score / n) for a, b, k, score, n in self.runs if a < size]


def plain(kind: str, text: str) -> str:
    """The text with spelt signs as signs."""
    if kind == "email":
        return SPELT_DOT.sub(".", SPELT_AT.sub("@", text))
    return SPELT_DOT.sub(".", text) if kind == "ip" else text


def passes(kind: str, text: str) -> bool:
    text = plain(kind, text)
    if kind == "email":
        return EMAIL.fullmatch(text) is not None
    if kind == "ip":
        return valid_ip(text)
    if kind == "card":
        return PLAIN_CARD.fullmatch(text) is not None and valid_card(text)
    return PLAIN_PHONE.fullmatch(text) is not None and valid_phone(text)


EDGE = " \t\r\n,;:!?\"'<>"


HOST = LOCAL - frozenset("._%+")


def snapped(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span widened to whole words or numbers."""
    before, after = (LOCAL, HOST) if kind == "email" else (DIGITS, DIGITS)
    if b > a and text[a] in before:
        while a and text[a - 1] in before:
            a -= 1
    if b > a and text[b - 1] in after:
        while b < len(text) and text[b] in after:
            b += 1
    return a, b


def further(text: str, base: list[Span], found: list[tuple[str, int, int, float]]) -> list[Span]:
    """The network's spans that are sure, pass the check of their kind and lie outside base spans."""
    if not found:
        return []
    ordered = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in ordered]
    reach = np.maximum.accumulate([b for _, b in ordered]).tolist() if ordered else []
    out = []
    for kind, a, b, sure in found:
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip(EDGE)), b - len(piece) + len(piece.rstrip(EDGE + "."))
        a, b = snapped(kind, text, a, b)
        k = bisect_left(starts, b)
        if sure >= SURE and b > a and passes(kind, text[a:b]) and not (k and reach[k - 1] > a):
            out.append((kind, a, b))
    return out


def detect_batch(texts: list[str | None], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and the network's further spans of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    waiting: list[tuple[int, list[int], np.ndarray, int | None, Reconciled]] = []  # text, starts, windows, next start
    held = 0

    def flush() -> None:
        nonlocal held
        if not waiting:
            return
        path, marginal = tagger.decode(np.concatenate([w for _, _, w, _, _ in waiting]).astype(np.int64))
        at = 0
        for k, starts, _, following, votes in waiting:
            own = slice(at, at + len(starts))
            at += len(starts)
            votes.add(starts, path[own], marginal[own], following)
            if following is None:
                more[k] = further(texts[k], base[k], votes.spans(len(texts[k])))
        waiting.clear()
        held = 0

    for k, text in enumerate(texts):
        starts = window_starts(text) if tagger is not None and text else []
        if not starts:
            continue
        seq, votes, i = classes(text), Reconciled(), 0
        while i < len(starts):
            some = starts[i : i + BLOCK - held]
            i += len(some)
            held += len(some)
            waiting.append((k, some, cut_windows(seq, some), starts[i] if i < len(starts) else None, votes))
            if held >= BLOCK:
                flush()
    flush()
    return list(zip(base, more, strict=True))


# ---- labelled spans ----


def phrase(rng: np.random.Generator, kind: str) -> str:
    """A made-up value of the kind, in plain or other writing."""
    pick = lambda *forms: forms[rng.integers(len(forms))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 9))))
    if kind == "email":
        name = word() + pick("", "", pick(".", "_", "-") + word(), digits(2))
        host, end = word() + pick("", "", digits(1), "." + word()), pick("com", "org", "net", "de", "fr", "co")
        if rng.random() < 0.4:
            return f"{name}@{host}.{end}"
        at, dot = pick((" at ", " dot "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" AT ", " DOT "), ("@", " dot "), ("@", "[.]"), ("{at}", "{dot}"))
        return name.replace(".", "_") + at + host.replace(".", "") + dot + end
    if kind == "ip":
        return pick(".", ".", "[.]", "(.)", " . ", "[dot]", " dot ").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == "card":
        n = pick(16, 16, 16, 15, 13, 19)
        body = pick("4", "5", "37", "6") + digits(n)
        body = body[: n - 1]
        last = next(d for d in "0123456789" if luhn(body + d))
        form, number = pick("", "", " ", "-", ".", "_", "/", "  "), body + last
        return form.join(number[i : i + 4] for i in range(0, n, 4))
    area, a, b = digits(3), digits(3), digits(4)
    form = pick("+1 ({}) {}-{}", "+1 {} {} {}", "+44{}{}{}", "({}) {}-{}", "({}) {} {}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "1-{}-{}-{}", "00 33 {} {} {}", "0049 {} {}{}", "1 ({}) {}-{}")
    return form.format(area, a, b)


def decoy(rng: np.random.Generator) -> str:
    """Digits and spelt signs that are no personal data."""
    n = lambda a, b: int(rng.integers(a, b))
    forms = (
        lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", lambda: f"{n(1, 29)}/{n(1, 13)}/{n(10, 99)}", lambda: f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}",
        lambda: f"version {n(0, 20)}.{n(0, 30)}", lambda: f"v{n(0, 20)}.{n(0, 30)}.{n(0, 90)}", lambda: f"{n(1, 99)},{n(100, 999)},{n(100, 999)}.{n(10, 99)}", lambda: f"{n(1900, 2030)}-{n(1900, 2030)}",
        lambda: f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", lambda: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40)), lambda: f"#{n(1000, 99999999)}", lambda: f"{n(1, 500)} x {n(1, 500)} x {n(1, 500)}",
        lambda: f"at {n(1, 13)} pm", lambda: "look at the dot there", lambda: "at noon", lambda: f"page {n(1, 900)} of {n(1, 900)}", lambda: "a red dot at the end", lambda: f"{n(1, 10**9)}",
    )
    return forms[rng.integers(len(forms))]()


def planted(contexts: list[str], n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """``n`` texts: a context into which one value, two neighbours or a decoy are put, with their spans."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        context = contexts[rng.integers(len(contexts))]
        gaps = [m.start() for m in re.finditer(r"\s", context)] or [len(context)]
        cut = gaps[rng.integers(len(gaps))]
        text, spans = context[:cut] + " ", []
        u = rng.random()
        for j in range(0 if u < 0.25 else 1 if u < 0.8 else 2):
            kind = KINDS[rng.integers(len(KINDS))]
            value = phrase(rng, kind)
            text += (" " if j else "") + value
            spans.append((kind, len(text) - len(value), len(text)))
        if not spans or rng.random() < 0.15:
            text += (" " if spans else "") + decoy(rng)
        out.append((text + context[cut:], spans))
    return out


def shaped(text: str) -> list[Span]:
    """Base spans, and bare runs of 13 to 19 digits whatever their check digit, which a network cannot tell."""
    runs = [("card", *m.span()) for m in re.finditer(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])", text)]
    return base_spans(text) + runs


def sampled_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to windows: those around triggers with their tags, and one stretch of the text for planting, without."""
    for frame in frames:
        rows = []
        for text in frame["text"]:
            at = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) % max(len(text) - WINDOW, 1)
            rows.append((text[at : at + WINDOW], None))
            starts = window_starts(text, (m.span() for m in TRIGGER.finditer(text)))
            if starts:
                y = cut_windows(tags(text, shaped(text)), starts)
                rows += [(text[s : s + WINDOW], b.tobytes()) for s, b in zip(starts, y, strict=True)]
        h = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass") + (y or b"")) >> 1 for t, y in rows]
        yield pd.DataFrame({"h": h, "piece": [t for t, _ in rows], "y": [y for _, y in rows]}, columns=["h", "piece", "y"])


def windows_of(texts: list[tuple[str, list[Span]]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One window of each text, about its first span or anywhere."""
    rng, x, y = np.random.default_rng(seed), [], []
    for text, spans in texts:
        first = spans[0][1] if spans else int(rng.integers(0, len(text)))
        start = [max(0, first - int(rng.integers(0, AROUND + STRIDE)))]
        x.append(cut_windows(classes(text), start))
        y.append(cut_windows(tags(text, spans), start))
    return np.concatenate(x), np.concatenate(y)


def train(docs: DataFrame, most: int = MOST_WINDOWS, documents: int = MOST_DOCUMENTS) -> Tagger | None:
    """Fits on at most ``most`` windows of about ``documents`` of ``docs`` and on PLANTED texts made from them; None if there are none.
    Whatever the input, tasks send no more windows than those documents have."""
    share = min(1.0, documents / max(docs.count(), 1))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    some = docs.where((place < int(share * (1 << 40))) & (F.length("text") > 0)).select("text")
    some = some.mapInPandas(sampled_windows, "h long, piece string, y binary")
    rows = some.orderBy("h", "piece", "y").limit(most).toPandas()
    if not len(rows):
        return None
    settings = (WINDOW, STRIDE, AROUND, PLANTED, BATCH, STEPS, HIDDEN, RATE, KINDS, OWN, SPELLING)
    return kept_model(docs.sparkSession, [settings, *rows.itertuples(index=False, name=None)], lambda: _fitted(rows))


def kept_model(spark: SparkSession, given: list, fit: Callable[[], Tagger]) -> Tagger:
    """A model fitted on just this sample under these settings: from the shared folder if it is there, else fitted and put there."""
    path = f"{shared_dir(spark)}/pii-models/{hashlib.sha256(repr(given).encode('utf-8', 'surrogatepass')).hexdigest()}"
    try:
        found = spark.read.schema("name string, kind string, shape array<int>, content binary").parquet(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if found:
        return Tagger(p={r.name: np.frombuffer(bytes(r.content), r.kind).reshape(r.shape) for r in found})
    tagger = fit()
    rows = [(k, w.dtype.str, list(w.shape), bytearray(w.tobytes())) for k, w in tagger.p.items()]
    spark.createDataFrame(rows, "name string, kind string, shape array<int>, content binary").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return tagger


def _fitted(rows: pd.DataFrame) -> Tagger:
    known = rows["y"].notna()
    contexts = rows["piece"][~known].tolist() or rows["piece"].tolist()
    x, y = windows_of(planted(contexts, PLANTED, 1), 2)
    if known.any():
        x = np.concatenate([x, *[cut_windows(classes(t), [0]) for t in rows["piece"][known]]])
        y = np.concatenate([y, np.frombuffer(b"".join(map(bytes, rows["y"][known])), np.uint8).reshape(-1, WINDOW)])
    tagger = Tagger()
    tagger.fit(x, y)
    return tagger


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _spread(docs: DataFrame, tagger: Tagger | None):
    """A function of no arguments that gives the network on an executor; plain arrays are sent, so it needs no copy of the package."""
    shared = docs.sparkSession.sparkContext.broadcast(None if tagger is None else tagger.p)
    return lambda: None if shared.value is None else Tagger(p=shared.value)


def detect(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with base_spans and spans, as kind:start:end in order, comma-joined."""
    network = _spread(docs, tagger)

    @F.pandas_udf("struct<base_spans string, spans string>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = network()
        for part in texts:
            found = detect_batch(part.tolist(), own)
            yield pd.DataFrame({"base_spans": [written(b) for b, _ in found], "spans": [written(b + m) for b, m in found]})

    row = docs.select(F.struct(*[F.col(c) for c in docs.columns if c not in ("base_spans", "spans")]).alias("row"), find("text").alias("found"))
    return row.select("row.*", "found.base_spans", "found.spans")


def redact(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with every span of their texts replaced by its kind in brackets; overlapping spans become one."""
    network = _spread(docs, tagger)

    @F.pandas_udf("string")
    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = network()
        for part in texts:
            own = part.tolist()
            out = []
            for text, (base, more) in zip(own, detect_batch(own, net), strict=True):
                pieces, done = [], 0
                for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
                    if a >= done:
                        pieces += [text[done:a], f"[{kind.upper()}]"]
                    done = max(done, b)
                out.append(text if not pieces else "".join(pieces) + text[done:])
            yield pd.Series(out, dtype=object)

    return docs.withColumn("text", masked("text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, train(docs))

    def starts(column: str, with_: str) -> Column:
        """How many of the spans written in a column begin with a text."""
        return F.size(F.filter(F.split(column, ","), lambda s: (s != "") & s.startswith(with_))).cast("long")

    counts = [starts("base_spans", f"{k}:").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans", starts("spans", "").alias("n_spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLE_SQL: dict[str, str] = {}
