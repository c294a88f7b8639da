"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside fixed patterns.

The base spans are those of the patterns below, kept as they are. The model reads windows of WINDOW characters, STRIDE
apart, and labels characters as outside, or as first or inner character of an email, ip, card or phone. It is trained in
numpy, by backpropagation through the CRF's likelihood, from labelled spans: windows of a bounded sample of the corpus with
their base spans, and made-up windows whose spans also have spellings that the patterns miss (phones without `+`, addresses
without a dot or with blanks around `@`) and look-alikes that are none (versions, years, prices, keys).

Every span of the model has a digit or an `@`. A window without either can't hold one, so only the others are decoded:
nothing is lost by that. The windows' spans are reconciled over the text: pieces of one kind that overlap are joined, a piece
cut off at a window's edge gives way to what a neighbouring window saw whole, spans that fail their kind's check are dropped,
and where kinds compete the higher score wins. A model span that touches a base span is dropped in its favour.

Defined cases: a null text counts as empty, with no spans; equal texts get equal spans; offsets are code points, ends
exclusive; the counts n_email to n_phone and base_sha256 are those of the base spans, n_added those the model adds. Other
columns are not looked at, and texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.llm.common import bounded, bounded_batches, decode, hash_sample, scored, splitmix, utf8

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- base patterns

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of local@domain: each starts where the run of local characters before its @ does."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)
    return out


def addresses(text: str) -> list[Span]:
    """Of a chain of numbers joined by dots, each four in turn are a match, the fourth part taking all its digits."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        out += addresses(text) + cards(text) + phones(text)
    return in_order(out)


# ---------------------------------------------------------------- model

WINDOW, STRIDE = 64, 32
EMBED, HIDDEN = 12, 16
TAGS = 1 + 2 * len(KINDS)
CLASSES = 131  #: ASCII, other letters, other characters, padding
PAD = 130
#: Bounds of the fit: documents of the corpus sample, none longer than so many characters, windows of one document, of the
#: corpus, and made up.
TRAIN_DOCS, TRAIN_CHARS, DOC_WINDOWS, CORPUS_WINDOWS, MADE_WINDOWS = 1500, 100_000, 8, 2500, 2500
EPOCHS, BATCH, RATE = 12, 125, 0.01
DECODE_BATCH = 512


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.size == 0 or codes.max() < 128:
        return codes.astype(np.int16)
    out = np.minimum(codes, 129).astype(np.int16)
    high = np.flatnonzero(codes >= 128)
    kinds, which = np.unique(codes[high], return_inverse=True)
    out[high] = np.array([128 if chr(c).isalpha() else 129 for c in kinds.tolist()], np.int16)[which]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x: (steps, rows, EMBED). Hidden states (steps, rows, HIDDEN), and what the backward pass needs."""
    n = x.shape[1]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((len(x), n, HIDDEN), np.float32), []
    zx = x @ wx + b
    for t in range(len(x)):
        z = zx[t] + h @ wh
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out, kept


def _lstm_back(x: np.ndarray, dh_all: np.ndarray, kept: list, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
    dwh = np.zeros_like(wh)
    dz = np.empty((len(x), x.shape[1], 4 * HIDDEN), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, g, tc = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        dwh += h.T @ dz[t]
        dh, dc = dz[t] @ wh.T, dc * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0), dz @ wx.T


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def emissions(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """codes: (rows, steps). Tag scores (steps, rows, TAGS)."""
        w = self.weights
        x = w["embed"][codes.T]
        left, kl = _lstm(x, w["wx0"], w["wh0"], w["b0"], keep)
        right, kr = _lstm(x[::-1], w["wx1"], w["wh1"], w["b1"], keep)
        both = np.concatenate((left, right[::-1]), axis=2)
        return both @ w["out"] + w["bias"], (x, both, kl, kr)

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (rows, steps) by Viterbi, and how much each beats `outside` at its place."""
        e, _ = self.emissions(codes)
        trans = self.weights["trans"]
        steps, rows, _ = e.shape
        back = np.empty((steps, rows, TAGS), np.int8)
        score = e[0] + self.weights["start"]
        for t in range(1, steps):
            both = score[:, :, None] + trans
            back[t] = both.argmax(axis=1)
            score = np.take_along_axis(both, back[t].astype(np.int64)[:, None, :], axis=1)[:, 0] + e[t]
        tags = np.empty((steps, rows), np.int64)
        tags[-1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None], axis=1)[:, 0]
        margin = np.take_along_axis(e, tags[:, :, None], axis=2)[:, :, 0] - e[:, :, 0]
        return tags.T, margin.T

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log likelihood of the gold tags (rows, steps), and its gradients."""
        w = self.weights
        e, (x, both, kl, kr) = self.emissions(codes, keep=True)
        e = e.astype(np.float64)
        gold = gold.T
        steps, rows, _ = e.shape
        trans = w["trans"].astype(np.float64)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + w["start"]
        for t in range(1, steps):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = _lse(alpha[-1], 1)
        de = np.exp(alpha + beta - log_z[:, None])
        dtrans = np.zeros_like(trans)
        for t in range(1, steps):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t] - log_z[:, None])[:, None, :]).sum(axis=0)
        dstart = de[0].sum(axis=0)
        t_at, r_at = np.meshgrid(np.arange(steps), np.arange(rows), indexing="ij")
        path = e[t_at, r_at, gold].sum() + trans[gold[:-1], gold[1:]].sum() + w["start"][gold[0]].sum()
        np.subtract.at(de, (t_at, r_at, gold), 1.0)
        np.subtract.at(dtrans, (gold[:-1], gold[1:]), 1.0)
        np.subtract.at(dstart, gold[0], 1.0)
        de = (de / rows).astype(np.float32)
        g = {"trans": dtrans / rows, "start": dstart / rows, "out": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "bias": de.sum(axis=(0, 1))}
        dboth = de @ w["out"].T
        g["wx0"], g["wh0"], g["b0"], dx = _lstm_back(x, dboth[:, :, :HIDDEN], kl, w["wx0"], w["wh0"])
        g["wx1"], g["wh1"], g["b1"], dr = _lstm_back(x[::-1], dboth[::-1, :, HIDDEN:], kr, w["wx1"], w["wh1"])
        dx = dx + dr[::-1]
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], codes.T, dx)
        return float((log_z.sum() - path) / rows), g


def new_model(seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1.0  # gates that remember at first
    w = {"embed": draw(CLASSES, EMBED) * 3, "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
    for d in "01":
        w |= {f"wx{d}": draw(EMBED, 4 * HIDDEN), f"wh{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": bias.copy()}
    for k in range(len(KINDS)):  # an inner tag follows only its own kind
        inner = 2 + 2 * k
        w["trans"][:, inner] = -8.0
        w["start"][inner] = -1.0
        w["trans"][[inner - 1, inner], inner] = 1.0
    return Model(w)


def tags_of(spans: list[Span], start: int) -> np.ndarray:
    """Tags of the window that starts at a place; a span that began before it goes on as inner."""
    out = np.zeros(WINDOW, np.int64)
    for kind, s, e in spans:
        a, b = max(s, start) - start, min(e, start + WINDOW) - start
        if a < b:
            k = KINDS.index(kind)
            out[a:b] = 2 + 2 * k
            if s >= start:
                out[a] = 1 + 2 * k
    return out


def _choose(rng: np.random.Generator, *options: str) -> str:
    return options[int(rng.integers(len(options)))]


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng: np.random.Generator, most: int = 9) -> str:
    return "".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(rng.integers(2, most))))


def _made(rng: np.random.Generator, kind: str) -> str:
    if kind == "email":
        local = _word(rng) + _choose(rng, "", ".", "_") + _choose(rng, _word(rng, 5), _digits(rng, 2))
        return local + _choose(rng, "@", "@", "@", " @ ") + _word(rng) + _choose(rng, "", _digits(rng, 1)) + _choose(rng, "", ".example", ".mail") + _choose(rng, ".com", ".org", ".net", ".de", "")
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(1, 256, 4))
    if kind == "card":
        d = _choose(rng, "4", "5", "37", "6011")
        d += _digits(rng, 15 - len(d))
        d += next(c for c in "0123456789" if luhn(d + c))
        return _choose(rng, d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return _choose(rng, f"+1 ({a}) {b}-{c}", f"+{_digits(rng, 2)} {a} {b}{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+1.{a}.{b}.{c}")


def _lookalike(rng: np.random.Generator) -> str:
    return _choose(rng, f"version {_digits(rng, 1)}.{_digits(rng, 1)}", f"v{_digits(rng, 1)}.{_digits(rng, 2)}.{_digits(rng, 1)}", "19" + _digits(rng, 2), f"{_digits(rng, 2)}.{_digits(rng, 2)}", f"${_digits(rng, 3)}", f"key{_digits(rng, 6)}{_word(rng)}{_digits(rng, 4)}", f"{_digits(rng, 4)}-{_digits(rng, 2)}-{_digits(rng, 2)}", "@" + _word(rng), _digits(rng, int(rng.integers(1, 9))), f"{_word(rng)}{_digits(rng, 1)}", f"AKIA{_digits(rng, 8)}", f"{_digits(rng, 1)}.{_digits(rng, 1)}.{_digits(rng, 1)}")


def made_windows(count: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        text, spans = "", []
        while len(text) < WINDOW:
            part = rng.random()
            if part < 0.2:
                kind = _choose(rng, *KINDS)
                s = _made(rng, kind)
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = _lookalike(rng) if part < 0.35 else _word(rng)
            text += s + _choose(rng, " ", " ", " ", ", ", ". ", "\n")
        shift = int(rng.integers(0, len(text) - WINDOW + 1))
        out.append((text[shift : shift + WINDOW], [(k, s - shift, e - shift) for k, s, e in spans]))
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @."""
    cells = {m.start() // STRIDE for m in TRIGGER.finditer(text)}
    return [c * STRIDE for c in sorted(cells | {c - 1 for c in cells if c})]


def padded_codes(text: str) -> np.ndarray:
    return np.concatenate((encode(text), np.full(WINDOW, PAD, np.int16)))


def window_codes(text: str, starts: list[int]) -> np.ndarray:
    return padded_codes(text)[np.asarray(starts)[:, None] + np.arange(WINDOW)]


def training_windows(texts: list[str]) -> list[tuple[int, int]]:
    """Text number and start of the windows to learn from: DOC_WINDOWS of each text and CORPUS_WINDOWS of all, that hash lowest."""
    found: list[tuple[int, int, int]] = []
    for n, text in enumerate(texts):
        starts = np.asarray(window_starts(text), np.uint64)
        with np.errstate(over="ignore"):
            h = splitmix(starts * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(text.encode("utf-8", "replace"))) * np.uint64(0xD6E8FEB86659FD93))
        found += [(int(h[i]), n, int(starts[i])) for i in np.argsort(h, kind="stable")[:DOC_WINDOWS].tolist()]
    return sorted((n, start) for _, n, start in sorted(found)[:CORPUS_WINDOWS])


def fit(texts: list[str]) -> Model:
    """Trains on windows of the sample with their base spans and on the made-up windows."""
    codes, gold = [], []
    spans: list[Span] = []
    last = -1
    for n, start in training_windows(texts):
        if n != last:
            last, spans = n, base_spans(texts[n])
        codes.append(window_codes(texts[n], [start])[0])
        gold.append(tags_of(spans, start))
    for text, spans in made_windows(MADE_WINDOWS):
        codes.append(window_codes(text, [0])[0])
        gold.append(tags_of(spans, 0))
    x, y = np.stack(codes), np.stack(gold)
    model, rng = new_model(), np.random.default_rng(5)
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(w) for k, w in model.weights.items()}
    step, total = 0, EPOCHS * -(-len(x) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            _, g = model.gradients(x[rows], y[rows])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            for k, a in g.items():
                a = (a * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                model.weights[k] -= np.float32(RATE * (1 - 0.9 * step / total)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + np.float32(1e-6))
    return model


# ---------------------------------------------------------------- reconciliation


def plausible(kind: str, s: str) -> bool:
    digits = len(only_digits(s))
    if kind == "email":
        return s.count("@") == 1 and len(s) >= 5 and s[0] != "@" and s[-1] != "@"
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= digits <= 19 and luhn(only_digits(s)) and set(s) <= set("0123456789 -")
    return 10 <= digits <= 15 and set(s) <= set("0123456789 ()+.-") and s[-1] in "0123456789"


def spans_of_window(tags: np.ndarray, margin: np.ndarray, start: int, size: int) -> list[tuple[str, int, int, float, bool]]:
    """Kind, start, end, score, and whether a window edge inside the text cuts it."""
    out, at = [], 0
    while at < WINDOW:
        if tags[at] == 0:
            at += 1
            continue
        k = (int(tags[at]) - 1) // 2
        end = at + 1
        while end < WINDOW and tags[end] == 2 + 2 * k:
            end += 1
        cut = (at == 0 and start > 0) or (end == WINDOW and start + WINDOW < size)
        if start + at < size:
            out.append((KINDS[k], start + at, min(size, start + end), float(margin[at:end].sum()), cut))
        at = end
    return out


def reconcile(pieces: list[tuple[str, int, int, float, bool]], text: str, base: list[Span]) -> list[Span]:
    """The model's spans over the whole text, none touching a base span or one another."""
    joined: list[list] = []
    whole = {(k, s, e) for k, s, e, _, cut in pieces if not cut}
    for k, s, e, score, cut in sorted(pieces, key=lambda p: (p[0], p[1], p[2])):
        if cut and any(k == a and b <= s and e <= c for a, b, c in whole):
            continue  # a neighbouring window saw all of it
        if joined and joined[-1][0] == k and s < joined[-1][2]:
            joined[-1][2] = max(e, joined[-1][2])
            joined[-1][3] = max(score, joined[-1][3])
        else:
            joined.append([k, s, e, score])
    free: list[Span] = []
    for k, s, e, _ in sorted(joined, key=lambda p: (-p[3], p[1], p[0])):
        while s < e and text[s].isspace():
            s += 1
        while s < e and (text[e - 1].isspace() or text[e - 1] in ",;:"):
            e -= 1
        if e <= s or not plausible(k, text[s:e]):
            continue
        if all(e <= a or b <= s for _, a, b in base) and all(e <= a or b <= s for _, a, b in free):
            free.append((k, s, e))
    return free


def all_spans(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    base = [base_spans(t) for t in texts]
    pieces: list[list] = [[] for _ in texts]
    held: list[np.ndarray] = []
    places: list[tuple[int, int]] = []

    def flush() -> None:
        tags, margin = model.decode(np.concatenate(held))
        for i in np.flatnonzero(tags.any(axis=1)).tolist():
            n, s = places[i]
            pieces[n] += spans_of_window(tags[i], margin[i], s, len(texts[n]))
        held.clear()
        places.clear()

    for n, text in enumerate(texts):
        starts = window_starts(text)
        if not starts:
            continue
        codes = padded_codes(text)  # once a text, however many windows it has
        while starts:
            part, starts = starts[: DECODE_BATCH - len(places)], starts[DECODE_BATCH - len(places) :]
            held.append(codes[np.asarray(part)[:, None] + np.arange(WINDOW)])
            places += [(n, s) for s in part]
            if len(places) == DECODE_BATCH:
                flush()
    if places:
        flush()
    return [(b, reconcile(p, t, b) if p else []) for b, p, t in zip(base, pieces, texts, strict=True)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in in_order(spans))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for k, s, e in in_order(spans):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(e, merged[-1][2])
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def train(docs: DataFrame) -> Model:
    """Fits on a bounded sample: about TRAIN_DOCS of the distinct texts with a digit or @ of at most TRAIN_CHARS characters."""
    rows = hash_sample(docs.select("text").where(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= TRAIN_CHARS)), "text", TRAIN_DOCS)
    return fit(sorted(r["text"] for r in bounded(rows.distinct(), 2 * TRAIN_DOCS).collect()))


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def found_spans(docs: DataFrame, model: Model | None = None) -> Column:
    """A struct column of counts, digest and spans for the text column of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for base, added in all_spans([decode(t) for t in texts], shared.value):
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            out.append((*counts, len(added), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added)))
        return pd.DataFrame(out, columns=names)

    return scored(FIELDS, run)(utf8(F.col("text")))


def query(docs: DataFrame) -> DataFrame:
    found = found_spans(docs)
    return docs.select("doc_id", found.alias("_p")).select("doc_id", "_p.*")


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with all spans replaced in text, and n_chars following; null texts stay null."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))

    def run(texts: pd.Series) -> pd.Series:
        plain = [decode(t) for t in texts]
        return pd.Series([redact(t, b + a) for t, (b, a) in zip(plain, all_spans(plain, shared.value), strict=True)], dtype=object)

    text = F.when(F.col("text").isNotNull(), scored("string", run)(utf8(F.col("text"))))
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
