"""Personal data: fixed base forms, and a character model that adds spans.

The model is a bidirectional LSTM over characters with CRF transitions between the tags, written and trained in numpy.
Its labelled spans are made with their texts: addresses, cards and phone numbers in the base forms and in spellings that
those miss (spelled-out or bracketed signs, blanks around signs, doubled blanks, 00 for +, numbers run together), and
look-alikes that are none, set into stretches of text of a bounded sample of documents (TRAIN_DOCS rows chosen by the
hash of their id, TRAIN_CHARS characters of each).

Windows of WINDOW characters are laid over all of every text, STEP apart. Where two overlap, each gives way to the
other evenly over the overlap. The best tags of a whole text follow from that: a place whose lead for "no data" is
larger than all that any transitions could win back has that tag in the best path of the whole text for certain, so
Viterbi passes over the stretches between such places give the tags of one pass over everything. Proposed spans are
completed to whole words and checked by the form and rules of their kind (signs, digits, Luhn, parts up to 255, and
numbers in rows of the same gap that end where data of the kind does, so that tables and logs hold none); those
that touch no other span are added.

Defined cases: null text is empty and has no spans; texts may be of any length (the network runs over a bounded number
of windows at a time, and only stretches not yet certain are carried on); equal rows get equal spans; an empty table
gives an empty result, and documents without any usable text leave the model with made-up texts alone; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

KINDS = ("email", "ip", "card", "phone")
TAGS = len(KINDS) + 1
#: Training: documents sampled and characters of each, windows and their length, steps, batch.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WINDOWS, TRAIN_LENGTH, STEPS, BATCH = 1000, 1200, 18000, 80, 1800, 48
#: Model: hidden units, embedding. Decoding: window, step, windows given to the network at once.
HIDDEN, EMBED, WINDOW, STEP, BLOCK = 12, 10, 256, 224, 1024

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base forms, by start, then kind."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            after = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(_is_byte(p) for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out)


_SIGNS = "@.-+()[]{}<>%_ \n:/#|,;\"'=*&!?$"
#: Classes: the signs, letters without case, zero, other digits, other ASCII, all else, and what is outside of texts.
N_CLASS = len(_SIGNS) + 26 + 5
PAD = N_CLASS - 1
_TABLE = np.full(129, len(_SIGNS) + 28, np.uint8)
_TABLE[128] += 1
for _k, _c in enumerate(_SIGNS):
    _TABLE[ord(_c)] = _k
_TABLE[97:123] = _TABLE[65:91] = np.arange(26) + len(_SIGNS)
_TABLE[48], _TABLE[49:58] = len(_SIGNS) + 26, len(_SIGNS) + 27


def classes_of(text: str) -> np.ndarray:
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


class Tagger:
    """Embedding, two LSTM directions, tag emissions and CRF transitions."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        tags = TAGS
        shape = {"embed": (N_CLASS, EMBED), "out": (2 * HIDDEN, tags), "bias": (tags,), "trans": (tags, tags)}
        shape |= {f"{d}_{p}": s for d in "fb" for p, s in (("x", (EMBED, 4 * HIDDEN)), ("h", (HIDDEN, 4 * HIDDEN)), ("c", (4 * HIDDEN,)))}
        self.p = {k: (rng.normal(0, 0.3, s) if len(s) > 1 and k != "trans" else np.zeros(s)).astype(np.float32) for k, s in sorted(shape.items())}
        for d in "fb":
            self.p[f"{d}_c"][HIDDEN : 2 * HIDDEN] = 1.0

    def _lstm(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """x: time x batch x embed -> time x batch x hidden; keep gathers what the way back needs."""
        p, steps, size = self.p, x.shape[0], x.shape[1]
        h = c = np.zeros((size, HIDDEN), np.float32)
        wide = x @ p[f"{d}_x"] + p[f"{d}_c"]
        out = np.empty((steps, size, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wide[t] + h @ p[f"{d}_h"]
            gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, tc, h_before))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: time x batch classes -> time x batch x tags. Both directions run side by side, units by batch, so that
        every operation is over rows of the whole batch. Sigmoids are (1 + tanh of half) / 2; of their halves one
        goes to the memory, the other to the weights that read the state."""
        p, (steps, size), x = self.p, x.shape, x.astype(np.intp)
        half = np.concatenate((np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN))).astype(np.float32)
        given = [np.ascontiguousarray(((p["embed"] @ p[f"{d}_x"] + p[f"{d}_c"]) * half).T) for d in "fb"]
        again = np.stack([np.ascontiguousarray((p[f"{d}_h"] * half / 2).T) for d in "fb"])
        ways = np.stack([np.ascontiguousarray(w.T) / 2 for w in (p["out"][:HIDDEN], p["out"][HIDDEN:])])
        h, c, put = (np.zeros((2, HIDDEN, size), np.float32) for _ in range(3))
        z, wide = np.empty((2, 4 * HIDDEN, size), np.float32), np.empty((2, 4 * HIDDEN, size), np.float32)
        out = np.zeros((steps, TAGS, size), np.float32) + p["bias"][:, None]
        for t in range(steps):
            np.matmul(again, h, out=z)
            np.take(given[0], x[t], axis=1, out=wide[0], mode="clip")
            np.take(given[1], x[steps - 1 - t], axis=1, out=wide[1], mode="clip")
            z += wide
            np.tanh(z, out=z)
            z[:, : 3 * HIDDEN] += 1
            np.multiply(z[:, :HIDDEN], z[:, 3 * HIDDEN :], out=put)
            c *= z[:, HIDDEN : 2 * HIDDEN]
            c += put
            c *= 0.5
            np.tanh(c, out=h)
            h *= z[:, 2 * HIDDEN : 3 * HIDDEN]
            said = np.matmul(ways, h)
            out[t] += said[0]
            out[steps - 1 - t] += said[1]
        return out.transpose(0, 2, 1)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences, and its gradient."""
        p, (size, steps) = self.p, x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        e = p["embed"][x.T]
        h = np.concatenate((self._lstm(e, "f", kept["f"]), self._lstm(e, "b", kept["b"])), 2)
        emit = h @ p["out"] + p["bias"]
        yt, rows, trans = y.T, np.arange(size), p["trans"]
        tags = emit.shape[2]

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, steps):
            alpha[t] = emit[t] + lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        gold = emit[np.arange(steps)[:, None], rows, yt].sum(0) + trans[yt[:-1], yt[1:]].sum(0)
        d_emit = np.exp(alpha + beta - total[None, :, None])
        d_emit[np.arange(steps)[:, None], rows, yt] -= 1
        both = alpha[:-1, :, :, None] + trans + (emit[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]
        d_trans = np.exp(both).sum((0, 1))
        np.add.at(d_trans, (yt[:-1].ravel(), yt[1:].ravel()), -1)
        d_emit /= size
        grad = {"trans": d_trans / size, "bias": d_emit.sum((0, 1)), "out": h.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, tags)}
        d_h = d_emit @ p["out"].T
        d_e = np.zeros_like(e)
        for d, part in (("f", d_h[:, :, :HIDDEN]), ("b", d_h[:, :, HIDDEN:])):
            dh = dc = np.zeros((size, HIDDEN), np.float32)
            g_x, g_h, g_c = (np.zeros_like(p[f"{d}_{k}"]) for k in "xhc")
            for t, i, f, o, g, before, tc, h_before in reversed(kept[d]):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                z = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
                g_x += e[t].T @ z
                g_h += h_before.T @ z
                g_c += z.sum(0)
                d_e[t] += z @ p[f"{d}_x"].T
                dh, dc = z @ p[f"{d}_h"].T, dc * f
            grad |= {f"{d}_x": g_x, f"{d}_h": g_h, f"{d}_c": g_c}
        g_embed = np.zeros_like(p["embed"])
        np.add.at(g_embed, x.T.ravel(), d_e.reshape(-1, EMBED))
        grad["embed"] = g_embed
        return float((total - gold).mean()), grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam over random batches; returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), BATCH)
            loss, grad = self.loss(x[at], y[at])
            losses.append(loss)
            rate = 0.02 * min(1.0, step / 20, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def _blocks(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place, emissions, is text) of the texts, each led by one step of nothing and filled up to whole steps, so
        that its windows lie the same way whatever stands beside it."""
        starts = np.concatenate(([0], np.cumsum([STEP * (1 + -(-len(t) // STEP)) for t in texts]))).astype(np.int64)
        overlap = WINDOW - STEP
        rise = ((np.arange(overlap) + 1) / (overlap + 1)).astype(np.float32)[:, None, None]
        carried = np.zeros((overlap, TAGS), np.float32)
        steps = int(starts[-1]) // STEP
        for first in range(0, steps, BLOCK):
            count = min(BLOCK, steps - first)
            low, high = first * STEP, (first + count - 1) * STEP + WINDOW
            codes, real = np.full(high - low, PAD, np.uint8), np.zeros(high - low, bool)
            for k in range(int(np.searchsorted(starts, low, "right")) - 1, len(texts)):
                at = int(starts[k]) + STEP
                if at >= high:
                    break
                a, b = max(low, at), min(high, at + len(texts[k]))
                if a < b:
                    codes[a - low : b - low], real[a - low : b - low] = classes_of(texts[k][a - at : b - at]), True
            laid = np.lib.stride_tricks.as_strided(codes, (WINDOW, count), (1, STEP))
            emit = self.emissions(np.ascontiguousarray(laid))
            emit[:overlap] *= rise
            emit[STEP:] *= 1 - rise
            whole = np.ascontiguousarray(emit[:STEP].transpose(1, 0, 2))
            whole[0, :overlap] += carried
            whole[1:, :overlap] += emit[STEP:, :-1].transpose(1, 0, 2)
            carried = emit[STEP:, -1].copy()
            yield low, whole.reshape(-1, TAGS), real[: count * STEP]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, end, kind) in each of the texts."""
        out = [[] for _ in texts]
        starts = np.concatenate(([0], np.cumsum([STEP * (1 + -(-len(t) // STEP)) for t in texts])))
        emit, low = np.zeros((1, TAGS), np.float32), -1
        for _, block, real in self._blocks(texts):
            block[~real, 1:] -= 1000
            emit = np.concatenate((emit, block))
            final = low + len(emit) >= starts[-1]
            open_, upto = self._open(emit, final)
            for a, b, tag in self._decoded(emit[:upto], ~open_[:upto]):
                k = int(np.searchsorted(starts, low + a, "right")) - 1
                out[k].append((low + a - int(starts[k]) - STEP, low + b - int(starts[k]) - STEP, tag - 1))
            emit, low = emit[upto:].copy(), low + upto
        return out

    def _open(self, emit: np.ndarray, final: bool) -> tuple[np.ndarray, int]:
        """Places that the best path could tag, and the place up to which that is certain whatever follows.

        A stretch of tags in the best path wins over "no data" what its emissions and inner transitions win at most,
        less the least cost of entering and leaving; so it lies in a stretch whose sum says that it may."""
        trans = self.p["trans"].astype(np.float64)
        gain = emit[:, 1:].max(1).astype(np.float64) - emit[:, 0] + (trans[1:, 1:].max() - trans[0, 0])
        cost = (trans[1:, 1:].max() + trans[0, 0]) - trans[0, 1:].max() - trans[1:, 0].max()
        total = np.cumsum(gain)
        before = np.minimum.accumulate(np.concatenate(([0.0], total[:-1])))
        after = np.maximum.accumulate(total[::-1])[::-1]
        open_ = after - before >= cost - 1e-6
        if final:
            return open_, len(emit)
        # one that goes on to what follows would rather start later, if the sum falls far enough from here on
        later = np.minimum.accumulate(total[::-1])[::-1]
        certain = np.flatnonzero(~open_ & (before - later > 4 * np.ptp(trans) + 1))
        return open_, int(certain[-1]) if len(certain) else 0

    def _decoded(self, emit: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int]]:
        """(begin, end, tag) of the best path; places that are sure, and both ends, have tag 0. The stretches between
        them are decoded side by side."""
        open_ = np.flatnonzero(np.diff(np.concatenate(([True], sure, [True])).astype(np.int8)))
        begin, end = open_[::2], open_[1::2]
        if not len(begin):
            return []
        order = np.argsort(begin - end, kind="stable")  # the longest first
        begin, size, trans = begin[order], (end - begin)[order], self.p["trans"].astype(np.float64)
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # stretches of at least t + 1 places
        ends = np.cumsum(live)
        back = np.zeros((int(ends[-1]), TAGS), np.int8)
        score = emit[begin] + trans[0]
        for t in range(1, int(size[0])):
            n = int(live[t])
            ways = score[:n, :, None] + trans
            back[ends[t] - n : ends[t]] = ways.argmax(1)
            score[:n] = ways.max(1) + emit[begin[:n] + t]
        tags = np.zeros(len(emit), np.int64)
        now = (score + trans[:, 0]).argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            n = int(live[t])
            tags[begin[:n] + t] = now[:n]
            if t:
                now[:n] = back[np.arange(ends[t] - n, ends[t]), now[:n]]
        cut = np.flatnonzero(np.concatenate(([tags[0] > 0], tags[1:] != tags[:-1], [tags[-1] > 0])))
        return [(int(a), int(b), int(tags[a])) for a, b in zip(cut[:-1], cut[1:]) if tags[a]]


_TLD, _NAMES = ("com", "org", "net", "de", "fr", "es", "co", "io", "info"), "abcdefghijklmnopqrstuvwxyz"
_AT, _DOT = ("@",) * 6 + (" at ", " AT ", " [at] ", "[at]", "(at)", " (at) ", " @ ", "{at}"), (".",) * 5 + (" dot ", " DOT ", " [dot] ", "[dot]", "(dot)", " . ", "[.]")


_COMMON = "user mail info contact admin sales support office john anna maria peter team news home site web shop post service".split()


def _word(rng: random.Random, low: int = 2, high: int = 9) -> str:
    """A name: any letters, syllables, or a common one."""
    size, pick = rng.randint(low, high), rng.random()
    if pick < 0.3:
        return "".join(rng.choices(_NAMES, k=size))
    if pick < 0.8:
        return "".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "s")) for _ in range((size + 1) // 2))
    return rng.choice(_COMMON)


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def made_span(rng: random.Random, kind: int) -> str:
    """Personal data of a kind, in a base form or another spelling."""
    if kind == 0:
        at = rng.choice(_AT)
        dot = rng.choice(_DOT if at == "@" else [d for d in _DOT if d != "."] + ["."] * 3)
        local = rng.choice([_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}{_digits(rng, 2)}", f"{_word(rng)}.{_digits(rng, 2)}", f"{_word(rng)}_{_word(rng)}"])
        host = rng.choice([[_word(rng)], [_word(rng), _word(rng)], [f"{_word(rng)}{rng.randint(0, 99)}"], ["mail", _word(rng)], [f"mail{rng.randint(0, 9)}", "example"]])
        return local + at + dot.join([*host, rng.choice(_TLD)])
    if kind == 1:
        return rng.choice((".",) * 5 + (" . ", "[.]", " [.] ", "(.)", ". ", " dot ", "[dot]")).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        body = rng.choice("3456") + _digits(rng, rng.choice((14, 14, 14, 14, 12, 13, 17)))
        number = next(body + c for c in "0123456789" if luhn(body + c))
        gap = rng.choice(("", "", " ", "-", "  ", ".", " - ", "/", "--"))
        return gap.join(number[k : k + 4] for k in range(0, len(number), 4))
    area, first, last = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    lead = rng.choice(("+", "+", "+", "00", "00 ", "+ ")) + str(rng.randint(1, 99))
    return rng.choice((
        f"{lead} ({area}) {first}-{last}", f"{lead} ({area})  {first}-{last}", f"{lead} {area} {first} {last}", f"{lead}-{area}-{first}-{last}",
        f"{lead}{area}{first}{last}", f"({area}) {first}-{last}", f"{lead}.{area}.{first}.{last}", f"{lead} / {area} / {first}{last}",
    ))


def look_alike(rng: random.Random) -> str:
    """What resembles personal data and is none."""
    n = lambda k: str(rng.randint(0, 10**k - 1))
    return rng.choice((
        f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(0, 23)}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}",
        f"version {n(1)}.{n(2)}.{n(2)}", f"{n(3)},{_digits(rng, 3)}.{_digits(rng, 2)}", f"chapter {n(1)}.{n(1)}", f"{n(5)}", f"no. {n(4)}", f"{n(2)}.{n(2)}", f"{n(3)} {n(3)}",
        f"CC BY-NC {n(1)}.0.", f"at {_word(rng)} dot", f"{_word(rng)} at {_word(rng)}", f"the dot {_word(rng)}", f"looked at {_word(rng)} and {_word(rng)}", f"@{_word(rng)}",
        f"{_word(rng)}.{rng.choice(_TLD)}", f"({_word(rng)})", f'token = "{"".join(rng.choices("0123456789abcdef", k=32))}"', f"{n(6)}-{n(2)}", f"+{n(2)}%", f"{n(2)}/{n(2)}/{n(4)}",
        f"[{n(1)}]", f"www.{_word(rng)}.{rng.choice(_TLD)}/{_word(rng)}", f"{n(2)} x {n(2)}", f"{n(2)} - {n(2)}",
    ))


def number_rows(rng: random.Random) -> str:
    """A piece of a table of numbers, of a log or of comma-separated values: no personal data, however long it is."""
    size, pick = rng.randint(3, 14), rng.randrange(4)
    if pick == 0:
        width = rng.choice((1, 2, 3, 5, 7, 9))  # rows of fours are told from cards by form
        return rng.choice((" ", " ", "  ", "\t", "\n", " | ")).join(_digits(rng, rng.choice((width, width, rng.randint(1, 9)))) for _ in range(size))
    if pick == 1:
        return rng.choice((",", ";", ", ")).join(rng.choice(("{}", "{}.{}", "-{}", "{}.{}")).format(rng.randint(0, 9999), rng.randint(0, 99)) for _ in range(size))
    stamp = f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}"
    rest = " ".join(rng.choice(("{}", "{}ms", "id={}", "[{}]", "0x{}", "{}/{}")).format(rng.randint(0, 99999), rng.randint(0, 99)) for _ in range(rng.randint(1, 5)))
    return f"{stamp} {rest}" if pick == 2 else f"{stamp}.{_digits(rng, 3)} {rng.choice(('INFO', 'WARN', 'ERROR'))} {rest}"


def example(rng: random.Random, context: list[str]) -> tuple[str, np.ndarray]:
    """A made text and the tag of each of its characters."""
    said, tags = [], []

    def add(part: str, tag: int) -> None:
        said.append(part)
        tags.extend([tag] * len(part))

    def prose() -> None:
        text = rng.choice(context) if context and rng.random() < 0.8 else " ".join(_word(rng) for _ in range(12))
        at = rng.randrange(max(1, len(text) - 40))
        piece = text[at : at + rng.randint(2, 40)]
        for k, part in enumerate(re.split(r"([^\s]*[0-9@][^\s]*)", piece)):
            add(part if k % 2 == 0 else "", 0)

    prose()
    for _ in range(rng.randint(1, 4)):
        add(rng.choice((" ", " ", " ", "\n", ": ", " (", ", ", " | ")), 0)
        if rng.random() < 0.6:
            kind = rng.choices(range(4), (5, 2, 2, 3))[0]  # spelled-out addresses are the hardest
            add(made_span(rng, kind), kind + 1)
        else:
            add(look_alike(rng) if rng.random() < 0.8 else number_rows(rng), 0)
        add(rng.choice((" ", " ", " ", "\n", ". ", ") ", ", ", " | ")), 0)
        if rng.random() < 0.5:
            prose()
    return "".join(said), np.array(tags, np.int64)


def examples(context: list[str], count: int = TRAIN_WINDOWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and tags."""
    rng = random.Random(seed)
    xs, ys = np.full((count, TRAIN_LENGTH), PAD, np.int64), np.zeros((count, TRAIN_LENGTH), np.int64)
    for k in range(count):
        text, tags = example(rng, context)
        codes = classes_of(text)
        room = len(codes) - TRAIN_LENGTH
        at = rng.randint(0, room) if room > 0 else rng.randint(room, 0)
        a, b = max(0, at), min(len(codes), at + TRAIN_LENGTH)
        xs[k, a - at : b - at], ys[k, a - at : b - at] = codes[a:b], tags[a:b]
    return xs, ys


def train(docs: DataFrame) -> Tagger:
    """Fit on made spans in text of a bounded sample of documents."""
    some = sampled(docs.select("doc_id", "text"), 2 * TRAIN_DOCS).filter(F.length("text") > 0)
    rows = some.select("doc_id", F.substring("text", 1, TRAIN_CHARS).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_DOCS).collect()
    tagger = Tagger()
    tagger.train(*examples([r["text"] for r in rows]))
    return tagger


_DOT_SIGN = r"(?:\.|\s\.\s|[\[(]\.[\])]|[\s\[({]{1,3}dot[\s\])}]{1,3})"
_AT_SIGN = re.compile(r"\s?@\s?|[\s\[({]{1,3}at[\s\])}]{1,3}", re.I)
_HOST = re.compile(rf"[A-Z0-9-]{{1,63}}(?:{_DOT_SIGN}[A-Z0-9-]{{1,63}}){{0,8}}{_DOT_SIGN}[A-Z]{{2,63}}", re.I)
#: What stands between the numbers of an address, of a card, of a phone number; what a phone number begins with.
_IP_GAP, _CARD_GAP, _PHONE_GAP = re.compile(r"\W{0,2}(?:\.|dot)\W{0,2}", re.I), re.compile(r"[ ./-]{1,3}"), re.compile(r"(?! +-[0-9])[ ()./-]{1,4}")
_PHONE_LEAD = re.compile(r"\+ ?\(?(?=[0-9])|(?<![0-9])(?<![0-9][ .-])(?=00[ ]?[0-9])|\((?=[0-9]{3}\))")
#: A number in a row with others that starts with zeros is a column's, not a phone number's.
_GOES_ON = re.compile(r"[ .-]{1,2}[0-9]")
#: Longest local part, most digits of a card and of a phone number: a look from any place goes no further.
LOCAL, CARD_DIGITS, PHONE_DIGITS = 64, 19, 15
_NUMBER = re.compile("[0-9]+")


def _mails(text: str) -> Iterator[tuple[int, int]]:
    after = 0
    for m in _AT_SIGN.finditer(text):
        start = m.start()
        while start > max(after, m.start() - LOCAL) and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start() and (host := _HOST.match(text, m.end())):
            yield start, host.end()
            after = host.end()


def _runs(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Numbers in a row with the same gap between them, as long as they go on, and that gap."""
    places = [m.span() for m in _NUMBER.finditer(text)]
    gaps = [text[a[1] : b[0]].lower() if b[0] - a[1] <= 8 else "\n" for a, b in zip(places, places[1:])]
    first = 0
    for k in range(1, len(places) + 1):
        if k == len(places) or (k - 1 > first and gaps[k - 1] != gaps[k - 2]):
            yield gaps[first] if k - first > 1 else "", places[first:k]
            first = k - 1 if k - first > 1 and k < len(places) else k


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers up to 255 with the same sign thrice between them; lists that go on are none."""
    for gap, run in _runs(text):
        if len(run) == 4 and _IP_GAP.fullmatch(gap) and all(_is_byte(text[a:b]) for a, b in run):
            yield run[0][0], run[-1][1]


def _cards(text: str) -> Iterator[tuple[int, int]]:
    """Three or four groups of four digits and perhaps a shorter one, or one number run together with a few others;
    groups of four that go on for longer are columns of a table."""

    def passes(part: list[tuple[int, int]]) -> bool:
        digits = "".join(text[a:b] for a, b in part)
        return 12 <= len(digits) <= CARD_DIGITS and luhn(digits)

    for gap, run in _runs(text):
        if len(run) <= 3:
            yield from ((a, b) for a, b in run if b - a > 12 and text[a] in "3456" and passes([(a, b)]))
        if not _CARD_GAP.fullmatch(gap):
            continue
        fours = [b - a == 4 for a, b in run] + [False]
        at = 0
        while at < len(run):
            end = at
            while fours[end]:
                end += 1
            if 3 <= end - at <= 5:
                last = end + (end < len(run) and run[end][1] - run[end][0] < 4)
                ways = [run[i:j] for i in range(at, end - 2) for j in range(last, i + 2, -1)]
                if found := max((w for w in ways if passes(w)), key=len, default=None):
                    yield found[0][0], found[-1][1]
            at = end + 1


def _phones(text: str) -> Iterator[tuple[int, int]]:
    """Numbers after a plus, two zeros or an area in brackets, as far as nine to fifteen digits go."""
    after = 0
    for m in _PHONE_LEAD.finditer(text):
        if m.start() < after:
            continue
        at, digits, end = m.end(), 0, None
        most = 11 if m[0] == "(" else PHONE_DIGITS
        while number := _NUMBER.match(text, at, at + most + 1):
            digits += number.end() - at
            if digits > most:
                break
            gap = _PHONE_GAP.match(text, number.end())
            if digits >= 9 and not (gap and " " not in gap[0] and _NUMBER.match(text, gap.end())):  # else a number is cut
                end = number.end()
            if not gap:
                break
            at = gap.end()
        if end is not None and (m[0] or not _GOES_ON.match(text, end)):
            yield m.start(), end
            after = end


_HELD = (_mails, _addresses, _cards, _phones)


def all_spans(texts: list[str | None], tagger: Tagger) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Per text base spans, and all spans: base ones stay, the model's are added where they touch none. Each check of a
    stretch is one pass over it, from each place no further than data of the kind can reach."""
    texts = [t or "" for t in texts]
    for text, proposed in zip(texts, tagger.spans(texts)):
        base = base_spans(text) if re.search(r"[0-9@]", text) else []
        added, taken, begun = [], bytearray(len(text)), 0
        for start, end, _ in base:
            taken[start:end] = b"\1" * (end - start)
        for start, end, kind in proposed:
            low, high = max(begun, start - LOCAL), min(len(text), end + LOCAL)
            while low < start and text[start - 1] in _LOCAL_CHARS and (kind == 0 or text[start - 1].isdigit()):
                start -= 1
            while end < high and text[end - 1].isalnum() and text[end].isalnum() and text[end].isascii():
                end += 1
            begun = start
            stretch = text[start:end]
            for k in sorted(range(len(KINDS)), key=lambda k: k != kind):  # the proposed kind first
                for a, b in _HELD[k](stretch):
                    if not any(taken[start + a : start + b]):
                        added.append((start + a, start + b, k))
                        taken[start + a : start + b] = b"\1" * (b - a)
        yield base, sorted(base + added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame) -> DataFrame:
    """Per document: base counts, digest of the base spans, all spans and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.pandas_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,n_spans:long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for base, every in all_spans(batch.tolist(), shared.value):
                counts = [sum(k == kind for *_, kind in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select("doc_id", found.asNondeterministic()("text").alias("p")).select("doc_id", "p.*")
