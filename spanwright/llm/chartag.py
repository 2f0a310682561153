"""A character tagger in numpy: bidirectional LSTM emissions, CRF transitions, Viterbi and marginal training.

Digits share one symbol, so a text is seen by its shape and its words. All arrays are float32 and a few
ten thousand numbers in all; they travel inside the task closure.
"""

from __future__ import annotations

import unicodedata

import numpy as np

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
#: O, then B- and I- of each type.
LABELS = ("O",) + tuple(f"{p}-{t}" for t in TYPES for p in "BI")

_ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,:;!?'\"()[]<>@-_/+&#|=*\n"
PAD, DIGIT, LOWER, UPPER, SPACE, OTHER = 0, 1, 2, 3, 4, 5
_BASE = 6
N_SYMBOLS = _BASE + len(_ASCII)


def _table() -> np.ndarray:
    t = np.full(0x3000, OTHER, np.int16)
    for cp in range(t.size):
        c = chr(cp)
        if c in _ASCII:
            t[cp] = _BASE + _ASCII.index(c)
        elif c.isdigit():
            t[cp] = DIGIT
        elif c.isspace():
            t[cp] = SPACE
        elif unicodedata.category(c) == "Lu":
            t[cp] = UPPER
        elif c.isalpha():
            t[cp] = LOWER
    return t


_SYMBOL = _table()


def encode(text: str) -> np.ndarray:
    """Symbol of each code point."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOL[np.minimum(a, 0x2FFF)]


def init_params(hidden: int, embed: int = 16, seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    k = len(LABELS)
    p = {"E": r.normal(0, 0.3, (N_SYMBOLS, embed)), "T": r.normal(0, 0.1, (k, k)), "s": np.zeros(k)}
    for d in "fb":
        p["W" + d] = r.normal(0, 1 / np.sqrt(embed), (embed, 4 * hidden))
        p["U" + d] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        b = np.zeros(4 * hidden)
        b[hidden : 2 * hidden] = 1.0
        p["b" + d] = b
    p["V"] = r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, k))
    p["c"] = np.zeros(k)
    return {n: v.astype(np.float32) for n, v in p.items()}


def _sweep(table: np.ndarray, u: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hidden states [T, B, H] of one direction; table is the input part of each symbol. The signs of table and u are turned
    and the candidate is doubled, so that one exponential gives the gates and, as tanh x = 2 / (1 + exp(-2 x)) - 1, the candidate."""
    steps, n = ids.shape
    h4 = u.shape[1]
    hid = h4 // 4
    out = np.empty((steps, n, hid), np.float32)
    h = np.zeros((n, hid), np.float32)
    c = np.zeros((n, hid), np.float32)
    z = np.empty((n, h4), np.float32)
    x = np.empty((n, h4), np.float32)
    tmp = np.empty((n, hid), np.float32)
    for t in range(steps):
        np.matmul(h, u, out=z)
        np.take(table, ids[t], axis=0, out=x, mode="clip")
        z += x
        np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)
        g = z[:, 3 * hid :]
        g *= 2
        g -= 1
        c *= z[:, hid : 2 * hid]
        np.multiply(z[:, :hid], z[:, 3 * hid :], out=tmp)
        c += tmp
        h = out[t]
        np.tanh(c, out=h)
        h *= z[:, 2 * hid : 3 * hid]
    return out


class Tagger:
    """Read-only model for scoring. Gate order: input, forget, output, candidate."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.hidden = params["Uf"].shape[0]
        half = np.full(4 * self.hidden, -1, np.float32)
        half[3 * self.hidden :] = -2
        self.table = {d: ((params["E"] @ params["W" + d] + params["b" + d]) * half).astype(np.float32) for d in "fb"}
        self.u = {d: (params["U" + d] * half).astype(np.float32) for d in "fb"}
        self.v, self.c, self.trans, self.start = params["V"], params["c"], params["T"], params["s"]
        t = self.trans - self.trans[0, 0]
        #: The most that a step can add beside a path of O, by kind of step: o(utside), b(egin), i(nside).
        sets = {"o": [0], "b": list(range(1, len(t), 2)), "i": list(range(2, len(t), 2))}
        self.most = {x + y: float(t[np.ix_(sets[x], sets[y])].max()) for x in "obi" for y in "obi"}
        start = self.start - self.start[0]
        self.most |= {"sb": float(start[1::2].max()), "si": float(start[2::2].max())}

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """[T, B] symbols to [K, T, B] scores."""
        with np.errstate(over="ignore"):
            f = _sweep(self.table["f"], self.u["f"], ids)
            b = _sweep(self.table["b"], self.u["b"], ids[::-1])[::-1]
        steps, n, h = f.shape
        em = self.v[:h].T @ f.reshape(-1, h).T
        em += self.v[h:].T @ b.reshape(-1, h).T
        em += self.c[:, None]
        return em.reshape(-1, steps, n)

    def viterbi(self, em: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Best labels [T, B] of [K, T, B]; first: scores to begin with, [K, B], else those of a text's start."""
        k, steps, n = em.shape
        scores = np.empty((steps, k, n), np.float32)
        scores[0] = em[:, 0] + (self.start[:, None] if first is None else first)
        cand = np.empty((k, n), np.float32)
        for t in range(1, steps):
            before, best = scores[t - 1], scores[t]
            np.add(before[0], self.trans[0][:, None], out=best)
            for j in range(1, k):
                np.add(before[j], self.trans[j][:, None], out=cand)
                np.maximum(best, cand, out=best)
            best += em[:, t]
        out = np.empty((steps, n), np.int8)
        cur = scores[-1].argmax(0)
        out[-1] = cur
        for t in range(steps - 1, 0, -1):
            # Where the best score of the label came from; asked only of the labels that are in the path.
            cur = (scores[t - 1] + self.trans[:, cur]).argmax(0)
            out[t - 1] = cur
        return out

    def open_places(self, em: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where a mention could be. The best path holds a mention only if it gains over O. No mention through a place
        gains more than the best chain of begin and inside scores through it, each the highest of any type."""
        m = self.most
        g = np.stack([em[1::2].max(0), em[2::2].max(0)], 1) - em[0][:, None]
        steps = len(g)
        step = np.array([[m["bb"], m["bi"]], [m["ib"], m["ii"]]], np.float32)
        into = np.ascontiguousarray(step.T)[:, :, None]
        enter = np.array([[m["ob"]], [m["oi"]]], np.float32)
        leave = np.array([[m["bo"]], [m["io"]]], np.float32)
        ahead, behind = g.copy(), g.copy()
        ahead[0] += np.array([[m["sb"]], [m["si"]]], np.float32)
        for t in range(1, steps):
            ahead[t] += np.maximum((ahead[t - 1] + into).max(1), enter)
        # A text may end inside a mention; beyond its end nothing is inside.
        place = np.arange(steps)[:, None]
        behind[np.broadcast_to((place >= lengths)[:, None], behind.shape)] = -1e9
        free = np.where((place == lengths - 1)[:, None], np.float32(0), leave)
        behind[-1] += free[-1]
        out = step[:, :, None]
        for t in range(steps - 2, -1, -1):
            behind[t] += np.maximum((out + behind[t + 1]).max(1), free[t])
        return (ahead + behind - g > -1e-3).any(1)

    def runs(self, em: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int, np.ndarray, bool, bool]]:
        """Where a mention could be in windows: (window, from, to, scores, whether it begins and whether it ends one)."""
        open_ = self.open_places(em, lengths)
        open_ &= np.arange(len(open_))[:, None] < lengths
        edge = np.diff(open_.T.astype(np.int8), axis=1, prepend=0, append=0)
        col, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        return [(c, b, e, em[:, b:e, c].copy(), b == 0, e == lengths[c]) for c, b, e in zip(col.tolist(), lo.tolist(), hi.tolist(), strict=True)]

    def solve(self, runs: list[tuple]) -> list[np.ndarray]:
        """Best labels of each run, as they are in the best path of its whole window."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(runs)
        order = sorted(range(len(runs)), key=lambda r: runs[r][2] - runs[r][1])
        k = len(LABELS)
        leave = self.trans[:, 0]
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            width = runs[part[-1]][2] - runs[part[-1]][1]
            sub = np.full((k, width, len(part)), -1e9, np.float32)
            sub[0] = 0
            first = np.empty((k, len(part)), np.float32)
            for i, r in enumerate(part):
                _, b, e, em, begins, ends = runs[r]
                n = e - b
                sub[:, :n, i] = em
                # Beyond a run the label is O; at the end of a text nothing follows.
                sub[:, n - 1, i] += (0 if ends else leave) - (leave if n < width else 0)
                first[:, i] = self.start if begins else self.trans[0]
            got = self.viterbi(sub, first)
            for i, r in enumerate(part):
                out[r] = got[: runs[r][2] - runs[r][1], i]
        return out

    def decode(self, em: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels [T, B] of windows of the given lengths; exact, but searched only where a mention could be."""
        out = np.zeros(em.shape[1:], np.int8)
        runs = self.runs(em, lengths)
        for (c, b, e, *_), y in zip(runs, self.solve(runs), strict=True):
            out[b:e, c] = y
        return out


def spans_of(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(type, start, end) of one label sequence; a type that changes without a B- starts a new span."""
    if not labels.any():
        return []
    out, typ, beg = [], -1, 0
    for i, y in enumerate(labels.tolist()):
        if y == 0:
            if typ >= 0:
                out.append((typ, beg, i))
            typ = -1
            continue
        t, inside = (y - 1) // 2, (y - 1) % 2
        if not inside or t != typ:
            if typ >= 0:
                out.append((typ, beg, i))
            typ, beg = t, i
    if typ >= 0:
        out.append((typ, beg, len(labels)))
    return out


# --- training -------------------------------------------------------------------------------------------------


def _forward(p: dict, ids: np.ndarray, d: str) -> tuple[np.ndarray, list]:
    steps, n = ids.shape
    hid = p["U" + d].shape[0]
    h = np.zeros((n, hid), np.float32)
    c = np.zeros((n, hid), np.float32)
    table = p["E"] @ p["W" + d] + p["b" + d]
    keep, out = [], np.empty((steps, n, hid), np.float32)
    for t in range(steps):
        z = table[ids[t]] + h @ p["U" + d]
        g = 0.5 * np.tanh(0.5 * z[:, : 3 * hid]) + 0.5
        a = np.tanh(z[:, 3 * hid :])
        i, f, o = g[:, :hid], g[:, hid : 2 * hid], g[:, 2 * hid :]
        c2 = f * c + i * a
        tc = np.tanh(c2)
        keep.append((h, c, i, f, o, a, tc))
        h, c = o * tc, c2
        out[t] = h
    return out, keep


def _backward(p: dict, g: dict, ids: np.ndarray, d: str, keep: list, dout: np.ndarray) -> None:
    steps, n = ids.shape
    hid = p["U" + d].shape[0]
    dh = np.zeros((n, hid), np.float32)
    dc = np.zeros((n, hid), np.float32)
    dz_all = np.empty((steps, n, 4 * hid), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, a, tc = keep[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[:, :hid] = dc * a * i * (1 - i)
        dz[:, hid : 2 * hid] = dc * c * f * (1 - f)
        dz[:, 2 * hid : 3 * hid] = dh * tc * o * (1 - o)
        dz[:, 3 * hid :] = dc * i * (1 - a * a)
        g["U" + d] += h.T @ dz
        dh = dz @ p["U" + d].T
        dc = dc * f
    flat, ids1 = dz_all.reshape(-1, 4 * hid), ids.reshape(-1)
    dtable = np.zeros((N_SYMBOLS, 4 * hid), np.float32)
    np.add.at(dtable, ids1, flat)
    g["W" + d] += p["E"].T @ dtable
    g["b" + d] += flat.sum(0)
    g["E"] += dtable @ p["W" + d].T


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def loss_and_grads(p: dict, ids: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """Negative log likelihood of the CRF over windows [T, B]; mask is 1 inside a text, and windows start at 0."""
    steps, n = ids.shape
    hid = p["Uf"].shape[0]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    hf, kf = _forward(p, ids, "f")
    hb, kb = _forward(p, ids[::-1], "b")
    hb = hb[::-1]
    em = hf @ p["V"][:hid] + hb @ p["V"][hid:] + p["c"]
    k = em.shape[2]
    alpha = np.empty((steps, n, k), np.float32)
    alpha[0] = em[0] + p["s"]
    for t in range(1, steps):
        a = _lse(alpha[t - 1][:, :, None] + p["T"], 1) + em[t]
        alpha[t] = np.where(mask[t][:, None] > 0, a, alpha[t - 1])
    logz = _lse(alpha[-1], 1)
    beta = np.zeros((n, k), np.float32)
    dem = np.zeros_like(em)
    rows = np.arange(n)
    gold_score = np.zeros(n, np.float32)
    for t in range(steps - 1, -1, -1):
        on = mask[t][:, None]
        dem[t] = np.exp(alpha[t] + beta - logz[:, None]) * on
        dem[t][rows, gold[t]] -= mask[t]
        gold_score += em[t][rows, gold[t]] * mask[t]
        if t:
            inner = em[t] + beta
            pair = np.exp(alpha[t - 1][:, :, None] + p["T"] + inner[:, None, :] - logz[:, None, None]) * on[:, :, None]
            g["T"] += pair.sum(0)
            np.add.at(g["T"], (gold[t - 1], gold[t]), -mask[t])
            gold_score += p["T"][gold[t - 1], gold[t]] * mask[t]
            beta = np.where(on > 0, _lse(p["T"] + inner[:, None, :], 2), beta)
    g["s"] += dem[0].sum(0)
    gold_score += p["s"][gold[0]]
    flat = dem.reshape(-1, k)
    g["V"][:hid] += hf.reshape(-1, hid).T @ flat
    g["V"][hid:] += hb.reshape(-1, hid).T @ flat
    g["c"] += flat.sum(0)
    dh = dem @ p["V"].T
    _backward(p, g, ids, "f", kf, dh[:, :, :hid])
    _backward(p, g, ids[::-1], "b", kb, dh[::-1, :, hid:])
    return float((logz - gold_score).sum()), g
