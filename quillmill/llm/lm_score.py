"""Language-model scoring: a gated recurrent model with a class-factored softmax.

Tokens are ASCII-lower-cased words and one end per document. Words fall in groups.
The most frequent words have outputs of their own, in a few classes of about equal
weight per group; the other words of a bounded head, and all words beyond it, form
one class each per group, within which they follow their corpus counts. The output
is a softmax over end and groups, one over the group's classes and one over the
class's frequent words. Documents are grouped by how often they use
each letter (spherical k-means over all learning documents); a word belongs to the group
that uses it most, a word beyond the head to the group of its last two bytes. So
classes hold words that occur together, such as those of a language, and the
recurrent state, which picks group, class and frequent word, can tell them apart.
The state is carried across windows, so a document's score is the log-likelihood
of the whole document.

Counts cover all learning documents. The network learns from every learning
document by truncated backpropagation: each partition of the input trains a copy
on whole documents, in turns over disjoint shares of the documents, and the copies
are averaged on executors, so the work grows with the input and is spread as it is.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Scratch, crc_mod, through

#: Words known in every worker, at most (a bounded broadcast); words with outputs of their own; their classes in a group; groups.
HEAD, OWN, CLASSES, GROUPS = 1 << 17, 2048, 3, 16
#: State size; window of backpropagation; turns, each over its share of the learning documents.
HIDDEN, WINDOW, TURNS = 16, 32, 2
#: Documents whose letter shares are held before like ones are summed up, and such sums a task; tasks' sums, or parameter sets, that one task merges.
SUMMED, SUMS, FAN = 2048, 64, 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Tokens of documents handled together, and lanes that run side by side.
BATCH_TOKENS, LANES, WINDOW_TOKENS = 4_000_000, 512, 8192
#: Symbols in a training lane, about: lanes are as many as give it. Tokens that a copy of the network learns from, at least, about.
TRAIN_STEPS, COPY_TOKENS = 2048, 400_000
#: Rows of class scores worked on at a time, so that they stay in a core's cache.
ROWS = 1024
#: AdaGrad's rate (halved in each later turn), and what its sums of squares start from.
RATE, START = 0.1, 0.1


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words (binary) of all texts, in order, and the row of each; null has none."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, row = found.flatten(), np.repeat(np.arange(len(found), dtype=np.int32), pc.list_value_length(found).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends leaves empty ones
    return words.filter(some).cast(pa.binary()), row[some.to_numpy(zero_copy_only=False)]


def letter_shares(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of a text's bytes without white space and controls: a unit vector, or zeros."""
    c = np.bincount(np.frombuffer((text or b"").translate(LOWER), np.uint8), minlength=256).astype(np.float32)
    c[:33] = 0
    return np.sqrt(c / max(c.sum(), 1))


def shares_of(texts: pa.Array) -> np.ndarray:
    """``letter_shares`` of each text."""
    c = np.zeros((len(texts), 256), np.float32)
    for row, x in zip(c, texts, strict=True):
        row[:] = np.bincount(np.frombuffer(raw_bytes(x), np.uint8), minlength=256)
    c[:, 97:123] += c[:, 65:91]
    c[:, 65:91] = 0
    c[:, :33] = 0
    return np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1))


class Vocabulary:
    """Classes and fixed log-probabilities of words.

    Symbols: 0 is end, 1..own the frequent words, then GROUPS of the head's other
    words, then GROUPS of the words beyond the head. ``head`` lists (word, count,
    group), most frequent first; ``endings`` gives (sum of count + 1, group) of the
    words beyond by their ending, and an unseen ending has a group by hash.
    """

    def __init__(self, head: list[tuple[bytes, int, int]], docs: int, endings: dict[bytes, tuple[int, int]]):
        self.words = pa.array([w for w, *_ in head], pa.binary())
        self.count = np.array([c for _, c, _ in head] or [0], np.int64)
        group = np.array([g for *_, g in head] or [0], np.int64)
        self.own = own = min(OWN, len(head))
        self.symbols = 1 + own + 2 * GROUPS
        self.symbol = np.zeros(max(1, len(head)), int)
        self.symbol[own:] = (1 + own + group[own:]) if len(head) else 0
        # a group's classes: its frequent words in runs of about equal square-root mass, its other words of the head, those beyond
        k = CLASSES + 2
        slot = np.zeros(own, int)
        for g in range(GROUPS):
            m = np.nonzero(group[:own] == g)[0] if own else np.zeros(0, int)
            root = np.sqrt(self.count[m] + 1.0)
            slot[m] = np.minimum((np.cumsum(root) - root / 2) / max(root.sum(), 1e-9) * CLASSES, CLASSES - 1).astype(int)
        order = np.argsort(group[:own] * k + slot, kind="stable")  # frequent words are numbered class by class
        if own:
            self.symbol[order] = np.arange(1, own + 1)
        # log10 of a word's share of its symbol
        mass = np.bincount(self.symbol, self.count + 1.0, self.symbols) if len(head) else np.zeros(self.symbols)
        self.endings, self.ending_group = pa.array(list(endings), pa.binary()), np.array([g for _, g in endings.values()] + [0], np.int64)
        self.beyond = np.ones(GROUPS)  # counts + 1 of words beyond the head, and one for all unseen
        for m, g in endings.values():
            self.beyond[g] += m
        self.within = np.zeros(len(self.count))
        if len(head) > own:
            self.within[own:] = np.log10((self.count[own:] + 1) / mass[self.symbol[own:]])
        group_of = np.concatenate([[-1], group[order], np.arange(GROUPS), np.arange(GROUPS)])
        slot = np.concatenate([[0], slot[order], np.full(GROUPS, CLASSES), np.full(GROUPS, CLASSES + 1)])
        self.group = 1 + group_of  # 0 is end
        self.slot = slot
        self.cls = np.where(group_of < 0, -1, group_of * k + slot).astype(np.int16)
        inner = (np.arange(self.symbols) >= 1) & (np.arange(self.symbols) <= own)
        self.inner = np.where(inner, 1 + group_of * CLASSES + slot, 0)  # number of a class of frequent words, else 0
        self.classes = [np.arange(g * k, g * k + k) for g in range(GROUPS)]
        self.members = [np.nonzero(self.inner == c)[0] for c in range(1, 1 + GROUPS * CLASSES)]
        self.filled = [(g * k + c, int(m[0]), int(m[-1]) + 1) for g in range(GROUPS) for c in range(CLASSES) if len(m := self.members[g * CLASSES + c])]  # class, first symbol, end of symbols
        self.rank = np.zeros(self.symbols, int)
        for m in self.members:
            self.rank[m] = np.arange(len(m))
        self.width = np.zeros(self.symbols, int)  # words of a frequent word's class
        for _, i, j in self.filled:
            self.width[i:j] = j - i
        self.weight = np.concatenate([[docs + 1.0], self.count[:own][order] + 1.0, mass[1 + own : 1 + own + GROUPS] + 1e-3, self.beyond])

    def groups_beyond(self, words: pa.Array) -> np.ndarray:
        """Groups of words beyond the head."""
        ends = pc.binary_slice(words, -2)
        at = pc.fill_null(pc.index_in(ends, value_set=self.endings), -1).to_numpy(zero_copy_only=False)
        out = self.ending_group[at]
        for i in np.nonzero(at < 0)[0]:
            out[i] = zlib.crc32(ends[i].as_py()) % GROUPS
        return out


class Network:
    """GRU with class-factored output, in numpy."""

    def __init__(self, voc: Vocabulary, seed: int = 5):
        r, h = np.random.default_rng(seed), HIDDEN
        self.voc = voc
        f = np.float32
        groups = np.bincount(voc.group, voc.weight, 1 + GROUPS)
        classes = np.bincount(voc.cls[1:], voc.weight[1:], GROUPS * (CLASSES + 2))
        self.p = {
            "emb": (r.standard_normal((voc.symbols, 3 * h)) * 0.1).astype(f),  # the input's part of the gates
            "u": (r.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(f),
            "b": np.concatenate([np.full(h, 1.0), np.zeros(2 * h)]).astype(f),  # gates start nearly open to the past
            "wg": np.zeros((1 + GROUPS, h), f),
            "bg": np.log(groups + 1e-3).astype(f),
            "wc": np.zeros((len(classes), h), f),
            "bc": np.log(classes + 1e-3).astype(f),
            "wo": np.zeros((voc.symbols, h), f),
            "bo": np.log(voc.weight).astype(f),
        }

    def steps(self, x: np.ndarray, h: np.ndarray, keep: np.ndarray, tape: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (time, lanes, HIDDEN + 1) after reading each input, a 1 behind each for biases, and the last state (HIDDEN, lanes).

        x, keep: (time, lanes); keep is 0 where a document starts. A state has a lane a
        column, so that each gate of all lanes lies in one piece of memory. What the two
        gates get is held with its sign turned, as their sigmoid needs it.
        """
        n, p, (long, many) = HIDDEN, self.p, x.shape
        sign = np.repeat(np.array([-1, 1], p["u"].dtype), (2 * n, n))
        u = np.ascontiguousarray((p["u"] * sign).T)
        e = np.empty((long, 3 * n, many), u.dtype)
        np.add(p["emb"].take(x, 0).transpose(0, 2, 1), p["b"][:, None], e)
        np.negative(e[:, : 2 * n], e[:, : 2 * n])
        a = np.empty((long if tape is not None else 1, 3 * n, many), u.dtype)
        states, part = np.empty((long + 1, n, many), u.dtype), np.empty((n, many), u.dtype)
        states[0] = h
        starts = (keep.min(1) < 1).tolist()
        for t in range(long):
            h0, g, c, to, at = states[t], e[t, : 2 * n], e[t, 2 * n :], states[t + 1], a[t if tape is not None else 0]
            if starts[t]:
                h0 = h0 * keep[t]
            np.dot(u, h0, at)
            np.add(g, at[: 2 * n], g)
            np.exp(g, g)
            np.add(g, 1, g)
            np.reciprocal(g, g)
            np.multiply(g[n:], at[2 * n :], part)
            np.add(c, part, c)
            np.tanh(c, c)
            np.subtract(h0, c, to)
            np.multiply(to, g[:n], to)
            np.add(to, c, to)
        if tape is not None:
            tape += [states[:-1] * keep[:, None], a[:, 2 * n :], e[:, :n], e[:, n : 2 * n], e[:, 2 * n :], starts]
        out = np.ones((long, many, n + 1), u.dtype)
        out[:, :, :n] = states[1:].transpose(0, 2, 1)
        return out, states[-1].copy()

    def heads(self) -> list[tuple[np.ndarray, bool]]:
        """For end and groups, for groups' classes and for classes' words: weights with biases behind them, and whether scores need no maximum taken off.

        States are within -1 and 1, so the weights bound how far scores go beyond the biases, of which each softmax has the largest taken off.
        """
        p, voc = self.p, self.voc

        def head(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
            return np.concatenate([w, b[:, None]], 1), bool((np.abs(w) @ np.ones(w.shape[1], w.dtype)).max(initial=0) < 60)

        bc, bo = p["bc"].reshape(GROUPS, -1), p["bo"].copy()
        if voc.filled:
            first = [i for _, i, _ in voc.filled]
            bo[1 : 1 + voc.own] -= np.repeat(np.maximum.reduceat(bo[: 1 + voc.own], first), [j - i for _, i, j in voc.filled])
        return [head(p["wg"], p["bg"] - p["bg"].max()), head(p["wc"], (bc - bc.max(1, keepdims=True)).ravel()), head(p["wo"], bo)]

    def output(self, h: np.ndarray, y: np.ndarray, heads: list | None = None, grad: bool = False):
        """Natural log-probabilities of symbols y after states h (with or without a 1 behind each); with ``grad`` the states' gradients too, and the parameters'.

        Rows are sorted by class once, so that those of a group and of a class lie together.
        A softmax's scores become exponentials in place; with ``grad`` the total is taken off
        at the symbol's place, which leaves the gradient times minus the total.
        """
        voc, k = self.voc, CLASSES + 2
        (wg, safe_g), (wc, safe_c), (wo, safe_o) = heads or self.heads()
        if h.shape[1] == HIDDEN:
            h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)
        key = voc.cls.take(y)
        order = np.argsort(key, kind="stable")
        hs, ys = h.take(order, 0), y.take(order)
        ends = np.cumsum(np.bincount(key + 1, minlength=1 + GROUPS * k)).tolist()  # of end's rows, then of each class's
        row = np.arange(len(ys))

        def softmax(s: np.ndarray, at: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
            if not safe:
                s -= s.max(1, keepdims=True)
            place = row[: len(at)] * s.shape[1] + at
            logs = s.ravel().take(place)
            np.exp(s, s)
            tot = s @ np.ones(s.shape[1], s.dtype)
            logs -= np.log(tot)
            if grad:
                s *= (-1 / tot)[:, None]
                s.ravel()[place] += 1
            return logs

        s = hs @ wg.T
        logs = softmax(s, voc.group[ys], safe_g)
        if grad:
            dh, gg = s @ wg, s.T @ hs
        # within the group: all rows but end's
        skip = ends[0]
        parts = [(g, i, j) for g in range(GROUPS) if (i := ends[g * k]) < (j := ends[g * k + k])]
        s = np.empty((len(ys) - skip, k), h.dtype)
        for g, i, j in parts:
            np.dot(hs[i:j], wc[g * k : g * k + k].T, s[i - skip : j - skip])
        logs[skip:] += softmax(s, voc.slot[ys[skip:]], safe_c)
        if grad:
            gc, d = np.zeros_like(wc), np.empty((len(s), h.shape[1]), h.dtype)
            for g, i, j in parts:
                m, r = slice(g * k, g * k + k), slice(i - skip, j - skip)
                np.dot(s[r], wc[m], d[r])
                np.dot(s[r].T, hs[i:j], gc[m])
            dh[skip:] += d
            go = np.zeros_like(wo)
        # within the class: frequent words only; their scores lie end to end, as classes differ in size
        own = [(a, b, i, j) for c, a, b in voc.filled if b - a > 1 and (i := ends[c]) < (j := ends[c + 1])]
        if own:
            at = np.concatenate([row[i:j] for _, _, i, j in own])
            width = voc.width[ys[at]]
            start = np.cumsum(width) - width
            flat, blocks, done = np.empty(int(width.sum()), h.dtype), [], 0
            for a, b, i, j in own:
                size = (j - i) * (b - a)
                block = flat[done : done + size].reshape(j - i, b - a)
                np.dot(hs[i:j], wo[a:b].T, block)
                if not safe_o:
                    block -= block.max(1, keepdims=True)
                blocks.append((a, b, i, j, block))
                done += size
            place = start + voc.rank[ys[at]]
            log = flat[place]
            np.exp(flat, flat)
            tot = np.add.reduceat(flat, start)
            logs[at] += log - np.log(tot)
            if grad:
                flat[place] -= tot
                less, d = np.zeros((len(ys), 1), h.dtype), np.zeros_like(hs)
                less[at, 0] = -1 / tot
                hl = hs * less
                for a, b, i, j, block in blocks:
                    np.dot(block, wo[a:b], d[i:j])
                    np.dot(block.T, hl[i:j], go[a:b])
                d *= less
                dh += d
        place = np.empty_like(order)
        place[order] = row
        out = logs.take(place)
        if not grad:
            return out
        g = {}
        for w, b, v in (("wg", "bg", gg), ("wc", "bc", gc), ("wo", "bo", go)):
            g |= {w: np.ascontiguousarray(v[:, :-1]), b: v[:, -1].copy()}
        return out, dh.take(place, 0)[:, :-1], g

    def backward(self, x, y, mask, h, keep) -> tuple[np.ndarray, dict, np.ndarray, float]:
        """As ``gradients``, but for the inputs' weights only rows of the symbols that occur, which come third."""
        n, (long, many) = HIDDEN, x.shape
        tape: list = []
        states, last = self.steps(x, h, keep, tape)
        live = np.nonzero(mask.ravel())[0]
        if not len(live):
            return last, {}, live, 0.0
        states, flat = states.reshape(-1, n + 1), y.ravel()
        full = len(live) == len(flat)
        logs, dh, g = self.output(states if full else states[live], flat if full else flat[live], self.heads(), grad=True)
        if not full:
            some = dh
            dh = np.zeros((mask.size, n), last.dtype)
            dh[live] = some
        dall = np.ascontiguousarray(dh.reshape(long, many, n).transpose(0, 2, 1))
        h0, a, z, r, c, starts = tape
        # what a state's gradient is multiplied by, for all steps at once: the candidate's input and the update gate's; then, of the candidate's, the reset gate's and the state's share
        k1, k2, d = (np.empty((long, i, n, many), last.dtype) for i in (2, 2, 4))
        np.subtract(1, z, k1[:, 1])
        np.multiply(1 - c * c, k1[:, 1], k1[:, 0])
        k1[:, 1] *= z
        k1[:, 1] *= h0 - c
        np.subtract(1, r, k2[:, 0])
        k2[:, 0] *= r
        k2[:, 0] *= a
        k2[:, 1] = r
        back, gates, u = np.zeros_like(last), d[:, 1:].reshape(long, 3 * n, many), self.p["u"]
        for t in range(long - 1, -1, -1):
            dt, to = dall[t], d[t]
            np.add(dt, back, dt)
            np.multiply(dt, k1[t], to[:2])
            np.multiply(to[0], k2[t], to[2:])
            np.dot(u, gates[t], back)
            np.multiply(dt, z[t], dt)
            np.add(back, dt, back)
            if starts[t]:
                back *= keep[t]
        gu = np.matmul(h0, gates.transpose(0, 2, 1)).sum(0)
        # sums over the inputs' symbols that occur, numbered as they come
        here = np.bincount(x.ravel(), minlength=len(self.p["emb"])) > 0
        at, rows = (np.cumsum(here) - 1)[x.ravel()], np.nonzero(here)[0]
        ge = d[:, :3].reshape(long, 3 * n, many).transpose(1, 0, 2).reshape(3 * n, -1)
        ge = np.stack([np.bincount(at, ge[i]) for i in (*range(n, 3 * n), *range(n))], 1).astype(last.dtype)
        return last, g | {"u": gu, "b": ge.sum(0), "emb": ge}, rows, float(logs.sum())

    def gradients(self, x, y, mask, h, keep) -> tuple[np.ndarray, dict, float]:
        """State after a window, gradients of its log-likelihood (the state before it is taken as given), and that."""
        last, g, rows, logs = self.backward(x, y, mask, h, keep)
        if g:
            part, g["emb"] = g["emb"], np.zeros_like(self.p["emb"])
            g["emb"][rows] = part
        return last, g, logs

    def train_window(self, x, y, mask, h, keep, opt: dict, rate: float) -> np.ndarray:
        """One truncated backpropagation over a window (AdaGrad); returns the state after it."""
        last, g, rows, _ = self.backward(x, y, mask, h, keep)
        less = max(1, np.count_nonzero(mask)) ** -0.5
        for k, v in g.items():
            v *= less
            at = rows if k == "emb" else slice(None)  # other rows have no gradient
            sums = opt[k][at]
            sums += v * v
            opt[k][at] = sums
            v /= np.sqrt(sums)
            v *= rate
            self.p[k][at] += v
        return last


def lanes(docs: list[np.ndarray], many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (symbol arrays) end to end in lanes of like length: symbols, document numbers (time, lanes), -1 where empty."""
    sizes = np.array([len(d) for d in docs])
    many = int(max(1, min(many, len(docs), -(-sizes.sum() // max(sizes.max(), 1)) * 2)))
    order = np.argsort(-sizes, kind="stable")
    import heapq

    heap = [(0, k) for k in range(many)]
    held: list[list[int]] = [[] for _ in range(many)]
    for d in order:
        used, k = heapq.heappop(heap)
        held[k].append(int(d))
        heapq.heappush(heap, (used + int(sizes[d]), k))
    held.sort(key=lambda ds: -sum(sizes[ds]))
    long = sum(sizes[held[0]])
    sym, doc = np.zeros((long, many), np.int32), np.full((long, many), -1, np.int32)
    lengths = np.zeros(many, int)
    for k, ds in enumerate(held):
        if ds:
            s = np.concatenate([docs[d] for d in ds])
            sym[: len(s), k] = s
            doc[: len(s), k] = np.repeat(ds, sizes[ds])
            lengths[k] = len(s)
    return sym, doc, lengths


def windows(docs: list[np.ndarray], width: int, many: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of lanes (without a width: of about WINDOW_TOKENS symbols each): inputs, targets, documents, keep (0 at a document's first symbol), lanes in use (always the first ones)."""
    sym, doc, lengths = lanes(docs, many)
    first = np.ones(sym.shape, bool)
    first[1:] = doc[1:] != doc[:-1]
    before = np.zeros_like(sym)
    before[1:] = sym[:-1]
    before[first] = 0  # a document starts after an end
    t = 0
    while t < len(sym):
        use = int((lengths > t).sum())
        w = slice(t, t + (width or max(1, WINDOW_TOKENS // use)))
        t = w.stop
        yield before[w, :use], sym[w, :use], doc[w, :use], (~first[w, :use]).astype(np.float32), use


def score_documents(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each symbol sequence; state goes across windows, memory is one window's."""
    out, heads = np.zeros(len(docs)), net.heads()
    h = np.zeros((HIDDEN, LANES), np.float32)
    for x, y, doc, keep, use in windows(docs, 0, LANES):
        states, h = net.steps(x, h[:, :use], keep)
        live = doc.ravel() >= 0
        out += np.bincount(doc.ravel()[live], net.output(states.reshape(-1, HIDDEN + 1)[live], y.ravel()[live], heads), len(docs))
    return out


def train_documents(net: Network, docs: list[np.ndarray], opt: dict, rate: float = RATE) -> None:
    """Learn from whole documents side by side; state goes across windows, and a window's step is in proportion to its symbols."""
    many = int(min(LANES, max(16, sum(map(len, docs)) // TRAIN_STEPS)))
    h = np.zeros((HIDDEN, many), net.p["u"].dtype)
    for x, y, doc, keep, use in windows(docs, WINDOW, many):
        mask = doc >= 0
        h = net.train_window(x, y, mask, h[:, :use], keep, opt, rate * np.count_nonzero(mask) / (many * WINDOW))


def fresh_opt(net: Network) -> dict:
    return {k: np.full_like(v, START) for k, v in net.p.items()}


def raw_bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def merged_sums(sums: np.ndarray, most: int, turns: int = 6) -> np.ndarray:
    """At most ``most`` sums of the rows of ``sums`` (each a sum of unit vectors) that point alike, by spherical k-means; nothing is left out but zeros."""
    size = np.linalg.norm(sums, axis=1)
    sums, size = sums[size > 0], size[size > 0]
    if len(sums) <= most:
        return sums
    x, rough = (sums / size[:, None]).astype(np.float32), sums.astype(np.float32)  # enough to tell directions apart
    c = x[np.linspace(0, len(x) - 1, most).astype(int)]
    for _ in range(turns):
        cells = np.argmax(x @ c.T, 1)[None, :] == np.arange(most)[:, None]
        got = cells.astype(np.float32) @ rough
        norm = np.linalg.norm(got, axis=1, keepdims=True)
        c = np.where(norm > 0, got / np.where(norm > 0, norm, 1), c)
    return cells[cells.any(1)].astype(sums.dtype) @ sums


def letter_sums(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(i, v binary): sums of the letter shares of all rows of the single text column, documents with like shares in one sum; SUMS rows a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 256))
        for b in batches:
            for k in range(0, len(b), SUMMED):
                held = np.concatenate([held, shares_of(b.column(0)[k : k + SUMMED])])
                if len(held) > SUMMED:
                    held = merged_sums(held, SUMS)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in merged_sums(held, SUMS)], pa.binary())], names=["v"])

    return scratch.stash(through(texts, run, "v binary").select(F.spark_partition_id().cast("long").alias("i"), "v"))


def fit_groups(learn: DataFrame, text_col: str, scratch: Scratch) -> np.ndarray:
    """Centres (groups, 256) of the letter shares of all learning documents: tasks sum up documents that are alike, FAN tasks' sums are merged at a time on executors until FAN are left, and k-means of those gives the centres."""
    vectors = lambda raw: np.array([np.frombuffer(v, np.float64) for v in sorted(raw)]).reshape(-1, 256)

    def merge(table: pa.Table) -> pa.Table:
        out = merged_sums(vectors(table.column("v").to_pylist()), SUMS)
        return pa.table({"i": pa.array([table.column("i")[0].as_py()] * len(out), pa.int64()), "v": pa.array([v.tobytes() for v in out], pa.binary())})

    sums = letter_sums(learn.select(F.col(text_col).alias("text")), scratch)
    while sums.count() > FAN * SUMS:
        sums = scratch.stash(sums.withColumn("i", F.floor(F.col("i") / FAN)).groupBy("i").applyInArrow(merge, "i long, v binary"))
    got = merged_sums(vectors([bytes(r["v"]) for r in sums.collect()]), GROUPS, 12)  # FAN x SUMS rows of 2 KB at most
    return (got / np.linalg.norm(got, axis=1, keepdims=True)).astype(np.float32) if len(got) else np.zeros((1, 256), np.float32)


def count_words(texts: DataFrame, centres: np.ndarray) -> DataFrame:
    """(word binary, c, g) over all rows of the single text column: its count, and the group of documents that uses it most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = [[] for _ in range(len(centres))]
        many = 0

        def out() -> Iterator[pa.RecordBatch]:
            for g, parts in enumerate(held):
                if parts:
                    seen = pc.value_counts(pa.chunked_array(parts))
                    yield pa.RecordBatch.from_arrays([seen.field(0), pa.array(np.full(len(seen), g, np.int32)), seen.field(1)], names=["word", "g", "c"])
                parts.clear()

        for b in batches:
            group = np.argmax(shares_of(b.column(0)) @ centres.T, 1)
            order = np.argsort(group, kind="stable")  # so that a group's words lie together
            words, row = words_of(b.column(0).take(pa.array(order)))
            ends = np.searchsorted(group[order][row], np.arange(len(centres) + 1)).tolist()
            for g in range(len(centres)):
                if ends[g] < ends[g + 1]:
                    held[g].append(words[ends[g] : ends[g + 1]])
            many += len(words)
            if many >= BATCH_TOKENS:
                yield from out()
                many = 0
        yield from out()

    found = through(texts, run, "word binary, g int, c long")
    per = found.repartition("word").groupBy("word", "g").agg(F.sum("c").alias("c"))  # one shuffle serves both sums
    # count and group in one number, whose maximum needs no sort
    return per.groupBy("word").agg(F.sum("c").alias("c"), F.pmod(F.max(F.col("c") * GROUPS + F.col("g")), F.lit(GROUPS)).cast("int").alias("g"))


class Encoded:
    """Texts as symbols: ``docs`` (each with its end), and of all words in order the row and the place in the head (-1 beyond); of those beyond the word, row and group."""

    def __init__(self, voc: Vocabulary, texts: pa.Array):
        words, self.row = words_of(texts)
        found = pc.index_in(words, value_set=voc.words)
        self.at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
        self.beyond = words.filter(pc.is_null(found))
        out = np.nonzero(self.at < 0)[0]
        self.beyond_row, self.groups = self.row[out], voc.groups_beyond(self.beyond)
        symbol = voc.symbol[self.at]
        symbol[out] = 1 + voc.own + GROUPS + self.groups
        flat = np.zeros(len(words) + len(texts), np.int32)
        flat[np.arange(len(words)) + self.row] = symbol  # a 0 is left behind each row
        self.sizes = np.bincount(self.row, minlength=len(texts)) + 1
        self.docs = np.split(flat, np.cumsum(self.sizes)[:-1]) if len(texts) else []


def averaged(trained: DataFrame, scratch: Scratch) -> tuple[dict | None, int]:
    """Mean parameters, weighted by n, of the rows (i, n, p), and the sum of n; FAN sets at a time are averaged on executors until FAN are left."""

    def mean(rows) -> tuple[dict, int]:
        total, out = 0, None
        for n, p in rows:
            p = pickle.loads(p)
            out = {k: v * np.float64(n) if out is None else out[k] + v * np.float64(n) for k, v in p.items()}
            total += n
        return {k: (v / total).astype(np.float32) for k, v in out.items()} if total else {}, total

    def merge(table: pa.Table) -> pa.Table:
        p, n = mean(zip(table.column("n").to_pylist(), table.column("p").to_pylist(), strict=True))
        return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "p": pa.array([pickle.dumps(p, protocol=5)], pa.binary())})

    while trained.count() > FAN:
        trained = scratch.stash(trained.withColumn("i", F.floor(F.col("i") / FAN)).groupBy("i").applyInArrow(merge, "i long, n long, p binary"))
    p, n = mean((r["n"], bytes(r["p"])) for r in trained.orderBy("i").toLocalIterator())
    return (p or None), n


def train_network(net: Network, learn: DataFrame, id_col: str, text_col: str, tokens: int, scratch: Scratch) -> list[int]:
    """Train on the learning documents, which have so many tokens, each of them in one of TURNS turns; returns the tokens that each turn learnt from.

    Each partition of the input trains a copy; partitions of few tokens are put together.
    """
    spark, voc, seen = learn.sparkSession, net.voc, []
    turn_of = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("turn")), F.lit(TURNS))
    for turn in range(TURNS):
        now = spark.sparkContext.broadcast(pickle.dumps((voc, net.p), protocol=5))

        def train(batches: Iterator[pa.RecordBatch], now=now, rate=RATE / 2**turn) -> Iterator[pa.RecordBatch]:
            voc, p = pickle.loads(now.value)
            own = Network(voc)
            own.p = {k: v.copy() for k, v in p.items()}
            opt, n, held, docs = fresh_opt(own), 0, 0, []
            for b in batches:
                docs += Encoded(voc, b.column(0)).docs
                held = sum(map(len, docs))
                if held >= BATCH_TOKENS:
                    train_documents(own, docs, opt, rate)
                    n, held, docs = n + held, 0, []
            if docs:
                train_documents(own, docs, opt, rate)
            yield pa.RecordBatch.from_arrays([pa.array([n + held], pa.int64()), pa.array([pickle.dumps(own.p, protocol=5)], pa.binary())], names=["n", "p"])

        part = learn.where(turn_of == turn).select(F.col(text_col).alias("text")).coalesce(max(1, tokens // TURNS // COPY_TOKENS))
        trained = scratch.stash(through(part, train, "n long, p binary").where("n > 0").select(F.spark_partition_id().cast("long").alias("i"), "n", "p"))
        p, n = averaged(trained, scratch)
        net.p = p or net.p
        seen.append(n)
        now.unpersist()
    return seen


def head_and_rest(counts: DataFrame) -> tuple[list[tuple[bytes, int, int]], DataFrame]:
    """The HEAD most frequent words (word, count, group) or somewhat fewer, as one bound on counts parts them from the rest."""
    octave = F.floor(8 * F.log2("c")).cast("int")
    sizes = counts.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).orderBy(F.desc("o")).collect()  # at most 8 x 63 rows
    bound, total = 1 << 30, 0
    for r in sizes:
        total += r["n"]
        if total > HEAD:
            break
        bound = r["o"]
    head = [(bytes(r["word"]), r["c"], r["g"]) for r in counts.where(octave >= bound).collect()]  # HEAD rows at most
    return sorted(head, key=lambda x: (-x[1], x[0])), counts.where(octave < bound)


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Documents whose crc32(id as text) modulo ``folds`` is ``fold`` are held out; a null
    id counts as empty text. base_score is the add-one unigram log10 probability, score
    the recurrent model's; both include the end. A null or empty text is one end. Where
    nothing can be learnt all counts are 0 and base and model fall back to log10(1) for
    the one unseen symbol. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        held = crc_mod(F.col(id_col), folds) == fold
        learn = docs.where(~held)
        n_docs = learn.count()
        centres = fit_groups(learn, text_col, scratch)
        counts = scratch.stash(count_words(learn.select(F.col(text_col).alias("text")), centres))
        sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        total, distinct = (sums["n"] or 0) + n_docs, sums["v"] + (n_docs > 0)
        head, rest = head_and_rest(counts)
        last2 = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
        per = rest.groupBy(last2.alias("e"), "g").agg(F.sum(F.col("c") + 1).alias("m")).groupBy("e").agg(F.sum("m").alias("m"), F.max_by("g", F.struct("m", "g")).alias("g"))
        endings = {bytes(r["e"]): (r["m"], r["g"]) for r in per.collect()}  # at most 2**16 pairs of bytes
        net = Network(Vocabulary(head, n_docs, endings))
        train_network(net, learn, id_col, text_col, total, scratch)
        return scratch.finish(scored_documents(docs, net, rest, held, id_col, text_col, (n_docs, total, distinct), scratch))


def scored_documents(docs: DataFrame, net: Network, rest: DataFrame, held, id_col: str, text_col: str, sums: tuple[int, int, int], scratch: Scratch) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps((net.voc, net.p), protocol=5))
    n_docs, total, distinct = sums
    norm = float(np.log10(max(total + distinct + 1, 1)))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, p = pickle.loads(model.value)
        own = Network(voc)
        own.p = p
        head_base = np.append(np.log10(voc.count + 1.0), 0.0)  # the last place is for words beyond
        within = np.append(voc.within, 0.0)
        beyond_base = -np.log10(voc.beyond)
        held: list[tuple[pa.RecordBatch, Encoded]] = []

        def scored() -> Iterator[pa.RecordBatch]:
            logs = score_documents(own, [d for _, e in held for d in e.docs]) / np.log(10)
            for b, e in held:
                many, (here, logs) = len(b), (logs[: len(b)], logs[len(b) :])
                total = lambda at, v: np.bincount(at, v, many)  # noqa: B023, E731
                base = total(e.row, head_base[e.at]) + np.log10(n_docs + 1.0) - e.sizes * norm
                here = here + total(e.row, within[e.at]) + total(e.beyond_row, beyond_base[e.groups])
                known = total(e.row, e.at >= 0).astype(np.int64) + (n_docs > 0)
                ends = np.concatenate([[0], np.cumsum(np.bincount(e.beyond_row, minlength=many))]).astype(np.int32)
                cols = [pa.array(e.sizes, pa.int64()), pa.array(known), pa.array(base), pa.array(here), pa.ListArray.from_arrays(pa.array(ends), e.beyond)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["id", "held_out", "n", "known", "base", "score", "beyond"])
            held.clear()

        waiting = 0
        for b in batches:
            if len(b):
                held.append((b, Encoded(voc, b.column(2))))
                waiting += int(held[-1][1].sizes.sum())
            if waiting >= BATCH_TOKENS:
                yield from scored()
                waiting = 0
        if held:
            yield from scored()

    out = through(docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text")), score, f"id {kind}, held_out boolean, n long, known long, base double, score double, beyond array<binary>")
    out = scratch.stash(out.withColumn("row", F.monotonically_increasing_id()))
    # words beyond the head: their counts come by a join; none of them is frequent
    words = out.select("row", F.explode("beyond").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    more = words.join(rest, "word").groupBy("row").agg(F.sum("k").alias("known2"), F.sum(F.col("k") * F.log10(F.col("c") + F.lit(1.0))).alias("more"))
    out = out.drop("beyond").join(more, "row", "left")
    plus = F.coalesce("more", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + plus).alias("base_score"), (F.col("score") + plus).alias("score"))
