"""Personal data: a semi-Markov conditional random field over candidate segments.

Base patterns find clear cases; their matches train the field and always stay.
The field looks at regions of text that hold digits or an at sign, between the
base matches. Whole-span features (shape, digit groups, checksum, neighbours)
score every candidate segment and each kind, and dynamic programming chooses
boundaries and kinds jointly. A segment is added if its posterior probability is
high. Segments are bounded, so a region is worked through in blocks of places
and memory holds one block and a few numbers a place, however long it is.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Scratch, picked, through

KINDS = ("email", "ip", "card", "phone")
#: Atoms in a segment at most; features; what posterior adds a segment.
LONGEST, FEATURES, SURE = 24, 1 << 12, 0.9
#: Characters of a segment; digits and runs of them in a segment without an at sign; places that a block begins at; blocks kept between passes.
LEAST_CHARS, MOST_CHARS, LEAST_DIGITS, MOST_DIGITS, MOST_RUNS, BLOCK, KEPT = 7, 80, 4, 20, 6, 512, 16
#: Documents that examples are taken from, about; examples with and without base spans, about.
FIT_DOCS, FIT_WITH, FIT_WITHOUT = 6000, 500, 700
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole: no shorter part of one can match where the whole does not.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TRIGGER = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As finditer of the email pattern, in linear time: only a run that ends at an at sign can match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' valid matches, by kind and start."""
    if not TRIGGER.search(text):
        return []
    out = [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


#: Parts of a region: runs of letters and digits, and single other characters.
ATOM = re.compile(r"[^\W_]+|.", re.S)
RUNS = re.compile(r"[a-z]+|[0-9]+")
NUMBER = re.compile("[0-9]+")


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring words with a digit or at sign (in linear time, word by word)."""
    start, end = -1, -1
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if TRIGGER.search(text, m.start(), m.end()):
            if start >= 0 and m.start() == end + 1 and text[end] == " ":
                end = m.end()
                continue
            if start >= 0:
                yield start, end
            start, end = m.span()
        elif start >= 0:
            yield start, end
            start = -1
    if start >= 0:
        yield start, end


def stretches(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The regions without the spans taken (sorted by start), one pass over both."""
    k = 0
    for lo, hi in regions(text):
        while lo < hi:
            while k < len(taken) and taken[k][1] <= lo:
                k += 1
            at = min(hi, taken[k][0]) if k < len(taken) else hi
            if at - lo >= LEAST_CHARS and TRIGGER.search(text, lo, at):
                yield lo, at
            lo = hi if at == hi else max(lo, taken[k][1])


def side(c: str) -> str:
    return "b" if c in ("", " ", "\n", "\t") else "d" if c.isdigit() else "a" if c.isalpha() else "p" if c in ".,;:)]'\"" else c


def bucket(n: int, most: int = 20) -> int:
    return n if n < 12 else min(most, 12 + (n - 12) // 2)


#: Features of a span.
N_FEATURES = 16


@functools.lru_cache(maxsize=1 << 16)
def feature(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES


@functools.lru_cache(maxsize=1 << 14)
def span_features(s: str, left: str, right: str) -> list[int]:
    """Hashed features of a whole span and its neighbours."""
    groups = NUMBER.findall(s)
    digits = "".join(groups)
    shape = RUNS.sub(lambda m: "9" if m[0][0].isdigit() else "a", s.lower())
    letters = sum(map(str.isalpha, s))
    names = [
        "bias", f"nd{bucket(len(digits))}", f"ng{min(len(groups), 7)}", f"sh{shape[:18]}", f"at{min(s.count('@'), 2)}", f"first{side(s[0]) if s[0] not in '+(' else s[0]}", f"last{side(s[-1])}",
        f"luhn{13 <= len(digits) <= 19 and luhn(digits)}", f"oct{len(groups) == 4 and s.count('.') == 3 and not letters and all(len(g) < 4 and int(g) < 256 for g in groups)}",
        f"let{min(letters, 3)}", f"len{bucket(len(s))}", f"l{side(left)}", f"r{side(right)}", f"lr{side(left)}{side(right)}", "gl" + "-".join(str(min(len(g), 9)) for g in groups[:6]), f"dots{min(s.count('.'), 4)}{'@' in s}",
    ]
    return [feature(x) for x in names]


def plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


Segment = tuple[int, int]


class Lattice:
    """The places of text[lo:hi] and its candidate segments, block by block.

    A segment begins at a run of letters and digits, a plus or a bracket, ends with
    such a run, and holds an at sign or else LEAST_DIGITS to MOST_DIGITS digits, in
    MOST_RUNS runs at most, and few letters.
    """

    def __init__(self, text: str, lo: int = 0, hi: int | None = None):
        hi = len(text) if hi is None else hi
        self.text, self.at = text, [lo, *(m.end() for m in ATOM.finditer(text, lo, hi))]
        self.n = len(self.at) - 1
        self.kept: dict[int, tuple[list[Segment], np.ndarray]] = {}

    def block(self, first: int) -> tuple[list[Segment], np.ndarray]:
        """Segments that begin at places first..first + BLOCK - 1, in order, and their features."""
        if first in self.kept:
            return self.kept[first]
        text, at = self.text, self.at
        upto = min(self.n, first + BLOCK + LONGEST)
        digits, letters, signs, runs = [0], [0], [0], [0]  # up to each place
        for i in range(first, upto):
            x = text[at[i] : min(at[i + 1], at[i] + MOST_CHARS + 1)]
            d = len(x) if x.isdecimal() else 0 if x.isalpha() or not x.isalnum() else sum(map(str.isdecimal, x))
            digits.append(digits[-1] + d)
            runs.append(runs[-1] + (d > 0))
            letters.append(letters[-1] + (len(x) - d if d < len(x) and x.isalnum() else 0))
            signs.append(signs[-1] + (x == "@"))
        found, features = [], []
        for i in range(first, min(self.n, first + BLOCK)):
            a = at[i]
            if not (text[a].isalnum() or text[a] in "+("):
                continue
            x = i - first
            for j in range(i + 1, min(self.n, i + LONGEST) + 1):
                b, y = at[j], j - first
                if b - a > MOST_CHARS:
                    break
                if b - a < LEAST_CHARS or not text[b - 1].isalnum():
                    continue
                if signs[y] == signs[x] and not (LEAST_DIGITS <= digits[y] - digits[x] <= MOST_DIGITS and runs[y] - runs[x] <= MOST_RUNS and letters[y] - letters[x] <= 4):
                    continue
                found.append((i, j))
                features.append(span_features(text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]))
        out = found, np.array(features, np.int32).reshape(len(features), N_FEATURES)
        if len(self.kept) < KEPT:
            self.kept[first] = out
        return out

    def forward(self, w: np.ndarray) -> tuple[list[float], list[tuple[Segment, int, float]]]:
        """Log sums of all segmentations up to each place (an atom outside all segments scores 0), and the best one as (segment, kind, score)."""
        n = self.n
        f, top = [0.0] * (n + 1), [0.0] * (n + 1)
        ending, best = {}, {}
        back: list = [None] * (n + 1)
        for first in range(0, n + 1, BLOCK):
            segments, features = self.block(first)
            s = scored(w, features)
            sums, kinds = np.logaddexp.reduce(s, 1).tolist() if len(s) else [], s.argmax(1).tolist() if len(s) else []
            k = 0
            for i in range(first, min(n + 1, first + BLOCK)):
                if i:
                    f[i], top[i] = plus(f[i - 1], ending.pop(i, -math.inf)), top[i - 1]
                    value, told = best.pop(i, (-math.inf, None))
                    if value > top[i]:
                        top[i], back[i] = value, told
                while k < len(segments) and segments[k][0] == i:
                    j, score = segments[k][1], float(s[k, kinds[k]])
                    ending[j] = plus(ending.get(j, -math.inf), f[i] + sums[k])
                    if top[i] + score > best.get(j, (-math.inf,))[0]:
                        best[j] = top[i] + score, (segments[k], kinds[k], score)
                    k += 1
        chosen, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                chosen.append(back[j])
                j = back[j][0][0]
        return f, chosen[::-1]

    def backward(self, w: np.ndarray) -> list[float]:
        """Log sums of all segmentations from each place on."""
        n = self.n
        b = [0.0] * (n + 1)
        for first in reversed(range(0, n, BLOCK)):
            segments, features = self.block(first)
            sums = np.logaddexp.reduce(scored(w, features), 1).tolist() if segments else []
            k = len(segments) - 1
            for i in range(min(n, first + BLOCK) - 1, first - 1, -1):
                b[i] = b[i + 1]
                while k >= 0 and segments[k][0] == i:
                    b[i] = plus(b[i], b[segments[k][1]] + sums[k])
                    k -= 1
        return b

    def spans(self, w: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(start, end, kind, posterior) of the best segmentation's segments."""
        f, chosen = self.forward(w)
        if not chosen:
            return []
        b = self.backward(w)
        return [(self.at[i], self.at[j], kind, math.exp(min(0.0, f[i] + score + b[j] - f[-1]))) for (i, j), kind, score in chosen]


def scored(w: np.ndarray, features: np.ndarray) -> np.ndarray:
    """(segments, kinds)"""
    return w[:, features].sum(-1).T if len(features) else np.zeros((0, len(w)))


def posteriors(lat: Lattice, w: np.ndarray) -> np.ndarray:
    """(segments, kinds) of a lattice of one block."""
    segments, features = lat.block(0)
    f, b = np.array(lat.forward(w)[0]), np.array(lat.backward(w))
    i, j = (np.array(x, int) for x in zip(*segments, strict=True)) if segments else (np.zeros(0, int),) * 2
    return np.exp(f[i][:, None] + scored(w, features) + b[j][:, None] - f[-1])


Spans = list[tuple[str, int, int]]


def fit_field(examples: list[tuple[str, Spans]], turns: int = 4, rate: float = 0.3, l2: float = 1e-4) -> np.ndarray:
    """Weights (kinds, features) by AdaGrad on the conditional log-likelihood; examples are shorter than a block."""
    w, g2 = np.zeros((len(KINDS), FEATURES)), np.full((len(KINDS), FEATURES), 1e-6)
    built = []
    for text, spans in examples:
        lat = Lattice(text)
        segments, features = lat.block(0)
        if lat.n >= BLOCK or not segments:
            continue
        at = {(lat.at[i], lat.at[j]): s for s, (i, j) in enumerate(segments)}
        gold = np.zeros((len(segments), len(KINDS)))
        for kind, a, b in spans:
            if (a, b) in at:
                gold[at[a, b], KINDS.index(kind)] = 1
        built.append((lat, features, gold))
    order = np.random.default_rng(11)
    for _ in range(turns):
        for e in order.permutation(len(built)):
            lat, features, gold = built[e]
            miss = gold - posteriors(lat, w)
            rows = np.abs(miss).max(1) > 1e-4
            if not rows.any():
                continue
            f = features[rows]
            used = np.unique(f)
            for k in range(len(KINDS)):
                grad = np.zeros(FEATURES)
                np.add.at(grad, f, miss[rows, k][:, None])
                grad = grad[used] - l2 * w[k, used]
                g2[k, used] += grad * grad
                w[k, used] += rate * grad / np.sqrt(g2[k, used])
    return w


def variants(region: str, spans: Spans) -> Iterator[tuple[str, Spans]]:
    """Other ways to write a region's only span, and near misses that are none; the same ones for the same region."""
    if len(spans) != 1:
        return
    kind, a, b = spans[0]
    said = region[a:b]
    groups = NUMBER.findall(said)
    rng = random.Random(region)
    put = lambda new, real: (region[:a] + new + region[b:], [(kind, a, a + len(new))] if real else [])
    if kind == "phone" and len(groups) >= 4 and len(groups[0]) <= 3:
        own = groups[1:]
        for new in (f"({own[0]}) " + "-".join(own[1:]), "-".join(own), ".".join(own), " ".join(own), "-".join(groups), f"{groups[0]} ({own[0]}) " + "-".join(own[1:])):
            yield put(new, True)
        yield put("-".join(own[:2]), False)
        yield put(f"{own[0]}-{own[1]}-{own[2]}{own[2]}-{own[0]}", False)
    if kind == "card":
        digits = "".join(groups)
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        yield put(".".join(fours), True)
        yield put("_".join(fours), True)
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        yield put(wrong, False)
        yield put(" ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), False)
        yield put(".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), False)
    if kind == "ip":
        yield put("[.]".join(groups), True)
        yield put(".".join([*groups[:2], str(rng.randint(256, 999)), groups[3]]), False)
        yield put(".".join(groups[:3]), False)
        yield put(".".join([*groups, groups[0]]), False)
    if kind == "email" and said.count("@") == 1:
        name, _, host = said.partition("@")
        yield put(f"{name}@{host.replace('.', '[.]')}", True)
        yield put(f"@{name}", False)


def plain_numbers(seed: int) -> Iterator[tuple[str, Spans]]:
    """Dates, times, amounts and versions, which are none of the kinds."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choices("123456789", k=n))
    for text in (f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}/0{d(1)}/20{d(2)}", f"1{d(1)}.0{d(1)}.20{d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)} 1{d(1)}:2{d(1)}:3{d(1)}", f"{d(1)},{d(3)},{d(3)}.{d(2)}", f"{d(1)}.{d(3)}.{d(3)},{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(9)}", f"{d(12)}", f"{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)} {d(3)}", f"{d(6)}.{d(6)}"):
        yield text, []


def learning_examples(docs: DataFrame, id_col: str, text_col: str) -> list[tuple[str, Spans]]:
    """Distinct regions of about FIT_DOCS documents picked by hash, about FIT_WITH with base spans and FIT_WITHOUT without, and their variants."""
    n = docs.count()
    if not n:
        return []
    part = docs.where(picked(FIT_DOCS / n, F.col(id_col).cast("string"), F.col(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for text in b.column(0):
                text = text.as_py() or ""
                spans = sorted((s, e, k) for k, s, e in base_spans(text))
                first = 0
                for start, end in regions(text):
                    while first < len(spans) and spans[first][1] <= start:
                        first += 1
                    if end - start > 200:
                        continue
                    mine, i = [], first
                    while i < len(spans) and spans[i][0] < end:
                        s, e, k = spans[i]
                        if start <= s and e <= end:
                            mine.append((k, s - start, e - start))
                        i += 1
                    # a card's digits may also be part of another kind: the longest span counts
                    mine = [x for x in mine if not any(y != x and y[1] <= x[1] and x[2] <= y[2] for y in mine)]
                    out.add((text[start:end], ",".join(f"{k}:{s}:{e}" for k, s, e in mine)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["region", "spans"])

    out = []
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.stash(through(part.select(text_col), run, "region string, spans string").distinct())
        for some, most in ((F.col("spans") != "", FIT_WITH), (F.col("spans") == "", FIT_WITHOUT)):
            rows = found.where(some)
            for region, spans in sorted(rows.where(picked(most / max(1, rows.count()), "region", "spans")).collect()):  # about ``most`` regions of 200 characters
                mine = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]
                out += [(region, mine), *variants(region, mine)]
    return out + [x for seed in range(20) for x in plain_numbers(seed)] if out else []


def field_spans(text: str, base: Spans, w: np.ndarray) -> Spans:
    """Base spans and what the field adds beside them."""
    out = list(base)
    for lo, hi in stretches(text, sorted((s, e) for _, s, e in base)):
        out += [(KINDS[kind], s, e) for s, e, kind, p in Lattice(text, lo, hi).spans(w) if p >= SURE]
    out.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return out


def said(spans: Spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: Spans) -> str:
    """The text with each span (overlaps merged) replaced by its kind in angle brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, redact: bool = False) -> DataFrame:
    """Spans of personal data in each whole text.

    Returns ``keep`` (``id_col`` unless given), n_email, n_ip, n_card, n_phone (base
    spans), base_sha256, spans (``kind:start:end``, code points) and n_spans (base and
    added ones); with ``redact`` also redacted, the text with spans replaced by
    ``<kind>`` (null stays null). A null text counts as empty. Repeated rows give
    repeated results. The field is fitted on about FIT_WITH + FIT_WITHOUT regions,
    see :func:`learning_examples`; without any, it adds nothing.
    """
    keep = keep or (id_col,)
    weights = docs.sparkSession.sparkContext.broadcast(fit_field(learning_examples(docs, id_col, text_col)))  # KINDS x FEATURES numbers
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    sent = [*keep, *([] if text_col in keep else [text_col])]  # the text goes to Python once
    k, at = len(keep), sent.index(text_col)
    names = [*keep, *(f"n_{x}" for x in KINDS), "base_sha256", "spans", "n_spans", *(["redacted"] if redact else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            rows, texts = [], []
            for raw in b.column(at):
                text = raw.as_py()
                base = base_spans(text or "")
                spans = field_spans(text, base, w) if text and TRIGGER.search(text) else base
                rows.append((*(sum(x[0] == kind for x in base) for kind in KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(spans), len(spans)))
                if redact:
                    texts.append(redacted(text, spans) if text and spans else text)
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(KINDS) + 3)
            types = [*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *map(pa.array, cols, types), *([pa.array(texts, pa.string())] if redact else [])], names=names)

    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in keep), *(f"n_{x} long" for x in KINDS), "base_sha256 string, spans string, n_spans long", *(["redacted string"] if redact else [])])
    return through(docs.select(*(F.col(f"`{x}`") for x in sent)), run, schema)
