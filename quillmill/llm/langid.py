"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all learning documents. The classifier is fitted
by follow-the-regularised-leader with elastic-net penalties on a bounded sample
per language (``fit_rows``), and one temperature is then fitted on a held part
of that sample, so that the score is a calibrated probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import crc_mod, picked, through

#: Hashed features (2**BUCKET_BITS); a language costs 8 bytes of each in every worker.
BUCKET_BITS = 13
#: Characters hashed at a time, so that memory does not follow the longest text.
STEP = 1 << 18
K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of the lower-cased whole text."""
    size = 1 << BUCKET_BITS
    out = np.zeros(size, np.int64)
    low = text.lower()
    for at in range(0, len(low), STEP):
        c = np.frombuffer(low[max(0, at - 2) : at + STEP].encode("utf-32-le", "surrogatepass"), np.uint32)
        new = min(2, at)  # letters that were there before
        h = c * K[0]
        for n in range(1, 4):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * K[n - 1] + c[n - 1 :] * K[0]
            part = h[max(0, new - n + 1) :]
            g = (part ^ (part >> np.uint32(16))) * np.uint32(0x7FEB352D)
            out += np.bincount((g >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), minlength=size)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def weighed(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and unit-length values of a document's TF-IDF vector."""
    i = np.nonzero(counts)[0]
    v = np.log1p(counts[i]) * idf[i]
    norm = np.sqrt((v * v).sum())
    return i, v / norm if norm > 0 else v


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, size: int, turns: int = 3, alpha: float = 0.5, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> np.ndarray:
    """Weights (size, k) of a multinomial model by FTRL-proximal with elastic net."""
    z, n, w = (np.zeros((size, k)) for _ in range(3))
    order = np.random.default_rng(seed)
    for _ in range(turns):
        for r in order.permutation(len(rows)):
            i, v = rows[r]
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((0.1 + np.sqrt(ni)) / alpha + l2))
            p = softmax(v @ wi)
            p[y[r]] -= 1
            g = v[:, None] * p
            n[i] = ni + g * g
            z[i] = zi + g - (np.sqrt(n[i]) - np.sqrt(ni)) / alpha * wi
    np.copyto(w, np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((0.1 + np.sqrt(n)) / alpha + l2)))
    return w


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    Targets are (n + 1) / (n + 2) rather than 1, so that n right answers do not give certainty.
    """
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + 2) / max(k - 1, 1))
    target[np.arange(n), y] = (n + 1) / (n + 2)
    loss = lambda u: -(target * np.log(np.maximum(softmax(logits / np.exp(u)), 1e-300))).sum(1).mean()
    lo, hi, r = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class LanguageModel:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        i, v = weighed(ngram_counts(text), self.idf)
        p = softmax(v @ self.weights[i] / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def fit_language_model(learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 600) -> LanguageModel:
    """Learn from the rows of ``learn`` with a language; about ``fit_rows`` distinct rows of each are fitted on.

    Rows are picked by a hash of id and text, so that neither a repeated nor a null id
    decides for many documents. The driver holds a row per language and the sample.
    """
    size = 1 << BUCKET_BITS
    learn = learn.where(F.col(lang_col).isNotNull())
    per = {r["lang"]: r["n"] for r in learn.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return LanguageModel([], np.ones(size), np.zeros((size, 0)), 1.0)
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in per.items() for x in (k, min(1.0, fit_rows / n))]), F.col(lang_col))
    r = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    taken = F.pmod(F.xxhash64(r, F.lit("fit")), F.lit(1 << 40)) < rate * (1 << 40)
    cols = learn.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), taken.alias("taken"), r.alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the sample (lang set), then this task's document frequencies."""
        df, docs = np.zeros(size, np.int64), 0
        names = ["lang", "r", "raw_i", "raw_c", "i", "c"]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for b in batches:
            rows = []
            for text, lang, hit, r in zip(*(b.column(k) for k in range(4)), strict=True):
                text = text.as_py()
                if not has_letter(text):
                    continue
                c = ngram_counts(text)
                i = np.nonzero(c)[0]
                df[i] += 1
                docs += 1
                if hit.as_py():
                    rows.append((lang.as_py(), r.as_py(), i.astype(np.int32).tobytes(), c[i].astype(np.int32).tobytes(), None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        i = np.nonzero(df)[0].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, docs, None, None, i, df[i]), kinds, strict=True)], names=names)

    seen = through(cols, run, "lang string, r long, raw_i binary, raw_c binary, i array<int>, c array<long>").persist()
    counts = seen.where("lang is null")
    total = counts.agg(F.sum("r")).first()[0] or 0
    df = np.zeros(size)
    for i, n in counts.select(F.explode(F.arrays_zip("i", "c")).alias("x")).groupBy("x.i").agg(F.sum("x.c")).collect():
        df[i] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = sorted(seen.where("lang is not null").select("lang", "r", "raw_i", "raw_c").dropDuplicates(["lang", "r"]).collect(), key=lambda r: (r["r"], r["lang"], bytes(r["raw_i"])))
    seen.unpersist()
    rows = [(i := np.frombuffer(r["raw_i"], np.int32), weighed_values(np.frombuffer(r["raw_c"], np.int32), idf[i])) for r in sample]
    y = np.array([langs.index(r["lang"]) for r in sample], int)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    w = fit_ftrl([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(langs), size)
    logits = np.array([v @ w[i] for (i, v), h in zip(rows, held, strict=True) if h])
    return LanguageModel(langs, idf, w, fit_temperature(logits, y[held]) if len(logits) else 1.0)


def weighed_values(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum())
    return v / norm if norm > 0 else v


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of each whole text; one narrow pass.

    lang_pred is a learnt language, or ``und`` with score 0 where the text is null or
    has no letter (or nothing was learnt). Repeated rows give repeated results.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    model = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS rows of one number per language
    sent = [*keep, *([] if text_col in keep else [text_col])]  # the text goes to Python once
    keep_n, at = len(keep), sent.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns[:keep_n], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    return through(docs.select(*(F.col(f"`{k}`") for k in sent)), run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string", "score double"]))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, fit_rows: int = 600) -> DataFrame:
    """``id_col``, held_out, lang_pred, score of every document.

    Documents whose crc32(id as text) modulo ``folds`` is ``fold`` are held out: nothing
    is learnt from them. A null id counts as empty text, a null language teaches
    nothing; an empty table gives an empty result.
    """
    held = crc_mod(F.col(id_col), folds) == fold
    model = fit_language_model(docs.where(~held), id_col, text_col, lang_col, fit_rows)
    marked = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).alias("text"))
    return predict_languages(marked, model, "text", (id_col, "held_out"))
