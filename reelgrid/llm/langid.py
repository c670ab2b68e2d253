"""Language ID: averaged hashed subword embeddings under a linear softmax, trained in numpy.

A text is lower-cased, every run of non-letters becomes one word boundary, and all of its
runs of 2 to 4 characters that lie inside a word (boundaries included) are hashed to
buckets. The mean of their embeddings goes through a linear softmax. Training is
stochastic gradient descent on a bounded, documented sample of snippets; a part of it is
held back to fit the temperature of the softmax and the score below which a prediction
is rejected. Texts of several known languages stay: one that scores below is read again in
pieces, at least two, and kept if most of them reach the score. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKET_BITS = 15
DIM = 8
ROWS_PER_LANG = 800  # bound of the training sample: labelled rows of each language, about
SNIPPETS = (40, 160, 640)  # code points of the snippets cut from each sampled row
EPOCHS, BATCH, RATE = 6, 64, 2.0
REJECT_QUANTILE = 0.0005  # share of right held-back predictions that the threshold may reject
PIECE = 1 << 18  # characters hashed at once
MIXED_PIECE = SNIPPETS[1]  # most code points of the pieces in which a text that may be of several languages is read


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logits: np.ndarray  # bucket x language: embeddings through the linear layer
    temperature: float
    threshold: float


class Subwords:
    """Bucket numbers of a text's subwords; its table of letters is built once a worker."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def buckets(self, text: str) -> Iterator[np.ndarray]:
        """In pieces, of which none is long; no subword is lost or doubled at a seam."""
        carry = np.zeros(1, np.uint32)
        for lo in range(0, len(text), PIECE):
            raw = np.frombuffer(text[lo : lo + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
            code = np.concatenate([carry, np.where(self.letter[raw], raw, 0).astype(np.uint32)])
            if lo + PIECE >= len(text):
                code = np.append(code, np.uint32(0))
            code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]
            for n in (2, 3, 4):
                if len(code) >= n:
                    yield _hashed(code, n, len(carry) if lo else 0)
            carry = code[-3:]

    def all(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *self.buckets(text)])


def _hashed(code: np.ndarray, n: int, seen: int) -> np.ndarray:
    """Buckets of all n-character subwords that do not lie wholly in the first `seen` characters."""
    code = code[max(0, seen - n + 1) :]
    size = len(code) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = np.full(size, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    inside = np.ones(size, bool)
    for i in range(n):
        c = code[i : i + size]
        h = (h ^ c) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        if 0 < i < n - 1:
            inside &= c != 0
    return (h[inside] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Fits on about 85 % of the snippets and calibrates on the rest. No labelled text: a model that knows no language."""
    words, names = Subwords(), tuple(sorted(set(langs)))
    bags = [words.all(t) for t in texts]
    keep = [i for i, b in enumerate(bags) if len(b)]
    if not keep:
        return Model((), np.zeros((1 << BUCKET_BITS, 0), np.float32), 1.0, 0.0)
    y = np.array([names.index(langs[i]) for i in keep])
    bags = [bags[i] for i in keep]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held = order[: max(1, len(bags) * 15 // 100)] if len(bags) > 20 else order
    fit = order[len(held) :] if len(bags) > 20 else order
    emb = np.zeros((1 << BUCKET_BITS, DIM), np.float32)
    out = rng.normal(0, 0.5, (DIM, len(names))).astype(np.float32)
    weight = 1.0 / np.maximum(1, np.bincount(y[fit], minlength=len(names)))
    weight = (weight / weight[y[fit]].mean()).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(fit)
        for lo in range(0, len(fit), BATCH):
            ids = fit[lo : lo + BATCH]
            sizes = np.array([len(bags[i]) for i in ids])
            flat = np.concatenate([bags[i] for i in ids])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(emb[flat], starts, axis=0) / sizes[:, None].astype(np.float32)
            grad = _softmax(mean @ out)
            grad[np.arange(len(ids)), y[ids]] -= 1
            grad *= weight[y[ids]][:, None] / len(ids)
            back = (grad @ out.T) * (np.float32(len(ids)) / sizes[:, None].astype(np.float32))
            out -= np.float32(rate) * (mean.T @ grad)
            step = np.repeat(np.float32(rate) * back, sizes, axis=0)
            for d in range(DIM):
                emb[:, d] -= np.bincount(flat, step[:, d], 1 << BUCKET_BITS).astype(np.float32)
    logits = (emb @ out).astype(np.float32)
    z = np.stack([logits[bags[i]].mean(0) for i in held])
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = _softmax(z / temperature)
    right = p.argmax(1) == y[held]
    threshold = float(np.quantile(p.max(1)[right], REJECT_QUANTILE)) if right.any() else 0.0
    return Model(names, logits, temperature, threshold)


def predict(model: Model, words: Subwords, text: str | None) -> tuple[str, float, bool]:
    """(language, calibrated probability, rejected); no text or no letter, or no known language: und, 0, rejected."""
    if not text or not model.langs:
        return UNKNOWN, 0.0, True
    p = _probabilities(model, words, text)
    if p is None or not _has_letter(text):
        return UNKNOWN, 0.0, True
    k = int(p.argmax())
    return model.langs[k], float(p[k]), bool(p[k] < model.threshold) and not _mixed(model, words, text)


def _probabilities(model: Model, words: Subwords, text: str) -> np.ndarray | None:
    total, n = np.zeros(len(model.langs)), 0
    for b in words.buckets(text):
        total += model.logits[b].sum(0, dtype=np.float64)
        n += len(b)
    return _softmax(total / n / model.temperature) if n else None


def _mixed(model: Model, words: Subwords, text: str) -> bool:
    """Whether most of the text's pieces with letters are of known languages, each by itself."""
    size = min(MIXED_PIECE, -(-len(text) // 2))
    pieces = (text[i : i + size] for i in range(0, len(text), size))
    known = [_probabilities(model, words, x).max() >= model.threshold for x in pieces if _has_letter(x)]
    return 2 * sum(known) > len(known)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is left out of training: crc32 of its id as text, modulo 3, is 1. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """Snippets of about ROWS_PER_LANG rows of each language, drawn by a hash of the id, never of held-out rows."""
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(F.col(text_col)) > 0))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return [], []
    u = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int((1 << 40) * min(1.0, ROWS_PER_LANG / n)))])
    drawn = labelled.where(u < share[F.col(lang_col)])
    start = F.xxhash64(F.col(id_col), F.lit(12))
    cut = [F.substring(F.col(text_col), F.pmod(start, F.greatest(F.lit(1), F.length(text_col) - n)).cast("int") + 1, F.lit(n)) for n in SNIPPETS]
    rows = drawn.select(F.col(lang_col).alias("lang"), *(c.alias(f"s{i}") for i, c in enumerate(cut))).distinct()
    # the draw comes near ROWS_PER_LANG; many rows of one id and text would be one draw, and are one row here
    rows = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(2 * ROWS_PER_LANG * len(counts)).collect()
    rows.sort(key=lambda r: tuple(r))
    return [r[f"s{i}"] for r in rows for i in range(len(SNIPPETS))], [r["lang"] for r in rows for _ in SNIPPETS]


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows as struct `doc`, and a struct `lang` (pred, score, rejected)."""
    spark = docs.sparkSession
    # 2^15 buckets x languages; plain values, as workers read broadcasts without this package
    shared = spark.sparkContext.broadcast((model.langs, model.logits, model.temperature, model.threshold))

    @F.pandas_udf("pred string, score double, rejected boolean")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, known = Subwords(), Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame([predict(known, words, t) for t in texts], columns=["pred", "score", "rejected"])

    return docs.select(F.struct("*").alias("doc"), apply(F.col(text_col)).alias("lang"))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id_col, held_out, lang_pred, score, rejected.

    Trains on the rows that are not held out and have a language. Null, empty or
    letterless text: und, score 0, rejected. Repeated rows come out once each; with no
    labelled row everything is und. Other columns are not read.
    """
    model = train(*training_sample(docs, id_col, text_col, lang_col))
    plain = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return with_language(plain, model).select(
        F.col("doc.id").alias(id_col), "doc.held_out", F.col("lang.pred").alias("lang_pred"), F.col("lang.score").alias("score"), F.col("lang.rejected").alias("rejected"),
    )


def accepted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose prediction is not rejected, with all their columns unchanged."""
    model = train(*training_sample(docs, id_col, text_col, lang_col))
    return with_language(docs, model, text_col).where(~F.col("lang.rejected")).select("doc.*")
