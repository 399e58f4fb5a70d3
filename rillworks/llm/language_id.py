"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sample import bounded
from ._send import received, sent
from ._text import Chunk, chunks

#: Buckets of hashed byte n-grams; rows of a language that train, about.
BUCKETS, PER_LANGUAGE = 1 << 13, 500
#: Lower-case letters and other bytes than ASCII stay, all else is a space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets + 1 x bits, the last for what isn't counted
    bias: np.ndarray
    trust: np.ndarray  # of each bit, from its errors in training


def grams(c: Chunk) -> list[np.ndarray]:
    """For 2 and 3 bytes: each position's bucket, or BUCKETS where a row ends or all is space."""
    b = _FOLD[c.buf].astype(np.uint32)
    out = []
    for n, (x, y, z) in ((2, (2654435761, 2246822519, 0)), (3, (3266489917, 668265263, 374761393))):
        m = max(0, len(b) - n + 1)
        h = b[:m] * np.uint32(x) + b[1 : m + 1] * np.uint32(y) + (b[2 : m + 2] * np.uint32(z) if n == 3 else np.uint32(0))
        at = np.full(len(b), BUCKETS, np.int32)
        at[:m] = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(19)
        blank = b == 0x20
        alone = blank[:m] & blank[1 : m + 1]
        at[:m][alone & blank[2 : m + 2] if n == 3 else alone] = BUCKETS
        for k in range(1, n):
            ends = c.off[1:] - k
            at[ends[ends >= c.off[:-1]]] = BUCKETS
        out.append(at)
    return out


def has_letter(c: Chunk) -> np.ndarray:
    """Whether a row has a letter of any script."""
    flag = np.append((_FOLD[c.buf] != 0x20) & (c.buf < 128), False)
    out = np.logical_or.reduceat(flag, c.off[:-1]) if len(c.buf) else np.zeros(c.n, bool)
    out[c.off[1:] == c.off[:-1]] = False
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(x.isalpha() for x in c.buf[c.off[i] : c.off[i + 1]].tobytes().decode())
    return out


def codewords(k: int) -> np.ndarray:
    """k codewords: all splits of the languages in two for up to five, else random ones that lie far apart."""
    if k <= 5:
        return np.array([(1, *x) for x in product((1, -1), repeat=k - 1) if -1 in x], np.int8).T.reshape(k, -1)
    rng, best = np.random.default_rng(5), None
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (k, int(np.ceil(10 * np.log2(k)))))
        m = m[:, np.abs(m.sum(axis=0, dtype=int)) < k]
        far = min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))
        if best is None or far > best[0]:
            best = far, m
    return best[1]


def fit_language_model(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = PER_LANGUAGE) -> LanguageModel:
    """Trains on about `most` rows of each language at most, of those with a text and a language; whole texts."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for c in chunks(batch["text"]):
                found = grams(c)
                for lo, hi in zip(c.off[:-1].tolist(), c.off[1:].tolist()):
                    k, m = np.unique(np.concatenate([x[lo:hi] for x in found]), return_counts=True)
                    at.append(k.astype(np.uint16).tobytes())
                    n.append(m.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "n"])

    got = bounded(rows, "lang", "id", most).select("lang", "text").where("text is not null").mapInArrow(count, "lang string, at binary, n binary").collect()
    languages = sorted({r.lang for r in got})
    k = len(languages)
    if k < 2:
        return LanguageModel(languages, np.ones((k, 0), np.int8), np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), np.zeros(0))
    x = np.zeros((len(got), BUCKETS + 1), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.n, np.uint32)
    x[:, BUCKETS] = 0
    x /= np.maximum(1, x.sum(axis=1, keepdims=True))
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-4)
    x *= scale
    x *= (norm := 4 / np.sqrt((x**2).sum(axis=1).mean() + 1e-9))
    code = codewords(k)
    y = code[[languages.index(r.lang) for r in got]].astype(np.float32)
    w, bias = np.zeros((BUCKETS + 1, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    share = 1 / np.array([sum(r.lang == s for r in got) for s in languages], np.float32)[[languages.index(r.lang) for r in got]]
    share = (share / share.sum())[:, None]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 121):  # logistic loss, a small ridge, Adam
        g = -y * share / (1 + np.exp(np.clip(y * (x @ w + bias), -30, 30)))
        bias -= 2 * g.sum(axis=0)
        g = x.T @ g + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    wrong = ((x @ w + bias) * y <= 0).mean(axis=0)
    return LanguageModel(languages, code, (w * (scale * norm)[:, None]).astype(np.float32), bias.astype(float), np.log((1 - wrong + 1e-3) / (wrong + 1e-3)))


def decode(m: LanguageModel, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of bit margins: the codeword with the least loss, weighted by each bit's trust; its share of exp(-loss); the gap to the second."""
    trust = m.trust / m.trust.mean() if len(m.trust) else m.trust
    loss = np.stack([(np.logaddexp(0, -f * word) * trust).sum(axis=1) for word in m.code], axis=1)
    order = np.sort(loss, axis=1)
    p = np.exp(order[:, :1] - order).sum(axis=1)
    return loss.argmin(axis=1), 1 / p, order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(f), np.inf)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", gap: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous (the nearest two codewords' losses differ by less than `gap`) for each row, from its whole text.

    A null text and one without a letter of any script are `und` with score 0, not ambiguous; so is every row if no language was learned.
    Ties go to the first language by name. Repeated rows stay; other columns are ignored.
    """
    held = sent(docs.sparkSession, model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(held)
        for batch in batches:
            lang, score, unsure = [], [], []
            for c in chunks(batch["text"]):
                f, n = np.zeros((c.n, m.code.shape[1])), np.zeros(c.n)
                if len(c.buf) and len(m.languages) > 1:
                    inside = c.off[1:] > c.off[:-1]
                    at = np.minimum(c.off[:-1], len(c.buf) - 1)
                    for g in grams(c):
                        f[inside] += np.add.reduceat(m.weights[g], at, axis=0)[inside]
                        n[inside] += np.add.reduceat((g != BUCKETS).astype(np.int64), at)[inside]
                best, p, far = decode(m, f / np.maximum(1, n)[:, None] + m.bias) if m.languages else (None, None, None)
                for i, letter in enumerate(has_letter(c).tolist()):
                    letter = letter and best is not None
                    lang.append(m.languages[best[i]] if letter else "und")
                    score.append(float(p[i]) if letter else 0.0)
                    unsure.append(bool(letter and far[i] < gap))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")


def fold(id_col: str, parts: int, which: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder `which`; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == which, F.lit(False))
