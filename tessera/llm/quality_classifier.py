"""Text quality by a factorisation machine.

Features are hashed words, structure statistics and size metadata of the text, all
with a weight and a low-rank factor. The pairwise part needs no pairs: for each
factor it is half of (sum of v x) squared less the sum of (v x) squared.

Defined cases: a null or empty text has no words and zero statistics, and is scored
from those; without any labels every score is 0; rows that repeat score alike; a
null doc_id is passed on; further columns are ignored; an empty table gives an
empty result. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import WordHasher, text_steps
from tessera.llm.labelled import held_out, sample

#: Bounds of training: labelled documents, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARACTERS = 3000, 20_000
BUCKETS, RANK = 1 << 15, 6
EPOCHS, RATE, DECAY = 60, 0.03, 2e-3
STATISTICS = ("log_words", "word_bytes", "upper", "digits", "symbols", "stops", "wide", "line_words", "equal_lines", "different_words", "short_words", "long_words")

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS, _STOPS = b"#*$%&|<>{}[]=+~^_\\/@", b".,;:!?"
_WIDE = bytes(range(128, 256))
_HASHES = WordHasher(0xA0761D6478BD642F)


def _statistics(text: bytes, words: list[bytes], different: int) -> list[float]:
    n, size = max(len(words), 1), max(len(text), 1)
    share = lambda characters: (len(text) - len(text.translate(None, characters))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(len(words)), lengths.sum() / n, share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_STOPS), share(_WIDE), np.log1p(len(words) / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), different / n, (lengths <= 2).sum() / n, (lengths >= 12).sum() / n,
    ]


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values of words (unit length for each text), and the statistics."""
    each = [(x or b"").split() for x in texts]
    hashes, counts = _HASHES.of(texts)
    row = np.repeat(np.arange(len(texts)), counts)
    key, n = np.unique(row * BUCKETS + (hashes >> np.uint64(20)).astype(np.int64) % BUCKETS, return_counts=True)
    row, bucket, value = key // BUCKETS, key % BUCKETS, np.log1p(n)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(texts)))
    different = np.bincount(row, minlength=len(texts))
    stats = np.array([_statistics(x or b"", w, d) for x, w, d in zip(texts, each, different.tolist())]).reshape(len(texts), len(STATISTICS))
    return row, bucket, value / np.maximum(norm, 1e-12)[row], stats


@dataclass
class Machine:
    offset: float
    weights: np.ndarray  # of buckets, then of statistics
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def _sums(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the sums of w x, of v x and of (v x) squared."""
        linear, s, q = z @ self.weights[BUCKETS:], z @ self.factors[BUCKETS:], (z * z) @ (self.factors[BUCKETS:] ** 2)
        if len(row):
            cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            vx = self.factors[bucket] * value[:, None]
            linear[row[cuts]] += np.add.reduceat(self.weights[bucket] * value, cuts)
            s[row[cuts]] += np.add.reduceat(vx, cuts, axis=0)
            q[row[cuts]] += np.add.reduceat(vx * vx, cuts, axis=0)
        return linear, s, q

    def logits(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, z: np.ndarray) -> np.ndarray:
        linear, s, q = self._sums(row, bucket, value, z)
        return self.offset + linear + 0.5 * (s * s - q).sum(1)

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Machine:
    """Adam on log loss over the whole sample."""
    row, bucket, value, stats = features(texts)
    rng = np.random.default_rng(seed)
    n = BUCKETS + len(STATISTICS)
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    fm = Machine(float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, 0.05, (n, RANK)), stats.mean(0), stats.std(0) + 1e-6)
    z = fm.scaled(stats)
    order = np.argsort(bucket, kind="stable")  # gradients are summed by bucket
    by_bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, by_bucket[1:] != by_bucket[:-1])) if len(order) else np.zeros(0, np.int64)
    m = [np.zeros(1), np.zeros(n), np.zeros((n, RANK))]
    v = [np.zeros(1), np.zeros(n), np.zeros((n, RANK))]
    for step in range(1, EPOCHS + 1):
        linear, s, q = fm._sums(row, bucket, value, z)
        g = (_sigmoid(fm.offset + linear + 0.5 * (s * s - q).sum(1)) - labels) / len(labels)
        gw, gv = np.zeros(n), np.zeros((n, RANK))
        gw[BUCKETS:] = z.T @ g
        gv[BUCKETS:] = z.T @ (s * g[:, None]) - fm.factors[BUCKETS:] * ((z * z).T @ g)[:, None]
        if len(order):
            gx, x = g[row] * value, value
            gw[by_bucket[cuts]] = np.add.reduceat(gx[order], cuts)
            gv[by_bucket[cuts]] = np.add.reduceat((gx[:, None] * (s[row] - fm.factors[bucket] * x[:, None]))[order], cuts, axis=0)
        grads = [np.array([g.sum()]), gw + DECAY * fm.weights, gv + DECAY * fm.factors]
        moves = []
        for k, gradient in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * gradient
            v[k] = 0.99 * v[k] + 0.01 * gradient**2
            moves.append(RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8))
        fm.offset -= float(moves[0][0])
        fm.weights -= moves[1]
        fm.factors -= moves[2]
    return fm


def _scored(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm: Machine | None = shared.value
        for batch, texts in text_steps(batches, "_text", 2 << 20):
            score = np.zeros(len(texts))
            if fm is not None:
                row, bucket, value, stats = features(texts)
                score = _sigmoid(fm.logits(row, bucket, value, fm.scaled(stats)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score(documents: DataFrame, fm: Machine | None, keep: list[str]) -> DataFrame:
    """``keep`` columns and the score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(fm)
    rows = documents.select(*keep, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(_scored(shared), T.StructType([*rows.schema[:-1], T.StructField("score", T.DoubleType())]))


def quality(documents: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; trained on labels of rows that aren't held out."""
    known = sample(documents, labels, "quality", modulus, rest, SAMPLE_ROWS, SAMPLE_CHARACTERS)
    texts, marks = [x.encode() for x in known.column("text").to_pylist()], np.array(known.column("label").to_pylist(), np.float64)
    fm = train(texts, marks) if len(texts) else None
    scored = score(documents, fm, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
