"""Toxicity by a convolutional text classifier, trained in numpy.

A word and its first few bytes are hashed, and a word's embedding is the sum of
theirs; hashes that the training sample doesn't hold often enough add nothing.
Filters of several widths run over the embeddings, each filter's largest value in
the text goes to a logistic unit, and a threshold for each language (told from its
function words in the text) is calibrated on a part of the sample that training
doesn't see.

Scoring needs no product of matrices: the part of each filter that a word meets at
each place is looked up.

Defined cases: a null or empty text is one padding word; without any labels every
score is 0; rows that repeat score alike; a null doc_id is passed on; further
columns are ignored; an empty table gives an empty result. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import text_steps
from tessera.llm.labelled import held_out, sample

#: Bounds of training: labelled documents, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARACTERS = 6000, 20_000
WIDTHS, FILTERS, DIMENSIONS = (1, 2, 3), 8, 12
LEAST_SEEN = 3
#: Beginnings of a word, in bytes, that are hashed besides the word.
BEGINNINGS = (4, 5, 6)
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.01, 1e-3
# Function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the and of to is was that with for are this on it be not by from or an at",
    "fr": "le la les des et est une dans que qui pour pas sur au aux du ce avec il elle",
    "de": "der die das und ist nicht mit ein eine den dem von zu auf für im sich des auch als",
    "es": "el los las una que en y por con para del se es su al lo como más pero sus",
}
LANGUAGES = (*sorted(FUNCTION_WORDS), "")
#: A-Z to a-z, and every byte that can't be in a word to a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split() or [b""]


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, 4)


def word_hashes(word: bytes) -> list[int]:
    return [word_hash(word), *(xxhash.xxh3_64_intdigest(word[:n], 100 + n) if len(word) >= n else 0 for n in BEGINNINGS)]


class WordRows:
    """Words seen so far, each with the embedding rows of its hashes (0: none). Word 0 is the padding."""

    def __init__(self, known: dict[int, int], limit: int = 300_000):
        self.known, self.limit = known, limit
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = {b"": 0}
        self.rows = np.zeros((1, 1 + len(BEGINNINGS)), np.int32)

    def of(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.places))
        if len(self.places) + len(new) > self.limit and len(self.places) > 1:
            self.forget()
            new = list(set(words).difference(self.places))
        if new:
            get = self.known.get
            self.places.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, np.array([[get(h, 0) for h in word_hashes(w)] for w in new], np.int32)])
        return np.fromiter(map(self.places.__getitem__, words), np.int32, len(words))


@dataclass
class Network:
    known: dict[int, int]  # hash -> row; row 0 adds nothing
    embedding: np.ndarray
    filters: list[np.ndarray]  # of each width: (width * dimensions, filters)
    bias: np.ndarray
    out: np.ndarray
    offset: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))  # logits by language



class Scorer:
    """A network with what each word seen so far adds to the filters, and its votes for languages."""

    def __init__(self, net: Network):
        self.net, self.words = net, WordRows(net.known)
        self.filters = np.concatenate([f.reshape(w, DIMENSIONS, FILTERS)[o] for w, f in zip(WIDTHS, net.filters) for o in range(w)], axis=1).astype(np.float32)
        self.function = {word.encode(): k for k, language in enumerate(LANGUAGES[:-1]) for word in FUNCTION_WORDS[language].split()}
        self._empty()

    def _empty(self) -> None:
        self.parts, self.votes = np.zeros((0, self.filters.shape[1]), np.float32), np.zeros((0, len(LANGUAGES) - 1), np.int32)

    def _learn(self) -> None:
        if new := len(self.words.rows) - len(self.parts):
            self.parts = np.concatenate([self.parts, self.net.embedding[self.words.rows[-new:]].sum(1) @ self.filters])
            self.votes = np.concatenate([self.votes, np.zeros((new, len(LANGUAGES) - 1), np.int32)])
            for word, k in self.function.items():
                if (place := self.words.places.get(word)) is not None:
                    self.votes[place, k] = 1

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits before calibration, and the languages' numbers."""
        words: list[bytes] = []
        starts, ends = [], []
        gap = [b""] * (max(WIDTHS) - 1)
        for text in texts:
            starts.append(len(words))
            words += words_of(text)
            ends.append(len(words))
            words += gap
        places = self.words.places
        ids = self.words.of(words)
        if self.words.places is not places:
            self._empty()
        self._learn()
        cuts = np.stack([starts, ends], axis=1).ravel()
        n, pooled, column = len(ids) - max(WIDTHS) + 1, [], 0
        for w in WIDTHS:
            conv = np.zeros((n + 1, FILTERS), np.float32)
            for o in range(w):
                conv[:n] += self.parts[:, column : column + FILTERS][ids[o : n + o]]
                column += FILTERS
            pooled.append(np.maximum.reduceat(conv, cuts, axis=0)[::2])
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
        told = np.add.reduceat(np.concatenate([self.votes[ids], self.votes[:1]]), cuts, axis=0)[::2]
        language = np.where(told.max(1) > 0, told.argmax(1), len(LANGUAGES) - 1)
        return hidden @ self.net.out + self.net.offset, language


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on log loss; the gradient of a pooled filter goes to the window that gave its largest value."""
    rng = np.random.default_rng(seed)
    seen: dict[int, int] = {}
    for text in texts:
        for h in {h for word in set(words_of(text)) if word for h in word_hashes(word)}:
            seen[h] = seen.get(h, 0) + 1
    kept = sorted(h for h, n in seen.items() if h and n >= LEAST_SEEN)
    known = {h: 1 + i for i, h in enumerate(kept)}
    words, d, n_filters = WordRows(known), DIMENSIONS, FILTERS * len(WIDTHS)
    params = {"e": rng.normal(0, 0.05, (1 + len(kept), d)), "b": np.zeros(n_filters), "o": rng.normal(0, 0.3, n_filters), "c": np.zeros(1)}
    params["e"][0] = 0
    params |= {f"f{k}": rng.normal(0, 1 / np.sqrt(w * d), (w * d, FILTERS)) for k, w in enumerate(WIDTHS)}
    m, v = {k: np.zeros_like(x) for k, x in params.items()}, {k: np.zeros_like(x) for k, x in params.items()}
    rows = []
    for text in texts:
        own = words.of([*words_of(text), *[b""] * (max(WIDTHS) - 1)])
        rows.append(words.rows[own])
    calibrating = rng.random(len(texts)) < 0.2
    training = np.flatnonzero(~calibrating)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3)).clip(0.2, 5)
    step = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(training), max(1, len(training) // BATCH)):
            pooled, windows = np.zeros((len(batch), n_filters)), np.zeros((len(batch), n_filters), np.int64)
            for r, i in enumerate(batch):
                e = params["e"][rows[i]].sum(1)
                n = len(e) - max(WIDTHS) + 1
                for k, w in enumerate(WIDTHS):
                    f = params[f"f{k}"]
                    conv = sum(e[o : n + o] @ f[o * d : (o + 1) * d] for o in range(w))
                    windows[r, k * FILTERS : (k + 1) * FILTERS] = at = conv.argmax(0)
                    pooled[r, k * FILTERS : (k + 1) * FILTERS] = conv[at, np.arange(FILTERS)]
            pre = pooled + params["b"]
            hidden = np.maximum(pre, 0)
            g = (_sigmoid(hidden @ params["o"] + params["c"][0]) - labels[batch]) * weight[batch] / len(batch)
            grad = {"o": hidden.T @ g, "c": np.array([g.sum()])}
            back = np.outer(g, params["o"]) * (pre > 0)
            grad["b"], touched, pulls = back.sum(0), [], []
            for k, w in enumerate(WIDTHS):
                f, gf = params[f"f{k}"], np.zeros_like(params[f"f{k}"])
                for j in range(FILTERS):
                    h = back[:, k * FILTERS + j]
                    at = windows[:, k * FILTERS + j]
                    for o in range(w):
                        found = np.array([rows[i][a + o] for i, a in zip(batch, at)])
                        gf[o * d : (o + 1) * d, j] = params["e"][found].sum(1).T @ h
                        pull = h[:, None] * f[o * d : (o + 1) * d, j]
                        touched.append(found.ravel())
                        pulls.append(np.repeat(pull, found.shape[1], axis=0))
                grad[f"f{k}"] = gf
            own, place = np.unique(np.concatenate(touched), return_inverse=True)
            grad["e"] = np.stack([np.bincount(place, x, len(own)) for x in np.concatenate(pulls).T], axis=1)
            grad["e"][own == 0] = 0
            step += 1
            for k, x in params.items():
                at = own if k == "e" else slice(None)  # embeddings that the batch doesn't touch stay as they are
                m[k][at] = 0.9 * m[k][at] + 0.1 * grad[k]
                v[k][at] = 0.999 * v[k][at] + 0.001 * grad[k] ** 2
                x[at] -= RATE * ((m[k][at] / (1 - 0.9**step)) / (np.sqrt(v[k][at] / (1 - 0.999**step)) + 1e-8) + DECAY * x[at] * (k != "c"))
    net = Network(known, params["e"].astype(np.float32), [params[f"f{k}"] for k in range(len(WIDTHS))], params["b"], params["o"], float(params["c"][0]))
    _calibrate(net, [texts[i] for i in np.flatnonzero(calibrating)], labels[calibrating])
    return net


def _best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """Where F1 is largest, a third of the way up the gap there."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(np.argmax(f1))
    below = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 2
    return float((logits[order[k]] + 2 * below) / 3)


def _calibrate(net: Network, texts: list[bytes], labels: np.ndarray, least: int = 8) -> None:
    """A language with fewer than ``least`` toxic or clean documents in the part keeps the threshold of all."""
    if not len(texts) or not labels.any():
        return
    logits, language = Scorer(net)(texts)
    net.thresholds[:] = _best_threshold(logits, labels)
    for k in range(len(LANGUAGES)):
        own = language == k
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= least:
            net.thresholds[k] = _best_threshold(logits[own], labels[own])


def _scored(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = shared.value
        scorer = Scorer(net) if net is not None else None
        for batch, texts in text_steps(batches, "_text", 2 << 20):
            score = np.zeros(len(texts))
            if scorer is not None:
                logits, language = scorer(texts)
                score = _sigmoid(logits - net.thresholds[language])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score(documents: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """``keep`` columns and the score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    rows = documents.select(*keep, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(_scored(shared), T.StructType([*rows.schema[:-1], T.StructField("score", T.DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; trained on labels of rows that aren't held out."""
    known = sample(documents, labels, "toxic", modulus, rest, SAMPLE_ROWS, SAMPLE_CHARACTERS)
    texts, marks = [x.encode() for x in known.column("text").to_pylist()], np.array(known.column("label").to_pylist(), np.float64)
    net = train(texts, marks) if len(texts) else None
    scored = score(documents, net, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
