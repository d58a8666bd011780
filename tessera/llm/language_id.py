"""Language identification by prediction by partial matching over bytes.

Byte context trees of up to three bytes are counted on a bounded sample of
labelled documents. For every context in the tree and every language the code of
the next byte is fixed beforehand: a byte seen in the context costs its share, any
other costs the escape (method C) and its code in the next shorter context, with
the seen bytes excluded. Scoring is then a table look-up for each byte and
language; a text goes to the language whose tree codes it in the fewest bits.

Defined cases: a null text and one without a letter get ``und`` and score 0, as
does every text if nothing is labelled; ties go to the smaller language name; a
null doc_id counts as the empty text in the split and never trains; rows that repeat
are predicted alike; further columns are ignored; an empty table gives an empty result. Texts of
any length are scored whole, in slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import text_steps
from tessera.llm.labelled import held_out

#: Size of the training sample: documents in all (never more than twice that), and for each language.
SAMPLE_DOCUMENTS, SAMPLE_PER_LANGUAGE = 4000, 400
#: Size of the model: a context stays in the trees from so many sightings; at most so many contexts stay, short ones
#: before long ones and frequent ones before rare ones. Bytes in contexts that didn't stay are coded in the next shorter one.
LEAST_SEEN, MOST_CONTEXTS = 6, 20_000
SLICE = 1 << 19
UNKNOWN = "und"


@dataclass
class ContextTrees:
    """Frozen statistics: ``bits[context * symbols + symbol, language]``."""

    languages: list[str]
    classes: np.ndarray  # byte -> symbol
    deepest: np.ndarray  # three symbols -> context
    bits: np.ndarray

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        n_symbols = int(self.classes.max()) + 1
        pad = b"   "
        raw = np.frombuffer(pad + pad.join(texts), np.uint8)
        lengths = np.array([len(x) for x in texts], np.int64)
        starts = np.cumsum(np.concatenate([[0], lengths[:-1] + 3])) + 3
        out = np.zeros((len(texts), len(self.languages)))
        for first in range(3, len(raw), SLICE):
            last = min(len(raw), first + SLICE)
            c = self.classes[raw[first - 3 : last]].astype(np.int64)
            key = (c[:-3] * n_symbols + c[1:-2]) * n_symbols + c[2:-1]
            cost = self.bits[self.deepest[key] * n_symbols + c[3:]]
            lo = int(np.searchsorted(starts, first, "right")) - 1
            hi = int(np.searchsorted(starts, last, "left"))
            for gap in starts[lo + 1 : hi + 1] if hi < len(starts) else starts[lo + 1 :]:  # the padding before a text isn't coded
                cost[max(0, gap - 3 - first) : max(0, gap - first)] = 0
            cuts = np.concatenate([[0], np.minimum(starts[lo + 1 : hi] - first, last - first - 1)]).astype(np.int64)
            part = np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)
            out[lo:hi] += part
        out[lengths == 0] = 0
        return out


def grow(languages: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray, least_seen: int = LEAST_SEEN, most: int | None = MOST_CONTEXTS) -> ContextTrees:
    """Trees from counts of byte quadruples: ``gram`` holds the three bytes before and the byte.

    All languages share the contexts, so that one look-up serves them all; a language
    that never saw a context passes through it to the next shorter one for free. With
    ``least_seen`` 0 and ``most`` None every context stays.
    """
    where = [(gram >> s) & 255 for s in (24, 16, 8, 0)]
    seen = np.unique(np.concatenate(where))
    classes = np.zeros(256, np.uint16)
    classes[seen] = np.arange(1, len(seen) + 1)  # symbol 0: bytes never seen
    a = len(seen) + 1
    symbols = [classes[x].astype(np.int64) for x in where]
    levels = []  # of each order: the context of each count (or -1), and the shorter context of each context
    deepest, made = np.zeros(1, np.int64), 0
    for order in range(4):
        key = np.zeros(len(gram), np.int64)
        for s in symbols[3 - order : 3]:
            key = key * a + s
        keys, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, weights=count)
        good = np.flatnonzero(total >= (least_seen if order > 1 else 0))
        if most is not None:
            good = np.sort(good[np.argsort(-total[good], kind="stable")[: max(0, most - made)]])
        context = np.full(len(keys), -1)
        context[good] = made + np.arange(len(good))
        table = np.tile(deepest, a) if order else deepest
        levels.append((context[inverse], table[keys[good]], made, len(good)))
        table[keys[good]] = context[good]
        deepest, made = table, made + len(good)
    bits = np.empty((made * a, len(languages)), np.float32)
    for k in range(len(languages)):
        p = np.full((made, a), 1.0 / a)  # below the empty context, all symbols are alike
        for context, shorter, first, size in levels:
            use = (context >= 0) & (language == k)
            n = np.bincount((context[use] - first) * a + symbols[3][use], weights=count[use], minlength=size * a).reshape(size, a)
            lower = p[shorter] if first else p[:size].copy()
            t, d = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            left = 1 - np.where(n > 0, lower, 0).sum(1, keepdims=True)
            escaped = d / np.maximum(t + d, 1) * lower / np.maximum(left, 1e-12)
            p[first : first + size] = np.where(t > 0, np.where(n > 0, n / np.maximum(t + d, 1), escaped), lower)
        bits[:, k] = -np.log2(np.maximum(p, 1e-12)).ravel()
    return ContextTrees(languages, classes, deepest.astype(np.int32), bits)


def _quadruples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_steps(batches):
        languages = batch.column(0).to_pylist()
        for language in sorted(set(languages)):
            raw = np.frombuffer(b"   " + b"   ".join((x or b"").lower() for x, y in zip(texts, languages) if y == language), np.uint8).astype(np.uint32)
            gram = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
            found, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(documents: DataFrame, modulus: int = 3, rest: int = 1, documents_in_all: int = SAMPLE_DOCUMENTS, per_language: int = SAMPLE_PER_LANGUAGE, least_seen: int = LEAST_SEEN, most_contexts: int | None = MOST_CONTEXTS) -> ContextTrees | None:
    """Trees of all languages in ``lang``, from about ``per_language`` labelled documents of each outside the held-out part.

    The doc_ids with the smallest hashes are taken, so the choice depends on nothing
    but the ids. Rows without a doc_id don't train: they share one hash.
    """
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    known = sizes.count()
    if not known:
        return None
    share = max(1, min(per_language, documents_in_all // known))
    # Each language gives the documents whose hash lies in its lowest share: no ranking, so a frequent language stays spread.
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(float(share << 40)) / F.col("n")
    chosen = labelled.select("doc_id", "lang").join(sizes, "lang").filter(low)
    # The limit bounds what is broadcast; by the order of hashes it is the same on every layout.
    ids = chosen.select(F.col("doc_id").alias("chosen_id")).distinct().orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(2 * documents_in_all)
    sample = labelled.join(F.broadcast(ids), F.col("doc_id") == F.col("chosen_id"), "left_semi").select("lang", F.col("text").cast("string"))
    counts = sample.mapInArrow(_quadruples, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique().tolist())
    index = {x: i for i, x in enumerate(languages)}
    counts = counts.sort_values(["lang", "gram"])
    return grow(languages, counts["lang"].map(index).to_numpy(), counts["gram"].to_numpy(), counts["n"].to_numpy().astype(np.float64), least_seen, most_contexts)


_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def _predicted(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: ContextTrees | None = shared.value
        for batch, texts in text_steps(batches, "_text", 1 << 20):
            language, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, x in enumerate(texts) if x and has_letter(x)] if trees else []
            if rows:
                bits = trees.code_lengths([texts[i].lower() for i in rows])
                best = bits.argmin(1)
                least = bits[np.arange(len(rows)), best]
                score[rows] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                for i, b in zip(rows, best.tolist()):
                    language[i] = trees.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(language, pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(documents: DataFrame, trees: ContextTrees | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(trees)
    rows = documents.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*rows.schema[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predicted(shared), schema)


def identify(documents: DataFrame, modulus: int = 3, rest: int = 1, least_seen: int = LEAST_SEEN, most_contexts: int | None = MOST_CONTEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; trained on the rows that aren't held out."""
    scored = predict(documents, train(documents, modulus, rest, least_seen=least_seen, most_contexts=most_contexts), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "lang_pred", "score")
