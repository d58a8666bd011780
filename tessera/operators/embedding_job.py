"""Embedding of documents as a job: vectors or an error for every chunk, then new builds of the documents that have no error."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.functions import text as fn
from tessera.operators import versions
from tessera.plans.storage import materialise

#: Texts that an embedder gets at once.
BATCH = 256
Embedder = Callable[[Sequence[str]], Sequence["np.ndarray | str"]]


class HashedTerms:
    """A stand-in for a model: the unit vector of a text's hashed terms, as :func:`embedding.term_bins` has it.

    A text without a term is an error, and so is one that holds ``refused`` (a regular expression), which
    stands for inputs that a model rejects.
    """

    def __init__(self, dimension: int = embedding.DIMENSION, refused: str | None = None):
        self.dimension, self.refused, self.bins = dimension, refused and re.compile(refused), {}
        self.accents = str.maketrans(dict(zip(fn.ACCENTED, fn.PLAIN)) | dict.fromkeys(fn.ACCENTED[len(fn.PLAIN) :]))

    def _bin(self, term: str) -> int:
        found = self.bins.get(term)
        if found is None:
            h, units = embedding.FNV_OFFSET, term.encode("utf-16-be")
            for i in range(0, len(units), 2):
                h = ((h ^ (units[i] << 8 | units[i + 1])) * embedding.FNV_PRIME) & 0xFFFFFFFF
            found = self.bins[term] = h % self.dimension
        return found

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray | str]:
        out: list[np.ndarray | str] = []
        for text in texts:
            terms = re.findall(r"[^\W_]+", text.lower().translate(self.accents))
            if self.refused and self.refused.search(text):
                out.append("INPUT_REFUSED")
            elif not terms:
                out.append("INPUT_EMPTY")
            else:
                counts = np.bincount([self._bin(t) for t in terms], minlength=self.dimension).astype(np.float64)
                out.append(counts / np.sqrt((counts * counts).sum()))
        return out


def _embedded(make: Callable[[], Embedder]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()  # one for each task
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                texts = part.column(2).to_pylist()
                try:
                    found = embed(texts)
                except Exception:  # the batch is no use to anyone: each text for itself
                    found = []
                    for text in texts:
                        try:
                            found += embed([text])
                        except Exception as failure:
                            found.append(f"EMBEDDER_FAILED: {type(failure).__name__}")
                vectors = [[] if isinstance(x, str) else x.tolist() for x in found]
                errors = [x if isinstance(x, str) else None for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], ["document_id", "chunk_id", "vector", "error"])

    return run


def embedded(chunks: DataFrame, make: Callable[[], Embedder], template: str | None = None) -> DataFrame:
    """document_id, chunk_id, vector and error of every chunk (document_id, chunk_id, content): an empty vector where there is an error. An embedder that fails on a batch sees its texts one by one."""
    types = dict(chunks.select("document_id", "chunk_id").dtypes)
    asked = chunks.select("document_id", "chunk_id", embedding.templated(F.col("content"), template).alias("content"))
    return asked.mapInArrow(_embedded(make), f"document_id {types['document_id']}, chunk_id {types['chunk_id']}, vector array<double>, error string")


def run(chunks: DataFrame, builds: DataFrame, make: Callable[[], Embedder], dimensions: int, model: str, now: int, template: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The manifest after the job, the vectors of its new builds (build_id, document_id, chunk_id, vector), and its errors (document_id, chunk_id, error).

    What was embedded is written once, so a lost executor costs the chunks that it had. A
    document with an error in any chunk keeps the build that it had, and the new one is
    marked as failed; the others' new builds become active, and what they supersede is
    pruned but for the newest.
    """
    found = materialise(embedded(chunks, make, template), "embedded")
    after = materialise(versions.posted(builds, found.select("document_id", "chunk_id", "vector"), dimensions, model, now), "builds")
    new = after.filter((F.col("created_at") == now) & F.col("is_active")).select("document_id", "build_id")
    return after, found.filter("error is null").join(new, "document_id").select("build_id", "document_id", "chunk_id", "vector"), found.filter("error is not null").select("document_id", "chunk_id", "error")
