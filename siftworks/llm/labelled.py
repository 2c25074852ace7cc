"""Labelled samples for the trained scores, and a small logistic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Labelled rows that a model is fitted on at most, of each label, and the bytes of text that such a row may have; the rows of the least hashes are taken.
SAMPLE_PER_LABEL, SAMPLE_BYTES = 2500, 100_000


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text divides by 5. A null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int = SAMPLE_PER_LABEL) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `per_label` rows of either label, none held out; bounded in rows and bytes whatever the corpus."""
    marked = labels.filter(f"doc_id IS NOT NULL AND {label} IN (0, 1)").filter(~held_out(F.col("doc_id")))
    picked = None
    for value in (0, 1):
        ids = marked.filter(F.col(label) == value).select("doc_id", F.col(label).alias("label")).distinct()
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = ids if picked is None else picked.unionByName(ids)
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(picked), "doc_id")
    rows = rows.select("doc_id", "text", "label").limit(8 * per_label).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    texts, marks = rows.column("text").to_pylist(), rows.column("label").to_numpy()
    return [texts[i] for i in order], marks[order].astype(np.float64)


def scores(model, lines: int | None = None):
    """An Arrow function from texts to a model's scores, in slices of bounded bytes, and lines if asked for."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            made = [model(b.column("text").to_pylist()) for b in pieces(batch, lines=lines)]
            yield pa.array(np.concatenate([np.zeros(0), *made]), pa.float64())

    return score


class Logistic:
    """Logistic regression on standardised features by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(30):
            p = self._p(z @ self.w)
            keep = np.full(z.shape[1], ridge)
            keep[-1] = 1e-6
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    @staticmethod
    def _p(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._p(self._z(x) @ self.w)
