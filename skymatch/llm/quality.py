"""Quality classifier by Bradley-Terry ranking.

Scores are learned from preference pairs: a document labelled 1 is preferred
to one labelled 0. The threshold is the quantile of the training scores at the
share of label 0, and a document's score is the Bradley-Terry chance that it
beats a document at the threshold, so 0.5 is the border.

The model is fitted on at most ``sample`` labelled rows, the ones with the
smallest hash of their id. Every document is scored, on its whole text and on
nothing but its text.

Defined results: null and empty texts get the score of an empty text; a null id
is scored and never learned from; an id with both labels counts for both, null
labels not at all; of several documents under a labelled id the one of the smallest
text is learned from; without rows of both labels every score is 0.5; repeated rows
are scored each; an empty table gives no rows; other columns stay, but for one named
``quality_score``, which `scored` replaces and `accepted` keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batched
from .features import WIDTH, features, rank_weights, scaling, standard

#: Labelled rows to learn from, at most.
SAMPLE = 8_000


@dataclass
class Ranker:
    """``score(x) = 1 / (1 + exp(-(standard(x) . weights - threshold)))``"""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(standard(x, self.mean, self.spread) @ self.weights - self.threshold, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, sample: int = SAMPLE) -> Ranker:
    """Learn from ``labels(doc_id, quality)``; ``where`` restricts its rows (over ``doc_id``)."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = (known if where is None else known.where(where)).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(0).to_pylist()], "f4").reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["quality", "x"])

    # at most `sample` rows of two numbers are broadcast, and as many gathered
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = batched(found.select("text", "quality")).mapInArrow(run, "quality int, x binary").collect()
    x = np.array([np.frombuffer(r["x"], "f4") for r in rows]).reshape(-1, WIDTH)
    y = np.array([r["quality"] for r in rows])
    order = np.lexsort((*x.T[::32], y))  # the same rows in any order give the same model
    x, y = x[order], y[order]
    if len(set(y.tolist())) < 2:
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    mean, spread = scaling(x)
    z = standard(x, mean, spread)
    weights = rank_weights(z[y == 1], z[y == 0])
    ranked = np.sort(z @ weights)
    low = int((y == 0).sum())
    return Ranker(mean, spread, weights, float(ranked[low - 1] + ranked[low]) / 2)


def _with_scores(docs: DataFrame, model: Ranker, text_col: str) -> DataFrame:
    """``(row, score)``, ``row`` being the document's own row, in the documents' own partitions: no shuffle."""

    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column(0).flatten()[at]  # the text travels once, inside its row
                x = np.array([features(t) for t in texts.to_pylist()], "f4").reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x))], ["row", "score"])

    rows = docs.select(F.struct("*").alias("row"))
    return batched(rows).mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``quality_score``."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "quality_score"]
    return _with_scores(docs, model, text_col).select(*kept, F.col("score").alias("quality_score"))


def accepted(docs: DataFrame, model: Ranker, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with the same columns."""
    return _with_scores(docs, model, text_col).where(F.col("score") >= least).select("row.*")
