"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(threshold_k - w . x)``: one weight vector over hashed byte trigrams of the
text, shared by all grades, and ascending thresholds.  The model gives the expected grade and the
tail probability that the grade reaches a wanted one.  With two grades it is logistic regression.

The fit uses at most ``max_labels`` rated documents, those with the lowest hash of their id, so the
sample is the same in every run.  Scoring reads every whole text in bounded pieces.

Null and empty texts have no trigrams and get the score of the thresholds alone.  Null ratings and
ratings of unknown documents are ignored; an id rated twice counts twice.  Without any ratings, or with
only one grade, every document gets that grade (0 if there is none) and a tail of 1.  An empty table gives an empty result.  Columns
named ``expected_grade`` or ``p_good`` are replaced by ``score`` and kept by ``reject``; others pass through.  A very long text is one row of counts, like
any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import map_pieces
from llm.words import Piece

BUCKETS = 2048
MAX_LABELS = 6000
TEXTS = 1024  # whose counts are held at once
_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)


def trigram_counts(piece: Piece) -> np.ndarray:
    """Hashed counts of the byte trigrams of each text: texts x BUCKETS."""
    raw = piece.raw.astype(np.uint32)
    if len(raw) < 3:
        return np.zeros((piece.n, BUCKETS), np.float32)
    hashed = raw[:-2] * _A + raw[1:-1] * _B + raw[2:] * _C
    hashed ^= hashed >> np.uint32(15)
    hashed = (hashed * _B) >> np.uint32(21)
    size = np.diff(piece.bounds)
    owner = np.repeat(np.arange(piece.n, dtype=np.int64), np.maximum(size - 2, 0))
    inside = np.ones(len(hashed), bool)
    for end in (piece.bounds[1:-1] - 1, piece.bounds[1:-1] - 2):  # trigrams across two texts
        inside[end[(end >= 0) & (end < len(hashed))]] = False
    if inside.sum() != len(owner):  # texts shorter than a trigram
        keep = np.repeat(np.arange(piece.n), size)[: len(hashed)]
        inside &= keep == np.repeat(np.arange(piece.n), size)[2:]
        owner = keep[inside]
    return np.bincount(owner * BUCKETS + hashed[inside], minlength=piece.n * BUCKETS).reshape(piece.n, BUCKETS).astype(np.float32)


def by_parts(piece: Piece, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``fn`` of the counts of all texts of the piece, a bounded number of texts at a time."""
    return np.concatenate([fn(trigram_counts(piece.part(a, min(a + TEXTS, piece.n)))) for a in range(0, piece.n, TEXTS)])


def features(counts: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)


@dataclass
class OrdinalModel:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each of the grades but the last."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds[None], -50, 50)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)

    def tail(self, tails: np.ndarray, grade: float) -> np.ndarray:
        """P(the rating is at least ``grade``)."""
        k = int(np.searchsorted(self.grades, grade))
        return np.ones(len(tails)) if k == 0 else np.zeros(len(tails)) if k == len(self.grades) else tails[:, k - 1]


def fit(x: np.ndarray, ratings: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> OrdinalModel:
    """Full-batch Adam on the likelihood; thresholds are a first one and positive increments."""
    grades = np.unique(ratings) if len(ratings) else np.zeros(1)
    k, n = len(grades) - 1, max(1, len(ratings))
    if k == 0:
        return OrdinalModel(grades.astype(float), np.zeros(x.shape[1] if x.ndim == 2 else BUCKETS, np.float32), np.zeros(0))
    y = np.searchsorted(grades, ratings)
    share = np.clip([(y <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    steps_up = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.concatenate((np.zeros(x.shape[1]), start[:1], steps_up))
    m, v, d = np.zeros_like(p), np.zeros_like(p), x.shape[1]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        thresholds = np.cumsum(np.concatenate((p[d : d + 1], np.exp(p[d + 1 :]))))
        ends = np.concatenate(([-np.inf], thresholds, [np.inf]))
        z = x @ p[:d].astype(np.float32)
        upper, lower = sig(ends[y + 1] - z), sig(ends[y] - z)
        lower[y == 0], upper[y == k] = 0, 1
        likely = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / likely, lower * (1 - lower) / likely  # of log P for the two ends
        g_ends = np.bincount(y + 1, du, k + 2)[1 : k + 1] - np.bincount(y, dl, k + 2)[1 : k + 1]
        g = np.concatenate((x.T @ (dl - du).astype(np.float32) - decay * n * p[:d], [g_ends.sum()], np.exp(p[d + 1 :]) * np.cumsum(g_ends[::-1])[::-1][1:])) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(grades.astype(float), p[:d].astype(np.float32), np.cumsum(np.concatenate((p[d : d + 1], np.exp(p[d + 1 :])))))


def rated_sample(docs: DataFrame, labels: DataFrame, rating: str, max_labels: int, doc_id: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Id, rating, text and ``extra`` columns of at most ``max_labels`` rated documents."""
    rated = labels.select(F.col(doc_id), F.col(rating).cast("double").alias("rating")).where(F.col(doc_id).isNotNull() & F.col("rating").isNotNull())
    chosen = rated.orderBy(F.xxhash64(F.col(doc_id), F.lit(17)), doc_id, "rating").limit(max_labels)
    return docs.select(doc_id, text, *extra).join(F.broadcast(chosen), doc_id)  # max_labels rows at most


def train(docs: DataFrame, labels: DataFrame, rating: str = "quality", max_labels: int = MAX_LABELS, doc_id: str = "doc_id", text: str = "text") -> OrdinalModel:
    def rows(piece: Piece, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = by_parts(piece, lambda c: np.minimum(c, 65535).astype(np.uint16))
        return pa.RecordBatch.from_arrays([batch.column("rating"), pa.array([c.tobytes() for c in counts], pa.binary()), batch.column(doc_id)], ["rating", "counts", "id"])

    kind = docs.schema[doc_id].dataType.simpleString()
    sample = rated_sample(docs, labels, rating, max_labels, doc_id, text)
    got = sorted(map(tuple, map_pieces(sample, text, rows, f"rating double, counts binary, id {kind}").collect()), key=lambda r: (str(r[2]), r[1], r[0]))
    x = np.stack([np.frombuffer(r[1], np.uint16) for r in got]).astype(np.float32) if got else np.zeros((0, BUCKETS), np.float32)
    return fit(features(x), np.array([r[0] for r in got]))


def score(docs: DataFrame, model: OrdinalModel, good_grade: float, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``p_good`` (the tail at ``good_grade``), without the text unless
    ``keep_text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in ("expected_grade", "p_good") and (keep_text or f.name != text)]
    names = [f.name for f in fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("expected_grade", T.DoubleType()), T.StructField("p_good", T.DoubleType())])

    def rows(piece: Piece, batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        tails = by_parts(piece, lambda c: m.tails(features(np.minimum(c, 65535))))
        out = [m.expected(tails), m.tail(tails, good_grade)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(np.asarray(c, float)) for c in out)], [*names, "expected_grade", "p_good"])

    return map_pieces(docs, text, rows, schema)


def reject(docs: DataFrame, labels: DataFrame, *, rating: str = "quality", good_grade: float = 1, min_tail: float = 0.5, doc_id: str = "doc_id", text: str = "text", max_labels: int = MAX_LABELS) -> DataFrame:
    """``docs``, all columns, without documents whose probability of ``good_grade`` is below ``min_tail``."""
    model = train(docs, labels, rating, max_labels, doc_id, text)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    row = docs.select((F.struct(*rest) if rest else F.lit(0)).alias("_row"), F.col(text).alias("text"))
    kept = score(row, model, good_grade, "text", keep_text=True).where(F.col("p_good") >= min_tail)
    return kept.select(*(F.col("text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns))
