"""Quality rules by weak supervision.

Each rule votes good, votes bad or abstains.  Documents are counted by their pattern of votes (a
few thousand patterns at most, whatever the number of documents), expectation-maximisation over
these counts estimates how often each rule votes and how often it is right, and a document is kept
if the posterior probability of being good is at least one half.

Null and empty texts have no words: all measures are 0, base_failed is true and kept is false.
Repeated rows get equal results, an empty table gives an empty result, and further columns of the
input may have any name (only the id and the text are read).  A very long text is measured as a whole.  The prior votes are worth a fixed
share of all documents, so they weigh alike at every size; they keep good and bad from changing places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import map_pieces, per_text
from llm.words import Piece, hash_spans, mix, shingles

REPEAT_WIDTH = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = np.isin(np.arange(256), np.arange(65, 91))
LETTER = UPPER | np.isin(np.arange(256), np.arange(97, 123))
ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\"')", np.uint8))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_ascii_letters", "n_letters"]


def repeated_words(piece: Piece, width: int = REPEAT_WIDTH) -> np.ndarray:
    """Whether each word is in a window of ``width`` words that the text has twice or more."""
    keys, owner = shingles(hash_spans(piece.raw, piece.starts, piece.ends), piece.word_bounds, width)
    keys = keys ^ mix(owner.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(len(piece.starts) + 1, np.int64)
    if len(twice):
        counts = np.diff(piece.word_bounds)
        runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
        first = piece.word_bounds[:-1][owner] + np.arange(len(owner)) - (np.cumsum(runs) - runs)[owner]
        at = np.searchsorted(twice, keys)
        begin = first[twice[np.minimum(at, len(twice) - 1)] == keys]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + width, -1)
    return np.cumsum(cover)[:-1] > 0


def measure_piece(piece: Piece, rows: pa.RecordBatch) -> pa.RecordBatch:
    inside = np.zeros(len(piece.raw) + 1, np.int8)
    inside[piece.starts] += 1
    inside[piece.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    n_lines, n_dup, n_ended = [], [], []
    for i in range(piece.n):
        lines = [s for s in piece.text(i).split(b"\n") if s.strip()]
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
        n_ended.append(sum(ENDS[s.rstrip()[-1]] for s in lines))
    columns = [
        np.diff(piece.word_bounds),
        per_text(inside & ((piece.raw & 0xC0) != 0x80), piece.bounds),
        per_text(SYMBOLS[piece.raw], piece.bounds),
        n_dup,
        per_text(repeated_words(piece), piece.word_bounds),
        n_lines,
        n_ended,
        per_text(UPPER[piece.raw], piece.bounds),
        per_text(LETTER[piece.raw], piece.bounds),
        per_text(LETTER[piece.raw] | (piece.raw >= 0xC0), piece.bounds),  # ASCII letters and characters beyond ASCII
    ]
    return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in columns)], [rows.schema.names[0], *MEASURES])


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and the measures of each whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    return map_pieces(docs.select(doc_id, text), text, measure_piece, schema)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """1: good, -1: bad, 0: abstains.  Counts of 0 divide as 1."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    c = F.col
    mean = c("word_chars") / words
    return {
        "length": _vote(c("n_words") >= 40, c("n_words") < 20),
        "word_length": _vote(mean.between(3, 8), (mean < 2) | ((mean > 15) & (2 * c("n_ascii_letters") > c("word_chars")))),
        "symbols": _vote(c("n_symbols") == 0, c("n_symbols") > 0.1 * words),
        "letters": _vote(c("n_letters") >= 0.95 * c("word_chars"), c("n_letters") < 0.9 * c("word_chars")),
        "duplicate_lines": _vote(c("n_dup_lines") == 0, c("n_dup_lines") > 0.3 * lines),
        "repetition": _vote(c("n_repeat_words") <= 0.05 * words, c("n_repeat_words") > 0.3 * words),
        "capitals": _vote(c("n_upper") <= 0.2 * c("n_ascii_letters"), c("n_upper") > 0.5 * c("n_ascii_letters")),
        "line_ends": _vote(c("n_ended") >= 0.7 * lines, (c("n_lines") >= 5) & (c("n_ended") < 0.1 * lines)),
    }


@dataclass
class LabelModel:
    """P(vote | class) for each rule and the share of good documents."""

    good: np.ndarray  # rules x (bad vote, abstains, good vote)
    bad: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(votes.shape[1])
        a = np.log(self.prior) + np.log(self.good[at, votes + 1]).sum(1)
        b = np.log(1 - self.prior) + np.log(self.bad[at, votes + 1]).sum(1)
        return 1 / (1 + np.exp(np.clip(b - a, -500, 500)))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, strength: float = 0.3) -> LabelModel:
    """Expectation-maximisation over vote patterns.  A good document seldom breaks a rule and a bad one breaks few of
    the rules, so at the start a bad vote says more than a good one; prior votes worth the share ``strength`` of all documents keep it from turning round."""
    n = max(1.0, float(counts.sum()))
    prior_good, prior_bad = np.array([0.004, 0.146, 0.85]), np.array([0.2, 0.05, 0.75])
    k = votes.shape[1]
    model = LabelModel(np.tile(prior_good, (k, 1)), np.tile(prior_bad, (k, 1)), 0.8)
    for _ in range(rounds):
        p = model.posterior(votes) * counts if len(votes) else np.zeros(0)
        q = counts - p
        tables = []
        for weight, prior in ((p, prior_good), (q, prior_bad)):
            table = np.stack([[weight[votes[:, j] == v].sum() for v in (-1, 0, 1)] for j in range(k)]) + strength * n * prior
            tables.append(table / table.sum(1, keepdims=True))
        share = float(np.clip((p.sum() + 0.8 * strength * n) / (n * (1 + strength)), 0.01, 0.99))
        model = LabelModel(tables[0], tables[1], share)
    return model


def score(measured: DataFrame, votes: dict[str, Column] | None = None) -> DataFrame:
    """``measured`` with ``votes`` (array) and ``quality`` (posterior probability of being good).
    ``measured`` is read twice: for the counts of patterns and for the result."""
    votes = votes or rules()
    voted = measured.withColumn("votes", F.array(*votes.values()))
    seen = voted.groupBy("votes").count().collect()  # 3 ** len(votes) rows at most
    patterns = np.array([r["votes"] for r in seen], int).reshape(len(seen), len(votes))
    counts = np.array([r["count"] for r in seen], float)
    posterior = fit(patterns, counts).posterior(patterns) if seen else []
    known = measured.sparkSession.createDataFrame(
        [(list(map(int, v)), float(p)) for v, p in zip(patterns, posterior, strict=True)], "votes array<int>, quality double"
    )
    return voted.join(F.broadcast(known), "votes", "left")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 20, max_repeated: int = 30) -> DataFrame:
    """Id, measures, votes, quality, base_failed (too few words, or more than ``max_repeated`` per cent
    of them repeated) and kept (false if base_failed, else quality of one half or more)."""
    from llm.common import materialize

    scored = score(materialize(measures(docs, doc_id, text)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= 0.5))
