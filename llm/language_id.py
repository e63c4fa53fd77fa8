"""Language identification with language-bitmask n-gram filters.

The byte 4-grams of all training texts are counted by language.  A language holds a gram if the gram makes
up at least ``MIN_RATE`` of the language's grams and at least ``MIN_SHARE`` of its highest rate in any
language.  The grams held go into bit-sliced Bloom filters: one table of slots whose words have a bit for each
language, so ``HASHES`` look-ups and an AND give all languages that hold a gram.  For a text the languages' bits
are counted over all its grams, each count is corrected for the filter's false positives (the share of
slots with the language's bit, to the power HASHES), and the highest count decides.

Grams are counted by Spark's own aggregation, after each task has added up its own.  At most ``1 / MIN_RATE`` grams of a language
reach the driver; the table has eight slots at least for each gram of the language that holds most.

Null texts and texts without a letter are ``und`` with score 0.  Texts without any known gram get the language
with most training grams and score 0; ties go to the first language in code point order.  Training rows
without text or language teach nothing.  Without training rows every text is ``und``.  Repeated rows count each time.  An empty table
gives an empty result; columns named ``lang_pred`` or ``score`` are replaced, others pass through.  A very long text is one piece.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import materialize
from llm.words import _LOWER, Piece, mix, pieces

MIN_RATE, MIN_SHARE = 2e-6, 0.2
HASHES = 3
HELD_GRAMS = 1_000_000  # distinct ones that a task adds up before it sends them
UNKNOWN = "und"


def grams(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of each text with a space before and after it, A-Z lower-cased, and the first gram of each text."""
    n, size = piece.n, np.diff(piece.bounds)
    padded = np.full(len(piece.raw) + n + 1, 32, np.uint8)
    padded[np.arange(len(piece.raw)) + np.repeat(np.arange(n), size) + 1] = _LOWER[piece.raw]
    padded[(padded >= 9) & (padded <= 13)] = 32
    wide = padded.astype(np.uint32)
    all_grams = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:] if len(wide) > 3 else np.zeros(0, np.uint32)
    # a text with its two spaces has size + 2 - 3 grams; those across two texts go
    counts = np.maximum(size - 1, 0)
    begin = piece.bounds[:-1] + np.arange(n)
    at = np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    return all_grams[at], np.concatenate(([0], np.cumsum(counts)))


def _has_letter(piece: Piece) -> np.ndarray:
    raw = piece.raw | 32
    total = np.concatenate(([0], np.cumsum((raw >= 97) & (raw <= 122) & (piece.raw < 128))))
    out = total[piece.bounds[1:]] > total[piece.bounds[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in piece.text(i).decode())
    return out


@dataclass
class LanguageFilter:
    languages: list[str]
    default: str
    table: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray

    def slots(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        hashed = mix(keys.astype(np.uint64) + np.uint64(1))
        step = hashed >> np.uint64(32) | np.uint64(1)
        for i in range(HASHES):
            yield ((hashed + np.uint64(i) * step) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def counts(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Grams of each text that each language holds, corrected for false positives."""
        held = self.table[next(iter(self.slots(keys)))]
        for i, at in enumerate(self.slots(keys)):
            held = held & self.table[at] if i else held
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        for k in range(len(self.languages)):
            bit = (held[:, k // 64] >> np.uint64(k % 64)).astype(np.uint8) & 1
            total = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
            out[:, k] = total[first[1:]] - total[first[:-1]]
        return np.maximum((out - self.false_rate * n[:, None]) / (1 - self.false_rate), 0)

    def predict(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: unknown) and score of each text."""
        if not self.languages:
            return np.full(piece.n, -1), np.zeros(piece.n)
        counts = self.counts(*grams(piece))
        best, total = counts.argmax(1), counts.sum(1)
        top = counts[np.arange(piece.n), best]
        best = np.where(total > 0, best, self.languages.index(self.default))
        letter = _has_letter(piece)
        return np.where(letter, best, -1), np.where(letter & (total > 0), top / np.maximum(total, 1e-9), 0.0)


def build(held: dict[str, np.ndarray], sizes: dict[str, int]) -> LanguageFilter:
    """The filter of the grams that each language holds."""
    languages = sorted(held)
    words = max(1, -(-len(languages) // 64))
    slots = 1 << max(16, (8 * max((len(x) for x in held.values()), default=0)).bit_length())
    out = LanguageFilter(languages, min(languages, key=lambda x: (-sizes[x], x)) if languages else UNKNOWN, np.zeros((slots, words), np.uint64), np.zeros(len(languages)))
    for k, language in enumerate(languages):
        bit = np.uint64(1) << np.uint64(k % 64)
        for at in out.slots(held[language]):
            out.table[at, k // 64] |= bit
        out.false_rate[k] = ((out.table[:, k // 64] & bit) != 0).mean() ** HASHES
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", min_rate: float = MIN_RATE, min_share: float = MIN_SHARE) -> LanguageFilter:
    """Learn from all rows of ``docs`` with text and language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = defaultdict(list)

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in seen.items():
                keys, n = _add(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])
            seen.clear()

        for batch in batches:
            names = batch.column(1).to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column(0)):
                keys, first = grams(piece)
                mine = names[piece.first : piece.first + piece.n]
                for name in set(mine):
                    chosen = keys[np.repeat(mine == name, np.diff(first))]
                    seen[name].append(np.unique(chosen, return_counts=True))
                    if len(seen[name]) > 32:
                        seen[name] = [_add(seen[name])]
                if sum(len(p[0]) for parts in seen.values() for p in parts) > 4 * HELD_GRAMS:
                    seen = defaultdict(list, {name: [_add(parts)] for name, parts in seen.items()})
                    if sum(len(parts[0][0]) for parts in seen.values()) > HELD_GRAMS:
                        yield from flush()
        yield from flush()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = materialize(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))  # a row for each language
    sizes = {r["lang"]: r["total"] for r in total.collect()}
    rate = F.col("n") / F.col("total")
    often = counted.join(F.broadcast(total), "lang").select("lang", "gram", rate.alias("rate")).where(F.col("rate") >= min_rate)
    # a gram has one row for each language at most
    shared = often.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("by"))
    held = shared.select("gram", F.explode(F.filter("by", lambda x: x["rate"] >= min_share * F.col("top"))["lang"]).alias("lang"))
    got = held.toArrow()  # 1 / min_rate grams a language at most
    keys, names = got.column("gram").to_numpy().astype(np.uint32), got.column("lang").to_numpy(zero_copy_only=False)
    return build({name: np.sort(keys[names == name]) for name, n in sizes.items() if n}, sizes)


def _add(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    unique, back = np.unique(keys, return_inverse=True)
    return unique, np.bincount(back, np.concatenate([p[1] for p in parts]), len(unique)).astype(np.int64)


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on min_rate and the languages, not on the texts
    fields = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    names = [f.name for f in fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of = np.array([*sent.value.languages, UNKNOWN], object)
        for batch in batches:
            for piece in pieces(batch.column(text)):
                rows = batch.slice(piece.first, piece.n)
                best, score = sent.value.predict(piece)
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(names_of[best], pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
