"""Phrases of a language whose words keep company more often than their parts do alone.

A text is cut into pieces at ``.,;:!?`` and line ends, a piece into words at blanks and tabs, A-Z lower-cased.  A phrase is a run of up to
``max_words`` words of a piece; all its occurrences count, overlapping ones included.

1. *Rows.*  Tasks turn texts into rows (language, phrase, n): first all words and pairs of words, then the longer phrases.  What a batch of
   texts says more than once is one row, told apart by the words themselves, and Spark adds the rows up for each language.  A phrase
   can't be more frequent than its parts, so the second pass leaves out those with a rare pair: a bit map of the frequent pairs (bounded by
   ``FILTER_BITS``) decides, and a false positive there only costs a row.  So no frequent phrase is lost at any size.
2. *Cuts.*  A phrase with ``a >= min_count`` is cut after each of its words; the counts ``l`` and ``r`` of both parts are joined to it, and
   ``floor(2000000 * a / (l + r))`` is taken in decimals.  The lowest cut counts, of equal ones the first.
3. *Extensions.*  A phrase goes if one of a word more has it inside and is nearly as frequent (``inside`` percent).  Phrases of more words than
   that hold one of a word more that is at least as frequent, so those needn't be looked at.
4. *Ranks.*  By score, count and the bytes of the phrase, first within slices of a language, then over what the slices keep.

Null texts are empty and have no words; a null language is ``und`` (an empty one is a language of its own).  Rows count as often as they are there.
Other columns are ignored, whatever their names; an empty table, or one without frequent phrases, gives no rows.  A text is handled as
a whole; tasks hold a small multiple of its size or of ``PIECE_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import best, written
from llm.words import Piece, mix, pieces

PIECE_BYTES = 2 << 20
FILTER_BITS = 1 << 29
SCALE = 2_000_000
UNKNOWN = "und"
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
APART = BREAK.copy()
APART[[ord(" "), ord("\t")]] = True
_ROWS = "lang string, phrase string, words int, n long"


def _hashes(values: pa.Array) -> np.ndarray:
    """A hash of each value as a whole; 0 for an empty one."""
    out = np.zeros(len(values), np.uint64)
    for piece in pieces(values, np.zeros(256, bool)):
        out[piece.first + np.flatnonzero(np.diff(piece.word_bounds))] = piece.hashes()
    return out


def _spot(lang: np.ndarray, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a pair of words, from the hashes of the language and both."""
    key = lang * np.uint64(0x9E3779B97F4A7C15) + first * np.uint64(0xD6E8FEB86659FD93) + second
    return (mix(key) & np.uint64(bits - 1)).astype(np.int64)


def _phrases(piece: Piece, lang: np.ndarray, names: pa.Array, widths: range, frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of the distinct phrases of ``widths`` words of a piece and, with its words, their number by language (``words`` 0).  ``lang``:
    the place in ``names`` for each text.  ``frequent``: the bit map of pairs."""
    code, words = piece.codes()
    if not len(code):
        return
    owner = piece.owner()
    part = np.cumsum(BREAK[piece.raw], dtype=np.int32)[piece.starts] + owner  # grows wherever a piece of a text ends
    lang = lang[owner]
    fits, number, n_single = np.ones(len(code) + 1, bool), np.zeros(len(code), np.int64), 1
    single = lang * len(words) + code
    for width in range(1, widths[-1] + 1):
        at = np.flatnonzero(part[width - 1 :] == part[: len(part) - width + 1])
        at = at[fits[at] & fits[at + 1]] if width > 2 else at
        if not len(at):
            return
        _, first, back, n = np.unique(number[at] * n_single + single[at + width - 1], return_index=True, return_inverse=True, return_counts=True)
        first = at[first]
        number = np.zeros(len(code), np.int64)
        number[at] = back
        if width == 1:
            single, n_single = number, len(n)
        if width in widths:
            phrase = pc.binary_join_element_wise(*(words.take(pa.array(code[first + k])) for k in range(width)), pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield _batch(names.take(pa.array(lang[first])), phrase, width, n)
        if width == 1 and width in widths:
            n = np.bincount(lang, minlength=len(names))
            yield _batch(names, pa.array([""] * len(names)), 0, n)
        if width > 1:
            fits = np.zeros(len(code) + 1, bool)
            fits[at] = True
        if width == 2 and frequent is not None:
            keys, langs = _hashes(words), _hashes(names)
            spot = _spot(langs[lang[first]], keys[code[first]], keys[code[first + 1]], 8 * len(frequent))
            fits[at] = (frequent[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)[back]


def _batch(lang: pa.Array, phrase: pa.Array, words: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(n), words, np.int32)), pa.array(n.astype(np.int64))], ["lang", "phrase", "words", "n"])


def _counted(rows: DataFrame, widths: range, min_count: int, frequent: Broadcast | None = None) -> DataFrame:
    """Phrases of ``widths`` words with at least ``min_count`` occurrences in a language; with ``words`` 0, the number of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).dictionary_encode()
            number, names = found.indices.to_numpy().astype(np.int64), found.dictionary
            for piece in pieces(batch.column(0), APART, PIECE_BYTES):
                yield from _phrases(piece, number[piece.first : piece.first + piece.n], names, widths, frequent and frequent.value)
            pa.default_memory_pool().release_unused()

    sums = rows.mapInArrow(run, _ROWS).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return sums.where((F.col("n") >= min_count) | (F.col("words") == 0))


def _bit_map(pairs: DataFrame, most: int) -> np.ndarray:
    """The bits of all ``pairs`` (lang, phrase), ``most`` at most."""
    bits = 1 << min(most.bit_length() - 1, max(20, (64 * pairs.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, first, second = (_hashes(batch.column(k)) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(_spot(lang, first, second, bits))], ["p"])

    words = pairs.selectExpr("lang", "substring_index(phrase, ' ', 1) AS a", "substring_index(phrase, ' ', -1) AS b")
    marked = words.mapInArrow(run, "p long").groupBy(F.shiftright("p", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits"))
    table = np.zeros((bits >> 15, 4096), np.uint8)
    for row in marked.toLocalIterator():  # FILTER_BITS at most
        table[row["b"]] = np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 4, min_count: int = 30, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``n``: all phrases of up to ``max_words`` words with at least ``min_count`` occurrences in the language,
    and a row with 0 words and an empty phrase for the number of all its words."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    counts = written(_counted(rows, range(1, min(max_words, 2) + 1), min_count), "phrases")
    if max_words > 2:
        sent = docs.sparkSession.sparkContext.broadcast(_bit_map(counts.where("words = 2"), filter_bits))
        counts = counts.unionByName(written(_counted(rows, range(3, max_words + 1), min_count, sent), "long-phrases"))
    return counts


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 4, min_count: int = 30, inside: int = 80, top: int = 2000, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The best ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` and ``words``."""
    counts = frequent_phrases(docs, text, lang, max_words, min_count, filter_bits)
    phrases = counts.where("words > 1").withColumnRenamed("n", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.selectExpr("*", "substring_index(phrase, ' ', k) AS left", "substring_index(phrase, ' ', k - words) AS right")
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.where("words > 0").select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    score = F.expr(f"cast({SCALE} AS decimal(8)) * cast(a AS decimal(19)) div cast(l + r AS decimal(19))")
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")

    longer = counts.where("words > 2").selectExpr("lang", "n", "explode(array(substring_index(phrase, ' ', words - 1), substring_index(phrase, ' ', 1 - words))) AS phrase")
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("m")).alias("longer")
    scored = scored.alias("scored")
    same = (F.col("scored.lang") == F.col("longer.lang")) & (F.col("scored.phrase") == F.col("longer.phrase"))
    kept = scored.join(longer, same & (100 * F.col("m") >= inside * F.col("a")), "left_anti")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = best(kept, ["lang"], order, "phrase", top).withColumn("rank", F.col("rank").cast("long"))
    return ranked.join(counts.where("words = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words")
