"""Audit of how far the sources of a language differ in the words they use.

A document counts for its (language, source).  Terms are runs of letters, A-Z lower-cased; a language keeps those in at least ``min_docs`` of its
documents (V of them).  A source gives a term the share ``p = 1 + floor(10^9 (n + 1) / (N + V))``, where n counts the term there and N all kept
ones; so does the language as a whole.  Two shares differ by ``floor((p - q)^2 / q)``.

1. *Inverted index.*  Tasks count the terms of a batch of texts, Spark adds up, and each term gets its postings: one entry (source, n) for
   each source that has it.
2. *Baseline.*  A pair of sources starts as if no term occurred in either: V times the difference of zero counts.
3. *Corrections.*  Only postings change that.  A term that one source has ``n`` times, against a source without it, has a correction that depends on ``n`` alone, so a
   histogram of the counts of each source gives all of these.  What both have adds ``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)``;
   these meet in the postings and are counted by (source, source, n, n) before anything is computed.
4. *Ranks.*  By value and the bytes of the item: all other sources, and the first ``top`` terms that a source has above its language's share.

All arithmetic is in integers and decimals.  Null texts, languages and sources are empty ones.  A group without terms still has its pairs, and with V = 0
their value is 0.  Rows count as often as they are there.  Other columns are ignored, whatever their names; an empty table gives no rows.
A text is handled as a whole; tasks hold a small multiple of its size or of ``PIECE_BYTES``.  A term's postings have one entry for each source at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import best, offsets_of, written
from llm.words import NOT_LETTER, Piece, pieces

PIECE_BYTES = 4 << 20
SALTS = 32  # parts of a language where its sources meet
UNIT = 1_000_000_000


def _terms(piece: Piece, group: np.ndarray, langs: pa.Array, sources: pa.Array) -> pa.RecordBatch | None:
    """Occurrences and documents of each term of a piece by group; ``group``: a number for each text, its language and source are at that place."""
    code, words = piece.codes()
    if not len(code):
        return None
    keys, n = np.unique(piece.owner() * len(words) + code, return_counts=True)  # one entry for each text and term
    keys = group[keys // len(words)] * len(words) + keys % len(words)
    order = np.argsort(keys, kind="stable")
    cut = offsets_of(keys[order])
    keys = keys[order][cut[:-1]]
    at, term = pa.array(keys // len(words)), words.take(pa.array(keys % len(words))).cast(pa.string())
    sums = [pa.array(np.add.reduceat(n[order], cut[:-1]).astype(np.int64)), pa.array(np.diff(cut))]
    return pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), term, *sums], ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (1, 2))
        both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        seen, group = np.unique(both, return_inverse=True)
        langs = lang.dictionary.take(pa.array(seen // max(1, len(source.dictionary))))
        sources = source.dictionary.take(pa.array(seen % max(1, len(source.dictionary))))
        for piece in pieces(batch.column(0), NOT_LETTER, PIECE_BYTES):
            out = _terms(piece, group[piece.first : piece.first + piece.n], langs, sources)
            if out is not None:
                yield out


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3) -> DataFrame:
    """``lang``, ``term``, ``total`` and ``by`` (source, n) of the terms in at least ``min_docs`` documents of the language."""
    rows = docs.select(*(F.coalesce(F.col(old).cast("string"), F.lit("")).alias(new) for old, new in ((text, "text"), (lang, "lang"), (source, "source"))))
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by"))
    return by.where(F.col("docs") >= min_docs).drop("docs")


def _share(n: str, size: str) -> str:
    """``size``: all occurrences of kept terms and the number of these."""
    return f"(1 + cast({UNIT} AS decimal(10)) * cast({n} + 1 AS decimal(19)) div cast({size} AS decimal(19)))"


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _times(h: str, value: str) -> str:
    return f"cast({h} AS decimal(19)) * cast({value} AS decimal(19))"


def _sizes(docs: DataFrame, found: DataFrame, lang: str, source: str) -> DataFrame:
    """Each (lang, source) with ``size``, its language's ``v`` and ``lang_size``, and ``p0``, its share for a count of zero."""
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    mine = found.selectExpr("lang", "inline(by)").groupBy("lang", "source").agg(F.sum("n").alias("mine"))
    whole = found.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole"))
    sizes = groups.join(mine, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["mine", "whole", "v"])
    sizes = sizes.selectExpr("lang", "source", "v", "mine + v AS size", "whole + v AS lang_size")
    return sizes.withColumn("p0", F.when(F.col("v") > 0, F.expr(_share("0", "size"))))


def _partners(rows: DataFrame, sizes: DataFrame, deal: str) -> DataFrame:
    """``rows`` of a source with each other source (``item``, ``q0``) of the language; ``deal``, an expression, spreads those of a language."""
    others = sizes.selectExpr("lang", "source AS item", "p0 AS q0", f"explode(sequence(0, {SALTS - 1})) AS salt")
    return rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64({deal}), {SALTS}) AS int)")).join(others, ["lang", "salt"]).where("source <> item").drop("salt")


def _pairs(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``p0``, ``q0`` and ``value`` of all ordered pairs of sources of a language."""
    base = _partners(sizes, sizes, "source")
    share = sizes.select("lang", "source", "size", "p0")

    counts = found.selectExpr("lang", "inline(by)").groupBy("lang", "source", "n").agg(F.count("*").alias("h"))
    alone = _partners(counts.join(share, ["lang", "source"]).withColumn("p", F.expr(_share("n", "size"))), sizes, "n")
    there, back = _times("h", f"({_apart('p', 'q0')} - {_apart('p0', 'q0')})"), _times("h", f"({_apart('q0', 'p')} - {_apart('q0', 'p0')})")

    both = found.selectExpr("lang", "by", "posexplode(by) AS (i, x)").selectExpr("lang", "x", "explode(slice(by, i + 2, size(by))) AS y")
    both = both.groupBy("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count("*").alias("h"))
    both = both.join(share, ["lang", "source"]).join(share.selectExpr("lang", "source AS item", "size AS item_size", "p0 AS q0"), ["lang", "item"])
    both = both.withColumns({"p": F.expr(_share("n", "size")), "q": F.expr(_share("m", "item_size"))})
    more = [_times("h", f"({_apart(p, q)} - {_apart(p, q0)} - {_apart(p0, q)} + {_apart(p0, q0)})") for p, q, p0, q0 in (("p", "q", "p0", "q0"), ("q", "p", "q0", "p0"))]

    def two_ways(rows: DataFrame, there: str, back: str) -> DataFrame:
        return rows.selectExpr("lang", f"inline(array(struct(source, item, {there} AS c), struct(item AS source, source AS item, {back} AS c)))")

    corrections = two_ways(alone, there, back).unionByName(two_ways(both, *more)).groupBy("lang", "source", "item").agg(F.sum("c").alias("c"))
    value = F.expr(f"cast(if(v = 0, 0, {_times('v', _apart('p0', 'q0'))} + coalesce(c, 0)) AS bigint)")
    return base.join(corrections, ["lang", "source", "item"], "left").withColumn("value", value)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.  ``pair``: item is another source of the language.  ``term``: item is a term
    that the source has above its language's share; ``p`` and ``q`` are both shares (for pairs, those of a count of zero; null with V = 0)."""
    found = written(postings(docs, text, lang, source, min_docs), "postings")
    sizes = written(_sizes(docs, found, lang, source), "sizes")
    pairs = _pairs(found, sizes).selectExpr("lang", "source", "'pair' AS part", "item", "p0 AS p", "q0 AS q", "value")
    order = [F.desc("value"), "item"]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    terms = found.selectExpr("lang", "term AS item", "total", "inline(by)").join(sizes, ["lang", "source"])
    terms = terms.withColumns({"p": F.expr(_share("n", "size")), "q": F.expr(_share("total", "lang_size"))}).where("p > q").withColumn("value", F.expr(_apart("p", "q")))
    terms = best(terms.select("lang", "source", F.lit("term").alias("part"), "item", "p", "q", "value"), ["lang", "source"], order, "item", top)
    return pairs.unionByName(terms)
