"""Line dedup with a log-template tree.

A line's words with digits are variable fields (``*``).  Lines fall into the leaves of a tree of fixed
depth: first the number of words, then the first ``LEAD`` words.  Within a leaf, each word is counted at its place over all
distinct lines; the words of a line that are rarer there than its others become what most lines of the leaf have at that place or, where no word is common
enough, variable fields.  At least ``SIMILAR`` of a line's places stay (``templates`` has the rule), so a line agrees with its template in at least that share, and what is
found depends neither on the order of lines nor on how many there are.  A template that
is found in two different texts or more recurs: its lines are dropped, but for
those in the first document (lowest id) with the template, so that no content is lost altogether.

The lines of a few megabytes of text are first reduced to distinct ones, then to distinct ones over all texts, so
a line that stands in a third of all documents is one row for its leaf.  Most lines are alone in their leaf; the words of the
others are read from the texts again and are rows by word and place from then on, so no task ever holds a leaf.  Counts that many lines ask for are
broadcast (``HOT`` of them at most), so a common word at a common place is no hot key.  A line's places stay together by the chunk of text (a piece of a megabyte), so a very common line is a row for each chunk.

Null and empty texts have no lines; lines without words are neither counted nor dropped.  Exact copies of a
whole text are one text when recurrence is counted, so copies alone don't make all their lines recur.  Rows with
equal id and text get equal results; null ids come last when the first document is chosen.  An empty table gives an empty
result.  Further columns are ignored by the report and pass through ``drop_recurring``, whatever their names.  A very long text is read as a whole; it
takes a small multiple of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import materialize, offsets_of, written
from llm.words import Piece, mix, pieces

LEAD, SIMILAR = 3, 0.8
HOT = 50_000
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_WILD = np.uint64(0x2A2A2A2A2A2A2A2A)
_SCAN = "chunk long, leaf long, key long, low long, high long, first long, docs array<int>, lines array<int>"
_NO_ID = np.iinfo(np.int64).max


def _line_starts(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line with a word: index of its first word (and one past the last of all), its text, its number in the text."""
    breaks = np.flatnonzero(piece.raw == 10)
    before = np.searchsorted(breaks, piece.starts)  # line breaks before each word
    owner = piece.owner()
    new = np.ones(len(owner), bool)
    new[1:] = (before[1:] != before[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    number = before[first] - np.searchsorted(breaks, piece.bounds[:-1])[owner[first]]
    return np.concatenate((first, [len(owner)])), owner[first], number


def _keys(piece: Piece, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, those with digits wild; and key and leaf of each line."""
    words = piece.hashes()
    digits = np.concatenate(([0], np.cumsum(_DIGIT[piece.raw], dtype=np.int32)))
    words[digits[piece.ends] > digits[piece.starts]] = _WILD
    n = np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], n)
    mixed = mix(words * (mix(place.astype(np.uint64) + np.uint64(77)) | np.uint64(1)))
    key = mix(np.add.reduceat(mixed, first[:-1]) + n.astype(np.uint64))
    leaf = mix(np.add.reduceat(np.where(place < LEAD, mixed, np.uint64(0)), first[:-1]) ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return words, key, leaf


def _scan_piece(chunk: int, piece: Piece, ids: np.ndarray, digests: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each text (no leaf): its number in the piece, id, digest and number of lines; and one for each distinct line of the
    piece, in the order of their first places: the lowest and highest digest of its texts, their first document, and all its places."""
    names = [c.split()[0] for c in _SCAN.split(", ")]
    first, owner, number = _line_starts(piece)
    one = pa.array(np.arange(piece.n + 1), pa.int32())
    listed = lambda x, cut: pa.ListArray.from_arrays(cut, pa.array(x, pa.int32()))
    none = pa.nulls(piece.n, pa.int64())
    row = [pa.array(np.full(piece.n, chunk)), none, none, pa.array(digests), none, pa.array(ids), listed(np.arange(piece.n), one), listed(np.bincount(owner, minlength=piece.n), one)]
    yield pa.RecordBatch.from_arrays(row, names)
    if not len(piece.starts):
        return
    _, key, leaf = _keys(piece, first)
    order = np.argsort(key, kind="stable")
    edges = offsets_of(key[order])
    low, high, least = np.minimum.reduceat(digests[owner][order], edges[:-1]), np.maximum.reduceat(digests[owner][order], edges[:-1]), np.minimum.reduceat(ids[owner][order], edges[:-1])
    lead, size = order[edges[:-1]], np.diff(edges)
    turn = np.argsort(lead)
    lead, size = lead[turn], size[turn]
    order = order[np.arange(len(order)) + np.repeat(edges[:-1][turn] - (np.cumsum(size) - size), size)]
    cut = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
    longs = (np.full(len(lead), chunk), leaf[lead].view(np.int64), key[lead].view(np.int64), low[turn], high[turn], least[turn])
    yield pa.RecordBatch.from_arrays([*map(pa.array, longs), listed(owner[order], cut), listed(number[order], cut)], names)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column(1)):
                part = slice(piece.first, piece.first + piece.n)
                yield from _scan_piece(chunk, piece, ids[part], digests[part])
                chunk += 1

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)), F.col(text), F.xxhash64(text))
    return written(rows.mapInArrow(run, _SCAN), "lines")


def _words_of(docs: DataFrame, text: str, leaves: DataFrame) -> DataFrame:
    """leaf, key and words (hashes of 32 bits, 0: variable) of the distinct lines in ``leaves``, from the texts; a bit map of bounded
    size drops nearly all other lines."""
    bits = 1 << min(28, max(20, (64 * leaves.count()).bit_length()))
    spot = F.col("leaf").bitwiseAND(F.lit(bits - 1))
    marked = leaves.select(spot.alias("p")).groupBy(F.shiftright("p", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits"))
    table = np.zeros((bits >> 15, 4096), np.uint8)
    for row in marked.toLocalIterator():  # 32 MB at most
        table[row["b"]] = np.frombuffer(row["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(table.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                if not len(piece.starts):
                    continue
                first, _, _ = _line_starts(piece)
                words, key, leaf = _keys(piece, first)
                at = leaf & np.uint64(bits - 1)
                some = np.flatnonzero(sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                lead = some[np.unique(key[some], return_index=True)[1]]
                small = words.astype(np.uint32)
                small[small == 0] = 1
                small[words == _WILD] = 0
                n = np.diff(first)[lead]
                place = np.arange(n.sum()) + np.repeat(first[:-1][lead] - (np.cumsum(n) - n), n)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[lead].view(np.int64)), pa.array(key[lead].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(small[place].view(np.int32)))], ["leaf", "key", "words"])

    return docs.select(text).mapInArrow(run, "leaf long, key long, words array<int>").groupBy("leaf", "key").agg(F.first("words").alias("words"))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, limit: float) -> DataFrame:
    """``rows`` with the columns of ``table`` by ``key`` (null where it has none).  What more than ``limit`` rows ask for is broadcast; rows
    that got it are dealt by a hash of their own in the join that answers the others, so no key is hot there."""
    values = [c for c in table.columns if c != key]
    common = table.where(F.col(weight) > limit).select(key, *(F.col(c).alias(f"_{c}") for c in values))
    rest = table.where(F.col(weight) <= limit).withColumnRenamed(key, "_key")
    asked = rows.join(F.broadcast(common), key, "left")
    own = F.when(F.col(f"_{weight}").isNull(), F.col(key)).otherwise(F.xxhash64("key", "place"))
    asked = asked.withColumn("_asked", own).join(rest, F.col("_asked") == F.col("_key"), "left")
    return asked.select(*rows.columns, *(F.coalesce(f"_{c}", c).alias(c) for c in values))


def templates(distinct: DataFrame, similar: float = SIMILAR, hot: int = HOT) -> DataFrame:
    """``distinct`` (leaf, key, words, low, high, first: distinct lines, the lowest and highest digest of their texts, their
    first document) -> key, template and first document of all lines whose template recurs.  ``distinct`` is read a few times.

    A line may miss ``misses`` = floor(width * (1 - similar)) of its template's words.  Of its words after the leading ones, those whose count at their place of
    the leaf is below the (misses + 1)-th lowest of the line are odd: ``misses`` at most, none where the lowest counts are equal.  An odd word becomes the most frequent one at its
    place (of equal ones the greatest hash), if that is as frequent as the (misses + 1)-th lowest, and else variable.  One word after the leading ones always stays."""
    width = F.size("words")
    lines = distinct.withColumn("misses", F.least(F.floor(width * F.lit(1 - similar) + 1e-9), width - LEAD - 1).cast("int"))
    wide = lines.where("misses > 0")
    words = wide.select("leaf", "key", "misses", F.posexplode("words").alias("place", "word")).where(F.col("place") >= LEAD)
    words = words.withColumn("token", F.xxhash64("leaf", "place", "word"))
    counts = words.groupBy("leaf", "place", "word", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = written(counts, "counts")  # words that stand once need no row
    asked = wide.agg(F.sum(width - LEAD)).first()[0] or 0
    limit = asked / hot  # fewer than ``hot`` words, or places of leaves, are asked for more often
    counted = _looked_up(words, counts.select("token", "n"), "token", "n", limit).withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    line = counted.groupBy("leaf", "key", "misses").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("w"))
    line = written(line.withColumn("least", F.element_at(F.array_sort(F.transform("w", lambda x: x["n"])), F.col("misses") + 1)), "counted")
    in_leaf = wide.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"))
    top = counts.groupBy("leaf", "place").agg(F.max(F.struct("n", "word")).alias("top")).join(in_leaf, "leaf")
    top = written(top.select(F.xxhash64("leaf", "place").alias("slot"), F.col("top.word").alias("top"), F.col("top.n").alias("top_n"), "lines"), "top")
    odd = line.select("leaf", "key", "least", F.explode(F.filter("w", lambda x: x["n"] < F.col("least"))).alias("x"))
    odd = odd.select("key", "least", F.col("x.place").alias("place"), F.xxhash64("leaf", "x.place").alias("slot"))
    common = _looked_up(odd, top, "slot", "lines", limit).where("top_n >= least")
    common = common.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("place", "top"))).alias("common"))
    general = F.transform("w", lambda x: F.when(x["n"] < F.col("least"), F.coalesce(F.try_element_at("common", x["place"]), F.lit(0))).otherwise(x["word"]))
    found = line.join(common, "key", "left").select("key", F.xxhash64("leaf", general).alias("template")).join(wide.select("key", "low", "high", "first"), "key")
    out = written(found.unionByName(lines.where("misses <= 0").select("key", F.col("key").alias("template"), "low", "high", "first")), "templates")
    recurring = out.groupBy("template").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")).where("low <> high")
    return out.select("key", "template").join(recurring.select("template", "first"), "template")


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """Each row of ``docs``: chunk and doc (its place in the scan), id, digest of the text, n_lines; and the places of the lines whose
    template recurs: chunk, doc, line number, template, and the first document with it."""
    scanned = scan(docs, doc_id, text)
    lines = scanned.where("leaf is not null")
    # the lowest and the highest digest tell whether a line stands in two different texts
    distinct = written(lines.groupBy("leaf", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")), "distinct")
    # only lines that share their leaf can share a template; the words of the others are never sent
    several = materialize(distinct.groupBy("leaf").count().where("count > 1").select("leaf"))
    worded = written(_words_of(docs, text, several).join(distinct, ["leaf", "key"]), "worded")
    shared = templates(worded, **options)
    single = distinct.where("low <> high").join(worded.select("leaf", "key"), ["leaf", "key"], "left_anti").select("key", F.col("key").alias("template"), "first")
    found = lines.select("chunk", "key", "docs", "lines").join(shared.unionByName(single), "key")
    places = found.select("chunk", "template", "first", F.explode(F.arrays_zip("docs", "lines")).alias("p"))
    rows = scanned.where("leaf is null").select("chunk", F.col("docs")[0].alias("doc"), F.col("first").alias("id"), F.col("low").alias("digest"), F.col("lines")[0].cast("long").alias("n_lines"))
    return rows, places.select("chunk", F.col("p.docs").alias("doc"), F.col("p.lines").alias("line"), "template", "first")


def _dropped(docs: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """Each row of ``docs`` with the numbers of its recurring lines and of those that are dropped."""
    rows, places = recurring_lines(docs, doc_id, text, **options)
    lines = places.groupBy("chunk", "doc").agg(F.collect_list(F.struct("line", "first")).alias("found"))
    out = rows.join(lines, ["chunk", "doc"], "left")
    found = F.coalesce("found", F.array().cast("array<struct<line:int,first:bigint>>"))
    cut = F.filter(found, lambda x: x["first"] != F.col("id"))
    return out.select("id", "digest", "n_lines", F.size(found).cast("long").alias("n_recurring"), F.array_sort(F.transform(cut, lambda x: x["line"])).alias("cut"))


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """For each row: the id, n_lines (with a word), n_recurring, n_dropped, and dropped_lines (their numbers from 0, ascending)."""
    own = F.when(F.col("id") != _NO_ID, F.col("id")).cast(docs.schema[doc_id].dataType)
    return _dropped(docs, doc_id, text, **options).select(own.alias(doc_id), "n_lines", "n_recurring", F.size("cut").cast("long").alias("n_dropped"), F.col("cut").alias("dropped_lines"))


def drop_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with the dropped lines cut from ``text``; other texts stay byte for byte."""
    cut = _dropped(docs, doc_id, text, **options).where(F.size("cut") > 0).select("id", "digest", "cut").distinct()  # rows with equal id and text lose the same
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    keyed = docs.select(F.struct(*rest).alias("_row"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("digest"))
    out = keyed.join(cut, ["id", "digest"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("cut", i)), "\n")
    new = F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept)
    return out.select(*(new.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns))
