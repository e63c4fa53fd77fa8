"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items form one automaton.  Training texts stream through it and the
longest match that ends at each word is tracked, so all copied windows are found in one pass.
Words that stand in no pair of neighbouring words known from the items can't be part of a copied
window; a fixed-size table of such pairs, made by numpy passes, skips them.

Items are cut into parts of at most ``BLOCK_WORDS`` words that overlap by a window less one word, and the parts are dealt to
blocks of about so many words.  Tasks build a block's automaton each and pack it into sorted arrays (some 70 bytes a word).
Up to ``PASS_BLOCKS`` blocks run over the documents in one pass, without a shuffle.  With more, a Bloom filter of all windows (``SIEVE_BITS``
bits at most) first finds the texts that may hold one; only these, each distinct one once, go through a pass for each ``PASS_BLOCKS`` blocks.  A pass writes
the ranges of words found by digest of the text, and all of them are joined to the documents once at the end, so documents are read
twice and never written, whatever the number of passes, and what the driver and the executors hold at once is bounded.  With far more windows
than bits the filter lets more texts through; it never loses one.

Null or empty texts have no words and are never hit; items without words have no window; items
without an id are matched but not listed.  Repeated documents and items give the same as single
ones, an empty benchmark gives no hits, and an empty table an empty result.  Further columns pass through; ``find_copies`` replaces those that begin with
``_hit_``.  A very long text is scanned as a whole.
"""

from __future__ import annotations

import pickle
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import materialize, packets, shared_dir, unpack, written
from llm.words import NOT_ALNUM, Piece, mix, pieces

WINDOW = 10
BLOCK_WORDS = 200_000
PASS_BLOCKS = 5
SIEVE_BITS = 1 << 29
SIEVE_PART = 1 << 19  # bits that one task sets
BROADCAST_BYTES = 32 << 20
SALTS = 64
_FOUND = "_hit_key string, _hit_spans array<array<long>>, _hit_items array<string>"


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the windows' items at their states."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.marks: dict[int, dict[int, set[str]]] = defaultdict(dict)

    def _state(self, length: int, link: int, nexts: dict[int, int]) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the longest string of ``p`` followed by ``word``; q may hold longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word, self.next[last][word])
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)

    def mark(self, words: list[int], item: str | None) -> None:
        """Note the item at the states of its windows; call it when all sequences are added."""
        size = min(self.window, len(words))
        state = length = 0
        for i, word in enumerate(words):
            state, length = self.step(state, length, word)
            if i + 1 >= size > 0:
                u = state
                while self.length[self.link[u]] >= size:
                    u = self.link[u]
                self.marks[u].setdefault(size, set()).update([item] if item is not None else [])

    def packed(self) -> dict[str, np.ndarray]:
        """The automaton as arrays: for each state its suffix link, length, transitions by word, and the nearest state, itself or up its
        links, with windows; for these, sizes and items."""
        n = len(self.link)
        nearest = np.zeros(n, np.int32)
        for u in sorted(range(1, n), key=self.length.__getitem__):
            nearest[u] = u if u in self.marks else nearest[self.link[u]]
        moves = [sorted(x.items()) for x in self.next]
        names = sorted({i for m in self.marks.values() for ids in m.values() for i in ids})
        number = {name: k for k, name in enumerate(names)}
        marks = [sorted(self.marks[u].items()) if u in self.marks else [] for u in range(n)]
        sizes = [(size, ids) for m in marks for size, ids in m]
        starts = lambda lengths: np.concatenate(([0], np.cumsum(np.fromiter(lengths, np.int64)))).astype(np.int32)
        flat = lambda values, kind: np.fromiter(values, kind)
        return {
            "link": np.array(self.link, np.int32), "length": np.array(self.length, np.int32), "nearest": nearest,
            "first": starts(len(m) for m in moves), "word": flat((w for m in moves for w, _ in m), np.uint64), "to": flat((t for m in moves for _, t in m), np.int32),
            "mark": starts(len(m) for m in marks), "size": flat((size for size, _ in sizes), np.int32), "of": starts(len(ids) for _, ids in sizes),
            "item": flat((number[i] for _, ids in sizes for i in sorted(ids)), np.int32), "names": np.array(names, object),
        }


class Block:
    """The packed automaton of some items and the table that finds where it has to run."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        automaton = SuffixAutomaton(window)
        for _, words in items:
            automaton.add(words.tolist())
        for name, words in items:
            automaton.mark(words.tolist(), name)
        self.arrays = automaton.packed()
        self.least = min((min(window, len(words)) for _, words in items if len(words)), default=window)
        total = sum(len(words) for _, words in items)
        self.shift = np.uint64(64 - max(16, int(64 * total + 1).bit_length()))
        table = np.zeros(1 << (64 - int(self.shift)), bool)
        for _, words in items:
            table[self._slot(words)] = True
        self.table = np.packbits(table, bitorder="little")

    def open(self) -> Block:
        """Views that give plain numbers, for a task."""
        self.views = {c: memoryview(a) for c, a in self.arrays.items() if c != "names"}
        return self

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest match after one more word."""
        v = self.views
        first, words = v["first"], v["word"]
        while True:
            end = first[state + 1]
            k = bisect_left(words, word, first[state], end)
            if k < end and words[k] == word:
                return v["to"][k], length + 1
            if not state:
                return 0, 0
            state = v["link"][state]
            length = v["length"][state]

    def windows(self, state: int, length: int) -> Iterator[tuple[int, list[str]]]:
        """Sizes and items of the windows that end where the longest match has this state and length."""
        v = self.views
        u = v["nearest"][state]
        while u:
            for k in range(v["mark"][u], v["mark"][u + 1]):
                if v["size"][k] <= length:
                    yield v["size"][k], self.arrays["names"][self.arrays["item"][v["of"][k] : v["of"][k + 1]]].tolist()
            u = v["nearest"][v["link"][u]]

    def _slot(self, words: np.ndarray) -> np.ndarray:
        key = words if self.least == 1 else words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:]
        return key >> self.shift

    def runs(self, words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words, within one text each, that may hold windows."""
        single = self.least == 1
        if len(words) < (1 if single else 2):
            return []
        slot = self._slot(words)
        ok = (self.table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        if not single:
            ok &= owner[1:] == owner[:-1]
        edge = np.diff(np.concatenate(([0], ok.view(np.int8), [0])))
        if single:
            edge = edge.astype(bool)
            cut = np.concatenate(([False], owner[1:] != owner[:-1], [False]))
            begins = np.flatnonzero(ok & (edge[:-1] | cut[:-1]))
            ends = np.flatnonzero(ok & (edge[1:] | cut[1:])) + 1
            return list(zip(begins.tolist(), ends.tolist(), strict=True))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        enough = ends - begins >= self.least
        return list(zip(begins[enough].tolist(), ends[enough].tolist(), strict=True))

    def scan(self, piece: Piece, words: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, list[str]]]:
        """The text, first and end word (in the text) and items of each window found."""
        for begin, end in self.runs(words, owner):
            text, state, length = int(owner[begin]), 0, 0
            base = begin - int(piece.word_bounds[text])
            for i, word in enumerate(words[begin:end].tolist()):
                state, length = self.step(state, length, word)
                for size, items in self.windows(state, length) if length >= self.least else ():
                    yield text, base + i + 1 - size, base + i + 1, items


def item_parts(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> DataFrame:
    """``item`` and ``words`` (packed hashes) of the parts of all items with words."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1), NOT_ALNUM):
                words, bounds = piece.hashes(), piece.word_bounds
                # each window is in a part: parts overlap by one word less
                spans = [(i, a, min(a + block_words + window - 1, int(bounds[i + 1]))) for i in range(piece.n) for a in range(int(bounds[i]), max(int(bounds[i]) + 1, int(bounds[i + 1]) - window + 1), block_words) if bounds[i] < bounds[i + 1]]
                ids = batch.column(0).slice(piece.first, piece.n).take(pa.array([s[0] for s in spans], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([words[a:b].tobytes() for _, a, b in spans], pa.binary())], ["item", "words"])

    return materialize(items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(parts, "item string, words binary").distinct())


def item_blocks(parts: DataFrame, window: int, block_words: int) -> DataFrame:
    """``packed`` (bytes) and ``_at`` (a number), a row for each block of parts."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held = [(i, np.frombuffer(w, np.uint64)) for i, w in zip(table.column("item").to_pylist(), table.column("words").to_pylist(), strict=True)]
        held.sort(key=lambda x: (x[0] is not None, x[0] or "", x[1].tobytes()))
        return pa.table({"packed": pa.array([pickle.dumps(Block(held, window))], pa.binary())})

    total = parts.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    n = max(1, -(-int(total) // block_words))
    built = parts.groupBy(F.pmod(F.xxhash64("item", "words"), F.lit(n)).alias("at")).applyInArrow(build, "packed binary")
    return materialize(built.withColumn("_at", F.monotonically_increasing_id()))


class Sieve:
    """A Bloom filter of the windows of all items, of each size that occurs."""

    def __init__(self, parts: DataFrame, window: int, most_bits: int):
        size = F.least(F.lit(window), (F.octet_length("words") / 8).cast("int"))
        self.sizes = sorted(r[0] for r in parts.select(size).distinct().collect())  # ``window`` at most
        total = int(parts.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0)
        self.bits = bits = min(max(16, int(64 * total).bit_length()), most_bits.bit_length() - 1)
        part = min(SIEVE_PART, 1 << bits)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = [np.zeros(0, np.int64)]
                for x in batch.column(0).to_pylist():
                    words = np.frombuffer(x, np.uint64)
                    high, low, _ = window_slots(words, np.zeros(len(words), np.int64), min(window, len(words)), bits)
                    slots += [high, low]
                found = np.unique(np.concatenate(slots))
                yield packets(found // part, {"slot": found % part})

        def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            marks = np.zeros(part, bool)
            marks[unpack(table, "slot", np.int64)] = True
            return pa.table({"to": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

        self.table = np.zeros((1 << bits) // 8, np.uint8)
        filled = parts.select("words").mapInArrow(places, "to long, slot binary").groupBy("to").applyInArrow(fill, "to long, packed binary")
        for r in filled.toLocalIterator():  # the table's bits, ``most_bits`` at most
            self.table[r[0] * part // 8 : (r[0] + 1) * part // 8] = np.frombuffer(r[1], np.uint8)

    def _has(self, slots: np.ndarray) -> np.ndarray:
        return (self.table[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)

    def passes(self, piece: Piece) -> np.ndarray:
        """Which of the piece's texts may hold a window."""
        words, owner = piece.hashes(), piece.owner()
        out = np.zeros(piece.n, bool)
        for size in self.sizes:
            high, low, of = window_slots(words, owner, size, self.bits)
            first = self._has(high)
            out[of[first][self._has(low[first])]] = True
        return out


def window_slots(words: np.ndarray, owner: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two places in a table of ``2**bits`` for each run of ``size`` words within a text, and the run's text."""
    n = max(0, len(words) - size + 1)
    key = np.full(n, size, np.uint64)
    for i in range(size):
        key = key * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    whole = owner[:n] == owner[size - 1 : size - 1 + n]
    key = mix(key[whole])
    return (key >> np.uint64(64 - bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64), owner[:n][whole]


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_copies(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    pass_blocks: int = PASS_BLOCKS,
    sieve_bits: int = SIEVE_BITS,
    clean: bool = False,
) -> DataFrame:
    """``docs`` without ``text`` and with what is copied from ``items``.

    ``_hit_words``: number of words of the text; ``_hit_spans``: ranges of words copied, disjoint
    and ascending; ``_hit_items``: ids of the items with a window in the text.  With ``clean``,
    the text stays and ``_hit_clean`` is the text without these ranges.
    """
    context = docs.sparkSession.sparkContext
    parts = item_parts(items, item_id, item_text, window, block_words)
    built = item_blocks(parts, window, block_words)
    places = [r[0] for r in built.select("_at").orderBy("_at").collect()]  # a number for each block
    groups = [places[i : i + pass_blocks] for i in range(0, len(places), pass_blocks)] or [[]]
    docs = docs.drop(*(c for c in docs.columns if c.startswith("_hit_")))

    def blocks_of(group: list[int]):
        rows = built.where(F.col("_at").between(group[0], group[-1])).select("packed").collect() if group else []  # pass_blocks blocks at most
        return context.broadcast([pickle.loads(r[0]) for r in rows])

    fields = [f for f in docs.schema.fields if clean or f.name != text]
    new = {"_hit_words": "long", "_hit_spans": "array<array<long>>", "_hit_items": "array<string>"} | ({"_hit_clean": "string"} if clean else {})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in new.items())).fields)
    if len(groups) == 1:
        return docs.mapInArrow(_one_pass(blocks_of(groups[0]), text, schema.names), schema)
    texts = _passing(docs, text, context.broadcast(Sieve(parts, window, sieve_bits)))
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/copies-{uuid.uuid4().hex}"
    for k, group in enumerate(groups):  # a job each, so its blocks can go
        blocks = blocks_of(group)
        texts.mapInArrow(_scan_pass(blocks), _FOUND).write.parquet(f"{path}/pass={k}")
        blocks.unpersist()
    found = docs.sparkSession.read.schema(_FOUND).parquet(path).groupBy("_hit_key")
    together = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return _joined(docs, text, written(found.agg(together("_hit_spans"), together("_hit_items")), "copies")).mapInArrow(_with_found(text, schema.names), schema)


def _passing(docs: DataFrame, text: str, sieve) -> DataFrame:
    """The distinct texts that may hold a window, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text"), NOT_ALNUM):
                yield batch.slice(piece.first, piece.n).filter(pa.array(sieve.value.passes(piece)))

    keyed = docs.select(F.md5(text).alias("_hit_key"), F.col(text).alias("text"))
    return written(keyed.mapInArrow(run, "_hit_key string, text string").dropDuplicates(["_hit_key"]), "sieved")


def _joined(docs: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """``docs`` with what was found in their texts.  A table of a checked size is broadcast; a larger one is there SALTS times, so the rows of a text that very
    many documents have are dealt to several tasks by the partition that they come from."""
    size = found.agg(F.sum(16 * F.size("_hit_spans") + F.octet_length(F.concat_ws(",", "_hit_items")) + 64)).first()[0] or 0
    keyed = docs.withColumn("_hit_text", F.md5(text))
    if size <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(found), F.col("_hit_text") == F.col("_hit_key"), "left").drop("_hit_text", "_hit_key")
    salted = found.withColumn("_hit_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = keyed.withColumn("_hit_part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    on = (F.col("_hit_text") == F.col("_hit_key")) & (F.col("_hit_part") == F.col("_hit_salt"))
    return keyed.join(salted, on, "left").drop("_hit_text", "_hit_key", "_hit_part", "_hit_salt")


def _matches(opened: list[Block], piece: Piece) -> tuple[dict[int, list], dict[int, set]]:
    """Ranges of words copied and items, for each text with any."""
    words, owner = piece.hashes(), piece.owner()
    spans, ids = defaultdict(list), defaultdict(set)
    for block in opened:
        for i, a, b, items in block.scan(piece, words, owner):
            spans[i].append((a, b))
            ids[i].update(items)
    return {i: union_spans(x) for i, x in spans.items()}, ids


def _report(piece: Piece, rows: pa.RecordBatch, text: str, names: list[str], spans: dict[int, list], ids: dict[int, set]) -> pa.RecordBatch:
    new = {
        "_hit_words": pa.array(np.diff(piece.word_bounds), pa.int64()),
        "_hit_spans": pa.array([[list(x) for x in spans.get(i, ())] for i in range(piece.n)], pa.list_(pa.list_(pa.int64()))),
        "_hit_items": pa.array([sorted(ids.get(i, ())) for i in range(piece.n)], pa.list_(pa.string())),
    }
    if "_hit_clean" in names:
        whole = rows.column(text).to_pylist()
        new["_hit_clean"] = pa.array([_without(piece, i, spans[i]) if i in spans else whole[i] for i in range(piece.n)], pa.string())
    return pa.RecordBatch.from_arrays([new[n] if n in new else rows.column(n) for n in names], names)


def _one_pass(blocks, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [b.open() for b in blocks.value]
        for batch in batches:
            for piece in pieces(batch.column(text), NOT_ALNUM):
                yield _report(piece, batch.slice(piece.first, piece.n), text, names, *_matches(opened, piece))

    return run


def _scan_pass(blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [b.open() for b in blocks.value]
        for batch in batches:
            for piece in pieces(batch.column("text"), NOT_ALNUM):
                spans, ids = _matches(opened, piece)
                hit = sorted(spans)
                keys = batch.column("_hit_key").slice(piece.first, piece.n).take(pa.array(hit, pa.int64()))
                found = pa.array([[list(x) for x in spans[i]] for i in hit], pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([keys, found, pa.array([sorted(ids[i]) for i in hit], pa.list_(pa.string()))], ["_hit_key", "_hit_spans", "_hit_items"])

    return run


def _with_found(text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(text), NOT_ALNUM):
                rows = batch.slice(piece.first, piece.n)
                found = enumerate(rows.column("_hit_spans").to_pylist())
                spans = {i: union_spans([(a, b) for a, b in x]) for i, x in found if x}
                items = rows.column("_hit_items").to_pylist()
                yield _report(piece, rows, text, names, spans, {i: set(items[i]) for i in spans})

    return run


def _without(piece: Piece, i: int, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each range."""
    raw, base, first = piece.text(i), piece.bounds[i], piece.word_bounds[i]
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at : piece.starts[first + a] - base])
        at = piece.ends[first + b - 1] - base
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame, items: DataFrame, *, text: str = "text", min_span: int = WINDOW, max_coverage: float = 0.5, **options
) -> DataFrame:
    """``docs`` with copied ranges of ``min_span`` words or more cut from the text, without documents
    whose share of copied words is above ``max_coverage``.  Other columns stay as they are."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    row = docs.select((F.struct(*rest) if rest else F.lit(0)).alias("_row"), F.col(text).alias("text"))
    found = find_copies(row, items, text="text", clean=True, window=min_span, **options)
    hit = F.aggregate("_hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    kept = found.where(hit <= max_coverage * F.col("_hit_words"))
    return kept.select(*(F.col("_hit_clean").alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns))
