"""N-gram Jaccard join with a prefix tree.

A document is the set of its distinct word 5-grams, hashed to 64 bits.  Documents with the same set are one class
(told apart by 128 bits of its digest).  Two classes link when ``100 * |intersection| >= 75 * |union|``.

1. *Scan.*  Each text gives its class and, for the filter, the half of its n-grams with the lowest hashes.
2. *Filter.*  Of a class with a link at least ``least`` of these n-grams are in another class, too.  The n-grams
   are dealt into buckets by hash; a bucket finds those of more than one class.  Most documents end here.
3. *Global order.*  For the classes left, the frequency of every n-gram orders it: rare first, ties by hash.
   N-grams of one class alone can't be shared and only use up the budget for differences.
4. *Prefixes.*  Linked sets share an n-gram of their prefixes (the first ``n - ceil(.75 n) + 1``).
   Classes connected by prefix n-grams form blocks, so all links are within blocks.
5. *Prefix tree.*  A block's sets, sorted by the global order, form a trie: each set is stored from
   where it leaves the path of the one before.  All links are found by traversing it with a set from the root towards the
   sets that share a prefix n-gram: each shared part is passed once, with the overlap so far, and a subtree is left when what
   remains of both sets can't reach the overlap needed.  One set of each component is looked for first; sets that are
   then connected needn't be looked for again, so a group of copies isn't expanded into pairs.
   A block of more than ``BLOCK_NGRAMS`` n-grams is cut into parts.  Each part is a task, with a few sets of the whole block that
   connect groups across parts; then only sets outside the block's largest group meet each other and each part.  So memory is
   bounded, all links between groups are kept, and a very large group of copies is linear work.

Wherever n-grams are dealt by hash, the texts of a chunk (a few megabytes) first agree on the distinct ones, so an n-gram that very many
documents have is one entry for each chunk; packets hold what a chunk has for a bucket, and with very many buckets they are dealt
in two steps (``common.redeal``), so the number of packets grows with the bytes.

Only components are asked for, so links within one are found until it is connected.  Hashes of 64 bits stand for n-grams.

Null and empty texts have an empty set and link with nothing.  Rows without id link with nothing and have a null
component.  Rows with equal ids are separate documents.  Extra columns are ignored, also if they have the names of result columns; an
empty table gives an empty result.  A very long text is one set; tasks hold a small multiple of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import binaries, bucket_of, materialize, offsets_of, packets, per_group, redeal, unpack
from llm.graph import components, forest
from llm.words import SPACE, Piece, mix, pieces, shingles

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
BUCKET_BYTES = 24 << 20  # of text for each bucket of the filter
CHUNK_BYTES = 8 << 20  # of text whose n-grams travel together
FAN = 4096
BLOCK_NGRAMS = 1_000_000
LEADS = 32
_SHARED = 0  # the class of n-grams that several classes of a chunk have
_DOCS = -1
_SCAN = "bucket long, chunk array<long>, ids array<long>, n array<int>, d1 array<long>, d2 array<long>, counts array<int>, grams binary"
_HITS = {"chunk": np.int64, "d1": np.int64, "hits": np.int64}
_PARTS = {"gram": np.uint64, "part": np.int32, "count": np.uint32}
_FREQUENCY = {"part": np.int32, "gram": np.uint64, "df": np.uint32}
_PREFIX = {"gram": np.uint64, "node": np.int64}


def _schema(kinds: dict[str, type]) -> str:
    return "to long, " + ", ".join(f"{c} binary" for c in kinds)


def least_overlap(n: np.ndarray) -> np.ndarray:
    """The overlap that a set of size n needs at least with any set it links with: ceil(.75 n)."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _extra(n: np.ndarray) -> np.ndarray:
    """Linked sets x and y share min(_extra(|x|), _extra(|y|)) of the first ``n - least_overlap(n) + _extra(n)`` n-grams of both."""
    return np.maximum(1, -(-n // 4))


def _sets(piece: Piece, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of all texts, one text after the other, and the first of each text."""
    grams, owner = shingles(piece.hashes(), piece.word_bounds, width)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[keep], np.searchsorted(owner[keep], np.arange(piece.n + 1))


def _digests(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    raw = memoryview(grams.tobytes())
    out = np.empty((len(first) - 1, 2), np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        out[i] = np.frombuffer(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]), np.int64)
    return out


def _take(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the first ``counts`` items of each run that begins at ``first``."""
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def _lists(values: np.ndarray, cut: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, kind))


def _scan_rows(bucket: np.ndarray, chunk: int, lists: dict[str, tuple[np.ndarray, np.ndarray]], grams: pa.Array | None = None) -> pa.RecordBatch:
    """Rows of ``_SCAN``; a column is given as its values and where each row's begin."""
    n, none = len(bucket), np.zeros(len(bucket) + 1, np.int64)
    columns = [pa.array(bucket, pa.int64()), _lists(np.full(n, chunk), np.arange(n + 1), pa.int64())]
    for name, kind in (("ids", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("counts", pa.int32())):
        columns.append(_lists(*lists.get(name, (none[:0], none)), kind))
    columns.append(binaries(np.zeros(0, np.uint8), none) if grams is None else grams)
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCAN.split(", ")])


def _spot(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The filter's bucket, from the low bits: it sees the n-grams with the lowest hashes."""
    return ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _filter_rows(chunk: int, klass: np.ndarray, owner: np.ndarray, keys: np.ndarray, n_buckets: int, per: int) -> pa.RecordBatch:
    """One row for each bucket (or group of them): its classes, how many n-grams each has here, and the n-grams: what
    their bucket doesn't say of them, or all while there is a step to come."""
    bucket = _spot(keys, n_buckets) // per
    order = np.lexsort((owner, bucket))
    bucket, owner, keys = bucket[order], owner[order], keys[order]
    entry = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.zeros(0, np.int64)
    cut = offsets_of(bucket)
    which = np.searchsorted(entry, cut)
    counts = np.diff(np.concatenate((entry, [len(keys)])))
    return _scan_rows(bucket[cut[:-1]], chunk, {"d1": (klass[owner[entry]], which), "counts": (counts, which)}, binaries(keys if per > 1 else (keys >> np.uint64(32)).astype(np.uint32), cut))


def _scan(n_buckets: int, width: int, fan: int):
    """Rows with all documents of each piece (bucket ``_DOCS``); for each chunk of several pieces, the n-grams of its classes by
    bucket, and (buckets below ``_DOCS``) the hits that are known within the chunk."""
    per = per_group(n_buckets, fan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            all_ids = batch.column(0)
            for piece in pieces(batch.column(1), SPACE):
                ids = all_ids.slice(piece.first, piece.n).to_numpy(zero_copy_only=False)
                grams, first = _sets(piece, width)
                n, digests = np.diff(first), _digests(grams, first)
                whole = np.array([0, piece.n])
                yield _scan_rows(np.array([_DOCS]), chunk, {"ids": (ids, whole), "n": (n, whole), "d1": (digests[:, 0], whole), "d2": (digests[:, 1], whole)})
                some = np.flatnonzero(n > 0)
                some = some[np.unique(digests[some], axis=0, return_index=True)[1]] if len(some) else some
                taken = np.minimum(n[some], n[some] - least_overlap(n[some]) + _extra(n[some]))
                held.append((digests[some, 0], taken, grams[_take(first[some], taken)]))
                size += len(piece.raw)
                if size >= CHUNK_BYTES:
                    yield from flush(chunk, held)
                    chunk, size, held = chunk + 1, 0, []
        yield from flush(chunk, held)

    def flush(chunk: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        classes, taken, keys = (np.concatenate([h[i] for h in held]) for i in range(3))
        klass, lead = np.unique(classes, return_index=True)
        once = np.zeros(len(classes), bool)  # a class counts once
        once[lead] = True
        keys = keys[np.repeat(once, taken)]
        owner = np.repeat(np.searchsorted(klass, classes[once]), taken[once])
        # n-grams of several classes of the chunk are known to be shared and are sent once, by none
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        edge = offsets_of(keys)
        many = np.diff(edge) > 1
        hits = np.bincount(owner[np.repeat(many, np.diff(edge))], minlength=len(klass))
        owner = np.where(many, len(klass), owner[edge[:-1]])
        if len(keys):
            yield _filter_rows(chunk, np.concatenate((klass, [_SHARED])), owner, keys[edge[:-1]], n_buckets, per)
        known = np.flatnonzero(hits)
        if len(known):
            to = bucket_of(mix(klass[known].view(np.uint64)), n_buckets) // per
            order = np.argsort(to, kind="stable")
            cut = offsets_of(to[order])
            yield _scan_rows(_DOCS - 1 - to[order][cut[:-1]], chunk, {"d1": (klass[known][order], cut), "counts": (hits[known][order], cut)})

    return run


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of filter rows, the chunk, class and number of n-grams of each entry."""
    cols = {c: table.column(c).combine_chunks() for c in ("chunk", "d1", "counts")}
    klass, counts, chunk = (cols[c].values.to_numpy(zero_copy_only=False) for c in ("d1", "counts", "chunk"))
    sizes, have = (np.diff(cols[c].offsets.to_numpy()) for c in ("d1", "chunk"))
    # a row has one chunk for all its entries, or one for each
    return np.repeat(chunk, np.repeat(np.where(have == sizes, 1, sizes), have)), klass, counts


def _filter_redeal(df: DataFrame, n_buckets: int, fan: int) -> DataFrame:
    """The second step of the filter's dealing."""
    if per_group(n_buckets, fan) == 1:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= CHUNK_BYTES:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        chunk, klass, counts = _entries(table)
        keys, entry = unpack(table, "grams", np.uint64), np.repeat(np.arange(len(klass)), counts)
        rows = _filter_rows(0, klass, entry, keys, n_buckets, 1)
        order = np.lexsort((entry, _spot(keys, n_buckets)))
        again = entry[order][np.concatenate(([True], (np.diff(_spot(keys, n_buckets)[order]) != 0) | (np.diff(entry[order]) != 0)))]
        return rows.set_column(1, rows.schema.field(1), _lists(chunk[again], rows.column("d1").offsets.to_numpy(), pa.int64()))

    return df.repartition("bucket").mapInArrow(run, df.schema)


def _count_hits(n_buckets: int, per: int):
    """Packets for buckets of classes: the chunks, classes and hits that one bucket of n-grams has."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk, klass, counts = _entries(table)
        grams = unpack(table, "grams", np.uint32)
        entry = np.repeat(np.arange(len(klass)), counts)
        order = np.argsort(grams, kind="stable")
        c = klass[entry[order]]
        first = offsets_of(grams[order])
        group = np.repeat(np.arange(len(first) - 1), np.diff(first))
        several = np.zeros(len(first) - 1, bool)
        several[group[(c != c[first[:-1]][group]) | (c == _SHARED)]] = True
        hits = np.bincount(entry[order][several[group]], minlength=len(klass))
        some = (hits > 0) & (klass != _SHARED)
        return pa.Table.from_batches([packets(_class_bucket(klass[some], n_buckets) // per, {"chunk": chunk[some], "d1": klass[some], "hits": hits[some].astype(np.int64)})])

    return run


def _class_bucket(klass: np.ndarray, n_buckets: int) -> np.ndarray:
    return bucket_of(mix(klass.view(np.uint64)), n_buckets)


def _known_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        chunk, klass, hits = _entries(table)
        to = np.repeat(_DOCS - 1 - batch.column("bucket").to_numpy(), np.diff(batch.column("d1").offsets.to_numpy()))
        yield packets(to, {"chunk": chunk, "d1": klass, "hits": hits.astype(np.int64)})


def _most_hits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The hits of each class: summed within a chunk, the most of all chunks."""
    chunk, klass, hits = (unpack(table, c, k) for c, k in _HITS.items())
    order = np.lexsort((chunk, klass))
    chunk, klass, hits = chunk[order], klass[order], hits[order]
    first = np.flatnonzero(np.concatenate(([True], (klass[1:] != klass[:-1]) | (chunk[1:] != chunk[:-1]))))
    total, klass = np.add.reduceat(hits, first), klass[first]
    first = offsets_of(klass)[:-1]
    return pa.table({"d1": klass[first], "hits": np.maximum.reduceat(total, first)})


def _candidates(scanned: DataFrame, classes: DataFrame, n_buckets: int, fan: int) -> DataFrame:
    """The ``classes`` that may have links."""
    dealt = _filter_redeal(scanned.where("bucket >= 0"), n_buckets, fan)
    hits = dealt.groupBy("bucket").applyInArrow(_count_hits(n_buckets, per_group(n_buckets, fan)), _schema(_HITS))
    hits = hits.unionByName(scanned.where(F.col("bucket") < _DOCS).mapInArrow(_known_hits, _schema(_HITS)))
    most = redeal(hits, _HITS, lambda c: _class_bucket(c["d1"], n_buckets), n_buckets, fan).groupBy("to").applyInArrow(_most_hits, "d1 long, hits long")
    # _extra() of the smallest set that may link
    needed = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) / 4))
    return classes.join(most, "d1").where(F.col("hits") >= needed).drop("hits", "n")


def _sets_of(rows: DataFrame, left: DataFrame, width: int) -> DataFrame:
    """Node and set (``grams``) of each class in ``left``, from one of its documents in ``rows`` (id, text).  A bit map of bounded
    size drops most others before they are read again."""
    bits = 1 << min(28, max(20, (64 * left.count()).bit_length()))
    spot = F.pmod(F.xxhash64("id"), F.lit(bits))
    marked = left.select(spot.alias("p")).groupBy(F.shiftright("p", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits"))
    table = np.zeros((bits >> 15, 4096), np.uint8)
    for row in marked.toLocalIterator():  # 32 MB at most
        table[row["b"]] = np.frombuffer(row["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(table.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((sent.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)))
            for piece in pieces(batch.column(1), SPACE):
                grams, first = _sets(piece, width)
                digests = _digests(grams, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), binaries(grams, first)], ["id", "d1", "d2", "grams"])

    near = rows.select("id", "text", spot.alias("p")).mapInArrow(run, "id long, d1 long, d2 long, grams binary")
    once = near.groupBy("id", "d1", "d2").agg(F.first("grams").alias("grams"))  # rows with the same id and text
    return once.join(left, ["id", "d1", "d2"]).select("node", "grams")


def _send_sets(n_parts: int, per: int):
    """The sets by part (a bucket of chunks; ``to`` -1), and packets: the distinct n-grams of a chunk, and how many of its classes have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 20, [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                held.append(batch.slice(i, 256))
                size += held[-1].nbytes
                if size >= CHUNK_BYTES:
                    yield from flush(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield from flush(number, held)

    def flush(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        grams, n = unpack(table, "grams", np.uint64), np.array([len(x) // 8 for x in table.column("grams").to_pylist()], np.int64)
        part = int(mix(np.array([number], np.uint64))[0] % np.uint64(n_parts))
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (grams, n, table.column("node").to_numpy())]
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([part], pa.int32()), *packed], ["to", "at", "gram", "part", "count"])
        keys, counts = np.unique(grams, return_counts=True)
        out = packets(bucket_of(keys, n_parts) // per, {"gram": keys, "part": np.full(len(keys), part, np.int32), "count": counts.astype(np.uint32)})
        yield pa.RecordBatch.from_arrays([out.column(0), pa.array(np.full(out.num_rows, -1), pa.int32()), *out.columns[1:]], ["to", "at", "gram", "part", "count"])

    return run


def _frequencies(per: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Back to the parts: n-grams of this bucket with a frequency of two or more."""
        grams, part, count = (unpack(table, c, k) for c, k in _PARTS.items())
        keys, at = np.unique(grams, return_inverse=True)
        df = np.bincount(at, count, len(keys)).astype(np.uint32)
        order = np.lexsort((grams, part))
        order = order[df[at[order]] > 1]
        once = np.concatenate(([True], (part[order][1:] != part[order][:-1]) | (grams[order][1:] != grams[order][:-1]))) if len(order) else np.zeros(0, bool)
        order = order[once]
        return pa.Table.from_batches([packets(part[order].astype(np.int64) // per, {"part": part[order], "gram": grams[order], "df": df[at[order]]})])

    return run


def _ordered_sets(key: tuple[pa.Scalar, ...], sets: pa.Table, frequency: pa.Table) -> pa.Table:
    """Each class with its shared n-grams in the global order; ``prefix``: how many of them are in its prefix.  Classes with too few shared
    n-grams for any link are left out."""
    grams, n, nodes = unpack(sets, "gram", np.uint64), unpack(sets, "part", np.int64), unpack(sets, "count", np.int64)
    known, df = unpack(frequency, "gram", np.uint64), unpack(frequency, "df", np.uint32)
    order = np.argsort(known, kind="stable")
    known, df = known[order], df[order]
    at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
    shared = known[at] == grams if len(known) else np.zeros(len(grams), bool)
    who = np.repeat(np.arange(len(nodes)), n)[shared]
    grams, df = grams[shared], df[at[shared]] if len(known) else np.zeros(0, np.uint32)
    order = np.lexsort((grams, df, who))
    who, grams, df = who[order], grams[order], df[order]
    first = np.searchsorted(who, np.arange(len(nodes) + 1))
    prefix = np.diff(first) - least_overlap(n) + 1  # n-grams of this class alone come first in the order
    some = np.flatnonzero((prefix > 0) & (np.diff(first) > 0))
    at = _take(first[some], np.diff(first)[some])
    cut = np.concatenate(([0], np.cumsum(np.diff(first)[some])))
    return pa.table({"node": nodes[some], "n": pa.array(n[some], pa.int32()), "prefix": pa.array(prefix[some], pa.int32()), "grams": binaries(grams[at], cut), "df": binaries(df[at], cut)})


def ordered_sets(sets: DataFrame, n_parts: int, fan: int) -> DataFrame:
    """``sets`` (node, grams) in the global order: node, n, prefix, grams, df."""
    per = per_group(n_parts, fan)
    sent = materialize(sets.mapInArrow(_send_sets(n_parts, per), "to long, at int, gram binary, part binary, count binary"))
    by_gram = redeal(sent.where("to >= 0").drop("at"), _PARTS, lambda c: bucket_of(c["gram"], n_parts), n_parts, fan)
    back = redeal(by_gram.groupBy("to").applyInArrow(_frequencies(per), _schema(_FREQUENCY)), _FREQUENCY, lambda c: c["part"].astype(np.int64), n_parts, fan)
    whole = sent.where("to < 0").select(F.col("at").cast("long").alias("to"), "gram", "part", "count")
    return materialize(whole.groupBy("to").cogroup(back.groupBy("to")).applyInArrow(_ordered_sets, "node long, n int, prefix int, grams binary, df binary"))


def _send_prefixes(n_buckets: int, per: int):
    """Prefix n-grams by bucket: each with one class of the batch; classes of a batch that share one are linked at once (``to`` -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix").to_numpy()
            if not len(prefix):
                continue
            grams = np.concatenate([np.frombuffer(x, np.uint64, p) for x, p in zip(batch.column("grams").to_pylist(), prefix.tolist(), strict=True)])
            keys, low, a, b = _hubs(grams, np.repeat(batch.column("node").to_numpy(), prefix))
            if len(a):
                yield packets(np.full(len(a), -1), {"gram": a, "node": b})
            yield packets(bucket_of(keys, n_buckets) // per, {"gram": keys, "node": low})

    return run


def _hubs(grams: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams with the smallest node of each, and a forest that connects all nodes of each n-gram."""
    order = np.lexsort((node, grams))
    grams, node = grams[order], node[order]
    start = np.concatenate(([True], grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, bool)
    first = np.flatnonzero(start)
    hub = node[first][np.cumsum(start) - 1]
    away = hub != node
    nodes, root = forest(node[away], hub[away])
    far = nodes != root
    return grams[first], node[first], nodes[far], root[far]


def _block_edges(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    _, _, a, b = _hubs(*(unpack(table, c, k) for c, k in _PREFIX.items()))
    return pa.table({"a": a, "b": b})


class PrefixTree:
    """Sets in the global order as a trie: set i keeps its n-grams from where it leaves set i - 1's path.

    ``begin``/``end``: the set's own part in ``ranks``; ``depth``: n-grams shared with the path before; ``parent``: the
    set that holds the last shared n-gram (-1: none), ``level``: number of ancestors; ``rest``: the most n-grams that any
    set of the subtree has from ``depth`` on; ``least_n``: the smallest size in it."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        m = len(sets)
        self.length = np.array([len(sets[i]) for i in self.order])
        self.depth = np.zeros(m, np.int64)
        self.parent = np.full(m, -1)
        self.level = np.zeros(m, np.int64)
        self.leaves_at = np.zeros(m, np.int64)  # place in ``ranks`` just past the last shared n-gram
        own, path = [], []  # path: sets on the current path, by depth
        total = 0
        self.begin = np.zeros(m, np.int64)
        for k, i in enumerate(self.order):
            if k:
                before, now = sets[self.order[k - 1]], sets[i]
                n = min(len(before), len(now))
                differ = np.flatnonzero(before[:n] != now[:n])
                self.depth[k] = differ[0] if len(differ) else n
            while path and self.depth[path[-1]] >= self.depth[k]:
                path.pop()
            if path and self.depth[k]:
                p = path[-1]
                self.parent[k], self.level[k] = p, self.level[p] + 1
                self.leaves_at[k] = self.begin[p] + self.depth[k] - self.depth[p]
            self.begin[k] = total
            own.append(sets[i][self.depth[k] :])
            total += len(own[-1])
            path.append(k)
        self.ranks = np.concatenate(own) if own else np.zeros(0, np.int64)
        self.end = np.concatenate((self.begin[1:], [total]))
        self.sizes = sizes[self.order]
        self.longest, self.least_n = self.length.copy(), self.sizes.copy()
        for k in range(m - 1, -1, -1):  # children come after their parents
            if self.parent[k] >= 0:
                p = self.parent[k]
                self.longest[p] = max(self.longest[p], self.longest[k])
                self.least_n[p] = min(self.least_n[p], self.least_n[k])
    def match(self, marks: np.ndarray, positions: np.ndarray, n: int, wanted: np.ndarray) -> np.ndarray:
        """Those of the sets ``wanted`` (in tree order) that link with a set of size ``n``: ``marks`` has its ranks, ``positions``
        the number of its n-grams up to each rank.  Only the ways from the root to ``wanted`` are passed, each part once."""
        on_way = np.zeros(len(self.order), bool)
        at = wanted
        while len(at):
            at = np.unique(at[~on_way[at]])
            on_way[at] = True
            at = self.parent[at]
            at = at[at >= 0]
        ways = np.flatnonzero(on_way)
        ways = ways[np.argsort(self.level[ways], kind="stable")]
        steps = np.searchsorted(self.level[ways], np.arange(self.level[ways[-1]] + 2)) if len(ways) else np.zeros(1, np.int64)
        overlap, place = np.zeros(len(self.order), np.int64), np.full(len(self.order), -1)  # where its parent is left; in ``total``
        total, size = np.zeros(1, np.int64), int(positions[-1])
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            at = ways[a:b]
            p = self.parent[at]
            top = p < 0
            live = top | (place[p] >= 0)
            at, p, top = at[live], p[live], top[live]
            begin = np.where(top, 0, place[p])
            overlap[at] = np.where(top, 0, overlap[p] + total[begin + np.where(top, 0, self.leaves_at[at] - self.begin[p])] - total[begin])
            passed = np.where(top, 0, positions[self.ranks[np.maximum(self.leaves_at[at] - 1, 0)]])
            most = overlap[at] + np.minimum(size - passed, self.longest[at] - self.depth[at])
            needed = -(-NUMERATOR * (n + self.least_n[at]) // (DENOMINATOR + NUMERATOR))
            at = at[most >= needed]
            own = self.end[at] - self.begin[at]
            total_here = np.concatenate(([0], np.cumsum(marks[self.ranks[_take(self.begin[at], own)]])))
            place[at] = len(total) + np.cumsum(own) - own
            total = np.concatenate((total, total[-1] + total_here))
        at = wanted[place[wanted] >= 0]
        both = overlap[at] + total[place[at] + self.end[at] - self.begin[at]] - total[place[at]]
        return at[DENOMINATOR * both >= NUMERATOR * (n + self.sizes[at] - both)]


def link_block(nodes: np.ndarray, sizes: np.ndarray, prefix: np.ndarray, grams: list[np.ndarray], df: list[np.ndarray], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the sets of a block as all its links do.  With ``side`` (0 or 1 for each set) only links between
    the sides count."""
    m = len(nodes)
    flat = np.concatenate(grams)
    keys, at = np.unique(flat, return_inverse=True)
    freq = np.zeros(len(keys), np.int64)
    freq[at] = np.concatenate(df)
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, freq))] = np.arange(len(keys))
    cut = np.concatenate(([0], np.cumsum([len(g) for g in grams])))
    sets = [rank[at[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    tree = PrefixTree(sets, sizes)
    place = np.empty(m, np.int64)
    place[tree.order] = np.arange(m)
    # which sets share a prefix n-gram
    heads = np.concatenate([s[:p] for s, p in zip(sets, prefix, strict=True)])
    owner = np.repeat(np.arange(m), prefix)
    by = np.lexsort((owner, heads))
    heads, owner = heads[by], owner[by]
    first = np.searchsorted(heads, np.arange(len(keys) + 1))
    comp = np.arange(m)
    members: list[list[int]] = [[i] for i in range(m)]
    side_of = side if side is not None else None
    edges: list[tuple[int, int]] = []
    marks, shared = np.zeros(len(keys), np.int64), np.zeros(m, bool)

    def join(i: int, j: int) -> None:
        edges.append((i, j))
        a, b = comp[i], comp[j]
        if a != b:
            if len(members[a]) < len(members[b]):
                a, b = b, a
            comp[members[b]] = a
            members[a] += members[b]
            members[b] = []

    for i in np.lexsort((np.arange(m), sizes)).tolist():
        shared[:] = False
        own = sets[i][: prefix[i]]
        shared[owner[_take(first[own], first[own + 1] - first[own])]] = True
        near = np.flatnonzero(shared & (comp != comp[i]))
        if side_of is not None:
            near = near[side_of[near] != side_of[i]]
        near = near[(DENOMINATOR * sizes[near] >= NUMERATOR * sizes[i]) & (NUMERATOR * sizes[near] <= DENOMINATOR * sizes[i])]
        if not len(near):
            continue
        marks[sets[i]] = 1
        positions = np.cumsum(marks)
        # one set of each component first: in a group of copies that is mostly enough
        lead = np.zeros(len(near), bool)
        lead[np.unique(comp[near], return_index=True)[1]] = True
        for some in (near[lead], near[~lead]):
            some = some[comp[some] != comp[i]]
            for k in tree.match(marks, positions, int(sizes[i]), place[some]).tolist():
                if comp[tree.order[k]] != comp[i]:
                    join(i, tree.order[k])
        marks[sets[i]] = 0
    a, b = (nodes[[e[k] for e in edges]] if edges else np.zeros(0, np.int64) for k in (0, 1))
    return a, b


def _link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The blocks of one task, one after the other."""
    block = table.column("block").to_numpy()
    nodes, sizes, prefix, side = (table.column(c).to_numpy() for c in ("node", "n", "prefix", "side"))
    grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
    df = [np.frombuffer(x, np.uint32) for x in table.column("df").to_pylist()]
    order = np.lexsort((nodes, block))
    edge = np.flatnonzero(np.concatenate(([True], block[order][1:] != block[order][:-1], [True])))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in zip(edge[:-1], edge[1:], strict=True):
        i = order[x:y]
        if len(i) > 1:
            two = side[i] if (side[i] >= 0).all() else None
            a, b = link_block(nodes[i], sizes[i].astype(np.int64), prefix[i].astype(np.int64), [grams[k] for k in i], [df[k] for k in i], two)
            out_a.append(a)
            out_b.append(b)
    return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def links(sets: DataFrame, n_buckets: int, block_ngrams: int = BLOCK_NGRAMS, fan: int = FAN) -> DataFrame:
    """Edges (a, b) that connect the classes of ``sets`` as all links do."""
    sent = materialize(sets.select("node", "prefix", "grams").mapInArrow(_send_prefixes(n_buckets, per_group(n_buckets, fan)), _schema(_PREFIX)))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(unpack(batch, c, np.int64)) for c in _PREFIX], ["a", "b"])

    within = sent.where("to < 0").mapInArrow(flat, "a long, b long")
    across = redeal(sent.where("to >= 0"), _PREFIX, lambda c: bucket_of(c["gram"], n_buckets), n_buckets, fan).groupBy("to").applyInArrow(_block_edges, "a long, b long")
    blocks = components(within.unionByName(across))
    held = sets.join(blocks, "node").withColumn("grams_n", (F.length("grams") / 8).cast("long"))
    sizes = held.groupBy("component").agg(F.sum("grams_n").alias("total")).withColumn("parts", F.ceil(F.col("total") / block_ngrams).cast("int"))
    held = materialize(held.join(sizes.drop("total"), "component"))
    whole = _tasks(held.where("parts = 1").withColumn("cells", F.array(_cell(0, 0, -1))), n_buckets)
    large = held.where("parts > 1")
    if not large.limit(1).count():
        return whole.groupBy("task").applyInArrow(_link, "a long, b long")
    # first each part of a large block, along with a few sets of the whole block that join its groups across the parts
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    large = large.withColumn("part", part)
    leads = large.groupBy("component", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(LEADS)).alias("k")).agg(F.min("node").alias("node")).select("node", F.lit(True).alias("lead"))
    large = large.join(leads, "node", "left")
    everywhere = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: _cell(i, i, -1))
    own = large.withColumn("cells", F.when(F.col("lead"), everywhere).otherwise(F.array(_cell(F.col("part"), F.col("part"), -1))))
    first = materialize(whole.unionByName(_tasks(own, n_buckets)).groupBy("task").applyInArrow(_link, "a long, b long"))
    # then what isn't in the largest group of its block, with itself and with each part: sets of that group needn't meet any more
    found = components(first)
    large = large.join(found.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    groups = large.groupBy("component", "group").agg(F.sum("grams_n").alias("n"))
    main = groups.groupBy("component").agg(F.max(F.struct("n", "group"))["group"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("top"))
    rest = materialize(large.join(main, "component").where("all > top"))
    more = F.ceil((F.col("all") - F.col("top")) / block_ngrams).cast("int")  # parts of the others, numbered after those of the block
    other = F.col("group") != F.col("main")
    piece = F.col("parts") + F.pmod(F.xxhash64("node", F.lit(2)), more).cast("int")
    pieces_of = F.sequence(F.col("parts"), F.col("parts") + more - 1)
    with_main = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: _cell(i, piece, 1))
    with_others = F.transform(pieces_of, lambda j: _cell(F.least(piece, j), F.greatest(piece, j), F.when(piece == j, -1).when(piece < j, 0).otherwise(1)))
    cells = F.when(other, F.concat(with_main, with_others)).otherwise(F.transform(pieces_of, lambda j: _cell(F.col("part"), j, 0)))
    second = _tasks(rest.withColumn("cells", cells), n_buckets).groupBy("task").applyInArrow(_link, "a long, b long")
    return first.unionByName(materialize(second))


def _cell(i, j, side) -> Column:
    """Where a set is compared: block by i and j; ``side`` 0 meets side 1, -1 meets all."""
    return F.struct(*(F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.cast("int").alias(n) for x, n in ((i, "i"), (j, "j"), (side, "side"))))


def _tasks(held: DataFrame, n_buckets: int) -> DataFrame:
    """The sets once for each of their ``cells``, dealt to tasks."""
    placed = held.select("component", "node", "n", "prefix", "grams", "df", F.explode("cells").alias("c"))
    placed = placed.select("node", "n", "prefix", "grams", "df", F.xxhash64("component", "c.i", "c.j").alias("block"), F.col("c.side").alias("side"))
    return placed.withColumn("task", F.pmod("block", F.lit(max(n_buckets, 1) * 64)))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN, block_ngrams: int = BLOCK_NGRAMS) -> DataFrame:
    """For each row: the id, ``n_shingles`` (size of the set) and ``component_id`` (smallest id connected by links)."""
    size = docs.agg(F.sum(F.octet_length(text))).collect()[0][0] or 0
    n_buckets = max(1, -(-size // bucket_bytes))
    none = np.iinfo(np.int64).min
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(none)).alias("id"), F.col(text).alias("text"))
    scanned = materialize(rows.mapInArrow(_scan(n_buckets, width, fan), _SCAN))
    docs_of = scanned.where(F.col("bucket") == _DOCS).select(F.col("chunk")[0].alias("chunk"), F.explode(F.arrays_zip("ids", "n", "d1", "d2")).alias("x")).select("chunk", "x.*").withColumnRenamed("ids", "id")
    # rows without words or id link with nothing
    named = (F.col("n") > 0) & (F.col("id") != none)
    classes = docs_of.where(named).groupBy("d1", "d2").agg(F.min("id").alias("id"), F.max("n").alias("n")).withColumn("node", F.xxhash64("d1", "d2"))
    left = materialize(_candidates(scanned, classes, n_buckets, fan))
    sets = ordered_sets(_sets_of(rows, left, width), n_buckets, fan)
    linked = components(links(sets, n_buckets, block_ngrams, fan))
    inside = classes.join(linked, "node")
    least = inside.groupBy("component").agg(F.min("id").alias("least"))
    inside = inside.join(least, "component").select("d1", "d2", "least")
    labelled = classes.join(inside, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", "id").alias("component"))
    # a class of very many copies goes to its documents by way of the chunks, one row for each
    placed = docs_of.where(named).select("chunk", "d1", "d2").distinct().join(labelled, ["d1", "d2"])
    out = docs_of.join(placed, ["chunk", "d1", "d2"], "left")
    component = F.when(named, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.when(F.col("id") != none, F.col("id")).cast(docs.schema[doc_id].dataType).alias(doc_id),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(component != none, component).alias("component_id"),
    )
