"""Token-ID output: ids in bit-plane shuffled, zstandard-compressed chunks with a chunk index.

File format.  ``<path>/chunks`` is a Parquet table with one row for each chunk, a run of whole
documents in order: ``shard``, ``chunk`` (its number in the shard), ``first`` (ids of the shard before
it), ``n_ids``, ``doc_ids``, ``doc_lens`` and ``data``.  ``data`` cuts the ids into blocks of
``BLOCK`` ids; a block, an array of unsigned 32-bit little-endian integers, is transposed into byte
planes (or bit planes), and each plane is compressed with zstandard.  ``<path>/index`` has a row for
each chunk with its place in the whole (``start``), so a reader finds any document without decoding
what stands before it.

Documents are dealt by ranges of their id, so each task encodes and writes one shard in order; only
the shards' totals, a row for each, are summed to place them.  Ids that are null come first; rows with
equal ids are ordered by a hash of their text.  A null or empty text has only the end id.  The ids have to be integers (other
values fail in the cast); further columns are ignored, whatever their names; an empty table gives empty files.  A very long text is
encoded as a whole and is one document of one chunk.

Encoding splits texts where the vocabulary's own rules always split (white space, runs of letters, of
digits, of other characters), so that each distinct run is encoded once per worker and a text is a
vectorised look-up.  Texts with characters for which that split isn't proven (anything but ASCII and the
Latin letters up to U+024F, control characters, special tokens) are encoded whole by the library.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import shared_dir
from llm.words import _LOWER, SPACE, Piece, hash_spans, pieces

BLOCK = 1 << 16
CHUNK_IDS = 1 << 20
_HEAD = struct.Struct("<4sBII")
_MAGIC = b"TKP1"
_CACHE_RUNS = 600_000
CHUNKS_SCHEMA = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, doc_lens array<long>, data binary"


def pack(ids: np.ndarray, planes: str = "byte", level: int = 1) -> bytes:
    """Ids as blocks of compressed planes."""
    ids = np.ascontiguousarray(ids, "<u4")
    squeeze = zstandard.ZstdCompressor(level=level)
    out = [_HEAD.pack(_MAGIC, planes == "bit", BLOCK, len(ids))]
    for at in range(0, len(ids), BLOCK):
        rows = ids[at : at + BLOCK].view(np.uint8).reshape(-1, 4).T
        if planes == "bit":
            rows = np.packbits(np.unpackbits(np.ascontiguousarray(rows), axis=1, bitorder="little").reshape(4, -1, 8).transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")
        for plane in rows:
            small = squeeze.compress(np.ascontiguousarray(plane)) if plane.any() else b""
            out += [struct.pack("<I", len(small)), small]
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    """The ids that ``pack`` was given."""
    magic, bits, block, total = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a chunk of token ids")
    out, at, expand = np.zeros(total, "<u4"), _HEAD.size, zstandard.ZstdDecompressor()
    for begin in range(0, total, block):
        n = min(block, total - begin)
        size = (n + 7) // 8 if bits else n
        rows = np.zeros((32 if bits else 4, size), np.uint8)
        for row in rows:
            (length,) = struct.unpack_from("<I", data, at)
            at += 4
            if length:
                row[:] = np.frombuffer(expand.decompress(data[at : at + length], size), np.uint8)
            at += length
        if bits:
            rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :n].reshape(4, 8, n).transpose(0, 2, 1), axis=2, bitorder="little").reshape(4, n)
        out[begin : begin + n] = np.ascontiguousarray(rows.T).view("<u4").ravel()
    return out


_LETTER, _DIGIT, _OTHER, _SPACE = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[SPACE] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:] = _LETTER
_ODD = np.zeros(256, bool)  # bytes outside ASCII and U+00C0..U+024F
_ODD[:9] = _ODD[14:32] = True
_ODD[0x7F] = True
_ODD[0xC0:0xC3] = _ODD[0xCA:] = True


def plain_texts(piece: Piece) -> np.ndarray:
    """Which texts only have characters for which splitting into runs is exact."""
    raw = piece.raw
    odd = _ODD[raw]
    if len(raw) > 1:
        two = raw[:-1].astype(np.uint16) << 8 | raw[1:]
        odd[:-1] |= (two == 0xC397) | (two == 0xC3B7) | (two == 0xC4B0) | ((raw[:-1] == 0xC9) & (raw[1:] > 0x8F))
        odd[:-1] |= two == 0x3C7C  # "<|" may begin a special token
    total = np.concatenate(([0], np.cumsum(odd)))
    return total[piece.bounds[1:]] == total[piece.bounds[:-1]]


class Encoder:
    """The library's tokenizer with a cache of the ids of runs; one for each worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros((0, 2), np.int64)  # first id and number of ids of each key
        self.flat = np.zeros(0, np.uint16)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, runs: list[bytes]) -> None:
        simple = [i for i, r in enumerate(runs) if not (r[-1:].isdigit() or b"'" in r)]  # one pre-token each
        lengths = np.zeros(len(runs), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(runs)
        joined = [b" ".join(runs[i] for i in simple[a : a + 64]).decode() for a in range(0, len(simple), 64)]
        for a, ids in enumerate(self.whole(joined)):
            at = np.flatnonzero(self.ends[ids]) + 1
            here = simple[a * 64 : a * 64 + 64]
            if len(at) != len(here):
                raise ValueError("the vocabulary doesn't mark ends of words as expected")
            for i, x in zip(here, np.split(ids, at[:-1]), strict=True):
                parts[i] = x
        known = set(simple)
        rest = [i for i in range(len(runs)) if i not in known]
        for i, ids in zip(rest, self.whole([runs[i].decode() for i in rest]), strict=True):
            parts[i] = ids
        lengths[:] = [len(p) for p in parts]
        place = np.stack((len(self.flat) + np.cumsum(lengths) - lengths, lengths), 1)
        self.flat = np.concatenate((self.flat, *parts)).astype(np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys)
        self.keys, self.place = keys[order], np.concatenate((self.place, place))[order]

    def runs(self, piece: Piece, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes at which runs begin and end in the texts that are plain."""
        kind = _CLASS[piece.raw]
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) & ~((piece.raw[:-1] == 39) & (kind[1:] == _LETTER))
        edge[piece.bounds] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        owner = np.searchsorted(piece.bounds, starts, "right") - 1
        keep = (kind[starts] != _SPACE) & plain[owner]
        return starts[keep], ends[keep]

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number for each text."""
        n = piece.n
        plain = plain_texts(piece)
        lens = np.zeros(n, np.int64)
        starts, ends = self.runs(piece, plain) if len(piece.raw) else (np.zeros(0, np.int64),) * 2
        hashes = hash_spans(_LOWER[piece.raw], starts, ends)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != unique)) if len(self.keys) else np.arange(len(unique))
        if len(new):
            if len(self.keys) + len(new) > _CACHE_RUNS and len(self.keys):
                self.clear()
                new = np.arange(len(unique))
            raw = piece.raw.tobytes()
            self._learn(unique[new], [raw[starts[i] : ends[i]] for i in first[new].tolist()])
            at = np.searchsorted(self.keys, unique)
        where, size = self.place[at[back], 0], self.place[at[back], 1] if len(unique) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(total[-1]) + np.repeat(where - total[:-1], size)].astype(np.uint32)
        edges = total[np.searchsorted(starts, piece.bounds)]
        lens[:] = np.diff(edges)
        odd = np.flatnonzero(~plain)
        if len(odd):
            parts, last = [], 0
            for i, more in zip(odd.tolist(), self.whole([piece.text(i).decode() for i in odd.tolist()]), strict=True):
                parts += [ids[last : edges[i]], more]
                last, lens[i] = edges[i], len(more)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, lens


_ENCODERS: dict[str, Encoder] = {}


def encode_column(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of rows, ids and lengths for each piece of the column."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    for piece in pieces(column):
        yield piece.first, piece.n, *_ENCODERS[path].encode(piece)


def _with_end(ids: np.ndarray, lens: np.ndarray, end_id: int) -> np.ndarray:
    out = np.full(len(ids) + len(lens), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lens + 1) - 1] = False
    out[keep] = ids
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, planes: str = "byte", chunk_ids: int = CHUNK_IDS) -> None:
    """Encode the ``text`` column and write the files described above to ``path``, in ascending order of ``doc_id``
    (an integer column)."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, chunk, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal chunk, first
            ids = np.concatenate([h[2] for h in held])
            row = [[number], [chunk], [first], [len(ids)], [[x for h in held for x in h[0]]], [np.concatenate([h[1] for h in held])], [pack(ids, planes)]]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names)
            chunk, first = chunk + 1, first + len(ids)
            held.clear()
            return out

        for batch in batches:
            names_in = batch.column(0)
            for at, n, ids, lens in encode_column(batch.column(1), tokenizer):
                held.append((names_in.slice(at, n).to_pylist(), lens + 1, _with_end(ids, lens, end_id)))
                if sum(len(h[2]) for h in held) >= chunk_ids:
                    yield close()
        if held:
            yield close()

    names = [c.split()[0] for c in CHUNKS_SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    ordered = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = ordered.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(shard, CHUNKS_SCHEMA).write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = docs.sparkSession.read.parquet(f"{path}/chunks")
    index = _placed(chunks).select("shard", "chunk", "start", "n_ids", F.size("doc_ids").alias("n_docs"), F.get("doc_ids", F.lit(0)).alias("first_doc"))
    index.write.mode("overwrite").parquet(f"{path}/index")


def _placed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``start``: the ids of all shards and chunks before each."""
    from pyspark.sql import Window

    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_total"))  # a row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    return chunks.join(starts, "shard").withColumn("start", F.col("_start") + F.col("first")).drop("_start")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)
    of each document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lens = unpack(row["data"]), np.array(row["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    index = spark.read.parquet(f"{path}/index").select("shard", "chunk", "start")
    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "doc_ids", "doc_lens", "data")
    return chunks.join(index, ["shard", "chunk"]).select("start", "doc_ids", "doc_lens", "data").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the folder that all executors share."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
