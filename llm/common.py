"""What the operators share: materialising, mapping over pieces of text, packed exchanges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.words import PIECE_BYTES, SPACE, Piece, column_bytes, piece_end, pieces


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder.  Where none is set, a folder of this machine
    serves a local master; a cluster has to name one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint where columns repeat."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, int]) -> Iterator[None]:
    """Spark's settings while the jobs in the ``with`` block run; the former ones come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def best(df: DataFrame, keys: list[str], order: list, item: str, top: int, slices: int = 64) -> DataFrame:
    """The first ``top`` rows of each group, with ``rank`` from 1.  Slices of a group, dealt by ``item``, are ranked first, so the task of a group gets
    ``slices * top`` rows at most."""
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(item), F.lit(slices)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))).where(F.col("rank") <= top)
    return first.drop("_slice").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)


def map_pieces(
    df: DataFrame,
    text: str,
    fn: Callable[[Piece, pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    separators: np.ndarray = SPACE,
) -> DataFrame:
    """Apply ``fn`` to each piece of the ``text`` column and the rows that it covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(text), separators):
                out = fn(piece, batch.slice(piece.first, piece.n))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def whole_pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches that ``pieces`` takes as one piece each, whatever batches they came in."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        held = pa.concat_batches([held, batch]) if held is not None else batch
        _, at = column_bytes(held.column(text))
        row = 0
        while (end := piece_end(at, row, size)) < held.num_rows:
            yield held.slice(row, end - row)
            row = end
        held = held.slice(row)
    if held is not None and held.num_rows:
        yield held


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a per-byte or per-word array for each text, empty texts included."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """A bucket in 0..n-1 from the high bits of 64-bit hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def per_group(n: int, fan: int) -> int:
    """Buckets for each group of the first step when ``n`` buckets are dealt: 1 if one step is enough.

    A sender has a packet for each target, so with ever more senders and ever more buckets packets would shrink to
    nothing.  Beyond ``fan`` buckets they are dealt to groups of buckets first, then (``redeal``) within the groups.
    """
    return 1 if n <= fan else -(-n // -(-n // fan))


def offsets_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array, and its end."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else np.zeros(1, np.int64)


def binaries(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The runs of an array that begin at ``cut`` (and its end) as binary values."""
    at = np.ascontiguousarray(cut * values.itemsize, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def packets(target: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each target with any values: ``to`` and the values of each column, packed."""
    order = np.argsort(target, kind="stable")
    target = target[order]
    cut = offsets_of(target)
    arrays = [pa.array(target[cut[:-1]], pa.int64()), *(binaries(c[order], cut) for c in columns.values())]
    return pa.RecordBatch.from_arrays(arrays, ["to", *columns])


def unpack(table: pa.Table | pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def redeal(df: DataFrame, kinds: dict[str, type], target: Callable[[dict[str, np.ndarray]], np.ndarray], n: int, fan: int, held_bytes: int = 8 << 20) -> DataFrame:
    """Packets dealt to groups of buckets (``to``: the group), dealt to the buckets of each group."""
    if per_group(n, fan) == 1:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= held_bytes:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        columns = {c: unpack(table, c, k) for c, k in kinds.items()}
        return packets(target(columns), columns)

    return df.repartition("to").mapInArrow(run, df.schema)
