"""Column helpers that several layers share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPS = 1e-6
HOT = 1000  # a value is hot if it has more than 1 / HOT of all rows, so at most HOT values are
SMALL = 300_000  # a table of so many narrow rows is broadcast


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, which all executors share.  A local session may do without naming one; a cluster may not."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a write in here is freed when it is done.  Spark would keep it until the driver happens to collect its garbage, so the disk would hold the
    shuffles of all steps at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_made = threading.local()  # the folders of ``cut`` for each ``tidy`` that runs in the thread


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from its plan by a Parquet table in the shared folder.  Later steps read only the columns they need."""
    at = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(at)
    if getattr(_made, "folders", None):
        _made.folders[-1].append((df.sparkSession, at))
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextmanager
def scratch() -> Iterator[list[tuple[SparkSession, str]]]:
    """The tables that are ``cut`` in here are removed at its end, but for those taken from the list of their folders."""
    outer, mine = getattr(_made, "folders", []), []
    _made.folders = [*outer, mine]
    try:
        yield mine
    finally:
        _made.folders = outer
        for spark, at in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``step`` with its result computed at once (``cut``); the tables that were cut on the way to it are removed when it is there."""

    @wraps(step)
    def run(*args, **kwargs) -> DataFrame:
        with scratch() as made:
            out = cut(step(*args, **kwargs))
            kept = made.pop()
        if _made.folders:
            _made.folders[-1].append(kept)
        return out

    return run


def packed_id(c: Column) -> Column:
    """An id as bytes, two hexadecimal digits in one; ``unpacked_id`` gives it back as it was."""
    return F.when(c.rlike("^([0-9a-f]{2})+$"), F.concat(F.unhex(F.lit("01")), F.unhex(c))).otherwise(F.concat(F.unhex(F.lit("00")), c.cast("binary")))


def unpacked_id(c: Column) -> Column:
    rest = F.substring(c, 2, (1 << 31) - 1)
    return F.when(F.substring(c, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def with_lookup(df: DataFrame, values: DataFrame, keys: str | list[str], how: str = "left") -> DataFrame:
    """``df`` joined with ``values`` (computed once, by the caller's ``cut``; a row for each key): broadcast up to ``SMALL`` rows, else both are shuffled and ``df`` isn't sorted for it."""
    return df.join(F.broadcast(values) if values.count() <= SMALL else values.hint("shuffle_hash"), keys, how)


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add the columns that are missing, with a constant."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def number(df: DataFrame, name: str, default: float | None = None) -> Column:
    """A column as double: unparseable values and nulls become ``default``, so does a column that isn't there."""
    if name not in df.columns:
        return F.lit(default).cast("double")
    got = F.col(name).try_cast("double")
    got = F.when(~F.isnan(got), got)
    return got if default is None else F.coalesce(got, F.lit(float(default)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    return a / (b + F.lit(eps))


def with_scalars(df: DataFrame, source: DataFrame | None = None, **aggs: Column) -> DataFrame:
    """``df`` with aggregates over all rows of ``source`` (``df`` itself by default) as columns: a one-row aggregate joined
    by broadcast, never a window without keys.  A ``source`` from before many steps saves computing them again."""
    return df.crossJoin(F.broadcast((source or df).agg(*(c.alias(n) for n, c in aggs.items()))))


def minmax_expr(c: Column, low: Column, high: Column, variant: str) -> Column:
    """Scale to 0..1 by what happens without spread: ``a`` range + 1e-9; ``b`` 0.5 up to 1e-9; ``c`` 0.5 up to 1e-6, else
    range + 1e-6; ``d`` 0."""
    span = high - low
    if variant == "a":
        return (c - low) / (span + F.lit(1e-9))
    if variant == "b":
        return F.when(span <= 1e-9, F.when(c.isNotNull(), 0.5)).otherwise((c - low) / F.when(span > 1e-9, span))
    if variant == "c":
        return F.when(span <= 1e-6, F.when(c.isNotNull(), 0.5)).otherwise((c - low) / (span + F.lit(1e-6)))
    return F.when(span <= 0, F.when(c.isNotNull(), 0.0)).otherwise((c - low) / F.when(span > 0, span))


def minmax_by(name: str, keys: list[str], variant: str) -> Column:
    w = Window.partitionBy(*keys)
    return minmax_expr(F.col(name), F.min(name).over(w), F.max(name).over(w), variant)


def minmax_all(df: DataFrame, name: str, out: str, variant: str) -> DataFrame:
    df = with_scalars(df, _low=F.min(name), _high=F.max(name))
    return df.withColumn(out, minmax_expr(F.col(name), F.col("_low"), F.col("_high"), variant)).drop("_low", "_high")


def running_counts(counts: DataFrame, value: str, count: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``counts`` (``keys``, ``value``, ``count``: distinct values) with ``below`` (rows with smaller values) and ``total`` (all rows), for each
    of the ``keys``.  Values are dealt by range and a total for each range, a row each, places its running sums, so no window
    sees all of them."""
    ranged = cut(counts.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()))  # computed once, so both readers see the same ranges
    totals = ranged.groupBy(*keys, "_p").agg(F.sum(count).alias("_t"))
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = of_key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_p", F.coalesce(F.sum("_t").over(order), F.lit(0)).alias("_start"), F.sum("_t").over(of_key).alias("total"))
    inside = Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_b", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(F.broadcast(starts), [*keys, "_p"])  # a row for each range
    return placed.withColumn("below", F.col("_start") + F.col("_b")).drop("_p", "_start", "_b")


def join_values(df: DataFrame, values: DataFrame, keys: list[str], out: list[str]) -> DataFrame:
    """``df`` with the columns ``out`` of ``values`` (one row for each of ``keys``; ``count`` and ``total`` tell how frequent they are).  Hot
    values, HOT at most for each total, are broadcast; only the other rows are shuffled."""
    values = cut(values)
    hot = values.where(F.col("count") * HOT > F.col("total")).select(*keys, *(F.col(c).alias(f"_hot_{c}") for c in out), F.lit(True).alias("_hot"))
    both = df.join(F.broadcast(hot), keys, "left")
    done, rest = both.where("_hot"), both.where("_hot is null").drop(*(f"_hot_{c}" for c in out), "_hot")
    rest = rest.join(values.select(*keys, *out), keys, "left")
    return done.withColumnsRenamed({f"_hot_{c}": c for c in out}).drop("_hot").unionByName(rest)


def rank_all(df: DataFrame, name: str, out: str) -> DataFrame:
    """Percent rank over all rows with ties averaged: (rank + (ties - 1) / 2) / n; nulls don't count and stay null.  ``df`` is read
    a few times."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name)).agg(F.count(F.lit(1)).alias("count"))
    ranks = running_counts(counts, name, "count").withColumn(out, (F.col("below") + 1 + (F.col("count") - 1) / 2) / F.col("total"))
    return join_values(df, ranks, [name], [out]).select(*df.columns, out)


def rank_within(df: DataFrame, name: str, keys: list[str], out: str) -> DataFrame:
    """Percent rank within groups of any size, ties averaged; nulls don't count and stay null, rows without a key have none.  Distinct values are dealt by
    range, so a group may be many tasks."""
    counts = df.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("count"))
    ranks = running_counts(counts, name, "count", keys).withColumn(out, (F.col("below") + 1 + (F.col("count") - 1) / 2) / F.col("total"))
    return df.join(ranks.select(*keys, name, out), [*keys, name], "left").select(*df.columns, out)


def minmax_within(df: DataFrame, name: str, out: str, keys: list[str], variant: str) -> DataFrame:
    """Scaled to 0..1 within groups of any size by their least and largest values; rows without a key have none."""
    ends = df.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.min(name).alias("_low"), F.max(name).alias("_high"))
    joined = df.join(ends, keys, "left")
    return joined.withColumn(out, minmax_expr(F.col(name), F.col("_low"), F.col("_high"), variant)).select(*df.columns, out)


def rank_by(name: str, keys: list[str]) -> Column:
    """Percent rank within a group, ties averaged."""
    w = Window.partitionBy(*keys)
    value = F.col(name)
    ties = F.count(value).over(Window.partitionBy(*keys, value))
    below = F.rank().over(w.orderBy(value.asc_nulls_last()))
    return F.when(value.isNotNull(), (below + (ties - 1) / 2) / F.count(value).over(w))


def percentiles(df: DataFrame, name: str, shares: list[float]) -> DataFrame:
    """One row ``p_0``, ``p_1`` ...: the values at ``shares`` of all rows with a value, interpolated between neighbours, exactly.  From counts of distinct values dealt by range, so no
    task sees all of them."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name)).agg(F.count(F.lit(1)).alias("count"))
    placed = running_counts(counts, name, "count")
    out = []
    for i, share in enumerate(shares):
        at = (F.col("total") - 1) * F.lit(float(share))
        held = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("count")), F.col(name).cast("double")))
        low, high, part = held(F.floor(at)), held(F.ceil(at)), F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(f"p_{i}"))
    return placed.agg(*out)


def robust_z(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """``<name>_z`` = \\|x - median\\| / ((MAD + 1e-6) * 1.4826) within a group.  A group is sorted in one task: give it rows that a group has
    few of, such as the days of a party."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({f"_dev_{n}": F.abs(F.col(n) - F.median(n).over(w)) for n in names})
    df = df.withColumns({f"{n}_z": F.col(f"_dev_{n}") / ((F.median(f"_dev_{n}").over(w) + F.lit(EPS)) * F.lit(1.4826)) for n in names})
    return df.drop(*(f"_dev_{n}" for n in names))


def zscore_by(name: str, keys: list[str]) -> Column:
    """Standardised with the population deviation; 0 without spread."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(name).over(w)
    return F.when(sd > 0, (F.col(name) - F.avg(name).over(w)) / sd).otherwise(F.lit(0.0))


def risk_level(c: Column, yellow: float = 0.31, red: float = 0.70) -> Column:
    return F.when(c >= red, "red").when(c >= yellow, "yellow").when(c.isNotNull(), "green")


# What the levels of a reply are worth
LEVEL_VALUES = {"красный": 0.9, "жёлтый": 0.6, "желтый": 0.6, "зелёный": 0.1, "зеленый": 0.1, "red": 0.9, "yellow": 0.6, "green": 0.1}


def level_value(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LEVEL_VALUES.items() for x in pair))
    return F.try_element_at(known, F.lower(F.trim(c)))


def clean_text(c: Column) -> Column:
    """Lower case; anything but a-z, Cyrillic a-ya, digits and white space becomes a space; spaces collapse.  A null is ``nan``."""
    low = F.lower(F.coalesce(c, F.lit("nan")))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-zа-я0-9\s]", " "), r"\s+", " "))


def has_raw_stem(c: Column, stems: tuple[str, ...]) -> Column:
    """1.0 if the text holds one of the stems anywhere, in any case; a null holds none."""
    return F.coalesce(F.lower(c).rlike("(" + "|".join(stems) + ")"), F.lit(False)).cast("double")


def zscores(df: DataFrame, names: list[str]) -> DataFrame:
    """Each column standardised over all rows with its population deviation; 0 without spread."""
    stats = df.agg(*(F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).alias(f"_{n}") for n in names))
    df = df.crossJoin(F.broadcast(stats))  # one row
    return df.withColumns({n: F.when(F.col(f"_{n}.s") > 0, (F.col(n) - F.col(f"_{n}.m")) / F.col(f"_{n}.s")).otherwise(0.0) for n in names}).drop(*(f"_{n}" for n in names))


def bottom_n(df: DataFrame, by: str, n: int, key: str = "txn_id") -> DataFrame:
    """The ``n`` rows with the lowest values, nulls left out, ties by key."""
    return df.where(F.col(by).isNotNull()).orderBy(by, key).limit(n)


def has_stem(cleaned: Column, stems: tuple[str, ...]) -> Column:
    """Whether a word of cleaned text begins with one of the stems."""
    return cleaned.rlike("(^| )(" + "|".join(stems) + ")")


def python_number(c: Column) -> Column:
    """A double as text with at least one decimal and no trailing zeros, up to six decimals; null is ``nan``."""
    plain = F.regexp_replace(c.cast("decimal(24,6)").cast("string"), "0+$", "")
    return F.coalesce(F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain), F.lit("nan"))
