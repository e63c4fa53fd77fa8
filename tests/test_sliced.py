"""Windows over hot parties in slices, against the plain windows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.functions import exprs as E
from riskflow.operators import features, sliced

ORDER = ["date", "txn_id"]


@pytest.fixture(scope="module")
def rows(spark):
    """One payer has nine tenths of the rows, another more than the limit; ties of day, a repeated row, rows without a party."""
    rng = np.random.default_rng(5)
    out = []
    for k in range(3000):
        payer = "hot" if rng.random() < 0.9 else ["warm", "cold", None, "x"][int(rng.integers(4))]
        payee = None if rng.random() < 0.03 else f"p{int(rng.integers(60)) ** 2 // 40}"
        out.append((f"t{int(rng.integers(10**9)):09}", dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(300))), payer, payee, float(rng.integers(1, 40))))
    out.append(out[7])
    df = spark.createDataFrame(out, "txn_id string, date date, debit_inn string, credit_inn string, amount double")
    return df.withColumns({"debit_amount": F.col("amount"), "credit_amount": F.lit(0.0)}).cache()


@pytest.fixture(scope="module")
def many(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def same(a, b):
    a, b = (sorted(map(tuple, x.collect()), key=str) for x in (a, b))
    return len(a) == len(b) and all(x == y or all(p == q or math.isclose(p, q, rel_tol=1e-12) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("limit", [50, 1000])
def test_gaps_and_novelty(rows, many, limit):
    names = ["txn_id", "debit_inn", "credit_inn", *(f"days_since_last_txn_{r}" for r in ("debit", "credit")), "daily_total_debit"]
    assert same(features.daily(rows, hot_rows=limit).select(*names), features.daily(rows).select(*names))
    for n in (1, 2, 30, 200):  # longer than some slices
        assert same(features.novelty(rows, n, hot_rows=limit).select("txn_id", "debit_new_counterparty_ratio"), features.novelty(rows, n).select("txn_id", "debit_new_counterparty_ratio"))
    assert features.novelty(rows, hot_rows=limit).columns == features.novelty(rows).columns


def test_hot_party_is_many_small_slices(rows, many):
    dealt, starts = sliced.slices(rows.where("debit_inn = 'hot'"), "debit_inn", ORDER)
    sizes = [r["count"] for r in dealt.groupBy("_slice").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 0.15 * sum(sizes)  # the largest task of a window over (party, slice)
    assert sorted(r["_start"] for r in starts.collect()) == sorted(np.concatenate(([0], np.cumsum([n for _, n in sorted((r["_slice"], r["count"]) for r in dealt.groupBy("_slice").count().collect())])[:-1])))


def test_only_parties_beyond_the_limit(rows):
    assert sliced.hot_groups(rows, ["debit_inn", "credit_inn"], 1000) == {"debit_inn": ["hot"], "credit_inn": []}
    assert sliced.hot_groups(rows.limit(0), ["debit_inn"], 1) == {"debit_inn": []}


def test_ranks_and_scales_within_parties(rows, many):
    known = rows.where("debit_inn is not null").withColumn("amount", F.when(F.col("amount") != 3, F.col("amount")))
    assert same(E.rank_within(known, "amount", ["debit_inn"], "r").select("txn_id", "r"), known.select("txn_id", E.rank_by("amount", ["debit_inn"]).alias("r")))
    for kind in "abcd":
        assert same(E.minmax_within(known, "amount", "m", ["debit_inn"], kind).select("txn_id", "m"), known.select("txn_id", E.minmax_by("amount", ["debit_inn"], kind).alias("m")))
    assert E.rank_within(rows.limit(0), "amount", ["debit_inn"], "r").count() == 0
