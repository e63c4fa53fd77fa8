"""Steps that shuffle no more than they need, and their results against plain Python."""

import datetime
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.functions import exprs as E
from riskflow.operators import features, fusion, graph, kb, layers, review
from riskflow.sources import workbook


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_with_an_id_of_their_own_are_not_grouped(spark):
    once = spark.createDataFrame([("a", 1.0, "x"), ("b", None, None)], "txn_id string, amount double, purpose string")
    out = fusion.one_row_each(once)
    assert sorted(map(tuple, out.collect())) == [("a", 1.0, "x"), ("b", None, None)]
    assert "Exchange" not in plan(out)
    more = once.union(spark.createDataFrame([("a", 3.0, "w"), ("a", None, None), (None, 1.0, "n"), (None, 2.0, "m")], once.schema))
    assert sorted(map(tuple, fusion.one_row_each(more).collect()), key=str) == sorted([("a", 3.0, "w"), ("b", None, None), (None, 2.0, "m")], key=str)


def test_a_cut_reads_the_columns_asked_for(spark):
    kept = E.cut(spark.range(5).select("id", (F.col("id") * 2).alias("twice")))
    assert [r[0] for r in kept.select("twice").orderBy("twice").collect()] == [0, 2, 4, 6, 8]
    assert "ReadSchema: struct<twice:bigint>" in plan(kept.select("twice"))
    assert kept.schema["id"].dataType == spark.range(1).schema["id"].dataType and E.cut(spark.range(0)).count() == 0


@pytest.mark.parametrize("small", [0, 300_000])
def test_lookups_are_equal_broadcast_or_not(spark, monkeypatch, small):
    monkeypatch.setattr(E, "SMALL", small)
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", None, 3.0), ("b", "x", 3.0)], "debit_inn string, credit_inn string, iforest_score_debit double").withColumn("txn_id", F.monotonically_increasing_id())
    got = {(r["debit_inn"], r["credit_inn"]): (r["n_debit"], r["n_credit"]) for r in fusion.trust(rows).collect()}
    assert got == {("a", "x"): (2, 2), ("a", "y"): (2, 1), ("b", None): (2, None), ("b", "x"): (2, 2)}


def test_percentiles_come_from_counts(spark):
    values = [float(v) for v in np.random.default_rng(3).integers(0, 40, 301)] + [1e6]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = E.percentiles(df, "v", [0.0, 0.5, 0.95, 1.0])
    assert list(got.first()) == pytest.approx(list(np.percentile(values, [0, 50, 95, 100])))
    assert "percentile(" not in plan(got)
    assert E.percentiles(df.where("v is null"), "v", [0.5]).first()[0] is None


def test_standard_features_keep_their_scale(spark):
    wide = layers.standardised(spark.range(50).select(F.col("id").cast("string").alias("txn_id"), (F.col("id") % 7 / 3).alias("v")), ["v"])
    assert "stddev_pop" not in plan(wide)  # reading it again doesn't add up again


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_copula_score_however_values_are_looked_up(spark, monkeypatch, few):
    monkeypatch.setattr(layers, "FEW", few)
    rng = np.random.default_rng(5)
    x = np.column_stack((rng.exponential(size=40).round(2), rng.integers(0, 2, 40), np.zeros(40), -rng.exponential(size=40).round(1)))
    df = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "txn_id string, x array<double>")
    want = np.zeros(40)
    for c in x.T:
        left, right = (-np.log([(s * c <= s * v).mean() for v in c]) for s in (1, -1))
        skew = ((c - c.mean()) ** 3).mean()
        want += np.maximum(left if skew < -1e-12 else right if skew > 1e-12 else left + right, (left + right) / 2)
    got = {r["txn_id"]: r["copod_raw"] for r in layers.copod(df).collect()}
    assert [got[str(i)] for i in range(40)] == pytest.approx(list(want))


@pytest.mark.parametrize("listed", [1, 3, 2000])
def test_common_neighbours_by_lists(spark, monkeypatch, listed):
    monkeypatch.setattr(graph, "LISTED", listed)
    rng = np.random.default_rng(7)
    pairs = sorted({tuple(sorted(map(str, p))) for p in rng.integers(0, 14, (45, 2)) if p[0] != p[1]} | {(str(i), "hub") for i in range(14)})
    near = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    edges = spark.createDataFrame(pairs, "u string, v string")
    asked = [*pairs, *[p for p in itertools.combinations(sorted(near), 2) if p not in pairs][:30], ("0", "nobody")]
    both = lambda u, v: near.get(u, set()) & near.get(v, set())
    got = {(r["u"], r["v"]): r for r in graph.common_neighbours(spark.createDataFrame(asked, "u string, v string"), edges).collect()}
    only = {(r["u"], r["v"]): r["common"] for r in graph.common_neighbours(spark.createDataFrame(asked, "u string, v string"), edges, weighed=False).collect()}
    df = spark.createDataFrame([(u, v, 1.0) for u, v in pairs], "debit_inn string, credit_inn string, amount double")
    close = {(r["u"], r["v"]): r for r in graph.neighbourhoods(df).collect()}
    for u, v in asked:
        w = both(u, v)
        want = (len(w), sum(1 / math.log(len(near[x])) for x in w if len(near[x]) > 1), sum(1 / len(near[x]) for x in w))
        assert only[u, v] == want[0]
        for found in (got, close) if (u, v) in pairs else (got,):
            assert tuple(found[u, v][c] for c in ("common", "adamic_adar", "resource_allocation")) == pytest.approx(want)


def test_split_features_differ_in_their_nodes_and_come_alike():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6, 5))
    x[:, 3], x[:3, 0], x[5] = 2.0, 1.0, x[4]
    nodes, size = np.tile([0, 1, 2, 3, 4, 5, 4, 5, 3], 900), np.tile([3, 3, 2, 1], 900)
    some = np.array([0, 1, 2, 4])
    for tries in (0, 1, 4):
        f, low, high = layers.IsolationForest._split_features(x, nodes, size, some, rng, tries)
        f, low, high = f.reshape(-1, 4), low.reshape(-1, 4), high.reshape(-1, 4)
        assert set(f[:, 0]) == {1, 2, 4} and set(f[:, 1]) == {0, 1, 2, 4} and set(f[:, 2]) == {-1} == set(f[:, 3])
        assert all(np.allclose((low[f[:, 0] == k, 0], high[f[:, 0] == k, 0]), [[x[:3, k].min()], [x[:3, k].max()]]) for k in (1, 2, 4))
        assert min(np.bincount(f[:, 0])[[1, 2, 4]]) > 230 and min(np.bincount(f[:, 1])[[0, 1, 2, 4]]) > 170


def test_tasks_put_workbooks_in_place(spark, tmp_path, monkeypatch):
    df = spark.range(0, 95, 1, 5).select(F.col("id"), F.concat(F.lit("t"), "id").alias("t"))
    put = []
    plain = workbook._put
    monkeypatch.setattr(workbook, "_put", lambda *a: put.append(a[1].getName()) or plain(*a))
    for shared, through in ((True, 0), (False, 15)):
        at = str(tmp_path / str(shared))
        if not shared:
            monkeypatch.setattr(workbook, "_mounted", lambda *_: None)
        made = workbook.write_workbooks(df, at, 7)
        assert len(made) == len(set(made)) == 15 and len(put) == through
        assert sorted(map(tuple, workbook.read_workbook(spark, at).collect())) == [(float(i), f"t{i}") for i in range(95)]


def test_series_are_scored_without_a_second_shuffle(spark):
    rng = np.random.default_rng(2)
    rows = [("debit", p, i, *(float(v) for v in rng.integers(0, 9, 5)), int(i % 5 > 0)) for p, n in (("a", 20), ("b", 11), ("c", 30)) for i in range(n)] + [("credit", "a", 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1)]
    days = spark.createDataFrame(rows, "side string, inn string, date int, daily_total double, daily_count double, in_out double, net_flow double, client_round double, is_active_day int")
    out = layers.series_scores(days)
    assert plan(out).count("Exchange") == 1 and out.columns == [*days.columns, "ts_score"]
    got = {tuple(r[:3]): r["ts_score"] for r in out.collect()}
    want = dict.fromkeys(got, 0.0)
    for p in "ac":  # b has fewer than ten active days
        mine = [r for r in rows if r[:2] == ("debit", p) and r[8]]
        x = np.array([r[3:8] for r in mine])
        dev = np.abs(x - np.median(x, 0))
        raw = (dev / ((np.median(dev, 0) + 1e-6) * 1.4826)).mean(1)
        want |= {r[:3]: v for r, v in zip(mine, (raw - raw.min()) / (raw.max() - raw.min()))}
    assert len(got) == len(rows) and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.fixture(scope="module")
def payments(spark):
    """Several rows a day, days apart, rows without a party or a day, a repeated id."""
    rng = np.random.default_rng(9)
    day = lambda: None if rng.random() < 0.03 else datetime.date(2024, 1, 1) + datetime.timedelta(days=int(rng.integers(120)))
    name = lambda n: None if rng.random() < 0.05 else f"p{int(rng.integers(n))}"
    rows = [(f"{k % 290:03}", day(), name(3), name(4), float(rng.integers(0, 5)), float(rng.integers(0, 5)), int(rng.integers(2))) for k in range(300)]
    df = spark.createDataFrame(rows, "txn_id string, date date, debit_inn string, credit_inn string, debit_amount double, credit_amount double, is_round_amount int")
    return df.withColumn("amount", F.col("debit_amount") + F.col("credit_amount"))


def test_a_partys_windows_share_one_shuffle_for_each_role(payments):
    out = features.by_party(payments, (7, 30), volatile=True, fan=True)
    assert plan(out).count("Exchange") == 2


@pytest.mark.parametrize("hot", [20, 5_000_000])
def test_windows_over_rows_are_those_of_days(payments, hot):
    got = features.by_party(payments, (7, 30, 90), volatile=True, fan=True, hot_rows=hot).collect()
    assert len(got) == 300
    rows = [r.asDict() for r in got]
    for role, party, other in (("debit", "debit_inn", "credit_inn"), ("credit", "credit_inn", "debit_inn")):
        for r in rows:
            mine = [x for x in rows if r[party] is not None and x[party] == r[party]]
            today = [x for x in mine if x["date"] == r["date"]]
            if r["date"] is None or r[party] is None:
                assert r[f"{role}_roll_sum_7d"] is None and r[f"{role}_roll_p95_90d"] is None and r[features.FANS[role][2]] is None
                continue
            first = min(x["date"] for x in mine if x["date"])
            for w in (7, 90):
                n = min(w, (r["date"] - first).days + 1)
                days = [sum(x[f"{role}_amount"] for x in mine if x["date"] == r["date"] - datetime.timedelta(days=k)) for k in range(n)]
                want = (sum(days), sum(v > 0 for v in days), np.mean(days), np.std(days, ddof=1) if n > 1 else 0.0, np.percentile(days, 95))
                assert tuple(r[f"{role}_roll_{a}_{w}d"] for a in ("sum", "cnt", "mean", "std", "p95")) == pytest.approx(want, abs=1e-6)
            month = [x for x in mine if x["date"] and 0 <= (r["date"] - x["date"]).days < 30]
            assert r[f"{role}_client_round_ratio_30d"] == pytest.approx(np.mean([x["is_round_amount"] for x in month]))
            assert r[features.FANS[role][2]] == pytest.approx(len({x[other] for x in today} - {None}) / len(today))
            assert r[f"daily_total_{role}"] == pytest.approx(sum(x["amount"] for x in today))


def test_both_sides_come_from_one_pass(payments):
    wide = features.by_party(payments.withColumn("purpose", F.lit("x")), (7,))
    long = features.roles(wide)
    assert plan(long).count("Exchange") == 2 and "Union" not in plan(long)
    got = {(r["side"], r["inn"], r["date"], r["txn_id"], r["amount"], r["daily_total"], r["roll_sum_7d"]) for r in long.collect()}
    want = {(k, r[f"{k}_inn"], r["date"], r["txn_id"], r[f"{k}_amount"], r[f"daily_total_{k}"], r[f"{k}_roll_sum_7d"]) for r in wide.collect() for k in features.ROLES if r[f"{k}_inn"] is not None}
    assert got == want


def test_profiles_hold_no_percentiles_for_each_partner(spark):
    rows = [("1", "2024-01-01", "a", "x", 0.2), ("2", "2024-03-01", "a", "x", 0.9), ("3", "2024-03-05", "a", None, 0.4), ("4", None, "b", "y", 0.5), ("5", "2024-02-01", None, "y", 0.7), ("6", "2024-02-01", "c", None, 0.1)]
    txns = kb.project(spark.createDataFrame(rows, "txn_id string, date string, debit_inn string, credit_inn string, overall_risk double").withColumns({"in_out_ratio_30d": F.col("overall_risk"), "purpose_clean": F.lit("x")}))
    out = kb.profiles(txns)
    assert "count(distinct" not in plan(out).lower()
    got = {(r["role"], r["inn"]): (r["tx_count"], r["uniq_counterparties"], r["first_tx_date"], r["last_tx_date"], round(r["transit_ratio"], 4), r["suspicious_cp_cnt"]) for r in out.collect()}
    assert got == {
        ("debit", "a"): (3, 1, "2024-01-01", "2024-03-05", 0.3333, 1), ("debit", "b"): (1, 1, None, None, 0.0, 0), ("debit", "c"): (1, 0, "2024-02-01", "2024-02-01", 0.0, 0),
        ("credit", "x"): (2, 1, "2024-01-01", "2024-03-01", 0.5, 1), ("credit", "y"): (2, 1, "2024-02-01", "2024-02-01", 0.0, 0),
    }


def test_a_store_deals_its_rows_once_and_withdraws_sides(spark, tmp_path, monkeypatch):
    dealt = []
    plain = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *a: dealt.append(plan(plain(df, *a))) or plain(df, *a))
    row = lambda *rows: kb.project(spark.createDataFrame(rows, "txn_id string, debit_inn string, credit_inn string, amount double"))
    store = kb.Store(spark, str(tmp_path / "kb"), buckets=2)
    store.write(row(("1", "a", "x", 1.0), ("2", "a", "y", 2.0), ("3", "b", "x", 3.0), ("4", "b", None, 4.0)))
    store.write(row(("2", "c", "y", 5.0), ("3", "b", "x", 6.0), ("4", None, "x", 7.0), ("5", "a", "z", 8.0)))
    txns, stats = store.read()
    assert sorted((r["txn_id"], r["debit_inn"], r["amount"]) for r in txns.collect()) == [("1", "a", 1.0), ("2", "c", 5.0), ("3", "b", 6.0), ("4", None, 7.0), ("5", "a", 8.0)]
    got = {(r["role"], r["inn"]): (r["tx_count"], r["amount_mean"]) for r in stats.collect()}
    assert got == {("debit", "a"): (2, 4.5), ("debit", "b"): (1, 6.0), ("debit", "c"): (1, 5.0), ("credit", "x"): (3, pytest.approx(14 / 3)), ("credit", "y"): (1, 5.0), ("credit", "z"): (1, 8.0)}
    store.write(row(("3", "c", "x", 6.0)))  # b has nothing left
    assert "b" not in {r["inn"] for r in store.read()[1].collect()}
    assert len(dealt) == 9 and not any("Join" in p for p in dealt[0::3] + dealt[1::3])  # transactions and sides of each write


def test_blend_reads_its_input_once_and_may_be_of_some_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = [(f"{i:02x}", f"p{i % 3}", f"q{i % 2}", i / 50, (50 - i) / 50, i / 49 if i % 4 else None, 0.3, i / 60, "tax" if i % 5 == 0 else "loan", i % 10 == 0) for i in range(50)]
    schema = "txn_id string, debit_inn string, credit_inn string, hbos_score double, copod_score double, iforest_score_debit double, semantic_risk_score double, graph_node_score double, purpose string, purpose_stopword_high boolean"
    df = spark.createDataFrame(rows, schema)
    every = {r["txn_id"]: r for r in fusion.fuse(df.mapInPandas(counted, schema)).collect()}
    assert seen.value == len(every) == 50
    some = fusion.fuse(df, of=lambda base: base.orderBy("txn_id").limit(7)).collect()  # scalars and counts are still those of all rows
    assert len(some) == 7 and all(r.asDict() == every[r["txn_id"]].asDict() for r in some)
    twice = fusion.fuse(df.unionByName(df.withColumn("hbos_score", F.lit(0.0)))).collect()
    assert {r["txn_id"]: r["overall_risk"] for r in twice} == {k: r["overall_risk"] for k, r in every.items()}
    blended = fusion.fuse(df.withColumn("is_tax", review.is_tax(("tax",))))
    assert sorted(map(tuple, review.rule_levels(blended.drop("purpose", "purpose_stopword_high")).select("txn_id", "rule_level").collect())) == sorted(map(tuple, review.rule_levels(blended.drop("is_tax"), ("tax",)).select("txn_id", "rule_level").collect()))


def test_lists_of_neighbours_are_never_broadcast(spark, monkeypatch):
    """Spark broadcasts what is small as a compressed file, and the lists unpacked filled the driver's memory."""
    plans, real = [], E.cut
    monkeypatch.setattr(E, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0)], "debit_inn string, credit_inn string, amount double")
    graph.neighbourhoods(df)
    assert any("array_intersect" in p and "ShuffledHashJoin [b#" in p for p in plans)
    pairs = E.cut(graph.edges(df).select("u", "v"))
    plan = graph.common_neighbours(pairs, pairs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [node#" not in plan and "near#" in plan


def test_a_list_goes_once_to_each_part_that_asks(spark, monkeypatch):
    """Lists went to each pair, so a node with 30 pairs was shuffled 30 times."""
    pairs = [(f"a{i}", f"b{j}") for i in range(30) for j in range(30)]
    edges = spark.createDataFrame(pairs, "u string, v string")
    asked, real = [], graph._look_up
    monkeypatch.setattr(graph, "_look_up", lambda dealt, *rest: (asked.extend(dealt.where("kind = 1").select("node", "part", F.size("of").alias("n")).collect()), real(dealt, *rest))[1])
    got = graph.common_neighbours(edges, edges)
    assert got.count() == 900 and got.agg(F.sum("common")).first()[0] == 0
    assert sum(r["n"] for r in asked) == 900 and len({(r["node"], r["part"]) for r in asked}) == len(asked) < 450


def test_tidy_steps_leave_their_result_alone(spark):
    """Tables and shuffles of passed steps stayed on the disk."""
    tables = lambda: set(os.listdir(E.shared_folder(spark).removeprefix("file:")))
    before = tables()

    @E.tidy
    def inner():
        return E.cut(spark.range(4)).where("id > 0")

    @E.tidy
    def outer():
        return E.cut(inner()).join(inner(), "id")

    assert sorted(r[0] for r in outer().collect()) == [1, 2, 3] and len(tables() - before) == 1
    with pytest.raises(ZeroDivisionError):
        E.tidy(lambda: 1 / 0)()
    E.cut(spark.range(1))
    assert len(tables() - before) == 2


def test_a_cut_frees_what_it_shuffled(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen, before = [], spark.conf.get(name, "false")
    with E.freeing(spark):
        seen.append(spark.conf.get(name))
    assert seen == ["true"] and spark.conf.get(name) == before


def test_ids_are_shuffled_as_bytes_and_come_back(spark, tmp_path, monkeypatch):
    """A store shuffled ids as text, and what it computed on the way stayed on the disk."""
    ids = ["0a1f", "0A1F", "abc", "", "a", "Ы", "00", "01", "ffff" * 16, None]
    rows = spark.createDataFrame([(i,) for i in ids], "txn_id string").withColumn("b", E.packed_id(F.col("txn_id")))
    assert {r[0]: r[1] for r in rows.select("txn_id", E.unpacked_id(F.col("b"))).collect()} == {i: i for i in ids}
    assert rows.where(F.col("txn_id") == "ffff" * 16).select(F.length("b")).first()[0] == 33 and rows.select("b").distinct().count() == len(ids)
    tables = lambda: set(os.listdir(E.shared_folder(spark).removeprefix("file:")))
    before = tables()
    store = kb.Store(spark, str(tmp_path / "store"), buckets=2)
    made = kb.project(spark.createDataFrame([("0a1f", "7", "8", 2.0), ("x", "8", "7", 3.0)], "txn_id string, debit_inn string, credit_inn string, amount double"))
    store.write(made)
    store.write(made.where("txn_id = 'x'"))
    assert sorted(r["txn_id"] for r in store.read()[0].collect()) == ["0a1f", "x"] and tables() == before


def test_days_are_dealt_before_they_are_grouped(spark):
    """Sums by task held an id for each of five measures, and these were shuffled."""
    day = datetime.date(2020, 1, 1)
    rows = [("b", "1", day, 1.0, None), ("a", "1", day, None, 2.0), ("c", "1", day, 5.0, 6.0), ("d", None, day, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "txn_id string, debit_inn string, date date, m double, k double")
    days = layers.daily_series(df, "debit", {n: "m" if n == "daily_total" else "k" for n in layers.SERIES})
    assert "min_by" not in plan(days).split("Exchange")[1]
    assert [(r["inn"], r["daily_total"], r["in_out"]) for r in days.collect()] == [("1", 1.0, 2.0)]


@pytest.mark.parametrize("at_once", [1, 2, 50])
def test_copula_score_however_many_features_at_once(spark, monkeypatch, at_once):
    """The shuffles of all features were on the disk at once."""
    monkeypatch.setattr(layers, "AT_ONCE", at_once)
    x = np.random.default_rng(5).normal(size=(30, 3)).round(1)
    x[:, 1] = np.exp(x[:, 1]).round(1)
    df = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "txn_id string, x array<double>")
    want = np.zeros(len(x))
    for c in x.T:
        left, right = (-np.log([(s * c <= s * v).mean() for v in c]) for s in (1, -1))
        skew = ((c - c.mean()) ** 3).mean()
        want += np.maximum(left if skew < -1e-12 else right if skew > 1e-12 else left + right, (left + right) / 2)
    got = {r["txn_id"]: r["copod_raw"] for r in layers.copod(df).collect()}
    assert [got[str(i)] for i in range(30)] == pytest.approx(list(want))
    assert layers.copod(df.limit(0)).count() == 0


def test_storefront_blends_once(spark, monkeypatch):
    """the blend was computed for the profiles and again for what is shown."""
    from riskflow import queries_more

    calls, real = [], queries_more.fused
    monkeypatch.setattr(queries_more, "fused", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    monkeypatch.setattr("riskflow.queries.fused", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    queries_more.QUERIES["storefront"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
