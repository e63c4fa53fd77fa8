import datetime
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow import queries_more as Q
from riskflow.config import Forest, Settings
from riskflow.functions import exprs as E
from riskflow.operators import features, fusion, graph, kb, layers, review
from riskflow.plans import pipeline
from riskflow.sources import ledger
from riskflow.streaming import ledger_stream

DATA = "/root/testdata/sf0.001"
LEDGER = [
    ("t1", "2024-01-01", "A", "B", "10000", None, "Оплата по договору 12"),
    ("t2", "2024-01-01", "A", "C", "2500.50", None, "Возврат займа"),
    ("t3", "2024-01-03", "B", "C", None, "300000", "Заём ООО"),
    ("t4", "2024-01-08", "A", "B", "500", None, "USDT перевод"),
    ("t5", "2024-01-08", "C", "A", "100", None, "перевод на карту"),
    ("t6", "2024-01-31", "A", "A", "0", None, None),
    ("t7", "2024-02-29", "B", "A", "abc", "50000", "БЕЗНАЛИЧНЫЙ расчет"),
    ("t8", "2024-03-31", "A", "B", "20000", None, "Перевод денег: карта"),
]


@pytest.fixture(scope="module")
def small(spark):
    return ledger.prepare(spark.createDataFrame(LEDGER, "txn_id string, date string, debit_inn string, credit_inn string, debit_amount string, credit_amount string, purpose string"))


@pytest.mark.parametrize("name", ["prepare_base", "text_clean", "daily_aggregates", "rolling_30_debit", "novelty", "graph_edge_scores", "graph_node_scores", "ts_scores", "copod", "overall_risk", "kb_split", "hbos_all", "history_lookup", "llm_echo", "csv_round_trip", "edge_features_z"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "documents", "events", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = Q.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    result = con.execute(Q.ORACLE_SQL[name])
    place = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(place) == columns
    plain = lambda v: v if v is None or isinstance(v, int | str) else float(v) if not isinstance(v, datetime.date) else str(v)
    want = sorted((tuple(plain(r[place[c]]) for c in columns) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == want


def test_base_and_intervals(small):
    rows = {r["txn_id"]: r for r in features.novelty(features.daily(features.base(small))).collect()}
    assert [rows[f"t{i}"]["amount"] for i in range(1, 9)] == [10000, 2500.5, 300000, 500, 100, 0, 50000, 20000]
    assert [rows[f"t{i}"]["purpose_stopword_high"] for i in range(1, 9)] == [False, True, False, True, False, False, False, False]
    assert [rows[f"t{i}"]["days_since_last_txn_debit"] for i in range(1, 9)] == [9999, 0, 9999, 7, 9999, 23, 57, 60]
    assert [rows[f"t{i}"]["days_since_last_txn_credit"] for i in range(1, 9)] == [9999, 9999, 2, 7, 9999, 23, 29, 83]
    assert rows["t8"]["debit_new_counterparty_ratio"] == pytest.approx(0.6)


def test_rolling_counts_absent_days(small):
    rows = {str(r["date"]): r for r in features.rolling(small, "debit").where("inn = 'A'").collect()}
    r = rows["2024-01-08"]
    assert (r["debit_roll_sum_7d"], r["debit_roll_cnt_30d"]) == (500, 2)
    assert r["debit_roll_std_30d"] == pytest.approx(4397.822111, abs=1e-5)
    assert r["debit_roll_p95_7d"] == pytest.approx(350)
    assert rows["2024-03-31"]["debit_roll_p95_7d"] == pytest.approx(14000)


def test_ranks_scaling_and_deviation(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.2), (4, None), (5, 0.9)], "i int, x double")
    assert [r["r"] for r in E.rank_all(df, "x", "r").orderBy("i").collect()] == [0.25, 0.625, 0.625, None, 1]
    same = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [E.minmax_all(same, "x", "y", v).first()["y"] for v in "abcd"] == [0, 0.5, 0.5, 0]
    z = E.robust_z(spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3, 100)], "k string, x double"), ["x"], ["k"]).orderBy("x").collect()
    assert [round(r["x_z"], 4) for r in z] == [0.6745, 0, 0, 0.6745, 66.1]


def test_graph_fixture(spark):
    pairs = [("A", "B")] * 3 + [("A", "C")] * 2 + [("B", "C"), ("D", "C")]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "debit_inn string, credit_inn string, amount double")
    got = {r["u"] + r["v"]: r["graph_edge_score"] for r in graph.edge_scores(df).collect()}
    assert got == pytest.approx({"AB": 0, "AC": 0.47619, "BC": 0.571428, "CD": 0.999999}, abs=1e-5)
    nodes = {r["inn"]: (r["degree"], r["graph_node_score"]) for r in graph.node_scores(df).collect()}
    assert nodes["D"] == (1, pytest.approx(0.999998, abs=1e-5)) and nodes["A"][1] == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("per_edge", [1, 3])
def test_negative_pairs_are_as_many_as_asked(spark, per_edge):
    ring = [(f"n{i:04}", f"n{(i + k) % 1500:04}") for i in range(1500) for k in (1, 2, 3)]
    clique = [(f"c{i:02}", f"c{j:02}") for i in range(40) for j in range(i)] + [(f"x{i}", f"y{i}") for i in range(70)]
    star = [("hub", f"s{i}") for i in range(40)]
    full = [(f"f{i}", f"f{j}") for i in range(5) for j in range(i)]
    for links, want in ((ring, per_edge * 4500), (clique, per_edge * 850), (star, min(per_edge * 40, 780)), (full, 0), (full + [("f0", "g")], 4)):
        df = spark.createDataFrame([(a, b, 1.0) for a, b in links], "debit_inn string, credit_inn string, amount double")
        got = [tuple(r) for r in graph.negative_pairs(df, per_edge=per_edge).collect()]
        assert len(got) == len(set(got)) == want and all(u < v for u, v in got)
        assert not {tuple(sorted(x)) for x in links} & set(got)


def test_history_weight_and_level(spark):
    df = spark.createDataFrame([("x", "p", "q", 0.922142, 0.4)], "txn_id string, debit_inn string, credit_inn string, txn_risk_score double, graph_node_score double")
    r = fusion.overall(df, spark.createDataFrame([("p", "debit", 0.9, 50)], "inn string, role string, history_risk double, tx_count long")).first()
    assert (round(r["w_history"], 4), round(r["overall_risk"], 6), r["risk_level"]) == (0.03, 0.790942, "red")


def test_store_is_idempotent(spark, small, tmp_path):
    store = kb.Store(spark, str(tmp_path / "kb"))
    rows = kb.project(small.withColumn("overall_risk", F.lit(0.5)).withColumn("txn_id", F.concat(F.upper("txn_id"), F.lit(".0"))))
    for _ in range(2):
        store.write(rows)
    txns, stats = store.read()
    assert txns.count() == 8 and txns.where("txn_id = 't1'").count() == 1
    assert stats.count() == stats.select("role", "inn").distinct().count() == 6


def test_second_write_changes_only_what_it_touches(spark, small, tmp_path, monkeypatch):
    store = kb.Store(spark, str(tmp_path / "kb"), buckets=4, keep=2)
    rows = kb.project(small.withColumn("overall_risk", F.lit(0.5)))
    store.write(rows)
    first, opened, real = store._parts(1), [], kb.Store._open
    monkeypatch.setattr(kb.Store, "_open", lambda self, parts: real(self, opened.extend(parts := list(parts)) or parts))
    store.write(rows.where("txn_id = 't3'").withColumn("debit_inn", F.lit("Z")))
    monkeypatch.undo()
    second = store._parts(2)
    assert sum(first["txns"][b] != second["txns"][b] for b in first["txns"]) == 1
    # reads: the part of the id, and parts of the parties B, C and Z only
    own = {r[0] for r in spark.createDataFrame([("B",), ("C",), ("Z",)], "inn string").select(store._bucket("inn")).collect()}
    assert {p for p in opened if p[0].startswith("txns")} == {first["txns"][b] for b in first["txns"] if first["txns"][b] != second["txns"][b]}
    assert all(b in own for of in (first, second) for b, p in of["sides"].items() if p in opened)
    txns, stats = store.read()
    assert txns.where("txn_id = 't3'").first()["debit_inn"] == "Z" and txns.count() == 8
    got = {(r["role"], r["inn"]): r["tx_count"] for r in stats.collect()}
    assert got["debit", "Z"] == 1 and got["debit", "B"] == 1 and len(got) == 7
    store.write(rows.where("txn_id = 't7'").withColumn("debit_inn", F.lit("Z")))
    assert ("debit", "B") not in {(r["role"], r["inn"]) for r in store.read()[1].collect()}  # a party without rows has no profile
    store.write(rows.limit(0))
    assert store._versions() == [2, 3] and not [n for n in store._names() if n.split("-")[1] == "1" and not any(p[0].startswith(n) for of in store._parts(2).values() for p in of.values())]


def same_profiles(store):
    txns, stats = store.read()
    names = [c for c in stats.columns if c != "updated_at"]
    rows = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=str)
    return rows(stats) == rows(kb.profiles(txns))


def test_profiles_after_many_writes_are_those_computed_anew(spark, tmp_path):
    rng = np.random.default_rng(2)
    store = kb.Store(spark, str(tmp_path / "kb"), buckets=3)
    for turn in range(3):  # new rows, overwritten rows that change party, day and risk, rows without a party
        rows = [(f"t{int(k)}", f"2024-0{1 + int(rng.integers(5))}-11", *(None if rng.random() < 0.1 else f"p{int(rng.integers(6))}" for _ in "dc"), float(rng.random()), float(rng.integers(9))) for k in rng.choice(60, 25, replace=False)]
        df = spark.createDataFrame(rows, "txn_id string, date string, debit_inn string, credit_inn string, overall_risk double, amount double")
        store.write(kb.project(df.withColumns({"txn_risk_score": F.col("overall_risk"), "purpose": F.lit("loan back"), "in_out_ratio_30d": F.col("overall_risk")})))
        last = store.read()[0]
        assert same_profiles(store) and last.count() == last.select("txn_id").distinct().count()


def test_two_writers_lose_nothing(spark, small, tmp_path, monkeypatch):
    """A second writer, that began from the same version, commits while the first one is about to."""
    rows = kb.project(small.withColumn("overall_risk", F.lit(0.5)))
    one, other = (kb.Store(spark, str(tmp_path / "kb"), buckets=4) for _ in range(2))
    one.write(rows.where("txn_id < 't3'"))
    real, turns = kb.Store._commit, []

    def late(self, version, name):
        if self is one and len(turns) < 2:
            turns.append(version)
            other.write(rows.where(f"txn_id = 't{4 + len(turns)}'"))
        return real(self, version, name)

    monkeypatch.setattr(kb.Store, "_commit", late)
    one.write(rows.where("txn_id = 't3'"))
    assert turns == [2, 3] and one._versions()[-1] == 4
    assert {r["txn_id"] for r in one.read()[0].collect()} == {"t1", "t2", "t3", "t5", "t6"} and same_profiles(one)
    assert not [n for n in one._names() if n.startswith("draft")]
    monkeypatch.setattr(kb.Store, "_commit", lambda self, version, name: False)
    with pytest.raises(RuntimeError):
        kb.Store(spark, str(tmp_path / "kb"), buckets=4, tries=2).write(rows.where("txn_id = 't7'"))
    assert "t7" not in {r["txn_id"] for r in one.read()[0].collect()}


def test_stream_into_the_store(spark, small, tmp_path):
    for i in range(2):
        small.withColumns({"overall_risk": F.lit(0.1 * i), "amount": F.col("amount") + i}).write.parquet(str(tmp_path / f"in/{i}"))
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    stream = spark.readStream.schema(small.withColumn("overall_risk", F.lit(0.1)).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    store = kb.Store(spark, str(tmp_path / "kb"), buckets=4)
    ledger_stream.upsert_stream(stream, store, str(tmp_path / "c")).awaitTermination(120)
    txns, stats = store.read()
    assert txns.count() == txns.select("txn_id").distinct().count() == 8 and stats.count() == 6


def test_daily_totals_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-01 12:00:00", 2.0), ("b", "2024-01-02 01:00:00", 5.0), ("a", "2024-01-09 00:00:00", 7.0)], "user_id string, ts string, value double").select("user_id", F.to_timestamp("ts").alias("ts"), "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id string, ts timestamp, value double").parquet(str(tmp_path / "e"))
    ledger_stream.daily_totals(stream).writeStream.format("memory").queryName("totals").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    got = {(r["user_id"], str(r["date"])): r["total"] for r in spark.table("totals").collect()}
    assert got == {("a", "2024-01-01"): 3.0, ("b", "2024-01-02"): 5.0}  # the last day may still get rows


def test_null_parties_stay_alone(spark, small):
    rows = {r["txn_id"]: r for r in features.novelty(features.daily(small.withColumn("debit_inn", F.when(F.col("txn_id") != "t1", F.col("debit_inn"))))).collect()}
    assert rows["t1"]["daily_total_debit"] is None and rows["t1"]["days_since_last_txn_debit"] == 9999 and rows["t1"]["debit_new_counterparty_ratio"] is None


def test_hot_values_and_ranges(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 4000, 0.0).otherwise(F.col("id") / 7).alias("x"))
    got = {r["id"]: r["r"] for r in E.rank_all(df, "x", "r").collect()}
    assert len(got) == 5000 and got[0] == got[3999] == pytest.approx(2000.5 / 5000) and got[4999] == 1.0 and got[4000] == pytest.approx(4001 / 5000)


def test_forest_finds_an_outlier_in_parts_as_well(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{i:03}", "p", "debit", float(rng.normal()) + (30 if i == 7 else 0), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "txn_id string, inn string, side string, amount double, log_amount double").withColumn("days_since_last", F.lit(1))
    whole, parts = ({r["txn_id"]: r["iforest_score_debit"] for r in layers.individual(df, Forest(trees=50, group_rows=n)).collect()} for n in (1000, 50))
    assert max(whole, key=whole.get) == "t007" and len(whole) == len(parts) == 120 and min(whole.values()) == min(parts.values()) == 0
    # fitted on a third of the rows, seen or not seen the outlier
    assert np.corrcoef([whole[t] for t in sorted(whole)], [parts[t] for t in sorted(parts)])[0, 1] > 0.7


def test_vectors_are_those_of_a_plain_decomposition(spark):
    texts = ["loan one", "loan two", "cash out", "cash in", "gift box", "gift bag now"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "txn_id string, purpose_clean string")
    long = features.tfidf(df, "txn_id").collect()
    grams = sorted({r["gram"] for r in long})
    a = np.zeros((6, len(grams)))
    for r in long:
        a[int(r["txn_id"]), grams.index(r["gram"])] = r["weight"]
    u, values, _ = np.linalg.svd(a, full_matrices=False)
    want = u[:, :3] * values[:3]
    got = np.array([r["vector"] for r in sorted(layers.purpose_vectors(df, dims=3, width=1 << 14).collect(), key=lambda r: r["txn_id"])])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)


def test_storefront_and_fallbacks(spark):
    df = spark.createDataFrame([("t", "ПЕРЕВОД: ЗаЙм", 5.0, 1.4), ("u", None, 6.0, 0.2)], "txn_id string, purpose string, amount double, txn_risk_score double")
    got = {r["txn_id"]: r for r in review.storefront(df).collect()}
    assert got["t"]["purpose_stopword_high"] == 1 and got["t"]["overall_risk"] == 1 and got["u"]["purpose_stopword_high"] == 0


def test_whole_run_twice(spark, tmp_path):
    """The second run sees the history that the first one left."""
    rows = ledger.synthetic_ledger(spark, DATA).where("cast(debit_inn as int) <= 12").drop("x_quantity", "x_tax", "x_part", "x_line")
    for i in range(2):
        rows.where(f"x_discount % 2 = {i}").drop("x_discount").write.parquet(str(tmp_path / f"in{i}.parquet"))
    out = [pipeline.run(spark, str(tmp_path / f"in{i}.parquet"), str(tmp_path / "kb"), Settings(forest=Forest(trees=10))) for i in range(2)]
    for i, result in enumerate(out):
        got = result.enriched.select("txn_id", "overall_risk", "risk_level", "history_risk", "llm_risk_level").collect()
        assert len({r["txn_id"] for r in got}) == len(got) > 0 and all(0 <= r["overall_risk"] <= 1 and not math.isnan(r["overall_risk"]) and r["risk_level"] for r in got)
        assert any(r["history_risk"] is not None for r in got) == bool(i)
    assert kb.Store(spark, str(tmp_path / "kb")).read()[0].count() == rows.count()
