"""Fusion of the layers' scores into one risk and level for each transaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.config import Fusion
from riskflow.functions import exprs as E


def one_row_each(df: DataFrame) -> DataFrame:
    """One row for each txn_id: the highest of each number; of anything else the first known one, in the order of values, since
    rows of a distributed table have no other.  Only rows whose id may come again (by its hash) are grouped, the others stay where they are."""
    numeric = (T.NumericType,)
    aggs = [(F.max(f.name) if isinstance(f.dataType, numeric) else F.min(f.name)).alias(f.name) for f in df.schema.fields if f.name != "txn_id"]
    df = df.select("txn_id", *(c for c in df.columns if c != "txn_id")).withColumn("_h", F.xxhash64("txn_id"))
    again = E.cut(df.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"))
    some = again.count()
    if some > E.SMALL:
        return E.cut(df.drop("_h").groupBy("txn_id").agg(*aggs))
    if not some:
        return df.drop("_h")
    once = df.join(F.broadcast(again), "_h", "left_anti").drop("_h")
    return once.unionByName(df.join(F.broadcast(again), "_h", "left_semi").drop("_h").groupBy("txn_id").agg(*aggs))


def global_score(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``glob``: the mean of both global scores (or the global behaviour score if it is there); null becomes the mean, 0.5 if all are null."""
    raw = E.number(df, "global_behavior_score") if "global_behavior_score" in df.columns else (E.number(df, "hbos_score") + E.number(df, "copod_score")) / 2
    df = E.with_scalars(df.withColumn("_g", raw), source or df, _mean=F.avg(raw))
    return df.withColumn("glob", E.clip(F.coalesce("_g", "_mean", F.lit(0.5)), 0.0, 1.0)).drop("_g", "_mean")


def trust(df: DataFrame, s: Fusion = Fusion(), source: DataFrame | None = None) -> DataFrame:
    """``alpha_debit`` and ``alpha_credit``: how much a party's own score counts, by its rows; 0 without one."""
    source = source or df
    for role in ("debit", "credit"):
        party = f"{role}_inn"
        counts = E.cut(source.where(F.col(party).isNotNull()).groupBy(party).agg(F.count(F.lit(1)).alias(f"n_{role}")))
        top = counts.agg(F.greatest(F.max(f"n_{role}"), F.lit(s.min_party_rows)).alias("_top"))
        df = E.with_lookup(df, counts, party).crossJoin(F.broadcast(top))
        alpha = E.clip(0.35 + 0.5 * F.log1p(F.coalesce(F.col(f"n_{role}"), F.lit(0))) / F.log1p("_top"), 0.35, 0.85)
        df = df.withColumn(f"alpha_{role}", F.when(E.number(df, f"iforest_score_{role}").isNotNull(), alpha).otherwise(0.0)).drop("_top")
    return df


def behaviour(df: DataFrame) -> DataFrame:
    """``behavior_risk``: own and global score blended by trust in each role, the higher of both; the global score without own ones."""
    risk = {r: F.when(E.number(df, f"iforest_score_{r}").isNotNull(), F.col(f"alpha_{r}") * E.number(df, f"iforest_score_{r}") + (1 - F.col(f"alpha_{r}")) * F.col("glob")) for r in ("debit", "credit")}
    return df.withColumns({f"risk_{r}": c for r, c in risk.items()}).withColumn("behavior_risk", E.clip(F.coalesce(F.greatest("risk_debit", "risk_credit"), F.col("glob")), 0.0, 1.0))


def correction(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``correction``: weighted mean of semantic, time-series and graph scores over those that are above 0 anywhere."""
    zero = lambda n: E.number(df, n, 0.0)
    parts = {"_sem": zero("semantic_risk_score"), "_ts": zero("ts_anomaly_score_txn"), "_graph": F.greatest(zero("graph_edge_score"), zero("graph_node_score"))}
    df = E.with_scalars(df.withColumns(parts), source or df, **{f"_m{n}": F.max(c) for n, c in parts.items()})
    weight = {n: F.when(F.col(f"_m_{n}") > 0, w).otherwise(0.0) for n, w in (("sem", 0.5), ("ts", 0.3), ("graph", 0.2))}
    total = sum(weight.values())
    value = F.when(total > 0, sum(w * F.col(f"_{n}") for n, w in weight.items()) / F.when(total > 0, total)).otherwise(0.0)
    return df.withColumn("correction", E.clip(value, 0.0, 1.0)).drop("_sem", "_ts", "_graph", "_m_sem", "_m_ts", "_m_graph")


def transaction_risk(df: DataFrame, s: Fusion = Fusion()) -> DataFrame:
    return df.withColumn("txn_risk_score", E.clip(F.col("behavior_risk") + s.gamma * F.col("correction"), 0.0, 1.0))


def ranked(df: DataFrame) -> DataFrame:
    """``txn_risk_rank``; reads ``df`` a few times, so give it a written table."""
    return E.rank_all(df, "txn_risk_score", "txn_risk_rank")


def overall(df: DataFrame, history: DataFrame | None = None, s: Fusion = Fusion()) -> DataFrame:
    """``overall_risk`` and ``risk_level``: the transaction's risk blended with its parties' graph score and history.

    ``history``: inn, role, history_risk, tx_count.  The base keeps a weight of ``min_base_weight`` at least; the other two
    shrink in proportion.
    """
    if history is None:
        df = df.withColumns({"history_risk": F.lit(None).cast("double"), "history_txns": F.lit(0).cast("long")})
    else:
        per = E.cut(history.groupBy("inn").pivot("role", ["debit", "credit"]).agg(F.max("history_risk").alias("h"), F.max("tx_count").alias("n")))
        for role in ("debit", "credit"):
            own = per.where(F.col(f"{role}_n").isNotNull()).select(F.col("inn").alias(f"{role}_inn"), F.col(f"{role}_h").alias(f"_h_{role}"), F.col(f"{role}_n").alias(f"_n_{role}"))
            df = E.with_lookup(df, own, f"{role}_inn")
        df = df.withColumns({"history_risk": F.greatest("_h_debit", "_h_credit"), "history_txns": F.coalesce(F.greatest("_n_debit", "_n_credit"), F.lit(0))}).drop("_h_debit", "_h_credit", "_n_debit", "_n_credit")
    n = F.col("history_txns").cast("double")
    w_h = F.when(F.col("history_risk").isNotNull(), s.history_cap * n / (n + s.history_hyper)).otherwise(0.0)
    node = E.number(df, "graph_node_score")
    df = df.withColumns({"_wh": w_h, "_wg": F.when(node.isNotNull(), s.graph_weight).otherwise(0.0), "_node": node})
    rest = F.col("_wh") + F.col("_wg")
    shrink = F.when(1 - rest < s.min_base_weight, (1 - s.min_base_weight) / rest).otherwise(1.0)
    df = df.withColumns({"w_history": F.col("_wh") * shrink, "w_graph": F.col("_wg") * shrink}).withColumn("w_base", 1 - F.col("w_history") - F.col("w_graph"))
    base = F.col("txn_risk_score")
    risk = F.col("w_base") * base + F.col("w_graph") * F.coalesce("_node", base) + F.col("w_history") * F.coalesce("history_risk", base)
    df = df.withColumn("overall_risk", E.clip(risk, 0.0, 1.0)).drop("_wh", "_wg", "_node")
    return df.withColumn("risk_level", E.risk_level(F.col("overall_risk"), s.yellow, s.red))


def fuse(df: DataFrame, history: DataFrame | None = None, s: Fusion = Fusion(), of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All of it, from layer scores.  Scalars and party counts come from all of the deduplicated input; ``df`` is computed once, before it is
    looked through for ids that come again.  ``of`` picks the rows of the result; what needs no party is computed before the parties are looked up, so
    less goes with the rows."""
    base = one_row_each(E.cut(df))
    rows = base if of is None else E.cut(of(base))
    return overall(transaction_risk(behaviour(trust(correction(global_score(rows, base), base), s, base)), s), history, s)


def mean_weights(df: DataFrame) -> DataFrame:
    return df.agg(*(F.avg(c).alias(c) for c in ("w_base", "w_graph", "w_history")))


def eligibility(df: DataFrame, least: int = 10) -> DataFrame:
    """Rows of each party by role and whether the individual layer fits it: in all and in the role."""
    counts = [df.where(F.col(f"{r}_inn").isNotNull()).groupBy(F.col(f"{r}_inn").alias("inn")).agg(F.count(F.lit(1)).alias(f"n_{r}")) for r in ("debit", "credit")]
    out = counts[0].join(counts[1], "inn", "full_outer").na.fill(0).withColumn("n_total", F.col("n_debit") + F.col("n_credit"))
    return out.withColumns({f"eligible_{r}": ((F.col("n_total") >= least) & (F.col(f"n_{r}") >= least)).cast("int") for r in ("debit", "credit")})


def keep_last(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last row of each key by an ingest sequence."""
    w = Window.partitionBy(key).orderBy(F.col(sequence).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
