"""More registered queries: what joins, stores, reads, writes and checks; the rest is in ``riskflow.queries``.

Where a model has no SQL, a query gives properties of its result that SQL can state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import config
from riskflow.functions import exprs as E
from riskflow.operators import features, fusion, graph, kb, layers, links, review
from riskflow.plans import pipeline
from riskflow.queries import _GRAPH, _STATS, _WIDE, BOTH_ROLLS, DAILY, FUSED, ORACLE_SQL, QUERIES, RANKSQL, STEMS, WINDOWS, P, R, based, fused, kb_columns, kb_rows, packed, prepared, query, raw, rounded_amounts, stats, unpacked
from riskflow.sources import ledger, sinks, workbook

__all__ = ["ORACLE_SQL", "QUERIES"]


def folder(spark: SparkSession) -> str:
    """A new folder among those that the executors share."""
    return f"{E.shared_folder(spark)}/{uuid.uuid4().hex}"


def sub(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


# sources and sinks

_BASE = ["txn_id", "date", "debit_inn", "credit_inn", "debit_amount", "credit_amount", "purpose"]


def _csv(s: SparkSession, d: str) -> DataFrame:
    at = folder(s)
    sinks.write_csv(raw(s, d).select(*_BASE), f"{at}/b.csv")
    sinks.write_csv(s.range(1), f"{at}/c.csv")
    return ledger.prepare(ledger.load_statement(s, ledger.discover_statement(s, at))).select("txn_id", "date", "debit_inn", "amount", "purpose")


def _json(s: SparkSession, d: str) -> DataFrame:
    at = folder(s)
    sinks.write_json(prepared(s, d).select("txn_id", "credit_inn", "amount"), at)
    return s.read.json(at)


query("csv_round_trip", f"WITH {P} SELECT txn_id, date, debit_inn, amount, purpose FROM p")(_csv)
query("json_round_trip", f"WITH {P} SELECT txn_id, credit_inn, amount FROM p")(_json)

# preparation

query("fallback_keyword", f"WITH {P} SELECT txn_id, CAST(regexp_matches(lower(purpose), '({'|'.join(STEMS)})') AS DOUBLE) AS flag FROM p")(
    lambda s, d: prepared(s, d).select("txn_id", E.has_raw_stem(F.upper("purpose"), STEMS).alias("flag"))
)
query("global_logs", f"WITH {DAILY} SELECT txn_id, {R('ln(1 + abs(amount))')} AS log_amount, {R('ln(1 + gd)')} AS log_days_since_last_debit, {R('ln(1 + gc)')} AS log_days_since_last_credit FROM dl", log_amount=6, log_days_since_last_debit=6, log_days_since_last_credit=6)(
    lambda s, d: layers.with_logs(features.daily(prepared(s, d))).select("txn_id", "log_amount", "log_days_since_last_debit", "log_days_since_last_credit")
)
_REL = "coalesce({r}_amount / (nullif({t}_mean30, 0) + 1e-6), 0)"
query("log_gap_relative", f"WITH {_WIDE} SELECT txn_id, 'debit' AS side, {R('ln(1 + gd)')} AS log_days_since_last, {R(_REL.format(r='debit', t='d'), 4)} AS rel_amount_to_mean30d FROM x UNION ALL SELECT txn_id, 'credit', {R('ln(1 + gc)')}, {R(_REL.format(r='credit', t='c'), 4)} FROM x", log_days_since_last=6, rel_amount_to_mean30d=4)(
    lambda s, d: unpacked(layers.role_features(features.roles(features.derived(features.by_party(packed(based(s, d)), WINDOWS))))).select("txn_id", "side", "log_days_since_last", "rel_amount_to_mean30d")
)
_KB_SQL = {
    "txn_id": "lower(txn_id)", "date": "CAST(date AS VARCHAR)", "purpose_clean": "clean", "purpose_stopword_high": "CAST(kw AS DOUBLE)", "global_score": "gl", "iforest_score_debit": "fd", "iforest_score_credit": "fc",
    "behavior_risk_debit": "CASE WHEN fd IS NOT NULL THEN ad * fd + (1 - ad) * gl END", "behavior_risk_credit": "CASE WHEN fc IS NOT NULL THEN ac * fc + (1 - ac) * gl END", "base_behavior_risk": "beh", "txn_risk_score": "txr", "semantic_risk_score": "sem",
    "ts_anomaly_score_txn": "ts", "graph_edge_score": "ge", "graph_node_score": "gn", "round_large_amount": "CAST(amount % 10000 = 0 AS INT)", "debit_fan_out_ratio": "dc / 10.0", "credit_fan_in_ratio": "tx / 8.0", "in_out_ratio_30d": "io",
}
_KB_ROUNDED = [c for c in kb.FIXED if c in _KB_SQL and c not in ("txn_id", "date", "purpose_clean", "round_large_amount")]
query("kb_projection", f"WITH {FUSED} SELECT {', '.join((R(_KB_SQL[c]) if c in _KB_ROUNDED else _KB_SQL.get(c, c)) + f' AS {c}' for c in kb.FIXED)} FROM fu", **dict.fromkeys(_KB_ROUNDED, 6))(
    lambda s, d: kb.project(fused(s, d, *kb.FIXED, "is_round_amount").withColumn("txn_id", F.concat(F.lit(" "), F.upper("txn_id"), F.lit(".0 ")))).select(*kb.FIXED)
)
query("contamination", f"WITH {P}, c AS (SELECT debit_inn AS inn, count(*)::DOUBLE AS n FROM p GROUP BY 1) SELECT inn, {R('greatest(least(least(greatest(3 / n, 0.02), 10 / n), 0.2), 0.02)')} AS share FROM c", share=6)(
    lambda s, d: prepared(s, d).groupBy(F.col("debit_inn").alias("inn")).count().select("inn", layers.contamination(F.col("count")).alias("share"))
)
query("node_ids", f"WITH {P} SELECT inn, row_number() OVER (ORDER BY inn) - 1 AS id FROM (SELECT debit_inn AS inn FROM p UNION SELECT credit_inn FROM p)")(lambda s, d: graph.node_ids(prepared(s, d)))
_VZ = "coalesce(({t}_std30 / ({t}_mean30 + 1e-6) - avg({t}_std30 / ({t}_mean30 + 1e-6)) OVER (PARTITION BY {r}_inn)) / nullif(stddev_pop({t}_std30 / ({t}_mean30 + 1e-6)) OVER (PARTITION BY {r}_inn), 0), 0)"
query("volatility_z", f"WITH {_WIDE} SELECT txn_id, {R(_VZ.format(t='d', r='debit'), 4)} AS debit_volatility_z, {R(_VZ.format(t='c', r='credit'), 4)} AS credit_volatility_z FROM x", debit_volatility_z=4, credit_volatility_z=4)(
    lambda s, d: unpacked(features.by_party(packed(prepared(s, d)), WINDOWS, volatile=True, days=False)).select("txn_id", "debit_volatility_z", "credit_volatility_z")
)

# time series of all five measures, on amounts of which some are round

_PR = P.replace("coalesce(d, c, 0.0) AS amount", "floor(coalesce(d, c, 0.0) / 5000) * 5000 AS amount")
_DAILY_R = DAILY.replace(P, _PR)


def _flows(role: str) -> str:
    frame = "OVER (PARTITION BY inn ORDER BY date RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND CURRENT ROW)"
    return f""", g_{role} AS MATERIALIZED (SELECT {role}_inn AS inn, CAST(date AS TIMESTAMP) AS date, sum({role}_amount) AS amt, count(*) AS n, count(*) FILTER (amount % 10000 = 0) AS k FROM p GROUP BY 1, 2),
 h_{role} AS MATERIALIZED (SELECT inn, CAST(date AS DATE) AS date, sum(amt) {frame.format(n=6)} AS s7, sum(amt) {frame.format(n=29)} AS s30, sum(k) {frame.format(n=29)} / sum(n) {frame.format(n=29)} AS share FROM g_{role})"""


_TS5 = f"""{_DAILY_R} {_flows('debit')} {_flows('credit')}, mm AS MATERIALIZED (SELECT dl.*, (c.s30 - d.s30) / (c.s30 + d.s30 + 1e-6) AS io, greatest(least((c.s7 - d.s7) / (c.s7 + d.s7 + 1e-6), 1), -1) AS nf, d.share AS rd, c.share AS rc
 FROM dl JOIN h_debit d ON d.inn = debit_inn AND d.date = dl.date JOIN h_credit c ON c.inn = credit_inn AND c.date = dl.date),
 ev AS (SELECT 'debit' AS side, debit_inn AS inn, date, txn_id, td AS total, nd AS cnt, io, nf, rd AS cr FROM mm UNION ALL SELECT 'credit', credit_inn, date, txn_id, tc, nc, io, nf, rc FROM mm),
 dy AS MATERIALIZED (SELECT side, inn, date, min_by(total, txn_id)::DOUBLE AS m1, min_by(cnt, txn_id)::DOUBLE AS m2, min_by(io, txn_id) AS m3, min_by(nf, txn_id) AS m4, min_by(cr, txn_id) AS m5 FROM ev GROUP BY 1, 2, 3),
 ac AS MATERIALIZED (SELECT * FROM dy WHERE abs(m1) > 0 AND (side, inn) IN (SELECT (side, inn) FROM dy WHERE abs(m1) > 0 GROUP BY side, inn HAVING count(*) >= 10)),
 me AS MATERIALIZED (SELECT side, inn, {', '.join(f'median(m{i}) AS c{i}' for i in range(1, 6))} FROM ac GROUP BY 1, 2),
 dv AS MATERIALIZED (SELECT side, inn, date, {', '.join(f'abs(m{i} - c{i}) AS d{i}' for i in range(1, 6))} FROM ac JOIN me USING (side, inn)),
 ma AS MATERIALIZED (SELECT side, inn, {', '.join(f'median(d{i}) AS a{i}' for i in range(1, 6))} FROM dv GROUP BY 1, 2),
 rw AS MATERIALIZED (SELECT side, inn, date, ({' + '.join(f'd{i} / ((a{i} + 1e-6) * 1.4826)' for i in range(1, 6))}) / 5 AS rw FROM dv JOIN ma USING (side, inn)),
 ex AS MATERIALIZED (SELECT side, inn, min(rw) AS lo, max(rw) AS hi FROM rw GROUP BY 1, 2), sc AS MATERIALIZED (SELECT side, inn, date, CASE WHEN hi = lo THEN 0 ELSE (rw - lo) / (hi - lo) END AS ts FROM rw JOIN ex USING (side, inn))"""
_TXTS5 = _TS5 + ", tt AS (SELECT txn_id, coalesce(a.ts, 0) AS x, coalesce(b.ts, 0) AS y FROM dl LEFT JOIN sc a ON a.side = 'debit' AND a.inn = debit_inn AND a.date = dl.date LEFT JOIN sc b ON b.side = 'credit' AND b.inn = credit_inn AND b.date = dl.date)"


def _measured(s: SparkSession, d: str) -> DataFrame:
    return features.derived(features.by_party(packed(features.base(rounded_amounts(prepared(s, d)), STEMS)), WINDOWS))


def _of_transactions(s: SparkSession, d: str) -> DataFrame:
    return unpacked(layers.time_series(layers.series_input(_measured(s, d)), rank=False))


@E.tidy
def _scored_days(s: SparkSession, d: str) -> DataFrame:
    df = E.cut(layers.series_input(_measured(s, d)))
    sides = [E.cut(layers.series_scores(layers.daily_series(df, r, layers.measures(r))).select("side", "inn", "date", "ts_score")) for r in ("debit", "credit")]
    return sides[0].unionByName(sides[1])


def _series(s: SparkSession, d: str) -> DataFrame:
    df = E.cut(layers.series_input(_measured(s, d)))
    sides = [layers.daily_series(df, r, layers.measures(r)) for r in ("debit", "credit")]
    return sides[0].unionByName(sides[1])


query("ts_daily", f"WITH {_TS5} SELECT side, inn, date, {R('m1', 2)} AS daily_total, m2 AS daily_count, {R('m3', 5)} AS in_out, {R('m4', 5)} AS net_flow, {R('m5', 5)} AS client_round, CAST(abs(m1) > 0 AS INT) AS is_active_day FROM dy", daily_total=2, in_out=5, net_flow=5, client_round=5)(
    lambda s, d: _series(s, d).select("side", "inn", "date", *layers.SERIES, "is_active_day")
)
query("ts_scores", f"WITH {_TS5} SELECT dy.side, dy.inn, dy.date, {R('coalesce(ts, 0)', 4)} AS ts_score FROM dy LEFT JOIN sc ON sc.side = dy.side AND sc.inn = dy.inn AND sc.date = dy.date", ts_score=4)(_scored_days)
query("ts_transactions", f"WITH {_TXTS5} SELECT txn_id, {R('x', 4)} AS ts_anomaly_score_debit, {R('y', 4)} AS ts_anomaly_score_credit, {R('greatest(x, y)', 4)} AS ts_anomaly_score_txn FROM tt", ts_anomaly_score_debit=4, ts_anomaly_score_credit=4, ts_anomaly_score_txn=4)(
    lambda s, d: _of_transactions(s, d)
)
query("top_n_ts", f"WITH {_TXTS5} SELECT txn_id, {R('greatest(x, y)', 4)} AS ts_score FROM tt ORDER BY {R('greatest(x, y)', 4)} DESC, txn_id LIMIT 20")(
    lambda s, d: _of_transactions(s, d).select("txn_id", (F.round(F.col("ts_anomaly_score_txn") + F.lit(1e-7), 4) + F.lit(0.0)).alias("ts_score")).orderBy(F.desc("ts_score"), "txn_id").limit(20)
)

# joins

query("profile_join", f"WITH {P}, a AS (SELECT debit_inn, count(DISTINCT credit_inn) AS k FROM p GROUP BY 1), b AS (SELECT credit_inn, count(DISTINCT date) AS k FROM p GROUP BY 1) SELECT txn_id, a.k AS debit_inn_partners, b.k AS credit_inn_active_days FROM p JOIN a ON a.debit_inn = p.debit_inn JOIN b ON b.credit_inn = p.credit_inn")(
    lambda s, d: features.add_profiles(prepared(s, d)).select("txn_id", "debit_inn_partners", "credit_inn_active_days")
)


def _graph(s: SparkSession, d: str, canonical: bool) -> DataFrame:
    df = prepared(s, d)
    near = graph.neighbourhoods(df)
    return graph.enrich(df, graph.edge_scores(df, near), graph.node_scores(df, near), canonical).select("txn_id", "graph_edge_score", "graph_node_score")


for _name, _on in (("graph_join", "e.u = least(debit_inn, credit_inn) AND e.v = greatest(debit_inn, credit_inn)"), ("graph_join_as_stored", "e.u = debit_inn AND e.v = credit_inn")):
    query(_name, f"WITH {P} SELECT txn_id, e.graph_edge_score, greatest(a.graph_node_score, b.graph_node_score) AS graph_node_score FROM p LEFT JOIN {sub('graph_edge_scores')} e ON {_on} LEFT JOIN {sub('graph_node_scores')} a ON a.inn = debit_inn LEFT JOIN {sub('graph_node_scores')} b ON b.inn = credit_inn", graph_edge_score=6, graph_node_score=6)(
        lambda s, d, canonical=_name == "graph_join": _graph(s, d, canonical)
    )
query("layer_join", f"WITH {P} SELECT p.txn_id, t.ts_anomaly_score_txn, e.graph_edge_score FROM p LEFT JOIN {sub('ts_transactions')} t ON t.txn_id = p.txn_id LEFT JOIN {sub('graph_edge_scores')} e ON e.u = least(debit_inn, credit_inn) AND e.v = greatest(debit_inn, credit_inn)", ts_anomaly_score_txn=4, graph_edge_score=6)(
    lambda s, d: pipeline.with_layers(_graph(s, d, True), [_of_transactions(s, d)]).select("txn_id", "ts_anomaly_score_txn", "graph_edge_score")
)
query("history_lookup", f"""WITH {_STATS}, l AS (SELECT txn_id, txr, gn, greatest(a.hist, b.hist) AS h, greatest(coalesce(a.tx_count, 0), coalesce(b.tx_count, 0)) AS n, CASE WHEN gn IS NULL THEN 0 ELSE 0.25 END AS g FROM fu LEFT JOIN hi a ON a.role = 'debit' AND a.inn = debit_inn LEFT JOIN hi b ON b.role = 'credit' AND b.inn = credit_inn),
 w AS (SELECT *, 0.5 * n / (n + 20.0) AS wh FROM l), f AS (SELECT *, CASE WHEN 1 - wh - g < 0.6 THEN 0.4 / (wh + g) ELSE 1 END AS shrink FROM w)
 SELECT txn_id, {R('h', 5)} AS history_risk, n AS history_txns, {R('wh * shrink', 5)} AS w_history, {R('g * shrink', 5)} AS w_graph, {R('greatest(least((1 - (wh + g) * shrink) * txr + g * shrink * coalesce(gn, txr) + wh * shrink * h, 1), 0)', 4)} AS overall_risk FROM f""", history_risk=5, w_history=5, w_graph=5, overall_risk=4)(
    lambda s, d: fusion.overall(fused(s, d).drop("history_risk", "history_txns", "w_history", "w_graph", "w_base", "overall_risk", "risk_level"), stats(s, d), config.Fusion(history_cap=0.5, history_hyper=20.0)).select("txn_id", "history_risk", F.col("history_txns").cast("long").alias("history_txns"), "w_history", "w_graph", "overall_risk")
)
query("txn_rank", f"WITH {FUSED}, q AS (SELECT txn_id, round(txr, 6) AS x FROM fu) SELECT txn_id, {R(RANKSQL.format(x='x'))} AS txn_risk_rank FROM q", txn_risk_rank=6)(
    lambda s, d: fusion.ranked(E.cut(fused(s, d).withColumn("txn_risk_score", F.round("txn_risk_score", 6)))).select("txn_id", "txn_risk_rank")
)
query("bottom_n", f"WITH {FUSED} SELECT txn_id, amount FROM fu ORDER BY round(txr, 6), txn_id LIMIT 20")(lambda s, d: E.bottom_n(fused(s, d, "amount").withColumn("txn_risk_score", F.round("txn_risk_score", 6)), "txn_risk_score", 20).select("txn_id", "amount"))

# graph

_LINKS = f"""{_GRAPH}, w AS MATERIALIZED (SELECT e.u, e.v, sum(CASE WHEN k > 1 THEN 1 / ln(k) END) AS aa, sum(1.0 / k) AS ra FROM e JOIN arc a ON a.u = e.u JOIN arc b ON b.u = e.v AND a.v = b.v JOIN deg ON deg.u = a.v GROUP BY 1, 2),
 sl AS MATERIALIZED (SELECT e.u, e.v, coalesce(both_n, 0)::DOUBLE AS f1, coalesce(both_n, 0) / (a.k + b.k - coalesce(both_n, 0)) AS f2, coalesce(aa, 0) AS f3, coalesce(ra, 0) AS f4, ln(1 + a.k * b.k) AS f5 FROM e JOIN deg a ON a.u = e.u JOIN deg b ON b.u = e.v LEFT JOIN cm ON cm.u = e.u AND cm.v = e.v LEFT JOIN w ON w.u = e.u AND w.v = e.v)"""
query("structural_links_z", f"WITH {_LINKS}, st AS (SELECT {', '.join(f'avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}' for i in range(1, 6))} FROM sl) SELECT u, v, {', '.join(f'{R(f"coalesce((f{i} - m{i}) / nullif(s{i}, 0), 0)", 4)} AS {n}' for i, n in enumerate(graph.LINK_FEATURES, 1))} FROM sl, st", **dict.fromkeys(graph.LINK_FEATURES, 4))(
    lambda s, d: graph.structural_links(prepared(s, d), standard=True)
)
_PAIRS = f"""{P}, gp AS (SELECT *, coalesce(date_diff('day', lag(date) OVER (PARTITION BY debit_inn, credit_inn ORDER BY date, txn_id), date), 9999) AS gap, ln(1 + abs(amount)) AS la FROM p),
 pa AS (SELECT debit_inn, credit_inn, avg(la) AS f1, max(la) AS f2, ln(1 + count(*)) AS f3, avg(CAST(amount % 10000 = 0 AS INT)) AS f4, avg(CAST(amount % 100000 = 0 AS INT)) AS f5, avg(length(purpose)) AS f6,
 avg(length(regexp_replace(purpose, '[^0-9]', '', 'g')) / (length(purpose) + 1e-6)) AS f7, avg(gap) AS f8 FROM gp GROUP BY 1, 2)"""
query("edge_features_z", f"WITH {_PAIRS}, ak AS (SELECT DISTINCT least(debit_inn, credit_inn) AS u, greatest(debit_inn, credit_inn) AS v FROM p WHERE debit_inn <> credit_inn), jo AS MATERIALIZED (SELECT u, v, {', '.join(f'coalesce(f{i}, 0) AS f{i}' for i in range(1, 9))} FROM ak LEFT JOIN pa ON u = debit_inn AND v = credit_inn), st AS (SELECT {', '.join(f'avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}' for i in range(1, 9))} FROM jo) SELECT u, v, "
      + ", ".join(R(f"coalesce((f{i} - m{i}) / nullif(s{i}, 0), 0)", 4) + f" AS {n}" for i, n in enumerate(graph.HISTORY, 1)) + " FROM jo, st", **dict.fromkeys(graph.HISTORY, 4))(
    lambda s, d: graph.edge_features(graph.edges(prepared(s, d)).select("u", "v"), based(s, d))
)


def _negatives(s: SparkSession, d: str) -> DataFrame:
    df = prepared(s, d)
    got = graph.negative_pairs(df).join(graph.edges(df).select("u", "v", F.lit(1).alias("linked")), ["u", "v"], "left")
    return got.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("u", "v").alias("distinct_pairs"), F.count("linked").alias("linked"), F.count_if(F.col("u") >= F.col("v")).alias("unordered"))


query("negative_pairs_check", f"WITH {P}, e AS (SELECT DISTINCT least(debit_inn, credit_inn) AS u, greatest(debit_inn, credit_inn) AS v FROM p WHERE debit_inn <> credit_inn) SELECT count(*) AS pairs, count(*) AS distinct_pairs, 0::BIGINT AS linked, 0::BIGINT AS unordered FROM e")(_negatives)
query("link_model_check", f"WITH {P}, e AS (SELECT DISTINCT least(debit_inn, credit_inn) AS u, greatest(debit_inn, credit_inn) AS v FROM p WHERE debit_inn <> credit_inn) SELECT count(*) AS pairs, 0::BIGINT AS outside FROM e")(
    lambda s, d: graph.link_model(prepared(s, d)).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~F.col("edge_risk").between(0, 1)).alias("outside"))
)
_TEMPORAL = f"""{P}, tr AS (SELECT debit_inn AS u, credit_inn AS v, date_diff('day', DATE '1970-01-01', date) AS day FROM p WHERE debit_inn <> credit_inn), qu AS (SELECT quantile_cont(day, 0.7) AS q1, quantile_cont(day, 0.85) AS q2 FROM tr),
 pt AS MATERIALIZED (SELECT u, v, CASE WHEN day <= q1 THEN 'train' WHEN day <= q2 THEN 'valid' ELSE 'test' END AS part FROM tr, qu),
 no AS MATERIALIZED (SELECT inn, row_number() OVER (ORDER BY inn) - 1 AS id FROM (SELECT u AS inn FROM pt UNION SELECT v FROM pt)), nn AS (SELECT count(*) AS n FROM no),
 po AS MATERIALIZED (SELECT DISTINCT part, u, v FROM pt WHERE part <> 'train'), dr AS (SELECT part, unnest(range(n)) AS i FROM (SELECT part, count(*) AS n FROM po GROUP BY 1)),
 di AS (SELECT part, {', '.join(f"CAST('0x' || substr(md5(part || '|' || i || '|{k}|42'), 1, 12) AS BIGINT) % n AS {k}" for k in 'uv')} FROM dr, nn),
 ne AS (SELECT DISTINCT part, a.inn AS u, b.inn AS v FROM di JOIN no a ON a.id = di.u JOIN no b ON b.id = di.v WHERE a.inn <> b.inn AND NOT EXISTS (SELECT 1 FROM pt WHERE pt.u = a.inn AND pt.v = b.inn)),
 aq AS MATERIALIZED (SELECT *, 1 AS label FROM po UNION ALL SELECT *, 0 FROM ne),
 te AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM pt WHERE part = 'train'), ta AS MATERIALIZED (SELECT u, v FROM te UNION ALL SELECT v, u FROM te), tg AS MATERIALIZED (SELECT u, count(*) AS k FROM ta GROUP BY 1),
 tc AS MATERIALIZED (SELECT aq.u, aq.v, count(*) AS common, sum(CASE WHEN k > 1 THEN 1 / ln(k) END) AS aa, sum(1.0 / k) AS ra FROM (SELECT DISTINCT u, v FROM aq) aq JOIN ta a ON a.u = aq.u JOIN ta b ON b.u = aq.v AND a.v = b.v JOIN tg ON tg.u = a.v GROUP BY 1, 2),
 tl AS MATERIALIZED (SELECT part, aq.u, aq.v, label, coalesce(common, 0) AS common, coalesce(coalesce(common, 0) / nullif(coalesce(x.k, 0) + coalesce(y.k, 0) - coalesce(common, 0), 0), 0) AS jaccard, coalesce(aa, 0) AS adamic_adar, coalesce(ra, 0) AS resource_allocation, ln(1 + coalesce(x.k, 0) * coalesce(y.k, 0)) AS preferential
  FROM aq LEFT JOIN tg x ON x.u = aq.u LEFT JOIN tg y ON y.u = aq.v LEFT JOIN tc ON tc.u = aq.u AND tc.v = aq.v)"""
query("temporal_links", f"WITH {_TEMPORAL} SELECT part, u, v, label, common, {', '.join(f'{R(n)} AS {n}' for n in graph.LINK_FEATURES[1:])} FROM tl", **dict.fromkeys(graph.LINK_FEATURES[1:], 6))(lambda s, d: links.temporal_links(prepared(s, d)))
query("link_quality", f"""WITH {_TEMPORAL}, sc AS (SELECT part, label, {R('preferential', 2)} AS s FROM tl), qc AS (SELECT part, s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sc GROUP BY 1, 2),
 cu AS (SELECT *, sum(p) OVER (PARTITION BY part ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY part ORDER BY s DESC) AS fp FROM qc)
 SELECT part, CAST(sum(p) AS BIGINT) AS links, CAST(sum(n) AS BIGINT) AS others, {R('sum(n * (tp - p / 2.0)) / (sum(p) * sum(n))')} AS roc_auc, {R('sum(p * tp / (tp + fp)) / sum(p)')} AS average_precision FROM cu GROUP BY part""", roc_auc=6, average_precision=6)(
    lambda s, d: _quality(E.cut(links.temporal_links(prepared(s, d)).withColumn("s", F.round(F.col("preferential") + F.lit(1e-7), 2))))
)


def _quality(scored: DataFrame) -> DataFrame:
    parts = [links.ranking_quality(scored.where(F.col("part") == p), "s").select(F.lit(p).alias("part"), "*") for p in ("valid", "test")]
    return parts[0].unionByName(parts[1])


def _network_quality(s: SparkSession, d: str) -> DataFrame:
    """The network on links after the second cut: as many as there are, and ranked better than by the best link feature alone and a bound."""
    df = based(s, d)
    alone = E.cut(links.temporal_links(df).where("part = 'test'"))
    best = max(links.ranking_quality(alone, n).first()["roc_auc"] for n in graph.LINK_FEATURES)
    good = F.col("roc_auc") > max(best, 0.8)
    return links.held_out_quality(df).select("links", "others", good.alias("better_than_one_feature"), (F.col("average_precision") > 0.8).alias("precise"))


query("graph_network", None)(lambda s, d: links.link_risk(based(s, d)))
query("graph_network_check", f"WITH {_TEMPORAL} SELECT count(*) FILTER (label = 1) AS links, count(*) FILTER (label = 0) AS others, true AS better_than_one_feature, true AS precise FROM tl WHERE part = 'test'")(_network_quality)
query("node_risk", f"SELECT inn, {R('avg(x)', 5)} AS node_risk FROM (SELECT u AS inn, graph_edge_score AS x FROM {sub('graph_edge_scores')} UNION ALL SELECT v, graph_edge_score FROM {sub('graph_edge_scores')}) GROUP BY 1", node_risk=5)(
    lambda s, d: graph.node_risk(graph.edge_scores(prepared(s, d)).select("u", "v", (F.round(F.col("graph_edge_score") + F.lit(1e-7), 6)).alias("edge_risk")))
)

# models without SQL of their own


def _projection(s: SparkSession, d: str) -> DataFrame:
    got = layers.pca_projection(based(s, d).withColumnsRenamed({"x_quantity": "q", "x_discount": "dc"}), ["amount", "q", "dc", "is_weekend"])
    tiny = lambda c: F.abs(c) < 1e-6
    return got.agg(F.count(F.lit(1)).alias("n"), (tiny(F.avg("pc_1")) & tiny(F.avg("pc_2"))).alias("centred"), tiny(F.covar_pop("pc_1", "pc_2")).alias("uncorrelated"), (F.var_pop("pc_1") >= F.var_pop("pc_2")).alias("ordered"), (F.var_pop("pc_1") >= 1).alias("above_mean"))


query("pca_projection_check", f"WITH {P} SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered, true AS above_mean FROM p")(_projection)


def _svd(s: SparkSession, d: str) -> DataFrame:
    got = layers.purpose_vectors(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("txn_id"), E.clean_text(F.col("p_type")).alias("purpose_clean")))
    length = F.aggregate(F.transform("vector", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return got.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).cast("long").alias("dims"), F.count_if(length > 1.001).alias("too_long"), (F.avg(length) > 0.5).alias("most_kept"))


query("svd_vectors_check", "SELECT count(*) AS n, least(50, count(DISTINCT p_type) - 1) AS dims, 0::BIGINT AS too_long, true AS most_kept FROM part")(_svd)


def _forest(s: SparkSession, d: str) -> DataFrame:
    df = based(s, d)
    scores = layers.individual(features.roles(features.daily(df))).join(df.select("txn_id", "debit_inn", "credit_inn"), "txn_id")
    sides = [scores.groupBy(F.col(f"{r}_inn").alias("inn")).agg(F.count(f"iforest_score_{r}").alias("n"), F.min(f"iforest_score_{r}").alias("least"), F.max(f"iforest_score_{r}").alias("most")).withColumn("side", F.lit(r)) for r in ("debit", "credit")]
    return sides[0].unionByName(sides[1]).select("side", "inn", "n", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"))


_SIDES = f"WITH {P}, s AS (SELECT 'debit' AS side, debit_inn AS inn FROM p UNION ALL SELECT 'credit', credit_inn FROM p), c AS (SELECT side, inn, count(*) AS k FROM s GROUP BY 1, 2)"
query("iforest_check", f"{_SIDES} SELECT side, inn, CASE WHEN k >= 10 THEN k ELSE 0 END AS n, CASE WHEN k >= 10 THEN 0.0::DOUBLE END AS least, CASE WHEN k >= 10 THEN 1.0::DOUBLE END AS most FROM c")(_forest)

# all base columns and logarithms of the global layer, rounded, so that ties are ties on both sides

_NAMES = [*layers.BASE_FEATURES, *layers.LOG_FEATURES]
_FAN = "fd AS (SELECT debit_inn, date, count(DISTINCT credit_inn) / count(*) AS fo FROM p GROUP BY 1, 2), fc AS (SELECT credit_inn, date, count(DISTINCT debit_inn) / count(*) AS fi FROM p GROUP BY 1, 2)"
_STEMMED = f"regexp_matches(trim(regexp_replace(regexp_replace(lower(purpose), '[^a-zа-я0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '(^| )({'|'.join(STEMS)})')"
_VALUES = ["amount"] + [f"{t}_{x}" if x in ("cnt30", "mean30", "std30") else x.replace("?", t) for t in "dc" for x in ("cnt30", "mean30", "std30", "?_sum7 / (?_sum30 / 4 + 1e-6)", "?_cnt7 / (?_cnt30 / 4 + 1e-6)", "?_std30 / (?_mean30 + 1e-6)")] + [
    "nd", "nc", "coalesce(amount / nullif(td, 0), 0)", "coalesce(amount / nullif(tc, 0), 0)", "gd", "gc", "fo", "fi", "(c_sum30 - d_sum30) / (c_sum30 + d_sum30 + 1e-6)", "(amount % 10000 = 0)::INT", "isodow(date) - 1", "(isodow(date) >= 6)::INT", "(date = last_day(date))::INT", f"({_STEMMED})::INT",
    "ln(1 + abs(amount))", "ln(1 + gd)", "ln(1 + gc)",
]
_ALL = f"""{_WIDE}, {_FAN}, fe AS MATERIALIZED (SELECT txn_id, {', '.join(f'round(CAST({v} AS DOUBLE), 3) AS v{i}' for i, v in enumerate(_VALUES))} FROM x JOIN fd USING (debit_inn, date) JOIN fc ON fc.credit_inn = x.credit_inn AND fc.date = x.date),
 lg AS (SELECT txn_id, unnest([{', '.join(f"{i}" for i in range(len(_VALUES)))}]) AS f, unnest([{', '.join(f'v{i}' for i in range(len(_VALUES)))}]) AS x0 FROM fe), sd AS MATERIALIZED (SELECT f, avg(x0) AS m, stddev_pop(x0) AS s, min(x0) AS lo, max(x0) AS hi, count(*) AS n, skewness(x0) AS sk FROM lg GROUP BY 1),
 qq AS MATERIALIZED (SELECT txn_id, f, x0, n, sk, CASE WHEN hi > lo THEN (hi - lo) / 10 / s ELSE 0.1 END AS step, CASE WHEN hi > lo THEN least(floor((x0 - lo) / ((hi - lo) / 10) + 1e-9), 9) ELSE 5 END AS bin FROM lg JOIN sd USING (f)),
 bi AS (SELECT f, bin, count(*) AS c FROM qq GROUP BY 1, 2), hb AS (SELECT txn_id, sum(-log2(c / (n * step) + 0.1)) AS raw_h FROM qq JOIN bi USING (f, bin) GROUP BY 1),
 vc AS (SELECT f, x0, count(*) AS c FROM lg GROUP BY 1, 2), tl AS MATERIALIZED (SELECT f, x0, -ln(sum(c) OVER (PARTITION BY f ORDER BY x0) / sum(c) OVER (PARTITION BY f)) AS le, -ln(sum(c) OVER (PARTITION BY f ORDER BY x0 DESC) / sum(c) OVER (PARTITION BY f)) AS ri FROM vc),
 cp AS (SELECT txn_id, sum(greatest(CASE WHEN sk < -1e-9 THEN le WHEN sk > 1e-9 THEN ri ELSE le + ri END, (le + ri) / 2)) AS raw_c FROM qq JOIN tl USING (f, x0) GROUP BY 1)"""


def _all_features(s: SparkSession, d: str) -> DataFrame:
    df = unpacked(features.derived(features.by_party(packed(based(s, d)), WINDOWS, fan=True)))
    return E.cut(layers.with_logs(df).select("txn_id", *(F.round(F.col(n).cast("double"), 3).alias(n) for n in _NAMES)))


query("hbos_all", f"WITH {_ALL} SELECT txn_id, {R('raw_h', 3)} AS hbos_raw FROM hb", hbos_raw=3)(lambda s, d: layers.hbos(layers.standardised(_all_features(s, d), _NAMES), len(_NAMES)))
query("copod_all", f"WITH {_ALL} SELECT txn_id, {R('raw_c', 3)} AS copod_raw FROM cp", copod_raw=3)(lambda s, d: layers.copod(layers.standardised(_all_features(s, d), _NAMES)))


def _global_80(s: SparkSession, d: str) -> DataFrame:
    wide = E.cut(features.derived(features.by_party(based(s, d), WINDOWS, fan=True)))
    return layers.global_scores(layers.with_vectors(wide, layers.purpose_vectors(wide))).select("txn_id", "hbos_score", "copod_score", "global_score", "global_rank")


query("global_score_80")(_global_80)

# store

query("kb_graph_p95", f"WITH {_STATS} SELECT role, inn, {R('quantile_cont(gn, 0.95)', 5)} AS graph_node_p95, {R('quantile_cont(ge, 0.95)', 5)} AS graph_edge_p95 FROM ag GROUP BY 1, 2", graph_node_p95=5, graph_edge_p95=5)(lambda s, d: stats(s, d).select("role", "inn", "graph_node_p95", "graph_edge_p95"))
query("kb_entity_view", f"""WITH {_STATS}, fl AS (SELECT inn, unnest([CASE WHEN hist >= 0.7 THEN role || ':high_history' END, CASE WHEN re / tx_count > 0.3 THEN role || ':many_red' END, CASE WHEN lo > 0.5 THEN role || ':loans' END, CASE WHEN tz > 0.4 THEN role || ':transit' END, CASE WHEN sh > 0.4 THEN role || ':semantic' END, CASE WHEN th > 0.4 THEN role || ':time_series' END, CASE WHEN gm > 0.7 THEN role || ':graph' END]) AS f FROM hi WHERE inn = '7'),
 rc AS (SELECT txn_id FROM fu WHERE debit_inn = '7' OR credit_inn = '7' ORDER BY round(txr, 9) DESC, date DESC, txn_id LIMIT 20)
 SELECT '7' AS inn, (SELECT count(*) FROM hi WHERE inn = '7') AS n_profiles, coalesce((SELECT string_agg(DISTINCT f, ',' ORDER BY f) FROM fl), '') AS flags, (SELECT {R('max(hist)', 5)} FROM hi WHERE inn = '7') AS max_history_risk, (SELECT string_agg(txn_id, ',' ORDER BY txn_id) FROM rc) AS recent""", max_history_risk=5)(
    lambda s, d: (lambda rows: kb.entity_view(rows.withColumn("txn_risk_score", F.round("txn_risk_score", 9)), kb.profiles(rows, config.LOAN_STEMS_EN), "7").select("inn", F.size("profiles").cast("long").alias("n_profiles"), F.array_join("flags", ",").alias("flags"), "max_history_risk", F.array_join(F.array_sort(F.transform("recent", lambda r: r["txn_id"])), ",").alias("recent")))(kb_rows(s, d))
)


def _stored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A store after two runs whose rows overlap; the second run has other amounts and moves rows of one payer to another."""
    store = kb.Store(s, folder(s), buckets=8)
    df = prepared(s, d).withColumn("overall_risk", F.col("x_quantity") / 100)
    second = df.where("x_quantity >= 30").withColumns({"amount": F.col("amount") + 1, "debit_inn": F.when(F.col("debit_inn") == "7", "8").otherwise(F.col("debit_inn"))})
    if store.exists() or store.read() is not None:
        raise AssertionError("a new store is not empty")
    for part in (df.where("x_quantity <= 40"), second):
        store.write(kb.project(part))
    got = store.read()
    assert got is not None
    return got


_TWICE = f"{P}, m AS (SELECT txn_id, date, CASE WHEN q >= 30 AND debit_inn = '7' THEN '8' ELSE debit_inn END AS debit_inn, credit_inn, CASE WHEN q >= 30 THEN amount + 1 ELSE amount END AS amount, q / 100 AS ov FROM p), sd AS (SELECT 'debit' AS role, debit_inn AS inn, * FROM m UNION ALL SELECT 'credit', credit_inn, * FROM m)"
query("kb_store", f"WITH {_TWICE} SELECT txn_id, debit_inn, amount FROM m")(lambda s, d: _stored(s, d)[0].select("txn_id", "debit_inn", "amount"))
query("kb_store_stats", f"WITH {_TWICE} SELECT role, inn, count(*) AS tx_count, {R('avg(amount)', 2)} AS amount_mean, {R('avg(ov)', 5)} AS risk_mean, {R('quantile_cont(ov, 0.95)', 5)} AS risk_p95 FROM sd GROUP BY 1, 2", amount_mean=2, risk_mean=5, risk_p95=5)(
    lambda s, d: _stored(s, d)[1].select("role", "inn", "tx_count", "amount_mean", "risk_mean", "risk_p95")
)

# review

_SAMPLE = f"{FUSED}, ch AS (SELECT txn_id FROM fu WHERE amount > 50000 ORDER BY md5('42/' || txn_id), txn_id LIMIT 20)"
query("seeded_sample", f"WITH {_SAMPLE} SELECT txn_id FROM ch")(lambda s, d: fused(s, d, "amount", of=review.chosen).select("txn_id"))
query("llm_echo", f"WITH {_SAMPLE} SELECT txn_id, 'yellow' AS llm_risk_level, 0.6::DOUBLE AS llm_risk, NULL::VARCHAR AS legal_characterization, 'echo' AS risk_explanation, NULL::VARCHAR AS recommendation, NULL::VARCHAR AS notes_for_audit, '[]' AS reasoning, '[]' AS legal_basis FROM ch")(
    lambda s, d: review.replies(fused(s, d, *review.PAYLOAD_COLUMNS, of=review.chosen))
)
query("llm_journal", ORACLE_SQL["llm_echo"])(lambda s, d: _journal(s, E.cut(fused(s, d, *review.PAYLOAD_COLUMNS, of=review.chosen))))


def _journal(s: SparkSession, rows: DataFrame) -> DataFrame:
    """Asked in two runs with one journal: the second only asks for what the first didn't have."""
    at = folder(s)
    review.journalled_replies(rows.limit(7), at)
    return review.journalled_replies(rows, at)


query("reply_join", f"WITH {_SAMPLE} SELECT fu.txn_id, amount, CASE WHEN ch.txn_id IS NOT NULL THEN 0.6 END::DOUBLE AS llm_risk FROM fu LEFT JOIN ch ON ch.txn_id = fu.txn_id")(
    lambda s, d: (lambda df: review.attach(df, review.replies(review.chosen(df))).select("txn_id", "amount", "llm_risk"))(E.cut(fused(s, d, *review.PAYLOAD_COLUMNS)))
)
query("review_summary", f"WITH {_SAMPLE} SELECT count(*) || ' transactions reviewed: yellow ' || count(*) AS said FROM ch")(lambda s, d: s.createDataFrame([(review.summary(review.replies(review.chosen(fused(s, d, *review.PAYLOAD_COLUMNS)))),)], "said string"))
query("llm_parse", "SELECT CAST(item_id AS VARCHAR) AS txn_id, CASE WHEN item_id % 5 = 2 THEN 0.9 WHEN item_id % 5 < 5 THEN 0.6 END::DOUBLE AS level FROM benchmark")(
    lambda s, d: s.read.parquet(f"{d}/benchmark.parquet").select(
        F.col("item_id").cast("string").alias("txn_id"),
        F.when(F.col("item_id") % 5 == 0, F.format_string('{"transactions": [{"txn_id": "%d", "risk_level": "Жёлтый "}]}', "item_id")).when(F.col("item_id") % 5 == 1, F.format_string('Answer: ```{"txn_id": "%d", "risk_level": "yellow"}``` end', "item_id"))
        .when(F.col("item_id") % 5 == 2, F.format_string('{"txn_id": "%d", "risk_level": "красный"}', "item_id")).when(F.col("item_id") % 5 == 3, F.format_string('[{"txn_id": "%d", "risk_level": "yellow"}]', "item_id")).otherwise(F.format_string('{"items": [{"txn_id": "%d", "risk_level": "yellow"}]}', "item_id")).alias("raw"),
    ).select("txn_id", E.level_value(F.get(review.parse_replies(F.col("raw")), F.lit(0))["risk_level"]).alias("level"))
)


@E.tidy
def _storefront(s: SparkSession, d: str) -> DataFrame:
    df = E.cut(fused(s, d, all_columns=True))  # blended once, for the profiles and for what is shown
    rows = kb_columns(kb.project(df))
    known = E.cut(kb.profiles(rows.drop("txn_id"), config.LOAN_STEMS_EN).select("role", "inn", "cp_review_flag"))  # looked up for each role
    flags = kb.review_flags(rows, known).select("txn_id", "review_debit", "review_credit", "review_any")
    return unpacked(review.storefront(packed(df), packed(flags))).select("txn_id", "amount", "base_behavior_risk", "overall_risk", "cp_review_flag_debit", "cp_review_flag_any")


query("storefront", f"WITH {_STATS} SELECT txn_id, amount, {R('beh', 5)} AS base_behavior_risk, {R('ov', 5)} AS overall_risk, coalesce(CAST(a.sr > 0.4 AS INT), 0) AS cp_review_flag_debit, greatest(coalesce(CAST(a.sr > 0.4 AS INT), 0), coalesce(CAST(b.sr > 0.4 AS INT), 0)) AS cp_review_flag_any FROM fu LEFT JOIN hi a ON a.role = 'debit' AND a.inn = fu.debit_inn LEFT JOIN hi b ON b.role = 'credit' AND b.inn = fu.credit_inn", base_behavior_risk=5, overall_risk=5)(
    _storefront
)
query("report_order", f"WITH {FUSED} SELECT txn_id, amount, {R('ov', 5)} AS overall_risk FROM fu", overall_risk=5)(lambda s, d: sinks.report(fused(s, d, "amount")).select("txn_id", "amount", "overall_risk"))
query("report_top", f"WITH {FUSED} SELECT txn_id, amount FROM fu ORDER BY round(ov, 5) DESC, amount DESC, txn_id LIMIT 100")(
    lambda s, d: sinks.report(fused(s, d, "amount").withColumn("overall_risk", F.round("overall_risk", 5))).limit(100).select("txn_id", "amount")
)


def _workbooks(s: SparkSession, d: str) -> DataFrame:
    at = folder(s)
    df = prepared(s, d).select("txn_id", "date", "debit_inn", "amount", "purpose")
    workbook.write_workbooks(df.repartition("txn_id"), at, 10_000)
    return workbook.read_workbook(s, at).withColumn("date", F.to_date("date").cast("string"))


query("excel_round_trip", f"WITH {P} SELECT txn_id, CAST(date AS VARCHAR) AS date, debit_inn, amount, purpose FROM p")(_workbooks)
