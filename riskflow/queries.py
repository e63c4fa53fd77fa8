"""The registered queries over the synthetic ledger and, where SQL can say the same, DuckDB SQL to hold them against.

Doubles are rounded on both sides, counts are longs, ties are broken by the transaction id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow import config
from riskflow.functions import exprs as E
from riskflow.operators import features, fusion, graph, kb, layers, review
from riskflow.sources import ledger, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
STEMS = config.RISK_STEMS_EN
WINDOWS = (7, 14, 30, 90)


def query(name: str, sql: str | None = None, **digits: int):
    """Register a query; ``digits`` rounds its columns."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c) + F.lit(1e-7), n) + F.lit(0.0) for c, n in digits.items()}) if digits else out

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.synthetic_ledger(spark, sf_dir)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.prepare(raw(spark, sf_dir))


def rounded_amounts(df: DataFrame) -> DataFrame:
    """The ledger with amounts rounded down to 5000, so that some are round."""
    return df.withColumn("amount", F.floor(F.col("amount") / 5000).cast("double") * 5000)


def based(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.base(prepared(spark, sf_dir), STEMS)


def packed(df: DataFrame) -> DataFrame:
    """``df`` with its ids (hexadecimal digests) as bytes, which sort alike and are half as long in each shuffle."""
    return df.withColumn("txn_id", F.unhex("txn_id"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.withColumn("txn_id", F.lower(F.hex("txn_id")))


def stubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared ledger with stand-ins for layer scores made from other columns."""
    c = F.col
    return based(spark, sf_dir).withColumns({
        "hbos_score": c("x_discount") / 10.0, "copod_score": c("x_tax") / 8.0,
        "iforest_score_debit": F.when(c("x_quantity") % 5 != 0, c("x_quantity") % 10 / 10.0), "iforest_score_credit": F.when(c("x_quantity") % 3 != 0, c("x_quantity") % 7 / 7.0),
        "semantic_risk_score": c("x_part") % 11 / 10.0, "ts_anomaly_score_txn": c("x_line") % 8 / 7.0,
        "graph_edge_score": F.when(c("x_part") % 5 != 0, c("x_part") % 13 / 12.0), "graph_node_score": F.when(c("x_part") % 4 != 0, c("x_part") % 17 / 16.0),
        "in_out_ratio_30d": (c("x_quantity") - 25) / 25.0, "debit_fan_out_ratio": c("x_discount") / 10.0, "credit_fan_in_ratio": c("x_tax") / 8.0,
    })


# what the blend works on
BLENDED = ("txn_id", "debit_inn", "credit_inn", "hbos_score", "copod_score", "iforest_score_debit", "iforest_score_credit", "semantic_risk_score", "ts_anomaly_score_txn", "graph_edge_score", "graph_node_score")


def fused(spark: SparkSession, sf_dir: str, *columns: str, all_columns: bool = False, of: Callable[[DataFrame], DataFrame] | None = None, **made: Column) -> DataFrame:
    """The blended ledger (``of``: these of its rows) with ``columns`` and those ``made`` besides; the blend is computed once, and what isn't named isn't carried."""
    df = stubbed(spark, sf_dir).withColumns(made).drop("x_quantity", "x_discount", "x_tax", "x_line")
    df = df if all_columns else df.select(*BLENDED, *(c for c in (*columns, *made) if c in df.columns and c not in BLENDED))
    return unpacked(fusion.fuse(packed(df), of=of and (lambda base: packed(of(unpacked(base))))))


def kb_rows(spark: SparkSession, sf_dir: str, ids: bool = True, keep: bool = True) -> DataFrame:
    """The columns of the store that profiles and views look at, computed once (``keep``) for those that read them several times; profiles alone need no ``ids``."""
    df = kb.project(fused(spark, sf_dir, "date", "amount", "purpose_clean", "purpose_stopword_high", "in_out_ratio_30d", "debit_fan_out_ratio", "credit_fan_in_ratio"))
    df = kb_columns(df, ids)
    return E.cut(df) if keep else df


def kb_columns(df: DataFrame, ids: bool = True) -> DataFrame:
    return df.select(*dict.fromkeys((*(c for c in kb.SIDE if c in df.columns and (ids or c != "txn_id")), "debit_inn", "credit_inn", "debit_fan_out_ratio", "credit_fan_in_ratio")))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.profiles(kb_rows(spark, sf_dir, ids=False), config.LOAN_STEMS_EN)


# SQL parts


def R(x: str, n: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE) + 1e-7, {n}) + 0.0)"  # the small term settles ties


def CLIP(x: str) -> str:
    return f"greatest(least({x}, 1.0), 0.0)"


RAW = """raw AS (SELECT sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))) AS txn_id,
 CAST(l_shipdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS debit_inn, CAST(l_suppkey AS VARCHAR) AS credit_inn,
 CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 100 END AS d, CASE WHEN l_returnflag = 'R' THEN CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 100 END AS c,
 concat_ws(' ', p_name, p_type, o_orderpriority) AS purpose, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS dc, CAST(round(l_tax * 100) AS BIGINT) AS tx, l_partkey AS pk, CAST(l_linenumber AS BIGINT) AS ln
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
P = RAW + ", p AS (SELECT *, coalesce(d, 0.0) AS debit_amount, coalesce(c, 0.0) AS credit_amount, coalesce(d, c, 0.0) AS amount FROM raw)"
CLEAN = "trim(regexp_replace(regexp_replace(lower(coalesce(purpose, 'nan')), '[^a-zа-я0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
STEM = f"regexp_matches({CLEAN}, '(^| )({'|'.join(STEMS)})')"
DAILY = P + """, dl AS (SELECT *, sum(amount) OVER (PARTITION BY debit_inn, date) AS td, sum(amount) OVER (PARTITION BY credit_inn, date) AS tc,
 count(*) FILTER (amount > 0) OVER (PARTITION BY debit_inn, date) AS nd, count(*) FILTER (amount > 0) OVER (PARTITION BY credit_inn, date) AS nc,
 coalesce(date_diff('day', lag(date) OVER (PARTITION BY debit_inn ORDER BY date, txn_id), date), 9999) AS gd, coalesce(date_diff('day', lag(date) OVER (PARTITION BY credit_inn ORDER BY date, txn_id), date), 9999) AS gc FROM p)"""


def roll_cte(role: str, windows: tuple[int, ...], tag: str, p95: bool = True) -> str:
    """Dense calendar of each party and windows over it."""
    frame = lambda w: f"OVER (PARTITION BY inn ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    cols = ", ".join(
        f"sum(amt) {frame(w)} AS sum{w}, count(*) FILTER (amt > 0) {frame(w)} AS cnt{w}, avg(amt) {frame(w)} AS mean{w}, coalesce(stddev_samp(amt) {frame(w)}, 0) AS std{w}" + (f", quantile_cont(amt, 0.95) {frame(w)} AS p95{w}" if p95 or w == 90 else "")
        for w in windows
    )
    return f""", a_{tag} AS (SELECT {role}_inn AS inn, date, sum({role}_amount) AS amt FROM p GROUP BY 1, 2),
 s_{tag} AS (SELECT inn, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM a_{tag} GROUP BY inn),
 f_{tag} AS (SELECT s.inn, s.date, coalesce(a.amt, 0) AS amt, a.amt IS NOT NULL AS act FROM s_{tag} s LEFT JOIN a_{tag} a ON s.inn = a.inn AND s.date = a.date),
 w_{tag} AS (SELECT * FROM (SELECT inn, date, act, {cols} FROM f_{tag}) WHERE act)"""


BOTH_ROLLS = roll_cte("debit", (7, 14, 30, 90), "d", False) + roll_cte("credit", (7, 14, 30, 90), "c", False)
STUB = P + f""", st AS (SELECT *, dc / 10.0 AS hb, tx / 8.0 AS cp, CASE WHEN q % 5 <> 0 THEN q % 10 / 10.0 END AS fd, CASE WHEN q % 3 <> 0 THEN q % 7 / 7.0 END AS fc, pk % 11 / 10.0 AS sem, ln % 8 / 7.0 AS ts,
 CASE WHEN pk % 5 <> 0 THEN pk % 13 / 12.0 END AS ge, CASE WHEN pk % 4 <> 0 THEN pk % 17 / 16.0 END AS gn, (q - 25) / 25.0 AS io, {CLEAN} AS clean, {STEM} AS kw FROM p)"""
FUSED = STUB + f""", g AS (SELECT *, {CLIP('(hb + cp) / 2')} AS gl, count(*) OVER (PARTITION BY debit_inn) AS n_d, count(*) OVER (PARTITION BY credit_inn) AS n_c FROM st),
 tp AS (SELECT greatest(max(n_d), 10) AS md, greatest(max(n_c), 10) AS mc, max(sem) AS ms, max(ts) AS mt, max(coalesce(greatest(ge, gn), 0)) AS mg FROM g),
 al AS (SELECT *, CASE WHEN fd IS NULL THEN 0 ELSE greatest(least(0.35 + 0.5 * ln(1 + n_d) / ln(1 + md), 0.85), 0.35) END AS ad, CASE WHEN fc IS NULL THEN 0 ELSE greatest(least(0.35 + 0.5 * ln(1 + n_c) / ln(1 + mc), 0.85), 0.35) END AS ac FROM (SELECT * EXCLUDE (ln), ln AS line FROM g), tp),
 br AS (SELECT *, {CLIP('coalesce(greatest(ad * fd + (1 - ad) * gl, ac * fc + (1 - ac) * gl), gl)')} AS beh, {CLIP('(0.5 * (ms > 0)::INT * sem + 0.3 * (mt > 0)::INT * ts + 0.2 * (mg > 0)::INT * coalesce(greatest(ge, gn), 0)) / nullif(0.5 * (ms > 0)::INT + 0.3 * (mt > 0)::INT + 0.2 * (mg > 0)::INT, 0)')} AS cor FROM al),
 tr AS (SELECT *, {CLIP('beh + 0.5 * cor')} AS txr, CASE WHEN gn IS NULL THEN 0 ELSE 0.25 END AS wg FROM br),
 fu AS (SELECT *, {CLIP('(1 - wg) * txr + wg * coalesce(gn, txr)')} AS ov FROM tr)"""
KB = FUSED + """, sd AS (SELECT 'debit' AS role, debit_inn AS inn, credit_inn AS partner, dc / 10.0 AS fan, * FROM fu UNION ALL SELECT 'credit', credit_inn, debit_inn, tx / 8.0, * FROM fu),
 ag AS (SELECT *, max(date) OVER (PARTITION BY role, inn) AS last_day FROM sd)"""
RANKSQL = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count(*) OVER ()"

# preparation and scalars

query("prepare_base", f"WITH {P} SELECT txn_id, date, debit_inn, credit_inn, debit_amount, credit_amount, amount FROM p")(
    lambda s, d: prepared(s, d).select("txn_id", "date", "debit_inn", "credit_inn", "debit_amount", "credit_amount", "amount")
)
_PYNUM = "CASE WHEN regexp_replace(CAST(CAST({x} AS DECIMAL(24,6)) AS VARCHAR), '0+$', '') LIKE '%.' THEN regexp_replace(CAST(CAST({x} AS DECIMAL(24,6)) AS VARCHAR), '0+$', '') || '0' ELSE regexp_replace(CAST(CAST({x} AS DECIMAL(24,6)) AS VARCHAR), '0+$', '') END"
query("txn_id_hash", f"WITH {P} SELECT txn_id AS key, sha256(concat_ws('||', CAST(date AS VARCHAR) || ' 00:00:00', {_PYNUM.format(x='debit_amount')}, {_PYNUM.format(x='credit_amount')}, {_PYNUM.format(x='amount')}, purpose)) AS txn_id FROM p")(
    lambda s, d: ledger.prepare(raw(s, d).withColumnRenamed("txn_id", "key")).select("key", "txn_id")
)
query("calendar_features", f"""WITH {P} SELECT txn_id, CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, CAST(isodow(date) >= 6 AS BIGINT) AS is_weekend, CAST(date = last_day(date) AS BIGINT) AS is_month_end,
 CAST(date = last_day(date) AND month(date) % 3 = 0 AS BIGINT) AS is_quarter_end, CAST(date = last_day(date) AND month(date) = 12 AS BIGINT) AS is_year_end, CAST(month(date) AS BIGINT) AS month, CAST(week(date) AS BIGINT) AS week_of_year FROM p""")(
    lambda s, d: based(s, d).select("txn_id", *(F.col(c).cast("long").alias(c) for c in ("day_of_week", "is_weekend", "is_month_end", "is_quarter_end", "is_year_end", "month", "week_of_year")))
)
query("round_flags", f"WITH {P}, r AS (SELECT txn_id, floor(amount / 5000) * 5000 AS a FROM p) SELECT txn_id, CAST(a % 10000 = 0 AS BIGINT) AS is_round_10k, CAST(a % 100000 = 0 AS BIGINT) AS is_round_100k, CAST(a % 10000 = 0 AS BIGINT) AS is_round_amount, {R('ln(1 + greatest(a, 1))')} AS log_amount FROM r", log_amount=6)(
    lambda s, d: features.base(rounded_amounts(prepared(s, d))).select("txn_id", *(F.col(c).cast("long").alias(c) for c in ("is_round_10k", "is_round_100k", "is_round_amount")), "log_amount")
)
query("text_stats", "SELECT doc_id, length(t) AS purpose_len, " + R("length(regexp_replace(t, '[^0-9]', '', 'g')) / (length(t) + 1e-6)") + " AS digits, " + R("length(regexp_replace(t, '[^A-ZА-Я]', '', 'g')) / (length(t) + 1e-6)") + " AS upper FROM (SELECT doc_id, coalesce(text, 'nan') AS t FROM documents)", digits=6, upper=6)(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("nan")).alias("t")).select(
        "doc_id", F.length("t").cast("long").alias("purpose_len"), E.ratio(F.regexp_count("t", F.lit("[0-9]")).cast("double"), F.length("t")).alias("digits"), E.ratio(F.regexp_count("t", F.lit("[A-ZА-Я]")).cast("double"), F.length("t")).alias("upper"))
)
query("text_clean", f"SELECT doc_id, md5({CLEAN.replace('purpose', 'text')}) AS cleaned FROM documents")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(E.clean_text(F.col("text"))).alias("cleaned"))
)
query("keyword_flag", f"WITH {P} SELECT txn_id, {STEM} AS purpose_stopword_high FROM p")(lambda s, d: based(s, d).select("txn_id", "purpose_stopword_high"))

# windows

query("daily_aggregates", f"WITH {DAILY} SELECT txn_id, {R('td', 2)} AS daily_total_debit, {R('tc', 2)} AS daily_total_credit, nd AS daily_debit_transaction_count, nc AS daily_credit_transaction_count FROM dl", daily_total_debit=2, daily_total_credit=2)(
    lambda s, d: features.daily(prepared(s, d)).select("txn_id", "daily_total_debit", "daily_total_credit", "daily_debit_transaction_count", "daily_credit_transaction_count")
)
query("daily_share", f"WITH {DAILY} SELECT txn_id, {R('coalesce(amount / nullif(td, 0), 0)')} AS daily_debit_percent, {R('coalesce(amount / nullif(tc, 0), 0)')} AS daily_credit_percent FROM dl", daily_debit_percent=6, daily_credit_percent=6)(
    lambda s, d: features.daily(prepared(s, d)).select("txn_id", "daily_debit_percent", "daily_credit_percent")
)
query("intervals", f"WITH {DAILY} SELECT txn_id, gd AS days_since_last_txn_debit, gc AS days_since_last_txn_credit FROM dl")(
    lambda s, d: features.daily(prepared(s, d)).select("txn_id", F.col("days_since_last_txn_debit").cast("long").alias("days_since_last_txn_debit"), F.col("days_since_last_txn_credit").cast("long").alias("days_since_last_txn_credit"))
)


def _rolling(role: str, w: int) -> None:
    sql = f"WITH {P} {roll_cte(role, (w,), 'x')} SELECT inn, date, {R(f'sum{w}', 2)} AS total, cnt{w} AS cnt, {R(f'mean{w}', 2)} AS mean, {R(f'std{w}', 2)} AS std, {R(f'p95{w}', 2)} AS p95 FROM w_x"
    names = {f"{role}_roll_{a}_{w}d": b for a, b in (("sum", "total"), ("cnt", "cnt"), ("mean", "mean"), ("std", "std"), ("p95", "p95"))}
    query(f"rolling_{w}_{role}", sql, total=2, mean=2, std=2, p95=2)(lambda s, d: features.rolling(prepared(s, d), role, (w,)).withColumnsRenamed(names).select("inn", "date", *names.values()))


for _role in ("debit", "credit"):
    for _w in WINDOWS:
        _rolling(_role, _w)

_SPIKES = [f"{r}_{n}" for r in ("debit", "credit") for n in ("amount_spike_ratio_7d", "tx_rate_spike_7d", "accel_ratio_7d", "to_p95_ratio")]
_WIDE = f"{DAILY} {BOTH_ROLLS}, x AS (SELECT dl.*, {', '.join(f'w_{t}.{n} AS {t}_{n}' for t in 'dc' for n in ('sum7', 'sum14', 'sum30', 'cnt7', 'cnt30', 'mean30', 'std30', 'p9590'))} FROM dl JOIN w_d ON dl.debit_inn = w_d.inn AND dl.date = w_d.date JOIN w_c ON dl.credit_inn = w_c.inn AND dl.date = w_c.date)"
query(
    "spikes_accel",
    f"WITH {_WIDE} SELECT txn_id, " + ", ".join(
        f"{R(f'{t}_sum7 / ({t}_sum30 / 4 + 1e-6)', 5)} AS {r}_amount_spike_ratio_7d, {R(f'{t}_cnt7 / ({t}_cnt30 / 4 + 1e-6)', 5)} AS {r}_tx_rate_spike_7d, {R(f'greatest(least(({t}_sum7 - {t}_sum14) / ({t}_sum14 + 1e-6), 10), -10)', 5)} AS {r}_accel_ratio_7d, {R(f'least({t}_sum7 / ({t}_p9590 + 1e-6), 1e6)', 3)} AS {r}_to_p95_ratio"
        for t, r in (("d", "debit"), ("c", "credit"))) + " FROM x",
    **{c: 3 if "p95" in c else 5 for c in _SPIKES},
)(lambda s, d: unpacked(features.derived(features.by_party(packed(prepared(s, d)), WINDOWS))).select("txn_id", *(F.least(F.col(c), F.lit(1e6)).alias(c) if "p95" in c else c for c in _SPIKES)))
query("transit_netflow", f"WITH {_WIDE} SELECT txn_id, CAST(gc = 0 AND tc > 0 AND td > 0 AS BIGINT) AS transit_same_day_flag, {R('greatest(least((c_sum7 - d_sum7) / (c_sum7 + d_sum7 + 1e-6), 1), -1)')} AS net_flow_ratio_7d, {R('(c_sum30 - d_sum30) / (c_sum30 + d_sum30 + 1e-6)')} AS in_out_ratio_30d FROM x", net_flow_ratio_7d=6, in_out_ratio_30d=6)(
    lambda s, d: unpacked(features.derived(features.by_party(packed(prepared(s, d)), WINDOWS))).select("txn_id", F.col("transit_same_day_flag").cast("long").alias("transit_same_day_flag"), "net_flow_ratio_7d", "in_out_ratio_30d")
)
query("novelty", f"WITH {P}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY debit_inn, credit_inn ORDER BY date, txn_id) = 1 AS INT) AS new FROM p) SELECT txn_id, {R('avg(new) OVER (PARTITION BY debit_inn ORDER BY date, txn_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)')} AS ratio FROM n", ratio=6)(
    lambda s, d: features.novelty(prepared(s, d)).select("txn_id", F.col("debit_new_counterparty_ratio").alias("ratio"))
)
query("fan_ratios", f"""WITH {P}, a AS (SELECT debit_inn, date, count(DISTINCT credit_inn) AS k, count(*) AS n FROM p GROUP BY 1, 2), b AS (SELECT credit_inn, date, count(DISTINCT debit_inn) AS k, count(*) AS n FROM p GROUP BY 1, 2)
 SELECT txn_id, a.k AS unique_recipients_per_day, b.k AS unique_receivers_per_day, {R('a.k / a.n')} AS debit_fan_out_ratio, {R('b.k / b.n')} AS credit_fan_in_ratio FROM p JOIN a USING (debit_inn, date) JOIN b ON p.credit_inn = b.credit_inn AND p.date = b.date""", debit_fan_out_ratio=6, credit_fan_in_ratio=6)(
    lambda s, d: features.fans(prepared(s, d)).select("txn_id", "unique_recipients_per_day", "unique_receivers_per_day", "debit_fan_out_ratio", "credit_fan_in_ratio")
)
query("pct_rank", f"WITH {P} SELECT txn_id, {R(RANKSQL.format(x='q'))} AS overall_rank, {R('(rank() OVER (PARTITION BY debit_inn ORDER BY q) + (count(*) OVER (PARTITION BY debit_inn, q) - 1) / 2.0) / count(*) OVER (PARTITION BY debit_inn)')} AS party_rank FROM p", overall_rank=6, party_rank=6)(
    lambda s, d: E.rank_within(E.rank_all(prepared(s, d), "x_quantity", "overall_rank"), "x_quantity", ["debit_inn"], "party_rank").select("txn_id", "overall_rank", "party_rank")
)
query("minmax_scaling", f"""WITH {P}, w AS (SELECT txn_id, amount AS a, min(amount) OVER (PARTITION BY debit_inn) AS lo, max(amount) OVER (PARTITION BY debit_inn) AS hi, (SELECT min(amount) FROM p) AS l, (SELECT max(amount) FROM p) AS h FROM p)
 SELECT txn_id, {R('(a - lo) / (hi - lo + 1e-9)')} AS a, {R('CASE WHEN h - l <= 1e-9 THEN 0.5 ELSE (a - l) / (h - l) END')} AS b, {R('CASE WHEN h - l <= 1e-6 THEN 0.5 ELSE (a - l) / (h - l + 1e-6) END')} AS c, {R('CASE WHEN hi = lo THEN 0 ELSE (a - lo) / (hi - lo) END')} AS d FROM w""", a=6, b=6, c=6, d=6)(
    lambda s, d: E.minmax_all(E.minmax_all(prepared(s, d), "amount", "b", "b"), "amount", "c", "c").transform(lambda f: E.minmax_within(E.minmax_within(f, "amount", "a", ["debit_inn"], "a"), "amount", "d", ["debit_inn"], "d")).select("txn_id", "a", "b", "c", "d")
)
query("robust_z", f"WITH {P}, m AS (SELECT *, abs(amount - median(amount) OVER (PARTITION BY debit_inn)) AS dev FROM p) SELECT txn_id, {R('dev / ((median(dev) OVER (PARTITION BY debit_inn) + 1e-6) * 1.4826)', 4)} AS z, {R('coalesce((amount - avg(amount) OVER (PARTITION BY debit_inn)) / nullif(stddev_pop(amount) OVER (PARTITION BY debit_inn), 0), 0)')} AS zscore FROM m", z=4, zscore=6)(
    lambda s, d: E.robust_z(prepared(s, d), ["amount"], ["debit_inn"]).withColumn("zscore", E.zscore_by("amount", ["debit_inn"])).select("txn_id", F.col("amount_z").alias("z"), "zscore")
)

# aggregations


def _profile(role: str, other: str) -> None:
    a, p = f"{role}_amount", f"{role}_inn_"
    query(
        f"entity_profile_{role}",
        f"WITH {P} SELECT {role}_inn AS inn, {R(f'sum({a})', 2)} AS {p}total_amount, {R(f'avg({a})', 2)} AS {p}mean_amount, {R(f'coalesce(stddev_samp({a}), 0)', 2)} AS {p}std_amount, {R(f'quantile_cont({a}, 0.5)', 2)} AS {p}median_amount, count(DISTINCT {other}_inn) AS {p}partners, count(*) FILTER ({a} > 0) AS {p}txn_count, count(DISTINCT date) AS {p}active_days FROM p GROUP BY 1",
        **{f"{p}{n}_amount": 2 for n in ("total", "mean", "std", "median")},
    )(lambda s, d: features.profile(prepared(s, d), role))


_profile("debit", "credit")
_profile("credit", "debit")
query("role_view", f"WITH {DAILY} SELECT txn_id, date, debit_inn AS inn, 'debit' AS side, debit_amount AS amount, {R('td', 2)} AS daily_total, nd AS daily_txn_cnt, gd AS days_since_last FROM dl UNION ALL SELECT txn_id, date, credit_inn, 'credit', credit_amount, {R('tc', 2)}, nc, gc FROM dl", daily_total=2)(
    lambda s, d: unpacked(features.roles(features.daily(packed(based(s, d))))).select("txn_id", "date", "inn", "side", "amount", "daily_total", "daily_txn_cnt", F.col("days_since_last").cast("long").alias("days_since_last"))
)
query("eligibility", f"WITH {P}, a AS (SELECT debit_inn AS inn, count(*) AS n FROM p GROUP BY 1), b AS (SELECT credit_inn AS inn, count(*) AS n FROM p GROUP BY 1), c AS (SELECT coalesce(a.inn, b.inn) AS inn, coalesce(a.n, 0) AS n_debit, coalesce(b.n, 0) AS n_credit FROM a FULL JOIN b ON a.inn = b.inn) SELECT *, n_debit + n_credit AS n_total, CAST(n_debit + n_credit >= 10 AND n_debit >= 10 AS INT) AS eligible_debit, CAST(n_debit + n_credit >= 10 AND n_credit >= 10 AS INT) AS eligible_credit FROM c")(
    lambda s, d: fusion.eligibility(prepared(s, d))
)
query("pair_aggregates", f"""WITH {P}, g AS (SELECT *, coalesce(date_diff('day', lag(date) OVER (PARTITION BY debit_inn, credit_inn ORDER BY date, txn_id), date), 9999) AS gap, ln(1 + greatest(amount, 1)) AS la FROM p)
 SELECT debit_inn, credit_inn, {R('avg(la)')} AS mean_log, {R('max(la)')} AS max_log, count(*) AS freq, {R('avg(CAST(amount % 10000 = 0 AS INT))')} AS round_share, {R('avg(length(purpose))', 4)} AS mean_len, {R('avg(gap)', 4)} AS mean_gap FROM g GROUP BY 1, 2""", mean_log=6, max_log=6, round_share=6, mean_len=4, mean_gap=4)(
    lambda s, d: graph.pair_aggregates(based(s, d))
)
query("node_features", f"""WITH {P}, a AS (SELECT debit_inn AS inn, quantile_cont(amount, 0.5) AS m, avg(amount) AS v FROM p GROUP BY 1), b AS (SELECT credit_inn AS inn, quantile_cont(amount, 0.5) AS m, avg(amount) AS v FROM p GROUP BY 1)
 SELECT coalesce(a.inn, b.inn) AS inn, {R('coalesce(a.m, 0)', 2)} AS debit_amount_median, {R('coalesce(a.v, 0)', 2)} AS debit_amount_mean, {R('coalesce(b.m, 0)', 2)} AS credit_amount_median, {R('coalesce(b.v, 0)', 2)} AS credit_amount_mean FROM a FULL JOIN b ON a.inn = b.inn""", debit_amount_median=2, debit_amount_mean=2, credit_amount_median=2, credit_amount_mean=2)(
    lambda s, d: graph.node_features(prepared(s, d), ["amount"])
)
query("temporal_split", f"WITH {P}, e AS (SELECT txn_id, date_diff('day', DATE '1970-01-01', date) AS k FROM p), q AS (SELECT quantile_cont(k, 0.7) AS a, quantile_cont(k, 0.85) AS b FROM e) SELECT txn_id, CASE WHEN k <= a THEN 'train' WHEN k <= b THEN 'valid' ELSE 'test' END AS part FROM e, q")(
    lambda s, d: graph.temporal_split(prepared(s, d)).select("txn_id", "part")
)
query("distribution_summary", f"WITH {P} SELECT {', '.join(f'{R(f'quantile_cont(amount, {q / 100})', 2)} AS p{q}' for q in (50, 90, 95, 99))}, count(*) AS n, {R('avg(amount)', 2)} AS mean FROM p", p50=2, p90=2, p95=2, p99=2, mean=2)(
    lambda s, d: (lambda df: E.percentiles(df, "amount", [0.5, 0.9, 0.95, 0.99]).withColumnsRenamed({f"p_{i}": f"p{q}" for i, q in enumerate((50, 90, 95, 99))}).crossJoin(df.agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean"))))(prepared(s, d))
)
query("duplicate_pairs", f"WITH {P} SELECT debit_inn, credit_inn, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: prepared(s, d).groupBy("debit_inn", "credit_inn").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))

# graph

_GRAPH = P + """, e AS (SELECT least(debit_inn, credit_inn) AS u, greatest(debit_inn, credit_inn) AS v, count(*) AS n, sum(amount) AS total FROM p WHERE debit_inn <> credit_inn GROUP BY 1, 2), arc AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
 deg AS (SELECT u, count(*) AS k FROM arc GROUP BY 1), lp AS (SELECT DISTINCT debit_inn AS x FROM p WHERE debit_inn = credit_inn), cm AS (SELECT a.u AS u, b.u AS v, count(*) AS both_n FROM arc a JOIN arc b ON a.v = b.v AND a.u < b.u JOIN e ON e.u = a.u AND e.v = b.u GROUP BY 1, 2)"""
query("graph_edge_scores", f"""WITH {_GRAPH}, j AS (SELECT e.u, e.v, e.n, e.total, coalesce(both_n, 0) AS i, a.k - 1 + (e.u IN (SELECT x FROM lp))::INT + b.k - 1 + (e.v IN (SELECT x FROM lp))::INT - coalesce(both_n, 0) AS un FROM e JOIN deg a ON a.u = e.u JOIN deg b ON b.u = e.v LEFT JOIN cm ON cm.u = e.u AND cm.v = e.v),
 r AS (SELECT *, i / (un + 1e-6) AS jac, 0.6 * (1 - i / (un + 1e-6)) + 0.4 / (n + 1) AS raw_score FROM j), m AS (SELECT min(raw_score) AS lo, max(raw_score) AS hi FROM r)
 SELECT u, v, n AS txn_count, {R('total', 2)} AS total_amount, {R('jac')} AS jaccard, {R('1.0 / (n + 1)')} AS rarity, {R('raw_score')} AS raw_score, {R('CASE WHEN hi - lo <= 1e-6 THEN 0.5 ELSE (raw_score - lo) / (hi - lo + 1e-6) END')} AS graph_edge_score FROM r, m""", total_amount=2, jaccard=6, rarity=6, raw_score=6, graph_edge_score=6)(
    lambda s, d: graph.edge_scores(prepared(s, d))
)
query("graph_node_scores", f"""WITH {_GRAPH}, t AS (SELECT u AS x, both_n FROM cm UNION ALL SELECT v, both_n FROM cm), l AS (SELECT x, sum(both_n) AS links FROM t GROUP BY 1), nd AS (SELECT u AS x FROM deg UNION SELECT x FROM lp),
 r AS (SELECT nd.x AS inn, coalesce(k, 0) + 2 * (nd.x IN (SELECT x FROM lp))::INT AS degree, CASE WHEN k > 1 THEN coalesce(links, 0) / (k * (k - 1)) ELSE 0 END AS c FROM nd LEFT JOIN deg ON deg.u = nd.x LEFT JOIN l ON l.x = nd.x),
 s AS (SELECT *, 0.5 * (1 - c) + 0.5 / (degree + 1) AS raw_score FROM r), m AS (SELECT min(raw_score) AS lo, max(raw_score) AS hi FROM s)
 SELECT inn, CAST(degree AS BIGINT) AS degree, {R('c')} AS clustering, {R('raw_score')} AS raw_score, {R('CASE WHEN hi - lo <= 1e-6 THEN 0.5 ELSE (raw_score - lo) / (hi - lo + 1e-6) END')} AS graph_node_score FROM s, m""", clustering=6, raw_score=6, graph_node_score=6)(
    lambda s, d: graph.node_scores(prepared(s, d))
)
query("structural_links", f"""WITH {_GRAPH}, w AS (SELECT e.u, e.v, sum(CASE WHEN k > 1 THEN 1 / ln(k) END) AS aa, sum(1.0 / k) AS ra FROM e JOIN arc a ON a.u = e.u JOIN arc b ON b.u = e.v AND a.v = b.v JOIN deg ON deg.u = a.v GROUP BY 1, 2)
 SELECT e.u, e.v, CAST(coalesce(both_n, 0) AS BIGINT) AS common, {R('coalesce(both_n, 0) / (a.k + b.k - coalesce(both_n, 0))')} AS jaccard, {R('coalesce(aa, 0)')} AS adamic_adar, {R('coalesce(ra, 0)')} AS resource_allocation, {R('ln(1 + a.k * b.k)')} AS preferential
 FROM e JOIN deg a ON a.u = e.u JOIN deg b ON b.u = e.v LEFT JOIN cm ON cm.u = e.u AND cm.v = e.v LEFT JOIN w ON w.u = e.u AND w.v = e.v""", jaccard=6, adamic_adar=6, resource_allocation=6, preferential=6)(
    lambda s, d: graph.structural_links(prepared(s, d))
)
query("negative_pairs")(lambda s, d: graph.negative_pairs(prepared(s, d)))
query("link_model")(lambda s, d: graph.link_model(prepared(s, d)))

# time series of events; those of the ledger are in queries_more

query("events_ts_scores", f"""WITH ev AS (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS total, CAST(count(*) AS DOUBLE) AS cnt FROM events GROUP BY 1, 2), ac AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ev WHERE abs(total) > 0),
 dv AS (SELECT *, abs(total - median(total) OVER w) AS d1, abs(cnt - median(cnt) OVER w) AS d2 FROM ac WHERE n >= 10 WINDOW w AS (PARTITION BY user_id)), zz AS (SELECT *, (d1 / ((median(d1) OVER w + 1e-6) * 1.4826) + d2 / ((median(d2) OVER w + 1e-6) * 1.4826)) / 5 AS rw FROM dv WINDOW w AS (PARTITION BY user_id)),
 sc AS (SELECT user_id, date, CASE WHEN max(rw) OVER w = min(rw) OVER w THEN 0 ELSE (rw - min(rw) OVER w) / (max(rw) OVER w - min(rw) OVER w) END AS ts FROM zz WINDOW w AS (PARTITION BY user_id)) SELECT ev.user_id AS inn, ev.date, {R('coalesce(ts, 0)', 4)} AS ts_score FROM ev LEFT JOIN sc ON sc.user_id = ev.user_id AND sc.date = ev.date""", ts_score=4)(
    lambda s, d: layers.series_scores(E.ensure_columns(s.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("inn"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("daily_total"), F.count(F.lit(1)).cast("double").alias("daily_count")).withColumns({"side": F.lit("events"), "is_active_day": (F.abs("daily_total") > 0).cast("int")}), {"in_out": 0.0, "net_flow": 0.0, "client_round": 0.0})).select("inn", "date", "ts_score")
)

# semantics on embeddings, with the label as the party

_VEC = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_LOCAL = _VEC + """, ls AS (SELECT label, i, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY 1, 2), ld AS (SELECT vec_id, x.label, sqrt(sum(pow((x - m) / (s + 1e-6), 2))) AS dist FROM x JOIN ls ON ls.label = x.label AND ls.i = x.i GROUP BY 1, 2),
 lo AS (SELECT vec_id, CASE WHEN count(*) OVER w < 5 THEN NULL WHEN max(dist) OVER w = min(dist) OVER w THEN 0 ELSE (dist - min(dist) OVER w) / (max(dist) OVER w - min(dist) OVER w) END AS shift FROM ld WINDOW w AS (PARTITION BY label))"""
_GLOBAL = """, gs AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY 1), gd AS (SELECT vec_id, sqrt(sum(pow((x - m) / (s + 1e-6), 2))) AS dist FROM x JOIN gs ON gs.i = x.i GROUP BY 1), go AS (SELECT vec_id, (dist - (SELECT min(dist) FROM gd)) / nullif((SELECT max(dist) - min(dist) FROM gd), 0) AS outl FROM gd)"""


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").withColumn("label", F.col("label").cast("string"))


query("semantic_shift", f"WITH {_LOCAL} SELECT vec_id, {R('shift', 5)} AS shift FROM lo", shift=5)(lambda s, d: layers.local_shift(_vectors(s, d), "embedding", "label", "shift").select("vec_id", "shift"))
query("semantic_global", f"WITH {_VEC} {_GLOBAL} SELECT vec_id, {R('coalesce(outl, 0)', 5)} AS outlier FROM go", outlier=5)(lambda s, d: layers.global_outlier(_vectors(s, d), "embedding", "outlier").select("vec_id", "outlier"))
query("semantic_risk", f"WITH {_LOCAL} {_GLOBAL}, r AS (SELECT lo.vec_id, 0.5 * coalesce(shift, 0) + 0.3 * coalesce(outl, 0) + 0.2 * (lo.vec_id % 7 = 0)::INT AS rw FROM lo JOIN go ON go.vec_id = lo.vec_id) SELECT vec_id, {R('(rw - min(rw) OVER ()) / (max(rw) OVER () - min(rw) OVER ())', 5)} AS semantic_risk_score FROM r", semantic_risk_score=5)(
    lambda s, d: layers.semantic_risk(layers.global_outlier(layers.local_shift(_vectors(s, d), "embedding", "label", "l"), "embedding", "g").withColumn("k", (F.col("vec_id") % 7 == 0).cast("int")), "l", "g", "k").select("vec_id", "semantic_risk_score")
)
query("tfidf_chargrams", """WITH t AS (SELECT DISTINCT p_name AS k FROM part), g AS (SELECT k, substr(k, CAST(i AS INT), CAST(n AS INT)) AS gram FROM t, (SELECT unnest([3, 4, 5]) AS n) AS ns, unnest(generate_series(1, length(k) - n + 1)) AS u(i)), tf AS (SELECT k, gram, count(*) AS c FROM g GROUP BY 1, 2), df AS (SELECT gram, count(*) AS d FROM tf GROUP BY 1), w AS (SELECT k, tf.gram, c * (ln((1.0 + (SELECT count(*) FROM t)) / (1 + d)) + 1) AS x FROM tf JOIN df USING (gram))
 SELECT k, gram, """ + R("x / sqrt(sum(x * x) OVER (PARTITION BY k))") + " AS weight FROM w", weight=6)(
    lambda s, d: features.tfidf(s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("k")).distinct(), "k", "k")
)
query("svd_vectors")(lambda s, d: layers.purpose_vectors(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("txn_id"), E.clean_text(F.col("p_type")).alias("purpose_clean"))))

# global outliers over a few features

_FEATURES = ["amount", "q", "dc", "is_weekend"]
_MATRIX = P + ", l AS (SELECT txn_id, unnest(['amount', 'q', 'dc', 'is_weekend']) AS f, unnest([amount, q::DOUBLE, dc::DOUBLE, (isodow(date) >= 6)::INT::DOUBLE]) AS x0 FROM p), z AS (SELECT txn_id, f, coalesce((x0 - avg(x0) OVER w) / nullif(stddev_pop(x0) OVER w, 0), 0) AS x, x0 FROM l WINDOW w AS (PARTITION BY f))"
_HB = ", hr AS (SELECT f, min(x) AS lo, max(x) AS hi, count(*) AS n FROM z GROUP BY 1), hq AS (SELECT txn_id, z.f, n, (hi - lo) / 10 AS step, least(floor((x - lo) / ((hi - lo) / 10) + 1e-9), 9) AS bin FROM z JOIN hr ON hr.f = z.f), hs AS (SELECT txn_id, -log2(count(*) OVER (PARTITION BY f, bin) / (n * step) + 0.1) AS s FROM hq), hb AS (SELECT txn_id, sum(s) AS raw_h FROM hs GROUP BY 1)"
_CP = ", cr AS (SELECT txn_id, f, -ln(cume_dist() OVER (PARTITION BY f ORDER BY x0)) AS le, -ln(cume_dist() OVER (PARTITION BY f ORDER BY x0 DESC)) AS ri FROM z), sk AS (SELECT f, sign(skewness(x)) AS sg FROM z GROUP BY 1), cs AS (SELECT txn_id, greatest(CASE WHEN sg < 0 THEN le WHEN sg > 0 THEN ri ELSE le + ri END, (le + ri) / 2) AS s FROM cr JOIN sk ON sk.f = cr.f), cp AS (SELECT txn_id, sum(s) AS raw_c FROM cs GROUP BY 1)"


def _matrix(s: SparkSession, d: str) -> DataFrame:
    return layers.standardised(based(s, d).withColumnsRenamed({"x_quantity": "q", "x_discount": "dc"}), _FEATURES)


query("hbos", f"WITH {_MATRIX} {_HB} SELECT txn_id, {R('raw_h', 4)} AS hbos_raw FROM hb", hbos_raw=4)(lambda s, d: layers.hbos(_matrix(s, d), len(_FEATURES)))
query("copod", f"WITH {_MATRIX} {_CP} SELECT txn_id, {R('raw_c', 4)} AS copod_raw FROM cp", copod_raw=4)(lambda s, d: layers.copod(_matrix(s, d)))
query("global_score", f"WITH {_MATRIX} {_HB} {_CP}, m AS (SELECT min(raw_h) AS hl, max(raw_h) AS hh FROM hb), n AS (SELECT min(raw_c) AS cl, max(raw_c) AS ch FROM cp) SELECT hb.txn_id, {R('(raw_h - hl) / (hh - hl)', 4)} AS hbos_score, {R('(raw_c - cl) / (ch - cl)', 4)} AS copod_score, {R('0.5 * (raw_h - hl) / (hh - hl) + 0.5 * (raw_c - cl) / (ch - cl)', 4)} AS global_score FROM hb JOIN cp ON cp.txn_id = hb.txn_id, m, n", hbos_score=4, copod_score=4, global_score=4)(
    lambda s, d: layers.global_scores(based(s, d).withColumnsRenamed({"x_quantity": "q", "x_discount": "dc"}), _FEATURES, rank=False)
)
query("pca_loadings")(lambda s, d: layers.pca_loadings(based(s, d).withColumnsRenamed({"x_quantity": "q", "x_discount": "dc"}), _FEATURES))
query("iforest")(lambda s, d: layers.individual(features.roles(features.enrich(prepared(s, d), config.Features(stems=STEMS)))))

# fusion


def _f(name: str, columns: dict[str, str], digits: int = 5) -> None:
    sql = f"WITH {FUSED} SELECT txn_id, " + ", ".join(f"{R(x, digits)} AS {c}" for c, x in columns.items()) + " FROM fu"
    query(name, sql, **dict.fromkeys(columns, digits))(lambda s, d: fused(s, d).select("txn_id", *columns))


_f("global_select", {"glob": "gl"})
_f("trust_alpha", {"alpha_debit": "ad", "alpha_credit": "ac"})
_f("behavior_risk", {"behavior_risk": "beh"})
_f("correction", {"correction": "cor"})
_f("transaction_risk", {"txn_risk_score": "txr"})
_f("overall_risk", {"overall_risk": "ov", "w_base": "1 - wg", "w_graph": "wg"})
query("risk_levels", f"WITH {FUSED} SELECT CASE WHEN round(ov, 5) >= 0.7 THEN 'red' WHEN round(ov, 5) >= 0.31 THEN 'yellow' ELSE 'green' END AS level, count(*) AS n FROM fu GROUP BY 1")(
    lambda s, d: fused(s, d).withColumn("level", E.risk_level(F.round("overall_risk", 5))).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
)
query("mean_weights", f"WITH {FUSED} SELECT {R('avg(1 - wg)')} AS w_base, {R('avg(wg)')} AS w_graph, 0.0::DOUBLE AS w_history FROM fu", w_base=6, w_graph=6, w_history=6)(lambda s, d: fusion.mean_weights(fused(s, d)))
query("dedupe_max_first", f"WITH {P} SELECT debit_inn AS txn_id, max(amount) AS amount, max(q) AS x_quantity, min(purpose) AS purpose FROM p GROUP BY 1")(
    lambda s, d: fusion.one_row_each(prepared(s, d).select(F.col("debit_inn").alias("txn_id"), "amount", "x_quantity", "purpose"))
)
query("dedupe_keep_last", f"WITH {P} SELECT debit_inn, max(txn_id) AS txn_id FROM p GROUP BY 1")(lambda s, d: fusion.keep_last(prepared(s, d), "debit_inn", "txn_id").select("debit_inn", "txn_id"))

# knowledge base

_STATS = KB + f""", ps AS (SELECT role, inn, partner, max(ov) AS top FROM sd GROUP BY 1, 2, 3), pc AS (SELECT role, inn, count(*) FILTER (top >= 0.6) AS sc, count(*) AS pn FROM ps GROUP BY 1, 2),
 pr AS (SELECT role, inn, count(*) AS tx_count, min(date) AS first_day, max(date) AS last_tx, count(DISTINCT partner) AS uniq, avg(amount) AS am, quantile_cont(amount, 0.95) AS ap, avg(ov) AS rm, quantile_cont(ov, 0.95) AS rp, avg(ov) FILTER (date_diff('day', date, last_day) <= 30) AS r30, avg(ov) FILTER (date_diff('day', date, last_day) <= 90) AS r90, max(txr) AS mx,
 count(*) FILTER (ov < 0.31) AS gr, count(*) FILTER (ov >= 0.31 AND ov < 0.7) AS ye, count(*) FILTER (ov >= 0.7) AS re, avg(fan) AS fm, avg((abs(io) > 0.7)::INT) AS tz, avg(regexp_matches(clean, '(^| )({'|'.join(config.LOAN_STEMS_EN)})')::INT) AS lo, avg((sem > 0.7)::INT) AS sh, avg((ts > 0.7)::INT) AS th, avg(gn) AS gm FROM ag GROUP BY 1, 2),
 hi AS (SELECT pr.*, sc, pn, tx_count / (tx_count + 50.0) * ((rm + r30) / 2) + 50.0 / (tx_count + 50.0) * (SELECT avg(ov) FROM fu) AS hist, sc / pn AS sr FROM pr JOIN pc ON pc.role = pr.role AND pc.inn = pr.inn)"""
query("kb_profile", f"WITH {_STATS} SELECT role, inn, tx_count, CAST(first_day AS VARCHAR) AS first_tx_date, CAST(last_tx AS VARCHAR) AS last_tx_date, uniq AS uniq_counterparties, {R('am', 2)} AS amount_mean, {R('ap', 2)} AS amount_p95, {R('rm', 5)} AS risk_mean, {R('rp', 5)} AS risk_p95, {R('r30', 5)} AS risk_mean_30d, {R('r90', 5)} AS risk_mean_90d, {R('mx', 5)} AS max_txn_risk, {R('fm', 5)} AS fan_ratio_mean, {R('tz', 5)} AS transit_ratio, {R('lo', 5)} AS loan_like_share, {R('sh', 5)} AS semantic_high_share, {R('th', 5)} AS ts_high_share, {R('gm', 5)} AS graph_node_mean FROM hi",
      amount_mean=2, amount_p95=2, **dict.fromkeys(("risk_mean", "risk_p95", "risk_mean_30d", "risk_mean_90d", "max_txn_risk", "fan_ratio_mean", "transit_ratio", "loan_like_share", "semantic_high_share", "ts_high_share", "graph_node_mean"), 5))(
    lambda s, d: stats(s, d).select("role", "inn", "tx_count", "first_tx_date", "last_tx_date", "uniq_counterparties", "amount_mean", "amount_p95", "risk_mean", "risk_p95", "risk_mean_30d", "risk_mean_90d", "max_txn_risk", "fan_ratio_mean", "transit_ratio", "loan_like_share", "semantic_high_share", "ts_high_share", "graph_node_mean")
)
query("kb_history", f"WITH {_STATS} SELECT role, inn, {R('hist', 5)} AS history_risk FROM hi", history_risk=5)(lambda s, d: stats(s, d).select("role", "inn", "history_risk"))
query("kb_suspicious_cp", f"WITH {_STATS} SELECT role, inn, sc AS suspicious_cp_cnt, {R('sr', 5)} AS suspicious_cp_ratio, CAST(sr > 0.4 AS INT) AS cp_review_flag FROM hi", suspicious_cp_ratio=5)(lambda s, d: stats(s, d).select("role", "inn", "suspicious_cp_cnt", "suspicious_cp_ratio", "cp_review_flag"))
query("kb_entity_flags", f"WITH {_STATS}, fl AS (SELECT inn, unnest([CASE WHEN hist >= 0.7 THEN role || ':high_history' END, CASE WHEN re / tx_count > 0.3 THEN role || ':many_red' END, CASE WHEN lo > 0.5 THEN role || ':loans' END, CASE WHEN tz > 0.4 THEN role || ':transit' END, CASE WHEN sh > 0.4 THEN role || ':semantic' END, CASE WHEN th > 0.4 THEN role || ':time_series' END, CASE WHEN gm > 0.7 THEN role || ':graph' END]) AS f FROM hi) SELECT inn, coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') AS flags FROM fl GROUP BY 1")(
    lambda s, d: kb.entity_flags(stats(s, d)).select("inn", F.array_join("flags", ",").alias("flags"))
)
query("kb_recent_risky", f"WITH {FUSED} SELECT txn_id, CAST(date AS VARCHAR) AS date, CASE WHEN debit_inn = '7' THEN 'debit' ELSE 'credit' END AS role, CASE WHEN debit_inn = '7' THEN credit_inn ELSE debit_inn END AS counterparty, amount FROM fu WHERE debit_inn = '7' OR credit_inn = '7' ORDER BY round(txr, 9) DESC, date DESC, txn_id LIMIT 20")(
    lambda s, d: kb.recent_risky(kb_rows(s, d, keep=False).withColumn("txn_risk_score", F.round("txn_risk_score", 9)), "7").select("txn_id", "date", "role", "counterparty", "amount")
)
query("review_flags", f"WITH {_STATS} SELECT txn_id, coalesce(CAST(a.sr > 0.4 AS INT), 0) AS review_debit, coalesce(CAST(b.sr > 0.4 AS INT), 0) AS review_credit, greatest(coalesce(CAST(a.sr > 0.4 AS INT), 0), coalesce(CAST(b.sr > 0.4 AS INT), 0)) AS review_any FROM fu LEFT JOIN hi a ON a.role = 'debit' AND a.inn = fu.debit_inn LEFT JOIN hi b ON b.role = 'credit' AND b.inn = fu.credit_inn")(
    lambda s, d: (lambda rows: kb.review_flags(rows, kb.profiles(rows, config.LOAN_STEMS_EN)))(kb_rows(s, d)).select("txn_id", "review_debit", "review_credit", "review_any")
)
query("kb_upsert", f"WITH {P} SELECT txn_id, CASE WHEN q >= 30 THEN amount + 1 ELSE amount END AS amount FROM p WHERE q <= 40 OR q >= 30")(
    lambda s, d: kb.upsert(prepared(s, d).where("x_quantity <= 40").select("txn_id", "amount"), prepared(s, d).where("x_quantity >= 30").select("txn_id", (F.col("amount") + 1).alias("amount")))
)
query("kb_split", f"WITH {P} SELECT txn_id, CASE WHEN q <= 40 THEN 'update' ELSE 'insert' END AS kind FROM p WHERE q >= 30")(
    lambda s, d: (lambda u, i: u.select("txn_id", F.lit("update").alias("kind")).union(i.select("txn_id", F.lit("insert").alias("kind"))))(*kb.split(prepared(s, d).where("x_quantity <= 40"), prepared(s, d).where("x_quantity >= 30")))
)
query("kb_affected", f"WITH {P} SELECT debit_inn AS inn FROM p WHERE q = 50 UNION SELECT credit_inn FROM p WHERE q = 50")(lambda s, d: kb.affected(prepared(s, d).where("x_quantity = 50")))

# review and reports

query("llm_payload", f"WITH {FUSED} SELECT txn_id, purpose, amount FROM fu WHERE amount > 50000")(
    lambda s, d: review.payload(fused(s, d, *review.PAYLOAD_COLUMNS).where("amount > 50000")).select("txn_id", F.from_json("payload", "purpose string, amount double").alias("j")).select("txn_id", "j.purpose", "j.amount")
)
query("rule_levels", f"WITH {FUSED} SELECT txn_id, CASE WHEN round(ov, 5) > 0.5 THEN 'red' WHEN round(ov, 5) > 0.4 THEN 'yellow' ELSE 'green' END AS rule_level FROM fu")(
    lambda s, d: review.rule_levels(fused(s, d, is_tax=review.is_tax()).withColumn("overall_risk", F.round("overall_risk", 5))).select("txn_id", "rule_level")
)
query("top_parties", f"WITH {P}, t AS (SELECT debit_inn AS inn, sum(amount) AS total FROM p GROUP BY 1) SELECT inn, {R('total', 2)} AS total FROM t ORDER BY round(total, 2) DESC, inn LIMIT 100", total=2)(
    lambda s, d: prepared(s, d).groupBy(F.col("debit_inn").alias("inn")).agg(F.sum("amount").alias("total")).orderBy(F.desc(F.round("total", 2)), "inn").limit(100)
)
