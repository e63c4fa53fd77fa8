"""Transaction features.  Input: a prepared ledger (``sources.ledger.prepare``).

Null parties get no group values: aggregates are null (later 0) and the gap is 9999 days.  Their rows are spread over the tasks by their
ids instead of forming a group.  All windows of a party see its rows where one shuffle put them, so what ``by_party`` makes costs one shuffle for each role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.config import Features
from riskflow.functions import exprs as E
from riskflow.operators import sliced

ROLES = {"debit": "debit_inn", "credit": "credit_inn"}


def _known(party: str, c: Column) -> Column:
    return F.when(F.col(party).isNotNull(), c)


def _grouped(df: DataFrame, party: str, hot: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` dealt by party, which all windows of the party share; rows without the party (and of ``hot`` ones, which have no such windows) are dealt by their id, ``_alone``.  It is a column, as
    windows by an expression would each shuffle anew."""
    one = F.col(party).isNull() | F.col(party).cast("string").isin(hot)
    return df.withColumn("_alone", F.when(one, F.col("txn_id"))).repartition(party, "_alone")


def _group(party: str) -> list[Column]:
    """The party, or the row alone where there is none (of ``_grouped`` rows)."""
    return [F.col(party), F.col("_alone")]


def base(df: DataFrame, stems: tuple[str, ...] = Features.stems) -> DataFrame:
    """Calendar, roundness, logarithm and text signals of each row."""
    text = F.coalesce(F.col("purpose"), F.lit("nan"))
    length = F.length(text)
    ten, hundred = (F.col("amount") % 10000 == 0).cast("int"), (F.col("amount") % 100000 == 0).cast("int")
    month_end = F.col("date") == F.last_day("date")
    return df.withColumns(
        {
            "day_of_week": F.weekday("date"),
            "is_weekend": (F.weekday("date") >= 5).cast("int"),
            "is_month_end": month_end.cast("int"),
            "is_quarter_end": (month_end & (F.month("date") % 3 == 0)).cast("int"),
            "is_year_end": (month_end & (F.month("date") == 12)).cast("int"),
            "month": F.month("date"),
            "week_of_year": F.weekofyear("date"),
            "log_amount": F.log1p(F.greatest("amount", F.lit(1.0))),
            "is_round_10k": ten,
            "is_round_100k": hundred,
            "is_round_amount": F.greatest(ten, hundred),
            "purpose_len": length,
            "purpose_digits_ratio": E.ratio(F.regexp_count(text, F.lit("[0-9]")).cast("double"), length),
            "purpose_upper_ratio": E.ratio(F.regexp_count(text, F.lit("[A-ZА-Я]")).cast("double"), length),
            "purpose_clean": E.clean_text(F.col("purpose")),
            "purpose_stopword_high": E.has_stem(E.clean_text(F.col("purpose")), stems),
        }
    )


def _daily(df: DataFrame, role: str, hot: list[str]) -> DataFrame:
    party = ROLES[role]
    day = Window.partitionBy(*_group(party), "date")
    df = sliced.lagged(df, party, ["date", "txn_id"], "_before_it", hot, _group(party))
    df = df.withColumns(
        {
            f"daily_total_{role}": _known(party, F.sum("amount").over(day)),
            f"daily_{role}_transaction_count": _known(party, F.count(F.when(F.col("amount") > 0, 1)).over(day)),
            f"days_since_last_txn_{role}": F.coalesce(_known(party, F.date_diff("date", "_before_it")), F.lit(Features.first_gap)),
        }
    )
    return df.withColumn(f"daily_{role}_percent", F.coalesce(F.col("amount") / F.nullif(f"daily_total_{role}", F.lit(0.0)), F.lit(0.0))).drop("_before_it")


def by_party(df: DataFrame, windows: tuple[int, ...] = (), volatile: bool = False, fan: bool = False, days: bool = True, hot_rows: int = sliced.HOT_ROWS) -> DataFrame:
    """What windows of a party give: ``daily`` columns (``days``), those of ``add_rolling`` for ``windows``, ``volatility`` and ``fans``, with one shuffle for each role.
    Parties with more than ``hot_rows`` rows are several tasks."""
    hot = sliced.hot_groups(df, list(ROLES.values()), hot_rows) if days or windows or volatile else {}


    def made(rows: DataFrame, role: str, some: list[str]) -> DataFrame:
        rows = _daily(rows, role, some) if days else rows
        rows = _rolling(rows, role, windows, bool(some)) if windows else rows
        rows = _volatility(rows, role, bool(some)) if volatile else rows
        return (_fan(rows, role) if fan else rows).drop("_alone")

    for role, party in ROLES.items():
        some, rest = sliced.apart(df, party, hot[party]) if hot.get(party) else (None, df)
        df = made(_grouped(rest, party), role, [])
        if some is not None:
            df = df.unionByName(made(some.withColumn("_alone", F.lit(None).cast("string")), role, hot[party]).select(*df.columns))
    return df


def daily(df: DataFrame, hot_rows: int = sliced.HOT_ROWS) -> DataFrame:
    """Each party's total and number of positive amounts of the day, the row's share of it, and the days since its last row."""
    return by_party(df, hot_rows=hot_rows)


def active_days(df: DataFrame, role: str) -> DataFrame:
    """One row for each party and day with rows: the day's amount in the role's own column, its rows and how many of them are round."""
    party = ROLES[role]
    round_rows = F.sum("is_round_amount") if "is_round_amount" in df.columns else F.lit(0)
    return df.where(F.col(party).isNotNull()).groupBy(F.col(party).alias("inn"), "date").agg(F.sum(f"{role}_amount").alias("amt"), F.count(F.lit(1)).alias("_rows"), round_rows.alias("_round"))


def rolling(df: DataFrame, role: str, windows: tuple[int, ...] = Features.windows) -> DataFrame:
    """Calendar windows of each party's active days (inn, date): sum, active days with money, mean, sample deviation and
    95th percentile, in which the days without rows since the party's first count as 0.

    Only active days are rows: n = min(W, days since the first + 1) days are in a window, and the absent
    ones are n - k zeros, which the sums ignore and the percentile's sorted array gets in front.  ``client_round_ratio_30d`` is the share
    of round amounts among the party's rows of 30 days.
    """
    days = active_days(df, role).withColumns({"d": F.unix_date("date"), "_one": F.lit(True)}).withColumnsRenamed({"amt": "_amt"})
    seen, out = _windows(role, Window.partitionBy("inn"), windows, F.sum("_rows"), F.sum("_round"))
    days = days.withColumn("_first", F.min("d").over(Window.partitionBy("inn"))).withColumns(seen).withColumns({f"_sorted_{w}": F.array_sort(f"_all_{w}") for w in windows})
    return days.select("inn", "date", *(c.alias(n) for n, c in out.items()))


def _windows(role: str, party: Window, windows: tuple[int, ...], rows: Column, rounds: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """The window aggregates of ``rolling`` and, with the lists sorted as ``_sorted_<w>``, its columns.  Input: ``d`` (day's number), ``_first`` (the party's first), ``_amt`` (the day's amount) and ``_one``,
    true in one row of each day; ``rows`` and ``rounds`` add up rows and round amounts."""
    seen, out = {}, {}
    amt = F.when(F.col("_one"), F.col("_amt"))
    for w in windows:
        frame = party.orderBy("d").rangeBetween(-(w - 1), 0)
        # each window aggregate is a column of its own, or Spark would compute it again wherever it is used
        seen |= {
            f"_sum_{w}": F.sum(amt).over(frame), f"_sq_{w}": F.sum(amt * amt).over(frame),
            f"_cnt_{w}": F.count(F.when(amt > 0, 1)).over(frame), f"_all_{w}": F.collect_list(amt).over(frame),
        }
        n = F.least(F.lit(w), F.col("d") - F.col("_first") + 1)
        total, values = F.col(f"_sum_{w}"), F.col(f"_sorted_{w}")
        at = (n - 1) * F.lit(0.95)
        low = F.floor(at)
        zeros = n - F.size(values)
        # the k-th value in order, from 0; amounts are not negative, so the zeros come first
        value = lambda k, values=values, zeros=zeros: F.when(k < zeros, 0.0).otherwise(F.get(values, (k - zeros).cast("int")))
        out |= {
            f"{role}_roll_sum_{w}d": total,
            f"{role}_roll_cnt_{w}d": F.col(f"_cnt_{w}"),
            f"{role}_roll_mean_{w}d": total / n,
            f"{role}_roll_std_{w}d": F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col(f"_sq_{w}") - total * total / n) / (n - 1)))).otherwise(0.0),
            f"{role}_roll_p95_{w}d": value(low) + (at - low) * (F.coalesce(value(F.least(low + 1, n - 1)), F.lit(0.0)) - value(low)),
        }
    month = party.orderBy("d").rangeBetween(-29, 0)
    seen |= {"_rows_30": rows.over(month), "_round_30": rounds.over(month)}
    out[f"{role}_client_round_ratio_30d"] = F.col("_round_30") / F.col("_rows_30")
    return seen, out


def _rolling(df: DataFrame, role: str, windows: tuple[int, ...], hot: bool) -> DataFrame:
    """``df`` (``_grouped``) with the columns of ``rolling``.  The windows run over the rows themselves, where they are: a range of days has all rows of each day, and one of them holds the
    day's amount.  Rows of hot parties are too many in a range; their days are aggregated and joined instead."""
    party = ROLES[role]
    if hot:
        return df.join(rolling(df, role, windows).withColumnRenamed("inn", party), [party, "date"], "left")
    whole, day = Window.partitionBy(*_group(party)), Window.partitionBy(*_group(party), "date")
    rows = df.withColumns({"_one": F.row_number().over(day.orderBy("txn_id")) == 1, "_amt": F.sum(f"{role}_amount").over(day)})
    rows = rows.withColumn("d", F.unix_date("date")).withColumn("_first", F.min("d").over(whole))
    seen, out = _windows(role, whole, windows, F.count(F.lit(1)), F.sum("is_round_amount") if "is_round_amount" in df.columns else F.sum(F.lit(0)))
    rows = rows.withColumns(seen).withColumns({f"_sorted_{w}": F.array_sort(f"_all_{w}") for w in windows})
    known = F.col(party).isNotNull() & F.col("date").isNotNull()
    return rows.select(*df.columns, *(F.when(known, c).alias(n) for n, c in out.items()))


def add_rolling(df: DataFrame, windows: tuple[int, ...] = Features.windows, hot_rows: int = sliced.HOT_ROWS) -> DataFrame:
    return by_party(df, windows, days=False, hot_rows=hot_rows)


def _unsteady(role: str) -> Column:
    return E.ratio(F.col(f"{role}_roll_std_30d"), F.col(f"{role}_roll_mean_30d"))


def derived(df: DataFrame) -> DataFrame:
    """Spikes, acceleration, distance from the usual high, transit and flow signs (needs daily and rolling columns)."""
    out = {}
    for r in ROLES:
        s7, s14, s30 = (F.col(f"{r}_roll_sum_{w}d") for w in (7, 14, 30))
        out |= {
            f"{r}_amount_spike_ratio_7d": E.ratio(s7, s30 / 4),
            f"{r}_tx_rate_spike_7d": E.ratio(F.col(f"{r}_roll_cnt_7d"), F.col(f"{r}_roll_cnt_30d") / 4),
            f"{r}_accel_ratio_7d": E.clip(E.ratio(s7 - s14, s14), -10.0, 10.0),
            f"{r}_to_p95_ratio": E.ratio(s7, F.col(f"{r}_roll_p95_90d")),
            f"{r}_amount_volatility_30d": _unsteady(r),
        }
    c7, d7, c30, d30 = F.col("credit_roll_sum_7d"), F.col("debit_roll_sum_7d"), F.col("credit_roll_sum_30d"), F.col("debit_roll_sum_30d")
    transit = (F.col("days_since_last_txn_credit") == 0) & (F.col("daily_total_credit") > 0) & (F.col("daily_total_debit") > 0)
    return df.withColumns(out | {
        "transit_same_day_flag": F.coalesce(transit, F.lit(False)).cast("int"),
        "net_flow_ratio_7d": E.clip(E.ratio(c7 - d7, c7 + d7), -1.0, 1.0),
        "in_out_ratio_30d": E.ratio(c30 - d30, c30 + d30),
    })


def _volatility(df: DataFrame, role: str, hot: bool) -> DataFrame:
    party, name = ROLES[role], f"{role}_amount_volatility_30d"
    df = df.withColumn(name, _unsteady(role))
    if hot:
        df = df.join(F.broadcast(df.groupBy(party).agg(F.avg(name).alias("_m"), F.stddev_pop(name).alias("_s"))), party)  # a row for each hot party
    else:
        whole = Window.partitionBy(*_group(party))
        df = df.withColumns({"_m": F.avg(name).over(whole), "_s": F.stddev_pop(name).over(whole)})
    return df.withColumn(f"{role}_volatility_z", F.when(F.col("_s") > 0, (F.col(name) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def volatility(df: DataFrame, hot_rows: int = sliced.HOT_ROWS) -> DataFrame:
    """``<role>_volatility_z``: the 30-day volatility standardised within the party (population deviation; 0 without spread)."""
    return by_party(df, volatile=True, days=False, hot_rows=hot_rows)


def novelty(df: DataFrame, rows: int = Features.novelty_rows, hot_rows: int = sliced.HOT_ROWS) -> DataFrame:
    """Share of first payments to a payee among the payer's last ``rows`` rows, this one included.  Payers with more than ``hot_rows`` rows are several tasks."""
    order, hot, group = ["date", "txn_id"], sliced.hot_groups(df, ["debit_inn"], hot_rows)["debit_inn"], _group("debit_inn")
    df = _grouped(df, "debit_inn", hot)
    df = sliced.first_of_pair(df, "debit_inn", "credit_inn", order, "_new", hot, group)
    df = sliced.trailing_mean(df, "debit_inn", order, "_new", rows, "_share", hot, group)
    return df.withColumn("debit_new_counterparty_ratio", _known("debit_inn", F.col("_share"))).drop("_new", "_share", "_alone")


# Each role's partner, its columns of the distinct partners of a day and of their share in the day's rows
FANS = {"debit": ("credit_inn", "unique_recipients_per_day", "debit_fan_out_ratio"), "credit": ("debit_inn", "unique_receivers_per_day", "credit_fan_in_ratio")}


def _fan(df: DataFrame, role: str) -> DataFrame:
    other, partners, name = FANS[role]
    known = F.col(ROLES[role]).isNotNull() & F.col("date").isNotNull()
    day = Window.partitionBy(*_group(ROLES[role]), "date")
    df = df.withColumn("_new", F.row_number().over(Window.partitionBy(*_group(ROLES[role]), "date", other).orderBy("txn_id")) == 1)
    df = df.withColumns({"_k": F.count(F.when(F.col("_new") & F.col(other).isNotNull(), 1)).over(day), "_n": F.count(F.lit(1)).over(day)})
    return df.withColumns({partners: F.when(known, F.col("_k")), name: F.when(known, F.col("_k") / F.col("_n"))}).drop("_new", "_k", "_n")


def fans(df: DataFrame) -> DataFrame:
    """Distinct partners of each party's day, and per row of the day."""
    return by_party(df, fan=True, days=False)


def profile(df: DataFrame, role: str) -> DataFrame:
    """One row for each party in the role: totals, partners and active days; missing statistics are 0."""
    party, other = ROLES[role], ROLES["credit" if role == "debit" else "debit"]
    amount, p = F.col(f"{role}_amount"), f"{role}_inn_"
    out = df.where(F.col(party).isNotNull()).groupBy(F.col(party).alias("inn")).agg(
        F.sum(amount).alias(f"{p}total_amount"),
        F.avg(amount).alias(f"{p}mean_amount"),
        F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias(f"{p}std_amount"),
        F.percentile(amount, F.lit(0.5)).alias(f"{p}median_amount"),
        F.countDistinct(other).alias(f"{p}partners"),
        F.count(F.when(amount > 0, 1)).alias(f"{p}txn_count"),
        F.countDistinct("date").alias(f"{p}active_days"),
    )
    return out


def add_profiles(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``df`` with its parties' profiles (of the rows ``of``, ``df`` itself by default)."""
    source = of if of is not None else df
    for role, party in ROLES.items():
        df = df.join(profile(source, role).withColumnRenamed("inn", party), party, "left")
    return df


def enrich(df: DataFrame, settings: Features = Features()) -> DataFrame:
    """All features of a prepared ledger."""
    return add_profiles(novelty(derived(by_party(base(df, settings.stems), settings.windows, volatile=True, fan=True)), settings.novelty_rows), df)


def roles(df: DataFrame) -> DataFrame:
    """The enriched ledger in long form, one row for each transaction and side, with the role's columns under common names.  Each row is doubled where it is, so ``df`` is computed once."""
    fan_names = {"debit": "debit_fan_out_ratio", "credit": "credit_fan_in_ratio"}

    def side(role: str) -> dict[str, Column]:
        own = {c.replace(f"{role}_", "", 1): F.col(c) for c in df.columns if c.startswith((f"{role}_roll_", f"{role}_amount_", f"{role}_tx_rate", f"{role}_accel", f"{role}_to_p95", f"{role}_client_round", f"{role}_volatility_z"))}
        new = F.col("debit_new_counterparty_ratio") if role == "debit" and "debit_new_counterparty_ratio" in df.columns else F.lit(0.0)
        fan = {"fan_ratio": F.col(fan_names[role])} if fan_names[role] in df.columns else {}
        return {
            "inn": F.col(ROLES[role]), "amount": F.col(f"{role}_amount"), "log_amount": F.log1p(F.greatest(F.col(f"{role}_amount"), F.lit(1.0))),
            "daily_total": F.col(f"daily_total_{role}"), "daily_txn_cnt": F.col(f"daily_{role}_transaction_count"), "daily_percent": F.col(f"daily_{role}_percent"), "days_since_last": F.col(f"days_since_last_txn_{role}"),
        } | own | {"new_counterparty_ratio": new} | fan

    debit, credit = side("debit"), side("credit")
    common = [c for c in ("is_weekend", "is_month_end", "is_quarter_end", "is_year_end", "is_round_amount", "purpose_len", "purpose_digits_ratio", "purpose_upper_ratio", "net_flow_ratio_7d", "in_out_ratio_30d", "transit_same_day_flag") if c in df.columns]
    both = df.withColumn("_side", F.explode(F.array(F.lit("debit"), F.lit("credit"))))
    paid = F.col("_side") == "debit"
    none = F.lit(None)
    out = {n: F.when(paid, debit.get(n, none)).otherwise(credit.get(n, none)).alias(n) for n in [*debit, *(n for n in credit if n not in debit)]}
    return both.select("txn_id", "date", out.pop("inn"), F.col("_side").alias("side"), "purpose", *(out.pop(n) for n in ("amount", "log_amount", "daily_total", "daily_txn_cnt", "daily_percent", "days_since_last")), *common, *out.values()).where(F.col("inn").isNotNull())


def tfidf(df: DataFrame, key: str = "txn_id", text: str = "purpose_clean", low: int = 3, high: int = 5) -> DataFrame:
    """Character n-gram TF-IDF (spaces included, smoothed logarithm, unit length): key, gram, weight.  Equal texts are computed once."""
    distinct = df.select(F.coalesce(text, F.lit("nan")).alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_copies"))
    size = F.length("_t")
    one = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("_t"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = distinct.select("_t", "_copies", F.explode(F.flatten(F.array(*(one(n) for n in range(low, high + 1))))).alias("gram"))
    tf = grams.groupBy("_t", "gram").agg(F.count(F.lit(1)).alias("tf"), F.first("_copies").alias("_copies"))
    frequency = tf.groupBy("gram").agg(F.sum("_copies").alias("df"))
    n = distinct.agg(F.sum("_copies").alias("_n"))
    weighed = tf.join(frequency, "gram").crossJoin(F.broadcast(n)).withColumn("_w", F.col("tf") * (F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1))
    norm = weighed.groupBy("_t").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    vectors = weighed.join(norm, "_t").select("_t", "gram", (F.col("_w") / F.col("_norm")).alias("weight"))
    return df.select(key, F.coalesce(text, F.lit("nan")).alias("_t")).join(vectors, "_t").select(key, "gram", "weight")
