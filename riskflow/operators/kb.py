"""The knowledge base: scored transactions and profiles of parties, kept as versions of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.config import LOAN_STEMS, Fusion, KnowledgeBase
from riskflow.functions import exprs as E
from riskflow.operators.fusion import keep_last

# The columns of the store
FIXED = (
    "txn_id", "date", "debit_inn", "credit_inn", "debit_amount", "credit_amount", "amount", "purpose", "purpose_clean", "purpose_stopword_high",
    "global_score", "iforest_score_debit", "iforest_score_credit", "behavior_risk_debit", "behavior_risk_credit", "base_behavior_risk", "txn_risk_score",
    "semantic_risk_score", "ts_anomaly_score_txn", "graph_edge_score", "graph_node_score", "round_large_amount", "debit_fan_out_ratio", "credit_fan_in_ratio", "in_out_ratio_30d",
)
#: what the blend knows besides
COLUMNS = (*FIXED, "overall_risk", "risk_level", "behavior_risk", "hbos_score", "copod_score", "history_risk")
TEXT = ("debit_inn", "credit_inn", "purpose", "purpose_clean", "risk_level")
#: names of the store that have another one in the blend
KNOWN_AS = {"global_score": "glob", "behavior_risk_debit": "risk_debit", "behavior_risk_credit": "risk_credit", "base_behavior_risk": "behavior_risk", "round_large_amount": "is_round_amount"}


def project(df: DataFrame) -> DataFrame:
    """The columns of the store: ids trimmed, without a trailing ``.0``, in lower case, rows without one dropped; days as ISO text.  A column that isn't there is null."""
    df = df.withColumns({c: F.col(old) for c, old in KNOWN_AS.items() if c not in df.columns and old in df.columns})
    df = E.ensure_columns(df, {c: None for c in COLUMNS})
    made = {
        "txn_id": F.lower(F.regexp_replace(F.trim(F.col("txn_id").cast("string")), r"\.0$", "")), "date": F.date_format(F.col("date").cast("date"), "yyyy-MM-dd"),
        "round_large_amount": F.col("round_large_amount").try_cast("int"),
    } | {c: F.col(c).cast("string") for c in TEXT}
    out = df.select(*((made[c] if c in made else E.number(df, c)).alias(c) for c in COLUMNS), *(c for c in ("_seq",) if c in df.columns))
    return out.where("txn_id is not null and txn_id <> ''")


def upsert(existing: DataFrame, new: DataFrame, key: str | list[str] = "txn_id") -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with the same key, and added."""
    return existing.join(new, key, "left_anti").unionByName(new)


def split(existing: DataFrame, new: DataFrame, key: str = "txn_id") -> tuple[DataFrame, DataFrame]:
    """Rows that update and rows that are inserted."""
    return new.join(existing, key, "left_semi"), new.join(existing, key, "left_anti")


def affected(new: DataFrame) -> DataFrame:
    return new.select(F.col("debit_inn").alias("inn")).union(new.select(F.col("credit_inn").alias("inn"))).where("inn is not null").distinct()


def sides(txns: DataFrame) -> DataFrame:
    """Each transaction once for each of its parties: role, inn, partner and the role's fan ratio."""
    def side(role: str, other: str, fan: str) -> DataFrame:
        return txns.where(F.col(f"{role}_inn").isNotNull()).withColumns({"role": F.lit(role), "inn": F.col(f"{role}_inn"), "partner": F.col(f"{other}_inn"), "fan": F.col(fan)})

    return side("debit", "credit", "debit_fan_out_ratio").unionByName(side("credit", "debit", "credit_fan_in_ratio"))


def profiles(txns: DataFrame, stems: tuple[str, ...] = LOAN_STEMS, kb: KnowledgeBase = KnowledgeBase(), s: Fusion = Fusion(), of: DataFrame | None = None) -> DataFrame:
    """One row for each party and role.  ``of`` (inn) limits the parties; the mean risk that history leans on is that of all rows."""
    long = sides(txns)
    return side_profiles(long if of is None else long.join(of, "inn", "left_semi"), txns.agg(F.avg("overall_risk").alias("_all")), stems, kb, s)


def side_profiles(long: DataFrame, overall: DataFrame, stems: tuple[str, ...] = LOAN_STEMS, kb: KnowledgeBase = KnowledgeBase(), s: Fusion = Fusion()) -> DataFrame:
    """The profiles of all parties in ``long`` (``sides``); ``overall``: one row with ``_all``, the mean risk of all rows."""
    risk = F.col("overall_risk")
    loan = F.when(F.col("purpose_clean").isNotNull(), E.has_stem(F.col("purpose_clean"), stems)).otherwise(F.coalesce(F.col("purpose_stopword_high") > 0.5, F.lit(False)))
    share: Callable[[Column, int], Column] = lambda c, n: F.when(c, 1 << n).otherwise(0)
    signs = share(F.abs("in_out_ratio_30d") > 0.7, 0) + share(loan, 1) + share(F.col("semantic_risk_score") > 0.7, 2) + share(F.col("ts_anomaly_score_txn") > 0.7, 3)
    # texts and ids stay behind: only what is added up is shuffled
    long = long.select(
        "role", "inn", "partner", "fan", F.to_date("date").alias("day"), "amount", "overall_risk", "txn_risk_score", "graph_node_score", "graph_edge_score", signs.cast("byte").alias("_signs"),
    )
    has = lambda n: F.shiftright("_signs", n).bitwiseAND(1).cast("double")
    last = long.groupBy("role", "inn").agg(F.max("day").alias("last_day"))
    long = long.join(last.hint("shuffle_hash"), ["role", "inn"])  # the rows are dealt by party once and not sorted for it
    age = F.date_diff("last_day", "day")
    p95 = lambda c: F.percentile(c, F.lit(0.95))
    base = long.groupBy("role", "inn").agg(
        F.count(F.lit(1)).alias("tx_count"), F.min("day").cast("string").alias("first_tx_date"), F.max("day").cast("string").alias("last_tx_date"),
        F.avg("amount").alias("amount_mean"), p95("amount").alias("amount_p95"),
        F.avg(risk).alias("risk_mean"), p95(risk).alias("risk_p95"), F.avg(F.when(age <= 30, risk)).alias("risk_mean_30d"), F.avg(F.when(age <= 90, risk)).alias("risk_mean_90d"), F.max("txn_risk_score").alias("max_txn_risk"),
        F.count_if(risk < s.yellow).alias("green_cnt"), F.count_if((risk >= s.yellow) & (risk < s.red)).alias("yellow_cnt"), F.count_if(risk >= s.red).alias("red_cnt"),
        F.avg("fan").alias("fan_ratio_mean"), F.avg(has(0)).alias("transit_ratio"), F.avg(has(1)).alias("loan_like_share"), F.avg(has(2)).alias("semantic_high_share"), F.avg(has(3)).alias("ts_high_share"),
        F.avg("graph_node_score").alias("graph_node_mean"), p95("graph_node_score").alias("graph_node_p95"), p95("graph_edge_score").alias("graph_edge_p95"),
    )
    # distinct partners are counted from their own groups: with percentiles beside it, a distinct count would hold and sort a percentile's state for each partner
    partners = long.where(F.col("partner").isNotNull()).groupBy("role", "inn", "partner").agg(F.max(risk).alias("top"))
    partners = partners.groupBy("role", "inn").agg(F.count_if(F.col("top") >= kb.suspicious_risk).alias("suspicious_cp_cnt"), F.count(F.lit(1)).alias("_partners"))
    out = base.join(partners, ["role", "inn"], "left").crossJoin(F.broadcast(overall))
    mean = F.coalesce((F.col("risk_mean") + F.col("risk_mean_30d")) / 2, "risk_mean", "risk_mean_30d", "_all")
    n = F.col("tx_count")
    ratio = F.coalesce(F.col("suspicious_cp_cnt") / F.col("_partners"), F.lit(0.0))
    return out.withColumns({
        "history_risk": n / (n + kb.history_hyper) * mean + kb.history_hyper / (n + kb.history_hyper) * F.col("_all"),
        "uniq_counterparties": F.coalesce("_partners", F.lit(0)), "suspicious_cp_cnt": F.coalesce("suspicious_cp_cnt", F.lit(0)), "suspicious_cp_ratio": ratio, "cp_review_flag": (ratio > kb.review_ratio).cast("int"),
    }).drop("_partners", "_all")


# Flag, column, threshold, whether it includes the threshold
FLAGS = (("high_history", "history_risk", 0.7, True), ("many_red", None, 0.3, False), ("loans", "loan_like_share", 0.5, False), ("transit", "transit_ratio", 0.4, False), ("semantic", "semantic_high_share", 0.4, False), ("time_series", "ts_high_share", 0.4, False), ("graph", "graph_node_mean", 0.7, False))


def entity_flags(stats: DataFrame) -> DataFrame:
    """Each party's profile flags over both roles, distinct and in order, and its highest history risk."""
    def over(column: str | None, least: float, equal: bool) -> Column:
        c = F.col("red_cnt") / F.col("tx_count") if column is None else F.col(column)
        return c >= least if equal else c > least

    made = F.array_compact(F.array(*(F.when(over(c, least, equal), F.concat("role", F.lit(f":{name}"))) for name, c, least, equal in FLAGS)))
    return stats.withColumn("_f", made).groupBy("inn").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_f")))).alias("flags"), F.max("history_risk").alias("max_history_risk"))


def recent_risky(txns: DataFrame, inn: str, limit: int = KnowledgeBase.recent) -> DataFrame:
    """A party's riskiest transactions, as payer or payee."""
    mine = txns.where((F.col("debit_inn") == inn) | (F.col("credit_inn") == inn))
    role = F.when(F.col("debit_inn") == inn, "debit").otherwise("credit")
    return mine.orderBy(F.desc_nulls_last("txn_risk_score"), F.desc("date"), "txn_id").limit(limit).select(
        "txn_id", "date", role.alias("role"), F.when(role == "debit", F.col("credit_inn")).otherwise(F.col("debit_inn")).alias("counterparty"), "amount", "txn_risk_score", "overall_risk"
    )


def entity_view(txns: DataFrame, stats: DataFrame, inn: str, limit: int = KnowledgeBase.recent) -> DataFrame:
    """One row: the party, its profiles, flags, highest history risk and riskiest transactions."""
    own = stats.where(F.col("inn") == inn)
    return own.groupBy("inn").agg(F.collect_list(F.struct(*(c for c in stats.columns if c != "inn"))).alias("profiles")).join(entity_flags(own), "inn").crossJoin(
        recent_risky(txns, inn, limit).agg(F.collect_list(F.struct("txn_id", "date", "role", "counterparty", "amount", "txn_risk_score", "overall_risk")).alias("recent"))
    )


def review_flags(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` with the review flags of both parties and whether any is set."""
    for role in ("debit", "credit"):
        own = E.cut(stats.where(F.col("role") == role).select(F.col("inn").alias(f"{role}_inn"), F.col("cp_review_flag").alias(f"review_{role}")))
        df = E.with_lookup(df, own, f"{role}_inn").na.fill(0, [f"review_{role}"])
    return df.withColumn("review_any", F.greatest("review_debit", "review_credit"))


#: what profiles look at
SIDE = ("role", "inn", "txn_id", "partner", "fan", "date", "amount", "overall_risk", "txn_risk_score", "in_out_ratio_30d", "purpose_clean", "purpose_stopword_high", "semantic_risk_score", "ts_anomaly_score_txn", "graph_node_score", "graph_edge_score")
KEYS = {"txns": ["txn_id"], "sides": ["inn", "role", "txn_id"], "stats": ["inn", "role"]}
_PARTS = "name string, bucket int, folder string, risk double, known long"


class Store:
    """Transactions, their sides by party, and profiles, each in ``buckets`` parts by hash of the first of its keys, under one folder that Spark reads and writes.

    A version is a list of the folders that hold the parts.  A write reads and rewrites only parts that its rows fall in: those of its ids, to find what it overwrites, and those of the
    parties it touches, whose profiles are computed from their sides anew (exact quantiles and withdrawn rows need all values of a party, not all parties).
    The mean risk of all rows comes from a sum and a count for each part.

    Writers don't wait for each other.  Each prepares folders of its own and then puts its version's file in place, which fails if there is one of that number (atomic where
    renaming without overwriting is, as in HDFS); the writer then starts again from the version that was faster.  The last ``keep`` versions stay readable."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 3, tries: int = 10):
        self.spark, self.path, self.buckets, self.keep, self.tries = spark, path.rstrip("/"), buckets, keep, tries
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        return [p.getPath().getName() for p in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[8:]) for n in self._names() if n.startswith("version-"))

    def _parts(self, version: int) -> dict[str, dict[int, tuple]]:
        """bucket -> folder, sum of risks, number of known risks; for each table."""
        out: dict[str, dict[int, tuple]] = {n: {} for n in KEYS}
        name = self.spark.read.text(f"{self.path}/version-{version}").first()[0]
        for r in self.spark.read.schema(_PARTS).parquet(f"{self.path}/{name}").collect():  # a row for each part
            out[r["name"]][r["bucket"]] = (r["folder"], r["risk"], r["known"])
        return out

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> tuple[DataFrame, DataFrame] | None:
        """Transactions and profiles of the last version, or None."""
        versions = self._versions()
        if not versions:
            return None
        parts = self._parts(versions[-1])
        return self._open(parts["txns"].values()), self._open(parts["stats"].values())

    def _open(self, parts: Iterable[tuple]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{p[0]}" for p in parts))

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _touched(self, keys: DataFrame, name: str) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(KEYS[name][0])).distinct().collect())  # buckets at most

    def _replace(self, name: str, old: dict[int, tuple], fresh: DataFrame, folder: str, gone: DataFrame | None = None) -> dict[int, tuple]:
        """New folders for the parts with rows of ``fresh`` or keys in ``gone``: the old rows but for those with these keys, and the fresh ones."""
        keys = fresh.select(*KEYS[name]) if gone is None else fresh.select(*KEYS[name]).unionByName(gone.select(*KEYS[name]))
        touched = self._touched(keys, name)
        again = [old[b] for b in touched if b in old]
        both = fresh.withColumn("_state", F.lit(2))
        if again:
            both = self._open(again).withColumn("_state", F.lit(0)).unionByName(both)
            both = both if gone is None else both.unionByName(gone.select(*KEYS[name], F.lit(1).alias("_state")), allowMissingColumns=True)
        dealt = both.withColumns({"bucket": self._bucket(KEYS[name][0]), "_slot": F.pmod(F.shiftright(F.xxhash64(*KEYS[name]), 32), F.lit(4))})
        ids = [c for c in ("txn_id",) if c in KEYS[name]]
        dealt = dealt.withColumns({c: E.packed_id(F.col(c)) for c in ids}).repartition("bucket", "_slot")
        if again:  # the rows of a key are together where they are dealt to: fresh ones win, those that are gone win over old ones
            dealt = dealt.withColumn("_top", F.max("_state").over(Window.partitionBy("bucket", "_slot", *KEYS[name]))).where("_state = _top and _state <> 1").drop("_top")
        dealt = dealt.withColumns({c: E.unpacked_id(F.col(c)) for c in ids}).drop("_slot", "_state")
        with E.freeing(self.spark):
            dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = {int(p.getPath().getName()[7:]): p.getPath().getName() for p in self._fs.listStatus(self._at(folder)) if p.getPath().getName().startswith("bucket=")}
        out = {b: p for b, p in old.items() if b not in touched} | {b: (f"{folder}/{n}", None, None) for b, n in made.items()}
        if name == "txns" and made:
            sums = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("bucket").agg(F.sum("overall_risk").alias("risk"), F.count("overall_risk").alias("known"))
            out |= {r["bucket"]: (f"{folder}/{made[r['bucket']]}", r["risk"], r["known"]) for r in sums.collect()}
        if not out:  # an empty table has a folder, too
            fresh.limit(0).write.parquet(f"{self.path}/{folder}/none")
            out = {-1: (f"{folder}/none", None, None)}
        return out

    def write(self, txns: DataFrame, profile: Callable[[DataFrame, DataFrame], DataFrame] = side_profiles) -> None:
        """Upsert projected transactions; ``profile`` (sides of the touched parties, mean risk of all rows) gives their profiles."""
        with E.scratch():
            self._write(txns, profile)

    def _write(self, txns: DataFrame, profile: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        if "_seq" in txns.columns:
            txns = keep_last(txns, "txn_id", "_seq").drop("_seq")
        txns = E.cut(txns)
        if not txns.limit(1).count():
            return
        for _ in range(self.tries):
            version = max(self._versions(), default=0) + 1
            tag = f"{version}-{uuid.uuid4().hex}"
            parts = self._changed(txns, self._parts(version - 1) if version > 1 else {n: {} for n in KEYS}, tag, profile)
            rows = [(n, b, *p) for n, of in parts.items() for b, p in of.items()]
            self.spark.createDataFrame(rows, _PARTS).coalesce(1).write.parquet(f"{self.path}/list-{tag}")
            if self._commit(version, f"list-{tag}"):
                self._clean(version)
                return
            for name in self._names():  # another writer was faster
                if name.endswith(tag):
                    self._fs.delete(self._at(name), True)
        raise RuntimeError(f"other writers were faster {self.tries} times")

    def _changed(self, txns: DataFrame, old: dict[str, dict[int, tuple]], tag: str, profile: Callable[[DataFrame, DataFrame], DataFrame]) -> dict[str, dict[int, tuple]]:
        mine = [old["txns"][b] for b in self._touched(txns, "txns") if b in old["txns"]] if old["txns"] else []
        # only the parties of what is overwritten matter
        replaced = E.cut(self._open(mine).select("txn_id", "debit_inn", "credit_inn").join(txns.select("txn_id").hint("shuffle_hash"), "txn_id", "left_semi")) if mine else None
        fresh = sides(txns).select(*SIDE)
        gone = None if replaced is None else replaced.select("txn_id", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"{r}_inn").alias("inn")) for r in ("debit", "credit")))).alias("s")).select("txn_id", "s.*").where("inn is not null")
        parts = {"txns": self._replace("txns", old["txns"], txns, f"txns-{tag}"), "sides": self._replace("sides", old["sides"], fresh, f"sides-{tag}", gone)}
        touched = affected(txns) if replaced is None else affected(txns).union(affected(replaced)).distinct()
        touched = E.cut(touched)
        known = [parts["sides"][b] for b in self._touched(touched, "sides") if b in parts["sides"]]
        risk, n = (sum(p[k] or 0 for p in parts["txns"].values()) for k in (1, 2))
        overall = self.spark.createDataFrame([(risk / n if n else None,)], "_all double")
        long = (self._open(known) if known else fresh.limit(0)).join(touched, "inn", "left_semi")
        stats = E.cut(profile(long, overall).withColumn("updated_at", F.current_timestamp().cast("string")))
        both = touched.crossJoin(self.spark.createDataFrame([("debit",), ("credit",)], "role string"))  # two rows
        parts["stats"] = self._replace("stats", old["stats"], stats, f"stats-{tag}", both)
        return parts

    def _commit(self, version: int, name: str) -> bool:
        """Put the version's file in place; False if there is one already."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft = self._at(f"draft-{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(name, "ascii"))
        out.close()
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, self._at(f"version-{version}"), never)
            return True
        except Py4JJavaError as e:
            if not self._fs.exists(self._at(f"version-{version}")):
                raise
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(draft, False)
            return False

    def _clean(self, version: int) -> None:
        """Remove versions before the last ``keep`` ones, and folders of their time that no later version names.  What other writers prepare has a higher number."""
        kept = [v for v in self._versions() if v > version - self.keep]
        used = {p[0].partition("/")[0] for v in kept for of in self._parts(v).values() for p in of.values()} | {self.spark.read.text(f"{self.path}/version-{v}").first()[0] for v in kept}
        for name in self._names():
            kind, _, rest = name.partition("-")
            number = rest.partition("-")[0]
            if name not in used and (kind in KEYS or kind in ("list", "version")) and int(number) <= version - self.keep:
                self._fs.delete(self._at(name), True)
