"""Ledgers: one row for each transfer from a payer (debit) to a payee (credit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.exprs import number, python_number
from riskflow.sources.workbook import read_workbook

# Which files are statements
PATTERNS = ("*.csv", "*.xlsx", "*.xls", "*.parquet")


def discover_statement(spark: SparkSession, path: str | None = None, patterns: tuple[str, ...] = PATTERNS) -> str:
    """``path`` if it is a file (or a folder with the name of one), else the first match in name order in the folder (the current one by default), in any store that
    Spark reads."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(path or ".")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(base) and (fs.getFileStatus(base).isFile() or base.getName().endswith((".parquet", ".csv"))):
        return str(base)
    found = sorted({str(f.getPath()) for p in patterns for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, p)) or ()})
    if not found:
        raise FileNotFoundError(f"no statement in {base}")
    return found[0]


def load_statement(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A statement by its suffix: CSV with a header, Excel (first sheet) or Parquet.  ``path`` may be
    anything Spark reads, folders included.  The old binary workbooks (xls) need pandas with a reader for them, on the driver."""
    low = path.lower()
    if low.endswith(".xlsx"):
        return read_workbook(spark, path)
    if low.endswith(".xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    if low.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path)


def synthetic_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order tables as a ledger; columns that begin with ``x_`` stand in for layer scores in tests of the fusion."""
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    price = cents.cast("double") / 100
    refund = F.col("l_returnflag") == "R"
    day = F.to_date("l_shipdate")
    return joined.select(
        F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day.cast("string"), cents.cast("string")), 256).alias("txn_id"),
        day.alias("date"),
        F.col("o_custkey").cast("string").alias("debit_inn"),
        F.col("l_suppkey").cast("string").alias("credit_inn"),
        F.when(~refund, price).alias("debit_amount"),
        F.when(refund, price).alias("credit_amount"),
        F.concat_ws(" ", "p_name", "p_type", "o_orderpriority").alias("purpose"),
        F.col("l_quantity").cast("long").alias("x_quantity"),
        F.round(F.col("l_discount") * 100).cast("long").alias("x_discount"),
        F.round(F.col("l_tax") * 100).cast("long").alias("x_tax"),
        F.col("l_partkey").alias("x_part"),
        F.col("l_linenumber").cast("long").alias("x_line"),
    )


def txn_hash(day: Column, debit: Column, credit: Column, amount: Column, purpose: Column) -> Column:
    """SHA-256 of the day (with midnight), the three amounts and the purpose, joined by two bars; nulls are ``nan``."""
    stamp = F.coalesce(F.concat(day.cast("string"), F.lit(" 00:00:00")), F.lit("NaT"))
    return F.sha2(F.concat_ws("||", stamp, python_number(debit), python_number(credit), python_number(amount), F.coalesce(purpose, F.lit("nan"))), 256)


def prepare(df: DataFrame) -> DataFrame:
    """Days as dates, amounts as numbers (unparseable: null, then 0), ``amount`` = debit or else credit amount unless it is there
    already, ids as text, a transaction id if there is none."""
    debit, credit = number(df, "debit_amount"), number(df, "credit_amount")
    amount = number(df, "amount") if "amount" in df.columns else F.coalesce(debit, credit)
    out = df.withColumns({"date": F.to_date("date"), "_d": debit, "_c": credit, "amount": F.coalesce(amount, F.lit(0.0))})
    out = out.withColumns({"debit_amount": F.coalesce("_d", F.lit(0.0)), "credit_amount": F.coalesce("_c", F.lit(0.0)), "debit_inn": F.col("debit_inn").cast("string"), "credit_inn": F.col("credit_inn").cast("string")}).drop("_d", "_c")
    if "txn_id" not in df.columns:
        out = out.withColumn("txn_id", txn_hash(F.col("date"), F.col("debit_amount"), F.col("credit_amount"), F.col("amount"), F.col("purpose")))
    return out
