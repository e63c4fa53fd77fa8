"""Reports: the enriched ledger and reviews as CSV or JSON lines; Excel workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.sources.workbook import write_workbooks

# The columns of a report
REPORT_COLUMNS = ("txn_id", "date", "amount", "debit_inn", "credit_inn", "purpose", "overall_risk", "risk_level", "llm_risk_level", "legal_characterization", "risk_explanation", "recommendation", "notes_for_audit")


def report(df: DataFrame) -> DataFrame:
    """The report's columns that are there, highest risk first, then highest amount."""
    risk = F.coalesce(F.col("overall_risk"), F.lit(-1.0)) if "overall_risk" in df.columns else F.lit(-1.0)
    return df.select(*(c for c in REPORT_COLUMNS if c in df.columns), risk.alias("_risk")).orderBy(F.desc("_risk"), F.desc("amount"), "txn_id").drop("_risk")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_excel(df: DataFrame, path: str, limit: int = 1_000_000) -> list[str]:
    """A report as workbooks in a folder; more than ``limit`` rows are refused, not cut."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows; write CSV or JSON instead")
    return write_workbooks(df, path)
