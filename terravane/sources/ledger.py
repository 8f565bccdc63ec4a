"""Ledger of ingested datasets: an append-only table of status records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Life cycle of a dataset.
STATUSES = ("PENDING", "DOWNLOADING", "DOWNLOADED", "VALIDATED", "PARSED", "FAILED")


def unregistered(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Datasets the ledger does not know yet."""
    return candidates.join(ledger.select("dataset_id"), "dataset_id", "left_anti")


def current(ledger: DataFrame) -> DataFrame:
    """Latest record of every dataset; ``sequence`` breaks ties of the same time."""
    facts = [c for c in ledger.columns if c != "dataset_id"]
    return (
        ledger.groupBy("dataset_id")
        .agg(F.max_by(F.struct(*facts), F.struct("recorded_at", "sequence")).alias("_r"))
        .select("dataset_id", "_r.*")
    )


def to_ingest(ledger: DataFrame) -> DataFrame:
    """Datasets not parsed yet, or failed."""
    return current(ledger).where(F.col("status") != "PARSED")


def by_provider(latest: DataFrame) -> DataFrame:
    return latest.groupBy("provider").agg(
        F.count(F.lit(1)).alias("datasets"),
        F.countDistinct("product").alias("products"),
        F.sum("file_size").alias("bytes"),
    )


def by_status(latest: DataFrame) -> DataFrame:
    return latest.groupBy("status").agg(F.count(F.lit(1)).alias("datasets"))


def repeated(latest: DataFrame) -> DataFrame:
    """The same granule of the same product registered more than once."""
    return (
        latest.groupBy("provider", "product", "coverage_start", "granule_id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
