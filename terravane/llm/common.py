"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.session import prepare, run_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the parquet tables of a folder."""
    prepare(spark)
    # texts may be long: batches sent to Python stay small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(frame: DataFrame, label: str) -> DataFrame:
    """Write to a new place in the shared folder and read back: a lost executor repeats no earlier work."""
    place = run_folder(frame.sparkSession, label)
    frame.write.parquet(place)
    return frame.sparkSession.read.schema(frame.schema).parquet(place)


def ascii_lower(text: Column | str) -> Column:
    """A-Z in lower case, every other character as it is; null becomes empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet, whatever extra columns it carries."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
