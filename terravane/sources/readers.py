"""Readers for the layers, feeds and exports the jobs start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terravane import contracts


def yearly(
    spark: SparkSession,
    root: str,
    first: int,
    last: int,
    columns: Sequence[str] | None = None,
    day: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Rows of a ``year=`` partitioned table; the year condition prunes folders, the range rows."""
    frame = spark.read.parquet(root).where(F.col("year").between(first, last))
    if day is not None:
        frame = frame.where(F.col(day).between(start, end))
    return frame.select(*columns) if columns else frame


def by_suffix(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet or headed CSV, by the ending of the path."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"neither parquet nor csv: {path}")


def dimension(spark: SparkSession, path: str, schema: str, key: Sequence[str]) -> DataFrame:
    """A headed CSV registry with a unique key, sorted by it."""
    frame = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    contracts.assert_unique_key(contracts.assert_no_nulls(frame, key), key)
    return frame.orderBy(*key)


# Column order of the public event export, version 2.
EXPORT_COLUMNS = (
    "GLOBALEVENTID", "SQLDATE", "MonthYear", "Year", "FractionDate",
    "Actor1Code", "Actor1Name", "Actor1CountryCode", "Actor1KnownGroupCode", "Actor1EthnicCode",
    "Actor1Religion1Code", "Actor1Religion2Code", "Actor1Type1Code", "Actor1Type2Code", "Actor1Type3Code",
    "Actor2Code", "Actor2Name", "Actor2CountryCode", "Actor2KnownGroupCode", "Actor2EthnicCode",
    "Actor2Religion1Code", "Actor2Religion2Code", "Actor2Type1Code", "Actor2Type2Code", "Actor2Type3Code",
    "IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode", "QuadClass", "GoldsteinScale",
    "NumMentions", "NumSources", "NumArticles", "AvgTone",
    "Actor1Geo_Type", "Actor1Geo_FullName", "Actor1Geo_CountryCode", "Actor1Geo_ADM1Code", "Actor1Geo_ADM2Code",
    "Actor1Geo_Lat", "Actor1Geo_Long", "Actor1Geo_FeatureID",
    "Actor2Geo_Type", "Actor2Geo_FullName", "Actor2Geo_CountryCode", "Actor2Geo_ADM1Code", "Actor2Geo_ADM2Code",
    "Actor2Geo_Lat", "Actor2Geo_Long", "Actor2Geo_FeatureID",
    "ActionGeo_Type", "ActionGeo_FullName", "ActionGeo_CountryCode", "ActionGeo_ADM1Code", "ActionGeo_ADM2Code",
    "ActionGeo_Lat", "ActionGeo_Long", "ActionGeo_FeatureID",
    "DATEADDED", "SOURCEURL",
)


def export_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of headerless export files: source_file, value, the fields, and why it is rejected.

    A line without tabs but with commas is read as comma separated; missing fields at the end are
    null.  ``reject_reason`` is null for accepted lines, one per id and file, the smallest of its lines.
    """
    names = StructType([StructField(name, StringType()) for name in EXPORT_COLUMNS])
    ddl = ", ".join(f"{name} STRING" for name in names.fieldNames())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    comma = ~F.contains("value", F.lit("\t"))
    parsed = lines.withColumn(
        "_row",
        F.when(comma, F.from_csv("value", ddl, {"sep": ","})).otherwise(F.from_csv("value", ddl, {"sep": "\t"})),
    )
    identity = F.col("GLOBALEVENTID")
    # quoted commas are no separators, so only a line that the fields do not fill up can be too long
    fields = F.size(F.split("value", F.lit("\t")))
    judged = parsed.select("source_file", "value", "_row.*").withColumn(
        "reject_reason",
        F.when(F.trim("value") == "", "empty line")
        .when(fields > len(EXPORT_COLUMNS), "too many fields")
        .when(identity.isNull(), "no id")
        .when(identity == "GLOBALEVENTID", "header")
        .when(identity == "0", "id 0"),
    )
    same = Window.partitionBy("source_file", "GLOBALEVENTID", F.col("reject_reason").isNull()).orderBy("value")
    repeated = F.col("reject_reason").isNull() & (F.row_number().over(same) > 1)
    return judged.withColumn("reject_reason", F.when(repeated, "repeated id").otherwise(F.col("reject_reason")))


def event_export(spark: SparkSession, path: str) -> DataFrame:
    """The accepted rows of headerless export files, all text, one per id and file."""
    return export_lines(spark, path).where("reject_reason IS NULL").drop("value", "reject_reason")


def export_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are no rows: source_file, value, reject_reason; with the rows, all lines."""
    return export_lines(spark, path).where("reject_reason IS NOT NULL").select("source_file", "value", "reject_reason")


def file_index(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Lines of size, md5 and URL; keeps files with the suffix and a 14-digit time stamp."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.size(parts) == 3)
    rows = lines.select(
        F.element_at(parts, 1).try_cast("long").alias("size_bytes"),
        F.element_at(parts, 2).alias("md5"),
        F.element_at(parts, 3).alias("url"),
    ).withColumn("filename", F.element_at(F.split("url", "/"), -1))
    stamped = rows.where(F.endswith("url", F.lit(suffix))).withColumn(
        "stamp", F.regexp_extract("filename", r"^(\d{14})\.", 1)
    )
    valid = stamped.where("stamp <> ''")
    time = F.try_to_timestamp("stamp", F.lit("yyyyMMddHHmmss"))
    return valid.withColumn("time", time).withColumns(
        {"year": F.substring("stamp", 1, 4).cast("int"), "month": F.substring("stamp", 5, 2).cast("int")}
    )


def work_queue(index: DataFrame, first: int, last: int, months: Sequence[int]) -> DataFrame:
    """Files of the wanted years and months in time order."""
    return index.where(F.col("year").between(first, last) & F.col("month").isin(*months)).orderBy(
        "stamp", "url"
    )


def queue_size(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("total_bytes"))


def granule_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a granule search: id, times and the data link; an entry without id is an error.

    The data link is the first secure link whose relation ends with ``/data#``.
    """
    schema = (
        "feed STRUCT<entry: ARRAY<STRUCT<id: STRING, title: STRING, time_start: STRING, time_end: STRING, "
        "links: ARRAY<STRUCT<rel: STRING, href: STRING, title: STRING>>>>>"
    )
    entries = spark.read.schema(schema).json(path).select(F.explode("feed.entry").alias("e"))
    data = F.filter(
        "e.links",
        lambda l: F.endswith(F.coalesce(l["rel"], F.lit("")), F.lit("/data#"))
        & F.startswith(F.coalesce(l["href"], F.lit("")), F.lit("https://")),
    )
    identity = F.when(F.length("e.id") > 0, F.col("e.id")).otherwise(
        F.raise_error(F.lit("granule without id"))
    )
    return entries.select(
        identity.alias("granule_id"),
        F.col("e.time_start").cast("timestamp").alias("start_time"),
        F.col("e.time_end").cast("timestamp").alias("end_time"),
        F.get(data, F.lit(0))["href"].alias("data_url"),
    )


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of FeatureCollection files: properties and polygons as nested arrays.

    ``properties`` is the DDL of the properties object.  Polygon and MultiPolygon both
    become ``array<polygon>``.
    """
    schema = f"features ARRAY<STRUCT<properties: STRUCT<{properties}>, geometry: STRING>>"
    rows = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(path)
        .select(F.explode("features").alias("f"))
        .select("f.properties.*", F.col("f.geometry").alias("_g"))
    )
    kind = F.get_json_object("_g", "$.type")
    coordinates = F.get_json_object("_g", "$.coordinates")
    ring = "ARRAY<ARRAY<DOUBLE>>"
    single = F.array(F.from_json(coordinates, f"ARRAY<{ring}>"))
    many = F.from_json(coordinates, f"ARRAY<ARRAY<{ring}>>")
    polygons = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", many)
    points = F.transform(
        polygons,
        lambda p: F.transform(
            p, lambda r: F.transform(r, lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat")))
        ),
    )
    return rows.withColumn("geometry", points).drop("_g")
