"""Queries that write tables with Spark, read them back or stream them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.functions import geometry
from terravane.plans.bindings import (
    DISTRICTS_SQL,
    READINGS_SQL,
    STATION_DAYS_SQL,
    cell_latitude,
    cell_longitude,
    districts,
    readings,
    station_days,
)
from terravane.plans.registry import query, tidy, tidy_sql
from terravane.plans.spatial import POLYGONS_SQL, polygons
from terravane.session import run_folder
from terravane.sources import ledger, readers, writers
from terravane.streaming import jobs


@query(
    "yearly_partition_scan",
    "S1 S2 S3 S12 S13",
    f"""WITH {STATION_DAYS_SQL} SELECT station, CAST(valid_date AS VARCHAR) AS valid_date, precipitation FROM station_days
    WHERE year(valid_date) BETWEEN 1997 AND 1999 AND valid_date BETWEEN DATE '1997-03-10' AND DATE '1999-06-20'""",
)
def yearly_partition_scan(t):
    path = writers.yearly(station_days(t), run_folder(t.spark, "station-days"), "valid_date")
    rows = readers.yearly(
        t.spark, path, 1997, 1999, ["station", "valid_date", "precipitation"], "valid_date",
        F.lit("1997-03-10").cast("date"), F.lit("1999-06-20").cast("date"),
    )
    return rows.withColumn("valid_date", F.col("valid_date").cast("string"))


@query(
    "csv_dimension_scan",
    "S4 S6 S14",
    f"WITH {DISTRICTS_SQL} SELECT state, district, latitude, longitude FROM districts",
)
def csv_dimension_scan(t):
    path = run_folder(t.spark, "places") + ".csv"
    writers.csv(districts(t).select("state", "district", "latitude", "longitude"), path)
    return readers.dimension(
        t.spark, path, "state STRING, district STRING, latitude DOUBLE, longitude DOUBLE", ["state", "district"]
    )


@query(
    "event_export_scan",
    "S5",
    """SELECT CAST(doc_id AS VARCHAR) AS event_key, '2024010' || (doc_id % 9 + 1) AS sql_date, lang AS action_geo, 'http://' || source AS source_url FROM documents WHERE doc_id <> 0""",
)
def event_export_scan(t):
    key = F.col("doc_id")
    filled = {
        "GLOBALEVENTID": key.cast("string"),
        "SQLDATE": F.concat(F.lit("2024010"), key % 9 + 1),
        "ActionGeo_FullName": F.col("lang"),
        "SOURCEURL": F.concat(F.lit("http://"), F.col("source")),
    }
    fields = [filled.get(name, F.lit("")) for name in readers.EXPORT_COLUMNS]
    tabbed = t.documents.select(F.concat_ws("\t", *fields).alias("value"))
    # every fourth document also arrives twice, every fifth line is comma separated
    mixed = t.documents.select(
        key, F.when(key % 5 == 0, F.concat_ws(",", *fields)).otherwise(F.concat_ws("\t", *fields)).alias("value")
    )
    again = mixed.where(key % 4 == 0)
    header = tabbed.limit(1).select(F.lit("\t".join(readers.EXPORT_COLUMNS)).alias("value"))
    path = run_folder(t.spark, "export")
    lines = mixed.unionByName(again).select("value").unionByName(header)
    lines.write.text(path)
    rows = readers.event_export(t.spark, path)
    # ids repeat across part files here, as they do across export files
    return rows.select(
        F.col("GLOBALEVENTID").alias("event_key"),
        F.col("SQLDATE").alias("sql_date"),
        F.col("ActionGeo_FullName").alias("action_geo"),
        F.col("SOURCEURL").alias("source_url"),
    ).distinct()


@query(
    "export_line_outcomes",
    "S5",
    """SELECT 'accepted' AS outcome, count(*) AS lines FROM documents WHERE doc_id <> 0 UNION ALL SELECT 'repeated id', count(*) FROM documents WHERE doc_id % 4 = 0 AND doc_id <> 0
    UNION ALL SELECT 'too many fields', count(*) FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'id 0', count(*) * 2 FROM documents WHERE doc_id = 0
    UNION ALL SELECT 'empty line', count(*) FROM documents WHERE doc_id % 11 = 0""",
)
def export_line_outcomes(t):
    key, last = F.col("doc_id"), len(readers.EXPORT_COLUMNS) - 2
    line = F.concat_ws("\t", key.cast("string"), F.col("lang"), *[F.lit("")] * last)
    lines = F.array_compact(
        F.array(
            line,
            F.when(key % 4 == 0, line),
            F.when(key % 7 == 0, F.concat_ws("\t", line, F.lit("one"), F.lit("more"))),
            F.when(key % 11 == 0, F.lit("")),
        )
    )
    path = run_folder(t.spark, "export-lines")
    # all lines of an id stand in one file
    t.documents.repartition("doc_id").select(F.explode(lines).alias("value")).write.text(path)
    outcome = F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    return readers.export_lines(t.spark, path).groupBy(outcome).agg(F.count(F.lit(1)).alias("lines"))


INDEX_SQL = """idx AS (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS size_bytes, strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || '1500' AS stamp,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders WHERE o_orderkey % 3 <> 0)"""


def _index(t):
    stamp = F.concat(
        F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("1500")
    )
    kind = F.when(F.col("o_orderkey") % 3 == 0, ".mentions.CSV.zip").otherwise(".export.CSV.zip")
    line = F.concat_ws(
        " ", F.rint("o_totalprice").cast("long"), F.md5(F.col("o_orderkey").cast("string")),
        F.concat(F.lit("http://files.example/v2/"), stamp, kind),
    )
    path = run_folder(t.spark, "index")
    t.orders.select(line.alias("value")).write.text(path)
    return readers.file_index(t.spark, path, ".export.CSV.zip")


@query(
    "file_index_rows",
    "S9",
    f"WITH {INDEX_SQL.replace('CAST(o_totalprice AS BIGINT)', 'CAST(round_even(o_totalprice, 0) AS BIGINT)')} SELECT stamp, md5(CAST(o_orderkey AS VARCHAR)) AS md5, size_bytes, year, month, CAST(epoch(strptime(stamp, '%Y%m%d%H%M%S')) AS BIGINT) AS epoch_s FROM idx",
)
def file_index_rows(t):
    return _index(t).select("stamp", "md5", "size_bytes", "year", "month", F.unix_timestamp("time").alias("epoch_s"))


@query(
    "work_queue_size",
    "S10",
    f"WITH {INDEX_SQL.replace('CAST(o_totalprice AS BIGINT)', 'CAST(round_even(o_totalprice, 0) AS BIGINT)')} SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM idx WHERE year BETWEEN 1996 AND 1999 AND month IN (6, 7, 8, 9)",
)
def work_queue_size(t):
    return readers.queue_size(readers.work_queue(_index(t), 1996, 1999, [6, 7, 8, 9]))


@query(
    "granule_feed_rows",
    "S19",
    """SELECT 'G' || page_id AS granule_id, CAST(epoch(TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(page_id % 100 AS INTEGER)) AS BIGINT) AS start_s, CASE WHEN page_id % 4 <> 0 THEN 'https://data.example/' || page_id END AS data_url FROM pages""",
)
def granule_feed_rows(t):
    key = F.col("page_id")

    def link(rel: str, href):
        return F.struct(F.lit(rel).alias("rel"), href.alias("href"), F.lit("x").alias("title"))

    secure = F.when(key % 4 != 0, "https://data.example/").otherwise("ftp://data.example/")
    entry = F.struct(
        F.concat(F.lit("G"), key).alias("id"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key % 100).cast("int")), "yyyy-MM-dd'T'00:00:00.000'Z'").alias("time_start"),
        F.lit("2024-12-31T00:00:00.000Z").alias("time_end"),
        F.array(
            link("http://esip/browse#", F.lit("https://browse.example/")),
            link("http://esip/data#", F.concat(secure, key)),
        ).alias("links"),
    )
    pages_of_ten = t.pages.groupBy(F.floor(key / 10).alias("n")).agg(F.collect_list(entry).alias("entry"))
    path = run_folder(t.spark, "granules")
    pages_of_ten.select(F.to_json(F.struct(F.struct("entry").alias("feed"))).alias("value")).write.text(path)
    rows = readers.granule_feed(t.spark, path)
    return rows.select("granule_id", F.unix_timestamp("start_time").alias("start_s"), "data_url")


@query(
    "geojson_features",
    "S8",
    f"WITH {POLYGONS_SQL} SELECT district, 2 AS rings, x0 AS west, y0 AS south, x0 + 2 AS east, y0 + 2 AS north FROM polygons",
)
def geojson_features(t):
    coordinates = F.transform(
        F.element_at("geometry", 1),
        lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"])),
    )
    odd = F.col("district_id") % 2 == 1
    body = F.when(odd, F.to_json(F.array(coordinates))).otherwise(F.to_json(coordinates))
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"district":"'), F.col("district"), F.lit('"},"geometry":{"type":"'),
        F.when(odd, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), body, F.lit("}}"),
    )
    # collections of at most fifty features, one per line
    files = polygons(t).groupBy(F.floor(F.col("district_id") / 50).alias("n")).agg(F.collect_list(feature).alias("f"))
    path = run_folder(t.spark, "geojson")
    line = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("f", ","), F.lit("]}"))
    # one collection per file, as the sources deliver them
    count = max(1, files.count())
    files.select(line.alias("value")).repartitionByRange(count, "value").write.text(path)
    rows = readers.features(t.spark, path, "district: STRING")
    box = geometry.bounding_box("geometry")
    return rows.select("district", F.size(F.element_at("geometry", 1)).alias("rings"), box.alias("b")).select("district", "rings", "b.*")


@query(
    "run_summary",
    "S15",
    "SELECT count(*) AS rows, count(DISTINCT user_id) AS cells, count(*) FILTER (event_type = 'error') AS errors FROM events",
)
def run_summary(t):
    measures = [
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("user_id").alias("cells"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    ]
    return writers.run_summary(t.events, run_folder(t.spark, "summary"), measures)


@query(
    "append_new_ids",
    "S16",
    "SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1 UNION ALL SELECT l_orderkey, min(l_partkey) FROM lineitem GROUP BY 1 HAVING min(l_linenumber) > 3",
)
def append_new_ids(t):
    path = run_folder(t.spark, "upsert")
    # units of orders: the second run reads the stored ids of its own units only
    unit = (F.col("l_orderkey") % 8).cast("string").alias("unit")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", unit)
    first, every = rows.where("l_linenumber <= 3").drop("l_linenumber"), rows.drop("l_linenumber")
    for part in (first, every):
        writers.append_new(part, path, "l_orderkey", ["l_partkey"], "unit")
    return t.spark.read.schema(every.schema).parquet(path).drop("unit")


def ledger_rows(t):
    """Orders as status records: one dataset per customer, one record per order."""
    o = t.orders
    statuses = F.array(*[F.lit(s) for s in ledger.STATUSES])
    return o.select(
        F.col("o_custkey").alias("dataset_id"),
        F.concat(F.lit("provider"), F.floor(F.col("o_custkey") / 100)).alias("provider"),
        F.concat(F.lit("product"), F.col("o_custkey") % 7).alias("product"),
        F.concat(F.lit("granule"), F.floor(F.col("o_custkey") / 2)).alias("granule_id"),
        F.lit("2024-01-01").alias("coverage_start"),
        F.element_at(statuses, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("status"),
        F.rint("o_totalprice").cast("long").alias("file_size"),
        F.col("o_orderdate").alias("recorded_at"),
        F.col("o_orderkey").alias("sequence"),
    )


LEDGER_SQL = """ledger AS (SELECT o_custkey AS dataset_id, 'provider' || (o_custkey // 100) AS provider, 'product' || (o_custkey % 7) AS product, 'granule' || (o_custkey // 2) AS granule_id,
  ['PENDING', 'DOWNLOADING', 'DOWNLOADED', 'VALIDATED', 'PARSED', 'FAILED'][CAST(o_orderkey % 6 + 1 AS INTEGER)] AS status, CAST(round_even(o_totalprice, 0) AS BIGINT) AS file_size, o_orderkey, o_orderdate FROM orders),
latest AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


@query("ledger_latest_status", "S18", f"WITH {LEDGER_SQL} SELECT dataset_id, status, file_size FROM latest WHERE status <> 'PARSED'")
def ledger_latest_status(t):
    return ledger.to_ingest(ledger_rows(t)).select("dataset_id", "status", "file_size")


@query("ledger_unregistered", "S18", "SELECT c_custkey AS dataset_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000.5)")
def ledger_unregistered(t):
    return ledger.unregistered(t.customer.select(F.col("c_custkey").alias("dataset_id")), ledger_rows(t).where("file_size > 400000"))


@query(
    "ledger_by_provider",
    "A33",
    f"WITH {LEDGER_SQL} SELECT provider, count(*) AS datasets, count(DISTINCT product) AS products, CAST(sum(file_size) AS BIGINT) AS bytes FROM latest GROUP BY 1",
)
def ledger_by_provider(t):
    return ledger.by_provider(ledger.current(ledger_rows(t)))


@query("ledger_by_status", "A33", f"WITH {LEDGER_SQL} SELECT status, count(*) AS datasets FROM latest GROUP BY 1")
def ledger_by_status(t):
    return ledger.by_status(ledger.current(ledger_rows(t)))


@query(
    "ledger_repeated_granules",
    "A33",
    f"WITH {LEDGER_SQL.replace('o_custkey % 7', 'o_custkey // 14')} SELECT provider, product, '2024-01-01' AS coverage_start, granule_id, count(*) AS copies FROM latest GROUP BY ALL HAVING count(*) > 1",
)
def ledger_repeated_granules(t):
    rows = ledger_rows(t).withColumn("product", F.concat(F.lit("product"), F.floor(F.col("dataset_id") / 14)))
    return ledger.repeated(ledger.current(rows))


def event_stream(t):
    # a pattern, so that one file and a folder of files are both followed
    raw = jobs.files(t.spark, f"{t.folder}/event[s].parquet", t.events.schema)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def folders(t, label):
    base = run_folder(t.spark, label)
    return f"{base}/table", f"{base}/checkpoint"


@query(
    "stream_incremental_ingest",
    "R1",
    "SELECT event_id, user_id, value FROM events WHERE value > 25",
)
def stream_incremental_ingest(t):
    table, checkpoint = folders(t, "ingest")
    rows = event_stream(t).where("value > 25").select("event_id", "user_id", "value")
    jobs.once(rows, table, checkpoint)
    # a second run finds nothing new and adds nothing
    again = event_stream(t).where("value > 25").select("event_id", "user_id", "value")
    return jobs.once(again, table, checkpoint)


@query(
    "stream_ledger_ingest",
    "R2",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS unit, count(*) AS rows, count(*) AS ledger_rows, 'struct<unit:string,_row_id:bigint,value:double>' AS schema, 1 AS phase FROM events GROUP BY 1",
)
def stream_ledger_ingest(t):
    base = run_folder(t.spark, "units")
    table, book = f"{base}/table", f"{base}/ledger"
    rows = event_stream(t).select(
        F.to_date("ts").cast("string").alias("unit"), F.col("event_id").alias("_row_id"), "value"
    )
    expected = t.events.groupBy(F.to_date("ts").cast("string").alias("unit")).agg(F.count(F.lit(1)).alias("rows"))
    work = jobs.ingest_units("unit", ["value"], table, book, expected)
    jobs.once_per_batch(rows, work, f"{base}/first")
    # the same input through a new checkpoint: full units are skipped by schema and count
    jobs.once_per_batch(rows, work, f"{base}/second")
    stored = t.spark.read.schema(rows.schema).parquet(table).groupBy("unit").agg(F.count(F.lit(1)).alias("rows"))
    state = jobs.ledger_state(t.spark.read.schema(f"unit STRING, {jobs.ENTRY}").parquet(book), "unit")
    return stored.join(state.withColumnRenamed("rows", "ledger_rows"), "unit").select(
        "unit", "rows", "ledger_rows", "schema", "phase"
    )


@query(
    "stream_final_before_late",
    "R3",
    f"""WITH {READINGS_SQL}, f AS (SELECT latitude, longitude, valid_date, sum(value) AS v FROM readings WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3),
    l AS (SELECT latitude, longitude, valid_date, sum(value) AS v FROM readings WHERE event_type = 'purchase' GROUP BY 1, 2, 3)
    SELECT latitude, longitude, CAST(valid_date AS VARCHAR) AS valid_date, {tidy_sql('v')} AS precipitation, 'FINAL' AS product FROM f
    UNION ALL SELECT latitude, longitude, CAST(valid_date AS VARCHAR), {tidy_sql('v')}, 'LATE' FROM l ANTI JOIN f USING (latitude, longitude, valid_date)""",
)
def stream_final_before_late(t):
    keys = ["latitude", "longitude", "valid_date"]

    def product(kinds, label):
        table, checkpoint = folders(t, label)
        rows = event_stream(t).where(F.col("event_type").isin(*kinds)).select(
            cell_latitude("user_id").alias("latitude"), cell_longitude("user_id").alias("longitude"), F.to_date("ts").alias("valid_date"), "value"
        )
        return jobs.once(rows, table, checkpoint).groupBy(*keys).agg(F.sum("value").alias("precipitation"))

    merged = jobs.prefer_final(product(["view", "click"], "final"), product(["purchase"], "late"), keys)
    return merged.select(
        "latitude", "longitude", F.col("valid_date").cast("string").alias("valid_date"),
        tidy("precipitation").alias("precipitation"), "product",
    )


@query(
    "stream_unique_ids",
    "R4",
    "SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
)
def stream_unique_ids(t):
    table, checkpoint = folders(t, "unique")
    keyed = event_stream(t).select(
        F.concat_ws("/", "user_id", "event_type", F.to_date("ts")).alias("id"),
        "user_id", "event_type", F.to_date("ts").cast("string").alias("day"), "ts",
    )
    rows = jobs.unique_by_id(keyed, "id", "ts", "40 days")
    return jobs.once(rows, table, checkpoint).select("user_id", "event_type", "day")


@query(
    "stream_daily_resample",
    "R5",
    f"""SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS valid_date, {tidy_sql('sum(value)')} AS total, count(*) AS readings FROM events
    WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY user_id, CAST(ts AS DATE)""",
)
def stream_daily_resample(t):
    table, checkpoint = folders(t, "daily")
    rows = jobs.daily(
        event_stream(t), ["user_id"], "ts", "2 hours",
        [F.sum("value").alias("total"), F.count(F.lit(1)).alias("readings")],
    )
    out = jobs.once(rows, table, checkpoint)
    return out.select("user_id", F.col("valid_date").cast("string").alias("valid_date"), tidy("total").alias("total"), "readings")


@query(
    "stream_sliding_week",
    "R6",
    f"""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2), k AS (SELECT DISTINCT event_type, CAST(unnest(generate_series(day, day + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS last_date FROM d)
    SELECT k.event_type, CAST(last_date AS VARCHAR) AS last_date, {tidy_sql('sum(v)')} AS week_total FROM k JOIN d ON d.event_type = k.event_type AND d.day BETWEEN last_date - 6 AND last_date
    WHERE last_date + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
)
def stream_sliding_week(t):
    table, checkpoint = folders(t, "week")
    rows = jobs.sliding(event_stream(t), ["event_type"], "ts", "1 hour", 7, [F.sum("value").alias("week_total")])
    out = jobs.once(rows, table, checkpoint)
    return out.select("event_type", F.col("last_date").cast("string").alias("last_date"), tidy("week_total").alias("week_total"))


@query(
    "stream_dry_spells",
    "R7",
    """WITH d AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE value < 20),
    e AS (SELECT *, sum(CASE WHEN gap <= INTERVAL 2 DAY THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS spell FROM d)
    SELECT user_id, count(*) AS readings, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM e GROUP BY user_id, spell
    HAVING max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE value < 20)""",
)
def stream_dry_spells(t):
    table, checkpoint = folders(t, "spells")
    rows = jobs.spells(
        event_stream(t).where("value < 20"), ["user_id"], "ts", "1 hour", 2, [F.count(F.lit(1)).alias("readings")]
    )
    out = jobs.once(rows, table, checkpoint)
    return out.select(
        "user_id", "readings", F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us")
    )


@query(
    "stream_running_series",
    "R8",
    f"""WITH RECURSIVE d AS (SELECT user_id AS cell, CAST(ts AS DATE) AS day, sum(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS rn FROM events GROUP BY user_id, CAST(ts AS DATE)),
    w AS (SELECT cell, day, rn, v, CAST(v >= 60 AS INTEGER) AS s, v AS y FROM d WHERE rn = 1
      UNION ALL SELECT d.cell, d.day, d.rn, d.v, CASE WHEN d.v >= 60 THEN w.s + 1 ELSE 0 END, 0.2::DOUBLE * d.v + 0.8::DOUBLE * w.y FROM w JOIN d ON d.cell = w.cell AND d.rn = w.rn + 1)
    SELECT cell, CAST(day AS VARCHAR) AS day, s AS wet_streak, {tidy_sql('y')} AS wetness FROM w""",
)
def stream_running_series(t):
    source = run_folder(t.spark, "cell-days")
    days = t.events.groupBy(F.col("user_id").alias("cell"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("rain"))
    table, checkpoint = folders(t, "series")
    # two runs: every third day of a cell comes after the days that follow it
    for late in (False, True):
        part = days.where((F.dayofyear("day") % 3 == 0) == F.lit(late))
        writers.snapshot(part, f"{source}/late={int(late)}")
        stream = jobs.files(t.spark, f"{source}/*", days.schema)
        series = jobs.running_series(stream, "cell", "day", "rain", 60.0, 0.2)
        stored = jobs.once(series, table, checkpoint, jobs.KEYED_STATE)
    out = jobs.newest(stored, "cell", "day")
    return out.select("cell", F.col("day").cast("string").alias("day"), "wet_streak", tidy("wetness").alias("wetness"))


@query(
    "stream_freshness",
    "R9",
    "SELECT count(*) AS rows, CAST(epoch_us(max(ts)) AS BIGINT) AS newest_us, CAST(max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 36 HOUR AS INTEGER) AS stale FROM events",
)
def stream_freshness(t):
    base = run_folder(t.spark, "fresh")
    batches = jobs.freshness(event_stream(t), "ts", f"{base}/checkpoint", f"{base}/batches")
    limit = F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp") - F.expr("INTERVAL 36 HOURS"))
    return batches.agg(F.sum("rows").alias("rows"), F.max("newest_us").alias("newest_us")).withColumn(
        "stale", (F.col("newest_us") < limit).cast("int")
    )


@query(
    "stream_alert_join",
    "R10",
    "SELECT e.event_id, CASE WHEN s.s_acctbal > 5000 THEN 'ACTIVE' WHEN s.s_suppkey IS NOT NULL THEN 'QUIET' ELSE 'UNAVAILABLE' END AS alert FROM events e LEFT JOIN supplier s ON s.s_suppkey = e.user_id",
)
def stream_alert_join(t):
    alerts = t.supplier.select(
        F.col("s_suppkey").alias("user_id"), F.when(F.col("s_acctbal") > 5000, "ACTIVE").otherwise("QUIET").alias("alert")
    )
    table, checkpoint = folders(t, "alerts")
    rows = jobs.against_alerts(event_stream(t).select("event_id", "user_id"), alerts, ["user_id"], F.lit("UNAVAILABLE"))
    return jobs.once(rows, table, checkpoint).select("event_id", "alert")
