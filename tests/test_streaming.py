from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from terravane.operators.windows import SeriesKey, decayed_index, streak
from terravane.sources import writers
from terravane.streaming import jobs


def test_running_series_survives_restarts_and_equals_the_batch_result(spark, rows, tmp_path):
    """Nulls, NaN, days out of order and given twice, over three restarts."""
    schema, nan = "cell long, day date, rain double", float("nan")
    day = lambda n: date(2024, 1, 1) + timedelta(days=n)
    amount = lambda c, d: None if (d + c) % 6 == 1 else nan if d % 9 == 5 else float((d * 7 + c) % 10)
    every = [(c, day(d), amount(c, d)) for c in (1, 2, 3) for d in range(24)]
    parts = [[r for i, r in enumerate(every) if (i * 5) % 8 in kinds] for kinds in ((0, 1, 2), (3,), (4, 5), (6, 7))]
    parts[2] += [(1, day(2), 99.0), (4, day(3), None)]
    parts[3] += [(4, day(1), 8.0), (4, day(5), 2.0), (4, day(7), 4.0)]
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in parts:
        rows(schema, *part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.files(spark, source, rows(schema, every[0]).schema)
        series = jobs.running_series(stream, "cell", "day", "rain", 5.0, 0.3)
        got = jobs.newest(jobs.once(series, table, checkpoint, jobs.KEYED_STATE), "cell", "day")
    given = rows(schema, *[r for part in parts for r in part])
    tidy = given.withColumn("rain", F.when(~F.isnan("rain"), F.col("rain"))).groupBy("cell", "day").agg(F.min("rain").alias("rain"))
    key = SeriesKey(("cell",), "day")
    runs = streak(tidy, key, {"wet_streak": F.col("rain") >= 5})
    batch = decayed_index(runs, key, "rain", 0.3, "wetness")
    shown = lambda frame: {
        (r.cell, r.day): (r.rain, r.wet_streak, r.wetness if r.wetness is None else round(r.wetness, 9)) for r in frame.collect()
    }
    assert shown(got) == shown(batch) and len(shown(got)) == 24 * 3 + 4
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != list(jobs.KEYED_STATE.values())[0]


def test_late_rows_and_duplicates(spark, rows, tmp_path):
    schema = "id string, ts timestamp, v double"
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    first = [("a", datetime(2024, 1, 1, 3), 1.0), ("a", datetime(2024, 1, 1, 4), 1.0), ("b", datetime(2024, 1, 5), 2.0)]
    second = [("late", datetime(2024, 1, 1, 5), 9.0), ("c", datetime(2024, 1, 9), 3.0)]
    for part in (first, second):
        rows(schema, *part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.files(spark, source, rows(schema, first[0]).schema)
        daily = jobs.daily(stream, [], "ts", "1 hour", [F.sum("v").alias("total")])
        got = jobs.once(daily, table, checkpoint)
    # the first day was closed before the late row came; the last day is still open
    assert {(str(r.valid_date), r.total) for r in got.collect()} == {("2024-01-01", 2.0), ("2024-01-05", 2.0)}
    unique = jobs.unique_by_id(jobs.files(spark, source, rows(schema, first[0]).schema), "id", "ts", "2 days")
    kept = jobs.once(unique, str(tmp_path / "u"), str(tmp_path / "uc"))
    assert sorted(r.id for r in kept.collect()) == ["a", "b", "c", "late"]


def test_append_new_adds_each_id_once(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    assert writers.append_new(rows("id int, v int", (1, 1), (1, 2), (2, 1)), path, "id", ["v"]) == 2
    assert writers.append_new(rows("id int, v int", (2, 9), (3, 1)), path, "id", ["v"]) == 1
    assert writers.append_new(rows("id int, v int", (3, 9)), path, "id", ["v"]) == 0
    assert {(r.id, r.v) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 1), (3, 1)}
    units = str(tmp_path / "u")
    for batch in ([("a", 1, 1), ("b", 1, 1)], [("a", 1, 2), ("a", 2, 1)]):
        writers.append_new(rows("unit string, id int, v int", *batch), units, "id", ["v"], "unit")
    assert spark.read.parquet(units).count() == 3


def test_a_unit_may_come_in_several_batches(spark, rows, tmp_path):
    source, table, book = (str(tmp_path / n) for n in ("in", "t", "l"))
    schema = "unit string, _row_id long, v int"
    expected = rows("unit string, rows long", ("u1", 3), ("u2", 1))
    parts = ([("u1", 1, 1), ("u1", 2, 1)], [("u1", 3, 1), ("u1", 2, 9), ("u2", 4, 1)], [("u1", 5, 1), ("u2", 4, 2)])
    for number, part in enumerate(parts):
        rows(schema, *part).write.mode("append").parquet(source)
        stream = jobs.files(spark, source, rows(schema, part[0]).schema)
        work = jobs.ingest_units("unit", ["v"], table, book, expected)
        jobs.once_per_batch(stream, work, str(tmp_path / "c"))
    stored = spark.read.schema(rows(schema, parts[0][0]).schema).parquet(table)
    # u1 was complete with its third row; the repeat of row 2 and all of the last batch are left out
    assert sorted((r.unit, r._row_id, r.v) for r in stored.collect()) == [("u1", 1, 1), ("u1", 2, 1), ("u1", 3, 1), ("u2", 4, 1)]
    jobs.ingest_units("unit", ["v"], table, book)(rows(schema, ("u1", 5, 1)), 9)
    assert stored.sparkSession.read.schema(stored.schema).parquet(table).count() == 5


class Crash(Exception):
    pass


@pytest.mark.parametrize("written", [False, True])
@pytest.mark.parametrize("step", [1, 2, 3])
def test_a_crash_at_any_step_doubles_and_loses_nothing(spark, rows, tmp_path, monkeypatch, step, written):
    """The batch dies before or after its intent, data or commit is written, and is run again."""
    table, book = str(tmp_path / "t"), str(tmp_path / "l")
    schema = "unit string, _row_id long, v int"
    first = rows(schema, ("u1", 1, 1), ("u1", 2, 1), ("u2", 3, 1))
    work = jobs.ingest_units("unit", ["v"], table, book, rows("unit string, rows long", ("u1", 2), ("u2", 1)))
    calls, plain = [], jobs._append

    def failing(*arguments):
        calls.append(arguments)
        if len(calls) == step and not written:
            raise Crash
        plain(*arguments)
        if len(calls) == step:
            raise Crash

    monkeypatch.setattr(jobs, "_append", failing)
    with pytest.raises(Crash):
        work(first, 0)
    monkeypatch.setattr(jobs, "_append", plain)
    for number in (0, 1):
        work(first, number)
    stored = spark.read.schema(schema).parquet(table)
    assert sorted((r.unit, r._row_id, r.v) for r in stored.collect()) == [("u1", 1, 1), ("u1", 2, 1), ("u2", 3, 1)]
    state = jobs.ledger_state(spark.read.schema(f"unit string, {jobs.ENTRY}").parquet(book), "unit")
    assert sorted((r.unit, r.phase, r.rows) for r in state.collect()) == [("u1", 1, 2), ("u2", 1, 1)]


def test_freshness_of_more_batches_than_spark_remembers(spark, rows, tmp_path):
    source = str(tmp_path / "in")
    days = [(i, datetime(2024, 1, 1) + timedelta(hours=(i * 37) % 130)) for i in range(130)]
    rows("id int, ts timestamp", *days).repartition(130, "id").write.option("maxRecordsPerFile", 1).parquet(source)
    stream = jobs.files(spark, source, rows("id int, ts timestamp", days[0]).schema, per_batch=1)
    found = jobs.freshness(stream, "ts", str(tmp_path / "c"), str(tmp_path / "b"))
    totals = found.agg(F.count("batch").alias("n"), F.sum("rows").alias("rows"), F.max("newest_us").alias("us")).first()
    assert totals["n"] >= 130 and totals["rows"] == 130
    assert totals["us"] == (datetime(2024, 1, 1) + timedelta(hours=129)).replace(tzinfo=timezone.utc).timestamp() * 1e6


def test_running_series_asks_the_state_once(spark):
    """Three calls to the state per cell in order, and columns that come out typed."""
    import pandas as pd

    calls, kept = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def done(*given):
                calls.append((self.name, call))
                if call in ("update", "appendList"):
                    kept[self.name] = given[0]
                return kept.get(self.name)

            return done

    series = jobs.RunningSeries("day", "value", 5.0, 0.3)
    series.last, series.days = State("last"), State("days")
    for first in (1, 3):
        part = pd.DataFrame({"day": [date(2024, 1, first), date(2024, 1, first + 1)], "value": [6.0, None]})
        (frame,) = series.handleInputRows((7,), iter([part]), None)
    assert calls == [("last", "get"), ("days", "appendList"), ("last", "update")] * 2
    assert [str(t) for t in frame.dtypes[2:]] == ["float64", "int32", "float64", "int32"]
    assert frame["wet_streak"].tolist() == [1, 0] and frame["revision"].tolist() == [2, 2]
