"""Alerts with memory, versions, keyed tables and the idempotent sink, through stops, restarts and replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casewright.functions.columns import unused
from casewright.operators.numbering import number_rows
from casewright.sources import store
from casewright.streaming import stateful

KIND = "key long, owner long, due date, open boolean, ts timestamp"
START = dt.datetime(2024, 3, 1)


def events(seed, first_day, last_day, n=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        ts = START + dt.timedelta(minutes=rnd.randint(first_day * 1440, last_day * 1440 - 1))
        out.append((rnd.randint(1, 12), rnd.choice([1, 2, None]), rnd.choice([None, (START + dt.timedelta(days=rnd.randint(-1, 8))).date()]), rnd.random() < 0.75, ts))
    return out


def by_days(rows, last):
    """The rule itself, day by day."""
    out = []
    for key in {r[0] for r in rows} - {None}:
        for d in range(-2, 40):
            day = START + dt.timedelta(days=d)
            before = [r for r in rows if r[0] == key and r[4] is not None and r[4] <= day]
            if day > last or not before:
                continue
            _, owner, due, open_, _ = max(before, key=lambda r: (r[4], not r[3], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or dt.date.min))
            if open_ and owner is not None and due is not None and (due - day.date()).days <= 3:
                left = (due - day.date()).days
                out.append((key, owner, day.date(), left, {0: "vence hoy o vencida", 1: "vence mañana"}.get(max(left, 0), "vence en 3 días")))
    return sorted(out)


def test_daily_alerts_equal_the_rule(spark):
    rows = events(1, 0, 9) + [(1, 1, START.date(), True, START), (1, 2, START.date(), True, START), (2, 1, START.date(), True, START), (2, 1, START.date(), False, START), (None, 1, START.date(), True, START), (3, 1, START.date(), True, None)]
    got = stateful.daily_alerts(spark.createDataFrame(rows, KIND), "2024-03-11")
    assert sorted(map(tuple, got.collect())) == by_days(rows, dt.datetime(2024, 3, 11)) != []
    assert stateful.daily_alerts(spark.createDataFrame([], KIND), "2024-03-11").count() == 0


def test_stream_of_alerts_equals_the_batch_job_over_a_restart(spark, tmp_path):
    """Three days of input, in any order within the delay, with a stop after the second; a last event moves the watermark on."""
    days = [events(k + 5, k, k + 1) for k in range(3)]
    late = [r for r in days[1] if r[4] < START + dt.timedelta(days=1, hours=6)]
    days[1] = [r for r in days[1] if r not in late]
    parts = [days[0], days[1], days[2] + late, [(99, None, None, False, START + dt.timedelta(days=9))], [(98, None, None, False, START + dt.timedelta(days=9, hours=1))]]

    def run(some):
        for k in some:
            spark.createDataFrame(parts[k], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
            q = stateful.alerts_with_memory(stream, "2 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()

    run([0, 1])
    run([2, 3, 4])
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    every = [r for p in parts for r in p]
    assert sorted(got) == by_days(every, START + dt.timedelta(days=6, hours=23)) != []
    assert len({(g[0], g[2]) for g in got}) == len(got)


def test_versions_are_whole_or_absent(spark, tmp_path):
    folder = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        store.read_version(spark, folder)
    first = store.write_version(spark.range(10).toDF("x"), folder, {"silhouette": "0.4"})
    reading = store.read_version(spark, folder)
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        store.write_version(broken, folder)
    assert store.current_version(spark, folder)["about"] == {"silhouette": "0.4"} and store.read_version(spark, folder).count() == 10
    second = store.write_version(spark.range(5).toDF("x"), folder)
    assert first < second and reading.count() == 10 and store.read_version(spark, folder).count() == 5 and store.read_version(spark, folder, first).count() == 10
    for n in range(3):
        store.write_version(spark.range(n).toDF("x"), folder)
    assert store.read_version(spark, folder).count() == 2 and len(list((tmp_path / "table/versions").iterdir())) == 6
    assert sum(any(d.iterdir()) for d in (tmp_path / "table/versions").iterdir()) == 2


def files_of(path):
    return {str(f.relative_to(path)) for f in path.rglob("part-*.parquet")}


def test_upsert_rewrites_touched_parts_only(spark, tmp_path):
    table = store.KeyedTable(spark, str(tmp_path / "cases"), "docket", 16)
    table.create(spark.createDataFrame([(f"d{k}", k, "Pendiente", "keep") for k in range(200)], "docket string, n int, state string, note string"))
    before = table.pointer()["parts"]
    changes = spark.createDataFrame([("d3", 33, "Respondida"), ("new", 1, "Pendiente"), (None, 1, "x"), ("d4", 4, "Pendiente")], "docket string, n int, state string")
    assert table.apply(changes, 1, ["n", "state"])
    after = table.pointer()["parts"]
    assert 1 <= sum(after[p] != before.get(p) for p in after) <= 3 and {p for p in before if before[p] == after[p]}
    rows = {r["docket"]: tuple(r)[1:] for r in table.read().collect()}
    assert len(rows) == 201 and rows["d3"] == (33, "Respondida", "keep") and rows["new"] == (1, "Pendiente", None) and rows["d5"] == (5, "Pendiente", "keep")
    audit = {tuple(r) for r in table.read_audit().select("batch", "docket", "column", "before", "after").collect()}
    assert audit == {(1, "d3", "n", "3", "33"), (1, "d3", "state", "Pendiente", "Respondida"), (1, "new", "n", None, "1"), (1, "new", "state", None, "Pendiente")}
    # the same batch again changes nothing; the next one works on
    assert not table.apply(spark.createDataFrame([("d3", 0, "x")], "docket string, n int, state string"), 1, ["n", "state"])
    assert table.apply(changes.limit(0), 2, ["n"]) and table.pointer()["parts"] == after
    table.clean()
    assert table.read().count() == 201


def test_a_batch_that_stops_half_way_is_repeated_in_whole(spark, tmp_path, monkeypatch):
    table = store.KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    table.create(spark.createDataFrame([(k, "old") for k in range(20)], "k long, v string"))
    changes = spark.createDataFrame([(1, "new"), (50, "new")], "k long, v string")
    with monkeypatch.context() as m:
        m.setattr(store, "_replace", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.apply(changes, 1, ["v"])
    assert table.read().where("v = 'new'").count() == 0 == table.read_audit().count() and table.read().count() == 20
    assert table.apply(changes, 1, ["v"])
    assert table.read().where("v = 'new'").count() == 2 == table.read_audit().count() and table.read().count() == 21


def test_stream_into_a_keyed_table_equals_the_latest_state(spark, tmp_path):
    kind = "key long, state string, ts timestamp"
    rnd = random.Random(3)
    parts = [[(rnd.randint(1, 9), rnd.choice("abc"), START + dt.timedelta(minutes=100 * k + j)) for j in range(40)] for k in range(3)]
    table = store.KeyedTable(spark, str(tmp_path / "t"), "key", 4)
    table.create(spark.createDataFrame([], kind))
    write, seen = store.upsert_sink(table, ["state", "ts"], "ts"), []

    def killed_once(batch, number):
        if number == 1 and 1 not in seen:
            seen.append(1)
            write(batch, number)
            raise RuntimeError("killed after the write, before the stream knows")
        write(batch, number)

    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
            q = stream.writeStream.foreachBatch(killed_once).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
                break
            except Exception as stopped:
                assert "killed" in str(stopped)
    newest = {}
    for k, state, ts in sorted((r for p in parts for r in p), key=lambda r: r[2]):
        newest[k] = (state, ts)
    assert {r["key"]: (r["state"], r["ts"]) for r in table.read().collect()} == newest and seen == [1]
    assert {r["batch"] for r in table.read_audit().collect()} <= {1, 2, 3}


def test_numbers_in_order(spark, monkeypatch):
    rows = [(rnd % 3 if rnd % 7 else None, rnd * 37 % 1000) for rnd in range(1000)]
    df = spark.createDataFrame(rows, "g int, x int")
    got = sorted((r["x"], r["n"]) for r in number_rows(df, ["x"], position="n").collect())
    assert got == [(k, k) for k in range(1000)]
    by = {}
    for g, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        by.setdefault(g, []).append(x)
    from casewright.operators import numbering

    monkeypatch.setattr(numbering, "FEW", 0)
    grouped = number_rows(df, ["x"], ["g"], "n", "size").collect()
    assert len(grouped) == 1000 and all(by[r["g"]][r["n"]] == r["x"] and r["size"] == len(by[r["g"]]) for r in grouped)
    assert number_rows(df.limit(0), ["x"], position="n").count() == 0
    assert unused(df, "g", "G", "new") == ["g_", "G__", "new"]
