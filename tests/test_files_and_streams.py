import datetime as dt
import json

from pyspark.sql import functions as F

from tessera.operators import lifecycle
from tessera.sources import files, sinks
from tessera.streaming import events as stream


def test_event_files(spark, tmp_path):
    e = {"application_no": "2024/1", "event_type": "transfer", "details": {"b": "2", "a": "1"}}
    (tmp_path / "a.json").write_text(json.dumps({"status": "success", "source_type": "GZ", "gazette_no": "12", "events": [e, {**e, "details": {"a": "1", "b": "2"}}, {**e, "page_number": 3}, {"event_type": "x"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"status": "failed", "events": [e]}))
    (tmp_path / "c.json").write_text(json.dumps({"status": "success"}))
    got = files.event_files(spark, str(tmp_path)).collect()
    assert len(got) == 3 and {r.bulletin_no for r in got} == {"12"} and len({r.event_fingerprint for r in got}) == 2


def test_metadata_csv_and_log(spark, tmp_path):
    rec = lambda name: {"APPLICATIONNO": "2020/5", "STATUS": "s", "TRADEMARK": {"NAME": name, "NICECLASSES_LIST": ["9", "35"]}, "HOLDERS": [{"TITLE": "ACME (77)"}]}
    (tmp_path / "m.json").write_text(json.dumps([rec("first"), rec("şekil second")]))
    r = files.metadata_files(spark, str(tmp_path / "m.json")).first()
    assert (r.name, r.classes, r.client_id) == ("second", [9, 35], "77")
    (tmp_path / "u.csv").write_text("Marka Adı,Nice Sınıflar,x\nKuzey,9;35,1\n")
    r = files.uploaded_csv(spark, str(tmp_path / "u.csv")).first()
    assert (r.name, r.classes, r.application_no) == ("Kuzey", [9, 35], None)
    (tmp_path / "db.log").write_text("INSERT INTO T VALUES(1,'it''s, ok',NULL)\nSET X\nINSERT INTO T VALUES(2,'',3)\n")
    t = files.insert_log(spark, str(tmp_path / "db.log"), {"t": ["a", "b", "c"]})["t"].orderBy("a").collect()
    assert [tuple(r) for r in t] == [("1", "it's, ok", None), ("2", "", "3")]


def test_folders_and_salvage(spark, tmp_path):
    for folder in ("GZ_1", "BLT_2"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "events.json").write_text(json.dumps({"status": "success", "events": [{"application_no": folder, "event_type": "transfer"}]}))
        (tmp_path / folder / "metadata.json").write_text(json.dumps([{"APPLICATIONNO": folder, "STATUS": "s"}])[: None if folder == "GZ_1" else 20])
    assert {r.application_no for r in files.event_files(spark, str(tmp_path / "*" / "events.json"), "GZ").collect()} == {"GZ_1"}
    made = spark.createDataFrame([("BLT_2", "b", "s", "n", [1], "h", "7"), ("GZ_1", "no", "s", "n", [1], "h", "7")], "folder string, application_no string, status string, name string, classes array<int>, holder string, client_id string")
    assert {r.application_no for r in files.salvaged_metadata(spark, str(tmp_path / "*" / "metadata.json"), made).collect()} == {"GZ_1", "b"}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, [i, 9], f"n,{i}") for i in range(9)], "id int, classes array<int>, name string")
    sinks.export_csv(df, str(tmp_path / "c"), [F.desc("id")], 2)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == [("8", "8;9", "n,8"), ("7", "7;9", "n,7")]
    sinks.reload(df, str(tmp_path / "t"))
    sinks.reload(df.limit(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_incremental_fold_equals_full(spark, sf, tmp_path):
    kind = lifecycle._lookup({"signup": "renewal", "purchase": "transfer", "error": "seizure", "view": "restriction_lift", "click": "cancellation"}, F.col("event_type"))
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("application_no"), kind.alias("event_type"), F.lit("x").alias("event_subtype"), F.lit("H").alias("new_value"), F.col("ts").cast("date").alias("bulletin_date"), F.col("ts").alias("created_at"), F.col("event_id").alias("id")
    )
    source = str(tmp_path / "in")
    for part in range(3):  # the last part repeats the first and holds late events
        e.where(F.col("id") % 2 == part if part < 2 else F.col("id") < 50).coalesce(1).write.mode("append").parquet(source)
    events = stream.event_stream(spark, source, e.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), 1)
    stream.start_fold(events, str(tmp_path / "store"), str(tmp_path / "states"), str(tmp_path / "check")).awaitTermination(120)
    got = stream.current_states(spark, str(tmp_path / "states"))
    full = lifecycle.trademark_fold(e)
    assert sorted(map(str, got.select(full.columns).collect())) == sorted(map(str, full.collect()))
    stream.compact_states(spark, str(tmp_path / "states"), str(tmp_path / "compact"))
    assert sorted(map(str, stream.current_states(spark, str(tmp_path / "compact")).select(full.columns).collect())) == sorted(map(str, full.collect()))


def test_keyed_fold_equals_one_fold_over_all(spark, tmp_path):
    """Late, repeated and disordered batches, a restart between them, and the states of one fold over everything."""
    shape = "application_no bigint, event_type string, event_subtype string, new_value string, bulletin_date date, created_at timestamp, id bigint"
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    kinds = ["renewal", "transfer", "seizure", "restriction_lift", "cancellation"]
    rows = [(i % 7, kinds[i % 5], "court" if i % 9 == 0 else "x", f"H{i % 3}" if i % 4 else None, day(i * 37 % 200) if i % 11 else None, dt.datetime(2024, 1, 1, i % 24), i) for i in range(120)]
    whole = spark.createDataFrame(rows, shape)
    source, states, check = (str(tmp_path / n) for n in ("in", "states", "check"))
    for part in ("id % 3 = 2", "id % 3 = 0 or id < 20", "id % 3 = 1 or id > 100"):
        whole.where(part).coalesce(1).write.mode("append").parquet(source)
        events = stream.event_stream(spark, source, shape, 1)
        stream.start_keyed_fold(events, states, check).awaitTermination(240)
    got, full = stream.current_states(spark, states), lifecycle.trademark_fold(whole)
    assert sorted(map(str, got.select(full.columns).collect())) == sorted(map(str, full.collect()))


def test_streaming_windows(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    events = stream.event_stream(spark, str(tmp_path / "in"), "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    q = stream.windowed_counts(stream.deduplicated(events, ["event_id"], "ts"), "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("w").count() > 0
