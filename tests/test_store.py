"""Events as a browser's runtime writes them, ingest that a retry can't double, and changes by bucket."""

import json
import random

import pytest
from pyspark.sql import functions as F

from inkstone.functions import json_text
from inkstone.operators import behaviour
from inkstone.sources.store import Store
from inkstone.streaming import events

BODY = "batch_id string, body string, user_id string, user_agent string, created_at long"


def test_numbers_and_texts_as_a_browser_writes_them():
    shown = {0.0: "0", -0.0: "0", 1.0: "1", 1e3: "1000", 1.5: "1.5", -2.25: "-2.25", 1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", 1e-6: "0.000001", 1e-7: "1e-7", 1.25e-9: "1.25e-9", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 0.1: "0.1", 100.125: "100.125"}
    assert {x: json_text.number(x) for x in shown} == shown
    assert json_text.write(json_text.read('{"b":1.0,"10":[],"9":{},"a":"\\u4e00\\u0001\\ud800\\"","b":null}')) == '{"9":{},"10":[],"b":null,"a":"一\\u0001\\ud800\\""}'
    assert json_text.write(json_text.read("12345678901234567890")) == "12345678901234567000" and json_text.write(json_text.read("1" * 400)) == "null"
    for bad in ("NaN", "[1] x", "[1,]", "{'a':1}", "", "[" * 100_000):
        with pytest.raises(ValueError):
            json_text.read(bad)
    rng = random.Random(1)
    for _ in range(500):
        x = rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300)
        assert float(json_text.number(x)) == x


def stored(spark, *bodies):
    rows = spark.createDataFrame([(str(i), b, None, None, 1) for i, b in enumerate(bodies)], BODY)
    return [(r.batch_id, r.id, r.event, r.session_id, r.extra_json) for r in behaviour.expand_batches(rows).orderBy("id").collect()]


def test_bodies(spark):
    assert stored(spark, '[{"event":"share"}] trailing', "[" + ",".join(['{"event":"share"}'] * 51) + "]", '[{"event":"nope"}]') == []
    assert stored(spark, '﻿[{"event":"share","extra":"abc"},7,{"event":"share","extra":"0"},{"event":"share","extra":0.0}]') == [("0", "0:0", "share", None, '"abc"'), ("0", "0:2", "share", None, '"0"'), ("0", "0:3", "share", None, None)]
    assert stored(spark, '[{"event":"nope","event":"search","sessionId":"\\ud800x","extra":{"a":1.0}}]') == [("0", "0:0", "search", "�x", '{"a":1}')]
    assert stored(spark, '{"events":{},"events":[{"event":"share","extra":[]},{"event":"share","extra":{}}]}') == [("0", "0:0", "share", None, "[]"), ("0", "0:1", "share", None, "{}")]


def test_a_failed_micro_batch_is_stored_once(spark, tmp_path, monkeypatch):
    """The writer fails behind the write; the next start runs the same batch again."""
    rows = [(f"b{i}", json.dumps([{"event": "share"}, {"event": "search"}]), None, None, i) for i in range(20)]
    spark.createDataFrame(rows, BODY).write.parquet(f"{tmp_path}/in")
    write, fails = behaviour.append_events, [True]

    def failing(*args):
        write(*args)
        if fails and fails.pop():
            raise RuntimeError("lost")

    monkeypatch.setattr(events, "append_events", failing)
    start = lambda: events.ingest(spark.readStream.schema(BODY).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    with pytest.raises(Exception, match="lost"):
        start()
    assert behaviour.stored_events(spark, f"{tmp_path}/out").count() == 40
    start()
    found = behaviour.stored_events(spark, f"{tmp_path}/out")
    assert (found.count(), found.select("id").distinct().count()) == (40, 40)
    spark.createDataFrame([("new", '[{"event":"share"}]', None, None, 1)], BODY).write.mode("append").parquet(f"{tmp_path}/in")
    start()
    assert behaviour.stored_events(spark, f"{tmp_path}/out").count() == 41


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_change_writes_the_folders_of_its_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("user_id"), F.lit("b").alias("book_id"), F.lit("old").alias("data_json"), F.lit(1).cast("long").alias("updated_at"))
    store.save_progress(rows)
    before = files(tmp_path / "reading_progress")
    one = rows.where("user_id = '77'").withColumns({"data_json": F.lit("new"), "updated_at": F.lit(2).cast("long")})
    store.save_progress(one.unionByName(rows.where("user_id = '77'")))
    after = files(tmp_path / "reading_progress")
    assert len({f.parent for f in before.keys() ^ after.keys()}) == 1 and len({f.parent for f in after}) == 8
    assert [r.data_json for r in store.read_key("reading_progress", "77").collect()] == ["new"]
    found = store.read("reading_progress")
    assert (found.count(), found.where("data_json = 'new'").count()) == (20_000, 1)
    store.save_progress(rows.limit(0))
    assert files(tmp_path / "reading_progress") == after


def test_users_are_found_by_any_spelling(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "id string, email string, name string, created_at long"
    store.insert_users(spark.createDataFrame([("1", " A@x.Org　", " n ", 1), ("2", "a@X.org", None, 2)], schema))
    store.insert_users(spark.createDataFrame([("3", "A@X.ORG", "m", 3), ("4", "b@x.org", "", 4)], schema))
    assert sorted(map(tuple, store.read("users").collect())) == [("1", "a@x.org", "n", 1), ("4", "b@x.org", None, 4)]
    assert [r.id for r in behaviour.user_by_email(store.read("users"), " A@x.org ").collect()] == ["1"]


def test_jobs_keep_their_source_and_take_patches(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    job = "id string, book_id string, block_id string, type string, source_text string, status string, error string, prompt string, image_url string, created_at long, updated_at long"
    store.insert_jobs(spark.createDataFrame([(str(i), f"b{i % 5}", f"k{i}", "scene", f"text {i}", "pending", None, "p", None, i, i) for i in range(20)], job))
    store.insert_jobs(spark.createDataFrame([("x", "b0", "k0", "scene", "y", "done", None, "p", None, 99, 99)], job))
    patch = "job_id string, patch_id long, at long, status string, error string, image_url string"
    store.patch_jobs(spark.createDataFrame([("7", 1, 50, "done", None, "/i"), ("7", 2, 60, None, "e", None), ("none", 1, 1, "done", None, None)], patch))
    rows = {r.id: r for r in store.read("illustration_jobs").collect()}
    assert len(rows) == 20 and (rows["7"].status, rows["7"].error, rows["7"].image_url, rows["7"].source_text, rows["7"].updated_at) == ("done", "e", "/i", "text 7", 60)
    assert rows["8"].status == "pending"
