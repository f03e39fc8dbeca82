"""Repeats that come long after the first, and after a restart."""

import datetime

from voxgrain.sources import files as fl
from voxgrain.streaming import posts as st

SCHEMA = "id long, ts timestamp, text string"
START = datetime.datetime(2024, 1, 1)


def land(spark, folder, rows):
    days = [(key, START + datetime.timedelta(days=day), text) for key, day, text in rows]
    spark.createDataFrame(days, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drained(spark, folder, out, state, find):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = st.event_time(st.ingest(spark, folder, schema, files_per_trigger=1), "ts", "1 hour")
    st.append_to_files(find(stream), out, state).awaitTermination()
    return sorted((r["id"] is None, r["id"] or 0, r["text"]) for r in spark.read.parquet(out).collect())


def test_a_repeat_after_the_watermark_and_a_restart_is_dropped(spark):
    folder, out, state = (fl.scratch_folder(spark, n) for n in ("in", "out", "state"))
    find = lambda stream: st.drop_repeats_ever(stream, "id")
    land(spark, folder, [(1, 0, "a"), (2, 0, "b"), (None, 0, "n")])
    land(spark, folder, [(3, 30, "c"), (4, 31, "d")])
    assert len(drained(spark, folder, out, state, find)) == 5
    land(spark, folder, [(1, 60, "again"), (4, 61, "again"), (5, 62, "e"), (None, 62, "again"), (5, 63, "twice")])
    found = drained(spark, folder, out, state, find)
    assert [f[1] for f in found if not f[0]] == [1, 2, 3, 4, 5] and sum(f[0] for f in found) == 1
    assert not any(f[2] == "again" for f in found)


def test_keys_of_earlier_output_are_dropped(spark):
    folder, out, state = (fl.scratch_folder(spark, n) for n in ("in", "out", "state"))
    earlier = spark.createDataFrame([(2, "x"), (2, "x"), (9, "y")], "id long, other string")
    land(spark, folder, [(1, 0, "a"), (2, 0, "b"), (9, 5, "c"), (3, 9, "d")])
    assert [f[1] for f in drained(spark, folder, out, state, lambda s: st.drop_repeats_ever(s, "id", earlier))] == [1, 3]
