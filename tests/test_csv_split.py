"""CSV files cut amid their records against the whole-file reader."""

import csv
import random

import pytest
from pyspark.sql import types as T

from voxgrain.sources import csv_split
from voxgrain.sources import files as fl

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])


def texts(rng, size):
    parts = ["plain", 'a "quoted" word', "line\nbreak", "\n", '"', '""', ",", "two\n\nbreaks, and \"more\"\n", "ünïcode 😀", " blanks ", "x" * 300, "", "windows\r\nbreak"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(4))) for _ in range(size)]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def whole(spark, path, schema=SCHEMA):
    return sorted(map(repr, spark.read.options(**fl.CSV_READ).schema(schema).csv(str(path)).collect()))


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_many_tasks_read_what_one_does(spark, tmp_path, small_splits, ending):
    rng = random.Random(len(ending))
    for name in ("one", "two"):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            writer = csv.writer(f, lineterminator=ending)
            writer.writerow(SCHEMA.names)
            for i, text in enumerate(texts(rng, 120)):
                writer.writerow([i, text, rng.choice(["", "1.5", "-2"])])
                if i % 17 == 0:
                    f.write(ending)  # a blank line between records
            writer.writerow([999, "long " + "many words\n" * 400, "3"])  # over several splits
            writer.writerow([1000, "after", ""])
    lines = csv_split._lines(spark, str(tmp_path), "*.csv", False)
    assert lines.rdd.getNumPartitions() > 10
    found = fl.read_posts(spark, str(tmp_path), "csv", SCHEMA, "*.csv")
    assert sorted(map(repr, found.collect())) == whole(spark, tmp_path)
    named = fl.read_posts(spark, str(tmp_path), "csv", pattern="*.csv", with_source=True)
    assert named.columns == [*SCHEMA.names, "file_source"] and {r["file_source"] for r in named.select("file_source").distinct().collect()} == {"one", "two"}
    assert named.count() == found.count() == 2 * 122


@pytest.mark.parametrize("content", [
    'id,text,score\n1,5" pipe,2\n2,"a\nb",3\n', 'id,text,score\n1,"open\n2,b,3\n', 'id,text,score\n1,a" b" c,2\n3,"x",4\n', "id,text,score\n", "id,text,score", "id,text,score\n1,a\n2,b,3,4\n",
])
def test_files_without_sure_records_are_read_whole(spark, tmp_path, content):
    (tmp_path / "odd.csv").write_text(content)
    assert sorted(map(repr, fl.read_posts(spark, str(tmp_path / "odd.csv"), "csv", SCHEMA).collect())) == whole(spark, tmp_path / "odd.csv")


def test_a_header_that_comes_again_is_a_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,x\nid,text\n2,y\n")
    assert [r["id"] for r in fl.read_posts(spark, str(tmp_path / "a.csv"), "csv").collect()] == ["1", "id", "2"]


def test_where_records_begin():
    # file, split, lines with an odd number of quotes
    odd = [("a", 0, 1), ("a", 10, 0), ("a", 20, 2), ("a", 30, 1), ("a", 40, 0), ("b", 0, 0), ("b", 10, 3), ("b", 20, 0)]
    splits = [(*s, 0, 0) for s in odd]
    assert csv_split._beginnings(splits) == {("a", 10): 0, ("a", 20): 0, ("a", 30): 20, ("b", 20): 10}
