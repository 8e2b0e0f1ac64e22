import gzip
import json

import numpy as np

from taxoflow.sources import files
from taxoflow.streaming import windowed_counts


def test_csv_with_mark_quotes_and_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('\ufeffid,text\n1,"a ""q"" \nb"\n2,\n'.encode())
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'a "q" \nb'), ("2", None)]
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("id,n\n007,1.5\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv.gz"), "id string, n double", 2).collect()] == [("007", 1.5)]


def test_json_forms_and_writers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": {"c": ["x"]}}, {"a": 2}]))
    rows = files.read_json_array(spark, str(tmp_path / "a.json"), "a int, b struct<c: array<string>>")
    assert [r.a for r in rows.collect()] == [1, 2]
    (tmp_path / "b.json").write_text('{"a": 1}\n\n{"a": 3}\n')
    assert [r.a for r in files.read_json_lines(spark, str(tmp_path / "b.json"), "a int").where("a is not null").collect()] == [1, 3]
    files.write_json_lines(rows, str(tmp_path / "out"))
    assert files.read_json_lines(spark, str(tmp_path / "out"), "a int").count() == 2
    df = spark.createDataFrame([(1, 0.5)], "id int, x double")
    files.write_csv(df, str(tmp_path / "csv"), "gzip", {"x": 6})
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "csv")).collect()] == [("1", "0.500000")]
    assert files.file_manifest(spark, str(tmp_path / "csv")).where("length(sha256) = 64").count() >= 1


def test_resumable_and_npz(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert [r.k for r in files.new_rows(a, b, "k").collect()] == [2]
    np.savez(tmp_path / "v.npz", ids=np.array(["a", "b"]), vectors=np.eye(2, dtype="float32"))
    assert [(r.ids, list(r.vectors)) for r in files.vectors_from_npz(spark, str(tmp_path / "v.npz")).collect()] == [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = windowed_counts(stream, "ts", ["event_type"], "1 day", "60 days")
    run = counts.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    batch = windowed_counts(events, "ts", ["event_type"], "1 day")
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))
