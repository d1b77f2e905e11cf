"""Sources that go on where the last run stopped."""

import pytest

from strandline.sources import resumable


def run(stream, place, sink):
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(place)).trigger(availableNow=True).start().awaitTermination()


def test_a_spool_is_read_once(spark, tmp_path):
    folder, place, seen = tmp_path / "spool", tmp_path / "place", []
    folder.mkdir()
    (folder / "001.json").write_text('{"a": 1}\n{"a": 2}\n')
    (folder / "002.json").write_text('{"a": 3}\n\n{"a": "ü"}')
    (folder / ".hidden.json").write_text("no")
    (folder / "note.txt").write_text("no")
    lines = lambda: resumable.spool_lines(spark, str(folder))
    run(lines(), place, lambda df, n: seen.append(sorted((r.file, r.place, r.line) for r in df.collect())))
    assert seen == [[("001.json", 0, '{"a": 1}'), ("001.json", 1, '{"a": 2}'), ("002.json", 0, '{"a": 3}'), ("002.json", 1, ""), ("002.json", 2, '{"a": "ü"}')]]
    (folder / "003.json").write_text("x")
    for _ in range(2):
        run(lines(), place, lambda df, n: seen.append([r.line for r in df.collect()]))
    assert [x for x in seen[1:] if x] == [["x"]]


def test_a_table_goes_on_after_the_last_key_and_after_a_crash(spark, tmp_path):
    table, place, seen = str(tmp_path / "table"), tmp_path / "place", {}
    schema = "id long, v string"
    add = lambda a, b: spark.range(a, b).selectExpr("id", "'v' || id AS v").coalesce(1).write.mode("append").parquet(table)
    stream = lambda: resumable.keyset(spark, table, "id", schema)

    def sink(df, n):
        seen[n] = sorted(r.id for r in df.collect())  # a batch that is read again replaces what it gave

    add(0, 50)
    spark.createDataFrame([(None, "null")], schema).write.mode("append").parquet(table)
    run(stream(), place, sink)
    assert seen == {0: [*range(50)]}
    add(50, 80)

    def stopped(df, n):
        sink(df, n)
        raise RuntimeError("the executor is gone")

    with pytest.raises(Exception, match="the executor is gone"):
        run(stream(), place, stopped)
    add(80, 90)
    run(stream(), place, sink)
    run(stream(), place, sink)
    assert sorted(i for batch in seen.values() for i in batch) == [*range(90)]
    assert {n: b for n, b in seen.items() if b} == {0: [*range(50)], 1: [*range(50, 80)], 2: [*range(80, 90)]}


def test_row_groups_without_new_keys_are_not_read(tmp_path, spark):
    table = str(tmp_path / "table")
    for a in (0, 100, 200):
        spark.range(a, a + 100).coalesce(1).write.mode("append").parquet(table)
    reader = resumable.KeysetReader({"path": table, "key": "id"}, spark.range(1).schema)
    assert reader.latestOffset() == {"key": 299}
    assert len(reader.partitions({"key": 199}, {"key": 299})) == 1 and len(reader.partitions({"key": 150}, {"key": 299})) == 2 and reader.partitions({"key": 299}, {"key": 299}) == []
