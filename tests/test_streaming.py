import datetime as dt

from strataspark.streaming import watch


def test_bursts(spark):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [("a.go", "WRITE", at(0)), ("b.go", "CREATE", at(300)), ("c.go", "WRITE", at(2000))]
    events = spark.createDataFrame(rows, "name string, op string, ts timestamp")
    assert [(r.events, r.name) for r in watch.bursts(events).orderBy("started").collect()] == [(2, "b.go"), (1, "c.go")]


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = '{{"name": "{}", "op": "{}", "ts": "2024-01-01T00:00:{:06.3f}Z"}}\n'
    (source / "1.json").write_text(line.format("a.go", "WRITE", 0) + line.format("b.go", "WRITE", 0.2) + line.format(".h.go", "WRITE", 0.3) + line.format("x.py", "WRITE", 0.4) + line.format("c.go", "CHMOD", 0.4))
    (source / "2.json").write_text(line.format("z.go", "WRITE", 30))
    stream = spark.readStream.schema("name string, op string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    seen = []

    def analyse(name):
        seen.append(name)
        if len(seen) == 1:
            raise RuntimeError("a failing run")
        return 0

    query = watch.run_on_bursts(stream, analyse, str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert seen == ["b.go"]


def test_event_source(spark, tmp_path):
    import os

    from strataspark.sources import events

    root = tmp_path / "tree"
    (root / "vendor").mkdir(parents=True)
    (root / "old.go").write_text("package a\n")
    reader = events.EventReader(str(root))
    start = reader.initialOffset()
    (root / "new").mkdir()
    (root / "new" / "a.go").write_text("package a\n")
    (root / "vendor" / "x.go").write_text("package a\n")
    rows, middle = reader.read(start)
    assert [r[:2] for r in rows] == [("new/a.go", "CREATE")]
    os.utime(root / "old.go", ns=(1, 1))
    os.remove(root / "new" / "a.go")
    rows, end = reader.read(middle)
    assert [r[:2] for r in rows] == [("new/a.go", "REMOVE"), ("old.go", "WRITE")]
    assert len(list(reader.readBetweenOffsets(start, end))) == 3
    reader.commit(middle)
    assert [r[1] for r in reader.readBetweenOffsets(middle, end)] == ["REMOVE", "WRITE"]
    seen = []
    query = events.stream(spark, str(root)).writeStream.foreachBatch(lambda df, _: seen.extend(r.name for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    (root / "late.go").write_text("package a\n")
    query.processAllAvailable()
    query.stop()
    assert seen == ["late.go"]
