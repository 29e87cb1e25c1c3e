import time

from pageloom.streaming import events, tasks


def test_command_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.txt").write_text("rapor.pdf sıkıştır\nmerhaba\n", encoding="utf-8")
    q = events.command_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("said").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["input_file"], len(r["action_chain"])) for r in spark.table("said").collect()) == [("", 0), ("rapor.pdf", 1)]


def test_windows_and_sessions(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "ev"))
    stream = events.task_events(spark.readStream.schema(source.schema).parquet(str(tmp_path / "ev")))
    for name, df in (("w", events.progress_windows(stream)), ("s", events.task_sessions(stream))):
        q = df.writeStream.format("memory").outputMode("complete" if name == "w" else "append").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    static = events.progress_windows(events.task_events(source))
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, static.collect()))
    assert spark.table("s").count() > 0


def test_cancel_and_count(spark):
    def slow():
        return spark.range(4).repartition(4).rdd.map(lambda x: time.sleep(30)).count()

    task = tasks.Task(spark, "slow", slow)
    time.sleep(2)
    task.cancel()
    try:
        task.result(20)
        raise AssertionError("ran to its end")
    except AssertionError:
        raise
    except TimeoutError:
        raise
    except Exception as e:
        assert "cancel" in str(e).lower()
    df, seen = tasks.counted(spark.range(7))
    df.collect()
    assert seen.get["rows"] == 7
