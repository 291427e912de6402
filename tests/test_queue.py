"""The queue keeps what was published: late names, restarts between reading and commit, publishers beside readers."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from visbag.sources import queue


def put(tmp_path, *names: str) -> None:
    (tmp_path / "q").mkdir(exist_ok=True)
    for n in names:
        (tmp_path / "q" / f".{n}").write_bytes(n.encode())
        (tmp_path / "q" / f".{n}").rename(tmp_path / "q" / n)


def delivered(reader, start: dict, end: dict) -> list[str]:
    return [value.decode() for p in reader.partitions(start, end) for _, value in reader.read(p)]


def test_a_late_name_is_not_acknowledged_unread(tmp_path):
    reader = queue.Reader({"path": str(tmp_path), "queue": "q", "size": "2"})
    put(tmp_path, "0002", "0003", "0004")
    start = reader.initialOffset()
    first = reader.latestOffset()
    put(tmp_path, "0001")  # its publisher took its time stamp earlier
    assert delivered(reader, start, first) == ["0002", "0003", "0004"]
    reader.commit(first)
    assert queue.names(str(tmp_path / "q")) == ["0001"]
    second = reader.latestOffset()
    assert delivered(reader, first, second) == ["0001"]
    reader.commit(second)
    assert queue.names(str(tmp_path / "q")) == [] and reader.latestOffset() == second


def test_a_restart_between_reading_and_commit(tmp_path):
    options = {"path": str(tmp_path), "queue": "q", "most": "2"}
    put(tmp_path, "a", "b", "c")
    one = queue.Reader(options)
    first = one.latestOffset()
    assert delivered(one, one.initialOffset(), first) == ["a", "b"]
    put(tmp_path, "0")
    other = queue.Reader(options)  # the process died; the stream goes on from its checkpoint
    assert delivered(other, other.initialOffset(), first) == ["a", "b"]
    other.commit(first)
    second = other.latestOffset()
    assert delivered(other, first, second) == ["0", "c"]
    put(tmp_path, "d")
    third = queue.Reader(options)  # died again, after a part of the commit
    (tmp_path / "q" / "0").unlink()
    assert delivered(third, first, second) == ["c"]
    third.commit(second)
    last = third.latestOffset()
    assert last["batch"] == second["batch"] + 1 and delivered(third, second, last) == ["d"]
    third.commit(last)
    assert third.log.numbers() == [last["batch"]] and third.log[last["batch"]] == []


def test_an_empty_queue(tmp_path):
    reader = queue.Reader({"path": str(tmp_path), "queue": "none"})
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions({"batch": 0}, {"batch": 0}) == []


def test_stream_that_fails_and_goes_on(spark, tmp_path):
    """Publishers write while a stream reads; it fails once after reading and is started again. Nothing is lost."""
    transport = queue.Transport(spark, f"file://{tmp_path}/broker", "in")
    publish = lambda a, b: transport.publish(spark.range(a, b).select(F.lit("in").alias("queue"), F.col("id").cast("string").cast("binary").alias("value")))
    publish(0, 60)
    seen, fail = [], [True]

    def batch(df, _):
        got = [int(bytes(r.value)) for r in df.collect()]
        if fail[0]:
            fail[0] = False
            raise RuntimeError("lost after reading")
        seen.extend(got)

    def run():
        q = transport.incoming(most=25).writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost after reading"):
        run()
    def others():
        folder = tmp_path / "broker" / "in"
        for i in range(60, 90):  # names before and after those that Spark's writer gives
            name = f"{'0' if i % 2 else '9'}{i}"
            (folder / f".{name}").write_bytes(str(i).encode())
            (folder / f".{name}").rename(folder / name)
            time.sleep(0.02)

    beside = threading.Thread(target=others)
    beside.start()
    for _ in range(5):
        run()
    beside.join()
    for _ in range(6):
        run()
    assert sorted(set(seen)) == list(range(90))
    waiting = queue.names(f"file://{tmp_path}/broker/in")  # Spark acknowledges a batch when it plans the next
    log = queue.Log(f"file://{tmp_path}/broker/in")
    assert sorted(waiting) == sorted(n for k in log.numbers() for n in log[k])
