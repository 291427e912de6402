"""Message queues as a Spark data source, ``format("queue")``: a folder of the shared store for each queue, a file for
each message. It takes the place of a broker, for which no client is bundled, and keeps its terms: messages are
delivered at least once and acknowledged (removed) when a batch has been committed.

What a batch holds is written down before it is read: the queue's log, a folder ``.log`` beside the messages, has a file
for each batch with the names of its messages, and a stream's offset is the number of a batch. A commit removes the names
of its batches and no others, so a message whose name sorts before delivered ones (its publisher took the time earlier)
comes with the next batch; a stream that is restarted between reading and commit finds the same batches in the log. The
last batch committed stays in the log, empty, so that numbers go on. A queue has one consumer at a time.

Reading (streams): rows of name and value; ``path`` the store, ``queue`` the incoming queue, ``size`` messages a
partition, ``most`` messages a batch. Writing (batch): rows of queue and value, each published to its queue, under the
name given in a column ``name`` (the time and a random part where it has none).
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .vector_file import _located, _opened

SIZE, MOST = 200, 100_000
SCHEMA = "name string, value binary"


def names(path: str) -> list[str]:
    """The messages that wait, in order."""
    from pyarrow import fs

    system, folder = _located(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith("."))


class Messages(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class Log:
    """Batches by number: the names of their messages. An entry appears whole and is never written twice, but to be emptied."""

    def __init__(self, queue: str):
        self.path = f"{queue}/.log"

    def numbers(self) -> list[int]:
        return [int(n) for n in names(self.path) if n.isdigit()]

    def __getitem__(self, number: int) -> list[str]:
        with _opened(f"{self.path}/{number:012d}") as f:
            return [n for n in f.read().decode().split("\n") if n]

    def __setitem__(self, number: int, messages: list[str]) -> None:
        hidden = f".{number:012d}-{uuid.uuid4().hex}"
        with _opened(f"{self.path}/{hidden}", write=True) as f:
            f.write("\n".join(messages).encode())
        system, folder = _located(self.path)
        system.move(f"{folder}/{hidden}", f"{folder}/{number:012d}")

    def __delitem__(self, number: int) -> None:
        system, folder = _located(self.path)
        system.delete_file(f"{folder}/{number:012d}")


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = f"{options['path'].rstrip('/')}/{options['queue']}"
        self.size, self.most = int(options.get("size", SIZE)), int(options.get("most", MOST))
        self.log = Log(self.path)

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        """Plans a batch of what waits and is in no batch yet, if there is any."""
        numbers = self.log.numbers()
        planned = {n for number in numbers for n in self.log[number]}
        waiting = [n for n in names(self.path) if n not in planned][: self.most]
        last = max(numbers, default=0)
        if waiting:
            last += 1
            self.log[last] = waiting
        return {"batch": last}

    def partitions(self, start: dict, end: dict) -> list[Messages]:
        taken = [n for number in self.log.numbers() if start["batch"] < number <= end["batch"] for n in self.log[number]]
        return [Messages(taken[i : i + self.size]) for i in range(0, len(taken), self.size)]

    def read(self, partition: Messages):
        for name in partition.names:
            try:
                with _opened(f"{self.path}/{name}") as f:
                    value = f.read()
            except FileNotFoundError:  # acknowledged by a commit that did not come to its end
                continue
            yield name, value

    def commit(self, end: dict) -> None:
        """Acknowledges: what the batches up to ``end`` have delivered leaves the queue, then their entries the log."""
        system, folder = _located(self.path)
        for number in self.log.numbers():
            if number <= end["batch"]:
                for name in self.log[number]:
                    try:
                        system.delete_file(f"{folder}/{name}")
                    except FileNotFoundError:
                        pass
                if number == end["batch"]:
                    self.log[number] = []
                else:
                    del self.log[number]

    def stop(self) -> None:
        pass


class Writer(DataSourceWriter):
    """Messages appear whole: each is written under a hidden name, then renamed."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, iterator) -> WriterCommitMessage:
        for row in iterator:
            name = getattr(row, "name", None) or f"{time.time_ns():020d}-{uuid.uuid4().hex}"
            with _opened(f"{self.path}/{row.queue}/.{name}", write=True) as f:
                f.write(bytes(row.value))
            system, folder = _located(f"{self.path}/{row.queue}")
            system.move(f"{folder}/.{name}", f"{folder}/{name}")
        return WriterCommitMessage()


class Queue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


class Transport:
    """Where messages come from and go to: the store and the incoming queue."""

    def __init__(self, spark: SparkSession, server: str, queue: str = ""):
        spark.dataSource.register(Queue)
        self.spark, self.server, self.queue = spark, server, queue

    def incoming(self, most: int = MOST) -> DataFrame:
        """A stream of name and value from the incoming queue."""
        return self.spark.readStream.format("queue").option("path", self.server).option("queue", self.queue).option("most", most).load()

    def publish(self, messages: DataFrame) -> None:
        """Rows of queue and value, and a name if the publisher gives one (a second message of a name replaces the first)."""
        messages.select("queue", "value", *(c for c in messages.columns if c == "name")).write.format("queue").mode("append").save(self.server)
