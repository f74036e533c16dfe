"""A queue in a folder that driver and executors share, as a streaming source with acknowledgement.

``ready`` holds message files, one message a line. What a batch takes is noted
below ``deliveries`` before it is read, so a batch that is run again reads the
same messages; files go only when Spark commits the batch. What was delivered
and not acknowledged comes again: after a restart from the checkpoint as the
same batch, without a checkpoint as the first delivery.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "value string, file string, delivery long"


class Folder:
    """The folders of a spool, in any store that Arrow's file systems reach."""

    def __init__(self, path: str):
        self.store, self.base = fs.FileSystem.from_uri(path)
        self.ready, self.deliveries = f"{self.base}/ready", f"{self.base}/deliveries"

    def names(self, folder: str) -> list[str]:
        """Names of a folder's files in order, without hidden ones."""
        found = self.store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name[0] not in "._")

    def delivered(self, number: int) -> list[str]:
        with self.store.open_input_stream(f"{self.deliveries}/{number:012d}") as f:
            return json.loads(f.read())

    def deliver(self, number: int, names: list[str]) -> None:
        """Notes a delivery under its number; the note is there whole or not at all."""
        self.store.create_dir(self.deliveries)
        draft = f"{self.deliveries}/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft) as f:
            f.write(json.dumps(names).encode())
        self.store.move(draft, f"{self.deliveries}/{number:012d}")

    def acknowledge(self, number: int) -> None:
        """Removes a delivery's messages, then its note; what is gone already is left alone, so it can be done again."""
        for name in self.delivered(number):
            self.drop(f"{self.ready}/{name}")
        self.drop(f"{self.deliveries}/{number:012d}")

    def drop(self, path: str) -> None:
        try:
            self.store.delete_file(path)
        except FileNotFoundError:
            pass

    def lines(self, name: str) -> Iterator[str]:
        with self.store.open_input_stream(f"{self.ready}/{name}") as f:
            for line in f.read().decode("utf-8", "replace").split("\n"):
                if line.strip():
                    yield line


class Files(InputPartition):
    def __init__(self, delivery: int, names: list[str]):
        super().__init__((delivery, names))
        self.delivery, self.names = delivery, names


class SpoolReader(DataSourceStreamReader):
    """Offsets are delivery numbers; a batch takes ``prefetch`` message files at most."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a spool needs the option path")
        self.path = options["path"]
        self.prefetch = int(options.get("prefetch", "100"))
        self.tasks = max(1, int(options.get("tasks", "8")))
        if self.prefetch < 1:
            raise ValueError("prefetch is at least 1")

    def initialOffset(self) -> dict:
        """Before the oldest delivery that was not acknowledged, for a query that has no checkpoint yet."""
        open_ones = Folder(self.path).names(Folder(self.path).deliveries)
        return {"delivery": int(open_ones[0]) - 1 if open_ones else 0}

    def latestOffset(self) -> dict:
        """Takes up to ``prefetch`` files that no delivery has and notes them; without any, the last delivery stands."""
        folder = Folder(self.path)
        open_ones = folder.names(folder.deliveries)
        last = max([self._at(), *map(int, open_ones)])
        taken = {n for d in open_ones for n in folder.delivered(int(d))}
        fresh = [n for n in folder.names(folder.ready) if n not in taken][: self.prefetch]
        if not fresh:
            return {"delivery": last}
        folder.deliver(last + 1, fresh)
        self._keep(last + 1)
        return {"delivery": last + 1}

    def _at(self) -> int:
        """The number of the last delivery, which outlives its acknowledgement."""
        folder = Folder(self.path)
        try:
            with folder.store.open_input_stream(f"{folder.base}/last") as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def _keep(self, number: int) -> None:
        folder = Folder(self.path)
        draft = f"{folder.base}/.{uuid.uuid4().hex}"
        with folder.store.open_output_stream(draft) as f:
            f.write(str(number).encode())
        folder.store.move(draft, f"{folder.base}/last")

    def partitions(self, start: dict, end: dict) -> list[Files]:
        folder, out = Folder(self.path), []
        for number in range(start["delivery"] + 1, end["delivery"] + 1):
            names = folder.delivered(number)
            out += [Files(number, names[i :: self.tasks]) for i in range(min(self.tasks, len(names)))]
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        folder = Folder(self.path)
        for name in partition.names:
            for line in folder.lines(name):
                yield line, name, partition.delivery

    def commit(self, end: dict) -> None:
        """Acknowledges all deliveries up to ``end``: Spark calls it when their batch is done for good."""
        folder = Folder(self.path)
        for number in map(int, folder.names(folder.deliveries)):
            if number <= end["delivery"]:
                folder.acknowledge(number)


class Spool(DataSource):
    """``spark.readStream.format("spool")`` with the options path, prefetch and tasks."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> SpoolReader:
        return SpoolReader(self.options)


def read_spool(spark: SparkSession, path: str, prefetch: int = 100, tasks: int = 8) -> DataFrame:
    """Messages of a spool as a stream of (value, file, delivery). One query reads a spool at a time."""
    spark.dataSource.register(Spool)
    return spark.readStream.format("spool").option("prefetch", prefetch).option("tasks", tasks).load(path)


def publish(messages: DataFrame, path: str, tag: str, column: str = "value") -> int:
    """Puts messages into a spool and gives the number of files.

    Tasks write beside the queue; the files are then moved in, so a reader never
    sees half of one. The same ``tag`` replaces what it put in before and is
    still there. Files are taken in the order of their tags.
    """
    folder = Folder(path)
    messages.select(column).where(f"{column} IS NOT NULL").write.mode("overwrite").text(f"{path}/staged/{tag}")
    folder.store.create_dir(folder.ready)
    names = folder.names(f"{folder.base}/staged/{tag}")
    for i, name in enumerate(names):
        folder.store.move(f"{folder.base}/staged/{tag}/{name}", f"{folder.ready}/{tag}-{i:06d}")
    folder.store.delete_dir(f"{folder.base}/staged/{tag}")
    return len(names)


def waiting(path: str) -> tuple[int, int]:
    """(message files that are ready, deliveries that are not acknowledged)."""
    folder = Folder(path)
    return len(folder.names(folder.ready)), len(folder.names(folder.deliveries))
