"""A table of dated rows that streams rewrite date by date, under a commit log.

Commit n is one small file, created exclusively, with the whole state: the data folder of every date, and the last batch
of every checkpoint that wrote. A batch reads its own dates' folders, writes a new folder and commits on top of the state
it has read; if another writer was faster, it merges again. So a batch that is repeated is applied once, a query with a
fresh checkpoint goes on from what is there, and two queries may write the same table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A commit file without content that is older than this was cut short and is passed over.
STALE_SECONDS = 60
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Commit:
    """The table after a commit: number, data folder per date ('' for rows without one), last batch per checkpoint."""

    number: int = 0
    dates: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    schema: str | None = None


def _key(day: date | None) -> str:
    return "" if day is None else day.isoformat()


class VersionedTable:
    """Rows with a date column under one folder: `commits/` and `data/`."""

    def __init__(self, spark: SparkSession, path: str, day: str = "business_date") -> None:
        self.spark, self.path, self.day = spark, path.rstrip("/"), day

    def _at(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _numbers(self) -> dict[int, tuple[int, int]]:
        """Commit number -> size and time of its file."""
        files, folder = self._at("commits")
        if not files.exists(folder):
            return {}
        found = {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in files.listStatus(folder)}
        return {int(name[7:]): v for name, v in found.items() if name.startswith("commit-")}

    def _read(self, number: int) -> Commit:
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/commits/commit-{number:012d}").first()
        return Commit(**json.loads(rows[0]))

    def state(self) -> Commit:
        """The last whole commit."""
        whole = [n for n, (size, _) in self._numbers().items() if size]
        return self._read(max(whole)) if whole else Commit()

    def _commit(self, commit: Commit) -> bool:
        """Creates the commit file; False where the number is taken, or the commit came too late to count."""
        files, folder = self._at("commits")
        files.mkdirs(folder)
        try:
            out = files.create(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"commit-{commit.number:012d}"), False)
        except Py4JJavaError as exc:
            if "AlreadyExists" in exc.java_exception.getClass().getName() or "already exists" in str(exc.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps(commit.__dict__).encode()))
        out.close()
        return max(self._numbers()) == commit.number

    def _next(self) -> tuple[Commit, int]:
        """The state to build on, and the number of the next commit."""
        while True:
            numbers = self._numbers()
            last = max(numbers, default=0)
            if not last or numbers[last][0]:
                break
            if time.time() * 1000 - numbers[last][1] > STALE_SECONDS * 1000:
                break
            time.sleep(0.5)  # another writer is at it
        return self.state(), last + 1

    def places(self, state: Commit, days: list[str] | None = None) -> list[str]:
        """The folders that hold some dates, or all."""
        return sorted(
            f"{self.path}/data/{folder}/{self.day}={key or _NO_DATE}"
            for key, folder in state.dates.items() if days is None or key in days
        )

    def read(self, state: Commit | None = None, days: list[str] | None = None) -> DataFrame | None:
        """Rows of some dates, or all; None where nothing was written."""
        state = state or self.state()
        if state.schema is None:
            return None
        schema, places = StructType.fromJson(json.loads(state.schema)), self.places(state, days)
        if not places:
            return self.spark.createDataFrame([], schema)
        names = [f"`{f.name}`" for f in schema.fields]
        parts: dict[str, list[str]] = {}
        for place in places:
            parts.setdefault(place.rsplit("/", 1)[0], []).append(place)
        if len(parts) == 1:
            return self.spark.read.schema(schema).option("basePath", next(iter(parts))).parquet(*places).select(*names)
        folder = StructType([*schema.fields]).add("_folder", "string")
        return self.spark.read.schema(folder).option("basePath", f"{self.path}/data").parquet(*places).select(*names)

    def apply(self, batch: DataFrame, batch_id: int, writer: str, merge: Callable[[DataFrame], DataFrame]) -> bool:
        """Merges a batch into its dates and commits; False where this writer's batch was committed before.

        merge gets the rows of the batch and of the same dates in the table, and returns the dates' new rows.
        """
        days = [_key(r[0]) for r in batch.select(self.day).distinct().collect()]
        schema = json.dumps(batch.schema.jsonValue())
        while True:
            state, number = self._next()
            if state.batches.get(writer, -1) >= batch_id:
                return False
            old = self.read(state, days) if any(d in state.dates for d in days) else None
            rows = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
            name = f"_folder={uuid.uuid4().hex}"
            merge(rows).write.partitionBy(self.day).option("compression", "zstd").parquet(f"{self.path}/data/{name}")
            done = Commit(number, state.dates | dict.fromkeys(days, name), state.batches | {writer: batch_id}, schema)
            if self._commit(done):
                return True

    def compact(self, keep: int = 2) -> int:
        """Deletes data folders that none of the last `keep` commits names, and older commits; returns how many folders.

        A folder that a running batch has written and not committed yet is newer than the last commit, and stays.
        """
        numbers = self._numbers()
        whole = sorted(n for n, (size, _) in numbers.items() if size)
        kept = whole[-keep:]
        if not kept:
            return 0
        named = {folder for n in kept for folder in self._read(n).dates.values()}
        newest = numbers[whole[-1]][1]
        files, folder = self._at("data")
        gone = 0
        for status in files.listStatus(folder):
            if status.getPath().getName() not in named and status.getModificationTime() <= newest:
                files.delete(status.getPath(), True)
                gone += 1
        files, folder = self._at("commits")
        for n in whole[:-keep]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"commit-{n:012d}"), False)
        return gone


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that Spark gave a checkpoint; a fresh checkpoint in the same place has another."""
    text = spark.read.option("wholetext", True).text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return json.loads(text)["id"]
