"""Several tables that change together: staged folders, and one small file that names them, put in its place last.

A store is a folder with `data`, where each change stages the tables that it writes, and `commits`, one file for each state: its number, and the
folder of every table. A state is there once its file is, and the file comes by a rename that fails if the number is taken. So a
reader sees all of a change or nothing of it, whatever step the writer dies at; of two writers that start from the same
state the second one fails. Staged folders that no state names are litter, which `recover` takes away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the state that this one wanted to write."""


class Store:
    """Tables below a folder that driver and executors share; any path that Spark's file systems open."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = hadoop.FileContext.getFileContext(self._path(self.root).toUri(), spark._jsc.hadoopConfiguration())
        self._no_overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        self._no_overwrite[0] = getattr(hadoop, "Options$Rename").NONE

    def state(self) -> tuple[int, dict[str, str]]:
        """Number of the newest state, 0 before the first, and the folder of each table in it."""
        number, said = self._newest()
        return number, said["tables"]

    def mark(self, name: str) -> int | None:
        """A number that the newest state was committed with, such as the last batch of a stream that it holds."""
        return self._newest()[1]["marks"].get(name)

    def _newest(self) -> tuple[int, dict]:
        names = self._names("commits")
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()]
        if not numbers:
            return 0, {"tables": {}, "marks": {}}
        newest = max(numbers)
        stream = self._fs.open(self._path(f"{self.root}/commits/{newest:012d}.json"))
        try:
            return newest, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        """A table of the newest state."""
        return self.spark.read.parquet(self.state()[1][name])

    def tables(self) -> dict[str, DataFrame]:
        """All tables of one state: asked for one by one they could be of several."""
        return {name: self.spark.read.parquet(folder) for name, folder in self.state()[1].items()}

    def apply(self, changes: dict[str, DataFrame], base: int | None = None, marks: dict[str, int] | None = None, after: Callable[[str], None] = lambda step: None) -> int:
        """Writes the new content of the given tables as the state after `base` (by default the newest one); the others stay as they are.

        `after` is told each step that is done. The contents may be read from the tables that they replace: those folders are not touched.
        """
        number, said = self._newest()
        if base is not None and base != number:
            raise Conflict(f"state {number} has come after {base}")
        own = uuid.uuid4().hex
        staged = dict(said["tables"])
        for name, rows in changes.items():
            staged[name] = f"{self.root}/data/{number + 1:012d}-{own}/{name}"
            rows.write.parquet(staged[name])
            after(f"staged {name}")
        draft = self._path(f"{self.root}/commits/_draft-{own}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(json.dumps({"tables": staged, "marks": said["marks"] | (marks or {})}).encode())
        finally:
            stream.close()
        after("drafted")
        try:
            self._context.rename(draft, self._path(f"{self.root}/commits/{number + 1:012d}.json"), self._no_overwrite)
        except Exception as failed:
            if self.state()[0] > number:
                raise Conflict(f"state {number + 1} is taken") from failed
            raise
        after("committed")
        return number + 1

    def recover(self) -> list[str]:
        """Removes drafts and staged folders that the newest state does not name, and returns them. For when no writer is at work."""
        _, tables = self.state()
        used = {folder.rpartition("/")[0].rpartition("/")[2] for folder in tables.values()}
        litter = [f"data/{n}" for n in self._names("data") if n not in used] + [f"commits/{n}" for n in self._names("commits") if n.startswith("_draft-")]
        for name in litter:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return litter

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []
