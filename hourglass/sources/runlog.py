"""A table of runs that survives retries (SNK-5).

Each run writes to a folder of its own attempt, then a new version of the
ledger names that folder.  A version is one small file that must not exist
before, so of two writers one goes first and the other adds to what that one
wrote.  Readers see the runs of the latest whole version: a run that was
killed half-way leaves files that nobody reads, a retried run takes the place
of its own earlier rows only, and runs of other names never meet.

``fold`` puts several runs into one (with a merge, if rows of one key come
together), in one version as well.  Superseded attempts stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import files, storage

_END = "\n#end"


class RunLog:
    """Runs under ``path``, each a set of files of ``fmt`` (JSON gzipped, unless ``options`` say otherwise), all of one ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options):
        self.spark, self.path, self.schema, self.fmt = spark, path.rstrip("/"), schema, fmt
        self.options = {"ignoreNullFields": "false", **files.GZIP, **options} if fmt == "json" else options

    def _versions(self) -> list[int]:
        fs, p = storage.file_system(self.spark, f"{self.path}/ledger")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def runs(self) -> dict[str, str]:
        """Attempt folder of each committed run, from the latest version that was written to its end."""
        for version in self._versions():
            text = storage.read_text(self.spark, f"{self.path}/ledger/{version:012d}")
            if text.endswith(_END):
                return json.loads(text.removesuffix(_END))
        return {}

    def _commit(self, change: Callable[[dict], dict]) -> None:
        while True:
            version = max(self._versions(), default=0) + 1
            text = json.dumps(change(self.runs()), sort_keys=True) + _END
            if storage.create_text(self.spark, f"{self.path}/ledger/{version:012d}", text):
                return

    def _write(self, df: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        df.write.format(self.fmt).options(**self.options).save(f"{self.path}/data/{attempt}")
        return attempt

    def append(self, df: DataFrame, run: str) -> None:
        """Add a run, in place of an earlier run of that name."""
        attempt = self._write(df)
        self._commit(lambda runs: {**runs, run: attempt})

    def read(self, only: list[str] | None = None) -> DataFrame:
        """The rows of all committed runs (or of some)."""
        runs = self.runs()
        chosen = [f"{self.path}/data/{runs[r]}" for r in sorted(runs if only is None else only)]
        reader = self.spark.read.schema(self.schema).format(self.fmt)
        if self.fmt == "json":
            reader = reader.option("mode", "FAILFAST")
        return reader.load(chosen) if chosen else self.spark.createDataFrame([], self.schema)

    def fold(self, into: str, merge: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Put all runs committed so far into one; runs that come meanwhile stay beside it."""
        before = self.runs()
        attempt = self._write(merge(self.read(list(before))))
        self._commit(lambda runs: {**{r: a for r, a in runs.items() if before.get(r) != a}, into: attempt})

    def vacuum(self) -> int:
        """Delete attempts that no committed run names (not while a writer is at work); how many went."""
        keep, gone = set(self.runs().values()), 0
        fs, p = storage.file_system(self.spark, f"{self.path}/data")
        for status in fs.listStatus(p) if fs.exists(p) else []:
            if status.getPath().getName() not in keep and fs.delete(status.getPath(), True):
                gone += 1
        return gone
