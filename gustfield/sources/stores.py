"""Stored tables of runs: written whole, checked when they are read, renewed without doubling, evicted by age and number.

A store is a folder partitioned by ``run``. Writing a run again replaces it (only its partition), so a writer that failed half-way or was
started twice leaves one copy. What a store refuses has a code in its message: other-schema, no-key, duplicate-key, stale, no-such-run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Refused(ValueError):
    """What can't be read or written; ``code`` says why."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


class Store:
    """Rows of ``schema`` with a unique ``key`` in every run, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema)

    def _folder(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def write(self, rows: DataFrame, run: str) -> None:
        """Replaces the run. The key is checked on what was written, before it takes the run's place."""
        names = [f.name for f in self.schema]
        if sorted(rows.columns) != sorted(names) or any(rows.schema[f.name].dataType != f.dataType for f in self.schema):
            raise Refused("other-schema", f"{rows.schema.simpleString()} isn't {self.schema.simpleString()}")
        fs, new = self._folder(f"_new/run={run}")
        fs.delete(new, True)
        rows.select(*names).write.parquet(f"{self.path}/_new/run={run}")
        made = self.spark.read.schema(self.schema).parquet(f"{self.path}/_new/run={run}")
        nulls = made.where(" or ".join(f"`{k}` is null" for k in self.key)).limit(1)
        twice = made.groupBy(*self.key).count().where("count > 1").limit(1)
        code = "no-key" if not nulls.isEmpty() else "duplicate-key" if not twice.isEmpty() else None
        if code:
            fs.delete(new, True)
            raise Refused(code, f"run {run}, key {', '.join(self.key)}")
        _, old = self._folder(f"run={run}")
        fs.delete(old, True)
        fs.mkdirs(old.getParent())
        if not fs.rename(new, old):
            raise Refused("not-written", f"run {run} could not take its place")

    def runs(self) -> dict[str, int]:
        """Runs and when each was written (milliseconds)."""
        fs, at = self._folder()
        if not fs.exists(at):
            return {}
        found = {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(at) if s.isDirectory()}
        return {n.removeprefix("run="): t for n, t in found.items() if n.startswith("run=")}

    def read(self, run: str | None = None, now_ms: int | None = None, max_age_ms: int | None = None) -> DataFrame:
        """A run's rows, or all with ``run``. A run older than ``max_age_ms`` at ``now_ms`` is stale; files of other columns are refused."""
        have = self.runs()
        if run is not None and run not in have:
            raise Refused("no-such-run", f"{run}; there are {', '.join(sorted(have)) or 'none'}")
        old = sorted(r for r in ([run] if run is not None else have) if max_age_ms is not None and now_ms - have[r] > max_age_ms)
        if old:
            raise Refused("stale", f"runs {', '.join(old)}")
        for r in [run] if run is not None else have:
            stored = self.spark.read.parquet(f"{self.path}/run={r}").schema
            if [(f.name, f.dataType) for f in stored] != [(f.name, f.dataType) for f in self.schema]:
                raise Refused("other-schema", f"run {r} has {stored.simpleString()}")
        if not have:
            return self.spark.createDataFrame([], StructType([*self.schema.fields]).add("run", "string"))
        if run is not None:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/run={run}").withColumn("run", F.lit(run))
        whole = StructType([*self.schema.fields]).add("run", "string")
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*[f"{self.path}/run={r}" for r in have])

    def evict(self, now_ms: int, max_age_ms: int | None = None, keep: int | None = None) -> list[str]:
        """Deletes runs that are too old, then the oldest beyond ``keep`` (equally old ones by name); returns them."""
        have = sorted(self.runs().items(), key=lambda x: (x[1], x[0]))
        gone = [r for r, t in have if max_age_ms is not None and now_ms - t > max_age_ms]
        left = [r for r, _ in have if r not in gone]
        if keep is not None:
            gone += left[: max(len(left) - keep, 0)]
        for r in gone:
            fs, at = self._folder(f"run={r}")
            fs.delete(at, True)
        return gone
