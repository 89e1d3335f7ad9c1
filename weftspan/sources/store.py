"""Versions of crawl tables as Parquet, put in force together by small manifests.

A version is written whole under a new name. A manifest then names the versions that make up each
table; the last manifest is in force, so what a batch changes in several tables counts at once or, if
the job dies before, not at all. A table may be several versions: what is only ever added to isn't
written again. Files are reached through Hadoop's file systems, so any path that Spark can read will do.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Versions of a table that is added to before they become one.
DELTAS = 20


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._path(path)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _numbers(self, path: str, pattern: str) -> list[int]:
        return sorted(int(m[1]) for n in self._names(path) if (m := re.fullmatch(pattern, n)))

    def _commits(self) -> list[int]:
        return self._numbers(f"{self.root}/commits", r"c(\d+)\.json")

    def _manifest(self, number: int) -> dict[str, list[int]]:
        fs, at = self._path(f"{self.root}/commits/c{number:08d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self, table: str) -> list[int]:
        """Complete versions, in force or not."""
        return [v for v in self._numbers(f"{self.root}/{table}", r"v(\d+)") if "_SUCCESS" in self._names(f"{self.root}/{table}/v{v:08d}")]

    def current(self) -> dict[str, list[int]]:
        """The versions in force; without a manifest the last one of each table."""
        if have := self._commits():
            return self._manifest(have[-1])
        return {t: v[-1:] for t in self._names(self.root) if (v := self.versions(t))}

    def read(self, table: str) -> DataFrame | None:
        have = self.current().get(table)
        return self.spark.read.parquet(*[f"{self.root}/{table}/v{v:08d}" for v in have]) if have else None

    def commit(self, whole: dict[str, DataFrame] | None = None, more: dict[str, DataFrame] | None = None) -> None:
        """Replaces the tables of `whole` and adds to those of `more`, all at once. Tables of many additions are joined into one version."""
        now = self.current()

        def put(table: str, rows: DataFrame) -> int:
            number = max(self._numbers(f"{self.root}/{table}", r"v(\d+)"), default=0) + 1
            rows.write.mode("overwrite").parquet(f"{self.root}/{table}/v{number:08d}")
            return number

        then = {t: list(v) for t, v in now.items()}
        for t, rows in (whole or {}).items():
            then[t] = [put(t, rows)]
        for t, rows in (more or {}).items():
            if len(now.get(t, [])) >= DELTAS:
                then[t] = [put(t, self.read(t).unionByName(rows))]
            else:
                then[t] = [*then.get(t, []), put(t, rows)]
        number = max(self._commits(), default=0) + 1
        fs, at = self._path(f"{self.root}/commits/.c{number:08d}.{uuid.uuid4().hex}")
        out = fs.create(at)
        out.write(bytearray(json.dumps(then).encode()))
        out.close()
        fs.rename(at, self._path(f"{self.root}/commits/c{number:08d}.json")[1])

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """A new version of one table, read back."""
        self.commit({table: rows})
        return self.spark.read.schema(rows.schema).parquet(*[f"{self.root}/{table}/v{v:08d}" for v in self.current()[table]])

    def prune(self, keep: int = 2) -> None:
        """Deletes all but the last manifests, and complete versions that none of them names."""
        commits = self._commits()
        named: dict[str, set[int]] = {}
        for c in commits[-keep:]:
            for t, have in self._manifest(c).items():
                named.setdefault(t, set()).update(have)
        for t, have in named.items():
            for v in set(self.versions(t)) - have:
                fs, at = self._path(f"{self.root}/{t}/v{v:08d}")
                fs.delete(at, True)
        for c in commits[:-keep]:
            fs, at = self._path(f"{self.root}/commits/c{c:08d}.json")
            fs.delete(at, False)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors see. Where none is set, a session in one process makes a local one, and any other is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="weftspan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialized(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder, for what reads them more than once."""
    path = f"{shared_dir(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header line in each file."""
    rows.write.mode("overwrite").option("header", True).csv(path)
