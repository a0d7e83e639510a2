"""Tables in the folder that all executors share: cut lineage, and several tables that change at once under one manifest."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local master without that setting gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="vetspan-")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: the rows as a new Parquet table of the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/vetspan/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Snapshots:
    """Tables under one folder, read and changed together.

    A version is a manifest, a small text file that names the folder of each table's rows. A change writes
    the new rows into fresh folders first and publishes the manifest last, by a rename that fails if
    another writer published that version before. So readers see all tables of one version or of the one
    before, and a job that dies between two writes leaves the last version as it is.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._hadoop.Path(name)

    def versions(self) -> list[int]:
        """Published versions in order."""
        place = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """For each table the folders and the schema (as text) of a version, by default of the last; none before the first."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else None
        if version is None:
            return {}
        if version not in found:
            raise ValueError(f"no version {version} in {self.folder}")
        (row,) = self.spark.read.text(f"{self.folder}/manifests/{version:010d}.json", wholetext=True).collect()
        return json.loads(row.value)

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        return {name: self.spark.read.schema(t["schema"]).parquet(*t["folders"]) for name, t in self.manifest(version).items()}

    def publish(self, tables: dict[str, DataFrame], based_on: int | None = None, appended: dict[str, DataFrame] | None = None) -> int:
        """Write the given tables and the rows appended to others, keep the rest of the version they are based on (by default the last), publish all as the next version."""
        found = self.versions()
        base = based_on if based_on is not None else (found[-1] if found else 0)
        manifest = self.manifest(base) if base else {}
        for new, more in ((tables, False), (appended or {}, True)):
            for name, rows in new.items():
                before = manifest[name]["folders"] if more and name in manifest else []
                if before:
                    rows = rows.select(self.spark.createDataFrame([], manifest[name]["schema"]).columns)
                folder = f"{self.folder}/rows/{name}-{uuid.uuid4().hex}"
                rows.write.parquet(folder)
                manifest[name] = {"folders": [*before, folder], "schema": _ddl(rows)}
        return self._publish(manifest, base + 1)

    def _publish(self, manifest: dict, version: int) -> int:
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
        draft, final = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifests/{version:010d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} was published by another writer; read it and change that")
        return version

    @contextmanager
    def change(self) -> Iterator[dict[str, DataFrame]]:
        """A mapping of tables to change in place; what was set is published when the block ends, nothing if it fails."""
        found = self.versions()
        base = found[-1] if found else 0
        tables = self.read(base) if base else {}
        before = dict(tables)
        yield tables
        changed = {n: t for n, t in tables.items() if before.get(n) is not t}
        if changed:
            self.publish(changed, base)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the manifests but the last `keep`, and folders of rows that no manifest left names; gives those folders.

        Rows of a change that is still being written are in no manifest: don't run it beside a writer.
        """
        for version in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{version:010d}.json"), False)
        named = {f.rsplit("/", 1)[1] for v in self.versions() for t in self.manifest(v).values() for f in t["folders"]}
        place = self._path(f"{self.folder}/rows")
        old = [s.getPath() for s in self._fs.listStatus(place) if s.getPath().getName() not in named] if self._fs.exists(place) else []
        for path in old:
            self._fs.delete(path, True)
        return sorted(p.getName() for p in old)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

