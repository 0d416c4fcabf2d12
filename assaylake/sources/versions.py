"""Tables that change together: new parts are written first, then one rename makes them all visible.

A version is a small manifest, which names for each table the folders that make it up. A batch that
fails, or is lost with its driver, before the rename leaves the version before it as it was; run again it is
written once, since the manifest also says which batch of which writer was the last.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIGITS = 12


class Conflict(RuntimeError):
    """Another writer has made the next version first; read again and try again."""


class VersionedTables:
    """The tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version; 0 if there is none yet."""
        path, fs = self._path("_versions")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "last": {}}
        row = self.spark.read.text(f"{self.root}/_versions/{version:0{_DIGITS}d}", wholetext=True).first()
        return json.loads(row.value)

    def read(self, name: str, schema, version: int | None = None) -> DataFrame:
        """A table as it was at a version; without rows if it has none."""
        folders = self.manifest(version)["tables"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def commit(self, parts: dict[str, DataFrame], writer: str = "", batch: int | None = None, base: dict | None = None, replace: tuple[str, ...] = ()) -> int:
        """Adds rows to tables (or replaces them) as one new version, and returns it.

        A batch number that the writer has committed before, or a later one, changes nothing. ``base``: the manifest that
        the parts were made from; if another version has come since, Conflict is raised and nothing is visible.
        """
        base = self.manifest() if base is None else base
        if batch is not None and base["last"].get(writer, -1) >= batch:
            return base["version"]
        tables = {k: list(v) for k, v in base["tables"].items()}
        for name, df in parts.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            tables[name] = [*([] if name in replace else tables.get(name, [])), folder]
        last = base["last"] | ({} if batch is None else {writer: batch})
        return self._publish({"version": base["version"] + 1, "tables": tables, "last": last})

    def _publish(self, manifest: dict) -> int:
        temporary, fs = self._path(f"_temporary/{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final, _ = self._path(f"_versions/{manifest['version']:0{_DIGITS}d}")
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise Conflict(f"version {manifest['version']} exists")
        return manifest["version"]


def append_once(tables: VersionedTables, batch: DataFrame, key: str, writer: str, number: int) -> int:
    """New rows go to ``rows``, rows that differ from a known one of their key to ``conflicts``, both in one version."""
    from ..operators.journal import append_log

    base = tables.manifest()
    if base["last"].get(writer, -1) >= number:
        return base["version"]
    fresh, conflicts = append_log(tables.read("rows", batch.schema, base["version"]), batch, key)
    return tables.commit({"rows": fresh, "conflicts": conflicts}, writer, number, base)
