"""A keyed table as base and delta files under a list of snapshots.

Every change writes new files first, then one small manifest that names all files of the new
snapshot and the schema; the manifest with the highest number is the table. A change that dies in between
leaves files that no manifest names, and the table as it was. Deltas hold new rows and
tombstones and are merged on reading; ``compact`` folds them into a new base. Readers of an
older snapshot keep their files until ``vacuum``.

Two writers can't both take a number: the manifest is created, never overwritten. The one that comes
second reads the newest snapshot and appends its delta there; a fold keeps the deltas
that came meanwhile. ``tag`` names a change (a stream's batch): one that is among the newest ``TAGS``
is not applied again.

A key column may hold nulls; a null is a key like any other. Rows of one change with equal keys are
reduced to the newest by ``order``; without an order to the greatest row.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col

_GONE, _AT = "_gone", "_change"
END = "end of manifest"
TAGS = 1000  # newest tags that a manifest remembers


class Conflict(RuntimeError):
    """Other writers were first again and again."""


class SnapshotTable:
    """A table of rows with a key, stored under ``path`` in any file system of the session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests -----------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, key: list[str]) -> SnapshotTable:
        """An empty table, or the one that is there."""
        table = cls(spark, path)
        if not table.versions():
            if isinstance(schema, str):
                schema = spark.createDataFrame([], schema).schema
            if missing := [k for k in key if k not in schema.names]:
                raise ValueError(f"no columns {missing} for the key")
            try:
                table._commit(0, {"key": key, "schema": schema.jsonValue(), "base": None, "deltas": [], "tags": []})
            except Conflict:
                pass  # another writer created it
        return table

    def versions(self) -> list[int]:
        """Numbers of all whole snapshots."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        numbers = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))
        # one that its writer didn't finish is not a snapshot
        return [n for n in numbers if n < numbers[-1] or self._manifest(n) is not None]

    def _manifest(self, version: int) -> dict | None:
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text.removesuffix(END)) if text.endswith(END) else None

    def manifest(self, version: int | None = None) -> dict:
        """What the newest, or a named, snapshot is made of."""
        versions = self.versions()
        if not versions or (version is not None and version not in versions):
            raise ValueError(f"no snapshot {'' if version is None else version} under {self.path}")
        found = self._manifest(versions[-1] if version is None else version)
        if found is None:
            raise ValueError(f"snapshot {version} was never finished")
        return found | {"version": versions[-1] if version is None else version}

    def _commit(self, version: int, manifest: dict) -> None:
        target = self._path(f"{self.path}/manifests/{version:010d}.json")
        manifest = {k: v for k, v in manifest.items() if k != "version"}
        try:
            out = self._fs.create(target, False)
        except Py4JJavaError as error:
            if self._fs.exists(target):
                raise Conflict(f"snapshot {version} is there already") from error
            raise
        try:
            out.write(bytearray((json.dumps(manifest) + END).encode()))
        finally:
            out.close()

    def _next_number(self) -> int:
        """One above every manifest, also unfinished ones."""
        folder = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))) + 1

    def _change(self, step, tries: int = 10) -> int:
        """Commits ``step(newest manifest)``, again on the newer one where another writer was first."""
        for _ in range(tries):
            number = self._next_number()
            new = step(self.manifest())
            if new is None:
                return self.manifest()["version"]
            try:
                self._commit(number, new)
                return number
            except Conflict:
                continue
        raise Conflict(f"{tries} attempts to change {self.path}")

    # --- changes ---------------------------------------------------------------------

    def _append(self, rows: DataFrame, tag: str | None) -> int:
        if tag is not None and tag in self.manifest()["tags"]:
            return self.manifest()["version"]
        name = f"data/delta-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")

        def step(now: dict) -> dict | None:
            if tag is not None and tag in now["tags"]:
                return None
            return now | {"deltas": [*now["deltas"], name], "tags": [*now["tags"], tag][-TAGS:] if tag is not None else now["tags"]}

        return self._change(step)

    def upsert(self, rows: DataFrame, order: list[str] | None = None, tag: str | None = None) -> int:
        """New rows, and rows in place of those with their keys; the number of the new snapshot."""
        now = self.manifest()
        key, schema = now["key"], T.StructType.fromJson(now["schema"])
        rest = [n for n in schema.names if n not in key]
        rows = rows.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        newest = F.max_by(F.struct(*rest), F.struct(*order, *[n for n in rest if n not in order])) if order else F.max(F.struct(*rest))
        rows = rows.groupBy(*key).agg(newest.alias("_row")).select(*key, "_row.*") if rest else rows.distinct()
        return self._append(rows.select(*schema.names, F.lit(False).alias(_GONE)), tag)

    def delete(self, keys: DataFrame, tag: str | None = None) -> int:
        """Tombstones for keys; unknown keys do no harm."""
        now = self.manifest()
        schema = T.StructType.fromJson(now["schema"])
        blank = [c(f.name).cast(f.dataType).alias(f.name) if f.name in now["key"] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        return self._append(keys.select(*now["key"]).distinct().select(*blank, F.lit(True).alias(_GONE)), tag)

    def compact(self) -> int:
        """One base in place of base and deltas; deltas that came meanwhile stay."""
        old = self.manifest()
        if not old["deltas"]:
            return old["version"]
        name = f"data/base-{uuid.uuid4().hex}"
        self.read(old["version"]).write.parquet(f"{self.path}/{name}")

        def step(now: dict) -> dict | None:
            if now["base"] != old["base"]:
                return None  # another fold was first: its base is as good
            return now | {"base": name, "deltas": now["deltas"][len(old["deltas"]):]}

        return self._change(step)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes the files that none of the last ``keep`` snapshots names, and the older snapshots.

        No writer may be at work: files of a change that is not committed yet would be lost.
        """
        versions = self.versions()
        kept = [self._manifest(v) for v in versions[-max(keep, 1):]]
        named = {x for m in kept for x in [m["base"], *m["deltas"]]}
        for v in versions[:-max(keep, 1)]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:010d}.json"), False)
        data = self._path(f"{self.path}/data")
        if not self._fs.exists(data):
            return []
        gone = [f"data/{s.getPath().getName()}" for s in self._fs.listStatus(data) if f"data/{s.getPath().getName()}" not in named]
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return sorted(gone)

    # --- reading ---------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest, or a named, snapshot.

        The base is not regrouped: its rows lose the keys of the deltas (an anti join with the
        small side's keys), and the newest delta row of each key comes in their place.
        """
        now = self.manifest(version)
        schema, key = T.StructType.fromJson(now["schema"]), now["key"]
        if now["base"] is None:
            base = self.spark.createDataFrame([], schema)
        else:
            base = self.spark.read.schema(schema).parquet(f"{self.path}/{now['base']}")
        if not now["deltas"]:
            return base
        wide = T.StructType([*schema.fields, T.StructField(_GONE, T.BooleanType())])
        parts = [self.spark.read.schema(wide).parquet(f"{self.path}/{name}").withColumn(_AT, F.lit(n)) for n, name in enumerate(now["deltas"])]
        deltas = reduce(DataFrame.unionByName, parts)
        rest = [n for n in schema.names if n not in key]
        newest = deltas.groupBy(*key).agg(F.max_by(F.struct(*rest, _GONE), _AT).alias("_row"))
        rows = newest.where(~c(f"_row.{_GONE}")).select(*key, *[c(f"_row.{n}").alias(n) for n in rest]).select(*schema.names)
        if now["base"] is None:
            return rows
        keys = newest.select(*[c(k).alias(f"_{k}") for k in key])
        same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_{k}")) for k in key])
        return base.join(keys, same, "left_anti").select(*schema.names).unionByName(rows)
