"""Versioned tables: folders of Parquet that count once a snapshot names them.

A snapshot is one small file.  It names the folders of every table, the folder of every state, and some numbers; writing it is
the commit of all of them together.  Readers take the newest snapshot and the folders it names, so they never list a
table's history and never see half a commit.  A version that a snapshot holds is not written again.

Each commit adds one folder to a table.  As soon as a table has ``FAN_IN`` folders of one level, they are merged into one of the next
level, so that the folders a table consists of grow with the logarithm of its commits.  Folders that no kept snapshot
names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostpulse.sources.tables import delete_folder, subfolders

FAN_IN = 8
SNAPSHOTS_KEPT = 3
_LEVEL = "."


def level_of(folder: str) -> int:
    return int(folder.partition(_LEVEL)[2] or 0)


def merged_name(folders: list[str]) -> str:
    """The folder of the next level: it sorts behind all that it holds and before what comes after."""
    return f"{folders[-1].partition(_LEVEL)[0]}{_LEVEL}{level_of(folders[-1]) + 1}"


def due_for_merge(folders: list[str], fan_in: int = FAN_IN) -> list[str]:
    """The newest folders, all of one level, that are to be merged; empty if there are too few."""
    run = []
    for folder in reversed(folders):
        if run and level_of(folder) != level_of(run[-1]):
            break
        run.append(folder)
    return run[::-1] if len(run) >= fan_in else []


@dataclass(frozen=True)
class Snapshot:
    """What was committed last: ``version``, folders per table, one folder per state, schemas, and numbers."""

    version: str = ""
    tables: dict[str, list[str]] = field(default_factory=dict)
    states: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    numbers: dict[str, int] = field(default_factory=dict)

    def holds(self, version: str) -> bool:
        """Whether a version is committed (versions are committed in order)."""
        return version <= self.version

    def folders(self) -> set[str]:
        return {f"{t}/{f}" for t, fs in self.tables.items() for f in fs} | {f"state/{s}/{f}" for s, f in self.states.items()}


class Versions:
    """The versioned tables and states below ``root``."""

    def __init__(self, spark: SparkSession, root: str, *, fan_in: int = FAN_IN):
        self.spark, self.root, self.fan_in = spark, root, fan_in

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/snapshots")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/snapshots/{name}")

    def _names(self) -> list[str]:
        """Snapshots, oldest first; no more than are kept and one."""
        return [n for n in subfolders(self.spark, f"{self.root}/snapshots") if n.endswith(".json")]

    def _read(self, name: str) -> Snapshot:
        files = self._files()
        stream = files.open(self._path(name))
        try:
            return Snapshot(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def newest(self) -> Snapshot:
        names = self._names()
        return self._read(names[-1]) if names else Snapshot()

    def folder(self, table: str, version: str) -> str:
        return f"{self.root}/{table}/version={version}"

    def write(self, df: DataFrame, table: str, version: str, *, partition: list[str] | None = None) -> DataFrame:
        """Write one version of a table or state, in place of what a failed try left, and read it back."""
        target = self.folder(table, version)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition) if partition else writer).parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def table(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """All rows of a table, with their ``version`` folder."""
        snapshot = snapshot or self.newest()
        folders = snapshot.tables.get(name)
        if not folders:
            raise ValueError(f"no finished batch has written {name}")
        schema = T.StructType.fromJson(json.loads(snapshot.schemas[name])).add("version", T.StringType())
        paths = [self.folder(name, f) for f in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def state(self, name: str, snapshot: Snapshot | None = None) -> DataFrame | None:
        """The newest state, or None before the first."""
        snapshot = snapshot or self.newest()
        folder = snapshot.states.get(name)
        if folder is None:
            return None
        schema = T.StructType.fromJson(json.loads(snapshot.schemas[f"state/{name}"]))
        return self.spark.read.schema(schema).parquet(self.folder(f"state/{name}", folder))

    def commit(
        self,
        version: str,
        before: Snapshot,
        *,
        tables: dict[str, T.StructType],
        states: dict[str, T.StructType] | None = None,
        numbers: dict[str, int] | None = None,
    ) -> Snapshot:
        """Make the folders written for ``version`` count, all at once."""
        if before.holds(version):
            raise ValueError(f"version {version} is already committed")
        plain = {f"state/{n}": s for n, s in (states or {}).items()} | tables
        after = Snapshot(
            version,
            before.tables | {t: [*before.tables.get(t, []), version] for t in tables},
            before.states | dict.fromkeys(states or {}, version),
            before.schemas | {n: _plain(s).json() for n, s in plain.items()},
            before.numbers | (numbers or {}),
        )
        self._publish(after, f"{version}.json")
        return after

    def note(self, snapshot: Snapshot, numbers: dict[str, int]) -> Snapshot:
        """The same version with further numbers."""
        after = replace(snapshot, numbers=snapshot.numbers | numbers)
        self._publish(after, f"{after.version}{_LEVEL}noted.json")
        return after

    def compact(self, snapshot: Snapshot, rewrite: dict[str, Callable[[DataFrame, str], object]] | None = None) -> Snapshot:
        """Merge what is due, level by level, and remove folders that are no longer named.

        ``rewrite`` has tables that are written in their own way: a function of the merged rows and the new folder's name.
        """
        after = snapshot
        for table in sorted(snapshot.tables):
            while due := due_for_merge(after.tables[table], self.fan_in):
                name = merged_name(due)
                rows = self.table(table, replace(after, tables={table: due})).drop("version")
                if rewrite and table in rewrite:
                    rewrite[table](rows, name)
                else:
                    self.write(rows, table, name, partition=["event_date"] if "event_date" in rows.columns else None)
                kept = [f for f in after.tables[table] if f not in due]
                after = replace(after, tables=after.tables | {table: [*kept, name]})
        if after is not snapshot:
            # the same version again, with other folders of the same rows
            self._publish(after, f"{after.version}{_LEVEL}merged.json")
        self._clean()
        return after

    def _publish(self, snapshot: Snapshot, name: str) -> None:
        files, hidden = self._files(), self._path(f".{name}.writing")
        out = files.create(hidden, True)
        out.write(bytearray(json.dumps(snapshot.__dict__, indent=1), "utf-8"))
        out.close()
        files.delete(self._path(name), False)
        if not files.rename(hidden, self._path(name)):
            raise OSError(f"snapshot {name} cannot be published")

    def _clean(self) -> None:
        """Remove snapshots beyond those kept, and the folders that only they name."""
        names = self._names()
        old, kept = names[:-SNAPSHOTS_KEPT], names[-SNAPSHOTS_KEPT:]
        named = set().union(*(self._read(n).folders() for n in kept)) if old else set()
        for name in old:
            for folder in sorted(self._read(name).folders() - named):
                table, _, version = folder.rpartition("/")
                delete_folder(self.spark, self.folder(table, version))
            self._files().delete(self._path(name), False)


def _plain(schema: T.StructType) -> T.StructType:
    """The schema as files are read: everything may be null."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
