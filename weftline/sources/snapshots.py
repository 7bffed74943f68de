"""Several tables changed in one transaction: new versions are written beside the old ones, and one manifest names those that count.

A manifest is a small file with a number; the largest one is the state. It is created complete and under a name that no other has, so a commit is one
rename: what fails before it changes nothing, and of two writers that started from one state the second is refused. Readers keep
the manifest that they opened, whatever is committed after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed since this one read the state."""


class Store:
    """Tables under a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self.path(f"{self.root}/_manifests")
        names = [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        """(version, folder of each table): the newest, or the one asked for; version 0 has no tables."""
        held = self.versions()
        version = (held[-1] if held else 0) if version is None else version
        if not version:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/_manifests/{version}", wholetext=True).first()[0]
        return version, json.loads(text)

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of one version, all of the same transaction."""
        return {name: self.spark.read.parquet(f"{self.root}/{folder}") for name, folder in self.manifest(version)[1].items()}

    def commit(self, base: int, folders: dict[str, str]) -> int:
        """Make these folders the state after version `base`."""
        draft = self.path(f"{self.root}/_drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(folders).encode()))
        finally:
            out.close()
        at = self.path(f"{self.root}/_manifests/{base + 1}")
        self.fs.mkdirs(at.getParent())
        if self.fs.exists(at) or not self.fs.rename(draft, at):
            self.fs.delete(draft, False)
            raise Conflict(f"version {base + 1} of {self.root} is there already")
        return base + 1

    def upsert(self, changes: dict[str, tuple[DataFrame, Sequence[str]]]) -> int:
        """One transaction: in each table rows are replaced by those of its new ones with their keys, others are added; the new version.

        Twice the same is once. Of new rows that share their keys the one largest in its other columns (as JSON) counts. Tables that aren't named stay as they are.
        """
        base, folders = self.manifest()
        folders = dict(folders)
        for name, (new, keys) in changes.items():
            others = F.to_json(F.struct(*[F.col(c) for c in new.columns if c not in keys])) if set(new.columns) - set(keys) else F.lit("")
            one = new.withColumn("_said", others).groupBy(*keys).agg(F.max_by(F.struct(*new.columns), "_said").alias("_row")).select("_row.*")
            if name in folders:
                old = self.spark.read.parquet(f"{self.root}/{folders[name]}")
                one = old.join(one.select(*keys), list(keys), "left_anti").unionByName(one, allowMissingColumns=True)
            folders[name] = f"{name}/{uuid.uuid4().hex}"
            one.write.parquet(f"{self.root}/{folders[name]}")
        return self.commit(base, folders)

    def vacuum(self, keep: int = 1) -> None:
        """Drop all but the newest `keep` versions, and folders that no version left names (no writer may be at work)."""
        held = self.versions()
        for version in held[: max(len(held) - keep, 0)]:
            self.fs.delete(self.path(f"{self.root}/_manifests/{version}"), False)
        used = {folder for version in self.versions() for folder in self.manifest(version)[1].values()}
        for table in self.fs.listStatus(self.path(self.root)):
            name = table.getPath().getName()
            for version in self.fs.listStatus(table.getPath()) if table.isDirectory() and name != "_manifests" else []:
                if f"{name}/{version.getPath().getName()}" not in used:
                    self.fs.delete(version.getPath(), True)
