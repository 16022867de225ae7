"""Tables kept in slices: a new version writes the slices that it touches and names the others where they are.

A slice is a number that a row's slice column has: a span of time or a bucket of keys. Rows of version k lie under
v=k/slice=s; its manifest m=k_tag has a row for each slice with the version that wrote it last, its number of
rows and facts about it. A version counts once its manifest is committed, so a failed one leaves files that nothing
names, and the next attempt overwrites them. A tag tells which change a version came from: a change
that is delivered again finds its tag and does nothing.

The driver sees manifests: a row for each slice, never one for each row or key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay, for readers of the last ones.
KEPT = 3


class Slices:
    def __init__(self, spark: SparkSession, folder: str, schema: str, order: list[str], facts: dict[str, Column] | None = None) -> None:
        """order: columns that a slice's rows are sorted by; facts: aggregates that a manifest has for each slice."""
        self.spark, self.folder, self.schema, self.order, self.facts = spark, folder.rstrip("/"), schema, order, facts or {}

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self) -> list[tuple[int, str, str]]:
        """Number, tag and folder of each committed manifest."""
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        known = [n for n in names if n.startswith("m=") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted((int(n[2:].split("_", 1)[0]), n.split("_", 1)[1], n) for n in known)

    def versions(self) -> list[int]:
        return [k for k, _, _ in self._names()]

    def has(self, tag: str) -> bool:
        """Whether one of the kept versions came from a change of this tag."""
        return any(t == tag for _, t, _ in self._names())

    def manifest(self, version: int | None = None) -> list:
        """The rows of a version's manifest, by slice; of the newest without a version."""
        known = [n for k, _, n in self._names() if version is None or k == version]
        return sorted(self.spark.read.parquet(f"{self.folder}/{known[-1]}").where("slice is not null").collect(), key=lambda r: r["slice"]) if known else []

    def paths(self, slices: Iterable[int] | None = None, version: int | None = None) -> list[str]:
        wanted = None if slices is None else set(slices)
        return [f"{self.folder}/v={r['version']}/slice={r['slice']}" for r in self.manifest(version) if wanted is None or r["slice"] in wanted]

    def read(self, slices: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of some slices or of all; only these slices' files are opened."""
        found = self.paths(slices, version)
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, touched: Iterable[int], tag: str, laid: bool = False) -> int:
        """A new version: rows (with the column slice) take the place of all rows of the touched slices.

        laid: rows are partitioned so that a slice is in few partitions, and are only sorted there; others are laid by ranges.
        """
        names, touched = self._names(), set(touched)
        version = names[-1][0] + 1 if names else 0
        data = f"{self.folder}/v={version}"
        rows = rows.select(*self.spark.createDataFrame([], self.schema).columns, "slice")
        placed = rows if laid else rows.repartitionByRange("slice", *self.order)
        placed.sortWithinPartitions("slice", *self.order).write.mode("overwrite").partitionBy("slice").parquet(data)
        # Read with a schema, so that no rows at all are fine too.
        stored = self.spark.read.schema(f"{self.schema}, slice long").parquet(data)
        fresh = stored.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in self.facts.items())).withColumn("version", F.lit(version).cast("long"))
        if names:
            old = self.spark.read.parquet(f"{self.folder}/{names[-1][2]}")
            fresh = fresh.unionByName(old.where(~F.col("slice").isin(*touched) if touched else F.lit(True)))
        fresh.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/m={version:09d}_{tag}")  # a row for each slice
        self._clean()
        return version

    def _clean(self) -> None:
        """Removes the oldest manifests, and the slices that only they name."""
        names = self._names()
        if len(names) <= KEPT:
            return
        fs, path = self._fs()
        held = {(r["slice"], r["version"]) for k, _, _ in names[-KEPT:] for r in self.manifest(k)}
        for k, _, name in names[:-KEPT]:
            for r in self.manifest(k):
                if (r["slice"], r["version"]) not in held:
                    fs.delete(path(f"{self.folder}/v={r['version']}/slice={r['slice']}"), True)
            fs.delete(path(f"{self.folder}/{name}"), True)

    def changes(self, old: int | None, new: int) -> tuple[DataFrame, DataFrame]:
        """The rows that a version has and a later one hasn't, and the other way round; only slices that differ are read."""
        before = {r["slice"]: r["version"] for r in self.manifest(old)} if old is not None else {}
        after = {r["slice"]: r["version"] for r in self.manifest(new)}
        differ = [s for s in before.keys() | after.keys() if before.get(s) != after.get(s)]
        was = self.read(differ, old) if old is not None else self.spark.createDataFrame([], self.schema)
        now = self.read(differ, new)
        return was.exceptAll(now), now.exceptAll(was)
