"""Tenants' tables as partitioned Parquet."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from datetime import UTC, datetime

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.config import InvalidTenant
from tarnwick.functions.ids import TENANT_ID
from tarnwick.schema import INDEXED_PROPERTY, KEYS, SUBPARTITIONS, TABLES
from tarnwick.session import delete, table

COMMITS = "version long, time timestamp, tables array<string>, note string"


class Store:
    """Tenants under a root folder of any file system that Spark reads.

    Tables with a key are partitioned by a hash of it: documents, snippets and postings by document, interactions,
    interests, tag weights and last-seen times by user. Documents are parted by ``is_candidate`` too, so that a search
    doesn't read the others. A change rewrites the partitions of its keys by Spark's dynamic overwrite, which puts new files in
    place once all are written, and no others; tables are written in the order given. Changes of the same partition at the same
    time are the caller's to avoid; a frame read before a change is not to be used after it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._options: dict[str, dict] = {}
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _dir(self, tenant: str) -> str:
        if not re.match(TENANT_ID, tenant):
            raise InvalidTenant(tenant=tenant)
        return f"{self.root}/{tenant}"

    def path(self, tenant: str, name: str) -> str:
        return f"{self._dir(tenant)}/{name}"

    def _names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self._fs.exists(self._path(path)) else []

    def has(self, tenant: str, name: str) -> bool:
        return bool(self._names(self.path(tenant, name)))

    # --- tenants ---

    def tenants(self) -> list[str]:
        return self._names(self.root)

    def create(self, tenant: str, embedder: str = "hashing-64", partitions: int = 16) -> None:
        """partitions: of each table with a key; at least as many as the tables are to have tasks. It stays for good."""
        if tenant in self.tenants():
            raise InvalidTenant(tenant=tenant, reason="exists")
        for name in (*TABLES, "commits"):
            self._fs.mkdirs(self._path(self.path(tenant, name)))
        first = self.spark.createDataFrame([("publication_date", "date")], INDEXED_PROPERTY)
        self._put_options(tenant, {"embedder": embedder, "partitions": partitions})
        self.commit(tenant, {"indexed_property": first})

    def drop(self, tenant: str) -> None:
        """The tenant and all its tables."""
        if tenant not in self.tenants():
            raise InvalidTenant(tenant=tenant, reason="unknown")
        delete(self.spark, self._dir(tenant))
        self._options.pop(tenant, None)

    def options(self, tenant: str) -> dict:
        if tenant not in self._options:
            if not self._names(self.path(tenant, "options")):
                raise InvalidTenant(tenant=tenant, reason="unknown")
            self._options[tenant] = json.loads(self.spark.read.text(self.path(tenant, "options")).first()[0])
        return self._options[tenant]

    def _put_options(self, tenant: str, options: dict) -> None:
        self.spark.createDataFrame([(json.dumps(options),)], "value string").coalesce(1).write.mode("overwrite").text(self.path(tenant, "options"))
        self._options[tenant] = options

    def commits(self, tenant: str) -> DataFrame:
        """A row for each change: version, time, tables, note."""
        return self.spark.read.schema(COMMITS).json(self.path(tenant, "commits"))

    def versions(self, tenant: str) -> list[int]:
        self.options(tenant)
        return sorted(r["version"] for r in self.commits(tenant).select("version").collect())

    def _log(self, tenant: str, tables: Iterable[str], note: str) -> int:
        path = self.path(tenant, "commits")
        version = sum(n.startswith("part-") for n in self._names(path)) + 1  # a file for each change
        row = self.spark.createDataFrame([(version, datetime.now(UTC), list(tables), note)], COMMITS)
        row.coalesce(1).write.mode("append").json(path)
        return version

    # --- rows ---

    def part_of(self, key: str, partitions: int) -> int:
        """The partition of a key, as part() computes it."""
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        return (h - (1 << 64) if h >> 63 else h) % partitions

    def part(self, key: Column, partitions: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")

    def _part_of_rows(self, name: str, partitions: int) -> Column:
        """Blocks of postings are numbered so that theirs is the partition of their documents."""
        return F.pmod("block", F.lit(partitions)).cast("int") if name == "postings" else self.part(F.col(KEYS[name]), partitions)

    def parts(self, tenant: str, keys: Iterable[str] | DataFrame) -> list[int]:
        """The partitions of keys, given as strings or as a frame's first column; there are no more than a table has."""
        n = self.options(tenant)["partitions"]
        if isinstance(keys, DataFrame):
            key = F.col(keys.columns[0])
            return sorted(r[0] for r in keys.where(key.isNotNull()).select(self.part(key, n)).distinct().collect())
        return sorted({self.part_of(k, n) for k in keys})

    def table(self, tenant: str, name: str, parts: list[int] | None = None) -> DataFrame:
        """All rows of a table, or those of some partitions, which alone are read then."""
        schema = TABLES[name]
        if name not in KEYS:
            return self.spark.read.schema(schema).parquet(self.path(tenant, name))
        out = self.spark.read.schema(_ddl(schema, "part int")).parquet(self.path(tenant, name))
        out = out if parts is None else out.where(F.col("part").isin(parts))
        return out.select(*schema.names)

    def tables(self, tenant: str) -> dict[str, DataFrame]:
        self.options(tenant)
        return {name: self.table(tenant, name) for name in TABLES}

    def commit(self, tenant: str, changed: dict[str, DataFrame], options: dict | None = None, note: str = "") -> int:
        """Replaces whole tables."""
        if options:
            self._put_options(tenant, self.options(tenant) | options)
        return self.replace(tenant, changed, None, note)

    def replace(self, tenant: str, changed: dict[str, DataFrame], parts: list[int] | dict[str, list[int]] | None, note: str = "") -> int:
        """Replaces what the tables have in the partitions parts (for all tables, or for each) by the rows given, which are
        all that they are to have there; in whole tables without parts. Tables without a key are replaced whole."""
        n = self.options(tenant)["partitions"]
        for name, df in changed.items():
            rows = df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])
            mine = parts.get(name, []) if isinstance(parts, dict) else parts
            if name not in KEYS or mine is None:
                rows = table(rows, f"next-{name}") if self.has(tenant, name) else rows  # it may read what it replaces
            if name not in KEYS:
                rows.write.mode("overwrite").parquet(self.path(tenant, name))
            else:
                self._overwrite(self.path(tenant, name), rows.withColumn("part", self._part_of_rows(name, n)), ["part", *SUBPARTITIONS.get(name, [])], mine)
        return self._log(tenant, changed, note)

    def _overwrite(self, path: str, rows: DataFrame, by: list[str], parts: list[int] | None) -> None:
        dealt = rows.hint("rebalance", *by).sortWithinPartitions(*by, *[c for c in ("term",) if c in rows.columns])
        if parts is None:
            dealt.write.mode("overwrite").partitionBy(*by).parquet(path)
            return
        leaves = [f"{path}/part={p}" for p in parts]
        leaves = leaves if len(by) == 1 else [f"{leaf}/{x}" for leaf in leaves for x in self._names(leaf)]
        before = {leaf: set(self._names(leaf)) for leaf in leaves}
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        for leaf, files in before.items():
            if files & set(self._names(leaf)):  # no row came, so Spark has left what was there
                delete(self.spark, leaf)

    def indexed_properties(self, tenant: str) -> dict[str, str]:
        return {r["name"]: r["type"] for r in self.table(tenant, "indexed_property").collect()}


def _ddl(schema, *more: str) -> str:
    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema.fields] + list(more))
