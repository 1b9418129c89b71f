"""Vectors in NPY files: a data source that writes them and tells which rows it could not write, and a reader."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows of one file.
ROWS_A_FILE = 100_000
MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: pairs of files (ids, vectors), and its file of failures, if it has one."""

    files: list[str]
    failures: str | None
    rows: int
    failed: int


class NpyWriter(DataSourceWriter):
    """Each task writes files of names of its own; they count once the driver has listed them in the manifest, so what a lost or
    repeated task left is never read."""

    def __init__(self, path: str, dim: int):
        self.path, self.dim = path.rstrip("/"), dim

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def _put(self, name: str, data: bytes) -> None:
        files, root = self._open()
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(data)

    def write(self, iterator: Iterator[Row]) -> Written:
        own, names, ids, vectors, rows, failed = uuid.uuid4().hex, [], [], [], 0, []

        def flush() -> None:
            name = f"{own}-{len(names)}"
            for kind, values in (("ids", np.array(ids, np.int64)), ("vectors", np.array(vectors, np.float32).reshape(-1, self.dim))):
                held = io.BytesIO()
                np.save(held, values)
                self._put(f"{name}.{kind}.npy", held.getvalue())
            names.append(name)
            ids.clear()
            vectors.clear()

        for row in iterator:
            key, vector = row[0], row[1]
            reason = None
            if key is None or vector is None:
                reason = "null"
            elif len(vector) != self.dim:
                reason = "length"
            elif not all(x is not None and np.isfinite(x) for x in vector):
                reason = "number"
            if reason:
                failed.append({"id": key, "reason": reason})
                continue
            ids.append(key)
            vectors.append(vector)
            rows += 1
            if len(ids) >= ROWS_A_FILE:
                flush()
        if ids:
            flush()
        if failed:
            self._put(f"{own}.failed.jsonl", "\n".join(map(json.dumps, failed)).encode())
        return Written(names, f"{own}.failed.jsonl" if failed else None, rows, len(failed))

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        whole = {"files": sorted(f for m in told for f in m.files), "failures": sorted(m.failures for m in told if m.failures), "rows": sum(m.rows for m in told), "failed": sum(m.failed for m in told), "dim": self.dim}
        self._put(MANIFEST, json.dumps(whole).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = self._open()
        for m in messages:
            for name in [x for f in m.files for x in (f"{f}.ids.npy", f"{f}.vectors.npy")] + [m.failures] * bool(m.failures) if m is not None else ():
                files.delete_file(f"{root}/{name}")


class NpySource(DataSource):
    """Format ``npy``, to write only: columns id (long) and vector (array of float); options path and dim."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "id long, vector array<float>"

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], int(self.options["dim"]))


def write(df: DataFrame, path: str, dim: int) -> DataFrame:
    """Writes df (id, vector) as NPY files under path, a new folder of any file system that pyarrow knows; what it returns are the
    failures: id, reason (null, length: not dim numbers, or number: not finite). Other rows are written whatever fails."""
    spark = df.sparkSession
    spark.dataSource.register(NpySource)
    df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).write.format("npy").mode("append").options(path=path, dim=dim).save()
    return failures(spark, path)


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def failures(spark: SparkSession, path: str) -> DataFrame:
    names = manifest(spark, path)["failures"]
    kinds = "id long, reason string"
    return spark.read.schema(kinds).json([f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], kinds)


def read(spark: SparkSession, path: str) -> DataFrame:
    """id, vector of all rows that the manifest lists; files are read by Spark, a pair of them in one task."""
    names = manifest(spark, path)["files"]
    kinds = "id long, vector array<float>"
    if not names:
        return spark.createDataFrame([], kinds)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    pairs = files.select(F.regexp_extract("path", r"([^/]+)\.(ids|vectors)\.npy$", 1).alias("name"), F.regexp_extract("path", r"\.(ids|vectors)\.npy$", 1).alias("kind"), "content")
    listed = F.broadcast(spark.createDataFrame([(n,) for n in names], "name string"))  # a name for each ROWS_A_FILE rows and task
    pairs = pairs.join(listed, "name")
    pairs = pairs.groupBy("name").agg(*[F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("ids", "vectors")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, vectors in zip(pdf["ids"], pdf["vectors"], strict=True):
                yield pd.DataFrame({"id": np.load(io.BytesIO(ids)), "vector": list(np.load(io.BytesIO(vectors)))})

    return pairs.mapInPandas(run, kinds)
