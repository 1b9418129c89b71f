from __future__ import annotations

import json
import os

import numpy as np

from tarnwick.sources import npy


def test_round_trip_and_planted_failures(spark, tmp_path, monkeypatch):
    rows = [(i, [float(i), i / 3, -1.5]) for i in range(500)]
    planted = [(1000, None, "null"), (None, [1.0, 2.0, 3.0], "null"), (1001, [1.0], "length"), (1002, [1.0, float("nan"), 0.0], "number"), (1003, [float("inf"), 0.0, 0.0], "number"), (1004, [1.0, None, 2.0], "number"), (1005, [], "length")]
    df = spark.createDataFrame(rows + [p[:2] for p in planted], "id long, vector array<double>").repartition(5)
    path = str(tmp_path / "vectors")
    failed = npy.write(df, path, 3)
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((r["id"], r["reason"]) for r in failed.collect()), key=key) == sorted(((p[0], p[2]) for p in planted), key=key)
    told = npy.manifest(spark, path)
    assert (told["rows"], told["failed"], told["dim"]) == (500, 7, 3)
    got = {r["id"]: r["vector"] for r in npy.read(spark, path).collect()}
    assert got == {i: np.array(v, np.float32).tolist() for i, v in rows}
    assert np.load(f"{path}/{told['files'][0]}.vectors.npy").shape[1] == 3
    np.save(f"{path}/left-by-a-lost-task.ids.npy", np.array([9]))
    assert npy.read(spark, path).count() == 500


def test_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    failed = npy.write(spark.createDataFrame([], "id long, vector array<float>"), path, 4)
    assert failed.count() == 0 and npy.read(spark, path).count() == 0 and os.path.exists(f"{path}/{npy.MANIFEST}")
    assert json.load(open(f"{path}/{npy.MANIFEST}"))["files"] == []
