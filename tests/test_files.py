"""Files of mixed types through ingestion."""

from __future__ import annotations

import base64
import gzip

from pyspark.sql import functions as F

from tarnwick.engine import Engine
from tarnwick.operators.split import Splitter
from tarnwick.operators.subwords import Subwords
from tarnwick.sources import files

HTML = b"\xef\xbb\xbf \n<!DOCTYPE HTML><html><head><title>no</title><style>p{}</style></head><body><p>Hello &amp; welcome.</p><script>x()</script></body></html>"
CASES = {
    "plain": (b"Just a text. With two sentences.", "text/plain"),
    "utf8": ("Größe — naïve 東京".encode(), "text/plain"),
    "page": (HTML, "text/html"),
    "xhtml": (b"<?xml version='1.0'?>\n<html><body>In a page.</body></html>", "text/html"),
    "xml": (b"<?xml version='1.0'?><feed/>", "text/plain"),
    "json": (b'{"a": 1}', "text/plain"),
    "pdf": (b"%PDF-1.7\nsome content", "application/pdf"),
    "png": (b"\x89PNG\r\n\x1a\n\x00\x00", "image/png"),
    "zip": (b"PK\x03\x04abc", "application/zip"),
    "gzip": (gzip.compress(b"Packed text here."), "application/gzip"),
    "latin": (b"caf\xe9", "application/octet-stream"),
    "control": (b"a\x00b", "application/octet-stream"),
    "empty": (b"", None),
    "blank": (b" \n\t ", "text/plain"),
}


def test_media_types(spark):
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in CASES.items()] + [("null", None)], "k string, b binary")
    got = {r["k"]: r["t"] for r in df.select("k", files.media_type(F.col("b")).alias("t")).collect()}
    assert got == {k: v[1] for k, v in CASES.items()} | {"null": None}


def test_mixed_files_through_the_engine(spark, tmp_path):
    own = files.Files().extractors | {"application/gzip": files.by_function(lambda b: gzip.decompress(b).decode()), "application/pdf": files.by_function(lambda b: None)}
    subwords = Subwords("abcdefghijklmnopqrstuvwxyz")
    engine = Engine(spark, str(tmp_path / "tenants"), "t", splitter=Splitter(20, 24, subwords.length), files=files.Files(own))
    engine.store.create("t", partitions=2)
    batch = [{"id": k, "file": base64.b64encode(v[0]).decode()} for k, v in CASES.items()] + [{"id": "bad", "file": "no base64!"}, {"id": "text", "snippet": "as it is"}]
    report = {r["document_id"]: r["status"] for r in engine.upsert(batch).collect()}
    taken = {"plain", "utf8", "page", "xhtml", "xml", "json", "gzip", "text"}
    assert {k for k, s in report.items() if s == "new"} == taken
    assert {k for k, s in report.items() if s == "invalid"} == {*CASES, "bad"} - taken
    rows = engine.store.table("t", "snippet").orderBy("document_id", "sub_id").collect()
    joined = {}
    for r in rows:
        joined.setdefault(r["document_id"], []).append(r["snippet"])
        assert r["document_id"] == "text" or subwords.length(r["snippet"]) <= 24
    assert joined["page"] == ["Hello & welcome."] and joined["gzip"] == ["Packed text here."] and joined["xhtml"] == ["In a page."]
    assert "".join("".join(joined["plain"]).split()) == "Justatext.Withtwosentences." and len(joined["plain"]) > 1


def test_allowed_types(spark):
    only = files.Files(allowed=("text/plain",))
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in CASES.items()], "k string, b binary")
    got = {r["k"] for r in df.where(only.accepted(F.col("b"))).collect()}
    assert got == {k for k, v in CASES.items() if v[1] == "text/plain"}
