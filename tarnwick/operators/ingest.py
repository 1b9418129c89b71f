"""Upserts, deletions, candidates, properties, tags: each from the current tables to the next ones."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.config import MAX_BATCH, MAX_PROPERTIES_BYTES, MAX_STRING_BYTES, MAX_TAGS, BatchTooLarge
from tarnwick.functions import ids, values
from tarnwick.operators.embed import Embedder, embedded
from tarnwick.operators.split import Splitter, split_text
from tarnwick.operators.summarize import summarized
from tarnwick.session import table
from tarnwick.sources.files import Files


def check_batch(n: int, most: int = MAX_BATCH) -> None:
    if n > most:
        raise BatchTooLarge(size=n, most=most)


def resolve_candidate(set_to: Column, default_to: Column, existing: Column) -> Column:
    """is_candidate of a document: what it is set to; else what it was; else the default; else true."""
    return F.coalesce(set_to, F.when(default_to.isNotNull(), F.coalesce(existing, default_to)), F.lit(True))


def valid_properties(properties: Column, schema: dict[str, str] | None = None) -> Column:
    """Whether a JSON text is an object of flat properties within all limits: names, kinds (booleans, numbers, strings, lists
    of strings), lengths of strings, size of the whole, and for each declared property its type. A declared property may
    be missing, but not null."""
    object_ = F.try_parse_json(properties)
    pairs = object_.try_cast("map<string,variant>")
    kinds = F.transform(F.map_values(pairs), values.json_kind)
    texts = F.from_json(properties, "map<string,string>")
    ok = pairs.isNotNull() & F.forall(F.map_keys(pairs), ids.valid_property_id) & F.forall(kinds, lambda k: k != "other")
    ok = ok & F.forall(F.map_values(texts), lambda t: F.coalesce(F.octet_length(t) <= MAX_STRING_BYTES, F.lit(True)))
    ok = ok & (values.properties_size(properties) <= MAX_PROPERTIES_BYTES)
    for name, kind in (schema or {}).items():
        value = F.try_element_at(pairs, F.lit(name))
        is_ = values.json_kind(value)
        fits = {"boolean": is_ == "boolean", "number": is_ == "number", "keyword": is_ == "string", "keyword[]": is_ == "strings", "date": (is_ == "string") & values.parsed_date(F.try_element_at(texts, F.lit(name))).isNotNull()}
        ok = ok & (~F.array_contains(F.map_keys(pairs), name) | F.coalesce(fits[kind], F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def validated(batch: DataFrame, schema: dict[str, str] | None = None, files: Files = Files()) -> DataFrame:  # noqa: B008
    """batch (schema.INGEST, with pos) plus ``errors``: the names of the fields that don't hold. schema: declared properties."""
    split, text = F.coalesce("split", F.lit(False)), F.col("snippet")
    checks = {
        "id": ids.valid_document_id(F.col("id")),
        "snippet": F.when(F.col("file").isNull(), ids.valid_snippet(text, split)).otherwise(text.isNull()),
        "file": F.col("file").isNull() | files.accepted(values.decoded_base64(F.col("file"))),
        "properties": F.col("properties").isNull() | valid_properties(F.col("properties"), schema),
        "tags": F.col("tags").isNull() | (F.coalesce(F.forall("tags", ids.valid_tag), F.lit(False)) & (F.size("tags") <= MAX_TAGS)),
        "is_candidate": F.col("is_candidate").isNull() | F.col("default_is_candidate").isNull(),
        "preprocessing": F.when(F.col("file").isNull(), ~(split & F.coalesce("summarize", F.lit(False)))).otherwise(~F.coalesce("summarize", F.lit(False)) & F.coalesce("split", F.lit(True))),
    }
    errors = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return batch.withColumn("errors", errors)


def last_wins(batch: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return batch.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def prepared(batch: DataFrame, files: Files = Files()) -> DataFrame:  # noqa: B008
    """Requests as document rows: trimmed text, hash of the input, step, defaults. A file's text is extracted by its type, and split."""
    step = F.when(F.coalesce("split", F.col("file").isNotNull()), "nltk_split_v1").when(F.coalesce("summarize", F.lit(False)), "summarize").otherwise("none")
    text = F.coalesce(ids.trimmed(F.col("snippet")), ids.trimmed(files.text(values.decoded_base64(F.col("file")))))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), ids.trimmed)
    return batch.select(ids.trimmed(F.col("id")).alias("document_id"), text.alias("text"), values.sha256_of(text).alias("original_sha256"), step.alias("preprocessing_step"), F.coalesce("properties", F.lit("{}")).alias("properties"), tags.alias("tags"), F.col("is_candidate").alias("set_to"), F.col("default_is_candidate").alias("default_to"))


def classified(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows (prepared()) against the existing documents: ``status`` new, changed or unchanged, with flags for what
    changed, and the resolved is_candidate. New: absent, or another input or preprocessing step."""
    old = documents.select("document_id", *[F.col(c).alias(f"old_{c}") for c in ("original_sha256", "preprocessing_step", "properties", "tags", "is_candidate")])
    j = rows.join(old, "document_id", "left")
    j = j.withColumn("is_candidate", resolve_candidate(F.col("set_to"), F.col("default_to"), F.col("old_is_candidate")))
    new = F.col("old_original_sha256").isNull() | (F.col("old_original_sha256") != F.col("original_sha256")) | (F.col("old_preprocessing_step") != F.col("preprocessing_step"))
    j = j.withColumn("new_properties", ~F.col("properties").eqNullSafe(F.col("old_properties"))).withColumn("new_tags", ~F.col("tags").eqNullSafe(F.col("old_tags")))
    j = j.withColumn("new_candidate", ~F.col("is_candidate").eqNullSafe(F.col("old_is_candidate")))
    changed = F.col("new_properties") | F.col("new_tags") | F.col("new_candidate")
    return j.withColumn("status", F.when(new, "new").when(changed, "changed").otherwise("unchanged"))


def snippets_of(rows: DataFrame, embedder: Embedder, splitter: Splitter = Splitter()) -> DataFrame:  # noqa: B008
    """document_id, sub_id, snippet, embedding of new rows: split into several snippets, summarised (the summary is
    embedded, the original stored) or as they are."""
    text, step = F.col("text"), F.col("preprocessing_step")
    split = rows.where(step == "nltk_split_v1").select("document_id", F.posexplode(split_text(text, splitter)).alias("sub_id", "snippet")).withColumn("basis", F.col("snippet"))
    short = rows.where(step == "summarize").select("document_id", F.lit(0).alias("sub_id"), text.alias("snippet"), summarized(text).alias("basis"))
    plain = rows.where(step == "none").select("document_id", F.lit(0).alias("sub_id"), text.alias("snippet"), text.alias("basis"))
    every = split.unionByName(short).unionByName(plain)
    return every.select("document_id", F.col("sub_id").cast("long").alias("sub_id"), "snippet", embedded(F.col("basis"), embedder).alias("embedding"))


@dataclass
class Upsert:
    """The next documents and snippets, and the report (document_id, status)."""

    documents: DataFrame
    snippets: DataFrame
    report: DataFrame


def upsert(batch: DataFrame, documents: DataFrame, snippets: DataFrame, embedder: Embedder, schema: dict[str, str] | None = None, files: Files = Files(), splitter: Splitter = Splitter()) -> Upsert:  # noqa: B008
    """One plan: validate, last wins, classify, embed only what is new, replace rows.

    Invalid requests, and those whose text gives no snippet, are reported and the others go on. A re-ingested document
    loses all its old snippets.
    """
    checked = validated(batch, schema, files)
    invalid = checked.where(F.size("errors") > 0).select(F.col("id").alias("document_id"), F.lit("invalid").alias("status"))
    asked = last_wins(prepared_with_pos(checked.where(F.size("errors") == 0), files), "document_id")
    empty = F.coalesce(ids.trimmed(F.col("text")), F.lit("")) == ""
    invalid = invalid.unionByName(asked.where(empty).select("document_id", F.lit("invalid").alias("status")))
    rows = table(classified(asked.where(~empty), documents), "classified")  # tables are overwritten one after another
    columns = ["document_id", "original_sha256", "preprocessing_step", "properties", "tags", "is_candidate"]
    next_docs = documents.join(rows.select("document_id"), "document_id", "left_anti").select(*columns).unionByName(rows.select(*columns))
    new = rows.where("status = 'new'")
    made = snippets_of(new, embedder, splitter)
    next_snippets = snippets.join(new.select("document_id"), "document_id", "left_anti").select("document_id", "sub_id", "snippet", "embedding").unionByName(made)
    return Upsert(next_docs, next_snippets, rows.select("document_id", "status").unionByName(invalid))


def prepared_with_pos(batch: DataFrame, files: Files = Files()) -> DataFrame:  # noqa: B008
    """prepared() with the requests' order."""
    out = prepared(batch.withColumn("tags", F.concat(F.array(F.col("pos").cast("string")), F.coalesce("tags", F.array().cast("array<string>")))), files)
    return out.withColumn("pos", F.element_at("tags", 1).cast("long")).withColumn("tags", F.slice("tags", 2, MAX_TAGS))


def set_candidates(documents: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next documents, missing ids): exactly the wanted ids that exist are candidates."""
    ids_ = wanted.select("document_id").distinct().withColumn("wanted", F.lit(True))
    next_docs = documents.join(ids_, "document_id", "left").withColumn("is_candidate", F.coalesce("wanted", F.lit(False))).drop("wanted")
    return next_docs, ids_.join(documents, "document_id", "left_anti").select("document_id")


def add_candidates(documents: DataFrame, wanted: DataFrame, to: bool = True) -> tuple[DataFrame, DataFrame]:
    """(next documents, missing ids): the wanted ids become candidates (to=False: stop being any), others stay."""
    ids_ = wanted.select("document_id").distinct().withColumn("wanted", F.lit(True))
    flag = F.when(F.col("wanted"), F.lit(to)).otherwise(F.col("is_candidate"))
    next_docs = documents.join(ids_, "document_id", "left").withColumn("is_candidate", flag).drop("wanted")
    return next_docs, ids_.join(documents, "document_id", "left_anti").select("document_id")


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(next tables, missing ids): documents, their snippets and interactions go; interests and tag weights stay."""
    ids_ = gone.select("document_id").distinct()
    out = {name: df.join(ids_, "document_id", "left_anti") for name, df in tables.items() if "document_id" in df.columns}
    return tables | out, ids_.join(tables["document"], "document_id", "left_anti")


def _where_id(documents: DataFrame, document_id: str, column: str, value: Column) -> DataFrame:
    return documents.withColumn(column, F.when(F.col("document_id") == document_id, value).otherwise(F.col(column)))


def put_properties(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """documents with the properties that changes (document_id, properties) have for them; null deletes all."""
    new = changes.select("document_id", F.coalesce("properties", F.lit("{}")).alias("new"))
    return documents.join(new, "document_id", "left").withColumn("properties", F.coalesce("new", "properties")).drop("new")


def put_property(documents: DataFrame, document_id: str, name: str, value) -> DataFrame:
    """value: any JSON value as Python has it. The document's other properties keep their values and types."""
    return _where_id(documents, document_id, "properties", values.with_property(F.col("properties"), name, F.parse_json(F.lit(json.dumps(value)))))


def delete_property(documents: DataFrame, document_id: str, name: str) -> DataFrame:
    return _where_id(documents, document_id, "properties", values.with_property(F.col("properties"), name, None))


def put_tags(documents: DataFrame, document_id: str, tags: list[str]) -> DataFrame:
    return _where_id(documents, document_id, "tags", F.array(*[F.lit(t) for t in tags]).cast("array<string>"))
