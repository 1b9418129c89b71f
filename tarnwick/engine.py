"""The service's API as Python methods over a tenant's tables; every result is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwick.config import MAX_CANDIDATES, RECOMMENDATION_WEIGHTS, SEARCH_WEIGHTS, DocumentNotFound, EngineConfig, InvalidProperties, InvalidUser, NotEnoughInteractions, PropertyNotFound
from tarnwick.functions import values
from tarnwick.functions.ids import trimmed
from tarnwick.operators import filters, fusion, ingest, personalize, postings, vector_index
from tarnwick.operators import interests as ci
from tarnwick.operators.embed import REGISTRY
from tarnwick.operators.search import knn, top
from tarnwick.operators.split import Splitter
from tarnwick.schema import KEYS
from tarnwick.session import table
from tarnwick.sources.files import Files
from tarnwick.sources.readers import requests_of
from tarnwick.sources.store import Store
from tarnwick.streaming import stateful

#: Tables of a user.
USER_TABLES = ("center_of_interest", "weighted_tag", "users", "interaction")
#: Blocks of postings in a partition of documents.
BLOCKS_A_PARTITION = 64
#: Stands for the user of an inline history.
INLINE = "inline"


class Engine:
    """One tenant. ``now`` is an argument wherever time matters; it defaults to the clock. embedder (texts to vectors): instead of the tenant's.
    splitter: how files and texts are split, by default as config says, in words; files: which are taken, and their extractors."""

    def __init__(self, spark: SparkSession, root: str, tenant: str, config: EngineConfig = EngineConfig(), embedder: Callable | None = None, splitter: Splitter | None = None, files: Files = Files()):  # noqa: B008
        self.spark, self.store, self.tenant, self.config = spark, Store(spark, root), tenant, config
        self._own_embedder, self.files = embedder, files
        self.splitter = splitter or Splitter(config.split.chunk_size, config.split.hard_limit)

    # --- tables ---

    def _tables(self) -> dict[str, DataFrame]:
        return self.store.tables(self.tenant)

    def _of(self, name: str, *keys: str) -> DataFrame:
        """The rows of some keys; only their partitions are read."""
        key = KEYS[name]
        return self.store.table(self.tenant, name, self.store.parts(self.tenant, keys)).where(F.col(key).isin(*keys))

    @property
    def embedder(self):
        return self._own_embedder or REGISTRY[self.store.options(self.tenant)["embedder"]]

    def _candidates(self, condition: Column | None = None) -> DataFrame:
        """Snippets of candidate documents under a condition, before any top-k."""
        t = self._tables()
        docs = t["document"].where("is_candidate").withColumn("properties_json", F.col("properties")).withColumn("properties", F.parse_json("properties"))
        docs = docs if condition is None else docs.where(condition)
        return t["snippet"].join(docs.select("document_id", "properties_json", "tags"), "document_id")

    def _condition(self, filter_json: dict | None, published_after: str | None) -> Column:
        tree = filters.published_after(filters.parse(filter_json), published_after)
        return filters.compile_filter(tree, self.schema(), filters.from_json_column(F.col("properties")))

    # --- indexes ---

    def _replace(self, parts: dict[str, list[int]], changed: dict[str, DataFrame], note: str = "") -> None:
        """New rows of some partitions of each table; postings follow the documents."""
        self.store.replace(self.tenant, changed, parts, note)
        if parts.get("document"):
            self.index_texts(parts["document"])

    def index_texts(self, parts: list[int] | None = None) -> None:
        """Builds the postings of the candidates, of all or of some partitions, which alone are read and written then."""
        rows = self.store.table(self.tenant, "snippet", parts).join(self.store.table(self.tenant, "document", parts).where("is_candidate").select("document_id"), "document_id")
        blocks = self.store.options(self.tenant)["partitions"] * BLOCKS_A_PARTITION
        self.store.replace(self.tenant, {"postings": postings.build(rows.select("document_id", "sub_id", F.col("snippet").alias("text")), blocks)}, parts, "postings")

    def index_vectors(self, n_lists: int | None = None) -> None:
        """Builds an index of all vectors. From then on searches may use it, and upserts and deletions keep it up to date."""
        vector_index.build(self._tables()["snippet"].select("document_id", "sub_id", "embedding"), self.store.path(self.tenant, "vectors"), n_lists)

    def _vectors(self) -> vector_index.VectorIndex | None:
        return vector_index.VectorIndex(self.spark, self.store.path(self.tenant, "vectors")) if self.store.has(self.tenant, "vectors") else None

    def _refresh_vectors(self, changed: DataFrame, parts: list[int]) -> None:
        if (index := self._vectors()) is not None:
            rows = self.store.table(self.tenant, "snippet", parts).join(changed.select("document_id"), "document_id", "left_semi")
            vector_index.refresh(index, changed, rows.select("document_id", "sub_id", "embedding"))

    def _nearest(self, num_candidates: int | None) -> Callable[..., DataFrame]:
        """How to find the nearest rows: exactly, or with num_candidates by the index, if there is one."""
        index = self._vectors() if num_candidates is not None else None
        if index is None:
            return knn
        return lambda rows, queries, k=10: vector_index.search(index, queries, k, candidates=num_candidates, shown=rows)

    # --- back office ---

    def upsert(self, documents: list[dict] | DataFrame) -> DataFrame:
        """Report (document_id, status) of a batch; invalid documents don't stop the others."""
        if isinstance(documents, list):
            ingest.check_batch(len(documents))
            documents = requests_of(self.spark, documents)
        parts = self.store.parts(self.tenant, documents.select(trimmed(F.col("id"))))
        old = {name: self.store.table(self.tenant, name, parts) for name in ("document", "snippet")}
        out = ingest.upsert(documents, old["document"], old["snippet"], self.embedder, self.schema(), self.files, self.splitter)
        report = table(out.report, "report")
        if parts:
            # documents last: a batch that was cut off before is new again
            self._replace({"document": parts, "snippet": parts}, {"snippet": out.snippets, "document": out.documents})
            self._refresh_vectors(report.where("status = 'new'"), parts)
        return report

    def delete(self, ids: list[str]) -> DataFrame:
        """Ids that didn't exist."""
        gone = self._ids(ids)
        parts = {name: self.store.parts(self.tenant, ids) for name in ("document", "snippet")}
        theirs = self._tables()["interaction"].join(gone, "document_id", "left_semi")
        parts["interaction"] = self.store.parts(self.tenant, theirs.select("user_id"))
        tables, missing = ingest.delete_documents({name: self.store.table(self.tenant, name, p) for name, p in parts.items()}, gone)
        missing = table(missing, "missing")
        self._replace(parts, {name: tables[name] for name in ("interaction", "snippet", "document")})
        self._refresh_vectors(gone, parts["document"])
        return missing

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "document_id string")

    def candidates(self) -> DataFrame:
        return self._tables()["document"].where("is_candidate").select("document_id")

    def set_candidates(self, ids: list[str]) -> DataFrame:
        """Ids that don't exist; all other documents stop being candidates."""
        old = self._tables()["document"]
        after, missing = ingest.set_candidates(old, self._ids(ids))
        flags = old.select("document_id", F.col("is_candidate").alias("was")).join(after.select("document_id", "is_candidate"), "document_id")
        parts = self.store.parts(self.tenant, flags.where(~F.col("was").eqNullSafe(F.col("is_candidate"))).select("document_id"))
        return self._flag(parts, ingest.set_candidates(self.store.table(self.tenant, "document", parts), self._ids(ids))[0], missing)

    def add_candidates(self, ids: list[str], to: bool = True) -> DataFrame:
        parts = self.store.parts(self.tenant, ids)
        return self._flag(parts, *ingest.add_candidates(self.store.table(self.tenant, "document", parts), self._ids(ids), to))

    def _flag(self, parts: list[int], documents: DataFrame, missing: DataFrame) -> DataFrame:
        missing = table(missing, "missing")
        if parts:
            self._replace({"document": parts}, {"document": documents})
        return missing

    def schema(self) -> dict[str, str]:
        return self.store.indexed_properties(self.tenant)

    def extend_schema(self, new: dict[str, str]) -> dict[str, str]:
        whole = filters.extend_schema(self.schema(), new)
        self.store.commit(self.tenant, {"indexed_property": self.spark.createDataFrame(list(whole.items()), "name string, type string")})
        return whole

    def _document(self, document_id: str) -> DataFrame:
        row = self._of("document", document_id)
        if row.isEmpty():
            raise DocumentNotFound(document_id=document_id)
        return row

    def _beside(self, document_id: str) -> DataFrame:
        """All documents in the partition of one."""
        return self.store.table(self.tenant, "document", self.store.parts(self.tenant, [document_id]))

    def _commit_document(self, document_id: str, documents: DataFrame) -> None:
        """documents: what _beside() gave, with changes that no posting depends on."""
        self.store.replace(self.tenant, {"document": documents}, self.store.parts(self.tenant, [document_id]))

    def properties(self, document_id: str) -> DataFrame:
        return self._document(document_id).select("properties")

    def _commit_properties(self, document_id: str, documents: DataFrame) -> None:
        mine = documents.where(F.col("document_id") == document_id)
        if mine.where(~ingest.valid_properties(F.col("properties"), self.schema())).count():
            raise InvalidProperties(document_id=document_id)
        self._commit_document(document_id, documents)

    def put_properties(self, document_id: str, properties_json: str | None) -> None:
        self._document(document_id)
        changes = self.spark.createDataFrame([(document_id, properties_json)], "document_id string, properties string")
        self._commit_properties(document_id, ingest.put_properties(self._beside(document_id), changes))

    def property(self, document_id: str, name: str) -> DataFrame:
        """One property as JSON text; a document without it is another error than no document."""
        value = F.get_json_object("properties", values.json_path(name))
        row = self._document(document_id).select(value.alias("value")).where("value is not null")
        if row.isEmpty():
            raise PropertyNotFound(document_id=document_id, name=name)
        return row

    def put_property(self, document_id: str, name: str, value) -> None:
        """value: a boolean, a number, a string or a list of strings."""
        self._document(document_id)
        filters.validate_property(name, value, self.schema())
        self._commit_properties(document_id, ingest.put_property(self._beside(document_id), document_id, name, value))

    def delete_property(self, document_id: str, name: str) -> None:
        self.property(document_id, name)
        self._commit_document(document_id, ingest.delete_property(self._beside(document_id), document_id, name))

    def put_tags(self, document_id: str, tags: list[str]) -> None:
        self._document(document_id)
        self._commit_document(document_id, ingest.put_tags(self._beside(document_id), document_id, tags))

    # --- front office ---

    def interact(self, user_id: str, documents: list[tuple[str, int]], now: datetime | None = None) -> None:
        """Folds the snippets in request order into the user's interests, logs them and adds their tags. Of each table
        the user's partition is rewritten, and no other. A call that was cut off may count tags twice when it is made again;
        interact_stream() doesn't."""
        now = now or datetime.now(UTC)
        rows = [(user_id, d, s, i, now) for i, (d, s) in enumerate(documents)]
        asked = self.spark.createDataFrame(rows, "user_id string, document_id string, sub_id long, event_id long, time_stamp timestamp")
        wanted = sorted({d for d, _ in documents})
        known = asked.join(self._of("snippet", *wanted).select("document_id", "sub_id", "embedding"), ["document_id", "sub_id"])
        parts = self.store.parts(self.tenant, [user_id])
        old = {name: self.store.table(self.tenant, name, parts) for name in USER_TABLES}
        mine = F.col("user_id") == user_id
        before = old["center_of_interest"].where(mine).withColumn("step", F.row_number().over(_by_id()) - 1)
        after = ci.fold_interactions(known, self.config.interests, before).drop("step")
        tags = personalize.tag_weights(known, self._of("document", *wanted)).unionByName(old["weighted_tag"]).groupBy("user_id", "tag").agg(F.sum("weight").alias("weight"))
        changed = {"center_of_interest": old["center_of_interest"].where(~mine).unionByName(after), "weighted_tag": tags, "users": self._seen_at(old["users"], [(user_id, now)])}
        if self.config.store_user_history:
            log = known.select("document_id", "sub_id", "user_id", "time_stamp")
            changed["interaction"] = old["interaction"].unionByName(log).distinct()
        self.store.replace(self.tenant, changed, parts)

    def interact_stream(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Interactions as they arrive: events (user_id, document_id, sub_id, event_id, time_stamp), a stream. Each micro-batch ends in
        the tables as calls of interact() would, in the order of time and event.

        Interests and tag weights are the stream's state, which begins with what the tables have; it holds whole
        values, so a micro-batch that is written again after a failure changes nothing, and one that is known to be written
        is left out. Of the tables, the partitions of the micro-batch's users are rewritten. While the stream runs nothing
        else is to write interests; changed documents are seen after a restart. trigger: as for DataStreamWriter.trigger().
        """
        t = self._tables()
        rows = events.select("user_id", "document_id", "sub_id", "event_id", "time_stamp")
        vectors = t["snippet"].select("document_id", "sub_id", stateful.packed("embedding").alias("embedding"))
        rows = rows.join(vectors, ["document_id", "sub_id"], "left").join(t["document"].select("document_id", "tags"), "document_id", "left")
        out = stateful.updates(rows, t["center_of_interest"], t["weighted_tag"], self.config.interests)

        def write(batch: DataFrame, number: int) -> None:
            note = f"stream {checkpoint} batch {number}"
            if self.store.commits(self.tenant).where(F.col("note") == note).isEmpty():
                self._write_users(table(batch, "stream-batch"), note)

        stream = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        with stateful.state_store(self.spark):
            return stream.start()

    def _write_users(self, new: DataFrame, note: str) -> None:
        """new: rows of stateful.UPDATES."""
        parts = self.store.parts(self.tenant, new.select("user_id"))
        if not parts:
            return
        old = {name: self.store.table(self.tenant, name, parts) for name in USER_TABLES}
        of = lambda kind: new.where(F.col("kind") == kind)
        changed = {}
        for name, kind, key in (("center_of_interest", "centre", "coi_id"), ("weighted_tag", "tag", "tag")):
            rows = of(kind).select(*old[name].columns)
            changed[name] = old[name].join(rows.select("user_id", key), ["user_id", key], "left_anti").select(*rows.columns).unionByName(rows)
        changed["users"] = old["users"].unionByName(of("seen").select("user_id", F.col("time_stamp").alias("last_seen"))).groupBy("user_id").agg(F.max("last_seen").alias("last_seen"))
        if self.config.store_user_history:
            changed["interaction"] = old["interaction"].unionByName(of("log").select(*old["interaction"].columns)).distinct()
        self.store.replace(self.tenant, changed, parts, note)

    def _seen_at(self, users: DataFrame, seen: list[tuple[str, datetime]]) -> DataFrame:
        new = self.spark.createDataFrame(seen, "user_id string, last_seen timestamp")
        return users.unionByName(new).groupBy("user_id").agg(F.max("last_seen").alias("last_seen"))

    def search(self, text: str | None = None, document_id: str | None = None, sub_id: int | None = None, count: int | None = None, filter: dict | None = None, published_after: str | None = None, hybrid: bool = False, hybrid_options: dict | None = None, user_id: str | None = None, history: list[dict] | None = None, exclude_seen: bool = True, include_properties: bool = True, include_snippet: bool = False, show_raw_scores: bool = False, now: datetime | None = None, num_candidates: int | None = None) -> DataFrame:
        """Rows (document_id, sub_id, score, ...) similar to a text, a document or one of its snippets, best first; with
        a user, or with an inline history as in recommend(), reranked by their interests and without what they have seen.
        With num_candidates the vectors of so many rows are looked at, in the nearest lists of index_vectors(); else all."""
        count = self.config.checked_count(count)
        if (text is None) == (document_id is None):
            raise InvalidUser(reason="exactly one of text and document_id")
        if user_id is not None and history is not None:
            raise InvalidUser(reason="at most one of user_id and history")
        rows = self._candidates(self._condition(filter, published_after))
        if document_id is not None:
            t = self._of("snippet", document_id).where(F.col("sub_id") == (sub_id or 0))
            vec = t.select(F.lit("q").alias("q"), F.col("embedding").alias("vec"))
            if t.isEmpty():
                raise DocumentNotFound(document_id=document_id)
            same = F.col("document_id") == document_id
            rows = rows.where(~same if sub_id is None else ~(same & (F.col("sub_id") == sub_id)))
        else:
            vec = self.spark.createDataFrame([("q", [float(x) for x in self.embedder([text])[0]])], "q string, vec array<double>")
        if user_id is not None and exclude_seen and self.config.store_user_history:
            rows = personalize.exclude_documents(rows, self._of("interaction", user_id))
        if history is not None and exclude_seen:
            rows = self._unseen(rows, history)
        vector = self._nearest(num_candidates)(rows, vec, count).drop("q")
        found = vector
        lexical = None
        if hybrid and text is not None:
            asked = self.spark.createDataFrame([("q", text)], "q string, text string")
            lexical = postings.search(self.store.table(self.tenant, "postings"), asked, count, rows).drop("q")
            found = fusion.hybrid(vector, lexical, count, **(hybrid_options or {}))
        if user_id is not None:
            found = self._personalised(user_id, found, rows, self._of("center_of_interest", user_id), self._of("weighted_tag", user_id), now, SEARCH_WEIGHTS)
        elif history is not None:
            found = self._personalised(INLINE, found, rows, *self._of_history(history, now), now, SEARCH_WEIGHTS)
        out = top(found, count)
        if show_raw_scores:
            out = fusion.with_raw_scores(out, vector, lexical if lexical is not None else vector.where("false"))
        extra = ["document_id", "sub_id"] + ["properties_json"] * include_properties + ["snippet"] * include_snippet + ["tags"]
        shown = out.join(rows.select(*extra), ["document_id", "sub_id"])
        return shown.orderBy(F.col("score").desc(), F.col("document_id").desc(), F.col("sub_id").desc())

    def _now(self, now: datetime | None) -> Column:
        return F.lit(now or datetime.now(UTC))

    def _personalised(self, user: str, found: DataFrame, rows: DataFrame, mine: DataFrame, weights: DataFrame, now: datetime | None, parts: tuple) -> DataFrame:
        """found reranked by one user's interests and tag weights; unchanged with too few interests."""
        mine = table(mine, "own-interests")
        if mine.limit(self.config.interests.min_interests).count() < self.config.interests.min_interests:
            return found
        relevant = ci.relevance(mine.withColumn("step", F.row_number().over(_by_id())), self._now(now), self.config.interests.horizon_days)
        pairs = found.join(rows.select("document_id", "sub_id", "embedding", "tags"), ["document_id", "sub_id"]).withColumn("user_id", F.lit(user))
        return personalize.rerank(pairs.select("user_id", "document_id", "sub_id", "score"), ci.interest_scores(pairs, relevant), personalize.tag_scores(pairs, weights), parts).drop("user_id")

    def _history(self, history: list[dict]) -> DataFrame:
        rows = [(INLINE, i, h["document_id"], h.get("sub_id") or 0, h.get("time_stamp")) for i, h in enumerate(history)]
        return self.spark.createDataFrame(rows, "user_id string, pos long, document_id string, sub_id long, time_stamp timestamp")

    def _of_history(self, history: list[dict], now: datetime | None) -> tuple[DataFrame, DataFrame]:
        """Interests and tag weights of an inline history."""
        t = self._tables()
        used = personalize.trim_history(personalize.backfill_history(self._history(history), self._now(now)))
        loaded = personalize.load_history(used.where("used"), t["snippet"]).withColumn("event_id", F.col("pos"))
        return table(ci.fold_interactions(loaded, self.config.interests), "history-interests"), personalize.tag_weights(loaded, t["document"])

    def _unseen(self, rows: DataFrame, history: list[dict]) -> DataFrame:
        """rows without the history's snippets, and without its documents where an entry names no snippet."""
        h = self._history(history)
        whole = h.where(F.col("pos").isin([i for i, x in enumerate(history) if x.get("sub_id") is None]) if history else F.lit(False))
        return personalize.exclude_documents(personalize.exclude_documents(rows, whole), h, ("document_id", "sub_id"))

    def recommend_user(self, user_id: str, count: int | None = None, filter: dict | None = None, published_after: str | None = None, exclude_seen: bool = True, now: datetime | None = None) -> DataFrame:
        count = self.config.checked_count(count)
        if self._of("center_of_interest", user_id).limit(self.config.interests.min_interests).count() < self.config.interests.min_interests:
            raise NotEnoughInteractions(user_id=user_id)
        parts = self.store.parts(self.tenant, [user_id])
        self.store.replace(self.tenant, {"users": self._seen_at(self.store.table(self.tenant, "users", parts), [(user_id, now or datetime.now(UTC))])}, parts)
        return self.recommend_all(count, filter, published_after, exclude_seen, now, user_id)

    def recommend_all(self, count: int | None = None, filter: dict | None = None, published_after: str | None = None, exclude_seen: bool = True, now: datetime | None = None, user_id: str | None = None, num_candidates: int | None = None) -> DataFrame:
        """(user_id, document_id, sub_id, score, rank) for all users with enough interests, or for one, in one plan; by the
        index of vectors with num_candidates, as in search()."""
        count = self.config.checked_count(count)
        t = {name: self.store.table(self.tenant, name) if user_id is None else self._of(name, user_id) for name in USER_TABLES}
        interests = t["center_of_interest"].withColumn("step", F.row_number().over(_by_id()) - 1)
        seen = personalize.seen_documents(t["interaction"]) if exclude_seen and self.config.store_user_history else None
        rows = self._candidates(self._condition(filter, published_after))
        return personalize.recommend(rows, interests, t["weighted_tag"], seen, self._now(now), count, MAX_CANDIDATES, self.config.interests.horizon_days, self.config.interests.min_interests, self._nearest(num_candidates))

    def recommend(self, history: list[dict], count: int | None = None, filter: dict | None = None, now: datetime | None = None) -> DataFrame:
        """For an inline history of {document_id, sub_id?, time_stamp?}, oldest first; nothing is stored."""
        count = self.config.checked_count(count)
        interests, tags = self._of_history(history, now)
        if interests.limit(self.config.interests.min_interests).count() < self.config.interests.min_interests:
            raise NotEnoughInteractions(history=len(history))
        cands = self._unseen(self._candidates(self._condition(filter, None)), history)
        return personalize.recommend(cands, interests, tags, None, self._now(now), count, MAX_CANDIDATES, self.config.interests.horizon_days, self.config.interests.min_interests)


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("last_view", "coi_id")


__all__ = ["RECOMMENDATION_WEIGHTS", "Engine"]
