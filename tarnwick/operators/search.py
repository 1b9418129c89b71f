"""Vector and lexical top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.config import BM25_B, BM25_K1
from tarnwick.functions.values import tokens
from tarnwick.session import table

#: Queries of one cell, shares of the snippets that each of them meets, and queries multiplied with a batch at once.
QUERY_BLOCK, SHARES, QUERIES_AT_ONCE = 4096, 32, 512
#: Rows at most that queries of equal vectors look up together.
MOST_SHARED = 1000
#: What a product may differ by from the sum in order.
SLACK = 1e-12
RESULT = "q string, document_id string, sub_id long, score double"


def ranked(scores: DataFrame, by: tuple = ("q",), name: str = "rank") -> DataFrame:
    """1-based position inside each group by score, ties by the larger (document_id, sub_id) first."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("document_id").desc(), F.col("sub_id").desc())
    return scores.withColumn(name, F.row_number().over(w))


def top(scores: DataFrame, n: int) -> DataFrame:
    """The n best rows of one score list, best first."""
    return scores.orderBy(F.col("score").desc(), F.col("document_id").desc(), F.col("sub_id").desc()).limit(n)


class Best:
    """The best snippets so far of a number of queries. It holds a few times as many rows as they ask for."""

    def __init__(self, qs: list[str], ks: np.ndarray, least: float = -np.inf):
        self.qs, self.ks = np.array(qs, object), ks
        self.least = np.full(len(qs), least)
        self.held: list[tuple] = []
        self.n_held, self.bound = 0, 2 * int(ks.sum()) + 1000

    def hits(self, at: np.ndarray, s: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the scores s, a row for each of the queries ``at``, that can be among their best; -inf never is."""
        hit = s >= (self.least[at, None] - slack)
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 2 * self.ks[at])
        if len(many):  # the batch alone bounds these from below
            k = np.minimum(self.ks[at][many], s.shape[1])
            part = s[many]
            part.partition(np.unique(s.shape[1] - k), axis=1)
            enough = self.ks[at][many] <= s.shape[1]
            least = np.where(enough, part[np.arange(len(many)), s.shape[1] - k], -np.inf)
            self.least[at[many]] = np.maximum(self.least[at[many]], least)
            hit[many] = s[many] >= (self.least[at[many]][:, None] - slack)
        hit &= s > -np.inf
        return np.nonzero(hit)

    def hold(self, q: np.ndarray, docs: np.ndarray, subs: np.ndarray, s: np.ndarray) -> None:
        self.held.append((q, docs, subs, s))
        self.n_held += len(q)
        if self.n_held > self.bound:
            self._cut()

    def _cut(self) -> None:
        rows = pd.DataFrame({n: np.concatenate(x) for n, x in zip("qdus", zip(*self.held, strict=True), strict=True)})
        rows = rows.sort_values(["q", "s", "d", "u"], ascending=[True, False, False, False])
        q = rows["q"].to_numpy()
        at = np.arange(len(q)) - np.searchsorted(q, q)
        rows, q, at = rows[at < self.ks[q]], q[at < self.ks[q]], at[at < self.ks[q]]
        last = at == self.ks[q] - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], rows["s"].to_numpy()[last])
        self.held = [tuple(rows[n].to_numpy() for n in "qdus")]
        self.n_held = len(rows)

    def score(self, s: np.ndarray) -> np.ndarray:
        return s

    def best(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        self._cut()
        q, docs, subs, s = self.held[0]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32()]
        columns = [self.qs[q], docs, subs, self.score(s), self.ks[q]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["q", "document_id", "sub_id", "score", "k"])


class _Cell(Best):
    """A cell's queries of vectors."""

    def __init__(self, qs: list[str], ks: np.ndarray, exclude: list[list[str] | None], vectors: np.ndarray):
        super().__init__(qs, ks)
        self.vectors = vectors
        self.without: dict[str, list[int]] = {}
        for i, docs in enumerate(exclude):
            for d in docs or ():
                self.without.setdefault(d, []).append(i)

    def add(self, docs: np.ndarray, subs: np.ndarray, v: np.ndarray) -> None:
        out = [(i, at) for at, d in enumerate(docs.tolist()) for i in self.without.get(d, ())] if self.without else []
        out = np.array(sorted(out), np.int64).reshape(-1, 2)
        for lo in range(0, len(self.qs), QUERIES_AT_ONCE):
            hi = min(lo + QUERIES_AT_ONCE, len(self.qs))
            s = self.vectors[lo:hi] @ v.T
            np.clip(s, -1.0, 1.0, out=s)
            mine = out[np.searchsorted(out[:, 0], lo) : np.searchsorted(out[:, 0], hi)]
            s[mine[:, 0] - lo, mine[:, 1]] = -np.inf
            q, d = self.hits(np.arange(lo, hi), s, SLACK)
            for i in range(0, len(q), self.bound):
                self._summed(q[i : i + self.bound] + lo, d[i : i + self.bound], docs, subs, v)

    def _summed(self, q: np.ndarray, d: np.ndarray, docs: np.ndarray, subs: np.ndarray, v: np.ndarray) -> None:
        """Scores are summed in order, so equal vectors have equal ones wherever they stand."""
        total = np.zeros(len(q))
        for j in range(v.shape[1]):
            total += self.vectors[q, j] * v[d, j]
        self.hold(q, docs[d], subs[d], np.clip(total, -1.0, 1.0))

    def score(self, s: np.ndarray) -> np.ndarray:
        return (1 + s) / 2


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_of_cells(queries: DataFrame, snippets: DataFrame) -> DataFrame:
    """RESULT and k: of each cell the best k snippets of each of its queries.

    queries: cell, q, vec, k, exclude; snippets: cell, document_id, sub_id, embedding. Cells are dealt to tasks, in which the
    snippets stream past their cell's queries; a task holds the queries of one cell, a batch of snippets and the best so far.
    """
    none = lambda df, *names: [F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names]
    left = queries.select("cell", F.lit(0).alias("kind"), F.col("q").alias("id"), F.lit(None).cast("long").alias("sub_id"), "vec", "k", "exclude", *none(snippets, "embedding"))
    right = snippets.where("embedding is not null").select("cell", F.lit(1).alias("kind"), F.col("document_id").alias("id"), F.col("sub_id").cast("long").alias("sub_id"), *none(queries, "vec", "k", "exclude"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell, asked = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])])
            for lo, hi in zip(starts, np.r_[starts[1:], len(cells)], strict=True):
                part = batch.slice(lo, hi - lo)
                if cells[lo] != at:
                    if cell is not None and (done := cell.best()) is not None:
                        yield done
                    at, cell, asked = cells[lo], None, []
                if kinds[lo] == 0:
                    asked.append(part)
                    continue
                if cell is None and asked:
                    cell = _Cell([q for p in asked for q in p.column("id").to_pylist()], np.concatenate([p.column("k").to_numpy() for p in asked]), [x for p in asked for x in p.column("exclude").to_pylist()], np.concatenate([_matrix(p.column("vec")) for p in asked]))
                    asked = []
                if cell is not None:
                    cell.add(np.array(part.column("id").to_pylist(), object), part.column("sub_id").to_numpy(), _matrix(part.column("embedding")))
        if cell is not None and (done := cell.best()) is not None:
            yield done

    return left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, RESULT + ", k int")


def _scanned(snippets: DataFrame, asked: DataFrame) -> DataFrame:
    """The k best of all snippets for each query of a table (q, vec, k, exclude); parts of the queries meet shares of the snippets."""
    parts = -(-asked.count() // QUERY_BLOCK)
    cell = F.col("part").cast("long") * SHARES + F.col("share")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    queries = asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(max(parts, 1)))).withColumn("share", numbers(SHARES))
    rows = snippets.select("document_id", "sub_id", "embedding", F.pmod(F.xxhash64("document_id", "sub_id"), F.lit(SHARES)).alias("share")).withColumn("part", numbers(parts))
    return ranked(best_of_cells(queries.withColumn("cell", cell), rows.withColumn("cell", cell))).where("rank <= k").drop("rank", "k")


def slim_queries(queries: DataFrame, k: int) -> DataFrame:
    """A table of queries: q, vec, k, exclude."""
    own_k = F.col("k").cast("int") if "k" in queries.columns else F.lit(k)
    exclude = F.col("exclude") if "exclude" in queries.columns else F.lit(None).cast("array<string>")
    return table(queries.select("q", F.col("vec").cast("array<double>").alias("vec"), own_k.alias("k"), exclude.alias("exclude")), "knn-queries")


def knn(snippets: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(q, document_id, sub_id, score): per query its k snippets of the largest dot product, score (1 + dot) / 2.

    snippets: document_id, sub_id, embedding, already filtered. queries: q, vec, and optionally k (its own number of
    results) and exclude (document ids it must not return).

    Queries of one vector are looked up together where that takes fewer rows: as many as each could need, from which
    each takes its best without what it excludes. One that finds too few there, because it excludes documents of many
    snippets, is looked up alone, as all others are.
    """
    return knn_of(snippets, slim_queries(queries, k))


def knn_of(snippets: DataFrame, slim: DataFrame) -> DataFrame:
    """knn() for a table of slim_queries()."""
    if slim.limit(2).count() < 2:
        return _scanned(snippets, slim)
    need = F.max(F.col("k") + F.coalesce(F.size("exclude"), F.lit(0))).alias("need")
    groups = slim.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("most"), need)
    groups = table(groups.where((F.col("n") > 1) & (F.col("need") <= F.col("n") * F.col("most"))).withColumn("g", F.monotonically_increasing_id().cast("string")), "knn-vectors")
    if groups.isEmpty():
        return _scanned(snippets, slim)
    m = F.greatest("most", F.least("need", F.lit(MOST_SHARED))).cast("int")
    hits = _scanned(snippets, groups.select(F.col("g").alias("q"), "vec", m.alias("k"), F.lit(None).cast("array<string>").alias("exclude")))
    lists = hits.groupBy(F.col("q").alias("g")).agg(F.sort_array(F.collect_list(F.struct("score", "document_id", "sub_id")), asc=False).alias("hits"))
    lists = table(groups.select("vec", "g", m.alias("m")).join(lists, "g"), "knn-shared")
    kept = F.filter("hits", lambda x: F.coalesce(~F.array_contains("exclude", x["document_id"]), F.lit(True)))
    found = slim.join(lists, "vec").select("q", "k", (F.size("hits") >= F.col("m")).alias("cut"), F.slice(kept, 1, F.col("k")).alias("hits"))
    found = table(found, "knn-found")
    alone = slim.join(groups.select("vec"), "vec", "left_anti").select(*slim.columns)
    short = slim.join(found.where(F.col("cut") & (F.size("hits") < F.col("k"))).select("q"), "q", "left_semi").select(*slim.columns)
    rest = table(alone.unionByName(short), "knn-alone")
    whole = found.where(~(F.col("cut") & (F.size("hits") < F.col("k")))).select("q", F.explode("hits").alias("x")).select("q", F.col("x.document_id").alias("document_id"), F.col("x.sub_id").alias("sub_id"), F.col("x.score").alias("score"))
    return whole if rest.isEmpty() else whole.unionByName(_scanned(snippets, rest))


def bm25(docs: DataFrame, query: str, condition=None) -> DataFrame:
    """(document_id, sub_id, score) of the documents (document_id, sub_id, text) with a query term.

    Statistics cover all of docs; condition filters results and never changes scores. Terms are the distinct query
    tokens; a term's weight is ln(1 + (N - n + 0.5) / (n + 0.5)). Texts are read once: lengths and term counts go to a
    slim table, from which both the statistics and the scores come. Null text has no terms.
    """
    terms = list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))
    if not terms:
        return docs.select("document_id", "sub_id", F.lit(0.0).alias("score")).limit(0)
    extra = [condition.alias("shown")] if condition is not None else [F.lit(True).alias("shown")]
    t = docs.select("document_id", "sub_id", *extra, tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    times = lambda term: F.size(F.filter("tokens", lambda x: x == term)).cast("double")
    tf = [times(term).alias(f"tf{i}") for i, term in enumerate(terms)]
    t = table(t.select("document_id", "sub_id", "shown", F.size("tokens").cast("double").alias("dl"), *tf), "term-counts")
    stats = t.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))])
    j = t.where(F.col("shown")).crossJoin(F.broadcast(stats))  # stats: one row

    def weight(i: int):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * F.col(f"tf{i}") * (BM25_K1 + 1) / (F.col(f"tf{i}") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))

    total = sum((weight(i) for i in range(1, len(terms))), weight(0))
    return j.select("document_id", "sub_id", total.alias("score")).where("score > 0")
