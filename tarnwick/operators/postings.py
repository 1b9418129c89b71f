"""Lexical search over an inverted index whose blocks know the most that they can give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.config import BM25_B, BM25_K1
from tarnwick.functions.values import tokens
from tarnwick.operators.search import RESULT, Best, ranked
from tarnwick.session import table

#: Query terms that are pushed down to the scan; a larger set meets the postings in a join.
MOST_PUSHED = 1000
#: Query terms at most that are broadcast to the postings.
MOST_BROADCAST = 200_000
#: (query, snippet) at most, by each term that they share, that are shuffled; more stay inside the tasks that score them.
MOST_SHUFFLED = 1 << 20
#: Queries and terms of queries of one cell, shares of the blocks that each of them meets, and scores that a task holds at once.
QUERIES_A_CELL, TERMS_A_CELL, SHARES, SCORES_AT_ONCE = 1 << 15, 1 << 18, 32, 1 << 18
#: A term that this share of a block's snippets has is a row of scores there.
FREQUENT = 1 / 8
#: What a sum of floats may differ by in another order.
SLACK = 1e-9
#: Blocks at least, and snippets of one, about.
LEAST_BLOCKS, ROWS_A_BLOCK = 64, 512


def blocks_for(n: int) -> int:
    """Blocks for n snippets: a task's share and what a query reads at first don't grow with them."""
    return max(LEAST_BLOCKS, -(-n // ROWS_A_BLOCK))


def build(snippets: DataFrame, blocks: int) -> DataFrame:
    """snippets (document_id, sub_id, text) -> block, term, n, max_tf, min_dl, sum_dl, docs: for each block of documents and each
    term in it the snippets that have it, as (document_id, sub_id, tf, dl), how many, and the extremes that bound their scores. The
    empty term lists all snippets of a block, those without tokens too; null text has none.

    A document's block is a hash of its id, so the blocks of changed documents can be built alone. Snippets are dealt by
    block once; terms are counted and gathered there. A list holds at most the snippets of one block.
    """
    block = F.pmod(F.xxhash64("document_id"), F.lit(blocks))
    rows = snippets.select(block.alias("block"), "document_id", "sub_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).repartition("block")
    rows = rows.select("block", "document_id", "sub_id", F.size("t").cast("double").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    counts = rows.groupBy("block", "term", "document_id", "sub_id", "dl").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    docs = F.sort_array(F.collect_list(F.struct("document_id", "sub_id", "tf", "dl"))).alias("docs")
    return counts.groupBy("block", "term").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sum("dl").alias("sum_dl"), docs)


def _weight(tf: Column, dl: Column) -> Column:
    """idf is known by then; grows with tf and falls with dl."""
    return F.col("idf") * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / F.col("avgdl")))


def _scores(asked: DataFrame, postings: DataFrame, shown: DataFrame | None) -> DataFrame:
    """(q, document_id, sub_id, score) in the blocks asked for (q, pos, term, idf, avgdl, block); a score's parts are summed in
    the order of the query's terms, so equal documents have equal scores."""
    rows = asked.join(postings.select("term", "block", "docs"), ["term", "block"]).select("q", "pos", "idf", "avgdl", F.explode("docs").alias("d"))
    rows = rows.select("q", "pos", F.col("d.document_id").alias("document_id"), F.col("d.sub_id").alias("sub_id"), _weight(F.col("d.tf"), F.col("d.dl")).alias("w"))
    rows = rows if shown is None else rows.join(shown.select("document_id", "sub_id"), ["document_id", "sub_id"], "left_semi")
    each = rows.groupBy("q", "document_id", "sub_id").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    return each.select("q", "document_id", "sub_id", F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"]).alias("score"))


class _Cell(Best):
    """A cell's queries of texts: query i has the terms ``codes[first[i] : first[i] + n[i]]``, in order."""

    def __init__(self, rows: pa.Table, k: int):
        q = rows["q"].combine_chunks().dictionary_encode()
        numbers = q.indices.to_numpy()
        self.first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
        self.n = np.diff(np.r_[self.first, len(numbers)])
        super().__init__(q.dictionary.to_pylist(), np.full(len(self.first), k, np.int32), np.nextafter(0.0, 1.0))
        term = rows["term"].combine_chunks().dictionary_encode()
        self.codes, names = term.indices.to_numpy(), term.dictionary.to_pylist()
        self.code = {t: i for i, t in enumerate(names)}
        self.idf = np.zeros(len(names))
        self.idf[self.codes] = rows["idf"].to_numpy()
        self.avgdl = rows["avgdl"][0].as_py()

    def add(self, terms: list[str | None], lists: pa.ListArray, filtered: bool) -> None:
        """The lists of one block; that of the null term, if filtered, has what may be returned."""
        flat = lists.flatten()
        ids, subs, tf, dl = (x.to_numpy(zero_copy_only=False) if i else x.dictionary_encode() for i, x in enumerate(flat.flatten()))
        ends = np.cumsum(lists.value_lengths().to_numpy())
        starts = np.r_[0, ends[:-1]]
        each, sub = np.unique(subs, return_inverse=True)
        key = ids.indices.to_numpy().astype(np.int64) * len(each) + sub
        whole = terms.index("")
        mine = slice(starts[whole], ends[whole])
        order = np.argsort(key[mine])
        column = order[np.searchsorted(key[mine][order], key)]
        names, numbers = ids.dictionary.take(ids.indices[mine]).to_numpy(zero_copy_only=False), subs[mine]
        width = len(names)
        hidden = None
        if filtered:
            hidden = np.ones(width, bool)
            for i in (i for i, t in enumerate(terms) if t is None):
                hidden[column[starts[i] : ends[i]]] = False

        found = [(i, self.code[t]) for i, t in enumerate(terms) if t in self.code]
        if not found or (hidden is not None and hidden.all()):
            return
        row, code = np.array(found).T
        idf = np.zeros(len(terms))
        idf[row] = self.idf[code]
        w = np.repeat(idf, ends - starts) * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / self.avgdl))
        peak, start, n, dense = np.zeros(len(self.idf)), np.zeros(len(self.idf), np.int64), np.zeros(len(self.idf), np.int64), np.zeros(len(self.idf), np.int64)
        peak[code] = np.maximum.reduceat(w, starts)[row]
        often = (ends - starts)[row] >= FREQUENT * width
        start[code], n[code] = starts[row], np.where(often, 0, (ends - starts)[row])
        dense[code[often]] = np.arange(1, often.sum() + 1)
        scores = np.zeros((1 + often.sum(), width))  # the first row: none
        for at, i in enumerate(row[often], 1):
            scores[at, column[starts[i] : ends[i]]] = w[starts[i] : ends[i]]

        able = np.flatnonzero(np.add.reduceat(peak[self.codes], self.first) * (1 + SLACK) >= self.least)
        step = max(1, SCORES_AT_ONCE // width)
        for lo in range(0, len(able), step):
            at = able[lo : lo + step]
            s = self._sums(at, scores, dense, start, n, column, w)
            if hidden is not None:
                s[:, hidden] = 0.0
            q, d = self.hits(at, s)
            for i in range(0, len(q), self.bound):
                part = q[i : i + self.bound], d[i : i + self.bound]
                self.hold(at[part[0]], names[part[1]], numbers[part[1]], s[part])

    def _sums(self, at: np.ndarray, scores: np.ndarray, dense: np.ndarray, start: np.ndarray, n: np.ndarray, column: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Scores of the queries ``at``; their parts are summed in the order of the query's terms."""
        s = np.zeros((len(at), scores.shape[1]))
        for pos in range(self.n[at].max()):
            having = np.flatnonzero(self.n[at] > pos)
            code = self.codes[self.first[at[having]] + pos]
            r = np.flatnonzero(dense[code])
            s[having[r]] += scores[dense[code[r]]]
            r = np.flatnonzero(n[code])
            many = n[code[r]]
            i = np.repeat(start[code[r]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            s[np.repeat(having[r], many), column[i]] += w[i]
        return s


def _of_cells(known: DataFrame, postings: DataFrame, k: int, shown: DataFrame | None, queries: int, terms: int) -> DataFrame:
    """RESULT and k: the k best snippets of each query (known: q, pos, term, idf, avgdl) in each share of the blocks.

    Shares of the blocks and parts of the queries meet in cells. Blocks stream past their cell's queries; a task holds the
    queries of one cell, the lists of one block and the best so far, and only those leave it."""
    parts = max(1, -(-queries // QUERIES_A_CELL), -(-terms // TERMS_A_CELL))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("part").cast("long") * SHARES + F.col("share")).alias("cell")
    lists = postings.select("block", "term", "docs")
    if shown is not None:
        each = postings.where("term = ''").select("block", F.explode("docs").alias("d")).withColumn("document_id", F.col("d.document_id")).withColumn("sub_id", F.col("d.sub_id"))
        each = each.join(shown.select("document_id", "sub_id"), ["document_id", "sub_id"], "left_semi")
        lists = lists.unionByName(each.groupBy("block").agg(F.collect_list("d").alias("docs")).select("block", F.lit(None).cast("string").alias("term"), "docs"))
    left = known.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts))).withColumn("share", numbers(SHARES))
    left = left.select(cell, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "q", "pos", "term", "idf", "avgdl", F.lit(None).cast(postings.schema["docs"].dataType).alias("docs"))
    none = [F.lit(None).cast(left.schema[n].dataType).alias(n) for n in ("idf", "avgdl")]
    right = lists.withColumn("share", F.pmod("block", F.lit(SHARES))).withColumn("part", numbers(parts))
    right = right.select(cell, F.lit(1).alias("kind"), F.col("block").cast("long").alias("block"), F.lit(None).cast("string").alias("q"), F.lit(None).cast("int").alias("pos"), "term", *none, "docs")
    filtered = shown is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None
        for (number, kind, _), part in _runs(batches):
            if number != at:
                if cell is not None and (done := cell.best()) is not None:
                    yield done
                at, cell = number, None
            if kind == 0:
                cell = _Cell(part, k)
            elif cell is not None:
                cell.add(part["term"].to_pylist(), part["docs"].combine_chunks(), filtered)
        if cell is not None and (done := cell.best()) is not None:
            yield done

    return left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "kind", "block", "q", "pos").mapInArrow(run, RESULT + ", k int")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Neighbouring rows of one cell, kind and block."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array([batch.column(n).to_numpy() for n in ("cell", "kind", "block")], np.int64)
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        for lo, hi in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            key = tuple(keys[:, lo].tolist())
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def query_terms(queries: DataFrame) -> DataFrame:
    """queries (q, text) -> q, pos, term: the distinct tokens of each."""
    return queries.select("q", F.posexplode(F.array_distinct(tokens(F.col("text")))).alias("pos", "term"))


def search(postings: DataFrame, queries: DataFrame, k: int, shown: DataFrame | None = None) -> DataFrame:
    """(q, document_id, sub_id, score): each query's k best snippets by BM25, those of bm25(); no text is read.

    postings: as build() gives them. queries: q, text. shown (document_id, sub_id): what may be returned; statistics
    cover all postings whatever it says, so a filter never changes a score.

    First only the heads of the query terms' blocks are read, and give each block the most that a snippet in it can
    score. The k best blocks of each query are scored; its k-th best snippet there bounds the result from below, so blocks
    that can't reach that bound are never read. Where queries and snippets share so many terms that they can't be shuffled, blocks
    stream past cells of queries instead, under the same bounds. The result is exact both ways.
    """
    terms = table(query_terms(queries), "query-terms")
    few = [r["term"] for r in terms.select("term").distinct().limit(MOST_PUSHED + 1).collect()]
    if len(few) <= MOST_PUSHED:
        postings = postings.where(F.col("term").isin(["", *few]))
    else:
        wanted = table(terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct(), "asked-terms")
        postings = postings.join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, "term", "left_semi")
    heads = postings.select("term", "block", "n", "max_tf", "min_dl", "sum_dl")
    stats = heads.where("term = ''").agg(F.sum("n").cast("double").alias("all"), (F.sum("sum_dl") / F.sum("n")).alias("avgdl"))
    df = heads.where("term <> ''").groupBy("term").agg(F.sum("n").cast("double").alias("df"))
    known = terms.join(df, "term").crossJoin(F.broadcast(stats))  # stats: one row
    known = table(known.select("q", "pos", "term", "df", "avgdl", F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "query-weights")
    size = known.agg(F.coalesce(F.sum("df"), F.lit(0.0)).alias("pairs"), F.countDistinct("q").alias("queries"), F.count(F.lit(1)).alias("terms")).first()
    if size["pairs"] > MOST_SHUFFLED:
        return ranked(_of_cells(known, postings, k, shown, size["queries"], size["terms"])).where(F.col("rank") <= k).drop("rank", "k")
    known = known.drop("df")

    most = known.join(heads.select("term", "block", "max_tf", "min_dl"), "term")
    bounds = table(most.groupBy("q", "block").agg((F.sum(_weight(F.col("max_tf"), F.col("min_dl"))) * (1 + SLACK)).alias("bound")), "block-bounds")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("bound").desc(), "block"))
    first = table(bounds.withColumn("nth", nth).where(F.col("nth") <= k).select("q", "block"), "first-blocks")
    found = table(ranked(_scores(known.join(first, "q"), postings, shown)).where(F.col("rank") <= k), "first-found")
    least = found.where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    rest = bounds.join(first, ["q", "block"], "left_anti").join(least, "q", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)))
    more = _scores(known.join(rest.select("q", "block"), "q"), postings, shown)
    return ranked(found.drop("rank").unionByName(more)).where(F.col("rank") <= k).drop("rank")

