"""Search by meaning for any number of queries: pages' vectors and queries in blocks, statistics from pages' moments.

A page's elements are packed into blocks of some BLOCK vectors, an element's vectors together (a page of any size is as many
blocks as it needs). Queries come in blocks, too; each pair of blocks is one product of matrices, never a pair of rows, and up to STATED_ROWS
queries are broadcast at a time, the next ones in a pass of their own.

An element counts where its best cosine stands out from its page's: mean and population deviation over all of the page's elements.
* Pages of one block have them from the product itself.
* Larger pages whose elements have one vector each have them from moments, the sum of their unit vectors and of
  the vectors' outer products, which give both for any query without its scores. Blocks whose vectors all lie too
  far from a query (centre and radius) are not multiplied for it. Only what stands out leaves a task; the page's best is among it, if anything is.
* Larger pages with several vectors for an element give all scores, which windows judge.

Rows without page, element or vector, vectors with nulls or of another length than the queries' take no part; a zero
vector scores 0; a deviation of zero counts as one; equal element ids of a page are one element; no queries or vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomstone.operators.relational import running
from loomstone.operators.retrieval import MEANING_MAX, MEANING_SPREAD, MEANING_Z, RERANK, STATED_ROWS, cosine
from loomstone.sources.scratch import cut, discard

BLOCK = 1024
#: Vectors of a block of which a search for the best keeps one.
LEFT_OUT = 50
#: Variance below which it is rounding of equal scores; margin of the bound for rounding.
EQUAL, MARGIN = 1e-14, 1e-9
#: Pages of several blocks that are broadcast at most.
BROADCAST_PAGES = 1 << 20


def _usable(rows: DataFrame, dims: int, *keys: str) -> DataFrame:
    rows = rows.select(*keys, F.col("vector").cast("array<double>").alias("vector"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.where((F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull()))


def page_blocks(vectors: DataFrame, dims: int, block: int = BLOCK, with_moments: bool = True) -> DataFrame:
    """Rows (page_id, salt, parts, single, elements, vectors, moments): the pages in blocks, larger ones with their moments, if wanted."""
    rows = _usable(vectors, dims, "page_id", "element_id")
    sizes = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("element_id").alias("distinct"))
    large = cut(sizes.where(F.col("n") > block).select("page_id", F.ceil(F.col("n") / block).alias("parts"), (F.col("n") == F.col("distinct")).alias("single")), "pages-large")
    few = large.count() <= BROADCAST_PAGES
    dealt = rows.join(F.broadcast(large) if few else large, "page_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("element_id"), F.col("parts")))
    listed = dealt.groupBy("page_id", "salt", "parts", "single").agg(F.collect_list(F.struct("element_id", "vector")).alias("rows"))
    packed = listed.select("page_id", "salt", "parts", F.coalesce("single", F.lit(False)).alias("single"), F.col("rows.element_id").alias("elements"), F.flatten("rows.vector").alias("vectors"))
    packed = cut(packed, "page-blocks")
    if not with_moments:
        return packed.withColumn("moments", F.lit(None).cast("array<double>"))
    summed = packed.where("parts > 1 AND single").mapInArrow(lambda it: _moments(it, dims), packed.select("page_id", F.lit(0).alias("k"), F.lit(0.0).alias("value")).schema)
    summed = summed.groupBy("page_id", "k").agg(F.sum("value").alias("value"))
    # As many entries as a vector and its outer product have.
    moments = summed.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("moments"))
    moments = cut(moments, "page-moments")
    whole = cut(packed.join(F.broadcast(moments) if moments.count() * dims * dims <= BROADCAST_PAGES * 8 else moments, "page_id", "left"), "page-blocks")
    discard(packed, moments)
    return whole


def _units(values: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow list, one behind the other, at length one (zero vectors stay)."""
    v = values.to_numpy(zero_copy_only=False).reshape(-1, dims)
    norm = np.sqrt((v * v).sum(axis=1))
    return v / np.where(norm == 0, 1, norm)[:, None]


def _moments(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            v = _units(batch.column("vectors")[i].values, dims)
            values = np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
            page = pa.array([batch.column("page_id")[i]] * len(values), type=batch.schema.field("page_id").type)
            yield pa.record_batch([page, pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["page_id", "k", "value"])


class _Pair:
    """A block of a page and a block of queries."""

    def __init__(self, batch: pa.RecordBatch, i: int, dims: int):
        at = lambda name: batch.column(name)[i]
        self.page, self.parts, self.single, self.salt = at("page_id"), at("parts").as_py(), at("single").as_py(), at("salt").as_py()
        self.vectors, self.queries = _units(at("vectors").values, dims), _units(at("wanted").values, dims)
        self.elements, self.query_ids = at("elements").values, at("query_ids").values
        codes = self.elements.dictionary_encode()
        self.names, self.code = codes.dictionary, codes.indices.to_numpy()
        moments = at("moments")
        self.moments = None if moments is None or not moments.is_valid else moments.values.to_numpy(zero_copy_only=False)
        self.dims = dims
        # The element of each query's own id, which takes no part: its place in the block, and its score where it lies in another one.
        self.own_place, self.own_score = None, None
        if "own" in batch.schema.names:
            at_id = {e: i for i, e in enumerate(self.names.to_pylist())}
            self.own_place = np.array([at_id.get(q, -1) for q in self.query_ids.to_pylist()])
            page, own = self.page.as_py(), at("own").as_py()
            self.own_score = np.array([next((x["score"] for x in of or () if x["page_id"] == page), np.nan) for of in own])

    def without_own(self, s: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Scores with nan for the elements of the queries' own ids."""
        if self.own_place is not None:
            place = self.own_place[rows]
            has = np.flatnonzero(place >= 0)
            s[has, place[has]] = np.nan
        return s

    def scores(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Best cosine of each element (columns) for queries."""
        s = self.queries[rows] @ self.vectors.T
        if len(self.names) == s.shape[1]:
            return s
        order = np.argsort(self.code, kind="stable")
        return np.maximum.reduceat(s[:, order], np.flatnonzero(np.diff(self.code[order], prepend=-1)), axis=1)

    def page_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the page for each query, from its moments."""
        n, total = self.moments[0], self.moments[1 : self.dims + 1]
        second = self.moments[self.dims + 1 :].reshape(self.dims, self.dims)
        sums, squares = self.queries @ total, ((self.queries @ second) * self.queries).sum(axis=1)
        if self.own_score is not None:
            has = ~np.isnan(self.own_score)
            own = np.where(has, self.own_score, 0)
            n, sums, squares = np.maximum(n - has, 1), sums - own, squares - own * own
        mean = sums / n
        variance = squares / n - mean * mean
        return mean, np.where(variance < EQUAL, 1, np.sqrt(np.maximum(variance, EQUAL)))

    def rows(self, query: np.ndarray, element: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
        page = pa.array([self.page] * len(query), type=self.page.type)
        return [self.query_ids.take(pa.array(query)), page, self.names.take(pa.array(element)), *(pa.array(v, pa.float64()) for v in values)]

    def standing_out(self, z: float) -> list[pa.Array]:
        """(query, page, element, score, z) of what reaches z; all scores without z where the page's statistics are not known."""
        if self.parts > 1 and not self.single:
            s = self.without_own(self.scores())
            q, e = np.nonzero(~np.isnan(s))
            return self.rows(q, e, s[q, e], np.full(len(q), np.nan))
        if self.parts == 1:
            live, s = np.arange(len(self.queries)), self.without_own(self.scores())
            here = ~np.isnan(s)
            n = np.maximum(here.sum(axis=1), 1)
            mean = np.where(here, s, 0).sum(axis=1) / n
            sd = np.sqrt((np.where(here, s - mean[:, None], 0) ** 2).sum(axis=1) / n)
            sd = np.where(sd * sd < EQUAL, 1, sd)
        else:
            mean, sd = self.page_statistics()
            centre = self.vectors.mean(axis=0)
            radius = np.sqrt(((self.vectors - centre) ** 2).sum(axis=1).max())
            live = np.flatnonzero(self.queries @ centre + radius * np.sqrt((self.queries**2).sum(axis=1)) >= mean + z * sd - MARGIN)
            mean, sd, s = mean[live], sd[live], self.without_own(self.scores(live), live)
        over = (s - mean[:, None]) / sd[:, None]
        q, e = np.nonzero(over >= z)
        return self.rows(live[q], e, s[q, e], over[q, e])

    def best(self, most: int) -> list[pa.Array]:
        """(query, page, element, score, null) of each query's best ``most`` scores in the block; of equal ones those of the least ids."""
        s = self.scores()
        order = pc.sort_indices(self.names).to_numpy()
        if s.shape[1] > most:
            s = s[:, order]
            least = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most][:, None]
            equal, more = s == least, s > least
            q, e = np.nonzero(more | (equal & (np.cumsum(equal, axis=1) <= most - more.sum(axis=1)[:, None])))
            return self.rows(q, order[e], s[q, e], np.full(len(q), np.nan))
        q, e = np.divmod(np.arange(s.size), s.shape[1])
        return self.rows(q, e, s[q, e], np.full(len(q), np.nan))

    def sums(self) -> list[pa.Array]:
        """(query, page, n, sum, sum of squares) of the block's scores; of the whole page, once, where it has moments."""
        nq = len(self.queries)
        if self.parts > 1 and self.single:
            if self.salt:
                nq, n, a, b = 0, np.zeros(0), np.zeros(0), np.zeros(0)
            else:
                count, total, second = self.moments[0], self.moments[1 : self.dims + 1], self.moments[self.dims + 1 :].reshape(self.dims, self.dims)
                n, a, b = np.full(nq, count), self.queries @ total, ((self.queries @ second) * self.queries).sum(axis=1)
        else:
            s = self.scores()
            n, a, b = np.full(nq, float(s.shape[1])), s.sum(axis=1), (s * s).sum(axis=1)
        return [self.query_ids.slice(0, nq), pa.array([self.page] * nq, type=self.page.type), pa.array(n), pa.array(a), pa.array(b)]


def _own_scores(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """``asked`` with ``own``: the pages and scores of the elements of the query's own id, as many as there are such pages."""
    own = vectors.join(asked.select(F.col("query_id").alias("element_id"), "nth_row", F.col("vector").alias("wanted")), "element_id")
    best = own.groupBy("nth_row", "page_id").agg(F.max(cosine(F.col("wanted"), F.col("vector"))).alias("score"))
    return asked.join(best.groupBy("nth_row").agg(F.collect_list(F.struct("page_id", "score")).alias("own")), "nth_row", "left")


def _paired(vectors: DataFrame, queries: DataFrame, block: int, kernel: str, args: tuple, names: list[str], skip_equal: bool = False) -> DataFrame:
    """The rows of ``kernel`` for every page block and query block; the queries in passes of at most STATED_ROWS."""
    first = queries.select(F.size("vector")).where(F.col("size(vector)") > 0).first()
    dims = first[0] if first else 1
    asked = _usable(queries, dims, "query_id")
    placed = running(asked.withColumn("nth_row", F.monotonically_increasing_id()), ["query_id", "nth_row"])
    held = ["query_id", "vector"]
    if skip_equal:
        placed, held = _own_scores(cut(placed, "query-rows"), _usable(vectors, dims, "page_id", "element_id")), [*held, "own"]
    grouped = placed.groupBy(F.floor((F.col("place") - 1) / block).alias("nth")).agg(F.collect_list(F.struct(*held)).alias("rows"))
    columns = [F.col("rows.query_id").alias("query_ids"), F.flatten("rows.vector").alias("wanted"), *([F.col("rows.own").alias("own")] if skip_equal else [])]
    wanted = cut(grouped.select("nth", *columns), "query-blocks")
    n_blocks, a_pass = wanted.count(), max(1, STATED_ROWS // block)
    pages = page_blocks(vectors, dims, block, kernel != "best")
    known = {f.name: f for f in [*queries.schema, *vectors.schema]}
    schema = StructType([known[c] if c in known else StructField(c, DoubleType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.record_batch(getattr(_Pair(batch, i, dims), kernel)(*args), names=names)

    found = None
    for start in range(0, max(n_blocks, 1), a_pass):
        stop = min(start + a_pass, max(n_blocks, 1))
        met = pages.withColumn("nth", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(stop - 1).cast("long"))))
        pairs = met.join(F.broadcast(wanted.where((F.col("nth") >= start) & (F.col("nth") < stop))), "nth")
        rows = pairs.mapInArrow(run, schema)
        found = rows if found is None else found.union(rows)
    return found


def meaning_matches(vectors: DataFrame, queries: DataFrame, z: float = MEANING_Z, spread: float = MEANING_SPREAD, most: int = MEANING_MAX, block: int = BLOCK, skip_equal: bool = False) -> DataFrame:
    """query_id, page_id, element_id, score, z, rank: for each query and page the elements that stand out and are near the best.

    vectors(page_id, element_id, vector), queries(query_id, vector). ``skip_equal``: an element takes no part for the query of its own id.
    """
    found = cut(_paired(vectors, queries, block, "standing_out", (z,), ["query_id", "page_id", "element_id", "score", "z"], skip_equal), "meaning")
    page = Window.partitionBy("query_id", "page_id")
    sd = F.stddev_pop("score").over(page)
    rated = found.where(F.isnan("z")).withColumn("z", (F.col("score") - F.avg("score").over(page)) / F.when(sd * sd < EQUAL, 1.0).otherwise(sd))
    kept = found.where(~F.isnan("z")).union(rated).where(F.col("z") >= z).withColumn("top", F.max("score").over(page)).where(F.col("score") >= F.col("top") - spread).drop("top")
    return kept.withColumn("rank", F.row_number().over(page.orderBy(F.desc("score"), "element_id"))).where(F.col("rank") <= most)


def rerank_candidates(vectors: DataFrame, queries: DataFrame, most: int = RERANK, block: int = BLOCK) -> DataFrame:
    """query_id, page_id, element_id, score, rank: for each query and page the best ``most`` elements, for a check of their texts.

    A block gives ``most`` scores for each query, so blocks hold LEFT_OUT times as many vectors at least; of smaller ones nearly all pairs would be rows.
    """
    block = max(block, LEFT_OUT * most)
    found = _paired(vectors, queries, block, "best", (most,), ["query_id", "page_id", "element_id", "score", "z"]).drop("z")
    best = Window.partitionBy("query_id", "page_id").orderBy(F.desc("score"), "element_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def similarity(vectors: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """query_id, page_id, mean, sd of the scores of a page's elements for each query."""
    sums = _paired(vectors, queries, block, "sums", (), ["query_id", "page_id", "n", "a", "b"])
    total = sums.groupBy("query_id", "page_id").agg(*(F.sum(c).alias(c) for c in "nab"))
    variance = F.col("b") / F.col("n") - (F.col("a") / F.col("n")) * (F.col("a") / F.col("n"))
    return total.select("query_id", "page_id", (F.col("a") / F.col("n")).alias("mean"), F.when(variance < EQUAL, 1.0).otherwise(F.sqrt(variance)).alias("sd"))
