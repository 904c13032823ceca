"""Language identification by nearest centroid over hashed, normalised TF-IDF n-gram vectors.

The model is fitted on a bounded sample: at most ``per_language`` labelled rows of each language, those with the
least hash of doc_id and text among the rows that may be learned from. Document frequencies are summed and each language's
centroids (spherical k-means) found in tasks; only the centroids come to the driver. A text takes the language of the
centroid with the largest cosine. It is rejected when it is farther from every centroid than texts of its length
are: for each power of two of n-grams, the sample's texts and pieces of them give the cosine that all but
``OUTLIERS`` of them reach, and a text is beyond the radius at less than ``REJECT_SHARE`` of it.

Defined results: null text and text without any letter is ``und`` with score 0 and rejected; a model
without languages (no labelled rows) gives ``und`` everywhere; null doc_id counts as the empty text in the
split; repeated rows each give a row, and equal rows count once in the sample. Column names of the input may be anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, discard, fresh, small_batches
from loomstone.llm.textcore import passes, string_bytes

N_GRAM = 3
BUCKETS = 4096
#: Bound of the sample: labelled rows of each language that the model is fitted on.
PER_LANGUAGE = 400
CENTROIDS = 4
#: Languages of one broadcast part of the model (64 KB each); a model of more goes over the texts part by part.
PART_LANGUAGES = 512
#: The radius: share of the sample's pieces that may be outliers, and share of the cosine that the others reach.
OUTLIERS, REJECT_SHARE = 0.01, 0.7
#: Letters of the least piece; shorter texts are not rejected for their distance.
LEAST_PIECE = 16
UNKNOWN = "und"

#: ASCII bytes that are no letters count as white space.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray  # least cosine by bits of the number of n-grams


def held_out(doc_id, parts: int, part: int):
    """True where crc32 of doc_id as text leaves ``part``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def least_hashed(rows: DataFrame, group: str, most: int, *by: str) -> DataFrame:
    """The ``most`` rows of each group with the least hash of the columns ``by``; rows equal in them count once.

    A large group is cut to about four times as many by its hash before it is ranked, so that no task ranks a whole group.
    """
    n, h, rank = (fresh(x, rows) for x in ("n", "h", "rank"))
    # Distinct rows, about: the cut leaves several times as many as are taken.
    sizes = cut(rows.groupBy(group).agg(F.approx_count_distinct(F.xxhash64(*by)).alias(n)), "group-sizes")
    few = sizes if sizes.count() > 10_000 else F.broadcast(sizes)
    share = F.least(F.lit(1.0), 4.0 * most / F.col(n))
    hashed = rows.withColumn(h, F.xxhash64(*by)).join(few, group).where(F.pmod(h, F.lit(1 << 20)) < share * (1 << 20))
    order = Window.partitionBy(group).orderBy(F.pmod(h, F.lit(1 << 20)), h, *by)
    return hashed.dropDuplicates([group, *by]).withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most).select(*rows.columns)


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Hashed n-gram counts of each text (lower-cased UTF-8 bytes), one row of BUCKETS each."""
    raw, offsets = string_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(offsets) - 1
    if len(raw) < N_GRAM:
        return np.zeros((n, BUCKETS), dtype=np.int64)
    folded = _FOLD[raw]
    grams = len(raw) - N_GRAM + 1
    h = folded[:grams] * np.uint32(0x9E3779B1)
    for i, prime in enumerate((0x85EBCA77, 0xC2B2AE3D), 1):
        h ^= (folded[i : i + grams] + np.uint32(i)) * np.uint32(prime)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    bucket = (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    inside = np.maximum(np.diff(offsets) - N_GRAM + 1, 0)
    doc = np.repeat(np.arange(n), inside)
    at = np.repeat(offsets[:-1], inside) + np.arange(len(doc)) - np.repeat(np.cumsum(inside) - inside, inside)
    return np.bincount(doc * BUCKETS + bucket[at], minlength=n * BUCKETS).reshape(n, BUCKETS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts, dtype=np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with farthest-first starts; the same for the same rows in the same order."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(start) < min(k, len(x)):
        far = (x @ x[start].T).max(axis=1)
        far[start] = np.inf
        start.append(int(np.argmin(far)))
    c = x[start]
    for _ in range(12):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _rows_of(counts: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in counts.astype(np.uint32)], type=pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, BUCKETS)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Fit on the sample of labelled documents outside the held-out part (crc32 mod 4 = 2)."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    sample = cut(least_hashed(labelled, "lang", per_language, "doc_id", "text").select("text", "lang"), "langid-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text", 1 << 20):
                for at in range(0, part.num_rows, 256):
                    few = part.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([few.column("lang"), _rows_of(gram_counts(few.column("text")))], names=["lang", "grams"])

    grams = cut(sample.mapInArrow(count, "lang string, grams binary"), "langid-grams")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([_rows_of((_matrix(batch.column("grams")) > 0).sum(axis=0)[None, :]), pa.array([batch.num_rows])], names=["grams", "n"])

    # Sums of batches: one row of BUCKETS numbers for some thousand sampled rows.
    total, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for row in grams.mapInArrow(frequency, "grams binary, n long").toLocalIterator():
        total += np.frombuffer(row.grams, dtype=np.uint32)
        n += row.n
    if not n:
        return Model(np.ones(BUCKETS, dtype=np.float32), np.zeros((0, BUCKETS), dtype=np.float32), [], np.zeros(1))
    idf = (np.log((1 + n) / (1 + total)) + 1).astype(np.float32)

    def nearest(group: pa.Table) -> pa.Table:
        # At most per_language rows; in order of content, so that any dealing gives the same.
        rows = _matrix(pa.chunked_array([pa.array(sorted(group.column("grams").to_pylist()), type=pa.binary())]))
        found = _centroids(_vectors(rows, idf), centroids)
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(found), "centroid": pa.array([c.astype(np.float32).tobytes() for c in found], type=pa.binary())})

    found = sorted(((r.lang, bytes(r.centroid)) for r in grams.groupBy("lang").applyInArrow(nearest, "lang string, centroid binary").toLocalIterator()))
    model = Model(idf, np.stack([np.frombuffer(c, dtype=np.float32) for _, c in found]), [lang for lang, _ in found], np.zeros(1))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size class and cosine of each text, and of the middle 16, 32, 64, ... letters of it."""
        for batch in batches:
            for part in passes(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                for at in range(0, len(texts), 64):
                    cuts = [t[(len(t) - size) // 2 :][:size] for t in texts[at : at + 64] for size in (LEAST_PIECE << i for i in range(20)) if size < len(t)]
                    some = pa.array(texts[at : at + 64] + cuts, type=pa.string())
                    for first in range(0, len(some), 256):
                        counts = gram_counts(some.slice(first, 256))
                        near = (_vectors(counts, send.value.idf) @ send.value.centroids.T).max(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(_size_class(counts)), pa.array(near.astype(float))], names=["k", "near"])

    send = spark.sparkContext.broadcast(model)
    # One row for each power of two.
    rows = sample.mapInArrow(pieces, "k int, near double").groupBy("k").agg(F.expr(f"percentile(near, {OUTLIERS})").alias("near")).collect()
    least = {r.k: r.near * REJECT_SHARE for r in rows if r.k > 3}
    model.limits = np.array([least.get(k, 0.0) for k in range(max([*least, 0]) + 1)])
    discard(sample, grams)
    return model


def _size_class(counts: np.ndarray) -> np.ndarray:
    """Bits of the number of n-grams of each row."""
    return np.frexp(counts.sum(axis=1).astype(float))[1].astype(np.int32)


def detect(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """``carry`` columns of every document, with lang_pred, score (cosine) and rejected."""
    small_batches(docs.sparkSession)
    source = docs.select(*dict.fromkeys([*carry, "text"]))
    carried = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carry)
    found = "lang_pred string, score double, rejected boolean"
    inner = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(carry)}
    languages = sorted(set(model.languages))
    parts = [set(languages[i : i + PART_LANGUAGES]) for i in range(0, len(languages), PART_LANGUAGES)] or [set()]

    def search(rows: DataFrame, names: list[str], first: bool, last: bool) -> DataFrame:
        """One pass over the texts with some languages; what passes before found is in the columns best and near."""
        at = [i for i, lang in enumerate(model.languages) if lang in names]
        # At most PART_LANGUAGES * CENTROIDS vectors.
        send = rows.sparkSession.sparkContext.broadcast(Model(model.idf, model.centroids[at], [model.languages[i] for i in at], model.limits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = send.value
            known = np.array([*m.languages, UNKNOWN], dtype=object)
            for batch in batches:
                for part in passes(batch, "text", 1 << 20):
                    for begin in range(0, part.num_rows, 256):
                        few = part.slice(begin, 256)
                        counts = gram_counts(few.column("text"))
                        best, score = np.full(len(counts), UNKNOWN, dtype=object), np.zeros(len(counts))
                        if m.languages:
                            near = _vectors(counts, m.idf) @ m.centroids.T
                            best, score = known[near.argmax(axis=1)], np.clip(near.max(axis=1), 0, 1).astype(float)
                        if not first:
                            before, cosine = few.column("best").to_numpy(zero_copy_only=False), few.column("near").to_numpy(zero_copy_only=False)
                            best, score = np.where(score > cosine, best, before), np.maximum(score, cosine)
                        if not last:
                            others = [n for n in inner.values() if n != "text"]
                            yield pa.RecordBatch.from_arrays([*(few.column(n) for n in [*others, "text"]), pa.array(best, type=pa.string()), pa.array(score)], names=[*others, "text", "best", "near"])
                            continue
                        letters = pc.fill_null(pc.match_substring_regex(few.column("text"), r"\pL"), False).to_numpy(zero_copy_only=False) & bool(len(model.languages))
                        reject = ~letters | (score < m.limits[np.minimum(_size_class(counts), len(m.limits) - 1)])
                        best, score = np.where(letters, best, UNKNOWN), np.where(letters, score, 0.0)
                        yield pa.RecordBatch.from_arrays([*(few.column(inner[c]) for c in carry), pa.array(best, type=pa.string()), pa.array(score), pa.array(reject)], names=[*carry, "lang_pred", "score", "rejected"])

        between = ", ".join([*(f"{n} {source.schema[c].dataType.simpleString()}" for c, n in inner.items() if n != "text"), "text string, best string, near double"])
        return rows.mapInArrow(run, ", ".join(x for x in (carried, found) if x) if last else between)

    rows = source.select(*(F.col(c).alias(n) for c, n in inner.items() if n != "text"), "text")
    for i, names in enumerate(parts):
        rows = search(rows, names, i == 0, i == len(parts) - 1)
    return rows
