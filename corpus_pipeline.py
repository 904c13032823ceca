"""A training-data pipeline over ``documents``: language ID, near-dedup, decontamination, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents (the last: the token files' index); its
result is written as Parquet and read again as the next stage's docs. Other columns of documents may have any name
and come through; an empty table gives empty results. This file belongs to ``loomstone.llm`` and needs it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import fmindex, langid, mixing, simhash, tokens
from loomstone.llm.scratch import cut, discard, fresh, numbered, renamed, sweep

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def with_place(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that tell its rows apart for good: file and row of a written table."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not read from files: write it
        docs = cut(docs, "placed")
    place = [fresh("file_key", docs), fresh("row_key", docs)]
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(place[0]), F.col("_metadata.row_index").alias(place[1])), place


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the nearest-centroid model accepts; fitted on the stage's own input.

    Null texts and texts without a letter go; repeated rows each stay.
    """
    sweep(spark)
    named, names = numbered(docs, "text")
    found = langid.detect(named, langid.fit(docs), named.columns)
    return renamed(found.where(~F.col("rejected")), names, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: five-word shingles, similarity 0.8 or more, decided by the exact sets.

    A class keeps the document with the smallest doc_id, rows without one last (of rows with equal doc_id the one with the
    smallest hash of its content). The least row is taken before rows are shuffled.
    """
    sweep(spark)
    named, place = with_place(docs)
    content = fresh("content", named)
    rows = named.select(*place, "doc_id", "text", F.xxhash64("text", "source", "lang", "n_chars").alias(content))
    classes = simhash.similar_documents(rows, similarity=0.8, shingle=5, carry=(*place, content))
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", content, *place)
    kept = classes.groupBy("class_id").agg(F.min_by(F.struct(*place), order).alias("kept")).select("kept.*")
    return named.join(kept, place, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark windows; null and wordless texts stay."""
    sweep(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named, names = numbered(docs, "text")
    found = fmindex.contaminated_spans(named, benchmark, named.columns)
    return renamed(found.where(~fmindex.is_contaminated(fmindex.n_hit(), F.col("n_words"))), names, docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken; the last time only the words that the mix still takes.

    Only the rows' places travel through the mixing; texts are joined to the result once. Null and wordless texts
    are taken no time; the null source is a source.
    """
    sweep(spark)
    placed, place = with_place(docs)
    named, names = numbered(placed, "text", "doc_id", "source", "n_chars")
    place = [names[c] for c in place]
    amounts = mixing.mix(named.select(*place, "doc_id", "source", "text"), place)
    taken = named.join(amounts.select(*place, "size", "taken").where("taken > 0"), place)
    times = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))
    left = F.col("taken") - (F.col("time") - 1) * F.col("size")
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)), 1, left.cast("int")), " ")
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(words)
    out = taken.select("*", F.explode(times).alias("time")).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return renamed(out, names, docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Range-coded token files of the mix, and the index that is read back from them."""
    import public_tokenizers

    sweep(spark)
    return tokens.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token IDs", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what lies between two stages is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i}")
            if before is not None:
                discard(before)
            before = docs
    return docs
