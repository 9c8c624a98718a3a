"""A training-data pipeline of five stages, from raw documents to packed sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; run() writes what a stage returns as
Parquet in the shared folder and reads it again for the next. All stages but the last return the
columns of documents. Null texts are undetermined in language, so none is left after the first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwater.llm.common import free_name, maybe_in, membership, stored
from tarnwater.llm.language_id import keep_identified
from tarnwater.llm.line_dedup import drop_repeated_lines
from tarnwater.llm.packing import pack
from tarnwater.llm.secret_scan import redact, train
from tarnwater.llm.shingle_join import link

#: Near duplicates share so many hundredths of their shingles of so many words.
WORDS, PERCENT = 5, 80


def measured(docs):
    """docs with n_chars as the text now has it, where there is such a column."""
    kind = dict(docs.dtypes).get("n_chars")
    return docs.withColumn("n_chars", F.char_length("text").cast(kind)) if kind else docs


def language(spark, docs, sf_dir):
    """Documents whose language the classifier tells; the others go, null and empty texts among them. Repeated
    rows come or go together; texts are scored whole, whatever their length; columns stay."""
    return keep_identified(docs)


def lines(spark, docs, sf_dir):
    """Later repeated runs of lines go, and documents of which no word is left."""
    done = drop_repeated_lines(docs)
    removed = done.columns[-1]  # its name depends on those of docs
    return measured(done.where((F.col(removed) == 0) | F.col("text").rlike(r"\S")).select(docs.columns))


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates one row stays: that with the least id, a null id coming last;
    where an id has several texts, that with the least hash of its text; of rows that agree in both,
    the least by all columns. Documents without words are in no group and all stay. Columns of docs
    stay, whatever their names."""
    key, gone, maybe = (free_name(docs, c) for c in ("key", "gone", "maybe"))
    hashes = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    rows = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", hashes.alias("hash")))
    found = link(rows, WORDS, PERCENT, id_col=key).where("n_shingles > 0").select(F.col(key), "component_id")
    known = found.groupBy(key).agg(F.bool_or(F.col(key) != F.col("component_id")).alias(gone), F.count("*").alias("n"))
    known = stored(known.where(F.col(gone) | (F.col("n") > 1)).select(key, gone))
    # only rows that may be in the list are shuffled to meet it
    rows = maybe_in(rows, key, membership(known, key), maybe)
    met = rows.where(F.col(maybe)).join(known, key, "left")
    again = met.where(~F.col(gone)).groupBy(key).agg(F.min(F.struct(docs.columns)).alias("row"))
    alone = rows.where(~F.col(maybe)).select(docs.columns)
    return alone.unionByName(met.where(F.col(gone).isNull()).select(docs.columns)).unionByName(again.select("row.*"))


def secrets(spark, docs, sf_dir):
    """Secrets are replaced by a mark, in whole texts of any length. Null and empty texts, repeated rows and
    all columns stay; n_chars is counted anew."""
    return measured(redact(docs, train(docs)))


def packing(spark, docs, sf_dir):
    """All words of what is left, placed in training sequences."""
    return pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("packing", packing)]

#: Models and packing have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The placement of every word of documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
