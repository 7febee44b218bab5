"""A corpus pipeline: quality classifier, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docsift.llm import jaccard_join, line_dedup, packing, quality
from docsift.llm.common import documents, dropped, stored

def quality_stage(spark, docs, sf_dir):
    """Documents whose best grade is the likelier outcome stay, with all their columns; a tail of exactly 0.5 stays.

    A null or empty text is scored by its lack of words, a text of any length
    as a whole; rows of one id and rows without one are judged each by its own
    text. Without labels the tail is 0.5 for all, so all stay; an empty table
    stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, quality.grades(labels))
    return quality.score_documents(docs, model).where("tail_probability >= 0.5").select("row.*")


def lines_stage(spark, docs, sf_dir):
    """Lines that three documents share stay in the one with the largest doc_id; n_chars follows the text.

    All rows and all other columns stay. A null text becomes the empty text;
    rows of one doc_id are one document and a null doc_id is the smallest;
    lines of any length count as a whole; an empty table stays empty.
    """
    found = line_dedup.dedup_lines(docs)
    named = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[named[c].alias(c) if c in named else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates_stage(spark, docs, sf_dir):
    """Of each group of documents with similar five-word shingles the row with the smallest doc_id stays, with all its columns.

    Of repeated rows one stays; rows without doc_id or without words stay;
    texts of any length are compared whole; an empty table stays empty.
    """
    return jaccard_join.keep_one(docs, n=5, threshold=0.8)


def packing_stage(spark, docs, sf_dir):
    """The kept documents as pieces of training sequences, without other columns.

    A null or empty text is the end id alone, a text of any length is cut as
    needed, and rows of one doc_id or of none are examples of their own; an
    empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near_duplicates", near_duplicates_stage), ("packing", packing_stage)]

#: The classifier's weights can't be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
