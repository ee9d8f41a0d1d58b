"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of documents:

1. toxicity: documents whose noisy-or score is 0.5 or more go. The model is fitted to labels.toxic of the folder's labels.
2. line_dedup: lines on over a tenth of a source's documents (two at least) are dropped; n_chars follows.
3. ngram_jaccard: of documents connected by links of five-word shingles with similarity 0.8 or more, the one with the smallest id stays.
4. suffix_dedup: text covered by a 100-byte string that starts earlier in the corpus is cut out; n_chars follows.
5. packing: pieces of at most 2048 tokens, placed into sequences.

Null and empty texts pass through all stages (packing gives them an end id alone); an empty table gives an empty result. Rows that repeat an id are one document
and stay together. Extra columns pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard, linededup, packing, suffixdedup, toxicity
from millrace.llm.common import lean, table, tokenizer_file, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return suffixdedup.counted(linededup.drop_boilerplate_lines(docs))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return jaccard.one_of_each(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return suffixdedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_out),
    ("ngram_jaccard", copies_out),
    ("suffix_dedup", repeats_out),
    ("packing", packed),
]

#: SQL can't express the classifier, the substring removal and the packing; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
