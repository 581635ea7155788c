"""A corpus pipeline of five stages; each is a function (spark, docs, sf_dir) of the stage before.

Every stage's result is written and read again as the next one's input. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinale.llm import contamination, near, packing, passages, toxicity
from ordinale.llm.columns import masked, unmasked
from ordinale.llm.queries import tokenizer_path
from ordinale.llm.storage import cut, discard


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for toxicity go; lexicon and score are learned from the labels of these documents.

    Null and empty texts have no terms and stay, unless the labels say that a text without
    any is toxic more often than not. Rows that repeat a text are treated alike, a very long
    text is scored whole, and without labels of both kinds every document stays. An empty
    table stays empty; columns of any name are carried along.
    """
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept, inner = masked(docs, docs.columns)
    return unmasked(toxicity.score(kept, model, inner["text"]).where(F.col("toxicity") < 0.3), inner)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least doc_id.

    Null texts and those without words are in no class and all stay. Where rows share the
    least doc_id, each different text of the class among them stays once; of a class of
    null ids every different text does. An empty table stays empty; long texts are
    compared whole, and columns of any name are carried along.
    """
    return near.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go, and with them documents of which no word is left; n_chars follows the text.

    Documents are in the order of doc_id, nulls last, equal ids by their texts; rows that
    repeat id and text are one document and all stay. Null, empty and wordless texts stay,
    with n_chars as it was for null. An empty table stays empty; long texts are handled
    whole, and columns of any name are carried along.
    """
    return passages.remove_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*(f"`{c}`" for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: those of whose words a twentieth or more stand in a window of a benchmark item.

    Null and empty texts have no words and stay; an empty benchmark leaves all documents.
    Items with a null id count like others. Repeated rows are treated alike, an empty table
    stays empty, long texts are scanned whole, and columns of any name are carried along.
    """
    kept, inner = masked(docs, docs.columns)
    found = contamination.find(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), inner["text"], unnamed=True)
    return unmasked(found.where(~contamination.contaminated()), inner)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece.

    A null or empty text is the closing id alone; a null or repeated doc_id is packed like
    others, each row by itself; a very long text is cut over as many sequences as it needs.
    An empty table gives no rows; other columns are not read.
    """
    out = packing.pack(docs, tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group", "token_ids")


STAGES = [("toxicity", without_toxic), ("ngram_join", one_of_each), ("passages", without_repeats), ("decontamination", without_benchmark), ("packing", packed)]

#: SQL can't express learned scores, the join's components or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is written to the shared checkpoint folder and removed when the next stage is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
