"""A training corpus from raw documents: toxicity, exact and near copies, personal data, packing."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetspan.llm import exact_dedup, near_dedup, packing, pseudonyms, toxicity
from vetspan.llm.queries import DEMO_KEY, table, tokenizer_file, toxicity_model
from vetspan.llm.shared import written

#: Setting of the session that holds the key of pseudonyms.
SECRET = "spark.vetspan.pseudonymSecret"
#: Near copies: five-word shingles, similarity of 0.8 or more.
NEAR = near_dedup.Similarity(words=5, percent=80)
#: Toxicity: terms that tell the labels apart outweigh the words of a topic; chosen by leave-one-out votes of the labelled rows of sf0.1 that may be learnt from.
TOXIC = toxicity.ToxicitySettings(telling=4.0)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under 0.5, with the columns of `docs`; a null text is scored as an empty one."""
    model = toxicity_model(spark, docs, sf_dir, TOXIC)
    scored = toxicity.score_documents(docs, model, prefix="__vs_")
    return scored.filter("__vs_predicted = 0").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, that with the largest doc_id (of repeated rows one); null texts equal empty ones; an empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by similarity, that with the smallest doc_id; wordless and null texts stay, and rows with a null id."""
    return near_dedup.drop_near_copies(docs, NEAR)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal values replaced by pseudonyms; n_chars follows where the text's length changes.

    The key is the session's spark.vetspan.pseudonymSecret (Spark hides settings of such names in its pages
    and logs). Without it the key of the demonstration is used, with a warning: it stands in this source, so
    its pseudonyms can be undone by anyone. A null text or n_chars stays null.
    """
    key = spark.conf.get(SECRET, None)
    if not key:
        warnings.warn(f"{SECRET} isn't set: the pseudonyms use the key of the demonstration and protect nobody", stacklevel=2)
        key = DEMO_KEY
    marked = pseudonyms.pseudonymise(docs.withColumn("__vs_length", F.length("text")), key, found_col=None)
    if "n_chars" in docs.columns:
        change = F.coalesce(F.length("text") - F.col("__vs_length"), F.lit(0))
        marked = marked.withColumn("n_chars", (F.col("n_chars") + change).cast(docs.schema["n_chars"].dataType))
    return marked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a null text is an empty document of one token, an empty table has no piece."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("pii", hide_personal_data), ("packing", pack)]

#: No stage but the exact copies can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that all stages kept, from the table of documents; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
