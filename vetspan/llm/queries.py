"""One query for each corpus operator, over its whole table, with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, clusters, decontamination, exact_dedup, licences, near_dedup, oracles, packing, pseudonyms, repetition, search, toxicity, warc
from .shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/id div 1000/id div 50; the first id of a thousand or fifty is the LICENSE file of that directory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    top, group = (F.expr(f"CAST(doc_id DIV {n} AS STRING)") for n in (1000, 50))
    place = F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", top, F.lit("LICENSE"))).when(F.col("doc_id") % 50 == 0, F.concat_ws("/", top, group, F.lit("LICENSE"))).otherwise(F.concat_ws("/", top, group, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    tree = docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("-")), place))
    scanned = written(licences.scan_licences(tree).drop("text"), "licence-scan")  # read three times
    found = licences.inherit_licences(scanned)
    return found.select("doc_id", "path", "own_licence", "own_cosine", "own_line", "licence", "licence_from", "licence_directory")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "closed")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_bundles(table(spark, sf_dir, "pages"))
    records = warc.read_bundles(index)
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("header_digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return records.select(F.col("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str, settings: toxicity.ToxicitySettings = toxicity.ToxicitySettings()) -> toxicity.ToxicityModel:  # noqa: B008
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out())
    return toxicity.fit(docs, labels, settings)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "evidence")


#: Key of the registered queries only; a job takes its own from where it keeps secrets.
DEMO_KEY = "vetspan-demo-key"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts look like marks of a template."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mark = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(mark).alias("text"))
    kinds = dict(rows.dtypes)
    extra = extra.select([F.col(c).cast(kinds[c]) for c in rows.columns])
    return chat_format.digest_turns(chat_format.format_turns(rows.unionByName(extra)))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_documents(encoded, path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


#: The contract's rule: three-word shingles, similarity of 0.85 or more.
OP9_RULE = near_dedup.Similarity(words=3, percent=85)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), OP9_RULE)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_index(table(spark, sf_dir, "documents"))
    return search.search(index, table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items, size = F.sha2(F.array_join("items", ","), 256), F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", size.alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_licences": op1_licences,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_chat_format": op6_chat_format,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_repetition": op8_repetition,
    "op9_near_dedup": op9_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_search": op11_search,
    "op12_decontamination": op12_decontamination,
    "op13_clusters": op13_clusters,
}
RULES = repetition.RepetitionRules()
SQL = {
    "op3_warc": oracles.OP3,
    "op6_chat_format": oracles.OP6,
    "op8_repetition": oracles.op8(RULES.ngram_share, RULES.line_share, RULES.base_window, RULES.min_words, RULES.base_percent),
    "op9_near_dedup": oracles.op9(OP9_RULE.words, OP9_RULE.percent),
    "op10_exact_dedup": oracles.OP10,
    "op11_search": oracles.OP11,
    "op12_decontamination": oracles.OP12,
    "op13_clusters": oracles.op13(clusters.Clustering()),
}

