"""The corpus pipeline: documents through five of the numbered operators. Each stage is written as Parquet and read again by the next.

The first four return the columns of documents. The quality classifier and the quality rules drop what they reject, each row by its own text;
near-dedup keeps one row of each group; mixing gives each document its place in the schedule and drops none; encoding lays the documents'
tokens out in that order and returns where each begins. A row with a null doc_id counts as a document of its own in every stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm import byte_bpe, hyperminhash, pfair_mix, quality_gam, robust_rules
from codeatlas.llm.queries import vocabulary_file
from codeatlas.llm.shared import parts, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of good quality."""
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return robust_rules.keep_regular(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies: texts that share four fifths of their runs of five words, and chains of them."""
    return hyperminhash.keep_one(docs, threshold=80, shingle=5, bands=(32, 4))


#: A document's place in the schedule: ascending and unique, with gaps. The upper bits number ranges of places, of which there are as many as partitions.
PLACE, RANGE_BITS = "schedule_place", 33


def placing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a schedule that gives each source its target weight, with their PLACE in it."""
    mixed = pfair_mix.mix(docs, pfair_mix.tempered(docs), carry=tuple(docs.columns))
    order = F.col("slot").asc_nulls_last(), "start", "doc_id"
    laid = mixed.repartitionByRange(parts(docs), *order).sortWithinPartitions(*order)
    return laid.select("carried.*", F.monotonically_increasing_id().alias(PLACE))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """placing_stage with the columns of docs alone."""
    return placing_stage(spark, docs, sf_dir).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the decoded bytes of each document; of documents with a PLACE also start, the tokens of all documents placed before."""
    import public_tokenizers

    placed = PLACE in docs.columns
    texts = docs.select(F.col(PLACE).alias("doc_id"), "text") if placed else docs
    done = byte_bpe.encode_decode(texts, vocabulary_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    done = done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return started(docs.select(PLACE, "doc_id"), written(done.withColumnRenamed("doc_id", PLACE), "encoded")) if placed else done


def started(docs: DataFrame, done: DataFrame) -> DataFrame:
    """done (PLACE, n_tokens, ...) with the doc_id of docs (PLACE, doc_id) and with start, summed within ranges of places and over all ranges before."""
    before = "rows between unbounded preceding and 1 preceding"
    done = done.withColumn("of", F.shiftright(PLACE, RANGE_BITS))
    ranges = done.groupBy("of").agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.select("of", F.expr(f"coalesce(sum(n) over (order by of {before}), 0L)").alias("first"))  # one row a partition
    start = F.col("first") + F.expr(f"coalesce(sum(n_tokens) over (partition by of order by {PLACE} {before}), 0L)")
    return done.join(docs, PLACE).join(F.broadcast(ranges), "of").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", start.alias("start"))


STAGES = [("quality classifier", quality_stage), ("quality rules", rules_stage), ("MinHash near-dedup", dedup_stage), ("mixing to target weights", placing_stage), ("byte-level BPE", encoding_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k + 1}")
    return docs


#: No SQL twin: a learned classifier, iterated estimates and tokenizers are beyond SQL. Tests compare each stage, on its own input, with brute force.
ORACLE_SQL = None
