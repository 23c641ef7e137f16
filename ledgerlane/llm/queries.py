"""The operators as registered queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import align, ann, lines, mix, ngram, omh, pack, phrases, pii, quality, tokens, urls, warc
from ledgerlane.llm.common import shared_dir, staged, staged_path, table  # noqa: F401

#: The box's public vocabularies; parameters of every operator that needs one.
VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The rules of the URL filter.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.taken_words(mix.plan(table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staged_path(spark, "warc")
    warc.write_bundles(warc.with_revisits(table(spark, sf_dir, "pages")), folder)
    return warc.read_bundles(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.components(table(spark, sf_dir, "documents"), n=4, threshold=(85, 100))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.compare(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return tokens.token_digests(spark, path)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.removed_per_document(docs)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path(PIECES))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_pack, op3_warc, op4_jaccard, op5_nearest, op6_fingerprint,
                                   op7_urls, op8_tokens, op9_quality, op10_lines, op11_align,
                                   op12_pii, op13_phrases)}
ORACLE_SQL: dict[str, str] = {}
