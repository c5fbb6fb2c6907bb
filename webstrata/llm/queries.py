"""Registered queries of this package: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from webstrata.llm.config_packing import pack_few
from webstrata.llm.exact_dedup import exact_dedup
from webstrata.llm.hamming_search import nearest
from webstrata.llm.jaccard_join import jaccard_components
from webstrata.llm.language_id import identify
from webstrata.llm.line_dedup import dedup_lines
from webstrata.llm.packing import pack
from webstrata.llm.pieces import round_trip
from webstrata.llm.prefix_trie import prefix_trie
from webstrata.llm.revisits import archive_of, resolve
from webstrata.llm.token_counts import token_counts
from webstrata.llm.token_files import token_files
from webstrata.llm.whitening import whiten
from webstrata.session import shared_folder

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_exact_dedup(spark, sf):
    return exact_dedup(table(spark, sf, "documents"))


@query
def op2_token_files(spark, sf):
    folder = shared_folder(spark, "token-files")
    return token_files(table(spark, sf, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op3_packing(spark, sf):
    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query
def op4_line_dedup(spark, sf):
    kept = dedup_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_token_counts(spark, sf):
    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_ngram_jaccard_join(spark, sf):
    return jaccard_components(table(spark, sf, "documents"), width=4, percent=85)


@query
def op7_multi_index_hashing(spark, sf):
    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op8_warc_revisits(spark, sf):
    found = resolve(archive_of(table(spark, sf, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("record_id", "canonical_url", "full_id", "verdict", "matched_by", F.array_join(pairs, ";").alias("headers"))


@query
def op9_language_id(spark, sf):
    return identify(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_sentencepiece(spark, sf):
    return round_trip(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_prefix_trie(spark, sf):
    return prefix_trie(table(spark, sf, "conversations"))


@query
def op12_config_packing(spark, sf):
    return pack_few(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op13_whitening(spark, sf):
    return whiten(table(spark, sf, "embeddings"))


@query
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
