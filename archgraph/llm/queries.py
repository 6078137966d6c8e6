"""Registered queries of the operators, and the SQL that checks those that SQL can express."""

from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from archgraph.llm import statements
from archgraph.llm.curve_packing import pack_along_curve
from archgraph.llm.language_model import fit_language_model, language_scores
from archgraph.llm.licenses import license_places, license_summary
from archgraph.llm.line_dedup import remove_boilerplate
from archgraph.llm.max_sketches import best_documents
from archgraph.llm.mixing import mix_sources
from archgraph.llm.near_duplicates import near_duplicates
from archgraph.llm.nearest import nearest
from archgraph.llm.packing import pack, token_pieces
from archgraph.llm.quality import HELD_OUT, fit_quality, quality_scores, remainder
from archgraph.llm.spelling import spelling_variants
from archgraph.llm.token_files import read_token_files, write_token_files
from archgraph.llm.vector_duplicates import near_duplicate_vectors
from archgraph.session import materialize, new_folder


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs):
    pieces = token_pieces(docs, tokenizer_path("byte_bpe_50k.json"))
    digests = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(digests)


def op2_embedding_near_dedup(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_language_model_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = language_scores(docs, fit_language_model(docs))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return scored.select("doc_id", "n_words", "log_prob", mean.alias("mean_log_prob"))


def op4_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")


def op5_mix_sources(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_token_files(spark, sf_dir):
    folder = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op8_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))  # a null id has no remainder
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_license_scan(spark, sf_dir):
    return license_summary(license_places(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_max_sketch_search(spark, sf_dir):
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_curve_packing(spark, sf_dir):
    pieces = pack_along_curve(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_embedding_near_dedup, op3_language_model_scores, op4_line_dedup, op5_mix_sources, op6_token_files, op7_minhash_near_dedup, op8_nearest_neighbours, op9_quality_classifier, op10_license_scan,
    op11_spelling_variants, op12_max_sketch_search, op13_curve_packing,
)}


STATEMENTS = {"op5_mix_sources": statements.MIX, "op11_spelling_variants": statements.VARIANTS, "op12_max_sketch_search": statements.RANK}
