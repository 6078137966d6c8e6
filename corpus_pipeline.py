"""A corpus from raw documents to packed sequences: five stages over whole tables.

Quality classifier (rejected documents go), removal of boilerplate lines,
MinHash near-duplicates (one document of each group stays), mixing of sources
to target weights, best-fit packing. Every stage is written as Parquet to the
shared folder and read again by the next, so a lost executor or a failed stage
costs that stage only.

All stages but the last return the columns of ``documents``, whatever further
columns those have. ``n_chars`` follows the text where lines were taken out.
Documents that consist of boilerplate only are dropped with it; empty documents
are scored, kept or rejected like others. Mixing repeats a document's row, or
leaves it out, as the targets ask for.
"""

from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from archgraph.llm.line_dedup import remove_boilerplate
from archgraph.llm.mixing import mix_sources, take_copies
from archgraph.llm.near_duplicates import without_near_duplicates
from archgraph.llm.order import whole_row
from archgraph.llm.packing import pack, token_pieces
from archgraph.llm.quality import fit_quality, quality_scores
from archgraph.session import materialize

SIMILARITY_PERCENT = 80
SHINGLE_WORDS = 5


def good_quality(spark, docs, sf_dir):
    fitted = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rest = docs.drop("text")
    rows = docs.select(whole_row(rest).alias("row"), "text")
    good = quality_scores(rows, fitted, keep=["row", "text"]).where("predicted = 1")
    return good.select(*[F.col("text") if n == "text" else F.col("row").getField(n).alias(n) for n in docs.columns])


def without_boilerplate(spark, docs, sf_dir):
    own = ("n_lines", "n_removed")
    clean = remove_boilerplate(docs.withColumnsRenamed({name: f"input {name}" for name in docs.columns if name in own}))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    clean = clean.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(f"`input {n}`").alias(n) if n in own else F.col(f"`{n}`") for n in docs.columns])


def one_of_each(spark, docs, sf_dir):
    return without_near_duplicates(docs, shingle_words=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def mixed(spark, docs, sf_dir):
    rows = docs.select(whole_row(docs).alias("row"), "doc_id", "source", "text")
    return take_copies(mix_sources(rows, keep=["row"]), ["row.*"])


def packed(spark, docs, sf_dir):
    pieces = token_pieces(docs, tokenizer_path("byte_bpe_50k.json"))
    return pack(materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("minhash near-dedup", one_of_each),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL cannot express the classifier, the near-duplicate links or the packing.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
