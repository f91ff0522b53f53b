"""From documents to tokens: language ID, quality, near-duplicates, benchmark decontamination, encoding.

Every stage takes all that the one before it kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import drop, written
from scorelake.llm.decontam import decontaminate
from scorelake.llm.gam import fit_quality, quality_score
from scorelake.llm.langid import fit_languages, language
from scorelake.llm.pieces import encode_documents
from scorelake.llm.queries import PIECES, table
from scorelake.llm.simhash import deduplicated


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty ones too), those of no language that is likelier than the others together, and those
    that no learned language explains: whose mean log-probability a character lies far below those that the model has learnt from."""
    model = fit_languages(docs, PIECES, with_floors=True)
    found = language(model, F.col("text"))
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= 0.5) & (found["above"] >= 0))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which label 0 is likelier."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_score(model, F.col("text")) >= 0.5)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles of a Jaccard similarity of 0.8 or more one row stays, that of the smallest id (null ids last).
    Groups are of texts: an id with two texts can be in two of them; rows alike in id and text are copies too."""
    return deduplicated(docs, words=5, radius=2, similarity=0.8).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document with any window of a benchmark item, or a whole item of fewer words than a window, goes whole: what is left around a cut
    could still give the item away. Rows are judged one by one, those of null or equal ids too."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.0)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source, and of the text its ids, their number, source spans and the decoded text's digest."""
    out = encode_documents(docs, PIECES, keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "spans", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]
#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again as the next one's input; a stage's table is deleted once the next
    one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
            if before is not None:
                drop(before)
            before = docs
    return docs
