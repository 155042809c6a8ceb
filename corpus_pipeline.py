"""From raw documents to token ids: five stages, each by one operator of ledgerline.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.bpe_lexicon import encode
from ledgerline.llm.decontaminate import add_contamination
from ledgerline.llm.jaccard_join import drop_near_copies
from ledgerline.llm.line_spread import remove_boilerplate
from ledgerline.llm.storage import discard, written
from ledgerline.llm.toxicity import add_scores, learned

#: Documents of this toxicity and more go.
TOXIC = 0.7
#: Near duplicates: words of a shingle and percent of similarity.
SHINGLE, SIMILAR = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the network finds toxic; it learns from the labelled ones of these documents.

    A null or empty text scores as a quiet one and stays; rows without a label are scored alike, rows may repeat, and without
    labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    network = learned(docs.select("doc_id", "text"), labels)
    score = next(name for name in map("score{}".format, range(len(docs.columns) + 1)) if name not in docs.columns)
    return add_scores(docs, network, to=score).where(F.col(score) < TOXIC).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines out; a document of which nothing is left by that goes.

    n_chars, where there is such a column, follows the text. Documents that were empty before stay, null texts too. A row's other columns
    pass through, whatever their names.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    out = remove_boilerplate(rows)
    text, changed = F.col("text"), F.col("n_removed") > 0
    emptied = changed & ~text.rlike(r"[^\x09-\x0D ]")
    new = {"text": text} | ({"n_chars": F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return out.where(~emptied).select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: of rows, the one of the smallest id, then of the smallest hash of its text.

    Of rows that repeat both id and text one stays. An id with several texts doesn't tie their groups together. Rows without an id, a text or words stay.
    """
    return drop_near_copies(docs, k=SHINGLE, percent=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages; null and empty texts hold none, and repeated rows share their fate."""
    found = add_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document that is left; a null or empty text has no ids, and rows may repeat."""
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_text=False).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: The network's scores can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's rows written before the next reads them."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            discard(last)
        last = docs
    return docs
