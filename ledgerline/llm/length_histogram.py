"""Exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.pieces import PieceCache, batches_by_size, spaced_pieces
from ledgerline.llm.storage import small_batches, written
from ledgerline.llm.workers import frugal, kept

#: Lengths of one block of the two-level sums.
BLOCK = 128


class TokenCounter:
    """Numbers of tokens of texts; each distinct piece is encoded once."""

    def __init__(self, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first = PieceCache(lambda pieces: [len(encode(p)) for p in pieces], sized=False)
        self.spaced = PieceCache(lambda pieces: [len(encode(" " + p)) for p in pieces], sized=False)

    def count(self, texts: list[str]) -> list[int]:
        pieces = [spaced_pieces(t) for t in texts]
        heads = self.first.values([p[:1] for p in pieces])
        return [sum(h) + sum(r) for h, r in zip(heads, self.spaced.values([p[1:] for p in pieces]))]


def _counter(ranks_file: str, pattern: str) -> TokenCounter:
    """One counter a worker."""
    return kept(("lengths", ranks_file, pattern), lambda: TokenCounter(ranks_file, pattern))


def _lengths(ranks_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks_file, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = []
            for a, b in batches_by_size(texts):
                out.extend(counter.count(texts[a:b]))
            yield pa.record_batch([batch.column("id"), pa.array(out, pa.int64())], names=["id", "length"])

    return frugal(run)


def encoded_lengths(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, length): each row's number of tokens; a null text is empty and has none."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_lengths(ranks_file, pattern), f"id {kind}, length long")


def length_histogram(lengths: DataFrame, length_col: str = "length") -> DataFrame:
    """(length, n_docs), one row a length; nulls are left out. Hot lengths are counted before the shuffle.

    It is written, as what it answers reads it more than once, and encoding is to happen once.
    """
    counts = lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))
    return written(counts, "lengths")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """What holds for a context limit of each length of the histogram.

    n_docs of that length; docs_over and tokens_over of longer ones; docs_upto and
    tokens_upto of the others; truncated_total, all tokens when longer documents are cut at the limit;
    lost_tokens by the cut; share_whole, the part of documents that fit, of which quantiles
    are read. Sums run in two levels: blocks of BLOCK lengths, then
    inside each block, so no task holds the whole histogram. An empty histogram has no rows.
    """
    rows = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("toks"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(after), zero).alias("docs_after"),
        F.coalesce(F.sum("toks").over(after), zero).alias("toks_after"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("toks").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(inside), zero)).alias("docs_over"),
        (F.col("toks_after") + F.coalesce(F.sum("tokens").over(inside), zero)).alias("tokens_over"),
        "all_docs",
        "all_tokens",
    )
    lost = F.col("tokens_over") - F.col("length") * F.col("docs_over")
    return out.select(
        "length",
        "n_docs",
        "docs_over",
        "tokens_over",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_upto"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_upto"),
        (F.col("all_tokens") - lost).alias("truncated_total"),
        lost.alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_whole"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, lost_tokens, truncated_total) for any limits, also between or beyond the lengths."""
    length, n = F.col("length"), F.col("n_docs")
    each = []
    for limit in limits:
        over = length > limit
        each += [
            F.coalesce(F.sum(F.when(over, n)), F.lit(0)).alias(f"d{limit}"),
            F.coalesce(F.sum(F.when(over, (length - limit) * n)), F.lit(0)).alias(f"l{limit}"),
        ]
    row = sums.agg(F.coalesce(F.sum(length * n), F.lit(0)).alias("all_tokens"), *each)
    answers = [
        F.struct(F.lit(int(x)).cast("long").alias("context_limit"), F.col(f"d{x}").alias("docs_over"), F.col(f"l{x}").alias("lost_tokens"), (F.col("all_tokens") - F.col(f"l{x}")).alias("truncated_total"))
        for x in limits
    ]
    return row.select(F.explode(F.array(*answers)).alias("x")).select("x.*")


def length_quantiles(sums: DataFrame, quantiles: list[float]) -> DataFrame:
    """(quantile, length): the smallest length that at least that part of documents don't pass."""
    picks = [F.min(F.when(F.col("share_whole") >= q, F.col("length"))).alias(f"q{i}") for i, q in enumerate(quantiles)]
    pairs = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(f"q{i}").alias("length")) for i, q in enumerate(quantiles)]))
    return sums.agg(*picks).select(pairs.alias("x")).select("x.*")
