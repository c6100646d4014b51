"""Exact length histogram of encoded documents; suffix sums answer every context limit.

Documents are aggregated by encoded length before anything else is done, so what is sorted and summed is as long as the
longest document at most, whatever the number of documents. The suffix sums run in blocks of lengths: sums of whole
blocks first, then sums inside each block, so no window holds the histogram in one task.

Null and empty texts have length 0 and are counted; texts of any length are encoded whole. Repeated rows count each.
Special tokens' strings in a text are ordinary text. An empty table has an empty histogram. Only the text is read, so other
columns of any name don't matter."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 512


@functools.cache
def _lengths(tokenizer: str) -> tokens.Cached:
    """Lengths of pieces; made once in a worker, whatever its tasks."""
    import tiktoken

    encode = tiktoken.Encoding("ranks", pat_str=tokens.pattern(), mergeable_ranks=tokens.read_ranks(tokenizer), special_tokens={}).encode_ordinary
    return tokens.Cached(lambda piece: len(encode(piece)))


def with_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row (n_tokens) per document: the length of its whole text in tokens of the rank file at tokenizer."""

    def count(batches):
        lengths = _lengths(tokenizer)
        tokens.alone(lengths)
        for batch in batches:
            found = [sum(map(lengths.__getitem__, tokens.pieces(x or ""))) for x in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(found, pa.int64())], ["n_tokens"])

    return common.bounded(docs.select(text)).mapInArrow(count, "n_tokens long")


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Rows per length (n_tokens, n_docs)."""
    return lengths.groupBy(F.col(length).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: n_docs and tokens of that length, docs_ge and tokens_ge
    of at least that length, truncated_tokens if every document were cut at that length, and fraction_le, the part of
    documents no longer."""
    hist = common.keep(hist, "histogram").withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    down = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = down(Window.orderBy(F.desc("block")))
    blocks = blocks.select("block", (F.sum("bd").over(after) - F.col("bd")).alias("docs_after"), (F.sum("bt").over(after) - F.col("bt")).alias("tokens_after"))
    inside = down(Window.partitionBy("block").orderBy(F.desc("n_tokens")))
    total = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    out = hist.join(blocks, "block").withColumn("docs_ge", F.sum("n_docs").over(inside) + F.col("docs_after")).withColumn("tokens_ge", F.sum("tokens").over(inside) + F.col("tokens_after"))
    out = out.crossJoin(F.broadcast(total))  # one row of two numbers
    return out.select(
        "n_tokens", "n_docs", "tokens", "docs_ge", "tokens_ge",
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("fraction_le"),
    )


class TokenCounts:
    """Answers from the suffix sums, each from a filter and one row."""

    def __init__(self, sums: DataFrame):
        self.sums = sums

    def total(self) -> int:
        return self.truncated_total(None)

    def truncated_total(self, limit: int | None) -> int:
        """Tokens left if every document is cut at limit."""
        if limit is None:
            return self.sums.agg(F.sum("tokens")).first()[0] or 0
        above = F.col("n_tokens") > limit
        row = self.sums.agg(F.sum(F.when(~above, F.col("tokens"))), F.sum(F.when(above, F.col("n_docs")))).first()
        return (row[0] or 0) + limit * (row[1] or 0)

    def quantile(self, q: float) -> int | None:
        """The least length that at least the part q of the documents doesn't exceed; None without documents."""
        return self.sums.where(F.col("fraction_le") >= q).agg(F.min("n_tokens")).first()[0]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    return suffix_sums(histogram(with_lengths(docs, tokenizer, text)))
