"""Documents mixed from several sources to target shares of the total size in tokens.

Weighted fair queueing: the shuffled documents of a source, repeated as often as it may be, get a
virtual finish time, the source's running total of tokens divided by its weight; all documents are
ordered by it, in ranges, and cut off at the total budget.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.functions.scale import cut_lineage, salted_join, spread

#: Default place of the tokenizer's ranks; always a parameter, never copied into the library.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this tokenizer cuts text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that one task orders at a time; more rows make more ranges.
ROWS_PER_RANGE = 100_000


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of each document; whole texts are counted, null and empty ones have 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            batch["tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.pop("text")]
            yield batch

    return spread(documents.select(F.col("doc_id").cast("long"), "source", "text")).mapInPandas(count, "doc_id long, source string, tokens long")


def _ranges(rows: int) -> int:
    return max(16, -(-rows // ROWS_PER_RANGE))


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: str, out: str, limit: int | None = None) -> DataFrame:
    """Adds the running total of `value` in the order (bucket, order) within keys.

    The buckets' totals are summed first; each bucket then adds up its own rows from its offset, so
    no task orders more than one bucket of a key. `bucket` must not decrease along the order.
    Buckets that start beyond `limit` are left out before they are ordered.
    """
    placed = df.withColumn("_bucket", bucket)
    sums = placed.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    joined = placed.join(offsets, [*keys, "_bucket"])
    if limit is not None:
        joined = joined.filter(F.col("_before") <= limit)
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(within)).drop("_bucket", "_before")


def mix_sources(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selection, totals, targets): the mixed documents, the tokens at hand and the plan of each source.

    selection: doc_id, source, copy (1 to max_repeats), tokens, finish, position: the running total of
    tokens in the order of finish, at most the budget. Sources without a target, and documents
    without a source, are not selected; a document without tokens is never needed. targets: source,
    target_share, max_repeats; a null or negative share counts as 0, null repeats as 1; repeated
    rows count once, by the larger share. Without a budget it is the largest total at which no
    source that has documents must stay below its share, shares taken among those sources. A
    source that runs out before the budget leaves its place to the others.

    A repeated doc_id is a document of its own. Ties in the order go by source, document and copy.
    """
    plan = targets.filter("source is not null").groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    counted = cut_lineage(token_counts(documents, tokenizer))
    totals = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    present = plan.filter("target_share > 0 and max_repeats > 0").join(totals, "source").filter("tokens > 0")
    scale = present.agg(F.sum("target_share").alias("s"), F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share")).alias("most"), F.sum(F.col("docs") * F.col("max_repeats")).alias("rows")).first()
    total = (budget if budget is not None else int(scale["most"] * scale["s"])) if scale["s"] else 0
    ranges = _ranges(scale["rows"] or 0)

    weights = present.select("source", (F.col("target_share") / F.lit(scale["s"] or 1.0)).alias("weight"), "max_repeats")
    queue = salted_join(counted.filter("tokens > 0"), weights, ["source"], ["doc_id"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
    # each copy of a source is shuffled anew and follows the copy before it
    shuffled = queue.withColumn("_h", F.xxhash64("doc_id", "copy", F.lit(seed)))
    slot = F.col("copy") * ranges + F.floor((F.shiftrightunsigned("_h", 1) / F.lit(2.0**63)) * ranges)
    order = [F.shiftrightunsigned("_h", 1), F.col("doc_id"), F.col("tokens")]
    served = running_total(shuffled, ["source"], slot, order, "tokens", "_served").withColumn("finish", F.col("_served") / F.col("weight"))

    # no source that is never idle finishes beyond the budget; one that takes others' places does, and has a range for
    # each part of a doubling from there on, so the ranges stay few however far it goes
    part = F.col("finish") / F.lit(float(max(total, 1)))
    lane = F.when(part < 1, F.floor(part * ranges)).otherwise(F.floor((1 + F.log2(F.greatest(part, F.lit(1.0)))) * ranges))
    merged = running_total(served.withColumn("_all", F.lit(0)), ["_all"], lane, [F.col("finish"), F.col("source"), F.col("doc_id"), F.col("copy")], "tokens", "position", total)
    selection = merged.filter(F.col("position") <= total).select("doc_id", "source", "copy", "tokens", "finish", "position")
    return selection, totals, plan


def mixture_report(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """source, target_share, reached_share, tokens, docs, most_copies of each source with a target; 0 for sources without documents."""
    selection, _, plan = mix_sources(documents, targets, budget, seed, tokenizer)
    got = selection.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("docs"), F.max("copy").alias("most_copies"))
    zero = F.lit(0)
    rows = plan.join(got, "source", "left").select("source", "target_share", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("docs", zero).alias("docs"), F.coalesce("most_copies", zero).alias("most_copies"))
    every = Window.partitionBy(F.lit(1))  # one row for each target
    return rows.withColumn("reached_share", F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(every), F.lit(1)), 6))
