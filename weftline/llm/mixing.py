"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target of words. Whole passes over a source come first; the
rest of its budget is filled by documents counted by exact length: a proportional
share of each length, then the longest that fit, then a bounded-knapsack dynamic
program over the words still missing. Which documents of a length are taken
follows a seeded hash.

Sources: code point order, null last. A null text has length 0; documents of
length 0 are never taken. Texts are counted whole, however long. Rows alike in id,
source and text each count; they are ranked as one row with their number, so their
repeats never meet in a task. Ties of the hash are broken by id and text hash. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from weftline.llm.text import word_count
from weftline.sources.shared import written

MAX_TIMES = 3
#: Words left to the dynamic program where enough short documents remain.
EXACT = 1 << 15
#: Documents of one source and length that one task ranks, about.
RANKED = 1024


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, max_times: float = MAX_TIMES) -> list[float]:
    """Shares of total by weight; a share stops at max_times its size and the excess is shared anew."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > max_times * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(max_times * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length come closest to budget from below: reachable sums as bits, copies by binary splitting."""
    limit = (1 << (budget + 1)) - 1
    reach, items = 1, []
    for i in range(len(lengths)):
        left, step = min(counts[i], budget // lengths[i] if lengths[i] else 0), 1
        while left > 0:
            k = min(step, left)
            items.append((i, k, reach))
            reach |= (reach << (k * lengths[i])) & limit
            left, step = left - k, step * 2
        if reach >> budget & 1:
            break
    at, out = reach.bit_length() - 1, [0] * len(lengths)
    for i, k, before in reversed(items):
        if not before >> at & 1:
            at -= k * lengths[i]
            out[i] += k
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length, for about budget words in all."""
    order = np.argsort(-lengths, kind="stable")
    size, have = lengths[order].tolist(), counts[order].tolist()
    total = sum(s * h for s, h in zip(size, have, strict=True))
    take = [h * budget // total if total and s else 0 for s, h in zip(size, have, strict=True)]
    left = budget - sum(s * t for s, t in zip(size, take, strict=True))
    for i, s in enumerate(size):
        if s and left > EXACT:
            more = min(have[i] - take[i], (left - EXACT // 2) // s)
            take[i], left = take[i] + more, left - more * s
    if left > 0:
        rest = [i for i in range(len(size) - 1, -1, -1) if 0 < size[i] <= left and take[i] < have[i]]
        for i, more in zip(rest, knapsack([size[i] for i in rest], [have[i] - take[i] for i in rest], left), strict=True):
            take[i] += more
    out = np.zeros(len(lengths), np.int64)
    out[order] = take
    return out


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """pdf: a row for each length of one source."""
    pdf = pdf.assign(quota=fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0])))
    return pdf[["source", "size", "n", "source_size", "target", "passes", "quota"]]


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, key, source_size, target, copies) for every row of docs; key is a hash of the text.

    What the driver holds is one row a source. The lengths of a source (as many as
    its longest document has words, at most) meet in one task; documents never do.
    """
    spark = docs.sparkSession
    source = docs[source_col].cast("string")
    sized = docs.select(docs[id_col].alias("id"), source.alias("source"), word_count(docs[text_col]).alias("size"), F.xxhash64(docs[text_col]).alias("key"))
    sized = sized.groupBy("id", "source", "size", "key").agg(F.count(F.lit(1)).alias("rows"))
    sized = written(spark, sized, "sized").withColumn("h", F.xxhash64(F.lit(seed), "id", "key"))
    per_length = sized.groupBy("source", "size").agg(F.sum("rows").alias("n"))
    sums = sorted(((r[0], int(r[1])) for r in per_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([s for _, s in sums], [weights[i % len(weights)] for i in range(len(sums))], sum(s for _, s in sums))
    rows = []
    for (name, size), t in zip(sums, goal, strict=True):
        words = min(round(t), MAX_TIMES * size)
        passes = words // size if size else 0
        rows.append((name, size, t, passes, words - passes * size))
    schema = T.StructType([T.StructField("g", T.StringType()), *(T.StructField(k, t()) for k, t in (("source_size", T.LongType), ("target", T.DoubleType), ("passes", T.LongType), ("budget", T.LongType)))])
    plan = per_length.join(spark.createDataFrame(rows, schema), F.col("source").eqNullSafe(F.col("g")))
    quotas = plan.groupBy("source").applyInPandas(_fit_source, "source string, size long, n long, source_size long, target double, passes long, quota long")
    quotas = written(spark, quotas, "quotas").toDF("s", "l", "n", "source_size", "target", "passes", "quota")
    slots = F.greatest(F.lit(1), F.ceil(F.col("n") / RANKED)).cast("long")
    # Slots follow the order of the unsigned hash, so ranks within slots add up to ranks of the whole length.
    slot = F.floor((F.shiftrightunsigned("h", 32).cast("long") * slots) / F.lit(float(1 << 32))).cast("long")
    dealt = sized.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l"))).withColumn("slot", slot)
    many = dealt.where(F.col("n") > RANKED).groupBy("source", "size", "slot").agg(F.sum("rows").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("source", "size").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = many.select(F.col("source").alias("bs"), F.col("size").alias("bl"), F.col("slot").alias("bk"), before.alias("before"))
    ahead = W.partitionBy("source", "size", "slot").orderBy(F.shiftrightunsigned("h", 1), "h", "id", "key").rowsBetween(W.unboundedPreceding, -1)
    ranked = dealt.withColumn("ahead", F.coalesce(F.sum("rows").over(ahead), F.lit(0))).join(before, F.col("source").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bl")) & (F.col("slot") == F.col("bk")), "left")
    ranked = ranked.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    one_more = (F.coalesce("before", F.lit(0)) + F.col("ahead") + F.col("nth") <= F.col("quota")).cast("long")
    return ranked.select("id", "source", "size", "key", "source_size", "target", F.when(F.col("size") > 0, F.col("passes") + one_more).otherwise(F.lit(0)).cast("long").alias("copies"))


def op2_mix(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
