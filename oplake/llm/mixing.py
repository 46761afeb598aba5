"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oplake.llm.common import scratch, word_count

#: Documents of one (source, length) are dealt over so many seeded buckets, so that no task ranks a hot length alone.
BUCKETS = 64


def water_fill(sizes: list[int], weights: list[float], total: float, max_repeat: int) -> list[float]:
    """Shares of ``total`` in proportion to ``weights``, none above ``max_repeat`` times its size;
    the excess goes by weight to those that still have room."""
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if weights[i] > 0]
    left = float(total)
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > max_repeat * sizes[i]]
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = float(max_repeat * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that the taken words come as near below
    ``budget`` as the lengths allow.

    Every length first gives its proportional share, so the mix keeps the source's length
    profile; a seeded round of single documents brings the rest below ``window`` words, and a
    bounded-knapsack dynamic programme over that rest (one bit per reachable sum) ends it.
    Needs memory in proportion to ``window`` plus the longest length, not to the budget.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or total <= 0:
        return taken
    if budget >= total:
        return counts.copy()
    for i in range(len(lengths)):  # exact integers: a float share could pass the budget
        taken[i] = int(counts[i]) * budget // total
    rest = budget - int((lengths * taken).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in order:
        if lengths[i] > 0 and taken[i] < counts[i] and rest - lengths[i] >= window:
            taken[i] += 1
            rest -= int(lengths[i])
    reach, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for i in order:
        room, length = int(counts[i] - taken[i]), int(lengths[i])
        if length == 0 or length > rest:
            continue
        room, part = min(room, rest // length), 1
        while room and not reach >> rest & 1:
            part = min(part, room)
            steps.append((i, part, reach))
            reach |= reach << (part * length) & mask
            room, part = room - part, part * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * int(lengths[i])
    return taken


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_repeat: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies (taken = copies * size).

    A document is taken ``k * size`` words for a whole k from 0 to ``max_repeat``.  Sources are
    ordered by code point with null last and weigh ``weights`` in turn.  Null text has size 0;
    a source whose documents are all empty has target 0; repeated rows count each; an empty
    table gives no rows; other columns are ignored; a text of any length counts whole, and one longer
    than its source's target is taken only as far as whole copies of it fit.  The list of sources (one total each) is
    planned on the driver; documents and lengths stay distributed.
    """
    if not weights or max_repeat < 1 or not 0 <= share <= max_repeat:
        raise ValueError("weights must not be empty, max_repeat at least 1, share within 0..max_repeat")
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("~"))
    sized = scratch(
        docs.select(F.col(id_col).alias("doc_id"), key.alias("skey"), word_count(F.col(text_col)).alias("size"))
        .withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed)))
        .withColumn("b", F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int")),
        "mix-sized",
    )
    cells = scratch(sized.groupBy("skey", "size", "b").agg(F.count("*").alias("n")), "mix-cells")
    sources = sorted((r.skey, int(r.total)) for r in cells.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect())
    names, totals = [s for s, _ in sources], [t for _, t in sources]
    # "s..." sorts before "~"; Python orders str by code point
    targets = water_fill(totals, [float(weights[i % len(weights)]) for i in range(len(names))], share * sum(totals), max_repeat)
    plan = []
    for i, (name, total, target) in enumerate(zip(names, totals, targets)):
        budget = min(int(math.floor(target + 0.5)), max_repeat * total)
        whole = min(max_repeat, budget // total) if total else 0
        plan.append((name, total, float(target), whole, budget - whole * total if total else 0, seed + i))
    plan_df = spark.createDataFrame(plan, "skey string, source_size long, target double, whole long, rest long, seed long")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", kind="stable").reset_index(drop=True)
        part["x"] = fit_budget(part["size"].to_numpy(), part["n"].to_numpy(), int(part["rest"].iloc[0]), int(part["seed"].iloc[0]))
        return part[["skey", "size", "source_size", "target", "whole", "x"]]

    lengths = cells.groupBy("skey", "size").agg(F.sum("n").alias("n")).join(plan_df, "skey")
    fitted = lengths.groupBy("skey").applyInPandas(fit, "skey string, size long, source_size long, target double, whole long, x long")
    before = Window.partitionBy("skey", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(fitted, ["skey", "size"])
        .select("skey", "size", "b", "source_size", "target", "whole", F.greatest(F.lit(0), F.least(F.col("n"), F.col("x") - F.col("before"))).alias("more"))
    )
    rank = F.row_number().over(Window.partitionBy("skey", "size", "b").orderBy("h", "doc_id"))
    return (
        sized.withColumn("rank", rank)
        .join(quota, ["skey", "size", "b"])
        .withColumn("copies", F.col("whole") + (F.col("rank") <= F.col("more")).cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, each as often as the mix takes it.

    Where ids repeat or are null, rows are first written with an id of their own.
    """
    spark, columns = docs.sparkSession, docs.columns
    unsure = docs.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("n")).where("n > 1 or __id is null").limit(1).count()
    if unsure:
        rows = scratch(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    else:
        rows = docs.withColumn("__row", F.col(id_col))
    taken = mix_sources(rows, id_col="__row", **options).where("copies > 0").select(F.col("doc_id").alias("__row"), F.col("copies").alias("__copies"))
    return rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)
