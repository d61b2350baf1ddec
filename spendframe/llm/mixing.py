"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact size). A source's target is met by whole passes over it, and the
remaining budget by a choice of how many documents of each size to take once more: an even share of
every size first, then a bounded knapsack over what is left. Which documents of a size are taken
is decided by a seeded rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, rank_in, stored

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
SEED = 20
#: The knapsack works on budgets of at most this many words.
KNAPSACK_WORDS = 1 << 16


def words(text: str = "text") -> Column:
    """Number of words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Sources in code-point order, null last, take the weights in turn. A target is
    min(passes * size, weight * level); the level at which the targets add up to all sizes is what
    handing the excess round again and again converges to. One row per source is windowed in one
    task: sources are a catalogue with a weight each, not data.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    listed = sizes.withColumn("weight", weight).withColumn("cap", passes * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").isNull(), "source")
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # Sources that fill up come first; the level of the first one that does not holds for the rest.
    filled = listed.withColumn("level", level).withColumn("place", F.row_number().over(by_fill))
    still_open = F.col("cap") >= F.col("weight") * F.col("level")
    final = F.min(F.when(still_open, F.struct("place", "level"))).over(everything)["level"]
    return filled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * final).alias("target"))


def fitted(counts: np.ndarray, sizes: np.ndarray, budget: int, words_most: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each size to take so that the words come near `budget` from below.

    An even share of every size leaves less than one document of each; these are given out from the largest
    size down until the rest fits the knapsack, which takes the largest sum within the rest that all sizes left can reach. Its
    reachable sums are bits of one integer. The words miss the best possible sum by less than the largest size.
    """
    total = int((counts * sizes).sum())
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    rest = budget - int((taken * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= words_most:
            break
        more = min(int(counts[i] - taken[i]), (rest - words_most) // int(sizes[i]) + 1, rest // int(sizes[i]))
        taken[i] += more
        rest -= more * int(sizes[i])
    free = counts - taken
    usable = [i for i in np.argsort(-sizes, kind="stable") if free[i] and 0 < sizes[i] <= rest]
    if rest > words_most:  # no document left fits into the rest
        return taken
    # Each entry adds `k` documents of one size: powers of two make every number up to the count.
    mask, reach, trail = (1 << (rest + 1)) - 1, 1, []
    for i in usable:
        left, k = min(int(free[i]), rest // int(sizes[i])), 1
        while left:
            k = min(k, left)
            trail.append((i, k, reach))
            reach |= (reach << (k * int(sizes[i]))) & mask
            left, k = left - k, k * 2
            if reach >> rest:
                break
        if reach >> rest:
            break
    at = reach.bit_length() - 1
    for i, k, earlier in reversed(trail):
        if not (earlier >> at) & 1:
            at -= k * int(sizes[i])
            taken[i] += k
    return taken


def choose(histogram: DataFrame) -> DataFrame:
    """(source, size, passes, extra) from (source, size, n, source_size, target).

    One source's histogram has a row per distinct size, whatever the number of documents, and is fitted in
    one task; sources are fitted in parallel.
    """
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable")
        whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // whole) if whole else 0
        budget = int(round(target - passes * whole))
        extra = fitted(rows["n"].to_numpy(np.int64), rows["size"].to_numpy(np.int64), budget) if budget > 0 else 0
        return rows[["source", "size"]].assign(passes=passes, extra=extra)

    return histogram.groupBy("source").applyInPandas(fit, "source string, size long, passes long, extra long")


def mix(docs: DataFrame, size_of: Column, source: str = "source", doc_id: str = "doc_id", seed: int = SEED,
        name: str = "mix") -> DataFrame:
    """All of `docs` with a struct `name` of (size, source_size, target, times, taken); `size_of` gives a row's size.

    `times` is how often the mix takes the document (0 to 3), `taken` its words times that. A null or blank
    text has size 0 and is never taken; a null source is a source. Among documents of one source and size a
    seeded hash of the id decides; repeated rows are ranked one after another. Reruns agree. Texts are not
    shuffled for the counts. An empty table gives an empty one.
    """
    size, key = fresh(docs, "_size"), fresh(docs, "_source")
    sized = docs.withColumn(size, size_of).withColumn(key, F.col(source).cast("string"))
    counts = sized.groupBy(F.col(key).alias("source"), F.col(size).alias("size")).agg(F.count("*").alias("n"))
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    histogram = counts.alias("a").join(goals.alias("b"), same).select("a.*", "b.source_size", "b.target")
    chosen = choose(histogram.filter(F.col("size") > 0))
    plan = histogram.alias("a").join(chosen.alias("b"), same & F.col("a.size").eqNullSafe(F.col("b.size")), "left").select(
        "a.source", "a.size", "a.source_size", "a.target", F.coalesce("b.passes", F.lit(0)).alias("passes"),
        F.coalesce("b.extra", F.lit(0)).alias("extra"))
    place = fresh(docs, "_place")
    ranked = rank_in(sized, [key, size], [doc_id], seed, place)
    times = F.col("p.passes") + (F.col(f"d.{place}") < F.col("p.extra")).cast("long")
    joined = ranked.alias("d").join(plan.alias("p"), F.col(f"d.{key}").eqNullSafe(F.col("p.source")) & (F.col(f"d.{size}") == F.col("p.size")))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.struct(
        F.col("p.size"), F.col("p.source_size"), F.col("p.target"), times.alias("times"), (times * F.col("p.size")).alias("taken")).alias(name))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    name = fresh(docs, "mix")
    mixed = mix(docs, words(), name=name).filter(F.col(f"{name}.times") > 0)
    copy = fresh(mixed, "_copy")
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{name}.times")))).select(*docs.columns)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken). Texts become sizes at the scan."""
    slim = stored(docs.select("doc_id", "source", words().alias("words")), "sizes")
    return mix(slim, F.col("words")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")
