"""Sharding by vector bin packing over bytes, tokens and rows at once.

Equal texts form a group and stay together unless the group is larger than a share of a shard. Small groups are
summed into a fixed number of cells by their hash, large ones are cells of their own, so the packing sees
a bounded list however large the table is. Cells are placed from the largest down, each where
the dot product of its demand with the shard's residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, rank_in, stored
from .mixing import words

SHARDS = 40
#: Hash cells for each shard; a group of over 1/PIECES of a shard is a cell of its own, and one of over
#: 1/SPLIT of a shard is dealt into pieces of about 1/PIECES.
CELLS, PIECES, SPLIT = 128, 32, 2
OVERHEAD, SEED = 16, 70
#: Weight of the bytes, tokens and rows in the dot product: sizes are what must come out near equal.
WEIGHTS = (1.0, 0.2, 0.2)


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of the text (a null has none) plus a fixed overhead."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + OVERHEAD


def pack(demands: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of `demands` (cells x dimensions), largest first.

    Demands and capacities are shares of the totals. Ties go to the lowest shard. A shard whose bytes would pass an
    even share is left out while another has room for the cell.
    """
    total = np.maximum(demands.sum(axis=0), 1)
    need = demands / total
    weights = np.array(WEIGHTS)[: demands.shape[1]]
    residual = np.full((shards, demands.shape[1]), 1.0 / shards)
    placed = np.zeros(len(need), dtype=np.int64)
    for i in np.lexsort((np.arange(len(need)), -need.sum(axis=1), -need[:, 0])):
        score = residual @ (weights * need[i])
        fits = residual[:, 0] >= need[i, 0]
        best = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(residual[:, 0]))
        placed[i] = best
        residual[best] -= need[i]
    return placed


def shard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, name: str = "placed",
          seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`.

    Sizes come out near equal over the shards (law `bytes`), tokens and rows as far as they allow. A null text
    counts as empty: size 16, checksum 0, one group with the empty texts. Rows of a group too large for a
    shard are dealt over several by a hash of their id; repeated rows are separate rows.
    Slots run from 0 without gaps in each shard. An empty table gives an empty result.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"), size_of(text).alias("size"), words(text).alias("tokens"),
        F.crc32(full.cast("binary")).alias("text_crc32"), F.xxhash64(full).alias("h1"), F.xxhash64(F.lit(seed), full).alias("h2")), "sizes")
    same = [F.col("r.h1") == F.col("g.h1"), F.col("r.h2") == F.col("g.h2")]
    # Only groups of two rows or more, or of large texts, can be large; all others go by hash alone.
    even = rows.agg(F.sum("size").alias("total")).select((F.col("total") / (shards * PIECES)).alias("piece")).scalar()
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    large = (groups.withColumn("piece", even).filter(F.col("bytes") > F.col("piece"))
             .withColumn("pieces", F.when((F.col("bytes") > F.col("piece") * (PIECES / SPLIT)) & (F.col("n") > 1),
                                          F.least(F.ceil(F.col("bytes") / F.col("piece")), F.col("n"))).otherwise(1))
             .select("h1", "h2", "pieces"))
    # Their number is at most shards x PIECES, so they can be sent to every task.
    dealt = rows.alias("r").join(F.broadcast(large).alias("g"), same[0] & same[1], "left").select(
        "r.*", F.when(F.col("g.pieces").isNull(), F.concat(F.lit("c"), F.pmod("r.h1", F.lit(shards * CELLS)).cast("string")))
        .otherwise(F.concat_ws(":", F.lit("g"), "r.h1", "r.h2", F.pmod(F.xxhash64("r.doc_id", F.lit(seed)), F.coalesce("g.pieces", F.lit(1)))))
        .alias("cell"))
    cells = dealt.groupBy("cell").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cell", kind="stable")
        return pd.DataFrame({"cell": frame["cell"], "shard": pack(frame[["bytes", "tokens", "n"]].to_numpy(np.float64), shards)})

    # At most shards x (CELLS + PIECES + pieces of split groups) rows, whatever the table's size: one task.
    plan = stored(cells.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(place, "cell string, shard int"), "cells")
    placed = dealt.join(F.broadcast(plan), "cell").drop("cell", "h1", "h2", "tokens")
    ranked = rank_in(placed, ["shard"], ["doc_id", "size", "text_crc32"], seed, "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
