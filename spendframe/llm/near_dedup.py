"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set of word shingles is thrown into the bins of a sketch round after round, until every bin is filled: a bin
keeps the smallest value of the first round that reached it, and after as many rounds as bins each
further round fills one bin for certain. Two sets agree in a bin with the probability of their similarity, with
bounds as for independent bins. Documents that agree in a whole band meet in a bucket. In a bucket, the members
most often met elsewhere serve as pivots: all others are compared with them on full sets. In buckets
that still hold more than one component, the members outside the largest are compared with all others, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import annotate, encoded, flat, fresh, grams, mixed, rows_hashed, stored
from .components import components

SHINGLE, PERCENT = 5, 85
#: Bins of a sketch, and the probability with which a pair at the threshold may be missed.
BINS, MISSED = 127, 1e-6
#: Pivots of a bucket, and members of a bucket in one block.
PIVOTS, BLOCK = 2, 512

_SEEDS = mixed(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EMPTY = np.uint64(2**64 - 1)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct k-word shingles as sorted 64-bit hashes; fewer words are one shingle, no words none."""
    words = encoded(text).lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(grams(hashes, min(k, len(words)))) if words else hashes


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set, with at most 127 bins.

    A value holds its round above its hash, so an earlier round always wins.
    """
    out = np.full(bins, _EMPTY)
    step = max(1, 2048 // len(elements))
    for start in range(0, bins, step):
        rounds = np.arange(start, min(bins, start + step), dtype=np.uint64)
        hashed = mixed(elements[None, :] ^ _SEEDS[rounds.astype(np.int64), None])
        at = ((hashed & np.uint64(0xFFFFFFFF)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(out, at.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(56)) | (hashed >> np.uint64(8))).ravel())
        if (out != _EMPTY).all():
            return out
    for bin_ in np.flatnonzero(out == _EMPTY):
        value = mixed(elements ^ _SEEDS[bins + bin_]).min() >> np.uint64(8)
        out[bin_] = np.uint64(bins + bin_) << np.uint64(56) | value
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, bins of a band): the longest bands with which a pair at the threshold is missed less often than MISSED.

    25 bands of 5 for 85 percent, 31 of 4 for 80. Under 11 percent no banding of so many bins suffices; single bins come nearest.
    """
    rows = max((r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (BINS // r) < MISSED), default=1)
    return BINS // rows, rows


def set_key(elements: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; null for the empty set."""
    return xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None


def _signature(percent: int):
    bands, rows = banding(percent)
    tags = np.arange(bands, dtype=np.uint64)[:, None]

    def compute(texts):
        for text in texts:
            found = shingles(text)
            if not len(found):
                yield 0, None, []
                continue
            keys = rows_hashed(np.hstack([sketch(found, bands * rows).reshape(bands, rows), tags]))
            yield len(found), set_key(found), keys.view(np.int64).tolist()

    return compute


def _keys(texts):
    for text in texts:
        found = shingles(text)
        yield len(found), set_key(found)


def _sets(texts):
    for text in texts:
        found = shingles(text)
        yield found.tobytes(), set_key(found)


def _similar(percent: int):
    def compare(left, right):
        for a, b in zip(left, right):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            yield (100 * common >= percent * (len(a) + len(b) - common),)

    return compare


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("left")), "a")
    full = left.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("right")), "b")
    return annotate(full, ["left", "right"], _similar(percent), "similar boolean", "is").filter("is.similar").select("a", "b")


def _spread(percent: int):
    """Links between components in a pair of blocks: no more than it takes to join what belongs together."""
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "set_key"], kind="stable").reset_index(drop=True)
        sets = [np.frombuffer(e, np.uint64) for e in rows["elements"]]
        sizes, block = np.array([len(s) for s in sets]), rows["block"].to_numpy()
        _, root = np.unique(rows["component"].to_numpy(), return_inverse=True)
        tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(at, kind="stable")
        holders, starts = owner[order], np.searchsorted(at[order], np.arange(len(tokens) + 1))
        ends = np.cumsum(sizes)
        largest = np.argmax(np.bincount(root))
        found = []
        for i in np.flatnonzero(root != largest):
            common = np.bincount(np.concatenate([holders[starts[t]:starts[t + 1]] for t in at[ends[i] - sizes[i]:ends[i]]]), minlength=len(sets))
            near = (100 * common >= percent * (sizes[i] + sizes - common)) & (rows["i"].iat[0] == rows["j"].iat[0] or block != block[i])
            for j in np.flatnonzero(near):
                if root[i] != root[j]:
                    found.append((i, j))
                    root[root == root[j]] = root[i]
        pick = rows[["doc_id", "set_key"]]
        left, right = (pick.iloc[[f[side] for f in found]].reset_index(drop=True) for side in (0, 1))
        return pd.concat([left.add_prefix("a_"), right.add_prefix("b_")], axis=1)

    return compare


def links(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components (id, component) of the documents that meet in buckets.

    `members` has (key, id, n): a bucket, a document in it, its set's size. First all members of a bucket are compared with its
    pivots: a row per member and pivot. What then is still in different components is compared in blocks: the
    members of a bucket are dealt over blocks by hash, each pair of blocks is one group of bounded size,
    and only links between components come out of it. So every pair in a bucket is linked, connected or compared.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("m"))
    weights = members.join(sizes, "key").groupBy("id").agg(F.sum("m").alias("weight"))
    members = stored(members.join(weights, "id"), "members")
    ranked = members.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "id")))
    pivots = ranked.filter(F.col("place") <= PIVOTS)
    near = (F.col("x.id") != F.col("p.id")) & (100 * F.least("x.n", "p.n") >= percent * F.greatest("x.n", "p.n"))
    pairs = members.alias("x").join(pivots.alias("p"), (F.col("x.key") == F.col("p.key")) & near).select(
        F.least("x.id", "p.id").alias("a"), F.greatest("x.id", "p.id").alias("b")).distinct()
    edges = stored(verified(stored(pairs, "pairs"), sets, percent), "links")
    labels = components(edges)
    state = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # Buckets with the same members ask the same question: one of them stays.
    open_ = state.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"),
                                     F.bit_xor(F.xxhash64("id")).alias("who")).filter(
        (F.col("lo") != F.col("hi")) & (F.col("m") > PIVOTS + 1)).groupBy("who", "m").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = state.join(open_.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.xxhash64("component").alias("component"))
    paired = paired.join(sets, "id").select("key", "i", "j", "block", "component", "id.*", "elements")
    more = paired.groupBy("key", "i", "j").applyInPandas(_spread(percent), "a_doc_id long, a_set_key binary, b_doc_id long, b_set_key binary")
    more = stored(more.select(F.struct(F.col("a_doc_id").alias("doc_id"), F.col("a_set_key").alias("set_key")).alias("a"),
                              F.struct(F.col("b_doc_id").alias("doc_id"), F.col("b_set_key").alias("set_key")).alias("b")), "links")
    return components(edges.union(more)) if more.take(1) else labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, set_key, component_id, kept) for every row of `docs`.

    Equal sets are one class before anything is compared. Null, blank and empty texts have an empty set, no link and
    themselves as component; rows with a null id are not linked either and count as kept. Repeated rows
    fall in one component. Rows of one id with different texts are separate members that share the id. An empty
    table gives an empty result.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = stored(flat(annotate(slim, ["text"], _signature(percent), "n bigint, set_key binary, bands array<bigint>", "s"), "s", "doc_id"), "signed")
    classes = signed.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # A class is known by its smallest id and its set, so that one id with two texts is two nodes.
    classes = stored(classes.withColumn("id", F.struct("doc_id", "set_key")), "classes")
    dealt = classes.select("id", "n", F.explode("bands").alias("key"))
    buckets = dealt.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > 1).select("key")
    members = stored(dealt.join(buckets, "key"), "buckets")
    met = members.select("id.*").distinct()
    whole = slim.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = flat(annotate(whole, ["text"], _sets, "elements binary, set_key binary", "s"), "s", "doc_id").join(
        met, ["doc_id", "set_key"]).groupBy(F.struct("doc_id", "set_key").alias("id")).agg(F.first("elements").alias("elements"))
    labels = links(members, stored(sets, "sets"), percent)
    joined = classes.join(labels, "id", "left")
    component = F.coalesce("component", "id")
    found = joined.select("set_key", component["doc_id"].alias("component_id"), "rows", "doc_id").filter(
        (F.col("rows") > 1) | (F.col("component_id") != F.col("doc_id"))).select("set_key", "component_id")
    out = signed.join(found, "set_key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "set_key",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay, one of each component, with the columns they came with.

    Repeated rows of the document that stays are dropped too. Empty texts and null ids all stay.
    """
    mark, n, key = fresh(docs, "_set"), fresh(docs, "_n"), fresh(docs, "_key")
    kept = near_duplicates(docs, text, doc_id, percent).filter(F.col("kept") & (F.col("n_shingles") > 0)).select(
        F.col("doc_id").alias(doc_id), F.col("set_key").alias(key)).distinct()
    marked = annotate(docs, [text], _keys, "n bigint, set_key binary", mark).withColumn(n, F.col(f"{mark}.n")).withColumn(
        key, F.col(f"{mark}.set_key")).drop(mark)
    alone = (F.col(n) == 0) | F.col(doc_id).isNull()
    linked = marked.filter(~alone).join(kept, [doc_id, key], "left_semi").dropDuplicates([doc_id, key])
    return linked.select(*docs.columns).union(marked.filter(alone).select(*docs.columns))
