"""Benchmark decontamination by winnowing.

The smallest k-gram hash of every sliding window is a text's fingerprint, so a document and an item that share a span
of `window` words share a fingerprint in it. Fingerprint hits are extended to whole shared windows, word by word.
The benchmark goes to the workers in blocks of bounded size; each block meets all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import annotate, encoded, flat, fresh, grams, rows_hashed, stored, winnow

WINDOW, GRAM = 10, 5
#: Words of benchmark text in one block: about 50 bytes each in a worker.
BLOCK_WORDS = 500_000
#: Keys over which the documents with one set of windows are dealt.
SALTS = 16

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words of a text."""
    found = _WORD.findall(encoded(text).lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


class Block:
    """Windows of some benchmark items, found through their fingerprints."""

    def __init__(self, windows: list[bytes], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        words = [np.frombuffer(w, np.uint64) for w in windows]
        self.lengths = sorted({len(w) for w in words if len(w) < window})
        #: By window length: the gram hashes in order, and the windows they belong to.
        self.tables = {}
        for length in {len(w) for w in words}:
            own = [i for i, w in enumerate(words) if len(w) == length]
            keys = np.array([grams(words[i], length)[0] for i in own], np.uint64)
            order = np.argsort(keys, kind="stable")
            self.tables[length] = keys[order], np.array(own)[order], np.stack([words[i] for i in own])[order]
        long = self.tables.get(window)
        self.prints = np.unique(np.concatenate([
            g[winnow(g, window - gram + 1)] for g in (grams(w, gram) for w in long[2])])) if long else np.empty(0, np.uint64)

    def matches(self, hashes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts at which a window of that length occurs, and the window; words are compared one by one."""
        keys, owners, words = self.tables[length]
        starts = starts[(starts >= 0) & (starts + length <= len(hashes))]
        if not len(starts):
            return starts, starts
        runs = np.lib.stride_tricks.sliding_window_view(hashes, length)[starts]
        sums = rows_hashed(runs)
        at = np.minimum(np.searchsorted(keys, sums), len(keys) - 1)
        same = (keys[at] == sums) & (words[at] == runs).all(axis=1)
        return starts[same], owners[at[same]]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit positions, distinct windows) of a document."""
        spans, found = [], []
        if len(self.prints) and len(hashes) >= self.window:
            own = grams(hashes, self.gram)
            reach = self.window - self.gram + 1
            chosen = winnow(own, reach)
            at = np.minimum(np.searchsorted(self.prints, own[chosen]), len(self.prints) - 1)
            chosen = chosen[self.prints[at] == own[chosen]]
            starts = np.unique(chosen[:, None] - np.arange(reach))
            starts, windows = self.matches(hashes, starts, self.window)
            spans.append((starts, self.window))
            found.append(windows)
        for length in self.lengths:  # items shorter than a window: no winnowing, every run is looked up
            own = grams(hashes, length)
            keys = self.tables[length][0]
            if len(own):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                starts, windows = self.matches(hashes, np.flatnonzero(keys[at] == own), length)
                spans.append((starts, length))
                found.append(windows)
        marks = np.zeros(len(hashes) + 1, np.int64)
        for starts, length in spans:
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + length, -1)
        hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        return hit, np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def item_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(words, items): every distinct window of the benchmark as its word hashes, and who has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = word_hashes(body)
                if len(hashes):
                    length = min(window, len(hashes))
                    runs = [hashes[i:i + length].tobytes() for i in range(len(hashes) - length + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(runs, pa.binary()), pa.array([item] * len(runs), pa.string())], ["words", "item"])

    pairs = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return pairs.mapInArrow(run, "words binary, item string")


def listed_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(window, words, item), stored: a 128-bit key, the word hashes and one item of each pair of a window and an item."""
    pairs = item_windows(benchmark, text, item_id, window)
    return stored(pairs.select(F.unhex(F.md5("words")).alias("window"), "words", "item").distinct(), "windows")


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS, name: str = "hits",
         benchmark_text: str = "text", item_id: str = "item_id", listed: DataFrame | None = None) -> DataFrame:
    """All of `docs` with a struct `name`: n_words, n_hit and the sorted keys of the windows that occur.

    A null or wordless text has no words and no hits. An empty benchmark hits nothing. Only windows and their keys are broadcast,
    block by block, never the items that have them, however many share a window. With several blocks each one reads
    the texts and leaves a row for every text with a hit; texts are not written, and copies share a row.
    """
    spark = docs.sparkSession
    listed = listed_windows(benchmark, benchmark_text, item_id) if listed is None else listed
    windows = listed.select("window", "words").distinct().withColumn("block", F.xxhash64("words"))
    blocks = max(1, -(-windows.count() * WINDOW // block_words))

    def held(b: int):
        # A block is bounded by block_words; the driver and a worker hold one block at a time.
        rows = sorted(windows.filter(F.pmod("block", F.lit(blocks)) == b).select("words", "window").collect())
        return spark.sparkContext.broadcast(([bytes(r.words) for r in rows], [bytes(r.window) for r in rows]))

    fields, part = "n_words bigint, hits array<int>, windows array<binary>, digest binary", fresh(docs, "_part")
    if blocks == 1:
        out = annotate(docs, [text], _lookup(held(0)), fields, part)
        return out.withColumn(name, F.struct(F.col(part).n_words.alias("n_words"), F.size(F.col(part).hits).cast("long").alias("n_hit"),
                                             F.array_sort(F.col(part).windows).alias("windows"))).drop(part)
    found = None
    for b in range(blocks):
        block = held(b)
        rows = flat(annotate(docs.select(F.col(text).alias("text")), ["text"], _lookup(block), fields, "s"), "s").filter(F.size("hits") > 0)
        rows = stored(rows.groupBy("digest").agg(F.first("hits").alias("hits"), F.first("windows").alias("windows")), "hits")
        block.unpersist()
        found = rows if found is None else found.union(rows)
    found = found.groupBy("digest").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
        F.array_sort(F.flatten(F.collect_list("windows"))).alias("windows")).alias("f")
    sized = annotate(docs, [text], _sizes, "n_words bigint, digest binary", part).alias("d")
    joined = sized.join(found, F.col(f"d.{part}.digest") == F.col("f.digest"), "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.struct(
        F.col(f"d.{part}.n_words").alias("n_words"), F.coalesce("f.n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("f.windows", F.array().cast("array<binary>")).alias("windows")).alias(name))


def _sizes(texts):
    for body in texts:
        yield len(word_hashes(body)), xxhash.xxh3_128_digest(encoded(body))


def _lookup(held):
    made: dict[str, Block] = {}

    def compute(texts):
        words, keys = held.value
        if not made:
            made["it"] = Block(words)
        for body in texts:
            hashes = word_hashes(body)
            hit, found = made["it"].find(hashes)
            yield len(hashes), hit.tolist(), [keys[w] for w in found.tolist()], xxhash.xxh3_128_digest(encoded(body))

    return compute


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with the columns they came with."""
    name = fresh(docs, "hits")
    return hits(docs, benchmark, name=name).filter(F.col(f"{name}.n_hit") == 0).drop(name)


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    Null item ids have no name and are left out of the items, though their windows count as hits; repeated items count once.
    Windows meet their items once for each distinct set of windows that documents have, so a window that many items share costs
    its items once, not once in every document. A set that many documents have is dealt over SALTS keys, and documents without any
    are spread by their ids, so no task takes all of either.
    """
    listed = listed_windows(benchmark)
    found = flat(hits(docs.select("doc_id", "text"), benchmark, listed=listed), "hits", "doc_id")
    same = F.sha2(F.array_join(F.transform("windows", F.hex), ","), 256)
    found = stored(found.withColumn("same", F.when(F.size("windows") > 0, same)), "found")
    sets = found.filter(F.col("same").isNotNull()).groupBy("same").agg(F.first("windows").alias("windows"))
    items = sets.select("same", F.explode("windows").alias("window")).join(listed.select("window", "item").filter("item is not null"), "window").groupBy(
        "same").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        "same", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    items = items.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    spread = F.xxhash64("doc_id", "n_words")
    salted = found.withColumn("salt", F.when(F.col("same").isNull(), spread).otherwise(F.pmod(spread, F.lit(SALTS))))
    return salted.join(items, ["same", "salt"], "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(b""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
