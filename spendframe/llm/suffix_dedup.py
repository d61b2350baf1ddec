"""Removal of long strings that occur more than once in a corpus, by suffix arrays.

A suffix array of the whole corpus would be several times its size, so the corpus is first cut to what can hold a repeat.
The smallest k-gram hash of every 400-byte window is its mark: equal windows have equal marks, so a
mark found at one place only rules its windows out. Runs of windows with one repeated mark, cut out as
segments, meet by mark. Equal segments are counted before they are shuffled. Blocks of segments get a suffix array by
two-stage sorting, and windows whose adjacent common prefix covers them are repeated. A mark with more
segments than a block holds is dealt over several blocks, whose windows are then counted by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import annotate, encoded, flat, mixed, sliding, stored
from .suffix_array import repeated_windows

LENGTH, GRAM = 400, 128
#: Windows of a text hashed at a time, and most windows in a segment.
PIECE, SEGMENT = 1 << 19, 4096
#: Bytes of segments in a block; a mark with more than MARK_BYTES of segments is dealt over several.
BLOCK_BYTES, MARK_BYTES = 1 << 20, 3 << 20
#: Segments whose bytes a task remembers having sent; others are sent again.
REMEMBERED = 100_000

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        held = _POWERS[base] = np.cumprod(factors)
    return held[:n]


def window_hashes(data: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """A hash of every k bytes: differences of prefix sums, brought to one scale by the inverse of the base."""
    n = len(data)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(base, n), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * _powers(pow(base, -1, 1 << 64), n - k + 1))


def pieces(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text that overlap so that every window lies in one of them."""
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(whole) - length + 1, PIECE):
        yield start, whole[start:start + PIECE + length - 1]


def marks(data: bytes, length: int, gram: int) -> np.ndarray:
    """The marks of a text's windows, twice if at two places or more."""
    found = [np.empty(0, np.uint64)]
    span = length - gram + 1
    edge = np.zeros(span - 1, np.uint64)
    for _, piece in pieces(data, length):
        hashes = window_hashes(piece, gram)
        lowest = sliding(hashes, span, np.minimum)
        found.append(hashes[sliding(np.concatenate([edge, lowest, edge]), span, np.maximum) == hashes])
    values, counts = np.unique(np.concatenate(found), return_counts=True)
    return np.repeat(values, np.minimum(counts, 2))


def segments(data: bytes, chosen: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(mark, first window, windows) of every run of windows with one of the chosen marks."""
    for start, piece in pieces(data, length):
        lowest = sliding(window_hashes(piece, gram), length - gram + 1, np.minimum)
        edges = np.flatnonzero(lowest[1:] != lowest[:-1]) + 1
        firsts = np.concatenate([[0], edges])
        sizes = np.diff(np.concatenate([firsts, [len(lowest)]]))
        kept = np.isin(lowest[firsts], chosen)
        for first, size in zip(firsts[kept].tolist(), sizes[kept].tolist()):
            for at in range(first, first + size, SEGMENT):
                yield int(lowest[first].view(np.int64)), start + at, min(SEGMENT, first + size - at)


def _sign(length: int, gram: int):
    def compute(texts):
        for text in texts:
            data = encoded(text)
            yield (len(data), xxhash.xxh3_128_digest(data), hashlib.sha256(data).hexdigest(),
                   marks(data, length, gram).view(np.int64).tolist() if len(data) >= length else [])

    return compute


def _digest(texts):
    for text in texts:
        yield (xxhash.xxh3_128_digest(encoded(text)),)


def _cut(pool: DataFrame, length: int, gram: int, bodies: bool) -> DataFrame:
    """The segments of the pooled texts: (mark, segment, windows) with `body`, or with the text and place they are from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for digest, text, chosen in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                data, rows = encoded(text), []
                for mark, at, size in segments(data, np.array(chosen, np.int64).view(np.uint64), length, gram):
                    body = data[at:at + size + length - 1]
                    key = xxhash.xxh3_128_digest(body)
                    if bodies:
                        rows.append((mark, key, size, None if key in sent else body))
                        if len(sent) < REMEMBERED:
                            sent.add(key)
                    else:
                        rows.append((mark, key, size, digest, at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary()] + ([] if bodies else [pa.int64()])
    names = ["mark", "segment", "windows", "body" if bodies else "digest"] + ([] if bodies else ["at"])
    schema = "mark long, segment binary, windows int, " + ("body binary" if bodies else "digest binary, at long")
    return pool.select("digest", "text", "chosen").mapInArrow(run, schema)


def _spans(mask: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return edges[::2].tolist(), edges[1::2].tolist()


_FOUND = "mark long, segment binary, first array<int>, last array<int>, loose_at array<int>, loose array<binary>"


def _scan(length: int):
    """Suffix arrays over blocks of whole marks: the repeated windows of each segment.

    For a mark that is dealt over several blocks, also a hash for each distinct window of the block: with its place in the
    segment where the block has it once, with place -1 where it is repeated already.
    """
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
    names = ["mark", "segment", "first", "last", "loose_at", "loose"]

    def block(rows: list[dict]) -> pa.RecordBatch:
        data = b"".join(r["body"] for r in rows)
        starts = np.cumsum([0, *[len(r["body"]) for r in rows]])
        wanted = np.zeros(len(data), bool)
        for r, start in zip(rows, starts):
            wanted[start:start + r["windows"]] = True
        lone = len(rows) == 1 and rows[0]["whole"] and not rows[0]["dealt"]
        mask = wanted if lone else repeated_windows(data, wanted, length)
        out, text = [], np.frombuffer(data, np.uint8)
        for r, start in zip(rows, starts.tolist()):
            here = mask[start:start + r["windows"]]
            if r["whole"]:
                here = np.ones(r["windows"], bool)
            loose_at, loose = [], []
            if r["dealt"]:
                body = text[start:start + len(r["body"])]
                keys = np.stack([window_hashes(body, length), window_hashes(body, length, _BASE ^ 0x5555555555555554)], axis=1)
                settled = set()
                for i, key in enumerate(keys):
                    key = key.tobytes()
                    if not here[i] or key not in settled:
                        loose_at.append(-1 if here[i] else i)
                        loose.append(key)
                        if here[i]:
                            settled.add(key)
            if here.any() or loose:
                out.append((r["mark"], r["segment"], *_spans(here), loose_at, loose))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                key = row["mark"], row["block"]
                if rows and key != last and size >= BLOCK_BYTES:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row["body"]), key
        if rows:
            yield block(rows)

    return run


def _remaining(length: int):
    def compute(texts, found):
        for text, hits in zip(texts, found):
            data = encoded(text)
            edges = np.zeros(len(data) + 1, np.int64)
            for hit in hits:
                for first, last in zip(hit["first"], hit["last"]):
                    edges[hit["at"] + first] += 1
                    edges[hit["at"] + last - 1 + length] -= 1
            covered = np.cumsum(edges[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
            yield int(covered.sum()), len(_spans(covered)[0]), hashlib.sha256(kept).hexdigest(), kept

    return compute


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
            with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and `kept_text` bytes on request, for every row of `docs`.

    A byte is removed if a string of `length` bytes over it also starts anywhere else in the table, the same text included.
    Strings never cross texts and are judged on the input. Null and empty texts have no bytes; texts shorter
    than `length` lose none; a text that occurs in two rows (repeated rows too) and is long enough
    loses all. Null and repeated ids are kept as they are. `kept_text` is null where nothing was removed.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = stored(flat(annotate(slim, ["text"], _sign(length, gram), "n_bytes bigint, digest binary, sha string, marks array<bigint>", "s"),
                         "s", "doc_id"), "signed")
    classes = signed.filter(F.col("n_bytes") >= length).groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("marks").alias("marks"))
    classes = stored(classes, "classes")
    dealt = classes.select("digest", F.explode("marks").alias("mark"))
    twice = dealt.groupBy("mark").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("mark")
    chosen = dealt.join(twice, "mark").groupBy("digest").agg(F.collect_set("mark").alias("chosen"))
    wanted = classes.select("digest", "doc_id", "copies").join(chosen, "digest").alias("c")
    # One row for each text goes on, found by its smallest id, so copies never meet in one task.
    held = flat(annotate(slim, ["text"], _digest, "digest binary", "d"), "d", "doc_id", "text").alias("h")
    pool = held.join(wanted, (F.col("h.digest") == F.col("c.digest")) & F.col("h.doc_id").eqNullSafe(F.col("c.doc_id"))).select(
        "h.digest", "h.text", "c.chosen", "c.copies", "h.doc_id").dropDuplicates(["digest", "doc_id"])
    pool = stored(pool.drop("doc_id"), "pool")
    distinct = stored(_cut(pool, length, gram, True).groupBy("mark", "segment").agg(
        F.count("*").alias("n"), F.first("windows").alias("windows"), F.first("body", ignorenulls=True).alias("body")), "segments")
    found = _found(distinct, length)
    places = _cut(pool.filter(F.col("copies") == 1), length, gram, False)
    hits = places.join(found, ["mark", "segment"]).groupBy("digest").agg(F.collect_list(F.struct("at", "first", "last")).alias("hits"))
    partly = annotate(pool.filter(F.col("copies") == 1).select("digest", "text").join(hits, "digest"), ["text", "hits"],
                      _remaining(length), "n_removed bigint, n_spans bigint, kept string, kept_text binary", "r")
    partly = flat(partly, "r", "digest")
    wholly = classes.filter(F.col("copies") > 1).select("digest", F.lit(True).alias("all"))
    out = signed.drop("marks").join(partly if with_text else partly.drop("kept_text"), "digest", "left").join(wholly, "digest", "left")
    gone = F.col("all").isNotNull()
    columns = [F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
               F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
               F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256")]
    if with_text:
        columns.append(F.when(gone, F.lit(b"")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select("doc_id", "n_bytes", *columns)


def _found(distinct: DataFrame, length: int) -> DataFrame:
    """(mark, segment, first, last): the spans of repeated windows in the distinct segments."""
    sizes = distinct.groupBy("mark").agg(F.sum(F.octet_length("body")).alias("size"), F.count("*").alias("rows"))
    many = stored(sizes.filter((F.col("size") > MARK_BYTES) & (F.col("rows") > 1)).select(
        "mark", F.ceil(F.col("size") / MARK_BYTES).alias("blocks")), "many")
    rows = distinct.select("mark", "segment", "windows", "body", (F.col("n") > 1).alias("whole")).join(many, "mark", "left")
    rows = rows.withColumn("dealt", F.col("blocks").isNotNull()).withColumn(
        "block", F.pmod(F.xxhash64("segment"), F.coalesce("blocks", F.lit(1)))).drop("blocks")
    scanned = rows.repartition("mark", "block").sortWithinPartitions("mark", "block").mapInArrow(_scan(length), _FOUND)
    if not many.take(1):
        return scanned.select("mark", "segment", "first", "last")
    scanned = stored(scanned, "scanned")
    loose = scanned.filter(F.size("loose") > 0).select("mark", "segment", F.explode(F.arrays_zip("loose_at", "loose")).alias("w")).select(
        "mark", "segment", "w.loose_at", "w.loose")
    again = loose.groupBy("mark", "loose").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("mark", "loose")
    more = loose.filter(F.col("loose_at") >= 0).join(again, ["mark", "loose"]).groupBy("mark", "segment").agg(
        F.collect_list("loose_at").alias("first"))
    more = more.withColumn("last", F.transform("first", lambda i: i + 1))
    return scanned.filter(F.size("first") > 0).select("mark", "segment", "first", "last").union(more)
