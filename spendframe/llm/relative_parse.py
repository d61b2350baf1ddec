"""Removal of word sequences that stand in an earlier document, by relative Lempel-Ziv parsing.

Every document is factored against the documents before it (those with smaller ids), which go into reference blocks. A window of 50
words can only be found in blocks that hold its mark, the smallest hash of its 25-word runs, so the texts are cut to segments: runs of
windows with one mark that several documents have. Equal segments are one row with the smallest id. A block of segments is indexed
by a suffix array over its words; with the common prefixes of neighbours, that tells for every word the longest match in an earlier
document. The greedy parse takes the longest factor there is; a factor of a window or more is a duplicate span, and the
windows that begin before its end and reach over it are looked up at that boundary.
A mark with more segments than a block holds is cut finer, by the hash of the whole window, where equal windows are one row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import annotate, dropped, encoded, flat, mixed, sliding, stored, written

WINDOW, GRAM = 50, 25
#: Most windows in a segment, bytes of segments in a block, and bytes of one mark's segments beyond which it is cut finer.
SEGMENT, BLOCK_BYTES, MARK_BYTES = 4096, 1 << 20, 3 << 20
#: Segments whose words a task remembers having sent; others are sent again.
REMEMBERED = 100_000
#: Bytes of text split at a time, and bytes of a word beyond which a segment holds its length and 128-bit hash in its place.
PIECE, LONG_WORD = 1 << 20, 1024

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LAST = 2**63 - 1


def joined(text: str | None) -> bytes:
    """The words of a text with one space between."""
    data, at, out = encoded(text), 0, []
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.end() if cut else len(data)
        words = data[at:end].split()
        if words:
            out.append(b" ".join(words))
        at = end
    return b" ".join(out)


class Words:
    """A text as its words: where they start in `data`, and their hashes."""

    def __init__(self, data: bytes):
        self.data = data
        self.starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1, [len(data) + 1]]) if data else np.zeros(1, np.int64)
        self.n = len(self.starts) - 1

    def hashes(self) -> np.ndarray:
        out, at = np.empty(self.n, np.uint64), 0
        for first in range(0, self.n, 1 << 16):
            words = self.part(first, min(self.n, first + (1 << 16))).split(b" ")
            out[at:at + len(words)] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            at += len(words)
        return out

    def part(self, first: int, last: int) -> bytes:
        return self.data[self.starts[first]:self.starts[last] - 1]

    def body(self, first: int, last: int) -> bytes:
        """The words from first to last, long ones by their length and hash."""
        if np.diff(self.starts[first:last + 1]).max() <= LONG_WORD:
            return self.part(first, last)
        return b" ".join(w if len(w) <= LONG_WORD else b"%d:%s" % (len(w), xxhash.xxh3_128_hexdigest(w).encode())
                         for w in self.part(first, last).split(b" "))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k hashes, from hashes of runs of 2, 4, 8 and so on."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    out, width = hashes, 1
    while width * 2 <= k:
        out = mixed(out[:-width] * _LEFT + out[width:] * _RIGHT)
        width *= 2
    n = len(hashes) - k + 1
    return out if width == k else mixed(out[:n] * _LEFT + out[k - width:k - width + n] * _RIGHT)


def window_marks(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The mark of every window."""
    return sliding(runs(hashes, gram), window - gram + 1, np.minimum) if len(hashes) >= window else np.empty(0, np.uint64)


def _signed(window: int, gram: int):
    def compute(texts):
        for text in texts:
            words = Words(joined(text))
            marks = np.unique(window_marks(words.hashes(), window, gram)) if words.n >= window else np.empty(0, np.uint64)
            yield words.n, xxhash.xxh3_128_digest(words.data), hashlib.sha256(words.data).hexdigest(), marks.view(np.int64).tolist()

    return compute


def _fine(window: int, gram: int):
    """(digest, key) of every distinct window whose mark is among the chosen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text, chosen in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                hashes = Words(joined(text)).hashes()
                kept = np.isin(window_marks(hashes, window, gram), np.array(chosen, np.int64).view(np.uint64))
                keys = np.unique(runs(hashes, window)[kept]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(keys), pa.binary()), pa.array(keys)], ["digest", "mark"])

    return run


_PIECES = "digest binary, low long, mark long, segment binary, at array<long>, windows array<int>, body binary"


def _cut(window: int, gram: int):
    """The segments of each text with a chosen mark, and all places where they stand; a task sends the words of a segment once.

    A segment is one row however often a text repeats it. If a mark is the hash of a whole window, the windows of a run are
    equal and the first one stands for all.
    """
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    names = [f.split()[0] for f in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for digest, low, text, chosen in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                words, rows = Words(joined(text)), {}
                if xxhash.xxh3_128_digest(words.data) != digest:  # another text under the same id
                    continue
                marks = window_marks(words.hashes(), window, gram)
                firsts = np.concatenate([[0], np.flatnonzero(marks[1:] != marks[:-1]) + 1])
                sizes = np.diff(np.concatenate([firsts, [len(marks)]]))
                kept = np.isin(marks[firsts], np.array(chosen, np.int64).view(np.uint64))
                for first, size in zip(firsts[kept].tolist(), sizes[kept].tolist()):
                    mark = int(marks[first].view(np.int64))
                    for at in range(first, first + size, SEGMENT):
                        n = min(SEGMENT, first + size - at)
                        body = words.body(at, at + (1 if gram == window else n) + window - 1)
                        key = xxhash.xxh3_128_digest(body)
                        row = rows.get((mark, key))
                        if row:
                            row[4].append(at)
                            row[5].append(n)
                            continue
                        rows[mark, key] = digest, low, mark, key, [at], [n], None if key in sent else body
                        if len(sent) < REMEMBERED:
                            sent.add(key)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows.values()), kinds)], names)

    return run


class Reference:
    """A block of segments, indexed by a suffix array over their words."""

    def __init__(self, bodies: list[bytes], lows: list[int], window: int):
        ids: dict[bytes, int] = {}
        parts, self.window = [], window
        for i, body in enumerate(bodies):
            words = body.split(b" ")
            parts.append(np.array([*[ids.setdefault(w, len(ids)) for w in words], -1 - i], np.int64))
        sizes = np.array([len(p) for p in parts])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.lows = np.repeat(np.array(lows, np.int64), sizes)
        levels, longest = self._levels(np.concatenate(parts)), int(sizes.max())
        order = np.empty(len(self.lows), np.int64)
        order[levels[-1]] = np.arange(len(order))
        shared = self._shared(order, levels)
        self.reach = self._reach(order, shared)
        self.longest = longest

    @staticmethod
    def _levels(text: np.ndarray) -> list[np.ndarray]:
        """Ranks of the runs of 1, 2, 4, ... words from each place, until all differ. Every segment ends in a word of its own."""
        n, width = len(text), 1
        levels = [np.unique(text, return_inverse=True)[1]]
        while levels[-1].max() < n - 1:
            following = np.zeros(n, np.int64)
            following[:-width] = levels[-1][width:] + 1
            levels.append(np.unique(levels[-1] * (n + 1) + following, return_inverse=True)[1])
            width *= 2
        return levels

    @staticmethod
    def _shared(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each suffix in the order has in common with the next one."""
        left, right = order[:-1].copy(), order[1:].copy()
        for level in range(len(levels) - 2, -1, -1):
            # The last level tells all suffixes apart; equal runs end before a segment's own last word.
            same = levels[level][left] == levels[level][right]
            left[same] += 1 << level
            right[same] += 1 << level
        return left - order[:-1]

    def _reach(self, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Of each place with a match of a window or more in an earlier document, the length of the longest; else 0.

        Among the suffixes that share a window, the longest match is with the nearest one before or after in the order
        that is of a smaller id.
        """
        out = np.zeros(len(order), np.int64)
        linked = np.concatenate([[False], shared >= self.window, [False]])
        places = np.flatnonzero(linked[1:] | linked[:-1])
        if not len(places):
            return out
        lows, at = self.lows[order[places]].tolist(), order[places]
        near = shared[np.minimum(places, len(shared) - 1)]
        near = np.where(linked[places + 1], near, 0).tolist()  # with the next one of these places; 0 between groups
        best = np.maximum(_nearest_smaller(lows, near), _nearest_smaller(lows[::-1], [*near[-2::-1], 0])[::-1])
        out[at] = np.where(best >= self.window, best, 0)
        return out

    def parse(self, segment: int) -> list[tuple[int, int]]:
        """Runs of windows (first, end) that the long factors of a segment cover."""
        start, end = int(self.starts[segment]), int(self.starts[segment + 1]) - 1
        reach = self.reach[start:end]
        hits = np.flatnonzero(reach).tolist()
        out: list[tuple[int, int]] = []
        k = 0
        while k < len(hits):
            first = hits[k]
            after = first + int(reach[first]) - self.window + 1  # windows from here on reach over the factor's end
            if out and out[-1][1] >= first:
                out[-1] = out[-1][0], max(after, out[-1][1])
            else:
                out.append((first, after))
            k = bisect_left(hits, after, k + 1)
        return out


def _nearest_smaller(lows: list[int], near: list[int]) -> np.ndarray:
    """For each place, what it shares with the nearest place before it that has a smaller value; near[i]: i with i + 1."""
    out, held, shares = [0] * len(lows), [], []
    for i, low in enumerate(lows):
        common = near[i - 1] if i else 0
        while held and held[-1] >= low:
            held.pop()
            common = min(common, shares.pop())
        out[i] = common if held else 0
        held.append(low)
        shares.append(out[i])
    return np.array(out, np.int64)


def _parse(window: int):
    """(mark, segment, low, first, last) for the segments of whole marks, block by block."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def block(rows: list[dict]) -> pa.RecordBatch:
        out = []
        reference = Reference([r["body"] for r in rows], [r["low"] for r in rows], window) if len(rows) > 1 else None
        for i, r in enumerate(rows):
            spans = reference.parse(i) if reference else []
            if spans or r["n"] > 1:
                out.append((r["mark"], r["segment"], r["low"], [a for a, _ in spans], [b for _, b in spans]))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)],
                                          ["mark", "segment", "low", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["mark"] != rows[-1]["mark"] and size >= BLOCK_BYTES:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row["body"])
        if rows:
            yield block(rows)

    return run


def _remaining(window: int):
    def compute(texts, found):
        for text, hits in zip(texts, found):
            words = Words(joined(text))
            edges = np.zeros(words.n + 1, np.int64)
            for hit in hits:
                places = np.array(hit["at"])
                spans = [(0, np.array(hit["windows"]))] if hit["whole"] else zip(hit["first"], hit["last"])
                for first, last in spans:
                    np.add.at(edges, places + first, 1)
                    np.add.at(edges, places + last - 1 + window, -1)
            covered = np.cumsum(edges[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]])))
            kept = b" ".join(words.part(a, b) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()))
            yield int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept

    return compute


def _chosen(dealt: DataFrame) -> DataFrame:
    """(digest, chosen): the marks (digest, mark) that more than one text has."""
    several = dealt.groupBy("mark").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("mark")
    return dealt.join(several, "mark").groupBy("digest").agg(F.collect_set("mark").alias("chosen"))


def _distinct(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("mark", "segment").agg(F.min("low").alias("low"), F.count("*").alias("n"), F.first("body", ignorenulls=True).alias("body"))


def _found(distinct: DataFrame, window: int) -> DataFrame:
    rows = distinct.repartition("mark").sortWithinPartitions("mark", "low", "segment")
    return rows.mapInArrow(_parse(window), "mark long, segment binary, low long, first array<int>, last array<int>")


def _hits(pieces: DataFrame, found: DataFrame) -> DataFrame:
    """(digest, at, windows, whole, first, last): a text after the earliest with its segment loses all of it, the earliest what the
    parse found, at each place."""
    both = pieces.select("digest", F.col("low").alias("own"), "mark", "segment", "at", "windows").join(found, ["mark", "segment"])
    whole = F.col("own") > F.col("low")
    return both.select("digest", "at", "windows", whole.alias("whole"), "first", "last").filter(F.col("whole") | (F.size("first") > 0))


def earlier(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM,
            with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and `kept_text` bytes on request, for every row of `docs`.

    A word is removed if `window` consecutive words over it also start in a row with a smaller id; they are judged on the
    input and never cross texts. Null and empty texts have no words; texts shorter than `window` lose none. Ids are compared as
    longs; null ids come after all others, and rows with equal ids (or both null) lose nothing to each other. `kept_text` is the
    kept words with one space between, null where nothing was removed.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), order.alias("low"), F.xxhash64(text).alias("print"))
    signed = stored(flat(annotate(slim, ["text"], _signed(window, gram), "n_words bigint, digest binary, sha string, marks array<bigint>", "s"),
                         "s", "doc_id", "low", "print"), "signed")
    long = signed.filter(F.col("n_words") >= window)
    classes = stored(long.groupBy("digest").agg(F.min(F.struct("low", "print")).alias("at"), F.count("*").alias("copies"),
                                                F.first("marks").alias("marks")).select("digest", "at.low", "at.print", "copies", "marks"), "classes")
    chosen = _chosen(classes.select("digest", F.explode("marks").alias("mark")))
    wanted = classes.select("digest", "low", "print").join(chosen, "digest")
    # One row for each text goes on, found by its smallest id and a hash of it.
    pool = stored(slim.select("low", "print", "text").join(wanted, ["low", "print"]).dropDuplicates(["low", "print", "digest"])
                  .select("digest", "low", "text", "chosen"), "pool")
    pieces = stored(pool.mapInArrow(_cut(window, gram), _PIECES), "pieces")
    distinct, path = written(_distinct(pieces), "distinct")
    sizes = distinct.groupBy("mark").agg(F.sum(F.octet_length("body")).alias("size"), F.count("*").alias("rows"))
    large = stored(sizes.filter((F.col("size") > MARK_BYTES) & (F.col("rows") > 1)).select("mark"), "large")
    plain = distinct.join(large, "mark", "left_anti")
    hits = _hits(pieces.drop("body"), stored(_found(plain, window), "found"))
    dropped(docs.sparkSession, path)
    if large.take(1):
        own = pool.select("digest", F.explode("chosen").alias("mark")).join(large, "mark").groupBy("digest").agg(F.collect_set("mark").alias("large"))
        wide = pool.select("digest", "low", "text").join(own, "digest")
        fine = _chosen(stored(wide.select("digest", "text", "large").mapInArrow(_fine(window, gram), "digest binary, mark long"), "fine"))
        again = pool.select("digest", "low", "text").join(fine, "digest").select("digest", "low", "text", "chosen")
        exact = stored(again.mapInArrow(_cut(window, window), _PIECES), "exact")
        # The first window stands for its run, so what the parse found holds for the run.
        late = _hits(exact.drop("body"), stored(_found(_distinct(exact), window), "found"))
        hits = hits.unionByName(late.withColumn("whole", F.lit(True)))
    found = hits.groupBy("digest").agg(F.collect_list(F.struct("at", "windows", "whole", "first", "last")).alias("hits"))
    partly = flat(annotate(pool.select("digest", "text").join(found, "digest"), ["text", "hits"], _remaining(window),
                           "n_removed bigint, kept string, kept_text binary", "r"), "r", "digest")
    firsts = classes.filter(F.col("copies") > 1).select("digest", F.col("low").alias("first_low"))
    out = signed.drop("marks", "print").join(partly if with_text else partly.drop("kept_text"), "digest", "left").join(firsts, "digest", "left")
    gone = F.col("low") > F.col("first_low")
    columns = [F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
               F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256")]
    if with_text:
        columns.append(F.when(gone, F.lit(b"")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select("doc_id", "n_words", *columns)
