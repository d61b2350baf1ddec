"""The order of some suffixes of a byte string by two-stage sorting, and their adjacent common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last suffix is larger than the empty one."""
    n = len(text)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    place = np.where(step != 0, np.arange(n, dtype=np.int32), n)
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def _needed(wanted: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The wanted suffixes and those after them up to the next directly sorted one, from which they are induced."""
    n = len(wanted)
    place = np.where(smaller, np.arange(n, dtype=np.int32), n - 1)
    until = np.minimum.accumulate(place[::-1])[::-1]
    marks = np.bincount(np.flatnonzero(wanted), minlength=n + 1) - np.bincount(until[wanted] + 1, minlength=n + 1)
    return np.cumsum(marks[:n]) > 0


def _sorted_directly(data: bytes, text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the `depth` bytes from them on: buckets by two bytes, then each by comparison."""
    codes = text[at].astype(np.uint16) << np.uint16(8) | text[np.minimum(at + 1, len(text) - 1)]
    order = np.argsort(codes, kind="stable")
    at, codes = at[order], codes[order]
    edges = np.flatnonzero(np.diff(codes)) + 1
    out = []
    for bucket in np.split(at, edges):
        if len(bucket) > 1:
            bucket = np.array(sorted(bucket.tolist(), key=lambda i: data[i:i + depth]), at.dtype)
        out.append(bucket)
    return np.concatenate(out) if out else at


def suffix_order(data: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The positions `wanted` (a mask) in the order of their suffixes, exact in the first `depth` bytes.

    Suffixes smaller than their successors are sorted directly. All others follow from them: going through the buckets of
    first bytes in order, each suffix found puts its predecessor, if that is larger, at the end of
    the first part of the predecessor's bucket.
    """
    text = np.frombuffer(data, np.uint8)
    if not len(text):
        return np.empty(0, np.int64)
    smaller = suffix_types(text)
    needed = _needed(wanted, smaller)
    direct = _sorted_directly(data, text, np.flatnonzero(needed & smaller), depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[-1]:
        waiting[text[-1]].append(np.array([len(text) - 1]))
    out = []
    for byte in range(256):
        parts = waiting[byte]
        level = np.concatenate(parts) if parts else np.empty(0, np.int64)
        parts = [level]
        while len(level):  # runs of one byte: the predecessor falls in this same part
            level = level[level > 0] - 1
            level = level[(text[level] == byte) & needed[level]]
            parts.append(level)
        bucket = np.concatenate([*parts, direct[cuts[byte]:cuts[byte + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        larger = (first > byte) & needed[before]
        before, first = before[larger], first[larger]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        if len(before):
            for part in np.split(before, np.flatnonzero(np.diff(first)) + 1):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def common_prefixes(data: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each position in `order` with the next one, up to `depth`.

    Every position must have `depth` bytes from it on.
    """
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), depth)
    out = np.empty(max(len(order) - 1, 0), np.int64)
    for start in range(0, len(out), 4096):
        part = order[start:start + 4097]
        rows = windows[part]
        differ = rows[1:] != rows[:-1]
        out[start:start + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return out


def repeated_windows(data: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """A mask of the wanted positions whose next `depth` bytes also start at another wanted position."""
    order = suffix_order(data, wanted, depth)
    equal = common_prefixes(data, order, depth) >= depth
    out = np.zeros(len(wanted), bool)
    out[order[:-1][equal]] = True
    out[order[1:][equal]] = True
    return out
