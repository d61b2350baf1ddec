"""Quality rules with risk-controlled thresholds.

Fixed base rules reject first. Further rules reject a document whose value is above a cutoff. The cutoffs come from labelled
good documents, by fixed-sequence testing in every stratum: an order of steps, set before any label is seen, adds the most lenient
cutoff of each rule and then tightens the rules in turn. A step holds if the exact binomial upper bound of what all rules together
falsely reject after it is within the risk; the steps before the first one that fails are taken. A sequence needs no
correction within itself, so the doubt is shared by the strata alone. Where the labels prove nothing, no rule rejects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import annotate, encoded, flat, grams, stored

REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: At most this share of the good documents of a stratum is rejected by all rules together, with this confidence.
RISK, DOUBT = 0.02, 0.05

#: The rules and the cutoffs tried, from strict to lenient. Fixed before any label is seen.
SHARES = (0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)
RULES = {
    "symbol_share": SHARES,
    "dup_line_share": SHARES,
    "repeat_share": SHARES,
    "other_share": SHARES,
    "word_length": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = ", ".join([f"{c} bigint" for c in (*COUNTS, "n_lines", "n_other")])

_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DELETED = _LETTERS + b" \t\n\r\x0b\x0c" + bytes(range(128, 256))


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window found at least twice, its first occurrence included."""
    if len(words) < window + 1:
        return 0
    runs = grams(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), window)
    _, at, counts = np.unique(runs, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[at] > 1)
    marks = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + window, minlength=len(words) + 1)
    return int((np.cumsum(marks) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of FIELDS; a null text has none of anything."""
    text = text or ""
    data = encoded(text)
    words = data.split()
    seen, lines, again = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    blanks = sum(map(text.count, " \t\n\r\x0b\x0c"))
    return (len(words), len(text) - blanks, sum(map(text.count, "#*$%&|<>")), again, repeated_words(words), lines,
            len(data.translate(None, _DELETED)))


def measured(docs: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    """All of `docs` with a struct `name` of counts; whole texts, one pass."""
    return annotate(docs, [text], lambda texts: map(counts, texts), FIELDS, name)


def values() -> dict[str, F.Column]:
    """What the rules look at, from the counts; 0 where there is nothing to divide by."""
    def share(part, whole):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"), "other_share": share("n_other", "word_chars"),
            "word_length": share("word_chars", "n_words")}


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial, as a regularised incomplete beta function."""
    if k >= n:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    if p <= 0:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return max(0.0, 1 - front * _beta_fraction(b, a, p) / b)


def upper_bound(k: int, n: int, doubt: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate of which k in n were seen."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_cdf(k, n, middle) > doubt else (low, middle)
    return high


def steps() -> list[tuple[str, float]]:
    """(rule, cutoff) in the order of testing: the rules in turn, each from its most lenient cutoff on."""
    most = max(map(len, RULES.values()))
    return [(rule, cuts[-1 - j]) for j in range(most) for rule, cuts in RULES.items() if j < len(cuts)]


def calibrate(labelled: DataFrame, stratum: str, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(stratum, n_good, and one cutoff per rule, null for none) from good documents with their counts.

    Rows with equal `print` are copies of one text and count once in a stratum: the bound is that of independent documents. Rows
    are summed to one row per stratum before anything else happens; that row, with a count for every step, is all that is looked
    at. A null stratum is one of its own.
    """
    found, order = values(), steps()
    first = F.array_min(F.array_compact(F.array(*[F.when(found[rule] > cut, F.lit(i)) for i, (rule, cut) in enumerate(order)])))
    distinct = labelled.select(F.col(stratum).alias("stratum"), "print", first.alias("first")).groupBy("stratum", "print").agg(F.min("first").alias("first"))
    sums = distinct.groupBy("stratum").agg(F.count("*").alias("n_good"), *[F.count_if(F.col("first") <= i).alias(f"_{i}") for i in range(len(order))])
    # One row per stratum: how many there are sets the correction for multiple tests.
    sums = sums.withColumn("strata", F.count("*").over(Window.partitionBy()))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                chosen = dict.fromkeys(RULES)
                for i, (rule, cut) in enumerate(order):
                    if binomial_cdf(int(row[f"_{i}"]), int(row["n_good"]), risk) > doubt / row["strata"]:
                        break
                    chosen[rule] = cut
                out.append((row["stratum"], int(row["n_good"]), *chosen.values()))
            yield pd.DataFrame(out, columns=["stratum", "n_good", *RULES]).astype({r: "float64" for r in RULES})

    return sums.mapInPandas(choose, "stratum string, n_good long, " + ", ".join(f"{r} double" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang",
          risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(doc_id, counts, base_failed, kept, rejected_by) for every row of `docs`.

    A document is good for calibration if it passes the base rules and none of its labels is below 1; documents without a
    label calibrate nothing. Null texts have counts of 0 and fail the base. Strata with too few labels reject nothing
    beyond the base. Repeated rows and copies are judged alike, and count once in the calibration.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"),
                       F.xxhash64(text).alias("print"))
    rows = stored(flat(measured(slim), "counts", "doc_id", "stratum", "print"), "counts")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(F.col("quality") >= 1)
    cutoffs = calibrate(rows.filter(~base_failed()).join(good, "doc_id", "left_semi"), "stratum", risk, doubt)
    joined = rows.alias("d").join(stored(cutoffs, "cutoffs").alias("c"), F.col("d.stratum").eqNullSafe(F.col("c.stratum")), "left")
    reasons = F.filter(F.array(*[F.when(value > F.col(f"c.{rule}"), F.lit(rule)) for rule, value in values().items()]), lambda r: r.isNotNull())
    return joined.select("d.doc_id", *COUNTS, base_failed().alias("base_failed"),
                         (~base_failed() & (F.size(reasons) == 0)).alias("kept"), F.array_join(reasons, ",").alias("rejected_by"))
