"""Phrase collocation mining: frequent phrases level by level, scored by their weakest cut.

Texts become arrays of the ids of frequent words, once. For phrases of k words, the frequent phrases of k - 1 words go out as
double-array tries; numpy takes all positions of a batch through a trie at the same time, a level at a step. Where a position and the
next one both end in an accepting state, the k words there are a candidate that is safe by the Apriori rule: both its parts are
frequent. So no candidate is listed that doesn't occur, however many phrases share a common word. A task counts
its pairs of accepting states, and Spark sums the counts of all tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, encoded, fresh, stored, written
from .double_array import DoubleArray

LONGEST, LEAST, INSIDE_PERCENT, TOP = 5, 100, 100, 2000
#: Words of a vocabulary and phrases of a trie that are broadcast at a time: some 100 MB in a worker.
WORDS_HELD, PHRASES_HELD = 1 << 19, 1 << 19
#: Different words or phrases that a task counts before it hands the counts on, and bytes of text split at a time.
COUNTED, PIECE = 1 << 20, 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_TOKEN = re.compile(rb"\n|[^ \n]+")
_CUT = re.compile(rb"[ \n]")


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, with a line feed between pieces, some at a time."""
    data, at = encoded(text).translate(_LOWER), 0
    while at < len(data):
        cut = _CUT.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield _TOKEN.findall(data[at:end])
        at = end


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), summed up within a task as far as COUNTED allows."""
    held: dict[str, Counter] = {}

    def sums() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, words in held.items() for w, n in words.items() if w != b"\n"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, [pa.string(), pa.binary(), pa.int64()])],
                                          ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counter = held.setdefault(lang, Counter())
            for words in tokens(text):
                counter.update(words)
        if sum(map(len, held.values())) > COUNTED:
            yield sums()
            held.clear()
    yield sums()


def _numbered(df: DataFrame, order: list[str], held: int) -> tuple[DataFrame, int]:
    """The rows with `block` and `id`, in blocks of about `held` rows at most; ids of a block follow each other."""
    blocks = -(-df.count() // max(1, held // 2)) if held > 1 else 1
    dealt = df.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(max(1, blocks))))
    sizes = {r.block: r["count"] for r in dealt.groupBy("block").count().collect()}
    before, offsets = 0, []
    for b in range(max(1, blocks)):
        offsets.append(before)
        before += sizes.get(b, 0)
    rank = F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1
    first = F.element_at(F.array(*[F.lit(v).cast("long") for v in offsets]), (F.col("block") + 1).cast("int"))
    return dealt.withColumn("id", first + rank), max(1, blocks)


def _encode(held):
    """`ids` of the words; -1 for others and at every end of a piece or text. Ids found with an earlier part of the words stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            out = []
            for lang, text, before in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                get = known.get(lang, {}).get
                own = [np.array([get(w, -1) for w in words], np.int32) for words in tokens(text)]
                ids = np.concatenate([*own, np.array([-1], np.int32)])
                out.append(ids if before is None else np.maximum(ids, np.array(before, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["lang", "text", "ids"])

    return run


def _encoded(texts: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """One array of ids for each text, stored; a vocabulary of several blocks takes as many passes."""
    spark = texts.sparkSession
    rows, path = texts.select("lang", "text", F.lit(None).cast("array<int>").alias("ids")), None
    for b in range(blocks):
        part: dict[str, dict[bytes, int]] = {}
        for r in words.filter(F.col("block") == b).select("lang", "word", "id").toLocalIterator():
            part.setdefault(r.lang, {})[bytes(r.word)] = r.id
        held, last = spark.sparkContext.broadcast(part), path
        made = rows.mapInArrow(_encode(held), rows.schema)
        rows, path = written(made if b + 1 < blocks else made.select("ids"), "ids")
        held.unpersist()
        if last:
            dropped(spark, last)
    return rows


def _fill(held):
    """`at`: for each position the number of the phrase that starts there, -1 where none does; earlier blocks' numbers stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, first = held.value
        for batch in batches:
            ids = batch.column(0)
            found = trie.advance(ids.flatten().to_numpy().astype(np.int64))
            found = np.where(found >= 0, found + first, -1)
            if batch.column(1).null_count < batch.num_rows:
                found = np.maximum(found, batch.column(1).flatten().to_numpy())
            sizes = np.diff(ids.offsets.to_numpy())
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(found))], ["ids", "at"])

    return run


def _count_pairs(held):
    """(a, b, n): how often phrase b starts a word after phrase a. Without `held`, from stored numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def summed() -> None:
            every, where = np.unique(np.concatenate(keys), return_inverse=True)
            # Counts stay far below 2^53 in a task, so the doubles of bincount are exact.
            counts[:] = [np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)]
            keys[:] = [every]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0] >> 32), pa.array(keys[0] & 0xFFFFFFFF), pa.array(counts[0])], ["a", "b", "n"])

        for batch in batches:
            if held is None:
                at = batch.column(1).flatten().to_numpy()
            else:
                trie, _ = held.value
                at = trie.advance(batch.column(0).flatten().to_numpy().astype(np.int64))
            both = (at[:-1] >= 0) & (at[1:] >= 0)
            every, n = np.unique((at[:-1][both] << 32) | at[1:][both], return_counts=True)
            keys.append(every)
            counts.append(n)
            if sum(map(len, keys)) > 2 * COUNTED:
                summed()
                if len(keys[0]) > COUNTED:
                    yield out()
                    keys.clear()
                    counts.clear()
        if keys:
            summed()
            yield out()

    return run


def _pairs(ids: DataFrame, phrases: DataFrame, blocks: int) -> DataFrame:
    """(a, b, n) of all neighbouring numbers of `phrases`; with several blocks the numbers are written out first."""
    spark, path, made = ids.sparkSession, None, None
    rows = ids.select("ids", F.lit(None).cast("array<bigint>").alias("at"))
    for b in range(blocks):
        held_rows = phrases.filter(F.col("block") == b).select("id", "ids").orderBy("id").toPandas()
        if len(held_rows):
            table, first = np.array(held_rows["ids"].tolist(), np.int64), int(held_rows["id"].iloc[0])
        elif blocks > 1:
            continue
        else:
            table, first = np.empty((0, 1), np.int64), 0
        held = spark.sparkContext.broadcast((DoubleArray(table), first))
        if blocks == 1:
            made = rows.mapInArrow(_count_pairs(held), "a long, b long, n long")
            continue
        last = path
        rows, path = written(rows.mapInArrow(_fill(held), rows.schema), "at")
        held.unpersist()
        if last:
            dropped(spark, last)
    counts = made if blocks == 1 else rows.mapInArrow(_count_pairs(None), "a long, b long, n long")
    return counts.groupBy("a", "b").agg(F.sum("n").alias("f"))


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of every phrase of 1 to `longest` words that occurs `least` times or more in its language, and (lang, n)."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    spark = docs.sparkSession
    counted, counted_path = written(texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("f")), "words")
    totals = stored(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    common, blocks = _numbered(counted.filter(F.col("f") >= least), ["lang", "word"], WORDS_HELD)
    level = stored(common.select("id", "block", F.array(F.col("id").cast("int")).alias("ids"), "lang", "word",
                                 F.array(F.col("word")).alias("words"), "f"), "phrases")
    dropped(spark, counted_path)
    ids = _encoded(texts, level, blocks)
    levels = [level]
    for _ in range(2, longest + 1):
        pairs = _pairs(ids, level, blocks).filter(F.col("f") >= least)
        head = level.select(F.col("id").alias("a"), "lang", "ids", "words")
        tail = level.select(F.col("id").alias("b"), F.slice("ids", -1, 1).alias("i"), F.slice("words", -1, 1).alias("w"))
        longer = pairs.join(head, "a").join(tail, "b").select(
            "lang", F.concat("ids", "i").alias("ids"), F.concat("words", "w").alias("words"), "f")
        longer = stored(longer, "longer")
        numbered, blocks = _numbered(longer, ["ids"], PHRASES_HELD)
        level = stored(numbered, "phrases")
        levels.append(level)
        if not level.take(1):
            break
    every = levels[0].select("lang", "words", "f")
    for level in levels[1:]:
        every = every.union(level.select("lang", "words", "f"))
    return every, totals


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exact: the products are decimals, the quotient is whole."""
    big = [c.cast("decimal(18,0)") for c in (a, n, left, right)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * big[0] * big[1], big[2] * big[3])


def ranked(phrases: DataFrame, totals: DataFrame, inside: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language by their weakest cut, without those that a longer phrase explains."""
    key = phrases.withColumn("k", F.size("words"))
    longer = key.filter("k > 2").select("lang", F.col("f").alias("around"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.slice("words", i, size))
    ))).alias("words"))
    most = longer.groupBy("lang", "words").agg(F.max("around").alias("around"))
    left_out = F.lit(100) * F.col("around") >= F.lit(inside) * F.col("f")
    kept = key.filter("k > 1").join(most, ["lang", "words"], "left").filter(F.col("around").isNull() | ~left_out)
    cuts = kept.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "*", F.slice("words", F.lit(1), F.col("cut")).alias("head"), F.slice("words", F.col("cut") + 1, F.size("words")).alias("tail"))
    scored = cuts.join(phrases.select("lang", F.col("words").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        phrases.select("lang", F.col("words").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(F.broadcast(totals), "lang")
    weakest = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct(
        score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("best"))
    # Bytes are joined and compared as bytes; equal to the order of UTF-8 text.
    phrase = F.aggregate(F.slice("words", 2, F.lit(LONGEST * 2)), F.get("words", F.lit(0)), lambda x, w: F.concat(x, F.lit(b" "), w))
    rows = weakest.select("lang", phrase.alias("phrase"), "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Ranked within parts of a language first, so that no task gathers all its phrases.
    part = fresh(rows, "part")
    near = rows.withColumn(part, F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    whole = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return near.withColumn("rank", whole.cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
                 inside: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words by score.

    Texts are lower-cased (A-Z) and end a piece at .,;:!? and line ends; words lie between blanks and tabs, phrases within pieces.
    Null texts are empty, a null language is `und`. a, l and r count the phrase and the two parts of the cut with the lowest score
    floor(1000 a n / (l r)), n all words of the language. Phrases with a below `least` don't count, and a phrase is dropped if a longer
    one around it has `inside` percent of its count. Repeated rows count each time; ties go by a, then by the bytes of the phrase.
    Without a frequent phrase the result is empty.
    """
    phrases, totals = frequent(docs, text, lang, longest, least)
    return ranked(phrases, totals, inside, top)
