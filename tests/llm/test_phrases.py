"""Phrase mining against counting everything, and the trie against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendframe.llm import phrases
from spendframe.llm.common import read
from spendframe.llm.double_array import DoubleArray
from spendframe.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.conftest import LONG

SMALL = SF.replace("0.001", "0.01")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=5, least=100, inside=100, top=2000):
    """{lang: [(phrase, a, l, r, n, score)]} of (lang, text) rows."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(_LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, own in counts.items():
        candidates = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        around = defaultdict(int)
        for p, c in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i:i + k]] = max(around[p[i:i + k]], c)
        found = []
        for p, a in candidates.items():
            if p in around and 100 * around[p] >= inside * a:
                continue
            s, _, l, r = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((" ".join(p), a, l, r, n[lang], s))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        if found:
            out[lang] = found[:top]
    return out


def results(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.lang, r["rank"])):
        out[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert r["rank"] == len(out[r.lang])
    return dict(out)


def test_the_whole_table(spark):
    rows = [(r.lang, r.text) for r in read(spark, SMALL, "documents").collect()]
    found = results(QUERIES["op13_phrases"](spark, SMALL))
    assert found == brute(rows) and sum(map(len, found.values())) > 50
    lower = results(phrases.collocations(read(spark, SMALL, "documents"), least=12))
    assert lower == brute(rows, least=12) and max(p.count(" ") for own in lower.values() for p, *_ in own) == 4


@pytest.mark.parametrize("held", [None, 20])
def test_every_level_and_several_blocks(spark, monkeypatch, held):
    """With `held` 20, words and phrases go out in many blocks; counts pass through several batches of a task."""
    if held:
        monkeypatch.setattr(phrases, "WORDS_HELD", held)
        monkeypatch.setattr(phrases, "PHRASES_HELD", 2 * held)
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(["a", "B", "c,", "the quick fox.", "x y z\tw v u", "é"]) for _ in range(rng.randint(0, 30))))
            for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert results(phrases.collocations(docs, least=8, inside=80, top=50)) == brute(rows, 5, 8, 80, 50)


def test_the_trie_is_a_dictionary():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 4):
        for n in (0, 1, 5, 300):
            rows = np.unique(rng.integers(0, 12, (n, k)), axis=0)
            ids, known = rng.integers(-1, 14, 2000), {tuple(r): i for i, r in enumerate(rows.tolist())}
            found = DoubleArray(rows).advance(ids)
            assert found.tolist() == [known.get(tuple(ids[i:i + k].tolist()), -1) for i in range(len(ids))]


def test_scores_beyond_64_bits(spark):
    big = [(3 * 10**12, 10**14, 4 * 10**12, 5 * 10**12), (100, 10**15, 100, 100), (7, 3, 7, 7)]
    df = spark.createDataFrame(big, "a long, n long, l long, r long")
    found = [r.s for r in df.select(phrases.score(*[F.col(c) for c in "anlr"]).alias("s")).collect()]
    assert found == [1000 * a * n // (l * r) for a, n, l, r in big]


def test_cases(documents):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "A b, a  b\ta b"), (5, LONG), (6, "a b", None), (7, "a b\na b", None), (8, "?!.,"), (9, "İ İ \x00 a")]
    found = results(phrases.collocations(documents(*rows), least=2))
    assert found == brute([(r[2] if len(r) > 2 else "en", r[1]) for r in rows], least=2)
    assert found["und"] == [("a b", 3, 3, 3, 6, 2000)]
    assert phrases.collocations(documents().limit(0)).count() == 0
    assert phrases.collocations(documents((1, None), (2, "one two"))).count() == 0
