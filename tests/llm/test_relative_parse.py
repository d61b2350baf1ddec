"""Removal of word sequences of earlier documents against brute force over all windows."""

import hashlib
import random
import re

import pytest

from spendframe.llm import relative_parse
from spendframe.llm.common import read
from spendframe.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.conftest import LONG

SMALL = SF.replace("0.001", "0.01")


def brute(rows, window=50):
    """[(doc_id, n_words, n_removed, kept_sha256)] of (doc_id, text) rows, sorted."""
    last = 2**63 - 1
    split = [(last if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, text in rows]
    first = {}
    for low, _, words in split:
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            first[key] = min(first.get(key, low), low)
    out = []
    for low, i, words in split:
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at:at + window])] < low:
                gone[at:at + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return sorted(out, key=str)


def results(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, SMALL])
def test_the_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    found = results(QUERIES["op12_relative_parse"](spark, sf))
    assert found == brute(rows) and sum(r[2] > 0 for r in found) > 10


def tangle(seed, n, words=6, window=8):
    """Texts of few words with shared passages, in shuffled id order."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdef") + str(rng.randint(0, 3)) for _ in range(rng.randint(window - 2, 30))] for _ in range(words)]
    rows = []
    for i in rng.sample(range(10 * n), n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(passages)[rng.randint(0, 4):] if rng.random() < 0.6 else [rng.choice("abcdef") for _ in range(rng.randint(1, 12))]
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("mark_bytes", [relative_parse.MARK_BYTES, 0])
def test_tangled_texts(spark, monkeypatch, seed, mark_bytes):
    """With mark_bytes 0 every mark with several segments takes the finer way."""
    monkeypatch.setattr(relative_parse, "MARK_BYTES", mark_bytes)
    rows = tangle(seed, 120) + [(3, "x " * 200), (4, "x " * 90 + "y"), (5, "x x x x"), (6, "x " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(relative_parse.earlier(docs, window=8, gram=4)) == brute(rows, 8)


def test_repeated_windows_of_a_text_are_one_row(spark, monkeypatch):
    """A line over and over, in a mark that is cut finer: one row for each distinct window, with all its places, and all results."""
    texts = [(i, f"lead{i} " + "is on. " * 300 + f"tail{i}") for i in range(4)] + [(9, "x " * 120 + "y " * 120 + "is on. " * 60 + "x " * 120)]
    words = [[tuple(t.split()[i:i + 50]) for i in range(len(t.split()) - 49)] for _, t in texts]
    batch = relative_parse.pa.RecordBatch.from_pylist([
        {"digest": relative_parse.xxhash.xxh3_128_digest(data), "low": i, "text": t,
         "chosen": relative_parse.runs(relative_parse.Words(data).hashes(), 50).view("int64").tolist()}
        for i, t in texts for data in [relative_parse.joined(t)]])
    rows = [row for out in relative_parse._cut(50, 50)(iter([batch])) for row in out.to_pylist()]
    assert len(rows) == sum(len(set(w)) for w in words)
    assert sum(sum(r["windows"]) for r in rows) == sum(map(len, words))
    monkeypatch.setattr(relative_parse, "MARK_BYTES", 0)
    assert results(relative_parse.earlier(spark.createDataFrame(texts, "doc_id long, text string"))) == brute(texts)


def test_factors_and_their_boundaries():
    """Factors of two references that overlap in the parsed text: the windows over the boundary are covered as well."""
    reference = relative_parse.Reference([b"a b c d e f", b"d e f g h i", b"z a b c d e f g h i y"], [1, 2, 3], 3)
    assert reference.parse(0) == [] and reference.parse(1) == [(0, 1)]
    assert reference.parse(2) == [(1, 8)]
    assert reference.reach[reference.starts[2] + 1] == 6 and reference.reach[reference.starts[2] + 4] == 6
    same = relative_parse.Reference([b"a b c d", b"a b c e"], [4, 4], 3)
    assert same.parse(0) == same.parse(1) == []


def test_longest_matches_are_exact():
    rng = random.Random(11)
    for _ in range(60):
        bodies = list({" ".join(rng.choice("ab") for _ in range(rng.randint(3, 20))) for _ in range(6)})
        lows = [rng.randint(0, 3) for _ in bodies]
        reference = relative_parse.Reference([b.encode() for b in bodies], lows, 3)
        for i, body in enumerate(bodies):
            words = body.split()
            for at in range(len(words)):
                best = max((n for j, other in enumerate(bodies) if lows[j] < lows[i] for n in range(len(words) - at + 1)
                            if f" {' '.join(words[at:at + n])} " in f" {other} "), default=0)
                assert reference.reach[reference.starts[i] + at] == (best if best >= 3 else 0)


def test_cases(documents, rows):
    fifty = " ".join(f"w{i}" for i in range(50))
    docs = [(1, None), (2, ""), (3, fifty), (4, "other " + fifty.replace(" ", "\n\t")), (5, fifty[:-1] + "x"), (None, fifty), (3, fifty), (7, LONG),
            (8, LONG + "tail"), (9, fifty + " " + fifty), (10, " ".join(["nbsp"] * 60)), (-1, fifty + "y"), (11, ("y" * 3000 + " ") * 50),
            (12, ("y" * 3000 + " ") * 51)]
    found = results(relative_parse.earlier(documents(*docs)))
    assert found == brute(docs)
    by_id = rows(relative_parse.earlier(documents(*docs), with_text=True))
    assert by_id[None]["n_removed"] == 50 and by_id[None]["kept_text"] == b"" and [r["n_removed"] for r in by_id[3]] == [0, 0]
    assert by_id[8]["kept_text"] == b"tail" and by_id[4]["kept_text"] == b"other" and by_id[7]["kept_text"] is None
    assert relative_parse.earlier(documents().limit(0)).count() == 0
    with pytest.raises(ValueError):
        relative_parse.earlier(documents(), gram=51)


def test_one_passage_in_every_document(spark, monkeypatch):
    """A mark that every document has, with other words around it each time."""
    monkeypatch.setattr(relative_parse, "MARK_BYTES", 1 << 16)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"l{i}.{j}" for j in range(40)) + f" {passage} " + " ".join(f"r{i}.{j}" for j in range(40))) for i in range(400)]
    found = results(relative_parse.earlier(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute(rows) and sum(r[2] == 60 for r in found) == 399
