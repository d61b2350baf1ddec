"""Operators that compare or share out documents, against brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from spendframe.llm import decontaminate, mixing, near_dedup, sharding, suffix_array, suffix_dedup, warc
from spendframe.llm.common import grams, new_path, read, sliding, winnow
from spendframe.llm.components import components
from spendframe.llm.queries import QUERIES, SQL
from tests.conftest import SF
from tests.llm.conftest import LONG

SMALL = SF.replace("0.001", "0.01")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}


# helpers

def test_sliding_and_winnow():
    rng = np.random.default_rng(1)
    for span in (1, 2, 5, 8, 13):
        values = rng.integers(0, 9, 40).astype(np.uint64)
        expected = [values[i:i + span].min() for i in range(41 - span)]
        assert sliding(values, span, np.minimum).tolist() == expected
        chosen = set(winnow(values, span).tolist())
        assert all(any(values[j] == m and j in chosen for j in range(i, i + span)) for i, m in enumerate(expected))
        assert all(any(i <= j < i + span and values[j] == m for i, m in enumerate(expected)) for j in chosen)
    assert len(winnow(np.empty(0, np.uint64), 4)) == 0


def test_grams_tell_orders_apart():
    a, b = np.array([3, 5, 5, 3], np.uint64), np.array([5, 3, 3, 5], np.uint64)
    assert grams(a, 4)[0] != grams(b, 4)[0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(1000, i) for i in range(300, 360)] + [(i, i + 1) for i in range(400, 440)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in found} == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# suffix arrays

def test_suffix_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(1500):
        n, depth, top = rng.randint(1, 60), rng.randint(1, 6), rng.choice([1, 2, 3, 250])
        data = bytes(rng.randint(0, top) for _ in range(n))
        wanted = np.array([rng.random() < 0.7 and i + depth <= n for i in range(n)], bool)
        order = suffix_array.suffix_order(data, wanted, depth).tolist()
        keys = [data[i:i + depth] for i in order]
        assert sorted(order) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)
        common = suffix_array.common_prefixes(data, np.array(order), depth) if len(order) > 1 else []
        for x, y, c in zip(keys, keys[1:], common):
            assert x[:c] == y[:c] and (c == depth or x[c] != y[c])


def removed(texts, length):
    """(n_bytes, n_removed, n_spans, digest) per text, by counting every string."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def compare_repeats(df, texts, length, **options):
    found = suffix_dedup.repeats(df, length=length, **options).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == sorted((i, *r) for i, r in enumerate(removed(texts, length)))


def planted(seed, count):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(20, 200))) for _ in range(6)]
    texts = []
    for _ in range(count):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 80))), "ab" * rng.randint(0, 60)])
                 for _ in range(rng.randint(0, 5))]
        texts.append("".join(parts))
    return [*texts, None, "", *texts[:3], "a" * 500, "xyz" * 200, "\0" * 90]


def test_repeats_are_those_of_all_strings(spark):
    texts = planted(7, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compare_repeats(df, texts, 40, gram=12)


def test_repeats_of_a_mark_dealt_over_blocks(spark, monkeypatch):
    texts = planted(8, 50)
    monkeypatch.setattr(suffix_dedup, "MARK_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 200)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 16)
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compare_repeats(df, texts, 40, gram=12)


def test_repeats_in_documents(spark):
    texts = texts_of(spark, SF)
    expected = {i: r for i, r in zip(texts, removed(texts.values(), 400))}
    found = QUERIES["op1_suffix_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == expected


def test_repeats_cases(documents, rows):
    body = LONG[:1000]
    found = rows(suffix_dedup.repeats(documents((1, None), (2, "x" * 399), (2, "x" * 399), (3, body), (3, body), (None, body + "!"), (4, "é" * 400)), with_text=True))
    assert found[1]["n_bytes"] == 0 and all(r["n_removed"] == 0 for r in found[2])
    assert all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 and bytes(r["kept_text"]) == b"" for r in found[3])
    assert found[None]["n_removed"] == len(body) and bytes(found[None]["kept_text"]) == b"!"
    assert found[4]["n_removed"] == 800
    assert suffix_dedup.repeats(documents().limit(0)).count() == 0


# near duplicates

def near_components(texts, percent=85):
    sets = {}
    for i, t in texts:
        w = ascii_lower(t).encode().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def found_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}


def test_near_duplicates_in_documents(spark):
    texts = texts_of(spark, SF)
    assert found_components(read(spark, SF, "documents")) == near_components(texts.items())


def test_near_duplicates_around_a_hub_and_in_chains(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(40):  # near the base, often not near each other
        w = list(base)
        for at in rng.sample(range(300), 5):
            w[at] = f"q{rng.random()}"
        texts.append(" ".join(w))
    chain = list(base[::-1])
    for step in range(30):
        chain = list(chain)
        chain[step * 10: step * 10 + 4] = [f"c{step}{j}" for j in range(4)]
        texts.append(" ".join(chain))
    texts = list(enumerate(texts, 100))
    rng.shuffle(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert found_components(df) == near_components(texts)


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(3)
    agree = []
    for n in (5, 60, 900):
        for _ in range(30):
            shared, own = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n // 5 + 1).astype(np.uint64)
            similarity = len(shared) / (len(shared) + len(own))
            a, b = np.unique(shared), np.unique(np.concatenate([shared, own]))
            agree.append((near_dedup.sketch(a, 125) == near_dedup.sketch(b, 125)).mean() - similarity)
    assert abs(np.mean(agree)) < 0.02 and np.max(np.abs(agree)) < 0.2
    assert (near_dedup.sketch(np.array([7], np.uint64), 125) != near_dedup._EMPTY).all()


def test_near_duplicates_cases(documents, rows):
    body = " ".join(f"w{i}" for i in range(200))
    docs = documents((1, None), (2, ""), (3, "  \n"), (4, "Hi there"), (5, "hi  THERE"), (7, body), (7, body), (8, body + " x"), (9, LONG), (None, body), (6, body + " y"))
    found = rows(near_dedup.near_duplicates(docs))
    assert [(found[i]["n_shingles"], found[i]["component_id"]) for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert found[5]["component_id"] == 4 and found[8]["component_id"] == found[6]["component_id"] == 6
    assert [r["component_id"] for r in found[7]] == [6, 6] and found[None]["component_id"] is None and found[None]["kept"]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 9]
    assert sorted(r.doc_id for r in near_dedup.keep_one(documents((7, body), (7, body), (7, "other text"))).collect()) == [7, 7]
    assert near_dedup.near_duplicates(documents().limit(0)).count() == 0
    assert near_dedup.keep_one(documents().limit(0)).count() == 0


# benchmark decontamination

def benchmark_hits(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in items:
        w = pattern.findall(ascii_lower(text))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i:i + k])].add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = pattern.findall(ascii_lower(text)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 400])
def test_decontamination(spark, block_words, monkeypatch):
    monkeypatch.setattr(decontaminate.hits, "__defaults__", tuple(block_words if x == decontaminate.BLOCK_WORDS else x for x in decontaminate.hits.__defaults__))
    texts = texts_of(spark, SMALL)
    items = [(r.item_id, r.text) for r in read(spark, SMALL, "benchmark").collect()]
    found = {r[0]: tuple(r[1:]) for r in QUERIES["op3_decontamination"](spark, SMALL).collect()}
    assert found == benchmark_hits(texts.items(), items)
    assert any(r[4] for r in found.values())


def test_decontamination_of_short_items_and_cases(documents, spark, rows):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("abcdeé") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (62, LONG)]
    items = [(1, "A b, c!"), (2, "a b c d e a b c d"), (3, " ".join(rng.choice("abcdeé") for _ in range(14))), (4, None), (5, "..."), (3, "a"), (30, "É")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r[0]: tuple(r[1:]) for r in decontaminate.scan(documents(*docs), benchmark).collect()}
    assert found == benchmark_hits(docs, items)
    clean = decontaminate.clean(documents((1, "x"), (2, "a")), benchmark)
    assert [r.doc_id for r in clean.collect()] == [1] and clean.columns == documents((1, "x")).columns
    assert decontaminate.scan(documents((1, "a b")), benchmark.limit(0)).collect()[0].n_hit == 0
    assert decontaminate.scan(documents().limit(0), benchmark).count() == 0


def test_a_window_that_very_many_items_share(spark):
    """The window goes out once, without its items; they are counted where it is found."""
    items = spark.range(100_000).selectExpr("concat('i', id) AS item_id", "'one two three four five six seven eight nine ten' AS text")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y"), (2, "one two"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.scan(docs, items).collect()}
    names = ",".join(sorted(f"i{i}" for i in range(100_000)))
    assert (found[1].n_hit, found[1].n_items, found[1].items_sha256) == (10, 100_000, hashlib.sha256(names.encode()).hexdigest())
    assert found[2].n_items == 0 and not found[3].contaminated
    assert all(len(r.hits.windows) <= 1 for r in decontaminate.hits(docs, items).collect())


def test_blocks_leave_no_texts_behind(spark, monkeypatch):
    """Five blocks of the benchmark: what is written in between has no text column."""
    written, plain = [], decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, name="table": (written.append(df.columns), plain(df, name))[1])
    benchmark = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 25}x{j}" for j in range(i % 30))) for i in range(100)], "doc_id long, text string")
    rows = decontaminate.hits(docs, benchmark, block_words=850).collect()
    assert {r.doc_id: r.hits.n_hit for r in rows} == {i: (i % 30 if i % 25 < 20 and i % 30 >= 10 else 0) for i in range(100)}
    assert len(written) == 6 and not any("text" in columns for columns in written)


# mixing

def expected_targets(sizes):
    """By handing the excess round until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total = sum(sizes.values())
    full, out = set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in full and out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mixing_documents(spark):
    docs = {r.doc_id: r for r in read(spark, SMALL, "documents").collect()}
    found = {r.doc_id: r for r in QUERIES["op6_mixing"](spark, SMALL).collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for i, r in docs.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert found[i].size == words and found[i].taken % max(words, 1) == 0 and found[i].taken <= 3 * words
        sizes[r.source] += words
        taken[r.source] += found[i].taken
    targets = expected_targets(sizes)
    for i, r in docs.items():
        assert found[i].source_size == sizes[r.source] and found[i].target == pytest.approx(targets[r.source])
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = {r.doc_id: r for r in QUERIES["op6_mixing"](spark, SMALL).collect()}
    assert again == found


def test_fitting_the_budget():
    rng = np.random.default_rng(5)
    for _ in range(300):
        sizes = np.unique(rng.integers(1, 60, rng.integers(1, 8)))
        counts = rng.integers(1, 5, len(sizes))
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        budget = int(rng.integers(0, int((sizes * counts).sum()) + 5))
        taken = mixing.fitted(counts, sizes, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        reached, best = int((taken * sizes).sum()), max(s for s in sums if s <= budget)
        assert reached <= budget and best - reached <= sizes.max()
    wide = np.arange(3, 9003, 3)  # more sizes than were ever kept before: only multiples of 3 can be reached
    assert int((mixing.fitted(np.ones(3000, np.int64), wide, 50_000) * wide).sum()) == 49_998
    few = mixing.fitted(np.array([1, 1, 1]), np.array([70_000, 90_000, 3]), 85_000)
    assert int((few * np.array([70_000, 90_000, 3])).sum()) == 70_003
    many = mixing.fitted(np.full(500, 10**6), np.arange(1, 501), 10**9 + 7)
    assert int((many * np.arange(1, 501)).sum()) == 10**9 + 7


def test_mixing_cases(documents, rows):
    docs = documents((1, None, "en", "a"), (2, "", "en", None), (3, "one two", "en", None), (3, "one two", "en", None), (4, LONG, "en", "b"), (None, "x y z", "en", "c"))
    mixed = mixing.mix(docs, mixing.words(), name="m")
    found = rows(mixed.select("doc_id", "m.*"))
    assert found[1]["size"] == found[1]["taken"] == found[2]["taken"] == 0
    assert found[1]["source_size"] == 0 and found[1]["target"] == 0.0
    assert found[4]["source_size"] == 30_000 and len(found[3]) == 2
    total = 30_000 + 4 + 3
    weights = {"a": 0, "b": 2, "c": 3, None: 1}
    assert sum(r["taken"] for v in found.values() for r in (v if isinstance(v, list) else [v])) <= total and weights
    assert mixing.repeated(docs).columns == docs.columns
    assert mixing.repeated(documents().limit(0)).count() == 0


# sharding

def check_shards(found, texts, shards):
    slots, sizes, groups, rows = (collections.defaultdict(x) for x in (list, int, set, int))
    for r in found:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        rows[r["shard"]] += 1
        groups[text].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, groups


def test_sharding_documents(spark):
    texts = texts_of(spark, SMALL)
    found = [r.asDict() for r in QUERIES["op7_sharding"](spark, SMALL).collect()]
    assert len(found) == len(texts)
    sizes, groups = check_shards(found, texts, 40)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values()) / 40 + 200
    assert all(len(g) == 1 for g in groups.values())


def test_a_hot_group_is_dealt_out(documents, spark):
    texts = {i: "hot text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 30) for i in range(3000)}
    found = [r.asDict() for r in sharding.shard(documents(*texts.items())).collect()]
    sizes, groups = check_shards(found, texts, 40)
    assert len(groups["hot text " * 20]) > 10
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_sharding_cases(documents):
    texts = {1: None, 2: "", 3: LONG, None: "x", 5: "é"}
    found = [r.asDict() for r in sharding.shard(documents(*texts.items(), (5, "é"))).collect()]
    assert len(found) == 6
    check_shards(found, texts, 40)
    assert sharding.shard(documents().limit(0)).count() == 0


# archives

def test_archives_of_pages(spark):
    html = {r.page_id: r.html for r in read(spark, SMALL, "pages").collect()}
    found = {r.page_id: r for r in QUERIES["op9_warc"](spark, SMALL).collect()}
    assert set(found) == set(html) and "op9_warc" in SQL
    for i, r in found.items():
        assert r.intact and r.payload_bytes == len(html[i].encode()) and r.payload_digest == hashlib.sha1(html[i].encode()).hexdigest()


def test_archive_chunks(spark, rows):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"
    big = "".join(f"{i}é" for i in range(5000)) + tricky
    html = [(1, big), (2, big), (3, tricky), (4, "WARC/1.1\r\n\r\nWARC/1.1\r\nx"), (5, None), (6, ""), (7, "\r\n\r\n"), (8, "ends\r\n\r\nWARC/1.1"),
            (9, big), (9, big), (None, "none"), (10, "y" * 999), (11, "y" * 999), (12, tricky * 400), (13, "x" * 1022 + "\r\n\r\nWARC/1.1\r\nz")]
    df = spark.createDataFrame([(i, f"http://a/{i}\r\n", t) for i, t in html], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write(df, path, size=1024)
    found = rows(warc.read_records(spark, path))
    for i, text in html:
        data = (text or "").encode()
        for r in found[i] if isinstance(found[i], list) else [found[i]]:
            assert r["intact"] and (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest()), i
            expected = ("revisit", 9) if text == big and i != 9 else ("response", None)
            assert (r["record_type"], r["refers_to"]) == expected
    parts = warc.record_chunks(spark, path)
    assert parts.count() > len(html) + 60
    assert max(r.size for r in parts.collect()) <= 1024 + 8


def test_archive_damage_is_seen(spark):
    df = spark.createDataFrame([(1, "u", "abc" * 1000), (2, "u", "x")], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write(df, path, size=1024)
    text = spark.read.option("wholetext", True).text(path).collect()
    broken = new_path(spark, "warc")
    spark.createDataFrame([(t.value.replace("abcabc", "abcabd", 1),) for t in text], "value string").coalesce(1).write.option("lineSep", "\r\n").text(broken)
    found = {r.page_id: r.intact for r in warc.read_records(spark, broken).collect()}
    assert found[1] is False
    empty = new_path(spark, "warc")
    warc.write(df.limit(0), empty)
    assert warc.read_records(spark, empty).count() == 0


# pipeline

def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"] and corpus_pipeline.ORACLE_SQL is None
    docs = read(spark, SF, "documents")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, SF).collect(), docs.schema)
        assert kept.columns == columns
        ids, left = {r.doc_id for r in before.collect()}, [r.doc_id for r in kept.collect()]
        assert set(left) <= ids and left
        texts = {r.doc_id: r.text for r in before.collect()}
        if name == "near_dedup":  # the stage links from 80 percent; the 85 are those of op5 alone
            assert sorted(left) == sorted(i for i, r in near_components(texts.items(), 80).items() if r[2] or not r[0])
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
            assert sorted(left) == sorted(i for i, r in benchmark_hits(texts.items(), items).items() if not r[4])
        if name == "mixing":
            assert max(collections.Counter(left).values()) <= 3
    result = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in result.collect()) == sorted(left)


def test_pipeline_links_near_copies_from_80_percent(spark):
    base = [f"w{i}" for i in range(200)]
    copy = [f"x{i}" if i in (30, 80, 120, 170) else w for i, w in enumerate(base)]  # 176 of 216 shingles
    other = [f"y{i}" if i in (30, 70, 110, 150, 190) else w for i, w in enumerate(base)]  # 171 of 221
    texts = [(i, " ".join(w)) for i, w in enumerate((base, copy, other))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, df, SF).collect()) == [0, 2]
    assert sorted(r.doc_id for r in near_dedup.keep_one(df).collect()) == [0, 1, 2]
    docs = read(spark, SF, "documents")
    expected = near_components(texts_of(spark, SF).items(), 80)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()) == sorted(
        i for i, r in expected.items() if r[2] or not r[0])


def test_pipeline_with_near_copies_from_80_percent(spark, monkeypatch):
    monkeypatch.setattr(near_components, "__defaults__", (corpus_pipeline.NEAR_PERCENT,))
    test_pipeline(spark)


def test_bands_miss_few_pairs_at_the_threshold():
    assert near_dedup.banding(85) == (25, 5) and near_dedup.banding(80) == (31, 4)
    for percent in range(11, 101):
        bands, rows = near_dedup.banding(percent)
        assert bands * rows <= 127 and (1 - (percent / 100) ** rows) ** bands < 1e-6
