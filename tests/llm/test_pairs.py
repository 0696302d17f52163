"""Joins, dedup and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, ngram_join, suffix_dedup
from quillspark.llm.components import components

from . import cases


def brute_dedup(rows, size=100):
    """Every window in order of document and place."""
    first, out = set(), {}
    for doc_id, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if b[p : p + size] in first:
                gone[p : p + size] = b"\1" * size
            first.add(b[p : p + size])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(bytes(gone).replace(b"\0", b" ").split())
        out[doc_id] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def brute_join(rows):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed=3, n=60):
    rng, base, rows = random.Random(seed), cases.prose(77, 90).split(), []
    for i in range(n):
        w = list(base) if i % 3 else cases.prose(100 + i % 9, 70).split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("hot,meet", [(2048, 256), (1, 256), (2048, 2), (1, 1)])
def test_dedup_equals_brute_force(spark, monkeypatch, hot, meet):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MEET", meet)
    rows = near_copies() + [(900, "ab" * 400), (901, "x" + "ab" * 300), (902, None), (903, "é" * 150)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == brute_dedup(rows)


def test_dedup_of_ids_with_several_texts(spark):
    """Texts of one id are documents of their own, in the order of their hash; very long ones are cut to blocks inside."""
    shared = cases.prose(61, 60)
    rows = [(1, cases.prose(62, 40) + shared), (1, cases.prose(63, 50) + shared), (2, shared), (3, cases.prose(64, 130_000)), (3, cases.prose(64, 130_000)[400_000:] + "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted((r.doc_id, r.t, r.text) for r in frame.selectExpr("doc_id", "xxhash64(text) AS t", "text").collect())
    want = brute_dedup([((i, t), text) for i, t, text in order])
    got = suffix_dedup.dedup(frame).collect()
    assert sorted(tuple(r)[1:5] for r in got) == sorted(want.values()) and all(0 <= r.n_removed <= r.n_bytes for r in got)


def test_common_lines_spread_over_ranges(spark):
    """One line in every document: copies don't gather in its range."""
    line = "This very line of more than one hundred bytes stands in each of the documents, at its end or its beginning, whole. " * 2
    docs = spark.createDataFrame([(k, cases.prose(k, 60) + "\n" + line) for k in range(2000)], "doc_id long, text string").repartition(4)
    texts = docs.selectExpr("doc_id", "xxhash64(text) AS t", "text")
    rows = texts.mapInArrow(suffix_dedup._anchors(64, 1, 100), "r int, g int, h binary, c binary, d binary, p binary, n binary")
    n = [r.n for r in rows.groupBy("r").agg(F.sum(F.length("n")).alias("n")).collect()]
    assert len(n) == 64 and max(n) < 3 * sorted(n)[len(n) // 2] + 2000 * 4


def test_dedup_awkward_rows(spark):
    got = suffix_dedup.dedup(cases.documents(spark)).collect()
    want = brute_dedup({(r[0], r[1]) for r in cases.rows() if r[0] is not None})
    assert len(got) == len(cases.rows())
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert tuple(r)[1:5] == want[r.doc_id]
    assert suffix_dedup.dedup(cases.empty(spark)).collect() == []


def test_bounded_prefixes_by_comparison():
    b = np.frombuffer(b"banana bandana banana\0cabana\0", np.uint8)
    for bound in (1, 3, 6):
        order = suffix_dedup.suffix_order(b, bound)
        text = b.tobytes() * 2
        s = [text[i : i + bound] for i in order]
        assert suffix_dedup.bounded_prefixes(b, order, bound).tolist() == [False, *(x == y for x, y in zip(s, s[1:]))]


@pytest.mark.parametrize("group", [8192, 7])
def test_join_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rows = near_copies(5, 80)
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(rows)


def test_join_of_ids_with_several_texts(spark):
    """An id joins what its texts are linked to."""
    a, b = cases.prose(71, 60), cases.prose(72, 60)
    rows = [(1, a), (5, a), (5, b), (7, b + " end"), (9, cases.prose(73, 60)), (11, cases.prose(74, 9)), (11, cases.prose(75, 9))]
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 5: 1, 7: 1, 9: 9, 11: 11} and len(got) == len(rows)


def test_join_of_long_and_tiny_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BATCH", 1 << 16)
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", 1 << 12)
    long = cases.prose(81, 500_000)
    rows = [(1, long), (2, long + " more"), (3, "a b"), (4, "A b"), (5, "a b c d e f"), (6, "a b c d e g"), (7, "a b c d e f g"), *((20 + k, t) for k, t in near_copies(9, 60))]
    rows = [(i, t) for i, t in rows]
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id < 3} == {1: 1, 2: 1}
    want = brute_join(rows[2:])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id > 2} == want


def test_memory_of_a_long_text():
    """Beside a text, its shingles take a few times its size, not the hashing of each byte."""
    text = " ".join(f"w{k * 7919 % 100_003}" for k in range(600_000)).encode()
    tracemalloc.start()
    n = len(next(ngram_join.shingle_sets([text])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and peak < 16 * len(text)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_words_across_blocks(monkeypatch, block):
    """Words that go over the ends of blocks, or over several blocks, and words that end with one."""
    text = f" {'x' * 40} ab\n abc  A {cases.prose(12, 30)} é\tend".encode()
    want, first = ngram_join.word_hashes(np.frombuffer(text, np.uint8))
    sets = [x.tolist() for x in ngram_join.shingle_sets([text, b"", b"  ", text + b" more"])]
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got, at = ngram_join.word_hashes(np.frombuffer(text, np.uint8))
    assert got.tolist() == want.tolist() and at.tolist() == first.tolist() == [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    assert [x.tolist() for x in ngram_join.shingle_sets([text, b"", b"  ", text + b" more"])] == sets


def test_payload_does_not_grow_with_ranges(spark):
    docs = spark.createDataFrame([(k, cases.prose(k, 80)) for k in range(500)], "doc_id long, text string").coalesce(1)
    size = lambda n: docs.mapInArrow(ngram_join._shingles(n), "r int, batch string, x binary, n binary, y binary").agg(F.sum(F.length("x") + F.length("n"))).head()[0]
    assert size(8192) < 1.1 * size(128)


def test_join_awkward_rows(spark):
    got = ngram_join.classes(cases.documents(spark)).collect()
    want = brute_join({(r[0], r[1]) for r in cases.rows() if r[0] is not None})
    assert len(got) == len(cases.rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles > 0
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert ngram_join.classes(cases.empty(spark)).collect() == []


def test_components_of_long_paths(spark):
    p = random.Random(1).sample(range(200), 200)
    edges = [(p[i], p[i + 1]) for i in range(149)] + [(p[i], p[i + 3]) for i in range(150, 190)] + [(p[0], p[0])]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == min(p[:150]) for x in p[:150])
    assert len(set(got.values())) == 4


PLAIN = "Which of these metals is the best at carrying heat from one end of a short rod to the other end?"
ITEM = "A train travels 120 km in 3 hours. If Alice rides with Bob for 45 minutes, how far do they travel together in total?"


def test_decontamination_finds_other_parameters(spark):
    docs = [
        (1, "Q: A train travels 300 km in 5 hours. If Carol rides with Dave for 20 minutes, how far do they travel together in total? Yes."),
        (2, "A train left. Nobody knows how far they travel, in total silence, together."), (3, PLAIN.upper()), (4, None), (5, ""), (None, ITEM),
    ]
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (7, ITEM), (10, PLAIN)], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (3, 10), (None, 7)}
    assert decontamination.contaminated(cases.empty(spark), items).collect() == []
    assert decontamination.contaminated(cases.documents(spark), items.limit(0)).collect() == []


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SMALL", 0)
    docs = spark.createDataFrame([(1, f"{cases.prose(8, 300)} {ITEM} {cases.prose(9, 300)}"), (2, cases.prose(8, 300))], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()] == [(1, 7)]


def test_decontamination_rejects_unsteady_slots(spark):
    item = "Add 10 to the sum then take 10 from the rest then give 10 to the first and give 10 to the last one of them all"
    other = "Add 11 to the sum then take 12 from the rest then give 13 to the first and give 14 to the last one of them all"
    steady = item.replace("10", "25")
    docs = spark.createDataFrame([(1, other), (2, steady)], "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [2]


def test_decontamination_judges_each_occurrence(spark):
    """The exact item beside two versions with other values; one version of more tokens; and unsteady slots alone."""
    item = "Add 10 to the sum then take 12 from the rest then give 14 to the first and give 16 to the last one of them all"
    versions = [re.sub(r"\d+", lambda m, k=k: str(int(m.group()) * k + 1), item) for k in (3, 5)]
    longer = item.replace("10", "7.5").replace("14", "9.5")
    unsteady = "Add 10 to the sum then take 10 from the rest then give 10 to the first and give 10 to the last one of them all"
    docs = [(1, " ".join([versions[0], item, versions[1]])), (2, " ".join([cases.prose(1, 50), longer, cases.prose(2, 400), versions[0]])), (3, unsteady.replace("take 10", "take 11").replace("first and give 10", "first and give 12"))]
    items = spark.createDataFrame([(1, item), (2, unsteady)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert {(1, 1), (2, 1)} <= got and (3, 2) not in got


def test_decontamination_finds_every_verbatim_item(spark):
    items = {
        1: "12 + 7 = 19, 4 x 5 = 20", 2: "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan", 3: "Which Famous River Flows Through Old Paris And Rouen",
        4: "capital of Peru", 5: "小明有三个苹果，他吃了一个。还剩几个？", 6: "ฉันมีแอปเปิ้ลสามลูก", 7: "Why did Maria and Pedro leave Lima with Rosa so early", 8: "Photosynthesis",
    }
    docs = [(k, f"{cases.prose(k, 40)} {t} {cases.prose(k + 50, 40)}") for k, t in items.items()]
    docs += [(15, f"他说：{items[5]}我不知道"), (17, items[7].lower()), (18, items[7].replace(" Pedro", "\nPedro")), (20, cases.prose(7, 300)), (21, "小明有两本书，他很高兴。")]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in items} | {(15, 5), (17, 7), (18, 7)}


@pytest.mark.parametrize("name", ["documents"])
def test_decontamination_on_the_tables(spark, name):
    docs, items = spark.read.parquet(f"{cases.SF}/{name}.parquet"), spark.read.parquet(f"{cases.SF}/benchmark.parquet")
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if flat(i.text) in flat(d.text)}
    assert want <= {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}


def test_decontamination_in_long_texts(spark):
    """Items at and beside the places where a long text is cut, and in a text without spaces."""
    size = decontamination.BLOCK - decontamination.CONTEXT
    filler = cases.prose(91, 400_000)
    docs = [(k, f"{filler[: size + shift]} {ITEM} {filler[: 2 * size]}") for k, shift in enumerate((-len(ITEM) - 40, -60, -20, -8, -2, 0, 5))]
    docs += [(20, filler[: 3 * size]), (21, "长" * 400_000 + "小明有三个苹果，他吃了一个。还剩几个？" + "长" * 9)]
    items = spark.createDataFrame([(7, ITEM), (8, "小明有三个苹果，他吃了一个。还剩几个？")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(k, 7) for k in range(7)} | {(21, 8)}
    assert len(decontamination._parts([docs[3][1].encode()])[0]) == len(re.findall(r"[^\W_]+", docs[3][1]))


def test_components_of_edges_that_change(spark):
    """Each evaluation of these edges gives another tree; all connect the same nodes."""

    def tree(batches):
        for rows in batches:
            a = rows["id"].to_numpy()
            yield pd.DataFrame({"a": a, "b": np.random.default_rng().integers(0, a)})

    edges = spark.range(1, 400).mapInPandas(tree, "a long, b long")
    got = components(edges).collect()
    assert len(got) == 400 and {r.component for r in got} == {0}


def test_links_in_any_order():
    """Sets with the same shared shingles, some with more of their own; rows may arrive in any order."""
    shared = [np.arange(12, dtype=np.uint64).tobytes(), np.arange(1, 13, dtype=np.uint64).tobytes()]
    rows = pd.DataFrame([(i, 12 + i % 3, shared[i % 2]) for i in range(30)], columns=["doc_id", "size", "shared"])
    want = ngram_join._group_links(rows)
    assert len(want) == 29
    for seed in range(5):
        assert ngram_join._group_links(rows.sample(frac=1, random_state=seed)).equals(want)
