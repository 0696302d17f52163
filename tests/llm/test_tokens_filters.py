"""Pieces, the filter audit and fill-in-middle against brute force and the library."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2, sentencepiece_pb2

from quillspark.llm import fill_middle, filter_audit, pieces, queries

from . import cases

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SIGNS = "ab  ▁.éﬁⅷＡ①\n\t́　한글中😀<s></s>½\xad​\x00�1 23"


def model(rule: str | None = None, squeezed: bool = False) -> bytes:
    raw = queries.piece_model()
    if rule:
        m, n = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(raw)
        n.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        m.normalizer_spec.CopyFrom(n.normalizer_spec)
        m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = squeezed, True
        raw = m.SerializeToString()
    return raw


def spans(library, text):
    m = sentencepiece_pb2.SentencePieceText()
    m.ParseFromString(library.encode(text, out_type="serialized_proto"))
    return [(p.begin, p.end) for p in m.pieces]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", " ", "  ", "▁", "▁▁a", " a", "a ", "中" * 500, "x" * 3000, "ab " * 3000]


@pytest.mark.parametrize("rule,squeezed", [(None, False), ("nmt_nfkc", True), ("nmt_nfkc", False), ("nfkc_cf", True)])
def test_pieces_equal_the_library(rule, squeezed):
    raw = model(rule, squeezed)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Pieces(raw)
    texts = odd_texts(600)
    for text, (ids, begins, ends) in zip(texts, own.encode([t.encode() for t in texts])):
        want = library.encode(text)
        assert ids.tolist() == want, text
        assert list(zip(begins.tolist(), ends.tolist())) == spans(library, text), text
        assert own.decode(want) == library.decode(want), text


def test_any_ids_decode_as_in_the_library():
    raw, rng = model(), random.Random(5)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Pieces(raw)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 28705]) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_long_texts_go_by_in_chunks(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 200)
    monkeypatch.setattr(pieces, "CACHED", 50)
    raw = model()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Pieces(raw)
    for text in ("Tell me  more ▁ about it, " * 60, " ".join(odd_texts(80)), "a" * 900 + " " * 300 + "b" * 900):
        ids, begins, ends = own.encode([text.encode()])[0]
        assert ids.tolist() == library.encode(text) and list(zip(begins.tolist(), ends.tolist())) == spans(library, text)


def test_pieces_over_awkward_rows(spark):
    raw = model()
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    docs = cases.documents(spark).withColumn("ids", F.lit("clash"))
    out = pieces.decode(pieces.encode(docs, raw), raw).collect()
    assert len(out) == len(cases.rows()) and set(docs.columns) | {"begins", "ends", "decoded"} == set(out[0].asDict())
    for r in out:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
        assert list(zip(r.begins, r.ends)) == spans(library, r.text or "")
    assert pieces.encode(cases.empty(spark), raw).collect() == []
    with pytest.raises(ValueError):
        other = sentencepiece_model_pb2.ModelProto()
        other.ParseFromString(raw)
        other.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
        pieces.Pieces(other.SerializeToString())


@given(st.lists(st.integers(0, 400), max_size=120))
@settings(max_examples=200, deadline=None)
def test_coded_lists_give_their_values_back(steps):
    values = np.cumsum(np.array([x + 1 for x in steps], np.int64))
    width, coded = fill_middle.elias_fano(values, int(values[-1]) if len(values) else 0)
    assert fill_middle.selected(coded, len(values), width, tuple(range(len(values) + 1))) == [0, *values.tolist()]


@given(st.text(alphabet="ab \n\té中😀\x0b\x1c\xa0", max_size=60))
@settings(max_examples=300, deadline=None)
def test_unit_ends_equal_the_pattern(text):
    ends, chars = fill_middle.unit_ends(text.encode())
    assert chars == len(text) and ends.tolist() == [m.end() for m in UNIT.finditer(text)]


def filled(doc_id, text):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["copy of it <S", "<P> marked", None, "", cases.prose(k, k % 90), "一 二　三 \n" * (k % 7), "a <S", ">b <"]), k * 7) for k in range(400)]
    rows += [(k, "a hot text in many rows", 0) for k in range(1000, 1600)] + [rows[0], (None, "no id", 1), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumns({"key": F.lit("k"), "cut": F.lit(1), "Salt": F.lit(2)}).repartition(7)
    got = fill_middle.fill_middle(docs).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(i), str(t), *map(str, filled(i, t or ""))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), str(r.text), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got) == want
    assert all(r.again == (r.text or "") and (r.key, r.cut, r.Salt) == ("k", 1, 2) for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(cases.empty(spark)).collect() == []


def test_index_has_each_text_once_but_for_hot_ones(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k % 40}") for k in range(400)] + [(k, "hot") for k in range(400, 700)], "doc_id long, text string").repartition(5)
    monkeypatch.setattr(fill_middle, "HOT", 8)
    rows = docs.select("*", *fill_middle._content(F.col("text")))
    hot = fill_middle._salts(rows, "text")
    assert [(r.bytes, r.salts) for r in hot.collect()] == [(3, 4)]
    index = fill_middle.distinct_index(fill_middle._salted(rows, hot, "doc_id")).collect()
    assert len({(r.text, r.salt) for r in index}) == len(index) == 44


def audited(rows, labels):
    good, toxic = {}, {}
    for i, q, t in labels:
        good[i], toxic[i] = good.get(i, False) or q == 1, toxic.get(i, False) or t == 1
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((part or "", f, i is not None and good.get(i, False), i is not None and toxic.get(i, False)))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order, 1):
                gone = lambda f: any(f[y] for y in order[: k - 1])  # noqa: E731, B023
                removed = [d for d in own if d[1][x] and not gone(d[1])]
                shapley[part, x] = shapley.get((part, x), 0) + len(removed)
                out[part, "".join(order), k] = (
                    sum(not gone(d[1]) and not d[1][x] for d in own), len(removed), sum(d[1][x] and gone(d[1]) for d in own),
                    sum(d[1][x] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    long = cases.prose(9, 260)
    texts = [None, "", "A B", long, long + " #", "X" * 30 + " " + long, "w " * 300, cases.prose(8, 230), "copy", "| " + "w " * 220]
    rows = [(rng.choice([None, k, k, k, 7]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for k in range(300)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 300, 3)] + [(3, 1, 1), (None, 1, 1), (7, 1, 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, part string").repartition(5)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    index = filter_audit.bitmap_index(filter_audit.with_labels(filter_audit.with_copies(filter_audit.measured(docs)), table))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(index).collect()}
    assert got == audited(rows, labels)
    empty = filter_audit.with_labels(filter_audit.with_copies(filter_audit.measured(docs.limit(0))), table.limit(0))
    assert filter_audit.audit(filter_audit.bitmap_index(empty)).collect() == []


def test_index_counts_are_bits(spark):
    rows = spark.createDataFrame([("p", k % 2 == 0, k % 3 == 0, k % 5 == 0, False) for k in range(100)] + [("q", True, True, False, True)], "part string, A boolean, B boolean, good boolean, toxic boolean")
    index = filter_audit.bitmap_index(rows.coalesce(1), "AB")
    assert sorted((r.part, r.n, len(r.A)) for r in index.collect()) == [("p", 100, 13), ("q", 1, 1)]
    left = {(r.part, r.failed): r.n for r in filter_audit.left_by_set(index, "AB").collect()}
    assert left == {("p", 0): 100, ("p", 1): 50, ("p", 2): 66, ("p", 3): 33, ("q", 0): 1, ("q", 1): 0, ("q", 2): 0, ("q", 3): 0}
