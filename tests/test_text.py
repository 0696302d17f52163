"""Cleanup, speech rules, sentences, blocks and scripts."""

from __future__ import annotations

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import navigation, store
from quillspark.operators.segment import sentences
from quillspark.operators.text_blocks import text_blocks, titles
from quillspark.plans import script
from quillspark.queries import cases, spliced
from quillspark.plans.settings import Settings, needs_rebuild


def mapped(spark, f, values):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in frame.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_speech_rules(spark):
    pairs = [*cases.SPOKEN, *spliced.PAIRS["speech_cases"]]
    assert mapped(spark, T.expand_for_speech, [a if a != "PO" else "PO now" for a, _ in pairs]) == [b if b != "by mouth" else "by mouth now" for _, b in pairs]


def test_speech_gate_leaves_nothing_out(spark):
    """The look that saves most sentences the chain of rules: with and without it the result is the same."""
    rng = random.Random(4)
    parts = ["mg", "/", "dL", "5", "µg", "kg", "95", "%", "CI", "p", "<", "=", "et al.", "e.g.", "i.e.", "vs", "cf.", "etc", "viz", "approx", "Fig.", "Dr.", "Prof.", "U.S.", "U.K.", "phase", "II", "type", "iv",
             "x", "word", "–", "-", "~", "±", "×", "and", "or", "QoL", "NaCl", "mmHg", "cmH2O", "HbA1c", "RCT", "suppl.", "No.", "sect.", "°", "C", "α", "κ", "χ2", "Δ", "μ", "ca.", "beats/min", "mEq/L", "eGFR", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]

    def bare(c):
        for pattern, to, flags in (*T.UNITS, *T.STATS, *T.MEDICAL, *T.GENERAL, *T.SYMBOLS):
            c = T._replace(c, pattern.replace("{m}", "[µμ]"), to, "i" in flags)
        for number, word in T.ROMAN:
            c = T._replace(c, rf"\b(phase|grade|class|stage|type|factor|trial)\s+{number}\b", f"$1 {word}")
        return T._replace(T._replace(c, r"\s{2,}", " "), r"\s+([,;:.!?])", "$1")

    assert mapped(spark, T.expand_for_speech, texts) == [x.strip() for x in mapped(spark, bare, texts)]


def test_composition(spark):
    """Letters and marks in any order that is already canonical: as the standard library composes them."""
    rng = random.Random(5)
    texts = []
    for _ in range(2000):
        chars = [rng.choice("aeoucnsEOUαиﬁ x1") + "".join(rng.sample("\u0300\u0301\u0308\u030a\u0327\u030c", rng.randint(0, 2))) for _ in range(4)]
        texts.append(unicodedata.normalize("NFD", "".join(chars)))
    assert mapped(spark, T.composed, texts) == [unicodedata.normalize("NFC", x) for x in texts]

def test_normalize(spark):
    got = mapped(spark, T.normalize, ["Ko ¨ tter", "ﬁne “quotes” – a…", "soft­hyphen x", None, "  a \n b  ", "5 − 3"])
    assert got == ["Kötter", 'fine "quotes", a...', "softhyphen x", "", "a b", "5 - 3"]


def test_citations_and_addresses(spark):
    clean = lambda c: T.strip_citations(T.strip_addresses(c))
    got = mapped(spark, clean, [
        "It works [12, 15] well (Smith et al., 2019).", "Kept (p = 0.03) and (95% CI 1.2–3.4).", "See https://x.org/a?b=1 or me@x.org, doi:10.1000/xyz12 now.",
        "A phrase (in ordinary words from 1999 onwards here) stays.", "Shown before, Jones and Brown (2004).",
    ])
    assert got == ["It works well.", "Kept (p = 0.03) and (95% CI 1.2–3.4).", got[2], "A phrase (in ordinary words from 1999 onwards here) stays.", "Shown before."]
    assert "http" not in got[2] and "@" not in got[2] and "10.1000" not in got[2]


@pytest.mark.parametrize("text,kind,reason", [
    ("ab", "para", "short"), ("12.3 | 4", "para", "numbers"), ("Received: 3 May", "para", "front_matter"), ("Open Access this is it", "para", "licence"),
    ("a1111111111 of text here", "para", "repeated"), ("Axis label", "para", "fragment"), ("conv3 x 28×28 ×2 ×4 3×3, 128", "para", "few_words"),
    ("pool pool pool", "heading", "one_word"), ("method top-1 top-5 err", "heading", "numbered_heading"),
])
def test_noise(spark, text, kind, reason):
    frame = spark.createDataFrame([(text, kind)], "t string, k string")
    assert frame.select(T.noise_reasons(F.col("t"), F.col("k"))[reason]).head()[0]
    assert not spark.createDataFrame([("A sentence of prose that ends well.", "para")], "t string, k string").select(T.is_noise(F.col("t"), F.col("k"))).head()[0]


def split(spark, texts, limit=300):
    return mapped(spark, lambda c: sentences(c, limit), texts)


def test_sentences(spark):
    assert ["|".join(x) for x in split(spark, [a for a, _ in cases.SPLIT])] == [b for _, b in cases.SPLIT]
    long = "one two three four five six seven eight nine ten eleven twelve; " + "and then a good many more words follow here without any stop at all"
    got = split(spark, [long, None, "We saw a rise, which held for long enough to be told apart from the noise of it all"], 60)
    assert got[1] == [] and all(len(x) <= 60 for x in got[0] + got[2]) and got[2][0] == "We saw a rise, which held for"
    assert split(spark, [long], 120)[0][0].endswith(";")


def test_sentences_keep_all_text(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aB.!? ,;:-'\"()1\n") for _ in range(rng.randint(0, 400))) for _ in range(800)] + [x * 40 for x in ("ab, ", "a ", "Ab. ", "; ", "word; word, ")]
    for text, pieces in zip(texts, split(spark, texts, 60)):
        assert "".join("".join(pieces).split()) == "".join(text.split()) and all(0 < len(p) <= 60 for p in pieces), text


MARKDOWN = "# Title\n\nIntro line\nmore text\n\nHead\n===\n\n- item one\n  goes on\n- item two\n\nTable 1. Cap\nAfter\n\nMETHODS HERE\n\nPara with hyph-\nenation.\n***\n1. first\n\nResults\n\nlast"


def test_text_blocks(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.type, r.text, r.level) for r in text_blocks(docs).orderBy("ord").collect()]
    assert got == [
        ("heading", "Title", 1), ("para", "Intro line more text", None), ("heading", "Head", 1), ("para", "• item one goes on", None), ("para", "• item two", None),
        ("caption", "Table 1. Cap", None), ("para", "After", None), ("heading", "METHODS HERE", 2), ("para", "Para with hyphenation.", None), ("para", "• first", None),
        ("heading", "Results", 2), ("para", "last", None),
    ]
    assert [r.title for r in titles(text_blocks(docs)).collect()] == ["Title"]


REFERENCE = "Smith, AB. A study of things. Lancet 2019; 12: 33-40."


def test_zones(spark):
    blocks = [("heading", "Introduction"), ("para", "Body text of the work."), *[("para", REFERENCE)] * 4, ("heading", "Appendix tables"), ("para", "More.")]
    frame = spark.createDataFrame([(1, k, t, x) for k, (t, x) in enumerate(blocks)], "doc_id long, ord int, type string, text string")
    got = [r.zone for r in script.zone_blocks(frame).orderBy("block_idx").collect()]
    assert got == ["body", "body", "references", "references", "references", "references", "backmatter", "backmatter"]
    other = spark.createDataFrame([(1, 0, "heading", "One"), (1, 1, "para", "Text."), (1, 2, "heading", "References"), (1, 3, "para", "x y z.")], frame.schema)
    assert [r.zone for r in script.zone_blocks(other).orderBy("block_idx").collect()] == ["body", "body", "references", "references"]


def test_script_and_navigation(spark):
    docs = spark.createDataFrame([(1, "# A first heading\n\nHere is one sentence. Here is another one.\n\nReferences\n\nSmith wrote a book once.")], "doc_id long, text string")
    s = script.build_sentences(script.zone_blocks(text_blocks(docs))).cache()
    rows = s.orderBy("i").collect()
    assert [r.skip for r in rows] == [False, False, False, True, True] and [r.pause_before for r in rows] == [550, 0, 0, 550, 0]
    stats = script.script_stats(s).head()
    assert (stats.words, stats.sentences, stats.playable, stats.minutes) == (11, 5, 3, 1)
    near = {r.i: (r.next_playable, r.previous_playable) for r in navigation.neighbours(s).collect()}
    assert near[0] == (1, None) and near[3] == (None, 2)
    assert [r.title for r in script.outline(script.zone_blocks(text_blocks(docs))).orderBy("ord").collect()] == ["A first heading", "References"]
    kept = script.build_sentences(script.zone_blocks(text_blocks(docs)), Settings(skip_references=False))
    assert kept.filter("skip").count() == 0
    assert navigation.audio_plan(s).count() == 3 and navigation.audio_plan(s, navigation.audio_plan(s)).count() == 0


def test_script_hash(spark):
    def fnv(x):
        h = 2166136261
        for c in x:
            h = ((h ^ ord(c)) * 16777619) % 2**32
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out

    values = ["", "a", "hello", "é·—"]
    assert mapped(spark, navigation.script_hash, values) == [fnv(v) for v in values]


def test_store(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "doc_id long, v string")
    assert sorted(map(tuple, store.upsert(a, b).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert [tuple(r) for r in store.remove({"docs": a}, b)["docs"].collect()] == [(1, "x")]
    assert needs_rebuild(Settings(), Settings(skip_tables=False)) and not needs_rebuild(Settings(), Settings())


def test_long_sentences_are_cut_in_stretches(spark):
    """All words stay in order, whatever stands at the end of a stretch; a long sentence takes time by its length."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.choice([1, 3, 7, 7, 9, 12]))) + rng.choice(["", "", "", ",", ";"]) for _ in range(160_000)]
    texts = [" ".join(words[a : a + 400 + a % 7]) for a in range(0, 4000, 400)] + ["x" * 2500 + " " + " ".join(words[:300]) + " " + "y" * 990, " ".join(words)]
    began = time.monotonic()
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1).select("id", sentences(F.col("text"), 60).alias("s")).collect()
    assert time.monotonic() - began < 60
    for r in got:
        assert "".join(r.s).replace(" ", "") == texts[r.id].replace(" ", "") and max(map(len, r.s)) <= 60 and all(x == x.strip() != "" for x in r.s)
        assert r.id == 10 or " ".join(r.s) == texts[r.id]
    short = spark.createDataFrame([(texts[0],)], "text string").select(sentences(F.col("text"), 60).alias("s")).head().s
    assert [x for r in got if r.id == 11 for x in r.s][: len(short) - 2] == short[:-2]
