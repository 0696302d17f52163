"""Blocks and zones found in one row against a reading line by line, and the rules that the spliced queries hit."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.speech_rules import GENERAL, MEDICAL, ROMAN, STATS, SYMBOLS, UNITS
from quillspark.operators.text_blocks import text_blocks, text_documents
from quillspark.plans import script
from quillspark.queries import spliced
from quillspark.tables import shared_dir

LINES = [
    "# Head one", "## Two ##", "plain text line", "Ends here.", "===", "---", "=-=", "", "", "", "- item", "  cont", "   - sub", "  # x", "1. num", "METHODS", "Results", "Table 1. x", "figure 2",
    "* * *", "    ===", "hyph-", "enated word", "12 Numbered head", "  ", " x", "ABCD", "====", "  Table 3 y", "Running text that goes on and is about sixty characters wide",
    "and it goes on with more words than anybody would ever like to", "Stops early. Yes.",
]


def sequential(text: str) -> list[tuple]:
    """One line after the other, with a list of open lines."""
    lines, out, held = re.sub("\r\n?", "\n", text).replace("\xa0", " ").split("\n"), [], []
    solid = [x.rstrip() for x in lines if len(x.strip()) > 20]
    mean = sum(map(len, solid)) / max(1, len(solid))
    wrapped = len(solid) >= 6 and 40 <= mean <= 110 and sum(abs(len(x) - mean) < mean * 0.22 for x in solid) / len(solid) > 0.55
    wrapped = wrapped and sum(not re.search(r"[.!?:;\"')\]]$", x) for x in solid) / len(solid) > 0.5

    def close(kind="para"):
        joined = ""
        for x in map(str.strip, held):
            cut = re.search(r"[a-zA-Z]-$", joined) and re.match("[a-z]", x)
            joined = joined[:-1] + x if cut else f"{joined} {x}" if joined else x
        if joined:
            out.append((kind, re.sub(r"\s+", " ", joined).strip(), None))
        held.clear()

    item, at = r"\s*([-*+•]|\d{1,3}[.)])\s+", 0
    while at < len(lines):
        line, t = lines[at], lines[at].strip()
        at += 1
        near = all(k < 0 or k >= len(lines) or not lines[k].strip() for k in (at - 2, at))
        if not t or re.fullmatch(r"\s*([-*_])(\s*\1){2,}\s*", line):
            close()
        elif m := re.fullmatch(r"(#{1,6})\s+(.*\S)\s*#*", t):
            close()
            out.append(("heading", m[2], 1 if len(m[1]) < 3 else 2))
        elif re.fullmatch("[=-]{3,}", t) and len(held) == 1:
            out.append(("heading", held.pop().strip(), 1 if t[0] == "=" else 2))
        elif re.match(r"(?i)(fig(ure)?\.?\s*\d|table\s*\d)", t):
            close()
            held.append(t)
            close("caption")
        elif re.match(item, line):
            close()
            held.append(re.sub(item, "• ", t, count=1))
            while at < len(lines) and lines[at].strip() and not re.match(item, lines[at]) and re.match(r"\s{2,}", lines[at]):
                held.append(lines[at].strip())
                at += 1
            close()
        elif near and len(t) <= 78 and not re.search("[.!?]$", t) and (
            re.fullmatch("[^a-z]{4,}", t) or re.match(r"\d+(\.\d+)*\.?\s+\S", t) or re.match(r"(?i)(abstract|introduction|methods?|results?|discussion|conclusions?|references?)\b", t)
        ):
            close()
            out.append(("heading", t, 2))
        else:
            held.append(line)
            if wrapped and re.search(r"[.!?][\"')\]]?\s*$", line) and len(line.rstrip()) < 62:
                close()
    close()
    return out


def test_blocks_equal_a_sequential_reading(spark):
    rng = random.Random(2)
    texts = [rng.choice(["\n", "\r\n"]).join(rng.choice(LINES) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got: dict[int, list] = {k: [] for k in range(len(texts))}
    for r in text_blocks(frame).orderBy("doc_id", "ord").collect():
        got[r.doc_id].append((r.type, r.text, r.level))
    for k, text in enumerate(texts):
        assert got[k] == sequential(text), text


def test_blocks_and_zones_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "# A\n\nb")], "doc_id long, text string")
    zoned = script.zone_documents(text_documents(docs))
    for plan in (text_blocks(docs), script.zone_blocks(text_documents(docs)), script.build_sentences(zoned), script.outline(zoned)):
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in shown and "Window" not in shown
        # The array behind a generator is computed once, not also in a filter.
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1 and "Filter (size(" not in shown


REFERENCE = "Smith, AB. A study of things. Lancet 2019; 12: 33-40."


def zones(blocks: list[tuple[str, str]]) -> list[tuple]:
    out, zone, section, opened, run = [], "body", None, False, 0
    for kind, text in blocks:
        if kind == "heading":
            if text in ("References", "Funding"):
                zone, run = "references" if text == "References" else "backmatter", 0
            elif zone == "body":
                opened = True
            else:
                zone = "backmatter"
            section = text
        elif zone == "body":
            run = run + 1 if opened and text == REFERENCE else 0
            if run >= 3:
                zone = "references"
                for back in (1, 2):
                    if len(out) < back or out[-back][0] == "heading":
                        break
                    out[-back][2] = "references"
        out.append([kind, text, zone, section])
    return out


def test_zones_equal_a_sequential_reading(spark):
    rng, docs = random.Random(7), {}
    for k in range(1200):
        docs[k] = [rng.choice([("heading", "Introduction"), ("heading", rng.choice(["References", "Funding", "Methods"])), *[("para", REFERENCE)] * 4, ("para", "Some body text."), ("caption", "Table 2")]) for _ in range(rng.randint(1, 12))]
    rows = [(k, i, *b) for k, blocks in docs.items() for i, b in enumerate(blocks)]
    frame = spark.createDataFrame(rows, "doc_id long, ord int, type string, text string").repartition(4)
    got: dict[int, list] = {k: [] for k in docs}
    for r in script.zone_blocks(frame).orderBy("doc_id", "block_idx").collect():
        got[r.doc_id].append([r.type, r.text, r.zone, r.section])
    assert got == {k: zones(v) for k, v in docs.items()}


def test_documents_without_sentences_keep_their_statistics(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "One sentence of it.")], "doc_id long, text string")
    stats = script.script_stats(script.build_sentences(script.zone_documents(text_documents(docs)), keep_empty=True))
    assert sorted(tuple(r) for r in stats.collect()) == [(1, 0, 0, 0, 1), (2, 0, 0, 0, 1), (3, 4, 1, 1, 1)]


def test_spliced_forms_hit_every_rule(spark):
    shared_dir(spark)
    rules = [(p.replace("{m}", "[µμ]"), to, "i" in f) for p, to, f in (*UNITS, *STATS, *MEDICAL, *GENERAL, *SYMBOLS)]
    rules += [(rf"\b(phase|grade|class|stage|type|factor|trial)\s+{n}\b", f"$1 {w}", False) for n, w in ROMAN]
    frame = spark.createDataFrame([(f"word and {a} then",) for a, _ in spliced.PAIRS["speech_cases"]], "t0 string")
    for k, (pattern, to, ignore_case) in enumerate(rules):
        frame = frame.withColumn(f"t{k + 1}", T._replace(F.col(f"t{k}"), pattern, to, ignore_case))
        if k % 20 == 19:
            frame = frame.checkpoint()
    row = frame.agg(*[F.max(F.col(f"t{k + 1}") != F.col(f"t{k}")) for k in range(len(rules))]).head()
    assert [rules[k][0] for k in range(len(rules)) if not row[k]] == []


def test_required_literals(spark):
    assert T.required(r"\bmg\s*/\s*d[lL]\b") == ["/"] and T.required(r"≈|≃|~(?=\s*\d)") == ["≈", "≃", "~"] and T.required(r"(\d)\s*[–—]\s*(?=\d)") == ["–", "—"]
    assert T.required(r"\b(phase|grade)\s+VIII\b") == ["VIII"] and T.required(r"(\d)\s*hr?s?\b") == ["h"]
