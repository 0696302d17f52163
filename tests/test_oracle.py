"""Queries against their SQL, on rows that small tables lack."""

from __future__ import annotations

import duckdb
import pytest

from quillspark.queries import ORACLE, QUERIES

_DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def same(spark, tmp_path):
    """Writes a table and compares the rows of queries with those of their SQL."""

    def compare(table: str, schema: str, rows: list[tuple], *names: str) -> dict[str, list[tuple]]:
        path = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
        con, out = duckdb.connect(), {}
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        for name in names:
            df = QUERIES[name](spark, str(tmp_path))
            read = con.execute(ORACLE[name])
            assert [c[0] for c in read.description] == df.columns, name
            out[name] = sorted(map(tuple, df.collect()), key=repr)
            assert out[name] == sorted(read.fetchall(), key=repr), name
        return out

    return compare


def documents(*texts: str) -> list[tuple]:
    return [(k, text, "en", "web", len(text or "")) for k, text in enumerate(texts)]


def test_numbers_of_one_digit_are_noise(same):
    rows = [(1, 1, 111111, 7, 30.0, 0.05, "A"), (1, 3, 111111, 7, 30.0, 0.01, "A"), (2, 3, 111112, 7, 30.0, 0.01, "R")]
    out = same("lineitem", "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_tax double, l_returnflag string", rows, "heading_noise")
    assert [r[-1] for r in out["heading_noise"]] == [2, 0]


def test_texts_of_all_kinds_of_lines_are_cut_as_in_sql(same):
    wrapped = "\n".join(["words that fill the whole of a line up to where it ends, with co-"] * 7 + ["the last one ends early here."] + ["and some more of the words that fill a line up to where it ends"] * 3)
    texts = [
        "4957227693675278 Things, in one line. 27.47.164.207", "4957227693675278 ends as a sentence.", "SHORT CAPITALS", "x\n\nMethods\n\ny", None, "", " \n\t", wrapped, wrapped + "\n\n" + wrapped,
        "# A # \n\n### B\nopen\n====\nmore\n----\n  text\n***\n- item\n  goes on-\n  wards\nno more\n1. one\n2) two\r\nFigure 3. Seen\n    table 2\r\u00a0 - \u00a0in", "====\n\n----", "\n\n====\n", "a\nb\n===",
        "- - -\nfoo-\nbar foo-\nBar\n\n   12. indented item\n\n  3 Lines\n\n#no heading\n\n####### seven", "x-\n-\ny", "* * *\n_ _ _\n-*-\n\u2022 dot",
    ]
    kinds = {(r[2], r[4]) for r in same("documents", _DOCUMENT, documents(*texts), "blocks")["blocks"]}
    assert kinds == {("heading", 1), ("heading", 2), ("para", None), ("caption", None)}


def test_references_without_a_semicolon_are_told(same):
    titles = ["a &amp;&amp; b &lt;c&gt and&amp", "&amp;lt; d &quot;e&quot &middot f", "cut &am", "One title | Site name"]
    rows = [(k, f"https://x.org/{k}", f"<html><head><title>{t}</title></head><body><p>Words of it.</p></body></html>") for k, t in enumerate(titles)]
    out = same("pages", "page_id long, url string, html string", rows, "html_title")
    assert [r[1] for r in out["html_title"]] == ["a && b <c> and&", '&lt; d "e" · f', "cut &am", "One title"]


def test_titles_that_are_noise_hold_no_words(same):
    texts = ["one ray at"] * 5 + ["ater ater ater"] + ["x"] * 8 + ["nll rst tld"] + ["x"] * 8 + ["and lllllll too"] + ["x"] * 8 + ["plain words here"] + ["x"] * 8 + ["about the authors"] + ["x"] * 8 + ["open access text"]
    words = {r[0]: r[3] for r in same("documents", _DOCUMENT, documents(*texts), "library_cases")["library_cases"] if r[2] == "TXT"}
    assert words == {5: 36, 14: 36, 23: 36, 32: 39, 41: 0, 50: 36}


def spliced(*words: str) -> list[tuple]:
    """Documents of 17 units, some words in place of the first three of a unit."""
    usual = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(12 * 17)]
    return documents(*[" ".join([*usual[: 12 * at], *w.split(), *usual[12 * at + 3 :]]) for at, w in ((int(x.split(":")[0]), x.split(":")[1]) for x in words)])


def test_headings_that_are_noise_are_not_in_outlines(same):
    out = same("documents", _DOCUMENT, spliced("0:nrarall rrrrrr llrres", "4:more more more", "1:nrarall rrrrrr llrres"), "spliced_outline")["spliced_outline"]
    assert [[r[2].split()[0] for r in out if r[0] == k] for k in range(3)] == [["More", "Under"], ["Part", "Under", "References"], ["Part", "More", "Under", "References"]]


def test_blocks_that_are_noise_are_skipped_and_not_counted(same):
    out = same("documents", _DOCUMENT, spliced("1:nrarall rrrrrr llrres", "8:under under under", "1:nrarall rrrrr llrres"), "spliced_script", "spliced_stats")
    assert [sum(r[8] for r in out["spliced_script"] if r[0] == k and r[4] == "body") for k in range(3)] == [3, 3, 2]
    assert len({r[1] for r in out["spliced_stats"]}) == 3


def test_paragraphs_with_a_letter_again_and_again_are_skipped(same):
    out = same("documents", _DOCUMENT, documents("osado osado llllll", "osado lllll here"), "script_cases")["script_cases"]
    assert [r[1] for r in out if r[0] == 0 and r[7]] == [1, 10, 11, 12, 13, 2, 8, 9] and [r[1] for r in out if r[0] == 1 and r[7]] == [10, 11, 12, 13, 8, 9]
