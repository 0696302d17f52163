"""The cut of pages, on hand-built runs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import layout, page_arrays, page_cut
from quillspark.operators.page_lines import _gathered, page_lines, page_regions

from . import page_reference

WIDTH, HEIGHT = 567.0, 756.0
SCHEMA = "doc_id string, page int, ord int, text string, x0 double, x1 double, top double, bot double, base double, size double, bold boolean"
PROSE = [
    "the first of the lines that fill a column whole", "goes on with some more words up to its very end", "and so does the third one which is as long too",
    "while the fourth says nothing new about anything", "but keeps the measure as all the others have it", "until the column comes to its end right here",
]


def run(text, x0, base, size=10.0, width=None):
    width = len(text) * size * 0.42 if width is None else width
    return (text, float(x0), float(x0 + width), base - 0.86 * size, base + 0.26 * size, float(base), float(size))


def column(x0, base, texts, size=10.0, pitch=12.0, measure=198.0):
    """Lines as one run each: all but the last fill the measure."""
    full = [run(t, x0, base + pitch * i, size, measure) for i, t in enumerate(texts[:-1])]
    return [*full, run(texts[-1], x0, base + pitch * (len(texts) - 1), size, min(measure, len(texts[-1]) * size * 0.42))]


def placed(spark, *pages):
    rows = [("d", p, k, *a, False) for p, atoms in enumerate(pages, 1) for k, a in enumerate(atoms)]
    geometry = spark.createDataFrame([("d", p, WIDTH, HEIGHT) for p in range(1, len(pages) + 1)], "doc_id string, page int, width double, height double")
    return spark.createDataFrame(rows, SCHEMA), geometry


def cut(spark, atoms):
    return [[a.text for a in g] for g in page_regions(*placed(spark, atoms)).head().regions]


def lines(spark, *pages):
    return page_lines(*placed(spark, *pages))


def random_page(rng):
    """Columns, notes, titles and stray runs, some of them as words and some as whole lines."""
    atoms, y = [run("first", 60, 30)], rng.uniform(60, 90)
    for _ in range(rng.randint(1, 3)):
        n, size = rng.randint(1, 3), rng.choice([8.0, 10.0, 10.0, 12.0])
        gap = rng.choice([3.0, 6.0, 9.0, 14.0])
        measure = (450 - gap * (n - 1)) / n
        rows = rng.randint(1, 9)
        for c in range(n):
            for k in range(rows - rng.choice([0, 0, 0, 1, 3])):
                base = y + 1.2 * size * k + rng.choice([0, 0, 0.3, 2.0])
                x, end = 60 + c * (measure + gap), 60 + c * (measure + gap) + measure * rng.choice([1, 1, 1, rng.uniform(0.2, 0.95)])
                if rng.random() < 0.4:
                    atoms.append(run("line", x, base, size, end - x))
                else:
                    while x < end:
                        w = min(rng.uniform(10, 40), end - x)
                        atoms.append(run(rng.choice(["word", "a", "12"]), x, base, size, w))
                        x += w + rng.choice([2.5, 2.5, 3.0, 6.0])
        if rng.random() < 0.3:
            atoms.append(run(rng.choice("AB"), 40, y + 2.4 * size, size * 2.4, 18))
        if rng.random() < 0.3:
            atoms += [run("note", 5 + rng.uniform(0, 3), y + 9.5 * k + rng.choice([0, 3]), 7, 35) for k in range(rng.randint(1, 5))]
        y += 1.2 * size * rows + rng.choice([4, 12, 30])
    rng.shuffle(atoms)
    return [(f"{k} {a[0]}" if rng.random() < 0.5 and len(a[0]) > 1 else a[0], *(round(v * 8) / 8 for v in a[1:])) for k, a in enumerate(atoms)]


def test_random_pages_are_cut_as_one_region_after_the_other(spark):
    rng = random.Random(11)
    pages = [random_page(rng) for _ in range(120)]
    got = {r.page: r.regions for r in page_regions(*placed(spark, *pages)).collect()}
    read = {}
    for r in lines(spark, *pages).orderBy("page", "ord").collect():
        read.setdefault(r.page, []).append((r.region_idx, r.text))
    several, capped = 0, 0
    for p, atoms in enumerate(pages, 1):
        numbers = np.array([a[1:] for a in atoms])
        order = np.lexsort((np.arange(len(atoms)), numbers[:, 0], numbers[:, 4]))
        want = [sorted(order[i] for i in g) for g in page_reference.regions(numbers[order], WIDTH)]
        by_place = {(a[5], a[1], a[0], a[2]): k for k, a in enumerate(atoms)}
        assert [sorted(by_place[a.base, a.x0, a.text, a.x1] for a in g) for g in got[p]] == want, p
        several += len(want) > 1
        for k, g in enumerate(want):
            g = sorted(g, key=lambda i: (numbers[i, 4], numbers[i, 0], i))  # noqa: B023
            own = numbers[g]
            caps = page_reference._drop_caps(own, [atoms[i][0] for i in g])
            capped += len(caps)
            rest = np.delete(np.arange(len(g)), list(caps))
            size = own[rest, 5]
            line = page_reference._anchored(own[rest, 4], lambda a, i: page_reference.LINE * (np.median(size[a:i]) or size[i])) if len(rest) else []  # noqa: B023
            assert len([t for i, t in read[p] if i == k]) == len(set(list(line))), (p, k)
    assert several > 60 and capped > 5


def test_columns_with_a_narrow_gutter(spark):
    other = [t.upper() for t in PROSE]
    assert cut(spark, [*column(62, 63, PROSE), *column(269, 63, other)]) == [PROSE, other]


def test_three_columns_under_a_heading(spark):
    texts = [[f"item {c}.{i} of a list" for i in range(12)] for c in range(3)]
    atoms = [a for c in range(3) for a in column(62 + 138 * c, 389, texts[c], 7.5, 9.0, 129.0)]
    assert cut(spark, [run("A heading as wide as all of the columns below it are", 65, 340, 18), *atoms])[1:] == texts


def test_footer_over_the_gutter(spark):
    foot = [run("A footer that is set over both of the columns and their gutter", 94, 141.9, 8), run("and another line of it that is long too", 134, 151.9, 8)]
    assert [len(g) for g in cut(spark, [*column(62, 63, PROSE), *column(269, 63, PROSE), *foot])] == [6, 6, 2]


def test_no_gutter_in_ragged_lines_and_word_spaces(spark):
    assert len(cut(spark, [run(t[: 30 + 3 * (i % 4)], 62, 63 + 12 * i) for i, t in enumerate(PROSE)])) == 1
    atoms = []
    for i in range(20):
        for begin, end, seed in ((62, 300, i), (307, 505, i + 3)):
            x, k = begin, 0
            while x < end - 30:
                w = min(24 + ((seed * 7 + k * 11) % 5) * 6, end - x)
                atoms.append(run("word", x, 63 + 12 * i, 10, w))
                x, k = x + w + 5, k + 1
            atoms.append(run("last", x, 63 + 12 * i, 10, max(end - x, 1)))
    assert len(cut(spark, atoms)) == 1


def test_marginal_note_and_list_markers(spark):
    note = ["A short note", "stands in", "the margin"]
    assert cut(spark, [*column(45, 92.3, note, 8, 9.5, 46), *column(100, 63, PROSE)]) == [note, PROSE]
    items = [a for i in range(6) for a in (run(f"{i + 1}.", 62, 63 + 24 * i), run("people of sixteen years of age or", 84, 63 + 24 * i), run("older than that were asked.", 84, 75 + 24 * i))]
    assert len(cut(spark, items)) == 1


def test_drop_caps(spark):
    body = [run(t, 130, 63 + 12 * i) for i, t in enumerate(["t first there was", "a word and then", "there came others", "and all was well"])]
    other = [run("A", 62, 63, 24), *column(62, 87, PROSE)]
    got = [(r.page, r.text) for r in lines(spark, [run("A", 100, 87, 47.4), *body], other).orderBy("ord").collect()]
    assert got[:4] == [(1, "At first there was"), (1, "a word and then"), (1, "there came others"), (1, "and all was well")]
    assert got[4:6] == [(2, "A"), (2, PROSE[0])]


def test_letter_spaced_heads(spark):
    texts = ["a bs tr ac t", "Me thods", "R esult s", "the results were not clear", "no findings of harm", "agents and methods used in it", "Me thods 2", "M e t h o d s and R e s u l t s"]
    got = [r.text for r in lines(spark, *[[run(t, 62, 63, 12)] for t in texts]).orderBy("ord").collect()]
    assert got == ["abstract", "Methods", "Results", *texts[3:7], "Methods and Results"]


def test_heading_from_spaced_letters(spark):
    got = layout.line_blocks(lines(spark, [run("Me thods", 62, 63, 12), *column(62, 87, PROSE)])).orderBy("ord").collect()
    assert [(r.type, r.text) for r in got] == [("heading", "Methods"), ("para", " ".join(PROSE))]


def test_marks_spaces_and_sizes(spark):
    # Names with raised marks: the marks go, the line keeps the size of the names, and wide gaps are told.
    names = [run("Ann Lee,", 62, 63, 10, 40), run("1,2", 102, 60, 6, 8), run("Bo Ray", 114, 63, 10, 30), run("Total", 200, 63, 10, 25), run("s", 225, 63, 10, 5)]
    r = lines(spark, names).head()
    assert (r.text, r.size, r.dropped_citations, r.gap_max, r.gap_at) == ("Ann Lee, Bo Ray Totals", 10.0, 1, 5.6, 144.0)
    assert (r.col_left, r.col_right, r.in_top, r.in_bot) == (62.0, 230.0, True, False)


def test_empty_and_incomplete(spark):
    none = (None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
    assert lines(spark, [none, run("  ", 10, 63), ("lost", None, 2.0, 3.0, 4.0, 5.0, 6.0)]).count() == 0
    twice = [run("same words", 62, 63), run("same words", 62, 63)]
    assert [r.text for r in lines(spark, twice).collect()] == ["same wordssame words"]


def test_rows_of_chosen_atoms_choose_them_once(spark):
    """Atoms given as an expression: a fold that names it in each step would evaluate it at every atom."""
    rows = page_cut.baseline_rows(F.filter("atoms", lambda a: a["x1"] < 60))
    text = spark.range(1).select(F.lit(None).cast(f"array<{page_cut.ATOM}>").alias("atoms")).select(rows.alias("rows"))._jdf.queryExecution().analyzed().toString()
    assert text.count("filter(atoms") == 1


def test_pages_of_a_batch_are_cut_together(spark, monkeypatch):
    """Whatever pages share a batch, each is cut as if alone; one with more atoms than a batch may have too."""
    rng = random.Random(5)
    gathered = _gathered(*placed(spark, *[random_page(rng) for _ in range(40)])).toArrow().combine_chunks().to_batches()
    told = lambda: [[r for b in part(iter(gathered)) for r in b.drop_columns(["n"] if "n" in b.schema.names else []).to_pylist()] for part in (page_arrays.line_batches, page_arrays.region_batches)]
    together = told()
    monkeypatch.setattr(page_arrays, "MOST_ATOMS", 1)
    assert together == told() and len(together[1]) == 40 < len(together[0])


def test_edges_of_a_region_are_found_once(spark):
    """A page of many lines: a line that looked for its region's edges by itself would make this quadratic."""
    page = [run("word", 60 + 30 * (k % 4), 20 + 2 * (k // 4), 2.0, 25) for k in range(40_000)]
    got = lines(spark, page).select("col_left", "col_right").distinct().collect()
    assert [tuple(r) for r in got] == [(60.0, 175.0)]
