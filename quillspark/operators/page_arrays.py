"""The cut of pages to regions and lines, over arrays that hold the atoms of many pages.

All pages of a batch are cut at once, level by level: each open region of a level is parted by the best gutter, else by the widest
blank band, until none can be. Sorting, running maxima and counts go over all regions of a level; only the rows of atoms, each of
which is anchored to the first, are found one after the other. Work is a sort of the atoms of each level.

Atoms of a page are in the order of base, x0 and their place in the page.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.patterns import SPACES
from .page_cut import (
    BAND_EMS, BAND_PITCH, BESIDE, CAP, CAP_TEXT, GUTTER, GUTTER_PAGE, LEAST_ATOMS, LEAST_SPACE, LEAST_SPACES, LINE, MAX_DEPTH, MOST_SPACES, NARROW, NARROW_PAGE, REGION_WIDTH, ROW,
    SHARED_ROWS, SIDE_WIDTH, STRAIGHT, WORD_SPACES,
)

NUMBERS = ("base", "x0", "x1", "top", "bot", "size")
#: Raised marks, spaces and margins, in ems and shares of the page's height.
RAISED, SMALL_RUN, SPACE_EMS, MARGIN = 0.14, 0.80, 0.20, 0.075
#: Words of headings, which may arrive letter by letter.
HEAD_WORDS = frozenset((
    "abstract summary background introduction objective objectives method methods materials design participants patients randomization "
    "randomisation intervention interventions outcome outcomes statistical analysis result results finding findings discussion conclusion "
    "conclusions limitation limitations implications reference references bibliography acknowledgment acknowledgments acknowledgement "
    "acknowledgements funding appendix keyword keywords highlights supplementary"
).split())
BEGUN = frozenset(word[:n] for word in HEAD_WORDS for n in range(1, len(word) + 1))
WHITE, MARKS = re.compile(f"[{re.escape(SPACES)}]+"), re.compile(f"[0-9{re.escape(SPACES)},;.–—*†‡-]+")
UNSHAPED = re.compile(r"[0-9]|[.!?]\Z")
#: This many atoms at a time are cut, or a page that has more.
MOST_ATOMS = 200_000


def _offsets(g: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)


def _medians(values: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each group (at: where it begins) the mean of the middle pair."""
    s, n = values[np.lexsort((values, g))], np.diff(np.r_[at, len(values)])
    return (s[at + (n - 1) // 2] + s[at + n // 2]) / 2


def _or_ten(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, 10.0)


def _channels(low: np.ndarray, high: np.ndarray, g: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, before and after of the uncovered stretches of at least the group's width; groups are numbered from 0 in order."""
    order = np.lexsort((high, low, g))
    low, high = low[order], high[order]
    levels, rank = np.unique(high, return_inverse=True)
    reach = levels[np.maximum.accumulate(g * len(levels) + rank) - g * len(levels)][:-1]
    free = low[1:] - reach
    found = np.flatnonzero((g[1:] == g[:-1]) & (low[1:] > reach) & (free >= least[g[1:]]))
    return g[1:][found], reach[found], low[1:][found]


def _rows(base: np.ndarray, size: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Number of the row of each atom: a row takes atoms whose baseline is near that of its first."""
    near, new = ROW * _or_ten(size), np.zeros(len(g), bool)
    # An atom like the one before it stays in its row.
    told = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (base[1:] != base[:-1]) | (near[1:] != near[:-1])])
    starts, group, first = [], None, 0.0
    for i, k, b, n in zip(told.tolist(), g[told].tolist(), base[told].tolist(), near[told].tolist()):
        if k != group or b - first > n:
            starts.append(i)
            group, first = k, b
    new[starts] = True
    return np.cumsum(new) - 1


def _spaces(x0: np.ndarray, x1: np.ndarray, base: np.ndarray, row: np.ndarray, g: np.ndarray, gaps: tuple[np.ndarray, ...], groups: int) -> np.ndarray:
    """The usual space between words of each group, but for those across its gaps; 0 where these are too few."""
    order = np.lexsort((base, x0, row))
    r, of = row[order], g[order][1:]
    a, b = x1[order][:-1], x0[order][1:]
    kept = np.flatnonzero((r[1:] == r[:-1]) & (b - a > LEAST_SPACE))
    a, b, of = a[kept], b[kept], of[kept]
    if len(a):
        gap, before, after = gaps
        levels, rank = np.unique(np.r_[after, a], return_inverse=True)
        # The first gap of the group that ends after the space begins.
        at = np.searchsorted(gap * len(levels) + rank[: len(gap)], of * len(levels) + rank[len(gap) :], side="right")
        on = np.minimum(at, len(gap) - 1)
        clear = ~((at < len(gap)) & (gap[on] == of) & (before[on] < b))
        a, b, of = a[clear], b[clear], of[clear]
    space, n = b - a, np.bincount(of, minlength=groups)
    rows = np.bincount(g[_offsets(row)], minlength=groups)
    sorted_spaces, ends = space[np.lexsort((space, of))], np.cumsum(n)
    out, enough = np.zeros(groups), n >= np.maximum(LEAST_SPACES, 2 * rows)
    out[enough] = sorted_spaces[(ends - n + np.floor(n * MOST_SPACES).astype(int))[enough]]
    return out


def _shared(base: np.ndarray, near: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether each row shares its baseline with one of the other half (2 c and 2 c + 1 are halves of one cut)."""
    order = np.lexsort((base, half // 2))
    b, h, n, place = base[order], half[order], near[order], np.arange(len(base))
    found = np.zeros(len(base), bool)
    for side in (0, 1):
        theirs = h % 2 == side
        before = np.maximum.accumulate(np.where(theirs, place, -1))
        after = np.minimum.accumulate(np.where(theirs, place, len(base))[::-1])[::-1]
        for other, there in ((before, before >= 0), (after, after < len(base))):
            o = np.where(there, other, 0)
            found |= ~theirs & there & (h[o] // 2 == h // 2) & (np.abs(b[o] - b) <= n)
    out = np.zeros(len(base), bool)
    out[order] = found
    return out


def _judged(v: dict[str, np.ndarray], cut: np.ndarray, gap: tuple[np.ndarray, ...], em: np.ndarray, page_width: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one gap of each cut whether it is a gutter, and how far both sides stand beside each other. ``cut`` numbers the cut of
    each atom from 0; a cut has before, after, em, page_width and space."""
    before, after = gap
    middle = before + (after - before) / 2
    order = np.argsort(cut * 2 + (v["x1"] > middle[cut]), kind="stable")
    half = (cut * 2 + (v["x1"] > middle[cut]))[order]
    n = np.bincount(half, minlength=2 * len(before))
    # Cuts with a side of too few atoms are none.
    usable = (n[0::2] >= LEAST_ATOMS) & (n[1::2] >= LEAST_ATOMS)
    ok, score = np.zeros(len(before), bool), np.zeros(len(before))
    if not usable.any():
        return ok, score
    kept = usable[half // 2]
    order, number = order[kept], np.cumsum(usable) - 1
    half = number[half[kept] // 2] * 2 + half[kept] % 2
    before, after, em, page_width, space = (x[usable] for x in (before, after, em, page_width, space))
    x0, x1, base, size = (v[k][order] for k in ("x0", "x1", "base", "size"))
    at = _offsets(half)
    top, bot = np.minimum.reduceat(v["top"][order], at), np.maximum.reduceat(v["bot"][order], at)
    width = np.maximum.reduceat(x1, at) - np.minimum.reduceat(x0, at)
    row = _rows(base, size, half)
    starts = _offsets(row)
    of, line, begin, end = half[starts], base[starts], np.minimum.reduceat(x0, starts), np.maximum.reduceat(x1, starts)
    near = ROW * _or_ten(_medians(size, row, starts))
    count = lambda test: np.bincount(of, weights=test, minlength=len(at))
    rows = np.bincount(of, minlength=len(at))
    alone = (width >= np.repeat(SIDE_WIDTH * page_width, 2)) | (count(_shared(line, near, of)) / rows < SHARED_ROWS)
    within = count((line >= top[of ^ 1]) & (line <= bot[of ^ 1]))
    beside = np.where(rows[0::2] <= rows[1::2], within[0::2], within[1::2])
    edge = np.where(of % 2 == 0, np.abs(end - before[of // 2]), np.abs(begin - after[of // 2]))
    straight = count(edge <= np.maximum(1.5, 0.2 * em)[of // 2]) / rows >= STRAIGHT
    free = after - before
    earned = (free >= np.maximum(NARROW * em, NARROW_PAGE * page_width)) & ((space <= 0) | (free >= WORD_SPACES * space)) & (beside >= BESIDE)
    ok[usable] = alone[0::2] & alone[1::2] & ((free >= np.maximum(GUTTER * em, GUTTER_PAGE * page_width)) | (earned & (straight[0::2] | straight[1::2])))
    score[usable] = np.minimum(bot[0::2], bot[1::2]) - np.maximum(top[0::2], top[1::2])
    return ok, score


def _gutters(v: dict[str, np.ndarray], g: np.ndarray, em: np.ndarray, page_width: np.ndarray) -> np.ndarray:
    """Where the gutter of each region is that parts most text (middle of it), NaN without one."""
    at, best = _offsets(g), np.full(len(em), np.nan)
    wide = np.maximum.reduceat(v["x1"], at) - np.minimum.reduceat(v["x0"], at) >= REGION_WIDTH * page_width
    gap, before, after = _channels(v["x0"], v["x1"], g, np.where(wide, np.maximum(NARROW * em, NARROW_PAGE * page_width), np.inf))
    if not len(gap):
        return best
    # From here on only the regions with gaps, numbered anew.
    having = np.unique(gap)
    number = np.full(len(em), -1)
    number[having] = np.arange(len(having))
    kept = np.flatnonzero(number[g] >= 0)
    v, g, gap, em, page_width = {k: x[kept] for k, x in v.items()}, number[g[kept]], number[gap], em[having], page_width[having]
    space = _spaces(v["x0"], v["x1"], v["base"], _rows(v["base"], v["size"], g), g, (gap, before, after), len(having))
    first, n = _offsets(gap), np.bincount(gap)
    most, width, found = np.full(len(having), -np.inf), np.zeros(len(having)), np.full(len(having), np.nan)
    for i in range(n.max()):
        # The i-th gap of each region that has one.
        mine = np.flatnonzero(n > i)
        cut = np.full(len(having), -1)
        cut[mine] = np.arange(len(mine))
        own = np.flatnonzero(cut[g] >= 0)
        a, b = before[first[mine] + i], after[first[mine] + i]
        ok, score = _judged({k: x[own] for k, x in v.items()}, cut[g[own]], (a, b), em[mine], page_width[mine], space[mine])
        better = ok & ((score > most[mine]) | (np.isnan(found[mine]) | ((score == most[mine]) & (b - a > width[mine]))))
        at = mine[better]
        most[at], width[at], found[at] = score[better], (b - a)[better], (a + (b - a) / 2)[better]
    best[having] = found
    return best


def _bands(v: dict[str, np.ndarray], g: np.ndarray, em: np.ndarray) -> np.ndarray:
    """Where the widest blank band of each region is that exceeds its own leading (middle of it), NaN without one."""
    points, out, pitch = np.floor(v["base"] + 0.5), np.full(len(em), np.nan), np.zeros(len(em))
    at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (points[1:] != points[:-1])])
    of, points = g[at], points[at]
    step = np.flatnonzero((of[1:] == of[:-1]) & (np.bincount(of, minlength=len(em)) >= 3)[of[1:]])
    if len(step):
        steps, of = (points[1:] - points[:-1])[step], of[1:][step]
        pitch[of[_offsets(of)]] = _medians(steps, of, _offsets(of))
    gap, before, after = _channels(v["top"], v["bot"], g, np.where(pitch > 0, BAND_PITCH * pitch, BAND_EMS * em))
    if len(gap):
        # Of equally wide ones the first.
        order = np.lexsort((-np.arange(len(gap)), after - before, gap))
        last = order[np.r_[gap[order][1:] != gap[order][:-1], True]]
        out[gap[last]] = before[last] + (after[last] - before[last]) / 2
    return out


def cut_regions(v: dict[str, np.ndarray], page: np.ndarray, page_width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Atoms in the reading order of their regions, and the number of the region of each; ``page`` numbers pages from 0."""
    order, region, done = np.arange(len(page)), page, np.zeros(len(page_width), bool)
    widths = page_width
    for _ in range(MAX_DEPTH):
        done = done | (np.bincount(region, minlength=len(done)) < LEAST_ATOMS)
        if done.all():
            break
        here = np.flatnonzero(~done[region])
        own = {k: x[order[here]] for k, x in v.items()}
        number = np.cumsum(~done) - 1
        g, w = number[region[here]], widths[~done]
        em = _or_ten(_medians(own["size"], g, _offsets(g)))
        at = _gutters(own, g, em, w)
        below = np.isnan(at)
        right = own["x1"] > at[g]
        if below.any():
            low = np.flatnonzero(below[g])
            again = np.cumsum(below) - 1
            band = _bands({k: x[low] for k, x in own.items()}, again[g[low]], em[below])
            right[low] = own["bot"][low] > band[again[g[low]]]
        # Without a cut, or with all atoms on one side of it, a region is done; a gutter has atoms on both sides.
        n, n_right = np.bincount(g), np.bincount(g, weights=right)
        parted = (n_right > 0) & (n_right < n)
        side = np.zeros(len(order), int)
        side[here] = right & parted[g]
        now_done = done.copy()
        now_done[np.flatnonzero(~done)[~parted]] = True
        key = region * 2 + side
        again = np.argsort(key, kind="stable")
        order, key = order[again], key[again]
        at = _offsets(key)
        done, widths, region = now_done[key[at] // 2], widths[key[at] // 2], np.cumsum(np.r_[False, key[1:] != key[:-1]])
    return order, region


def _trimmed(text: str) -> str:
    return text.strip(SPACES)


def _caps(v: dict[str, np.ndarray], texts: list[str], region: np.ndarray) -> tuple[np.ndarray, dict[int, str]]:
    """Which atoms are drop caps, and their texts by the atoms that they begin; atoms in the order of regions."""
    at, caps, begun = _offsets(region), np.zeros(len(region), bool), {}
    large = _or_ten(_medians(v["size"], region, at))
    for c in np.flatnonzero(v["size"] >= CAP * large[region]).tolist():
        text = _trimmed(texts[c])
        if len(text) > 2:
            continue
        a = at[region[c]]
        b = at[region[c] + 1] if region[c] + 1 < len(at) else len(region)
        base, size, x0 = (v[k][a:b] for k in ("base", "size", "x0"))
        wraps = (size < CAP_TEXT * v["size"][c]) & (base > v["top"][c]) & (base < v["base"][c] - 0.5 * size) & (x0 >= v["x1"][c] - 1) & (x0 <= v["x1"][c] + v["size"][c])
        if wraps.any():
            # The highest, and of those on one baseline the first.
            caps[c] = True
            begun[int(a + np.argmax(wraps))] = text
    return caps, begun


def _lines(base: np.ndarray, size: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Number of the line of each atom: a line takes atoms whose baseline is near that of its first, by the usual size of those that
    it has."""
    new, starts = np.zeros(len(base), bool), []
    sizes, group, first, seen, sorted_sizes = size.tolist(), None, 0.0, 0, []
    for i, (k, b) in enumerate(zip(region.tolist(), base.tolist())):
        if k == group:
            if b == first:
                continue
            for s in sizes[seen:i]:
                insort(sorted_sizes, s)
            seen, n = i, len(sorted_sizes)
            usual = (sorted_sizes[(n - 1) // 2] + sorted_sizes[n // 2]) / 2
            if b - first <= LINE * (usual if usual > 0 else sizes[i]):
                continue
        starts.append(i)
        group, first, seen, sorted_sizes = k, b, i, []
    new[starts] = True
    return np.cumsum(new) - 1


def rejoined(text: str) -> str:
    """Join the pieces of a letter-spaced heading, where these spell a word of headings."""
    if len(text) > 60 or " " not in text or UNSHAPED.search(text):
        return text
    tokens, out, i = text.split(" "), [], 0
    while i < len(tokens):
        piece, longest = tokens[i].lower(), 0
        for k in range(1, min(8, len(tokens) - 1 - i) + 1):
            if piece not in BEGUN:
                break
            piece += tokens[i + k].lower()
            if piece in HEAD_WORDS:
                longest = k
        out.append("".join(tokens[i : i + longest + 1]))
        i += longest + 1
    return " ".join(out)


def _size(runs: list[tuple]) -> float:
    """The size, in halves, that most characters of the line are set in; the first seen of equal ones."""
    weights: dict[float, int] = {}
    for size, text in runs:
        weights[size] = weights.get(size, 0) + max(len(_trimmed(text)), 1)
    size = max(weights, key=weights.get)
    return size if size > 0 else 10.0


def _text(runs: list[tuple], prefix: str, base: float, size: float) -> tuple[str, float, float, int]:
    """The text of runs (text, x0, x1, base, size), the widest space and its place, and the number of raised citation marks left out."""
    out, end, widest, widest_at, marks = prefix, None, 0.0, 0.0, 0
    for text, x0, x1, b, s in runs:
        if b < base - RAISED * size and s < SMALL_RUN * size and MARKS.fullmatch(text):
            marks += 1
        else:
            gap = x0 - (x0 if end is None else end) if out else 0.0
            if gap > SPACE_EMS * size and not (out and out[-1] in SPACES) and text[0] not in SPACES:
                out += " "
            out += text
            if gap > widest:
                widest, widest_at = gap, end
        end = x1
    return rejoined(_trimmed(WHITE.sub(" ", out))), widest, widest_at, marks


class Pages:
    """The atoms of some pages, in the order of their regions."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        atoms = batch.column("atoms")
        lengths, flat = np.diff(atoms.offsets.to_numpy()), atoms.flatten()
        page = np.repeat(np.arange(batch.num_rows), lengths)
        v = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in NUMBERS}
        order = np.lexsort((v["x0"], v["base"], page))
        place = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        v = {k: x[order] for k, x in v.items()}
        again, self.region = cut_regions(v, page[order], batch.column("width").to_numpy(zero_copy_only=False))
        self.order = order[again]
        self.v, self.page, self.place = {k: x[again] for k, x in v.items()}, page[self.order], place[self.order]
        self.text, self.bold = flat.field("text"), flat.field("bold").fill_null(False)

    def regions(self) -> pa.Array:
        """For each page the atoms of its regions."""
        fields = {"base": 0, "x0": 0, "k": self.place.astype(np.int32), "x1": 0, "top": 0, "bot": 0, "size": 0, "text": self.text.take(pa.array(self.order)), "bold": self.bold.take(pa.array(self.order))}
        atoms = pa.StructArray.from_arrays([pa.array(self.v[k]) if k in self.v else pa.array(x) for k, x in fields.items()], list(fields))
        ends = lambda at, n: pa.array(np.r_[at, n].astype(np.int32))
        first = _offsets(self.region)
        inner = pa.ListArray.from_arrays(ends(first, len(self.region)), atoms)
        return pa.ListArray.from_arrays(ends(_offsets(self.page[first]), len(first)), inner)

    def lines(self, height: np.ndarray) -> dict[str, list | np.ndarray]:
        """The lines of all regions: their pages and measures."""
        v, texts, region = self.v, self.text.take(pa.array(self.order)).to_pylist(), self.region
        bold, first = self.bold.to_numpy(zero_copy_only=False)[self.order], _offsets(region)
        left, right = np.minimum.reduceat(v["x0"], first), np.maximum.reduceat(v["x1"], first)
        number = region - region[_offsets(self.page)][np.cumsum(np.r_[False, self.page[1:] != self.page[:-1]])]
        caps, begun = _caps(v, texts, region)
        rest = np.flatnonzero(~caps)
        line = _lines(v["base"][rest], v["size"][rest], region[rest])
        runs = rest[np.lexsort((v["base"][rest], v["x0"][rest], line))]
        at = _offsets(line)
        n = np.diff(np.r_[at, len(line)])
        lowest, highest = (lambda k: np.minimum.reduceat(v[k][runs], at)), (lambda k: np.maximum.reduceat(v[k][runs], at))
        base, n_bold = _medians(v["base"][runs], line, at), np.add.reduceat(bold[runs].astype(int), at)
        halves, prefix = np.floor(v["size"][runs] * 2 + 0.5) / 2, {}
        for a in sorted(begun):
            if not caps[a]:
                prefix.setdefault(int(line[np.searchsorted(rest, a)]), begun[a])
        own = list(zip([texts[i] for i in runs.tolist()], *(v[k][runs].tolist() for k in ("x0", "x1", "base", "size"))))
        same, halves = np.minimum.reduceat(halves, at) == np.maximum.reduceat(halves, at), halves.tolist()
        told, sizes = [], []
        for j, (a, k, b, one) in enumerate(zip(at.tolist(), n.tolist(), base.tolist(), same.tolist())):
            size = (halves[a] if halves[a] > 0 else 10.0) if one else _size(list(zip(halves[a : a + k], [r[0] for r in own[a : a + k]])))
            sizes.append(size)
            told.append(_text(own[a : a + k], prefix.get(j, ""), b, size))
        text, gap, gap_at, marks = zip(*told)
        size, of, page, top, bot = np.array(sizes), region[runs][at], self.page[runs][at], lowest("top"), highest("bot")
        return {
            "row": page, "region_idx": number[runs][at].astype(np.int32), "text": list(text), "size": size, "base": base, "top": top, "bot": bot, "x0": lowest("x0"), "x1": highest("x1"),
            "bold": (n_bold > 0) & (n_bold >= n / 2), "gap_max": np.array(gap) / size, "gap_at": np.array(gap_at, float), "col_left": left[of], "col_right": right[of], "col_width": (right - left)[of],
            "in_top": pa.array(top < height[page] * MARGIN, mask=np.isnan(height[page])), "in_bot": pa.array(bot > height[page] * (1 - MARGIN), mask=np.isnan(height[page])), "dropped_citations": np.array(marks, np.int32),
        }


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of atoms."""
    for batch in batches:
        ends, at = np.cumsum(np.diff(batch.column("atoms").offsets.to_numpy())), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            end = min(max(at + 1, int(np.searchsorted(ends, done + MOST_ATOMS, side="right"))), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def region_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their regions in place of their atoms."""
    for batch in _some(batches):
        kept = [k for k in batch.schema.names if k != "atoms"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), Pages(batch).regions()], [*kept, "regions"])


def line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with text, each with its place among those of its page."""
    for batch in _some(batches):
        lines = Pages(batch).lines(batch.column("height").to_numpy(zero_copy_only=False))
        row = pa.array(lines.pop("row"))
        out = {"doc_id": batch.column("doc_id").take(row), "page": batch.column("page").take(row), "n": pa.array(np.arange(len(row), dtype=np.int32)), **{k: pa.array(x) for k, x in lines.items()}}
        kept = pa.array([x != "" for x in lines["text"]])
        yield pa.RecordBatch.from_arrays([x.filter(kept) for x in out.values()], list(out))
