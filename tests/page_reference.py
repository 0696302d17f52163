"""A page cut one region after the other, with numpy: what the expressions over whole levels are tested against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MAX_DEPTH, LEAST_ATOMS = 14, 3
GUTTER, GUTTER_PAGE, NARROW, NARROW_PAGE = 1.15, 0.018, 0.5, 0.008
WORD_SPACES, STRAIGHT, BESIDE, SHARED_ROWS = 1.8, 0.55, 3, 0.75
REGION_WIDTH, SIDE_WIDTH, BAND_PITCH, BAND_EMS = 0.34, 0.10, 0.7, 0.95
ROW, LINE, CAP, CAP_TEXT = 0.4, 0.62, 1.7, 0.7

X0, X1, TOP, BOT, BASE, SIZE = range(6)


def _anchored(base: np.ndarray, tolerance: Callable[[int, int], float]) -> np.ndarray:
    """Number groups of neighbours in ``base`` (ascending): each stays within a tolerance of its group's first."""
    out, first = np.zeros(len(base), np.int64), 0
    for i in range(1, len(base)):
        new = abs(base[i] - base[first]) > tolerance(first, i)
        out[i] = out[i - 1] + new
        first = i if new else first
    return out


def _channels(low: np.ndarray, high: np.ndarray, least: float) -> np.ndarray:
    """Uncovered stretches (begin, end) between intervals, in order."""
    by = np.argsort(low, kind="stable")
    begin, end = np.maximum.accumulate(high[by])[:-1], low[by][1:]
    keep = (end > begin) & (end - begin >= least)
    return np.column_stack([begin[keep], end[keep]])


class _Rows:
    """Atoms of one side of a cut, and the rows of those that share a baseline."""

    def __init__(self, atoms: np.ndarray):
        self.atoms = atoms[np.argsort(atoms[:, BASE], kind="stable")]
        size = self.atoms[:, SIZE]
        self.row = _anchored(self.atoms[:, BASE], lambda first, i: ROW * (size[i] or 10))
        self.at = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.base = self.atoms[self.at, BASE]
        self.begin = np.minimum.reduceat(self.atoms[:, X0], self.at)
        self.end = np.maximum.reduceat(self.atoms[:, X1], self.at)
        self.top, self.bot = self.atoms[:, TOP].min(), self.atoms[:, BOT].max()
        self.width = self.end.max() - self.begin.min()

    def word_space(self, channels: np.ndarray) -> float:
        """The 90th percentile of spaces outside the channels; 0 where atoms are whole lines rather than words."""
        by = np.lexsort((self.atoms[:, X0], self.row))
        row, begin, end = self.row[by][1:], self.atoms[by, X1][:-1], self.atoms[by, X0][1:]
        keep = (row == self.row[by][:-1]) & (end - begin > 0.05)
        keep &= ~((begin[:, None] < channels[:, 1]) & (end[:, None] > channels[:, 0])).any(axis=1)
        spaces = np.sort((end - begin)[keep])
        return spaces[int(len(spaces) * 0.9)] if len(spaces) >= max(8, 2 * len(self.at)) else 0.0

    def stands_beside(self, other: _Rows, page_width: float) -> bool:
        """Wide enough for a column, or a block with baselines of its own rather than markers of the other's lines."""
        if self.width >= SIDE_WIDTH * page_width:
            return True
        near = [ROW * (np.median(s) or 10) for s in np.split(self.atoms[:, SIZE], self.at[1:])]
        shared = (np.abs(self.base[:, None] - other.base) <= np.array(near)[:, None]).any(axis=1)
        return shared.mean() < SHARED_ROWS


def _is_gutter(begin: float, end: float, left: _Rows, right: _Rows, em: float, page_width: float, word_space: float) -> bool:
    """Wide channels are gutters; narrow ones need rows on both sides and a straight edge."""
    width = end - begin
    if width >= max(GUTTER * em, GUTTER_PAGE * page_width):
        return True
    if width < max(NARROW * em, NARROW_PAGE * page_width) or width < WORD_SPACES * word_space:
        return False
    few, many = (left, right) if len(left.at) <= len(right.at) else (right, left)
    if ((few.base >= many.top) & (few.base <= many.bot)).sum() < BESIDE:
        return False
    near = max(1.5, 0.2 * em)
    return bool((np.abs(right.begin - end) <= near).mean() >= STRAIGHT or (np.abs(left.end - begin) <= near).mean() >= STRAIGHT)


def _beside(atoms: np.ndarray, page_width: float) -> np.ndarray | None:
    """Which atoms are left of the gutter that parts most text."""
    em = np.median(atoms[:, SIZE]) or 10
    channels = _channels(atoms[:, X0], atoms[:, X1], max(NARROW * em, NARROW_PAGE * page_width))
    if not len(channels):
        return None
    word_space, found = _Rows(atoms).word_space(channels), []
    for begin, end in channels:
        mask = atoms[:, X1] <= begin + (end - begin) / 2
        if min(mask.sum(), (~mask).sum()) < LEAST_ATOMS:
            continue
        left, right = _Rows(atoms[mask]), _Rows(atoms[~mask])
        apart = left.stands_beside(right, page_width) and right.stands_beside(left, page_width)
        if apart and _is_gutter(begin, end, left, right, em, page_width, word_space):
            found.append((min(left.bot, right.bot) - max(left.top, right.top), end - begin, mask))
    return max(found, key=lambda x: x[:2])[2] if found else None


def _above(atoms: np.ndarray) -> np.ndarray | None:
    """Which atoms are above the widest blank band, if that is wider than the text's own leading."""
    steps = np.diff(np.unique(np.floor(atoms[:, BASE] + 0.5)))
    pitch = np.median(steps) if len(steps) > 1 else 0.0
    bands = _channels(atoms[:, TOP], atoms[:, BOT], BAND_PITCH * pitch if pitch > 0 else BAND_EMS * (np.median(atoms[:, SIZE]) or 10))
    if not len(bands):
        return None
    begin, end = bands[np.argmax(bands[:, 1] - bands[:, 0])]
    mask = atoms[:, BOT] <= begin + (end - begin) / 2
    return mask if mask.any() and not mask.all() else None


def regions(atoms: np.ndarray, page_width: float) -> list[np.ndarray]:
    """Positions of the atoms of each region, regions in reading order."""
    out, todo = [], [(np.arange(len(atoms)), 0)]
    while todo:
        group, depth = todo.pop()
        mask = None
        if len(group) >= LEAST_ATOMS and depth < MAX_DEPTH:
            own = atoms[group]
            if own[:, X1].max() - own[:, X0].min() >= REGION_WIDTH * page_width:
                mask = _beside(own, page_width)
            mask = _above(own) if mask is None else mask
        if mask is None:
            out.append(group)
        else:
            todo += [(group[~mask], depth + 1), (group[mask], depth + 1)]
    return out


def _drop_caps(atoms: np.ndarray, texts: list[str]) -> dict[int, int]:
    """Large initials, each with the place of the atom that it begins: the highest of those that wrap around it."""
    out = {}
    for i in np.flatnonzero(atoms[:, SIZE] >= CAP * (np.median(atoms[:, SIZE]) or 10)):
        x1, top, base, size = atoms[i, [X1, TOP, BASE, SIZE]]
        if len(texts[i].strip()) <= 2:
            wraps = (atoms[:, SIZE] < CAP_TEXT * size) & (atoms[:, BASE] > top) & (atoms[:, BASE] < base - 0.5 * atoms[:, SIZE])
            wraps &= (atoms[:, X0] >= x1 - 1) & (atoms[:, X0] <= x1 + size)
            if wraps.any():
                out[int(i)] = int(np.argmin(np.where(wraps, atoms[:, BASE], np.inf)))
    return out
