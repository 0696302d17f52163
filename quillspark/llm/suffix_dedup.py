"""Remove repeated byte strings, found by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``MIN_BYTES`` bytes that covers it also starts earlier: in a document of smaller doc_id, or
earlier in the same one. The suffixes that must be compared are first brought together:

1. Each window of MIN_BYTES bytes has an anchor, the leftmost of its grams of ``GRAM`` bytes with the least hash. Equal
   windows have equal anchors in the same place. The bytes of all neighbouring windows with one anchor form a segment.
2. Segments meet by the hash of their anchor, as hashes and places only. Of equal segments all but the earliest go
   whole. An anchor with one text left has nothing to compare; the texts of the others are fetched from the documents.
3. Each task joins the different segments of its anchors to one string, sorts its suffixes by their first bytes, and
   derives common prefixes from its Burrows-Wheeler transform: breadth-first backward extension visits the intervals of
   all strings by increasing length and sets every common prefix as its length is reached. It ends at MIN_BYTES; what is
   unset then has MIN_BYTES or more in common. Those suffixes form groups; all but the earliest of a group are repeats.

An anchor with very many different segments is split: each of its windows goes by the hash of its own bytes, so no task
has to hold the surroundings of a passage that a large part of the corpus shares. Copies within a batch of documents need
no comparison and are dealt evenly. Over many batches segments meet in two steps: groups of batches first keep the earliest
of each different segment and tell which anchors are hot, then a range of anchors sees what these have left. Nothing is
dropped or capped.

Defined results: a null text counts as empty; documents of fewer than MIN_BYTES bytes keep all; rows that repeat a doc_id
and its text are one document and get equal results; different texts under one doc_id are documents of their own, in the
order of a hash of their text; rows with a null doc_id keep all and are no one's earlier text; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nested, saved, slices, small_batches, utf8

MIN_BYTES = 100
GRAM = 32
#: Different segments of an anchor above which their windows are dealt out one by one.
HOT = 2048
#: Bytes that are hashed at a time, and bytes of a string that is sorted.
BLOCK, STRING = 512 << 10, 512 << 10
#: Key ranges for each input partition, and input partitions whose segments meet in a first step.
RANGES, MEET = 4, 256
#: Bytes of text that are cut to segments at a time, and whose asked segments are fetched at a time.
BATCH, FETCH = 8 << 20, 2 << 20
#: A document: its id, and a hash of its text that tells different texts of one id.
DOC = np.dtype([("id", "<i8"), ("t", "<i8")])

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(0, 1 << 62)) * 2 + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes that start at each place; ``size`` is a sum of powers of two."""
    h, have, out, at = _BYTE[b], 1, None, 0
    while True:
        if size & have:
            part = h if not at else h[at:] * np.uint64(pow(_BASE, at, 1 << 64))
            out = part if out is None else out[: len(part)] + part[: len(out)]
            at += have
        if at == size:
            return _mixed(out[: len(b) - size + 1])
        h = h[: len(h) - have] + h[have:] * np.uint64(pow(_BASE, have, 1 << 64))
        have *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


_POWER = np.full(BLOCK, _BASE, np.uint64)
_POWER[0] = 1
_POWER = np.cumprod(_POWER)
_INVERSE = np.full(BLOCK, pow(_BASE, -1, 1 << 64), np.uint64)
_INVERSE[0] = 1
_INVERSE = np.cumprod(_INVERSE)


def segments(b: np.ndarray, size: int, starts: tuple | list = ()) -> tuple[np.ndarray, ...]:
    """Anchor hash, first window, last window and content hash of the segments of a string of at most BLOCK bytes.

    ``starts``: where other texts start in the string; no window crosses these.
    """
    if len(b) < size:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint64))
    h = gram_hashes(b, GRAM)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = _least(key, size - GRAM + 1).astype(np.uint32)
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    inside = np.ones(len(anchor), bool)
    for e in starts:
        inside[max(0, e - size + 1) : e] = False
        new[[x for x in (e, max(0, e - size + 1)) if x < len(new)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _POWER[: len(b)], out=total[1:])
    content = (total[last + size] - total[first]) * _INVERSE[first]
    # Least hashes are small; mixed once more they spread over all ranges.
    return _mixed(h[anchor[first]] + _MIX), first, last, _mixed(content + (last - first).astype(np.uint64))


def _texts(data: list[bytes], size: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Segments of each text by its number. A text beyond BLOCK bytes comes in parts that share all windows at their ends."""
    at = 0
    while at < len(data):
        if len(data[at]) > BLOCK:
            b, step = np.frombuffer(data[at], np.uint8), BLOCK - size + 1
            for i in range(0, len(b) - size + 1, step):
                h, first, last, content = segments(b[i : i + BLOCK], size)
                yield at, (h, first + i, last + i, content)
            at += 1
            continue
        end, n = at, 0
        while end < len(data) and n + len(data[end]) <= BLOCK and len(data[end]) <= BLOCK:
            n += len(data[end])
            end += 1
        starts = np.concatenate([[0], np.cumsum([len(x) for x in data[at:end]])]).astype(np.int64)
        h, first, last, content = segments(np.frombuffer(b"".join(data[at:end]), np.uint8), size, starts[1:-1].tolist())
        doc = np.searchsorted(starts, first, side="right") - 1
        cuts = np.searchsorted(doc, np.arange(end - at + 1))
        for k in range(end - at):
            i, j = cuts[k], cuts[k + 1]
            if j > i:
                yield at + k, (h[i:j], first[i:j] - starts[k], last[i:j] - starts[k], content[i:j])
        at = end


def _packed(key: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """Range numbers and the places of their keys."""
    part = (key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    order = np.argsort(part.astype(np.uint16) if ranges <= 65536 else part, kind="stable")
    part = part[order]
    for at in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else ():
        yield int((int(key[at[0]]) >> 32) * ranges >> 32), at


def _firsts(h: np.ndarray, c: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of segments by anchor and content, the earliest ones and the others. A repeated row is no other place."""
    order = np.lexsort((p, d["t"], d["id"], c, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    lead = order[new]
    first = lead[np.cumsum(new) - 1] if len(order) else order
    elsewhere = (d[order] != d[first]) | (p[order] != p[first])
    return lead, order[elsewhere]


#: Rows of segments: range and group of batches; anchors, contents, documents, places and windows as arrays. Rows without
#: anchors are finished copies, rows without contents finished segments of hot anchors.
_ROW = pa.schema([("r", pa.int32()), ("g", pa.int32()), *((k, pa.binary()) for k in "hcdpn")])
_TYPES = {"h": np.uint32, "c": np.uint64, "d": DOC, "p": np.int32, "n": np.uint8}
#: So many windows mark an anchor as hot; a segment has fewer.
_HOT_MARK = 255


def _anchors(ranges: int, groups: int, size: int):
    """By ranges of anchors: hash, content, document, place and windows of each segment. Copies in a batch need no
    comparison: they go anywhere."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for number, rows in enumerate(slices(batches, BATCH)):
            ids = np.empty(len(rows), DOC)
            ids["id"], ids["t"] = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "t"))
            found = [(k, *x) for k, x in _texts(utf8(rows.column("text")), size)]
            if not found:
                continue
            h, first, last, content = (np.concatenate([x[i] for x in found]) for i in range(1, 5))
            doc = ids[np.repeat([x[0] for x in found], [len(x[1]) for x in found])]
            del found
            more = (last - first).astype(np.uint8)
            lead, copies = _firsts(h, content, doc, first)
            low = ((h * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint32)
            first, out = first.astype(np.int32), []
            for r, at in _packed(h[lead], ranges):
                k = lead[at]
                out.append((r, pid % groups, low[k].tobytes(), content[k].tobytes(), doc[k].tobytes(), first[k].tobytes(), more[k].tobytes()))
            if len(copies):
                anywhere = zlib.crc32(f"{pid}-{number}".encode()) % ranges
                out.append((anywhere, pid % groups, b"", b"", doc[copies].tobytes(), first[copies].tobytes(), more[copies].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROW)], schema=_ROW)

    return emit


def _parted(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Rows of finished copies, of finished segments of hot anchors, and of others."""
    h, c = (rows[k].str.len() > 0 for k in "hc")
    return rows[~h], rows[h & ~c], rows[h & c]


def _arrays(rows: pd.DataFrame, names: str = "hcdpn") -> list[np.ndarray]:
    return [np.frombuffer(b"".join(rows[k]), _TYPES[k]) for k in names]


def _hot(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the anchor of each of these different segments has over HOT of them, or a mark that it has."""
    _, name, count = np.unique(h, return_inverse=True, return_counts=True)
    marked = np.bincount(name, n == _HOT_MARK, len(count)) > 0
    return ((count > HOT) | marked)[name]


def _met(ranges: int):
    """The segments of a range in one group of batches: the earliest of each content, and what is settled with that, which
    needs no range any more and goes anywhere."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        copies, hot, rest = _parted(rows)
        h, c, d, p, n = _arrays(rest)
        lead, gone = _firsts(h, c, d, p)
        over = _hot(h[lead], n[lead])
        r, g = int(rows["r"].iloc[0]), int(rows["g"].iloc[0])
        anywhere = zlib.crc32(f"{r}-{g}".encode()) % ranges
        out = [*copies.itertuples(index=False), *hot.itertuples(index=False)]
        put = lambda where, k, *left_out: out.append((where, g, *(b"" if name in left_out else x[k].tobytes() for name, x in zip("hcdpn", (h, c, d, p, n)))))
        put(anywhere, gone, "h", "c")
        put(anywhere, lead[over], "c")
        put(r, lead[~over])
        marks = np.unique(h[lead[over]])
        out.append((r, g, marks.tobytes(), np.zeros(len(marks), np.uint64).tobytes(), np.zeros(len(marks), DOC).tobytes(),
                    np.full(len(marks), -1, np.int32).tobytes(), np.full(len(marks), _HOT_MARK, np.uint8).tobytes()))
        return pd.DataFrame([x for x in out if len(x[4])], columns=_ROW.names)

    return run


def _resolved(size: int):
    """Spans to remove (null anchor), and the first of each different segment of anchors that have several: doc_id, t, a, e,
    anchor, and whether its windows are to be dealt one by one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r, (copies, hot, rest) = int(rows["r"].iloc[0]), _parted(rows)
        h, c, d, p, n = _arrays(rest)
        lead, gone = _firsts(h, c, d, p)
        over = _hot(h[lead], n[lead])
        lead, over = lead[n[lead] != _HOT_MARK], over[n[lead] != _HOT_MARK]
        name = np.unique(h[lead], return_inverse=True)[1]
        ask = np.flatnonzero(over | (np.bincount(name)[name] > 1)) if len(lead) else lead
        over, ask = over[ask], lead[ask]
        parts = [(d[gone], p[gone], n[gone], None, False), (*_arrays(copies, "dpn"), None, False), (d[ask], p[ask], n[ask], h[ask], over), (*_arrays(hot, "dpn"), _arrays(hot, "h")[0], True)]
        doc, a, n = (np.concatenate([x[i] for x in parts]) for i in range(3))
        anchor = np.concatenate([np.full(len(x[0]), -1, np.int64) if x[3] is None else x[3].astype(np.int64) | (r << 32) for x in parts])
        dealt = np.concatenate([np.broadcast_to(x[4], len(x[0])) for x in parts])
        a = a.astype(np.int64)
        anchor = pd.Series(anchor).astype("Int64").mask(anchor < 0)
        return pd.DataFrame({"doc_id": doc["id"], "t": doc["t"], "a": a, "e": a + n + size, "anchor": anchor, "dealt": dealt})

    return run


def _fetched(ranges: int, size: int):
    """The texts of the segments asked for, by their anchor's range; those of hot anchors window by window."""
    schema = pa.schema([("r", pa.int32()), *((k, pa.binary()) for k in ("h", "d", "p", "len", "text"))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, FETCH):
            key, doc, place, text = [], [], [], []
            asked = nested(rows.column("asked"), "anchor", "a", "e", "dealt")
            for doc_id, t, data, own in zip(rows.column("doc_id").to_pylist(), rows.column("t").to_pylist(), utf8(rows.column("text")), asked):
                for anchor, a, e, dealt in own:
                    if not dealt:
                        spans = [(anchor, a, e)]
                    else:
                        spans = []
                        for i in range(a, e - size + 1):
                            h = int.from_bytes(hashlib.blake2b(data[i : i + size], digest_size=8).digest())
                            spans.append(((h * ranges >> 64) << 32 | h & 0xFFFFFFFF, i, i + size))
                    for k, i, j in spans:
                        key.append(k)
                        doc.append((doc_id, t))
                        place.append(i)
                        text.append(data[i:j])
            if not key:
                continue
            key, doc, place = np.array(key, np.int64), np.array(doc, DOC), np.array(place, np.int64)
            n = np.array([len(x) for x in text], np.int64)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order] >> 32)) + 1
            out = [
                (int(key[k[0]] >> 32), key[k].tobytes(), doc[k].tobytes(), place[k].tobytes(), n[k].tobytes(), b"".join(text[i] for i in k))
                for k in np.split(order, cuts)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return emit


def suffix_order(b: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``b`` in the order of their first ``depth`` bytes at least, by prefix doubling from eight bytes on."""
    n = len(b)
    x = np.concatenate([b, np.resize(b, 8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | x[i : i + n]
    have = 8
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        s = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]).astype(np.uint64)
        if int(rank[order[-1]]) == n - 1:
            return order
        key = (rank << np.uint64(32)) | np.roll(rank, -have)
        have *= 2


def bounded_prefixes(b: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """For each place of the suffix order, whether it has ``bound`` bytes or more in common with the place before.

    Breadth-first backward extension over the Burrows-Wheeler transform: the intervals of strings of length k give those
    of length k + 1, and an interval's right end whose common prefix isn't set yet has exactly k bytes in common.
    """
    n = len(b)
    bwt = b[order - 1]
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    prior, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    same = bwt[by[1:]] == bwt[by[:-1]]
    prior[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    left, right = np.array([0]), np.array([n - 1])
    for _ in range(bound):
        size = right - left + 1
        if not len(size):
            break
        at = np.repeat(left - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        # First and last of each symbol in an interval lead to the ends of the extended interval.
        ends_l = np.sort(lf[at[prior[at] < np.repeat(left, size)]])
        ends_r = np.sort(lf[at[after[at] > np.repeat(right, size)]])
        new = unset[ends_r + 1]
        left, right = ends_l[new], ends_r[new]
        unset[right + 1] = False
    out = unset[:n].copy()
    out[0] = False
    return out


def _repeats(d: np.ndarray, p: np.ndarray, lens: np.ndarray, texts: list[bytes], size: int) -> Iterator[tuple]:
    """Spans (document, start, end) of windows of these different segments that also occur in an earlier one."""
    b = np.frombuffer(b"".join(x + b"\0" for x in texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    order = suffix_order(b, size)
    shared = bounded_prefixes(b, order, size)
    seg = np.repeat(np.arange(len(texts)), lens + 1)
    off = np.arange(len(b)) - starts[seg]
    valid = (off + size <= lens[seg])[order]
    group = np.cumsum(~shared)[valid]
    s, o = seg[order][valid], off[order][valid]
    by = np.lexsort((p[s] + o, d["t"][s], d["id"][s], group))
    g = group[by]
    later = np.zeros(len(g), bool)
    later[1:] = g[1:] == g[:-1]
    k = by[later]
    doc, at = d[s[k]], p[s[k]] + o[k]
    by = np.lexsort((at, doc["t"], doc["id"]))
    doc, at = doc[by], at[by]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
        first = np.flatnonzero(new)
        yield doc[first], at[first], at[np.append(first[1:], len(doc)) - 1] + size


def _compared(size: int):
    """Spans of these segments that repeat others of the same anchor."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h, p, n = (np.frombuffer(b"".join(rows[k]), np.int64) for k in ("h", "p", "len"))
        d = np.frombuffer(b"".join(rows["d"]), DOC)
        body, ends = b"".join(rows["text"]), np.cumsum(n)
        texts = [body[j - k : j] for j, k in zip(ends.tolist(), n.tolist())]
        name = d.tolist()
        order = sorted(range(len(h)), key=lambda k: (h[k], texts[k], name[k], p[k]))
        # Windows of hot anchors may be equal; a repeated row brings its own segments again.
        lead: list[int] = []
        copies = []
        for k in order:
            if not lead or h[k] != h[lead[-1]] or texts[k] != texts[lead[-1]]:
                lead.append(k)
            elif (name[k], p[k]) != (name[lead[-1]], p[lead[-1]]):
                copies.append(k)
        spans = [(d[copies], p[copies], p[copies] + n[copies])] if copies else []
        # An anchor with one text has nothing to compare; the others are packed to strings of bounded size.
        lead = np.array(lead, np.int64)
        name = np.cumsum(np.append(True, h[lead][1:] != h[lead][:-1])) - 1
        lead = lead[np.bincount(name)[name] > 1]
        cuts, total = [0], 0
        for i, k in enumerate(lead):
            total += int(n[k])
            if total > STRING and i and h[k] != h[lead[i - 1]]:
                cuts.append(i)
                total = int(n[k])
        for i, j in zip(cuts, [*cuts[1:], len(lead)]):
            k = lead[i:j]
            if len(k):
                spans += _repeats(d[k], p[k], n[k], [texts[x] for x in k], size)
        d, a, e = (np.concatenate([x[i] for x in spans] or [np.zeros(0, DOC if i == 0 else np.int64)]) for i in range(3))
        return pd.DataFrame({"doc_id": d["id"], "t": d["t"], "a": a, "e": e})

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, BATCH):
        out = []
        for doc_id, data, spans in zip(rows.column("doc_id").to_pylist(), utf8(rows.column("text")), nested(rows.column("spans"), "a", "e")):
            removed, n, at, end, kept = 0, 0, 0, -1, []
            for a, e in sorted(spans):
                if a > end:
                    kept.append(data[at:a])
                    n += 1
                    removed += e - a
                elif e > end:
                    removed += e - end
                end = max(end, e)
                at = end
            kept.append(data[at:])
            rest = b"".join(kept)
            out.append((doc_id, len(data), removed, n, hashlib.sha256(rest).hexdigest(), rest.decode(errors="replace")))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Documents (doc_id, t: hash of the text, text) with ``spans``: array of (a, e), byte ranges to remove, which may overlap."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    partitions = max(4, texts.rdd.getNumPartitions())
    ranges, groups = min(RANGES * partitions, 1 << 30), -(-partitions // MEET)
    row = "r int, g int, h binary, c binary, d binary, p binary, n binary"
    lead = texts.filter("doc_id IS NOT NULL").mapInArrow(_anchors(ranges, groups, min_bytes), row)
    if groups > 1:
        lead = lead.groupBy("r", "g").applyInPandas(_met(ranges), row)
    schema = "doc_id long, t long, a long, e long, anchor long, dealt boolean"
    resolved = saved(lead.groupBy("r").applyInPandas(_resolved(min_bytes), schema))
    asked = resolved.filter("anchor IS NOT NULL").groupBy("doc_id", "t").agg(F.collect_list(F.struct("anchor", "a", "e", "dealt")).alias("asked"))
    rows = texts.join(asked, ["doc_id", "t"], "left").mapInArrow(
        _fetched(ranges, min_bytes), "r int, h binary, d binary, p binary, len binary, text binary"
    )
    spans = rows.groupBy("r").applyInPandas(_compared(min_bytes), "doc_id long, t long, a long, e long")
    spans = spans.unionByName(resolved.filter("anchor IS NULL").select("doc_id", "t", "a", "e"))
    spans = spans.groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
    return texts.join(spans, ["doc_id", "t"], "left")


def dedup(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (invalid UTF-8 at cuts replaced)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return repeated_spans(docs, min_bytes).mapInArrow(_kept, schema)
