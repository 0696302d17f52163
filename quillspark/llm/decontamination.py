"""Benchmark decontamination by template canonicalisation.

Texts become tokens (runs of letters and digits, without case). Numbers, names (capitalised words inside a sentence) and
units after a number become typed placeholders. Windows of WINDOW tokens with enough literal ones are hashed and joined
to those of the benchmark; so a question is found again when its numbers, names and units were exchanged. The values that
a match puts in the slots are then compared: an item's value should always meet one value of the document. Both are judged
for each place where an item occurs: for the matches of one alignment (place in the document less place in the item), of
alignments that follow each other within GAP tokens (values of more or fewer tokens), and of the whole document (an item
that is scattered over it). An item is reported for a document if in any of these enough of its windows match and the
slots agree.

Items of fewer than WINDOW tokens (MIN_WINDOW at least) are one window of their own length. Besides, windows of the plain
tokens, without placeholders, are joined for every item: they find verbatim copies of items with few literal tokens, of
one token and more, and copies in which names lost their capitals. An item with template windows needs PLAIN of its plain
ones, another one as many as of template windows. Characters of scripts without spaces are tokens of their own.

Defined results: null texts and items, and those without a letter or digit, match nothing; repeated rows are reported
once for each doc_id and item; a null doc_id is reported as null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, slices, small_batches, utf8

WINDOW, MIN_WINDOW, LITERALS = 8, 5, 4
#: Reported from this share of an item's windows or this many windows, and this share of slots in agreement.
COVERED, WINDOWS, AGREED = 0.3, 16, 0.7
#: Share of plain windows that reports an item which has template windows too.
PLAIN = 0.7
#: Alignments this close belong to one occurrence.
GAP = 4
#: Benchmark windows up to which every task tests membership before the join (8 bytes each).
SMALL = 1_000_000
#: Bytes of text that are cut to windows at a time, bytes that are cut to tokens at a time, and bytes before a cut that
#: tell whether what follows it begins a sentence or is a unit.
PART, BLOCK, CONTEXT = 1 << 20, 512 << 10, 256
#: Units of measure.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz pound pounds ounce ounces ton tons "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years cent cents dollar dollars euro euros percent degrees degree kmh mph volts watts"
).split()
_RANDOM = np.random.default_rng(33)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = (int(x) * 2 + 1 for x in _RANDOM.integers(0, 1 << 62, 2))
_MIX = np.uint64(0x9E3779B97F4A7C15)
NUMBER, NAME, UNIT = (np.uint64(x) for x in (1, 2, 3))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[*b".!?:\n|"]] = True


#: Code points of scripts without spaces, and of signs that separate words there.
SPACELESS = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
SIGNS = ((0x3000, 0x3004), (0x3008, 0x303F), (0x30FB, 0x30FB), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x)


_UP, _DOWN = _powers(_BASE, BLOCK + 2), _powers(pow(_BASE, -1, 1 << 64), BLOCK + 2)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _cut(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and where a token starts or ends beside another one (one more place than bytes)."""
    word, cut = _WORD[b], np.zeros(len(b) + 1, bool)
    at = np.flatnonzero(b >= 0xE0)
    at = at[at + np.where(b[at] >= 0xF0, 4, 3) <= len(b)]
    if len(at):
        long = b[at] >= 0xF0
        point = np.where(long, b[at] & 7, b[at] & 15).astype(np.int64)
        for i in (1, 2, 3):
            point = np.where(long | (i < 3), point << 6 | (b[np.minimum(at + i, len(b) - 1)] & 63), point)
        size = np.where(long, 4, 3)
        inside = lambda ranges: np.any([(point >= a) & (point <= z) for a, z in ranges], axis=0)
        alone, sign = inside(SPACELESS), inside(SIGNS)
        cut[at[alone]] = True
        cut[(at + size)[alone]] = True
        for i in range(3):
            word[at[sign] + i] = False
    return word, cut


def _tokens(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template token (placeholder or hash), hash of the plain token, and first byte of each token of one string."""
    small = b.copy()
    upper = (b >= 65) & (b <= 90)
    # Accented capitals of two bytes: C3 80 to C3 9E but for the sign of multiplication.
    upper[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    small[upper] += 32
    word, cut = _cut(b)
    first = np.flatnonzero(word & (cut[:-1] | ~np.append(False, word[:-1])))
    end = np.flatnonzero(word & (cut[1:] | ~np.append(word[1:], False))) + 1
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), first
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[small] * _UP[: len(b)], out=total[1:])
    plain = _mixed((total[end] - total[first]) * _DOWN[first]) | np.uint64(8)
    digits = np.concatenate([[0], np.cumsum((b >= 48) & (b <= 57))])
    number = digits[end] > digits[first]
    ends = np.concatenate([[0], np.cumsum(_END[b])])
    begins = np.ones(len(first), bool)
    begins[1:] = ends[first[1:]] > ends[end[:-1]]
    capitals = np.concatenate([[0], np.cumsum(upper)])
    head = first + (b[first] == 0xC3)
    name = upper[head] & (capitals[end] - capitals[first] == 1) & (end - first > 1) & ~begins & ~number
    unit = np.zeros(len(first), bool)
    unit[1:] = number[:-1] & np.isin(plain[1:], UNIT_HASHES)
    return np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, plain))), plain, first


UNIT_HASHES = np.zeros(0, np.uint64)
UNIT_HASHES = _tokens(np.frombuffer(" ".join(UNITS).encode(), np.uint8))[1]


def _parts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens, plain tokens and text numbers. A text beyond BLOCK is cut at white space, its tokens joined."""
    token, plain, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def flush(part: list[bytes], numbers: list[int], skip: int = 0) -> None:
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
        t, p, first = _tokens(np.frombuffer(b"\n".join(part), np.uint8))
        new = first >= skip
        token.append(t[new])
        plain.append(p[new])
        own.append(np.array(numbers, np.int64)[np.searchsorted(starts, first[new], side="right") - 1])

    part, numbers, size = [], [], 0
    for i, data in enumerate(texts):
        if part and size + len(data) + 1 > BLOCK - 2:
            flush(part, numbers)
            part, numbers, size = [], [], 0
        at = 0
        while len(data) - at > BLOCK - CONTEXT - 2:
            end = at + BLOCK - CONTEXT - 2
            space = max(data.rfind(b" ", at + 1, end), data.rfind(b"\n", at + 1, end))
            if space < 0:
                # Not inside a character.
                while data[end] & 0xC0 == 0x80:
                    end -= 1
            before = min(at, CONTEXT)
            flush([data[at - before : space if space > 0 else end]], [i], before)
            at = space if space > 0 else end
        if at:
            before = min(at, CONTEXT)
            flush([data[at - before :]], [i], before)
        else:
            part.append(data)
            numbers.append(i)
            size += len(data) + 1
    if part:
        flush(part, numbers)
    return np.concatenate(token), np.concatenate(plain), np.concatenate(own)


def windows(texts: list[bytes], lengths: list[int], whole: bool = False, known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Hash, text number, place in the text, length and first token of each window, and all plain and template tokens.

    ``whole``: texts shorter than WINDOW give one window of their own length, others windows of WINDOW. A negative length
    stands for windows of plain tokens. ``known``: sorted hashes; other windows are left out.
    """
    token, plain, own = _parts(texts)
    cuts = np.searchsorted(own, np.arange(len(texts) + 1))
    literal = np.concatenate([[0], np.cumsum(token > UNIT)])
    none = np.zeros(0, np.int64)
    out = [(np.zeros(0, np.uint64), none, none, none, none)]
    for length in lengths:
        k, series = (length, token) if length > 0 else (-length, plain)
        n = len(token) - k + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h += series[i : i + n] * np.uint64(pow(_STEP, i + 1, 1 << 64))
        h = _mixed(h + np.uint64(k if length > 0 else k + 64))
        ok = own[k - 1 :] == own[:n]
        if length > 0:
            ok &= literal[k:] - literal[:n] >= min(LITERALS, k - 1)
        if whole:
            size = np.diff(cuts)[own[:n]]
            ok &= (size == k) if k < WINDOW else (size >= k)
        at = np.flatnonzero(ok)
        if known is not None:
            j = np.searchsorted(known, h[at])
            j[j == len(known)] = 0
            at = at[known[j] == h[at]] if len(known) else at[:0]
        out.append((h[at], own[at], at - cuts[own[at]], np.full(len(at), length), at))
    return (*(np.concatenate([x[i] for x in out]) for i in range(5)), plain, token)


def _rows(column: str, lengths: list[int], whole: bool, keep) -> object:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART):
            h, own, place, size, at, plain, token = windows(utf8(part.column("text")), lengths, whole, None if keep is None else keep.value)
            # Plain windows have no slots: an empty slice.
            slots = [plain[a : a + n][token[a : a + n] <= UNIT].view(np.int64) for a, n in zip(at.tolist(), np.maximum(size, 0).tolist())]
            columns = [h.view(np.int64), part.column(column).take(pa.array(own)), place, size]
            slots = pa.array(slots, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), slots], ["h", column, "place", "k", "slots"])

    return emit


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document and item with a common window: doc_id, item_id, n_windows (of the item), n_matched, n_slots (different
    pairs of slot values), n_conflicts, contaminated; the counts are those of the occurrence that tells most."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    lengths = [*range(MIN_WINDOW, WINDOW + 1), *range(-WINDOW, 0)]
    known = saved(items.mapInArrow(_rows("item_id", lengths, True, None), "h long, item_id long, place long, k long, slots array<long>"))
    # Documents are only cut to windows of the lengths that items have.
    lengths = sorted(r["k"] for r in known.select("k").distinct().collect()) or [WINDOW]
    known = known.withColumn("plain", F.col("k") < 0).drop("k")
    n = known.select("h").distinct().count()
    keep = None
    if n <= SMALL:
        keep = spark.sparkContext.broadcast(np.sort(known.select("h").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(_rows("doc_id", lengths, False, keep), "h long, doc_id long, place long, k long, slots array<long>")
    found = found.withColumnsRenamed({"slots": "doc_slots", "place": "doc_place"}).drop("k")
    hits = saved(found.join(known, "h"))
    sizes = known.groupBy("item_id", "plain").agg(F.count(F.lit(1)).alias("n_windows"))
    both = known.groupBy("item_id").agg(F.bool_or(~F.col("plain")).alias("template"))
    sizes = sizes.join(both, "item_id")
    hits = hits.select(
        "doc_id", "item_id", "plain", "place", (F.col("doc_place") - F.col("place")).alias("align"),
        F.arrays_zip(F.col("slots").alias("item"), F.col("doc_slots").alias("doc")).alias("v"),
    )
    by = W.partitionBy("doc_id", "item_id", "plain").orderBy("align")
    hits = hits.withColumn("jump", (F.col("align") - F.lag("align", 1).over(by) > GAP).cast("long"))
    # Rows of equal alignment get equal numbers, as the sum's frame holds all of them.
    hits = hits.withColumn("occurrence", F.coalesce(F.sum("jump").over(by), F.lit(0)))
    levels = F.array(*[F.struct(F.lit(i).alias("level"), x.cast("long").alias("at")) for i, x in enumerate((F.col("align"), F.col("occurrence"), F.lit(0)))])
    groups = hits.select("doc_id", "item_id", "plain", "place", "v", F.explode(levels).alias("g")).groupBy("doc_id", "item_id", "plain", "g").agg(
        F.size(F.collect_set("place")).cast("long").alias("n_matched"), F.array_distinct(F.flatten(F.collect_set("v"))).alias("v")
    )
    n_slots = F.size("v").cast("long")
    n_values = F.size(F.array_distinct(F.transform("v", lambda x: x["item"]))).cast("long")
    groups = groups.select("doc_id", "item_id", "plain", "n_matched", n_slots.alias("n_slots"), (n_slots - n_values).alias("n_conflicts")).join(sizes, ["item_id", "plain"])
    enough = (F.col("n_matched") >= COVERED * F.col("n_windows")) | (F.col("n_matched") >= WINDOWS)
    enough = F.when(F.col("plain") & F.col("template"), F.col("n_matched") >= PLAIN * F.col("n_windows")).otherwise(enough)
    agreed = F.col("n_conflicts") <= (1 - AGREED) * F.col("n_slots")
    best = F.max(F.struct((enough & agreed).alias("contaminated"), "n_matched", (-F.col("n_conflicts")).alias("agreement"), "n_slots", "n_windows"))
    out = groups.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", "b.n_windows", "b.n_matched", "b.n_slots", (-F.col("b.agreement")).alias("n_conflicts"), "b.contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The document and item pairs that count as contamination."""
    return matches(docs, benchmark).filter("contaminated").drop("contaminated")
