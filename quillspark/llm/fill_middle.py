"""Fill-in-middle transformation over an index of distinct texts.

A text is cut into units: a word with the white space before it, or white space at the end. The index holds each distinct text
once, with the ends of its units as an Elias-Fano list (about 4.6 bits a unit); documents join it by content, and each
selects its two seeded cuts from the list without cutting the text again.

Content is told by SHA-256, a second hash and the length in bytes. A text is cut in the task that reads it, once for its
copies there, and the copies of all tasks meet as one row. Texts with more than a 1,024th of all rows, of which there are at
most 1,024, are told by a broadcast list of that bound and spread over as many groups, so that no task gets a hot text's
rows alone; texts cross the network once, in the index.

Defined results: a null text counts as empty; an empty one, one that holds a marker, and those that the seed leaves out are
``plain`` and stay as they are. A null doc_id is seeded as an empty one. Repeated rows are transformed alike, each by itself.
Extra columns pass through unless they bear the name of a result column, which replaces them. Texts are never cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, let, slices, small_batches, utf8

#: Stand before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
#: The place of the part after each marker in the text.
PARTS = {"<P>": 0, "<M>": 1, "<S>": 2}
KEYS = ("key", "own", "bytes", "salt")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")
#: A text with more than this share of all rows is hot; there are at most as many.
HOT = 1024
#: Distinct texts that a task remembers, and bytes of text that it cuts at once.
SEEN, SLICE = 1 << 16, 4 << 20


def unit_ends(text: bytes) -> tuple[np.ndarray, int]:
    """Where the units of a text end, in code points, and its length in code points."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.int64), 0
    space = (b == 32) | (b - np.uint8(9) <= 4)
    last = np.flatnonzero(~space & np.append(space[1:], True))
    chars = np.cumsum((b & 0xC0) != 0x80) if (b > 127).any() else None
    total = int(chars[-1]) if chars is not None else len(b)
    ends = chars[last] if chars is not None else last + 1
    return (np.append(ends, total) if space[-1] else ends).astype(np.int64), total


def elias_fano(values: np.ndarray, universe: int) -> tuple[int, bytes]:
    """An increasing list as the width of its low parts, and these followed by the high parts in unary."""
    n = len(values)
    if not n:
        return 0, b""
    width = max(0, (universe // n).bit_length() - 1)
    low = (values[:, None] >> np.arange(width)) & 1
    high = np.zeros(int(values[-1] >> width) + n, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return width, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def selected(coded: bytes, n: int, width: int, places: tuple[int, ...]) -> list[int]:
    """The values at these places of a list; at place 0, before the first value, 0."""
    split = (n * width + 7) // 8
    high, ones = np.frombuffer(coded, np.uint8, offset=split), None
    out = []
    for k in places:
        if k == 0:
            out.append(0)
            continue
        if ones is None:
            ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        at = int(np.searchsorted(ones, k))
        before = int(ones[at - 1]) if at else 0
        bit = at * 8 + int(np.flatnonzero(np.unpackbits(high[at : at + 1], bitorder="little"))[k - 1 - before])
        first = (k - 1) * width
        low = int.from_bytes(coded[first // 8 : (first + width + 7) // 8], "little") >> first % 8 & ((1 << width) - 1)
        out.append((bit - (k - 1)) << width | low)
    return out


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each content and salt the first text that this task meets, with its list."""
    seen: set[tuple] = set()
    for batch in slices(batches, SLICE):
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "own", "salt"))))
        at = []
        for i, key in enumerate(keys):
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                at.append(i)
        own = batch.take(pa.array(at, pa.int32()))
        found = []
        for text in utf8(own.column("text")):
            ends, chars = unit_ends(text)
            found.append((len(ends), *elias_fano(ends, chars)))
        columns = zip(*found) if found else ((), (), ())
        own = [own.column(c) for c in ("key", "own", "bytes", "salt", "text")]
        yield pa.RecordBatch.from_arrays(
            [*own, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary())))],
            ["key", "own", "bytes", "salt", "text", "n", "width", "ends"],
        )


def _content(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.unhex(F.sha2(t, 256)).alias("key"), F.xxhash64(t).alias("own"), F.octet_length(t).alias("bytes")]


def _salts(docs: DataFrame, text: str) -> DataFrame:
    """Contents with more than a share of 1 / HOT of all rows, at most HOT of them, and over how many groups each goes."""
    total = docs.count()
    n = docs.select(*_content(F.col(text))).groupBy("key", "own", "bytes").agg(F.count(F.lit(1)).alias("rows"))
    return n.filter(F.col("rows") * HOT > total).filter("rows > 1").select("key", "own", "bytes", F.ceil(F.col("rows") * HOT / max(total, 1)).alias("salts"))


def _salted(docs: DataFrame, hot: DataFrame, doc_id: str) -> DataFrame:
    """Rows with content columns get the group that they go to."""
    out = docs.join(F.broadcast(hot), ["key", "own", "bytes"], "left")
    return out.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.col(doc_id)), F.col("salts")), F.lit(0)).cast("long")).drop("salts")


def distinct_index(texts: DataFrame) -> DataFrame:
    """One row for each content and group of ``key, own, bytes, salt, text``: with ``n`` units and their coded ends."""
    small_batches(texts.sparkSession)
    kind = "key binary, own long, bytes int, salt long, text string, n long, width int, ends binary"
    lists = texts.select("key", "own", "bytes", "salt", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_lists, kind)
    one = F.first(F.struct("text", "n", "width", "ends")).alias("one")
    return lists.groupBy("key", "own", "bytes", "salt").agg(one).select("key", "own", "bytes", "salt", "one.*")


@F.pandas_udf(T.StructType([T.StructField("prefix", T.LongType()), T.StructField("rest", T.LongType())]))
def _cuts(n: pd.Series, width: pd.Series, ends: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
    rows = [selected(e, a, w, (j, k)) for a, w, e, j, k in zip(n, width, ends, low, high)]
    return pd.DataFrame(rows, columns=["prefix", "rest"], dtype="int64")


def fill_middle(docs: DataFrame, seed: int = 42, changed: int = 50, suffix_first: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Append ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``changed`` of 100 documents are transformed, of these ``suffix_first`` of 100 with the suffix first.
    """
    own = [c for c in docs.columns if c not in RESULTS]
    name = free_names(docs.select(*own), *KEYS, "salts", "index", "hashes", "cut", "missing", *RESULTS)
    text, doc_id, source = name.get(text, text), name.get(doc_id, doc_id), text
    rows = docs.select(*[F.col(c).alias(name.get(c, c)) for c in own])
    rows = _salted(rows.select("*", *_content(F.col(text))), _salts(rows, text), doc_id)
    index = distinct_index(rows.select(*KEYS, F.col(text).alias("text"))).select(*KEYS, F.struct("text", "n", "width", "ends").alias("index"))
    x = rows.withColumn("missing", F.col(text).isNull()).drop(text).join(index, list(KEYS))

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    x = x.withColumn("hashes", let(digest, lambda d: F.array(*[F.conv(F.substr(d, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4)])))
    n, body = F.col("index.n"), F.col("index.text")
    cut = lambda k: F.get("hashes", F.lit(k)) % (n + 1)
    x = x.withColumn("cut", _cuts(n, F.col("index.width"), F.col("index.ends"), F.least(cut(0), cut(1)), F.greatest(cut(0), cut(1))))
    plain = (body == "") | (F.get("hashes", F.lit(2)) % 100 >= changed)
    for marker in MARKERS:
        plain = plain | F.contains(body, F.lit(marker))
    x = x.withColumn("form", F.when(plain, "plain").when(F.get("hashes", F.lit(3)) % 100 < suffix_first, "spm").otherwise("psm"))
    a, b = F.col("cut.prefix"), F.col("cut.rest")
    part = lambda start, size: F.substr(body, (start + 1).cast("int"), size.cast("int"))
    pre, mid, suf = F.concat(F.lit(MARKERS[0]), part(F.lit(0), a)), F.concat(F.lit(MARKERS[2]), part(a, b - a)), F.concat(F.lit(MARKERS[1]), part(b, F.length(body)))
    output = F.when(F.col("form") == "plain", body).when(F.col("form") == "spm", F.concat(suf, pre, mid)).otherwise(F.concat(pre, suf, mid))
    changes = lambda c: F.when(F.col("form") != "plain", c)
    kept = [F.when(~F.col("missing"), body).alias(c) if c == source else F.col(name.get(c, c)).alias(c) for c in own]
    return x.select(*kept, n.alias("n"), "form", changes(a).alias("prefix_chars"), changes(b - a).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    def parts(*order: str) -> Column:
        second, third = F.instr(output, order[1]), F.instr(output, order[2])
        first = F.substr(output, F.lit(len(order[0]) + 1), second - len(order[0]) - 1)
        between = F.substr(output, second + len(order[1]), third - second - len(order[1]))
        return F.concat(*[x for _, x in sorted(zip((PARTS[m] for m in order), (first, between, F.substr(output, third + len(order[2]), F.length(output)))), key=lambda p: p[0])])

    return F.when(form == "spm", parts("<S>", "<P>", "<M>")).when(form == "psm", parts("<P>", "<S>", "<M>")).otherwise(output)
