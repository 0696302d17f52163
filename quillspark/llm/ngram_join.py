"""Exact Jaccard join of word 5-gram sets through prefix trees.

1. Each document becomes the set of hashes of its distinct shingles. Equal sets are one class, named by its least doc_id.
2. Shingles are counted over all documents, by ranges of their hashes. Those of one document only can't be part of an
   overlap; a set with too few others to reach the threshold links with nothing and is done.
3. The global order of shingles is by document frequency (up to 255), then by hash. Two sets that reach the threshold
   share a shingle within the first ``n - ceil(0.75 n) + 1`` of each, where those of one document come first. Joining
   documents to the least one that has a shingle there, and taking components, gives groups that no link can leave.
4. Each group's sets are stored in a trie in the global order (frequent first, so that paths are shared). A set goes
   through the trie once for all others: overlaps are counted along shared paths, and a subtree is left as soon as the
   shingles that remain in the set or below the node can't reach the threshold, or when all its sets are joined to the
   query's component already. Links found this way connect each group; components over them are the result.

A group of too many sets or bytes is split into blocks, and every pair of blocks is one task, so that no task holds an
unbounded group and no pair is lost. Tasks exchange shingles as arrays: four bytes each beside the number of the range, and
two for the document, so what is sent doesn't depend on the number of ranges.

A shingle is 64 bits; within the join 32 of them and the range tell it from others. A set of one or two shingles links with
equal sets alone, which the whole 64 bits tell (128 of their digest). Any other link takes three common shingles or more, so
a false one needs two sets that miss the threshold by one shingle and a collision between them besides.

Defined results: null or blank texts have an empty set, which links with nothing; texts of fewer than five words are one
shingle, their whole sequence; rows that repeat a doc_id and its text get equal rows; a doc_id with different texts is one
document for each of them, all under that name: each row has its own n_shingles and the class of its own set, and links of
any of its sets join the id, so all its rows have one component_id; rows with a null doc_id link with nothing; extra columns
are ignored; an empty table gives an empty result.
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

from .common import discard, saved, slices, small_batches, utf8
from .components import components

WORDS = 5
#: Two sets link when NUM * intersection >= DEN * (sum of sizes): a Jaccard similarity of 0.75.
NUM, DEN = 7, 3
#: Sets of a block, and bytes of their shingles; a task holds two blocks.
GROUP, GROUP_BYTES = 8192, 4 << 20
#: Bytes that are hashed at a time, and bytes of texts whose shingles travel together.
BLOCK, BATCH = 1 << 20, 8 << 20
#: Hash ranges for each input partition.
RANGES = 4

_RANDOM = np.random.default_rng(75)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = (int(x) * 2 + 1 for x in _RANDOM.integers(0, 1 << 62, 2))
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x)


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``b``, a block at a time: a text of any length takes only its words beside it."""
    hashes, firsts, open_word = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], False
    for at in range(0, len(b), BLOCK):
        part = _LOWER[b[at : at + BLOCK]]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~_SPACE[part]
        edge = np.diff(inside)
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _powers(_BASE, len(part)), out=total[1:])
        h = (total[end] - total[first]) * _powers(_INVERSE, len(part) + 1)[first]
        if open_word and inside[1]:
            # The rest of the word in which the block before ended.
            hashes[-1][-1:] += h[:1] * np.uint64(pow(_BASE, at - int(firsts[-1][-1]), 1 << 64))
            h, first = h[1:], first[1:]
        if len(h):
            hashes.append(h)
            firsts.append(first + at)
        open_word = bool(inside[-2])
    h, first = np.concatenate(hashes), np.concatenate(firsts)
    return (h ^ (h >> np.uint64(31))) * _MIX, first


def shingle_sets(data: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    at = 0
    while at < len(data):
        end, size = at, 0
        while end < len(data) and (end == at or size + len(data[end]) <= BLOCK):
            size += len(data[end])
            end += 1
        part = data[at:end]
        h, first = word_hashes(np.frombuffer(b" ".join(part), np.uint8))
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
        cuts = np.searchsorted(first, starts)
        n = len(h) - WORDS + 1
        s = np.zeros(max(n, 0), np.uint64)
        for k in range(WORDS):
            s += h[k : k + n] * np.uint64(pow(_STEP, k, 1 << 64)) if n > 0 else s
        s = (s ^ (s >> np.uint64(32))) * _MIX
        s ^= s >> np.uint64(29)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if j - i >= WORDS:
                x = np.sort(s[i : j - WORDS + 1])
                keep = np.ones(len(x), bool)
                keep[1:] = x[1:] != x[:-1]
                yield x[keep]
            elif j > i:
                powers = _powers(_STEP, j - i)
                x = (h[i:j] * powers).sum(dtype=np.uint64) + np.uint64(j - i)
                x = np.array([x])
                yield (x ^ (x >> np.uint64(32))) * _MIX
            else:
                yield np.zeros(0, np.uint64)
        at = end


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1 if n else 0


_ROW = pa.schema([("r", pa.int32()), ("batch", pa.string()), ("x", pa.binary()), ("n", pa.binary()), ("y", pa.binary())])


def _shingles(ranges: int):
    """By ranges: the shingles of each batch (x) with the number of their set (n), ordered by set; and one row that
    describes the batch's documents: ids (x), sizes (n), digests (y).

    Of equal sets in a batch only the first is sent.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in enumerate(slices(batches, BATCH)):
            # The same name if a lost task runs again.
            batch, seen, digests, sizes, sets, own = f"{TaskContext.get().partitionId()}-{k}", set(), [], [], [], []
            for i, h in enumerate(shingle_sets(utf8(rows.column("text")))):
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sizes.append(len(h))
                if len(h) and digests[-1] not in seen:
                    seen.add(digests[-1])
                    sets.append(h)
                    own.append(i)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(h) for h in sets])
            del sets
            part = ((flat >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint32)
            # What is left of the hash within its range.
            low = ((flat * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint32)
            del flat
            by = np.argsort(part.astype(np.uint16) if ranges <= 65536 else part, kind="stable")
            part, low, doc = part[by], low[by], doc[by]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
            out = [(int(part[i]), batch, low[i:j].tobytes(), doc[i:j].tobytes(), b"") for i, j in zip(cuts, cuts[1:]) if j > i]
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            out.append((ranges + zlib.crc32(batch.encode()) % ranges, batch, ids.tobytes(), np.array(sizes, np.int64).tobytes(),
                        np.array(own, np.int64).tobytes() + b"".join(digests)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROW)], schema=_ROW)

    return emit


def _frequencies(ranges: int):
    """Of each batch, the shingles that occur in two sets or more, with their frequency (y, up to 255)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["r"].iloc[0] >= ranges:
            return rows
        token = np.sort(np.frombuffer(b"".join(rows["x"]), np.uint32))
        at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        count = np.diff(np.append(at, len(token)))
        shared, times = token[at[count > 1]], np.minimum(count[count > 1], 255).astype(np.uint8)
        del token, at, count
        out = []
        for r, batch, x, n in zip(rows["r"], rows["batch"], rows["x"], rows["n"]):
            x = np.frombuffer(x, np.uint32)
            k = np.searchsorted(shared, x)
            k[k == len(shared)] = 0
            keep = shared[k] == x if len(shared) else np.zeros(len(x), bool)
            if keep.any():
                out.append((r, batch, x[keep].tobytes(), np.frombuffer(n, np.uint16)[keep].tobytes(), times[k[keep]].tobytes()))
        return pd.DataFrame(out, columns=["r", "batch", "x", "n", "y"])

    return run


def _documents(ranges: int):
    """The different sets of a batch: the ids that have it (ascending), size, digest, and its shared shingles in the global
    order, each as its frequency (8 bits), range (24) and hash within that (32).

    Sets that can't link with a different one have null shingles.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        about = rows[rows["r"] >= ranges].iloc[0]
        ids, sizes = np.frombuffer(about["x"], np.int64), np.frombuffer(about["n"], np.int64)
        own = np.frombuffer(about["y"][: len(about["y"]) - 16 * len(ids)], np.int64)
        digests = about["y"][8 * len(own) :]
        shared: list = [None] * len(own)
        rest = rows[rows["r"] < ranges]
        if len(rest):
            doc = np.frombuffer(b"".join(rest["n"]), np.uint16)
            token = np.frombuffer(b"".join(rest["x"]), np.uint32).astype(np.uint64)
            token |= np.repeat(rest["r"].to_numpy(np.uint64), rest["x"].str.len().to_numpy() // 4) << np.uint64(32)
            token |= np.frombuffer(b"".join(rest["y"]), np.uint8).astype(np.uint64) << np.uint64(56)
            n = np.bincount(doc, minlength=len(own))
            # Sets of one or two shingles link with equal ones alone.
            keep = ((4 * n >= 3 * sizes[own]) & (sizes[own] > 2))[doc]
            token, doc = token[keep], doc[keep]
            by = np.argsort(doc, kind="stable")
            token, cuts = token[by], np.searchsorted(doc[by], np.arange(len(own) + 1)).tolist()
            for i, (a, e) in enumerate(zip(cuts, cuts[1:])):
                if e > a:
                    shared[i] = np.sort(token[a:e]).tobytes()
        name = {digests[16 * i : 16 * i + 16]: k for k, i in enumerate(own.tolist())}
        members: list[list[int]] = [[] for _ in own]
        blank = []
        for i, doc_id in enumerate(ids.tolist()):
            members[name[digests[16 * i : 16 * i + 16]]].append(doc_id) if sizes[i] else blank.append(doc_id)
        digest = [digests[16 * i : 16 * i + 16] for i in own.tolist()]
        out = pd.DataFrame({"ids": [sorted(x) for x in members], "size": sizes[own], "digest": digest, "shared": shared})
        empty = pd.DataFrame({"ids": [[x] for x in blank], "size": np.zeros(len(blank), np.int64), "digest": [b""] * len(blank), "shared": [None] * len(blank)})
        return pd.concat([x for x in (out, empty) if len(x)] or [out])

    return run


_LOW, _RANGE = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFF)


def _prefixes(ranges: int):
    """By ranges: the shared shingles of each document's prefix, and the documents they come from."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            tokens, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc_id, n, x in zip(rows["doc_id"], rows["size"], rows["shared"]):
                # Shingles of one document come first in the order and join nothing.
                tokens.append(np.frombuffer(x, np.uint64)[: max(0, prefix_length(n) - (n - len(x) // 8))])
                owners.append(np.full(len(tokens[-1]), doc_id, np.int64))
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            part = ((token >> np.uint64(32)) & _RANGE).astype(np.uint32)
            by = np.argsort(part, kind="stable")
            token, owner, part = (token[by] & _LOW).astype(np.uint32), owner[by], part[by]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
            out = []
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    d, k = np.unique(owner[i:j], return_inverse=True)
                    out.append((int(part[i]), token[i:j].tobytes(), d.tobytes(), k.astype(np.uint32).tobytes()))
            yield pd.DataFrame(out, columns=["r", "h", "d", "k"])

    return emit


def _stars(rows: pd.DataFrame) -> pd.DataFrame:
    """Each document with a shingle, joined to the least one that has it."""
    h = np.frombuffer(b"".join(rows["h"]), np.uint32)
    d = np.concatenate([np.frombuffer(x, np.int64)[np.frombuffer(k, np.uint32)] for x, k in zip(rows["d"], rows["k"])])
    by = np.lexsort((d, h))
    h, d = h[by], d[by]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    least = np.repeat(d[at], np.diff(np.append(at, len(h))))
    keep = d != least
    return pd.DataFrame({"a": d[keep], "b": least[keep]}).drop_duplicates()


def trie_links(sets: list[np.ndarray], size: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Each set with the first of those that links connect it to: pairs of ids.

    ``sets`` hold the shingles that a set may share with others, in the global order; ``size`` counts all of them.
    """
    keys, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    lens = np.array([len(s) for s in sets])
    cuts = np.concatenate([[0], np.cumsum(lens)])
    # From the end of the global order, so that frequent shingles lead the paths.
    ranked = [(len(keys) - 1 - inverse[i:j])[::-1] for i, j in zip(cuts[:-1], cuts[1:])]
    order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
    ranked, lens, size, ids = [ranked[i] for i in order], lens[order], size[order], ids[order]

    # The trie, paths without branches as one node: depth of its end, sets below it (first, end), children.
    common = []
    for x, y in zip(ranked, ranked[1:]):
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        common.append(int(differ[0]) if len(differ) else n)
    root = [0, 0, len(sets), []]
    stack = [root]
    for i in range(len(sets)):
        depth = common[i - 1] if i else 0
        last = None
        while stack[-1][0] > depth:
            last = stack.pop()
            last[2] = i
        if stack[-1][0] < depth:
            # The path divides here: what hung below goes under a new node.
            node = [depth, last[1], i, [last]]
            stack[-1][3][-1] = node
            stack.append(node)
        if len(stack) > 1 and not stack[-1][3]:
            # The set that ends here becomes a child with an empty path, beside those that go on.
            stack[-1][3].append([depth, stack[-1][1], stack[-1][1] + 1, []])
        leaf = [int(lens[i]), i, i + 1, []]
        stack[-1][3].append(leaf)
        stack.append(leaf)
    while len(stack) > 1:
        stack.pop()[2] = len(sets)

    label = np.arange(len(sets))
    bounds: dict[int, tuple[int, int, int]] = {}  # of each node: least and greatest size below it, greatest depth
    mask = np.zeros(len(keys), bool)
    for q in range(1, len(sets)):
        # How many of the sets before each place are not joined to q yet.
        apart = np.concatenate([[0], np.cumsum(label[:q] != label[q])])
        if not apart[-1]:
            continue
        mask[ranked[q]] = True
        n = int(size[q])
        todo = [(child, 0, 0) for child in root[3]]
        while todo:
            node, depth, overlap = todo.pop()
            end, first, last, children = node
            if first >= q or apart[min(last, q)] == apart[first]:
                continue
            if id(node) not in bounds:
                below = size[first:last]
                bounds[id(node)] = (int(below.min()), int(below.max()), int(lens[first:last].max()))
            least, most, deepest = bounds[id(node)]
            if 4 * most < 3 * n or 3 * least > 4 * n:
                continue
            overlap += int(mask[ranked[first][depth:end]].sum())
            left = len(ranked[q]) - int(np.searchsorted(ranked[q], ranked[first][end - 1], side="right"))
            if NUM * (overlap + min(left, deepest - end)) < DEN * (n + least):
                continue
            if children:
                todo += [(child, end, overlap) for child in children]
            elif NUM * overlap >= DEN * (n + int(size[first])):
                label[label == label[q]] = label[first]
                apart = np.concatenate([[0], np.cumsum(label[:q] != label[q])])
        mask[ranked[q]] = False
    return [(int(ids[i]), int(ids[label[i]])) for i in range(len(sets)) if label[i] != i]


def _group_links(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("doc_id")  # the same links whatever order the rows arrive in
    sets = [np.frombuffer(x, np.uint64) for x in rows["shared"]]
    links = trie_links(sets, rows["size"].to_numpy(np.int64), rows["doc_id"].to_numpy(np.int64)) if len(sets) > 1 else []
    return pd.DataFrame(links, columns=["a", "b"]).astype(np.int64)


def _lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for rows in slices(batches, BATCH):
        n = [len(h) for h in shingle_sets(utf8(rows.column("text")))]
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none, none], ["doc_id", "n_shingles", "class_id", "component_id"])


def classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (least doc_id of an equal set), component_id."""
    small_batches(docs.sparkSession)
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = min(RANGES * max(4, texts.rdd.getNumPartitions()), 1 << 24)
    row = "r int, batch string, x binary, n binary, y binary"
    counted = texts.mapInArrow(_shingles(ranges), row).groupBy("r").applyInPandas(_frequencies(ranges), row)
    sets = counted.groupBy("batch").applyInPandas(_documents(ranges), "ids array<long>, size long, digest binary, shared binary")
    sets = saved(sets)

    # A class has a row for each batch that holds it; written, both sides are plain, and a class with a large part of all
    # batches can be split between tasks.
    named = saved(sets.filter("size > 0").groupBy("digest", "size").agg(F.min(F.element_at("ids", 1)).alias("class_id")))
    known = sets.join(named.hint("merge"), ["digest", "size"], "left").withColumn("class_id", F.coalesce("class_id", F.element_at("ids", 1)))
    known = saved(known.select("ids", F.col("size").alias("n_shingles"), "class_id", "shared"))

    # One set of each class goes on, under the class's name: of the batch that holds its least document. An id with
    # several texts names several classes; their sets go on one by one and meet under the id.
    able = known.filter("shared IS NOT NULL AND ids[0] = class_id")
    able = saved(able.select(F.col("class_id").alias("doc_id"), F.col("n_shingles").alias("size"), "shared").distinct())
    stars = able.mapInPandas(_prefixes(ranges), "r int, h binary, d binary, k binary")
    stars = stars.groupBy("r").applyInPandas(_stars, "a long, b long").distinct()
    groups = components(stars)

    # Large groups are cut to blocks; a set then goes with every pair of blocks that its own is in.
    weights = able.select(F.col("doc_id").alias("node"), F.length("shared").alias("bytes"))
    sizes = weights.join(groups, "node").groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("bytes") / GROUP_BYTES)).alias("blocks")
    )
    block = F.expr("pmod(xxhash64(node), blocks)")
    parts = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j")),
    )
    members = groups.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", F.explode(parts).alias("part"))
    links = able.join(members, "doc_id").groupBy("component", "part").applyInPandas(_group_links, "a long, b long")
    # Different sets under one id are joined by it.
    names = known.select(F.explode("ids").alias("doc_id"), "class_id").distinct()
    several = names.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("most")).filter("b < most")
    several = names.join(several, "doc_id").select(F.col("class_id").alias("a"), "b").filter("a <> b")
    joined = components(links.unionByName(several))
    discard(sets, named, able, groups)
    joined = joined.select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    out = known.select("n_shingles", "class_id", "ids").join(joined, "class_id", "left")
    out = out.select(F.explode("ids").alias("doc_id"), "n_shingles", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    lone = docs.filter("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return out.unionByName(lone.mapInArrow(_lone, "doc_id long, n_shingles long, class_id long, component_id long"))
