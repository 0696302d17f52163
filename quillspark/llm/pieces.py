"""SentencePiece encoding that keeps the place of every piece, and decoding.

A text is normalised through the model's compiled character map: at each place the longest prefix in the map's double-array
trie is replaced, and each normalised byte remembers the source byte its replacement began at. The normalised text is cut
where no piece of the vocabulary can reach across, each segment is merged pair by pair (best score, then leftmost), and the
ends of the pieces are projected through the alignment to byte spans of the original text. Characters without a piece become
one piece a byte, of which the last has the character's span and the others an empty one at its start.

Segments recur, so each task keeps those it has merged, about twice CACHED of them; a text of any length goes by in chunks if the map is
empty, and in one piece otherwise. Nothing is shuffled, so neither hot sources nor copies matter. The model is a file of
fixed size that goes with the plan; no file of it is needed on the executors.

Defined results: a null text counts as empty and has no pieces; null ids decode to an empty text. Ids of control pieces decode
to nothing, bytes that are no UTF-8 to U+FFFD each. Repeated rows are encoded one by one. Extra columns pass through unless
they bear the name of a result column, which replaces them.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, small_batches, utf8

SPACE = "▁"
#: Segments that a task remembers, the longest of them, and bytes of text or ids that are worked on at once.
CACHED, LONGEST, CHUNK, SLICE = 3 << 16, 48, 1 << 20, 1 << 20
#: Characters of a unit that is merged by itself, with a heap; no merger; and the number of the first character without a symbol.
LONG_UNIT, NONE, FOREIGN = 64, 1 << 30, 1 << 28
#: The kinds of pieces in a model.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("each byte", lambda e: ("�", e.start + 1))


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie over UTF-8 bytes, with replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]
        self.starts = re.compile(self._starts(), re.DOTALL)

    def _child(self, node: int, c: int) -> tuple[int, int] | None:
        """The unit at this byte below a node, and the node there."""
        at = node ^ c
        if at >= len(self.units) or self.units[at] & 0x800000FF != c:
            return None
        return self.units[at], at ^ self._offset(self.units[at])

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def _starts(self) -> bytes:
        """A pattern for the places where a prefix can start, by its first two bytes."""
        root, out = self._offset(self.units[0]), []
        one_of = lambda chars: b"[" + b"".join(b"\\x%02x" % c for c in chars) + b"]"
        for c in range(1, 256):
            if first := self._child(root, c):
                if first[0] >> 8 & 1:
                    out.append(one_of([c]))
                elif more := [d for d in range(1, 256) if self._child(first[1], d)]:
                    out.append(one_of([c]) + one_of(more))
        return b"|".join(out) or b"(?!)"

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix that starts here."""
        node, found = self._offset(self.units[0]), None
        for n, c in enumerate(memoryview(text)[at:], 1):
            if (step := self._child(node, c)) is None:
                break
            unit, node = step
            if unit >> 8 & 1:
                found = n, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def replaced(self, text: bytes) -> Iterator[tuple[bytes, int]]:
        """Each replacement with the length of what it replaces; what stays comes character by character."""
        at = 0
        while at < len(text):
            place = self.starts.search(text, at)
            until = place.start() if place else len(text)
            yield from ((x, len(x)) for x in (c.encode() for c in text[at:until].decode()))
            at = until
            if place:
                if found := self.longest(text, at):
                    yield found[1], found[0]
                    at += found[0]
                else:
                    n = 1
                    while at + n < len(text) and text[at + n] & 0xC0 == 0x80:
                        n += 1
                    yield text[at : at + n], n
                    at += n


class Pieces:
    """A BPE model with byte fallback, read from a model file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        norm, kinds = m.normalizer_spec, {p.type for p in m.pieces}
        if m.trainer_spec.model_type != pb.TrainerSpec.BPE or not m.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model must be BPE with byte fallback and have no user-defined or unused pieces")
        if not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or m.denormalizer_spec.precompiled_charsmap:
            raise ValueError("white space must be escaped and lead its word, and decoding must need no map")
        self.prefix, self.squeezed = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.map = CharacterMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.ids = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        # Segments of late and those of before, which go when their number is reached again.
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}
        self.spelled = [b"" if p.type == CONTROL else m.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else
                        bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in m.pieces]
        self.controls = {i for i, p in enumerate(m.pieces) if p.type == CONTROL}
        self.plain = [p.type == NORMAL for p in m.pieces]

    @functools.cached_property
    def reaches(self) -> np.ndarray:
        """Pairs of neighbouring characters that some piece holds; between others no piece can reach."""
        return np.array(sorted({ord(a) << 21 | ord(b) for x in self.ids for a, b in zip(x, x[1:])}) or [-1], np.int64)

    @functools.cached_property
    def by_word(self) -> bool:
        """No piece reaches from a word to the white space after it: then words are segments."""
        return not ((self.reaches & 0x1FFFFF == ord(SPACE)) & (self.reaches >> 21 != ord(SPACE))).any()

    @functools.cached_property
    def segments(self) -> re.Pattern:
        # Plain signs that stand beside others in no piece, such as line ends, are segments of their own.
        beside = {int(x) for pair in (self.reaches >> 21, self.reaches & 0x1FFFFF) for x in pair}
        alone = "".join(f"\\x{c:02x}" for c in range(128) if c not in beside)
        own = f"|[{alone}]+" if alone else ""
        return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+{own}" if self.by_word else "(?s:.+)")

    def _tables(self) -> None:
        """Numbers for pieces and for the characters in them, and all pairs that make a piece, ranked by its score."""
        self.symbols = {x: k for k, x in enumerate(dict.fromkeys([*self.ids, *"".join(self.ids)]))}
        named = list(self.symbols)
        self.piece_id = np.array([self.ids[x][0] if x in self.ids else -1 for x in named], np.int64)
        self.piece_bytes = np.array([len(x.encode()) for x in named], np.int64)
        self.char_code = np.array([ord(x) if len(x) == 1 else -1 for x in named], np.int64)
        self.symbol_of = np.full(int(self.char_code.max(initial=0)) + 1, -1, np.int64)
        single = self.char_code >= 0
        self.symbol_of[self.char_code[single]] = np.flatnonzero(single)
        self.byte_id = np.array([self.bytes[b] for b in range(256)], np.int64)
        rank = {score: k for k, score in enumerate(sorted({score for _, score in self.ids.values()}, reverse=True))}
        pairs = sorted(
            (self.symbols[x[:k]] << 32 | self.symbols[x[k:]], rank[self.ids[x][1]], self.symbols[x])
            for x in self.ids for k in range(1, len(x)) if x[:k] in self.symbols and x[k:] in self.symbols
        ) or [(-1, NONE, 0)]
        self.pairs, self.pair_rank, self.pair_made = np.array(pairs, np.int64).T.copy()

    def normalised(self, text: bytes, first: bool) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte; ``first``: not a later chunk."""
        if self.map is None and not self.squeezed:
            dummy = self.prefix and first and bool(text)
            b = np.frombuffer(text, np.uint8)
            source = np.repeat(np.arange(len(b) + 1), np.append(np.where(b == 32, 3, 1), 1))
            out = text.decode().replace(" ", SPACE)
            return (SPACE + out, np.append([0, 0, 0], source)) if dummy else (out, source)
        steps = list(self.map.replaced(text) if self.map else ((c.encode(), len(c.encode())) for c in text.decode()))
        at, done = 0, 0
        while self.squeezed and done < len(steps) and steps[done][0] == b" ":
            at += steps[done][1]
            done += 1
        out, sizes, places = [], [], []
        if done < len(steps) and self.prefix:
            out, sizes, places = [SPACE.encode()], [3], [at]
        spaced = self.squeezed
        for to, n in steps[done:]:
            if spaced:
                to = to.lstrip(b" ")
            if to:
                out.append(to.replace(b" ", SPACE.encode()))
                sizes.append(len(out[-1]))
                places.append(at)
                spaced = self.squeezed and to.endswith(b" ")
            at += n
        whole, source = b"".join(out), np.repeat(np.array(places, np.int64), np.array(sizes, np.int64))
        while self.squeezed and whole.endswith(SPACE.encode()):
            whole, at, source = whole[:-3], int(source[len(whole) - 3]), source[:-3]
        return whole.decode(), np.append(source, at)

    def merged(self, text: str) -> list[str]:
        """A segment as its pieces and the characters without one."""
        symbols, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (found := self.ids.get(symbols[left] + symbols[right])):
                heapq.heappush(heap, (-found[1], left, right, len(symbols[left]) + len(symbols[right])))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols the rank of their merger, NONE without one, and the symbol that it makes."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE), self.pair_made[at]

    def _merged_units(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all units at once, in each round the best pair of each; returns symbols and their units, in order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def looked_up(at: np.ndarray) -> None:
            rank[at], made[at] = self._ranks(symbols[at], symbols[at + 1])
            rank[at[unit[at] != unit[at + 1]]] = NONE

        rank, made = np.full(len(symbols), NONE, np.int64), np.zeros(len(symbols), np.int64)
        looked_up(np.arange(len(symbols) - 1))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(symbols)), starts)
            ends = np.repeat(best >> 32 == NONE, np.diff(np.append(starts, len(symbols))))
            done.append((symbols[ends], unit[ends]))
            at = best[best >> 32 != NONE] & 0xFFFFFFFF
            symbols[at] = made[at]
            keep = ~ends
            keep[at + 1] = False
            # The merged symbols meet new neighbours on both sides.
            place = (np.cumsum(keep) - 1)[at]
            symbols, unit, rank, made = symbols[keep], unit[keep], rank[keep], made[keep]
            if len(place):
                rank[place] = NONE
                near = np.concatenate([place, place[place > 0] - 1])
                looked_up(near[near < len(symbols) - 1])
        whole, units = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(units, kind="stable")
        return whole[order], units[order]

    def learn(self, segments: list[str]) -> None:
        """Merge these segments and remember their pieces: ids and lengths in normalised bytes, as packed int32."""
        if not hasattr(self, "pairs"):
            self._tables()
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        symbols = np.where(codes < len(self.symbol_of), self.symbol_of[np.minimum(codes, len(self.symbol_of) - 1)], -1)
        symbols = np.where(symbols < 0, FOREIGN + codes, symbols)
        starts = np.cumsum(sizes) - sizes
        begins = np.ones(len(codes), bool)
        pair = codes[:-1] << 21 | codes[1:]
        begins[1:] = self.reaches[np.minimum(np.searchsorted(self.reaches, pair), len(self.reaches) - 1)] != pair
        begins[starts] = True
        unit = np.cumsum(begins) - 1
        length = np.bincount(unit)
        long = length > LONG_UNIT
        parts = [(symbols[x], unit[x]) for x in [length[unit] == 1] if x.any()]
        middle = (length[unit] > 1) & ~long[unit]
        if middle.any():
            parts.append(self._merged_units(symbols[middle], unit[middle]))
        where = np.flatnonzero(begins)
        for u in np.flatnonzero(long):
            text = codes[where[u] : where[u] + length[u]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            own = [self.symbols.get(x, FOREIGN + ord(x[0])) for x in self.merged(text)]
            parts.append((np.array(own, np.int64), np.full(len(own), u)))
        symbols, unit = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(unit, kind="stable")
        symbols, unit = symbols[order], unit[order]
        known = symbols < len(self.piece_id)
        ids = np.where(known, self.piece_id[np.where(known, symbols, 0)], -1)
        code = np.where(known, self.char_code[np.where(known, symbols, 0)], symbols - FOREIGN)
        byte_n = np.where(ids >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        size = np.where(ids >= 0, self.piece_bytes[np.where(known, symbols, 0)], byte_n)
        first = np.cumsum(byte_n) - byte_n
        out, lens = np.repeat(ids, byte_n), np.zeros(int(byte_n.sum()), np.int32)
        lens[first + byte_n - 1] = size
        for n in range(1, 5):
            at = np.flatnonzero((ids < 0) & (byte_n == n))
            for k in range(n):
                bits = code[at] >> 6 * (n - 1 - k)
                lead = bits if n == 1 else bits | (0xF00 >> n & 0xFF) if k == 0 else bits & 0x3F | 0x80
                out[first[at] + k] = self.byte_id[lead]
        out = out.astype(np.int32)
        firsts = np.append(first[np.searchsorted(unit, np.append(0, np.cumsum(begins))[starts])], len(out)).tolist()
        for segment, a, b in zip(segments, firsts, firsts[1:]):
            self.cache[segment] = out[a:b].tobytes(), lens[a:b].tobytes()

    def chunks(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """A long text in chunks that no piece reaches across, if its normalisation is bytewise."""
        at = 0
        while self.map is None and not self.squeezed and self.by_word and len(text) - at > CHUNK:
            end = text.rfind(b" ", at + 1, at + CHUNK)
            while end > at and text[end - 1] == 32:
                end -= 1
            # A space of the text's own sign for spaces may stand before: then segments differ, and the chunk grows.
            if end <= at or text[:end].endswith(SPACE.encode()):
                break
            yield at, text[at:end]
            at = end
        yield at, text[at:]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the ids, and begin and end of each piece in the text's bytes."""
        chunks = [[(at, *self.normalised(chunk, at == 0)) for at, chunk in self.chunks(t)] for t in texts]
        cut = [[self.segments.findall(whole) for _, whole, _ in c] for c in chunks]
        if len(self.cache) > CACHED:
            self.cache, self.before = {}, self.cache
        new = []
        for x in {x for c in cut for segments in c for x in segments}:
            if x not in self.cache:
                if found := self.before.get(x):
                    self.cache[x] = found
                else:
                    new.append(x)
        if new:
            self.learn(new)
        out = []
        for c, parts in zip(chunks, cut):
            own = []
            for (at, _, source), segments in zip(c, parts):
                found = list(map(self.cache.__getitem__, segments))
                ids, sizes = (np.frombuffer(b"".join(f[k] for f in found), np.int32) for k in (0, 1))
                ends = np.cumsum(sizes, dtype=np.int64)
                own.append((ids, (source[ends - sizes] + at).astype(np.int32), (source[ends] + at).astype(np.int32)))
            out.append(own[0] if len(own) == 1 else tuple(np.concatenate(x) for x in zip(*own)))
        for segment in new:
            if len(segment) > LONGEST:
                self.cache.pop(segment, None)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of these ids. Between bytes that make a character no control piece may stand."""
        spelled = [self.spelled[i] for i in ids]
        if self.prefix or self.squeezed:
            # The space that the encoder puts first goes again.
            for k, i in enumerate(ids):
                if self.plain[i] and spelled[k].startswith(b" "):
                    spelled[k] = spelled[k][1:]
                    if not self.squeezed:
                        break
                if spelled[k]:
                    break
        runs, at = [], 0
        for k in (k for k, i in enumerate(ids) if i in self.controls):
            runs.append(spelled[at:k])
            at = k + 1
        return "".join(b"".join(r).decode("utf-8", "each byte") for r in (*runs, spelled[at:]))


    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of lists of ids, given as one array and the length of each. The pieces of all lists are laid out at once;
        lists with what needs care are decoded one by one."""
        if not hasattr(self, "laid_out"):
            self.laid_out, self.careful = pa.array(self.spelled, pa.binary()), np.array([i in self.controls or not p for i, p in enumerate(self.plain)])
        laid = self.laid_out.take(pa.array(ids, pa.int32()))
        offsets = np.frombuffer(laid.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data, out = memoryview(laid.buffers()[2] or b""), []
        ends = np.cumsum(sizes)
        care = np.append(0, np.cumsum(self.careful[ids]))
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            text = None
            if care[b] == care[a] or not np.isin(ids[a:b], list(self.controls)).any() and (a == b or self.plain[ids[a]]):
                own = bytes(data[offsets[a] : offsets[b]])
                if (self.prefix or self.squeezed) and own[:1] == b" " and not (self.squeezed and own.startswith(b"  ")):
                    own = own[1:]
                try:
                    text = own.decode()
                except UnicodeDecodeError:
                    text = None
            out.append(self.decode(ids[a:b].tolist()) if text is None or self.squeezed else text)
        return out


@functools.lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def _with_columns(docs: DataFrame, fields: list[tuple[str, T.DataType]], run) -> DataFrame:
    """Append columns that ``run`` gives for each batch, in place of any of the same names."""
    names = {n for n, _ in fields}
    docs = docs.select(*[c for c in docs.columns if c not in names])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in fields)])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, columns in run(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(n for n, _ in fields)])

    return docs.mapInArrow(mapped, schema)


def encode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Append ``ids``, ``begins`` and ``ends`` (arrays of int; places in the text's UTF-8 bytes), without begin or end ids."""
    small_batches(docs.sparkSession)
    _pieces(model)

    def run(batches: Iterator[pa.RecordBatch]):
        pieces = _pieces(model)
        for batch in slices(batches, SLICE, text=text):
            found = pieces.encode(utf8(batch.column(text)))
            offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
            yield batch, [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *(f[k] for f in found)]))) for k in range(3)]

    numbers = T.ArrayType(T.IntegerType())
    return _with_columns(docs, [("ids", numbers), ("begins", numbers), ("ends", numbers)], run)


def decode(rows: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Append ``decoded``, the text of the ids."""
    small_batches(rows.sparkSession)
    _pieces(model)

    def run(batches: Iterator[pa.RecordBatch]):
        pieces = _pieces(model)
        for batch in batches:
            lens = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(lens):
                end = max(at + 1, int(np.searchsorted(lens, (lens[at - 1] if at else 0) + SLICE // 4, side="right")))
                own = batch.slice(at, end - at)
                sizes = np.diff(lens[at:end], prepend=lens[at - 1] if at else 0)
                yield own, [pa.array(pieces.decoded(own.column(ids).flatten().to_numpy(zero_copy_only=False), sizes), pa.string())]
                at = end

    return _with_columns(rows, [("decoded", T.StringType())], run)
