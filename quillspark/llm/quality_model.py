"""Quality scores from random Fourier features of document statistics.

Each document is described by STATS statistics of its characters, words and lines. Random Fourier features approximate a
Gaussian kernel over them; ridge regression solves the normal equations, which tasks sum over their labelled rows; an
isotonic step function, fitted to counts in score bins, turns the ridge score into a probability. All labelled rows
outside the held-out fold take part; the driver holds matrices of a fixed size only.

Defined results: a null or empty text has zero statistics and is scored like any other; repeated rows get equal scores;
extra columns are ignored; labels without a document, or null, are ignored; with no labelled rows every score is 1; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, small_batches, utf8
from .labels import fold
from .ngram_join import _LOWER, _SPACE, word_hashes

STATS = ("chars", "words", "mean_word", "upper", "lower", "digit", "other", "symbol", "stop", "comma", "bang", "line", "distinct", "next_equal", "dup_lines", "marks_end", "single")
FREQUENCIES, RIDGE, WIDTH, BINS = 256, 1e-2, 10.0, 400
#: Bytes that are counted at a time, and groups of tasks whose sums are added up first.
BLOCK, MEET = 1 << 20, 256
_CLASS = np.full(256, 3, np.int64)
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), b"#*$%&|<>{}[]=+~^_@\\/", b".", b",", b"!?", b"\n", b"\t\x0b\x0c\r ")):
    _CLASS[list(_chars)] = _k


def statistics(data: list[bytes]) -> np.ndarray:
    """A row of STATS for each text."""
    out = np.zeros((len(data), len(STATS)))
    at = 0
    while at < len(data):
        end, n = at, 0
        while end < len(data) and (end == at or n + len(data[end]) <= BLOCK):
            n += len(data[end]) + 1
            end += 1
        part, rows = data[at:end], out[at:end]
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
        b = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        doc = np.repeat(np.arange(end - at), np.diff(starts))
        kinds = np.bincount(doc * 10 + _CLASS[b], minlength=(end - at) * 10).reshape(-1, 10).astype(float)
        h, first = word_hashes(b)
        own = doc[first]
        words = np.bincount(own, minlength=end - at).astype(float)
        size = np.array([len(x) for x in part], float)
        share = lambda x, of: x / np.maximum(of, 1)
        rows[:, 0], rows[:, 1] = np.log1p(size), np.log1p(words)
        rows[:, 2] = share(size - kinds[:, 8] - kinds[:, 9], words)
        rows[:, 3:8] = share(kinds[:, :5], size[:, None])
        rows[:, 8:11] = share(kinds[:, 5:8], words[:, None])
        rows[:, 11] = share(kinds[:, 8], words)
        order = np.lexsort((h, own))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
        rows[:, 12] = share(np.bincount(own[order][fresh], minlength=end - at), words)
        again = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        rows[:, 13] = share(np.bincount(own[1:][again], minlength=end - at), words)
        lines = [[x for x in d.split(b"\n") if x.strip()] for d in part]
        rows[:, 14] = [(len(x) - len(set(x))) / max(1, len(x)) for x in lines]
        last = b[np.append(first[1:], len(b)) - 2] if len(first) else b[:0]
        rows[:, 15] = share(np.bincount(own[(_CLASS[last] == 4) | (_CLASS[last] == 7)], minlength=end - at), words)
        length = np.diff(np.append(first, len(b)))
        rows[:, 16] = share(np.bincount(own[length <= 2], minlength=end - at), words)
        at = end
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, BLOCK):
        x = statistics(utf8(rows.column("text")))
        x = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), x], ["doc_id", "x"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics ``x`` (array<double>)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_described, "doc_id long, x array<double>")


def _fourier(x: np.ndarray, model: dict) -> np.ndarray:
    z = (x - model["mean"]) / model["scale"]
    z = np.cos(np.clip(z, -6, 6) @ model["w"] + model["shift"]) * np.sqrt(2 / FREQUENCIES)
    return np.concatenate([z, np.ones((len(z), 1))], 1)


def _summed(f, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum ``f`` over the rows of a task; one row for each row of the sum."""
    total = None
    for rows in batches:
        if len(rows):
            part = f(np.stack(rows["x"].to_list()), rows["y"].to_numpy(float))
            total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"g": TaskContext.get().partitionId() % MEET, "i": np.arange(len(total)), "v": list(total)})


def _sums(rows: DataFrame, f) -> np.ndarray | None:
    """The sum of ``f`` over all rows, added up row by row of the result, in groups of tasks first."""
    parts = rows.mapInPandas(lambda batches: _summed(f, batches), "g int, i int, v array<double>")
    add = lambda pdf: pd.DataFrame({"g": pdf["g"].iloc[:1], "i": pdf["i"].iloc[:1], "v": [np.stack(pdf["v"].to_list()).sum(0)]})
    parts = parts.groupBy("g", "i").applyInPandas(add, "g int, i int, v array<double>")
    out = parts.groupBy("i").applyInPandas(add, "g int, i int, v array<double>").toPandas().sort_values("i")
    return np.stack(out["v"].to_list()) if len(out) else None


def isotonic(bins: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins (b, n, y) in order: last bin and mean of each level."""
    levels: list[list[float]] = []
    for b, n, y in bins.sort_values("b")[["b", "n", "y"]].itertuples(index=False):
        levels.append([b, n, y])
        while len(levels) > 1 and levels[-2][2] * levels[-1][1] >= levels[-1][2] * levels[-2][1]:
            b, n, y = levels.pop()
            levels[-1] = [b, levels[-1][1] + n, levels[-1][2] + y]
    return np.array([x[0] for x in levels]), np.array([x[2] / x[1] for x in levels])


def fit(described: DataFrame, labels: DataFrame, seed: int = 9) -> dict | None:
    """Fit on every labelled row outside the held-out fold."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id"), 5) != 0)
    rows = saved(described.join(known.select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id").select("x", "y"))
    moments = _sums(rows, lambda x, y: np.stack([np.ones(x.shape[1]) * len(x), x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return None
    n, mean = moments[0, 0], moments[1] / moments[0]
    rng = np.random.default_rng(seed)
    model = {
        "mean": mean, "scale": np.sqrt(np.maximum(moments[2] / n - mean**2, 1e-9)),
        "w": rng.normal(0, 1 / WIDTH, (len(STATS), FREQUENCIES)), "shift": rng.uniform(0, 2 * np.pi, FREQUENCIES),
    }

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = _fourier(x, model)
        return np.concatenate([z.T @ z, (z.T @ y)[:, None]], 1)

    ab = _sums(rows, equations)
    model["beta"] = np.linalg.solve(ab[:, :-1] + RIDGE * n / FREQUENCIES * np.eye(len(ab)), ab[:, -1])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b = np.clip(_fourier(np.stack(pdf["x"].to_list()), model) @ model["beta"], -0.5, 1.5)
                yield pd.DataFrame({"b": np.floor(b * BINS).astype(np.int32), "y": pdf["y"]})

    bins = rows.mapInPandas(binned, "b int, y double").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    model["edges"], model["levels"] = isotonic(bins.toPandas())
    return model


def score(described: DataFrame, model: dict | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted for described documents."""
    shared = described.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            m, s = shared.value, np.ones(len(rows))
            if m is not None and len(rows):
                b = np.floor(np.clip(_fourier(np.stack(rows["x"].to_list()), m) @ m["beta"], -0.5, 1.5) * BINS)
                s = m["levels"][np.minimum(np.searchsorted(m["edges"], b), len(m["levels"]) - 1)]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": s})

    out = described.mapInPandas(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
