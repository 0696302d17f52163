"""Language identification with error-correcting output codes over hashed byte n-grams.

Each language has a codeword of BITS bits. One logistic classifier per bit is trained here to tell the languages whose bit
is set from the others; a text's language is the codeword with the least logistic loss against the classifiers' margins,
each bit weighted by how well its classifier fits. A text is flagged ``ambiguous`` if the two best codewords are close.

Training takes at most ``most`` documents of each language, chosen by a hash of their id, and whole texts of them.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no training rows all are ``und``;
rows with null text, language or doc_id are never learnt from; a language named ``und`` in the table is learnt like any
other; repeated rows get equal results; extra columns pass through, but those named ``lang_pred``, ``score`` and
``ambiguous`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, utf8
from .labels import fold, sample

FEATURES, BITS, MOST, MARGIN = 4096, 15, 400, 0.1
#: Bytes and texts that are counted at a time.
BLOCK, TEXTS = 1 << 20, 500
LETTER = re.compile(r"[^\W\d_]")
#: A to Z become small; digits and ASCII signs become spaces.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def counts(data: list[bytes]) -> np.ndarray:
    """Relative frequencies of hashed 2- and 3-grams of bytes (square roots, unit length), a row for each text."""
    out = np.zeros((len(data), FEATURES), np.float32)
    at = 0
    while at < len(data):
        end, n = at, 0
        while end < len(data) and (end == at or n + len(data[end]) <= BLOCK):
            n += len(data[end]) + 1
            end += 1
        part = data[at:end]
        total = np.zeros((end - at) * FEATURES, np.int64)
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
        b = _FOLD[np.frombuffer(b" ".join(part) + b" ", np.uint8)].astype(np.uint32)
        doc = np.repeat(np.arange(end - at, dtype=np.uint32), np.diff(starts)) * np.uint32(FEATURES)
        two = b[:-1] << np.uint32(8) | b[1:]
        for gram in (two, two[:-1] << np.uint32(8) | b[2:]):
            h = (gram * np.uint32(2654435761)) >> np.uint32(20)
            blank = (gram & np.uint32(0xFFFF)) == 0x2020
            k = (doc[: len(h)] + h)[~blank]
            total += np.bincount(k, minlength=len(total))
        out[at:end] = np.sqrt(total.reshape(-1, FEATURES))
        at = end
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def codewords(n: int, bits: int = BITS, seed: int = 8) -> np.ndarray:
    """``n`` codewords of +1 and -1, the best of many random draws by least and then total distance."""
    rng = np.random.default_rng(seed)
    bits = max(bits, 3 * int(np.ceil(np.log2(max(2, n)))))
    best, result = (-1, -1), None
    for _ in range(200):
        m = np.where(np.argsort(rng.random((bits, n)), 1) < (n + 1) // 2, 1, -1).T
        apart = (bits - m @ m.T) // 2
        other = apart[~np.eye(n, dtype=bool)] if n > 1 else np.array([bits])
        if (key := (int(other.min()), int(other.sum()))) > best:
            best, result = key, m
    return result


def train(rows: pd.DataFrame) -> dict | None:
    """Fit the classifiers to rows of ``lang`` and ``x`` (feature rows as bytes) by gradient steps on all of them."""
    if not len(rows):
        return None
    langs = sorted(set(rows["lang"]))
    x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"]]).astype(np.float32)
    code = codewords(len(langs))
    place = np.searchsorted(langs, rows["lang"].to_numpy())
    y = code[place].astype(np.float32)
    # Languages weigh alike however many rows they have.
    share = (1 / np.bincount(place, minlength=len(langs)))[place][:, None].astype(np.float32) / len(langs)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 121):
        g = -y * share / (1 + np.exp(y * (x @ w + b)))
        gw = x.T @ g + 1e-5 * w
        m += 0.1 * (gw - m)
        s += 0.01 * (gw * gw - s)
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-5)
        b -= 2.0 * g.sum(0)
    good = (share * (y * (x @ w + b) > 0)).sum(0)
    return {"langs": np.array(langs, object), "code": code, "w": w, "b": b, "weight": np.maximum(good - 0.5, 1e-3)}


def predict(model: dict, texts: list[bytes]) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    margin = counts(texts) @ model["w"] + model["b"]
    weight = model["weight"] / model["weight"].sum()
    loss = np.logaddexp(0, -margin[:, None, :] * model["code"][None]) @ weight
    best = loss.argmin(1)
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    second = np.sort(loss, 1)[:, 1] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    known = np.array([bool(LETTER.search(t.decode())) for t in texts], bool)
    lang = [model["langs"][k] if ok else "und" for ok, k in zip(known, best)]
    return lang, np.where(known, p[np.arange(len(best)), best], 0.0), known & (second - loss.min(1) < MARGIN)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, BLOCK, TEXTS):
        x = counts(utf8(rows.column("text"))).astype(np.float16)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "lang", "x"])


def fit(docs: DataFrame, most: int = MOST) -> dict | None:
    """Train on documents with a language outside the held-out fold."""
    small_batches(docs.sparkSession)
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    known = known.filter(fold(F.col("doc_id"), 4) != 2)
    chosen = sample(known, "lang", most).select("doc_id", F.col("lang").alias("_lang"))
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").filter("lang = _lang")
    x = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(_features, "doc_id long, lang string, x binary").toPandas()
    return train(x.sort_values(["lang", "doc_id"], kind="stable").reset_index(drop=True))


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """Append lang_pred, score and ambiguous to the documents."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, BLOCK, TEXTS):
            n = len(rows)
            found = (["und"] * n, np.zeros(n), np.zeros(n, bool)) if shared.value is None else predict(shared.value, utf8(rows.column("text")))
            for name, kind, x in zip(("lang_pred", "score", "ambiguous"), (pa.string(), pa.float64(), pa.bool_()), found):
                rows = rows.append_column(name, pa.array(x, kind))
            yield rows

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{types}, lang_pred string, score double, ambiguous boolean")
