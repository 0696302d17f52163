"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Words are runs of letters and digits, wherever they stand ('you/moron' is two), in pieces of LONGEST characters; scripts
without spaces give a word for each character, and signs count where they stand alone. A word's input is the sum of hashed
embeddings of the word and of its characters (its ends of three and five and each GRAM characters within), so that
inflected, unseen and hidden words share evidence. Windows of WINDOW words, one every STRIDE, cover the whole text; a
document's score is that of its ADJACENT worst windows in a row, however long it is. The network runs over many windows at a
time, one step for each place in the window; the projections of a word's input are computed once for each different word of
a batch.

Training takes at most ``most`` labelled documents of each class, chosen by a hash of their id, with all their windows. A
toxic document needs only one toxic window: after a first pass over all windows, each round trains on the worst windows of
toxic documents, and on the worst and some other windows of clean ones. Windows are drawn document by document, so a long
text weighs no more than a short one. A quarter of the documents is kept apart to turn the worst windows' score into a
probability (logistic calibration, weighted by the classes' frequencies).

Defined results: a null, empty or blank text has no window and score 0; texts in any script have words; repeated rows get
equal scores; extra columns pass through, but those named ``score`` and ``predicted`` are replaced; labels without a
document, or null, are ignored, and of contradicting labels of one document either may be taken; with no labelled rows of one
of the classes every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .labels import fold, sample

WINDOW, STRIDE = 32, 16
TABLE, DIM, HIDDEN = 1 << 16, 8, 8
#: A document's score is the highest mean logit of so many windows in a row; a text of fewer counts with all of them.
ADJACENT = 2
#: Labelled documents of each class that training takes at most.
MOST = 1500
#: Bytes of texts that go through the network at a time, and different words whose features a worker remembers.
PART, REMEMBERED = 1 << 20, 1 << 16
ROUNDS, STEPS, BATCH = 8, 120, 128
#: Documents in which a feature must occur for its embedding to be trained; all others stay zero.
SEEN = 3
#: The pull of embeddings towards zero.
DECAY = 1e-2
#: First learning rate. Windows of a toxic document that score this share of its worst one are taken for toxic.
RATE, NEAR = 0.01, 0.7
#: Characters of a word at most, and of the pieces within it; features of a word at most.
LONGEST, GRAM = 16, 4
FEATURES = 5 + LONGEST - GRAM + 1
#: Scripts without spaces, and those whose vowel signs are no letters to the pattern language.
SPACELESS = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
MARKED = "\u0300-\u036f\u0591-\u05bd\u05d0-\u05ea\u0610-\u061a\u0620-\u0669\u066e-\u06d3\u0900-\u0963\u0966-\u0dff"
WORDS = re.compile(rf"[{SPACELESS}]|[{MARKED}]{{1,{LONGEST}}}|[^\W_{SPACELESS}{MARKED}]{{1,{LONGEST}}}|(?<!\S)(?:[^\w\s{SPACELESS}{MARKED}]|_)++(?!\S)")
Net = dict[str, np.ndarray]


def features(w: str) -> list[int]:
    """Rows of the embedding table for a word: itself, its ends and its inner pieces."""
    parts = ["=" + w]
    for n in (3, 5):
        if len(w) > n:
            parts += ["^" + w[:n], "$" + w[-n:]]
    if len(w) > GRAM:
        parts += [w[i : i + GRAM] for i in range(min(len(w), LONGEST) - GRAM + 1)]
    return [zlib.crc32(p.encode("utf-8", "replace")) % TABLE for p in parts]


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if isinstance(text, str) else []


def starts(n: int) -> range | list[int]:
    """First words of the windows of a text of ``n`` words; the last window ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_net(seed: int = 6) -> Net:
    rng = np.random.default_rng(seed)
    net = {"E": rng.normal(0, 0.3, (TABLE, DIM)), "v": rng.normal(0, 0.3, 2 * HIDDEN), "w": rng.normal(0, 0.3, 2 * HIDDEN), "c": np.zeros(1)}
    for d in "fb":
        net |= {f"W{d}": rng.normal(0, 0.4, (DIM, 3 * HIDDEN)), f"U{d}": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"b{d}": np.zeros(3 * HIDDEN)}
    return {k: x.astype(np.float32) for k, x in net.items()}


def _run(net: Net, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (steps, windows, HIDDEN) of one direction, given the projected inputs (steps, windows, 3 HIDDEN)."""
    k, u = HIDDEN, net[f"U{d}"]
    ug, uc = np.ascontiguousarray(u[:, : 2 * k]), np.ascontiguousarray(u[:, 2 * k :])
    h, out, tape = np.zeros((x.shape[1], k), u.dtype), np.empty((len(x), x.shape[1], k), u.dtype), []
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        gates = h @ ug
        gates += x[t][:, : 2 * k]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :k], gates[:, k:]
        c = (r * h) @ uc
        c += x[t][:, 2 * k :]
        np.tanh(c, out=c)
        if keep:
            tape.append((t, h, z, r, c.copy()))
        c -= h
        c *= z
        c += h
        out[t] = h = c
    return out, tape


def _pool(net: Net, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention over the steps: weights, pooled states, scores."""
    e = np.where(mask, h @ net["v"], np.float32(-1e9))
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tbh,tb->bh", h, a)
    return a, pooled, _sigmoid(pooled @ net["w"] + net["c"])


def _gradients(net: Net, rows: np.ndarray, mask: np.ndarray, y: np.ndarray) -> Net:
    """Gradients of the log loss. ``rows``: (steps, windows, features) rows of the table, -1 for none."""
    x = np.where(rows[..., None] >= 0, net["E"][rows], 0).sum(2) * mask[..., None]
    g = {k: np.zeros_like(v) for k, v in net.items()}
    runs = {d: _run(net, d, x @ net[f"W{d}"] + net[f"b{d}"], True) for d in "fb"}
    h = np.concatenate([runs["f"][0], runs["b"][0]], 2)
    a, pooled, p = _pool(net, h, mask)
    dp = (p - y) / len(y)
    g["c"][0] = dp.sum()
    g["w"] = pooled.T @ dp
    dpool = dp[:, None] * net["w"]
    da = np.einsum("tbh,bh->tb", h, dpool)
    de = a * (da - (a * da).sum(0))
    g["v"] = np.einsum("tbh,tb->h", h, de)
    dh = a[..., None] * dpool + de[..., None] * net["v"]
    dx, k = np.zeros_like(x), HIDDEN
    for d, part in (("f", dh[..., :k]), ("b", dh[..., k:])):
        u, w, back = net[f"U{d}"], net[f"W{d}"], np.zeros((x.shape[1], k), np.float32)
        for t, h0, z, r, c in reversed(runs[d][1]):
            back = back + part[t]
            dc = back * z * (1 - c * c)
            drh = dc @ u[:, 2 * k :].T
            dz, dr = back * (c - h0) * z * (1 - z), drh * h0 * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], 1)
            g[f"U{d}"][:, : 2 * k] += h0.T @ dg[:, : 2 * k]
            g[f"U{d}"][:, 2 * k :] += (r * h0).T @ dc
            g[f"W{d}"] += x[t].T @ dg
            g[f"b{d}"] += dg.sum(0)
            dx[t] += dg @ w.T
            back = back * (1 - z) + drh * r + dg[:, : 2 * k] @ u[:, : 2 * k].T
    dx *= mask[..., None]
    ok = rows >= 0
    word = np.nonzero(ok)
    for i in range(DIM):
        g["E"][:, i] = np.bincount(rows[ok], dx[word[0], word[1], i], len(net["E"]))
    return g


@functools.lru_cache(REMEMBERED)
def _row(w: str) -> bytes:
    f = features(w)
    return np.array(f + [-1] * (FEATURES - len(f)), np.int32).tobytes()


def _table(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_row, words)), np.int32).reshape(len(words), FEATURES)


def _hidden(net: Net, inputs: dict[str, np.ndarray], word: np.ndarray) -> np.ndarray:
    return np.concatenate([_run(net, d, inputs[d][word], False)[0] for d in "fb"], 2)


def _inputs(net: Net, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Projected inputs of words given by their table rows; one more for the places that a short text leaves empty."""
    x = np.zeros((len(rows), DIM), np.float32)
    for i in range(0, len(rows), 4096):
        part = rows[i : i + 4096]
        x[i : i + 4096] = np.where(part[..., None] >= 0, net["E"][part], 0).sum(1)
    return {d: np.concatenate([x @ net[f"W{d}"] + net[f"b{d}"], net[f"b{d}"][None]]).astype(np.float32) for d in "fb"}


def _read(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the different words, and the word at each place of the joined texts; for each window its first place,
    the end of its text and the number of its text."""
    vocab: dict[str, int] = {}
    words = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t in texts]
    flat = np.concatenate([*words, np.full(WINDOW, len(vocab), np.int32)])
    base = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    own = [np.array(starts(len(w)), np.int64) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(x) for x in own])
    first = np.concatenate([np.zeros(0, np.int64), *own]) + base[owner]
    return _table(list(vocab)), flat, first, base[owner + 1], owner


def _places(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (steps, windows) of the windows' words in the joined texts, and which of them lie in their text."""
    place = first[None] + np.arange(WINDOW)[:, None]
    return place, place < end


def _window_scores(net: Net, inputs: dict[str, np.ndarray], flat: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(first))
    for i in range(0, len(first), 2048):
        place, mask = _places(first[i : i + 2048], end[i : i + 2048])
        word = np.where(mask, flat[place], len(inputs["f"]) - 1)
        out[i : i + 2048] = _pool(net, _hidden(net, inputs, word), mask)[2]
    return out


def _worst(score: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The place of the highest score of each document (documents in order)."""
    order = np.lexsort((score, doc))
    return order[np.append(doc[order][1:] != doc[order][:-1], True)]


def _overall(score: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Highest mean logit of ADJACENT windows in a row of each of ``n`` documents, whose windows stand in order; 0 for one without windows."""
    total = np.concatenate([[0], np.cumsum(_logit(score))])
    cuts = np.searchsorted(doc, np.arange(n + 1))
    k = np.minimum(np.diff(cuts), ADJACENT)
    out = np.full(n, -np.inf)
    at = np.arange(len(doc))
    at = at[at + k[doc] <= cuts[doc + 1]]
    own = doc[at]
    np.maximum.at(out, own, (total[at + k[own]] - total[at]) / k[own])
    return np.where(k > 0, out, 0.0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _calibrated(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic regression of ``y`` on ``raw``, by Newton steps with a weak prior."""
    x = np.stack([raw, np.ones(len(raw))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - y)) + 0.1 * (beta - [1.0, 0.0])
        beta -= np.clip(np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), g), -1, 1)
    return beta if beta[0] > 0 else np.array([1.0, 0.0])


def _drawn(rng: np.random.Generator, pool: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """``k`` windows of a pool: a document by chance, then one of its windows (windows of a document stand together)."""
    cuts = np.append(np.flatnonzero(np.append(True, doc[pool][1:] != doc[pool][:-1])), len(pool))
    at = rng.integers(0, len(cuts) - 1, k)
    return pool[rng.integers(cuts[at], cuts[at + 1])]


def train(texts: pd.DataFrame, weights: dict[int, float], seed: int = 6) -> Net | None:
    """Fit the network to whole texts: doc_id, text, toxic (0 or 1).

    ``weights``: how many documents each sampled one of a class stands for.
    """
    texts = texts.sort_values(["doc_id", "text"], kind="stable").drop_duplicates(["doc_id", "text"])
    table, flat, first, end, owner = _read(texts["text"].to_list())
    has, doc = np.unique(owner, return_inverse=True)
    y = texts["toxic"].to_numpy(np.int64)[has]
    label = y[doc]
    if len(set(label.tolist())) < 2:
        return None
    names = texts["doc_id"].to_numpy(np.int64)[has]
    # Every fourth document of a class is kept for calibration, if there are enough.
    rank = np.zeros(len(names), np.int64)
    for c in (0, 1):
        rank[y == c] = np.unique(names[y == c], return_inverse=True)[1]
    apart = (rank % 4 == 3) if min((y == 0).sum(), (y == 1).sum()) >= 80 else np.zeros(len(names), bool)
    own = ~apart[doc]
    net, rng = new_net(seed), np.random.default_rng(seed)
    # What few documents hold can only be learnt by heart.
    seen = np.zeros(TABLE, np.int64)
    at_own = np.flatnonzero(own)
    for part in np.split(at_own, np.flatnonzero(np.diff(doc[at_own])) + 1):
        place, mask = _places(first[part], end[part])
        used = np.unique(table[np.unique(flat[place[mask]])])
        seen[used[used >= 0]] += 1
    known = (seen >= SEEN)[:, None].astype(np.float32)
    net["E"] *= known
    m, s = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    bad, good = np.flatnonzero(own & (label == 1)), np.flatnonzero(own & (label == 0))
    step, steps = 0, ROUNDS * STEPS
    for n in range(ROUNDS):
        pool = [bad, good, good]
        if n:
            score = np.zeros(len(doc))
            score[own] = _window_scores(net, _inputs(net, table), flat, first[own], end[own])
            place = np.flatnonzero(own)[_worst(score[own], doc[own])]
            most = np.ones(len(names))
            most[doc[place]] = score[place]
            pool = [bad[score[bad] >= NEAR * most[doc[bad]]], place[label[place] == 0], good]
        for _ in range(STEPS):
            step += 1
            at = np.concatenate([_drawn(rng, g, doc, k) for g, k in zip(pool, (BATCH // 2, BATCH // 4, BATCH // 4))])
            place, mask = _places(first[at], end[at])
            part = np.where(mask[..., None], table[np.where(mask, flat[place], 0)], -1)
            g = _gradients(net, part, mask, label[at].astype(np.float32))
            g["E"] = (g["E"] + DECAY * net["E"]) * known
            rate = RATE * (1 - 0.9 * step / steps)
            for k in net:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] * g[k] - s[k])
                net[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    held = np.flatnonzero(apart[doc]) if apart.any() else np.arange(len(doc))
    name, own = np.unique(doc[held], return_inverse=True)
    raw, c = _overall(_window_scores(net, _inputs(net, table), flat, first[held], end[held]), own, len(name)), y[name]
    net["calibration"] = _calibrated(raw, c.astype(float), np.where(c == 1, weights[1], weights[0]))
    return net


def score_texts(net: Net, texts: list) -> np.ndarray:
    """Score of each text: that of its worst windows."""
    table, flat, first, end, owner = _read(texts)
    raw = _overall(_window_scores(net, _inputs(net, table), flat, first, end), owner, len(texts))
    slope, offset = net["calibration"]
    read = np.bincount(owner, minlength=len(texts)) > 0
    return np.where(read, 1 / (1 + np.exp(-np.clip(slope * raw + offset, -50, 50))), 0.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Net | None:
    """Train on labelled documents outside the held-out fold."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id"), 3) != 1)
    counts = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = sample(known, "toxic", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).toPandas()
    return train(texts, {c: max(1.0, n / most) for c, n in counts.items()})


def score(docs: DataFrame, net: Net | None, threshold: float = 0.7) -> DataFrame:
    """Append ``score`` (double) and ``predicted`` (int) to the documents."""
    docs = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, PART):
            values = np.zeros(len(rows)) if shared.value is None else score_texts(shared.value, rows.column("text").to_pylist())
            yield rows.append_column("score", pa.array(values, pa.float64()))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(run, f"{types}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
