"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded (character classes,
repetition, word shape and hashed words, then one hidden layer); gated attention (tanh times sigmoid)
weighs the encodings, and the weighted mean gives the score. Weights and encoder are learned together
from labels of whole documents, on a bounded sample of labelled rows, each with all its passages; scoring is one pass
over all passages of all texts, piece by piece with a running softmax, and sees nothing but the text.
Pieces of a very long text end at white space, and so do passages and runs of words there; a run counts as
repeated wherever in the text it stood before.

Results: a null text counts as empty and an empty text is one empty passage, so both get a score;
equal texts have equal scores (a text is summed alone, in double precision); rows are scored each on its own, so repeated rows, null ids and other
columns change nothing. Labels that are null or not 0 or 1 are ignored; several labels of a document
count each. Without labels of both classes the score is the share of label 1, or 1 without labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.tables import saved

PASSAGE_WORDS = 64
#: Labelled documents that a model is fitted on, at most, and passages of all of them together (90 MB).
#: A document that would exceed the second bound is not drawn; none is cut.
TRAIN_ROWS = 4_096
TRAIN_PASSAGES = 262_144
#: A text is predicted good from this score on.
THRESHOLD = 0.7
#: Texts are encoded together up to so many bytes; a longer one is cut at white space.
GROUP_BYTES = 1 << 20
BUCKETS = 64
HIDDEN = 24
ATTENTION = 12
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _classes() -> np.ndarray:
    """Character class of each byte."""
    out = np.full(256, 12, np.uint8)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",;:", "!?", "|", "#$%&*@^~=+<>{}[]\\/_", "\"'()-`"]
    for k, chars in enumerate(groups):
        out[list(chars.encode())] = k
    out[128:] = 11
    return out


_CLASS = _classes()
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
N_FEATURES = 13 + 8 + BUCKETS


def pieces(texts: Iterable[bytes]) -> Iterable[tuple[list[int], list[bytes]]]:
    """Groups of texts, or parts of long ones, with the number of the text each belongs to."""
    owner: list[int] = []
    parts: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t) or at == 0:
            stop = min(len(t), at + GROUP_BYTES)
            while stop < len(t) and not _SPACE[t[stop]]:
                stop += 1
            if parts and size + stop - at > GROUP_BYTES:
                yield owner, parts
                owner, parts, size = [], [], 0
            owner.append(k)
            parts.append(t[at:stop])
            size += stop - at
            at = stop
            if not t:
                break
    if parts:
        yield owner, parts


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, features) of every passage, in order; an empty text has one passage of zeros."""
    groups = list(encoded(texts))
    bags, rows = [b for b, _ in groups], [x for _, x in groups]
    if not bags:
        return np.zeros(0, int), np.zeros((0, N_FEATURES), np.float32)
    return np.concatenate(bags), np.concatenate(rows)


def encoded(texts: Iterable[bytes]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """The same, a group of pieces at a time."""
    seen: dict[int, np.ndarray] = {}
    for owner, parts in pieces(texts):
        yield _encode_group(np.array(owner), parts, seen)


def _encode_group(owner: np.ndarray, parts: list[bytes], seen: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``seen``: runs of three words in earlier pieces of a text; brought up to date for the last one."""
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    space = _SPACE[buf]
    start = np.nonzero(~space & np.concatenate([[True], space[:-1]]))[0]
    stop = np.nonzero(space & np.concatenate([[False], ~space[:-1]]))[0]
    part = np.searchsorted(ends, start, side="right")
    if not len(start):
        return owner, np.zeros((len(owner), N_FEATURES), np.float32)
    first = np.searchsorted(part, np.arange(len(parts)))  # first word of each part
    n_words = np.diff(np.concatenate([first, [len(start)]]))
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.concatenate([[0], np.cumsum(n_pass)])
    pid = base[part] + (np.arange(len(start)) - first[part]) // PASSAGE_WORDS
    total = int(base[-1])
    # bytes between a word's start and the next one of its text belong to the word's passage
    span = np.diff(np.concatenate([start, [len(buf)]]))
    lead = int(start[0])
    reach = np.minimum(start + span, ends[part]) - start
    inside = np.repeat(start - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
    kinds = np.bincount(np.repeat(pid, reach) * 13 + _CLASS[buf[inside]], minlength=total * 13).reshape(total, 13)
    length = stop - start
    where = np.arange(len(buf)) - np.repeat(np.concatenate([[0], start]), np.concatenate([[lead], span]))
    value = np.where(space, 0, (buf.astype(np.uint64) + np.uint64(1)) * _POWERS[where & 63])
    h = np.add.reduceat(value, start)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    words = np.bincount(pid, minlength=total)
    per = np.maximum(words, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(pid, weights=mask, minlength=total) / per

    def repeats(key: np.ndarray, group: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, group))
        k, g = key[order], group[order]
        out = np.zeros(len(key), bool)
        out[order[1:]] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
        return out

    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
    runs = np.flatnonzero(part[2:] == part[:-2])  # runs of three words in one piece
    three = h[runs] + h[runs + 1] * np.uint64(3) + h[runs + 2] * np.uint64(5)
    known = repeats(three, part[runs])
    for p in np.flatnonzero(np.isin(owner, list(seen))):
        own = part[runs] == p
        known[own] |= np.isin(three[own], seen[int(owner[p])])
    last = int(owner[-1])
    held = np.union1d(three[part[runs] == len(parts) - 1], seen.get(last, np.zeros(0, np.uint64)))
    seen.clear()
    seen[last] = held
    run_again = np.zeros(len(h), bool)
    run_again[runs] = known
    upper = (buf[start] >= 65) & (buf[start] <= 90)
    stats = np.stack(
        [
            np.log1p(words) / 5,
            share(length) / 8,
            np.sqrt(np.maximum(share(length.astype(float) ** 2) - share(length) ** 2, 0)) / 8,
            share(repeats(h, pid)),
            share(again),
            share(run_again),
            share(upper),
            np.log1p(np.maximum.reduceat(length, np.searchsorted(pid, np.arange(total)).clip(0, len(pid) - 1))) / 5 * (words > 0),
        ],
        axis=1,
    )
    hashed = np.bincount(pid * BUCKETS + (h % np.uint64(BUCKETS)).astype(int), minlength=total * BUCKETS).reshape(total, BUCKETS)
    x = np.concatenate([kinds / np.maximum(kinds.sum(1, keepdims=True), 1), stats, np.sqrt(hashed / per[:, None])], axis=1)
    return np.repeat(owner, n_pass), x.astype(np.float32)


# ---- the model -------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the score; ``constant`` where nothing was learned."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def bags(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Logit of each bag; ``bag`` numbers them from 0, in order, without gaps."""
        w = self.weights
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ w["enc"] + w["enc0"])
        t = np.tanh(h @ w["att"])
        g = 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["mix"]
        first = np.searchsorted(bag, np.arange(bag[-1] + 1))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        pooled = np.add.reduceat(h * a[:, None], first, axis=0)
        return pooled @ w["out"] + w["out0"][0], {"z": z, "h": h, "t": t, "g": g, "a": a, "pooled": pooled, "first": first}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), 1.0 if self.constant is None else self.constant)
        w = self.weights
        top, total = np.full(len(texts), -np.inf), np.zeros(len(texts))
        pooled = np.zeros((len(texts), len(w["out"])))
        for bag, x in encoded(texts):
            # one text at a time: the order of sums depends on nothing beside it
            first = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
            for lo, hi in zip(first, [*first[1:], len(bag)]):
                k = bag[lo]
                z = np.clip((x[lo:hi].astype(float) - self.mean) / self.scale, -6, 6)
                h = np.tanh(z @ w["enc"] + w["enc0"])
                e = (np.tanh(h @ w["att"]) / (1 + np.exp(-(h @ w["gate"])))) @ w["mix"]
                high = max(top[k], e.max())
                a, before = np.exp(e - high), np.exp(top[k] - high)
                top[k], total[k] = high, total[k] * before + a.sum()
                pooled[k] = pooled[k] * before + a @ h
        # scalar, as the last bit of a vector's exponential depends on its place
        logits = [float((p / t * w["out"]).sum() + w["out0"][0]) for p, t in zip(pooled, total)]
        return np.array([1 / (1 + math.exp(-v)) if v > -700 else 0.0 for v in logits])


def fit(x: np.ndarray, bag: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 256, seed: int = 42) -> Model:
    """Gradient descent (Adam) on the log loss of the bags' labels."""
    if len(label) == 0 or len(set(label.tolist())) < 2:
        return Model({}, np.zeros(0), np.ones(0), float(label.mean()) if len(label) else 1.0)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 0.05
    w = {
        "enc": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
        "enc0": np.zeros(HIDDEN),
        "att": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "mix": rng.normal(0, ATTENTION**-0.5, ATTENTION),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "out0": np.array([np.log((label.sum() + 1) / (len(label) - label.sum() + 1))]),
    }
    model = Model(w, mean, scale)
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    start = np.searchsorted(bag, np.arange(len(label) + 1))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(label))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            sizes = start[pick + 1] - start[pick]
            rows = np.repeat(start[pick] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            own = np.repeat(np.arange(len(pick)), sizes)
            logit, s = model.bags(x[rows], own)
            d = (1 / (1 + np.exp(-logit)) - label[pick]) / len(pick)
            d_pooled = d[:, None] * w["out"]
            d_a = (s["h"] * d_pooled[own]).sum(1)
            d_e = s["a"] * (d_a - np.add.reduceat(s["a"] * d_a, s["first"])[own])
            d_tg = d_e[:, None] * w["mix"]
            d_t, d_g = d_tg * s["g"] * (1 - s["t"] ** 2), d_tg * s["t"] * s["g"] * (1 - s["g"])
            d_h = s["a"][:, None] * d_pooled[own] + d_t @ w["att"].T + d_g @ w["gate"].T
            d_z = d_h * (1 - s["h"] ** 2)
            grads = {
                "enc": s["z"].T @ d_z + 1e-4 * w["enc"], "enc0": d_z.sum(0), "att": s["h"].T @ d_t, "gate": s["h"].T @ d_g,
                "mix": (s["t"] * s["g"]).T @ d_e, "out": s["pooled"].T @ d + 1e-4 * w["out"], "out0": np.array([d.sum()]),
            }
            step += 1
            for k, grad in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.mean, model.scale = mean.astype(float), scale.astype(float)
    return model


# ---- on tables -------------------------------------------------------------------------------


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES) -> Model:
    """A model from at most ``rows`` labelled documents (those whose ids hash lowest), never held-out ones.

    A document that would bring the sample above ``passages`` is passed over.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
    usable = usable.filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    # ids without a document must not use up the sample, so the ids meet before it is drawn
    known = docs.select(F.col(id_col).cast("long").alias("_id")).filter("_id is not null").distinct()
    drawn = usable.join(known, "_id").orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)
    ids = F.broadcast(drawn.groupBy("_id").agg(F.collect_list("_y").alias("_ys")))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_t"))

    def features(batches):
        for pdf in batches:
            bag, x = encode(pdf["_t"].tolist())
            first = np.searchsorted(bag, np.arange(len(pdf) + 1))
            out = [x[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pd.DataFrame({"_id": pdf["_id"], "_ys": pdf["_ys"], "_n": np.diff(first), "_x": out})

    # one text per id (the smallest, should rows repeat an id), so at most ``rows`` come to the driver
    chosen = texts.join(ids, "_id").groupBy("_id").agg(F.min("_t").alias("_t"), F.first("_ys").alias("_ys"))
    made = saved(chosen.select("_id", "_ys", "_t").mapInPandas(features, "_id bigint, _ys array<int>, _n bigint, _x binary"), "passages")
    fits, used = [], 0
    for r in sorted(made.select("_id", (F.col("_n") * F.size("_ys")).alias("n"), F.xxhash64("_id").alias("o")).collect(), key=lambda r: (r["o"], r["_id"])):
        if used + r["n"] <= passages:
            fits.append(r["_id"])
            used += r["n"]
    got = sorted(made.filter(F.col("_id").isin(fits)).collect(), key=lambda r: r["_id"])
    bags = [np.frombuffer(bytes(r["_x"]), np.float32).reshape(-1, N_FEATURES) for r in got for _ in r["_ys"]]
    y = np.array([v for r in got for v in r["_ys"]], float)
    x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
    return fit(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y)


def score(text: Column, model: Model) -> Column:
    """Score of a whole text, 0 to 1."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()), dtype="float64")

    return run(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
