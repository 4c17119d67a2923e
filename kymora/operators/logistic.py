"""Multinomial logistic models, one per key, all fitted at once.

Rows are packed once into matrices of bounded size.  A step of Newton's method is one
pass over the matrices of the keys that still move: loss, gradient and curvature are
summed per key inside a task, then in pieces over all tasks, and the solve of a key sees
one small matrix.  A step that does not lower the loss is halved.  Keys leave as they
converge, so the number of passes is that of the slowest key and not a sum over keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.operators.keyed import KEY, key_column
from kymora.session import spread, stored

BLOCK_NUMBERS = 1 << 17  # doubles in a packed matrix: one MB
PIECE = 4096  # doubles of a sum that travel in one row
HELD = 1 << 22  # doubles of sums that a task holds
MOVING, CONVERGED, ONE_CLASS, STOPPED = "moving", "converged", "one class", "not converged"
STATE = "_key string, classes array<int>, n bigint, weights array<double>, loss double, direction array<double>, slope double, size double, trial array<double>, steps int, status string"


def packed(p: int):
    """Arrow map: rows (_key, class, x) as matrices (_key, rows, class, x) of BLOCK_NUMBERS at most."""
    most = max(1, BLOCK_NUMBERS // p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def full(key: str) -> pd.DataFrame:
            parts = waiting.pop(key)
            c, x = np.concatenate([c for c, _ in parts]), np.concatenate([x for _, x in parts])
            cuts = range(0, len(c), most)
            return pd.DataFrame({KEY: key, "rows": [len(c[i : i + most]) for i in cuts], "class": [c[i : i + most].tobytes() for i in cuts], "x": [x[i : i + most].tobytes() for i in cuts]})

        for b in batches:
            for key, part in b.groupby(KEY, sort=False):
                x = np.stack(part["x"].to_numpy()).astype("<f8")
                if x.shape[1] != p:
                    raise ValueError(f"rows have {x.shape[1]} of {p} features")
                waiting.setdefault(key, []).append((part["class"].to_numpy("<i4"), x))
                held += x.size
                if sum(len(c) for c, _ in waiting[key]) >= most:
                    held -= sum(x.size for _, x in waiting[key])
                    yield full(key)
            if held > 8 * BLOCK_NUMBERS:
                for key in list(waiting):
                    yield full(key)
                held = 0
        for key in list(waiting):
            yield full(key)

    return run


def _probabilities(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities and log normalisers of rows under weights (classes x features and one bias)."""
    s = x @ w[:, :-1].T + w[:, -1]
    top = s.max(1, keepdims=True)
    e = np.exp(s - top)
    total = e.sum(1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def _sums(x: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """[loss, gradient, upper class pairs of the curvature] of some rows; ``c`` are places in the key's classes."""
    k, d = w.shape
    p, norm = _probabilities(x, w)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    picked = (x * w[c, :-1]).sum(1) + w[c, -1]
    r = p.copy()
    r[np.arange(len(c)), c] -= 1
    parts = [np.array([(norm - picked).sum()]), (r.T @ x1).ravel()]
    for a in range(k):
        for b in range(a, k):
            parts.append(((x1 * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x1).ravel())
    return np.concatenate(parts)


def _partial(p: int):
    """Arrow map: matrices with their key's trial weights as summed pieces (_key, piece, m)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        held = 0

        def pieces() -> pd.DataFrame:
            rows = [(key, i // PIECE, m[i : i + PIECE].tobytes()) for key, m in sums.items() for i in range(0, len(m), PIECE)]
            return pd.DataFrame(rows, columns=[KEY, "piece", "m"])

        for b in batches:
            for key, n, c, x, classes, trial in zip(b[KEY], b["rows"], b["class"], b["x"], b["classes"], b["trial"], strict=True):
                place = np.searchsorted(np.asarray(classes), np.frombuffer(c, "<i4"))
                m = _sums(np.frombuffer(x, "<f8").reshape(n, p), place, np.asarray(trial).reshape(-1, p + 1))
                if key in sums:
                    sums[key] += m
                else:
                    sums[key] = m
                    held += len(m)
                if held > HELD:
                    yield pieces()
                    sums, held = {}, 0
        if sums:
            yield pieces()

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["m"].iloc[0]) // 8)
    for m in pdf["m"]:
        total += np.frombuffer(m, "<f8")
    return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "piece": [pdf["piece"].iloc[0]], "m": [total.tobytes()]})


def _advance(p: int, c: float, tol: float, max_steps: int):
    """Arrow map: states with the sums at their trial weights, one step further."""

    def one(row) -> dict:
        k = len(row.classes)
        d = p + 1
        m = np.concatenate([np.frombuffer(s["m"], "<f8") for s in sorted(row.sums, key=lambda s: s["piece"])])
        trial = np.asarray(row.trial, float).reshape(k, d)
        loss = m[0] + (trial[:, :-1] ** 2).sum() / (2 * c)
        out = {x: getattr(row, x) for x in ("classes", "n", "weights", "loss", "direction", "slope", "size", "trial", "steps", "status")}
        out["steps"] = row.steps + 1
        first = row.steps == 0
        if first or loss <= row.loss - 1e-4 * row.size * row.slope + 1e-12 * abs(row.loss):
            g = m[1 : 1 + k * d].reshape(k, d).copy()
            g[:, :-1] += trial[:, :-1] / c
            h = np.zeros((k, d, k, d))
            at = 1 + k * d
            for a in range(k):
                for b in range(a, k):
                    h[a, :, b, :] = h[b, :, a, :] = m[at : at + d * d].reshape(d, d)
                    at += d * d
            for a in range(k):
                h[a, range(p), a, range(p)] += 1 / c
            h[:, p, :, p] += 1.0 / k  # a shift of all biases changes nothing: keep it at none
            h = h.reshape(k * d, k * d)
            direction = -np.linalg.lstsq(h, g.ravel(), rcond=None)[0]
            slope = float(-(direction @ g.ravel()))
            out |= {"weights": trial.ravel().tolist(), "loss": float(loss), "direction": direction.tolist(), "slope": slope, "size": 1.0, "trial": (trial.ravel() + direction).tolist()}
            if slope <= tol * max(1.0, abs(loss)):
                out["status"] = CONVERGED
        else:
            size = row.size / 2
            out |= {"size": size, "trial": (np.asarray(row.weights) + size * np.asarray(row.direction)).tolist()}
        if out["status"] == MOVING and (out["steps"] >= max_steps or out["size"] < 1e-12):
            out["status"] = STOPPED
        return out

    names = [f.split()[0] for f in STATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [one(r) | {KEY: key} for key, r in zip(b[KEY], b.drop(columns=KEY).itertuples(index=False), strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return run


def fit_logistic(
    train: DataFrame, keys: Sequence[str], features: str, label: str, p: int, c: float = 1.0, tol: float = 1e-14, max_steps: int = 60,
) -> DataFrame:
    """(keys, classes, weights, bias, n, steps, converged, reason): one model per key.

    The loss of a key is its summed log loss plus the squared weights (not the biases)
    over ``2 c``, the penalty ``1 / (c n)`` of a mean loss.  A key converges when the
    decrease that a full step promises falls under ``tol`` of its loss.  A key that has
    not after ``max_steps`` passes keeps its best weights and the reason ``not
    converged``; a key with one class has no weights and the reason ``one class``.

    Labels are whole numbers from 0.  Rows without label or features are left out, nulls
    and NaN among the features count as 0; a null key is a key of its own.
    """
    keys = list(keys)
    x = F.transform(F.col(features), lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))
    data = train.select(key_column(keys).alias(KEY), F.col(label).cast("int").alias("class"), x.alias("x")).where("class IS NOT NULL AND x IS NOT NULL")
    blocks = stored(data.mapInPandas(packed(p), f"{KEY} string, rows int, class binary, x binary"))
    counted = data.groupBy(KEY, "class").agg(F.count(F.lit(1)).alias("n")).groupBy(KEY)
    start = counted.agg(F.array_sort(F.collect_list("class")).alias("classes"), F.sum("n").alias("n"))  # as many entries as classes
    zeros = F.array_repeat(F.lit(0.0), F.size("classes") * (p + 1))
    none = F.lit(None)
    state = start.select(
        KEY, "classes", "n", zeros.alias("weights"), none.cast("double").alias("loss"), none.cast("array<double>").alias("direction"), none.cast("double").alias("slope"),
        F.lit(1.0).alias("size"), zeros.alias("trial"), F.lit(0).alias("steps"), F.when(F.size("classes") == 1, ONE_CLASS).otherwise(MOVING).alias("status"),
    )
    state = stored(state)
    while not (moving := state.where(F.col("status") == MOVING)).isEmpty():
        summed = blocks.join(moving.select(KEY, "classes", "trial"), KEY).mapInPandas(_partial(p), f"{KEY} string, piece int, m binary")
        added = spread(summed, KEY, "piece").groupBy(KEY, "piece").applyInPandas(_added, f"{KEY} string, piece int, m binary")
        whole = added.groupBy(KEY).agg(F.collect_list(F.struct("piece", "m")).alias("sums"))  # one curvature matrix
        stepped = spread(moving.join(whole, KEY), KEY).mapInPandas(_advance(p, c, tol, max_steps), STATE)
        state = stored(state.where(F.col("status") != MOVING).unionByName(stepped))
    flat = state.withColumnRenamed("weights", "_w")
    each = F.sequence(F.lit(0), F.size("classes") - 1)
    w = F.transform(each, lambda i: F.slice("_w", i * (p + 1) + 1, F.lit(p)))
    bias = F.transform(each, lambda i: F.element_at("_w", (i + 1) * (p + 1)))
    model = flat.select(
        KEY, "classes", w.alias("weights"), bias.alias("bias"), "n", "steps", (F.col("status") != STOPPED).alias("converged"), F.when(F.col("status") != CONVERGED, F.col("status")).alias("reason")
    )
    if not keys:
        return model.drop(KEY)
    named = train.select(*keys).distinct().withColumn(KEY, key_column(keys))
    return named.join(model, KEY).drop(KEY)
