"""Signal features and small classifiers as grouped Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.functions import vectors as V
from kymora.operators import series
from kymora.operators import windows as W
from kymora.operators.keyed import KEY, key_column, with_model
from kymora.session import spread, stored

# --- filtering ---


def butterworth_bandpass(order: int, low: float, high: float, sfreq: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital Butterworth band-pass."""
    if not 0.0 < low < high < sfreq / 2:
        raise ValueError("the band must lie inside (0, sfreq / 2)")
    w1, w2 = (2 * sfreq * math.tan(math.pi * f / sfreq) for f in (low, high))
    width, centre = w2 - w1, math.sqrt(w1 * w2)
    k = np.arange(1, order + 1)
    prototype = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(prototype**2 - centre**2)
    analog = np.concatenate([prototype + root, prototype - root])
    fs2 = 2 * sfreq
    poles = (fs2 + analog) / (fs2 - analog)
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    gain = float(np.real((width**order) * fs2**order / np.prod(fs2 - analog)))
    return zeros, poles, gain


def impulse_response(order: int, low: float, high: float, sfreq: float, tol: float = 1e-13) -> np.ndarray:
    """Response to one unit sample, as long as it stays above ``tol``.

    The response is a sum of decaying exponentials, one per pole, so its
    length follows from the slowest pole.
    """
    zeros, poles, gain = butterworth_bandpass(order, low, high, sfreq)
    n = math.ceil(math.log(tol) / math.log(np.abs(poles).max()))
    residues = np.array([np.prod(p - zeros) / np.prod(p - np.delete(poles, i)) / p for i, p in enumerate(poles)])
    t = np.arange(n)
    h = gain * np.real((residues[None, :] * poles[None, :] ** t[:, None]).sum(1))
    h[0] = gain
    return h


def band_filter(
    samples: DataFrame, keys: Sequence[str], idx: str, value: str, *, sfreq: float, bands: Sequence[tuple[float, float]], order: int = 4,
    name: str = "filtered", rows: int = 1024,
) -> DataFrame:
    """Causal band-pass of every series, one output row per sample and band.

    Samples travel as blocks at least as long as the longest response, and
    every block also goes to its successor as history.  A block is then
    filtered on its own, so a long series uses as many tasks as it has blocks.
    """
    keys = list(keys)
    responses = [impulse_response(order, lo, hi, sfreq) for lo, hi in bands]
    rows = max(rows, max(len(h) for h in responses))
    packed = W.blocks(samples, keys, idx, value, rows)
    sent = packed.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("block").alias("block"), F.col("signal").alias("own"), F.lit(None).cast("array<double>").alias("before")),
                F.struct((F.col("block") + 1).alias("block"), F.lit(None).cast("array<double>").alias("own"), F.col("signal").alias("before")),
            )
        ).alias("x"),
    ).select(*keys, "x.*")
    # At most two rows meet per (series, block).
    met = sent.groupBy(*keys, "block").agg(F.max("own").alias("own"), F.max("before").alias("before")).where(F.col("own").isNotNull())

    schema = T.StructType([*(met.schema[c] for c in [*keys, "block"]), T.StructField("band", T.IntegerType(), False), T.StructField("_s", T.ArrayType(T.DoubleType()))])
    per_band = met.select(*keys, "block", "own", "before").mapInArrow(_filter_blocks(responses, [*keys, "block"]), schema)
    return per_band.select(*keys, "band", "block", F.posexplode("_s").alias("_i", name)).select(
        *keys, "band", (F.col("block") * rows + F.col("_i")).alias(idx), name
    )


def _filter_blocks(responses: Sequence[np.ndarray], keep: Sequence[str], held: int = 1 << 18):
    """One row per block and band; a task holds its Arrow batch of blocks and the results of about ``held`` numbers."""
    longest = max(len(h) for h in responses)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectra: dict[int, list[np.ndarray]] = {}

        def filtered(head: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
            x = np.concatenate([head, own])
            size = 1 << (len(x) + longest - 1).bit_length()
            if size not in spectra:
                spectra[size] = [np.fft.rfft(h, size) for h in responses]
            spectrum = np.fft.rfft(x, size)
            return [np.fft.irfft(spectrum * h, size)[len(head) : len(x)] for h in spectra[size]]

        def packed(b: pa.RecordBatch, rows: list[int], out: list[np.ndarray]) -> pa.RecordBatch:
            flat = np.concatenate(out)
            offsets = np.append(0, np.cumsum([len(y) for y in out])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat)))  # what a missing sample touches is null
            bands = pa.array(np.tile(np.arange(len(responses), dtype=np.int32), len(rows)))
            at = pa.array(np.repeat(rows, len(responses)))
            return pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), bands, lists], [*keep, "band", "_s"])

        for b in batches:
            own, before = b.column("own"), b.column("before")
            rows, out, size = [], [], 0
            for i in range(b.num_rows):
                numbers = lambda c: c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid else np.zeros(0)
                out += filtered(numbers(before), numbers(own))
                rows.append(i)
                size += len(out[-1]) * len(responses)
                if size >= held:
                    yield packed(b, rows, out)
                    rows, out, size = [], [], 0
            if rows:
                yield packed(b, rows, out)

    return run


def band_log_power(filtered: DataFrame, keys: Sequence[str], idx: str, window: int, name: str = "filtered") -> DataFrame:
    """Log variance per window, band and series."""
    var = F.var_pop(name)
    return filtered.groupBy(*keys, "band", F.floor(F.col(idx) / window).alias("window")).agg(
        F.count(F.lit(1)).alias("n"), F.when(var > 0, F.log(var)).alias("log_power")
    )


# --- covariance and tangent space ---


def pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def wide_channels(samples: DataFrame, keys: Sequence[str], channels: Sequence[str], idx: str = "sample_idx") -> DataFrame:
    """One row per time step with a column per channel; steps that miss a channel are left out."""
    cols = [F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"c{i}") for i, c in enumerate(channels)]
    return samples.groupBy(*keys, idx).agg(*cols).dropna(subset=[f"c{i}" for i in range(len(channels))])


def covariances(wide: DataFrame, keys: Sequence[str], p: int, window: int, stride: int, idx: str = "sample_idx", shrink: bool = True) -> DataFrame:
    """Spatial covariance per sliding window, shrunk by default, upper triangle as an array.

    Moments are plain aggregates with map-side combine; the shrinkage weight is
    the oracle-approximating closed form.
    """
    first = F.greatest(F.floor((F.col(idx) - window) / stride) + 1, F.lit(0))
    placed = wide.withColumn("window", F.explode(F.sequence(first, F.floor(F.col(idx) / stride))))
    raw = placed.groupBy(*keys, "window").agg(
        F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs(p)]
    ).where(F.col("n") == window)
    total = sum((F.col(f"v{i}_{j}") ** 2 * (1 if i == j else 2) for i, j in pairs(p)), F.lit(0.0))
    alpha = total / float(p * p)
    mu = sum((F.col(f"v{i}_{i}") for i in range(p)), F.lit(0.0)) / float(p)
    den = (F.col("n") + 1) * (alpha - mu * mu / float(p))
    ready = raw.withColumn("_mu", mu).withColumn(
        "shrinkage", F.when(den == 0, 1.0).otherwise(F.least((alpha + mu * mu) / F.when(den != 0, den), F.lit(1.0))) if shrink else F.lit(0.0)
    )
    entries = [
        (1.0 - F.col("shrinkage")) * F.col(f"v{i}_{j}") + (F.col("shrinkage") * F.col("_mu") if i == j else F.lit(0.0)) for i, j in pairs(p)
    ]
    return ready.select(*keys, "window", "shrinkage", F.array(*entries).alias("cov"))


def _square(flat, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    for v, (i, j) in zip(flat, pairs(p), strict=True):
        m[i, j] = m[j, i] = v
    return m


def _matrix_function(m: np.ndarray, f: Callable) -> np.ndarray:
    w, q = np.linalg.eigh(m)
    return (q * f(np.maximum(w, 1e-300))) @ q.T


def _log_at(p: int):
    @F.pandas_udf("array<double>")
    def run(cov: pd.Series, ref: pd.Series) -> pd.Series:
        out = []
        for c, r in zip(cov, ref, strict=True):
            if c is None or r is None:
                out.append(None)
                continue
            root = _matrix_function(_square(r, p), lambda w: w**-0.5)
            m = _matrix_function(root @ _square(c, p) @ root, np.log)
            out.append([float(m[i, j]) for i, j in pairs(p)])
        return pd.Series(out)

    return run


def _step_along(p: int):
    @F.pandas_udf("array<double>")
    def run(ref: pd.Series, direction: pd.Series) -> pd.Series:
        out = []
        for r, d in zip(ref, direction, strict=True):
            m = _square(r, p)
            half = _matrix_function(m, np.sqrt)
            n = half @ _matrix_function_signed(_square(d, p)) @ half
            out.append([float(n[i, j]) for i, j in pairs(p)])
        return pd.Series(out)

    return run


def _matrix_function_signed(m: np.ndarray) -> np.ndarray:
    w, q = np.linalg.eigh(m)
    return (q * np.exp(w)) @ q.T


def geometric_mean(covs: DataFrame, keys: Sequence[str], p: int, tol: float = 1e-6) -> DataFrame:
    """Mean of positive-definite matrices per key under the affine-invariant metric.

    A pass sums, per key, the tangent vectors at a trial mean and their squared lengths.
    The trial becomes the mean where the sum of squares has not grown, else the step to
    it is halved, so any spread of matrices settles.  Keys leave as their mean tangent
    is shorter than ``tol``, or as rounding hides any gain; only one small matrix per key is stored between passes.
    """
    keys, m = list(keys), len(pairs(p))
    kinds = T.StructType([covs.schema[k] for k in keys])
    covs = stored(covs.withColumn(KEY, key_column(keys)).select(KEY, "cov"))  # read once per pass
    mean_of = lambda c: F.array(*[F.avg(F.col(c)[i]) for i in range(m)])
    weights = F.array(*[F.lit(1.0 if i == j else 2.0) for i, j in pairs(p)])
    squared = lambda c: F.aggregate(F.zip_with(c, weights, lambda v, w: v * v * w), F.lit(0.0), lambda a, v: a + v)
    start = covs.groupBy(KEY).agg(mean_of("cov").alias("trial"))
    none = F.lit(None)
    state = stored(start.select(KEY, none.cast("array<double>").alias("ref"), none.cast("array<double>").alias("direction"), none.cast("double").alias("spread"), F.lit(1.0).alias("size"), "trial", F.lit(True).alias("moving")))
    log_at, step = _log_at(p), _step_along(p)
    while not (moving := state.where("moving")).isEmpty():
        tangent = covs.join(moving.select(KEY, "trial"), KEY).select(KEY, log_at("cov", "trial").alias("_t"))
        at_trial = tangent.groupBy(KEY).agg(mean_of("_t").alias("_d"), F.avg(squared(F.col("_t"))).alias("_s"))
        better = F.col("spread").isNull() | (F.col("_s") <= F.col("spread") * (1 + 1e-12))
        pick = lambda new, old: F.when(better, F.col(new)).otherwise(F.col(old))
        size = F.when(better, F.least(F.col("size") * 2, F.lit(1.0))).otherwise(F.col("size") / 2)
        gained = F.col("spread") - F.col("_s") > F.col("spread") * 1e-13  # below that only rounding moves the sum
        settled = better & ((squared(F.col("_d")) < tol * tol) | (F.col("spread").isNotNull() & ~gained))
        moved = moving.join(at_trial, KEY).select(
            KEY, pick("trial", "ref").alias("ref"), pick("_d", "direction").alias("direction"), pick("_s", "spread").alias("spread"), size.alias("size"),
            ~settled & (size > 1e-6) & ~F.isnan("_s") & F.col("_s").isNotNull(),
        ).toDF(KEY, "ref", "direction", "spread", "size", "moving")
        trial = step("ref", F.transform("direction", lambda v: v * F.col("size")))
        stepped = moved.select(KEY, "ref", "direction", "spread", "size", trial.alias("trial"), "moving")
        state = stored(state.where("NOT moving").unionByName(stepped))
    return state.select(KEY, "ref").withColumns({k: F.from_json(KEY, kinds).getField(k) for k in keys}).select(*keys, "ref")


def tangent_features(covs: DataFrame, reference: DataFrame, keys: Sequence[str], p: int, cov: str = "cov", out: str = "features") -> DataFrame:
    """Tangent vectors at a reference (keys, ref) fitted on train windows; off-diagonal entries weigh sqrt 2.

    Windows of keys without a reference keep their row with null features.
    """
    weights = F.array(*[F.lit(1.0 if i == j else math.sqrt(2.0)) for i, j in pairs(p)])
    log_at = _log_at(p)
    t = with_model(covs, reference.withColumnRenamed("ref", "_ref"), keys).withColumn("_t", log_at(cov, "_ref"))
    return t.withColumn(out, F.zip_with("_t", weights, lambda a, b: a * b)).drop("_t", "_ref")


# --- feature relevance ---


def mutual_information(rows: DataFrame, features: str, label: str, bins: int = 8, slots: int = 256) -> DataFrame:
    """Mutual information of every feature with the label, from quantile bins, in nats.

    Of ``n`` values of a feature, one with ``r`` smaller values is in bin ``r * bins div
    n``: bins of equal size in order of value, and equal values always share one.  The
    ranks are exact and come from counts of equal values, added up along ``slots``
    ranges of the feature's values, so a feature is as many tasks as it has slots.  Null
    entries take no part, NaN is larger than any number.
    """
    long = rows.select(F.col(label).alias("label"), F.posexplode(features).alias("feature", "v")).where("v IS NOT NULL")
    counts = stored(long.groupBy("feature", F.col("v").cast("double").alias("v"), "label").agg(F.count(F.lit(1)).alias("n")))
    finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    ends = counts.groupBy("feature").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.sum("n").alias("nt"))
    values = counts.groupBy("feature", "v").agg(F.sum("n").alias("n")).join(ends, "feature")
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    place = F.when(F.isnan("v") | (F.col("v") > F.col("hi")), slots).when(F.col("v") < F.col("lo"), -1).when(F.col("hi") > F.col("lo"), F.floor(share * slots)).otherwise(0)
    ranked = series.scan(values, ["feature"], ["v"], place, {"below": ("sum", F.col("n"))})
    binned = counts.join(ranked.select("feature", "v", F.expr(f"below * {bins} div nt").alias("bin")), ["feature", "v"])
    joint = binned.groupBy("feature", "bin", "label").agg(F.sum("n").alias("n"))
    # The joint table is features x bins x labels: small, so its margins are windows over it.
    over = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))
    margins = joint.select("feature", "n", over("bin").alias("nb"), over("label").alias("nl"), over().alias("nt"))
    term = F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nb") * F.col("nl")))
    return margins.groupBy("feature").agg(F.sum(term).alias("information"))


def select_top(scores: DataFrame, score: str, index: str, k: int) -> DataFrame:
    """The ``k`` best rows, equal scores by index: a distributed top-k."""
    return scores.orderBy(F.desc(score), index).limit(k)


# --- discriminant analysis ---


def _class_moments(keys: Sequence[str], p: int, held: int = 1 << 20):
    """Count, sums and cross products per (key, class) of a partition in one array, at most ``held`` numbers at a time."""
    upper = np.triu_indices(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([[*k, m.tolist()] for k, m in sums.items()], columns=[*keys, "class", "m"])

        for b in batches:
            for key, part in b.groupby([*keys, "class"], dropna=False, sort=False):
                x = np.stack(part["x"].to_numpy())
                if x.shape[1] != p:
                    raise ValueError(f"rows have {x.shape[1]} of {p} features")
                m = np.concatenate([[len(x)], x.sum(0), (x.T @ x)[upper]])
                sums[key] = sums[key] + m if key in sums else m
                if len(sums) * len(m) > held:
                    yield rows()
                    sums.clear()
        if sums:
            yield rows()

    return run


def fit_discriminant(train: DataFrame, keys: Sequence[str], features: str, label: str, p: int, shrinkage: float = 0.1) -> DataFrame:
    """Weights of a linear discriminant per key.

    Counts, sums and cross products per (key, class) are made per partition and
    added up entry by entry; the solve sees one number per class and entry.  Where the
    classes of a key do not spread, the model has no weights but a ``reason``.
    """
    keys = list(keys)
    zeros = F.array_repeat(F.lit(0.0), p)  # a null adds nothing to a sum
    x = F.transform(F.slice(F.col(features), 1, p), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    data = train.select(*keys, F.col(label).cast("int").alias("class"), F.coalesce(x, zeros).alias("x"))
    ddl = "".join(f"`{k}` {data.schema[k].dataType.simpleString()}, " for k in keys)
    partial = data.mapInPandas(_class_moments(keys, p), ddl + "class int, m array<double>")
    stats = partial.select(*keys, "class", F.posexplode("m").alias("i", "v")).groupBy(*keys, "class", "i").agg(F.sum("v").alias("v"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["class", "i"])
        width = 1 + p + len(pairs(p))
        m = pdf["v"].to_numpy().reshape(-1, width)
        n = m[:, 0]
        means = m[:, 1 : p + 1] / n[:, None]
        within = sum(_square(q, p) for q in m[:, p + 1 :]) - (n[:, None, None] * means[:, :, None] * means[:, None, :]).sum(0)
        cov = within / n.sum()
        cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / p * np.eye(p)
        try:
            weights = np.linalg.solve(cov, means.T).T
            bias = -0.5 * (weights * means).sum(1) + np.log(n / n.sum())
            fitted = [weights.tolist(), bias.tolist(), None]
        except np.linalg.LinAlgError:
            fitted = [None, None, "no spread within classes"]
        return pd.DataFrame(
            [[*[pdf[k].iloc[0] for k in keys], pdf["class"].to_numpy()[::width].tolist(), *fitted]],
            columns=[*keys, "classes", "weights", "bias", "reason"],
        )

    return spread(stats, *[F.col(k) for k in keys]).groupBy(*keys).applyInPandas(
        solve, ddl + "classes array<int>, weights array<array<double>>, bias array<double>, reason string"
    )


def score_linear(rows: DataFrame, model: DataFrame, keys: Sequence[str], features: str, p: int, n_classes: int | None = None) -> DataFrame:
    """Posterior of every row under its key's model (classes, weights, bias, reason), and ``model_status``.

    Scores are linear in the first ``p`` features.  With ``n_classes`` the posterior has
    an entry for each class from 0, 0 for a class that the key has not seen; else one
    for each class of the key.  The status is ``ok``, the model's reason, ``no model``
    or ``no features``; only a row with weights and features has a posterior.
    """
    x = F.transform(F.slice(F.col(features), 1, p), lambda v: v.cast("double"))
    dots = F.transform("weights", lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    scored = with_model(rows, model.select(*keys, "classes", "weights", "bias", "reason"), keys)
    scored = scored.withColumn("_scores", F.zip_with(dots, F.col("bias"), lambda a, b: a + b))
    own = V.softmax(F.col("_scores"))
    if n_classes is not None:
        scored = scored.withColumn("_own", own)
        own = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.coalesce(F.get("_own", F.array_position("classes", k).cast("int") - 1), F.lit(0.0)))
        own = F.when(F.col("_own").isNotNull(), own)
    whole = F.col(features).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)) & (F.size(x) == p)
    status = F.when(F.col("classes").isNull(), "no model").when(~whole | F.col(features).isNull(), "no features").otherwise(F.coalesce("reason", F.lit("ok")))
    posterior = F.when(whole, V.as_float(own))
    return scored.withColumns({"posterior": posterior, "model_status": status}).drop("_scores", "_own", "weights", "bias", "classes", "reason")


# --- decoders by name ---


def decode(name: str, train: DataFrame, rows: DataFrame, keys: Sequence[str], features: str, label: str, p: int) -> DataFrame:
    """Fit the named decoder on train rows and score ``rows``; adds ``posterior`` and ``model_status``.

    Every row stays: one whose key has no train rows, or whose model or features do not
    give a posterior, has a null one and a status that says so.  To keep a fitted
    decoder, use its estimator in ``learners``.
    """
    from kymora.operators.learners import DECODERS  # these estimators are built from the functions of this module

    if name not in DECODERS:
        raise KeyError(f"unknown decoder {name!r}, available: {sorted(DECODERS)}")
    return DECODERS[name](keys=list(keys), featuresCol=features, labelCol=label, size=p).fit(train).transform(rows)


def decode_with_udf(rows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], features: str) -> DataFrame:
    """Score rows with any model: ``predict`` maps a batch of feature rows to probabilities."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(predict(np.stack(x.to_numpy())), dtype=np.float32)) if len(x) else [])

    return rows.withColumn("posterior", run(F.col(features)))

