"""Filters, band power, covariance, tangent space, relevance and decoders."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from kymora.functions import vectors as V
from kymora.functions.vectors import rounded
from kymora.operators import features as FE
from kymora.operators import spatial as SP
from kymora.operators import learners as LE
from kymora.operators import posterior as P
from kymora.plans.registry import query
from kymora.session import shared_dir, stored
from kymora.sources import tables

CHANNELS = ("click", "error", "purchase", "signup", "view")
SFREQ = 250.0
BANDS = ((20.0, 40.0), (40.0, 70.0), (70.0, 100.0))


def response_sql(order, bands):
    """Impulse responses as a table (band, k, h) of constants, from the plain recursion."""
    parts = []
    for band, (lo, hi) in enumerate(bands):
        zeros, poles, gain = FE.butterworth_bandpass(order, lo, hi, SFREQ)
        n = len(FE.impulse_response(order, lo, hi, SFREQ))
        b, a = gain * np.real(np.poly(zeros)), np.real(np.poly(poles))
        h = np.zeros(n)
        for t in range(n):
            h[t] = (b[t] if t < len(b) else 0.0) - sum(a[k] * h[t - k] for k in range(1, len(a)) if t - k >= 0)
        values = ",".join(f"{v!r}" for v in h.tolist())
        parts.append(f"SELECT CAST({band} AS INT) AS band, unnest(range(0,{n})) AS k, unnest([{values}]::DOUBLE[]) AS h")
    return " UNION ALL ".join(parts)


def filtered_sql(order, bands):
    return f"""WITH r AS ({response_sql(order, bands)}), y AS (SELECT s.subject, s.channel, s.sample_idx, band, sum(h*x.value) AS y
 FROM d_sample s JOIN r ON r.k<=s.sample_idx JOIN d_sample x ON x.subject=s.subject AND x.channel=s.channel AND x.sample_idx=s.sample_idx-r.k GROUP BY ALL)"""


SERIES = ["subject", "channel"]


def _filtered(spark, d, order, bands):
    return FE.band_filter(tables.samples(spark, d), SERIES, "sample_idx", "value", sfreq=SFREQ, bands=bands, order=order)


@query("band_filter", filtered_sql(2, BANDS[:1]) + " SELECT subject, channel, sample_idx, round(y,5)+0.0 AS filtered FROM y")
def band_filter(spark, d):
    """Causal second-order band-pass of every series."""
    return _filtered(spark, d, 2, BANDS[:1]).select(*SERIES, "sample_idx", rounded(F.col("filtered"), 5).alias("filtered"))


@query("causal_filter_4_to_38", filtered_sql(4, [(4.0, 38.0)]) + " SELECT subject, channel, sample_idx, round(y,3)+0.0 AS filtered FROM y")
def causal_filter_4_to_38(spark, d):
    """The default fourth-order band of 4 to 38 Hz."""
    return _filtered(spark, d, 4, [(4.0, 38.0)]).select(*SERIES, "sample_idx", rounded(F.col("filtered"), 3).alias("filtered"))


@query(
    "band_log_power",
    filtered_sql(2, BANDS) + " SELECT subject, channel, band, sample_idx//64 AS \"window\", count(*) AS n, round(CASE WHEN var_pop(y)>0 THEN ln(var_pop(y)) END,5) AS log_power FROM y GROUP BY ALL",
)
def band_log_power(spark, d):
    """Log variance per 64-sample window in three bands."""
    out = FE.band_log_power(_filtered(spark, d, 2, BANDS), SERIES, "sample_idx", 64)
    return out.select(*SERIES, "band", "window", "n", rounded(F.col("log_power"), 5).alias("log_power"))


def _cov_sql():
    cols = ", ".join(f"max(CASE WHEN channel='{c}' THEN value END) AS c{i}" for i, c in enumerate(CHANNELS))
    full = " AND ".join(f"c{i} IS NOT NULL" for i in range(5))
    cov = ", ".join(f"covar_pop(c{i},c{j}) AS v{i}_{j}" for i, j in FE.pairs(5))
    alpha = "(" + "+".join(f"{1 if i == j else 2}*v{i}_{j}*v{i}_{j}" for i, j in FE.pairs(5)) + ")/25"
    mu = "(" + "+".join(f"v{i}_{i}" for i in range(5)) + ")/5"
    rows = " UNION ALL ".join(
        f"SELECT subject, win AS \"window\", {i} AS ci, {j} AS cj, round((1-s)*v{i}_{j}+{'s*mu' if i == j else '0'},4)+0.0 AS cov FROM z" for i, j in FE.pairs(5)
    )
    return f"""WITH w AS (SELECT subject, sample_idx, {cols} FROM d_sample GROUP BY ALL), f AS (SELECT * FROM w WHERE {full}),
k AS (SELECT *, unnest(range(CAST(greatest(floor((sample_idx-32)/16.0::DOUBLE)+1,0) AS BIGINT), CAST(floor(sample_idx/16) AS BIGINT)+1)) AS win FROM f),
g AS (SELECT subject, win, count(*) AS n, {cov} FROM k GROUP BY ALL HAVING count(*)=32),
a AS (SELECT *, {alpha} AS al, {mu} AS mu FROM g), z AS (SELECT *, least((al+mu*mu)/((n+1)*(al-mu*mu/5)),1) AS s FROM a) {rows}"""


def _covs(spark, d):
    wide = FE.wide_channels(tables.samples(spark, d), ["subject"], CHANNELS)
    return FE.covariances(wide, ["subject"], 5, 32, 16)


@query("spatial_covariance", _cov_sql())
def spatial_covariance(spark, d):
    """Shrunk covariance of the five channels in sliding windows of 32 samples."""
    at = F.array(*[F.struct(F.lit(i).alias("ci"), F.lit(j).alias("cj")) for i, j in FE.pairs(5)])
    out = _covs(spark, d).select("subject", "window", F.explode(F.arrays_zip(at.alias("at"), F.col("cov").alias("cov"))).alias("x"))
    return out.select("subject", "window", F.col("x.at.ci").alias("ci"), F.col("x.at.cj").alias("cj"), rounded(F.col("x.cov"), 4).alias("cov"))


@query("tangent_features")
def tangent_features(spark, d):
    """Tangent vectors at the mean of the first half of each subject's windows."""
    covs = stored(_covs(spark, d))
    half = covs.groupBy("subject").agg((F.max("window") / 2).alias("_half"))
    train = covs.join(half, "subject").where(F.col("window") <= F.col("_half")).drop("_half")
    ref = FE.geometric_mean(train, ["subject"], 5)
    return FE.tangent_features(covs, ref, ["subject"], 5).select("subject", "window", "features")


def _band_covs(spark, d):
    """Covariances of the channels in windows of 16 samples, band by band; classes are cued in turn."""
    filtered = _filtered(spark, d, 2, BANDS).withColumnRenamed("filtered", "value")
    wide = FE.wide_channels(filtered, ["subject", "band"], CHANNELS)
    covs = FE.covariances(wide, ["subject", "band"], 5, CUE, CUE, shrink=False)
    return covs.withColumn("label", (F.col("window") % CUED).cast("int"))


CUED, CUE = 4, 16  # classes, samples of a cue


def _class_cov_sql():
    cols = ", ".join(f"max(CASE WHEN channel='{c}' THEN y END) AS c{i}" for i, c in enumerate(CHANNELS))
    full = " AND ".join(f"c{i} IS NOT NULL" for i in range(5))
    cov = ", ".join(f"covar_pop(c{i},c{j}) AS v{i}_{j}" for i, j in FE.pairs(5))
    rows = " UNION ALL ".join(f"SELECT subject, band, label, {i} AS ci, {j} AS cj, count(*) AS n, round(avg(v{i}_{j}),4)+0.0 AS cov FROM g GROUP BY subject, band, label" for i, j in FE.pairs(5))
    return f"""{filtered_sql(2, BANDS)}, w AS (SELECT subject, band, sample_idx, {cols} FROM y GROUP BY ALL),
g AS (SELECT subject, band, CAST(sample_idx//{CUE}%{CUED} AS INT) AS label, sample_idx//{CUE} AS win, {cov} FROM w WHERE {full} GROUP BY ALL HAVING count(*)={CUE}) {rows}"""


@query("class_covariances", _class_cov_sql())
def class_covariances(spark, d):
    """Mean covariance of each class per subject and band."""
    at = F.array(*[F.struct(F.lit(i).alias("ci"), F.lit(j).alias("cj")) for i, j in FE.pairs(5)])
    means = SP.class_covariances(_band_covs(spark, d), ["subject", "band"], "label", 5)
    out = means.select("subject", "band", "label", "n", F.explode(F.arrays_zip(at.alias("at"), F.col("cov").alias("cov"))).alias("x"))
    return out.select("subject", "band", "label", F.col("x.at.ci").alias("ci"), F.col("x.at.cj").alias("cj"), "n", rounded(F.col("x.cov"), 4).alias("cov"))


@query("spatial_log_power")
def spatial_log_power(spark, d):
    """Log variance behind four filters of each class, per subject and band; filters from the first half of the windows."""
    keys = ["subject", "band"]
    covs = stored(_band_covs(spark, d))
    train = covs.join(covs.groupBy(*keys).agg((F.max("window") / 2).alias("_half")), keys).where(F.col("window") <= F.col("_half"))
    filters = SP.fit_spatial(train, keys, "label", 5)
    return SP.spatial_log_power(covs, filters, keys, "label", 5).select(*keys, "window", "label", "spatial_status", "features")


INFORMATION_CTE = """WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS v, CAST(unnest(range(0,64)) AS INT) AS feature FROM embeddings),
b AS (SELECT feature, label, (rank() OVER (PARTITION BY feature ORDER BY v)-1)*8//count(*) OVER (PARTITION BY feature) AS bin FROM u),
j AS (SELECT feature, bin, label, count(*) AS n FROM b GROUP BY ALL),
a AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nl, sum(n) OVER (PARTITION BY feature) AS nt FROM j)"""


@query("feature_information", INFORMATION_CTE + " SELECT feature, round(sum(n/nt*ln(n*nt/(nb*nl))),6) AS information FROM a GROUP BY feature")
def feature_information(spark, d):
    """Mutual information of every feature with the label, from quantile bins."""
    e = tables.read(spark, d, "embeddings")
    return FE.mutual_information(e, "embedding", "label").select("feature", rounded(F.col("information")).alias("information"))


@query("informative_features", INFORMATION_CTE + " SELECT feature FROM (SELECT feature, round(sum(n/nt*ln(n*nt/(nb*nl))),9) AS s FROM a GROUP BY feature) ORDER BY s DESC, feature LIMIT 16")
def informative_features(spark, d):
    """The sixteen most informative of all features, equal ones by index."""
    mi = FE.mutual_information(tables.read(spark, d, "embeddings"), "embedding", "label").withColumn("s", F.round("information", 9))
    return FE.select_top(mi, "s", "feature", 16).select("feature")


def _windows(spark, d):
    """Embedding windows with a subject, a session and a label."""
    burst = F.floor(F.col("vec_id") / 7)
    return tables.read(spark, d, "embeddings").select(
        F.col("vec_id").alias("window_id"), (burst % 9 + 1).cast("int").alias("subject"), F.when(burst % 2 == 0, "T").otherwise("E").alias("session"),
        (F.col("label") % 4).alias("label"), "embedding",
    )


@query("decoded_posteriors")
def decoded_posteriors(spark, d):
    """Discriminant fitted on the train session of each subject; posteriors for the other session."""
    w = _windows(spark, d)
    out = FE.decode("discriminant", w.where("session = 'T'"), w.where("session = 'E'"), ["subject"], "embedding", "label", 64)
    return out.select("window_id", "subject", "label", "posterior")


@query("decoded_kappa")
def decoded_kappa(spark, d):
    """Window-level agreement of those posteriors per subject."""
    return P.agreement(decoded_posteriors(spark, d).withColumn("pred", V.argmax_class(F.col("posterior"))), ["subject"], "label", "pred")


@query("logistic_posteriors")
def logistic_posteriors(spark, d):
    """Multinomial logistic model over all subjects, scored on the other session."""
    w = _windows(spark, d)
    out = FE.decode("logistic", w.where("session = 'T'"), w.where("session = 'E'"), [], "embedding", "label", 64)
    return out.select("window_id", "subject", "label", "posterior")


@query("logistic_by_subject")
def logistic_by_subject(spark, d):
    """One logistic model per subject, all fitted together; every row of the other session with its status."""
    w = _windows(spark, d)
    out = FE.decode("logistic", w.where("session = 'T'"), w.where("session = 'E'"), ["subject"], "embedding", "label", 64)
    return out.select("window_id", "subject", "label", "posterior", "model_status")


WINDOW_CTE = """WITH w AS (SELECT vec_id AS window_id, CAST(floor(vec_id/7)%9+1 AS INT) AS subject, CASE WHEN floor(vec_id/7)%2=0 THEN 'T' ELSE 'E' END AS session FROM embeddings)"""


@query(
    "decoders_saved_and_loaded",
    WINDOW_CTE + """, k AS (SELECT DISTINCT subject FROM w WHERE session='T' AND subject<>4)
SELECT decoder, subject, count(*) AS n, CASE WHEN subject IN (SELECT subject FROM k) THEN 0.0::DOUBLE END AS worst, CASE WHEN subject IN (SELECT subject FROM k) THEN 'ok' ELSE 'no model' END AS model_status
FROM w, (SELECT unnest(['discriminant','logistic']) AS decoder) WHERE session='E' GROUP BY ALL""",
)
def decoders_saved_and_loaded(spark, d):
    """Posteriors of decoders that were saved and loaded against those of the fitted ones; subject 4 was not fitted."""
    w = _windows(spark, d)
    train, rows = w.where("session = 'T' AND subject <> 4"), w.where("session = 'E'")
    out = []
    for name, kind in LE.DECODERS.items():
        fitted = kind(keys=["subject"], featuresCol="embedding", labelCol="label", size=64).fit(train)
        path = f"{shared_dir(spark)}/decoder-{uuid.uuid4().hex}"
        fitted.write().save(path)
        fresh = fitted.transform(rows).select("window_id", F.col("posterior").alias("fresh"))
        both = LE.LinearDecoderModel.load(path).transform(rows).join(fresh, "window_id")
        gap = F.array_max(F.zip_with("posterior", "fresh", lambda a, b: F.abs(a - b))).cast("double")
        out.append(both.groupBy("subject", "model_status").agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("worst")).select(F.lit(name).alias("decoder"), "subject", "n", "worst", "model_status"))
    return out[0].unionByName(out[1])
