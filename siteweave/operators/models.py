"""Statistical models: pooled moments by site, small linear algebra on the driver (order p at most MAX_FEATURES).

Sites, iterations and blocks are columns. Every iteration is one grouped aggregation over the subjects.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from siteweave.functions.scalar import SIGMOIDS, chi2_p1, dot
from siteweave.operators.matrix import eliminated

#: Features at most: p (p + 1) / 2 sums reach the driver for each site.
MAX_FEATURES = 64


def _p(features: DataFrame, x: str = "x") -> int:
    row = features.select(F.size(x).alias("p")).first()
    p = row["p"] if row else 0
    if p > MAX_FEATURES:
        raise ValueError(f"over {MAX_FEATURES} features: {p}")
    return p


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def irls_moments(data: DataFrame, beta: list[float], kind: str = "NATIVE", by: list[str] | None = None) -> DataFrame:
    """(by, xtwx_i_j for i <= j, xtwz_i, ll, max_nu) of data (by, x array, y): one scan, one aggregation."""
    by = ["site"] if by is None else by
    p = len(beta)
    nu = dot(F.col("x"), _array(beta))
    own = data.select(*by, "x", "y", nu.alias("nu"))
    own = own.withColumn("mu", SIGMOIDS[kind](F.col("nu")))
    own = own.withColumn("w", F.col("mu") * (1 - F.col("mu"))).withColumn("wz", F.col("w") * F.col("nu") + F.col("y") - F.col("mu"))
    xi = lambda i: F.col("x")[i]
    sums = [F.sum(F.col("w") * xi(i) * xi(j)).alias(f"xtwx_{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(xi(i) * F.col("wz")).alias(f"xtwz_{i}") for i in range(p)]
    clip = lambda v: F.greatest(v, F.lit(1e-300))
    ll = F.col("y") * F.ln(clip(F.col("mu"))) + (1 - F.col("y")) * F.ln(clip(1 - F.col("mu")))
    return own.groupBy(*by).agg(*sums, F.sum(ll).alias("ll"), F.max(F.abs("nu")).alias("max_nu"))


def scaled_inverse(z: np.ndarray, rhs: np.ndarray, scaler: float = 1000.0) -> np.ndarray:
    """Weights by an inverse that travels scaled and padded to a power of two, and is unpadded and scaled back after the product."""
    n = 1 << max(0, len(z) - 1).bit_length()
    wide, right = np.zeros((n, n)), np.zeros(n)
    wide[: len(z), : len(z)], right[: len(z)] = z * scaler, rhs
    return (wide @ right)[: len(z)] / scaler


class Fit(NamedTuple):
    beta: list[float]
    z: np.ndarray  # (X'WX)^-1 of the last step
    history: list[dict]  # iteration, ll, and beta after it
    converged: bool


def masks(p: int, sites: list, seed: int, scheme: str) -> dict:
    """A site's multiplicative mask: a random diagonal ("diagonal") or full matrix ("full")."""
    out = {}
    for k, s in enumerate(sites):
        rng = np.random.default_rng(seed + k)
        n = rng.standard_normal((p, p))
        out[s] = np.diag(np.diag(n)) if scheme == "diagonal" else n
    return out


def masked_inverse(parts: dict, scheme: str | None, seed: int = 1) -> np.ndarray:
    """The inverse of the sum of the sites' matrices, as protocols find it that reveal the masked sum only.

    diagonal: the pooled matrix times the sites' masks in turn is inverted, and the masks multiplied from the left from the
    last to the first. full: the mask is the sum of the sites' masks. None: plain.
    """
    sites = sorted(parts, key=str)
    total = sum(parts[s] for s in sites)
    if scheme is None:
        return eliminated(total)
    own = masks(len(total), sites, seed, scheme)
    if scheme == "full":
        n = sum(own[s] for s in sites)
        return n @ eliminated(total @ n)
    chain = total
    for s in sites:
        chain = chain @ own[s]
    out = eliminated(chain)
    for s in reversed(sites):
        out = own[s] @ out
    return out


def irls(data: DataFrame, epochs: int = 10, epsilon: float = 1e-5, kind: str = "NATIVE", site: str | None = "site", mask: str | None = None, seed: int = 1) -> Fit:
    """Logistic regression by iteratively reweighted least squares from beta 0, over all sites' pooled moments.

    Stops when the pooled log-likelihood changes by less than epsilon. mask: None, "diagonal" or "full" (masked_inverse).
    data (site, x array<double> beginning with the intercept, y). Each epoch scans data once; of a fit of several epochs
    these columns are persisted in memory and on disk until it ends, unless the caller has done so, and computed once.
    """
    by = [site] if site else []
    if epochs > 1 and data.storageLevel == StorageLevel.NONE:
        own = data.select(*by, "x", "y").persist()
        try:
            return irls(own, epochs, epsilon, kind, site, mask, seed)
        finally:
            own.unpersist()
    beta, z, history, last = [0.0] * _p(data), np.zeros((0, 0)), [], None
    for iteration in range(epochs):
        rows = irls_moments(data, beta, kind, by).collect()
        p = len(beta)
        parts, rhs, ll = {}, np.zeros(p), 0.0
        for k, r in enumerate(rows):
            m = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    m[i, j] = m[j, i] = r[f"xtwx_{i}_{j}"]
            parts[r[site] if site else k] = m
            rhs += np.array([r[f"xtwz_{i}"] for i in range(p)])
            ll += r["ll"]
        z = masked_inverse(parts, mask, seed + iteration)
        beta = (z @ rhs).tolist()
        history.append({"iteration": iteration, "ll": ll, "beta": beta})
        if last is not None and abs(ll - last) < epsilon:
            return Fit(beta, z, history, True)
        last = ll
    return Fit(beta, z, history, False)


def convergence(lls: DataFrame, epsilon: float) -> DataFrame:
    """(iter, ll, delta, converged) of per-site log-likelihoods (iter, site, ll)."""
    from pyspark.sql import Window

    total = lls.groupBy("iter").agg(F.sum("ll").alias("ll"))
    out = total.withColumn("delta", F.col("ll") - F.lag("ll").over(Window.orderBy("iter")))  # a row for each iteration
    return out.withColumn("converged", F.coalesce(F.abs("delta") < epsilon, F.lit(False)))


def fitted(data: DataFrame, beta: list[float], kind: str = "NATIVE") -> DataFrame:
    """data with mu, the fitted probability."""
    return data.withColumn("mu", SIGMOIDS[kind](dot(F.col("x"), _array(beta))))


def log_likelihood(data: DataFrame, beta: list[float], by: list[str] | None = None) -> DataFrame:
    mu = F.col("mu")
    return fitted(data, beta).groupBy(*(by or [])).agg(F.sum(F.col("y") * F.ln(mu) + (1 - F.col("y")) * F.ln(1 - mu)).alias("ll"))


def likelihood_ratio(data: DataFrame, beta: list[float]) -> DataFrame:
    """(feature, lrt): twice the loss in log-likelihood with a weight at zero, the others as they are; all features in one scan."""
    logs = lambda b: (lambda mu: F.sum(F.col("y") * F.ln(mu) + (1 - F.col("y")) * F.ln(1 - mu)))(SIGMOIDS["NATIVE"](dot(F.col("x"), _array(b))))
    reduced = [logs([0.0 if i == k else b for i, b in enumerate(beta)]).alias(f"l{k}") for k in range(len(beta))]
    row = data.agg(logs(beta).alias("full"), *reduced)
    each = F.array(*[F.struct(F.lit(k).alias("feature"), (2 * (F.col("full") - F.col(f"l{k}"))).alias("lrt")) for k in range(len(beta))])
    return row.select(F.explode(each).alias("r")).select("r.*")


# ---- score tests ----


def score_stats(geno: DataFrame, subjects: DataFrame, p: int, by: list[str]) -> DataFrame:
    """(by, score, gwg, gwx_i): sums over subjects of g (y - mu), w g^2 and w g x_i.

    geno (var_idx, subject_idx, g) joined to subjects (subject_idx, site, x, y, mu). Zero genotypes add nothing and may be
    left out. A shuffle on subjects unless they are small enough to be broadcast, then a combined one on `by`.
    """
    own = geno.where("g <> 0").join(subjects, "subject_idx")
    g, w = F.col("g").cast("double"), F.col("mu") * (1 - F.col("mu"))
    sums = [F.sum(w * g * F.col("x")[i]).alias(f"gwx_{i}") for i in range(p)]
    return own.groupBy(*by).agg(F.sum(g * (F.col("y") - F.col("mu"))).alias("score"), F.sum(w * g * g).alias("gwg"), *sums)


def tested(stats: DataFrame, z: np.ndarray, by: list[str]) -> DataFrame:
    """(by, score, s, t, chisq, p): S = score^2, T = gwg less the quadratic form of gwx in Z, and the tail of S / T."""
    p = len(z)
    quad = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            quad = quad + F.lit(float(z[i, j])) * F.col(f"gwx_{i}") * F.col(f"gwx_{j}")
    out = stats.select(*by, "score", (F.col("score") * F.col("score")).alias("s"), (F.col("gwg") - quad).alias("t"))
    out = out.withColumn("chisq", F.when(F.col("t") > 0, F.col("s") / F.when(F.col("t") > 0, F.col("t")).otherwise(1.0)))
    return out.withColumn("p", chi2_p1(F.col("chisq")))


def score_test(geno: DataFrame, subjects: DataFrame, z: np.ndarray) -> DataFrame:
    """Pooled over sites: sites' sums add up, so it is one aggregation by variant."""
    return tested(score_stats(geno, subjects, len(z), ["var_idx"]), z, ["var_idx"])


def score_test_federated(geno: DataFrame, subjects: DataFrame, z: np.ndarray) -> DataFrame:
    """In the protocol's phases: sums by site and variant, then pooled by variant, then tested. Equal to score_test."""
    p = len(z)
    local = score_stats(geno, subjects, p, ["site", "var_idx"])
    pooled = local.groupBy("var_idx").agg(*[F.sum(c).alias(c) for c in ("score", "gwg", *[f"gwx_{i}" for i in range(p)])])
    return tested(pooled, z, ["var_idx"])


def centred_stats(geno: DataFrame, freqs: DataFrame, subjects: DataFrame, p: int, site: str | None = None, scale: float = 1.0) -> DataFrame:
    """score_stats (by site, if given, and var_idx) of genotypes scale * (g - 2 af), for every variant of freqs (var_idx, af).

    The centred table is dense, so it is never made: cells with g <> 0 are summed as they are, and what centring adds to
    each sum follows from totals over a site's subjects, p + 2 numbers a site. Cells that are not 0, 1 or 2 (null too) are
    missing: they count as the mean, 0. Variants or frequencies of one side only give no row, or one of zeros for g.
    """
    by, parts = [site] if site else [], range(p)
    r, w = F.col("y") - F.col("mu"), F.col("mu") * (1 - F.col("mu"))
    x = lambda i: F.col("x")[i]
    whole = {"__r": r, "__w": w} | {f"__x_{i}": w * x(i) for i in parts}
    totals = subjects.groupBy(*by).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in whole.items()])
    totals = subjects.sparkSession.createDataFrame(totals.collect(), totals.schema)  # a row a site
    known = F.coalesce(F.col("g").isin(0, 1, 2), F.lit(False))
    g = F.when(known, F.col("g").cast("double")).otherwise(0.0)
    gone = F.when(known, 0.0).otherwise(1.0)
    sums = {"__gr": g * r, "__gw": g * w, "__ggw": g * g * w, "__mr": gone * r, "__mw": gone * w}
    sums |= {f"__gx_{i}": g * w * x(i) for i in parts} | {f"__mx_{i}": gone * w * x(i) for i in parts}
    cells = geno.where("g IS NULL OR g <> 0").select("var_idx", "subject_idx", "g")
    own = cells.join(subjects.select("subject_idx", *by, "x", "y", "mu"), "subject_idx").groupBy(*by, "var_idx").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    every = freqs.select("var_idx", (2.0 * F.col("af")).alias("__m")).crossJoin(totals)  # the rows of the result
    out = every.join(own, [*by, "var_idx"], "left").na.fill(0.0, list(sums))
    m, c = F.col("__m"), float(scale)
    rest = lambda t, gone: F.col(t) - F.col(gone)
    return out.select(
        *by,
        "var_idx",
        (c * (F.col("__gr") - m * rest("__r", "__mr"))).alias("score"),
        (c * c * (F.col("__ggw") - 2 * m * F.col("__gw") + m * m * rest("__w", "__mw"))).alias("gwg"),
        *[(c * (F.col(f"__gx_{i}") - m * rest(f"__x_{i}", f"__mx_{i}"))).alias(f"gwx_{i}") for i in parts],
    )


def score_test_centred(geno: DataFrame, freqs: DataFrame, subjects: DataFrame, z: np.ndarray, scale: float = 1.0) -> DataFrame:
    """score_test of centred and scaled genotypes. At the weights of a converged fit with an intercept chisq is that of score_test."""
    return tested(centred_stats(geno, freqs, subjects, len(z), None, scale), z, ["var_idx"])


def site_informations(subjects: DataFrame, p: int) -> dict:
    """(X'WX)^-1 of each site, by its own rows."""
    w = F.col("mu") * (1 - F.col("mu"))
    sums = [F.sum(w * F.col("x")[i] * F.col("x")[j]).alias(f"m_{i}_{j}") for i in range(p) for j in range(p)]
    return {r["site"]: eliminated(np.array([[r[f"m_{i}_{j}"] for j in range(p)] for i in range(p)])) for r in subjects.groupBy("site").agg(*sums).collect()}


def meta_site_stats(geno: DataFrame, subjects: DataFrame, p: int) -> DataFrame:
    """(site, var_idx, score, var): each site projects with its own covariates only. Sites' Z (p x p each) meet their sums in a join."""
    local = score_stats(geno, subjects, p, ["site", "var_idx"])
    kind = subjects.schema["site"].dataType.simpleString()
    rows = [(s, [float(v) for v in z.ravel()]) for s, z in site_informations(subjects, p).items()]
    own = local.join(subjects.sparkSession.createDataFrame(rows, f"site {kind}, __z array<double>"), "site")
    quad = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            quad = quad + F.col("__z")[p * i + j] * F.col(f"gwx_{i}") * F.col(f"gwx_{j}")
    return own.select("site", "var_idx", "score", (F.col("gwg") - quad).alias("var"))


def meta(summary: DataFrame, by: str = "var_idx") -> DataFrame:
    """(by, s, t, chisq, p) of summary statistics (site, by, score, var): squared sum of scores over sum of variances."""
    out = summary.groupBy(by).agg(F.sum("score").alias("score"), F.sum("var").alias("t"))
    out = out.select(by, (F.col("score") * F.col("score")).alias("s"), "t")
    return out.withColumn("chisq", F.when(F.col("t") > 0, F.col("s") / F.when(F.col("t") > 0, F.col("t")).otherwise(1.0))).withColumn("p", chi2_p1(F.col("chisq")))


def noised_ratio(st: DataFrame, seed: int = 1) -> DataFrame:
    """S / T with a common random factor on both, so that their ratio alone shows; the factor keeps off zero."""
    n = F.rand(seed) + 0.5
    own = st.withColumn("__n", n).withColumns({"s_masked": F.col("s") * F.col("__n"), "t_masked": F.col("t") * F.col("__n")})
    return own.withColumn("chisq", F.try_divide("s_masked", "t_masked")).drop("__n", "s", "t")


# ---- gradient models ----


def gradient_epoch(data: DataFrame, beta: list[float], step: float, penalty: float = 0.0, double_scale: bool = False) -> list[float]:
    """One full-batch step: a single aggregation. double_scale divides by n a second time."""
    p = len(beta)
    err = F.col("y") - F.col("mu")
    row = fitted(data, beta).agg(F.count(F.lit(1)).alias("n"), *[F.sum(err * F.col("x")[i]).alias(f"g{i}") for i in range(p)]).first()
    n = max(1, row["n"])
    g = np.array([row[f"g{i}"] or 0.0 for i in range(p)]) / n / (n if double_scale else 1)
    shrink = np.array(beta) * penalty
    shrink[0] = 0  # the intercept is not shrunk
    return (np.array(beta) + step * (g - shrink)).tolist()


def gradient(data: DataFrame, epochs: int, step: float, penalty: float = 0.0, double_scale: bool = False) -> list[float]:
    beta = [0.0] * _p(data)
    for _ in range(epochs):
        beta = gradient_epoch(data, beta, step, penalty, double_scale)
    return beta


def sequential_gradient(data: DataFrame, epochs: int, step: float, penalty: float = 0.0, order: str = "PER_SUBJECT", seed: int = 1, by: str | None = None) -> DataFrame:
    """(by, beta): updates after each subject in a random order ("PER_SUBJECT") or feature by feature ("PER_FEAT").

    The order of an epoch is that of the MD5 digests of "seed:epoch:key", so that it can be made again; keys are
    subject_idx, or the rows' places, or the features' numbers. Each update reads the one before, so a group is one task; for many models of bounded data side by side.
    """
    keyed = data if by else data.withColumn("__all", F.lit(0))
    name = by or "__all"
    kind = keyed.schema[name].dataType.simpleString()

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float)
        keys = pdf["subject_idx"].to_numpy() if "subject_idx" in pdf else np.arange(len(pdf))
        x, y = x[np.argsort(keys, kind="stable")], y[np.argsort(keys, kind="stable")]
        n, p = x.shape
        w = np.zeros(p)
        dealt = lambda epoch, keys: sorted(range(len(keys)), key=lambda k: hashlib.md5(f"{seed}:{epoch}:{keys[k]}".encode()).hexdigest())
        keys = np.sort(keys, kind="stable").tolist()
        keep = np.ones(p) * penalty
        keep[0] = 0
        for epoch in range(epochs):
            if order == "PER_FEAT":
                for k in dealt(epoch, range(p)):
                    mu = 1 / (1 + np.exp(-(x @ w)))
                    w[k] += step * ((y - mu) @ x[:, k] / n - keep[k] * w[k])
            else:
                for i in dealt(epoch, keys):
                    mu = 1 / (1 + np.exp(-(x[i] @ w)))
                    w += step / n * ((y[i] - mu) * x[i] - keep * w)
        return pd.DataFrame({name: [pdf[name].iloc[0]], "beta": [w.tolist()]})

    out = keyed.groupBy(name).applyInPandas(train, f"{name} {kind}, beta array<double>")
    return out if by else out.drop("__all")


def simulated(spark: SparkSession, n: int, p: int, seed: int = 1, sites: int = 3) -> tuple[DataFrame, list[float]]:
    """Data (subject_idx, site, x, y) of a logistic model with normal covariates, and its weights."""
    beta = np.random.default_rng(seed).standard_normal(p).tolist()
    base = spark.range(n).select(F.col("id").alias("subject_idx"), (F.col("id") % sites).cast("int").alias("site"), F.array(F.lit(1.0), *[F.randn(seed + k) for k in range(1, p)]).alias("x"))
    return base.withColumn("y", (F.rand(seed + p) < SIGMOIDS["NATIVE"](dot(F.col("x"), _array(beta)))).cast("double")), beta


def scaled_features(data: DataFrame) -> DataFrame:
    """x with each feature but the intercept at mean 0 and deviation 1 (deviation 0: left at 0). Two aggregates a feature reach the driver."""
    p = _p(data)
    row = data.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(p)], *[F.stddev_samp(F.col("x")[i]).alias(f"s{i}") for i in range(p)]).first()
    cols = [F.col("x")[0]] + [(F.col("x")[i] - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"]) if row[f"s{i}"] else F.lit(0.0) for i in range(1, p)]
    return data.withColumn("x", F.array(*cols))


# ---- soft K-means ----


def soft_kmeans_step(points: DataFrame, centroids: list[list[float]], factor: float = 0.2, by: list[str] | None = None) -> DataFrame:
    """(by, k, w, c_d): for each centroid the sum of weights e^(-factor d^2) and of weighted coordinates.

    Centroids are literals of the plan (few and small), so points are scanned once and only sums move.
    """
    dims = len(centroids[0])
    own = points.select(*(by or []), F.col("x"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _array(c).alias("c")) for k, c in enumerate(centroids)])).alias("m"))
    d2 = F.aggregate(F.zip_with("x", "m.c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    own = own.select(*(by or []), F.col("m.k").alias("k"), "x", F.exp(-F.lit(factor) * d2).alias("w"))
    return own.groupBy(*(by or []), "k").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col("x")[d]).alias(f"c_{d}") for d in range(dims)])


def soft_kmeans(points: DataFrame, centroids: list[list[float]], iterations: int = 5, factor: float = 0.2, site: str | None = None) -> list[list[float]]:
    """Centroids after some iterations; with `site`, sums are made by site and pooled."""
    for _ in range(iterations):
        dims = len(centroids[0])
        sums = soft_kmeans_step(points, centroids, factor, [site] if site else None)
        if site:
            sums = sums.groupBy("k").agg(F.sum("w").alias("w"), *[F.sum(f"c_{d}").alias(f"c_{d}") for d in range(dims)])
        rows = {r["k"]: r for r in sums.collect()}
        centroids = [[rows[k][f"c_{d}"] / rows[k]["w"] for d in range(dims)] if k in rows and rows[k]["w"] else c for k, c in enumerate(centroids)]
    return centroids


def mixture(spark: SparkSession, counts: list[list[int]], centres: list[list[float]], spread: float = 0.5, seed: int = 1) -> DataFrame:
    """Points (x, cluster_i, site_i) about centres; counts by site and cluster."""
    cells = [(s, c, n) for s, row in enumerate(counts) for c, n in enumerate(row) if n]
    base = spark.createDataFrame(cells, "site_i int, cluster_i int, n int").select("site_i", "cluster_i", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    at = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])[F.col("cluster_i")]
    dims = len(centres[0])
    return base.select(F.array(*[at[d] + F.randn(seed + d) * spread for d in range(dims)]).alias("x"), "cluster_i", "site_i")


def sigmoid_table(spark: SparkSession, high: float, step: float = 0.01) -> DataFrame:
    """(x, kim, native, tenseal) on a grid from -high to high."""
    n = int(round(2 * high / step)) + 1
    x = F.lit(-float(high)) + F.col("id") * F.lit(float(step))
    return spark.range(n).select(x.alias("x"), SIGMOIDS["KIM_ETAL"](x).alias("kim"), SIGMOIDS["NATIVE"](x).alias("native"), SIGMOIDS["TENSEAL"](x).alias("tenseal"))
