"""Protocol steps by option name: what each site runs in turn, over an exchange folder.

A step reads tables that sites have uploaded before, and uploads one of its own, named by iteration and site. Two schemes
hide the pooled information matrix: "diagonal" multiplies it by the sites' random diagonals in turn, "full" by the sum of
the sites' random matrices, with the inverse scaled and padded to a power of two while it travels. Matrices here are
p x p (p of MAX_FEATURES at most); statistics of variants stay tables. Shares and masks show the protocol's numbers and
protect nothing. Block sizes of variants are accepted and not needed: a step treats all variants at once.
"""

from __future__ import annotations

import secrets
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.operators import genotypes as G
from siteweave.operators import matrix as M
from siteweave.operators import models as L
from siteweave.operators import shares as E
from siteweave.operators import tables as T
from siteweave.plans.commands import command, load, names_in, save
from siteweave.plans.federation import Federation
from siteweave.sources import exchange as X
from siteweave.sources import text as S

#: Factor of the inverse while it travels, so that small numbers keep their digits.
Z_SCALER = 1000.0


def padded(z: np.ndarray, scaler: float = Z_SCALER) -> np.ndarray:
    """The inverse scaled, and padded with zeros to the next power of two."""
    n = 1 << max(0, len(z) - 1).bit_length()
    out = np.zeros((n, n))
    out[: len(z), : len(z)] = z * scaler
    return out


def unpadded(z: np.ndarray, p: int, scaler: float = Z_SCALER) -> np.ndarray:
    return z[:p, :p] / scaler


def weight(site: int, sites: int) -> float:
    """A site's part of a pooled decryption: (i + 1) / (n (n + 1) / 2)."""
    return (site + 1) / (sites * (sites + 1) / 2)


class Steps(Federation):
    """The steps of a study of some sites over a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, sites: int, scheme: str = "diagonal", kind: str = "NATIVE", epsilon: float = 1e-5, wait: float = 600) -> None:
        super().__init__(spark, folder, sites, epsilon, kind, wait)
        self.scheme = scheme

    # small matrices as tables of cells
    def put(self, name: str, x: np.ndarray) -> None:
        rows = [(i, j, float(v)) for i, r in enumerate(np.atleast_2d(x)) for j, v in enumerate(r)]
        X.upload(self.spark.createDataFrame(rows, "row int, col int, v double").coalesce(1), self.folder, name)

    def get(self, name: str) -> np.ndarray:
        X.wait(self.spark, self.folder, [name], self.seconds)
        rows = X.download(self.spark, self.folder, name).collect()
        out = np.zeros((1 + max(r["row"] for r in rows), 1 + max(r["col"] for r in rows)))
        for r in rows:
            out[r["row"], r["col"]] = r["v"]
        return out

    def each(self, what: str) -> list[np.ndarray]:
        return [self.get(f"{what}_site_{k}") for k in range(self.sites)]

    def moments(self, iteration: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Each site's X'WX, and the sum of X'Wz."""
        rows = sorted(self._all(f"moments_iter_{iteration}").collect(), key=lambda r: r["site"])
        p = sum(c.startswith("xtwz_") for c in rows[0].asDict())
        parts = [np.array([[r[f"xtwx_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) for r in rows]
        return parts, np.array([sum(r[f"xtwz_{i}"] for r in rows) for i in range(p)])

    def beta_of(self, iteration: int, site: int, p: int) -> list[float]:
        return [0.0] * p if iteration == 0 else self.get(f"beta_iter_{iteration}_site_{site}").ravel().tolist()

    # ---- null model ----
    def local(self, iteration: int, site: int, data: DataFrame) -> None:
        """Moments of the site's rows under the weights so far, and the site's mask."""
        p = L._p(data)
        own = data.withColumn("site", F.lit(site))
        X.upload(L.irls_moments(own, self.beta_of(iteration, site, p), self.kind), self.folder, f"moments_iter_{iteration}_site_{site}")
        self.put(f"mask_iter_{iteration}_site_{site}", L.masks(p, [site], 1 + 1009 * iteration + site, self.scheme)[site])

    def masks(self, iteration: int) -> list[np.ndarray]:
        return self.each(f"mask_iter_{iteration}")

    def add_noise(self, iteration: int, site: int) -> None:
        own = self.moments(iteration)[0][site]
        masks = self.masks(iteration)
        noisy = own @ sum(masks) if self.scheme == "full" else reduce(np.matmul, masks, own)
        self.put(f"noisy_iter_{iteration}_site_{site}", noisy)

    def pool_noisy(self, iteration: int, site: int) -> None:
        self.put(f"pooled_iter_{iteration}_site_{site}", sum(self.each(f"noisy_iter_{iteration}")))

    def share(self, what: str, to: str, site: int) -> None:
        """A site's part of the decryption of a pooled matrix."""
        self.put(f"{to}_site_{site}", self.get(f"{what}_site_{site}") * weight(site, self.sites))

    def remove_noise(self, iteration: int, site: int) -> None:
        """The inverse of the pooled matrix, which only ever shows under masks."""
        inverse = L.eliminated(sum(self.each(f"part_iter_{iteration}")))
        masks = self.masks(iteration)
        z = sum(masks) @ inverse if self.scheme == "full" else reduce(lambda x, n: n @ x, reversed(masks), inverse)
        self.put(f"inverse_iter_{iteration}_site_{site}", padded(z) if self.scheme == "full" else z)

    def z_of(self, iteration: int, site: int, p: int) -> np.ndarray:
        z = self.get(f"inverse_iter_{iteration}_site_{site}")
        return unpadded(z, p) if self.scheme == "full" else z

    def update_beta(self, iteration: int, site: int) -> None:
        rhs = self.moments(iteration)[1]
        self.put(f"weights_iter_{iteration}_site_{site}", self.z_of(iteration, site, len(rhs)) @ rhs)

    def pool_beta(self, iteration: int, site: int) -> None:
        self.put(f"beta_iter_{iteration + 1}_site_{site}", sum(self.each(f"weights_part_iter_{iteration}")))

    def plain_update(self, iteration: int, site: int) -> None:
        parts, rhs = self.moments(iteration)
        z = L.eliminated(sum(parts))
        self.put(f"inverse_iter_{iteration}_site_{site}", padded(z) if self.scheme == "full" else z)
        self.put(f"beta_iter_{iteration + 1}_site_{site}", z @ rhs)

    # ---- tests ----
    def statistics(self, site: int, iteration: int, geno: DataFrame, data: DataFrame, centre: tuple[DataFrame, float] | None = None) -> None:
        """Sums by variant; iteration: that of the weights. centre: frequencies and a factor (models.centred_stats)."""
        p = L._p(data)
        own = L.fitted(data.withColumn("site", F.lit(site)), self.beta_of(iteration, site, p), self.kind)
        stats = L.centred_stats(geno, centre[0], own, p, "site", centre[1]) if centre else L.score_stats(geno, own, p, ["site", "var_idx"])
        X.upload(stats, self.folder, f"stats_site_{site}")

    def tested(self, site: int, iteration: int) -> DataFrame:
        """(var_idx, s, t) of the pooled sums, with the inverse that gave the weights of `iteration`."""
        stats = self._all("stats")
        p = sum(c.startswith("gwx_") for c in stats.columns)
        pooled = stats.groupBy("var_idx").agg(*[F.sum(c).alias(c) for c in ("score", "gwg", *[f"gwx_{i}" for i in range(p)])])
        return L.tested(pooled, self.z_of(iteration - 1, site, p), ["var_idx"]).select("var_idx", "s", "t")

    def pool_statistics(self, site: int, iteration: int) -> None:
        X.upload(self.tested(site, iteration), self.folder, f"st_site_{site}")

    def noise(self, site: int, var: F.Column) -> F.Column:
        """A site's random factor of a variant, off zero; from its hash, so that it can be made again."""
        return F.pmod(F.xxhash64(F.lit(4001 + site), var.cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20)) + 0.5

    def add_st_noise(self, site: int) -> None:
        """S and T times the site's noise: pooled, a common factor that their ratio does not show."""
        n = self.noise(site, F.col("var_idx"))
        X.wait(self.spark, self.folder, [f"st_site_{site}"], self.seconds)
        X.upload(X.download(self.spark, self.folder, f"st_site_{site}").select("var_idx", (F.col("s") * n).alias("s"), (F.col("t") * n).alias("t")), self.folder, f"st_noisy_site_{site}")

    def pool_st(self, site: int) -> None:
        pooled = self._all("st_noisy").groupBy("var_idx").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
        X.upload(pooled, self.folder, f"st_pooled_site_{site}")

    def share_st(self, what: str, site: int) -> None:
        X.wait(self.spark, self.folder, [f"{what}_site_{site}"], self.seconds)
        w = F.lit(weight(site, self.sites))
        own = X.download(self.spark, self.folder, f"{what}_site_{site}")
        X.upload(own.select("var_idx", (F.col("s") * w).alias("s"), (F.col("t") * w).alias("t")), self.folder, f"{what}_part_site_{site}")

    def p_values_of(self, what: str) -> DataFrame:
        """(var_idx, p, chisq, s, t) of the sites' parts."""
        from siteweave.functions.scalar import chi2_p1

        pooled = self._all(f"{what}_part").groupBy("var_idx").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
        chisq = F.when(F.col("t") > 0, F.col("s") / F.when(F.col("t") > 0, F.col("t")).otherwise(1.0))
        return pooled.withColumn("chisq", chisq).select("var_idx", chi2_p1(F.col("chisq")).alias("p"), "chisq", "s", "t")


# ---- files of a site ----


def data_of(s: SparkSession, features: str, phenotypes: str) -> DataFrame:
    return S.features(s, features).join(S.phenotypes(s, phenotypes), "subject_id")


def geno_of(s: SparkSession, gmmat: str, features: str) -> DataFrame:
    """Genotypes by subject id: the columns follow the rows of the feature file."""
    ids = S.numbered_lines(s, features).where("n > 0").select((F.col("n") - 1).alias("subject_idx"), F.split("value", "\t")[0].alias("subject_id"))
    long = G.long_form(S.gmmat(s, gmmat).withColumnRenamed("var_id", "var_idx"), ["var_idx"])
    return long.join(ids, "subject_idx").select("var_idx", F.col("subject_id").alias("subject_idx"), "g")


def subjects_of(s: SparkSession, features: str, phenotypes: str) -> DataFrame:
    return data_of(s, features, phenotypes).withColumnRenamed("subject_id", "subject_idx")


def _write(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").csv(out, sep="\t")


# ---- null model: (iteration, site, sites, features, phenotypes, epochs, sigmoid, epsilon, ..., shared folder) ----


def _null(scheme: str, act):
    def step(s, iteration, site, sites, features, phenotypes, epochs, kind, epsilon, *rest):
        act(Steps(s, rest[-1], int(sites), scheme, kind, float(epsilon)), int(iteration), int(site), lambda: data_of(s, features, phenotypes))

    return step


NULL = {
    "local": lambda f, k, site, data: f.local(k, site, data()),
    "noise": lambda f, k, site, _: f.add_noise(k, site),
    "pool": lambda f, k, site, _: f.pool_noisy(k, site),
    "part": lambda f, k, site, _: f.share(f"pooled_iter_{k}", f"part_iter_{k}", site),
    "inverse": lambda f, k, site, _: f.remove_noise(k, site),
    "update": lambda f, k, site, _: f.update_beta(k, site),
    "weights_part": lambda f, k, site, _: f.share(f"weights_iter_{k}", f"weights_part_iter_{k}", site),
    "beta": lambda f, k, site, _: f.pool_beta(k, site),
    "plain": lambda f, k, site, _: f.plain_update(k, site),
}

command("cryptable_client_calculate_save_XtWX_XtWz")(_null("diagonal", NULL["local"]))
command("cryptable_client_add_mult_noise_2_XtWX")(_null("diagonal", NULL["noise"]))
command("cryptable_client_pool_site_specific_all_site_noise_XtWX")(_null("diagonal", NULL["pool"]))
command("cryptable_collaborative_decrypt_pooled_noisy_XtWX")(_null("diagonal", NULL["part"]))
command("cryptable_pool_partially_decrypted_pooled_noisy_XtWx_remove_noise")(_null("diagonal", NULL["inverse"]))
command("cryptable_client_pool_XtWX_XtWz_update_beta")(_null("diagonal", NULL["update"]))
command("cryptable_client_collaborative_decrypt_beta")(_null("diagonal", NULL["weights_part"]))
command("cryptable_client_pool_partially_decrypted_beta")(_null("diagonal", NULL["beta"]))
command("secure_client_calculate_save_XtWX_XtWz")(_null("full", NULL["local"]))
command("add_noise_to_XtWX")(_null("full", NULL["noise"]))
command("pool_site_specific_all_site_noise_XtWX")(_null("full", NULL["pool"]))
command("collaborative_decrypt_pooled_noisy_XtWX")(_null("full", NULL["part"]))
command("pool_partially_decrypted_pooled_noisy_XtWx_remove_noise")(_null("full", NULL["inverse"]))
command("pool_XtWX_XtWz_update_beta")(_null("full", NULL["update"]))
command("client_collaborative_decrypt_beta")(_null("full", NULL["weights_part"]))
command("client_pool_partially_decrypted_beta")(_null("full", NULL["beta"]))
command("client_calculate_save_XtWX_XtWz")(_null("diagonal", NULL["local"]))
command("client_pool_XtWX_XtWz_update_beta")(_null("diagonal", NULL["plain"]))


@command("client_check_convergence_per_updated_beta")
def _(s, iteration, site, sites, epsilon, shared):
    return Steps(s, shared, int(sites), epsilon=float(epsilon)).converged(int(iteration))


@command("fit_null_model")
def fit_null_model(s, site, sites, features, phenotypes, epochs, kind, epsilon, shared):
    """One site's run of the secure null model; returns the number of the last weights. Sites run it side by side, and each step waits for the others' tables."""
    f = Steps(s, shared, int(sites), "full", kind, float(epsilon))
    for k in range(int(epochs)):
        for name in ("local", "noise", "pool", "part", "inverse", "update", "weights_part", "beta"):
            NULL[name](f, k, int(site), lambda: data_of(s, features, phenotypes))
        if f.converged(k):
            return k + 1
    return int(epochs)


# ---- tests: (site, sites, iteration, block, genotypes, features, phenotypes, ..., shared folder) ----


def _test(scheme: str, act):
    def step(s, site, sites, iteration, block, gmmat, features, phenotypes, *rest):
        return act(Steps(s, rest[-1], int(sites), scheme), int(site), int(iteration), lambda: geno_of(s, gmmat, features), lambda: subjects_of(s, features, phenotypes), rest)

    return step


def _final(f: Steps, what: str, rest) -> DataFrame:
    out = f.p_values_of(what)
    if len(rest) > 1:  # a private folder is named: the results go there
        _write(out, f"{rest[0]}/p_values")
    return out


command("cryptable_client_calculate_save_pvalue_stats")(_test("diagonal", lambda f, site, k, g, d, _: f.statistics(site, k, g(), d())))
command("cryptable_client_pool_pvalue_stats")(_test("diagonal", lambda f, site, k, g, d, _: f.pool_statistics(site, k)))
command("cryptable_client_collaborative_decrypt_pval_stats")(_test("diagonal", lambda f, site, k, g, d, _: f.share_st("st", site)))
command("cryptable_client_pool_partially_decrypted_pval_stats")(_test("diagonal", lambda f, site, k, g, d, rest: _final(f, "st", rest)))
command("secure_client_calculate_save_pvalue_stats")(_test("full", lambda f, site, k, g, d, _: f.statistics(site, k, g(), d())))
command("client_pool_pvalue_stats_add_noise")(_test("full", lambda f, site, k, g, d, _: (f.pool_statistics(site, k), f.add_st_noise(site))))
command("pool_noisy_ST_stats")(_test("full", lambda f, site, k, g, d, _: f.pool_st(site)))
command("client_collaborative_decrypt_noisy_ST_stats")(_test("full", lambda f, site, k, g, d, _: f.share_st("st_pooled", site)))
command("client_pool_partially_decrypted_noisy_ST_stats")(_test("full", lambda f, site, k, g, d, rest: _final(f, "st_pooled", rest)))


@command("cryptable_client_calculate_save_pvalue_stats_mean_centered_genotypes")
def _(s, site, sites, iteration, block, gmmat, features, phenotypes, freqs, scaler, *rest):
    """Genotypes less twice their allele frequency (column 5 of the file), times a factor; missing ones count as the mean."""
    af = s.read.text(freqs).select(F.split("value", "\t").alias("f")).select(F.col("f")[3].alias("var_idx"), F.col("f")[4].cast("double").alias("af"))
    step, geno = Steps(s, rest[-1], int(sites)), geno_of(s, gmmat, features)
    step.statistics(int(site), int(iteration), geno, subjects_of(s, features, phenotypes), (af, float(scaler)))


def _scaled(s, site, sites, iteration, shared) -> None:
    """A site's scale of each variant: its own G'WG less its part of the pooled projection."""
    f = Steps(s, shared, int(sites))
    stats = f._all("stats")
    p = sum(c.startswith("gwx_") for c in stats.columns)
    z = f.z_of(int(iteration) - 1, int(site), p)
    pooled = stats.groupBy("var_idx").agg(*[F.sum(f"gwx_{i}").alias(f"all_{i}") for i in range(p)])
    quad = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            quad = quad + F.lit(float(z[i, j])) * F.col(f"all_{i}") * F.col(f"gwx_{j}")
    own = stats.where(F.col("site") == int(site)).join(pooled, "var_idx")
    X.upload(own.select("var_idx", "score", (F.col("gwg") - quad).alias("scale")), shared, f"scale_site_{site}")


@command("client_calculate_save_pvalue_stats")
def _(s, site, sites, block, gmmat, features, phenotypes, null_model, shared):
    """Plain: the null model is a file of fitted phenotypes."""
    fitted = S.phenotypes(s, null_model).select(F.col("subject_id").alias("subject_idx"), F.col("y").alias("mu"))
    own = subjects_of(s, features, phenotypes).join(fitted, "subject_idx").withColumn("site", F.lit(int(site)))
    X.upload(L.score_stats(geno_of(s, gmmat, features), own, L._p(own), ["site", "var_idx"]), shared, f"stats_site_{site}")


command("client_update_pvalue_scale_stats")(lambda s, site, sites, iteration, block, gmmat, features, phenotypes, null_model, shared: _scaled(s, site, sites, iteration, shared))


@command("client_pool_pvalue_stats")
def _(s, site, sites, block, shared):
    """(var_idx, p, chisq, s, t) of the sites' scores and scales."""
    pooled = Steps(s, shared, int(sites))._all("scale").groupBy("var_idx").agg(F.sum("score").alias("score"), F.sum("scale").alias("t"))
    return _p_of(pooled.select("var_idx", (F.col("score") * F.col("score")).alias("s"), "t"))


def _p_of(st: DataFrame) -> DataFrame:
    from siteweave.functions.scalar import chi2_p1

    chisq = F.when(F.col("t") > 0, F.col("s") / F.when(F.col("t") > 0, F.col("t")).otherwise(1.0))
    return st.withColumn("chisq", chisq).select("var_idx", chi2_p1(F.col("chisq")).alias("p"), "chisq", "s", "t")


@command("client_calculate_save_pvalue_stats_for_meta_analysis")
def _(s, site, sites, block, gmmat, features, phenotypes, null_model, shared):
    """Scores, and variances by the site's own projection."""
    fitted = S.phenotypes(s, null_model).select(F.col("subject_id").alias("subject_idx"), F.col("y").alias("mu"))
    own = subjects_of(s, features, phenotypes).join(fitted, "subject_idx").withColumn("site", F.lit(int(site)))
    Federation(s, shared, int(sites)).share_summary(int(site), L.meta_site_stats(geno_of(s, gmmat, features), own, L._p(own)))


command("client_pool_pvalue_stats_for_meta_analysis")(lambda s, site, sites, block, shared: Federation(s, shared, int(sites), wait=600).meta())


@command("assign_p_values")
def _(s, site, sites, iteration, gmmat, features, phenotypes, shared, private):
    """One site's run of the secure test after fit_null_model."""
    f = Steps(s, shared, int(sites), "full")
    f.statistics(int(site), int(iteration), geno_of(s, gmmat, features), subjects_of(s, features, phenotypes))
    f.pool_statistics(int(site), int(iteration))
    f.add_st_noise(int(site))
    f.pool_st(int(site))
    f.share_st("st_pooled", int(site))
    return _final(f, "st_pooled", (private, shared))


@command("pool_final_plaintext_p_values")
def _(s, listed, out):
    """The blocks' results after one another."""
    _write(s.read.csv(names_in(s, listed), sep="\t"), out)


# ---- meta-analysis: (site, sites, summary file with score and variance in columns 6 and 7, shared folder) ----


@command("meta_encrypt_save_ST_stats")
def _(s, site, sites, summary, shared):
    f = s.read.text(summary).where("value <> ''").select(F.split("value", r"\t").alias("f")).where("try_cast(f[5] AS double) IS NOT NULL")
    X.upload(f.select(F.lit(int(site)).alias("site"), F.col("f")[0].alias("var_idx"), F.col("f")[5].cast("double").alias("score"), F.col("f")[6].cast("double").alias("var")), shared, f"summary_site_{site}")


@command("meta_pool_per_site_ST_stats_add_noise")
def _(s, site, sites, shared):
    f = Steps(s, shared, int(sites))
    pooled = f._all("summary").groupBy("var_idx").agg(F.sum("score").alias("score"), F.sum("var").alias("t"))
    n = f.noise(int(site), F.col("var_idx"))
    X.upload(pooled.select("var_idx", (F.col("score") * F.col("score") * n).alias("s"), (F.col("t") * n).alias("t")), shared, f"st_noisy_site_{site}")


command("meta_pool_noisy_ST_stats")(lambda s, site, sites, shared: Steps(s, shared, int(sites)).pool_st(int(site)))
command("meta_collaborative_decrypt_pooled_noisy_ST_stats")(lambda s, site, sites, shared: Steps(s, shared, int(sites)).share_st("st_pooled", int(site)))
command("meta_pool_partially_decrypted_pooled_noisy_ST_stats")(lambda s, site, sites, *rest: _final(Steps(s, rest[-1], int(sites)), "st_pooled", rest))


@command("run_META_analysis")
def _(s, site, sites, summary, shared, private):
    from siteweave.plans.commands import run

    for option in ("meta_encrypt_save_ST_stats", "meta_pool_per_site_ST_stats_add_noise", "meta_pool_noisy_ST_stats", "meta_collaborative_decrypt_pooled_noisy_ST_stats"):
        run(s, option, str(site), str(sites), *((summary,) if option == "meta_encrypt_save_ST_stats" else ()), shared)
    return run(s, "meta_pool_partially_decrypted_pooled_noisy_ST_stats", str(site), str(sites), private, shared)


# ---- checks, folders, exchange ----


@command("validate_input_data", "validate_run")
def _(s, gmmat, features, phenotypes, least="1"):
    """Files are there, rows are enough, and subjects agree."""
    X.require(s, [gmmat, features, phenotypes])
    X.check_rows(S.gmmat(s, gmmat), int(least), gmmat)
    a, b = S.features(s, features).select("subject_id"), S.phenotypes(s, phenotypes).select("subject_id")
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("features and phenotypes name different subjects")


@command("validate_meta_analysis_input_data", "validate_meta_run")
def _(s, summary, shared):
    X.require(s, [summary])
    if not X.probe(s, shared):
        raise OSError(f"{shared} cannot be written and read")


command("validate_directory_exists")(lambda s, path: X.require(s, [path], True))
command("validate_file_exists")(lambda s, path: X.require(s, [path], False))


@command("validate_param_directory")
def _(s, folder):
    """A folder with valid parameters in params.txt."""
    X.require(s, [folder], True)
    own = E.Params.read("\n".join(r["value"] for r in s.read.text(f"{folder}/params.txt").collect()))
    if own.faults():
        raise ValueError("; ".join(own.faults()))


@command("set_params")
def _(s, folder, degree, mod_bits, scale_bits, noise_bits):
    """Parameters, if valid, to params.txt."""
    own = E.Params(int(degree), tuple(int(x) for x in mod_bits.split()), int(scale_bits), int(noise_bits))
    if own.faults():
        raise ValueError("; ".join(own.faults()))
    lines = [str(own.degree), " ".join(map(str, own.mod_bits)), str(own.scale_bits), str(own.noise_bits)]
    s.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/params.txt")


@command("generate_per_site_noisy_keys", "generate_keys")
def _(s, sites, params, out):
    """A secret of -1, 0 and 1 as additive shares of the sites, a folder for each; they sum up to it."""
    own = E.Params.read("\n".join(r["value"] for r in s.read.text(params).collect()))
    secret = M.Matrix(M.grid(s, 1, own.degree).withColumn("v", F.pmod(F.xxhash64(F.lit(11), "col"), F.lit(3)) - 1.0), 1, own.degree)
    E.random_shares(secret, int(sites), float(1 << own.noise_bits)).write.mode("overwrite").partitionBy("site").parquet(out)


command("symmetric_encrypt_partdec_data")(lambda s, path, column, key, out: E.sealed(s.read.parquet(path), column, key).write.mode("overwrite").parquet(out))
command("symmetric_decrypt_partdec_data")(lambda s, path, column, key, out: E.unsealed(s.read.parquet(path), column, key).write.mode("overwrite").parquet(out))
command("get_date_time_str")(lambda s: s.range(1).select(X.timestamp_text()).first()[0])
command("get_resource_size")(lambda s, path: X.size(s, path))
command("test_file_IO")(lambda s, shared: X.probe(s, shared))
command("clean_shared_directory", "clean_local_directory")(lambda s, path: X.clean(s, path))
command("probe_files_in_shared")(lambda s, listed, shared: X.missing(s, shared, names_in(s, listed)))
command("wait_for_files_in_shared")(lambda s, listed, shared, seconds="3600": X.wait(s, shared, names_in(s, listed), float(seconds)))


def _base(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


@command("upload_files_to_shared")
def _(s, listed, shared):
    """Tables of the list, each under its own name."""
    for path in names_in(s, listed):
        X.upload(s.read.parquet(path), shared, _base(path))


@command("download_files_from_shared")
def _(s, listed, shared, out):
    for name in names_in(s, listed):
        X.download(s, shared, name).write.mode("overwrite").parquet(f"{out}/{name}")


command("setup_directories")(lambda s, *paths: [X._fs(s, p)[0].mkdirs(X._fs(s, p)[1]) for p in paths])
command("stop_FedGWAS_processes")(lambda s: s.sparkContext.cancelAllJobs())
command("get_last_win_start_i")(lambda s, n, block: G.last_block_start(int(n), int(block)))


@command("convert_GMMAT_dir")
def _(s, table, out):
    """A table id, covariates, phenotype as feature and phenotype files."""
    own = s.read.csv(table, sep="\t", header=True)
    key, *covars, y = own.columns
    f, p = T.genotype_phenotypes(own)
    f.write.mode("overwrite").csv(f"{out}/feat_matrix", sep="\t", header=True)
    p.write.mode("overwrite").csv(f"{out}/phenotypes", sep="\t", header=True)


@command("split_GMMAT_dir")
def _(s, gmmat, features, phenotypes, sites, out, seed="1"):
    """Subjects dealt to sites of nearly equal size in an order at random, with their rows and genotype columns."""
    from siteweave.operators.stats import dealt

    x, y = s.read.csv(features, sep="\t", header=True), s.read.csv(phenotypes, sep="\t", header=True)
    ids = S.numbered_lines(s, features).where("n > 0").select((F.col("n") - 1).alias("subject_idx"), F.split("value", "\t")[0].alias("id"))
    parts = T.split_parts(ids.withColumn("d", dealt(F.lit(int(seed)), F.col("id"))), int(sites), [F.col("d"), F.col("id")], "site").cache()
    long = G.long_form(S.gmmat(s, gmmat), ["var_id", "ref", "alt"]).join(parts.select("subject_idx", "site"), "subject_idx")
    for k in range(int(sites)):
        own = parts.where(F.col("site") == k + 1)
        place = own.select(F.col("id").alias(x.columns[0]), "subject_idx")
        x.join(place, x.columns[0]).coalesce(1).sortWithinPartitions("subject_idx").select(*x.columns).write.mode("overwrite").csv(f"{out}/site_{k}/feat_matrix", sep="\t", header=True)
        y.join(place.withColumnRenamed(x.columns[0], y.columns[0]), y.columns[0]).coalesce(1).sortWithinPartitions("subject_idx").select(*y.columns).write.mode("overwrite").csv(f"{out}/site_{k}/phenotypes", sep="\t", header=True)
        S.write_gmmat(G.wide_form(long.where(F.col("site") == k + 1), ["var_id", "ref", "alt"]), f"{out}/site_{k}/genotypes")
    parts.unpersist()


# ---- key material: random text keys for the built-in AES functions; archives come from any file system that Spark reaches ----


command("generate_openssl_hash")(lambda s, size="32": secrets.token_hex(int(size)))


@command("generate_DSK_encryption_key")
def _(s, out):
    """A random key of 32 characters."""
    s.createDataFrame([(secrets.token_hex(16),)], "value string").coalesce(1).write.mode("overwrite").text(out)


@command("download_DSK_archive")
def _(s, source, out):
    """A copy of a folder or file."""
    (a, x), (b, y) = X._fs(s, source), X._fs(s, out)
    s.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, s.sparkContext._jsc.hadoopConfiguration())


@command("decrypt_site_DSK")
def _(s, sealed, column, key_file, out):
    """A site's shares of the key, sealed under the key of a file."""
    E.unsealed(s.read.parquet(sealed), column, names_in(s, key_file)[0]).write.mode("overwrite").parquet(out)


# ---- soft K-means by sites: points are (row, col, v) of a matrix ----


def _points(s, path: str) -> DataFrame:
    return load(s, path).rows().select(F.col("v").alias("x"))


def _centroids(s, path: str) -> list[list[float]]:
    return [list(r["v"]) for r in load(s, path).rows().orderBy("row").collect()]


@command("get_X_2_centroids_dist")
def _(s, points, centroids, out, factor="0.2"):
    """-factor |x - c|^2 of each point (row) and centroid (column)."""
    cs = _centroids(s, centroids)
    own = load(s, points).rows()
    d2 = [F.aggregate(F.zip_with("v", L._array(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v) * F.lit(-float(factor)) for c in cs]
    cells = own.select("row", F.posexplode(F.array(*d2)).alias("col", "v"))
    save(M.Matrix(cells, load(s, points).nrow, len(cs)), out)


command("collab_exponentiate_cluster_sq_dists")(lambda s, distances, sites, out: save(E.collaborative_exp(load(s, distances), int(sites)), out))


@command("calculate_centroid_updates")
def _(s, points, weights, out):
    """A site's sums: for each centroid (row) of the weighted coordinates, then of the weights."""
    x, w = load(s, points), load(s, weights)
    sums = w.transpose().matmul(x).df
    total = w.df.groupBy(F.col("col").alias("row")).agg(F.sum("v").alias("v")).select("row", F.lit(x.ncol).alias("col"), "v")
    save(M.Matrix(sums.unionByName(total), w.ncol, x.ncol + 1), out)


@command("pool_normalize_centroid_updates")
def _(s, listed, out):
    """Sums of all sites, over their weights, which only show masked."""
    pooled = M.add_all([load(s, p) for p in names_in(s, listed)])
    d = pooled.ncol - 1
    weights = M.Matrix(pooled.df.where(F.col("col") == d).select("row", F.lit(0).alias("col"), "v"), pooled.nrow, 1)
    save(E.collaborative_divide(M.Matrix(pooled.df.where(F.col("col") < d), pooled.nrow, d), weights), out)


@command("generate_data")
def _(s, counts, centres, out, spread="0.5"):
    """Points about centres; counts by site and cluster: rows `a b c;d e f`."""
    table = lambda t, kind: [[kind(v) for v in r.split()] for r in t.split(";")]
    L.mixture(s, table(counts, int), table(centres, float), float(spread)).write.mode("overwrite").parquet(out)


@command("run_protocol")
def _(s, points, centroids, iterations, out):
    """Soft K-means over one table of points."""
    got = L.soft_kmeans(_points(s, points), _centroids(s, centroids), int(iterations))
    cells = [(i, j, float(v)) for i, c in enumerate(got) for j, v in enumerate(c)]
    save(M.Matrix(s.createDataFrame(cells, "row int, col int, v double"), len(got), len(got[0])), out)


@command("plot_results")
def _(s, points, centroids, out):
    """What a plot shows: (row, x, centroid, distance) of each point and the centroid closest to it."""
    cs = _centroids(s, centroids)
    d2 = [F.struct(F.sqrt(F.aggregate(F.zip_with("v", L._array(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)).alias("distance"), F.lit(k).alias("centroid")) for k, c in enumerate(cs)]
    load(s, points).rows().select("row", F.col("v").alias("x"), F.array_min(F.array(*d2)).alias("n")).select("row", "x", "n.centroid", "n.distance").write.mode("overwrite").parquet(out)


@command("run_FedGWAS")
def _(s, gmmat, features, phenotypes, sites, epochs, shared, private):
    """The whole study in one process: split by site, the null model's steps in turn, then the tests."""
    from siteweave.plans.commands import run

    n = int(sites)
    run(s, "split_GMMAT_dir", gmmat, features, phenotypes, sites, private)
    own = [(f"{private}/site_{k}/genotypes", f"{private}/site_{k}/feat_matrix", f"{private}/site_{k}/phenotypes") for k in range(n)]
    f = Steps(s, shared, n, "full")
    last = int(epochs)
    for it in range(int(epochs)):
        for name in ("local", "noise", "pool", "part", "inverse", "update", "weights_part", "beta"):
            for k, (_, x, y) in enumerate(own):
                NULL[name](f, it, k, lambda x=x, y=y: data_of(s, x, y))
        if f.converged(it):
            last = it + 1
            break
    for k, (g, x, y) in enumerate(own):
        f.statistics(k, last, geno_of(s, g, x), subjects_of(s, x, y))
    for act in (lambda k: f.pool_statistics(k, last), f.add_st_noise, f.pool_st, lambda k: f.share_st("st_pooled", k)):
        for k in range(n):
            act(k)
    return _final(f, "st_pooled", (private, shared))
