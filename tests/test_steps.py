"""The multi-site protocols by option names: equal to one pooled analysis."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import models as L
from siteweave.plans import steps
from siteweave.plans.commands import COMMANDS, load, run, save
from siteweave.sources import exchange as X

SITES = 2


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    """Files of each site, and all rows."""
    root = tmp_path_factory.mktemp("study")
    rng = np.random.default_rng(3)
    files, rows, genos = [], [], []
    for k in range(SITES):
        n = 30 + 10 * k
        x = np.column_stack([np.ones(n), rng.standard_normal((n, 2))])
        y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [0.2, 0.5, -0.4])))).astype(int)
        g = rng.integers(0, 3, (4, n))
        ids = [f"s{k}_{i}" for i in range(n)]
        d = root / f"site{k}"
        d.mkdir()
        (d / "x.txt").write_text("id\tINTERCEPT\tA\tB\n" + "".join("\t".join([i, *[repr(float(v)) for v in r]]) + "\n" for i, r in zip(ids, x)))
        (d / "y.txt").write_text("id\tPHENOTYPE\n" + "".join(f"{i}\t{v}\n" for i, v in zip(ids, y)))
        (d / "g.txt").write_text("".join("\t".join([f"v{j}_A_C", "A", "C", *map(str, r)]) + "\n" for j, r in enumerate(g)))
        files.append((str(d / "g.txt"), str(d / "x.txt"), str(d / "y.txt")))
        rows += [(i, k, [float(v) for v in r], float(t)) for i, r, t in zip(ids, x, y)]
        genos += [(f"v{j}_A_C", i, int(g[j, c])) for c, i in enumerate(ids) for j in range(4)]
    data = spark.createDataFrame(rows, "subject_idx string, site int, x array<double>, y double").cache()
    geno = spark.createDataFrame(genos, "var_idx string, subject_idx string, g int").cache()
    return files, data, geno


NULL = {
    "diagonal": [f"cryptable_{x}" for x in ("client_calculate_save_XtWX_XtWz", "client_add_mult_noise_2_XtWX", "client_pool_site_specific_all_site_noise_XtWX", "collaborative_decrypt_pooled_noisy_XtWX", "pool_partially_decrypted_pooled_noisy_XtWx_remove_noise", "client_pool_XtWX_XtWz_update_beta", "client_collaborative_decrypt_beta", "client_pool_partially_decrypted_beta")],
    "full": ["secure_client_calculate_save_XtWX_XtWz", "add_noise_to_XtWX", "pool_site_specific_all_site_noise_XtWX", "collaborative_decrypt_pooled_noisy_XtWX", "pool_partially_decrypted_pooled_noisy_XtWx_remove_noise", "pool_XtWX_XtWz_update_beta", "client_collaborative_decrypt_beta", "client_pool_partially_decrypted_beta"],
    "plain": ["client_calculate_save_XtWX_XtWz", "client_pool_XtWX_XtWz_update_beta"],
}
TESTS = {
    "diagonal": ["cryptable_client_calculate_save_pvalue_stats", "cryptable_client_pool_pvalue_stats", "cryptable_client_collaborative_decrypt_pval_stats", "cryptable_client_pool_partially_decrypted_pval_stats"],
    "full": ["secure_client_calculate_save_pvalue_stats", "client_pool_pvalue_stats_add_noise", "pool_noisy_ST_stats", "client_collaborative_decrypt_noisy_ST_stats", "client_pool_partially_decrypted_noisy_ST_stats"],
}


def expected(spark, data, geno, epochs):
    fit = L.irls(data, epochs, 0.0)
    rows = L.score_test(geno, L.fitted(data, fit.beta), fit.z).collect()
    return fit, {r["var_idx"]: (r["chisq"], r["p"]) for r in rows}


@pytest.mark.parametrize("scheme", ["diagonal", "full", "plain"])
def test_study_by_options(spark, study, tmp_path, scheme):
    files, data, geno = study
    shared, epochs = str(tmp_path / "shared"), 2
    fit, want = expected(spark, data, geno, epochs)
    for it in range(epochs):
        for option in NULL[scheme]:
            for k, (_, x, y) in enumerate(files):
                run(spark, f"-{option}", str(it), str(k), str(SITES), x, y, str(epochs), "NATIVE", "1e-9", *([] if scheme == "plain" else ["private"]), shared)
    f = steps.Steps(spark, shared, SITES, "full" if scheme == "full" else "diagonal")
    assert f.beta_of(epochs, 1, 3) == pytest.approx(fit.beta, rel=1e-6)
    assert run(spark, "-client_check_convergence_per_updated_beta", "1", "0", str(SITES), "1e9", shared)
    if scheme == "plain":
        for k, (g, x, y) in enumerate(files):
            mu = L.fitted(data.where(F.col("site") == k), fit.beta).select(F.col("subject_idx").alias("id"), F.col("mu").alias("PHENOTYPE"))
            mu.write.csv(str(tmp_path / f"mu{k}"), sep="\t", header=True)
            run(spark, "-client_calculate_save_pvalue_stats", str(k), str(SITES), "2", g, x, y, str(tmp_path / f"mu{k}"), shared)
        for k, (g, x, y) in enumerate(files):
            run(spark, "-client_update_pvalue_scale_stats", str(k), str(SITES), str(epochs), "2", g, x, y, str(tmp_path / f"mu{k}"), shared)
        got = run(spark, "-client_pool_pvalue_stats", "0", str(SITES), "2", shared)
    else:
        for option in TESTS[scheme]:
            for k, (g, x, y) in enumerate(files):
                got = run(spark, f"-{option}", str(k), str(SITES), str(epochs), "2", g, x, y, str(tmp_path / f"private{k}"), shared)
        assert spark.read.csv(str(tmp_path / "private1/p_values"), sep="\t").count() == 4
    got = {r["var_idx"]: (r["chisq"], r["p"]) for r in got.collect()}
    assert set(got) == set(want) and all(got[v] == pytest.approx(want[v], rel=1e-5) for v in want)


def test_centred_genotypes_give_the_same_test(spark, study, tmp_path):
    """The model has an intercept: a constant taken off the genotypes changes nothing."""
    files, data, geno = study
    shared = str(tmp_path / "shared")
    _, want = expected(spark, data, geno, 1)
    for option in NULL["diagonal"]:
        for k, (_, x, y) in enumerate(files):
            run(spark, option, "0", str(k), str(SITES), x, y, "1", "NATIVE", "1e-9", "private", shared)
    (tmp_path / "af.bed").write_text("".join(f"1\t{j}\t{j + 1}\tv{j}_A_C\t0.4\n" for j in range(4)))
    # mu is that of the weights after one step, at which scores of the intercept are not yet zero: only the scale is compared
    for k, (g, x, y) in enumerate(files):
        run(spark, "cryptable_client_calculate_save_pvalue_stats_mean_centered_genotypes", str(k), str(SITES), "1", "2", g, x, y, str(tmp_path / "af.bed"), "2", "private", shared)
    own = steps.Steps(spark, shared, SITES)._all("stats").groupBy("var_idx").agg(F.sum("gwg").alias("gwg")).collect()
    fit = L.irls(data, 1, 0.0)
    mu = L.fitted(data, fit.beta).select("subject_idx", "mu")
    direct = geno.join(mu, "subject_idx").groupBy("var_idx").agg(F.sum(F.expr("mu * (1 - mu) * 4 * (g - 0.8) * (g - 0.8)")).alias("gwg")).collect()
    assert {r["var_idx"]: r["gwg"] for r in own} == pytest.approx({r["var_idx"]: r["gwg"] for r in direct})


def test_meta_by_options(spark, study, tmp_path):
    shared = str(tmp_path / "shared")
    for k in range(SITES):
        (tmp_path / f"sum{k}.txt").write_text("SNP\tN\tM\tA\tB\tSCORE\tVAR\n" + "".join(f"v{j}\t1\t0\tA\tC\t{j + k}.5\t{2 + j}\n" for j in range(3)))
    for option in ("meta_encrypt_save_ST_stats", "meta_pool_per_site_ST_stats_add_noise", "meta_pool_noisy_ST_stats", "meta_collaborative_decrypt_pooled_noisy_ST_stats"):
        for k in range(SITES):
            run(spark, f"-{option}", str(k), str(SITES), *([str(tmp_path / f"sum{k}.txt")] if option.startswith("meta_encrypt") else []), shared)
    got = {r["var_idx"]: r["chisq"] for r in run(spark, "-meta_pool_partially_decrypted_pooled_noisy_ST_stats", "0", str(SITES), shared).collect()}
    assert got == pytest.approx({f"v{j}": (2 * j + 2.0) ** 2 / (2 * (2 + j)) for j in range(3)})


def test_checks_and_exchange(spark, study, tmp_path):
    files, *_ = study
    t = lambda n: str(tmp_path / n)
    run(spark, "-validate_input_data", *files[0], "4")
    with pytest.raises(ValueError):
        run(spark, "-validate_input_data", *files[0], "5")
    with pytest.raises(ValueError):
        run(spark, "-validate_run", files[0][0], files[0][1], files[1][2])
    run(spark, "-set_params", t("p"), "16384", "60 40 40 60", "40", "3")
    run(spark, "-validate_param_directory", t("p"))
    with pytest.raises(ValueError):
        run(spark, "-set_params", t("q"), "1024", "60 40 40 60", "40", "30")
    run(spark, "-generate_per_site_noisy_keys", "3", t("p/params.txt"), t("keys"))
    secret = spark.read.parquet(t("keys")).groupBy("row", "col").agg(F.round(F.sum("share"), 6).alias("v"))
    assert secret.count() == 16384 and {r["v"] for r in secret.select("v").distinct().collect()} == {-1.0, 0.0, 1.0}
    spark.range(5).write.parquet(t("tab"))
    (tmp_path / "list").write_text(t("tab") + "\n")
    (tmp_path / "names").write_text("tab\nother\n")
    run(spark, "-upload_files_to_shared", t("list"), t("shared"))
    assert run(spark, "-probe_files_in_shared", t("names"), t("shared")) == ["other"]
    with pytest.raises(TimeoutError):
        run(spark, "-wait_for_files_in_shared", t("names"), t("shared"), "0")
    (tmp_path / "names2").write_text("tab\n")
    run(spark, "-download_files_from_shared", t("names2"), t("shared"), t("down"))
    assert spark.read.parquet(t("down/tab")).count() == 5 and run(spark, "-get_resource_size", t("tab")) > 0
    assert run(spark, "-test_file_IO", t("shared")) and len(run(spark, "-get_date_time_str")) == 19 and run(spark, "-get_last_win_start_i", "50", "8") == 40
    spark.createDataFrame([(1, 2.5)], "k int, share double").write.parquet(t("plain"))
    run(spark, "-symmetric_encrypt_partdec_data", t("plain"), "share", "0123456789abcdef", t("sealed"))
    run(spark, "-symmetric_decrypt_partdec_data", t("sealed"), "share", "0123456789abcdef", t("open"))
    assert spark.read.parquet(t("open")).first()["share"] == 2.5
    run(spark, "-generate_DSK_encryption_key", t("key"))
    run(spark, "-symmetric_encrypt_partdec_data", t("plain"), "share", spark.read.text(t("key")).first()["value"], t("dsk"))
    run(spark, "-download_DSK_archive", t("dsk"), t("dsk2"))
    run(spark, "-decrypt_site_DSK", t("dsk2"), "share", t("key"), t("dsk3"))
    assert spark.read.parquet(t("dsk3")).first()["share"] == 2.5 and len(run(spark, "-generate_openssl_hash", "16")) == 32
    run(spark, "-clean_shared_directory", t("shared"))
    assert not X.exists(spark, t("shared"))


def test_kmeans_by_options(spark, tmp_path):
    from siteweave.operators import matrix as M

    t = lambda n: str(tmp_path / n)
    rng = np.random.default_rng(5)
    parts, centres = [rng.standard_normal((12, 2)), rng.standard_normal((9, 2)) + 2], [[0.0, 0.0], [2.0, 2.0]]
    matrix = lambda x: M.Matrix(spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "row int, col int, v double"), len(x), len(x[0]))
    save(matrix(centres), t("c"))
    for k, x in enumerate(parts):
        save(matrix(x), t(f"x{k}"))
        run(spark, "-get_X_2_centroids_dist", t(f"x{k}"), t("c"), t(f"d{k}"))
        run(spark, "-collab_exponentiate_cluster_sq_dists", t(f"d{k}"), "2", t(f"w{k}"))
        run(spark, "-calculate_centroid_updates", t(f"x{k}"), t(f"w{k}"), t(f"u{k}"))
    (tmp_path / "list").write_text(f"{t('u0')}\n{t('u1')}\n")
    run(spark, "-pool_normalize_centroid_updates", t("list"), t("new"))
    got = {(r["row"], r["col"]): r["v"] for r in load(spark, t("new")).df.collect()}
    x = np.concatenate(parts)
    w = np.exp(-0.2 * ((x[:, None] - np.array(centres)[None]) ** 2).sum(-1))
    want = (w.T @ x) / w.sum(0)[:, None]
    assert got == pytest.approx({(i, j): want[i, j] for i in range(2) for j in range(2)})
    run(spark, "-plot_results", t("x1"), t("c"), t("plot"))
    near = {r["row"]: r["centroid"] for r in spark.read.parquet(t("plot")).collect()}
    assert near == {k: int(((p - np.array(centres)) ** 2).sum(1).argmin()) for k, p in enumerate(parts[1])}


def test_run_whole_study(spark, study, tmp_path):
    """Split by site, fitted and tested: the result does not depend on the split."""
    files, data, geno = study
    _, want = expected(spark, data.where("site = 1"), geno.where("subject_idx LIKE 's1%'"), 1)
    got = run(spark, "-run_FedGWAS", *files[1], "2", "1", str(tmp_path / "shared"), str(tmp_path / "private"))
    assert {r["var_idx"]: r["chisq"] for r in got.collect()} == pytest.approx({v: c for v, (c, _) in want.items()}, rel=1e-4)
    assert len(COMMANDS) > 170
