"""File-level commands by their option names: files in, files out, for users of command lines.

Matrices are kept in a folder: cells as Parquet and their shape; text formats are those of sources.text. Arguments are
paths and values as strings. Options of encrypted matrices run the same numbers with levels checked (operators.shares);
key files named among their arguments are accepted and not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siteweave.operators import genotypes as G
from siteweave.operators import matrix as M
from siteweave.operators import models as L
from siteweave.operators import shares as E
from siteweave.operators import tables as T
from siteweave.sources import store
from siteweave.sources import text as S

COMMANDS: dict[str, Callable] = {}


def command(*names: str):
    def add(f):
        for n in names:
            COMMANDS[n] = f
        return f

    return add


def save(m: M.Matrix, path: str, level: int | None = None) -> None:
    m.df.write.mode("overwrite").parquet(f"{path}/cells")
    m.df.sparkSession.createDataFrame([(m.nrow, m.ncol, level)], "nrow int, ncol int, level int").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def load(spark: SparkSession, path: str) -> M.Matrix:
    shape = spark.read.parquet(f"{path}/shape").first()
    return M.Matrix(spark.read.parquet(f"{path}/cells"), shape["nrow"], shape["ncol"])


def load_enc(spark: SparkSession, path: str, params: str | None = None) -> E.Cipher:
    shape = spark.read.parquet(f"{path}/shape").first()
    own = E.Params.read("\n".join(r["value"] for r in spark.read.text(params).collect())) if params else E.Params()
    return E.Cipher(load(spark, path), own, own.levels if shape["level"] is None else shape["level"])


def save_enc(c: E.Cipher, path: str) -> None:
    save(c.m, path, c.level)


def run(spark: SparkSession, option: str, *args: str):
    """Run an option; unknown ones raise KeyError."""
    from siteweave.plans import steps  # noqa: F401  (the protocols' options)

    return COMMANDS[option.lstrip("-")](spark, *args)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Lines of a short list file."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]


def _unary(f):
    return lambda s, a, *rest: save(f(load(s, a), *rest[:-1]), rest[-1])


def _binary(f):
    return lambda s, a, b, out: save(f(load(s, a), load(s, b)), out)


def _enc_binary(f):
    return lambda s, a, b, params, *rest: save_enc(f(load_enc(s, a, params), load_enc(s, b, params)), rest[-1])


# ---- plain matrices ----
command("transform_elementwise_per_callback_pt", "transform_plaintext_elementwise_per_callback")(_unary(lambda m, f: m.apply(f)))
command("scalar_multiply_matrix_plain", "scalar_multiply_plaintext_matrix")(_unary(lambda m, c: m.scale(float(c))))
command("plain_pad_matrix_to_next_power_of_2", "pad_plaintext_matrix_2_to_n")(_unary(lambda m: m.pad_pow2()))
command("plain_pad_matrix_rows_to_next_power_of_2", "pad_plaintext_matrix_row_2_to_n")(_unary(lambda m: m.pad_pow2(cols=False)))
command("plain_pad_matrix_cols_to_next_power_of_2", "pad_plaintext_matrix_col_2_to_n")(_unary(lambda m: m.pad_pow2(rows=False)))
command("plain_unpad_matrix_to_size", "pad_plaintext_matrix_custom")(_unary(lambda m, r, c: m.resize(int(r), int(c))))
command("plain_invert_matrix", "invert_plaintext_matrix")(_unary(lambda m: m.inverse()))
command("transpose_pt_matrix", "transpose_plaintext_matrix")(_unary(lambda m: m.transpose()))
command("plain_add_matrices", "add_plaintext_matrix")(_binary(lambda a, b: a.add(b)))
command("plain_sub_matrices", "sub_plaintext_matrix")(_binary(lambda a, b: a.sub(b)))
command("multiply_matrices_pt", "multiply_plaintext_matrix")(_binary(lambda a, b: a.matmul(b)))
command("multiply_matrices_elementwise_pt", "multiply_elementwise_plaintext_matrices")(_binary(lambda a, b: a.mul(b)))
command("row2row_multiply_pt", "row2row_multiply_plaintext_matrices")(_binary(lambda a, b: a.row_dot(b)))
command("plain_add_matrices_per_list", "add_plaintext_matrix_list")(lambda s, listed, out: save(M.add_all([load(s, p) for p in names_in(s, listed)]), out))
command("write_plain_matrix_dimensions", "write_plaintext_matrix_dimensions", "write_enc_matrix_dimensions", "write_encrypted_matrix_dimensions")(lambda s, a, *rest: load(s, a).shape().write.mode("overwrite").csv(rest[-1], sep="\t"))
command("get_uniform_rand")(lambda s, n, seed, out: M.draws(s, "Uniform", int(n), int(seed)).select("v").write.mode("overwrite").csv(out))
command("get_normal_rand")(lambda s, n, seed, out: M.draws(s, "Gaussian", int(n), int(seed)).select("v").write.mode("overwrite").csv(out))
command("generate_random_pt_matrix")(lambda s, r, c, out: save(M.random_uniform(s, int(r), int(c)), out))
command("generate_mult_full_noise_matrix", "generate_random_plaintext_matrix")(lambda s, r, c, out: save(M.random_normal(s, int(r), int(c)), out))
command("generate_mult_diagonal_noise_matrix")(lambda s, n, out: save(M.random_normal_diagonal(s, int(n)), out))
command("generate_constant_diagonal_matrix", "generate_diagonal_plaintext_matrix")(lambda s, r, c, v, out: save(M.constant_diagonal(s, int(r), int(c), float(v)), out))
command("generate_constant_full_matrix", "generate_constant_plaintext_matrix")(lambda s, r, c, v, out: save(M.constant(s, int(r), int(c), float(v)), out))
command("test_linux_srandom_seeded")(lambda s, kind, out: M.draws(s, "Uniform" if kind == "Uniform" else "Gaussian").write.mode("overwrite").csv(out))
command("dump_matrix_plain", "save_matrix_text")(lambda s, a, out: S.dumped(load(s, a).rows()).orderBy("row").select("line").write.mode("overwrite").text(out))


@command("save_matrix_plain_2_bin", "convert_plaintext_matrix_text_2_bin")
def _(s, path, row_ids, col_ids, out):
    cells = S.text_matrix(s, path, row_ids == "1", col_ids == "1").cache()
    n = cells.agg(F.max("row"), F.max("col")).first()
    save(M.Matrix(cells, (n[0] or 0) + 1, (n[1] or 0) + 1), out)


@command("diag_matrix_multiply_checks")
def _(s):
    """Both diagonal products against the general product."""
    a = M.Matrix(M.constant(s, 5, 5, 0.0).df.withColumn("v", F.col("row") + 1.0), 5, 5)
    d = M.Matrix(M.constant_diagonal(s, 5, 5, 0.0).df.withColumn("v", F.col("row") + 1.0), 5, 5)
    for x, y in ((a.scale_rows(d), d.matmul(a)), (a.scale_cols(d), a.matmul(d))):
        if x.sub(y).df.where("abs(v) > 1e-12").count():
            raise AssertionError("diagonal products differ")


# ---- matrices with levels ----
command("continuous_encrypt_data_matrix", "encrypt_plaintext_matrix", "encrypt_encoded_pt_matrix")(lambda s, a, *rest: save_enc(E.encrypted(load(s, a)), rest[-1]))
command("fully_decrypt_continuous_encrypted_matrix", "full_decrypt_encrypted_matrix")(lambda s, a, *rest: save(load_enc(s, a).decrypt(), rest[-1]))
command("transpose_continuous_encrypted_vector", "transpose_encrypted_vector")(lambda s, a, *rest: save_enc(load_enc(s, a).transpose_vector(), rest[-1]))
command("secure_add_cont_ct_matrices", "secure_add_matrices")(_enc_binary(lambda a, b: a.add(b)))
command("secure_sub_cont_ct_matrices", "secure_sub_matrices")(_enc_binary(lambda a, b: a.sub(b)))
command("secure_elementwise_mul_cont_ct_matrices", "secure_elementwise_multiply_matrices")(_enc_binary(lambda a, b: a.mul(b)))
command("secure_row2row_inner_prod_continuous_encrypted_matrices", "secure_row2row_multiply_matrices")(_enc_binary(lambda a, b: a.row_dot(b)))
command("secure_multiply_matrices")(_enc_binary(lambda a, b: a.matmul(b)))
command("secure_add_cont_ct_matrices_per_list", "secure_add_matrix_list")(lambda s, listed, *rest: save_enc(E.add_list([load_enc(s, p) for p in names_in(s, listed)]), rest[-1]))
command("generate_plaintext_mask_per_continuous_encrypted_data", "generate_plaintext_mask_matrix")(lambda s, a, high, out: save(E.mask_of(load(s, a), float(high)), out))
command("additive_mask_continuous_encrypted_data", "mask_encrypted_matrix")(lambda s, a, mask, *rest: save_enc(load_enc(s, a).add(E.encrypted(load(s, mask))), rest[-1]))
command("additive_unmask_continuous_encrypted_data", "unmask_encrypted_matrix")(lambda s, a, mask, *rest: save_enc(load_enc(s, a).sub(E.encrypted(load(s, mask))), rest[-1]))
command("write_continuous_encrypted_ciphertext_vital_stats", "write_encrypted_matrix_vital_stats")(lambda s, a, *rest: load_enc(s, a).vital_stats().write.mode("overwrite").csv(rest[-1], sep="\t"))
command("col_expand_dense_encrypt_matrix", "col_expand_plaintext_matrix")(lambda s, a, n, *rest: load(s, a).expand_cols(int(n)).write.mode("overwrite").partitionBy("k").parquet(rest[-1]))
command("row_expand_dense_encrypt_matrix", "row_expand_plaintext_matrix")(lambda s, a, n, *rest: load(s, a).expand_rows(int(n)).write.mode("overwrite").partitionBy("k").parquet(rest[-1]))
command("row_expand_continuous_encrypted_matrix", "secure_row_expand_encrypted_matrix")(lambda s, a, n, *rest: load_enc(s, a).expand_rows(int(n)).write.mode("overwrite").partitionBy("k").parquet(rest[-1]))
command("pool_col_expanded_matrices", "pool_row_expanded_matrices")(lambda s, listed, *rest: M.pool_expansions([s.read.parquet(p) for p in names_in(s, listed)]).write.mode("overwrite").partitionBy("k").parquet(rest[-1]))


@command("secure_multiply_matrices_Acol_Brow_expansions", "secure_multiply_rowcol_expansion")
def _(s, a, b, *rest):
    x, y = s.read.parquet(a), s.read.parquet(b)
    n = x.agg(F.max("row"), F.max("col")).first()
    save_enc(E.by_expansions(x, y, n[0] + 1, n[1] + 1, E.Params(), E.Params().levels), rest[-1])


@command("partial_decrypt_continuous_enc_per_noisy_secretkey", "partial_decrypt_matrix")
def _(s, a, site, sites, *rest):
    E.shares(load(s, a), int(sites)).where(F.col("site") == int(site)).write.mode("overwrite").parquet(rest[-1])


@command("pool_partial_decrypted_continuous_enc_data", "pool_partially_decrypted_matrices")
def _(s, listed, nrow, ncol, out):
    paths = names_in(s, listed)
    save(E.pool_shares(s.read.parquet(*paths), int(nrow), int(ncol), len(paths)), out)


@command("validate_ckks_text_params")
def _(s, params, out):
    own = E.Params.read("\n".join(r["value"] for r in s.read.text(params).collect()))
    s.createDataFrame([(own.valid(),)], "value string").coalesce(1).write.mode("overwrite").text(out)


# ---- variants ----
command("separate_VCF_2_chroms", "separate_VCF_per_chrom")(lambda s, vcf, chroms, out: S.split_vcf(s, vcf, names_in(s, chroms), out))


@command("convert_VCF_2_matbed", "import_VCF")
def _(s, vcf, samples, bed, chrom, out, match_names="0"):
    found = G.at_targets(S.vcf(s, vcf).where(F.col("chrom") == chrom), S.bed(s, bed).where(F.col("chrom") == chrom), match_names == "1")
    n = len(names_in(s, samples))
    g = F.coalesce(F.col("v.g"), F.array_repeat(F.lit(-1), n))
    store.write(found.select("t.chrom", "t.start", "t.end", "t.name", g.alias("g")), out)


@command("extract_variant_regions", "extract_subset_variants")
def _(s, matbed, samples, bed, out):
    wanted = S.bed(s, bed).select("chrom", "start", "end")
    own = store.within(s, matbed, wanted) if "place" in s.read.parquet(matbed).columns else s.read.parquet(matbed)
    G.variants_in_regions(own.select("chrom", "start", "end", "name", "g"), wanted, "name").select("a.*").write.mode("overwrite").parquet(out)


@command("extract_subset_subjects")
def _(s, matbed, all_samples, wanted, out):
    place = {n: k for k, n in enumerate(names_in(s, all_samples))}
    g = F.array(*[F.col("g")[place[n]] if n in place else F.lit(-1) for n in names_in(s, wanted)])
    s.read.parquet(matbed).withColumn("g", g).write.mode("overwrite").parquet(out)


@command("extract_subsample_GMMAT_genotypes_from_GMMAT_genotype_matrix")
def _(s, gmmat, all_samples, wanted, out):
    place = {n: k for k, n in enumerate(names_in(s, all_samples))}
    S.write_gmmat(S.gmmat(s, gmmat).withColumn("g", F.array(*[F.col("g")[place[n]] for n in names_in(s, wanted) if n in place])), out)


@command("write_GMMAT_formatted_geno", "save_GMMAT_genotypes")
def _(s, listed, samples, out):
    own = s.read.parquet(*names_in(s, listed)).withColumn("p", G.parsed_name(F.col("name")))
    S.write_gmmat(own.select(F.col("name").alias("var_id"), "p.ref", "p.alt", "g"), out)


@command("impute_missing_GMMAT_formatted_geno")
def _(s, gmmat, out):
    own = G.impute_wide(S.gmmat(s, gmmat))
    S.write_gmmat(own, out)
    own.select("var_id", "n_missing", F.size("g").alias("n")).write.mode("overwrite").csv(f"{out}.missingness", sep="\t")


@command("extract_rows_per_query_column_preserve_query_order")
def _(s, queries, table, column, every, out):
    k = int(column)
    numbered = lambda p: s.read.text(p).select(F.monotonically_increasing_id().alias("pos"), "value")
    q = numbered(queries).select(F.col("pos").alias("q_pos"), F.trim("value").alias("key"))
    t = numbered(table).select(F.col("pos").alias("row_pos"), F.split("value", "\t")[k - 1].alias("key"), "value")
    T.lookup(q, t, "key", every == "1").orderBy("q_pos", "row_pos").select("value").write.mode("overwrite").text(out)


# ---- models ----
def _data(s, features, phenotypes):
    return S.features(s, features).join(S.phenotypes(s, phenotypes), "subject_id")


@command("test_LR_modified_IRLS_training_plaintext")
def _(s, features, phenotypes, epochs, kind, epsilon, out):
    fit = L.irls(_data(s, features, phenotypes), int(epochs), float(epsilon), kind, site=None)
    s.createDataFrame([(r,) for r in S.write_model(fit.beta).splitlines()], "value string").coalesce(1).write.mode("overwrite").text(out)


@command("test_LR_modified_training_plaintext")
def _(s, features, phenotypes, epochs, step, penalty, out):
    beta = L.gradient(_data(s, features, phenotypes), int(epochs), float(step), float(penalty))
    s.createDataFrame([(r,) for r in S.write_model(beta).splitlines()], "value string").coalesce(1).write.mode("overwrite").text(out)


@command("test_LR_baseline_training_plaintext")
def _(s, features, phenotypes, epochs, step, penalty, out):
    beta = L.sequential_gradient(_data(s, features, phenotypes), int(epochs), float(step), float(penalty)).first()["beta"]
    s.createDataFrame([(r,) for r in S.write_model(list(beta)).splitlines()], "value string").coalesce(1).write.mode("overwrite").text(out)


@command("assign_ChiSqr_pvalues_per_GMMAT_text_geno")
def _(s, gmmat, samples, features, phenotypes, out, epochs="10"):
    """Fits the null model, then tests each variant; samples lists the genotype columns' subjects."""
    data = _data(s, features, phenotypes)
    fit = L.irls(data, int(epochs), site=None)
    ids = s.createDataFrame(list(enumerate(names_in(s, samples))), "subject_idx int, subject_id string")
    geno = G.long_form(S.gmmat(s, gmmat).withColumnRenamed("var_id", "var_idx"), ["var_idx"])
    subjects = L.fitted(data, fit.beta).join(ids, "subject_id")
    L.score_test(geno, subjects, fit.z).select("var_idx", "p", "chisq", "s", "t").write.mode("overwrite").csv(out, sep="\t")


@command("assign_chisqr_pvals_per_ST_stats")
def _(s, path, out):
    from siteweave.functions.scalar import chi2_p1

    own = s.read.csv(path, sep="\t", schema="s double, t double")
    own.withColumn("p", F.format_string("%.4f", chi2_p1(F.try_divide("s", "t")))).write.mode("overwrite").csv(out, sep="\t")


command("test_log_sigmoid_approximations")(lambda s, high: L.sigmoid_table(s, float(high)))
