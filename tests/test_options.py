"""Options called by name that no other test calls: files in, files out."""

import numpy as np
import pytest

from siteweave.operators import models
from siteweave.plans import commands
from siteweave.sources import text

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty\tz
1\t100\trs1\tA\tG\t.\tPASS\t.\tGT\t0/0\t0/1\t1/1
1\t250\trs2\tC\tT\t.\tPASS\t.\tGT:DP\t0/1:3\t./.:0\t1/1:9
1\t9000\trs3\tG\tA\t.\tPASS\t.\tGT\t1/1\t1/1\t0/0
2\t100\trs4\tA\tC\t.\tPASS\t.\tGT\t0/1\t0/0\t0/0
"""


def put(path, body):
    path.write_text(body)
    return str(path)


def lines(spark, path):
    return sorted(r["value"] for r in spark.read.text(path).collect())


def run(spark, option, *args):
    return commands.run(spark, option, *map(str, args))


@pytest.mark.parametrize("take", ["convert_VCF_2_matbed", "import_VCF"])
def test_variants_from_vcf_to_genotype_tables(spark, tmp_path, take):
    t = lambda n: str(tmp_path / n)
    vcf, samples = put(tmp_path / "a.vcf", VCF), put(tmp_path / "s.txt", "x\ny\nz\n")
    chroms = put(tmp_path / "c.txt", "1\n2\n")
    for split in ("separate_VCF_2_chroms", "separate_VCF_per_chrom"):
        run(spark, split, vcf, chroms, t("split"))
        assert [len(lines(spark, t(f"split/lines/chrom={c}"))) for c in "12"] == [3, 1]
    targets = put(tmp_path / "t.bed", "1\t99\t100\trs1_A_G\n1\t249\t250\trs2_C_T\n1\t8999\t9000\trs3_G_A\n1\t499\t500\tnone_A_C\n")
    run(spark, take, vcf, samples, targets, "1", t("store"))
    got = {r["name"]: list(r["g"]) for r in spark.read.parquet(t("store")).collect()}
    assert got == {"rs1_A_G": [0, 1, 2], "rs2_C_T": [1, -1, 2], "rs3_G_A": [2, 2, 0], "none_A_C": [-1, -1, -1]}
    region = put(tmp_path / "r.bed", "1\t0\t300\n1\t8000\t8999\n")
    for cut in ("extract_variant_regions", "extract_subset_variants"):
        run(spark, cut, t("store"), samples, region, t("cut"))
        assert {r["name"] for r in spark.read.parquet(t("cut")).collect()} == {"rs1_A_G", "rs2_C_T"}
    listed = put(tmp_path / "l.txt", t("cut") + "\n")
    for write in ("write_GMMAT_formatted_geno", "save_GMMAT_genotypes"):
        run(spark, write, listed, samples, t("g"))
        assert lines(spark, t("g")) == ["rs1_A_G\tA\tG\t0\t1\t2", "rs2_C_T\tC\tT\t1\t-1\t2"]


def test_matrices_at_random_and_from_text(spark, tmp_path):
    t = lambda n: str(tmp_path / n)
    for option, args in (("generate_mult_full_noise_matrix", (4, 5)), ("generate_random_plaintext_matrix", (4, 5)), ("generate_mult_diagonal_noise_matrix", (6,))):
        run(spark, option, *args, t("m"))
        m = commands.load(spark, t("m"))
        cells = {(r["row"], r["col"]): r["v"] for r in m.df.collect()}
        assert len(set(cells.values())) == len(cells) == (20 if len(args) == 2 else 6) and (len(args) == 2 or all(i == j for i, j in cells))
    for option, low, high in (("get_uniform_rand", 0, 1), ("get_normal_rand", -8, 8)):
        run(spark, option, 2000, 7, t("v"))
        v = np.array([float(x) for x in lines(spark, t("v"))])
        assert len(v) == 2000 and low <= v.min() and v.max() <= high and abs(v.mean() - (low + high) / 2) < 0.1
    run(spark, "convert_plaintext_matrix_text_2_bin", put(tmp_path / "a.txt", "1\t2\n3\t4\n"), 0, 0, t("b"))
    assert sorted(r["v"] for r in commands.load(spark, t("b")).df.collect()) == [1, 2, 3, 4]


def test_training_options(spark, tmp_path):
    t = lambda n: str(tmp_path / n)
    rng = np.random.default_rng(1)
    x = rng.standard_normal(60)
    y = (rng.random(60) < 1 / (1 + np.exp(-x))).astype(int)
    features = put(tmp_path / "f.txt", "id\tINTERCEPT\tCOVAR_0\n" + "".join(f"s{k}\t1\t{v}\n" for k, v in enumerate(x)))
    phenotypes = put(tmp_path / "p.txt", "id\tPHENOTYPE\n" + "".join(f"s{k}\t{v}\n" for k, v in enumerate(y)))
    data = text.features(spark, features).join(text.phenotypes(spark, phenotypes), "subject_id")

    def model(out):
        return [w for _, _, w in text.read_model("\n".join(r["value"] for r in spark.read.text(out).collect()))]

    run(spark, "test_LR_modified_IRLS_training_plaintext", features, phenotypes, 4, "NATIVE", 1e-9, t("a"))
    assert model(t("a")) == pytest.approx(models.irls(data, 4, 1e-9, "NATIVE", site=None).beta, abs=1e-4)
    run(spark, "test_LR_modified_training_plaintext", features, phenotypes, 3, 0.1, 0.0, t("b"))
    assert model(t("b")) == pytest.approx(models.gradient(data, 3, 0.1, 0.0), abs=1e-4)
    run(spark, "test_LR_baseline_training_plaintext", features, phenotypes, 2, 0.1, 0.0, t("c"))
    assert model(t("c")) == pytest.approx(list(models.sequential_gradient(data, 2, 0.1, 0.0).first()["beta"]), abs=1e-4)


def test_paths_are_asked_for(spark, tmp_path):
    file, folder = put(tmp_path / "a", "x"), str(tmp_path)
    run(spark, "validate_directory_exists", folder)
    run(spark, "validate_file_exists", file)
    for option, path in (("validate_directory_exists", file), ("validate_file_exists", folder), ("validate_file_exists", folder + "/none")):
        with pytest.raises(Exception):  # noqa: B017
            run(spark, option, path)
