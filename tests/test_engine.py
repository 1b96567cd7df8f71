"""Operators on small fixtures worked out by hand, twins that must agree, and sources that must come back."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.functions import scalar as S
from siteweave.operators import features, genotypes, intervals, matrix, models, reads, sequences, shares, stats, tables
from siteweave.plans import commands
from siteweave.plans.federation import Federation
from siteweave.sources import exchange, text
from siteweave.streaming import gate


def mat(spark, rows):
    cells = [(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)]
    return matrix.Matrix(spark.createDataFrame(cells, "row int, col int, v double"), len(rows), len(rows[0]))


def arr(m):
    out = np.zeros((m.nrow, m.ncol))
    for r in m.df.collect():
        out[r["row"], r["col"]] = r["v"]
    return out


def val(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def test_scalars(spark):
    l = lambda x: F.lit(float(x))  # noqa: E731, E741
    got = val(spark, S.tenseal_sigmoid(l(0)), S.tenseal_sigmoid(l(1)), S.tenseal_sigmoid(l(6)), S.kim_sigmoid(l(8)), S.protected_log(l(-1)), S.protected_inverse(l(0)), S.protected_inverse(l(4)))
    assert got == pytest.approx((0.5, 0.693, 1, 0.96752, 0, 0, 0.25))
    for x in (0.0, 0.01, 1.0, 3.84, 4.49, 4.51, 30.0, 300.0):
        assert val(spark, S.chi2_p1(l(x)))[0] == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
    assert val(spark, S.chi2_sf(l(5), 2), S.chi2_sf(l(5), 4), S.chi2_sf(l(3.84), 1, True), S.chi2_sf(l(0), 1, True)) == pytest.approx((math.exp(-2.5), math.exp(-2.5) * 3.5, 0.0500435, 1e-14), rel=1e-3)
    assert val(spark, S.reverse_complement(F.lit("ACGTN")), S.translate_protein(F.lit("ATGTGGTAA")), S.normalise_chrom(F.lit("chr1 x")), S.number_nuc(F.lit(2))) == ("NACGT", "MW*", "1_x", "G")
    assert val(spark, S.balanced(F.lit("(()())")), S.balanced(F.lit("())(")), S.is_number(F.lit("-1.5e3")), S.is_number(F.lit("x1"))) == (True, False, True, False)
    assert val(spark, S.xlog_sum(F.lit(0.0), F.lit(S.LOG_OF_ZERO)), S.xlog_sub(F.lit(math.log(3)), F.lit(math.log(2)))) == pytest.approx((0, 0))
    assert [tuple(b) for b in val(spark, S.cigar_blocks(F.lit(10), F.lit("2S3M2D4M5N1M")))[0]] == [(10, 12), (15, 18), (24, 24)]


def test_matrices(spark):
    a, d = mat(spark, [[i + 1] * 5 for i in range(5)]), mat(spark, np.diag([1, 2, 3, 4, 5]).tolist())
    assert (arr(a.scale_cols(d))[1] == [2, 4, 6, 8, 10]).all() and (arr(a.scale_rows(d))[:, 0] == [1, 4, 9, 16, 25]).all()
    m = mat(spark, [[4, 7], [2, 6]])
    assert arr(m.inverse()) == pytest.approx(np.array([[0.6, -0.7], [-0.2, 0.4]]))
    assert arr(m.matmul(m.inverse())) == pytest.approx(np.eye(2))
    assert arr(mat(spark, [[0, 1], [1, 0]]).inverse()) == pytest.approx(np.array([[0, 1], [1, 0]]))
    with pytest.raises(Exception, match="zero pivot"):
        mat(spark, [[0, 1], [1, 0]]).inverse(pivot=False).df.collect()
    p = mat(spark, [[1] * 5] * 3).pad_pow2()
    assert (p.nrow, p.ncol) == (4, 8) and arr(p.dense()).sum() == 15
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((10, 30)), rng.standard_normal((30, 20))
    for product in (mat(spark, x).matmul(mat(spark, y)), mat(spark, x).matmul_blocked(mat(spark, y), 8)):
        assert arr(product) == pytest.approx(x @ y)
    assert (arr(mat(spark, x).transpose().transpose()) == x).all()
    with pytest.raises(ValueError):
        mat(spark, x).add(mat(spark, y))


def test_shares(spark):
    x = np.random.default_rng(2).standard_normal((4, 4))
    m = mat(spark, x)
    assert [r["share"] for r in shares.shares(mat(spark, [[6]]), 3).orderBy("site").collect()] == [1, 2, 3]
    assert arr(shares.pool_shares(shares.random_shares(m, 3, 10), 4, 4, 3)) == pytest.approx(x)
    with pytest.raises(Exception, match="missing"):
        shares.pool_shares(shares.random_shares(m, 3, 10).where("site > 0"), 4, 4, 3).df.collect()
    assert arr(shares.collaborative_inverse(m)) == pytest.approx(np.linalg.inv(x))
    c = shares.encrypted(m)
    assert (c.mul(c).level, c.row_dot(c).level, c.refresh().level) == (5, 4, 6)
    with pytest.raises(ValueError, match="levels"):
        for _ in range(9):
            c = c.mul(c)
    with pytest.raises(ValueError, match="vector"):
        shares.encrypted(m).transpose_vector()


def regions(spark, rows):
    return spark.createDataFrame([(k, "c", s, e) for k, (s, e) in enumerate(rows)], "id int, chrom string, start int, end int")


def test_intervals(spark):
    span = lambda df: sorted((r["start"], r["end"]) for r in df.collect())
    a = regions(spark, [(1, 5), (5, 8), (9, 10)])
    assert span(intervals.merge(a)) == [(1, 8), (9, 10)] and span(intervals.merge(a, 1)) == [(1, 10)]
    assert span(intervals.merge(intervals.merge(a, 1), 1)) == [(1, 10)]
    got = intervals.overlaps(regions(spark, [(1, 10)]), regions(spark, [(10, 12), (11, 20)])).collect()
    assert [(r["ol_start"], r["ol_end"], r["l_overlap"]) for r in got] == [(10, 10, 1)]
    assert span(intervals.subtract(regions(spark, [(1, 10)]), regions(spark, [(3, 4), (8, 12)]), "id")) == [(1, 2), (5, 7)]
    assert {r["id"]: r["distance"] for r in intervals.nearest_distance(regions(spark, [(1, 2), (50, 60)]), regions(spark, [(10, 12), (55, 56)]), "id").collect()} == {0: 8, 1: 0}
    rng = np.random.default_rng(3)
    x, y = ([(int(s), int(s + rng.integers(0, 300))) for s in rng.integers(1, 3000, 80)] for _ in range(2))
    rx, ry = regions(spark, x), regions(spark, y)
    want = sorted((i, j) for i, (s, e) in enumerate(x) for j, (t, f) in enumerate(y) if s <= f and t <= e)
    assert sorted((r["a"]["id"], r["b"]["id"]) for r in intervals.overlaps(rx, ry).collect()) == want
    left, both = intervals.subtract(intervals.merge(rx).withColumn("id", F.col("start")), ry, "id"), intervals.overlaps(intervals.merge(rx), intervals.merge(ry)).agg(F.sum("l_overlap")).first()[0]
    assert intervals.covered(left).first()[0] + both == intervals.covered(rx).first()[0]
    scored = regions(spark, [(1, 10), (5, 14), (30, 40), (100, 110)]).withColumn("score", F.col("id").cast("double"))
    chosen = intervals.greedy_apart(scored, 2, 5).collect()
    assert sorted(r["id"] for r in chosen if r["which"] == "top") == [2, 3] and sorted(r["id"] for r in chosen if r["which"] == "bottom") == [0, 2]
    with pytest.raises(Exception, match="partly outside"):
        intervals.in_super_region(regions(spark, [(1, 10)]), regions(spark, [(5, 20)]), "id").collect()


def test_genotypes(spark):
    wide = spark.createDataFrame([(0, [0, 2, 2, -1, 2]), (1, [-1, -1, 1, 0, 0])], "var_idx int, g array<int>")
    assert [r["g"] for r in genotypes.impute_wide(wide).orderBy("var_idx").collect()] == [[0, 2, 2, 1, 2], [0, 0, 1, 0, 0]]
    long = genotypes.long_form(wide, ["var_idx"])
    assert [r["g"] for r in genotypes.wide_form(genotypes.impute(long), ["var_idx"]).orderBy("var_idx").collect()] == [[0, 2, 2, 1, 2], [0, 0, 1, 0, 0]]
    assert sorted(map(tuple, genotypes.missingness(long).collect())) == [(0, 1, 5), (1, 2, 5)]
    name = spark.createDataFrame([("rs_1_A_T",), ("x",)], "n string").select(genotypes.parsed_name(F.col("n")).alias("p")).collect()
    assert [tuple(r["p"]) for r in name] == [("rs_1", "A", "T"), ("x", ".", ".")]
    gt = spark.createDataFrame([("0/0",), ("0/1",), ("1|1",), ("./1",)], "gt string").select(S.genotype_code(F.col("gt")), S.haplotype_code(F.col("gt"))).collect()
    assert [tuple(r) for r in gt] == [(0, 0), (1, 1), (2, 3), (-1, -1)]
    bad = long.select(S.require_genotype(F.col("g")))
    with pytest.raises(Exception, match="not among"):
        bad.collect()


def test_lookups(spark):
    q = spark.createDataFrame([(0, "b"), (1, "a"), (2, "z")], "q_pos int, k string")
    t = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "row_pos int, k string, v int")
    assert [(r["k"], r["v"]) for r in tables.lookup(q, t, "k").orderBy("q_pos", "row_pos").collect()] == [("b", 2), ("a", 1), ("a", 3)]
    assert [(r["k"], r["v"]) for r in tables.lookup(q, t, "k", False).orderBy("q_pos").collect()] == [("b", 2), ("a", 1)]


def test_statistics(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.04)], "id int, p double")
    assert [r["q"] for r in stats.bh(p).orderBy("id").collect()] == pytest.approx([0.03, 0.03, 0.04])
    s = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 2.0), ("b", 1, 4.0), ("b", 2, 1.0)], "s string, id int, v double")
    assert {(r["s"], r["id"]): r["qn"] for r in stats.quantile_normalised(s, "s").collect()} == {("a", 1): 4.5, ("a", 2): 1.5, ("b", 1): 4.5, ("b", 2): 1.5}
    h = stats.histogram(spark.createDataFrame([(1,), (1,), (2,), (2,)], "x int"), [F.col("x")], ["x"])
    assert stats.entropy(h).first()[0] == pytest.approx(math.log(2))
    track = spark.createDataFrame([("c", k, float(v)) for k, v in enumerate([0, 3, 4, 0, 5])], "chrom string, pos int, v double")
    runs = lambda **k: sorted((r["start"], r["end"]) for r in stats.peaks(track, ["chrom"], "pos", "v", [3], **k).collect())
    assert runs() == [(1, 2), (4, 4)] and runs(emit_open=False) == [(1, 2)]


def test_models(spark):
    subj = spark.createDataFrame([(k, k % 2, [1.0], y, 0.5) for k, y in enumerate((1.0, 0.0, 1.0, 0.0))], "subject_idx int, site int, x array<double>, y double, mu double")
    geno = spark.createDataFrame([(0, k, g) for k, g in enumerate((2, 0, 1, 1))], "var_idx int, subject_idx int, g int")
    r = models.score_test(geno, subj, np.array([[1.0]])).first()
    assert (r["s"], r["t"], r["chisq"]) == pytest.approx((1, 0.5, 2)) and r["p"] == pytest.approx(math.erfc(1))
    m = spark.createDataFrame([(0, 0, 1.0, 1.0), (1, 0, 2.0, 2.0)], "site int, var_idx int, score double, var double")
    assert models.meta(m).first()["chisq"] == 3
    k = models.soft_kmeans(spark.createDataFrame([([0.0],), ([2.0],)], "x array<double>"), [[0.0]], 1)
    assert k[0][0] == pytest.approx(2 * math.exp(-0.8) / (1 + math.exp(-0.8)))
    data, beta = models.simulated(spark, 4000, 3, seed=5)
    data = data.cache()
    fits = [models.irls(data, mask=mask).beta for mask in (None, "full", "diagonal")] + [models.irls(data, site=None).beta]
    for f in fits[1:]:
        assert f == pytest.approx(fits[0], abs=1e-6)
    assert fits[0] == pytest.approx(beta, abs=0.3)


@pytest.mark.parametrize("site", [None, "site"])
def test_centred_score_test(spark, site):
    """Sparse sums against the dense table: zeros stored or left out, missing and null cells, a variant without cells, unequal sites."""
    rng = np.random.default_rng(3)
    n, scale = 60, 1.5
    x, y = np.c_[np.ones(n), rng.normal(size=n)], (rng.random(n) < 0.4).astype(float)
    sites, mu = np.where(np.arange(n) % 5 == 0, 1, 0), 1 / (1 + np.exp(-(0.2 + 0.3 * x[:, 1])))
    g = rng.integers(-1, 3, size=(4, n)).astype(float)
    g[3] = 0
    af = np.array([0.1, 0.35, 0.5, 0.2])
    dense = np.where(g < 0, 0, scale * (g - 2 * af[:, None]))
    subj = spark.createDataFrame([(k, int(sites[k]), [float(v) for v in x[k]], float(y[k]), float(mu[k])) for k in range(n)], "subject_idx int, site int, x array<double>, y double, mu double")
    cells = [(j, k, None if g[j, k] < 0 and k % 2 else int(g[j, k])) for j in range(4) for k in range(n) if g[j, k] != 0 or k % 3 == 0 and j < 3]
    geno = spark.createDataFrame(cells, "var_idx int, subject_idx int, g int")
    freqs = spark.createDataFrame([(j, float(a)) for j, a in enumerate(af)], "var_idx int, af double")
    got = {(r[site] if site else None, r["var_idx"]): [r[c] for c in ("score", "gwg", "gwx_0", "gwx_1")] for r in models.centred_stats(geno, freqs, subj, 2, site, scale).collect()}
    w, want = mu * (1 - mu), {}
    for s in (0, 1) if site else (None,):
        own = np.full(n, True) if s is None else sites == s
        for j in range(4):
            d = dense[j, own]
            want[s, j] = [d @ (y - mu)[own], (w[own] * d) @ d, *((w[own] * d) @ x[own])]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    none = models.centred_stats(geno, freqs, subj.limit(0), 2, None, scale)
    assert {(r["var_idx"], r["score"], r["gwg"]) for r in none.collect()} == {(j, 0.0, 0.0) for j in range(4)}


def test_centring_leaves_the_test_at_the_fit(spark):
    data, _ = models.simulated(spark, 600, 3, seed=7)
    data = data.cache()
    geno = data.select((F.col("subject_idx") % 2).alias("var_idx"), "subject_idx", (F.col("subject_idx") % 3).cast("int").alias("g"))
    fit = models.irls(data, 12, 1e-12)
    own = models.fitted(data, fit.beta)
    freqs = genotypes.allele_frequencies(geno)
    pairs = [{r["var_idx"]: r["chisq"] for r in df.collect()} for df in (models.score_test(geno, own, fit.z), models.score_test_centred(geno, freqs, own, fit.z, 3.0))]
    assert pairs[0] == pytest.approx(pairs[1], rel=1e-6)
    kept = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    models.irls(data.select("site", "x", "y"), 3)
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= kept  # what a fit keeps goes with it


def test_federation_equals_pooled(spark, tmp_path):
    data, _ = models.simulated(spark, 900, 3, seed=7)
    data = data.cache()
    geno = data.select(F.lit(0).alias("var_idx"), "subject_idx", (F.col("subject_idx") % 3).cast("int").alias("g"))
    f = Federation(spark, str(tmp_path / "x"), 3, wait=5)
    parts = [data.where(F.col("site") == k).drop("site") for k in range(3)]
    last = f.fit(parts, 3, 8)
    pooled = models.irls(data, 8)
    assert f.beta(last, 3) == pytest.approx(pooled.beta, abs=1e-6)
    for k, own in enumerate(parts):
        f.share_statistics(k, geno, own, last, 3)
    want = models.score_test(geno, models.fitted(data, pooled.beta), pooled.z).first()
    assert f.p_values(last, 3).first()["chisq"] == pytest.approx(want["chisq"], rel=1e-5)
    with pytest.raises(FileExistsError):
        f.share_statistics(0, geno, parts[0], last, 3)
    with pytest.raises(TimeoutError):
        exchange.wait(spark, str(tmp_path / "x"), ["absent"], 0, 0)


def write(path, content):
    path.write_text(content)
    return str(path)


def test_sources(spark, tmp_path):
    bed = text.bed(spark, write(tmp_path / "a.bed", "track x\n#c\nchr1\t0\t10\tn\t5\t-\n1\t4\t6\n")).collect()
    assert [(r["chrom"], r["start"], r["end"], r["name"], r["strand"]) for r in bed] == [("1", 1, 10, "n", "-"), ("1", 5, 6, ".", "+")]
    text.write_bed(text.bed(spark, str(tmp_path / "a.bed")), str(tmp_path / "b"))
    assert sorted(map(tuple, text.bed(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, bed))
    g = text.gff(spark, write(tmp_path / "a.gff", 'chr1\ts\tgene\t1\t9\t.\t+\t.\tID=g1;N=a\nchr1\ts\texon\t2\t5\t.\t+\t.\tParent=g1\n'))
    assert features.with_parents(g).first()["parent"]["attributes"] == {"ID": "g1", "N": "a"} and features.by_type(g, "gene").count() == 1
    with pytest.raises(Exception, match="9 columns"):
        text.gff(spark, write(tmp_path / "b.gff", "a\tb\n")).collect()
    vcf = write(tmp_path / "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\trs\tA\tC\t.\tPASS\tAC=1;DB\tDP:GT\t3:0/1\t4:1|1\n2\t6\tr2\tA\tC\t.\tPASS\t.\tGT\t./.\t0/0\n")
    rows = text.vcf(spark, vcf).orderBy("chrom").collect()
    assert text.vcf_samples(spark, vcf) == ["s1", "s2"] and [r["g"] for r in rows] == [[1, 2], [-1, 0]] and rows[0]["info"] == {"AC": "1", "DB": ""}
    commands.run(spark, "-separate_VCF_2_chroms", vcf, write(tmp_path / "chroms", "1\n"), str(tmp_path / "split"))
    assert spark.read.text(str(tmp_path / "split/lines/chrom=1")).count() == 1
    gm = write(tmp_path / "g.txt", "v1_A_C\tA\tC\t0\t2\t2\t9\t2\n")
    commands.run(spark, "impute_missing_GMMAT_formatted_geno", gm, str(tmp_path / "imp"))
    assert text.gmmat(spark, str(tmp_path / "imp")).first()["g"] == [0, 2, 2, 1, 2]
    sam = text.sam(spark, write(tmp_path / "a.sam", "@h\nr1\t0\t1\t3\t9\t2M1D2M\t*\t0\t0\tACGT\tx\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tx\nr3\t16\t1\t4\t9\t3M\t*\t0\t0\tAAA\tx\n"))
    assert [(r["start"], r["end"], r["depth"]) for r in reads.coverage(sam).orderBy("start").collect()] == [(3, 3, 1), (4, 4, 2), (5, 5, 1), (6, 6, 2), (7, 7, 1)]
    assert {r["pos"]: (r["a"], r["total"]) for r in reads.pileup(sam).collect()} == {3: (1, 1), 4: (1, 2), 5: (1, 1), 6: (1, 2), 7: (0, 1)}
    fa = text.fasta(spark, write(tmp_path / "a.fa", ">chr1 d\nACGT\nAC\n>2\nGG\n"))
    r = spark.createDataFrame([(0, "1", 3, 5, "+"), (1, "1", 3, 5, "-")], "id int, chrom string, start int, end int, strand string")
    assert {x["id"]: x["seq"] for x in sequences.extracted(fa, r, "id").collect()} == {0: "GTA", 1: "TAC"}
    (tmp_path / "m.bin").write_bytes(text.encode_matrix(np.array([[1.0, 2.0], [3.0, 4.0]])))
    assert [r["v"] for r in text.binary_matrix(spark, str(tmp_path / "m.bin")).orderBy("row").collect()] == [[1, 2], [3, 4]]
    assert text.read_model(text.write_model([0.5, -1.25])) == [(0, "INTERCEPT", 0.5), (1, "COVAR_0", -1.25)]


def test_commands(spark, tmp_path):
    t = lambda n: str(tmp_path / n)
    write(tmp_path / "m.txt", "id\tx\ty\nr\t4\t7\ns\t2\t6\n")
    commands.run(spark, "save_matrix_plain_2_bin", t("m.txt"), "1", "1", t("m"))
    commands.run(spark, "plain_invert_matrix", t("m"), t("i"))
    commands.run(spark, "multiply_matrices_pt", t("m"), t("i"), t("e"))
    assert arr(commands.load(spark, t("e"))) == pytest.approx(np.eye(2))
    commands.run(spark, "continuous_encrypt_data_matrix", t("m"), "params", "key", t("c"))
    commands.run(spark, "secure_row2row_inner_prod_continuous_encrypted_matrices", t("c"), t("c"), None, "k", t("r"))
    assert arr(commands.load(spark, t("r"))).ravel().tolist() == [65, 40] and commands.load_enc(spark, t("r")).level == 4
    commands.run(spark, "diag_matrix_multiply_checks")
    with pytest.raises(KeyError):
        commands.run(spark, "-absent")


def test_gate_fires_once_all_sites_are_there(spark, tmp_path):
    folder, fired = str(tmp_path / "x"), []
    for k in range(2):
        exchange.upload(spark.range(3), folder, f"stats_site_{k}")
    q = gate.run_when_ready(gate.manifests(spark, folder), F.split("name", "_site_")[0], 2, fired.append, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert fired == ["stats"] and exchange.probe(spark, folder)
