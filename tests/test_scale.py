"""Operators where one region, chromosome, sample or file is large: same rows as by brute force, and no task that holds it whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import intervals, matrix, reads, sequences, stats, tiles
from siteweave.sources import text
from siteweave.streaming import gate


def regions(spark, rows, chrom="c"):
    return spark.createDataFrame([(k, chrom, s, e) for k, (s, e) in enumerate(rows)], "id int, chrom string, start int, end int")


def mixed(rng, n, top=1_000_000):
    """Regions of 1 to some 100,000 positions, all lengths as likely by their logarithm."""
    length = np.exp(rng.uniform(0, 11.5, n)).astype(int)
    start = rng.integers(1, top, n)
    return [(int(s), int(s + w)) for s, w in zip(start, length, strict=True)]


def meeting(x, y):
    return sorted((i, j) for i, (s, e) in enumerate(x) for j, (t, f) in enumerate(y) if s <= f and t <= e)


def pairs(df):
    return sorted((r["a"]["id"], r["b"]["id"]) for r in df.collect())


def test_overlaps_of_all_lengths(spark):
    rng = np.random.default_rng(1)
    x, y = mixed(rng, 150), mixed(rng, 200)
    x += [(1, 1_000_000), (1, 128), (128, 128), (129, 256)]
    y += [(128, 129), (1, 2_000_000_000)]
    a, b = regions(spark, x), regions(spark, y)
    assert pairs(intervals.overlaps(a, b)) == meeting(x, y)
    assert pairs(intervals.overlaps(b, a)) == sorted((j, i) for i, j in meeting(x, y))
    assert pairs(intervals.overlaps(a, b, longest=2_000_000_000)) == meeting(x, y)
    hit = {i for i, _ in meeting(x, y)}
    assert {r["id"] for r in intervals.without_overlap(a, b.where("id < 200")).collect()} == set(range(len(x))) - {i for i, j in meeting(x, y) if j < 200}
    assert intervals.without_overlap(a, b).count() == len(x) - len(hit) == 0
    assert intervals.overlaps(a, b.where("false")).count() == 0
    with pytest.raises(Exception, match="longer than 50"):
        intervals.overlaps(a, b, longest=50).collect()


def test_a_region_has_a_row_a_level_at_most_beside_its_own(spark):
    """One region as long as the chromosome beside many short ones."""
    short = spark.range(100_000).select(F.col("id").cast("int").alias("id"), F.lit("c").alias("chrom"), (F.col("id") * 900).cast("int").alias("start"), (F.col("id") * 900 + F.col("id") % 60).cast("int").alias("end"))
    long = regions(spark, [(1, 100_000_000)])
    both = short.unionByName(long)
    of_a, of_b = intervals.levels_of(both, short)
    assert (of_a, of_b) == ([7, 27], [7])
    assert intervals.overlaps(both, short).count() == 100_000 + 100_000 - 1
    joined = intervals._met(both, short, of_a, of_b)._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Generate explode") == 2
    rows = intervals._met(both, short, of_a, of_b)
    assert rows.count() == 199_999


def test_remainders_of_regions_with_many_cuts(spark):
    rng = np.random.default_rng(2)
    x, y = mixed(rng, 60), mixed(rng, 300)
    x.append((1, 1_200_000))
    a = regions(spark, x).unionByName(regions(spark, [(5, 9)], "other").withColumn("id", F.lit(1000)))
    got = {}
    for r in intervals.subtract(a, regions(spark, y), "id").collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"]))
    covered = np.zeros(1_400_000, bool)
    for s, e in y:
        covered[s : e + 1] = True
    for k, (s, e) in enumerate(x):
        free = np.flatnonzero(~covered[s : e + 1]) + s
        cuts = np.flatnonzero(np.diff(free) > 1)
        want = list(zip(free[np.r_[0, cuts + 1]].tolist(), free[np.r_[cuts, len(free) - 1]].tolist(), strict=True)) if len(free) else []
        assert sorted(got.get(k, [])) == want
    assert got[1000] == [(5, 9)]


def test_regions_until_a_coverage(spark):
    rng = np.random.default_rng(3)
    x = mixed(rng, 500)
    a = regions(spark, x)
    order = sorted(range(500), key=lambda k: (x[k][0] - x[k][1], k))
    for most in (1, 200_000, 1_000_000, 10**9):
        want, total = [], 0
        for k in order:
            if total >= most and want:
                break
            want.append(k)
            total += x[k][1] - x[k][0] + 1
        got = intervals.top_until_coverage(a, F.col("start") - F.col("end"), ["id"], most, parts=16)
        assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_ranks_of_a_hot_sample(spark):
    """Nine rows in ten in one sample, and half of those of one value: the order is cut by values, and that value's by ids."""
    rng = np.random.default_rng(4)
    data = [("hot" if k % 10 else f"s{k % 30}", k, float(rng.integers(0, 50)) if k % 2 else 7.0) for k in range(3000)] + [("hot", 5000, None)]
    df = spark.createDataFrame(data, "s string, id int, v double")
    up, down = {}, {}
    for name in {s for s, _, _ in data}:
        own = [(v, k) for s, k, v in data if s == name]
        up |= {k: n for n, (_, k) in enumerate(sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))}
        down |= {k: n for n, (_, k) in enumerate(sorted(own, key=lambda x: (x[0] is None, -(x[0] or 0), x[1])))}
    cut = stats.rank_normalised(df, ["s"], rows=100)
    assert {r["id"]: r["rank"] for r in cut.collect()} == up
    assert {r["id"]: r["rank"] for r in stats.rank_descending(df, ["s"], rows=100).collect()} == down
    assert {r["id"]: r["rank"] for r in stats.rank_normalised(df, ["s"]).collect()} == up
    own, part, _ = tiles.parts_by_group(df, ["s"], F.col("v"), "id", 100)
    sizes = [r["count"] for r in own.groupBy("s", part.alias("p")).count().collect()]
    assert max(sizes) < 300 and sum(sizes) == len(data)
    whole = {r["id"]: r["qn"] for r in stats.quantile_normalised(df.na.drop(), "s").collect()}
    assert {r["id"]: r["qn"] for r in stats.quantile_normalised(df.na.drop(), "s", rows=100).collect()} == whole


def test_transitions_of_a_hot_user(spark):
    rng = np.random.default_rng(5)
    data = [("hot" if k % 5 else f"u{k % 20}", int(rng.integers(0, 400)), k, "abc"[int(rng.integers(3))]) for k in range(2000)]
    df = spark.createDataFrame(data, "user string, ts int, id int, state string")
    want = {}
    for u in {x[0] for x in data}:
        own = [x[3] for x in sorted((x for x in data if x[0] == u), key=lambda x: (x[1], x[2]))]
        for a, b in zip(own, own[1:], strict=False):
            want[a, b] = want.get((a, b), 0) + 1
    for rows in (None, 100):
        assert {(r["source"], r["target"]): r["n"] for r in stats.transitions(df, ["user"], ["ts", "id"], "state", rows).collect()} == want


def test_a_chromosome_is_smoothed_in_tiles(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 9, 1500)
    pos = np.cumsum(rng.integers(1, 40, 1500))
    df = spark.createDataFrame([("c", int(p), float(v)) for p, v in zip(pos, x, strict=True)], "chrom string, pos int, v double")
    for half, iterations in ((2, 1), (5, 3)):
        want = x.copy()
        for _ in range(iterations):
            want = np.array([0.4 * want[k] + 0.6 / (2 * half) * (want[max(0, k - half) : k + half + 1].sum() - want[k]) for k in range(len(want))])
        own = stats.smoothed(df, ["chrom"], "pos", "v", half, 0.4, iterations, span=3000, rows=64)
        assert np.allclose([r["v"] for r in own.orderBy("pos").collect()], want)
        assert own.count() == 1500
        placed = tiles.numbered(df, F.floor(F.col("pos") / 3000), [F.col("pos")], "k", ["chrom"])
        sizes = [r["count"] for r in tiles.with_halos(placed, ["chrom"], "k", half * iterations, 64).groupBy("__tile").count().collect()]
        assert len(sizes) == 24 and max(sizes) <= 64 + 2 * half * iterations


def test_peaks_and_depth_across_tiles(spark):
    rng = np.random.default_rng(7)
    v = np.repeat(rng.integers(0, 10, 60), 17)
    track = spark.createDataFrame([("c", k, int(x)) for k, x in enumerate(v)], "chrom string, pos int, v int")
    for threshold in (3, 6):
        on = np.flatnonzero(v >= threshold)
        cuts = np.flatnonzero(np.diff(on) > 1)
        want = sorted(zip(on[np.r_[0, cuts + 1]].tolist(), on[np.r_[cuts, len(on) - 1]].tolist(), strict=True))
        for span in (10, 1 << 20):
            assert sorted((r["start"], r["end"]) for r in stats.peaks(track, ["chrom"], "pos", "v", [threshold], span=span).collect()) == want
    starts = rng.integers(1, 3000, 400)
    tags = spark.createDataFrame([(k, "c", int(s), "+", "50M") for k, s in enumerate(starts)] + [(999, "d", 5, "+", "5000M")], "read_id int, chrom string, pos int, strand string, cigar string")
    depth = np.zeros(3200, int)
    for s in starts:
        depth[s : s + 50] += 1
    for tile in (100, 1 << 20):
        rows = reads.coverage(tags, tile=tile).collect()
        got = np.zeros(3200, int)
        for r in rows:
            if r["chrom"] == "c":
                got[r["start"] : r["end"] + 1] += r["depth"]
        assert (got == depth).all()
        assert [(r["start"], r["end"], r["depth"]) for r in rows if r["chrom"] == "d"] == [(5, 5004, 1)]


def test_sequences_over_splits_of_their_file(spark, tmp_path):
    rng = np.random.default_rng(8)
    seqs = {f"s{k}": "".join(rng.choice(list("ACGTn"), int(n))) for k, n in enumerate([70_000, 0, 5, 200_000, 61, 60])}
    for width in (60, 7000):
        path = tmp_path / f"w{width}.fa"
        path.write_text("".join(f">{n} text\n" + "".join(s[k : k + width] + "\n" for k in range(0, len(s), width)) for n, s in seqs.items()))
        old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = text.fasta(spark, str(path))
            assert spark.read.text(str(path)).rdd.getNumPartitions() > 8
            rows = got.orderBy("chrom", "start").collect()
            r = spark.createDataFrame([(k, n, s, e, "+") for k, (n, s, e) in enumerate([("s0", 19_900, 20_100), ("s3", 1, 200_000), ("s3", 65_530, 65_540), ("s2", 1, 5)])], "id int, chrom string, start int, end int, strand string")
            cut = {x["id"]: x["seq"] for x in sequences.extracted(got, r, "id").collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
            spark.conf.set("spark.sql.files.openCostInBytes", old[1])
        whole = {}
        for x in rows:
            assert x["start"] == len(whole.get(x["chrom"], "")) + 1 and len(x["seq"]) <= text.CHUNK
            whole[x["chrom"]] = whole.get(x["chrom"], "") + x["seq"]
        assert whole == {n: s.upper() for n, s in seqs.items() if s}
        big = seqs["s3"].upper()
        assert cut == {0: seqs["s0"].upper()[19_899:20_100], 1: big, 2: big[65_529:65_540], 3: seqs["s2"].upper()}
    (tmp_path / "bad.fa").write_text("ACGT\n>a\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        text.fasta(spark, str(tmp_path / "bad.fa")).collect()


def test_the_barrier_counts_exactly_and_fires_once_over_restarts(spark, tmp_path):
    folder, fired = str(tmp_path / "in"), []

    def put(names):
        spark.createDataFrame([(n, 1) for n in names], "name string, size long").coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(gate.MANIFEST).parquet(folder)
        gate.run_when_ready(stream, F.split("name", "_site_")[0], 1000, fired.append, str(tmp_path / "cp")).awaitTermination(120)
        return sorted(fired)

    put([f"{g}_site_{k}" for g in ("a", "b", "c") for k in range(999)] + [f"a_site_{k}" for k in range(500)])
    assert run() == []
    put(["a_site_999", "b_site_5", "c_site_998"])
    assert run() == ["a"]
    put(["a_site_7", "b_site_999", "b_site_1000", "a_site_2000"])
    assert run() == ["a", "b"] == run()


def test_a_group_that_waits_too_long_is_reported(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    spark.createDataFrame([("a_1", 1), ("b_1", 1), ("b_2", 1)], "name string, size long").write.parquet(folder)
    found = gate.ready_groups(spark.readStream.schema(gate.MANIFEST).parquet(folder), F.split("name", "_")[0], 2, patience=1000)
    q = found.writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            if len(out) == 2:
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
    assert sorted(out) == [("a", 1, False), ("b", 2, True)]


def cells(spark, x, keep=None):
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(x) if keep is None or keep[i, j]]
    return matrix.Matrix(spark.createDataFrame(rows, "row int, col int, v double"), *x.shape)


def array(m):
    out, there = np.zeros((m.nrow, m.ncol)), np.zeros((m.nrow, m.ncol), bool)
    for r in m.df.collect():
        out[r["row"], r["col"]], there[r["row"], r["col"]] = r["v"], True
    return out, there


def test_products_by_blocks_and_by_cells_have_the_same_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, y = rng.integers(-2, 3, (37, 50)).astype(float), rng.integers(-2, 3, (50, 21)).astype(float)
    a, b = rng.random((37, 50)) < 0.2, rng.random((50, 21)) < 0.3
    a[5], b[:, 3] = False, False
    for p, q in ((None, None), (a, b), (a, None)):
        left, right = cells(spark, x, p), cells(spark, y, q)
        want = (x if p is None else x * p) @ (y if q is None else y * q)
        got, there = array(left.matmul_blocked(right, 8))
        by_cells, same = array(left.matmul(right, dense=False))
        assert np.allclose(got, want) and np.allclose(by_cells, want) and (there == same).all()
    monkeypatch.setattr(matrix, "LARGE", 10)
    plan = lambda m: m.df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan(cells(spark, x).matmul(cells(spark, y))) and "MapInPandas" not in plan(cells(spark, x, a).matmul(cells(spark, y, rng.random((50, 21)) < 0.01)))


def test_inverse_by_blocks(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((50, 50))
    x[:16, :16] = 0  # a leading block that has no inverse
    got, _ = array(cells(spark, x).inverse_blocked(16))
    assert np.allclose(got, np.linalg.inv(x), rtol=1e-8, atol=1e-8)
    s = x @ x.T + np.eye(50)
    sparse = np.abs(s) > 0.5
    sparse |= np.eye(50, dtype=bool)
    got, _ = array(cells(spark, np.where(sparse, s, 0) + 50 * np.eye(50), sparse).inverse_blocked(16, definite=True))
    assert np.allclose(got, np.linalg.inv(np.where(sparse, s, 0) + 50 * np.eye(50)))
    with pytest.raises(Exception, match="singular"):
        cells(spark, np.zeros((20, 20))).inverse_blocked(16, definite=True)


def test_a_store_reads_the_row_groups_of_a_region(spark, tmp_path):
    from siteweave.sources import store

    path = str(tmp_path / "s")
    own = spark.range(300_000).select(F.col("id"), (F.col("id") % 3 + 1).cast("string").alias("chrom"), (F.col("id") * 7919 % 1_000_003).cast("int").alias("start"))
    own = own.withColumn("end", (F.col("start") + F.col("id") % 200).cast("int")).withColumn("g", F.sha2(F.col("id").cast("string"), 256))
    store.write(own, path, 6, group=1 << 16)
    want = {r["id"] for r in own.where("chrom = '2' and start <= 510000 and end >= 500000").collect()}
    got = store.scan(spark, path, [("2", 500_000, 510_000)])
    assert {r["id"] for r in got.collect()} == want and got.columns == own.columns
    plan = got._jdf.queryExecution().executedPlan()
    assert "LessThanOrEqual(start,510000)" in plan.toString() and "(place" in plan.toString().split("PartitionFilters")[1]
    metric = lambda name: plan.collectLeaves().apply(0).metrics().apply(name).value()
    assert 0 < metric("numFiles") <= len(list((tmp_path / "s" / "place=c2").glob("*.parquet"))) < len(list((tmp_path / "s").rglob("*.parquet")))
    assert len(want) <= metric("numOutputRows") < 20_000  # of 100,000 of the chromosome
    regions_ = spark.createDataFrame([("2", 500_000, 505_000), ("2", 505_001, 510_000), ("3", 1, 10)], "chrom string, start int, end int")
    expect = want | {r["id"] for r in own.where("chrom = '3' and start <= 10 and end >= 1").collect()}
    assert sorted(r["id"] for r in store.within(spark, path, regions_).collect()) == sorted(expect)
    many = spark.range(2000).select(F.lit("2").alias("chrom"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 2).cast("int").alias("end"))
    joined = sorted(r["id"] for r in store.within(spark, path, many).collect())
    assert joined == sorted({r["a"]["id"] for r in intervals.overlaps(own, many).collect()})


def test_conditions_reach_files_of_positions(spark, tmp_path):
    from siteweave.sources import positioned

    positioned.register(spark)
    rng = np.random.default_rng(11)
    rows = sorted((str(c), int(p)) for c in (1, 2, 3) for p in rng.integers(1, 100_000, 3000))
    path = str(tmp_path / "a.vcf")
    with open(path, "w") as out:
        out.write("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\n")
        out.writelines(f"{c}\t{p}\tv{k}\tA\tC\t.\tPASS\t.\tGT\t0/1\n" for k, (c, p) in enumerate(rows))
    load = lambda **o: spark.read.format("positioned").options(kind="vcf", split="10000", **o).load(path)
    assert sorted((r["chrom"], r["pos"]) for r in load().collect()) == rows
    for sorted_ in ("true", "false"):
        for test in ("chrom = '2' and pos > 50000 and pos <= 51000", "chrom in ('1', '3') and pos < 700", "pos = 77", "chrom = '2' and id like '%7'", "chrom = '9'"):
            own = load(sorted=sorted_).where(test)
            assert sorted(r["id"] for r in own.collect()) == sorted(r["id"] for r in load().where(F.expr(test) & (F.rand() >= 0)).collect())
    asked = positioned.PositionedReader({"path": path, "kind": "vcf", "sorted": "true", "split": "10000"})
    every = len(asked.partitions())
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    assert list(asked.pushFilters([EqualTo(("chrom",), "2"), GreaterThan(("pos",), 50_000), LessThan(("pos",), 52_000)])) == []
    assert every > 20 and 1 <= len(asked.partitions()) <= 5  # ranges of the region, and those where a chromosome ends
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bed").write_text("track x\nc1\t9\t20\tn\t5\t-\nc1\t30\t40\n")
    import gzip

    (tmp_path / "b" / "y.bed.gz").write_bytes(gzip.compress(b"c2\t0\t5\tm\n"))
    bed = spark.read.format("positioned").option("kind", "bed").load(str(tmp_path / "b"))
    assert sorted((tuple(r) for r in bed.where("start >= 1").collect()), key=str) == [("c1", 10, 20, "n", "5", "-"), ("c1", 31, 40, None, None, None), ("c2", 1, 5, "m", None, None)]
    assert bed.where("chrom = 'c1' and start > 10").count() == 1
    (tmp_path / "a.sam").write_text("@HD\nr1\t16\tc1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\n")
    assert [tuple(r) for r in spark.read.format("positioned").option("kind", "sam").load(str(tmp_path / "a.sam")).collect()] == [("r1", 16, "c1", 5, "4M", "ACGT")]


def test_imputing_a_long_array_is_no_square(spark):
    """The mean of a variant's cells is not made again for each of them: 100,000 cells took minutes."""
    import time

    from siteweave.operators import genotypes

    cells = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda k: (k % 4).cast("int"))
    wide = spark.range(1).select(cells.alias("g"))
    t = time.time()
    r = genotypes.impute_wide(wide).select("n_missing", F.aggregate("g", F.lit(0), lambda s, x: s + x).alias("sum"), F.slice("g", 1, 4).alias("head")).first()
    assert (r["n_missing"], r["sum"], r["head"]) == (25_000, 100_000, [0, 1, 2, 1])
    assert time.time() - t < 20


def test_matches_of_one_key_are_many_tasks(spark):
    from siteweave.operators import tables

    q = spark.range(3000).select(F.col("id").alias("q_pos"), F.lit(1).alias("k")).coalesce(1)
    t = spark.range(2500).select(F.col("id").alias("row_pos"), F.lit(1).alias("k"), F.col("id").cast("string").alias("v")).coalesce(1)
    got = tables.lookup(q, t, "k")
    assert got.columns == ["k", "q_pos", "row_pos", "v"]
    assert got.agg(F.count(F.lit(1)), F.countDistinct("q_pos"), F.countDistinct("row_pos"), F.sum(F.col("q_pos") * 2500 + F.col("row_pos"))).first()[:] == (7_500_000, 3000, 2500, sum(range(7_500_000)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_first_matches_are_found_without_all_of_them(spark):
    """200,000 rows for each of 100,000 queries are 20 billion matches."""
    import time

    from siteweave.operators import tables

    q = spark.range(100_000).select(F.col("id").alias("q_pos"), F.lit(1).alias("k"))
    t = spark.range(200_000).select((200_000 - F.col("id")).alias("row_pos"), F.lit(1).alias("k"), F.col("id").alias("v"))
    at = time.time()
    assert tables.lookup(q, t, "k", all_matches=False).agg(F.count(F.lit(1)), F.min("row_pos"), F.max("row_pos"), F.max("v")).first()[:] == (100_000, 1, 1, 199_999)
    assert time.time() - at < 60


@pytest.mark.parametrize("tile", [64, 4096, 1 << 30])
def test_first_overlaps_by_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    x, y = mixed(rng, 150, 50_000) + [(7, 6), (100, 100)], mixed(rng, 120, 50_000) + [(100, 100), (100, 100), (40, 30)]
    for longest in (None, 200_000):
        got = intervals.overlaps_first(regions(spark, x), regions(spark, y), "id", longest, tile)
        want = {i: min((*y[j], j) for j in range(len(y)) if s <= y[j][1] and y[j][0] <= e and y[j][0] <= y[j][1]) for i, (s, e) in enumerate(x) if s <= e and any(s <= f and t <= e and t <= f for t, f in y)}
        rows = got.collect()
        assert {r["a"]["id"]: (r["b"]["start"], r["b"]["end"], r["b"]["id"]) for r in rows} == want and len(rows) == len(want)
        assert all(r["l_overlap"] == min(r["a"]["end"], r["b"]["end"]) - max(r["a"]["start"], r["b"]["start"]) + 1 for r in rows)


def test_first_overlaps_make_no_pairs(spark):
    """100,000 regions on 100,000 others are 10 billion pairs."""
    import time

    side = lambda k: spark.range(100_000).select("id", F.lit("c").alias("chrom"), F.lit(100).alias("start"), (F.col("id") % 50 + k).cast("int").alias("end"))
    t = time.time()
    got = intervals.overlaps_first(side(120), side(130), "id", 128).agg(F.count(F.lit(1)), F.min("b.id"), F.max("b.id")).first()
    assert got[:] == (100_000, 0, 0)
    assert time.time() - t < 60


def test_terms_of_the_gamma_series_are_one_number(spark):
    """Each term made a struct and its arguments anew: 20 s of CPU for 90,000 rows, twice."""
    from siteweave.functions import scalar

    z = (F.col("id") % 90 + 1) / 10.0
    plan = spark.range(2).select(scalar.lower_gamma(F.lit(2.0), z).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("named_struct") <= 1 and plan.count("% 90") == 3
    got = spark.range(2).select(F.col("id"), scalar.lower_gamma(F.lit(2.0), z).alias("x"), scalar.lower_gamma(F.lit(0.5), F.lit(0.0)).alias("zero"), scalar.lower_gamma(F.lit(0.5), F.lit(None).cast("double")).alias("none")).orderBy("id").collect()
    assert [r["x"] for r in got] == pytest.approx([1 - (1 + v) * np.exp(-v) for v in (0.1, 0.2)], rel=1e-13) and [(r["zero"], r["none"]) for r in got] == [(0.0, None)] * 2


def test_tasks_of_features_follow_the_table(spark, monkeypatch):
    """A task groups a bounded number of line items, so its memory does not grow with the table."""
    from siteweave.plans import catalog, catalog_files

    monkeypatch.setattr(catalog_files, "GROUPED", 50, raising=False)
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for name in ("read_gff", "gff_by_property", "gff_extent"):
        assert len(catalog.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()) > n // 50 * 0.8


def test_parents_are_joined_without_columns_that_nobody_asks_for(spark):
    from siteweave.operators import features

    gff = spark.range(4).select("id", F.rand(1).cast("string").alias("group"), F.create_map(F.lit("ID"), F.concat(F.lit("g"), "id"), F.lit("Parent"), F.concat(F.lit("g"), F.col("id") - 1)).alias("attributes"))
    found = features.with_parents(gff)
    assert found.columns == ["child", "parent"] and found.select("child.*").columns == found.select("parent.*").columns == gff.columns
    ids = found.select("child.id", F.col("parent.id").alias("up"))
    assert "rand(" not in ids._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(ids.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_pairs_of_regions_of_one_place_are_made_after_their_places_met(spark):
    """60 regions a place on either side: the join sees the places, in rows of bounded lists."""
    x = [(s, s + 9) for s in range(0, 60, 20)] * 60 + [(5, 4)]
    y = [(s, s + 4) for s in range(0, 60, 15)] * 60
    a, b = regions(spark, x), regions(spark, y)
    places = intervals.placed(a, 25)
    assert sorted(len(r["items"]) for r in places.collect()) == [10] * 3 + [25] * 6
    met = intervals.overlaps_by_place(a, b, 51)
    assert met.count() == len(meeting(sorted(set(x[:-1])), sorted(set(y))))
    own = intervals.apart(met.select(F.col("a.items.id").alias("a"), F.col("b.items.id").alias("b")), ["a"], ["b"])
    assert sorted((r["a"], r["b"]) for r in own.collect()) == meeting(x[:-1], y)
    left = intervals.pairwise_remainders(a, b, "id", 51)
    want = sorted((i, u, v, j) for i, j in meeting(x[:-1], y) for u, v in ((x[i][0], y[j][0] - 1), (y[j][1] + 1, x[i][1])) if u <= v)
    assert sorted((r["id"], r["start"], r["end"], r["b"]["id"]) for r in left.collect()) == want
    assert left.columns == ["id", "chrom", "start", "end", "b"] and left.select("b.*").columns == b.columns


def test_streamed_pairs_are_made_after_the_sink(spark, tmp_path):
    """The sink of overlaps_streamed has a row for two places that met, not for two regions."""
    from siteweave.plans import catalog, catalog_files

    d, held = "/root/testdata/sf0.001", []
    ran = catalog_files._ran
    catalog_files._ran = lambda stream, mode="append": held.append(ran(stream, mode)) or held[-1]
    try:
        got = catalog.QUERIES["overlaps_streamed"](spark, d)
    finally:
        catalog_files._ran = ran
    assert dict(held[0].dtypes)["a"] == "array<bigint>"
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog.QUERIES["overlap_join_all"](spark, d).collect()))


def test_moved_regions_are_the_same_however_often_they_are_made(spark):
    """Random places do not follow the order or partition of the rows, and no merge is made again."""
    a, b = regions(spark, [(k * 50, k * 50 + k % 40) for k in range(400)]), regions(spark, [(k * 70, k * 70 + 30) for k in range(300)])
    one = intervals.shuffled_overlap(a, b, 30_000, 3)
    two = intervals.shuffled_overlap(a.orderBy(F.desc("id")).repartition(3, "start"), b, 30_000, 3)
    assert sorted(one.collect()) == sorted(two.collect()) and all(r["coverage"] > 0 for r in one.collect())
    assert "Window" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_matches_are_written_as_runs_and_repeats(spark, tmp_path):
    """60,000 rows a task were too many for a dictionary of a file: each match was written with its name."""
    from pathlib import Path

    from siteweave.operators import tables

    q = spark.range(64).select(F.col("id").alias("q_pos"), F.lit(1).alias("k"))
    t = spark.range(240_000).select(F.col("id").alias("row_pos"), F.lit(1).alias("k"), F.format_string("Customer#%09d", "id").alias("name"))
    tables.lookup(q, t, "k").write.parquet(path := str(tmp_path / "out"))
    got = spark.read.parquet(path)
    assert got.agg(F.count(F.lit(1)), F.countDistinct("q_pos"), F.countDistinct("row_pos"), F.countDistinct("name")).first()[:] == (15_360_000, 64, 240_000, 240_000)
    assert got.where("CAST(substr(name, 10) AS INT) != row_pos").count() == 0
    size = sum(p.stat().st_size for p in Path(path).glob("*.parquet"))
    assert size < 15_360_000 * 0.8, size


def test_lists_are_unrolled_in_pieces_that_repeat_in_bytes(spark):
    """300 regions beside each of two: runs of 256, of a multiple of eight, and of the rest."""
    a, b = regions(spark, [(1, 9)] * 2), regions(spark, [(5, 7)] * 300)
    met = intervals.overlaps_by_place(a, b, 51).select(F.col("a.items.id").alias("a"), F.col("b.items.id").alias("b"))
    got = [r[:] for r in intervals.apart(met, ["a"], ["b"]).collect()]
    assert got == [(i, j) for low, high in ((0, 256), (256, 296), (296, 300)) for i in range(2) for j in range(low, high)]


@pytest.mark.parametrize("name", ["overlap_join_all", "pairwise_remainders", "overlaps_streamed", "join_by_name"])
def test_tasks_of_pairs_follow_the_line_items(spark, monkeypatch, name):
    """A task that writes pairs of more regions than a file's dictionary holds writes each number in full."""
    from siteweave.plans import catalog

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalog, "PAIRED", 100, raising=False)
    n = 1 + spark.read.parquet(f"{d}/lineitem.parquet").count() // 100
    plan = catalog.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert n > 50 and f", {n}), REPARTITION_BY_NUM" in plan
