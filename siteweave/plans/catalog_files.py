"""Registered queries of the file formats, reads, features, sequences, exchange and streams, each with SQL for the same rows.

Lines of each format are made from the driver's tables, written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions import scalar as S
from siteweave.operators import features as X
from siteweave.operators import genotypes as G
from siteweave.operators import intervals as I
from siteweave.operators import reads as R
from siteweave.operators import sequences as Q
from siteweave.operators import stats as A
from siteweave.plans.catalog import AB, GENO, IV, LONGEST, META, _intervals, _r, _t, _tasks, query
from siteweave.sources import exchange as E
from siteweave.sources import text as T


def _written(df: DataFrame, *columns: Column | str, what: str = "lines", gz: bool = False) -> str:
    """Tab-separated lines of the columns in a new folder."""
    path = E.scratch(df.sparkSession, what)
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    own = df.select(F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("value"))
    own.write.option("compression", "gzip" if gz else "none").text(path)
    return path


# ---- regions: purchases as in the interval queries, with a name, a score and a strand ----

REGS = IV + ", regs AS (SELECT id, chrom, s, e, 'r' || id AS name, CAST(id % 1000 AS DOUBLE) AS score, CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM iv) "


def _regs(s: SparkSession, d: str) -> DataFrame:
    own = _intervals(s, d, None)
    return own.withColumns({"name": F.concat(F.lit("r"), "id"), "score": F.col("id") % 1000, "strand": F.when(F.col("id") % 2 == 0, "+").otherwise("-")})


def _bed() -> list[Column]:
    """The six columns of BED: zero-based, half-open."""
    return [F.col("chrom"), F.col("start") - 1, F.col("end"), F.col("name"), F.col("score"), F.col("strand")]


@query("read_bed", REGS + 'SELECT chrom, s AS start, e AS "end", name, score, strand FROM regs')
def _(s, d):
    path = E.scratch(s, "bed")
    T.write_bed(_regs(s, d), path)
    return T.bed(s, path)


@query("read_bed_gz", REGS + "SELECT chrom, s AS start, e AS \"end\", '.' AS name, CAST(0 AS DOUBLE) AS score, '+' AS strand FROM regs")
def _(s, d):
    """Three columns, compressed."""
    return T.bed(s, _written(_regs(s, d), *_bed()[:3], gz=True))


@query("line_filters", REGS + "SELECT count(*) AS n, CAST(sum(length(chrom || s || e)) AS BIGINT) AS letters FROM regs")
def _(s, d):
    """Comment, track and blank lines go."""
    own = _regs(s, d).select("chrom", "start", "end")
    head = s.createDataFrame([("#c",), ("track name=x",), ("browser position",), ("",)], "value string")
    path = E.scratch(s, "lines")
    head.unionAll(own.select(F.concat_ws("\t", "chrom", F.col("start") - 1, "end").alias("value"))).write.text(path)
    return T.bed(s, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.concat("chrom", F.col("start").cast("string"), F.col("end").cast("string")))).alias("letters"))


@query("read_bed12", REGS + 'SELECT name, s AS thick_start, e AS thick_end, k AS block, CASE WHEN k = 0 THEN s ELSE e END AS start, CASE WHEN k = 0 THEN s ELSE e END AS "end" FROM regs, (VALUES (0), (1)) b(k)')
def _(s, d):
    """Blocks of one position at both ends."""
    starts = F.concat(F.lit("0,"), (F.col("end") - F.col("start")).cast("string"), F.lit(","))
    own = T.bed12(s, _written(_regs(s, d), *_bed(), F.col("start") - 1, "end", F.lit("0"), F.lit(2), F.lit("1,1,"), starts))
    return own.select("name", "thick_start", "thick_end", F.posexplode("intervals").alias("block", "b")).select("name", "thick_start", "thick_end", "block", "b.start", "b.end")


@query("read_narrow_peak", REGS + 'SELECT name, s AS start, e AS "end", score / 8 AS signal, score / 16 AS log_p, score / 32 AS log_q, CAST((e - s) // 2 AS INT) AS summit FROM regs')
def _(s, d):
    x = F.col("score")
    half = F.floor((F.col("end") - F.col("start")) / 2)
    return T.narrow_peak(s, _written(_regs(s, d), *_bed(), x / 8, x / 16, x / 32, half)).select("name", "start", "end", "signal", "log_p", "log_q", "summit")


@query("read_bed_pq", REGS + "SELECT name, score / 8 AS log_p, score / 16 AS log_q FROM regs ORDER BY log_q DESC, log_p, name")
def _(s, d):
    """By q and p, as the comparators of peaks order them."""
    return T.bed_pq(s, _written(_regs(s, d), *_bed(), F.col("score") / 8, F.col("score") / 16)).orderBy(F.desc("log_q"), "log_p", "name").select("name", "log_p", "log_q")


@query("read_interval", REGS + 'SELECT name, strand, k AS part, CASE WHEN k = 0 THEN s ELSE e END AS start, CASE WHEN k = 0 THEN s ELSE e END AS "end" FROM regs, (VALUES (0), (1)) b(k)')
def _(s, d):
    point = lambda c: F.struct(F.col(c).alias("start"), F.col(c).alias("end"))
    path = E.scratch(s, "interval")
    T.write_interval(_regs(s, d).withColumn("intervals", F.array(point("start"), point("end"))), path)
    return T.interval(s, path).select("name", "strand", F.posexplode("intervals").alias("part", "b")).select("name", "strand", "part", "b.start", "b.end")


@query("region_order", REGS + "SELECT id, row_number() OVER (ORDER BY chrom, s, e, id) AS place FROM regs")
def _(s, d):
    """Places in the order of chromosome, start and end, without a task for a whole chromosome."""
    own = _regs(s, d)
    part = F.struct(F.col("chrom"), F.floor(F.col("start") / 8192))
    return A.numbered(own, part, [F.col("chrom"), F.col("start"), F.col("end"), F.col("id")], "place").select("id", F.col("place").cast("long").alias("place"))


@query("join_by_name", REGS + "SELECT a.id AS a, b.id AS b FROM (SELECT *, substr(name, 2, 5) AS n FROM regs WHERE strand = '+') a JOIN (SELECT *, substr(name, 2, 5) AS n FROM regs WHERE strand = '-') b ON a.n = b.n")
def _(s, d):
    own = _regs(s, d).withColumn("name", F.substring("name", 2, 5))
    a, b = (own.where(F.col("strand") == x).select("id", "name") for x in "+-")
    return I.by_name(a, b, tasks=_tasks(s, d)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("super_region", REGS + "SELECT id, s - s % 512 AS sup FROM regs WHERE e < s - s % 512 + 512")
def _(s, d):
    """Regions that lie in one of 512 positions, with it."""
    own = _regs(s, d).withColumn("low", F.col("start") - F.col("start") % 512).where("end < low + 512")
    supers = own.select("chrom", F.col("low").alias("start"), (F.col("low") + 511).alias("end")).distinct()
    return I.in_super_region(own.select("id", "chrom", "start", "end"), supers, "id", 512).select("id", F.col("super.start").alias("sup"))


@query("shuffled_overlap", "SELECT CAST(k AS INT) AS replicate, true AS inside FROM range(1, 6) t(k)")
def _(s, d):
    """A null distribution at random: each replicate covers something, at most all of what there is."""
    a, b = _intervals(s, d, 1), _intervals(s, d, 0)
    most = I.covered(b).first()[0]
    return I.shuffled_overlap(a, b, 400_000, 5).select("replicate", F.col("coverage").between(1, most).alias("inside"))


@query("five_prime_ends", REGS + "SELECT id, CASE WHEN strand = '+' THEN s ELSE e END AS p5, CASE WHEN strand = '+' THEN e ELSE s END AS p3 FROM regs")
def _(s, d):
    own = _regs(s, d)
    return I.ends_of(own, 5).select("id", F.col("start").alias("p5")).join(I.ends_of(own, 3).select("id", F.col("start").alias("p3")), "id")


@query("track_masked", IV + ", t AS (SELECT chrom, s AS pos, count(*) AS v FROM a GROUP BY 1, 2) SELECT chrom, pos, v FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.chrom = t.chrom AND t.pos BETWEEN b.s AND b.e)")
def _(s, d):
    track = _intervals(s, d, 1).groupBy("chrom", F.col("start").alias("pos")).agg(F.count(F.lit(1)).alias("v"))
    return A.masked(track, _intervals(s, d, 0)).select("chrom", "pos", "v")


@query("read_bedgraph", IV + 'SELECT chrom, s AS start, max(e) AS "end", CAST(count(*) AS DOUBLE) AS v FROM a GROUP BY 1, 2')
def _(s, d):
    runs = _intervals(s, d, 1).groupBy("chrom", "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).cast("double").alias("v"))
    path = E.scratch(s, "bedgraph")
    T.write_bedgraph(runs, path)
    return T.bedgraph(s, path)


# ---- features: orders as genes, their line items as exons ----

GENES = """WITH ex AS (SELECT l_orderkey AS k, min(l_linenumber) AS ln, l_partkey % 1000 * 100 + 1 AS s, max(l_quantity) AS q, l_shipdate FROM lineitem GROUP BY l_orderkey, l_partkey, l_shipdate),
f AS (SELECT DISTINCT 'exon' AS feature, 'c' || k % 5 AS chrom, s, CAST(s + q AS INT) AS e, 'x' || k || '.' || ln AS id, 'g' || k AS parent FROM ex) """


#: Line items that a task groups.
GROUPED = 500_000


def _gff(s, d) -> DataFrame:
    li = _t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber", "l_quantity")
    # an order's items lie together once; tasks hold as many rows whatever the size of the table
    tasks = max(int(s.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // GROUPED))
    li = li.repartition(tasks, "l_orderkey").groupBy("l_orderkey", "l_partkey", "l_shipdate").agg(F.min("l_linenumber").alias("ln"), F.max("l_quantity").alias("q"))
    at = (F.col("l_partkey") % 1000 * 100 + 1).cast("int")
    li = li.select("l_orderkey", "ln", at.alias("s"), (at + F.col("q")).cast("int").alias("e")).distinct()
    exons = li.select(F.concat(F.lit("c"), F.col("l_orderkey") % 5).alias("chrom"), F.lit("exon").alias("feature"), "s", "e", F.concat_ws(";", F.concat(F.lit("ID=x"), "l_orderkey", F.lit("."), "ln"), F.concat(F.lit("Parent=g"), "l_orderkey")).alias("attr"))
    genes = _t(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey") % 5).alias("chrom"), F.lit("gene").alias("feature"), F.lit(1).alias("s"), F.lit(200_000).alias("e"), F.concat(F.lit('ID "g'), "o_orderkey", F.lit('"; status "'), "o_orderstatus", F.lit('";')).alias("attr"))
    rows = exons.unionByName(genes)
    return T.gff(s, _written(rows, "chrom", F.lit("shop"), "feature", "s", "e", F.lit("."), F.lit("+"), F.lit("."), "attr", what="gff"))


@query("read_gff", GENES + 'SELECT chrom, feature, s AS start, e AS "end", id, parent FROM f')
def _(s, d):
    own = X.by_type(X.by_source(_gff(s, d), "shop"), "exon")
    return own.select("chrom", "feature", "start", "end", F.col("attributes")["ID"].alias("id"), F.col("attributes")["Parent"].alias("parent"))


@query("gff_by_property", "SELECT 'g' || o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    return X.by_property(_gff(s, d), "status", "F").select(F.col("attributes")["ID"].alias("id"), F.col("attributes")["status"].alias("status"))


@query("gff_parents", GENES + "SELECT f.id AS child, parent, o_orderstatus AS status FROM f JOIN orders ON parent = 'g' || o_orderkey")
def _(s, d):
    own = X.with_parents(_gff(s, d))
    return own.select(F.col("child.attributes")["ID"].alias("child"), F.col("parent.attributes")["ID"].alias("parent"), F.col("parent.attributes")["status"].alias("status"))


@query("gff_extent", GENES + 'SELECT chrom, parent AS value, min(s) AS start, max(e) AS "end", count(*) AS n FROM f GROUP BY 1, 2')
def _(s, d):
    return X.extent(_gff(s, d), "Parent").select("chrom", "value", "start", "end", "n")


# ---- variants: parts, with genotypes of four samples ----

VAR = """WITH v AS (SELECT p_partkey AS k, p_brand AS chrom, CAST(p_partkey AS INT) AS pos, 'v' || p_partkey AS id, substr('ACGT', p_size % 4 + 1, 1) AS ref, substr('ACGT', (p_size + 1) % 4 + 1, 1) AS alt, p_size FROM part),
g AS (SELECT v.*, CAST(j AS INT) AS sample, CAST(CASE (k + j * p_size) % 4 WHEN 3 THEN -1 ELSE (k + j * p_size) % 4 END AS INT) AS g FROM v, range(4) t(j)) """
CHROM = "regexp_replace(chrom, '[^A-Za-z0-9_.-]', '_', 'g')"
SAMPLES = ["s0", "s1", "s2", "s3"]


def _variants(s, d) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    base = lambda n: F.substring(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))
    g = F.array(*[F.when((k + j * size) % 4 == 3, -1).otherwise((k + j * size) % 4).cast("int") for j in range(4)])
    return _t(s, d, "part").select(k.alias("k"), F.col("p_brand").alias("chrom"), k.cast("int").alias("pos"), F.concat(F.lit("v"), k).alias("id"), base(size).alias("ref"), base(size + 1).alias("alt"), g.alias("g"), "p_size")


def _vcf(s, d) -> str:
    path = E.scratch(s, "vcf")
    T.write_vcf(_variants(s, d), SAMPLES, path)
    return path


@query("read_vcf", VAR + f"SELECT {CHROM} AS chrom, pos, id, ref, alt, sample, g FROM g")
def _(s, d):
    return T.vcf(s, _vcf(s, d)).select("chrom", "pos", "id", "ref", "alt", F.posexplode("g").alias("sample", "g"))


@query("vcf_at_positions", VAR + "SELECT DISTINCT chrom, pos, id, ref, alt FROM g WHERE chrom = 'Brand#17' AND pos > 100 AND pos <= 1500")
def _(s, d):
    """By the source that takes the conditions, from a file of all variants."""
    from siteweave.sources import positioned

    positioned.register(s)
    own = s.read.format("positioned").option("kind", "vcf").load(_vcf(s, d))
    return own.where("chrom = 'Brand#17' and pos > 100 and pos <= 1500").select("chrom", "pos", "id", "ref", "alt")


@query("vcf_samples", "SELECT CAST(k AS INT) AS place, 's' || k AS sample FROM range(4) t(k)")
def _(s, d):
    return s.createDataFrame(list(enumerate(T.vcf_samples(s, _vcf(s, d)))), "place int, sample string")


@query("vcf_info_format", VAR + "SELECT id, CAST(p_size AS VARCHAR) AS size, true AS flagged, g FROM g WHERE sample = 0")
def _(s, d):
    """GT behind another field, INFO as a map."""
    gt = F.when(F.col("g")[0] == 0, "0/0").when(F.col("g")[0] == 1, "0|1").when(F.col("g")[0] == 2, "1/1").otherwise("./.")
    own = _variants(s, d)
    path = _written(own, "chrom", "pos", "id", "ref", "alt", F.lit("."), F.lit("PASS"), F.concat(F.lit("SIZE="), "p_size", F.lit(";FLAG")), F.lit("DP:GT"), F.concat(F.lit("7:"), gt))
    return T.vcf(s, path).select("id", F.col("info")["SIZE"].alias("size"), F.expr("map_contains_key(info, 'FLAG')").alias("flagged"), F.col("g")[0].alias("g"))


@query("vcf_haplotypes", VAR + "SELECT id, sample, CASE WHEN g < 0 THEN -1 ELSE g END AS h FROM g")
def _(s, d):
    path = E.scratch(s, "vcf")
    T.write_vcf(_variants(s, d), SAMPLES, path, haplotypes=True)
    return T.vcf(s, path, haplotypes=True).select("id", F.posexplode("g").alias("sample", "h"))


@query("split_vcf", VAR + f"SELECT {CHROM} AS chrom, count(*) AS n FROM v WHERE chrom IN ('Brand#11', 'Brand#12', 'Brand#21') GROUP BY 1")
def _(s, d):
    out = E.scratch(s, "split")
    T.split_vcf(s, _vcf(s, d), ["Brand_11", "Brand_12", "Brand_21"], out)
    return s.read.text(f"{out}/lines").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("read_gmmat", VAR + "SELECT id AS var_id, ref, alt, sample, g FROM g")
def _(s, d):
    path = E.scratch(s, "gmmat")
    T.write_gmmat(_variants(s, d).withColumnRenamed("id", "var_id"), path)
    return T.gmmat(s, path).select("var_id", "ref", "alt", F.posexplode("g").alias("sample", "g"))


@query("variants_at_targets", VAR + "SELECT p_partkey AS target, v.id AS id FROM part LEFT JOIN v ON p_brand = v.chrom AND p_partkey - p_partkey % 2 = v.pos")
def _(s, d):
    k = F.col("p_partkey")
    targets = _t(s, d, "part").select(F.col("p_brand").alias("chrom"), (k - k % 2).cast("int").alias("start"), F.lit(".").alias("name"), k.alias("target"))
    return G.at_targets(_variants(s, d), targets, match_names=True).select("t.target", "v.id")


@query("variant_names", VAR + "SELECT k, 'v_' || k AS id, ref, alt FROM v")
def _(s, d):
    name = F.concat_ws("_", F.lit("v"), "k", "ref", "alt")
    return _variants(s, d).select("k", G.parsed_name(name).alias("n")).select("k", "n.id", "n.ref", "n.alt")


@query("mutation_matrix", VAR + "SELECT CASE WHEN p_size >= 30 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS band, ref, alt, count(*) AS n FROM v GROUP BY 1, 2, 3")
def _(s, d):
    return G.mutation_matrix(_variants(s, d).withColumn("daf", F.col("p_size") / 50.0), [0.2, 0.6])


@query("variants_concat", VAR + "SELECT id, 1 AS part FROM v UNION ALL SELECT id, 2 FROM v WHERE p_size > 25")
def _(s, d):
    own = _variants(s, d)
    return G.concat_variants([own.withColumn("part", F.lit(1)), own.where("p_size > 25").withColumn("part", F.lit(2))]).select("id", "part")


@query("haplotype_dosage", VAR + "SELECT id, sample, CASE WHEN g < 0 THEN g ELSE g // 2 + g % 2 END AS g FROM g")
def _(s, d):
    long = G.long_form(_variants(s, d), ["id"]).withColumnRenamed("subject_idx", "sample")
    return G.haplotypes_to_dosage(long)


@query("genotype_validity", VAR + "SELECT id, sample, g >= 0 AS valid FROM g")
def _(s, d):
    return G.long_form(_variants(s, d), ["id"]).select("id", F.col("subject_idx").alias("sample"), S.valid_genotype(F.col("g")).alias("valid"))


# ---- models and signals ----


@query("read_features", "SELECT CAST(c_custkey AS VARCHAR) AS subject_id, CAST(1 AS DOUBLE) AS x0, round(c_acctbal, 2) AS x1, CAST(c_nationkey AS DOUBLE) AS y FROM customer")
def _(s, d):
    own = _t(s, d, "customer")
    from siteweave.operators.tables import genotype_phenotypes

    f, y = genotype_phenotypes(own.select(F.col("c_custkey").cast("string").alias("id"), F.round("c_acctbal", 2).alias("BAL"), "c_nationkey"))
    x, p = E.scratch(s, "features"), E.scratch(s, "phenotypes")
    f.write.csv(x, sep="\t", header=True)
    y.write.csv(p, sep="\t", header=True)
    both = T.features(s, x).join(T.phenotypes(s, p), "subject_id")
    return both.select("subject_id", F.col("x")[0].alias("x0"), F.round(F.col("x")[1], 2).alias("x1"), "y")


@query("model_round_trip", "SELECT CAST(k AS INT) AS feature, CASE WHEN k = 0 THEN 'INTERCEPT' ELSE 'COVAR_' || (k - 1) END AS name, round(w, 6) AS w FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, avg(c_acctbal) AS w FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey)")
def _(s, d):
    rows = _t(s, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("w")).orderBy("c_nationkey").collect()
    return s.createDataFrame([(k, n, round(w, 6)) for k, n, w in T.read_model(T.write_model([r["w"] for r in rows]))], "feature int, name string, w double")


@query("read_signal_bed", VAR + f"SELECT {CHROM} AS chrom, pos AS start, pos AS \"end\", id AS name, 's' || sample AS sample, CAST(g AS DOUBLE) AS v FROM g")
def _(s, d):
    own = _variants(s, d).select(F.concat_ws("\t", "chrom", F.col("pos") - 1, "pos", "id", F.array_join(F.transform("g", lambda x: x.cast("string")), "\t")).alias("value"))
    head = s.createDataFrame([("\t".join(["#CHROM", "START", "END", "NAME", *SAMPLES]),)], "value string")
    path = E.scratch(s, "signal")
    head.unionAll(own).write.text(path)
    return T.signal_bed(s, path)


@query("signal_without_duplicates", VAR + "SELECT id, sample, min(copy) AS copy FROM (SELECT id, sample, CAST(t.c AS INT) AS copy FROM g, range(2) t(c)) GROUP BY 1, 2")
def _(s, d):
    long = G.long_form(_variants(s, d), ["id"]).select("id", F.col("subject_idx").alias("sample"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return A.without_duplicate_samples(long)


@query("prune_below", "SELECT c_custkey FROM customer WHERE c_acctbal >= 9000 OR c_nationkey >= 20")
def _(s, d):
    return A.prune_below(_t(s, d, "customer"), {"c_acctbal": 9000, "c_nationkey": 20}).select("c_custkey")


@query("read_text_matrix", "SELECT CAST(k AS INT) AS \"row\", CAST(j AS INT) AS col, CASE j WHEN 0 THEN CAST(c_nationkey AS DOUBLE) ELSE round(c_acctbal, 2) END AS v FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer), range(2) t(j)")
def _(s, d):
    """Row numbers follow the lines."""
    own = _t(s, d, "customer").orderBy("c_custkey").select("c_nationkey", F.round("c_acctbal", 2).alias("b"))
    return T.text_matrix(s, _written(own, "c_nationkey", "b")).withColumn("v", F.round("v", 2))


@query("binary_matrix", "SELECT CAST(n_nationkey AS INT) AS \"row\", CAST(j AS INT) AS col, CAST(n_regionkey + j AS DOUBLE) AS v FROM nation, range(3) t(j)")
def _(s, d):
    cells = _t(s, d, "nation").select(F.col("n_nationkey").alias("row"), F.posexplode(F.array(*[(F.col("n_regionkey") + j).cast("double") for j in range(3)])).alias("col", "v"))
    path = E.scratch(s, "binary")
    T.write_binary_matrix(cells, 25, 3, path)
    return T.binary_matrix(s, path).select("row", F.posexplode("v").alias("col", "v"))


@query("read_binary_signal", IV + "SELECT chrom, s AS pos, CAST(count(*) AS DOUBLE) AS v FROM a GROUP BY 1, 2")
def _(s, d):
    """Runs of a track in bytes: int32 start and end, float64 value."""
    runs = _intervals(s, d, 1).groupBy("chrom", F.col("start").alias("start")).agg(F.count(F.lit(1)).cast("double").alias("v")).withColumn("end", F.col("start"))
    path = E.scratch(s, "signal")
    T.write_binary_runs(runs, path)
    return T.binary_runs(s, path).select("chrom", F.col("start").alias("pos"), "v")


# ---- reads: orders on seven chromosomes ----

READS = """WITH rd AS (SELECT o_orderkey AS k, 'q' || o_orderkey AS read_id, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 4 WHEN o_orderkey % 2 = 0 THEN 16 ELSE 0 END AS INT) AS flag, 'c' || o_custkey % 7 AS chrom, CAST(o_orderkey % 5000 + 1 AS INT) AS pos, CAST(o_custkey % 9 + 2 AS INT) AS n, CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand FROM orders) """


def _orders(s, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = (c % 9 + 2).cast("int")
    flag = F.when(k % 7 == 0, 4).when(k % 2 == 0, 16).otherwise(0)
    return _t(s, d, "orders").select(k.alias("k"), F.concat(F.lit("q"), k).alias("read_id"), flag.alias("flag"), F.concat(F.lit("c"), c % 7).alias("chrom"), (k % 5000 + 1).cast("int").alias("pos"), n.alias("n"), F.when(k % 2 == 0, "-").otherwise("+").alias("strand"), F.substring(F.lit("ACGT" * 6), F.lit(1), 2 * n).alias("seq"))


def _sam(s, d) -> DataFrame:
    """n matches, two deletions, n matches."""
    cigar = F.concat("n", F.lit("M2D"), "n", F.lit("M"))
    own = _orders(s, d).select(F.concat_ws("\t", "read_id", "flag", "chrom", "pos", F.lit("60"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*")).alias("value"))
    path = E.scratch(s, "sam")
    s.createDataFrame([("@HD\tVN:1.6",)], "value string").unionAll(own).write.text(path)
    return T.sam(s, path)


@query("read_sam", READS + "SELECT read_id, flag, chrom, pos, n || 'M2D' || n || 'M' AS cigar, strand FROM rd WHERE flag <> 4")
def _(s, d):
    return _sam(s, d).select("read_id", "flag", "chrom", "pos", "cigar", "strand")


@query("read_fragments", READS + 'SELECT read_id, pos AS start, pos + n - 1 AS "end" FROM rd WHERE flag <> 4 UNION ALL SELECT read_id, pos + n + 2, pos + 2 * n + 1 FROM rd WHERE flag <> 4')
def _(s, d):
    return R.fragments(_sam(s, d)).select("read_id", "start", "end")


DEPTH = READS + ", b AS (SELECT chrom, pos AS s, pos + n - 1 AS e FROM rd WHERE flag <> 4 UNION ALL SELECT chrom, pos + n + 2, pos + 2 * n + 1 FROM rd WHERE flag <> 4), p AS (SELECT chrom, unnest(range(s, e + 1)) AS pos FROM b) "


@query("read_coverage", DEPTH + "SELECT chrom, CAST(pos AS BIGINT) AS pos, count(*) AS depth FROM p GROUP BY 1, 2")
def _(s, d):
    runs = R.coverage(_sam(s, d))
    return runs.select("chrom", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long"))).alias("pos"), F.col("depth").cast("long").alias("depth"))


@query("read_pileup", READS + ", cells AS (SELECT chrom, pos, n, unnest(range(2 * n)) AS i FROM rd WHERE flag <> 4), x AS (SELECT chrom, CAST(pos + i + CASE WHEN i < n THEN 0 ELSE 2 END AS INT) AS pos, substr('ACGT', i % 4 + 1, 1) AS b FROM cells) SELECT chrom, pos, count(*) FILTER (WHERE b = 'A') AS a, count(*) FILTER (WHERE b = 'C') AS c, count(*) FILTER (WHERE b = 'G') AS g, count(*) FILTER (WHERE b = 'T') AS t, CAST(0 AS BIGINT) AS n, count(*) AS total FROM x GROUP BY 1, 2".replace("i % 4", "CAST(i % 4 AS INT)"))
def _(s, d):
    return R.pileup(_sam(s, d))


@query("read_flags", READS + "SELECT strand, count(*) AS n FROM rd WHERE flag <> 4 GROUP BY 1")
def _(s, d):
    return R.flagged(_orders(s, d).drop("strand")).groupBy("strand").agg(F.count(F.lit(1)).alias("n"))


SIMPLE = READS + "SELECT {id} AS read_id, chrom, pos, {n} || 'M' AS cigar, strand FROM rd"


@query("read_tag_align", SIMPLE.format(id="'.'", n="n"))
def _(s, d):
    return T.tag_align(s, _written(_orders(s, d), "chrom", F.col("pos") - 1, F.col("pos") - 1 + F.col("n"), "seq", F.lit("0"), "strand"))


@query("read_bowtie", SIMPLE.format(id="read_id", n="2 * n"))
def _(s, d):
    return T.bowtie(s, _written(_orders(s, d), "read_id", "strand", "chrom", F.col("pos") - 1, "seq", F.lit("I")))


@query("read_eland", SIMPLE.format(id="read_id", n="2 * n") + " WHERE flag <> 4")
def _(s, d):
    code = F.when(F.col("flag") == 4, "NM").otherwise("U0")
    return T.eland(s, _written(_orders(s, d), "read_id", "seq", code, F.lit("1"), F.lit("0"), F.lit("0"), F.concat("chrom", F.lit(".fa")), "pos", F.when(F.col("strand") == "+", "F").otherwise("R")))


@query("read_bed_reads", SIMPLE.format(id="'.'", n="n"))
def _(s, d):
    return T.bed_reads(s, _written(_orders(s, d), "chrom", F.col("pos") - 1, F.col("pos") - 1 + F.col("n"), "strand"), 4)


@query("cigar_spans", READS + 'SELECT k, CAST(2 * n + 2 AS INT) AS on_reference, CAST(2 * n AS INT) AS on_read FROM rd')
def _(s, d):
    cigar = F.concat("n", F.lit("M2D"), "n", F.lit("M"))
    return _orders(s, d).select("k", S.cigar_span(cigar).alias("on_reference"), S.cigar_span(cigar, read=True).alias("on_read"))


# ---- sequences: the letters of pages as bases, a contig a page ----

BASES = ("bdefhijklmnopqrsuvwxyz0123456789", "AACCGGTTAACCGGTTAACCGGAACCGGTTAA")
LETTER = "translate(upper(regexp_replace(lower(coalesce(html, '')), '[^a-z0-9]', '', 'g')), upper('{0}'), '{1}')".format(*BASES)
SEQ = f"WITH c AS (SELECT page_id, 'p' || page_id AS chrom, {LETTER} AS seq FROM pages) "


def _contigs(s, d) -> DataFrame:
    letters = F.translate(F.upper(F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), "[^a-z0-9]", "")), BASES[0].upper(), BASES[1])
    own = _t(s, d, "pages").select("page_id", letters.alias("seq"))
    path = E.scratch(s, "fasta")
    lines = F.array_join(F.regexp_extract_all("seq", F.lit("(.{1,60})"), F.lit(1)), "\n")
    own.select(F.concat(F.lit(">p"), "page_id", F.lit(" page\n"), lines).alias("value")).write.text(path)
    return T.fasta(s, path)


@query("read_fasta", SEQ + "SELECT chrom, CAST(length(seq) AS BIGINT) AS length, md5(seq) AS digest FROM c WHERE seq <> ''")
def _(s, d):
    own = _contigs(s, d).groupBy("chrom").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return own.select("chrom", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("digest"))


@query("sequence_composition", SEQ + "SELECT chrom, b AS base, CAST(length(seq) - length(replace(seq, b, '')) AS BIGINT) AS n FROM c, (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) x(b) WHERE seq <> ''")
def _(s, d):
    return Q.composition(_contigs(s, d)).withColumn("n", F.col("n").cast("long"))


@query("sequence_regions", SEQ + "SELECT chrom, CASE WHEN page_id % 2 = 0 THEN substr(seq, 41, 100) ELSE reverse(translate(substr(seq, 41, 100), 'ACGT', 'TGCA')) END AS seq FROM c WHERE length(seq) > 40")
def _(s, d):
    """100 bases across lines, complemented on the minus strand."""
    regions = _t(s, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("chrom"), F.lit(41).alias("start"), F.lit(140).alias("end"), F.when(F.col("page_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    return Q.extracted(_contigs(s, d), regions, "chrom")


CODE = "SELECT i, c FROM (SELECT CAST(i AS INT) AS i, substr('ACGT', CAST(i // 16 AS INT) + 1, 1) || substr('ACGT', CAST(i // 4 % 4 AS INT) + 1, 1) || substr('ACGT', CAST(i % 4 AS INT) + 1, 1) AS c FROM range(64) t(i))"


@query("codons", f"WITH c AS ({CODE}) SELECT i, c AS codon, substr('KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF', i + 1, 1) AS amino FROM c")
def _(s, d):
    i = F.col("id").cast("int")
    base = lambda n: F.substring(F.lit("ACGT"), n.cast("int") + 1, F.lit(1))
    own = s.range(64).select(i.alias("i"), F.concat(base(F.floor(i / 16)), base(F.floor(i / 4) % 4), base(i % 4)).alias("codon"))
    return own.select("i", "codon", S.codon_amino(F.col("codon")).alias("amino"))


@query("proteins", SEQ + "SELECT chrom, CAST(length(seq) // 3 AS INT) AS n, CASE substr(seq, 1, 2) WHEN 'CC' THEN 'P' WHEN 'GG' THEN 'G' WHEN 'AC' THEN 'T' WHEN 'GC' THEN 'A' WHEN 'GT' THEN 'V' WHEN 'CG' THEN 'R' WHEN 'CT' THEN 'L' WHEN 'TC' THEN 'S' END AS first FROM c WHERE length(seq) > 5")
def _(s, d):
    """Length and, where two bases decide, the first amino acid of the first hundred codons."""
    own = _contigs(s, d).where("start = 1").select("chrom", "seq")
    whole = _contigs(s, d).groupBy("chrom").agg(F.sum(F.length("seq")).alias("l")).where("l > 5")
    sure = F.substring("seq", 1, 2).isin("CC", "GG", "AC", "GC", "GT", "CG", "CT", "TC")
    first = F.substring(S.translate_protein(F.substring("seq", 1, 300)), 1, 1)
    return own.join(whole, "chrom").select("chrom", F.floor(F.col("l") / 3).cast("int").alias("n"), F.when(sure, first).alias("first"))


@query("nucleotide_numbers", SEQ + "SELECT chrom, CAST(instr('ACGT', substr(seq, 1, 1)) - 1 AS INT) AS number, substr(seq, 1, 1) AS base, (substr(seq, 1, 1) || substr(seq, 2, 1)) IN ('AT', 'TA', 'CG', 'GC', 'GT', 'TG') AS pair FROM c WHERE length(seq) > 1")
def _(s, d):
    a, b = F.substring("seq", 1, 1), F.substring("seq", 2, 1)
    own = _contigs(s, d).where("start = 1 AND length(seq) > 1")
    return own.select("chrom", S.nuc_number(a).alias("number"), S.number_nuc(S.nuc_number(a)).alias("base"), S.rna_pairs(a, b).alias("pair"))


# ---- exchange and streams ----


@query("exchange_round_trip", "SELECT s_suppkey, s_name, CAST(s_nationkey % 3 AS INT) AS site FROM supplier")
def _(s, d):
    """Three sites upload, each once; all is there, and is read by its manifests."""
    folder = E.scratch(s, "exchange")
    own = _t(s, d, "supplier").select("s_suppkey", "s_name", (F.col("s_nationkey") % 3).cast("int").alias("site"))
    names = [f"rows_site_{k}" for k in range(3)]
    for k, n in enumerate(names):
        E.upload(own.where(F.col("site") == k), folder, n)
    E.wait(s, folder, names, 60)
    parts = [E.download(s, folder, n) for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("exchange_sizes", "SELECT 'rows_site_' || k AS name, true AS sized FROM range(3) t(k)")
def _(s, d):
    folder = E.scratch(s, "exchange")
    own = _t(s, d, "supplier")
    for k in range(3):
        E.upload(own.where(F.col("s_nationkey") % 3 == k), folder, f"rows_site_{k}")
    return E.uploaded(s, folder).select("name", (F.col("size") > 0).alias("sized"))


STORED = IV + "SELECT id, chrom, s AS start, e AS \"end\" FROM iv WHERE "


@query("store_scan", STORED + "(chrom = 'NATION_1' AND s <= 90000 AND e >= 80000) OR (chrom = 'NATION_7' AND s <= 90000 AND e >= 80000) OR (chrom = 'NATION_2' AND s <= 1000000 AND e >= 150000) OR (chrom = 'NATION_11' AND s <= 1000000 AND e >= 150000)")
def _(s, d):
    """Four regions of a store of all line items."""
    from siteweave.sources import store

    store.write(_intervals(s, d, None), path := E.scratch(s, "store"))
    return store.scan(s, path, [("NATION_1", 80000, 90000), ("NATION_7", 80000, 90000), ("NATION_2", 150000, 1000000), ("NATION_11", 150000, 1000000)]).select("id", "chrom", "start", "end")


@query("store_within", IV + "SELECT DISTINCT b.id AS id FROM " + AB)
def _(s, d):
    """What of a store of one side overlaps the other side."""
    from siteweave.sources import store

    store.write(_intervals(s, d, 0), path := E.scratch(s, "store"))
    return store.within(s, path, _intervals(s, d, 1)).select("id")


def _streamed(df: DataFrame) -> DataFrame:
    """A stream of the rows of df, from files."""
    path = E.scratch(df.sparkSession, "source")
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _ran(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives, run to its end."""
    s, out = stream.sparkSession, E.scratch(stream.sparkSession, "sink")
    write = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/rows/batch={k}" if mode == "append" else f"{out}/rows")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = s.read.schema(stream.schema).parquet(f"{out}/rows")
    return got.select(*stream.columns)


@query("overlaps_streamed", IV + "SELECT a.id AS a, b.id AS b, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS l_overlap FROM " + AB)
def _(s, d):
    from siteweave.streaming.gate import overlaps_streamed

    # the stream brings places with their regions; the sink holds the places that met, and pairs are made of what is read
    # from it, dealt by position into tasks whose pairs are of few regions
    found = overlaps_streamed(_streamed(I.placed(_intervals(s, d, 1))), I.placed(_intervals(s, d, 0)), LONGEST)
    met = _ran(found.select("a.chrom", "a.start", F.col("a.items.id").alias("a"), F.col("b.items.id").alias("b"), "l_overlap"))
    met = met.repartition(_tasks(s, d), "chrom", F.shiftright("start", I.LOWEST)).sortWithinPartitions("chrom", "start")
    return I.apart(met.select("a", "b", "l_overlap"), ["a"], ["b"])


@query("ready_groups", "SELECT CAST(o_custkey % 50 AS VARCHAR) AS \"group\" FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 5")
def _(s, d):
    """Groups for which all five sites (priorities) have sent something."""
    from siteweave.streaming.gate import ready_groups

    own = _t(s, d, "orders").select(F.concat_ws("|", (F.col("o_custkey") % 50).cast("string"), "o_orderpriority").alias("name"), F.lit(1).cast("long").alias("size"))
    return _ran(ready_groups(_streamed(own), F.split("name", r"\|")[0], 5).select("group"))


# ---- scalar functions ----


@query("logit", "SELECT c_custkey, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT c_custkey, (c_custkey % 99 + 1) / CAST(100 AS DOUBLE) AS p FROM customer)")
def _(s, d):
    return _t(s, d, "customer").select("c_custkey", F.round(S.logit((F.col("c_custkey") % 99 + 1) / 100), 6).alias("logit"))


@query("gamma_functions", "SELECT c_custkey, round(1 - exp(-z), 6) AS one, round(1 - (1 + z) * exp(-z), 6) AS two, abs(s - 1) < 0.01 AS near FROM (SELECT c_custkey, (c_custkey % 90 + 1) / CAST(10 AS DOUBLE) AS z, CAST(1 AS DOUBLE) AS s FROM customer)")
def _(s, d):
    """The lower gamma function for 1 and 2, and Spouge's approximation against the factorial."""
    z = (F.col("c_custkey") % 90 + 1) / 10.0
    n = F.col("c_custkey") % 8 + 2
    near = F.abs(S.gamma_spouge(n.cast("double")) / F.factorial((n - 1).cast("int")) - 1) < 0.01
    return _t(s, d, "customer").select("c_custkey", F.round(S.lower_gamma(F.lit(1.0), z), 6).alias("one"), F.round(S.lower_gamma(F.lit(2.0), z), 6).alias("two"), near.alias("near"))


@query("chisq_dof", "SELECT c_custkey, round(exp(-x / 2), 6) AS two, round(exp(-x / 2) * (1 + x / 2), 6) AS four FROM (SELECT c_custkey, (c_custkey % 300 + 1) / CAST(10 AS DOUBLE) AS x FROM customer)")
def _(s, d):
    x = (F.col("c_custkey") % 300 + 1) / 10.0
    return _t(s, d, "customer").select("c_custkey", F.round(S.chi2_sf(x, 2), 6).alias("two"), F.round(S.chi2_sf(x, 4), 6).alias("four"))


@query("log_domain_all", "SELECT c_custkey, round(CASE WHEN x > 0 THEN ln(x) ELSE -1073741824.0 END, 6) AS l, round(CASE WHEN a > b THEN ln(exp(a) - exp(b)) WHEN a = b THEN -1073741824.0 END, 6) AS d, round(a - b, 6) AS q, round(a * 3, 6) AS p, greatest(a, b) AS m, round(exp(a), 6) AS e FROM (SELECT c_custkey, c_acctbal AS x, c_custkey % 10 / CAST(4 AS DOUBLE) AS a, c_custkey % 7 / CAST(4 AS DOUBLE) AS b FROM customer)")
def _(s, d):
    a, b = (F.col("c_custkey") % 10) / 4, (F.col("c_custkey") % 7) / 4
    named = {"l": S.xlog(F.col("c_acctbal")), "d": S.xlog_sub(a, b), "q": S.xlog_div(a, b), "p": S.xlog_pow(a, F.lit(3.0)), "m": S.xlog_max(a, b), "e": S.xexp(a)}
    return _t(s, d, "customer").select("c_custkey", *[(F.round(c, 6) if n != "m" else c).alias(n) for n, c in named.items()])


@query("coordinates", REGS + "SELECT id, s - 1 AS bed_start, e AS bed_end, s AS sam_start FROM regs")
def _(s, d):
    own = _regs(s, d)
    return own.select("id", S.translate_start(F.col("start"), "INTERNAL", "BED").alias("bed_start"), S.translate_end(F.col("end"), "INTERNAL", "BED").alias("bed_end"), S.translate_start(S.translate_start(F.col("start"), "INTERNAL", "BED"), "BED", "SAM").alias("sam_start"))


@query("chrom_names", "SELECT p_partkey, regexp_replace(p_brand || ' ' || p_size, '[^A-Za-z0-9_.-]', '_', 'g') AS chrom FROM part")
def _(s, d):
    return _t(s, d, "part").select("p_partkey", S.normalise_chrom(F.concat(F.lit("chr"), "p_brand", F.lit(" "), "p_size")).alias("chrom"))


@query("string_tests", "SELECT p_partkey, CAST(len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS INT) AS parts, true AS number, false AS word, CAST(p_size AS BIGINT) AS hex, p_size % 2 = 0 AS balanced FROM part")
def _(s, d):
    size = F.col("p_size")
    brackets = F.when(size % 2 == 0, "(a(b)c)").otherwise("a)(b")
    return _t(s, d, "part").select("p_partkey", F.size(S.tokens_by_string(F.col("p_type"), " ")).alias("parts"), S.is_number(F.col("p_retailprice").cast("string")).alias("number"), S.is_number(F.col("p_name")).alias("word"), S.number_in_base(F.hex(size), 16).alias("hex"), S.balanced(brackets).alias("balanced"))


# ---- lists ----


@query("first_of_list", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 25")
def _(s, d):
    """The first k, which is the feature."""
    from siteweave.operators.tables import first_n

    return first_n(_t(s, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 25)


@query("permuted_list", "SELECT c_custkey FROM customer")
def _(s, d):
    from siteweave.operators.tables import permuted

    return permuted(_t(s, d, "customer").select("c_custkey"), 7)


@query("interleaved_lists", "SELECT s_suppkey AS pos, s_name AS name FROM supplier UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    from siteweave.operators.tables import interleave

    a = _t(s, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"))
    return interleave(a, _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name")), "pos")


@query("distinct_values", "SELECT DISTINCT c_mktsegment FROM customer")
def _(s, d):
    return A.distinct_values(_t(s, d, "customer"), "c_mktsegment")


@query("merged_histograms", "SELECT event_type AS a, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    own = _t(s, d, "events").select("event_id", "event_type")
    parts = [A.histogram(own.where(F.col("event_id") % 3 == k), [F.col("event_type")], ["a"]) for k in range(3)]
    return A.merged_histograms(parts, ["a"])


@query(
    "greedy_apart",
    """WITH RECURSIVE it AS (SELECT 'n' || o_custkey % 5 AS chrom, CAST(o_orderkey AS INT) * 10 AS s, max(o_totalprice) AS score FROM orders GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY chrom, w ORDER BY CASE WHEN w = 'top' THEN -score ELSE score END, s) AS k FROM it, (VALUES ('top'), ('bottom')) x(w)),
g AS (SELECT DISTINCT chrom, w, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS taken FROM o
UNION ALL SELECT g.chrom, g.w, o.k, CASE WHEN len(list_filter(g.taken, lambda t: abs(t - o.s) <= 205)) = 0 THEN list_append(g.taken, o.s) ELSE g.taken END FROM g JOIN o ON o.chrom = g.chrom AND o.w = g.w AND o.k = g.k + 1 WHERE len(g.taken) < 4)
SELECT chrom, w AS which, unnest(max_by(taken, k)) AS start FROM g GROUP BY 1, 2""",
)
def _(s, d):
    """The four best and worst orders of a group, over 200 positions apart."""
    own = _t(s, d, "orders").groupBy(F.concat(F.lit("n"), F.col("o_custkey") % 5).alias("chrom"), (F.col("o_orderkey").cast("int") * 10).alias("start")).agg(F.max("o_totalprice").alias("score"))
    own = own.withColumn("end", F.col("start") + 5).select("chrom", "start", "end", "score")
    return I.greedy_apart(own, 4, 200).select("chrom", "which", "start")


SMOOTH = "(SELECT n_name AS chrom, CAST(l_partkey % 200 + 1 AS INT) AS pos, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"


@query("collaborative_inverse", "SELECT CAST(i AS INT) AS \"row\", CAST(j AS INT) AS col, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM range(8) a(i), range(8) b(j)")
def _(s, d):
    """The inverse under a mask, times the matrix."""
    from siteweave.operators import matrix as M
    from siteweave.operators import shares as H
    from siteweave.plans.catalog import _a

    m = _a(s, d).add(M.constant_diagonal(s, 8, 8, 1e6))
    product = m.matmul(H.collaborative_inverse(m))
    return product.dense().df.select("row", "col", (F.round("v", 5) + 0.0).alias("v"))


@query("simulated_model", "SELECT CAST(2000 AS BIGINT) AS n, CAST(3 AS BIGINT) AS sites, true AS binary, true AS near")
def _(s, d):
    """Data of a known model: the fit comes near its weights."""
    from siteweave.operators import models as L

    data, beta = L.simulated(s, 2000, 3, seed=5)
    own = data.cache()
    fit = L.irls(own, 8, 0.0)
    near = max(abs(a - b) for a, b in zip(fit.beta, beta, strict=True)) < 0.6
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("site").alias("sites"), F.bool_and(F.col("y").isin(0.0, 1.0)).alias("binary")).withColumn("near", F.lit(near))


@query("smooth_logs", f"SELECT chrom, pos, round(ln(0.5 * v + 0.125 * (sum(v) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - v)), 5) AS v FROM {SMOOTH}")
def _(s, d):
    """Values as logarithms."""
    from siteweave.plans.catalog import _track

    return A.smoothed_logs(_track(s, d).withColumn("v", F.ln("v")), ["chrom"], "pos", "v", 2, 0.5).select("chrom", "pos", _r("v", 5))


POWERS = f"(SELECT chrom, CAST(floor(ln(CAST(pos AS DOUBLE)) / ln(CAST(1.5 AS DOUBLE)) + 1e-9) AS INT) AS bin, sum(v) AS v FROM {SMOOTH} GROUP BY 1, 2)"


@query("smooth_by_powers", f"SELECT chrom, bin, round(0.6 * v + 0.2 * (sum(v) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - v), 5) AS v FROM {POWERS}")
def _(s, d):
    """Over bins that grow by powers of 1.5."""
    from siteweave.plans.catalog import _track

    own = _track(s, d).select("chrom", (F.col("pos") - 1).alias("at"), "v")
    return A.smoothed_by_powers(own, ["chrom"], "at", "v", 1.5, 1, 0.6).select("chrom", "bin", _r("v", 5))


@query("smooth_logs_by_powers", f"SELECT chrom, bin, round(ln(0.6 * v + 0.2 * (sum(v) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - v)), 5) AS v FROM {POWERS}")
def _(s, d):
    from siteweave.plans.catalog import _track

    own = _track(s, d).select("chrom", (F.col("pos") - 1).alias("at"), F.ln("v").alias("v"))
    return A.smoothed_by_powers(own, ["chrom"], "at", "v", 1.5, 1, 0.6, logs=True).select("chrom", "bin", _r("v", 5))


@query("track_bins_at_borders", f"SELECT CAST(i AS INT) AS region, CAST((pos - i * 50 - 1) // 20 AS INT) AS bin, sum(v) AS total, count(*) AS n FROM {SMOOTH}, range(4) t(i) WHERE pos BETWEEN i * 50 + 1 AND i * 50 + 50 GROUP BY 1, 2")
def _(s, d):
    """Bins of 20 positions that begin anew every 50."""
    from siteweave.plans.catalog import _track

    borders = s.range(4).crossJoin(_t(s, d, "nation").select(F.col("n_name").alias("chrom"))).select(F.col("id").cast("int").alias("region"), "chrom", (F.col("id") * 50 + 1).cast("int").alias("start"), (F.col("id") * 50 + 50).cast("int").alias("end"))  # four regions a nation
    return A.bin_totals(_track(s, d), 20, borders)


COHORTS = "WITH g AS (SELECT CAST(l_partkey % 40 AS INT) AS v, l_linenumber % 3 AS cohort, CAST(l_suppkey % 4 AS INT) AS s, CAST(least(2, count(*)) AS INT) AS g FROM lineitem WHERE l_partkey % 40 % 3 <> l_linenumber % 3 GROUP BY 1, 2, 3) "


@query("cohort_merge_list", COHORTS + "SELECT CAST(v.v AS INT) AS var_idx, CAST(c.c * 4 + s.s AS INT) AS place, CAST(coalesce(g.g, 0) AS INT) AS g FROM (SELECT DISTINCT v FROM g) v, range(3) c(c), range(4) s(s) LEFT JOIN g ON g.v = v.v AND g.cohort = c.c AND g.s = s.s")
def _(s, d):
    """Three cohorts of four samples, each without a third of the variants."""
    part, line = F.col("l_partkey") % 40, F.col("l_linenumber") % 3
    own = _t(s, d, "lineitem").where(part % 3 != line).groupBy(part.cast("int").alias("var_idx"), line.alias("cohort"), (F.col("l_suppkey") % 4).cast("int").alias("s")).agg(F.least(F.lit(2), F.count(F.lit(1))).cast("int").alias("g"))
    wide = own.groupBy("var_idx", "cohort").pivot("s", [0, 1, 2, 3]).agg(F.first("g")).select("var_idx", "cohort", F.array(*[F.coalesce(F.col(str(k)), F.lit(0)) for k in range(4)]).alias("g"))
    parts = [wide.where(F.col("cohort") == k).drop("cohort") for k in range(3)]
    return G.merge_cohort_list(parts, [4, 4, 4], ["var_idx"]).select("var_idx", F.posexplode("g").alias("place", "g"))


@query("weights_by_scaled_inverse", "SELECT * FROM (SELECT 0 AS feature, round((d * u - b * w) / (a * d - b * b), 6) AS beta FROM (SELECT sum(CAST(0.25 AS DOUBLE)) a, sum(0.25 * z) b, sum(0.25 * z * z) d, sum(y - 0.5) u, sum(z * (y - 0.5)) w FROM (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(1 AS DOUBLE) ELSE 0 END AS y, c_acctbal / 10000 AS z FROM customer)) UNION ALL SELECT 1, round((a * w - b * u) / (a * d - b * b), 6) FROM (SELECT sum(CAST(0.25 AS DOUBLE)) a, sum(0.25 * z) b, sum(0.25 * z * z) d, sum(y - 0.5) u, sum(z * (y - 0.5)) w FROM (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(1 AS DOUBLE) ELSE 0 END AS y, c_acctbal / 10000 AS z FROM customer)))")
def _(s, d):
    """A step of the null model whose inverse travels scaled and padded."""
    import numpy as np

    from siteweave.operators import models as L
    from siteweave.plans.catalog import _subjects

    r = L.irls_moments(_subjects(s, d), [0.0, 0.0], by=[]).first()
    z = L.eliminated(np.array([[r["xtwx_0_0"], r["xtwx_0_1"]], [r["xtwx_0_1"], r["xtwx_1_1"]]]))
    beta = L.scaled_inverse(z, np.array([r["xtwz_0"], r["xtwz_1"]]))
    return s.createDataFrame([(k, round(float(b), 6)) for k, b in enumerate(beta)], "feature int, beta double")


@query("track_bins_by_region", f"SELECT CAST(i AS INT) AS region, sum(v) AS total, count(*) AS n FROM {SMOOTH}, range(4) t(i) WHERE pos BETWEEN i * 50 + 1 AND i * 50 + 50 GROUP BY i")
def _(s, d):
    """Totals by region, of all chromosomes together."""
    from siteweave.plans.catalog import _track

    regions = s.range(4).select(F.col("id").cast("int").alias("region"), F.lit("all").alias("chrom"), (F.col("id") * 50 + 1).cast("int").alias("start"), (F.col("id") * 50 + 50).cast("int").alias("end"))
    return A.region_totals(_track(s, d).withColumn("chrom", F.lit("all")), regions, "region").select("region", _r("total", 4), "n")


@query("meta_by_summary_files", GENO + META + "SELECT CAST(v AS VARCHAR) AS var_idx, round(s / t, 4) AS chisq FROM res")
def _(s, d):
    """Each site writes a file of summary statistics; scores and variances are pooled, squared and compared under noise, by the steps' names."""
    from siteweave.operators import models as L
    from siteweave.plans.catalog import _geno, _subjects
    from siteweave.plans.commands import run

    subj = _subjects(s, d).withColumn("x", F.array(F.lit(1.0)))
    means = subj.groupBy("site").agg(F.avg("y").alias("mu"))
    own = L.meta_site_stats(_geno(s, d), subj.join(means, "site"), 1)
    fields = [F.col("var_idx").cast("string"), F.lit("A"), F.lit("C"), F.lit("."), F.lit("."), F.col("score").cast("string"), F.col("var").cast("string")]
    files, shared = E.scratch(s, "summaries"), E.scratch(s, "meta")
    own.select("site", F.concat_ws("\t", *fields).alias("value")).write.partitionBy("site").text(files)  # a folder a site, in one pass
    sites = range(3)
    for k in sites:
        run(s, "meta_encrypt_save_ST_stats", str(k), "3", f"{files}/site={k}", shared)
    for option in ("meta_pool_per_site_ST_stats_add_noise", "meta_pool_noisy_ST_stats", "meta_collaborative_decrypt_pooled_noisy_ST_stats"):
        for k in sites:
            run(s, option, str(k), "3", shared)
    return run(s, "meta_pool_partially_decrypted_pooled_noisy_ST_stats", "0", "3", shared).select("var_idx", F.round("chisq", 4).alias("chisq"))
