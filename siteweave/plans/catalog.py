"""The registered queries of the engine, each with SQL for the same rows.

Inputs are derived from the driver's tables: matrices from line items, intervals from orders, genotypes from purchases,
sites from nations, tracks and states from events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions import scalar as S
from siteweave.operators import genotypes as G
from siteweave.operators import intervals as I
from siteweave.operators import matrix as M
from siteweave.operators import models as L
from siteweave.operators import shares as E
from siteweave.operators import stats as A
from siteweave.operators import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = " ".join(sql.split())
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: str, places: int = 6) -> Column:
    return F.round(F.col(c), places).alias(c)


# ---- matrices: 8 x 8 sums of quantities (A, whole numbers) and of parts (B) ----

A_SQL = "SELECT CAST(l_orderkey % 8 AS INT) AS r, CAST(l_partkey % 8 AS INT) AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
B_SQL = "SELECT CAST(l_partkey % 8 AS INT) AS r, CAST(l_suppkey % 8 AS INT) AS c, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2"
AB = f"WITH a AS ({A_SQL}), b AS ({B_SQL}) "
D_SQL = "SELECT r, v FROM b WHERE r = c"


def _a(spark: SparkSession, d: str) -> M.Matrix:
    own = _t(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 8).cast("int").alias("row"), (F.col("l_partkey") % 8).cast("int").alias("col")).agg(F.sum("l_quantity").alias("v"))
    return M.Matrix(own, 8, 8)


def _b(spark: SparkSession, d: str) -> M.Matrix:
    own = _t(spark, d, "lineitem").groupBy((F.col("l_partkey") % 8).cast("int").alias("row"), (F.col("l_suppkey") % 8).cast("int").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return M.Matrix(own, 8, 8)


def _cells(m: M.Matrix, places: int = 6) -> DataFrame:
    return m.df.select("row", "col", _r("v", places))


def _matrix_query(name: str, build, sql: str, places: int = 6) -> None:
    query(name, f"{AB} {sql}")(lambda s, d: _cells(build(_a(s, d), _b(s, d)), places))


CELL = 'SELECT r AS "row", c AS "col", round({v}, 6) AS v FROM a'
JOINED = 'SELECT a.r AS "row", a.c AS "col", round({v}, 6) AS v FROM a JOIN b ON a.r = b.r AND a.c = b.c'
GRID = 'SELECT CAST(i.i AS INT) AS "row", CAST(j.i AS INT) AS "col", {v} AS v FROM range({n}) i(i), range({m}) j(i)'

_matrix_query("mat_add", lambda a, b: a.add(b), JOINED.format(v="a.v + b.v"))
_matrix_query("mat_sub", lambda a, b: a.sub(b), JOINED.format(v="a.v - b.v"))
_matrix_query("mat_add_list", lambda a, b: M.add_all([a, b, a]), JOINED.format(v="a.v + b.v + a.v"))
_matrix_query("mat_elementwise_mul", lambda a, b: a.mul(b), JOINED.format(v="a.v * b.v"))
_matrix_query("mat_div", lambda a, b: a.div(b), JOINED.format(v="a.v / b.v"))
_matrix_query("mat_scalar", lambda a, b: a.scale(2.5), CELL.format(v="v * CAST(2.5 AS DOUBLE)"))
_matrix_query("mat_transpose", lambda a, b: a.transpose(), 'SELECT c AS "row", r AS "col", round(v, 6) AS v FROM a')
_matrix_query("mat_row2row", lambda a, b: a.row_dot(b), 'SELECT a.r AS "row", 0 AS "col", round(sum(a.v * b.v), 6) AS v FROM a JOIN b ON a.r = b.r AND a.c = b.c GROUP BY 1')
_matrix_query("mat_diag_extract", lambda a, b: a.diagonal(), 'SELECT r AS "row", 0 AS "col", round(v, 6) AS v FROM a WHERE r = c')
_matrix_query("mat_diag_build", lambda a, b: a.diagonal().as_diagonal(), 'SELECT r AS "row", c AS "col", round(v, 6) AS v FROM a WHERE r = c')
_matrix_query("mat_diag_left", lambda a, b: a.scale_rows(b.diagonal()), f'SELECT a.r AS "row", a.c AS "col", round(a.v * d.v, 6) AS v FROM a JOIN ({D_SQL}) d ON a.r = d.r')
_matrix_query("mat_diag_right", lambda a, b: a.scale_cols(b), f'SELECT a.r AS "row", a.c AS "col", round(a.v * d.v, 6) AS v FROM a JOIN ({D_SQL}) d ON a.c = d.r')
_matrix_query("mat_submatrix", lambda a, b: a.submatrix(2, 5, 1, 3), 'SELECT r - 2 AS "row", c - 1 AS "col", round(v, 6) AS v FROM a WHERE r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 3')
_matrix_query("mat_unpad", lambda a, b: a.resize(5, 3), 'SELECT r AS "row", c AS "col", round(v, 6) AS v FROM a WHERE r < 5 AND c < 3')
_matrix_query(
    "mat_pad_pow2",
    lambda a, b: a.resize(5, 3).pad_pow2().dense(),
    'SELECT g."row", g."col", round(coalesce(a.v, 0.0), 6) AS v FROM (' + GRID.format(n=8, m=4, v="0") + ') g LEFT JOIN (SELECT * FROM a WHERE r < 5 AND c < 3) a ON a.r = g."row" AND a.c = g."col"',
)
_matrix_query("mat_pad_rows", lambda a, b: a.resize(5, 3).pad_pow2(cols=False).dense(), 'SELECT g."row", g."col", round(coalesce(a.v, 0.0), 6) AS v FROM (' + GRID.format(n=8, m=3, v="0") + ') g LEFT JOIN (SELECT * FROM a WHERE r < 5 AND c < 3) a ON a.r = g."row" AND a.c = g."col"')
_matrix_query("mat_pad_cols", lambda a, b: a.resize(5, 3).pad_pow2(rows=False).dense(), 'SELECT g."row", g."col", round(coalesce(a.v, 0.0), 6) AS v FROM (' + GRID.format(n=5, m=4, v="0") + ') g LEFT JOIN (SELECT * FROM a WHERE r < 5 AND c < 3) a ON a.r = g."row" AND a.c = g."col"')
_matrix_query("mat_map_log", lambda a, b: a.sub(b.scale(6)).apply("log"), 'SELECT a.r AS "row", a.c AS "col", round(CASE WHEN a.v - 6 * b.v > 0 THEN ln(a.v - 6 * b.v) ELSE 0.0 END, 6) AS v FROM a JOIN b ON a.r = b.r AND a.c = b.c')
_matrix_query("mat_map_exp", lambda a, b: a.scale(-0.001).apply("exp"), CELL.format(v="exp(v * CAST(-0.001 AS DOUBLE))"))
_matrix_query("mat_map_sigmoid", lambda a, b: a.scale(0.0001).apply("sigmoid"), CELL.format(v="1 / (1 + exp(-(v * CAST(0.0001 AS DOUBLE))))"))
_matrix_query("mat_map_inv", lambda a, b: a.apply("inv"), CELL.format(v="CASE WHEN v = 0 THEN 0.0 ELSE 1 / v END"), 6)
_matrix_query("matmul_by_expansion", lambda a, b: M.Matrix(M.multiply_expansions(a.expand_cols(8), b.expand_rows(8)), 8, 8), 'SELECT a.r AS "row", b.c AS "col", round(sum(a.v * b.v), 6) AS v FROM a JOIN b ON a.c = b.r GROUP BY 1, 2')
_matrix_query("mat_vector_transpose", lambda a, b: a.diagonal().transpose_vector(), 'SELECT 0 AS "row", r AS "col", round(v, 6) AS v FROM a WHERE r = c')
_matrix_query(
    "mat_inverse_2x2",
    lambda a, b: a.resize(2, 2).inverse(),
    "SELECT 0 AS \"row\", 0 AS \"col\", 0.0 AS v WHERE false UNION ALL SELECT i, j, round(v, 6) FROM (SELECT max(CASE WHEN r=0 AND c=0 THEN v END) p, max(CASE WHEN r=0 AND c=1 THEN v END) q, max(CASE WHEN r=1 AND c=0 THEN v END) s, max(CASE WHEN r=1 AND c=1 THEN v END) t FROM a) m, LATERAL (VALUES (0,0,t/(p*t-q*s)),(0,1,-q/(p*t-q*s)),(1,0,-s/(p*t-q*s)),(1,1,p/(p*t-q*s))) x(i,j,v)",
)


# ---- products of larger matrices: quantities by supplier and part class (P), items by part class and order class (Q) ----

WIDE = 250
PQ_SQL = f"""WITH a AS (SELECT CAST(l_suppkey % {WIDE} AS INT) AS r, CAST(l_partkey % {WIDE} AS INT) AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT CAST(l_partkey % {WIDE} AS INT) AS r, CAST(l_orderkey % {WIDE} AS INT) AS c, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.r AS "row", b.c AS "col", round(sum(a.v * b.v), 6) AS v FROM a JOIN b ON a.c = b.r GROUP BY 1, 2"""


def _wide(s, d) -> tuple[M.Matrix, M.Matrix]:
    li = _t(s, d, "lineitem")
    key = lambda c, n: (F.col(c) % WIDE).cast("int").alias(n)
    a = li.groupBy(key("l_suppkey", "row"), key("l_partkey", "col")).agg(F.sum("l_quantity").alias("v"))
    b = li.groupBy(key("l_partkey", "row"), key("l_orderkey", "col")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return M.Matrix(a, WIDE, WIDE), M.Matrix(b, WIDE, WIDE)


@query("mat_mul", PQ_SQL)
def _(s, d):
    a, b = _wide(s, d)
    return _cells(a.matmul(b))


@query("mat_mul_blocked", PQ_SQL)
def _(s, d):
    a, b = _wide(s, d)
    return _cells(M.Matrix(a.matmul_blocked(b, 128).df.where("v <> 0"), WIDE, WIDE))


@query("mat_inner", f"{AB} SELECT round(sum(a.v * b.v), 6) AS v FROM a JOIN b ON a.r = b.r WHERE a.r = a.c AND b.r = b.c")
def _(s, d):
    return _a(s, d).diagonal().inner(_b(s, d).diagonal()).select(_r("v"))


@query("mat_dims", "SELECT 8 AS nrow, 8 AS ncol")
def _(s, d):
    return _a(s, d).shape()


@query("mat_const_full", GRID.format(n=5, m=7, v="CAST(2.5 AS DOUBLE)"))
def _(s, d):
    return M.constant(s, 5, 7, 2.5).df


@query("mat_const_diag", 'SELECT CAST(i AS INT) AS "row", CAST(i AS INT) AS "col", CAST(3.0 AS DOUBLE) AS v FROM range(5) t(i)')
def _(s, d):
    return M.constant_diagonal(s, 5, 7, 3.0).df


@query("mat_dump_text", f"{AB} SELECT r AS \"row\", 'Row ' || r || ':' || chr(9) || string_agg(printf('%.4f', v), chr(9) ORDER BY c) AS line FROM a GROUP BY r")
def _(s, d):
    from siteweave.sources.text import dumped

    return dumped(_a(s, d).rows())


@query("mat_random_shape", "SELECT CAST(60 AS BIGINT) AS n, true AS inside")
def _(s, d):
    return M.random_uniform(s, 6, 10).df.agg(F.count(F.lit(1)).alias("n"), ((F.min("v") >= 0) & (F.max("v") < 5)).alias("inside"))


@query("col_expand", f'{AB} SELECT c AS k, r AS "row", CAST(j AS INT) AS "col", round(v, 6) AS v FROM a, range(3) t(j)')
def _(s, d):
    return _a(s, d).expand_cols(3).select("k", "row", "col", _r("v"))


@query("row_expand", f'{AB} SELECT r AS k, CAST(j AS INT) AS "row", c AS "col", round(v, 6) AS v FROM a, range(3) t(j)')
def _(s, d):
    return _a(s, d).expand_rows(3).select("k", "row", "col", _r("v"))


@query("expansion_pool", f'{AB} SELECT r AS k, CAST(j AS INT) AS "row", c AS "col", round(2 * v, 6) AS v FROM a, range(3) t(j)')
def _(s, d):
    x = _a(s, d).expand_rows(3)
    return M.pool_expansions([x, x]).select("k", "row", "col", _r("v"))


# ---- shares ----


@query("share_weights", f'{AB} SELECT CAST(i AS INT) AS site, r AS "row", c AS "col", round(v * (i + 1) / 6, 6) AS share FROM a, range(3) t(i)')
def _(s, d):
    return E.shares(_a(s, d), 3).select("site", "row", "col", _r("share"))


_matrix_query("share_split_pool", lambda a, b: E.pool_shares(E.random_shares(a, 4, 100.0), 8, 8, 4), CELL.format(v="v"), 4)
ORACLE_SQL["share_split_pool"] = " ".join(f"{AB} SELECT r AS \"row\", c AS \"col\", round(v, 4) AS v FROM a".split())
_matrix_query("mask_roundtrip", lambda a, b: a.add(E.mask_of(a, 1000.0)).sub(E.mask_of(a, 1000.0)), 'SELECT r AS "row", c AS "col", round(v, 4) AS v FROM a', 4)
_matrix_query("refresh_roundtrip", lambda a, b: E.encrypted(a).refresh().decrypt(), 'SELECT r AS "row", c AS "col", round(v, 4) AS v FROM a', 4)
_matrix_query("enc_add", lambda a, b: E.encrypted(a).add(E.encrypted(b)).decrypt(), JOINED.format(v="a.v + b.v"))
_matrix_query("enc_sub", lambda a, b: E.encrypted(a).sub(E.encrypted(b)).decrypt(), JOINED.format(v="a.v - b.v"))
_matrix_query("enc_add_list", lambda a, b: E.add_list([E.encrypted(x) for x in (a, b, b)]).decrypt(), JOINED.format(v="a.v + 2 * b.v"))
_matrix_query("enc_elementwise_mul", lambda a, b: E.encrypted(a).mul(E.encrypted(b)).decrypt(), JOINED.format(v="a.v * b.v"))
_matrix_query("enc_row2row", lambda a, b: E.encrypted(a).row_dot(E.encrypted(b)).decrypt(), 'SELECT a.r AS "row", 0 AS "col", round(sum(a.v * b.v), 6) AS v FROM a JOIN b ON a.r = b.r AND a.c = b.c GROUP BY 1')
_matrix_query("enc_matmul_t", lambda a, b: E.encrypted(a).matmul(E.encrypted(b)).decrypt(), 'SELECT a.r AS "row", b.r AS "col", round(sum(a.v * b.v), 6) AS v FROM a JOIN b ON a.c = b.c GROUP BY 1, 2')
_matrix_query("collab_exp", lambda a, b: E.collaborative_exp(a.scale(0.0001), 3), CELL.format(v="exp(v * CAST(0.0001 AS DOUBLE))"))
_matrix_query("collab_divide", lambda a, b: E.collaborative_divide(a, b.row_dot(b)), 'SELECT a.r AS "row", a.c AS "col", round(a.v / w.w, 6) AS v FROM a JOIN (SELECT r, sum(v * v) w FROM b GROUP BY r) w ON a.r = w.r')


@query("pack_slots", f"{AB} SELECT CAST(floor((r * 8 + c) / 16) AS INT) AS ct, CAST(count(*) AS INT) AS n_values, round(sum(v), 4) AS total FROM a GROUP BY 1")
def _(s, d):
    own = E.packed(_a(s, d), E.Params(degree=32))
    return own.select("ct", F.size("values").alias("n_values"), F.round(F.aggregate("values", F.lit(0.0), lambda x, y: x + y), 4).alias("total"))


_matrix_query("pack_roundtrip", lambda a, b: E.unpacked(E.packed(a, E.Params(degree=32)), 8, 8, E.Params(degree=32)), CELL.format(v="v"))


@query("vital_stats_levels", "SELECT 0 AS ct, 64 AS n_values, 5 AS level, 40 AS scale_bits, 16384 AS degree")
def _(s, d):
    return E.encrypted(_a(s, d)).mul(E.encrypted(_b(s, d))).vital_stats()


@query("params_valid", "SELECT 'VALID' AS a, 'INVALID' AS b, 'INVALID' AS c")
def _(s, d):
    return s.createDataFrame([(E.Params().valid(), E.Params(mod_bits=(60, 60)).valid(), E.Params(scale_bits=30).valid())], "a string, b string, c string")


@query("sealed_roundtrip", "SELECT s_suppkey, round(s_acctbal, 4) AS s_acctbal FROM supplier")
def _(s, d):
    own = _t(s, d, "supplier").select("s_suppkey", "s_acctbal")
    return E.unsealed(E.sealed(own, "s_acctbal", "0123456789abcdef"), "s_acctbal", "0123456789abcdef").select("s_suppkey", _r("s_acctbal", 4))


# ---- tables ----

LOOK = "WITH q AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS q_pos, CAST(s_nationkey AS INT) AS k FROM supplier), t AS (SELECT c_custkey AS row_pos, c_nationkey AS k, c_name FROM customer) "


def _lookup(s, d):
    from siteweave.operators.tiles import numbered, parts_of

    own, part = parts_of(_t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("k")), F.col("s_suppkey"))
    q = numbered(own, part, [F.col("s_suppkey")], "q_pos").select(F.col("q_pos").cast("long").alias("q_pos"), "k")
    return q, _t(s, d, "customer").select(F.col("c_custkey").alias("row_pos"), F.col("c_nationkey").alias("k"), "c_name")


@query("lookup_all", LOOK + "SELECT q_pos, q.k AS k, row_pos, c_name FROM q JOIN t ON q.k = t.k")
def _(s, d):
    return T.lookup(*_lookup(s, d), "k").select("q_pos", "k", "row_pos", "c_name")


@query("lookup_first", LOOK + "SELECT q_pos, q.k AS k, min(row_pos) AS row_pos, min_by(c_name, row_pos) AS c_name FROM q JOIN t ON q.k = t.k GROUP BY q_pos, q.k")
def _(s, d):
    return T.lookup(*_lookup(s, d), "k", all_matches=False).select("q_pos", "k", "row_pos", "c_name")


@query("lookup_semi", LOOK + "SELECT row_pos, k, c_name FROM t WHERE k IN (SELECT k FROM q)")
def _(s, d):
    return T.lookup_in_table_order(*_lookup(s, d), "k").select("row_pos", "k", "c_name")


@query("link_first_match", "SELECT n_nationkey, n_name, min(s_suppkey) AS s_suppkey, min_by(s_name, s_suppkey) AS s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1, 2")
def _(s, d):
    right = _t(s, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name")
    return T.link_first(_t(s, d, "nation").select("n_nationkey", "n_name"), right, "n_nationkey", "s_suppkey")


@query("select_by_header", "SELECT p_partkey, p_brand FROM part")
def _(s, d):
    return T.select_by_header(_t(s, d, "part"), ["p_brand", "absent", "p_partkey"])


@query("reorder_cols", "SELECT p_size, p_partkey, '.' AS absent FROM part")
def _(s, d):
    return T.reorder(_t(s, d, "part"), ["p_size", "absent", "p_partkey"])


@query("split_sites_ntile", "SELECT c_custkey, CAST(ntile(3) OVER (ORDER BY (c_custkey * 7919) % 1009, c_custkey) AS INT) AS part FROM customer")
def _(s, d):
    return T.split_parts(_t(s, d, "customer").select("c_custkey"), 3, [(F.col("c_custkey") * 7919) % 1009, F.col("c_custkey")])


@query("manifest_gate", "SELECT CAST(s_suppkey AS VARCHAR) AS name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49 AND l_discount = 0)")
def _(s, d):
    from siteweave.sources.exchange import missing_of

    have = _t(s, d, "lineitem").where("l_quantity >= 49 AND l_discount = 0").select(F.col("l_suppkey").cast("string").alias("name")).distinct()
    return missing_of(_t(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("name")), have)


# ---- intervals: a purchase at a place made of its order's day and its customer, as long as its quantity, by nation.
# Odd line numbers are one side, even ones the other: together all line items ----

IV = """WITH iv0 AS (SELECT l.l_orderkey * 10 + l.l_linenumber AS id, n.n_name AS chrom, CAST(date_diff('day', DATE '1990-01-01', CAST(o.o_orderdate AS DATE)) * 100 + o.o_custkey % 100 AS INT) AS s,
CAST(date_diff('day', DATE '1990-01-01', CAST(o.o_orderdate AS DATE)) * 100 + o.o_custkey % 100 + l.l_quantity AS INT) AS e, l.l_linenumber AS ln
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
iv AS (SELECT id, chrom, s, min(e) AS e, ln FROM iv0 GROUP BY id, chrom, s, ln),
a AS (SELECT id, chrom, s, e FROM iv WHERE ln % 2 = 1), b AS (SELECT id, chrom, s, e FROM iv WHERE ln % 2 = 0) """
#: Pairs that overlap, as an equi-join on bins of 64 positions: both sides in all of theirs, met in the first that both have.
MEET = "(SELECT *, unnest(range(s // 64, e // 64 + 1)) AS bin FROM {a}) {x} JOIN (SELECT *, unnest(range(s // 64, e // 64 + 1)) AS bin FROM {b}) {y} ON {x}.chrom = {y}.chrom AND {x}.bin = {y}.bin AND {x}.bin = greatest({x}.s // 64, {y}.s // 64) AND {x}.s <= {y}.e AND {y}.s <= {x}.e"
AB = MEET.format(a="a", x="a", b="b", y="b")
#: Lengths here are quantities, 50 at most.
LONGEST = 51


def _intervals(s, d, odd: int | None = 1) -> DataFrame:
    li = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    li = li if odd is None else li.where(F.col("l_linenumber") % 2 == odd)
    # orders get their places first; what is grouped lies together by order already
    at = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")) * 100 + F.col("o_custkey") % 100
    places = _t(s, d, "orders").select("o_orderkey", "o_custkey", at.cast("int").alias("start")).join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = li.join(places.select("o_orderkey", F.col("n_name").alias("chrom"), "start"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = own.groupBy("l_orderkey", "l_linenumber", "chrom", "start").agg(F.min("l_quantity").alias("q"))
    return own.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "chrom", "start", (F.col("start") + F.col("q")).cast("int").alias("end"))


def _ab(s, d):
    return _intervals(s, d, 1), _intervals(s, d, 0)


#: Line items a task where all pairs are written: their ids are few enough to be written as short numbers.
PAIRED = 1 << 16


def _tasks(s, d) -> int:
    """Tasks of the joins whose result is pairs, by the number of line items, which their files' footers hold."""
    return 1 + _t(s, d, "lineitem").count() // PAIRED


@query("overlap_join_all", IV + "SELECT a.id AS a, b.id AS b, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS l_overlap FROM " + AB)
def _(s, d):
    met = I.overlaps_by_place(*_ab(s, d), LONGEST, _tasks(s, d)).select(F.col("a.items.id").alias("a"), F.col("b.items.id").alias("b"), "l_overlap")
    return I.apart(met, ["a"], ["b"])


@query("overlap_join_first", IV + "SELECT a, b FROM (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY b.s, b.e, b.id) AS k FROM " + AB + ") WHERE k = 1")
def _(s, d):
    a, b = _ab(s, d)
    return I.overlaps_first(a, b.select("chrom", "start", "end", "id"), "id", LONGEST).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("interval_anti", IV + "SELECT a.id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e)")
def _(s, d):
    return I.without_overlap(*_ab(s, d)).select("id")


RUNS = "SELECT chrom, s, e, sum(n) OVER (PARTITION BY chrom ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS g FROM (SELECT chrom, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS n FROM {t})"


def _merged(t: str, gap: int) -> str:
    return f"SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n FROM ({RUNS.format(t=t, gap=gap)}) GROUP BY chrom, g"


@query("merge_gap", IV + f'SELECT chrom, s AS start, e AS "end", n FROM ({_merged("a", 3)})')
def _(s, d):
    return I.merge(_intervals(s, d), 3).select("chrom", "start", "end", "n")


@query("super_merge", IV + f'SELECT chrom, s AS start, e AS "end", n FROM ({_merged("(SELECT * FROM a UNION ALL SELECT * FROM b)", 0)})')
def _(s, d):
    return I.union_merge(list(_ab(s, d))).select("chrom", "start", "end", "n")


@query("coverage", IV + f"SELECT CAST(sum(e - s + 1) AS BIGINT) AS coverage FROM ({_merged('a', 0)})")
def _(s, d):
    return I.covered(_intervals(s, d))


@query(
    "overlap_f1",
    IV
    + f", x AS ({_merged('a', 0)}), y AS ({_merged('b', 0)}), o AS (SELECT coalesce(sum(least(x.e, y.e) - greatest(x.s, y.s) + 1), 0) AS ol FROM {MEET.format(a='x', x='x', b='y', y='y')}), ca AS (SELECT sum(e - s + 1) AS n FROM x), cb AS (SELECT sum(e - s + 1) AS n FROM y) SELECT CAST(ca.n AS BIGINT) AS cov_a, CAST(cb.n AS BIGINT) AS cov_b, CAST(ol AS BIGINT) AS ol, round(ol / CAST(ca.n AS DOUBLE), 6) AS of_a, round(ol / CAST(ca.n + cb.n - ol AS DOUBLE), 6) AS of_both, round(2.0 * ol / CAST(ca.n + cb.n AS DOUBLE), 6) AS f1 FROM o, ca, cb",
)
def _(s, d):
    return I.overlap_stats(*_ab(s, d)).select("cov_a", "cov_b", "ol", _r("of_a"), _r("of_both"), _r("f1"))


@query("interval_subtract", IV + f", y AS ({_merged('b', 0)}), p AS (SELECT a.id, a.chrom, a.s AS s0, a.e AS e0, greatest(a.s, y.s) AS cs, least(a.e, y.e) AS ce FROM {MEET.format(a='a', x='a', b='y', y='y')}), pieces AS (SELECT id, chrom, coalesce(lag(ce) OVER w + 1, s0) AS s, cs - 1 AS e FROM p WINDOW w AS (PARTITION BY id ORDER BY cs) UNION ALL SELECT id, chrom, max(ce) + 1, max(e0) FROM p GROUP BY id, chrom UNION ALL SELECT id, chrom, s, e FROM a WHERE id NOT IN (SELECT id FROM p)) SELECT id, chrom, s AS start, e AS \"end\" FROM pieces WHERE s <= e")
def _(s, d):
    return I.subtract(*_ab(s, d), "id")


@query("pairwise_remainders", IV + ", p AS (SELECT a.id, a.s AS s0, a.e AS e0, greatest(a.s, b.s) AS cs, least(a.e, b.e) AS ce, b.id AS b FROM " + AB + ") SELECT id, s0 AS start, cs - 1 AS \"end\", b FROM p WHERE s0 < cs UNION ALL SELECT id, ce + 1, e0, b FROM p WHERE ce < e0")
def _(s, d):
    return I.pairwise_remainders(*_ab(s, d), "id", LONGEST, _tasks(s, d)).select("id", "start", "end", F.col("b.id").alias("b"))


@query("nearest_dist", IV + "SELECT a.id, coalesce(min(CASE WHEN b.id IS NOT NULL THEN greatest(a.s - b.e, b.s - a.e, 0) END), 10000000) AS distance FROM a LEFT JOIN b ON a.chrom = b.chrom GROUP BY a.id")
def _(s, d):
    return I.nearest_distance(*_ab(s, d), "id")


@query("interval_gaps", IV + "SELECT chrom, start, gap FROM (SELECT chrom, s AS start, s - lag(e) OVER (PARTITION BY chrom ORDER BY s, e) AS gap FROM a) WHERE gap IS NOT NULL")
def _(s, d):
    return I.gaps(_intervals(s, d))


@query("cumulative_ends", IV + 'SELECT chrom, s AS start, e AS "end", max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS cumul_end, min(s) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cumul_start FROM a')
def _(s, d):
    return I.cumulative_ends(_intervals(s, d).drop("id"))


@query("flank_extend", IV + 'SELECT id, chrom, greatest(1, s - 5) AS start, e + 3 AS "end" FROM a')
def _(s, d):
    return I.extend(_intervals(s, d), 5, 3)


@query("flanks", IV + 'SELECT id, greatest(1, s - 4) AS start, s - 1 AS "end", 5 AS side FROM a WHERE s > 1 UNION ALL SELECT id, e + 1, e + 4, 3 FROM a')
def _(s, d):
    return I.flanks(_intervals(s, d), 4).select("id", "start", "end", "side")


@query("midpoints", IV + 'SELECT id, CAST(floor((s + e) / 2.0) AS INT) AS start, CAST(floor((s + e) / 2.0) AS INT) AS "end" FROM a')
def _(s, d):
    return I.midpoints(_intervals(s, d)).select("id", "start", "end")


@query("region_filters", IV + "SELECT id FROM a WHERE chrom IN ('NATION_1', 'FRANCE', 'CHINA', 'NATION_2') AND e < 250000 AND e - s > 5 AND e - s < 40")
def _(s, d):
    return I.filtered(_intervals(s, d), ["NATION_1", "FRANCE", "CHINA", "NATION_2"], end_max=250000, min_run=5, max_run=40).select("id")


@query("unique_by_pos", IV + 'SELECT chrom, s AS start, e AS "end", min(id) AS id FROM a GROUP BY 1, 2, 3 HAVING count(*) = 1')
def _(s, d):
    return I.unique_by_position(_intervals(s, d), keep_one=False)


@query("top_coverage", IV + "SELECT id FROM (SELECT id, coalesce(sum(e - s + 1) OVER (ORDER BY e - s DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a) WHERE before < 500")
def _(s, d):
    return I.top_until_coverage(_intervals(s, d), F.col("start") - F.col("end"), ["id"], 500).select("id")


@query("best_overlap_hist", IV + "SELECT CAST(floor(coalesce(best, 0) / CAST(a.e - a.s + 1 AS DOUBLE) / 0.25 + 1e-9) AS INT) AS bin, count(*) AS n FROM a LEFT JOIN (SELECT a.id, max(least(a.e, b.e) - greatest(a.s, b.s) + 1) AS best FROM " + AB + " GROUP BY a.id) o ON a.id = o.id GROUP BY 1")
def _(s, d):
    return I.best_overlap_histogram(*_ab(s, d), "id", 0.25)


@query("peak_associations", IV + "SELECT x.ln AS x, y.ln AS y, count(*) AS n FROM iv x JOIN iv y ON x.chrom = y.chrom AND x.s <= y.e AND y.s <= x.e WHERE x.ln < y.ln GROUP BY 1, 2")
def _(s, d):
    return I.associations(_intervals(s, d, None).withColumn("ln", (F.col("id") % 10).cast("int")), "ln")


# ---- genotypes: a customer's purchases of a part class, 0 to 2 ----

GENO = """WITH subj AS (SELECT c_custkey AS sid, c_nationkey % 3 AS site, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS y, c_acctbal AS bal FROM customer),
geno AS (SELECT o_custkey AS sid, CAST(l_partkey % 50 AS INT) AS v, CAST(least(2, count(*)) AS INT) AS g FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
raw AS (SELECT o_custkey AS sid, CAST(l_partkey % 50 AS INT) AS v, CAST(count(*) AS INT) AS g FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) """


def _counts(s, d) -> DataFrame:
    joined = _t(s, d, "lineitem").select("l_orderkey", "l_partkey").join(_t(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("subject_idx"), (F.col("l_partkey") % 50).cast("int").alias("var_idx")).agg(F.count(F.lit(1)).cast("int").alias("g"))


def _geno(s, d) -> DataFrame:
    return _counts(s, d).withColumn("g", F.least(F.lit(2), F.col("g")))


def _subjects(s, d) -> DataFrame:
    y = F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0)
    return _t(s, d, "customer").select(F.col("c_custkey").alias("subject_idx"), (F.col("c_nationkey") % 3).cast("int").alias("site"), y.alias("y"), F.array(F.lit(1.0), F.col("c_acctbal") / 10000).alias("x"))


@query("geno_missingness", GENO + "SELECT v AS var_idx, CAST(count(*) FILTER (WHERE g > 2) AS BIGINT) AS n_missing, count(*) AS n FROM raw GROUP BY v")
def _(s, d):
    return G.missingness(_counts(s, d))


@query("geno_impute", GENO + "SELECT r.v AS var_idx, sid AS subject_idx, CAST(CASE WHEN g <= 2 THEN g ELSE m END AS INT) AS g FROM raw r JOIN (SELECT v, floor(coalesce(avg(g) FILTER (WHERE g <= 2), 0)) AS m FROM raw GROUP BY v) f ON r.v = f.v")
def _(s, d):
    return G.impute(_counts(s, d)).select("var_idx", "subject_idx", "g")


@query("geno_impute_wide", GENO + "SELECT r.v AS var_idx, CAST(row_number() OVER (PARTITION BY r.v ORDER BY sid) - 1 AS INT) AS place, CAST(CASE WHEN g <= 2 THEN g ELSE m END AS INT) AS g, CAST(n_missing AS INT) AS n_missing FROM raw r JOIN (SELECT v, floor(coalesce(avg(g) FILTER (WHERE g <= 2), 0)) AS m, count(*) FILTER (WHERE g > 2) AS n_missing FROM raw GROUP BY v) f ON r.v = f.v")
def _(s, d):
    own = G.impute_wide(G.wide_form(_counts(s, d), ["var_idx"]))
    return own.select("var_idx", F.posexplode("g").alias("place", "g"), "n_missing")


@query("allele_freq", GENO + "SELECT v AS var_idx, round(sum(g) / (2.0 * count(*)), 6) AS af, count(*) AS n FROM geno GROUP BY v")
def _(s, d):
    return G.allele_frequencies(_geno(s, d)).select("var_idx", _r("af"), "n")


@query("geno_center", GENO + "SELECT v AS var_idx, sid AS subject_idx, round(g - 2.0 * avg(g / 2.0) OVER (PARTITION BY v), 6) AS gc FROM geno")
def _(s, d):
    own = _geno(s, d)
    return G.centred(own, G.allele_frequencies(own).select("var_idx", "af")).select("var_idx", "subject_idx", _r("gc"))


SAMPLES = "samples AS (SELECT row_number() OVER (ORDER BY c_custkey DESC) AS sample_pos, c_custkey AS sample_id FROM customer) "


def _samples(s, d) -> DataFrame:
    from pyspark.sql import Window

    return _t(s, d, "customer").select(F.row_number().over(Window.orderBy(F.desc("c_custkey"))).cast("long").alias("sample_pos"), F.col("c_custkey").alias("sample_id"))


@query("geno_subset_outer", GENO + ", " + SAMPLES + "SELECT CAST(vv.v AS INT) AS var_idx, sample_pos, sample_id, coalesce(g, -1) AS g FROM samples CROSS JOIN (SELECT DISTINCT v FROM geno) vv LEFT JOIN geno ON geno.sid = sample_id AND geno.v = vv.v")
def _(s, d):
    own = _geno(s, d).withColumnRenamed("subject_idx", "sample_id")
    return G.subset_outer(own, own.select("var_idx").distinct(), _samples(s, d))


@query("geno_subset_inner", GENO + ", " + SAMPLES + "SELECT v AS var_idx, sample_pos, sample_id, g FROM samples JOIN geno ON sid = sample_id")
def _(s, d):
    return G.subset_inner(_geno(s, d).withColumnRenamed("subject_idx", "sample_id"), _samples(s, d)).select("var_idx", "sample_pos", "sample_id", "g")


GT = "(SELECT CAST(p_size AS INT) AS k, (CASE p_size % 4 WHEN 3 THEN '.' ELSE CAST(p_size % 4 AS VARCHAR) END) || (CASE WHEN p_size % 2 = 0 THEN '/' ELSE '|' END) || CAST(p_partkey % 2 AS VARCHAR) AS gt FROM part)"


def _gts(s, d) -> DataFrame:
    size = F.col("p_size")
    return _t(s, d, "part").select(size.cast("int").alias("k"), F.concat(F.when(size % 4 == 3, ".").otherwise((size % 4).cast("string")), F.when(size % 2 == 0, "/").otherwise("|"), (F.col("p_partkey") % 2).cast("string")).alias("gt"))


@query("geno_code_from_gt", f"SELECT gt, CASE WHEN gt LIKE '.%' THEN -1 ELSE CAST(substr(gt, 1, 1) <> '0' AS INT) + CAST(substr(gt, 3, 1) <> '0' AS INT) END AS g, CASE WHEN gt LIKE '.%' THEN -1 ELSE 2 * CAST(substr(gt, 1, 1) <> '0' AS INT) + CAST(substr(gt, 3, 1) <> '0' AS INT) END AS h FROM {GT}")
def _(s, d):
    return _gts(s, d).select("gt", S.genotype_code(F.col("gt")).alias("g"), S.haplotype_code(F.col("gt")).alias("h"))


@query("haplo_decode", "SELECT p_partkey, CAST((p_size % 4) // 2 + (p_size % 4) % 2 AS INT) AS g, CAST((p_size % 4) // 2 AS INT) AS a1, CAST((p_size % 4) % 2 AS INT) AS a0, (p_size % 4) IN (1, 2) AS het FROM part")
def _(s, d):
    h = (F.col("p_size") % 4).cast("int")
    return _t(s, d, "part").select("p_partkey", S.haplo_to_geno(h).alias("g"), S.allele(h, 1).alias("a1"), S.allele(h, 0).alias("a0"), S.is_het(h).alias("het"))


@query("cohort_merge", "SELECT CAST(l_partkey % 20 AS INT) AS var_idx, CAST(12 AS INT) AS n, CAST(sum(g) AS BIGINT) AS total FROM (SELECT l_partkey % 20 AS l_partkey, l_suppkey % 12 AS s, least(2, count(*)) AS g FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 12")
def _(s, d):
    own = _t(s, d, "lineitem").groupBy((F.col("l_partkey") % 20).cast("int").alias("var_idx"), (F.col("l_suppkey") % 12).cast("int").alias("subject_idx")).agg(F.least(F.lit(2), F.count(F.lit(1))).cast("int").alias("g"))
    a, b = G.wide_form(own.where("subject_idx < 5"), ["var_idx"]), G.wide_form(own.where("subject_idx >= 5"), ["var_idx"])
    return G.merge_cohorts(a, b, ["var_idx"]).select("var_idx", F.size("g").alias("n"), F.aggregate("g", F.lit(0).cast("long"), lambda x, y: x + y).alias("total")).where("n = 12")


@query("variant_blocks", GENO + "SELECT CAST(v // 8 AS INT) AS block, count(*) AS n, v // 8 * 8 <= 50 - 50 % 8 - 8 AS whole FROM geno GROUP BY v // 8")
def _(s, d):
    own = _geno(s, d).groupBy(G.block_of(F.col("var_idx"), 8).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("whole", F.col("block") * 8 <= G.last_block_start(50, 8))


# ---- models ----

SCORE = """, mu AS (SELECT avg(y) AS mu, count(*) AS n FROM subj),
st AS (SELECT v, sum(g * (y - mu)) AS sc, sum(g) AS sg, sum(g * g) AS sgg, max(mu) AS mu, max(n) AS n FROM geno JOIN subj ON geno.sid = subj.sid CROSS JOIN mu GROUP BY v),
res AS (SELECT v, sc * sc AS s, mu * (1 - mu) * (sgg - CAST(sg AS DOUBLE) * sg / n) AS t FROM st) """


def _null_model(s, d):
    """Intercept only: mu is the mean, Z is 1 / (n mu (1 - mu))."""
    import numpy as np

    subj = _subjects(s, d).withColumn("x", F.array(F.lit(1.0)))
    mu = subj.agg(F.avg("y"), F.count(F.lit(1))).first()
    return subj.withColumn("mu", F.lit(mu[0])), np.array([[1 / (mu[1] * mu[0] * (1 - mu[0]))]])


_score_sql = GENO + SCORE + "SELECT v AS var_idx, round(s, 4) AS s, round(t, 4) AS t, round(s / t, 4) AS chisq FROM res"
_score_cols = lambda df: df.select("var_idx", _r("s", 4), _r("t", 4), _r("chisq", 4))


@query("score_test_central", _score_sql)
def _(s, d):
    subj, z = _null_model(s, d)
    return _score_cols(L.score_test(_geno(s, d), subj, z))


@query("score_test_fed", _score_sql)
def _(s, d):
    subj, z = _null_model(s, d)
    return _score_cols(L.score_test_federated(_geno(s, d), subj, z))


@query("score_test_noised_ratio", GENO + SCORE + "SELECT v AS var_idx, round(s / t, 4) AS chisq FROM res")
def _(s, d):
    subj, z = _null_model(s, d)
    return L.noised_ratio(L.score_test(_geno(s, d), subj, z)).select("var_idx", _r("chisq", 4))


def _irls_sql(steps: int) -> str:
    """CTEs b0 (zero) to b<steps>, each with the X'WX that led to it, for an intercept and bal / 10000."""
    out = ", x AS (SELECT sid, site, CAST(y AS DOUBLE) AS y, bal / 10000 AS z FROM subj), b0 AS (SELECT CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1)"
    for k in range(steps):
        fitted = f"(SELECT y, z, nu, mu, mu * (1 - mu) AS w FROM (SELECT y, z, nu, 1 / (1 + exp(-nu)) AS mu FROM (SELECT y, z, b0 + b1 * z AS nu FROM x, b{k})))"
        out += f", m{k} AS (SELECT sum(w) AS a, sum(w * z) AS b, sum(w * z * z) AS d, sum(w * nu + y - mu) AS u, sum(z * (w * nu + y - mu)) AS v FROM {fitted})"
        out += f", b{k + 1} AS (SELECT (d * u - b * v) / (a * d - b * b) AS b0, (a * v - b * u) / (a * d - b * b) AS b1, a, b, d, a * d - b * b AS det FROM m{k})"
    return out


STEPS = 6
TESTED = (
    GENO.replace("WITH subj", "WITH RECURSIVE subj")
    + _irls_sql(STEPS)
    + f""", f AS (SELECT sid, y, z, 1 / (1 + exp(-(b0 + b1 * z))) AS mu, a, b, d, det FROM x, b{STEPS}),
st AS (SELECT v, sum(g * (y - mu)) AS sc, sum(mu * (1 - mu) * g * g) AS gwg, sum(mu * (1 - mu) * g) AS g0, sum(mu * (1 - mu) * g * z) AS g1, max(a) AS a, max(b) AS b, max(d) AS d, max(det) AS det FROM geno JOIN f ON geno.sid = f.sid GROUP BY v),
res AS (SELECT v, sc, sc * sc AS s, gwg - (d * g0 * g0 - 2 * b * g0 * g1 + a * g1 * g1) / det AS t FROM st),
tail AS (SELECT v, sc, s, t, s / t AS q, 0 AS i, CAST(1 AS DOUBLE) AS term, CAST(1 AS DOUBLE) AS total FROM res UNION ALL SELECT v, sc, s, t, q, i + 1, term * (q / 2) / (1.5 + i), total + term * (q / 2) / (1.5 + i) FROM tail WHERE i < 150)
SELECT v AS var_idx, round(sc, 4) AS score, round(s, 3) AS s, round(t, 4) AS t, round(q, 4) AS chisq, round(1 - sqrt(q / 2) * exp(-q / 2) * 2 * total / sqrt(pi()), 6) AS p FROM tail WHERE i = 150"""
)


def _tested(df: DataFrame) -> DataFrame:
    return df.select("var_idx", _r("score", 4), _r("s", 3), _r("t", 4), _r("chisq", 4), _r("p"))


@query("score_test_pvalues", TESTED)
def _(s, d):
    """With a covariate, and p-values."""
    subj = _subjects(s, d)
    fit = L.irls(subj, STEPS, 0.0)
    return _tested(L.score_test(_geno(s, d), L.fitted(subj, fit.beta), fit.z))


@query("score_test_fed_covariates", TESTED)
def _(s, d):
    """In the protocol's phases, under the sites' full masks."""
    subj = _subjects(s, d)
    fit = L.irls(subj, STEPS, 0.0, mask="full")
    return _tested(L.score_test_federated(_geno(s, d), L.fitted(subj, fit.beta), fit.z))


CENTRED = (
    GENO
    + _irls_sql(1)
    + f""", f AS (SELECT sid, y, z, 1 / (1 + exp(-(b0 + b1 * z))) AS mu, a, b, d, det FROM x, b1),
af AS (SELECT v, sum(g) / (2.0 * count(*)) AS af FROM geno GROUP BY v),
dense AS (SELECT af.v, f.*, mu * (1 - mu) AS w, 2 * (coalesce(g, 0) - 2 * af) AS gc FROM af CROSS JOIN f LEFT JOIN geno ON geno.v = af.v AND geno.sid = f.sid),
st AS (SELECT v, sum(gc * (y - mu)) AS sc, sum(w * gc * gc) AS gwg, sum(w * gc) AS g0, sum(w * gc * z) AS g1, max(a) AS a, max(b) AS b, max(d) AS d, max(det) AS det FROM dense GROUP BY v)
SELECT v AS var_idx, round(sc, 3) AS score, round(gwg - (d * g0 * g0 - 2 * b * g0 * g1 + a * g1 * g1) / det, 3) AS t FROM st"""
)


@query("score_test_centred", CENTRED)
def _(s, d):
    """Genotypes less twice their frequency, doubled, with the weights of one step, at which centring still shows. The SQL makes the dense table."""
    subj = _subjects(s, d)
    fit = L.irls(subj, 1)
    geno = _geno(s, d)
    out = L.score_test_centred(geno, G.allele_frequencies(geno), L.fitted(subj, fit.beta), fit.z, 2.0)
    return out.select("var_idx", _r("score", 3), _r("t", 3))


META = """, mu AS (SELECT site, avg(y) AS mu, count(*) AS n FROM subj GROUP BY site),
st AS (SELECT subj.site, v, sum(g * (y - mu)) AS sc, sum(g) AS sg, sum(g * g) AS sgg, max(mu) AS mu, max(n) AS n FROM geno JOIN subj ON geno.sid = subj.sid JOIN mu ON mu.site = subj.site GROUP BY 1, 2),
res AS (SELECT v, sum(sc) * sum(sc) AS s, sum(mu * (1 - mu) * (sgg - CAST(sg AS DOUBLE) * sg / n)) AS t FROM st GROUP BY v) """


@query("meta_analysis", GENO + META + "SELECT v AS var_idx, round(s, 4) AS s, round(t, 4) AS t, round(s / t, 4) AS chisq FROM res")
def _(s, d):
    subj = _subjects(s, d).withColumn("x", F.array(F.lit(1.0)))
    mu = subj.groupBy("site").agg(F.avg("y").alias("mu"))
    return _score_cols(L.meta(L.meta_site_stats(_geno(s, d), subj.join(mu, "site"), 1)))


MOMENTS = "CAST(site AS INT) AS site, round(sum(CAST(0.25 AS DOUBLE)), 4) AS xtwx_0_0, round(sum(0.25 * bal / 10000), 4) AS xtwx_0_1, round(sum(0.25 * bal / 10000 * bal / 10000), 4) AS xtwx_1_1, round(sum(CAST(y - 0.5 AS DOUBLE)), 4) AS xtwz_0, round(sum(bal / 10000 * (y - 0.5)), 4) AS xtwz_1, round(count(*) * ln(0.5), 4) AS ll"


@query("irls_moments", GENO + f"SELECT {MOMENTS} FROM subj GROUP BY site")
def _(s, d):
    m = L.irls_moments(_subjects(s, d), [0.0, 0.0])
    return m.select("site", *[_r(c, 4) for c in m.columns if c not in ("site", "max_nu")])


@query(
    "irls_step1",
    GENO + ", m AS (SELECT sum(CAST(0.25 AS DOUBLE)) a, sum(0.25 * bal / 10000) b, sum(0.25 * bal / 10000 * bal / 10000) d, sum(y - 0.5) u, sum(bal / 10000 * (y - 0.5)) w FROM subj) SELECT round((d * u - b * w) / (a * d - b * b), 5) AS b0, round((a * w - b * u) / (a * d - b * b), 5) AS b1 FROM m",
)
def _(s, d):
    beta = L.irls(_subjects(s, d), epochs=1, mask="full").beta
    return s.createDataFrame([(round(beta[0], 5), round(beta[1], 5))], "b0 double, b1 double")


@query("irls_fit", GENO + _irls_sql(STEPS) + f" SELECT 0 AS feature, round(b0, 6) AS beta FROM b{STEPS} UNION ALL SELECT 1, round(b1, 6) FROM b{STEPS}")
def _(s, d):
    fit = L.irls(_subjects(s, d), STEPS, 0.0, mask="diagonal")
    return s.createDataFrame([(k, round(b, 6)) for k, b in enumerate(fit.beta)], "feature int, beta double")


BETA = "(0.1 + 0.5 * bal / 10000)"


@query("loglik", GENO + f"SELECT CAST(site AS INT) AS site, round(sum(y * ln(1 / (1 + exp(-{BETA}))) + (1 - y) * ln(1 - 1 / (1 + exp(-{BETA})))), 4) AS ll FROM subj GROUP BY site")
def _(s, d):
    return L.log_likelihood(_subjects(s, d), [0.1, 0.5], ["site"]).select("site", _r("ll", 4))


@query("lrt_scores", GENO + f", l AS (SELECT sum(y * ln(1 / (1 + exp(-{BETA}))) + (1 - y) * ln(1 - 1 / (1 + exp(-{BETA})))) AS f, sum(y * ln(1 / (1 + exp(-(0.5 * bal / 10000)))) + (1 - y) * ln(1 - 1 / (1 + exp(-(0.5 * bal / 10000))))) AS a, sum(y * ln(1 / (1 + exp(CAST(-0.1 AS DOUBLE)))) + (1 - y) * ln(1 - 1 / (1 + exp(CAST(-0.1 AS DOUBLE))))) AS b FROM subj) SELECT 0 AS feature, round(2 * (f - a), 4) AS lrt FROM l UNION ALL SELECT 1, round(2 * (f - b), 4) FROM l")
def _(s, d):
    return L.likelihood_ratio(_subjects(s, d), [0.1, 0.5]).select("feature", _r("lrt", 4))


@query("sgd_epoch_full_batch", GENO + "SELECT round(0.1 * avg(y - 0.5), 6) AS b0, round(0.1 * avg(bal / 10000 * (y - 0.5)), 6) AS b1 FROM subj")
def _(s, d):
    beta = L.gradient_epoch(_subjects(s, d), [0.0, 0.0], 0.1)
    return s.createDataFrame([(round(beta[0], 6), round(beta[1], 6))], "b0 double, b1 double")


SGD = "1 / (1 + exp(-(b0 + b1 * z)))"


@query(
    "sgd_sequential",
    GENO.replace("WITH subj", "WITH RECURSIVE subj")
    + f""", o AS (SELECT site, CAST(y AS DOUBLE) AS y, bal / 10000 AS z, row_number() OVER (PARTITION BY site ORDER BY e, md5('1:' || e || ':' || sid)) AS i, count(*) OVER (PARTITION BY site, e) AS n FROM subj, range(2) t(e)),
r AS (SELECT DISTINCT site, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM o UNION ALL SELECT r.site, o.i, b0 + 0.5 / n * (y - {SGD}), b1 + 0.5 / n * (y - {SGD}) * z FROM r JOIN o ON o.site = r.site AND o.i = r.i + 1)
SELECT CAST(site AS INT) AS site, round(max_by(b0, i), 6) AS b0, round(max_by(b1, i), 6) AS b1 FROM r GROUP BY site""",
)
def _(s, d):
    own = L.sequential_gradient(_subjects(s, d), 2, 0.5, by="site")
    return own.select("site", *[F.round(F.col("beta")[k], 6).alias(f"b{k}") for k in (0, 1)])


@query("convergence", "SELECT iter, ll, delta, coalesce(abs(delta) < 0.5, false) AS converged FROM (SELECT iter, ll, ll - lag(ll) OVER (ORDER BY iter) AS delta FROM (SELECT CAST(l_linenumber AS INT) AS iter, round(CAST(count(*) AS DOUBLE), 4) AS ll FROM lineitem GROUP BY 1))")
def _(s, d):
    own = _t(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("iter"), (F.col("l_suppkey") % 3).alias("site")).agg(F.count(F.lit(1)).cast("double").alias("ll"))
    return L.convergence(own, 0.5)


@query(
    "sigmoid_approx_table",
    "WITH g AS (SELECT -6.0 + i * CAST(0.01 AS DOUBLE) AS x FROM range(1201) t(i)) SELECT round(x, 4) AS x, round(0.5 + 1.73496 * (x / 8) - 4.19407 * pow(x / 8, 3) + 5.43402 * pow(x / 8, 5) - 2.50739 * pow(x / 8, 7), 6) AS kim, round(1 / (1 + exp(-x)), 6) AS native, round(CASE WHEN x > 5 THEN 1.0 WHEN x < -5 THEN 0.0 ELSE 0.5 + 0.197 * x - 0.004 * x * x * x END, 10) AS tenseal FROM g",
)
def _(s, d):
    return L.sigmoid_table(s, 6.0).select(_r("x", 4), _r("kim"), _r("native"), _r("tenseal", 10))


CENTRES = [[0.1] * 64, [-0.1] * 64]


@query(
    "kmeans_soft_step",
    "WITH p AS (SELECT embedding AS x FROM embeddings), w AS (SELECT k, x, exp(-0.2 * list_sum(list_transform(x, lambda v: (CAST(v AS DOUBLE) - c) * (CAST(v AS DOUBLE) - c)))) AS w FROM p, (VALUES (0, 0.1::DOUBLE), (1, -0.1::DOUBLE)) t(k, c)) SELECT k, CAST(d AS INT) AS d, round(sum(w), 4) AS w, round(sum(w * x[d + 1]), 4) AS c FROM w, range(64) r(d) GROUP BY k, d",
)
def _(s, d):
    points = _t(s, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    step = L.soft_kmeans_step(points, CENTRES)
    return step.select("k", _r("w", 4), F.posexplode(F.array(*[F.col(f"c_{k}") for k in range(64)])).alias("d", "c")).withColumn("c", F.round("c", 4))


def _kmeans_sql(steps: int) -> str:
    out = "WITH p AS (SELECT list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), c0 AS (SELECT * FROM (VALUES (0, list_transform(range(64), lambda i: CAST(0.1 AS DOUBLE))), (1, list_transform(range(64), lambda i: CAST(-0.1 AS DOUBLE)))) t(k, c))"
    for n in range(steps):
        out += f", w{n} AS (SELECT k, x, exp(-0.2 * list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))) AS w FROM p, c{n})"
        out += f", c{n + 1} AS (SELECT k, list(v ORDER BY d) AS c FROM (SELECT k, d, sum(w * x[d]) / sum(w) AS v FROM w{n}, range(1, 65) r(d) GROUP BY k, d) GROUP BY k)"
    return out + f" SELECT k, CAST(d AS INT) AS d, round(c[d + 1], 6) AS c FROM c{steps}, range(64) r(d)"


@query("kmeans_soft_fit", _kmeans_sql(3))
def _(s, d):
    points = _t(s, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("x"), (F.col("vec_id") % 3).cast("int").alias("site"))
    centres = L.soft_kmeans(points, CENTRES, 3, site="site")
    return s.createDataFrame([(k, i, round(v, 6)) for k, c in enumerate(centres) for i, v in enumerate(c)], "k int, d int, c double")


# ---- statistics ----

EV = "SELECT event_id AS id, user_id, event_type, value, ts FROM events"


def _events(s, d) -> DataFrame:
    return _t(s, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value", "ts")


@query("group_moments", f"SELECT event_type, round(avg(value), 5) AS mean, round(var_samp(value), 4) AS var, round(stddev_samp(value), 5) AS sd, count(value) AS n FROM ({EV}) GROUP BY 1")
def _(s, d):
    return A.moments(_events(s, d), ["event_type"], "value").select("event_type", _r("mean", 5), _r("var", 4), _r("sd", 5), "n")


@query("zscore", f"SELECT id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 5) AS z FROM ({EV}) WINDOW w AS (PARTITION BY event_type)")
def _(s, d):
    return A.zscore(_events(s, d), ["event_type"], "value").select("id", _r("z", 5))


@query("rank_norm", f"SELECT id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value, id) - 1 AS INT) AS rank FROM ({EV})")
def _(s, d):
    return A.rank_normalised(_events(s, d), ["event_type"], "value").select("id", "rank")


@query("rank_desc", f"SELECT id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, id) - 1 AS INT) AS rank FROM ({EV})")
def _(s, d):
    return A.rank_descending(_events(s, d), ["event_type"], "value").select("id", "rank")


@query("quantile_norm", f"WITH r AS (SELECT id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, id) AS k FROM ({EV})) SELECT id, round(avg(value) OVER (PARTITION BY k), 5) AS qn FROM r")
def _(s, d):
    return A.quantile_normalised(_events(s, d), "event_type", "value").select("id", _r("qn", 5))


@query("bh_q", "WITH p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / 10007.0::DOUBLE AS p FROM customer) SELECT id, round(p * (SELECT count(*) FROM p) / row_number() OVER (ORDER BY p, id), 6) AS q FROM p")
def _(s, d):
    own = _t(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 10007 / 10007.0).alias("p"))
    return A.bh(own).select("id", _r("q"))


@query("pearson", "SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 5) AS r FROM lineitem GROUP BY 1")
def _(s, d):
    return A.pearson(_t(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", _r("r", 5))


DEALT = "(SELECT n, v, row_number() OVER (PARTITION BY n ORDER BY substr(md5({seed} || ':' || s_suppkey), 1, 8), s_suppkey) AS k FROM (SELECT CAST(n AS INT) AS n, s_suppkey, {v} AS v FROM supplier, range(1, 21) t(n)))"


@query(
    "pearson_perm",
    f"WITH null_r AS (SELECT a.n, corr(a.v, b.v) AS r FROM {DEALT.format(seed="'0'", v='CAST(s_suppkey AS DOUBLE)')} a JOIN {DEALT.format(seed='n', v='s_acctbal')} b ON a.n = b.n AND a.k = b.k GROUP BY a.n), own AS (SELECT corr(s_suppkey, s_acctbal) AS r FROM supplier) SELECT round(max(own.r), 6) AS r, round((max(own.r) - avg(null_r.r)) / stddev_samp(null_r.r), 5) AS z FROM null_r, own",
)
def _(s, d):
    return A.pearson_permutation_z(_t(s, d, "supplier"), "s_suppkey", "s_acctbal", 20, "s_suppkey").select(_r("r"), _r("z", 5))


HIST = "(SELECT event_type AS a, CAST(floor(value / 10) AS INT) AS b, count(*) AS n FROM events GROUP BY 1, 2)"


def _hist(s, d) -> DataFrame:
    return A.histogram(_events(s, d), [F.col("event_type"), A.floor_bin(F.col("value"), 10.0)], ["a", "b"])


@query("histogram", f"SELECT a, b, n FROM {HIST}")
def _(s, d):
    return _hist(s, d)


@query("hist_marginals", f"SELECT a, b, CAST(grouping_id(a, b) AS INT) AS level, CAST(sum(n) AS BIGINT) AS n FROM {HIST} GROUP BY CUBE (a, b)")
def _(s, d):
    return A.marginals(_hist(s, d), ["a", "b"])


def _h(expr: str, source: str = HIST) -> str:
    return f"(SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM {source}) AS p FROM {source} GROUP BY {expr}))"


@query("entropy", f"SELECT round(h, 6) AS h FROM {_h('a, b')}")
def _(s, d):
    return A.entropy(_hist(s, d)).select(_r("h"))


@query("cond_entropy", f"SELECT round(x.h - y.h, 6) AS h FROM {_h('a, b')} x, {_h('a')} y")
def _(s, d):
    return A.conditional_entropy(_hist(s, d), ["b"], ["a"]).select(_r("h"))


PQ = "WITH p AS (SELECT CAST(floor(value / 10) AS INT) AS b, count(*) / sum(count(*)) OVER () AS p FROM events WHERE event_id % 2 = 0 GROUP BY 1), q AS (SELECT CAST(floor(value / 10) AS INT) AS b, count(*) / sum(count(*)) OVER () AS q FROM events WHERE event_id % 2 = 1 GROUP BY 1) "


def _pq(s, d):
    return tuple(A.histogram(_events(s, d).where(F.col("id") % 2 == k), [A.floor_bin(F.col("value"), 10.0)], ["b"]) for k in (0, 1))


@query("kl", PQ + "SELECT round(sum(p * ln(p / q)), 6) AS kl FROM p JOIN q ON p.b = q.b")
def _(s, d):
    return A.kl(*_pq(s, d), ["b"]).select(_r("kl"))


@query("js", PQ + "SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q ON p.b = q.b)")
def _(s, d):
    return A.jensen_shannon(*_pq(s, d), ["b"]).select(_r("js"))


@query("transition", f"WITH t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, id) AS source, event_type AS target FROM ({EV})), c AS (SELECT source, target, count(*) AS n FROM t WHERE source IS NOT NULL GROUP BY 1, 2) SELECT source, target, n, round(n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE), 6) AS p FROM c")
def _(s, d):
    return A.transitions(_events(s, d), ["user_id"], ["ts", "id"], "event_type").select("source", "target", "n", _r("p"))


@query("mode", "SELECT c_nationkey, mode FROM (SELECT c_nationkey, c_mktsegment AS mode, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k FROM customer GROUP BY 1, 2) WHERE k = 1")
def _(s, d):
    return A.mode(_t(s, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("log_sum_exp", "SELECT event_type, round(m + ln(sum(exp(value - m))), 5) AS lse FROM (SELECT event_type, value, max(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type, m")
def _(s, d):
    return A.log_sum_exp(_events(s, d), ["event_type"], "value").select("event_type", _r("lse", 5))


TRACK = "(SELECT n_name AS chrom, CAST(l_partkey % 200 + 1 AS INT) AS pos, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"


def _track(s, d) -> DataFrame:
    own = _t(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(_t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return own.groupBy(F.col("n_name").alias("chrom"), (F.col("l_partkey") % 200 + 1).cast("int").alias("pos")).agg(F.sum("l_quantity").cast("double").alias("v"))


@query("bin_track", f"SELECT chrom, CAST((pos - 1) // 25 AS INT) AS bin, sum(v) AS total, count(*) AS n FROM {TRACK} GROUP BY 1, 2")
def _(s, d):
    return A.bin_totals(_track(s, d), 25)


@query("track_regions", f"SELECT CAST(i AS INT) AS id, sum(v) AS total, round(avg(v), 5) AS mean, round(var_samp(v), 3) AS var, count(*) AS n FROM {TRACK}, range(10) t(i) WHERE pos BETWEEN i * 15 + 1 AND i * 15 + 40 AND chrom IN ('FRANCE', 'CHINA', 'NATION_1', 'NATION_2') GROUP BY i, chrom HAVING count(*) > 0")
def _(s, d):
    chroms = F.explode(F.array(*[F.lit(c) for c in ("FRANCE", "CHINA", "NATION_1", "NATION_2")]))
    regions = s.range(10).select(F.col("id").cast("int").alias("i"), (F.col("id") * 15 + 1).cast("int").alias("start"), (F.col("id") * 15 + 40).cast("int").alias("end"), chroms.alias("chrom")).withColumn("key", F.concat_ws("|", "i", "chrom"))
    return A.region_totals(_track(s, d), regions, "key").select(F.split("key", r"\|")[0].cast("int").alias("id"), "total", _r("mean", 5), _r("var", 3), "n")


@query("peaks", f"WITH t AS (SELECT chrom, pos, v, CAST(th AS INT) AS threshold FROM {TRACK}, (VALUES (20), (60), (120)) x(th) WHERE v >= th), r AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom, threshold ORDER BY pos) AS k FROM t) SELECT chrom, threshold, min(pos) AS start, max(pos) AS \"end\" FROM r GROUP BY chrom, threshold, k")
def _(s, d):
    return A.peaks(_track(s, d), ["chrom"], "pos", "v", [20, 60, 120])


@query("smooth_ma", f"SELECT chrom, pos, round(0.5 * v + 0.125 * (sum(v) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - v), 5) AS v FROM {TRACK}")
def _(s, d):
    return A.smoothed(_track(s, d), ["chrom"], "pos", "v", 2, 0.5).select("chrom", "pos", _r("v", 5))


@query("signal_pivot", "SELECT p_brand AS chrom, 1 AS start, 1 AS \"end\", p_brand AS name, sum(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS \"1\", sum(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS \"2\" FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def _(s, d):
    own = _t(s, d, "lineitem").join(_t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("name"), F.col("l_linenumber").cast("string").alias("sample")).agg(F.sum("l_quantity").alias("v"))
    return A.signals_side_by_side(own.select(F.col("name").alias("chrom"), F.lit(1).alias("start"), F.lit(1).alias("end"), "name", "sample", "v"), ["1", "2"])


# ---- scalar functions ----


@query("scalar_maps", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) ELSE 0.0 END, 6) AS plog, round(CASE WHEN c_acctbal <> 0 THEN 1 / c_acctbal ELSE 0.0 END, 6) AS pinv, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS sig, round(ln(1 + abs(c_acctbal)) / ln(2), 6) AS l2 FROM customer")
def _(s, d):
    b = F.col("c_acctbal")
    return _t(s, d, "customer").select("c_custkey", F.round(S.protected_log(b), 6).alias("plog"), F.round(S.protected_inverse(b), 6).alias("pinv"), F.round(S.sigmoid(b / 1000), 6).alias("sig"), F.round(S.log_plus(F.abs(b), 2), 6).alias("l2"))


@query("chisq_series", "WITH RECURSIVE x AS (SELECT c_custkey AS id, (c_custkey % 90 + 1) / 10.0::DOUBLE AS x FROM customer), t AS (SELECT id, x, 0 AS i, CAST(1.0 AS DOUBLE) AS term, CAST(1.0 AS DOUBLE) AS total FROM x UNION ALL SELECT id, x, i + 1, term * (x / 2) / (0.5 + i + 1), total + term * (x / 2) / (0.5 + i + 1) FROM t WHERE i < 80) SELECT id, round(1 - pow(x / 2, 0.5) * exp(-x / 2) / 0.5 * total / sqrt(pi()), 6) AS p FROM t WHERE i = 80")
def _(s, d):
    return _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.round(S.chi2_p1((F.col("c_custkey") % 90 + 1) / 10.0), 6).alias("p"))


@query("log_domain", "SELECT c_custkey, round(greatest(a, b) + ln(1 + exp(least(a, b) - greatest(a, b))), 6) AS s, round(a + b, 6) AS m FROM (SELECT c_custkey, c_acctbal / 1000 AS a, c_custkey % 10 / CAST(1 AS DOUBLE) AS b FROM customer)")
def _(s, d):
    a, b = F.col("c_acctbal") / 1000, (F.col("c_custkey") % 10).cast("double")
    return _t(s, d, "customer").select("c_custkey", F.round(S.xlog_sum(a, b), 6).alias("s"), F.round(S.xlog_mul(a, b), 6).alias("m"))


@query("strings", "SELECT p_partkey, upper(p_type) AS up, CAST(len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS INT) AS words, p_brand LIKE 'Brand%' AS branded, translate(p_type, 'AE', '__') AS masked, regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9_.-]', '_', 'g'), '^(chr|Chr|CHR)', '') AS chrom FROM part")
def _(s, d):
    return _t(s, d, "part").select("p_partkey", F.upper("p_type").alias("up"), F.size(S.tokens(F.col("p_name"), " ")).alias("words"), F.startswith("p_brand", F.lit("Brand")).alias("branded"), S.replace_any(F.col("p_type"), "AE", "_").alias("masked"), S.normalise_chrom(F.col("p_brand")).alias("chrom"))


LETTERS = ("BDEFHIJKLMNOPQRSUVWXYZ", "AACCGGTTAACCGGTTAACCGG")


@query("nucleotides", f"SELECT page_id, reverse(translate(translate(upper(url), '{LETTERS[0]}', '{LETTERS[1]}'), 'ACGT', 'TGCA')) AS rc FROM pages")
def _(s, d):
    return _t(s, d, "pages").select("page_id", S.reverse_complement(F.translate(F.upper("url"), *LETTERS)).alias("rc"))


@query("props_map", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(s, d):
    return _t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("quantize", "SELECT c_custkey, CAST(CASE WHEN c_acctbal >= 5000 THEN 5000 WHEN c_acctbal >= 0 THEN 0 ELSE -100000 END AS DOUBLE) AS q FROM customer")
def _(s, d):
    return _t(s, d, "customer").select("c_custkey", S.quantize(F.col("c_acctbal"), [-100000.0, 0.0, 5000.0]).alias("q"))


@query("events_stream", "SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    """The events table as a stream, in windows of event time; run to its end."""
    from siteweave.sources.exchange import scratch
    from siteweave.streaming.gate import windowed_counts

    path, out = f"{d}/events.parquet", scratch(s, "events")
    stream = s.readStream.schema(s.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(s, path) else f"{path}*")
    counts = windowed_counts(stream, "ts", ["event_type"]).select(F.unix_seconds("start").alias("start"), "event_type", "n")
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{out}/counts")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{out}/counts")


def _is_folder(s: SparkSession, path: str) -> bool:
    place = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


from siteweave.plans import catalog_files as _files  # noqa: E402, F401  (registers its queries here)
