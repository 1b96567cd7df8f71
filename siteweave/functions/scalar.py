"""Scalar functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- sigmoid family and protected maps ----


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    """ln(p / (1 - p)); null outside (0, 1)."""
    return F.when((p > 0) & (p < 1), F.ln(p / (F.lit(1.0) - p)))


def protected_log(x: Column) -> Column:
    """ln x, and 0 where x <= 0."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(0.0))


def protected_inverse(x: Column) -> Column:
    """1 / x, and 0 for 0."""
    return F.when(x != 0, F.lit(1.0) / F.when(x != 0, x).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def kim_sigmoid(x: Column) -> Column:
    """Degree-7 polynomial in x / 8, not clamped."""
    t = x / F.lit(8.0)
    t2 = t * t
    # fixed values: least-squares coefficients of the approximation
    return F.lit(0.5) + t * (F.lit(1.73496) + t2 * (F.lit(-4.19407) + t2 * (F.lit(5.43402) + t2 * F.lit(-2.50739))))


def tenseal_sigmoid(x: Column) -> Column:
    """Cubic, clamped to 0 and 1 beyond 5."""
    # fixed values: coefficients of the approximation
    return F.when(x > 5, F.lit(1.0)).when(x < -5, F.lit(0.0)).otherwise(F.lit(0.5) + F.lit(0.197) * x - F.lit(0.004) * x * x * x)


SIGMOIDS: dict[str, Callable[[Column], Column]] = {"NATIVE": sigmoid, "KIM_ETAL": kim_sigmoid, "TENSEAL": tenseal_sigmoid}
ELEMENTWISE: dict[str, Callable[[Column], Column]] = {"log": protected_log, "exp": F.exp, "sigmoid": sigmoid, "inv": protected_inverse}


def dot(x: Column, w: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def dot_sigmoid(x: Column, w: Column, kind: str = "NATIVE") -> Column:
    return SIGMOIDS[kind](dot(x, w))


# ---- chi-square tail ----


def gamma_spouge(z: Column, a: int = 5) -> Column:
    """Gamma by Spouge's formula with parameter a."""
    import math

    x = z - 1
    out = F.lit(math.sqrt(2 * math.pi))
    for k in range(1, a):
        out = out + F.lit((-1) ** (k - 1) / math.factorial(k - 1) * (a - k) ** (k - 0.5) * math.exp(a - k)) / (x + k)
    return F.pow(x + a, x + 0.5) * F.exp(-(x + a)) * out


def lower_gamma(s: Column, z: Column, terms: int = 200) -> Column:
    """Lower incomplete gamma by its power series, added up from its last term (Horner): a product and a quotient a term."""
    step = lambda s, z: F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, i: F.lit(1.0) + acc * z / (s + i))
    # s and z are variables of their own: they would be made again for each term
    total = F.transform(F.array(F.struct(s.cast("double").alias("s"), z.cast("double").alias("z"))), lambda x: step(x["s"], x["z"]))[0]
    return F.pow(z, s) * F.exp(-z) / s * total


def _erfc_tail(t: Column, depth: int = 60) -> Column:
    """erfc by its continued fraction, for t of 1.5 and more."""
    frac = F.aggregate(F.sequence(F.lit(depth), F.lit(1), F.lit(-1)), t, lambda acc, k: t + k / (F.lit(2.0) * acc))
    return F.exp(-t * t) / (frac * F.sqrt(F.lit(3.141592653589793)))


def chi2_p1(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, to about 1e-14 relative; null for x < 0 or null."""
    z = x / 2
    small = F.lit(1.0) - lower_gamma(F.lit(0.5), z, 80) / F.sqrt(F.lit(3.141592653589793))
    return F.when(x == 0, F.lit(1.0)).when(x < 4.5, small).when(x >= 4.5, _erfc_tail(F.sqrt(z)))


def chi2_sf(x: Column, dof: int, compat: bool = False) -> Column:
    """Upper tail for whole degrees of freedom; null for x < 0.

    compat: as the series alone gives it, with 1e-14 where the series is 1e-8 or less or overflows, and 0 for x < 0.
    """
    if compat:
        if dof < 1:
            return F.lit(0.0)
        if dof == 2:
            return F.when(x < 0, F.lit(0.0)).otherwise(F.exp(-x / 2))
        p = lower_gamma(F.lit(dof / 2), x / 2) / gamma_spouge(F.lit(dof / 2))
        return F.when(x < 0, F.lit(0.0)).when(F.isnan(p) | (p <= 1e-8) | (p == float("inf")), F.lit(1e-14)).otherwise(F.lit(1.0) - p)
    z = x / 2
    # from one or two degrees upward: Q(a + 1, z) = Q(a, z) + z^a e^-z / Gamma(a + 1)
    import math

    a = 0.5 if dof % 2 else 1.0
    out = chi2_p1(x) if dof % 2 else F.exp(-z)
    while a < dof / 2:
        out = out + F.pow(z, F.lit(a)) * F.exp(-z) / math.gamma(a + 1)
        a += 1
    return F.when(x >= 0, out)


# ---- log domain ----

#: Fixed value: the logarithm that stands for that of zero.
LOG_OF_ZERO = -float(1 << 30)


def xlog(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(LOG_OF_ZERO))


def xexp(x: Column) -> Column:
    return F.when(x <= LOG_OF_ZERO, F.lit(0.0)).otherwise(F.exp(x))


def xlog_sum(a: Column, b: Column) -> Column:
    """ln(e^a + e^b)."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(lo <= LOG_OF_ZERO, hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def xlog_sub(a: Column, b: Column) -> Column:
    """ln(e^a - e^b) for a >= b, else null."""
    return F.when(b <= LOG_OF_ZERO, a).when(a == b, F.lit(LOG_OF_ZERO)).when(a > b, a + F.log1p(-F.exp(b - a)))


def xlog_mul(a: Column, b: Column) -> Column:
    return F.when((a <= LOG_OF_ZERO) | (b <= LOG_OF_ZERO), F.lit(LOG_OF_ZERO)).otherwise(a + b)


def xlog_div(a: Column, b: Column) -> Column:
    """Null for division by zero."""
    return F.when(b <= LOG_OF_ZERO, F.lit(None)).when(a <= LOG_OF_ZERO, F.lit(LOG_OF_ZERO)).otherwise(a - b)


def xlog_pow(a: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).when(a <= LOG_OF_ZERO, F.lit(LOG_OF_ZERO)).otherwise(a * n)


def xlog_max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


# ---- genotypes and coordinates ----


def normalise_chrom(c: Column) -> Column:
    """Characters other than letters, digits, `_`, `.` and `-` become `_`; a leading chr goes, in any usual case."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.\-]", "_"), "^(chr|Chr|CHR)", "")


def genotype_code(gt: Column) -> Column:
    """GT field -> dosage: both alternate 2, one 1, none 0, missing -1."""
    a, b = F.substring(gt, 1, 1), F.substring(gt, 3, 1)
    missing = gt.isNull() | (a == ".") | (b == ".") | (F.length(gt) < 3)
    alt = lambda x: F.when(x == "0", 0).otherwise(1)
    return F.when(missing, F.lit(-1)).otherwise(alt(a) + alt(b)).cast("int")


def haplotype_code(gt: Column) -> Column:
    """GT field -> 2a + b, missing -1."""
    a, b = F.substring(gt, 1, 1), F.substring(gt, 3, 1)
    missing = gt.isNull() | (a == ".") | (b == ".") | (F.length(gt) < 3)
    alt = lambda x: F.when(x == "0", 0).otherwise(1)
    return F.when(missing, F.lit(-1)).otherwise(2 * alt(a) + alt(b)).cast("int")


def haplo_to_geno(h: Column) -> Column:
    """2a + b -> a + b; missing stays."""
    return F.when(h < 0, h).otherwise(F.shiftright(h, 1).bitwiseAND(F.lit(1)) + h.bitwiseAND(F.lit(1))).cast("int")


def allele(h: Column, which: int) -> Column:
    """Allele 0 or 1 of a haplotype code."""
    return F.shiftright(h, which).bitwiseAND(F.lit(1)).cast("int")


def is_het(h: Column) -> Column:
    return h.isin(1, 2)


def valid_genotype(g: Column) -> Column:
    return g.isin(0, 1, 2)


def require_genotype(g: Column) -> Column:
    return F.when(valid_genotype(g), g).otherwise(F.raise_error(F.concat(F.lit("genotype not among 0, 1, 2: "), F.coalesce(g.cast("string"), F.lit("null")))))


def mean_centre(g: Column, af: Column, scale: float = 1.0) -> Column:
    return F.lit(scale) * (g - F.lit(2.0) * af)


#: First coordinate of each format and whether its end is exclusive: fixed values of the formats.
FIRST = {"BED": 0, "INTERVAL": 0, "GFF": 1, "SAM": 1, "VCF": 1, "INTERNAL": 1}


def translate_start(c: Column, source: str, to: str = "INTERNAL") -> Column:
    return c - FIRST[source] + FIRST[to]


def translate_end(c: Column, source: str, to: str = "INTERNAL") -> Column:
    """Half-open ends (zero-based formats) equal inclusive ones of one-based formats."""
    return c


def quantize(x: Column, thresholds: list[float]) -> Column:
    """The largest threshold <= x; an error below all."""
    out = F.raise_error(F.concat(F.lit("below all thresholds: "), x.cast("string"))).cast("double")
    for t in sorted(thresholds):
        out = F.when(x >= t, F.lit(float(t))).otherwise(out)
    return out


def log_plus(x: Column, base: float) -> Column:
    """log of 1 + x to a base."""
    return F.log1p(x) / F.ln(F.lit(float(base)))


# ---- nucleotides ----


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTUacgtu", "TGCAAtgcaa")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def rna_pairs(a: Column, b: Column, wobble: bool = True) -> Column:
    """Watson-Crick pairs of RNA, and GU."""
    both = F.concat(F.translate(F.upper(a), "T", "U"), F.translate(F.upper(b), "T", "U"))
    return both.isin(*["AU", "UA", "CG", "GC"], *(["GU", "UG"] if wobble else []))


def nuc_number(c: Column) -> Column:
    """A 0, C 1, G 2, T and U 3, others 4."""
    at = F.instr(F.lit("ACGTU"), F.upper(c))
    return F.when((F.length(c) == 1) & (at > 0), F.least(at - 1, F.lit(3))).otherwise(4).cast("int")


def number_nuc(n: Column) -> Column:
    return F.when(n.between(0, 3), F.substring(F.lit("ACGT"), F.when(n.between(0, 3), n).otherwise(0) + 1, F.lit(1))).otherwise("N")


#: Amino acids of the standard code, codons in the order T, C, A, G of each place.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_amino(codon: Column) -> Column:
    """One-letter amino acid, * for stops; null if a base is none of ACGTU."""
    base = lambda k: F.instr(F.lit("TCAG"), F.translate(F.upper(F.substring(codon, k, 1)), "U", "T")) - 1
    a, b, c = base(1), base(2), base(3)
    return F.when((F.length(codon) == 3) & (a >= 0) & (b >= 0) & (c >= 0), F.substring(F.lit(AMINO), a * 16 + b * 4 + c + 1, F.lit(1)))


def translate_protein(seq: Column) -> Column:
    """Amino acids of the whole codons from the first base."""
    n = F.floor(F.length(seq) / 3).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.when(n > 0, n).otherwise(1)), lambda k: F.coalesce(codon_amino(F.substring(seq, (k - 1) * 3 + 1, F.lit(3))), F.lit("X"))), "")).otherwise("")


# ---- strings ----


def tokens(s: Column, delimiters: str, keep_empty: bool = False) -> Column:
    """Split at any of the delimiter characters."""
    import re

    parts = F.split(s, "[" + re.escape(delimiters) + "]", -1)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def tokens_by_string(s: Column, delimiter: str, keep_empty: bool = False) -> Column:
    import re

    parts = F.split(s, re.escape(delimiter), -1)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def is_number(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))


def number_in_base(s: Column, base: int) -> Column:
    return F.conv(s, base, 10).cast("long")


def replace_any(s: Column, characters: str, to: str) -> Column:
    """Each of the characters replaced by one other."""
    return F.translate(s, characters, to * len(characters))


def balanced(s: Column, opening: str = "(", closing: str = ")") -> Column:
    """Brackets open before they close, and all close."""
    depth = F.aggregate(
        F.split(s, ""), F.lit(0), lambda d, c: F.when(d < 0, d).when(c == opening, d + 1).when(c == closing, d - 1).otherwise(d)
    )
    return depth == 0


# ---- CIGAR ----


def cigar_parts(cigar: Column) -> Column:
    """array<struct(n, op)>"""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_blocks(pos: Column, cigar: Column, ops: tuple[str, ...] = ("M",)) -> Column:
    """Blocks of `ops` on the reference, array<struct(start, end)> inclusive; D, M, N, = and X advance it."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc, p):
        on = p["op"].isin("D", "M", "N", "=", "X")
        block = F.struct(acc["at"].alias("start"), (acc["at"] + p["n"] - 1).alias("end"))
        return F.struct((acc["at"] + F.when(on, p["n"]).otherwise(0)).alias("at"), F.when(p["op"].isin(*ops), F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cigar_parts(cigar), F.struct(pos.cast("int").alias("at"), empty.alias("out")), step)["out"]


def cigar_span(cigar: Column, read: bool = False) -> Column:
    """Length on the reference (D M N = X), or on the read (= X S M I)."""
    ops = ("=", "X", "S", "M", "I") if read else ("D", "M", "N", "=", "X")
    return F.aggregate(cigar_parts(cigar), F.lit(0), lambda s, p: s + F.when(p["op"].isin(*ops), p["n"]).otherwise(0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
