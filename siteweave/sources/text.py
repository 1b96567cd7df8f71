"""Readers and writers of the text formats; gz and bz2 by their codecs. All parse by splits inside the JVM.

Regions are read into (chrom, start, end, ...) counted from 1, inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteweave.functions.scalar import genotype_code, haplotype_code, is_number, normalise_chrom
from siteweave.operators.reads import flagged
from siteweave.operators.tiles import numbered


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def _fields(df: DataFrame, sep: str = "\t") -> DataFrame:
    return df.select(F.split(F.rtrim("value"), sep).alias("f"))


def _get(k: int) -> Column:
    return F.try_element_at("f", F.lit(k))


def _data(df: DataFrame) -> DataFrame:
    """Without blank, comment, track and browser lines."""
    return df.where(~F.col("value").rlike(r"^\s*($|#|track\b|browser\b)"))


def bed(spark: SparkSession, path) -> DataFrame:
    """BED of 3 to 6 columns; name `.`, score 0 and strand + where absent."""
    f = _fields(_data(lines(spark, path)), r"[\t ]+")
    score = F.when(is_number(_get(5)), _get(5).cast("double")).otherwise(0.0)
    return f.select(normalise_chrom(_get(1)).alias("chrom"), (_get(2).cast("int") + 1).alias("start"), _get(3).cast("int").alias("end"), F.coalesce(_get(4), F.lit(".")).alias("name"), score.alias("score"), F.coalesce(_get(6), F.lit("+")).alias("strand"))


def bed12(spark: SparkSession, path) -> DataFrame:
    """With thick ends and blocks as intervals."""
    f = _fields(_data(lines(spark, path)))
    start = _get(2).cast("int") + 1
    sizes, starts = (F.transform(F.filter(F.split(_get(k), ","), lambda x: x != ""), lambda x: x.cast("int")) for k in (11, 12))
    blocks = F.zip_with(starts, sizes, lambda s, n: F.struct((start + s).alias("start"), (start + s + n - 1).alias("end")))
    return f.select(normalise_chrom(_get(1)).alias("chrom"), start.alias("start"), _get(3).cast("int").alias("end"), _get(4).alias("name"), _get(5).cast("double").alias("score"), _get(6).alias("strand"), (_get(7).cast("int") + 1).alias("thick_start"), _get(8).cast("int").alias("thick_end"), blocks.alias("intervals"))


def bed_with_line(spark: SparkSession, path) -> DataFrame:
    """Regions with the whole line."""
    own = _data(lines(spark, path)).select("value", F.split("value", "\t").alias("f"))
    return own.select(normalise_chrom(_get(1)).alias("chrom"), (_get(2).cast("int") + 1).alias("start"), _get(3).cast("int").alias("end"), F.col("value").alias("line"))


def bed_pq(spark: SparkSession, path) -> DataFrame:
    """Regions with log p and log q in columns 7 and 8."""
    f = _fields(_data(lines(spark, path)))
    return f.select(normalise_chrom(_get(1)).alias("chrom"), (_get(2).cast("int") + 1).alias("start"), _get(3).cast("int").alias("end"), _get(4).alias("name"), _get(6).alias("strand"), _get(7).cast("double").alias("log_p"), _get(8).cast("double").alias("log_q"))


def narrow_peak(spark: SparkSession, path) -> DataFrame:
    f = _fields(_data(lines(spark, path)))
    return f.select(normalise_chrom(_get(1)).alias("chrom"), (_get(2).cast("int") + 1).alias("start"), _get(3).cast("int").alias("end"), _get(4).alias("name"), _get(5).cast("double").alias("score"), _get(6).alias("strand"), _get(7).cast("double").alias("signal"), _get(8).cast("double").alias("log_p"), _get(9).cast("double").alias("log_q"), _get(10).cast("int").alias("summit"))


def interval(spark: SparkSession, path) -> DataFrame:
    """name, chrom, strand, start, end, number of intervals, starts, ends."""
    f = _fields(_data(lines(spark, path)))
    starts, ends = (F.transform(F.filter(F.split(_get(k), ","), lambda x: x != ""), lambda x: x.cast("int")) for k in (7, 8))
    return f.select(normalise_chrom(_get(2)).alias("chrom"), (_get(4).cast("int") + 1).alias("start"), _get(5).cast("int").alias("end"), _get(1).alias("name"), _get(3).alias("strand"), F.zip_with(starts, ends, lambda s, e: F.struct((s + 1).alias("start"), e.alias("end"))).alias("intervals"))


def gff(spark: SparkSession, path) -> DataFrame:
    """Nine tab-separated columns, else an error; attributes as a map, in `a=b;` or `a "b";` form."""
    f = _fields(_data(lines(spark, path)))
    nine = F.when(F.size("f") == 9, _get(9)).otherwise(F.raise_error(F.lit("a GFF line without 9 columns")))
    parts = F.filter(F.transform(F.split(nine, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pair = lambda x: F.struct(F.regexp_extract(x, r"^([^=\s]+)", 1).alias("key"), F.regexp_replace(F.regexp_replace(x, r"^[^=\s]+[=\s]?\s*", ""), '^"|"$', "").alias("value"))
    number = lambda k: F.when(is_number(_get(k)), _get(k).cast("double"))
    return f.select(normalise_chrom(_get(1)).alias("chrom"), _get(2).alias("source"), _get(3).alias("feature"), _get(4).cast("int").alias("start"), _get(5).cast("int").alias("end"), number(6).alias("score"), _get(7).alias("strand"), _get(8).alias("frame"), F.map_from_entries(F.transform(parts, pair)).alias("attributes"), nine.alias("group"))


# ---- variants ----


def vcf_samples(spark: SparkSession, path) -> list[str]:
    """Sample ids of the #CHROM line: one row reaches the driver."""
    row = lines(spark, path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    return row[0]["value"].rstrip("\r").split("\t")[9:] if row else []


def vcf(spark: SparkSession, path, haplotypes: bool = False) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info map, format, gt array, g array): GT by its place in FORMAT."""
    code = haplotype_code if haplotypes else genotype_code
    f = lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split(F.rtrim("value"), "\t").alias("f"))
    at = F.array_position(F.split(_get(9), ":"), "GT").cast("int")
    calls = F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0)))
    gt = F.transform(calls, lambda c: F.when(at > 0, F.try_element_at(F.split(c, ":"), F.when(at > 0, at).otherwise(1))))
    info = F.map_from_entries(F.array_distinct(F.transform(F.filter(F.split(_get(8), ";"), lambda x: x != ""), lambda x: F.struct(F.split(x, "=", 2)[0].alias("key"), F.coalesce(F.try_element_at(F.split(x, "=", 2), F.lit(2)), F.lit("")).alias("value")))))
    return f.select(normalise_chrom(_get(1)).alias("chrom"), _get(2).cast("int").alias("pos"), _get(3).alias("id"), _get(4).alias("ref"), _get(5).alias("alt"), _get(6).alias("qual"), _get(7).alias("filter"), info.alias("info"), _get(9).alias("format"), gt.alias("gt"), F.transform(gt, code).alias("g"))


def split_vcf(spark: SparkSession, path, chroms: list[str], out: str) -> None:
    """Lines of the listed chromosomes to a folder for each, as text; header lines to header/, a copy for all."""
    own = lines(spark, path)
    own.where(F.col("value").startswith("#")).coalesce(1).write.mode("overwrite").text(f"{out}/header")
    data = own.where(~F.col("value").startswith("#")).withColumn("chrom", normalise_chrom(F.split("value", "\t")[0]))
    data.where(F.col("chrom").isin(chroms)).write.mode("overwrite").partitionBy("chrom").text(f"{out}/lines")


def write_vcf(variants: DataFrame, samples: list[str], path: str, haplotypes: bool = False) -> None:
    """Genotypes (chrom, pos, id, ref, alt, g) as VCF lines under a header line in a file of its own order."""
    gt = {0: "0/0", 1: "0/1", 2: "1/1"} if not haplotypes else {0: "0|0", 1: "0|1", 2: "1|0", 3: "1|1"}
    call = lambda x: F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in gt.items()], F.lit("./."))
    body = variants.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join(F.transform("g", call), "\t")).alias("value"))
    head = variants.sparkSession.createDataFrame([("##fileformat=VCFv4.2",), ("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]),)], "value string").coalesce(1)
    head.unionAll(body).write.mode("overwrite").text(path)


def gmmat(spark: SparkSession, path) -> DataFrame:
    """(var_id, ref, alt, g array): headerless id, ref, alt and one genotype a sample; values outside 0, 1, 2 are -1."""
    f = _fields(lines(spark, path).where("value <> ''"))
    g = F.transform(F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))), lambda x: F.when(x.isin("0", "1", "2"), F.when(x.isin("0", "1", "2"), x).cast("int")).otherwise(-1))
    return f.select(_get(1).alias("var_id"), _get(2).alias("ref"), _get(3).alias("alt"), g.alias("g"))


def write_gmmat(wide: DataFrame, path: str) -> None:
    wide.select(F.concat_ws("\t", "var_id", "ref", "alt", F.array_join(F.transform("g", lambda x: x.cast("string")), "\t")).alias("value")).write.mode("overwrite").text(path)


# ---- models, signals, matrices ----


def features(spark: SparkSession, path) -> DataFrame:
    """(subject_id, x array): tab-separated with a header; column 2 must be INTERCEPT."""
    t = spark.read.csv(path, sep="\t", header=True)
    if len(t.columns) < 2 or t.columns[1] != "INTERCEPT":
        raise ValueError("the second column of a feature matrix must be INTERCEPT")
    return t.select(F.col(f"`{t.columns[0]}`").alias("subject_id"), F.array(*[F.col(f"`{c}`").cast("double") for c in t.columns[1:]]).alias("x"))


def phenotypes(spark: SparkSession, path) -> DataFrame:
    t = spark.read.csv(path, sep="\t", header=True)
    if len(t.columns) < 2 or t.columns[1] != "PHENOTYPE":
        raise ValueError("the second column of phenotypes must be PHENOTYPE")
    return t.select(F.col(f"`{t.columns[0]}`").alias("subject_id"), F.col("PHENOTYPE").cast("double").alias("y"))


def read_model(text: str) -> list[tuple[int, str, float]]:
    """N_COVARS n, then a name and a weight a line."""
    rows = [x.split() for x in text.splitlines() if x.strip()]
    if rows[0][0] != "N_COVARS" or int(rows[0][1]) != len(rows) - 2:
        raise ValueError("the model's first line must give the number of covariates")
    return [(k, name, float(w)) for k, (name, w) in enumerate(rows[1:])]


def write_model(beta: list[float]) -> str:
    return "\n".join([f"N_COVARS {len(beta) - 1}", *[f"{'INTERCEPT' if k == 0 else f'COVAR_{k - 1}'} {w:.17g}" for k, w in enumerate(beta)]]) + "\n"


def signal_bed(spark: SparkSession, path) -> DataFrame:
    """(chrom, start, end, name, sample, v) of `#CHROM START END NAME sample ...`."""
    head = lines(spark, path).where(F.col("value").startswith("#")).limit(1).collect()
    samples = head[0]["value"].split("\t")[4:] if head else []
    f = _fields(_data(lines(spark, path)))
    names = F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>")
    own = f.select(normalise_chrom(_get(1)).alias("chrom"), (_get(2).cast("int") + 1).alias("start"), _get(3).cast("int").alias("end"), _get(4).alias("name"), F.explode(F.arrays_zip(names.alias("s"), F.slice("f", 5, F.greatest(F.size("f") - 4, F.lit(0))).alias("v"))).alias("x"))
    return own.select("chrom", "start", "end", "name", F.col("x.s").alias("sample"), F.col("x.v").cast("double").alias("v"))


def bedgraph(spark: SparkSession, path) -> DataFrame:
    f = _fields(_data(lines(spark, path)), r"[\t ]+")
    return f.select(normalise_chrom(_get(1)).alias("chrom"), (_get(2).cast("int") + 1).alias("start"), _get(3).cast("int").alias("end"), _get(4).cast("double").alias("v"))


def write_bedgraph(runs: DataFrame, path: str) -> None:
    runs.select(F.concat_ws("\t", "chrom", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.col("v").cast("string")).alias("value")).write.mode("overwrite").text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines that are not blank, numbered from 0 in the order of files and places in them. Numbers are made split by split, so a file need not be one task."""
    own = lines(spark, path).select("value", F.struct(F.input_file_name().alias("f"), F.input_file_block_start().alias("b")).alias("at"), F.monotonically_increasing_id().alias("i"))
    own = own.where("trim(value) <> ''")
    return numbered(own, F.col("at"), [F.col("i")], "n").select((F.col("n") - 1).cast("int").alias("n"), "value")


def text_matrix(spark: SparkSession, path: str, row_ids: bool = False, col_ids: bool = False) -> DataFrame:
    """(row, col, v) of a tab-separated file, or of a folder of parts in the order of their names."""
    own = numbered_lines(spark, path)
    if col_ids:
        own = own.where("n > 0").withColumn("n", F.col("n") - 1)
    cells = F.split(F.rtrim("value"), "\t")
    cells = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))) if row_ids else cells
    return own.select(F.col("n").alias("row"), F.posexplode(cells).alias("col", "t")).select("row", "col", F.col("t").cast("double").alias("v"))


def dumped(rows: DataFrame) -> DataFrame:
    """(row, line) of Matrix.rows(): `Row i:` and values of four places."""
    return rows.select("row", F.concat(F.format_string("Row %d:\t", "row"), F.array_join(F.transform("v", lambda x: F.format_string("%.4f", x)), "\t")).alias("line"))


def binary_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, nrow, ncol, row, v array): int32 rows, int32 columns, then row-major doubles, little-endian."""
    files = binary_files(spark, path)

    def read(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for p, b in zip(f["path"], f["content"], strict=True):
                n, m = np.frombuffer(b, "<i4", 2)
                x = np.frombuffer(b, "<f8", int(n) * int(m), 8).reshape(int(n), int(m))
                yield pd.DataFrame({"path": p, "nrow": int(n), "ncol": int(m), "row": range(int(n)), "v": list(x)})

    return files.mapInPandas(read, "path string, nrow int, ncol int, row int, v array<double>")


def encode_matrix(x) -> bytes:
    """The bytes that binary_matrix() reads, of a numpy matrix."""
    import numpy as np

    return np.asarray(x.shape, "<i4").tobytes() + np.ascontiguousarray(x, "<f8").tobytes()


def write_binary_matrix(cells: DataFrame, nrow: int, ncol: int, path: str) -> None:
    """Cells (row, col, v) as files that binary_matrix() reads: one of all rows, made in one task, as the format has it."""

    def pack(pdf):
        import numpy as np
        import pandas as pd

        x = np.zeros((nrow, ncol))
        x[pdf["row"], pdf["col"]] = pdf["v"]
        return pd.DataFrame({"name": ["matrix.bin"], "content": [encode_matrix(x)]})

    own = cells.select("row", "col", "v", F.lit(0).alias("all"))
    write_files(own.groupBy("all").applyInPandas(pack, "name string, content binary"), path)


def write_files(files: DataFrame, path: str) -> None:
    """Contents (name, content) into a folder, as rows of Parquet: a task lost and run again leaves one of each."""
    files.select("name", "content").write.parquet(path)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a folder: plain files, or those of write_files()."""
    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).limit(1).count()
    if own:
        return spark.read.parquet(path).select(F.col("name").alias("path"), "content")
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: Bytes of a run: int32 start, int32 end, float64 value, little-endian.
RUN = 16


def write_binary_runs(runs: DataFrame, path: str) -> None:
    """Runs (chrom, start, end, v), a content for each chromosome and a million positions, by start."""

    def pack(pdf):
        import numpy as np
        import pandas as pd

        own = pdf.sort_values("start")
        out = np.zeros(len(own), np.dtype([("s", "<i4"), ("e", "<i4"), ("v", "<f8")]))
        out["s"], out["e"], out["v"] = own["start"], own["end"], own["v"]
        return pd.DataFrame({"name": [f"{own['chrom'].iloc[0]}.{int(own['tile'].iloc[0])}"], "content": [out.tobytes()]})

    tiled = runs.select("chrom", "start", "end", "v", F.floor(F.col("start") / 1_000_000).alias("tile"))
    write_files(tiled.groupBy("chrom", "tile").applyInPandas(pack, "name string, content binary"), path)


def binary_runs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, v) of contents named by chromosome and part."""

    def read(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for p, b in zip(f["path"], f["content"], strict=True):
                x = np.frombuffer(b, np.dtype([("s", "<i4"), ("e", "<i4"), ("v", "<f8")]))
                yield pd.DataFrame({"chrom": p.rsplit("/", 1)[-1].rsplit(".", 1)[0], "start": x["s"], "end": x["e"], "v": x["v"]})

    return binary_files(spark, path).mapInPandas(read, "chrom string, start int, end int, v double")


# ---- reads and sequences ----


def sam(spark: SparkSession, path) -> DataFrame:
    """Mapped reads (read_id, flag, chrom, pos, cigar, seq, strand)."""
    f = lines(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    own = f.select(_get(1).alias("read_id"), _get(2).cast("int").alias("flag"), normalise_chrom(_get(3)).alias("chrom"), _get(4).cast("int").alias("pos"), _get(6).alias("cigar"), _get(10).alias("seq"))
    return flagged(own)


def _simple(chrom, start, length, strand, read_id=None) -> list[Column]:
    return [(F.lit(".") if read_id is None else read_id).alias("read_id"), normalise_chrom(chrom).alias("chrom"), start.cast("int").alias("pos"), F.concat(length.cast("int").cast("string"), F.lit("M")).alias("cigar"), strand.alias("strand")]


def tag_align(spark: SparkSession, path) -> DataFrame:
    """chrom, start, end, sequence, score, strand."""
    f = _fields(_data(lines(spark, path)))
    return f.select(*_simple(_get(1), _get(2).cast("int") + 1, _get(3).cast("int") - _get(2).cast("int"), _get(6)))


def bowtie(spark: SparkSession, path) -> DataFrame:
    """read, strand, chrom, offset from 0, sequence."""
    f = _fields(_data(lines(spark, path)))
    return f.select(*_simple(_get(3), _get(4).cast("int") + 1, F.length(_get(5)), _get(2), _get(1)))


def eland(spark: SparkSession, path) -> DataFrame:
    """read, sequence, match code, ..., chrom in column 7, position, strand F or R; only rows with a match."""
    f = _fields(_data(lines(spark, path)))
    own = f.where(_get(3).rlike("^U") & (F.size("f") >= 9))
    return own.select(*_simple(F.regexp_replace(_get(7), r"\.fa$", ""), _get(8), F.length(_get(2)), F.when(_get(9) == "F", "+").otherwise("-"), _get(1)))


def bed_reads(spark: SparkSession, path, columns: int = 6) -> DataFrame:
    """BED of 4, 5 or 6 columns as reads: the strand is the last of them."""
    f = _fields(_data(lines(spark, path)))
    return f.select(*_simple(_get(1), _get(2).cast("int") + 1, _get(3).cast("int") - _get(2).cast("int"), _get(columns)))


#: Bases of a chunk at most.
CHUNK = 1 << 16


def _sequence_pieces(keep: bool):
    """A reader of lines (file, block, value) in the order of each file's splits.

    Yields (file, block, k, head, at, n, seq): chunks of the k-th sequence of a split, from `at` bases after its header. That
    with k 0 goes on from the split before. A header has a row without bases. keep: with the bases, else their number only.
    """

    def read(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ("file", "block", "k", "head", "at", "n", "seq")
        split, k, head, at = None, 0, None, 0
        waiting: list[str] = []
        size = 0
        rows: list[tuple] = []

        def put(n: int, seq: str | None) -> None:
            nonlocal at
            rows.append((*split, k, head, at, n, seq))
            at += n

        def flush() -> None:
            nonlocal size
            if not keep:
                if size:
                    put(size, None)
            else:
                whole = "".join(waiting)
                for p in range(0, len(whole), CHUNK):
                    put(len(whole[p : p + CHUNK]), whole[p : p + CHUNK])
            waiting.clear()
            size = 0

        def out() -> "pa.RecordBatch":
            cols = zip(*rows, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (file, block) != split:
                    if split:
                        flush()
                    split, k, head, at = (file, block), 0, None, 0
                if value.startswith(">"):
                    flush()
                    k, head, at = k + 1, value[1:], 0
                    put(0, None)
                    continue
                bases = "".join(value.split())
                size += len(bases)
                if keep:
                    waiting.append(bases)
                    if size >= CHUNK:
                        flush()
            if rows:
                yield out()
        if split:
            flush()
        if rows:
            yield out()

    return read


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, seq): chunks of CHUNK bases at most, start counted from 1.

    Two passes over the files' splits: the first finds, for each split, its last header and the bases since; added up
    over the splits of a file, a row each, they say which sequence a split goes on with and where. So a sequence of any
    number of lines is read in as many tasks as its file has splits. What comes before a file's first header is an error.
    """
    own = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    schema = "file string, block long, k int, head string, at long, n long, seq string"
    sizes = own.mapInArrow(_sequence_pieces(False), schema)
    last = F.max(F.struct("k", (F.col("at") + F.col("n")).alias("bases"), "head")).alias("last")
    each = sizes.groupBy("file", "block").agg(last)
    before = Window.partitionBy("file").orderBy("block")
    each = each.withColumn("run", F.sum((F.col("last.k") > 0).cast("int")).over(before))  # splits since one with a header
    since = Window.partitionBy("file", "run").orderBy("block")
    each = each.withColumn("head_so_far", F.first("last.head").over(since)).withColumn("bases_so_far", F.sum("last.bases").over(since))
    brought = each.select("file", "block", F.lag("head_so_far").over(before).alias("brought"), F.lag("bases_so_far").over(before).alias("more"))
    pieces = own.mapInArrow(_sequence_pieces(True), schema).where("n > 0").join(brought, ["file", "block"])
    head = F.when(F.col("k") > 0, F.col("head")).otherwise(F.col("brought"))
    head = F.coalesce(head, F.raise_error(F.concat(F.lit("bases before the first header: "), F.col("file"))).cast("string"))
    start = F.when(F.col("k") > 0, F.lit(0)).otherwise(F.col("more")) + F.col("at") + 1
    return pieces.select(normalise_chrom(F.split(F.trim(head), r"\s+")[0]).alias("chrom"), start.cast("int").alias("start"), F.upper("seq").alias("seq"))


# ---- writers ----


def write_bed(regions: DataFrame, path: str) -> None:
    """BED of six columns; zero-based, half-open."""
    col = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in regions.columns else F.lit(d)
    regions.select(F.concat_ws("\t", "chrom", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), col("name", "."), col("score", "0"), col("strand", "+")).alias("value")).write.mode("overwrite").text(path)


def write_gff(regions: DataFrame, path: str) -> None:
    col = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in regions.columns else F.lit(d)
    regions.select(F.concat_ws("\t", "chrom", col("source", "."), col("feature", "region"), F.col("start").cast("string"), F.col("end").cast("string"), col("score", "."), col("strand", "."), col("frame", "."), col("group", ".")).alias("value")).write.mode("overwrite").text(path)


def write_interval(regions: DataFrame, path: str) -> None:
    join = lambda field, less: F.array_join(F.transform("intervals", lambda x: (x[field] - less).cast("string")), ",")
    regions.select(F.concat_ws("\t", "name", "chrom", "strand", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.size("intervals").cast("string"), join("start", 1), join("end", 0)).alias("value")).write.mode("overwrite").text(path)
