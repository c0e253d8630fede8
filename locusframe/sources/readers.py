"""Readers and writers of segment, variant, rearrangement, catalogue and signature tables.

Schemas are explicit; a file name gives the sample where a file holds none.
Every reader returns a lazy DataFrame, so filters and column choices of what
follows reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions.lineage import settled
from locusframe.operators.segments import clean_segments, complement_chromosomes, label_loh, merge_adjacent, require_columns
from locusframe.operators.variants import variant_type


def file_stem(*endings: str) -> Column:
    """Name of the file that a row came from, without folder and the given endings."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    for e in endings:
        name = F.regexp_replace(name, f"{e}$", "")
    return name


def read_segments(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Mapping[str, str],
    sep: str = "\t",
    keep_extra: bool = False,
    sizes: DataFrame | None = None,
    complement: bool = False,
    min_segnum: int = 0,
    max_copynumber: int | None = 20,
    loh_min_length: int | None = None,
    join_adjacent: bool = False,
    order: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Segments and those dropped for their chromosomes, from delimited files with headers.

    columns maps chromosome, start_pos, end_pos, seg_val and, if the files have
    them, sample and minor_cn to header names; without sample the file name
    serves. sizes (chrom, size) is needed to complement uncalled chromosomes.
    """
    raw = spark.read.csv(path if isinstance(path, str) else list(path), sep=sep, header=True)
    require_columns(raw, *columns.values())
    typed = {"chromosome": "string", "start_pos": "long", "end_pos": "long", "seg_val": "double", "sample": "string", "minor_cn": "int"}
    cols = [F.col(f"`{columns[k]}`").try_cast(t).alias(k) for k, t in typed.items() if k in columns]
    if "sample" not in columns:
        cols.append(file_stem(r"\.gz", r"\.[A-Za-z0-9]+").alias("sample"))
    if keep_extra:
        cols += [F.col(f"`{c}`") for c in raw.columns if c not in columns.values()]
    kept, dropped = clean_segments(raw.select(*cols), max_copynumber, min_segnum)
    if complement:
        if sizes is None:
            raise ValueError("sizes are needed to complement chromosomes")
        kept = complement_chromosomes(kept, sizes)
    if loh_min_length is not None:
        require_columns(kept, "minor_cn")
        kept = label_loh(kept, loh_min_length)
    if join_adjacent:
        kept = merge_adjacent(kept, order)
    return kept, dropped


def read_sequenza(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of all *_segments.txt files of a folder: sample from the file name, total and minor copy number."""
    raw = spark.read.csv(f"{folder}/*_segments.txt", sep="\t", header=True)
    require_columns(raw, "chromosome", "start.pos", "end.pos", "CNt", "B")
    c = lambda n, t: F.col(f"`{n}`").try_cast(t)
    return raw.select(file_stem("_segments.txt").alias("sample"), c("chromosome", "string").alias("chromosome"), c("start.pos", "long").alias("start_pos"), c("end.pos", "long").alias("end_pos"), c("CNt", "int").alias("seg_val"), c("B", "int").alias("minor_cn"))


def read_ascat(spark: SparkSession, path: str | Sequence[str], sep: str = "\t") -> DataFrame:
    """Exported allele-specific segments (sample, chr, startpos, endpos, nMajor, nMinor): total copy number and source file."""
    raw = spark.read.csv(path if isinstance(path, str) else list(path), sep=sep, header=True)
    require_columns(raw, "sample", "chr", "startpos", "endpos", "nMajor", "nMinor")
    major, minor = F.col("nMajor").try_cast("int"), F.col("nMinor").try_cast("int")
    return raw.select("sample", F.col("chr").alias("chromosome"), F.col("startpos").try_cast("long").alias("start_pos"), F.col("endpos").try_cast("long").alias("end_pos"), (major + minor).alias("seg_val"), minor.alias("minor_cn"), F.input_file_name().alias("source"))


def _first_of(raw: DataFrame, names: Sequence[str]) -> Column:
    found = [c for c in raw.columns if c.lower() in [n.lower() for n in names]]
    if not found:
        raise ValueError(f"none of the columns {', '.join(names)} is present")
    return F.coalesce(*[F.col(f"`{c}`") for c in found])


def minimal_variants(raw: DataFrame) -> DataFrame:
    """A variant table from any of the usual column names; variant_type, gene and classification are filled where absent."""
    names = {
        "sample": ("Tumor_Sample_Barcode", "Sample_ID", "sample"), "chrom": ("Chromosome", "chrom", "chr"), "pos": ("Start_Position", "start", "pos"),
        "end_pos": ("End_Position", "end"), "ref": ("Reference_Allele", "reference", "ref"), "alt": ("Tumor_Seq_Allele2", "alt"),
    }
    d = {k: _first_of(raw, v).try_cast("long" if k in ("pos", "end_pos") else "string").alias(k) for k, v in names.items()}
    low = {c.lower(): c for c in raw.columns}
    extra = {"variant_type": "variant_type", "gene": "hugo_symbol", "classification": "variant_classification"}
    out = raw.select(*d.values(), *[F.col(f"`{low[v]}`").alias(k) for k, v in extra.items() if v in low])
    if "variant_type" not in out.columns:
        out = out.withColumn("variant_type", variant_type(F.col("ref"), F.col("alt")))
    for k in ("gene", "classification"):
        if k not in out.columns:
            out = out.withColumn(k, F.lit("Unknown"))
    return out


def read_maf(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Variants of mutation annotation files, each once per gene, sample, place and alleles."""
    raw = spark.read.csv(path if isinstance(path, str) else list(path), sep="\t", header=True, comment="#")
    return minimal_variants(raw).dropDuplicates(["gene", "sample", "chrom", "pos", "end_pos", "ref", "alt"])


def read_vcf(spark: SparkSession, path: str | Sequence[str], keep_only_pass: bool = True, chrom_prefix: bool = True) -> DataFrame:
    """Variants of VCF files, with or without a header: the file name gives the sample; pos, ref, alt and filter as they stand."""
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(F.split("value", "\t").alias("f"), file_stem(r"\.gz", r"\.vcf").alias("sample"), "value")
    d = lines.where(~F.col("value").startswith("#") & (F.size("f") >= 7))
    chrom = F.get("f", F.lit(0))
    if chrom_prefix:
        chrom = F.concat(F.lit("chr"), F.regexp_replace(chrom, "^(?i)chr", ""))
    g = lambda i: F.get("f", F.lit(i))
    d = d.select("sample", chrom.alias("chrom"), g(1).try_cast("long").alias("pos"), g(3).alias("ref"), g(4).alias("alt"), g(6).alias("filter"))
    if keep_only_pass:
        d = d.where(F.col("filter") == "PASS")
    return d.withColumns({"end_pos": F.col("pos") + F.length("ref") - 1, "variant_type": variant_type(F.col("ref"), F.col("alt"))})


def read_xena_variants(spark: SparkSession, path: str | Sequence[str], keep_gene: bool = True) -> DataFrame:
    """Variants of a Xena table, whatever its headers are called; without keep_gene the gene is Unknown."""
    d = minimal_variants(spark.read.csv(path if isinstance(path, str) else list(path), sep="\t", header=True))
    return d if keep_gene else d.withColumn("gene", F.lit("Unknown"))


def read_rearrangements(spark: SparkSession, path: str | Sequence[str], sep: str = "\t") -> DataFrame:
    """Rearrangements of delimited files with headers in any case, classes derived where they are absent."""
    from locusframe.operators.rearrangements import clean

    d = clean(spark.read.csv(path if isinstance(path, str) else list(path), sep=sep, header=True))
    return d.withColumns({c: F.col(c).try_cast("long") for c in ("start1", "end1", "start2", "end2")})


def read_solution(spark: SparkSession, folder: str, signatures: str = "*Signatures*.txt", activities: str = "*Activities*.txt") -> tuple[DataFrame, DataFrame]:
    """Signatures (sig, component, weight as shares) and exposures (sample, sig, amount, rel) of another tool's solution folder: tables with a column per signature. Signatures are named Sig1, Sig2, ... by their total exposure."""
    from locusframe.operators.catalog import share, signature_order

    sig = read_signatures(spark, f"{folder}/{signatures}")
    raw = spark.read.csv(f"{folder}/{activities}", sep="\t", header=True, inferSchema=True)
    key = raw.columns[0]
    expo = raw.unpivot([key], raw.columns[1:], "sig", "amount").select(F.col(key).cast("string").alias("sample"), "sig", F.col("amount").cast("double").alias("amount"))
    names = signature_order(expo).select("sig", F.concat(F.lit("Sig"), F.col("place").cast("string")).alias("_name"))
    named = lambda d: d.join(names, "sig").drop("sig").withColumnRenamed("_name", "sig")
    return named(sig).select("sig", "component", "weight"), named(expo).withColumn("rel", share("amount", "sample")).select("sample", "sig", "amount", "rel")


def read_reference(spark: SparkSession, path: str, chunk: int = 10_000, overlap: int = 300) -> DataFrame:
    """chrom, chunk_id, seq of FASTA files, any number of sequences each: chunks that overlap, so that a window around a base lies in one chunk.

    Files are read by lines, and a line's place in its sequence comes from sums
    over the lines of its block of the file and over the blocks before it, so no
    row is longer than a line or a chunk. Names end at white space; lines before
    a first name and empty sequences give nothing.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = settled(spark.read.text(path).select("value", *meta).withColumn("i", F.monotonically_increasing_id()))  # rows of a block keep the order of its lines
    head = F.col("value").startswith(">")
    seq = F.when(~head, F.upper(F.regexp_replace("value", r"\s", "")))
    w = Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = raw.withColumns({"name": F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)), "seq": seq}).drop("value")
    d = d.withColumn("run", F.sum(F.coalesce(F.length("seq"), F.lit(0))).over(w))
    began = F.when(F.col("name").isNotNull(), F.struct("name", F.col("run").alias("base"), F.col("i").alias("nth")))
    d = d.withColumn("own", F.last(began, ignorenulls=True).over(w))
    blocks = d.groupBy("file", "block").agg(F.sum(F.coalesce(F.length("seq"), F.lit(0))).alias("n"), F.max_by("own", "i").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of a file
    blocks = blocks.withColumn("past", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = F.when(F.col("last").isNotNull(), F.struct(F.col("last.name").alias("name"), (F.col("past") + F.col("last.base")).alias("base"), F.col("last.nth").alias("nth")))
    blocks = blocks.withColumn("carry", F.last(carried, ignorenulls=True).over(before)).select("file", "block", "past", "carry")
    d = d.where("length(seq) > 0").join(blocks, ["file", "block"])
    at = F.coalesce(F.struct(F.col("own.name").alias("name"), (F.col("past") + F.col("own.base")).alias("base"), F.col("own.nth").alias("nth")), "carry")
    d = d.withColumn("at", F.when(F.col("own").isNotNull(), at).otherwise(F.col("carry"))).where("at.name IS NOT NULL")
    d = d.select(F.col("at.name").alias("chrom"), "file", F.col("at.nth").alias("nth"), (F.col("past") + F.col("run") - F.length("seq") - F.col("at.base")).alias("s"), "seq").withColumn("e", F.col("s") + F.length("seq"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("s") - chunk - 2 * overlap) / chunk)), F.floor((F.col("e") - 1 + overlap) / chunk)
    d = d.withColumn("chunk_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin = F.col("chunk_id") * chunk - F.least(F.lit(overlap), F.col("chunk_id") * chunk)
    a, z = F.greatest(F.col("s"), begin), F.least(F.col("e"), begin + chunk + 2 * overlap)
    core = (F.col("s") < (F.col("chunk_id") + 1) * chunk) & (F.col("e") > F.col("chunk_id") * chunk)
    d = d.where(a < z).select("chrom", "file", "nth", "chunk_id", F.struct(a.alias("a"), F.substr("seq", (a - F.col("s") + 1).cast("int"), (z - a).cast("int")).alias("t")).alias("piece"), core.alias("core"))
    whole = d.groupBy("chrom", "file", "nth", "chunk_id").agg(F.sort_array(F.collect_list("piece")).alias("p"), F.bool_or("core").alias("core")).where("core")
    return whole.select("chrom", "chunk_id", F.array_join(F.col("p.t"), "").alias("seq"))


def opportunities(reference: DataFrame, k: int = 3, chunk: int = 10_000, overlap: int = 300, fold: bool = True) -> DataFrame:
    """component and n: how often each word of k bases starts in the reference (chrom, chunk_id, seq), each start counted once, in the chunk that it belongs to.

    Words with other letters than A, C, G and T do not count. With fold a word
    and its reverse complement are one: the one whose middle base is C or T, or
    for an even k the lesser one.
    """
    if not 0 < k <= overlap:
        raise ValueError("k must be from 1 to the overlap of the chunks")
    begin = F.least(F.lit(overlap), F.col("chunk_id") * chunk)
    starts = F.least(F.lit(chunk), F.length("seq") - begin - k + 1)
    words = F.expr(f"transform(sequence(0, cast(_n - 1 AS int)), i -> substring(seq, cast(_b AS int) + i + 1, {k}))")
    d = reference.withColumns({"_b": begin, "_n": starts}).where("_n > 0").select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("w").rlike("^[ACGT]+$"))
    if fold:
        other = F.reverse(F.translate("w", "ACGT", "TGCA"))
        w = F.least(F.col("w"), other) if k % 2 == 0 else F.when(F.substring("w", k // 2 + 1, 1).isin("C", "T"), F.col("w")).otherwise(other)
        d = d.withColumn("w", w)
    return d.groupBy(F.col("w").alias("component")).agg(F.sum("n").alias("n"))


def component_opportunities(words: DataFrame, components: DataFrame) -> DataFrame:
    """component and n of mutation components such as A[C>T]G, each with the opportunities (component, n) of its context, here ACG."""
    context = F.regexp_replace("component", r"\[(\w+)>\w+\]", "$1")
    d = components.select("component").distinct().withColumn("_w", context)
    return d.join(words.select(F.col("component").alias("_w"), "n"), "_w").select("component", "n")


def with_context(variants: DataFrame, reference: DataFrame, flank: int = 2, chunk: int = 10_000, overlap: int = 300, out: str = "context") -> DataFrame:
    """Adds the reference sequence of flank bases on both sides of pos; the join is by (chrom, chunk)."""
    r = reference.select(F.col("chrom").alias("_c"), F.col("chunk_id").alias("_k"), "seq")
    d = variants.withColumn("_q", F.floor((F.col("pos") - 1) / chunk)).join(r, (F.col("chrom") == F.col("_c")) & (F.col("_q") == F.col("_k")), "left")
    start = F.col("pos") - F.col("_k") * chunk + F.least(F.lit(overlap), F.col("_k") * chunk)
    first = F.greatest(start - flank, F.lit(1))
    return d.withColumn(out, F.substr("seq", first.cast("int"), (start + flank - first + 1).cast("int"))).drop("_c", "_k", "_q", "seq")


def signature_set(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """sig, component, weight of a named set: folder/<name>.tsv, a wide table."""
    return read_signatures(spark, f"{folder}/{name}.tsv")


def read_signatures(spark: SparkSession, path: str, sep: str = "\t", component: str | None = None) -> DataFrame:
    """sig, component, weight of a wide table (a column per signature), each signature as shares."""
    from locusframe.operators.catalog import share

    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    key = component or raw.columns[0]
    d = raw.unpivot([key], [c for c in raw.columns if c != key], "sig", "w").withColumnRenamed(key, "component").withColumn("w", F.col("w").cast("double"))
    return d.select("sig", F.regexp_replace("component", "kb", "Kb").alias("component"), share("w", "sig").alias("weight"))


def cancer_type_signatures(index: DataFrame, keyword: str, seq_type: str | None = None, source: str | None = None) -> DataFrame:
    """Rows of an index (cancer_type, signatures, and seq_type and source if asked for) whose cancer type matches the keyword, case ignored; one row per signature of the comma list."""
    d = index.where(F.col("cancer_type").rlike(f"(?i){keyword}"))
    for column, wanted in (("seq_type", seq_type), ("source", source)):
        if wanted is not None:
            require_columns(d, column)
            d = d.where(F.col(column) == wanted)
    return d.withColumn("sig", F.explode(F.split(F.regexp_replace("signatures", " ", ""), ",")))


def write_catalog(catalog: DataFrame, path: str, vocabulary: Sequence[str], sep: str = "\t") -> None:
    """The catalogue with components as rows and samples as columns, samples without counts left out."""
    samples = [r["sample"] for r in catalog.groupBy("sample").agg(F.sum("n").alias("t")).where("t >= 0.01").select("sample").orderBy("sample").collect()]  # the columns of the file
    spark = catalog.sparkSession
    vocab = spark.createDataFrame(list(enumerate(vocabulary)), "place int, component string")
    wide = catalog.groupBy("component").pivot("sample", samples).agg(F.sum("n"))
    vocab.join(wide, "component", "left").na.fill(0).orderBy("place").drop("place").coalesce(1).write.mode("overwrite").csv(path, sep=sep, header=True)


def reordered(catalog: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """The catalogue in the order of another vocabulary (column place), components without counts as 0. Raises if a component is not in it."""
    vocab = catalog.sparkSession.createDataFrame(list(enumerate(vocabulary)), "place int, component string")
    lost = catalog.join(vocab, "component", "left_anti").select("component").distinct().limit(5).collect()
    if lost:
        raise ValueError(f"not in the vocabulary: {', '.join(r['component'] for r in lost)}")
    spine = catalog.select("sample").distinct().crossJoin(F.broadcast(vocab))
    return spine.join(catalog, ["sample", "component"], "left").select("sample", "place", "component", F.coalesce("n", F.lit(0)).alias("n"))


def write_signature_tables(signature: DataFrame, exposure: DataFrame, folder: str, reference: DataFrame | None = None) -> None:
    """CSV folders of an extraction: signature, exposure_absolute, exposure_relative, dominant, and with reference signatures similarity and best_match."""
    from locusframe.operators import catalog as C

    tables = {"signature": signature, "exposure_absolute": exposure.select("sample", "sig", "amount"), "exposure_relative": C.relative_exposure(exposure), "dominant": C.dominant_signature(exposure)}
    if reference is not None:
        pairs = C.cosine_pairs(signature.select("sig", "component", F.col("share" if "share" in signature.columns else "weight").alias("weight")), reference, "sig", "sig")
        tables |= {"similarity": pairs, "best_match": C.best_match(pairs)}
    write_tables(tables, folder, "csv")


def write_fit_tables(fitted: DataFrame, folder: str) -> None:
    """CSV folders of a fit: exposure_absolute, exposure_relative (shares of a sample) and error."""
    from locusframe.operators.catalog import share

    d = fitted.select("sample", "sig", "exposure")
    errors = fitted.groupBy("sample").agg(F.first("error").alias("error"), F.first("cosine").alias("cosine"))
    write_tables({"exposure_absolute": d, "exposure_relative": d.select("sample", "sig", share("exposure", "sample").alias("rel")), "error": errors}, folder, "csv")


def write_bootstrap_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """CSV folders of fit_bootstrap_batch: expo, error and p_val."""
    write_tables({k: tables[k] for k in ("expo", "error", "p_val")}, folder, "csv")


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Each table under its name in the folder."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{folder}/{name}")


def pending(tasks: DataFrame, done_path: str, keys: Sequence[str]) -> DataFrame:
    """Tasks whose keys are not among the rows written to done_path yet, so that an interrupted job goes on where it stopped."""
    spark = tasks.sparkSession
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(done_path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return tasks
    return tasks.join(spark.read.parquet(done_path).select(*keys).distinct(), list(keys), "left_anti")
