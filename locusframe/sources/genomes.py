"""Genome dimensions: chromosome sizes and centromeres that come with the library, other tables from the caller's folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lengths of chromosomes 1, 2, ..., X, Y of the public assemblies.
SIZES = {
    "hg19": (
        249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895,
        115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566,
    ),
    "hg38": (
        248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309,
        114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415,
    ),
    "mm10": (
        195471971, 182113224, 160039680, 156508116, 151834684, 149736546, 145441459, 129401213, 124595110, 130694993, 122082543, 120129022,
        120421639, 124902244, 104043685, 98207768, 94987271, 90702639, 61431566, 171031299, 91744698,
    ),
}
# First base of the centromere gap of hg19; each is three million bases long.
CENTROMERES_HG19 = (
    121535434, 92326171, 90504854, 49660117, 46405641, 58830166, 58054331, 43838887, 47367679, 39254935, 51644205, 34856694,
    16000000, 16000000, 17000000, 35335801, 22263006, 15460898, 24681782, 26369569, 11288129, 13000000, 58632012, 10104553,
)
CENTROMERE_LENGTH = 3_000_000
KINDS = ("chr_size", "centro_loc", "cytobands", "transcript", "gene")


def chromosomes(build: str) -> list[str]:
    n = len(SIZES[build]) - 2
    return [*(f"chr{i}" for i in range(1, n + 1)), "chrX", "chrY"]


def genome_annotation(spark: SparkSession, kind: str, build: str = "hg19", chrs: Sequence[str] = (), folder: str | None = None) -> DataFrame:
    """A dimension of a genome build, for the chromosomes chrs in their order (all in their natural order if none are named); a column place holds the order.

    chr_size (chrom, size) of hg19, hg38 and mm10 and centro_loc (chrom, size,
    cen_left, cen_right) of hg19 come with the library. Any other table is read
    as Parquet from folder/<build>/<kind>; it has a column chrom.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    if folder is not None:
        d, known = spark.read.parquet(f"{folder}/{build}/{kind}"), chromosomes(build) if build in SIZES else []
    elif kind == "chr_size" and build in SIZES:
        known = chromosomes(build)
        d = spark.createDataFrame(list(zip(known, SIZES[build], strict=True)), "chrom string, size long")
    elif kind == "centro_loc" and build == "hg19":
        known = chromosomes(build)
        d = spark.createDataFrame([(c, n, a, a + CENTROMERE_LENGTH) for c, n, a in zip(known, SIZES[build], CENTROMERES_HG19, strict=True)], "chrom string, size long, cen_left long, cen_right long")
    else:
        raise ValueError(f"no {kind} of {build} comes with the library; name a folder that holds it")
    wanted = list(chrs) or known
    if not wanted:
        return d.withColumn("place", F.lit(None).cast("int"))
    place = F.array_position(F.array(*[F.lit(c) for c in wanted]), F.col("chrom")).cast("int")
    return d.withColumn("place", place).where("place > 0").orderBy("place", *[c for c in ("start_pos",) if c in d.columns])


def genome_size(build: str, kind: str = "autosome") -> int:
    """Length of the autosomes, of X or of Y."""
    n = SIZES[build]
    return {"autosome": sum(n[:-2]), "X": n[-2], "Y": n[-1]}[kind]
