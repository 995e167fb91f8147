"""Line-based formats as DataFrames: structure files, FASTA, lookups, id lists, cluster maps and ranked hits. Lines keep their file and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import RESIDUES

#: Modified residues and the residues that they stand for.
PARENTS = "MSE MET SEC CYS PYL LYS SEP SER TPO THR PTR TYR CSO CYS HYP PRO MLY LYS"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no from 0 and line, for text files that are read whole each, so that order is the file's own."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def csv_columns(spark: SparkSession, path: str, schema: StructType | str, columns: list[str]) -> DataFrame:
    """Some columns of a CSV table with a header; the parser passes over the others. Rows come split by split, so no table is read whole."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False).select(*columns)


def multi_model(source: DataFrame) -> DataFrame:
    """file and whether it has more than one model."""
    return source.groupBy("file").agg((F.sum(F.col("line").startswith("MODEL").cast("int")) > 1).alias("multi_model"))


def first_model(source: DataFrame) -> DataFrame:
    """Lines up to the end of the first model."""
    ends = F.sum(F.col("line").startswith("ENDMDL").cast("int")).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return source.withColumn("_ended", F.coalesce(ends, F.lit(0))).where("_ended = 0").drop("_ended")


def alpha_carbons(source: DataFrame, modified: bool = False) -> DataFrame:
    """file, chain, line_no, residue letter and place of the alpha carbons of the first model; unknown residues are left out.

    With modified residues, these count as the ones they stand for, also in HETATM lines.
    """
    words = RESIDUES.split()
    if modified:
        names = dict(zip(words[::2], words[1::2], strict=True))
        parents = PARENTS.split()
        words = [*words, *(x for a, b in zip(parents[::2], parents[1::2], strict=True) for x in (a, names[b]))]
    letter = F.create_map(*(F.lit(x) for x in words))[F.trim(F.substring("line", 18, 3))]
    kinds = ("ATOM  ", "HETATM") if modified else ("ATOM  ",)
    atoms = first_model(source).where(F.substring("line", 1, 6).isin(*kinds) & (F.trim(F.substring("line", 13, 4)) == "CA"))
    number = lambda at: F.trim(F.substring("line", at, 8)).try_cast("double")
    own = atoms.select("file", F.substring("line", 22, 1).alias("chain"), "line_no", letter.alias("residue"), F.substring("line", 23, 5).alias("number"), number(31).alias("x"), number(39).alias("y"), number(47).alias("z"))
    first = Window.partitionBy("file", "chain", "number").orderBy("line_no")  # alternative places of one residue
    return own.where("residue is not null").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "number")


def structures(source: DataFrame, chain: str | None = None) -> DataFrame:
    """idx, letter and place of the residues of one chain: the named one, or the first with a standard residue. A file without it gives no rows; use require_chain to refuse."""
    own = alpha_carbons(source)
    if chain is None:
        first = own.groupBy("file").agg(F.min_by("chain", "line_no").alias("chain"))
        own = own.join(first, ["file", "chain"])
    else:
        own = own.where(F.col("chain") == chain)
    idx = (F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).cast("bigint")
    return own.select("file", "chain", idx.alias("idx"), "residue", "x", "y", "z")


def require_chain(source: DataFrame, chain: str) -> DataFrame:
    """The chain's residues; an error for a file without it."""
    missing = source.select("file").distinct().join(structures(source, chain).select("file").distinct(), "file", "left_anti")
    for row in missing.limit(1).collect():
        raise ValueError(f"{row['file']} has no chain {chain!r}")
    return structures(source, chain)


def chain_lengths(source: DataFrame) -> DataFrame:
    """file, chain, number of residues, and the chain's place among the file's chains from 0."""
    own = alpha_carbons(source).groupBy("file", "chain").agg(F.count(F.lit(1)).alias("length"), F.min("line_no").alias("first"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("first")) - 1).drop("first")


def end_chains(source: DataFrame) -> DataFrame:
    """file, first and last chain of the atoms of the first model."""
    atoms = first_model(source).where(F.col("line").startswith("ATOM"))
    return atoms.groupBy("file").agg(F.min_by(F.substring("line", 22, 1), "line_no").alias("first_chain"), F.max_by(F.substring("line", 22, 1), "line_no").alias("last_chain"))


def fasta(source: DataFrame) -> DataFrame:
    """id (the first word after '>') and sequence (its lines joined) of every entry; lines before the first entry are left out."""
    entry = F.sum(F.col("line").startswith(">").cast("int")).over(Window.partitionBy("file").orderBy("line_no"))
    own = source.withColumn("entry", entry).where("entry > 0")
    parts = own.groupBy("file", "entry").agg(F.sort_array(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))).alias("p"))  # the lines of one sequence
    return parts.select("file", F.regexp_extract(F.col("p")[0]["line"], r"^>\s*(\S*)", 1).alias("id"), F.array_join(F.transform(F.slice("p", 2, 1_000_000), lambda x: x["line"]), "").alias("sequence"))


def to_fasta(sequences: DataFrame) -> DataFrame:
    """value: the text of an entry, for write.text."""
    return sequences.select(F.concat(F.lit(">"), "id", F.lit("\n"), "sequence").alias("value"))


def lookup(source: DataFrame) -> DataFrame:
    """key and value: the first two words of each line that has two; the last line of a key wins."""
    words = F.split(F.trim("line"), r"\s+")
    own = source.where(F.size(words) >= 2).select(words[0].alias("key"), words[1].alias("value"), "file", "line_no")
    return own.groupBy("key").agg(F.max_by("value", F.struct("file", "line_no")).alias("value"))


def id_list(source: DataFrame) -> DataFrame:
    """id and seen (its first place) of lines that are not blank or comments, each id once."""
    own = source.select(F.trim("line").alias("id"), "line_no").where("id <> '' and not startswith(id, '#')")
    return own.groupBy("id").agg(F.min("line_no").alias("seen"))


def cluster_map(source: DataFrame) -> DataFrame:
    """member and representative of lines with two tab-separated fields; the last line of a member wins."""
    fields = F.split("line", "\t")
    own = source.where(F.size(fields) >= 2).select(F.trim(fields[1]).alias("member"), F.trim(fields[0]).alias("representative"), "file", "line_no")
    return own.groupBy("member").agg(F.max_by("representative", F.struct("file", "line_no")).alias("representative"))


def hits(source: DataFrame) -> DataFrame:
    """query, target, score if there is one, and rank: the line's place among its query's, from 1."""
    fields = F.split("line", "\t")
    own = source.where(F.size(fields) >= 2).select(fields[0].alias("query"), fields[1].alias("target"), F.get(fields, 2).try_cast("double").alias("score"), "file", "line_no")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("file", "line_no"))).drop("file", "line_no")


def closest_overlap(overlaps: DataFrame, least: float = 0.5) -> DataFrame:
    """query, hit and greatest identity of hits (query, target, fident, qstart, qend, qlen) that cover enough of the query; the first wins ties."""
    covered = overlaps.where((F.col("qend") - F.col("qstart") + 1) / F.col("qlen") >= least)
    return covered.groupBy("query").agg(F.max_by(F.struct("target", "fident"), F.struct("fident", -F.col("line_no"))).alias("x")).select("query", "x.target", "x.fident")
