"""Text formats over lines that are made from the embeddings: each label is a structure file, each vector a residue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling, search
from ..registry import query, table
from ..sources import formats, sinks, text
from ..sources.shared import folder
from ..streaming import incremental
from .geometry import _POINTS, residues
from .retrieval import _HITS, _OTHER, _sensitivity_sql, domains, hits, other_hits

_NAMES = "ALA A GLY G TRP W SER S".split()


def structure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chains a file, an unknown residue first, and a second model."""
    name = F.element_at(F.array(*(F.lit(x) for x in _NAMES[::2])), (F.col("idx") % 4 + 1).cast("int"))
    chain = F.when(F.col("idx") < 10, "B").otherwise("C")
    line = F.format_string("ATOM  %5d  CA  %s %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", F.col("idx").cast("int"), name, chain, F.col("idx").cast("int"), "x", "y", "z")
    own = residues(spark, sf_dir).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("file"), (F.col("idx") + 2).cast("int").alias("line_no"), line.alias("line"))
    files = own.select("file").distinct()
    unknown = "ATOM      0  CA  UNK A   0       0.000   0.000   0.000  1.00  0.00           C"
    marks = [F.struct(F.lit(n).alias("line_no"), F.lit(line).alias("line")) for n, line in ((0, "MODEL        1"), (1, unknown), (100_000, "ENDMDL"), (100_001, "MODEL        2"))]
    head = files.select("file", F.explode(F.array(*marks)).alias("x")).select("file", "x.line_no", "x.line")
    again = own.withColumn("line_no", F.col("line_no") + 100_002)
    return own.unionByName(head).unionByName(again)


_RES = f"SELECT concat('s', CAST(id AS VARCHAR)) AS file, CASE WHEN idx < 10 THEN 'B' ELSE 'C' END AS chain, idx, CASE idx % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'G' WHEN 2 THEN 'W' ELSE 'S' END AS residue, printf('%.3f', x)::DOUBLE AS x, printf('%.3f', y)::DOUBLE AS y, printf('%.3f', z)::DOUBLE AS z FROM ({_POINTS})"


@query("S10_structures", f"SELECT file, chain, idx, residue, x, y, z FROM ({_RES}) WHERE idx < 10")
def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.structures(structure_lines(spark, sf_dir))


@query("S11_chain_lengths", f"SELECT file, chain, count(*)::BIGINT AS length, CASE chain WHEN 'B' THEN 0 ELSE 1 END::INT AS place FROM ({_RES}) GROUP BY 1, 2")
def chain_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chain_lengths(structure_lines(spark, sf_dir))


@query("S12_all_chains", f"SELECT file, residue, count(*)::BIGINT AS n FROM ({_RES}) GROUP BY 1, 2")
def all_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.alpha_carbons(structure_lines(spark, sf_dir), modified=True).groupBy("file", "residue").agg(F.count(F.lit(1)).alias("n"))


@query("S13_multi_model", f"SELECT DISTINCT file, true AS multi_model FROM ({_RES})")
def multi_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.multi_model(structure_lines(spark, sf_dir))


@query("S14_end_chains", f"SELECT file, 'A' AS first_chain, CASE WHEN count(*) > 10 THEN 'C' ELSE 'B' END AS last_chain FROM ({_RES}) GROUP BY 1")
def end_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.end_chains(structure_lines(spark, sf_dir))


@query("S22_first_model", f"SELECT file, count(*)::BIGINT + 3 AS n FROM ({_RES}) GROUP BY 1")
def first_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.first_model(structure_lines(spark, sf_dir)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("S15_fasta", "SELECT concat('i', CAST(item_id AS VARCHAR)) AS id, replace(text, ' ', '') AS sequence FROM (SELECT item_id, replace(replace(text, chr(10), ''), '>', '') AS text FROM benchmark)")
def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two lines each, written and read."""
    clean = F.replace(F.replace("text", F.lit("\n"), F.lit("")), F.lit(">"), F.lit(""))
    own = table(spark, sf_dir, "benchmark").select("item_id", F.replace(clean, F.lit(" "), F.lit("")).alias("s"))
    entry = F.concat(F.lit(">i"), F.col("item_id").cast("string"), F.lit(" note\n"), F.substring("s", 1, 40), F.lit("\n"), F.expr("substring(s, 41)"))
    source = own.select(F.col("item_id").cast("string").alias("file"), F.posexplode(F.split(entry, "\n")).alias("line_no", "line"))
    return text.fasta(source).select("id", "sequence")


@query("K15_fasta_entry", "SELECT concat('>', CAST(item_id AS VARCHAR), chr(10), text) AS value FROM benchmark")
def fasta_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.to_fasta(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("sequence")))


@query("S16_lookup", "SELECT key, value FROM (SELECT concat('k', CAST(p_partkey % 50 AS VARCHAR)) AS key, p_brand AS value, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey DESC) AS k FROM part) WHERE k = 1")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("line_no"), F.concat(F.lit(" k"), (F.col("p_partkey") % 50).cast("string"), F.lit("  "), "p_brand").alias("line"))
    return text.lookup(own)


@query("S9_id_list", "SELECT c_mktsegment AS id, min(c_custkey) AS seen FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1")
def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("# "), "c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" ")))
    return text.id_list(table(spark, sf_dir, "customer").select(line.alias("line"), F.col("c_custkey").alias("line_no")))


@query("S17_hit_list", "SELECT query, target, score, CAST(row_number() OVER (PARTITION BY query ORDER BY line_no) AS INT) AS rank FROM (SELECT CAST(l_orderkey AS VARCHAR) AS query, CAST(l_partkey AS VARCHAR) AS target, l_quantity AS score, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no FROM lineitem)")
def hit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sampling.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "line_no")
    return text.hits(own.select(F.lit("f").alias("file"), "line_no", F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")).alias("line")))


@query("K9_formatted_hits", f"SELECT CAST(query AS VARCHAR) AS query, CAST(target AS VARCHAR) AS target, printf('%.5f', score + sign(score) * 1e-9) AS score FROM ({_HITS})")
def formatted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists as the writer leaves them, compressed lines with five decimals, read as text."""
    where = folder(spark)
    sinks.write_hits(hits(spark, sf_dir), where)
    return spark.read.csv(where, sep="\t").toDF("query", "target", "score")


@query("K12_wide_methods", "SELECT o_custkey, sum((o_orderstatus = 'O')::INT)::BIGINT AS method_o, sum((o_orderstatus = 'F')::INT)::BIGINT AS method_f FROM orders GROUP BY 1")
def wide_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["O", "F"]).agg(F.count(F.lit(1)))
    return own.select("o_custkey", F.coalesce("O", F.lit(0)).alias("method_o"), F.coalesce("F", F.lit(0)).alias("method_f"))


@query("K12_wide_file", f"SELECT coalesce(a.query, b.query) AS query, coalesce(a.superfamily, 0) AS cosine, coalesce(b.superfamily, 0) AS other FROM ({_sensitivity_sql(_HITS)}) a FULL JOIN ({_sensitivity_sql(_OTHER)}) b ON a.query = b.query")
def wide_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods' sensitivities side by side, written as a tab-separated table and read."""
    where = folder(spark)
    tables = {name: search.sensitivity(h(spark, sf_dir), domains(spark, sf_dir)) for name, h in (("cosine", hits), ("other", other_hits))}
    sinks.write_wide(tables, where, "query", "superfamily")
    return spark.read.schema("query bigint, cosine double, other double").csv(where, sep="\t", header=True)


def _written(spark: SparkSession, lines: DataFrame, key: str, order: str, whole: bool = True) -> str:
    """A folder of text files, one for each value of key. If they need not be whole, a large one is cut into several, none within a value of order."""
    where = folder(spark)
    parts = lines.repartition(key) if whole else lines.repartitionByRange(key, order)
    parts.sortWithinPartitions(key, order).select(key, F.col("line").alias("value")).write.partitionBy(key).text(where)
    formats.register(spark)
    return where


def _name(file: str) -> Column:
    """The value that a file of _written stands for."""
    return F.regexp_extract(file, "=([^/]*)/", 1)


@query("S10_residue_format", f"SELECT file, chain, idx, residue, x, y, z FROM ({_RES}) WHERE idx < 10")
def residue_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure files written and read as a format: one chain of each."""
    where = _written(spark, structure_lines(spark, sf_dir), "file", "line_no")
    return spark.read.format("residues").option("chain", "B").load(where).withColumn("file", _name("file"))


@query("S12_residue_format", f"SELECT file, residue, count(*)::BIGINT AS n FROM ({_RES}) GROUP BY 1, 2")
def all_chains_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _written(spark, structure_lines(spark, sf_dir), "file", "line_no")
    return spark.read.format("residues").load(where).groupBy(_name("file").alias("file"), "residue").agg(F.count(F.lit(1)).alias("n"))


@query("S15_fasta_format", "SELECT concat('i', CAST(item_id AS VARCHAR)) AS id, replace(text, ' ', '') AS sequence FROM (SELECT item_id, replace(replace(text, chr(10), ''), '>', '') AS text FROM benchmark)")
def fasta_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA files of several entries, read as a format."""
    clean = F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit("")), F.lit(">"), F.lit("")), F.lit(" "), F.lit(""))
    own = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 7).cast("string").alias("part"), clean.alias("s"))
    entry = F.concat(F.lit(">i"), F.col("item_id").cast("string"), F.lit(" note\n"), F.substring("s", 1, 40), F.lit("\n"), F.expr("substring(s, 41)"))
    where = _written(spark, own.select("part", "item_id", entry.alias("line")), "part", "item_id", whole=False)
    return spark.read.format("fasta").load(where).select("id", "sequence")


@query("S17_hit_format", "SELECT CAST(l_orderkey AS VARCHAR) AS query, CAST(l_partkey AS VARCHAR) AS target, l_quantity AS score FROM lineitem")
def hit_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists in files, streamed until all are taken."""
    own = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).cast("string").alias("part"), "l_orderkey", F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")).alias("line"))
    where, out = _written(spark, own, "part", "l_orderkey", whole=False), folder(spark)
    stream = spark.readStream.format("hits").load(where).select("query", "target", "score")
    incremental.write_batches(stream, f"{out}/hits", f"{out}/state")
    return incremental.appended(spark, f"{out}/hits")
