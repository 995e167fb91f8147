"""Search over the embeddings by the cosine of whole vectors; fold, superfamily and family are the signs of the first components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import search
from ..registry import query, table

TOP = 50


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = [F.when(F.get("embedding", k) >= 0, "p").otherwise("n") for k in range(4)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat_ws("", *sign).alias("family"), F.concat_ws("", *sign[:3]).alias("superfamily"), F.concat_ws("", *sign[:2]).alias("fold"))


def hits(spark: SparkSession, sf_dir: str, k: int = TOP) -> DataFrame:
    return search.blocked_top_k(vectors(spark, sf_dir), k)


def other_hits(spark: SparkSession, sf_dir: str, k: int = TOP) -> DataFrame:
    """A second method: the cosine of signed squares of the components."""
    return search.blocked_top_k(vectors(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x * F.abs(x))), k)


def _hits_sql(component: str = "x::DOUBLE", k: int = TOP) -> str:
    v = f"SELECT vec_id AS id, list_transform(embedding, lambda x: {component}) AS v FROM embeddings"
    unit = f"SELECT id, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9)) AS u FROM ({v})"
    return f"SELECT query, target, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS rank FROM (SELECT a.id AS query, b.id AS target, round(list_inner_product(a.u, b.u), 6) AS score FROM ({unit}) a, ({unit}) b WHERE a.id <> b.id)) WHERE rank <= {k}"


_DOMAINS = "SELECT vec_id AS id, concat(s1, s2, s3, s4) AS family, concat(s1, s2, s3) AS superfamily, concat(s1, s2) AS fold FROM (SELECT vec_id, " + ", ".join(f"CASE WHEN embedding[{k}] >= 0 THEN 'p' ELSE 'n' END AS s{k}" for k in range(1, 5)) + " FROM embeddings)"
_SIZES = f"SELECT *, count(*) OVER (PARTITION BY family) AS nf, count(*) OVER (PARTITION BY superfamily) AS ns, count(*) OVER (PARTITION BY fold) AS no FROM ({_DOMAINS})"
_HITS, _OTHER = _hits_sql(), _hits_sql("x::DOUBLE * abs(x::DOUBLE)")


def _found_sql(hits_sql: str, rows: str) -> str:
    return f"""SELECT query, sum((q.family = t.family)::INT) AS hf, sum((q.superfamily = t.superfamily AND q.family <> t.family)::INT) AS hs, sum((q.fold = t.fold AND q.superfamily <> t.superfamily)::INT) AS ho
 FROM ({rows.format(hits_sql)}) h JOIN ({_DOMAINS}) q ON h.query = q.id LEFT JOIN ({_DOMAINS}) t ON h.target = t.id GROUP BY query"""


_BEFORE_FP = f"SELECT query, target, rank FROM (SELECT h.*, sum((q.fold <> t.fold)::INT) OVER (PARTITION BY query ORDER BY rank) AS fp FROM ({{0}}) h JOIN ({_DOMAINS}) q ON h.query = q.id JOIN ({_DOMAINS}) t ON h.target = t.id) WHERE fp = 0"


def _sensitivity_sql(hits_sql: str) -> str:
    return f"SELECT s.id AS query, round(coalesce(hf, 0) / (nf - 1), 6) AS family, round(coalesce(hs, 0) / (ns - nf + 1), 6) AS superfamily, round(coalesce(ho, 0) / (no - ns + 1), 6) AS fold FROM ({_SIZES}) s LEFT JOIN ({_found_sql(hits_sql, _BEFORE_FP)}) f ON s.id = f.query WHERE nf > 1 AND ns > nf AND no > ns"


def _recall_sql(hits_sql: str, k: int) -> str:
    return f"SELECT s.id AS query, round(coalesce(hf, 0) / (nf - 1), 6) AS family, round(coalesce(hs, 0) / (ns - nf), 6) AS superfamily, round(coalesce(ho, 0) / (no - ns), 6) AS fold FROM ({_SIZES}) s LEFT JOIN ({_found_sql(hits_sql, 'SELECT * FROM ({0}) WHERE rank <= ' + str(k))}) f ON s.id = f.query WHERE nf > 1 AND ns > nf AND no > ns"


@query("T1_cosine_topk", _HITS)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


def named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by names that do not sort as their numbers do."""
    name = F.concat(F.lit("d"), F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 6), F.lit("_"), F.col("id").cast("string"))
    return vectors(spark, sf_dir).select(name.alias("id"), "vec")


_NAME = "concat('d', substr(md5(CAST({0} AS VARCHAR)), 1, 6), '_', CAST({0} AS VARCHAR))"


@query("T1_named_topk", f"SELECT query, target, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS INT) AS rank FROM (SELECT {_NAME.format('query')} AS query, {_NAME.format('target')} AS target, score FROM ({_hits_sql(k=100000)})) QUALIFY rank <= {TOP}")
def named_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.blocked_top_k(named_vectors(spark, sf_dir), TOP)


@query("T1_pruned_topk", _hits_sql(k=10))
def pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as the plain search, by cells around pivots."""
    return search.pruned_top_k(vectors(spark, sf_dir), 10).hits


def named_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures of 1, 3, 5, ... residues: the whole root of a vector's number says which it belongs to."""
    own = table(spark, sf_dir, "embeddings").select(F.floor(F.sqrt(F.col("vec_id").cast("double"))).alias("s"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    lists = own.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("vec_id", "vec"))).alias("r"))  # one chain
    return lists.select(F.concat(F.lit("S"), F.lpad((F.col("s") * 7 % 1000).cast("string"), 4, "0"), F.lit("_"), F.col("s").cast("string")).alias("id"), F.transform("r", lambda x: x["vec"]).alias("vecs"))


_RESIDUES = "SELECT concat('S', lpad(CAST(s * 7 % 1000 AS VARCHAR), 4, '0'), '_', CAST(s AS VARCHAR)) AS id, vec_id, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9)) AS u FROM (SELECT CAST(floor(sqrt(vec_id::DOUBLE)) AS BIGINT) AS s, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_MATRIX = f"SELECT a.id AS query, b.id AS target, a.vec_id AS i, b.vec_id AS j, list_inner_product(a.u, b.u) AS s FROM r a JOIN r b ON a.id <> b.id"
_LINES = "SELECT query, target, max(s) AS best, sum(exp((s - m) / 0.1) * s) / sum(exp((s - m) / 0.1)) AS soft FROM (SELECT *, max(s) OVER (PARTITION BY query, target, {0}) AS m FROM c) GROUP BY query, target, {0}"


@query("J8_matrix_scores", f"""WITH r AS MATERIALIZED ({_RESIDUES}), c AS MATERIALIZED ({_MATRIX}),
a AS (SELECT query, target, round(avg(best), 6) AS row_best, round(avg(soft), 6) AS row_soft FROM ({_LINES.format('i')}) GROUP BY 1, 2),
b AS (SELECT query, target, round(avg(best), 6) AS col_best, round(avg(soft), 6) AS col_soft FROM ({_LINES.format('j')}) GROUP BY 1, 2),
m AS (SELECT query, target, round(avg(s), 6) + 0.0 AS mean_all FROM c GROUP BY 1, 2)
SELECT * FROM a JOIN b USING (query, target) JOIN m USING (query, target)""")
def matrix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of structures by their residue matrices, in blocks of 65,536 entries, which is many blocks even here."""
    return search.matrix_scores(named_structures(spark, sf_dir), cells=1 << 16)


@query("J8_all_against_all", "SELECT query, target, score FROM (" + _hits_sql(k=100000) + ") WHERE query % 20 = 0")
def all_against_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain form: a stated set of queries against all vectors, with the whole embedding."""
    own = vectors(spark, sf_dir)
    return search.cosine_pairs(own.where("id % 20 = 0"), own).where("query <> target")


@query("E1_sensitivity_first_fp", _sensitivity_sql(_HITS))
def sensitivity_first_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sensitivity(hits(spark, sf_dir), domains(spark, sf_dir))


@query("A28_search_means", f"SELECT 'cosine' AS method, round(avg(family), 6) AS family, round(avg(superfamily), 6) AS superfamily, round(avg(fold), 6) AS fold FROM ({_sensitivity_sql(_HITS)}) UNION ALL SELECT 'other', round(avg(family), 6), round(avg(superfamily), 6), round(avg(fold), 6) FROM ({_sensitivity_sql(_OTHER)})")
def search_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [search.sensitivity(h(spark, sf_dir), domains(spark, sf_dir)).withColumn("method", F.lit(name)) for name, h in (("cosine", hits), ("other", other_hits))]
    return own[0].unionByName(own[1]).groupBy("method").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("family", "superfamily", "fold")))


@query("A10_level_sizes", f"SELECT id, nf AS n_family, ns AS n_superfamily, no AS n_fold FROM ({_SIZES})")
def level_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.level_sizes(domains(spark, sf_dir)).select("id", "n_family", "n_superfamily", "n_fold")


@query("A11_eligible", f"SELECT id FROM ({_SIZES}) WHERE nf > 1 AND ns > nf AND no > ns")
def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.level_sizes(domains(spark, sf_dir)).where("eligible").select("id")


@query("E2_denominators", f"SELECT id, nf - 1 AS family, ns - nf + 1 AS superfamily, no - ns + 1 AS fold FROM ({_SIZES})")
def denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = search.level_sizes(domains(spark, sf_dir))
    return own.select("id", (F.col("n_family") - 1).alias("family"), (F.col("n_superfamily") - F.col("n_family") + 1).alias("superfamily"), (F.col("n_fold") - F.col("n_superfamily") + 1).alias("fold"))


@query("E3_unknown_targets", f"SELECT round(avg((target % 13 = 5)::INT), 6) AS share, avg((target % 13 = 5)::INT) > 0.01 AS warn FROM ({_HITS})")
def unknown_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = domains(spark, sf_dir).where("id % 13 <> 5").select(F.col("id").alias("target"), F.lit(True).alias("known"))
    unknown = F.avg(F.col("known").isNull().cast("double"))
    return hits(spark, sf_dir).join(known, "target", "left").agg(F.round(unknown, 6).alias("share"), (unknown > 0.01).alias("warn"))


for _k in (10, 50):

    def _recall(spark: SparkSession, sf_dir: str, k: int = _k) -> DataFrame:
        return search.recall_at(hits(spark, sf_dir), domains(spark, sf_dir), k)

    query(f"E4_recall_at_{_k}", _recall_sql(_HITS, _k))(_recall)


@query("U3_hit_union", f"SELECT query, target FROM ({_HITS}) WHERE rank <= 10 UNION SELECT query, target FROM ({_OTHER}) WHERE rank <= 10")
def hit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, 10).select("query", "target").unionByName(other_hits(spark, sf_dir, 10).select("query", "target")).dropDuplicates()


@query("E5_union_recall", _recall_sql(f"SELECT DISTINCT query, target, 1 AS rank FROM (SELECT query, target, rank FROM ({_HITS}) UNION ALL SELECT query, target, rank FROM ({_OTHER})) WHERE rank <= 10", 10))
def union_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recall_at(hit_union(spark, sf_dir).withColumn("rank", F.lit(1)), domains(spark, sf_dir), 10)


_PAIRED = f"SELECT a.query, a.superfamily AS a, b.superfamily AS b FROM ({_sensitivity_sql(_HITS)}) a JOIN ({_sensitivity_sql(_OTHER)}) b ON a.query = b.query"
_DRAWS = 200


def bootstrap_sql(paired: str, draws: int = _DRAWS) -> str:
    return f"""WITH s AS MATERIALIZED ({paired}), n AS (SELECT count(*) AS n FROM s), d AS (SELECT row_number() OVER (ORDER BY query) - 1 AS number, a - b AS diff FROM s),
p AS (SELECT x // n AS draw, CAST(concat('0x', substr(md5(concat(CAST(x // n AS VARCHAR), '|', CAST(x % n AS VARCHAR))), 1, 8)) AS BIGINT) % n AS number FROM n, range({draws} * (SELECT n FROM n)) r(x)),
m AS (SELECT draw, avg(diff) AS mean FROM p JOIN d USING (number) GROUP BY 1)
SELECT (SELECT round(avg(diff), 6) FROM d) AS difference, (SELECT sum((diff > 0)::INT)::BIGINT FROM d) AS wins_a, (SELECT sum((diff < 0)::INT)::BIGINT FROM d) AS wins_b, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m"""


@query("E6_paired_bootstrap", bootstrap_sql(_PAIRED))
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = search.sensitivity(hits(spark, sf_dir), domains(spark, sf_dir)).select("query", F.col("superfamily").alias("a"))
    b = search.sensitivity(other_hits(spark, sf_dir), domains(spark, sf_dir)).select("query", F.col("superfamily").alias("b"))
    return search.paired_bootstrap(a.join(b, "query"), _DRAWS)


_RERANKED = f"SELECT query, target, CAST(row_number() OVER (PARTITION BY query ORDER BY rank <= 20 DESC, CASE WHEN rank <= 20 THEN s END DESC NULLS LAST, rank) AS INT) AS rank FROM (SELECT *, round(1 / (1 + abs(query - target)), 9) AS s FROM ({_HITS}))"


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rerank(hits(spark, sf_dir).withColumn("s", F.round(1 / (1 + F.abs(F.col("query") - F.col("target"))), 9)), "s", 20).select("query", "target", "rank")


@query("T4_reranked", _RERANKED)
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir)


@query("T3_head_and_tail", f"SELECT query, CAST(sum((rank <= 20)::INT) AS BIGINT) AS head, CAST(sum((rank > 20)::INT) AS BIGINT) AS tail FROM ({_HITS}) GROUP BY 1")
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_head = F.col("rank") <= 20
    return hits(spark, sf_dir).groupBy("query").agg(F.sum(in_head.cast("bigint")).alias("head"), F.sum((~in_head).cast("bigint")).alias("tail"))


@query("E8_reranked_sensitivity", _sensitivity_sql(_RERANKED))
def reranked_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sensitivity(reranked(spark, sf_dir), domains(spark, sf_dir))


_Z = "(round(score, 6) - avg(score) OVER (PARTITION BY query)) / (stddev_pop(score) OVER (PARTITION BY query) + 1e-12)"


@query("N17_blend", f"SELECT query, target, round(0.25 * z + 0.75 * r, 5) AS blend FROM (SELECT query, target, {_Z} AS z, 1.0 / rank AS r FROM ({_HITS}))")
def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hits(spark, sf_dir).withColumn("z", search.z_score("score"))
    return own.select("query", "target", F.round(0.25 * F.col("z") + 0.75 / F.col("rank"), 5).alias("blend"))


@query("W2_first_per_target", f"SELECT query, target, min(rank) AS rank FROM (SELECT query, target, rank FROM ({_HITS}) UNION ALL SELECT query, target, rank FROM ({_OTHER})) GROUP BY 1, 2")
def first_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).unionByName(other_hits(spark, sf_dir)).groupBy("query", "target").agg(F.min("rank").alias("rank"))


@query("W3_rank_within_query", f"SELECT query, target, CAST(rank - 1 AS INT) AS rank FROM ({_HITS})")
def rank_within_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query", "target", (F.col("rank") - 1).alias("rank"))


@query("W4_before_first_fp", _BEFORE_FP.format(_HITS))
def before_first_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = search.resolved(hits(spark, sf_dir), domains(spark, sf_dir))
    wrong = F.sum(F.coalesce(F.col("q_fold") != F.col("t_fold"), F.lit(True)).cast("int")).over(Window.partitionBy("query").orderBy("rank"))
    return rows.withColumn("fp", wrong).where("fp = 0").select("query", "target", "rank")


@query("F9_resolved_names", f"SELECT query, CASE WHEN target % 5 <> 0 THEN target END AS target FROM ({_HITS}) WHERE rank <= 5")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are, or without their last part if only that is known; some are known in neither form."""
    known = domains(spark, sf_dir).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("name"), "id")
    own = hits(spark, sf_dir, 5).withColumn("raw", F.concat(F.when(F.col("target") % 5 == 0, "x").otherwise("d"), F.col("target").cast("string"), F.when(F.col("target") % 2 == 1, "_A").otherwise("")))
    own = own.withColumn("short", F.regexp_replace("raw", "_[^_]*$", ""))
    whole = known.select(F.col("name").alias("raw"), F.col("id").alias("id1"))
    cut = known.select(F.col("name").alias("short"), F.col("id").alias("id2"))
    return own.join(whole, "raw", "left").join(cut, "short", "left").select("query", F.coalesce("id1", "id2").alias("target"))


@query("F10_identity_filter", f"SELECT query, target FROM ({_HITS}) WHERE CASE WHEN query % 3 = 0 THEN NULL ELSE query % 10 / 10.0 END < 0.3")
def identity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries near the training set go; an unknown identity is no identity under the cut."""
    ident = F.when(F.col("query") % 3 != 0, F.col("query") % 10 / 10)
    return hits(spark, sf_dir).where(ident < 0.3).select("query", "target")


@query("E6_split_bootstrap")
def split_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand draws, by names of queries."""
    a, b = (search.sensitivity(h(spark, sf_dir), domains(spark, sf_dir)).select(F.concat(F.lit("q"), F.col("query").cast("string")).alias("query"), F.col("superfamily").alias(name)) for name, h in (("a", hits), ("b", other_hits)))
    return search.split_bootstrap(a.join(b, "query"), 10_000)
