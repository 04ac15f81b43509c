"""The registered queries of the association engine and the DuckDB SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions.normal import CHI2_MEDIAN, neg_log10_p, quantile
from kinspark.operators import blocks, prep, tables
from kinspark.operators.eachvariant import score_each
from kinspark.operators.many import fit_many, score_many
from kinspark.operators.nullmodel import fit_joint, fit_single
from kinspark.operators.scoretest import calibration, score
from kinspark.sources.cohort import brand_dosages, cohort, pair_grm, part_dosages, table
from kinspark.sources.files import relatedness, sample_lines

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

COHORT = """
o AS (SELECT o_custkey, count(*) AS x2, avg(o_totalprice) AS spent FROM orders GROUP BY 1),
b AS (SELECT c_custkey AS iid, c_custkey // 2 AS family, c_nationkey::DOUBLE AS x1, coalesce(x2, 0)::DOUBLE AS x2,
    ((c_custkey // 2) * 37 % 11)::DOUBLE AS fe, coalesce(spent, 0) AS spent, c_acctbal FROM customer LEFT JOIN o ON c_custkey = o_custkey),
y AS (SELECT *, c_acctbal / 1000 + fe / 2 AS y, count(*) OVER () AS n FROM b),
cohort AS (SELECT iid, family, x1, x2, 0.5 * y + spent / 100000 + fe / 4 AS s, y, CASE WHEN iid * 10 < n * 4 THEN y END AS y_obs FROM y)"""
DOSAGES = """
geno AS (SELECT p_brand AS snp, o_custkey AS iid, least(count(*), 2)::DOUBLE AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
ONE_EACH = "independent AS (SELECT family, arg_min(iid, ((iid * 7919 + 13) % 10007) * 1000000000 + iid) AS iid FROM cohort GROUP BY 1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """-0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def members(people: DataFrame) -> DataFrame:
    return people.select("iid", F.col("family").alias("block_id"))


def independent(people: DataFrame) -> DataFrame:
    return people.join(blocks.one_of_each(members(people)), "iid", "left_semi")


@query(f"WITH {COHORT} SELECT iid, family, x1, x2, round(s, 6) AS s, round(y, 6) AS y FROM cohort WHERE y_obs IS NOT NULL")
def cohort_complete_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir).dropna(subset=["y_obs", "s", "x1", "x2"])
    return rounded(people.select("iid", "family", "x1", "x2", "s", "y"), "s", "y")


@query(f"WITH {COHORT} SELECT iid, family FROM cohort WHERE y_obs IS NULL")
def anti_join_unobserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    return people.join(people.filter("y_obs is not null").select("iid"), "iid", "left_anti").select("iid", "family")


@query("SELECT c_custkey AS iid, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("iid"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("iid"), "c_name").join(urgent, "iid", "left_semi")


@query("SELECT c_custkey AS iid, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def align_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("iid"), "n_name")


@query("SELECT o_custkey AS iid FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("iid"), "o_orderstatus")
    return orders.filter("o_orderstatus = 'F'").select("iid").intersect(orders.filter("o_orderstatus = 'O'").select("iid"))


@query("""WITH l AS (SELECT DISTINCT c_mktsegment AS s FROM customer)
SELECT c_custkey AS iid, (c_mktsegment = (SELECT s FROM l ORDER BY s LIMIT 1 OFFSET 1))::INT AS level_1,
    (c_mktsegment = (SELECT s FROM l ORDER BY s LIMIT 1 OFFSET 2))::INT AS level_2,
    (c_mktsegment = (SELECT s FROM l ORDER BY s LIMIT 1 OFFSET 3))::INT AS level_3,
    (c_mktsegment = (SELECT s FROM l ORDER BY s LIMIT 1 OFFSET 4))::INT AS level_4 FROM customer""")
def one_hot_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    levels = [r[0] for r in customers.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # a handful of segments
    hot = prep.one_hot(customers, "c_mktsegment", levels)
    return hot.select(F.col("c_custkey").alias("iid"), *[F.col(f"`c_mktsegment_{v}`").alias(f"level_{k}") for k, v in enumerate(levels[1:], 1)])


@query(f"WITH {COHORT} SELECT iid, x1 * x1 AS x1_2, x1 * (x2 - 1) AS x1_x2, x1 * x1 * (x2 - 1) AS x1_2_x2 FROM cohort")
def derived_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1, x2 = F.col("x1"), F.col("x2")
    return cohort(spark, sf_dir).select("iid", (x1 * x1).alias("x1_2"), (x1 * (x2 - 1)).alias("x1_x2"), (x1 * x1 * (x2 - 1)).alias("x1_2_x2"))


RANK_SQL = "rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2"


@query(f"WITH t AS (SELECT c_custkey AS iid, c_acctbal AS v FROM customer) SELECT iid, {RANK_SQL} AS rank FROM t")
def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.average_rank(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("iid"), F.col("c_acctbal").alias("v")), "v").select("iid", "rank")


@query(f"""WITH {COHORT}, t AS (SELECT iid, round(y_obs, 6) AS v FROM cohort), k AS (SELECT *, count(*) OVER () AS n FROM t WHERE v IS NOT NULL),
r AS (SELECT iid, ({RANK_SQL} - 0.375) / (n + 0.25) AS p FROM k) SELECT t.iid, round({quantile('p')}, 6) AS z FROM t LEFT JOIN r ON t.iid = r.iid""")
def int_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = rounded(cohort(spark, sf_dir).select("iid", F.col("y_obs").alias("v")), "v")
    return rounded(prep.inverse_normal(people, "v", into="z"), "z").select("iid", "z")


@query(f"""WITH {COHORT} SELECT 'x1' AS feature, round(corr(x1, y), 6) AS corr FROM cohort UNION ALL SELECT 'x2', round(corr(x2, y), 6) FROM cohort
UNION ALL SELECT 's', round(corr(s, y), 6) FROM cohort UNION ALL SELECT 'y_obs', NULL""")
def corr_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.correlations(cohort(spark, sf_dir), ["x1", "x2", "s", "y_obs"], "y"), "corr")


@query(f"""WITH {COHORT}, c AS (SELECT 'x1' AS feature, round(corr(x1, y), 6) AS corr FROM cohort UNION ALL SELECT 'x2', round(corr(x2, y), 6) FROM cohort
UNION ALL SELECT 's', round(corr(s, y), 6) FROM cohort) SELECT * FROM c ORDER BY abs(corr) DESC, feature LIMIT 2""")
def topk_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.top_k(rounded(prep.correlations(cohort(spark, sf_dir), ["x1", "x2", "s"], "y"), "corr"), "corr", 2, "feature")


@query(f"""WITH t AS (SELECT (c_mktsegment = 'BUILDING')::INT AS g, c_acctbal AS v FROM customer), r AS (SELECT g, v, {RANK_SQL} AS rk FROM t),
k AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY v)),
a AS (SELECT sum(g)::BIGINT AS n1, sum(1 - g)::BIGINT AS n0, sum(rk * g) AS r1, count(*)::DOUBLE AS n FROM r),
w AS (SELECT n1, n0, n, r1 - n1 * (n1 + 1) / 2 AS w, ties FROM a, k),
z AS (SELECT n1, n0, w, (w - n1 * n0 / 2 - sign(w - n1 * n0 / 2) * 0.5) ** 2 / (n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))) AS t FROM w)
SELECT n1, n0, w, round({neg_log10_p('t')}, 6) AS neg_log10_p FROM z""")
def wilcoxon_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select((F.col("c_mktsegment") == "BUILDING").cast("int").alias("g"), F.col("c_acctbal").alias("v"))
    return rounded(prep.rank_sum(customers, "g", "v"), "neg_log10_p")


#: Columns of two values, of any coding; the last has one value, the one before it three.
FLAGS = {f"f{k:02d}": f"CASE WHEN c_nationkey = {k} THEN {k % 3 + 1} ELSE {k % 3} END" for k in range(18)} | {
    "three": "c_nationkey % 3", "constant": "CASE WHEN c_nationkey < 0 THEN 0 ELSE 1 END",
}


def _rank_sum_sql(name: str, flag: str) -> str:
    return f"""SELECT '{name}' AS "column", * FROM (WITH t AS (SELECT {flag} AS c, c_acctbal AS v FROM customer), r AS (SELECT c = (SELECT max(c) FROM t) AS g, {RANK_SQL} AS rk FROM t),
k AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY v)), o AS (SELECT count(DISTINCT c) AS codes FROM t),
a AS (SELECT count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n0, sum(rk) FILTER (WHERE g) AS r1, count(*)::DOUBLE AS n FROM r),
w AS (SELECT n1, n0, n, r1 - n1 * (n1 + 1) / 2 AS w, ties, codes FROM a, k, o),
z AS (SELECT *, (w - n1 * n0 / 2 - sign(w - n1 * n0 / 2) * 0.5) ** 2 / nullif(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1))), 0) AS t FROM w)
SELECT CASE WHEN codes = 2 THEN n1 END AS n1, CASE WHEN codes = 2 THEN n0 END AS n0, CASE WHEN codes = 2 THEN w END AS w,
    CASE WHEN codes = 2 THEN round({neg_log10_p('t')}, 6) ELSE 0 END AS neg_log10_p FROM z)"""


@query(" UNION ALL ".join(_rank_sum_sql(n, f) for n, f in FLAGS.items()))
def rank_sum_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_acctbal", *[F.expr(f).alias(n) for n, f in FLAGS.items()])
    return rounded(prep.rank_sums(customers, list(FLAGS), "c_acctbal"), "neg_log10_p")


#: 3,000 features of each person, by arithmetic on the id.
FEATURES = 3000


@query(f"""WITH {COHORT} SELECT 'v' || k AS feature, CASE WHEN min(x) < max(x) THEN round(corr(x, y), 6) END AS corr
FROM (SELECT k, ((iid * (k + 1) + k) % 1009)::DOUBLE AS x, y FROM cohort, range({FEATURES}) r(k)) GROUP BY k""")
def wide_correlation_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = f"transform(sequence(0, {FEATURES - 1}), k -> cast((iid * (k + 1) + k) % 1009 AS double))"
    people = cohort(spark, sf_dir).select("y", F.expr(feature).alias("features"))
    return rounded(prep.wide_correlations(people, [f"v{k}" for k in range(FEATURES)], "features", "y"), "corr")


GRM = "grm AS (SELECT a.iid AS i, b.iid AS j, CASE WHEN a.iid = b.iid THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS k FROM cohort a JOIN cohort b ON a.family = b.family)"


@query(f"WITH {COHORT}, {GRM} SELECT * FROM grm")
def grm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.canonical(pair_grm(cohort(spark, sf_dir)))


@query(f"WITH {COHORT}, {GRM} SELECT round(count(*) / (SELECT count(*) * 1.0 * count(*) FROM cohort), 12) AS density FROM grm")
def grm_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    return rounded(blocks.density(pair_grm(people), people.count()), "density", digits=12)


@query(f"WITH {COHORT}, {GRM} SELECT * FROM grm WHERE i IN (SELECT iid FROM cohort WHERE y_obs IS NOT NULL) AND j IN (SELECT iid FROM cohort WHERE y_obs IS NOT NULL)")
def grm_submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    return blocks.submatrix(pair_grm(people), people.filter("y_obs is not null"))


def _links(spark: SparkSession, sf_dir: str, weakness: float = 0.004) -> tuple[DataFrame, DataFrame]:
    """Ids and entries of uneven blocks: pairs, some of which a weak entry joins."""
    people = cohort(spark, sf_dir)
    weak = people.filter("iid % 6 = 1").select(F.col("iid").alias("i"), (F.col("iid") + 1).alias("j"), F.lit(weakness).alias("k"))
    return people.select("iid"), blocks.canonical(pair_grm(people).unionByName(weak.filter(F.col("j") < people.count())))


BLOCK_SQL = f"""WITH {COHORT}, {GRM}, e AS (SELECT * FROM grm UNION ALL SELECT iid, iid + 1, 0.004 FROM cohort WHERE iid % 6 = 1 AND iid + 1 < (SELECT count(*) FROM cohort)),
m AS (SELECT iid, greatest(iid, (SELECT max(j) FROM e WHERE e.i = iid AND k >= {{}})) AS m FROM cohort),
r AS (SELECT iid, coalesce(max(m) OVER (ORDER BY iid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reached FROM m)
SELECT iid, max(CASE WHEN reached < iid THEN iid END) OVER (ORDER BY iid) AS block_id FROM r"""


@query(BLOCK_SQL.format(0))
def block_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks(*_links(spark, sf_dir))


@query(BLOCK_SQL.format(0.005))
def block_detect_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks(*_links(spark, sf_dir), threshold=0.005)


_AT = [BLOCK_SQL.replace("0.004", "0.0065").format(t) for t in (0.006, 0.007)]
_LARGEST = "(SELECT max(c) FROM (SELECT count(*) AS c FROM a GROUP BY block_id))"


@query(f"WITH a AS ({_AT[0]}), b AS ({_AT[1]}) SELECT * FROM a WHERE {_LARGEST} <= 3 UNION ALL SELECT * FROM b WHERE {_LARGEST} > 3")
def block_detect_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.adaptive_blocks(*_links(spark, sf_dir, 0.0065), most=3)[0]


@query(f"WITH {COHORT}, {ONE_EACH} SELECT iid FROM independent")
def independent_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.one_of_each(members(cohort(spark, sf_dir)))


@query(f"""WITH {COHORT}, z AS (SELECT family, count(*) AS c, ((family * 7919 + 1) % 10007) AS o FROM cohort GROUP BY 1),
runs AS (SELECT *, coalesce(sum(c) OVER (ORDER BY o, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    (SELECT round_even(0.8 * count(*), 0) FROM cohort) AS target FROM z)
SELECT iid, CASE WHEN abs(before + c - target) <= abs(before - target) THEN 'train' ELSE 'test' END AS split FROM cohort JOIN runs USING (family)""")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.split_by_blocks(members(cohort(spark, sf_dir)))


@query()
def block_split_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, links = _links(spark, sf_dir)
    return blocks.best_split(blocks.blocks(people, links))


@query("""WITH v AS (SELECT p_partkey AS snp, p_partkey - (SELECT min(p_partkey) FROM part) AS position, (SELECT count(*) FROM part) AS n FROM part),
a AS (SELECT *, greatest(0, (position * 7 + n - 2) // (n - 1) - 1) AS "array" FROM v)
SELECT snp, position, "array", (row_number() OVER (PARTITION BY "array" ORDER BY position) - 1) // 200 AS chunk FROM a""")
def variant_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("snp"))
    least = parts.agg(F.min("snp")).first()[0]
    return blocks.variant_chunks(parts.withColumn("position", F.col("snp") - least), 7)


@query(f"""WITH {COHORT}, {DOSAGES}, w AS (SELECT DISTINCT p_brand AS snp, length(p_brand) / 10.0 AS w FROM part WHERE p_size > 0)
SELECT iid, round(sum(g * w) / 10 + 0.4, 6) AS prs FROM geno JOIN w USING (snp) GROUP BY iid""")
def prs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "part").select(F.col("p_brand").alias("snp"), (F.length("p_brand") / 10.0).alias("w")).distinct()
    return rounded(prep.weighted_score(brand_dosages(spark, sf_dir), weights, intercept=2.0), "prs")


@query(f"""WITH {COHORT}, geno AS (SELECT l_partkey AS snp, o_custkey AS iid, least(count(*), 2)::DOUBLE AS g FROM lineitem JOIN orders
    ON l_orderkey = o_orderkey WHERE l_quantity >= 49 GROUP BY 1, 2),
s AS (SELECT snp, count(*) AS c, min(g) AS a, max(g) AS b FROM geno JOIN cohort USING (iid) WHERE y_obs IS NOT NULL GROUP BY 1)
SELECT p_partkey AS snp FROM part WHERE p_partkey NOT IN (SELECT snp FROM s WHERE c < (SELECT count(y_obs) FROM cohort) OR a < b)""")
def monomorphic_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = cohort(spark, sf_dir).filter("y_obs is not null")
    variants = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("snp"))
    return blocks.monomorphic(variants, part_dosages(spark, sf_dir), seen, seen.count())


def scan_sql(where: str, response: str, ddof: int, extra: str = "") -> str:
    """One covariate: residuals and information in closed form."""
    return f"""WITH {COHORT}, {DOSAGES}{extra}, d AS (SELECT iid, x1 AS x, {response} AS y FROM cohort WHERE {where}),
m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM d),
r AS (SELECT iid, x - mx AS xc, y - my - sxy / sxx * (x - mx) AS e, n, sxx, (syy - sxy * sxy / sxx) / (n - {ddof}) AS v FROM d, m),
a AS (SELECT snp, sum(g * e) AS u, sum(g * g) - sum(g) ** 2 / any_value(n) - sum(g * xc) ** 2 / any_value(sxx) AS q, any_value(v) AS v FROM geno JOIN r USING (iid) GROUP BY 1),
t AS (SELECT snp, CASE WHEN q > 1e-9 THEN u * u / (v * q) END AS t, CASE WHEN q > 1e-9 THEN u / q END AS beta, CASE WHEN q > 1e-9 THEN v / q END AS var_beta FROM a)
SELECT snp, round(t, 6) AS t_score, round({neg_log10_p('t')}, 6) AS neg_log10_p, round(beta, 6) AS beta, round(var_beta, 6) AS var_beta FROM t"""


def _tidy(results: DataFrame) -> DataFrame:
    return rounded(results, "t_score", "neg_log10_p", "beta", "var_beta")


def _scan(spark: SparkSession, sf_dir: str, people: DataFrame, response: str, covariance: str, grm: DataFrame | None = None, floor: float | None = None) -> DataFrame:
    rows = people.withColumn("_response", F.col(response))
    return _tidy(score(brand_dosages(spark, sf_dir), fit_single(rows, grm, ["x1"], "_response", covariance, floor)))


@query(scan_sql("y_obs IS NOT NULL", "y_obs", 2))
def ols_scan_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, cohort(spark, sf_dir).filter("y_obs is not null"), "y_obs", "ols")


@query(scan_sql("y_obs IS NULL", "s", 2))
def ols_scan_unobserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, cohort(spark, sf_dir).filter("y_obs is null"), "s", "ols")


@query(scan_sql("iid IN (SELECT iid FROM independent)", "y", 1, f", {ONE_EACH}"))
def diag_oracle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, independent(cohort(spark, sf_dir)), "y", "diag")


@query(scan_sql("y_obs IS NOT NULL AND iid IN (SELECT iid FROM independent)", "y_obs", 1, f", {ONE_EACH}"))
def diag_obs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, independent(cohort(spark, sf_dir)).filter("y_obs is not null"), "y_obs", "diag")


@query(f"WITH r AS ({scan_sql('y_obs IS NOT NULL', 'y_obs', 2)}) SELECT count(*) AS variants, round(quantile_cont(t_score, 0.5) / {CHI2_MEDIAN}, 5) AS lambda_gc, "
       "round(quantile_cont(neg_log10_p, 0.5), 5) AS median_neg_log10_p, round(avg((neg_log10_p > -log10(0.05))::INT), 5) AS share_05, "
       "round(avg((neg_log10_p > 2)::INT), 5) AS share_01, round(avg(beta), 5) AS mean_beta FROM r")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration(ols_scan_observed(spark, sf_dir)), "lambda_gc", "median_neg_log10_p", "share_05", "share_01", "mean_beta", digits=5)


def _grm_scan(spark: SparkSession, sf_dir: str, where: str, response: str, floor: float | None = 0.01) -> DataFrame:
    people = cohort(spark, sf_dir).filter(where)
    return _scan(spark, sf_dir, people, response, "grm", pair_grm(people), floor)


def grm_sql(where: str, response: str, floor: bool) -> str:
    """Pairs: the covariance of a family is exchangeable, so its inverse is (a, -b; -b, a) / (a a - b b); a single has 1 / a."""
    q = lambda own, other: f"sum({own} * qd) + sum({other} * qo)"
    return f"""WITH {COHORT}, {DOSAGES}, d AS (SELECT iid, family, x1 AS x, {response} AS y FROM cohort WHERE {where}),
m AS (SELECT avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM d),
e AS (SELECT d.*, y - my - sxy / sxx * (x - mx) AS e FROM d, m),
p AS (SELECT a.*, b.iid AS other, b.x AS x_, b.y AS y_, b.e AS e_ FROM e a LEFT JOIN e b ON a.family = b.family AND a.iid <> b.iid),
t AS (SELECT sum(0.5 * e * e_) / sum(CASE WHEN other IS NOT NULL THEN 0.25 END) AS tau, sum(e * e) AS ee, count(*) AS n FROM p),
c AS (SELECT tau, {'greatest((ee - tau * n) / n, 0.01)' if floor else '(ee - tau * n) / n'} AS sigma FROM t),
w AS (SELECT p.*, CASE WHEN other IS NULL THEN 1 / (tau + sigma) ELSE (tau + sigma) / ((tau + sigma) ** 2 - tau * tau / 4) END AS qd,
    CASE WHEN other IS NULL THEN 0 ELSE -tau / 2 / ((tau + sigma) ** 2 - tau * tau / 4) END AS qo FROM p, c),
f AS (SELECT iid, family, other, x, y, qd, qo, qd + qo AS a0, qd * x + qo * coalesce(x_, 0) AS a1, qd * y + qo * coalesce(y_, 0) AS qy FROM w),
s AS (SELECT sum(a0) AS m00, sum(a1) AS m01, sum(a1 * x) AS m11, sum(qy) AS b0, sum(qy * x) AS b1 FROM f),
i AS (SELECT m11 / (m00 * m11 - m01 * m01) AS i00, -m01 / (m00 * m11 - m01 * m01) AS i01, m00 / (m00 * m11 - m01 * m01) AS i11, b0, b1 FROM s),
u AS (SELECT f.*, qy - a0 * (i00 * b0 + i01 * b1) - a1 * (i01 * b0 + i11 * b1) AS u, i00, i01, i11 FROM f, i),
g AS (SELECT snp, sum(a.g * u) AS u, sum(a.g * a0) AS a0, sum(a.g * a1) AS a1, sum(a.g * a.g * qd + a.g * coalesce(b.g, 0) * qo) AS gg,
    any_value(i00) AS i00, any_value(i01) AS i01, any_value(i11) AS i11
    FROM geno a JOIN u ON a.iid = u.iid LEFT JOIN (SELECT snp AS snp_, iid AS iid_, g FROM geno) b ON b.iid_ = u.other AND b.snp_ = a.snp GROUP BY 1),
v AS (SELECT snp, u, gg - i00 * a0 * a0 - 2 * i01 * a0 * a1 - i11 * a1 * a1 AS v FROM g),
r AS (SELECT snp, CASE WHEN v > 1e-9 THEN u * u / v END AS t, CASE WHEN v > 1e-9 THEN u / v END AS beta, CASE WHEN v > 1e-9 THEN 1 / v END AS var_beta FROM v)
SELECT snp, round(t, 6) AS t_score, round({neg_log10_p('t')}, 6) AS neg_log10_p, round(beta, 6) AS beta, round(var_beta, 6) AS var_beta FROM r"""


@query(grm_sql("true", "y", True))
def grm_oracle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grm_scan(spark, sf_dir, "true", "y")


@query(grm_sql("y_obs IS NOT NULL", "y_obs", True))
def grm_observed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grm_scan(spark, sf_dir, "y_obs is not null", "y_obs")


@query(grm_sql("y_obs IS NOT NULL", "s", False))
def grm_hat_observed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grm_scan(spark, sf_dir, "y_obs is not null", "s", None)


@query(grm_sql("y_obs IS NULL", "s", False))
def grm_hat_unobserved_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grm_scan(spark, sf_dir, "y_obs is null", "s", None)


def _inverse(m: str, p: int) -> dict[tuple[int, int], str]:
    """Entries of the inverse of a symmetric matrix of 2 or 3 rows; m00, m01, ... are the columns of its upper triangle."""
    at = lambda i, j: f"{m}{min(i, j)}{max(i, j)}"
    if p == 2:
        whole = f"({m}00 * {m}11 - {m}01 * {m}01)"
        return {(0, 0): f"{m}11 / {whole}", (0, 1): f"-{m}01 / {whole}", (1, 1): f"{m}00 / {whole}"}

    def minor(i: int, j: int) -> str:
        (r, t), (c, d) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return f"({at(r, c)} * {at(t, d)} - {at(r, d)} * {at(t, c)})"

    whole = "(" + " + ".join(f"{'-' * (j % 2)}{at(0, j)} * {minor(0, j)}" for j in range(3)) + ")"
    return {(i, j): f"{'-' * ((i + j) % 2)}{minor(i, j)} / {whole}" for i in range(3) for j in range(i, 3)}


def joint_sql(xs: list[str], where: str = "true", related: bool = True, floor: bool = True, extra: str = "", own: bool = False) -> str:
    """The joint test of families of one or two people, both of whom have a target or neither: all matrices of a family have one value on the diagonal
    and one off it, and so have their products and inverses. related: else the people are taken as unrelated. own: the variant takes part in the
    surrogate's regression, so variances, and all that follows from them, are the variant's."""
    p, key, by = len(xs) + 1, "snp, " if own else "", " GROUP BY snp" if own else ""
    dims, pairs = range(p), [(i, j) for i in range(p) for j in range(i, p)]
    both = ", ".join
    x = lambda i, tail="": f"x{i}{tail}"
    inv = lambda m: both(f"{e} AS {m}i{i}{j}" for (i, j), e in _inverse(m, p).items())
    entry = lambda m, i, j: f"{m}i{min(i, j)}{max(i, j)}"
    times = lambda m, vec, i: "(" + " + ".join(f"{entry(m, i, j)} * {vec}{j}" for j in dims) + ")"
    dot = lambda a, b: "(" + " + ".join(f"{a}{i} * {b}{i}" for i in dims) + ")"
    act = lambda m, z: f"({m}d * {z} + {m}o * coalesce({z}_, 0))"
    tau = "sum(0.5 * {0} * {1}_) / sum(CASE WHEN {2}_ IS NOT NULL AND {2} IS NOT NULL THEN 0.25 END)" if related else "0"
    over = "{n}" if related else "({n} - 1)"
    floored = (lambda e: f"greatest({e}, 0.01)") if floor else (lambda e: e)
    off = lambda tail: " + ".join(f"x{i}{tail} * w{i}" for i in dims)
    each = "" if not own else f"""
w1 AS (SELECT n.snp, p.*, coalesce(a.g, 0) AS g1, coalesce(b.g, 0) AS g1_ FROM p CROSS JOIN (SELECT DISTINCT snp FROM geno JOIN k USING (iid)) n
    LEFT JOIN geno a ON a.snp = n.snp AND a.iid = p.iid LEFT JOIN geno b ON b.snp = n.snp AND b.iid = p.other),
w2 AS (SELECT snp, {both(f"sum(x{i} * g1) AS xg{i}" for i in dims)}, sum(g1 * g1) AS gg, sum(g1 * s) AS sg FROM w1 GROUP BY 1),
w3 AS (SELECT snp, {both(f"{times('g', 'xg', i)} AS w{i}" for i in dims)}, sg / (gg - ({" + ".join(f"xg{i} * {times('g', 'xg', i)}" for i in dims)})) AS slope FROM w2, gi),
pv AS (SELECT snp, s - slope * (g1 - ({off('')})) AS s, s_ - slope * (g1_ - ({off('_')})) AS s_, t, t_, n, no FROM w1 JOIN w3 USING (snp)),"""
    return f"""WITH {COHORT}, {DOSAGES}{extra}, k AS (SELECT * FROM cohort WHERE {where}),
d AS (SELECT iid, family, 1.0::DOUBLE AS x0, {both(f"{c} - avg({c}) OVER () AS x{i}" for i, c in enumerate(xs, 1))}, s, y_obs AS y FROM k),
g AS (SELECT count(*) AS n, count(y) AS no, {both(f"sum(x{i} * x{j}) AS g{i}{j}, sum(x{i} * x{j}) FILTER (WHERE y IS NOT NULL) AS h{i}{j}" for i, j in pairs)},
    {both(f"sum(x{i} * s) AS gs{i}, sum(x{i} * y) AS hy{i}" for i in dims)} FROM d),
gi AS (SELECT *, {inv("g")}, {inv("h")} FROM g),
e AS (SELECT iid, family, {both(map(x, dims))}, n, no, s - ({" + ".join(f"x{i} * {times('g', 'gs', i)}" for i in dims)}) AS s,
    y - ({" + ".join(f"x{i} * {times('h', 'hy', i)}" for i in dims)}) AS t FROM d, gi),
p AS (SELECT a.*, b.iid AS other, {both(f"b.x{i} AS x{i}_" for i in dims)}, b.s AS s_, b.t AS t_ FROM e a LEFT JOIN e b ON {'a.family = b.family AND a.iid <> b.iid' if related else 'false'}),{each}
v AS (SELECT {key}{tau.format('s', 's', 's')} AS ts, {tau.format('t', 't', 't')} AS tt, {tau.format('s', 't', 't')} AS tx,
    sum(s * s) AS ss, sum(t * t) AS st, sum(s * t) AS sx, any_value(n) AS n, any_value(no) AS no FROM {'pv' if own else 'p'}{by}),
c AS (SELECT {key}ts, tt, tx, (ss - ts * n) / {over.format(n='n')} AS us, {floored(f"(st - tt * no) / {over.format(n='no')}")} AS ut, (sx - tx * no) / {over.format(n='no')} AS ux FROM v),
q AS (SELECT {key}p.*, CASE WHEN other IS NULL THEN 0 ELSE 0.5 END AS k, ts + us AS a, ts * k AS b, a / (a * a - b * b) AS qd, -b / (a * a - b * b) AS qo,
    tx + ux AS xa, tx * k AS xb, xa * qd + xb * qo AS dd, xa * qo + xb * qd AS do_, tt + ut - (dd * xa + do_ * xb) AS od, tt * k - (dd * xb + do_ * xa) AS oo,
    CASE WHEN t IS NULL THEN 0 ELSE od / (od * od - oo * oo) END AS vd, CASE WHEN t IS NULL THEN 0 ELSE -oo / (od * od - oo * oo) END AS vo,
    vd * dd + vo * do_ AS hd, vd * do_ + vo * dd AS ho FROM p, c),
f AS (SELECT {key}iid, other, qd, qo, vd, vo, hd, ho, {both(map(x, dims))}, {act('q', 's')} AS w, CASE WHEN t IS NULL THEN 0 ELSE {act('v', 't')} END - {act('h', 's')} AS u,
    {both(f"{act(m, x(i))} AS {m}x{i}" for m in "qvh" for i in dims)} FROM q),
s AS (SELECT {key}{both(f"sum(x{i} * qx{j}) AS A{i}{j}, sum(x{i} * vx{j}) AS C{i}{j}" for i, j in pairs)}, {both(f"sum(x{i} * hx{j}) AS Z{i}{j}" for i in dims for j in dims)},
    {both(f"sum(x{i} * w) AS B{i}, sum(x{i} * u) AS R{i}" for i in dims)} FROM f{by}),
si AS (SELECT *, {inv("A")}, {inv("C")} FROM s),
m AS (SELECT a.snp, sum(a.g * w) AS b, sum(a.g * u) AS w, {both(f"sum(a.g * qx{i}) AS a{i}, sum(a.g * vx{i}) AS c{i}, sum(a.g * hx{i}) AS l{i}" for i in dims)},
    {both(f"sum(a.g * a.g * {m}d + a.g * coalesce(o.g, 0) * {m}o) AS {m}gg" for m in "qvh")}
    FROM geno a JOIN f ON a.iid = f.iid{' AND a.snp = f.snp' if own else ''} LEFT JOIN geno o ON o.iid = f.other AND o.snp = a.snp GROUP BY 1),
z AS (SELECT m.*, si.*{' EXCLUDE (snp)' if own else ''}, {both(f"{times('A', 'a', i)} AS am{i}, {times('C', 'c', i)} AS ga{i}, {times('A', 'B', i)} AS fb{i}" for i in dims)} FROM m{' JOIN si USING (snp)' if own else ', si'}),
y2 AS (SELECT *, qgg - {dot('a', 'am')} AS own_, vgg - {dot('c', 'ga')} AS info, hgg - {dot('ga', 'l')} AS dg, (b - {dot('am', 'B')}) / own_ AS alpha,
    {both(f"l{i} - ({' + '.join(f'Z{j}{i} * ga{j}' for j in dims)}) AS dx{i}" for i in dims)} FROM z WHERE qgg - {dot('a', 'am')} > 1e-9),
y3 AS (SELECT *, w - {dot('ga', 'R')} + dg * alpha + {" + ".join(f"dx{i} * (fb{i} - am{i} * alpha)" for i in dims)} AS num,
    info + {" + ".join(f"dx{i} * {times('A', 'dx', i)}" for i in dims)} + (dg - {dot('dx', 'am')}) ** 2 / own_ AS var FROM y2),
r AS (SELECT m.snp, CASE WHEN info > 1e-9 AND var > 1e-9 THEN num * num / var END AS t, CASE WHEN info > 1e-9 AND var > 1e-9 THEN num / info END AS beta,
    CASE WHEN info > 1e-9 AND var > 1e-9 THEN var / (info * info) END AS var_beta FROM m LEFT JOIN y3 ON m.snp = y3.snp)
SELECT snp, round(t, 6) AS t_score, round({neg_log10_p('t')}, 6) AS neg_log10_p, round(beta, 6) AS beta, round(var_beta, 6) AS var_beta FROM r"""


DIAG_JOINT = joint_sql(["x1", "x2"], "iid IN (SELECT iid FROM independent)", related=False, floor=False, extra=f", {ONE_EACH}")
GRM_JOINT = joint_sql(["x1", "x2"])


@query(GRM_JOINT)
def grm_joint_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    return _tidy(score(brand_dosages(spark, sf_dir), fit_joint(people, pair_grm(people), ["x1", "x2"])))


@query(DIAG_JOINT)
def diag_joint_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(score(brand_dosages(spark, sf_dir), fit_joint(independent(cohort(spark, sf_dir)), None, ["x1", "x2"], covariance="diag")))


@query(joint_sql(["x1"], own=True))
def grm_each_variant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    return _tidy(score_each(brand_dosages(spark, sf_dir), people, pair_grm(people), ["x1"], floor=0.01))


@query(grm_sql("true", "y", False))
def grm_oracle_unfloored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grm_scan(spark, sf_dir, "true", "y", None)


@query(grm_sql("y_obs IS NOT NULL", "y_obs", False))
def grm_observed_unfloored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grm_scan(spark, sf_dir, "y_obs is not null", "y_obs", None)


#: Responses of one fit: SQL text of each, over the cohort's columns.
RESPONSES = {f"p{k:02d}": f"y + {k} * s / 10.0 + (iid * {7 + k} % 11) / 5.0" for k in range(20)}


@query(" UNION ALL ".join(f"SELECT '{name}' AS phenotype, * FROM ({grm_sql('true', e, True)})" for name, e in RESPONSES.items()))
def many_response_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir).withColumns({name: F.expr(e.replace("10.0", "10e0").replace("5.0", "5e0")) for name, e in RESPONSES.items()})
    return _tidy(score_many(brand_dosages(spark, sf_dir), fit_many(people, pair_grm(people), ["x1"], list(RESPONSES), "grm", 0.01)))


def _first_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    dosages = brand_dosages(spark, sf_dir)
    return dosages.filter(F.col("snp") == table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0])


def first_sql(scan: str) -> str:
    return f"SELECT * FROM ({scan}) WHERE snp = (SELECT min(p_brand) FROM part)"


@query(first_sql(grm_sql("true", "y", True)))
def grm_oracle_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    return _tidy(score(_first_variant(spark, sf_dir), fit_single(people, pair_grm(people), ["x1"], "y", "grm", 0.01), 1))


@query(first_sql(grm_sql("y_obs IS NOT NULL", "y_obs", True)))
def grm_observed_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir).filter("y_obs is not null")
    return _tidy(score(_first_variant(spark, sf_dir), fit_single(people, pair_grm(people), ["x1"], "y_obs", "grm", 0.01), 1))


@query(first_sql(scan_sql("iid IN (SELECT iid FROM independent)", "y", 1, f", {ONE_EACH}")))
def diag_oracle_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = independent(cohort(spark, sf_dir))
    return _tidy(score(_first_variant(spark, sf_dir), fit_single(people, None, ["x1"], "y", "diag"), 1))


@query(first_sql(scan_sql("y_obs IS NOT NULL AND iid IN (SELECT iid FROM independent)", "y_obs", 1, f", {ONE_EACH}")))
def diag_observed_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = independent(cohort(spark, sf_dir)).filter("y_obs is not null")
    return _tidy(score(_first_variant(spark, sf_dir), fit_single(people, None, ["x1"], "y_obs", "diag"), 1))


@query(first_sql(GRM_JOINT))
def grm_joint_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    return _tidy(score(_first_variant(spark, sf_dir), fit_joint(people, pair_grm(people), ["x1", "x2"]), 1))


@query(first_sql(DIAG_JOINT))
def diag_joint_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(score(_first_variant(spark, sf_dir), fit_joint(independent(cohort(spark, sf_dir)), None, ["x1", "x2"], covariance="diag"), 1))


def table_sql(scans: dict[str, str]) -> str:
    first, *rest = scans
    columns = ", ".join(f"{m}.{c} AS {m}_{c}" for m in scans for c in tables.METHOD_COLUMNS)
    return f"SELECT snp, {columns} FROM ({scans[first]}) {first} " + " ".join(f"FULL JOIN ({scans[m]}) {m} USING (snp)" for m in rest)


@query(table_sql({
    "grm_oracle": grm_sql("true", "y", True), "grm_observed": grm_sql("y_obs IS NOT NULL", "y_obs", True),
    "diag_oracle": scan_sql("iid IN (SELECT iid FROM independent)", "y", 1, f", {ONE_EACH}"),
    "diag_observed": scan_sql("y_obs IS NOT NULL AND iid IN (SELECT iid FROM independent)", "y_obs", 1, f", {ONE_EACH}"),
}))
def single_method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = {"grm_oracle": grm_oracle_scan, "grm_observed": grm_observed_scan, "diag_oracle": diag_oracle_scan, "diag_observed": diag_obs_scan}
    return tables.side_by_side({m: scan(spark, sf_dir) for m, scan in scans.items()})


@query(table_sql({
    "grm_joint": GRM_JOINT, "grm_observed": grm_sql("y_obs IS NOT NULL", "y_obs", True), "diag_joint": DIAG_JOINT,
    "diag_observed": scan_sql("y_obs IS NOT NULL AND iid IN (SELECT iid FROM independent)", "y_obs", 1, f", {ONE_EACH}"),
}))
def four_method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = {"grm_joint": grm_joint_scan, "grm_observed": grm_observed_scan, "diag_joint": diag_joint_scan, "diag_observed": diag_obs_scan}
    return tables.side_by_side({m: scan(spark, sf_dir) for m, scan in scans.items()})


@query(f"""WITH {COHORT}, geno AS (SELECT l_partkey AS snp, o_custkey AS iid, least(count(*), 2)::DOUBLE AS g FROM lineitem JOIN orders
    ON l_orderkey = o_orderkey WHERE l_quantity >= 49 GROUP BY 1, 2),
s AS (SELECT snp, count(*) AS c, min(g) AS a, max(g) AS b FROM geno JOIN cohort USING (iid) WHERE y_obs IS NOT NULL GROUP BY 1),
same AS (SELECT p_partkey AS snp FROM part WHERE p_partkey NOT IN (SELECT snp FROM s WHERE c < (SELECT count(y_obs) FROM cohort) OR a < b)),
seen AS (SELECT iid, row_number() OVER (ORDER BY (iid * 7919 + 13) % 10007, iid) - 1 AS place, count(*) OVER () AS n FROM cohort WHERE y_obs IS NOT NULL),
six AS (SELECT snp, (snp * 7919 + k) % (SELECT max(n) FROM seen) AS place, CASE WHEN k IN (0, 5) THEN 2.0 ELSE 1.0 END::DOUBLE AS g FROM same, range(6) r(k)),
patch AS (SELECT snp, iid, g FROM six JOIN seen USING (place))
SELECT * FROM patch UNION ALL SELECT geno.* FROM geno ANTI JOIN patch USING (snp, iid)""")
def constant_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = cohort(spark, sf_dir).filter("y_obs is not null")
    return blocks.repair_constant(part_dosages(spark, sf_dir), monomorphic_variants(spark, sf_dir), seen, F.col("snp") * 7919)


@query(f"WITH b AS ({BLOCK_SQL.format(0.005)}) SELECT count(*) AS blocks, sum(c)::BIGINT AS people, max(c) AS largest FROM (SELECT count(*) AS c FROM b GROUP BY block_id)")
def block_size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_sizes(blocks.blocks(*_links(spark, sf_dir), threshold=0.005))


@query(f"WITH {COHORT}, {GRM} SELECT * FROM grm")
def grm_from_kinship(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat_ws("_", c, c).alias(c)
    kinship = pair_grm(cohort(spark, sf_dir)).filter("i <= j").select(name("i"), name("j"), (F.col("k") / 2).alias("k"))
    return relatedness(kinship)


def _scaled(spread: str) -> str:
    columns = ", ".join(f"round((x1 - avg(x1) OVER ()) / {spread.format(c)}, 6) AS {c}".replace("x1", c) for c in ("x1", "x2", "y"))
    return f"WITH {COHORT} SELECT iid, {columns} FROM cohort"


@query(_scaled("stddev_samp({}) OVER ()"))
def scaled_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.standardised(cohort(spark, sf_dir), ["x1", "x2", "y"]), "x1", "x2", "y").select("iid", "x1", "x2", "y")


@query(_scaled("1"))
def centred_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.standardised(cohort(spark, sf_dir), ["x1", "x2", "y"], spread=False), "x1", "x2", "y").select("iid", "x1", "x2", "y")


@query("SELECT o_custkey AS iid, round_even(count(*) / 2.0::DOUBLE, 0) AS half FROM orders GROUP BY 1")
def half_even_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("iid")).agg(F.count("*").alias("n"))
    return counts.select("iid", F.bround(F.col("n") / 2, 0).alias("half"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS status FROM orders")
def status_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.factor(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"], "status").select("o_orderkey", "status")


@query("SELECT c_custkey AS iid, c_acctbal AS acct_bal_total, c_mktsegment AS mkt_segment FROM customer")
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return tables.clean_names(customers.select(F.col("c_custkey").alias("iid"), F.col("c_acctbal").alias("acct-bal total"), F.col("c_mktsegment").alias("mkt segment")))


COVARIANCE_COLUMNS = ("x1", "x2", "s", "y")


@query(f"WITH {COHORT} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) AS cov FROM cohort" for k, a in enumerate(COVARIANCE_COLUMNS) for b in COVARIANCE_COLUMNS[k:]
))
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.covariances(cohort(spark, sf_dir), list(COVARIANCE_COLUMNS)), "cov")


@query(f"""WITH {COHORT}, picked AS (SELECT iid, row_number() OVER (ORDER BY (iid * 7919 + 3) % 10007, iid) AS r, count(*) OVER () AS n FROM cohort WHERE y_obs IS NOT NULL)
SELECT iid, CASE WHEN r <= floor(0.1::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM cohort LEFT JOIN picked USING (iid)""")
def train_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.train_sample(cohort(spark, sf_dir), "y_obs")


@query()
def forest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    return tables.forest_surrogate(people, tables.train_sample(people, "y_obs"), ["x1", "x2", "s"], "y_obs")


@query("SELECT CASE k WHEN 0 THEN 'ID_1 ID_2 missing nation ' ELSE '0 0 0 D ' END AS line FROM range(2) r(k) UNION ALL "
       "SELECT concat_ws(' ', c_custkey, c_custkey, 0, c_nationkey) FROM customer")
def sample_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("iid"), F.col("c_nationkey").alias("nation"))
    return sample_lines(people, ["nation"]).select("line")
