"""Association, rank and feature-clustering proofs (A9-A14, W1, C12, K1-K10, S13)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relyframe.operators import assoc as A
from relyframe.operators import select as K
from relyframe.operators.clean import drop_missing
from relyframe.operators.stats import average_rank, corr_matrix, matrix_to_long, spearman_matrix
from relyframe.plans.catalog import register, rounded
from relyframe.plans.frame import CATEGORICAL_FEATURES, FF_SQL, NUMERIC_FEATURES, standard_frame
from relyframe.plans.q_flagship import encoded_frame
from relyframe.sources import load

NUM = NUMERIC_FEATURES
CAT = CATEGORICAL_FEATURES
MIXED = ["num__o_totalprice", "num__c_acctbal", "num__sum_qty", "num__avg_disc",
         "cat__o_orderstatus", "cat__o_orderpriority", "cat__c_mktsegment", "cat__r_name"]
_MIX_SRC = {c: c.split("__", 1)[1] for c in MIXED}

D_SQL = "WITH " + FF_SQL + ", d AS (SELECT * FROM ff WHERE sum_qty IS NOT NULL)"


def assoc_frame(spark: SparkSession, sf: str):
    return drop_missing(standard_frame(spark, sf), ["sum_qty"])


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


# ------------------------------------------------------------------ Pearson

@register("pearson_matrix", D_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), 6) AS assoc FROM d" for a, b in _pairs(NUM)) + ")")
def q_pearson(spark: SparkSession, sf: str):
    m = corr_matrix(assoc_frame(spark, sf), NUM)
    return rounded(matrix_to_long(spark, m, NUM, upper_only=True))


# ----------------------------------------------------------------- Spearman

_ORD = ["o_totalprice", "o_custkey", "o_orderdate"]
_ORD_RANKS = ", ".join(
    f"CAST(rank() OVER (ORDER BY {c}) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY {c}) AS DOUBLE) - 1.0) / 2.0 AS r_{c}"
    for c in _ORD)


@register("spearman_matrix", f"WITH r AS (SELECT {_ORD_RANKS} FROM orders) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, round(coalesce(corr(r_{a}, r_{b}), 0.0), 6) AS rho FROM r" for a, b in _pairs(_ORD)) + ")")
def q_spearman(spark: SparkSession, sf: str):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_custkey",
                                         F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("o_orderdate"))
    m = spearman_matrix(o, _ORD)
    return rounded(matrix_to_long(spark, m, _ORD, upper_only=True, value_name="rho"))


# ------------------------------------------------------------- Cramer's V

def _cramer_sql(cols, src="d") -> str:
    cells = " UNION ALL ".join(f"SELECT '{a}' AS f1, CAST({a} AS VARCHAR) AS v1, '{b}' AS f2, CAST({b} AS VARCHAR) AS v2 FROM {src}"
                               for a, b in _pairs(cols))
    return f""",
c0 AS ({cells}),
ct AS (SELECT f1, f2, v1, v2, count(*) AS o FROM c0 WHERE v1 IS NOT NULL AND v2 IS NOT NULL GROUP BY ALL),
rm AS (SELECT f1, f2, v1, sum(o) AS ni FROM ct GROUP BY ALL),
cm AS (SELECT f1, f2, v2, sum(o) AS nj FROM ct GROUP BY ALL),
nn AS (SELECT f1, f2, CAST(sum(o) AS DOUBLE) AS n, CAST(count(DISTINCT v1) AS DOUBLE) AS rr,
              CAST(count(DISTINCT v2) AS DOUBLE) AS kk FROM ct GROUP BY ALL),
cells AS (SELECT rm.f1, rm.f2, CAST(ni AS DOUBLE) * nj / n AS e, CAST(coalesce(ct.o, 0) AS DOUBLE) AS o, n, rr, kk
          FROM rm JOIN cm ON rm.f1 = cm.f1 AND rm.f2 = cm.f2 JOIN nn ON rm.f1 = nn.f1 AND rm.f2 = nn.f2
          LEFT JOIN ct ON ct.f1 = rm.f1 AND ct.f2 = rm.f2 AND ct.v1 = rm.v1 AND ct.v2 = cm.v2),
adj AS (SELECT *, CASE WHEN (rr - 1) * (kk - 1) = 1 THEN o + least(0.5, abs(e - o)) * sign(e - o) ELSE o END AS oa FROM cells),
chi AS (SELECT f1, f2, sum((oa - e) * (oa - e) / e) AS chi2, max(n) AS n, max(rr) AS rr, max(kk) AS kk FROM adj GROUP BY ALL),
cv AS (SELECT f1, f2, chi2,
              CASE WHEN least(kk - (kk - 1) * (kk - 1) / (n - 1), rr - (rr - 1) * (rr - 1) / (n - 1)) - 1 = 0 THEN NULL
                   ELSE sqrt(greatest(0.0, chi2 / n - (kk - 1) * (rr - 1) / (n - 1))
                        / (least(kk - (kk - 1) * (kk - 1) / (n - 1), rr - (rr - 1) * (rr - 1) / (n - 1)) - 1)) END AS v
       FROM chi)"""


@register("cramers_v", D_SQL + _cramer_sql(CAT) + " SELECT f1, f2, round(chi2, 6) AS chi2, round(v, 6) AS cramers_v FROM cv")
def q_cramers_v(spark: SparkSession, sf: str):
    rows = A.cramers_v(assoc_frame(spark, sf), CAT)
    df = spark.createDataFrame([(a, b, float(c), None if np.isnan(v) else float(v)) for a, b, c, v in rows],
                               "f1 string, f2 string, chi2 double, cramers_v double")
    return rounded(df)


# -------------------------------------------------------- correlation ratio

def _eta_sql(noms, nums, src="d") -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS fc, CAST({c} AS VARCHAR) AS v, '{x}' AS fx, CAST({x} AS DOUBLE) AS x FROM {src}"
                               for c in noms for x in nums)
    return f""",
e0 AS (SELECT * FROM ({cells}) WHERE v IS NOT NULL AND x IS NOT NULL),
et AS (SELECT fc, fx, avg(x) AS mu FROM e0 GROUP BY ALL),
eg AS (SELECT fc, fx, v, CAST(count(*) AS DOUBLE) AS n, avg(x) AS m FROM e0 GROUP BY ALL),
eb AS (SELECT eg.fc, eg.fx, sum(n * (m - mu) * (m - mu)) AS sb FROM eg JOIN et ON eg.fc = et.fc AND eg.fx = et.fx GROUP BY ALL),
es AS (SELECT e0.fc, e0.fx, sum((x - mu) * (x - mu)) AS st FROM e0 JOIN et ON e0.fc = et.fc AND e0.fx = et.fx GROUP BY ALL),
eta AS (SELECT eb.fc, eb.fx, CASE WHEN sb = 0 OR st <= 0 THEN 0.0 ELSE sqrt(least(1.0, sb / st)) END AS eta
        FROM eb JOIN es ON eb.fc = es.fc AND eb.fx = es.fx)"""


@register("correlation_ratio", D_SQL + _eta_sql(CAT, NUM) + " SELECT fc AS f1, fx AS f2, round(eta, 6) AS eta FROM eta")
def q_eta(spark: SparkSession, sf: str):
    r = A.correlation_ratios(assoc_frame(spark, sf), CAT, NUM)
    return rounded(spark.createDataFrame([(c, x, float(v)) for (c, x), v in r.items()], "f1 string, f2 string, eta double"))


# ------------------------------------------------------------- mixed matrix

def mixed_frame(spark: SparkSession, sf: str):
    d = assoc_frame(spark, sf)
    return d.select("row_id", *[F.col(src).alias(name) for name, src in _MIX_SRC.items()])


_MIX_NUM = [c for c in MIXED if c.startswith("num__")]
_MIX_CAT = [c for c in MIXED if c.startswith("cat__")]
_MIX_D = D_SQL + ", m AS (SELECT row_id, " + ", ".join(f"{s} AS {n}" for n, s in _MIX_SRC.items()) + " FROM d)"
_ASSOC_ALL = (_MIX_D + _cramer_sql(_MIX_CAT, "m") + _eta_sql(_MIX_CAT, _MIX_NUM, "m") + """,
pe AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS a FROM m" for a, b in _pairs(_MIX_NUM)) + """),
up AS (SELECT f1, f2, a FROM pe UNION ALL SELECT f1, f2, v FROM cv UNION ALL SELECT fc, fx, eta FROM eta),
full_m AS (SELECT f1, f2, a AS assoc FROM up UNION ALL SELECT f2, f1, a FROM up UNION ALL
           SELECT f, f, 1.0 FROM (VALUES """ + ", ".join(f"('{c}')" for c in MIXED) + ") t(f))")


@register("association_matrix", _ASSOC_ALL + " SELECT f1, f2, round(assoc, 6) AS assoc FROM full_m")
def q_assoc_matrix(spark: SparkSession, sf: str):
    m = A.association_matrix(mixed_frame(spark, sf), MIXED)
    return rounded(A.long_matrix(spark, m, MIXED))


@register("assoc_distance", _ASSOC_ALL + " SELECT f1, f2, round(CASE WHEN f1 = f2 THEN 0.0 ELSE 1.0 - abs(coalesce(assoc, 0.0)) END, 6)"
          " AS distance FROM full_m")
def q_assoc_distance(spark: SparkSession, sf: str):
    m = A.association_matrix(mixed_frame(spark, sf), MIXED)
    return rounded(A.long_matrix(spark, A.assoc_to_distance(m), MIXED, name="distance"))


# --------------------------------------------------------- column distances

_CD = ["o_totalprice", "sum_price", "c_acctbal", "sum_qty"]


@register("column_distances", D_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, round(sqrt(sum(({a} - {b}) * ({a} - {b}))), 6) AS distance FROM d"
    for a, b in _pairs(_CD)) + ")")
def q_column_distances(spark: SparkSession, sf: str):
    d = A.column_distances(assoc_frame(spark, sf), _CD)
    return rounded(A.long_matrix(spark, d, _CD, name="distance", upper_only=True))


# ------------------------------------------------------------- average rank

_AR = ["o_totalprice", "sum_qty", "n_items"]


@register("average_rank", "WITH " + FF_SQL + " SELECT row_id, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN NULL ELSE CAST(rank() OVER (ORDER BY {c}) AS DOUBLE) + "
    f"(CAST(count(*) OVER (PARTITION BY {c}) AS DOUBLE) - 1.0) / 2.0 END AS {c}" for c in _AR) + " FROM ff")
def q_average_rank(spark: SparkSession, sf: str):
    return average_rank(standard_frame(spark, sf), _AR)


# -------------------------------------------------- clustering (rows-only)

def _sel_spearman(spark, sf):
    enc, names = encoded_frame(spark, sf)
    return K.select_by_spearman(enc, names, 0.675)


@register("cluster_spearman")
def q_cluster_spearman(spark: SparkSession, sf: str):
    sel = _sel_spearman(spark, sf)
    return spark.createDataFrame([(f,) for f in sel.selected], "feature string")


@register("cluster_report")
def q_cluster_report(spark: SparkSession, sf: str):
    return _sel_spearman(spark, sf).report(spark)


@register("cluster_association")
def q_cluster_association(spark: SparkSession, sf: str):
    enc, names = encoded_frame(spark, sf)
    return K.select_by_association(enc, names, 0.5).report(spark)


@register("cluster_ward")
def q_cluster_ward(spark: SparkSession, sf: str):
    enc, names = encoded_frame(spark, sf)
    return K.select_by_ward(enc, names, 1.0).report(spark)


@register("cluster_rank_ward")
def q_cluster_rank_ward(spark: SparkSession, sf: str):
    enc, names = encoded_frame(spark, sf)
    return K.select_by_rank_ward(enc, names, 0.35).report(spark)


# proofs of what follows a clustering, on a given one
GIVEN = {"o_totalprice": 1, "n_items": 1, "sum_qty": 1, "sum_price": 1, "c_acctbal": 2, "avg_disc": 3, "avg_tax": 3}
_LABELS = np.array(list(GIVEN.values()))
_GIVEN_SQL = (D_SQL + ", cl AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {l}, {i})" for i, (f, l) in enumerate(GIVEN.items())) + ") t(f, l, pos))"
              + ", up AS (" + " UNION ALL ".join(
                  f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS rho, sqrt(avg(({a} - {b}) * ({a} - {b}))) AS dist FROM d"
                  for a, b in _pairs(list(GIVEN))) + ")"
              + ", m AS (SELECT f1, f2, rho, dist FROM up UNION ALL SELECT f2, f1, rho, dist FROM up UNION ALL "
                "SELECT f, f, 1.0, 0.0 FROM cl), w AS (SELECT m.*, a.l AS l1, b.l AS l2 FROM m JOIN cl a ON f1 = a.f JOIN cl b ON f2 = b.f)")


@register("cluster_representative", _GIVEN_SQL + """,
s AS (SELECT l1 AS cluster_id, f1, round(sum(abs(rho)), 9) AS total FROM w WHERE l1 = l2 GROUP BY ALL)
SELECT cluster_id, f1 AS feature FROM s JOIN cl ON f1 = f QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY total DESC, pos) = 1""")
def q_cluster_rep(spark: SparkSession, sf: str):
    m = corr_matrix(assoc_frame(spark, sf), list(GIVEN))
    reps = K.representative_by_assoc(m, _LABELS, list(GIVEN))
    return spark.createDataFrame(list(zip(sorted(set(GIVEN.values())), reps)), "cluster_id int, feature string")


@register("cluster_centroid_rep", _GIVEN_SQL + """,
s AS (SELECT l1 AS cluster_id, f1, avg(dist * dist) AS total FROM w WHERE l1 = l2 GROUP BY ALL)
SELECT cluster_id, f1 AS feature FROM s JOIN cl ON f1 = f QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY total, pos) = 1""")
def q_cluster_centroid(spark: SparkSession, sf: str):
    d = A.column_distances(assoc_frame(spark, sf), list(GIVEN))
    reps = K.representative_by_centroid(d, _LABELS, list(GIVEN))
    return spark.createDataFrame(list(zip(sorted(set(GIVEN.values())), reps)), "cluster_id int, feature string")


@register("cluster_silhouette", _GIVEN_SQL + """,
g AS (SELECT f1, l1, l2, sum(1.0 - abs(rho)) AS total, count(*) AS n FROM w GROUP BY ALL),
ab AS (SELECT f1, max(CASE WHEN l1 = l2 AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN l1 <> l2 THEN total / n END) AS b
       FROM g GROUP BY f1)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, 3 AS n_clusters
FROM ab""")
def q_cluster_silhouette(spark: SparkSession, sf: str):
    m = corr_matrix(assoc_frame(spark, sf), list(GIVEN))
    sel = K.Selection(list(GIVEN), _LABELS, list(GIVEN), "association", 0.5, m)
    v = K.cluster_quality(sel)
    return rounded(spark.createDataFrame([(float(v["silhouette_score"]), int(v["n_clusters"]))], "silhouette double, n_clusters int"))
