"""The neighbour join and what is built on it, over the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from doubtline.operators import measures as M
from doubtline.operators.detectors import AngleDetector, LocalOutlierFactor, NeighbourDistance
from doubtline.operators.knn import knn_join, lsh_neighbours, neighbour_pairs
from doubtline.operators.models import NeighbourVote
from doubtline.queries import data as D
from doubtline.queries.data import nb_sql, with_sql
from doubtline.queries.registry import query, rounded

K = 19


def pairs_sql(name: str, k: int, own: bool = True, ref: str = "base") -> str:
    other = "" if own else "WHERE a.row_id <> b.row_id"
    return f"""{name}_d AS (SELECT a.row_id, b.row_id AS ref_id, list_distance(a.f, b.f) AS dist FROM base a, {ref} b {other}),
{name} AS (SELECT row_id, ref_id, dist, row_number() OVER (PARTITION BY row_id ORDER BY round(dist, 9), ref_id) AS rank
  FROM {name}_d QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(dist, 9), ref_id) <= {k})"""


_NN = (D.EMBEDDINGS_SQL, pairs_sql("nn", K))


@query("j01_knn_join", with_sql(*_NN, select="SELECT row_id, rank::INTEGER AS rank, ref_id, round(dist, 6) AS dist FROM nn"))
def nearest(spark, sf):
    df = D.embeddings(spark, sf)
    return rounded(neighbour_pairs(knn_join(df, df, K)))


@query("w01_top_k", with_sql(D.EMBEDDINGS_SQL, pairs_sql("nn", 5, own=False), select="SELECT row_id, rank::INTEGER AS rank, ref_id, round(dist, 6) AS dist FROM nn"))
def top_k(spark, sf):
    df = D.embeddings(spark, sf)
    return rounded(neighbour_pairs(knn_join(df, df, 5, exclude_self=True)))


@query("j01_knn_join_pivots", with_sql(*_NN, select="SELECT row_id, rank::INTEGER AS rank, ref_id, round(dist, 6) AS dist FROM nn"))
def nearest_by_pivots(spark, sf):
    """The same join in the form it takes when the reference is too large to broadcast."""
    df = D.embeddings(spark, sf)
    return rounded(neighbour_pairs(knn_join(df, df, K, broadcast_bytes=0, form="pivots", pivots=16, block_rows=200, query_rows=400)))


@query("j01_knn_join_tiles", with_sql(*_NN, select="SELECT row_id, rank::INTEGER AS rank, ref_id, round(dist, 6) AS dist FROM nn"))
def nearest_by_tiles(spark, sf):
    """The same join with groups of queries in place and the reference passing by in tiles."""
    df = D.embeddings(spark, sf)
    return rounded(neighbour_pairs(knn_join(df, df, K, broadcast_bytes=0, form="tiles", query_rows=400, block_rows=200)))


@query("j01_knn_join_slices", with_sql(*_NN, select="SELECT row_id, rank::INTEGER AS rank, ref_id, round(dist, 6) AS dist FROM nn"))
def nearest_by_slices(spark, sf):
    """The tiled join with a reference cut into slices, whose lists are merged."""
    df = D.embeddings(spark, sf)
    return rounded(
        neighbour_pairs(knn_join(df, df, K, broadcast_bytes=0, form="tiles", query_rows=400, block_rows=200, slice_rows=500))
    )


@query("j02_knn_lsh")
def nearest_by_hashing(spark, sf):
    df = D.embeddings(spark, sf)
    return rounded(lsh_neighbours(df, df, K, radius=2.0, bucket_length=4.0, tables=6))


@query(
    "w02_kth_distance",
    with_sql(*_NN, select="SELECT row_id, round(max(dist), 6) AS kth FROM nn GROUP BY row_id"),
)
def kth(spark, sf):
    df = D.embeddings(spark, sf)
    joined = knn_join(df, df, K)
    return rounded(joined.select("row_id", F.array_max(F.transform("nn", lambda e: e["dist"])).alias("kth")))


_NB_NN = (D.EMBEDDINGS_SQL, nb_sql("nb"), pairs_sql("nn", K))


def _scored(spark, sf):
    scored, model = D.scored(D.embeddings(spark, sf))
    return scored.select("row_id", "features", "label", "prob", "pred"), model


def _measured(spark, sf, measure):
    scored, model = _scored(spark, sf)
    names = [f"class {i}" for i in range(D.EMBEDDING_CLASSES)]
    fitted = measure.fit(M.FitContext(scored, D.EMBEDDING_CLASSES, model, names))
    return M.apply_measures(scored, [fitted], scorer=model, reference=scored), fitted


@query(
    "j03_neighbour_attributes",
    with_sql(*_NB_NN, select="SELECT nn.row_id, rank::INTEGER AS rank, ref_id, pred AS ref_pred, round(list_max(prob), 6) AS ref_confidence FROM nn JOIN nb ON nb.row_id = ref_id"),
)
def neighbour_attributes(spark, sf):
    scored, _ = _scored(spark, sf)
    joined = knn_join(scored, scored, K, carry=["pred", "prob"])
    long = joined.select("row_id", F.posexplode("nn").alias("rank", "e"))
    return rounded(
        long.select(
            "row_id", (F.col("rank") + 1).alias("rank"), F.col("e.ref_id").alias("ref_id"),
            F.col("e.pred").alias("ref_pred"), F.array_max("e.prob").alias("ref_confidence"),
        )
    )


_AGREE_SQL = with_sql(
    *_NB_NN,
    select=f"""SELECT q.row_id, round(sum((r.pred = q.pred)::INT) / {K}.0, 6) AS agreement
FROM nn JOIN nb r ON r.row_id = ref_id JOIN nb q ON q.row_id = nn.row_id GROUP BY q.row_id""",
)


@query("u11_neighbour_agreement", _AGREE_SQL)
def agreement(spark, sf):
    out, fitted = _measured(spark, sf, M.Neighbours(K))
    return rounded(out.select("row_id", F.col(fitted.ums[0]).alias("agreement")))


_VARIABILITY_SQL = with_sql(
    *_NB_NN,
    "p AS (SELECT nn.row_id, unnest(prob) AS p, unnest(range(len(prob))) AS c FROM nn JOIN nb ON nb.row_id = ref_id)",
    "s AS (SELECT row_id, c, stddev_pop(p) AS s FROM p GROUP BY 1, 2)",
    select="SELECT row_id, round(sum(s), 6) AS variability FROM s GROUP BY row_id",
)


@query("u12_neighbour_variability", _VARIABILITY_SQL)
def variability(spark, sf):
    out, fitted = _measured(spark, sf, M.Neighbours(K))
    return rounded(out.select("row_id", F.col(fitted.ums[1]).alias("variability")))


_DETAIL_SQL = with_sql(
    *_NB_NN,
    """h AS (SELECT nn.row_id, pred, count(*) AS n, min(rank) AS first FROM nn JOIN nb ON nb.row_id = ref_id GROUP BY 1, 2)""",
    select="""SELECT row_id, string_agg('class ' || pred || ': ' || n, ', ' ORDER BY n DESC, first) AS detail
FROM h GROUP BY row_id""",
)


@query("u13_neighbour_detail", _DETAIL_SQL)
def detail(spark, sf):
    out, fitted = _measured(spark, sf, M.Neighbours(K))
    text = F.transform(fitted.detail, lambda e: F.concat(e["label"], F.lit(": "), e["n"].cast("string")))
    return out.select("row_id", F.concat_ws(", ", text).alias("detail"))


@query(
    "u14_kth_distance",
    with_sql(*_NN, select="SELECT row_id, round(max(dist), 6) AS distance FROM nn GROUP BY row_id"),
)
def knn_distance(spark, sf):
    out, fitted = _measured(spark, sf, M.KnnDistance("not a number"))
    return rounded(out.select("row_id", F.col(fitted.um).alias("distance")))


@query(
    "a06_label_histogram",
    with_sql(*_NB_NN, select="SELECT nn.row_id, pred AS code, count(*) AS n FROM nn JOIN nb ON nb.row_id = ref_id GROUP BY 1, 2"),
)
def label_histogram(spark, sf):
    scored, _ = _scored(spark, sf)
    joined = knn_join(scored, scored, K, carry=["pred"])
    cells = joined.select("row_id", F.explode(M.neighbour_detail(F.col("nn"))).alias("e"))
    return cells.select("row_id", F.col("e.label").cast("int").alias("code"), F.col("e.n").cast("long").alias("n"))


@query("a07_variability", _VARIABILITY_SQL)
def grouped_variability(spark, sf):
    scored, _ = _scored(spark, sf)
    joined = knn_join(scored, scored, K, carry=["prob"])
    return rounded(joined.select("row_id", M.neighbour_variability(F.col("nn"), D.EMBEDDING_CLASSES).alias("variability")))


@query("a08_agreement_ratio", _AGREE_SQL)
def agreement_ratio(spark, sf):
    scored, _ = _scored(spark, sf)
    joined = knn_join(scored, scored, K, carry=["pred"])
    return rounded(joined.select("row_id", M.neighbour_agreement(F.col("nn")).alias("agreement")))


@query(
    "c03_neighbour_vote",
    with_sql(
        D.EMBEDDINGS_SQL,
        pairs_sql("nn", 11),
        "c AS (SELECT unnest(range(10)) AS c)",
        "v AS (SELECT nn.row_id, c, sum((label = c)::INT) / 11.0 AS share FROM nn JOIN base b ON b.row_id = ref_id, c GROUP BY 1, 2)",
        "p AS (SELECT row_id, list(share ORDER BY c) AS prob FROM v GROUP BY 1)",
        select="SELECT row_id, (list_position(prob, list_max(prob)) - 1)::INTEGER AS pred, round(list_max(prob), 6) AS confidence FROM p",
    ),
)
def neighbour_vote(spark, sf):
    df = D.embeddings(spark, sf)
    out = NeighbourVote(11).fit(df).transform(df)
    return rounded(out.select("row_id", "pred", F.array_max("prob").alias("confidence")))


@query(
    "d07_neighbour_distance",
    with_sql(D.EMBEDDINGS_SQL, pairs_sql("nn", 3, own=False), select="SELECT row_id, round(max(dist), 6) AS score FROM nn GROUP BY row_id"),
)
def detector_distance(spark, sf):
    df = D.embeddings(spark, sf)
    return rounded(NeighbourDistance().learn(df).train_scores(df).select("row_id", "score"))


@query(
    "d08_local_outlier_factor",
    with_sql(
        D.EMBEDDINGS_SQL,
        pairs_sql("nn", 5, own=False),
        "kd AS (SELECT row_id AS ref_id, max(dist) AS kdist FROM nn GROUP BY 1)",
        "lrd AS (SELECT row_id, 1 / (avg(greatest(dist, kdist)) + 1e-10) AS lrd FROM nn JOIN kd USING (ref_id) GROUP BY 1)",
        select="""SELECT nn.row_id, round(avg(o.lrd) / any_value(l.lrd), 6) AS score FROM nn JOIN lrd o ON o.row_id = nn.ref_id
JOIN lrd l ON l.row_id = nn.row_id GROUP BY nn.row_id""",
    ),
)
def local_outlier(spark, sf):
    df = D.embeddings(spark, sf)
    return rounded(LocalOutlierFactor().learn(df).train_scores(df).select("row_id", "score"))


@query(
    "d10_angles",
    with_sql(
        D.EMBEDDINGS_SQL,
        pairs_sql("nn", 7, own=False),
        "g AS (SELECT nn.row_id, rank, list_transform(range(1, 65), lambda i : r.f[i] - q.f[i]) AS g FROM nn JOIN base r ON r.row_id = ref_id JOIN base q ON q.row_id = nn.row_id)",
        """w AS (SELECT a.row_id, list_dot_product(a.g, b.g) / list_dot_product(a.g, a.g) / list_dot_product(b.g, b.g) AS w
  FROM g a JOIN g b ON a.row_id = b.row_id AND a.rank < b.rank)""",
        select="SELECT row_id, round(-var_pop(w), 6) AS score FROM w GROUP BY row_id",
    ),
)
def angles(spark, sf):
    df = D.embeddings(spark, sf)
    return rounded(AngleDetector().learn(df).train_scores(df).select("row_id", "score"))
