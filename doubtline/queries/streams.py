"""Streaming plans, run to the end over the event and vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from doubtline.functions.prob import confidence
from doubtline.operators import measures as M
from doubtline.operators.cleaning import rejected_to_null
from doubtline.operators.metrics import threshold_judge
from doubtline.plans.monitor import Monitor
from doubtline.queries import data as D
from doubtline.queries.aggregates import bounds_sql, omission_sql
from doubtline.queries.data import certainty_sql, nb_sql, with_sql
from doubtline.queries.neighbours import pairs_sql
from doubtline.queries.registry import query, rounded
from doubtline.session import work_path
from doubtline.sources.tables import vector_table
from doubtline.streaming.judge import drain, judge_batches, judge_stream, windowed_omission


def stream_of(spark, sf, name):
    """A table as a stream, be it one file or a folder of files."""
    schema = D.table(spark, sf, name).schema
    # as a pattern: a plain path would have to be a folder
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def event_stream(spark, sf):
    e = stream_of(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        D.event_features(),
        D.code_of("event_type", D.EVENT_TYPES).alias("label"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


@query(
    "x01_judge_stream",
    with_sql(
        D.EVENTS_SQL, nb_sql("nb"), bounds_sql("b", 0.9, True), D.long_sql("x", "nb", ", pred"),
        "i AS (SELECT x.row_id, avg((lo <= v AND v <= hi)::INT) AS inside FROM x JOIN b ON b.j = x.j AND b.label = x.pred GROUP BY 1)",
        select=f"""SELECT row_id, pred, round(inside, 6) AS um_interval_sup_0_9, round(list_max(prob), 6) AS um_max_prob,
  round({certainty_sql('prob', 5)}, 6) AS um_entropy FROM nb JOIN i USING (row_id)""",
    ),
)
def stream_measures(spark, sf):
    scored, model = D.scored(D.events(spark, sf))
    monitor = Monitor().add_confidence(level=0.9).add_maxprob().add_entropy().fit(scored, model, 5, D.EVENT_TYPES)
    judged = judge_stream(event_stream(spark, sf), monitor).select("row_id", "pred", *monitor.um_columns)
    return rounded(drain(judged, work_path(spark, "stream"), work_path(spark, "stream-state")))


@query(
    "x02_neighbours_on_stream",
    with_sql(D.EMBEDDINGS_SQL, pairs_sql("nn", 19), select="SELECT row_id, round(max(dist), 6) AS um FROM nn GROUP BY row_id"),
)
def stream_neighbours(spark, sf):
    scored, model = D.scored(D.embeddings(spark, sf))
    monitor = Monitor([M.KnnDistance(19)]).fit(scored, model, D.EMBEDDING_CLASSES)
    rows = vector_table(stream_of(spark, sf, "embeddings"), "vec_id", "embedding", "label", D.EMBEDDING_WIDTH)
    path = work_path(spark, "stream")
    judge_batches(rows, monitor, path, work_path(spark, "stream-state")).awaitTermination()
    return rounded(spark.read.parquet(path).select("row_id", F.col(monitor.um_columns[0]).alias("um")))


@query(
    "x03_windowed_omission",
    with_sql(
        D.EVENTS_SQL, nb_sql("nb"),
        "j AS (SELECT *, CASE WHEN list_max(prob) < 0.22 THEN NULL ELSE pred END AS wrapped_pred, date_trunc('day', ts) AS day FROM nb)",
        f"o AS ({omission_sql('j', 'day')})",
        select="""SELECT strftime(day, '%Y-%m-%d') AS day, alpha, eps, phi, alpha_w, eps_w, phi_c, phi_m, eps_gain, phi_m_ratio, overall
FROM o WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    ),
)
def stream_windows(spark, sf):
    """Closed windows only: the last ones stay open until the watermark passes them."""
    _, model = D.scored(D.events(spark, sf))
    scored = model.transform(event_stream(spark, sf))
    judged = scored.withColumn("um", confidence("prob")).withColumn("misc_pred", threshold_judge("um", 0.22))
    judged = judged.withColumn("wrapped_pred", rejected_to_null())
    out = drain(windowed_omission(judged, "ts"), work_path(spark, "windows"), work_path(spark, "windows-state"))
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return rounded(out.select(day, *[c for c in out.columns if not c.startswith("window_")]))
