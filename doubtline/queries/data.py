"""The test tables in the roles of labelled, vector and skewed datasets."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.operators.models import Fitted, GaussianBayes
from doubtline.sources.tables import vector_table

# fixed values: class names of the two tabular roles, in code order
STATUS = ["F", "O", "P"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EMBEDDING_WIDTH = 64
EMBEDDING_CLASSES = 10
#: Rows of a task that works long on each row.
TASK_ROWS = 200_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def code_of(column: str, names: list[str]):
    out = None
    for i, name in enumerate(names):
        out = (F.when if out is None else out.when)(F.col(column) == name, i)
    return out.cast("int")


def over_cores(df: DataFrame) -> DataFrame:
    """A table with few input splits, dealt over the cores, and to tasks of at most ``TASK_ROWS`` rows, for heavy work on each row."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / TASK_ROWS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order status from price and customer balance; three classes."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = over_cores(o).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        V.pack(["o_totalprice", "c_acctbal"]),
        code_of("o_orderstatus", STATUS).alias("label"),
        "o_orderpriority",
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Event type from value, hour, weekday and the number in the properties; five classes."""
    e = over_cores(table(spark, sf, "events"))
    return e.select(
        F.col("event_id").alias("row_id"),
        event_features(),
        code_of("event_type", EVENT_TYPES).alias("label"),
        "ts",
    )


def event_features():
    number = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    return V.pack([F.col("value"), F.hour("ts"), F.weekday("ts"), number])


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = over_cores(table(spark, sf, "embeddings"))
    return vector_table(e, "vec_id", "embedding", "label", EMBEDDING_WIDTH)


def document_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, labelled or not, by the size of the whole text."""
    d = table(spark, sf, "documents")
    sizes = d.select(
        F.col("doc_id").alias("row_id"),
        F.length("text").cast("double").alias("chars"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("blanks"),
    )
    return sizes.select("row_id", V.pack(["chars", "blanks"]))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic flag (rare) from the size of the whole text."""
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    sizes = d.select(
        "doc_id",
        "source",
        F.length("text").cast("double").alias("chars"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("blanks"),
    )
    joined = sizes.join(labels, "doc_id")
    return joined.select(
        F.col("doc_id").alias("row_id"),
        V.pack(["chars", "blanks"]),
        F.col("toxic").cast("int").alias("label"),
        "source",
        "quality",
    )


def scored(df: DataFrame, scaled: bool = False) -> tuple[DataFrame, Fitted]:
    """Gaussian naive Bayes as the black box, fitted on the whole table."""
    model = GaussianBayes(scaled=scaled).fit(df)
    return model.transform(df), model


# --- the same in SQL ------------------------------------------------------------------------

ORDERS_SQL = """base AS (
  SELECT o_orderkey AS row_id, [o_totalprice, c_acctbal]::DOUBLE[] AS f,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS label, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

EVENTS_SQL = r"""base AS (
  SELECT event_id AS row_id,
         [value, hour(ts), isodow(ts) - 1, regexp_extract(props, '(\d+)', 1)::DOUBLE]::DOUBLE[] AS f,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                         WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS label, ts
  FROM events)"""

EMBEDDINGS_SQL = """base AS (
  SELECT vec_id AS row_id, embedding::DOUBLE[] AS f, label::INTEGER AS label FROM embeddings)"""

DOCUMENTS_SQL = """base AS (
  SELECT doc_id AS row_id,
         [length(text), length(text) - length(replace(text, ' ', ''))]::DOUBLE[] AS f,
         toxic::INTEGER AS label, source, quality
  FROM documents JOIN labels USING (doc_id))"""


def long_sql(name: str, rows: str = "base", extra: str = "") -> str:
    return f"""{name} AS (
  SELECT row_id{extra}, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS j FROM {rows})"""


def nb_sql(name: str, train: str = "base", rows: str = "base", scaled: bool = False) -> str:
    """CTEs that end in ``name(row_id, f, label, prob, pred, ...)``."""
    v = "(v - lo) / (hi - lo)" if scaled else "v"
    n = name
    return f"""{long_sql(f'{n}_t0', train, ', label')},
{n}_b AS (SELECT j, min(v) AS lo, max(v) AS hi FROM {n}_t0 GROUP BY j),
{n}_t AS (SELECT row_id, label, j, {v} AS v FROM {n}_t0 JOIN {n}_b USING (j)),
{n}_e AS (SELECT 1e-9 * max(va) AS e FROM (SELECT var_pop(v) AS va FROM {n}_t GROUP BY j)),
{n}_s AS (SELECT label AS c, j, avg(v) AS mu, var_pop(v) + (SELECT e FROM {n}_e) AS va FROM {n}_t GROUP BY 1, 2),
{n}_p AS (SELECT label AS c, ln(count(*) * 1.0 / (SELECT count(*) FROM {train})) AS lp FROM {train} GROUP BY 1),
{long_sql(f'{n}_x0', rows)},
{n}_x AS (SELECT row_id, j, {v} AS v FROM {n}_x0 JOIN {n}_b USING (j)),
{n}_l AS (SELECT row_id, s.c, any_value(lp) + sum(-0.5 * ln(2 * pi() * va) - (v - mu) * (v - mu) / (2 * va)) AS ll
          FROM {n}_x x JOIN {n}_s s USING (j) JOIN {n}_p p ON p.c = s.c GROUP BY 1, 2),
{softmax_sql(n, f'{n}_l', rows)}"""


def counted_nb_sql(name: str, kind: str, train: str = "base", rows: str = "base") -> str:
    """Naive Bayes over features scaled to 0..1: ``multinomial``, ``bernoulli`` (1 above 0) or ``complement``; smoothing 1."""
    n = name
    v = "(v - lo) / (hi - lo)" if kind != "bernoulli" else "((v - lo) / (hi - lo) > 0)::INT::DOUBLE"
    mass = {
        "multinomial": "s, sum(s) OVER (PARTITION BY c) + count(*) OVER (PARTITION BY c) AS whole",
        "bernoulli": "s, (SELECT count(*) FROM {t} WHERE label = c) + 2.0 AS whole",
        "complement": "sum(s) OVER (PARTITION BY j) - s AS s, sum(s) OVER () - sum(s) OVER (PARTITION BY c) + count(*) OVER (PARTITION BY c) AS whole",
    }[kind].format(t=train)
    score = {
        "multinomial": "any_value(lp) + sum(v * th)",
        "bernoulli": "any_value(lp) + sum(v * th + (1 - v) * ln(1 - exp(th)))",
        "complement": "-sum(v * th)",
    }[kind]
    return f"""{long_sql(f'{n}_t0', train, ', label')},
{n}_b AS (SELECT j, min(v) AS lo, max(v) AS hi FROM {n}_t0 GROUP BY j),
{n}_t AS (SELECT row_id, label, j, {v} AS v FROM {n}_t0 JOIN {n}_b USING (j)),
{n}_s AS (SELECT label AS c, j, sum(v) AS s FROM {n}_t GROUP BY 1, 2),
{n}_m AS (SELECT c, j, {mass} FROM {n}_s),
{n}_h AS (SELECT c, j, ln(s + 1) - ln(whole) AS th FROM {n}_m),
{n}_p AS (SELECT label AS c, ln(count(*) + 1.0) - ln((SELECT count(*) + count(DISTINCT label) FROM {train})) AS lp FROM {train} GROUP BY 1),
{n}_l AS (SELECT row_id, h.c, {score} AS ll FROM {n}_t x JOIN {n}_h h USING (j) JOIN {n}_p p ON p.c = h.c GROUP BY 1, 2),
{softmax_sql(n, f'{n}_l', rows)}"""


def softmax_sql(name: str, scores: str, rows: str = "base") -> str:
    """From ``scores(row_id, c, ll)`` to ``name(row_id, ..., prob, pred)``."""
    n = name
    return f"""{n}_w AS (SELECT row_id, c, exp(ll - max(ll) OVER (PARTITION BY row_id)) AS w FROM {scores}),
{n}_z AS (SELECT row_id, list(w ORDER BY c) AS w, sum(w) AS t FROM {n}_w GROUP BY row_id),
{n} AS (SELECT r.*, list_transform(w, lambda a : a / t) AS prob,
               (list_position(w, list_max(w)) - 1)::INTEGER AS pred
        FROM {rows} r JOIN {n}_z USING (row_id))"""


def lda_sql(name: str, train: str = "base", rows: str = "base") -> str:
    """Linear discriminant for two features, the inverse written out."""
    n = name
    return f"""{n}_m AS (SELECT label AS c, count(*) AS n, avg(f[1]) AS a, avg(f[2]) AS b FROM {train} GROUP BY 1),
{n}_q AS (SELECT sum((f[1] - a) * (f[1] - a)) / (count(*) - count(DISTINCT c)) AS s11,
                 sum((f[1] - a) * (f[2] - b)) / (count(*) - count(DISTINCT c)) AS s12,
                 sum((f[2] - b) * (f[2] - b)) / (count(*) - count(DISTINCT c)) AS s22
          FROM {train} JOIN {n}_m ON label = c),
{n}_g AS (SELECT c, n, a, b, (s22 * a - s12 * b) / (s11 * s22 - s12 * s12) AS wa,
                 (s11 * b - s12 * a) / (s11 * s22 - s12 * s12) AS wb FROM {n}_m, {n}_q),
{n}_l AS (SELECT row_id, c, wa * f[1] + wb * f[2] - 0.5 * (wa * a + wb * b)
                 + ln(n * 1.0 / (SELECT count(*) FROM {train})) AS ll FROM {rows}, {n}_g),
{softmax_sql(n, f'{n}_l', rows)}"""


def certainty_sql(prob: str, classes: int) -> str:
    h = (
        f"list_sum(list_transform(list_filter({prob}, lambda p : p <> 0), "
        f"lambda p : -(p / list_sum({prob})) * log2(p / list_sum({prob}))))"
    )
    return f"(log2({classes}) - {h}) / log2({classes})"


def uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('_', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
