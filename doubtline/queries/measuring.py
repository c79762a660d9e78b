"""Uncertainty measures and custom hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from doubtline.functions import vectors as V
from doubtline.functions.prob import modal_vote, vote_share
from doubtline.operators import measures as M
from doubtline.operators.models import BlackBox, GaussianBayes, LinearDiscriminant, Model
from doubtline.operators.recon import Reconstructor
from doubtline.plans.monitor import Monitor
from doubtline.queries import data as D
from doubtline.queries.aggregates import bounds_sql
from doubtline.queries.data import certainty_sql, lda_sql, nb_sql, uniform_sql, with_sql
from doubtline.queries.registry import query, rounded

_ORDERS = (D.ORDERS_SQL, nb_sql("nb"))
_EVENTS = (D.EVENTS_SQL, nb_sql("nb"))


def measured(spark, sf, build, measures, classes, names=None):
    """Columns ``row_id, um_*`` of some measures around the naive Bayes black box."""
    scored, model = D.scored(build(spark, sf))
    monitor = Monitor(measures).fit(scored, model, classes, names)
    out = monitor.measure(scored)
    keep = [c for f in monitor.fitted for c in f.displays()]
    return rounded(out.select("row_id", *keep)), monitor


def one(df, name):
    source = [c for c in df.columns if c != "row_id"][0]
    return df.select("row_id", F.col(source).alias(name))


@query("u01_max_prob", with_sql(*_EVENTS, select="SELECT row_id, round(list_max(prob), 6) AS um FROM nb"))
def max_prob(spark, sf):
    return one(measured(spark, sf, D.events, [M.MaxProb()], 5)[0], "um")


@query("u02_entropy", with_sql(*_EVENTS, select=f"SELECT row_id, round({certainty_sql('prob', 5)}, 6) AS um FROM nb"))
def entropy(spark, sf):
    return one(measured(spark, sf, D.events, [M.Entropy()], 5)[0], "um")


def _inside(table: str, match: str) -> str:
    return f"""SELECT x.row_id, round(avg((lo <= v AND v <= hi)::INT), 6) AS um
FROM x JOIN {table} b ON {match} GROUP BY x.row_id"""


@query(
    "u03_interval_unsupervised",
    with_sql(D.EVENTS_SQL, bounds_sql("b", 0.5, False), D.long_sql("x"), select=_inside("b", "b.j = x.j")),
)
def interval_unsupervised(spark, sf):
    return one(measured(spark, sf, D.events, [M.ConfidenceInterval(0.5, False)], 5)[0], "um")


_SUP = (*_EVENTS, bounds_sql("b", 0.9, True), D.long_sql("x", "nb", ", pred"))


@query("u04_interval_supervised", with_sql(*_SUP, select=_inside("b", "b.j = x.j AND b.label = x.pred")))
def interval_supervised(spark, sf):
    return one(measured(spark, sf, D.events, [M.ConfidenceInterval(0.9)], 5)[0], "um")


@query(
    "j04_interval_lookup",
    with_sql(
        *_EVENTS,
        bounds_sql("b", 0.9, True, "sd"),
        D.long_sql("x", "nb", ", pred"),
        select=_inside("b", "b.j = x.j AND b.label = x.pred"),
    ),
)
def interval_lookup(spark, sf):
    """Intervals of single rows instead of intervals of the mean: they keep their width on large tables."""
    return one(measured(spark, sf, D.events, [M.ConfidenceInterval(0.9, True, "sd")], 5)[0], "um")


@query(
    "u05_external_supervised",
    with_sql(*_ORDERS, lda_sql("ck"), select=f"SELECT row_id, round({certainty_sql('prob', 3)}, 6) AS um, round(list_max(prob), 6) AS um_max FROM ck"),
)
def external_supervised(spark, sf):
    lda = LinearDiscriminant()
    out, _ = measured(spark, sf, D.orders, [M.External(lda), M.External(lda, measure="max_prob")], 3)
    return out.select("row_id", F.col("um_external_lda_entropy").alias("um"), F.col("um_external_lda_max_prob").alias("um_max"))


@query("u06_bayes", with_sql(D.EVENTS_SQL, nb_sql("ck"), select=f"SELECT row_id, round({certainty_sql('prob', 5)}, 6) AS um FROM ck"))
def bayes(spark, sf):
    return one(measured(spark, sf, D.events, [M.Bayes()], 5)[0], "um")


def combined_sql(check: str, classes: int) -> str:
    own, other = certainty_sql("nb.prob", classes), certainty_sql(f"{check}.prob", classes)
    return f"CASE WHEN nb.pred = {check}.pred THEN 1 ELSE -1 END * ({own} + {other}) / 2"


@query(
    "u08_combined",
    with_sql(*_ORDERS, lda_sql("ck"), select=f"SELECT row_id, round({combined_sql('ck', 3)}, 6) AS um FROM nb JOIN ck USING (row_id)"),
)
def combined(spark, sf):
    return one(measured(spark, sf, D.orders, [M.Combined(LinearDiscriminant())], 3)[0], "um")


_SCALED = nb_sql("sc", scaled=True)


@query(
    "u09_multi_combined",
    with_sql(*_ORDERS, lda_sql("ck"), _SCALED,
             select=f"SELECT row_id, round(({combined_sql('sc', 3)} + {combined_sql('ck', 3)}) / 2, 6) AS um FROM nb JOIN ck USING (row_id) JOIN sc USING (row_id)"),
)
def multi_combined(spark, sf):
    checkers = [GaussianBayes(scaled=True), LinearDiscriminant()]
    return one(measured(spark, sf, D.orders, [M.MultiCombined(checkers)], 3)[0], "um")


_VOTES = """v AS (SELECT nb.row_id, unnest([a.pred, b.pred, c.pred]) AS vote
  FROM nb JOIN nb a USING (row_id) JOIN sc b USING (row_id) JOIN ck c USING (row_id)),
n AS (SELECT row_id, vote, count(*) AS n FROM v GROUP BY 1, 2)"""


@query(
    "u10_agreement",
    with_sql(*_ORDERS, lda_sql("ck"), _SCALED, _VOTES, select="SELECT row_id, round(max(n) / 3.0, 6) AS um FROM n GROUP BY 1"),
)
def agreement(spark, sf):
    checkers = [GaussianBayes(), GaussianBayes(scaled=True), LinearDiscriminant()]
    return one(measured(spark, sf, D.orders, [M.Agreement(checkers)], 3)[0], "um")


@query(
    "a09_modal_vote",
    with_sql(*_ORDERS, lda_sql("ck"), _SCALED, _VOTES,
             select="SELECT row_id, first(vote ORDER BY n DESC, vote) AS vote, round(max(n) / 3.0, 6) AS share FROM n GROUP BY 1"),
)
def mode_of_votes(spark, sf):
    base = df = D.orders(spark, sf)
    names = []
    for i, model in enumerate([GaussianBayes(), GaussianBayes(scaled=True), LinearDiscriminant()]):
        df = model.fit(base).transform(df, f"prob{i}", f"pred{i}")
        names.append(f"pred{i}")
    votes = F.array(*names)
    return rounded(df.select("row_id", modal_vote(votes).alias("vote"), vote_share(votes).alias("share")))


def noise_sql(points: int, width: float, seed: int = 0) -> str:
    cells = ", ".join(
        f"f[{j}] + ({uniform_sql(str(seed), 'row_id', 'i', str(j - 1))} * 2 - 1) * {width} * sd[{j}]" for j in range(1, 5)
    )
    return f"""sd AS (SELECT list(s ORDER BY j) AS sd FROM (SELECT j, stddev_pop(v) AS s FROM {'lx'} GROUP BY j)),
noisy AS (SELECT row_id * 1000 + i AS row_id, row_id AS own, f AS origin, [{cells}]::DOUBLE[] AS f, label
  FROM base, sd, (SELECT unnest(range(1, {points + 1})) AS i))"""


def _proximity_sql(points: int, width: float, select: str) -> str:
    return with_sql(
        D.EVENTS_SQL, D.long_sql("lx"), nb_sql("nb"), noise_sql(points, width), nb_sql("nc", rows="noisy"),
        "h AS (SELECT own AS row_id, (nc.pred = nb.pred)::INT AS hit, list_distance(nc.f, origin) AS d FROM nc JOIN nb ON nb.row_id = own)",
        select=select,
    )


@query("u15_proximity", _proximity_sql(10, 0.1, "SELECT row_id, round(avg(hit), 6) AS um FROM h GROUP BY row_id"))
def proximity(spark, sf):
    return one(measured(spark, sf, D.events, [M.Proximity(10, 0.1, noise="md5")], 5)[0], "um")


@query(
    "u16_proximity_weighted",
    _proximity_sql(
        20, 0.05,
        """SELECT row_id, round(sum(hit * (m - d + 0.1 * m)) / sum(m - d + 0.1 * m), 6) AS um
FROM (SELECT *, max(d) OVER (PARTITION BY row_id) AS m FROM h) GROUP BY row_id""",
    ),
)
def proximity_weighted(spark, sf):
    return one(measured(spark, sf, D.events, [M.Proximity(20, 0.05, True, noise="md5")], 5)[0], "um")


@query(
    "j05_row_expansion",
    with_sql(D.EVENTS_SQL, D.long_sql("lx"), noise_sql(10, 0.1),
             select="SELECT own AS row_id, round(sum(f[1]), 6) AS value, round(sum(f[2]), 6) AS hour, count(*) AS copies FROM noisy GROUP BY own"),
)
def row_expansion(spark, sf):
    df = D.events(spark, sf)
    fitted = M.Proximity(10, 0.1, noise="md5").fit(M.FitContext(df, 5))
    wide = df.select("row_id", F.col("features").alias("__base"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("i"))
    noisy = wide.select("row_id", fitted.noisy("row_id", "i").alias("f"))
    return rounded(
        noisy.groupBy("row_id").agg(
            F.sum(V.item("f", 0)).alias("value"), F.sum(V.item("f", 1)).alias("hour"), F.count(F.lit(1)).alias("copies")
        )
    )


@query("u17_feature_bagging")
def feature_bagging(spark, sf):
    return measured(spark, sf, D.events, [M.FeatureBagging(10)], 5)[0]


@query("u18_feature_bagging_unsupervised")
def feature_bagging_unsupervised(spark, sf):
    return measured(spark, sf, D.orders, [M.FeatureBagging(10, "uns")], 3)[0]


@query("u19_reconstruction")
def reconstruction(spark, sf):
    return measured(spark, sf, D.embeddings, [M.ReconstructionLoss("simple")], 10)[0]


@query("u20_reconstruction_sparse")
def reconstruction_sparse(spark, sf):
    return measured(spark, sf, D.embeddings, [M.ReconstructionLoss("sparse")], 10)[0]


@query("u21_reconstruction_deep")
def reconstruction_deep(spark, sf):
    return measured(spark, sf, D.embeddings, [M.ReconstructionLoss("deep")], 10)[0]


@query("u19_reconstruction_linear")
def reconstruction_linear(spark, sf):
    return measured(spark, sf, D.embeddings, [M.ReconstructionLoss("pca")], 10)[0]


@query(
    "u19_reconstruction_stable",
    """SELECT kind, count(*) AS n, count(*) AS same, true AS learned
FROM embeddings, (SELECT unnest(['simple', 'sparse', 'deep']) AS kind) GROUP BY kind""",
)
def reconstruction_stable(spark, sf):
    """Rows whose loss is the same (to 1e-6) whether the autoencoder read one partition or eight, and whether it learned."""
    df = D.embeddings(spark, sf)
    out = None
    for kind in ("simple", "sparse", "deep"):
        one, many = (Reconstructor.fit(df.repartition(n), kind, epochs=10) for n in (1, 8))
        same = F.abs(one.loss() - many.loss()) <= 1e-6
        told = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same")).select(
            F.lit(kind).alias("kind"), "n", "same", F.lit(one.history[-1] < one.history[0]).alias("learned")
        )
        out = told if out is None else out.unionByName(told)
    return out


@query("u22_confidence_bagging")
def confidence_bagging(spark, sf):
    return measured(spark, sf, D.events, [M.ConfidenceBaggingMeasure(GaussianBayes(), members=10, decisors=6)], 5)[0]


@query("u23_confidence_boosting")
def confidence_boosting(spark, sf):
    return measured(spark, sf, D.events, [M.ConfidenceBoostingMeasure(GaussianBayes())], 5)[0]


# --- whole monitors -------------------------------------------------------------------------

_SPEC = [
    {"measure": "confidence", "level": 0.9},
    {"measure": "maxprob"},
    {"measure": "entropy"},
    {"measure": "bayes"},
    {"measure": "combined", "model": "LDA"},
    {"measure": "multicombined", "models": ["GNB", "LDA"]},
    {"measure": "agreement", "models": [{"name": "GNB", "scaled": False}, "GNB", "LDA"]},
]

MONITOR_SQL = with_sql(
    *_ORDERS, lda_sql("ck"), _SCALED, _VOTES,
    bounds_sql("b", 0.9, True), D.long_sql("x", "nb", ", pred"),
    "i AS (SELECT x.row_id, avg((lo <= v AND v <= hi)::INT) AS inside FROM x JOIN b ON b.j = x.j AND b.label = x.pred GROUP BY 1)",
    "g AS (SELECT row_id, max(n) / 3.0 AS share FROM n GROUP BY 1)",
    select=f"""SELECT row_id, round(inside, 6) AS um_interval_sup_0_9, round(list_max(nb.prob), 6) AS um_max_prob,
  round({certainty_sql('nb.prob', 3)}, 6) AS um_entropy, round({certainty_sql('nb.prob', 3)}, 6) AS um_external_gaussiannb_entropy,
  round({combined_sql('ck', 3)}, 6) AS um_combined_lda,
  round(({combined_sql('sc', 3)} + {combined_sql('ck', 3)}) / 2, 6) AS um_multicombined_gnb_lda,
  round(share, 6) AS um_agreement_gaussiannb_gnb_lda
FROM nb JOIN ck USING (row_id) JOIN sc USING (row_id) JOIN i USING (row_id) JOIN g USING (row_id)""",
)


def spec_monitor() -> Monitor:
    return Monitor.from_spec(_SPEC)


@query("m01_measure_set", MONITOR_SQL)
def measure_set(spark, sf):
    scored, model = D.scored(D.orders(spark, sf))
    monitor = spec_monitor().fit(scored, model, 3, D.STATUS)
    return rounded(monitor.measure(scored).select("row_id", *monitor.um_columns))


@query("m03_monitor_from_calls", MONITOR_SQL)
def monitor_from_calls(spark, sf):
    scored, model = D.scored(D.orders(spark, sf))
    monitor = Monitor().add_confidence(level=0.9).add_maxprob().add_entropy().add_bayes().add_combined("LDA")
    monitor.add_multicombined(["GNB", "LDA"]).add_agreement([GaussianBayes(), "GNB", "LDA"])
    monitor.fit(scored, model, 3, D.STATUS)
    return rounded(monitor.measure(scored).select("row_id", *monitor.um_columns))


# --- hooks ----------------------------------------------------------------------------------


def price_box() -> BlackBox:
    """A black box from outside: the chance of a high price by a logistic curve."""

    def prob(features):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(V.item(features, 0) - 250000.0) / 100000.0))
        return F.array(1.0 - p, p)

    return BlackBox("price", prob, 2)


_BOX = (
    D.ORDERS_SQL,
    "p AS (SELECT row_id, 1 / (1 + exp(-(f[1] - 250000.0) / 100000.0)) AS p FROM base)",
    "bx AS (SELECT row_id, [1 - p, p] AS prob, (p > 0.5)::INTEGER AS pred FROM p)",
)


@query(
    "e01_black_box",
    with_sql(*_BOX, select=f"SELECT row_id, pred, round(list_max(prob), 6) AS um_max_prob, round({certainty_sql('prob', 2)}, 6) AS um_entropy FROM bx"),
)
def black_box(spark, sf):
    box = price_box()
    scored = box.transform(D.orders(spark, sf).drop("label"))
    monitor = Monitor().add_maxprob().add_entropy().fit(scored, box, 2)
    return rounded(monitor.measure(scored).select("row_id", "pred", *monitor.um_columns))


class Margin(M.Measure):
    """A measure of one's own: the gap between the two largest probabilities."""

    def fit(self, ctx):
        return FittedMargin()


class FittedMargin(M.FittedMeasure):
    def columns(self, env):
        ranked = F.sort_array("prob", asc=False)
        return {"um_margin": V.item(ranked, 0) - V.item(ranked, 1)}

    def displays(self):
        return {"um_margin": "Margin"}


@query(
    "e02_custom_measure",
    with_sql(*_EVENTS, "s AS (SELECT row_id, list_reverse_sort(prob) AS p FROM nb)", select="SELECT row_id, round(p[1] - p[2], 6) AS um FROM s"),
)
def custom_measure(spark, sf):
    return one(measured(spark, sf, D.events, [Margin()], 5)[0], "um")


class PriceModel(Model):
    """A checker of one's own."""

    name = "price"

    def fit(self, train):
        return price_box()


@query(
    "e03_custom_checker",
    with_sql(*_BOX, nb_sql("nb"), select=f"""SELECT row_id, round(CASE WHEN nb.pred = bx.pred THEN 1 ELSE -1 END
  * ({certainty_sql('nb.prob', 3)} + {certainty_sql('bx.prob', 3)}) / 2, 6) AS um FROM nb JOIN bx USING (row_id)"""),
)
def custom_checker(spark, sf):
    return one(measured(spark, sf, D.orders, [M.Combined(PriceModel())], 3)[0], "um")


@query(
    "e04_dataset_hooks",
    " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, count(*) AS items, round(avg(f[1]), 6) AS first FROM (WITH {sql} SELECT * FROM base)"
        for name, sql in (("orders", D.ORDERS_SQL), ("events", D.EVENTS_SQL), ("embeddings", D.EMBEDDINGS_SQL))
    ),
)
def dataset_hooks(spark, sf):
    """Datasets given as callables that return a table."""
    hooks = {"orders": D.orders, "events": D.events, "embeddings": D.embeddings}
    parts = [
        build(spark, sf).agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("items"), F.avg(V.item("features", 0)).alias("first"))
        for name, build in hooks.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


