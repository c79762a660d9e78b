"""Per-feature and per-class statistics, exact quantiles and exact running totals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doubtline.functions.vectors import double_literal, item, width_of
from doubtline.operators.bounded import bounded_collect, check_values

WIDE_LIMIT = 32
SMALL_GROUP = 2_000_000
#: Up to so many tasks, their vectors are folded in one step.
DIRECT_TASKS = 16
#: Times that quantile brackets are counted and narrowed.
MOST_PASSES = 20


@dataclass
class Moments:
    """Count, mean, population variance, minimum and maximum per (group, feature)."""

    labels: list
    n: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def width(self) -> int:
        return self.mean.shape[1]

    @property
    def rows(self) -> float:
        return float(self.n.sum())

    def overall(self) -> Moments:
        """Merge the groups into one."""
        share = (self.n / self.n.sum())[:, None]
        mean = (share * self.mean).sum(axis=0)
        var = (share * (self.var + (self.mean - mean) ** 2)).sum(axis=0)
        return Moments(
            [None],
            np.array([self.n.sum()]),
            mean[None, :],
            var[None, :],
            self.low.min(axis=0)[None, :],
            self.high.max(axis=0)[None, :],
        )

    def sem(self) -> np.ndarray:
        """Standard error of the mean; NaN for a group of one row."""
        n = self.n.astype(float)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n > 1, np.sqrt(self.var / (n - 1.0)), np.nan)


def long_form(df: DataFrame, *keys: str, features: str = "features") -> DataFrame:
    """One row per (row, feature): ``keys..., fid, x``. Narrow, no shuffle."""
    return df.select(*keys, F.posexplode(features).alias("fid", "x"))


def moments(df: DataFrame, by: str | None = None, features: str = "features") -> Moments:
    """One pass over the table, combined on the map side."""
    d = width_of(df, features)
    key = F.col(by) if by else F.lit(0)
    base = df.select(key.alias("__g"), F.col(features).alias("__f"))
    if d <= WIDE_LIMIT:
        aggs = [F.count(F.lit(1)).alias("n")]
        for j in range(d):
            x = item("__f", j)
            aggs += [
                F.avg(x).alias(f"a{j}"),
                F.var_pop(x).alias(f"v{j}"),
                F.min(x).alias(f"l{j}"),
                F.max(x).alias(f"h{j}"),
            ]
        rows = bounded_collect(base.groupBy("__g").agg(*aggs), what="class statistics")
        rows.sort(key=lambda r: r["__g"])
        check_values(len(rows) * d, "class statistics")
        grid = {p: np.array([[r[f"{p}{j}"] for j in range(d)] for r in rows], float) for p in "avlh"}
        counts, labels = [r.n for r in rows], [r["__g"] for r in rows]
    else:
        long = base.select("__g", F.posexplode("__f").alias("fid", "x"))
        table = long.groupBy("__g", "fid").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("x").alias("a"),
            F.var_pop("x").alias("v"),
            F.min("x").alias("l"),
            F.max("x").alias("h"),
        )
        cells = bounded_collect(table, limit=2_000_000, what="class statistics")
        labels = sorted({r["__g"] for r in cells})
        place = {g: i for i, g in enumerate(labels)}
        grid = {p: np.zeros((len(labels), d)) for p in "avlh"}
        counts = [0] * len(labels)
        for r in cells:
            i = place[r["__g"]]
            counts[i] = r.n
            for p in "avlh":
                grid[p][i, r.fid] = r[p]
    if not labels:
        raise ValueError("no rows to fit on")
    return Moments(
        labels if by else [None], np.array(counts, float), grid["a"], grid["v"], grid["l"], grid["h"]
    )


# --- exact quantiles ------------------------------------------------------------------------


def exact_quantile(
    df: DataFrame,
    probability: float,
    by: str | None = None,
    features: str = "features",
    small: int = SMALL_GROUP,
    group_rows: float | None = None,
) -> dict:
    """``{group: [quantile of each feature]}``, exact, linear between ranks.

    Groups of at most ``small`` values use the built-in exact ``percentile``, whose buffers are
    then bounded. Larger ones are narrowed first: a quantile sketch brackets the two ranks wanted, the
    bracket is verified by counting, and only the values inside go on. Two or three passes bring
    any size below ``small``; no task ever holds a whole group.
    """
    d = width_of(df, features)
    key = F.col(by) if by else F.lit(0)
    base = df.select(key.alias("__g"), F.col(features).alias("__f"))
    if group_rows is None:
        counts = bounded_collect(base.groupBy("__g").agg(F.count(F.lit(1)).alias("n")))
        group_rows = max((r.n for r in counts), default=0)
    if group_rows * d <= small:
        if d <= WIDE_LIMIT:
            aggs = [F.percentile(item("__f", j), F.lit(probability)).alias(f"q{j}") for j in range(d)]
            rows = bounded_collect(base.groupBy("__g").agg(*aggs))
            return {(r["__g"] if by else None): [r[f"q{j}"] for j in range(d)] for r in rows}
        long = base.select("__g", F.posexplode("__f").alias("fid", "x"))
        cells = bounded_collect(
            long.groupBy("__g", "fid").agg(F.percentile("x", F.lit(probability)).alias("q")),
            limit=2_000_000,
        )
        out: dict = {}
        for r in cells:
            out.setdefault(r["__g"] if by else None, [None] * d)[r.fid] = r.q
        return out
    long = base.select("__g", F.posexplode("__f").alias("fid", "x"))
    found = _bracketed_quantile(long, probability, small)
    out = {}
    for (g, fid), q in found.items():
        out.setdefault(g if by else None, [None] * d)[fid] = q
    return out


def _bounds_frame(long: DataFrame, state: dict) -> DataFrame:
    spark = long.sparkSession
    gtype = long.schema["__g"].dataType.simpleString()
    rows = [(g, f, s["lo"], s["hi"]) for (g, f), s in state.items()]
    frame = spark.createDataFrame(rows, f"__g {gtype}, fid int, lo double, hi double")
    return F.broadcast(frame)


def _bracketed_quantile(long: DataFrame, p: float, small: int) -> dict:
    keys = ["__g", "fid"]
    accuracy = 10_000
    margin = 4.0 / accuracy
    shares = F.array(F.lit(max(p - margin, 0.0)), F.lit(min(p + margin, 1.0)))
    start = bounded_collect(
        long.groupBy(*keys).agg(
            F.count("x").alias("n"),
            F.min("x").alias("least"),
            F.max("x").alias("most"),
            F.percentile_approx("x", shares, accuracy).alias("b"),
        ),
        what="quantile brackets",
    )
    state = {}
    for r in start:
        at = p * (r.n - 1)
        state[(r["__g"], r.fid)] = {
            "n": r.n, "first": math.floor(at), "part": at - math.floor(at),
            "least": r.least, "most": r.most, "lo": r.b[0], "hi": r.b[1],
        }
    for attempt in range(MOST_PASSES + 1):
        joined = long.join(_bounds_frame(long, state), keys)
        inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
        seen = bounded_collect(
            joined.groupBy(*keys).agg(
                F.sum(F.when(F.col("x") < F.col("lo"), 1).otherwise(0)).alias("below"),
                F.sum(F.when(inside, 1).otherwise(0)).alias("inside"),
            )
        )
        retry = False
        for r in seen:
            s = state[(r["__g"], r.fid)]
            s["below"], s["inside"] = r.below, r.inside
            last = min(s["first"] + 1, s["n"] - 1)
            if s["below"] > s["first"]:
                s["lo"], retry = s["least"], True
            if s["below"] + s["inside"] <= last:
                s["hi"], retry = s["most"], True
        if retry:
            if attempt == MOST_PASSES:
                raise RuntimeError("the quantile brackets were not verified")
            continue
        wide = {k: s for k, s in state.items() if s["inside"] > small and s["lo"] < s["hi"]}
        if not wide or attempt >= MOST_PASSES:
            break  # the last counts are those of these brackets
        # narrow again, inside the verified bracket only
        narrowed = long.join(_bounds_frame(long, wide), keys).filter(inside)
        grid = [i / 64.0 for i in range(65)]
        cuts = bounded_collect(
            narrowed.groupBy(*keys).agg(
                F.percentile_approx("x", F.array(*[F.lit(g) for g in grid]), accuracy).alias("b")
            )
        )
        moved = False
        for r in cuts:
            s = wide[(r["__g"], r.fid)]
            at = (s["first"] - s["below"]) / max(s["inside"] - 1, 1)
            i = min(int(at * 64), 63)
            lo, hi = r.b[max(i - 1, 0)], r.b[min(i + 2, 64)]
            moved = moved or (lo, hi) != (s["lo"], s["hi"])
            s["lo"], s["hi"] = lo, hi
        if not moved:
            break  # the same brackets, already counted
    joined = long.join(_bounds_frame(long, state), keys)
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    values = joined.filter(inside).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("upto", F.sum("c").over(upto))
    wanted = long.sparkSession.createDataFrame(
        [
            (g, f, w, s["first"] - s["below"] + w if s["first"] + w < s["n"] else s["first"] - s["below"])
            for (g, f), s in state.items()
            for w in (0, 1)
        ],
        f"__g {long.schema['__g'].dataType.simpleString()}, fid int, which int, rank bigint",
    )
    hit = ranked.join(F.broadcast(wanted), keys).filter(
        (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank"))
    )
    picked: dict = {}
    for r in bounded_collect(hit.select(*keys, "which", "x")):
        picked.setdefault((r["__g"], r.fid), {})[r.which] = r.x
    return {
        k: v[0] + (v[1] - v[0]) * state[k]["part"] if v[1] != v[0] else v[0] for k, v in picked.items()
    }


def column_quantile(
    df: DataFrame, column: str, probability: float, small: int = SMALL_GROUP, rows: float | None = None
) -> float:
    """Exact quantile of one numeric column; ``rows`` saves a count where it is known."""
    x = F.col(column).cast("double")
    frame = df.select(F.array(x).alias("features", metadata={"width": 1}))
    return exact_quantile(frame, probability, small=small, group_rows=rows)[None][0]


# --- exact running totals without a global sort in one task --------------------------------


def range_text(column: str, cuts: list[float]) -> str:
    """Number of cut points below a column, as a balanced tree of comparisons."""
    points = sorted(set(cuts))

    def node(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if({column} > {double_literal(points[mid])}, {node(mid + 1, hi)}, {node(lo, mid)})"

    return node(0, len(points))


def running_totals(
    df: DataFrame,
    order: str,
    sums: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    buckets: int | None = None,
    merged: bool = False,
) -> DataFrame:
    """Running sums of ``sums`` in the order of a numeric column, one row per distinct value.

    Equal values are merged first, so a value that holds a third of all rows is one row
    afterwards. Value ranges (cut points from a sketch) are then totalled, their offsets, a
    bounded table, are broadcast, and each range is summed by its own task. ``merged`` tells that
    ``df`` has one row per value already; the ranges then hold equal numbers of values.
    """
    by = by or []
    spark = df.sparkSession
    values = df if merged else df.groupBy(*by, order).agg(*[F.sum(s).alias(s) for s in sums])
    buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = bounded_collect(
        df.groupBy(*by).agg(F.percentile_approx(order, shares, 10_000).alias("__cuts")),
        what="running-total groups",
    )
    check_values(len(cuts) * buckets, "running-total ranges")
    schema = df.select(*by).schema.simpleString()[len("struct<") : -1] if by else ""
    if by:
        cut_schema = f"{schema}, __cuts array<double>"
        rows = [tuple(r[b] for b in by) + ([float(c) for c in r["__cuts"] or []],) for r in cuts]
        ranged = values.join(F.broadcast(spark.createDataFrame(rows, cut_schema)), by)
        below = F.filter("__cuts", lambda c: c < F.col(order))
        ranged = ranged.withColumn("__range", F.size(below)).drop("__cuts")
    else:
        ranged = values.withColumn("__range", F.expr(range_text(order, cuts[0]["__cuts"] or [])))
    totals = ranged.groupBy(*by, "__range").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    direction = F.col("__range").desc() if descending else F.col("__range").asc()
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(direction).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *by, "__range", *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums]
    )
    step = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*by, "__range").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), [*by, "__range"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.sum(s).over(inside) + F.col(f"__o_{s}"))
    return out.drop("__range", *[f"__o_{s}" for s in sums])


# --- numpy partials per task ----------------------------------------------------------------


def task_partials(df: DataFrame, fn, size: int, how: str = "sum", features: str = "features") -> np.ndarray:
    """Reduce ``fn(matrix) -> vector of length size`` over the whole table.

    Each task folds its batches into one vector; the vectors are folded by position on the
    executors, so that ``size`` numbers reach the driver, whatever the number of tasks.
    """
    from doubtline.functions.vectors import to_matrix

    check_values(size, "partial results")
    fold = {"sum": np.add, "min": np.minimum, "max": np.maximum}[how]

    def partial(batches):
        import pyarrow as pa

        state = None
        for batch in batches:
            if batch.num_rows:
                part = np.asarray(fn(to_matrix(batch.column(0))), float)
                state = part if state is None else fold(state, part)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.list_(pa.float64()))], ["part"])

    column = F.col(features).cast("array<double>").alias("x")
    return fold_vectors(df.select(column).mapInArrow(partial, "part array<double>"), size, how)


def fold_vectors(parts: DataFrame, size: int, how: str = "sum") -> np.ndarray:
    """Folds the vectors of a column ``part``, one for each task, into one of ``size`` numbers.

    Many tasks' vectors go whole to about the square root of their number of tasks, which fold them, so the numbers
    that are then folded by position grow with that root and not with the tasks.
    """
    fold = {"sum": np.add, "min": np.minimum, "max": np.maximum}[how]
    merge = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    tasks = parts.rdd.getNumPartitions()
    if tasks > DIRECT_TASKS:

        def together(batches):
            import pyarrow as pa

            state = None
            for batch in batches:
                for row in batch.column(0):
                    part = row.values.to_numpy()
                    state = part.copy() if state is None else fold(state, part)
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array([state], pa.list_(pa.float64()))], ["part"])

        parts = parts.repartition(math.ceil(math.sqrt(tasks))).mapInArrow(together, "part array<double>")
    folded = parts.select(F.posexplode("part").alias("pos", "v")).groupBy("pos").agg(merge("v").alias("v"))
    out = np.zeros(size)
    for r in bounded_collect(folded, limit=size, what="partial results"):
        out[r.pos] = r.v
    return out


def gram(df: DataFrame, center: np.ndarray, features: str = "features") -> tuple[float, np.ndarray, np.ndarray]:
    """``(n, sum of centred rows, centred X'X)``"""
    center = np.asarray(center, float)
    d = len(center)

    def block(x: np.ndarray) -> np.ndarray:
        x = x - center
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    flat = task_partials(df, block, d * (d + 1) + 1, "sum", features)
    return flat[0], flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


def covariance(
    df: DataFrame, features: str = "features", ddof: int = 1, center: np.ndarray | None = None
) -> tuple[float, np.ndarray, np.ndarray]:
    """``(n, mean, covariance)``; rows are centred first, to keep the digits."""
    if center is None:
        center = moments(df, features=features).mean[0]
    n, first, second = gram(df, center, features)
    shift = first / n
    return n, center + shift, (second - n * np.outer(shift, shift)) / max(n - ddof, 1.0)
