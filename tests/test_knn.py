import numpy as np
import pytest
from helpers import vectors

from doubtline.operators.knn import knn_join, lsh_neighbours, neighbour_pairs, valid_k


def brute(q, r, k, own=False, q_ids=None, r_ids=None):
    q_ids = np.arange(len(q)) if q_ids is None else q_ids
    r_ids = np.arange(len(r)) if r_ids is None else r_ids
    out = set()
    for qi, x in zip(q_ids, q):
        d = np.sqrt(((r - x) ** 2).sum(axis=1))
        order = sorted((round(v, 9), i) for v, i in zip(d, r_ids) if not (own and i == qi))[:k]
        out |= {(qi, n + 1, i) for n, (_, i) in enumerate(order)}
    return out


def pairs(df):
    return {(r.row_id, r.rank, r.ref_id) for r in neighbour_pairs(df).collect()}


FORMS = {
    "broadcast": {},
    "pivots": {"broadcast_bytes": 0, "pivots": 7, "block_rows": 40, "query_rows": 30, "form": "pivots"},
    "one_pivot": {"broadcast_bytes": 0, "pivots": 1, "block_rows": 1000, "query_rows": 1000, "form": "pivots"},
    "rings": {"broadcast_bytes": 0, "pivots": 2, "block_rows": 10, "query_rows": 1000, "form": "pivots"},
    "tiles": {"broadcast_bytes": 0, "pivots": 3, "block_rows": 40, "query_rows": 70, "form": "tiles"},
    "slices": {"broadcast_bytes": 0, "pivots": 3, "block_rows": 20, "query_rows": 70, "slice_rows": 90, "form": "tiles"},
    "measured": {"broadcast_bytes": 0, "block_rows": 40},
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("own", [False, True])
def test_exact_against_brute_force(spark, form, own):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)).round(1)  # many equal distances
    df = vectors(spark, x).repartition(3)
    assert pairs(knn_join(df, df, 6, exclude_self=own, **FORMS[form])) == brute(x, x, 6, own)


@pytest.mark.parametrize("form", FORMS)
def test_a_third_of_the_rows_are_copies(spark, form):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 2)) * 10
    x[::3] = [1.0, 2.0]
    df = vectors(spark, x).repartition(4)
    assert pairs(knn_join(df, df, 5, exclude_self=True, **FORMS[form])) == brute(x, x, 5, True)


@pytest.mark.parametrize("form", FORMS)
def test_clusters_far_apart_and_other_queries(spark, form):
    rng = np.random.default_rng(2)
    r = np.concatenate([rng.normal(size=(100, 4)) + c for c in (0, 50, 1000)])
    q = np.concatenate([rng.normal(size=(20, 4)) + c for c in (25, 1000, -400)])
    query, ref = vectors(spark, q, start=5000), vectors(spark, r)
    got = pairs(knn_join(query, ref, 4, **FORMS[form]))
    assert got == brute(q, r, 4, q_ids=np.arange(5000, 5060))


@pytest.mark.parametrize("form", FORMS)
def test_k_not_below_the_reference_size(spark, form):
    x = np.arange(8.0)[:, None]
    df = vectors(spark, x)
    assert pairs(knn_join(df, df, 8, **FORMS[form])) == brute(x, x, 8)
    assert pairs(knn_join(df, df, 20, **FORMS[form])) == brute(x, x, 20)


@pytest.mark.parametrize("form", FORMS)
def test_carried_columns_belong_to_the_neighbour(spark, form):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2))
    df = vectors(spark, x).selectExpr("row_id", "features", "cast(row_id * 2 as int) as pred", "array(cast(row_id as double), 1D) as prob")
    for r in knn_join(df, df, 3, carry=["pred", "prob"], **FORMS[form]).collect():
        assert all(e.pred == e.ref_id * 2 and e.prob == [float(e.ref_id), 1.0] for e in r.nn)


def test_hashing_recall_and_k(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(40, 8)) * 0.1 + c for c in rng.normal(size=(6, 8)) * 5])
    df = vectors(spark, x)
    near = lsh_neighbours(df, df, 5, radius=2.0, bucket_length=2.0, tables=8)
    got = {(r.row_id, r.ref_id) for r in near.collect()}
    want = {(q, i) for q, _, i in brute(x, x, 5)}
    assert len(got & want) / len(want) >= 0.9
    assert valid_k("7") == 7 and valid_k("many") == 19 and valid_k(None) == 19


def test_all_forms_agree_on_repeated_ids(spark):
    """An id may stand on several rows, some of them equal: each row has the neighbours of its own vector."""
    rng = np.random.default_rng(5)
    ref = vectors(spark, rng.normal(size=(200, 2)))
    rows = [(i % 60, rng.normal(size=2).round(2).tolist()) for i in range(120)]
    rows += rows[:10]
    query = spark.createDataFrame(rows, "row_id bigint, features array<double>")

    def answers(form):
        out = knn_join(query, ref, 5, **FORMS[form]).collect()
        return sorted((r.row_id, tuple(r.features), tuple((e.ref_id, round(e.dist, 9)) for e in r.nn)) for r in out)

    want = answers("broadcast")
    assert len(want) == 130
    for form in ("pivots", "rings", "tiles", "slices"):
        assert answers(form) == want, form


def test_an_empty_reference_gives_empty_lists(spark):
    ref = vectors(spark, np.zeros((3, 2))).filter("row_id > 10")
    query = vectors(spark, np.ones((2, 2)))
    assert [r.nn for r in knn_join(query, ref, 2).collect()] == [[], []]


def test_carried_columns_count_for_the_broadcast(spark):
    from pyspark.sql import functions as F

    from doubtline.operators.knn import reference_bytes

    df = vectors(spark, np.zeros((10, 2))).withColumn("prob", F.array_repeat(F.lit(0.1), 10_000)).withColumn("note", F.repeat(F.lit("x"), 500))
    rows, size = reference_bytes(df, "features", "prob", "note")
    assert rows == 10 and 10 * 80_500 < size < 10 * 81_000


def test_copies_are_cut_for_any_k(spark):
    from doubtline.operators.knn import drop_surplus_copies

    df = vectors(spark, np.zeros((3000, 2))).union(vectors(spark, np.ones((5, 2)), start=3000))
    kept = drop_surplus_copies(df, 1200, "row_id", "features").collect()
    assert sorted(r.row_id for r in kept) == [*range(1200), *range(3000, 3005)]


def test_the_share_of_the_reference_asked_chooses_the_form():
    from doubtline.operators.knn import choose_form, tiling

    asked, rows, width = 1_000_000, 10_000_000, 64
    groups, slices = tiling(asked, rows, width, 50_000, 8)
    assert (groups, slices) == (20, 10)
    told = {"groups": groups, "slices": slices, "rows": rows, "width": width, "k": 19, "carried": 0, "query_rows": 50_000}
    assert choose_form(asked, 0.07, 35.0, **told) == "pivots"
    assert choose_form(asked, 1.0, 500.0, **told) == "tiles"
    # few queries that ask two blocks each: a reference moved to eight groups would be waste
    assert tiling(1, rows, width, 50_000, 8) == (1, 10)
    assert choose_form(2000, 0.6, 2.0, 8, 1, rows, width, 19, 0, 50_000) == "pivots"


def test_routing_tells_clustered_from_wide_vectors(spark):
    from doubtline.operators.knn import _Cells, routing

    rng = np.random.default_rng(8)

    def share(x):
        cells = _Cells(x[:: len(x) // 12][:12])
        away = cells.distances(x)
        home = away.argmin(axis=1)
        used = np.unique(home)
        cells.block_ids, cells.block_cell = np.arange(len(used)), used
        own = [away[home == c, c] for c in used]
        cells.block_low, cells.block_high = np.array([o.min() for o in own]), np.array([o.max() for o in own])
        for c, o in zip(used, own, strict=True):
            cells.kth_within[c] = np.sort(o)[min(4, len(o) - 1)] if len(o) > 4 else np.inf
        return routing(vectors(spark, x), cells, np.array([len(o) for o in own]), "features")

    asked, wide, _ = share(rng.normal(size=(400, 64)))
    assert asked == 400 and wide > 0.9
    clustered = np.concatenate([rng.normal(size=(50, 4)) * 0.1 + 20 * c for c in np.concatenate([np.eye(4), -np.eye(4)])])
    assert share(clustered)[1] < 0.5


def test_tiles_keep_the_columns_of_the_query(spark):
    rng = np.random.default_rng(9)
    df = vectors(spark, rng.normal(size=(90, 3)))
    query = df.selectExpr("row_id", "features", "cast(null as string) as note", "array('a', null) as `a.b`", "named_struct('x', row_id) as s", "1 as nn")
    out = knn_join(query, df, 2, **FORMS["tiles"])
    assert [(f.name, f.dataType) for f in out.schema][:5] == [(f.name, f.dataType) for f in query.schema][:5]
    rows = out.collect()
    assert len(rows) == 90
    assert all(r["a.b"] == ["a", None] and r.s.x == r.row_id and r.nn[0].ref_id == r.row_id for r in rows)


def test_a_query_without_a_vector_counts_as_zeros_in_all_forms(spark):
    df = vectors(spark, np.arange(40.0)[:, None] - 20)
    query = spark.createDataFrame([(1, None)], "row_id bigint, features array<double>")
    for form in ("broadcast", "tiles", "slices"):
        assert [e.ref_id for e in knn_join(query, df, 2, **FORMS[form]).first().nn] == [20, 19], form


def test_copies_of_rows_stay_bounded_on_large_tables():
    """Small blocks, groups and slices asked for on a large table don't copy each row hundreds of times."""
    from doubtline.operators.knn import copies_of, tiling

    groups, slices = tiling(600_000, 600_000, 64, 400, 12, slice_rows=500)
    assert groups <= 16 and slices <= 8 and copies_of(600_000, 400) <= 16
    assert tiling(2000, 2000, 64, 400, 4, slice_rows=500) == (5, 4)


def test_hashing_finds_what_shares_a_bucket(spark, monkeypatch):
    """All pairs of a bucket within the radius, also where a bucket is met in pieces; copies beyond k don't multiply."""
    from pyspark.sql import functions as F

    from doubtline.operators import knn

    rng = np.random.default_rng(6)
    # far from zero, where the buckets begin
    x = np.concatenate([rng.normal(size=(150, 5)), np.zeros((60, 5))]) + 1000.0
    df = vectors(spark, x)
    want = {(q, n, i) for q, n, i in brute(x, x, 5)}
    monkeypatch.setattr(knn, "QUERY_ROWS", 20)
    # one bucket holds all rows
    near = lsh_neighbours(df, df, 5, radius=1e6, bucket_length=1e6, tables=2)
    assert {(r.row_id, r.rank, r.ref_id) for r in near.collect()} == want
    assert near.groupBy("row_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] == 5
    close = lsh_neighbours(df, df, 5, radius=1.0, bucket_length=1e6, tables=2).collect()
    gap = {(i, j): np.sqrt(((x[i] - x[j]) ** 2).sum()) for i in range(len(x)) for j in range(len(x))}
    assert {(r.row_id, r.rank, r.ref_id) for r in close} == {t for t in want if gap[t[0], t[2]] < 1.0}


def test_a_group_holds_its_lists_within_the_bytes(spark):
    from pyspark.sql import functions as F

    from doubtline.operators.knn import GROUP_BYTES, held_numbers, tiling

    ref = vectors(spark, np.zeros((3, 64))).withColumn("prob", F.array(F.lit(0.5), F.lit(0.5)).alias("prob", metadata={"width": 2}))
    assert held_numbers(ref, 64, 9, "features", []) == 64 + 9 * 3
    held = held_numbers(ref, 64, 9, "features", ["features", "prob"])
    assert held == 64 + 9 * (3 + 64 + 2)
    groups, _ = tiling(600_000, 600_000, held, 50_000, 12)
    assert 600_000 / groups * held * 8 <= GROUP_BYTES


@pytest.mark.parametrize("width", (1, 2, 5))
def test_leaves_give_the_same_neighbours(width, monkeypatch):
    from doubtline.operators import knn

    rng = np.random.default_rng(width)
    ref = rng.normal(size=(3000, width)) * 100
    ref[500:900] = ref[:400]  # copies
    ref[1000:1500] = ref[1000:1500].round(-1)  # ties
    query, ids = np.concatenate([ref[:1200], rng.normal(size=(300, width)) * 300]), np.arange(3000) % 2000
    own = np.arange(1500)
    options = [{}, {"q_ids": own}, {"bound": np.full(1500, 40.0)}, {"leaves": knn.Leaves(ref)}]
    for k in (1, 7, 400):
        for given in options:
            found = knn.nearest(query, ref, ids, k, **given)
            with monkeypatch.context() as m:
                m.setattr(knn, "LEAF_PAIRS", 1 << 60)
                want = knn.nearest(query, ref, ids, k, **given)
            within = [d <= 40.0 if "bound" in given else np.full(len(d), True) for d in (found[2], want[2])]
            assert all(np.array_equal(ids[a[within[0]]] if i == 1 else a[within[0]], ids[b[within[1]]] if i == 1 else b[within[1]]) for i, (a, b) in enumerate(zip(found, want, strict=True)))


def test_leaves_look_at_few_pairs(monkeypatch):
    """A table of short vectors isn't met pair by pair."""
    from doubtline.operators import knn

    seen, square = [], knn._square
    monkeypatch.setattr(knn, "_square", lambda x, r: seen.append(len(x) * len(r)) or square(x, r))
    x = np.random.default_rng(0).normal(size=(20_000, 2))
    assert len(knn.nearest(x, x, np.arange(20_000), 5)[0]) == 100_000
    assert sum(seen) < 20_000 * 20_000 / 10


@pytest.mark.parametrize("kind", ["spread", "far", "copies"])
def test_blocks_of_long_vectors_give_the_same_neighbours(kind, monkeypatch):
    from doubtline.operators import knn

    rng = np.random.default_rng(21)
    ref = rng.normal(size=(2600, 16)) + (1000.0 if kind == "far" else 0.0)
    if kind == "copies":
        ref[300:1500] = ref[0]
        ref[1500] = 1e9
    query, ids, own = ref[:500], rng.permutation(2600) % 2500, rng.permutation(2500)[:500]
    calls, blocks = [], knn._nearest_by_blocks
    monkeypatch.setattr(knn, "_nearest_by_blocks", lambda *a: calls.append(1) or blocks(*a))
    for given in ({}, {"q_ids": own}, {"bound": np.full(500, 5.0)}):
        found = knn.nearest(query, ref, ids, 7, **given)
        with monkeypatch.context() as m:
            m.setattr(knn, "WIDE_PAIRS", 1 << 60)
            want = knn.nearest(query, ref, ids, 7, **given)
        within = [d <= 5.0 if "bound" in given else np.full(len(d), True) for d in (found[2], want[2])]
        assert all(np.array_equal(a[within[0]], b[within[1]]) for a, b in zip((found[0], ids[found[1]], found[2]), (want[0], ids[want[1]], want[2])))
    assert len(calls) == 3


def test_a_pair_of_several_common_buckets_is_met_once():
    from doubtline.operators.knn import first_met

    rng = np.random.default_rng(22)
    q, r = rng.integers(0, 2, (3000, 5)).astype(float), rng.integers(0, 2, (40, 5)).astype(float)
    seen = np.zeros((3000, 40), int)
    for table in range(5):
        for bucket in (0.0, 1.0):
            mine, other = np.flatnonzero(q[:, table] == bucket), np.flatnonzero(r[:, table] == bucket)
            for a, b in first_met(q[mine, :table], r[other, :table]):
                seen[np.ix_(mine[a], other[b])] += 1
    assert np.array_equal(seen, (q[:, None] == r[None]).any(axis=2))
    # a query of its own buckets: all rows, as before
    ((a, b),) = first_met(np.arange(100.0)[:, None], np.zeros((4, 1)))
    assert len(a) == 100 and len(b) == 4


@pytest.mark.parametrize("form", ["pivots", "tiles", "slices"])
def test_a_query_table_that_is_long_work_is_read_once(spark, form):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def slow(i):
        seen.add(1)
        return i

    x = np.random.default_rng(23).normal(size=(200, 3))
    x[150:] = x[0]
    slim = vectors(spark, x)
    query = slim.withColumn("more", slow.asNondeterministic()("row_id"))
    found = knn_join(query, slim, 4, asked=slim, **FORMS[form])
    assert found.columns == [*query.columns, "nn"]
    assert pairs(found.filter("more >= 0")) == brute(x, x, 4)
    assert seen.value == 200


def test_the_reference_of_votes_is_collected_once(spark, monkeypatch):
    from doubtline.operators import knn
    from doubtline.operators.models import make_model

    rng = np.random.default_rng(24)
    x = rng.normal(size=(60, 2))
    df = vectors(spark, x, rng.integers(0, 2, 60))
    calls, collected = [], knn._collected
    monkeypatch.setattr(knn, "_collected", lambda *a: calls.append(1) or collected(*a))
    model = make_model("KNN", k=3).fit(df)
    first, second = (model.transform(t).select("row_id", "prob").collect() for t in (df, df.repartition(3)))
    assert sorted(first) == sorted(second) and len(calls) == 1
