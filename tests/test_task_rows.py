"""Work of a task on tables of few input splits."""

from doubtline.queries import data as D


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    rows = spark.range(1000).repartition(1)
    cores = spark.sparkContext.defaultParallelism
    assert D.over_cores(rows).rdd.getNumPartitions() == cores
    monkeypatch.setattr(D, "TASK_ROWS", 10)
    dealt = D.over_cores(rows)
    assert dealt.rdd.getNumPartitions() == max(cores, 100)
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
