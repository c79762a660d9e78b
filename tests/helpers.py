import numpy as np

from doubtline.functions.vectors import with_width


def vectors(spark, x, label=None, start=0):
    """Rows ``row_id, features[, label]`` from a matrix."""
    x = np.asarray(x, float)
    if label is None:
        rows = [(start + i, r.tolist()) for i, r in enumerate(x)]
        df = spark.createDataFrame(rows, "row_id bigint, features array<double>")
    else:
        rows = [(start + i, r.tolist(), int(y)) for i, (r, y) in enumerate(zip(x, label))]
        df = spark.createDataFrame(rows, "row_id bigint, features array<double>, label int")
    return with_width(df, "features", x.shape[1])


def blobs(rng, n, centers, spread=1.0):
    label = rng.integers(0, len(centers), n)
    return np.asarray(centers, float)[label] + spread * rng.standard_normal((n, len(centers[0]))), label
