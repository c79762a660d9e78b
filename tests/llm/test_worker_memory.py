"""Python workers hand free memory back when a task ends."""

import pyarrow as pa
import pytest

from doubtline.llm import common, substrings


class Tasks:
    """Stands for a table: its operators run in this process."""

    def mapInArrow(self, run, schema):
        return run

    def repartition(self, *columns):
        return self

    def sortWithinPartitions(self, *columns):
        return self


@pytest.fixture
def left(monkeypatch):
    """Arrow bytes in use each time memory is given back."""
    found = []
    monkeypatch.setattr(common, "release_memory", lambda: found.append(pa.total_allocated_bytes()))
    monkeypatch.setattr(substrings, "release_memory", lambda: found.append(pa.total_allocated_bytes()))
    return found


def big(schema, n, make):
    for _ in range(3):
        yield pa.RecordBatch.from_arrays([pa.array(make(f.name, n), f.type) for f in schema], schema=schema)


def test_batches_are_gone_when_memory_is_given_back(left):
    schema = pa.schema([("text", pa.string())])
    before = pa.total_allocated_bytes()
    run = common.map_batches(Tasks(), lambda batch: batch, "text string")
    rows = sum(out.num_rows for out in run(big(schema, 10_000, lambda name, n: ["x" * 500] * n)))
    assert rows == 30_000 and len(left) == 1 and left[0] - before < 6_000_000  # the reader still holds the last slice


def test_pieces_are_gone_when_memory_is_given_back(left):
    values = {"slot": range, "key": lambda n: [0] * n, "did": range, "tid": range, "start": lambda n: [0] * n, "n": lambda n: [1] * n, "c": lambda n: [1] * n, "piece": lambda n: [b"y" * 220] * n}
    before = pa.total_allocated_bytes()
    run = substrings._refined(Tasks(), 200, 1 << 20)
    for _ in run(big(substrings.PIECE_SCHEMA, 10_000, lambda name, n: list(values[name](n)))):
        pass
    assert len(left) == 1 and left[0] - before < 1_000_000


def test_memory_is_given_back():
    common.release_memory()
