"""Sharding by a weighted hash tree: each document descends region, rack and shard by weighted draws."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a shard that one task numbers.
SLOT_ROWS = 50_000
DIGITS = 13  # hexadecimal digits of a draw: 52 bits


@dataclass(frozen=True)
class Leaf:
    """One shard, its place in the tree, and its weight; the weight of a rack or region is that of all shards below it."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, base: int = 24, racks: int = 6, regions: int = 2) -> list[Leaf]:
    """The usual tree: ``base`` shards spread over the racks of the regions; each further shard opens a region of its own.

    A shard that joined a full rack would raise the weight of that rack and its region, and documents would come from
    outside to the old shards of that rack, too. As a region of its own it changes no other subtree, so documents move only
    into it.
    """
    if shards < base:
        raise ValueError(f"the tree starts with {base} shards")
    grid = [Leaf(f"r{i * regions // base}", f"k{i * racks // base}", i) for i in range(base)]
    return grid + [Leaf(f"r+{i}", "k0", i) for i in range(base, shards)]


def _number(text: Column) -> Column:
    """A number from 0 to 16**13 - 1 that the text decides, by MD5."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _children(leaves: list[Leaf], depth: int) -> dict[str, list[tuple[str, float]]]:
    """Node to its children and their weights, at one level: the root's regions, a region's racks, a rack's shards."""
    found: dict[str, dict[str, list[float]]] = {}
    for x in leaves:
        path = ["", x.region, f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}"]
        found.setdefault(path[depth], {}).setdefault(path[depth + 1], []).append(x.weight)
    return {node: [(child, math.fsum(w)) for child, w in below.items()] for node, below in found.items()}


def _descend(key: Column, node: Column, below: dict[str, list[tuple[str, float]]]) -> Column:
    """The child of a node that wins the row's draw.

    Each child draws -ln(u) / weight, u from the key and the child's name; the least wins, with probability in proportion to
    the weight. A child's draw depends on no other child, so where weights change rows move only from or to that child.
    """
    lists = [(F.lit(n), F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in below[n]])) for n in below]
    unit = lambda c: (_number(F.concat_ws("|", key, c["child"])) + 0.5) / float(16**DIGITS)
    draws = F.transform(F.create_map(*[x for pair in lists for x in pair])[node], lambda c: F.struct((-F.log(unit(c)) / c["weight"]).alias("draw"), c["child"].alias("child")))
    return F.array_min(draws)["child"]


def with_shard(rows: DataFrame, leaves: list[Leaf], key: Column, name: str) -> DataFrame:
    """``rows`` with the shard of each key: the draw at the root picks a region, the next a rack in it, the last a shard."""
    if not leaves or any(not x.weight > 0 for x in leaves):
        raise ValueError("a tree needs shards of positive weight")
    out = rows.withColumn("__key", key).withColumn("__node", F.lit(""))
    for depth in range(3):
        out = out.withColumn("__node", _descend(F.col("__key"), F.col("__node"), _children(leaves, depth)))
    return out.withColumn(name, F.substring_index("__node", "/", -1).cast("int")).drop("__key", "__node")


def assign_shards(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """``docs`` with ``shard`` and, if a grown tree is given, ``grown_shard``: a projection, no shuffle.

    ``doc_id`` and the tree decide alone. All null ids go the way of one key; equal ids stay together.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    out = with_shard(docs, leaves, key, "shard")
    return with_shard(out, grown, key, "grown_shard") if grown else out


def with_slots(rows: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``rows`` with ``slot``: numbers from 0 without gaps in each shard, in an order that the values of a row decide.

    Equal rows are counted together first. Each shard is then cut into ranges by a hash of the row, as many as the table
    asks for, so that a task numbers about ``slot_rows`` rows however large a shard is; a range's first slot is the sum of
    the ranges before it, a few bytes for each range. Counted rows are written out again in blocks of ``slot_rows``.
    """
    names = rows.columns
    ranges = max(1, math.ceil(rows.count() / slot_rows))
    spread = F.pmod(_number(F.concat_ws("|", F.lit("slot"), *[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names])), F.lit(ranges)).cast("int")
    distinct = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).withColumn("__range", spread)
    earlier = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = distinct.groupBy("shard", "__range").agg(F.sum("__n").alias("__sum"))
    firsts = firsts.select("shard", "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "__range").orderBy(*[n for n in names if n != "shard"]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = distinct.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(firsts, ["shard", "__range"])
    start = F.col("__first") + F.col("__before")
    blocks = numbered.select(*names, "__n", start.alias("__start"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / slot_rows))).alias("__block"))
    first = F.col("__block") * slot_rows
    last = F.least(first + slot_rows, F.col("__n")) - 1
    return blocks.select(*names, "__start", F.explode(F.sequence(first, last)).alias("__own")).select(*names, (F.col("__start") + F.col("__own")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row for each row of ``docs``.

    The law is ``key``: ``doc_id`` and the number of shards decide, and one more shard takes rows only into itself. ``size``
    is the UTF-8 length of the text plus 8; a null text has 0 bytes and the check sum of no bytes. Null ids share a shard.
    Repeated rows share a shard and have slots of their own. Further columns are ignored. DataFrame functions only; the text
    itself isn't shuffled.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = with_slots(assign_shards(slim, tree(shards), tree(shards + 1)), slot_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The same in SQL, but for the parts that follow from the tree.
SQL = """
WITH RECURSIVE table_of(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) AS t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_of WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM table_of WHERE k = 8),
nodes(tree, parent, child, weight) AS (VALUES {nodes}),
sized AS (
  SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
docs AS (
  SELECT r, doc_id, size, coalesce(doc_id::VARCHAR, 'null') AS key,
         xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM sized, crc_table),
level1 AS (SELECT key, tree, arg_min(child, (draw, child)) AS node FROM ({draw1}) GROUP BY key, tree),
level2 AS (SELECT key, tree, arg_min(child, (draw, child)) AS node FROM ({draw2}) GROUP BY key, tree),
level3 AS (SELECT key, tree, split_part(arg_min(child, (draw, child)), '/', 3)::INT AS shard FROM ({draw3}) GROUP BY key, tree),
placed AS (
  SELECT d.*, a.shard, b.shard AS grown_shard,
         ('0x' || substr(md5(concat_ws('|', 'slot', d.key, size, text_crc32, a.shard, b.shard)), 1, {digits}))::BIGINT
           % greatest(1, ceil((SELECT count(*) FROM documents) / {slot_rows}.0)::BIGINT) AS part
  FROM docs d JOIN level3 a ON a.key = d.key AND a.tree = 0 JOIN level3 b ON b.key = d.key AND b.tree = 1)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, size, text_crc32, grown_shard) - 1 AS slot, grown_shard
FROM placed
"""


def shards_sql(shards: int = 24, slot_rows: int = SLOT_ROWS) -> str:
    nodes = []
    for which, leaves in enumerate((tree(shards), tree(shards + 1))):
        for depth in range(3):
            nodes += [f"({which}, '{n}', '{c}', {w}::DOUBLE)" for n, below in _children(leaves, depth).items() for c, w in below]
    draw = f"SELECT s.key, n.tree, n.child, -ln((('0x' || substr(md5(s.key || '|' || n.child), 1, {DIGITS}))::BIGINT + 0.5::DOUBLE) / {16**DIGITS}::DOUBLE) / n.weight AS draw FROM {{}}"
    return SQL.format(
        nodes=", ".join(nodes),
        draw1=draw.format("(SELECT DISTINCT key FROM docs) s JOIN nodes n ON n.parent = ''"),
        draw2=draw.format("level1 s JOIN nodes n ON n.parent = s.node AND n.tree = s.tree"),
        draw3=draw.format("level2 s JOIN nodes n ON n.parent = s.node AND n.tree = s.tree"),
        digits=DIGITS,
        slot_rows=slot_rows,
    )
