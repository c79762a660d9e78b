"""Mixing sources to target weights: blocks of equal tokens go to sources, then to shards, by Sainte-Laguë's quotients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doubtline.session import materialize

WEIGHTS = (3, 1, 2)
#: All targets together as a share of all sizes, and the most a source is repeated.
SHARE, REPEATS = 1.5, 2
#: Words of a block, words of a shard (about), and copies of one row that stay together.
BLOCK_WORDS, SHARD_WORDS, COPIES = 32, 1 << 22, 1024
#: Steps from block to block of a shard; the second where the first divides the number of blocks.
STEPS = (1_000_003, 1_000_033)
DIGITS = 13
WORD = r"[^\x20\x09-\x0D]+"


def _draw(seed: str, *values: Column) -> Column:
    """A number from 0 to 16**13 - 1 that the seed and the values decide, by MD5."""
    named = [F.coalesce(v.cast("string"), F.lit("null")) for v in values]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *named)), 1, DIGITS), 16, 10).cast("long")


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows``, one for each value of ``by``, with their number from 0 in its order, nulls last: ranges are numbered in parallel."""
    ranged = materialize(rows.repartitionByRange(F.col(by).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    firsts = firsts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col(by).asc_nulls_last())) - 1
    return ranged.withColumn("own", within).join(firsts, "part").withColumn(name, F.col("first") + F.col("own")).drop("part", "own", "first")


def targets(sources: DataFrame, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """``sources`` (``weight, source_size``) with ``target``: ``share`` of all sizes dealt by weight.

    A target stops at ``repeats`` times its source's size; the excess is dealt again to the others by weight until none is
    above. Each round is one sum over the sources and raises the level of the open ones, so it ends.
    """
    cap = F.col("source_size") * float(repeats)
    words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    whole = share * float(words or 0)
    level, stopped = whole / weights if weights else 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        n, held, weight = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == stopped or not weight:
            break
        level, stopped = (whole - (held or 0.0)) / weight, n
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level) >= cap, cap).otherwise(F.col("weight") * F.lit(level)).cast("double"))


def apportion(units: DataFrame, group: str, key: str, weight: str, most: str, seats: str, name: str) -> DataFrame:
    """``units`` with ``name``: how many of its group's seats a unit gets by Sainte-Laguë's method, never above ``most``.

    Seat k of a unit has the quotient weight / (2k - 1); the seats of a group go to its highest quotients, ties to the least
    ``key``. The divisor that ends the award lies between two that half a seat for each unit away from the exact shares
    gives, so the seats below both are sure and only some two quotients a unit, on average, are ranked. Units that come out
    above ``most`` keep that, and the others share the rest again, until none is above.
    """
    rows = units.withColumn("fixed", F.lit(None).cast("long"))
    while True:
        free = F.col("fixed").isNull()
        sums = rows.groupBy(group).agg(
            F.sum(F.when(free, F.col(weight))).alias("all_weight"),
            F.sum(F.when(free, 1)).alias("open_units"),
            (F.least(F.first(seats), F.sum(most)) - F.coalesce(F.sum("fixed"), F.lit(0))).alias("rest"),
        )
        part = F.when(F.col("all_weight") > 0, F.col(weight) / F.col("all_weight")).otherwise(0.0)
        half = F.col("open_units") / 2
        bounded = rows.join(sums, group).withColumn("sure", F.when(free, F.greatest(F.lit(0), F.floor(part * (F.col("rest") - half) + 0.5) - 1)).otherwise(0))
        bounded = bounded.withColumn("possible", F.when(free & (F.col(weight) > 0), F.floor(part * (F.col("rest") + half) + 0.5) + 1).otherwise(0))
        offers = bounded.filter("possible > sure").select(group, key, F.col(weight).alias("w"), "rest", F.explode(F.sequence(F.col("sure") + 1, F.col("possible"))).alias("seat"))
        order = Window.partitionBy(group).orderBy((F.col("w") / (2 * F.col("seat") - 1)).desc(), F.col(key))
        sure = bounded.groupBy(group).agg(F.sum("sure").alias("all_sure"))
        won = offers.withColumn("place", F.row_number().over(order)).join(sure, group).filter(F.col("place") <= F.col("rest") - F.col("all_sure"))
        won = won.groupBy(group, key).agg(F.count(F.lit(1)).alias("won"))
        given = F.coalesce("fixed", F.col("sure") + F.coalesce("won", F.lit(0))).cast("long")
        done = materialize(bounded.join(won, [group, key], "left").select(*units.columns, "fixed", given.alias(name)), "seats")
        if not done.filter(F.col(name) > F.col(most)).limit(1).count():
            return done.drop("fixed")
        rows = done.withColumn("fixed", F.when(F.col(name) > F.col(most), F.col(most)).otherwise(F.col("fixed"))).drop(name)


def _words_taken(first: Column, size: Column) -> Column:
    """Words that the chosen blocks of a shard take from the range of words ``[first, first + size)``.

    Block k of ``blocks`` starts at word k * words div blocks. Each block is taken ``quota`` div ``blocks`` times, and
    ``quota`` mod ``blocks`` of them once more: those that a seeded permutation of the blocks puts first.
    """
    words, blocks, quota = F.col("shard_words"), F.col("blocks"), F.col("quota")
    block_of = lambda word: _div((word + 1) * blocks - 1, words)
    once_more = quota % blocks
    chosen = lambda k: (k * F.col("step") + F.col("offset")) % blocks < once_more
    overlap = lambda k: F.least(first + size, _div((k + 1) * words, blocks)) - F.greatest(first, _div(k * words, blocks))
    some = F.aggregate(F.sequence(block_of(first), block_of(first + size - 1)), F.lit(0).cast("long"), lambda total, k: total + F.when(chosen(k), overlap(k)).otherwise(F.lit(0).cast("long")))
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(size * _div(quota, blocks) + F.when(once_more > 0, some).otherwise(F.lit(0).cast("long")))


def _div(a: Column, b: Column) -> Column:
    """Whole division of non-negative longs."""
    return ((a - a % b) / b).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: str = "mix",
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    copies: int = COPIES,
) -> DataFrame:
    """``doc_id, source, shard, size, source_size, target, taken``, one row for each row of ``docs`` (``doc_id, text, source``).

    ``size`` counts the words of the whole text. Sources in code-point order, null last, weigh ``weights``, repeating, and
    share ``share`` of all sizes. A source is cut into shards by a hash of its rows and a shard into blocks of equally many
    words. Blocks are allocated to sources, and a source's blocks to its shards, by the highest quotients; in a shard a
    seeded permutation chooses blocks. ``taken`` is what the chosen blocks take of a row's words: at most ``repeats`` times
    its size, and over a source its target within about one block.

    A null or empty text has size 0 and gives nothing. Null ids are ids like any other. Equal rows (id, source, size) are
    counted together before anything is moved and spread over the shards ``copies`` at a time, so neither a hot source nor
    a hot row ends in one task. Values alone decide, so reruns agree. Further columns are ignored. The text isn't shuffled.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = materialize(slim.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "mix_rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    order = numbered(sizes, "source", "source_no")
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = materialize(targets(materialize(order.withColumn("weight", cycle), "mix_sources"), share, repeats), "mix_targets")

    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("doc_id", rows["source"], "size", "copies", "source_no", "source_size", "target", shards.alias("shards"))
    bundles = F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("copies") - 1, F.lit(copies))))
    placed = placed.withColumn("bundle", bundles).withColumn("copies", F.least(F.lit(copies).cast("long"), F.col("copies") - F.col("bundle") * copies))
    placed = placed.withColumn("draw", _draw(seed, F.col("source_no"), F.col("doc_id"), F.col("size"), F.col("bundle"))).withColumn("shard", F.col("draw") % F.col("shards"))
    placed = placed.drop("shards")

    held = placed.groupBy("source_no", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_words"))
    held = materialize(held.withColumn("blocks", F.ceil(F.col("shard_words") / block_words)), "mix_shards")
    # a source's blocks are as long as its own words divided by their number
    own = held.groupBy("source_no").agg(F.sum("blocks").alias("source_blocks"))
    wanted = sources.join(own, "source_no").select(
        "source_no", F.lit(0).alias("all"), (repeats * F.col("source_blocks")).alias("most"),
        F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(0.0).alias("wanted"),
    )
    wanted = materialize(wanted, "mix_wanted")
    seats = wanted.agg(F.floor(F.sum("wanted") + 0.5)).first()[0] or 0
    quotas = apportion(wanted.withColumn("seats", F.lit(seats).cast("long")), "all", "source_no", "wanted", "most", "seats", "source_quota")
    units = held.join(quotas.select("source_no", "source_quota"), "source_no").withColumn("most", repeats * F.col("blocks"))
    units = apportion(units, "source_no", "shard", "blocks", "most", "source_quota", "quota").drop("most", "source_quota")
    step = F.when(F.col("blocks") % STEPS[0] != 0, STEPS[0]).otherwise(STEPS[1]).cast("long")
    offset = F.when(F.col("blocks") > 0, _draw(seed, F.col("source_no"), F.col("shard")) % F.col("blocks"))
    units = units.withColumn("step", step).withColumn("offset", offset)

    before = Window.partitionBy("source_no", "shard").orderBy("draw", "doc_id", "size", "bundle").rowsBetween(Window.unboundedPreceding, -1)
    ranged = placed.withColumn("first", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0))).join(units, ["source_no", "shard"])
    each = ranged.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    taken = _words_taken(F.col("first") + F.col("copy") * F.col("size"), F.col("size"))
    return each.select("doc_id", "source", "shard", "size", "source_size", "target", taken.alias("taken"))


#: The same in SQL: every seat's quotient is made and ranked, every block's overlap with every row is added up.
SQL = r"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{word}')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS source_no FROM sizes),
weighed AS (SELECT *, ([{weights}])[(source_no % {cycle} + 1)::INT] AS weight, {repeats} * source_size AS cap FROM numbered),
-- the sources whose cap is reached first are the first to stop: find how many do
stopping AS (
  SELECT *, row_number() OVER o AS k, sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM weighed WINDOW o AS (ORDER BY cap / weight::DOUBLE, source_no)),
level AS (
  SELECT arg_min(({share}::DOUBLE * (SELECT sum(source_size) FROM sizes) - coalesce(held, 0)) / left_weight, k) AS level
  FROM stopping WHERE ({share}::DOUBLE * (SELECT sum(source_size) FROM sizes) - coalesce(held, 0)) / left_weight < cap / weight::DOUBLE),
sources AS (
  SELECT source, source_no, source_size, greatest(1, ceil(source_size / {shard_words}.0))::BIGINT AS shards,
         least(cap::DOUBLE, coalesce(weight * (SELECT level FROM level), cap::DOUBLE)) AS target
  FROM weighed),
copied AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM slim),
drawn AS (
  SELECT c.*, s.* EXCLUDE (source), copy // {copies} AS bundle,
         ('0x' || substr(md5(concat_ws('|', '{seed}', source_no::VARCHAR, coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR, (copy // {copies})::VARCHAR)), 1, {digits}))::BIGINT AS draw
  FROM copied c JOIN sources s ON c.source IS NOT DISTINCT FROM s.source),
placed AS (
  SELECT *, draw % shards AS shard,
         coalesce(sum(size) OVER (PARTITION BY source_no, draw % shards ORDER BY draw, doc_id NULLS FIRST, size, bundle, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM drawn),
held AS (SELECT source_no, shard, sum(size)::BIGINT AS words, ceil(sum(size) / {block_words}.0)::BIGINT AS blocks FROM placed GROUP BY ALL),
own AS (SELECT source_no, sum(blocks)::BIGINT AS source_blocks FROM held GROUP BY source_no),
wanted AS (
  SELECT source_no, source_blocks, CASE WHEN source_size > 0 THEN target * source_blocks / source_size ELSE 0 END AS wanted
  FROM sources JOIN own USING (source_no)),
source_seats AS (
  SELECT source_no, row_number() OVER (ORDER BY wanted / (2 * k - 1) DESC, source_no) AS place
  FROM (SELECT *, unnest(range(1, {repeats} * source_blocks + 1)) AS k FROM wanted WHERE wanted > 0)),
source_quota AS (
  SELECT source_no, count(*) AS source_quota FROM source_seats WHERE place <= (SELECT floor(sum(wanted) + 0.5) FROM wanted) GROUP BY source_no),
shard_seats AS (
  SELECT source_no, shard, source_quota, row_number() OVER (PARTITION BY source_no ORDER BY blocks / (2 * k - 1)::DOUBLE DESC, shard) AS place
  FROM (SELECT *, unnest(range(1, {repeats} * blocks + 1)) AS k FROM held JOIN source_quota USING (source_no))),
quota AS (SELECT source_no, shard, count(*) AS quota FROM shard_seats WHERE place <= source_quota GROUP BY ALL),
blocked AS (
  SELECT source_no, shard, k, k * words // blocks AS block_start, (k + 1) * words // blocks AS block_end,
         quota // blocks + CASE WHEN (k * step + "offset") % blocks < quota % blocks THEN 1 ELSE 0 END AS times
  FROM (SELECT held.*, coalesce(quota, 0) AS quota, CASE WHEN blocks % {step} <> 0 THEN {step} ELSE {other} END AS step,
               ('0x' || substr(md5(concat_ws('|', '{seed}', source_no::VARCHAR, shard::VARCHAR)), 1, {digits}))::BIGINT % blocks AS "offset",
               unnest(range(0, blocks)) AS k
        FROM held LEFT JOIN quota USING (source_no, shard) WHERE blocks > 0)),
took AS (
  SELECT p.source_no, p.shard, p.start, p.doc_id, p.size, p.bundle, p.copy, sum(times * (least(p.start + p.size, block_end) - greatest(p.start, block_start)))::BIGINT AS taken
  FROM placed p JOIN blocked b ON p.source_no = b.source_no AND p.shard = b.shard AND block_start < p.start + p.size AND block_end > p.start
  WHERE p.size > 0 GROUP BY ALL)
SELECT p.doc_id, p.source, p.shard, p.size, p.source_size, p.target, coalesce(t.taken, 0) AS taken
FROM placed p LEFT JOIN took t ON p.source_no = t.source_no AND p.shard = t.shard AND p.start = t.start AND p.size = t.size
  AND p.doc_id IS NOT DISTINCT FROM t.doc_id AND p.bundle = t.bundle AND p.copy = t.copy
"""


def mix_sql(block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, copies: int = COPIES) -> str:
    return SQL.format(
        word=WORD, weights=", ".join(map(str, WEIGHTS)), cycle=len(WEIGHTS), repeats=REPEATS, share=SHARE, shard_words=shard_words, copies=copies,
        seed="mix", digits=DIGITS, block_words=block_words, step=STEPS[0], other=STEPS[1],
    )
