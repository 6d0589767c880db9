"""Mixing sources to target weights (operator 5): a low-discrepancy schedule of equal-token blocks.

Each source's documents, shuffled by the MD5 of their id, are laid end to end and cut into blocks of ``block_tokens``
tokens; a document belongs to the block in which it begins. Slot i of the schedule takes the golden-ratio point
frac(i * 0.618...), which falls into one source's share of the cumulated weights. The r-th slot of a source holds its
r-th block, so that every stretch of the schedule has the sources in their target proportions. Points are whole
64-bit numbers (a multiplication modulo 2**64), so they stay exact for any number of slots.

With ``max_epochs`` None, as in the query and the pipeline, the schedule ends where every source has had its last block:
nothing is left out, and sources of fewer blocks than their share begin again from their first. With a number it ends
where the first source would need more than that many times its blocks; what other sources have beyond their share is
left out. By default a source weighs the square root of its tokens.

Nothing needs a source's rows in one place: documents fall into 4096 ranges of their MD5 and slots into ranges of
``SLOT_RANGE``; counts run inside a range, and the totals of ranges are cumulated. A slot finds its source by an equal
join: the cumulated weights are cut into ``4 x sources`` cells, and each source is listed in the cells that it touches.
Tokens are runs of non-blank characters.

Cases: null sources count as ``(none)``; null and empty texts are documents of no tokens and travel with the document
that follows; identical rows travel together, and a document under two sources is one of each; sources without tokens
or with a weight of 0 get no slot; an empty table gives an empty schedule. Rows are told apart by source and 128 bits of
id and text. The result has the columns below only, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_SOURCE, stored, table

BLOCK_TOKENS = 4096
#: 2**64 divided by the golden ratio.
GOLDEN = 11400714819323198485
#: Slots whose ranks are counted in one place.
SLOT_RANGE = 1 << 18
_KEY = ["row", "row2"]


def _named() -> list:
    """source, row and row2: what tells rows apart."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    return [source.alias("source"), F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text", "doc_id").alias("row2")]


def _units(docs: DataFrame) -> DataFrame:
    """One slim row for each distinct row of docs: source, doc_id, row, row2, key, n_tokens (of all copies)."""
    slim = docs.select(*_named(), "doc_id", F.expr(r"coalesce(regexp_count(text, '\\S+'), 0)").cast("long").alias("t"))
    units = slim.groupBy("source", "doc_id", *_KEY).agg(F.sum("t").alias("n_tokens"))
    return units.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


def _placed(units: DataFrame, block_tokens: int) -> DataFrame:
    """units with their block and the tokens before them in it."""
    units = units.withColumn("range", F.substring("key", 1, 3))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", *_KEY).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = units.groupBy("source", "range").agg(F.sum("n_tokens").alias("t"))
    offsets = totals.select("source", "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    running = units.withColumn("local", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    at = running.join(offsets, ["source", "range"]).withColumn("at", F.col("offset") + F.col("local"))
    return at.select("source", *_KEY, "n_tokens", F.expr(f"at div {block_tokens}L").alias("block"), F.expr(f"at % {block_tokens}L").alias("block_offset"))


def _shares(placed: DataFrame, weights: dict[str, int] | None) -> DataFrame:
    """source, blocks, and the bounds lo and hi of its share of the cumulated integer weights."""
    totals = placed.groupBy("source").agg(F.sum("n_tokens").alias("t"), (F.max("block") + 1).alias("blocks")).where("t > 0")
    weight = F.floor(F.sqrt("t"))
    if weights is not None:
        weight = F.coalesce(*(F.when(F.col("source") == k, F.lit(int(w))) for k, w in weights.items()), F.lit(0)) if weights else F.lit(0)
    weighed = totals.withColumn("weight", weight.cast("long")).where("weight > 0")
    run = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)  # a row for each source only
    return weighed.withColumn("hi", F.sum("weight").over(run)).withColumn("lo", F.col("hi") - F.col("weight"))


def schedule(placed: DataFrame, weights: dict[str, int] | None = None, max_epochs: int | None = 1) -> DataFrame:
    """slot, source, block and epoch for every slot that has a block; max_epochs None: until all blocks have had one."""
    shares = stored(_shares(placed, weights))
    total, count = shares.agg(F.coalesce(F.max("hi"), F.lit(0)), F.count("*")).first()
    need = F.expr(f"CAST(CAST(blocks AS DECIMAL(20, 0)) * {max_epochs or 1} * {total} div weight AS BIGINT)")
    least, most, light = shares.agg(F.min(need), F.max(need), F.min("weight")).first()
    width = total // (4 * count) + 1 if count else 1
    cells = shares.withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}L, (hi - 1) div {width}L)")))

    def ranked(slots: int) -> DataFrame:
        points = placed.sparkSession.range(slots).selectExpr("id AS slot", f"(CAST(id AS DECIMAL(18, 0)) * {GOLDEN}BD % {1 << 64}BD) * CAST({total} AS DECIMAL(14, 0)) div {1 << 64}BD AS u")
        own = points.withColumn("cell", F.expr(f"u div {width}L")).join(cells, "cell").where("u >= lo AND u < hi").withColumn("range", F.expr(f"slot div {SLOT_RANGE}L"))
        before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = own.groupBy("source", "range").agg(F.count("*").alias("n")).select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        inside = F.row_number().over(Window.partitionBy("source", "range").orderBy("slot"))
        return own.select("slot", "source", "range", "blocks", inside.alias("local")).join(offsets, ["source", "range"]).select("slot", "source", "blocks", (F.col("offset") + F.col("local") - 1).alias("rank"))

    slots = least or 0
    if max_epochs is None and total:
        # The points of an interval differ from its share by a few: some slots more may be needed, or some fewer.
        slots, ended = most, (0, None)
        while ended[0] < count:
            ended = ranked(slots).where("rank = blocks - 1").agg(F.count("*"), F.max("slot")).first()
            slots = ended[1] + 1 if ended[0] == count else slots + -(-total // light)
    taken = ranked(slots)
    if max_epochs is not None:
        taken = taken.where(F.col("rank") < F.col("blocks") * F.lit(max_epochs))
    return taken.select("slot", "source", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("epoch"))


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block_tokens: int = BLOCK_TOKENS, max_epochs: int | None = 1) -> DataFrame:
    """The scheduled documents: slot, block_offset (their order), doc_id, text, lang, source, block, epoch, n_tokens.

    ``weights``: integers by source; sources that aren't named get none.
    """
    placed = stored(_placed(_units(docs), block_tokens))
    chosen = placed.join(schedule(placed, weights, max_epochs), ["source", "block"])
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(*_named(), "doc_id", "text", lang.alias("lang"))
    return texts.join(chosen, ["source", *_KEY]).select("slot", "block_offset", "doc_id", "text", "lang", "source", "block", "epoch", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``documents`` as a schedule with square-root weights that leaves nothing out."""
    return mixed(table(spark, sf_dir, "documents"), max_epochs=None)


ORACLE = rf"""
WITH units AS (
  SELECT coalesce(source, '{NO_SOURCE}') AS source, doc_id, text, lang, len(regexp_extract_all(coalesce(text, ''), '\S+'))::BIGINT AS n_tokens,
    md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
placed AS (
  SELECT *, spot // {BLOCK_TOKENS} AS block, spot % {BLOCK_TOKENS} AS block_offset
  FROM (SELECT *, (sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens)::BIGINT AS spot FROM units)),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS t, max(block) + 1 AS blocks FROM placed GROUP BY source HAVING sum(n_tokens) > 0),
shares AS (
  SELECT source, blocks, floor(sqrt(t))::BIGINT AS weight, (sum(floor(sqrt(t))::BIGINT) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING))::BIGINT AS hi FROM totals),
-- Slots up to twice the largest need and some more, of which the schedule takes those to the last first use of a block.
ends AS (SELECT max(hi) AS total, (2 * max(blocks * (SELECT max(hi) FROM shares) // weight) + 20 * (max(hi) // min(weight) + 1))::BIGINT AS bound FROM shares),
points AS (
  SELECT i AS slot, ((i::HUGEINT * {GOLDEN} % 18446744073709551616::HUGEINT) * total::HUGEINT // 18446744073709551616::HUGEINT)::BIGINT AS u
  FROM (SELECT unnest(range(bound)) AS i, total FROM ends)),
ranked AS (
  SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM points JOIN shares ON u >= hi - weight AND u < hi),
last AS (SELECT max(slot) AS slot FROM ranked WHERE rank = blocks - 1),
taken AS (SELECT slot, source, rank % blocks AS block, rank // blocks AS epoch FROM ranked WHERE slot <= (SELECT slot FROM last))
SELECT slot, block_offset, doc_id, text, lang, source, block, epoch, n_tokens FROM placed JOIN taken USING (source, block)
"""
