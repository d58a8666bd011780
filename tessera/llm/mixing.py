"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed by source, shares of the total follow the weights, and no
source may exceed ``cap`` times its own size: what a capped source can't take is
shared again by weight. Each document is then taken floor(rate) times, and once
more if a hash of its doc_id, text and source falls below the fraction of its
source's rate. Rows that are equal in all three draw as one: n of them are taken
floor(n * rate) times and perhaps once more, spread over the rows; so it makes no
difference for the mix whether ids tell rows apart.

Defined cases: a null text has size 0 and draws as an empty one; a null source is a
source of its own, last in the order; a null doc_id draws as the text 'null'; of rows
that are equal in doc_id, text and source, any may be those that are taken once more
(their number is settled, on every layout of the table); a source of size 0 has
target 0 and gives nothing; further columns are ignored; an empty table gives an
empty result.

Sources are ordered in one task, a row for each; up to ``BROADCAST_SOURCES`` are
broadcast, more of them meet the rows in a join that splits hot sources. Likewise up to
``BROADCAST_GROUPS`` groups of equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.skew import join_unique, left_join_unique
from tessera.plans.storage import materialise

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
BROADCAST_SOURCES, BROADCAST_GROUPS = 10_000, 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def _size():
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def _drawn_by(seed: str):
    """What a row draws by, in hexadecimal: equal for rows with the same doc_id, text and source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(seed + ":"), null("doc_id"), F.lit(":"), F.md5(text), F.lit(":"), null("source")))


def sizes(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size (words of the text) and what the row draws by, written so that texts are read once."""
    return materialise(documents.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), _drawn_by(seed).alias("drawn_by")), "sizes")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target and rate for each source.

    The targets are min(cap * size, level * weight) with the level at which they
    sum to the total. With sources in the order of cap * size / weight, every
    (total - caps before) / (weights from here on) is at most that level, and one
    of them is the level: their maximum. So a running sum over the one row of each
    source replaces repeated sharing.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward)
    return (
        by_source.withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least((F.col("source_size") * cap).cast("double"), F.col("level") * F.col("weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select(F.col("source").alias("mix_source"), "source_size", "target", "rate")
    )


def draw(drawn_by):
    """A number in [0, 1): 48 bits of what the row draws by."""
    return F.conv(F.substring(drawn_by, 1, 12), 16, 10).cast("double") / float(1 << 48)


def copies(rate, drawn_by, n, place):
    """How often the row at this place (from 0) among n equal ones is taken."""
    all_ = F.floor(n * rate) + F.when(draw(drawn_by) < n * rate - F.floor(n * rate), 1).otherwise(0)
    return F.floor(rate) + F.when(place < all_ - n * F.floor(rate), 1).otherwise(0)


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with their source's row of ``targets``."""
    if targets.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(targets), rows["source"].cast("string").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return join_unique(rows.withColumn("_mix_name", named("source")), targets.withColumn("_mix_name", named("mix_source")).drop("mix_source"), "_mix_name", "source_size").drop("_mix_name")


def _with_places(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """``rows`` (drawn_by) with _n, how many rows are equal to each, and its _place among them.

    Equal rows are numbered within the partitions of a written table, each from what the
    partitions before it hold; so a group may fill many tasks.
    """
    groups = materialise(sized.groupBy("drawn_by").agg(F.count("*").alias("_n")).filter("_n > 1"), "groups")
    many = groups.count()
    if not many:
        return rows.withColumns({"_n": F.lit(1).cast("long"), "_place": F.lit(0).cast("long")})
    counted = rows.join(F.broadcast(groups), "drawn_by", "left") if many <= BROADCAST_GROUPS else left_join_unique(rows, groups, "drawn_by", "_n", sized.count())
    once = counted.filter("_n is null").withColumns({"_n": F.lit(1).cast("long"), "_place": F.lit(0).cast("long")})
    again = materialise(counted.filter("_n is not null").withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "repeated")
    parts = again.groupBy("drawn_by", "_part").agg(F.count("*").alias("_of_part"))
    before = F.sum("_of_part").over(Window.partitionBy("drawn_by").orderBy("_part")) - F.col("_of_part")
    offsets = parts.select("drawn_by", "_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("drawn_by", "_part").orderBy("_row")) - 1
    placed = again.withColumn("_within", within).join(offsets, ["drawn_by", "_part"]).withColumn("_place", F.col("_before") + F.col("_within"))
    return once.unionByName(placed.select(*once.columns))


def _copies():
    return copies(F.col("rate"), F.col("drawn_by"), F.col("_n"), F.col("_place")).cast("long")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the source, rate and copies behind them, for every row."""
    sized = sizes(documents, seed)
    targets = materialise(source_targets(sized, weights, cap), "targets")
    taken = _with_targets(_with_places(sized, sized), targets).withColumn("copies", _copies())
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "rate", "copies")


def repeat(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``documents`` as many times as it is taken, columns unchanged."""
    sized = sizes(documents, seed)
    targets = materialise(source_targets(sized, weights, cap).select("mix_source", "rate", "source_size"), "targets")
    rows = documents.select(F.struct(*documents.columns).alias("_row_of"), "source", _drawn_by(seed).alias("drawn_by"))  # as one column, no name can clash
    taken = _with_targets(_with_places(rows, sized), targets).withColumn("copies", _copies()).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row_of.*")


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':' || coalesce(source, 'null')) AS drawn_by FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([1.0, 2.0, 3.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM by_source
), levels AS (
  SELECT *, CAST(CAST((SELECT sum(source_size) FROM by_source) AS BIGINT)
      - coalesce(CAST(sum(source_size * 3) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), (SELECT max(level) FROM levels) * weight) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
), drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, s.source, r.rate,
    CAST(CAST('0x' || substr(drawn_by, 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u,
    count(*) OVER (PARTITION BY drawn_by) AS n, row_number() OVER (PARTITION BY drawn_by) - 1 AS place
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
), counted AS (
  SELECT *, CAST(floor(rate) AS BIGINT)
    + CASE WHEN place < floor(n * rate) + CASE WHEN u < n * rate - floor(n * rate) THEN 1 ELSE 0 END - n * floor(rate) THEN 1 ELSE 0 END AS copies FROM drawn
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, rate, CAST(copies AS BIGINT) AS copies FROM counted
"""
