"""Mixing sources to target weights, in DataFrame functions only.

Targets: each source wants its weight's share of all words; none gets more than ``max_epochs`` times its own words, and
what is over is shared again by weight (one water level, found exactly on the per-source totals). Whole epochs come
first. The fraction left is drawn by Efraimidis and Spirakis: each document has the key ``-ln(u) / quality``, with u from
its id's MD5 digest, and the smallest keys go in until their words, prefix-summed, meet the budget. Of the document that
crosses it the mix takes the first words, as many as are left, so a source ends on its target.

The prefix sum never sorts a source in one task: keys fall into 16,384 cells by a monotone map under which no cell holds
more than (largest quality / smallest) / 16,384 of a source; cell totals are partial aggregates, and only the one cell
that holds the budget is sorted. Decisions are then a comparison with the source's cut, so texts never shuffle.

Edge cases: null text has 0 words; a null source is a source, after all others; a null id draws like the id ''; rows
with equal ids have equal keys and, where they cross the budget, share what is left by their sizes, rounded down; quality
null or <= 0 counts as 1; an empty table, or texts without words, give targets of 0. Columns named ``_x_*`` are not allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.bloom import marked_possible
from quarrystone.llm.common import SPACE, stored, table

CELLS = 16384
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
WORD = SPACE.replace("[", "[^") + "+"


def order() -> Column:
    """A row's place in its source's draw."""
    return F.struct(F.col("key"), F.col("id").isNull().alias("unnamed"), F.col("id"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key(id: Column, quality: Column, seed: str = SEED) -> Column:
    """Exponential key; smaller goes first."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(u) / F.when(quality > 0, quality).otherwise(F.lit(1.0)).cast("double")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, lowest, target) from (source, size, quality): one row a source, weights dealt by code point, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("quality").alias("lowest"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("ratio", F.lit(max_epochs).cast("double") * F.col("source_size") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumns(
        {
            "rest": F.sum("source_size").over(everything) - max_epochs * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)),
            "rest_w": F.sum("w").over(later),
            "place": F.row_number().over(by_ratio),
        }
    )
    fits = F.col("rest") * F.col("w") <= max_epochs * F.col("source_size") * F.col("rest_w")
    per = per.withColumn("level", F.min(F.when(fits, F.struct("place", "rest", "rest_w"))).over(everything))
    shared = (F.col("w") * F.col("level.rest")).cast("double") / F.col("level.rest_w")
    whole = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    target = F.when(F.col("place") < F.col("level.place"), whole).otherwise(F.least(shared, whole))
    return per.select("source", "source_size", "lowest", target.alias("target"))


def _cell(key: Column, lowest: Column) -> Column:
    return F.least(F.floor((F.lit(1.0) - F.exp(-key * lowest)) * F.lit(CELLS)), F.lit(CELLS - 1)).cast("int")


def _with_cell(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cell", _cell(F.col("key"), F.col("lowest")))


def source_cuts(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, lowest, target, epochs, cut_cell, cut, part, part_of): what a row needs to know. Rows whose order
    is ``cut`` have ``part_of`` words, of which ``part`` are taken. sizes: (id, source, size, quality, key)."""
    targets = stored(source_targets(sizes, weights, max_epochs), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("left", left)
    same = sizes["source"].eqNullSafe(targets["source"])
    celled = _with_cell(sizes.join(targets, same).select(sizes["*"], targets["lowest"], targets["left"]))
    cells = celled.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    run = Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("before", F.sum("words").over(run) - F.col("words"))
    crossed = cells.where(F.col("before") + F.col("words") > F.col("left")).groupBy("source")
    crossed = crossed.agg(F.min(F.struct("cell", "before")).alias("at")).select(
        F.col("source").alias("cut_source"), F.col("at.cell").alias("cut_cell"), F.col("at.before").alias("before")
    )
    crossed = stored(crossed, "mix-cells")
    inside = celled.join(crossed, celled["source"].eqNullSafe(crossed["cut_source"]) & (celled["cell"] == crossed["cut_cell"]))
    inside = inside.groupBy("cut_source", "left", "before", order().alias("at")).agg(F.sum("size").alias("words"))
    within = Window.partitionBy("cut_source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.sum("words").over(within) + F.col("before")).where(F.col("upto") > F.col("left"))
    first = inside.groupBy("cut_source").agg(F.min(F.struct("at", (F.col("left") - F.col("upto") + F.col("words")).alias("part"), "words")).alias("first"))
    cuts = first.select("cut_source", F.col("first.at").alias("cut"), F.col("first.part").alias("part"), F.col("first.words").alias("part_of"))
    known = targets.join(crossed, targets["source"].eqNullSafe(crossed["cut_source"]), "left").drop("cut_source", "before")
    known = known.join(cuts, known["source"].eqNullSafe(cuts["cut_source"]), "left").drop("cut_source", "left")
    return stored(known, "mix-cuts")  # one row a source: as a table of known size it is broadcast where it is small


def copies(rows: DataFrame, cuts: DataFrame, size: Column) -> DataFrame:
    """``rows`` (id, source, quality, key, ...) with source_size, target, copies (how often the mix takes the whole row) and
    part (how many words of it besides); ``size``: the row's words, asked for only at the cut."""
    known = cuts.withColumnRenamed("source", "_source")
    joined = _with_cell(rows.join(known, rows["source"].eqNullSafe(known["_source"])))
    in_cell = F.col("cell").eqNullSafe(F.col("cut_cell"))
    drawn = F.coalesce(F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell")) | (in_cell & (order() < F.col("cut"))), F.lit(False))
    drawn = drawn & (F.col("target") > F.col("epochs") * F.col("source_size"))
    n = F.col("epochs") + F.when(drawn, 1).otherwise(0)
    whole = size * F.col("part")
    part = (whole - whole % F.col("part_of")) / F.col("part_of")
    part = F.when(in_cell & (order() == F.col("cut")), part.cast("long")).otherwise(F.lit(0).cast("long"))
    return joined.withColumns({"copies": n, "part": part}).drop("_source", "lowest", "epochs", "cut_cell", "cut", "cell", "part_of")


def sized(docs: DataFrame, quality: DataFrame | None, id: str, source: str, text: str, seed: str = SEED) -> DataFrame:
    """(id, source, size, quality, key); ``quality``: (id, quality), one row an id, or None for equal quality."""
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    if quality is None:
        rows = rows.withColumn("quality", F.lit(1.0))
    else:
        rows = rows.join(quality, "id", "left").withColumn("quality", F.when(F.col("quality") > 0, F.col("quality")).otherwise(1.0))
    return rows.withColumn("key", key(F.col("id"), F.col("quality"), seed))


def label_quality(labels: DataFrame) -> DataFrame:
    """Documents labelled good weigh 2, bad 0.5, others 1."""
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"))
    return best.select("id", F.when(F.col("q") >= 1, 2.0).when(F.col("q") <= 0, 0.5).otherwise(1.0).alias("quality"))


def _with_quality(rows: DataFrame, quality: DataFrame | None, cuts: DataFrame) -> DataFrame:
    """``rows`` (id, source, ...) with a quality that decides like their own. Only rows that a filter of the rated ids may hold,
    and that the lowest and the highest quality there is would put on different sides of their source's cut (or near it),
    shuffle to meet their own; the others pass straight through."""
    if quality is None:
        return rows.withColumn("quality", F.lit(1.0))
    low, high = quality.agg(F.min(F.when(F.col("quality") > 0, F.col("quality"))), F.max(F.when(F.col("quality") > 0, F.col("quality")))).first()
    least, most = min(1.0, float(low or 1.0)), max(1.0, float(high or 1.0))
    at = cuts.select(F.col("source").alias("_source"), "lowest", "cut_cell")
    asking = marked_possible(rows, "id", quality).join(at, rows["source"].eqNullSafe(at["_source"]))
    first, last = (_cell(key(F.col("id"), F.lit(q)), F.col("lowest")) for q in (most, least))
    sure = F.col("cut_cell").isNull() | (last < F.col("cut_cell")) | (first > F.col("cut_cell"))
    asking = asking.withColumn("_x_again", F.col("_x_again") & ~sure)
    own = asking.where("_x_again").select(rows.columns).join(quality, "id", "left")
    own = own.withColumn("quality", F.when(F.col("quality") > 0, F.col("quality")).otherwise(1.0))
    return asking.where("not _x_again").select(rows.columns).withColumn("quality", F.lit(1.0)).unionByName(own)


def mix(docs: DataFrame, quality: DataFrame | None = None, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it, with all columns. What it takes of a row in
    part comes as a row of its own with the text's first words, joined by one space. Rows meet the cut of their source and,
    if given, their quality."""
    quality = None if quality is None else stored(quality, "mix-quality")
    cuts = source_cuts(stored(sized(docs, quality, id, source, text), "mix-sizes"))
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.struct("*").alias("_x_row"))
    rows = _with_quality(rows, quality, cuts)
    held = F.col("_x_row").getField(text)
    taken = copies(rows.withColumn("key", key(F.col("id"), F.col("quality"))), cuts, word_count(held))
    taken = taken.withColumn("_x_n", F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)).where("_x_n > 0")
    each = taken.select("_x_row", "copies", "part", F.explode(F.sequence(F.lit(1).cast("long"), "_x_n")).alias("_x_nth"))
    words = F.slice(F.regexp_extract_all(held, F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int"))
    cut = F.when(F.col("_x_nth") > F.col("copies"), F.array_join(words, " ")).otherwise(held)
    return each.select(*[cut.alias(c) if c == text else F.col("_x_row").getField(c).alias(c) for c in docs.columns])


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    quality = label_quality(table(spark, sf_dir, "labels"))
    sizes = stored(sized(table(spark, sf_dir, "documents"), quality, "doc_id", "source", "text"), "mix-sizes")
    rows = copies(sizes, source_cuts(sizes), F.col("size"))
    taken = F.col("copies") * F.col("size") + F.col("part")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


OP5_SQL = r"""
WITH q AS (SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 2.0 WHEN max(quality) <= 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS quality
           FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
           / coalesce(quality, 1.0::DOUBLE) AS k
  FROM documents LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER r AS place,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest_w
  FROM s WINDOW r AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST)),
l AS (SELECT place AS lp, rest AS lr, rest_w AS lw FROM o WHERE rest * w <= 3 * source_size * rest_w ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN place < lp THEN (3 * source_size)::DOUBLE
              ELSE least((w * lr)::DOUBLE / lw::DOUBLE, (3 * source_size)::DOUBLE) END AS target
  FROM o, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.*, source_size, target, epochs, floor(target - epochs * source_size + 0.5::DOUBLE)::BIGINT AS rem,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST) AS upto,
         sum(size) OVER (PARTITION BY d.source, k, doc_id) AS alike
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * epochs + CASE WHEN upto <= rem THEN size WHEN upto - alike >= rem THEN 0 ELSE (size * (rem - (upto - alike))) // alike END)::BIGINT AS taken
FROM p
"""
