"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document is expected e times: e is in proportion to a weight of its own within its
source, at most MOST, and such that the expected words of a source are its target (LEVELS says how weights are
counted; by default long documents weigh more than short ones). floor(e) copies are certain, and one more is drawn with
inclusion probability p = e - floor(e), so probabilities differ from document to document. Draws are ranked by
(odds of a uniform number of the document) / (odds of p), the Pareto rank, and the ranks are taken from the lowest up
to the size that is left of the target. The uniform number is a digest of the document's id, so reruns agree.

No task ranks a whole source: sizes are summed over CELLS cells of the rank (a source at a time has CELLS sums), and
only the one cell in which the target is reached is ranked row by row. By the shape of the Pareto rank that cell holds
a few of CELLS parts of a source, however large the source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WORD = "[^\\x20\\x09-\\x0D]+"
#: The weights of sources in order of their names, repeating; the share of all words to take; the most copies.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
CELLS = 4096
#: Weights of documents count in LEVELS steps to 1, up to TOP; so a source has LEVELS * TOP different ones at most.
LEVELS, TOP = 16, 16
#: The weight of a document by its words: in proportion to them from half of WORDS to twice as many.
WORDS = 200


def words_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the id: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from source, source_size: one row for each source.

    Targets are in proportion to the weights; one that would be over most times its source's size stops there, and
    the excess goes to the others by weight until none is above. That is min(most * size, level * weight) for the one
    level at which targets add up; sources in order of size / weight give the level by running sums.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    named = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    every = Window.partitionBy()
    # Sources with a smaller size for their weight reach their ceiling first; equal ones reach it together.
    full = F.col("source_size") / F.col("weight")
    below = Window.orderBy("full").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = named.withColumn("full", full).withColumns(
        {
            "sum_size": F.sum("source_size").over(every),
            "sum_weight": F.sum("weight").over(every),
            "size_below": F.sum("source_size").over(below),
            "weight_below": F.sum("weight").over(below),
        }
    )
    # The level if just the sources up to this one are at their ceiling.
    rest = F.col("sum_weight") - F.col("weight_below")
    level = F.when(rest > 0, (F.lit(share) * F.col("sum_size") - F.lit(most) * F.col("size_below")) / rest)
    next_full = F.lead("full").over(Window.orderBy("full", F.col("source").isNull(), F.col("source").cast("binary")))
    run = run.withColumn("level", level).withColumn("next_full", next_full)
    none_full = F.lit(share) * F.col("sum_size") / F.col("sum_weight")
    run = run.withColumn("none_full", none_full)
    # The first prefix whose level leaves the next source below its ceiling; before any, the level of no ceilings.
    fits = F.col("level") <= F.lit(most) * F.col("next_full")
    right = F.when(F.min(F.lit(most) * F.col("full")).over(every) >= F.col("none_full"), F.col("none_full")).otherwise(
        F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("full"))).over(every)
    )
    target = F.least(F.lit(most) * F.col("source_size").cast("double"), F.coalesce(right * F.col("weight"), F.lit(most) * F.col("source_size").cast("double")))
    return run.select("source", "source_size", target.alias("target"))


def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, weight: Column | None) -> DataFrame:
    size, text = words_of(store.col(text_col)), store.col(text_col)
    own = weight if weight is not None else F.least(F.lit(2.0), F.greatest(F.lit(0.5), size / F.lit(float(WORDS))))
    level = F.round(F.least(F.lit(float(TOP)), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(own.cast("double"), F.lit(0.0)), F.lit(0.0)))) * LEVELS)
    source = store.col(source_col).cast("string")
    return docs.select(
        store.col(id_col).alias("doc_id"), source.alias("source"), size.alias("size"), draw_of(store.col(id_col), seed).alias("u"), level.cast("long").alias("w"), F.xxhash64(text).alias("text_hash")
    )


def rates(sums: DataFrame, most: int = MOST) -> DataFrame:
    """key, rate from key, w, level_size, target (a row for each level of weight): min(most, rate * w) times sizes makes target.

    Levels in falling order reach most first; the rate is that of the first level that stays below it. Null: all are at most.
    """
    down = Window.partitionBy("key").orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("key").orderBy(F.desc("w")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    run = sums.withColumns({"full": F.coalesce(F.sum("level_size").over(down), F.lit(0)), "weighted": F.sum(F.col("w") * F.col("level_size")).over(rest)})
    rate = F.when(F.col("weighted") > 0, (F.col("target") - F.lit(most) * F.col("full")) / F.col("weighted"))
    run = run.withColumn("rate", rate).withColumn("fits", F.col("rate") * F.col("w") <= F.lit(float(most)))
    return run.groupBy("key").agg(F.min_by(F.when(F.col("fits"), F.col("rate")), F.when(F.col("fits"), -F.col("w"))).alias("rate"))


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None
) -> DataFrame:
    """id_col, source, size, source_size, target, copies and taken (copies * size) for each row of docs.

    weight: what a document's expected copies are in proportion to within its source (most at most), counted in steps of
    1 / LEVELS up to TOP; by default its words. A weight that is null, NaN or below half a step counts as 0: the
    document isn't taken. Where a source's other documents can't make up for such, it stays below its target.

    Rows of a null source form a source, last in order. A document without words has size 0 and costs nothing; it
    gets its certain copies. Whole documents are taken: the one that reaches the target is in if at least half of it
    fits, so a source misses its target by half a document at most. Equal ranks go by id, then size, then text. Repeated
    rows count each. An empty table gives an empty result.
    """
    drawn = _drawn(docs, weights, share, most, seed, id_col, text_col, source_col, weight)
    return drawn.select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _drawn(docs: DataFrame, weights, share: float, most: int, seed: str, id_col: str, text_col: str, source_col: str, weight: Column | None) -> DataFrame:
    """What mix() gives, and the hash of the text."""
    rows = store.cut(_counted(docs, id_col, text_col, source_col, seed, weight))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    levels = store.cut(rows.groupBy("source", "w").agg(F.sum("size").alias("level_size"), F.count("*").alias("rows")))
    sizes = levels.groupBy("source").agg(F.sum("level_size").alias("source_size"), F.sum("rows").alias("rows")).withColumn("key", key)
    goal = targets(sizes.select("source", "source_size"), weights, share, most).withColumn("key", key).select("key", "target")
    known = store.cut(sizes.select("key", "source_size", "rows").join(goal, "key"))
    rate = rates(levels.withColumn("key", key).join(known.select("key", "target"), "key"), most)
    known = store.cut(known.join(rate, "key"))
    total = rows.count()
    # One row a source; a source can be hot, so the sources that hold most rows are broadcast and the others shuffled.
    each = store.lookup(rows.withColumn("key", key), known, "key", "rows", total).drop("rows")
    expected = F.when(F.col("w") > 0, F.coalesce(F.least(F.lit(float(most)), F.col("rate") * F.col("w")), F.lit(float(most)))).otherwise(F.lit(0.0))
    each = each.withColumn("e", expected).withColumn("certain", F.floor("e")).withColumn("p", F.col("e") - F.col("certain"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    each = each.withColumn("q", F.when(F.col("p") > 0, odds))
    each = each.withColumn("cell", F.when(F.col("p") > 0, F.least(F.floor(F.lit(CELLS) * F.col("q") / (1 + F.col("q"))), F.lit(CELLS - 1))).cast("int"))
    sums = each.groupBy("key", "cell").agg(
        F.sum(F.when(F.col("p") > 0, F.col("size")).otherwise(0)).alias("cell_size"), F.sum(F.col("certain") * F.col("size")).alias("cell_certain"), F.first("target").alias("goal"), F.count("*").alias("cell_rows")
    )
    source, up_to = Window.partitionBy("key"), Window.partitionBy("key").orderBy("cell")
    run = sums.withColumns({"need": F.col("goal") - F.sum("cell_certain").over(source), "rows": F.sum("cell_rows").over(source), "after": F.sum("cell_size").over(up_to)})
    reached = F.col("cell").isNotNull() & (F.col("after") - F.col("cell_size") <= F.col("need")) & (F.col("after") > F.col("need"))
    edge = run.groupBy("key").agg(
        F.min(F.when(reached, F.col("cell"))).alias("last_cell"), F.min_by(F.col("after") - F.col("cell_size"), F.when(reached, F.col("cell"))).alias("before"), F.first("need").alias("need"), F.first("rows").alias("rows")
    )  # no last cell: all are taken
    each = store.lookup(each, store.cut(edge), "key", "rows", total)
    inside = each.where((F.col("p") > 0) & (F.col("cell") == F.col("last_cell")))
    order = Window.partitionBy("key").orderBy("q", F.col("doc_id"), "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("size").over(order)
    inside = inside.withColumn("drawn", (upto - F.col("size") / 2 <= F.col("need")).cast("long"))
    others = each.where((F.col("p") <= 0) | F.col("last_cell").isNull() | (F.col("cell") != F.col("last_cell")))
    others = others.withColumn("drawn", F.when(F.col("p") <= 0, 0).when(F.col("last_cell").isNull() | (F.col("cell") < F.col("last_cell")), 1).otherwise(0).cast("long"))
    copies = F.col("certain") + F.col("drawn")
    return others.unionByName(inside).select("doc_id", "source", "size", "text_hash", "source_size", "target", copies.alias("copies"))


def sample(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None
) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns as they were, whatever their names.

    Each row moves once; where rows agree in id, source and text, those that agree in all columns are counted first, and moved
    once more.
    """
    plan = _drawn(docs, weights, share, most, seed, id_col, text_col, source_col, weight)
    # Rows that agree in id, source and text are drawn as one set: which of them get the copies doesn't matter.
    set_of = store.name_of(F.col("text_hash"), F.col("size"), F.col("doc_id"), F.col("source"))
    how = store.cut(plan.groupBy(set_of.alias("key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"))
    text = store.col(text_col)
    rows = store.marked(docs, store.name_of(F.xxhash64(text), words_of(text), store.col(id_col), store.col(source_col).cast("string")))
    if how.agg(F.max("rows")).first()[0] in (None, 1):
        found = rows.join(how.hint("merge"), "key").select("row", F.col("copies").cast("int").alias("take"))
    else:
        rows = rows.groupBy("key", "row").agg(F.count("*").alias("n"))
        found = rows.join(how.hint("merge"), "key")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        base = F.floor(F.col("copies") / F.col("rows"))
        more = F.col("copies") - base * F.col("rows")  # that many rows, the first ones, have one copy more
        found = found.select("row", (F.col("n") * base + F.greatest(F.lit(0), F.least(F.col("n"), more - before))).cast("int").alias("take"))
    out = found.where("take > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("take"))).alias("copy"))
    return out.select("row.*")
