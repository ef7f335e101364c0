"""Mixing sources to target weights by Pareto order sampling (operator 7).

A source of weight w shares a word budget; its target stops at ``max_copies``
times its own words and the excess goes to the others by weight until no
source is above.  Inside a source every document has its own expected number of
copies: a level times the bits of its size (a text of 1000 words has ten bits,
one of three words has two, so scraps come less often than articles),
``max_copies`` at most, the level being the one at which the expected words are
the source's target.  The whole part of that number are certain copies; the
fraction p is the document's inclusion probability for one more.  Documents are
ranked by their random odds over their inclusion odds, q = [u/(1-u)] /
[p/(1-p)], and taken in that order until the source's remaining words are
filled, so the sample's size in words is fixed up to one document.

No source is ever sorted in one task.  The rank is cut by a histogram: v =
q/(1+q) falls into one of ``RANK_CELLS`` cells, words are summed by (source,
span of cells), then by the cells of the span that holds the cut, and only the
documents of the cut's own cell are ordered.

Levels come from sums by (source, bits), at most 64 rows for each source.

Defined cases: null or blank text has size 0 and is never taken; a null source is a source of its
own, ranked last; equal rows are exchangeable and the cut may fall between
them; a source without words has target 0; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.llm.common import WORD_PATTERN, if_small, pinned, positional

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MAX_COPIES = 2
SEED = "mix-1"
#: Cells of the rank histogram; a cut cell holds about 1/65536 of a source.
RANK_CELLS = 65536
#: Cells that are first summed together, so no window sees more than 257 rows.
SPAN_CELLS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number inside (0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def bits(size: Column) -> Column:
    """Binary digits of a size, 0 for 0: what a document's expected copies are in proportion to."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def source_ranks(sources: DataFrame) -> DataFrame:
    """``sources`` (one row each, column ``source``) with their rank from 0.

    Order is by code point, null last.  Range partitions are numbered and
    ranked side by side, so any number of sources is ranked without one task
    that sees them all.
    """
    spark = sources.sparkSession
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id())
    dealt = pinned(dealt)
    offsets, at = [], 0
    for part, n in sorted((r["__part"], r["n"]) for r in dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((part, at))
        at += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "__part int, __start long")
    inside = Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("__at", F.row_number().over(inside)).join(starts, "__part").withColumn("rank", F.col("__start") + F.col("__at") - 1).drop("__part", "__at", "__start")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, budget_share: float = BUDGET_SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """Rows (source, words, target) from rows (source, words).

    The driver sees two sums for each round of resharing, never the sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = pinned(source_ranks(sources).withColumn("weight", weight))
    total = ranked.agg(F.sum("words")).first()[0] or 0
    top = F.col("words") * F.lit(float(max_copies))
    level, budget = -1.0, budget_share * total
    while True:
        above = F.col("weight") * F.lit(level) > top
        fixed, free = ranked.agg(F.sum(F.when(above, top)), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            break
        new = (budget - (fixed or 0.0)) / free
        if new == level:
            break
        level = new
    share = F.col("weight") * F.lit(level)
    return ranked.select("source", "words", F.when(share > top, top).otherwise(share).alias("target"))


def _levels(sized: DataFrame, goals: DataFrame, max_copies: int) -> DataFrame:
    """Rows (source, words, target, bits, inside, whole, p): expected copies of each size class of a source."""
    classes = sized.groupBy("source", bits(F.col("size")).alias("bits")).agg(F.sum("size").alias("inside")).filter("bits > 0")
    goals = goals.toDF("__g", "words", "target")
    met = classes.join(if_small(goals), F.col("source").eqNullSafe(F.col("__g"))).drop("__g")
    up = Window.partitionBy("source").orderBy("bits")
    down = Window.partitionBy("source").orderBy(F.col("bits").desc())
    # The level if all classes of more bits have max_copies and the others are below that.
    above = F.coalesce(F.sum("inside").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum(F.col("inside") * F.col("bits")).over(up.rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("level", (F.col("target") - F.lit(float(max_copies)) * above) / free)
    fits = F.when(F.col("level") * F.col("bits") <= max_copies, F.struct("bits", "level"))
    met = met.withColumn("level", F.max(fits).over(Window.partitionBy("source"))["level"])
    copies = F.least(F.lit(float(max_copies)), F.coalesce(F.col("level") * F.col("bits"), F.lit(float(max_copies))))
    return met.withColumn("copies", copies).select("source", "words", "target", "bits", "inside", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p"))


def _schedule(sized: DataFrame, weights: tuple, budget_share: float, max_copies: int, seed: str) -> DataFrame:
    """One row per source and size class: words, target, copies, and where the source's ranking is cut.

    Sources without words have no class and no row.
    """
    goals = pinned(targets(sized.groupBy("source").agg(F.sum("size").alias("words")), weights, budget_share, max_copies))
    classes = _levels(sized, goals, max_copies)
    rest = F.col("target") - F.sum(F.col("whole") * F.col("inside")).over(Window.partitionBy("source"))
    classes = pinned(classes.withColumn("rest", rest).toDF(*[f"__{c}" for c in [*classes.columns, "rest"]]))
    ranked = _ranked(sized, classes, F.col("doc_id"), F.col("source"), F.col("size"), seed)
    ranked = pinned(ranked.filter("__q is not null").select("__source", "__rest", "size", "__cell"))
    wide = ranked.withColumn("__span", F.floor(F.col("__cell") / SPAN_CELLS)).withColumn("__before", F.lit(0).cast("long"))
    spans = _cut(wide, "__span").select(F.col("__source").alias("__s"), F.col("__span").alias("__t"), "__before")
    inside = wide.drop("__before").join(spans, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__span") == F.col("__t")))
    cuts = _cut(inside, "__cell").select(F.col("__source").alias("__cut_source"), F.col("__cell").alias("__cut"), "__before")
    classes = classes.join(cuts, F.col("__source").eqNullSafe(F.col("__cut_source")), "left").drop("__cut_source")
    blank = goals.select(F.col("source").alias("__source"), F.col("words").alias("__words"), F.col("target").alias("__target"), F.lit(0).alias("__bits"), F.lit(0).cast("long").alias("__whole"), F.lit(0.0).alias("__p"))
    return pinned(classes.unionByName(blank, allowMissingColumns=True))


def _cut(rows: DataFrame, cell: str) -> DataFrame:
    """For each source the cell in which its remaining words run out, and the words before it."""
    cells = rows.groupBy("__source", "__rest", "__before", cell).agg(F.sum("size").alias("__in"))
    filled = F.sum("__in").over(Window.partitionBy("__source").orderBy(cell))
    cells = cells.withColumn("__filled", F.col("__before") + filled).withColumn("__before", F.col("__filled") - F.col("__in"))
    return cells.filter((F.col("__before") <= F.col("__rest")) & (F.col("__filled") > F.col("__rest")))


def _ranked(rows: DataFrame, schedule: DataFrame, doc_id: Column, source: Column, size: Column, seed: str) -> DataFrame:
    """``rows`` with the schedule of their source and size class, ``__q`` and its histogram cell."""
    u = uniform(doc_id, seed)
    odds = (u / (1 - u)) / (F.col("__p") / (1 - F.col("__p")))
    met = rows.join(if_small(schedule), source.eqNullSafe(F.col("__source")) & (bits(size) == F.col("__bits"))).withColumn("__q", F.when(F.col("__p") > 0, odds))
    return met.withColumn("__cell", F.floor(F.col("__q") / (1 + F.col("__q")) * F.lit(float(RANK_CELLS))).cast("int"))


def _inside(cell: Column, cut: Column) -> Column:
    """Whether a row lies in its source's cut cell, so that its copies are not known at once."""
    return cell.isNotNull() & cut.isNotNull() & cell.eqNullSafe(cut)


def _copies() -> Column:
    """Copies of a row outside the cut cell: the certain ones, and one more in front of the cut."""
    return F.col("__whole") + F.when(F.col("__q").isNull(), 0).when(F.col("__cut").isNull() | (F.col("__cell") < F.col("__cut")), 1).otherwise(0)


def _split(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose copies are known at once, and those of the cut cells."""
    inside = _inside(F.col("__cell"), F.col("__cut"))
    return ranked.filter(~inside).withColumn("__copies", _copies()), ranked.filter(inside)


def _cut_cells(ranked_cut: DataFrame) -> DataFrame:
    """Counted rows of the cut cells with how many of each get one more copy.

    Equal rows are counted first, so a row that repeats without end is one row
    here; a cell's distinct rows are ordered by q and filled up to the nearest
    document.
    """
    alike = ranked_cut.groupBy("doc_id", "source", "size", "__words", "__target", "__whole", "__q", "__rest", "__before").agg(F.count(F.lit(1)).alias("__m"))
    order = Window.partitionBy("source").orderBy("__q", F.col("doc_id").asc_nulls_last(), "size")
    start = F.col("__before") + F.sum(F.col("size") * F.col("__m")).over(order) - F.col("size") * F.col("__m")
    fits = F.when(F.col("__start") > F.col("__rest"), 0).when(F.col("size") == 0, F.col("__m")).otherwise(F.floor((F.col("__rest") - F.col("__start")) / F.col("size") + 0.5))
    return alike.withColumn("__start", start).withColumn("__fits", F.least(F.col("__m"), fits).cast("long"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return pinned(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, budget_share: float = BUDGET_SHARE, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies): one per row of ``docs``."""
    sized = _sized(docs, id_col, text_col, source_col)
    schedule = _schedule(sized, weights, budget_share, max_copies, seed)
    plain, cut = _split(_ranked(sized, schedule, F.col("doc_id"), F.col("source"), F.col("size"), seed))
    columns = ["doc_id", "source", "size", F.col("__words").alias("source_size"), F.col("__target").alias("target")]
    cut = _cut_cells(cut).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))))
    cut = cut.withColumn("__copies", F.col("__whole") + F.when(F.col("__copy") <= F.col("__fits"), 1).otherwise(0))
    return plain.select(*columns, F.col("__copies").alias("copies")).unionByName(cut.select(*columns, F.col("__copies").alias("copies")))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, budget_share: float = BUDGET_SHARE, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, all columns kept.

    Sizes are counted once and ranked without the texts.  Whole documents are
    read once, where they meet the schedule and the few decisions of the cut
    cells; only if the cut falls between equal rows are those numbered apart.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    schedule = _schedule(sized, weights, budget_share, max_copies, seed)
    fits = _cut_cells(_split(_ranked(sized, schedule, F.col("doc_id"), F.col("source"), F.col("size"), seed))[1])
    fits = pinned(fits.select(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__z"), "__m", "__fits"))
    own, (id_name, text, source_name) = positional(docs, id_col, text_col, source_col)
    doc_id, source = F.col(id_name), F.col(source_name)
    same = doc_id.eqNullSafe(F.col("__i")) & source.eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
    ranked = _ranked(own.withColumn("__size", word_count(F.col(text))), schedule, doc_id, source, F.col("__size"), seed)
    partly = (F.col("__fits") > 0) & (F.col("__fits") < F.col("__m"))
    met = ranked.join(if_small(fits), same & _inside(F.col("__cell"), F.col("__cut")), "left")
    met = met.withColumn("__copies", F.when(F.col("__m").isNull(), _copies()).when(partly, 0).otherwise(F.col("__whole") + (F.col("__fits") > 0).cast("long")))
    parts = [met]
    between = pinned(fits.filter(partly))
    if between.take(1):
        among = Window.partitionBy("__i", "__s", "__z").orderBy(F.xxhash64(F.col(text)))
        apart = ranked.join(if_small(between), same).withColumn("__at", F.row_number().over(among))
        parts.append(apart.withColumn("__copies", F.col("__whole") + (F.col("__at") <= F.col("__fits")).cast("long")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")
    taken = [x.filter("__copies > 0").select(*own.columns, copies).select(own.columns) for x in parts]
    return (taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])).toDF(*docs.columns)
