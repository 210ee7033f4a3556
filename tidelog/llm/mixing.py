"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Rates r = exp(tilt) minimise the relative entropy sum(size * (r ln r - r + 1)) under one token constraint a
source, sum(size * r) = target.  The dual is convex; as no document is under two constraints its Hessian is diagonal, so
Newton steps of all sources run at once on the sources' sums and need no further pass over documents.  The limit is
the logarithm of target / mass, which SQL can state.

Rates are then rounded into whole copies: each document gets floor(r), and of each source some documents get one more.
These are taken in a fixed random order as long as they fit into the words that are still missing; what is then left is
filled up, ``ROUNDS`` times in all, by documents that are no larger.  The place where a round ends is found by refining
histograms of the order key, so no task sorts a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often.
MOST_COPIES = 3
#: Bits of the order key, and of each of the two histogram levels that refine it.
KEY_BITS, LEVEL_BITS = 32, 12
NEWTON_STEPS = 64
#: Times that the words still missing are filled up.
ROUNDS = 3
#: A source's rows are dealt out to so many keys where they meet its row of the plan.
SALTS = 64


def entropy_rates(sources: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """Adds ``rate``: exp of the tilt at which the dual's gradient, target - mass * exp(tilt), vanishes.

    Newton starts at tilt 0.  A step down is at most 1 by the dual's shape; one up is at most ratio - 1, and
    from above Newton descends monotonically.  A source without mass or target has rate 0.
    """
    solve = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda tilt, _: tilt + (F.col("target") - F.col("mass") * F.exp(tilt)) / (F.col("mass") * F.exp(tilt)))
    return sources.withColumn("rate", F.when((F.col("mass") > 0) & (F.col("target") > 0), F.exp(solve)).otherwise(0.0))


def source_targets(sizes: DataFrame, weights=(1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: the total shared by weight, no target above ``most`` times its source.

    What a capped source leaves is shared by weight among the rest until none is above, which ends at one level
    of target per weight; sorted by cap per weight, running sums give it in one pass over sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", pick)
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    s = s.withColumn("all", F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("all") - (F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))).cast("double") / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).cast("double"))
    s = s.withColumn("level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.col("cap").cast("double"))).alias("target"))


def order_key(key: str = "doc_id"):
    """A fixed pseudo-random integer of the document id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _measured(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    """docs with _k, _source, _size and the order key _u."""
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_k": F.col(key), "_source": F.col(source).cast("string"), "_size": size, "_u": order_key(key)})


def _place(u: str, k: str):
    """Where a document stands in its source's order."""
    return F.struct(F.col(u).alias("u"), F.coalesce(F.col(k).cast("long"), F.lit(-(2**63))).alias("k"))


def _taken(size, place, rounds: int, plan: str = ""):
    """Whether a document gets one more copy in the first rounds, from its source's columns gap0, end0, gap1, ...: in
    each it is a candidate if it has none and fits, and is taken before the place where the round ends (null: nowhere)."""
    taken = F.lit(False)
    for r in range(rounds):
        gap, end = F.col(f"{plan}gap{r}"), F.col(f"{plan}end{r}")
        taken = taken | ((gap > 0) & (size <= gap) & (end.isNull() | (place < end)))
    return taken


def mixing_plan(rows: DataFrame, scratch: Scratch, weights=(1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """A row for each source: its size and target, the copies that every document gets, and for each round the words
    that are missing, gap, and where the order of those that get one more ends.  ``rows`` is a written table (k, source,
    size, u)."""
    plan = entropy_rates(source_targets(rows, weights, most).withColumn("mass", F.col("source_size").cast("double")))
    plan = plan.withColumn("base", F.least(F.lit(most), F.floor(F.col("rate") + 1e-9)).cast("long"))
    plan = plan.withColumn("gap0", F.when(F.col("base") >= most, 0).otherwise(F.floor(F.col("target") + 1e-6).cast("long") - F.col("base") * F.col("source_size")))
    plan = scratch.cut(plan.select("source", "source_size", "target", "base", "gap0"), "plan")
    for r in range(ROUNDS):
        own = _with_plan(rows.withColumn("salt", F.pmod("u", F.lit(SALTS))), plan, "source", "salt")
        own = own.filter((F.col(f"gap{r}") > 0) & (F.col("size") <= F.col(f"gap{r}")) & ~_taken(F.col("size"), _place("u", "k"), r))
        own = scratch.cut(own.select("k", "source", "size", "u"), f"candidates{r}")
        plan = _ended(own, plan, scratch, r)
        scratch.drop(f"candidates{r}", f"level{r}1", f"level{r}2")
    return plan


def _ended(rows: DataFrame, plan: DataFrame, scratch: Scratch, r: int) -> DataFrame:
    """Adds end and the next round's gap to the plan; ``rows`` are the round's candidates."""
    part, shift = plan.select("source", F.lit(0).cast("long").alias("cell"), F.col(f"gap{r}").alias("left")), KEY_BITS
    for level in (1, 2):
        # Of the cell where the order ends, sum a finer histogram and find the finer cell.
        held = _of_cell(rows, part, shift)
        shift -= LEVEL_BITS
        sums = held.groupBy("source", F.shiftright("u", shift).alias("cell")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("left", F.col("left") - F.sum("words").over(upto)).filter("left < 0")
        first = F.struct(-F.col("cell"))
        part = scratch.cut(sums.groupBy("source").agg(F.min("cell").alias("cell"), (F.max_by("words", first) + F.max_by("left", first)).alias("left")), f"level{r}{level}")
    # The last cell holds about one key in 2 ** 24 of a source.
    tie = Window.partitionBy("source").orderBy("u", F.col("k").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = _of_cell(rows, part, shift).withColumn("left", F.col("left") - F.sum("size").over(tie))
    ends = held.filter("left < 0").groupBy("source").agg(F.min(_place("u", "k")).alias(f"end{r}"))
    plan = scratch.cut(plan.alias("a").join(ends.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", f"b.end{r}"), f"ends{r}")
    if r + 1 == ROUNDS:
        return plan
    own = _with_plan(rows.withColumn("salt", F.pmod("u", F.lit(SALTS))), plan, "source", "salt")
    filled = own.filter(F.col(f"end{r}").isNull() | (_place("u", "k") < F.col(f"end{r}"))).groupBy("source").agg(F.sum("size").alias("words"))
    left = F.col(f"a.gap{r}") - F.coalesce(F.col("b.words"), F.lit(0))
    return scratch.cut(plan.alias("a").join(filled.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", left.alias(f"gap{r + 1}")), f"gaps{r}")


def _with_plan(rows: DataFrame, plan: DataFrame, source: str, salt: str) -> DataFrame:
    """Rows beside the plan's columns other than the source."""
    columns = [c for c in plan.columns if c != "source"]
    r, p = rows.alias("r"), _salted(plan).alias("p")
    return r.join(p, F.col(f"r.{source}").eqNullSafe(F.col("p.source")) & (F.col(f"r.{salt}") == F.col("p.salt"))).select("r.*", *(F.col(f"p.{c}") for c in columns))


def _of_cell(rows: DataFrame, part: DataFrame, shift: int) -> DataFrame:
    """Rows of each source's cell; a source is dealt out by salt."""
    r, p = rows.withColumn("salt", F.pmod("u", F.lit(SALTS))).alias("r"), _salted(part).alias("p")
    on = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.salt") == F.col("p.salt")) & (F.shiftright(F.col("r.u"), shift) == F.col("p.cell"))
    return r.join(p, on).select("r.source", "r.k", "r.size", "r.u", "p.left")


def _salted(sources: DataFrame) -> DataFrame:
    return sources.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _planned(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds _source_size, _target and _copies to measured rows."""
    plan = plan.select("source", F.struct(*(c for c in plan.columns if c != "source")).alias("_plan"))
    out = _with_plan(measured.withColumn("_salt", F.pmod("_u", F.lit(SALTS))), plan, "_source", "_salt")
    taken = _taken(F.col("_size"), _place("_u", "_k"), ROUNDS, "_plan.")
    return out.select("*", F.col("_plan.source_size").alias("_source_size"), F.col("_plan.target").alias("_target"), (F.col("_plan.base") + F.when(taken, 1).otherwise(0)).alias("_copies"))


def _sizes(docs: DataFrame, scratch: Scratch, text: str, key: str, source: str) -> DataFrame:
    rows = _measured(docs, text, key, source).select(F.col("_k").alias("k"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_u").alias("u"))
    return scratch.cut(rows, "sizes")


def mix_sources(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=(1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """One row for each input row: key, size, source_size, target, taken, copies, source.

    A null text has size 0; a null source is a source of its own, the last.  Copies are a function of key, sizes
    and targets, so reruns agree; rows that repeat a key in a source are taken alike.  An empty table gives an
    empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _sizes(docs, scratch, text, key, source)
    plan = mixing_plan(rows, scratch, weights, most)
    out = _planned(rows.select(F.col("k").alias("_k"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("u").alias("_u")), plan)
    return out.select(
        F.col("_k").alias(key),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
        F.col("_copies").alias("copies"),
        F.col("_source").alias("source"),
    )


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=(1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    As in ``mix_sources``: null texts have size 0, a null source is one of its own, repeated rows are taken alike, and
    texts of any length are counted whole.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    plan = mixing_plan(_sizes(docs, scratch, text, key, source), scratch, weights, most)
    out = _planned(_measured(docs, text, key, source), plan).filter("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
