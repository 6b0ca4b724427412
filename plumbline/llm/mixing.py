"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.base import WORD, hinted, wrapped
from plumbline.session import materialize

ROWS_PER_SALT = 5_000
MAX_SALTS = 4_096
CLASSES_PER_DOUBLING = 4
ROUNDS = 60
PHASES = 64
TOLERANCE = 1e-12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(names: DataFrame, by: str) -> DataFrame:
    """``names`` with ``place``, 0 for the least value of ``by``; nulls come last.

    Ranges are numbered apart and joined with the number of rows before each, so no task sees all rows.
    """
    spark = names.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    dealt = names.repartitionByRange(parts, F.col(by).asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    inside = Window.partitionBy("part").orderBy(F.col(by).asc_nulls_last())
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "part")
    return placed.withColumn("place", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def shared_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: ``share`` of all sizes, dealt by weight.

    Sources ordered by code point, null last, take the weights in turn.  A target stops at ``cap`` times
    its source's size and what is over goes to the others by weight, until none is above.
    """
    order = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked(sources, "source")
    weighed = weighed.withColumn("weight", F.element_at(order, (F.col("place") % len(weights) + 1).cast("int")))
    weighed = materialize(weighed.drop("place"), "weighed")
    full = F.col("source_size") * F.lit(float(cap))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level only rises, and each round fills at least one more source
        over = full <= F.col("weight") * F.lit(level)
        fixed, open_weight = weighed.agg(
            F.sum(F.when(over, full).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if not open_weight:
            break
        risen = (share * total - fixed) / open_weight
        if risen <= level:
            break
        level = risen
    return weighed.withColumn("target", F.least(full, F.col("weight") * F.lit(level))).drop("weight")


def balanced_rates(groups: DataFrame, targets: DataFrame, cap: float, rounds: int = ROUNDS) -> DataFrame:
    """``groups`` (source, base, tokens) with ``rate``, the entropy-balanced copies of a document.

    Among all rates in [0, cap] that meet the token constraint of each source, these are nearest to the base
    rates in token-weighted relative entropy: min(cap, base * exp(dual)).  The dual is convex and has one
    variable per source, so its Hessian is diagonal and a Newton step for every source is one aggregation:
    gradient ``target - sum(tokens * rate)``, curvature ``sum(tokens * rate)`` below the cap.  The signs of earlier
    gradients bracket the optimum; a step that leaves the bracket, as from where all rates are
    capped, goes to its middle.  A source without tokens keeps dual 0.
    """
    start = [F.lit(0.0).alias("dual"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")]
    duals = materialize(targets.select("source", "target", *start), "duals")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    rate = lambda dual: F.least(F.lit(float(cap)), F.col("base") * F.exp(dual))
    for _ in range(rounds):
        met = groups.join(hinted(duals), same(groups, duals)).drop(groups["source"])
        free = F.col("base") * F.exp("dual") < cap
        flow = F.col("tokens") * rate(F.col("dual"))
        sums = met.groupBy("source", "target", "dual", "low", "high").agg(
            F.sum(flow).alias("flow"), F.sum(F.when(free, flow).otherwise(0.0)).alias("curve")
        )
        gap = F.col("target") - F.col("flow")
        done = (F.abs(gap) <= F.lit(TOLERANCE) * F.greatest("target", F.lit(1.0))) | (F.col("target") <= 0)
        sums = sums.select("source", "target", "dual", "curve", gap.alias("gap"), done.alias("done"), "low", "high")
        sums = sums.withColumn("low", F.when(F.col("gap") >= 0, F.col("dual")).otherwise(F.col("low")))
        sums = sums.withColumn("high", F.when(F.col("gap") <= 0, F.col("dual")).otherwise(F.col("high")))
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("gap") / F.col("curve")))
        newton = F.col("dual") + F.when(F.col("curve") > 0, step).otherwise(F.signum("gap"))
        outside = (newton <= F.col("low")) | (newton >= F.col("high"))
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, newton)
        dual = F.when(F.col("done"), F.col("dual")).when(outside, middle).otherwise(newton)
        moved = materialize(sums.select("source", "target", dual.alias("dual"), "low", "high", "done"), "duals")
        duals = moved.drop("done")
        if moved.where("not done").limit(1).count() == 0:
            break
    out = groups.join(hinted(duals), same(groups, duals), "left").drop(duals["source"])
    zero = F.col("target").isNull() | (F.col("target") <= 0)
    return out.withColumn("rate", F.when(zero, 0.0).otherwise(rate(F.col("dual")))).drop("target", "dual", "low", "high")


def copies_of(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) per row of ``docs`` (doc_id, source, size).

    Every document of a source gets the source's balanced rate.  Rates are rounded by systematic sampling in the
    order of size: the k-th document takes floor(k * rate + phase) - floor((k - 1) * rate + phase) copies, which meets a source's words to within about
    one document; of 64 phases each source takes the one that comes nearest.  The number k comes from counts by
    (source, size class, salt) and a rank inside these, so a source that holds most rows is still many small windows.  Ties
    are ordered by md5 of the id, so reruns agree; equal rows are interchangeable.
    """
    narrow = materialize(docs.select("doc_id", "source", "size"), "sizes")
    n = narrow.count()
    salts = min(MAX_SALTS, max(1, n // ROWS_PER_SALT))
    sources = materialize(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = materialize(shared_targets(sources, weights, share, cap), "targets")
    groups = sources.select("source", F.lit(1.0).alias("base"), F.col("source_size").cast("double").alias("tokens"))
    rates = balanced_rates(groups, targets, cap).select("source", "rate")
    known = targets.join(rates, targets["source"].eqNullSafe(rates["source"])).drop(rates["source"])
    known = materialize(known.select(F.col("source").alias("s"), "source_size", "target", "rate"), "rates")

    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    level = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * CLASSES_PER_DOUBLING)
    salt = F.conv(F.substring("digest", 1, 6), 16, 10).cast("long") % salts
    keyed = narrow.withColumn("digest", digest).withColumn("class", level).withColumn("salt", salt)
    cells = keyed.groupBy("source", "class", "salt").agg(F.count(F.lit(1)).alias("n"))
    slices = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "class", F.coalesce(F.sum("n").over(before("source", "class")), F.lit(0)).alias("below"))
    cells = cells.select("source", "class", "salt", F.coalesce(F.sum("n").over(before("source", "class", "salt")), F.lit(0)).alias("ahead"))
    starts = cells.join(slices, cells["source"].eqNullSafe(slices["source"]) & (cells["class"] == slices["class"]))
    starts = starts.select(cells["source"].alias("s"), cells["class"].alias("c"), cells["salt"].alias("t"), (F.col("below") + F.col("ahead")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("source", "class", "salt").orderBy("size", "digest", "doc_id"))
    numbered = keyed.withColumn("rank", rank)
    at = numbered["source"].eqNullSafe(starts["s"]) & (numbered["class"] == starts["c"]) & (numbered["salt"] == starts["t"])
    numbered = numbered.join(starts, at).drop("s", "c", "t")
    numbered = numbered.join(hinted(known), numbered["source"].eqNullSafe(known["s"])).drop("s")
    numbered = numbered.withColumn("k", F.col("start") + F.col("rank"))
    numbered = materialize(numbered.select("doc_id", "source", "size", "source_size", "target", "rate", "k"), "numbered")

    def taken(phase: Column) -> Column:
        return F.floor(F.col("k") * F.col("rate") + phase) - F.floor((F.col("k") - 1) * F.col("rate") + phase)

    phases = [(i + 0.5) / PHASES for i in range(PHASES)]
    miss = [F.struct(F.abs(F.sum(taken(F.lit(p)) * F.col("size")) - F.col("target")).alias("miss"), F.lit(p).alias("phase")) for p in phases]
    best = numbered.groupBy("source", "target").agg(F.array_min(F.array(*miss))["phase"].alias("phase"))
    best = materialize(best.select(F.col("source").alias("s"), "phase"), "phases")
    chosen = numbered.join(hinted(best), numbered["source"].eqNullSafe(best["s"]))
    return chosen.select("doc_id", "source", "size", "source_size", "target", "rate", taken(F.col("phase")).alias("copies"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: what the mix takes of it (``taken`` words, repeats counted).

    A null text has size 0.  A null source is a source of its own, ordered last.  Documents without words take
    part with 0 words.  No rows give no rows.  Repeated rows each count.  Other columns are ignored.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = copies_of(sized, weights, share, cap)
    return out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: rows of ``docs`` repeated as often as their copies; all columns stay.

    Rows are told apart by doc_id and the text's hash.  Several rows alike in both share their copies: each takes the
    whole part of the average, and the first ones, by all their columns, one of what is left over.
    """
    name = lambda i, d: F.to_json(F.struct(F.col(i).alias("id"), F.col(d).alias("text")))
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), word_count(F.col("text")).alias("size"))
    taken = copies_of(sized.select(name("doc_id", "digest").alias("doc_id"), "source", "size"), weights, share, cap)
    counts = taken.groupBy(F.col("doc_id").alias("name")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    counts = materialize(counts.where("copies > 0"), "copies")
    rows = wrapped(docs).select("doc", name("key_id", "key_text").alias("name"))
    once = rows.join(hinted(counts.where("rows = 1"), 1_000_000), "name").select("doc", "copies")
    several = rows.join(hinted(counts.where("rows > 1"), 1_000_000), "name")
    turn = F.row_number().over(Window.partitionBy("name").orderBy("doc"))
    each = F.floor(F.col("copies") / F.col("rows")) + (turn <= F.col("copies") % F.col("rows")).cast("int")
    out = once.unionByName(several.select("doc", each.alias("copies"))).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
