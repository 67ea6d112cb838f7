"""Mixing sources to target weights by entropy balancing.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words by weight;
a target stops at `cap` times its source's size and the excess is shared out again by weight.

Of all document rates r (0 <= r <= cap) that meet the targets, the one nearest to "each document once"
in relative entropy is r = min(cap, exp(lambda_s * size / mean size of s)): the dual has one
multiplier for each source. Newton steps on that convex dual, each kept inside a bracket that
holds the root, run as aggregations over (source, size) counts; the multipliers stay a table,
joined by source. Sums are exact integers (rates in units of 2^-30), so reruns agree bit by bit.

Rates become copies: the whole part, and one copy more for documents in the order of
hash / fraction, a source's list being cut where its words come nearest to the target. The cut is found
on a histogram of that order and then inside one bin, never by ordering a whole source in one task;
documents that still fit into the rest are taken in further rounds, and at last the one nearest to the rest.

Null text and null source are handled as the contract says (no words; a source of its own, last). A source
without words gets nothing. Repeated rows are documents of their own and may get different numbers of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import fresh, numbered, stored, table

WEIGHTS = (5, 2, 1)
CAP = 3
UNIT = 1 << 30
BINS = 4096
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def words(text="text"):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """_s (number of the source), source, source_size, docs, target; `sizes` holds (source, size, n)."""
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    # Text sorts by its UTF-8 bytes, which is the order of code points.
    listed = numbered(by_source, ["source"], "_s", "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_s", F.lit(len(weights))).cast("int"))
    listed = stored(listed.withColumn("_weight", weight), "source-weights")
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    most, level, last = F.col("source_size") * float(cap), 0.0, -1
    while True:  # sources leave at their cap until none is above; two numbers come back each time
        above = most <= F.col("_weight") * level
        row = listed.agg(
            F.sum(F.when(above, most)).alias("held"), F.sum(F.when(~above, F.col("_weight"))).alias("free"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if row.n == last or not row.free:
            break
        level, last = (total - (row.held or 0.0)) / row.free, row.n
    return listed.withColumn("target", F.least(most, F.col("_weight") * level)).drop("_weight")


def _rate(scale, multiplier, cap):
    """Units of 2^-30. The source is spent whole (cap), not at all (0) or tilted."""
    return F.round(F.least(F.lit(float(cap)), F.exp(F.least(multiplier * scale, F.lit(50.0)))) * UNIT).cast("long")


def solve(sizes: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = 1e-6, rounds: int = 60) -> DataFrame:
    """_s, multiplier (null: all documents at the cap) and _mean of every source with words."""
    counts = stored(sizes.where("size > 0").join(
        goals.select(F.col("source").alias("_source"), "_s"), F.col("source").eqNullSafe(F.col("_source"))
    ).groupBy("_s", "size").agg(F.sum("n").alias("n")), "size-counts")
    edge = counts.groupBy("_s").agg(F.min("size").alias("_small"), F.max("size").alias("_large"))
    ratio = F.col("target") / F.col("source_size")
    mean = F.col("source_size") / F.col("docs")
    state = goals.where("source_size > 0").drop("source").join(edge, "_s")
    small, large = F.col("_small") / mean, F.col("_large") / mean
    # exp(lambda x) against the ratio at the smallest and the largest size holds the root between these two.
    down, up = F.log(ratio) / small, F.log(ratio) / large
    state = state.withColumns({
        "_mean": mean, "_low": F.when(ratio < 1, down).otherwise(up),
        "_high": F.when(ratio < 1, up).otherwise(F.log(F.lit(float(cap))) / small),
    })
    state = stored(state.withColumns({
        "multiplier": F.when(ratio >= cap * (1 - 1e-12), F.lit(None)).otherwise((F.col("_low") + F.col("_high")) / 2),
        "_gap": F.lit(1.0),
    }), "multipliers")
    for _ in range(rounds):
        live = state.where(F.col("multiplier").isNotNull() & (F.col("_gap") > tolerance)).select(
            "_s", "multiplier", "_mean")
        scale = F.col("size") / F.col("_mean")
        rate = _rate(scale, F.col("multiplier"), cap)
        whole = F.col("n").cast("decimal(20,0)") * F.col("size") * rate
        slope = F.when(rate < cap * UNIT, F.round(F.col("size") * scale * rate / 1024)).otherwise(0.0).cast("decimal(20,0)") * F.col("n")
        sums = counts.join(live, "_s").groupBy("_s").agg(
            (F.sum(whole).cast("double") / UNIT).alias("_got"), (F.sum(slope).cast("double") * 1024 / UNIT).alias("_slope"))
        got = F.col("_got").isNotNull()
        over = F.col("_got") > F.col("target")
        low = F.when(got & ~over, F.col("multiplier")).otherwise(F.col("_low"))
        high = F.when(got & over, F.col("multiplier")).otherwise(F.col("_high"))
        newton = F.col("multiplier") - (F.col("_got") - F.col("target")) / F.col("_slope")
        inside = (F.col("_slope") > 0) & (newton > low) & (newton < high)
        gap = F.abs(F.col("_got") / F.col("target") - 1)
        state = stored(state.join(sums, "_s", "left").select(
            *[c for c in state.columns if c not in ("multiplier", "_low", "_high", "_gap")],
            low.alias("_low"), high.alias("_high"),
            F.when(got & (gap > tolerance), F.when(inside, newton).otherwise((low + high) / 2))
            .otherwise(F.col("multiplier")).alias("multiplier"),
            F.coalesce(gap, "_gap").alias("_gap"),
        ), "multipliers")
        if state.where(F.col("multiplier").isNotNull() & (F.col("_gap") > tolerance) & (F.col("_high") - F.col("_low") > 1e-12)).isEmpty():
            break
    return state.select("_s", "multiplier", "_mean")


OWN = ("size", "source_size", "target", "copies", "taken")


def _take(pool: DataFrame, need: DataFrame) -> DataFrame:
    """Rows of `pool` (_id, _s, size, _key in [0, 1)) to take so that each source's words stay within `need` (_s, _need)."""
    pool = pool.withColumn("_bin", F.floor(F.col("_key") * BINS).cast("int"))
    bins = pool.groupBy("_s", "_bin").agg(F.sum("size").alias("_w"))
    before = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
    bins = bins.withColumn("_base", F.coalesce(F.sum("_w").over(before), F.lit(0))).join(need, "_s")
    bins = bins.where("_base < _need").withColumn("_whole", F.col("_base") + F.col("_w") <= F.col("_need"))
    near = pool.join(bins.select("_s", "_bin", "_base", "_need", "_whole"), ["_s", "_bin"])
    inner = Window.partitionBy("_s", "_bin").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = near.where("not _whole").withColumn("_sum", F.col("_base") + F.sum("size").over(inner)).where("_sum <= _need")
    return near.where("_whole").select("_id", "_s", "size").unionByName(cut.select("_id", "_s", "size"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights=WEIGHTS, cap: int = CAP, rounds: int = 4) -> DataFrame:
    """The columns `keep` (all) of `docs` (doc_id, text, source and others), with size, source_size, target, copies, taken.

    Columns of `docs` that bear one of these five names give way to them.
    """
    keep = [c for c in keep or docs.columns if c not in OWN]
    # Stored, so that the row numbers stand; all planning is on the narrow part.
    rows = stored(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), "source", words().alias("size"),
        F.xxhash64("doc_id", "text", F.lit("mix")).alias("_hash"), F.monotonically_increasing_id().alias("_id"),
    ), "mix-rows")
    flat = rows.select("_id", "_hash", "source", "size")
    sizes = stored(flat.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    goals = stored(targets(sizes, weights, cap), "mix-targets")
    plan = goals.join(solve(sizes, goals, cap), "_s", "left").select(
        F.col("source").alias("_source"), "source_size", "target", "multiplier", "_mean", "_s")
    rate = F.when(F.col("size") == 0, 0).when(F.col("multiplier").isNull(), F.lit(cap * UNIT)).otherwise(
        _rate(F.col("size") / F.col("_mean"), F.col("multiplier"), cap))
    rated = flat.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_rate", rate).withColumns({
        "_base": F.floor(F.col("_rate") / UNIT).cast("long"),
        "_part": (F.col("_rate") % UNIT) / float(UNIT),
    })
    chance = (F.shiftrightunsigned("_hash", 11) + F.lit(0.5)) / float(1 << 53)
    rated = stored(rated.select(
        "_id", "_s", "size", "source_size", "target", "_base",
        # hash / fraction, folded into [0, 1); documents with a whole rate have no place in the order.
        F.when(F.col("_part") > 0, chance / (chance + F.col("_part"))).alias("_key"),
    ), "mix-rates")
    need = rated.groupBy("_s").agg(
        F.max("target").alias("_target"), F.sum(F.col("_base") * F.col("size")).alias("_got"))
    need = stored(need.select("_s", (F.col("_target") - F.col("_got")).alias("_need")), "mix-needs")
    pool = rated.where("_key is not null").select("_id", "_s", "size", "_key")
    extra = None
    for _ in range(rounds):
        # A document longer than the rest that is still needed can never be part of it.
        fits = pool.join(need, "_s").where("size <= _need").drop("_need")
        more = stored(_take(fits, need), "mix-extra")
        extra = more if extra is None else extra.unionByName(more)
        pool = pool.join(more.select("_id"), "_id", "left_anti")
        got = more.groupBy("_s").agg(F.sum("size").alias("_more"))
        need = stored(need.join(got, "_s", "left").select("_s", (F.col("_need") - F.coalesce("_more", F.lit(0))).alias("_need")), "mix-needs")
    # One more where it brings the source nearer: the document nearest in size to what is still missing.
    last = pool.join(need, "_s").where("_need > 0 and size < 2 * _need").groupBy("_s").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("_need")).alias("off"), "_key", "_id", "size")).alias("_b"))
    extra = stored(extra.unionByName(last.select("_b._id", "_s", "_b.size")), "mix-extra")
    copies = rated.join(extra.select("_id", F.lit(1).alias("_one")), "_id", "left").select(
        "_id", "size", "source_size", "target", (F.col("_base") + F.coalesce("_one", F.lit(0))).alias("copies"))
    return rows.select("_row", "_id").join(copies, "_id").select(
        *[F.col("_row")[c].alias(c) for c in keep], "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of `docs`.

    Documents without words are no part of any target; they are left out.
    """
    columns = docs.columns
    wide = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"))
    return mix(wide, ["_all"], **options).where("copies > 0").select(
        "_all", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    ).select(*[F.col("_all")[c].alias(c) for c in columns])


@query("op2_mixing")
def mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mix(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
