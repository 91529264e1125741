"""Mixing sources to target weights by entropy balancing.

Each source's document rates minimise relative entropy to rate 1 under one constraint: rate times
size, summed over the source, equals its target; no rate exceeds MAX_COPIES. The dual is convex with
one multiplier a source: rate = min(MAX_COPIES, exp(lambda * size / mean size)). Newton steps with a
bracket solve all duals at once; every step is one distributed aggregate over (source, size) counts
and its state is a table with a row a source.

Rates become whole copies by a rule that each row decides for itself, so no text moves: a document
gets floor(rate) copies, and one more if its hash less the rate's fraction lies below its source's cut.
The cut is the value at which the words taken cross the target, found by histograms of ever narrower
range; the remaining gap is narrowed by single documents whose size fits it best.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own,
ranked last; rows equal in id and text get equal copies, other ties are broken by the hash; an empty
table gives an empty result; extra columns are not read; very long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import materialize, small

MAX_COPIES = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
TOLERANCE = 1e-7
#: Newton steps until an error; a bracketed step halves its range at worst, so some sixty reach a double's precision.
STEPS = 200
#: Buckets of one histogram, and the histograms: their last buckets are narrower than 1e-10.
BUCKETS, HISTOGRAMS = 4096, 3
#: Single documents, at most, by which a source's gap is narrowed; it ends when none of them would narrow it.
CHANGES = 32


def sizes(docs: DataFrame) -> DataFrame:
    """Adds _source, size (words) and _hash (of id and text)."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.withColumns({"_source": F.col("source"), "size": size, "_hash": F.xxhash64(F.col("doc_id").cast("string"), "text")})


def ranked_sources(sized: DataFrame) -> DataFrame:
    """(source, size, n, rank): rank by code point from 0, null last, without a task that sees all sources."""
    found = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "mix-sources")
    # a row a partition
    parts = numbered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(F.broadcast(before.select("_part", "_first", "_before")), "_part").select("source", "size", "n", (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"))  # one row a shuffle partition


def with_targets(sources: DataFrame, weights: tuple[float, ...], cap: float = MAX_COPIES) -> DataFrame:
    """Adds target: shares of the total by weight; what exceeds cap times a size is reshared until none does.

    Shares are one level times the weight. Whatever is capped at a level stays so at the next, higher one,
    so the level alone tells the state; each round is one aggregate.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    level, was = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.lit(float(cap)) * F.col("size")
        s = rows.agg(
            F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"), F.count_if(over).alias("n"),
        ).first()
        if s.n == was or not s.open:
            break
        level, was = (s.total - cap * s.capped) / s.open, s.n if level else -1
    return rows.withColumn("target", F.when(over, F.lit(float(cap)) * F.col("size")).otherwise(F.lit(level) * F.col("weight")))


def _kept(df: DataFrame, counted: Column, name: str) -> tuple[DataFrame, int]:
    """df, written, and the number of its rows for which something holds, counted while writing."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count_if(counted).alias("n")), name)
    return out, seen.get["n"]


def solve_duals(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, target, size, mean, lam), a row a source. counts: (source, size, n). A source at its cap has a null lam: rate MAX_COPIES."""
    mean = F.greatest(F.lit(1.0), F.col("size") / F.col("n"))
    full = F.col("target") >= MAX_COPIES * F.col("size") * (1 - 1e-12)
    start = F.when(full & (F.col("size") > 0), None).when(F.col("size") > 0, F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("size"))).otherwise(0.0)
    state, open_ = _kept(sources.select("source", "size", "target", mean.alias("mean"), start.alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (start.isNull() | (F.col("size") == 0)).alias("done")), ~F.col("done"), "mix-duals")
    n = state.count()
    for _ in range(STEPS):
        if not open_:
            return state.select("source", "target", "size", "mean", "lam")
        todo = state.filter("not done").select(F.col("source").alias("_s"), "lam", "mean")
        x = F.col("size") / F.col("mean")
        rate = F.least(F.exp(F.col("lam") * x), F.lit(float(MAX_COPIES)))
        sums = counts.join(small(todo, n), F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(F.sum(F.col("n") * F.col("size") * rate).alias("g"), F.sum(F.when(rate < MAX_COPIES, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("h"))
        gap = F.col("g") - F.col("target")
        joined = state.join(small(sums, n), F.col("source").eqNullSafe(F.col("_s")), "left").withColumns({
            "_solved": F.col("done") | (F.abs(gap) <= TOLERANCE * F.greatest(F.lit(1.0), F.col("target"))), "_low": F.when(gap <= 0, F.col("lam")).otherwise(F.col("low")), "_high": F.when(gap > 0, F.col("lam")).otherwise(F.col("high")),
        })
        newton = F.when(F.col("h") > 0, F.col("lam") - gap / F.col("h"))
        inside = F.coalesce(newton > F.col("_low"), newton.isNotNull()) & F.coalesce(newton < F.col("_high"), newton.isNotNull())
        away = F.col("lam") + F.when(gap < 0, 1).otherwise(-1) * (1 + F.abs("lam"))
        step = F.when(inside, newton).otherwise(F.coalesce((F.col("_low") + F.col("_high")) / 2, away))
        state, open_ = _kept(joined.select(
            "source", "size", "target", "mean", F.when(F.col("_solved"), F.col("lam")).otherwise(step).alias("lam"), F.col("_low").alias("low"), F.col("_high").alias("high"), (F.col("_solved") | (step == F.col("lam"))).alias("done")
        ), ~F.col("done"), "mix-duals")
    raise RuntimeError("the duals did not settle")


def _rate() -> Column:
    power = F.col("lam") * F.col("size") / F.col("mean")
    return F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), float(MAX_COPIES)).otherwise(F.least(F.exp(power), F.lit(float(MAX_COPIES))))


def _base() -> Column:
    return F.floor("rate").cast("int")


def _stand() -> Column:
    """Where a document stands against its source's cut: its hash as a number below 1, less its rate's fraction; 2 if it gets no more."""
    u = F.call_function("shiftrightunsigned", F.col("_hash"), F.lit(11)) / F.lit(float(1 << 53))
    return F.when((F.col("size") > 0) & (_base() < MAX_COPIES), u - (F.col("rate") - F.floor("rate"))).otherwise(2.0)


def find_cuts(rows: DataFrame, duals: DataFrame) -> DataFrame:
    """duals with a cut a source. rows: (source key of duals as sid, size, rate, _hash, stand)."""
    base = rows.groupBy("sid").agg(F.sum(_base() * F.col("size")).alias("base"))
    n = duals.count()
    state = materialize(duals.join(small(base, n), "sid").select("sid", (F.col("target") - F.col("base")).alias("need"), F.lit(-1.0).alias("low"), F.lit(2.0).alias("width")), "mix-cuts")
    for _ in range(HISTOGRAMS):
        inside = rows.join(small(state, n), "sid").filter((F.col("stand") >= F.col("low")) & (F.col("stand") < F.col("low") + F.col("width")))
        at = F.least(F.floor((F.col("stand") - F.col("low")) / F.col("width") * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket")
        bars = inside.select("sid", at, "size").groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
        upto = Window.partitionBy("sid").orderBy("bucket")  # at most BUCKETS rows a source
        summed = bars.withColumn("upto", F.sum("held").over(upto)).join(small(state.select("sid", "need"), n), "sid")
        # the bucket in which the words reach what is needed; past all of them, the last one
        crossing = summed.groupBy("sid").agg(F.min(F.when(F.col("upto") >= F.col("need"), F.struct("bucket", "upto", "held"))).alias("hit"), F.max(F.struct("bucket", "upto", "held")).alias("last"))
        found = state.join(small(crossing, n), "sid", "left").withColumn("b", F.coalesce("hit", "last"))
        state = materialize(found.select(
            "sid", F.coalesce(F.col("need") - (F.col("b.upto") - F.col("b.held")), F.col("need")).alias("need"), F.coalesce(F.col("low") + F.col("b.bucket") * F.col("width") / BUCKETS, F.col("low")).alias("low"),
            F.when(F.col("b").isNotNull(), F.col("width") / BUCKETS).otherwise(F.col("width")).alias("width"), F.coalesce("b.held", F.lit(0)).alias("held"),
        ), "mix-cuts")
    # before or after the last bucket, whichever leaves less
    cut = F.when(2 * F.col("need") >= F.col("held"), F.col("low") + F.col("width")).otherwise(F.col("low"))
    return duals.join(small(state.select("sid", cut.alias("cut")), n), "sid", "left")


def _copies() -> Column:
    times = lambda a: F.size(F.filter(a, lambda h: h == F.col("_hash")))
    whole = _base() + F.when(_stand() < F.col("cut"), 1).otherwise(0) + times("ups") - times("downs")
    return F.greatest(F.lit(0), F.least(F.lit(MAX_COPIES), whole)).cast("int")


def narrow_gaps(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts with ups and downs: hashes of the documents that get one copy more or less, each the best for its source's gap."""
    none = F.array().cast("array<long>")
    plan, n = cuts.withColumns({"ups": none, "downs": none}), cuts.count()

    def now(state: DataFrame, more: list[str]) -> DataFrame:
        wanted = state.select("sid", "lam", "mean", "target", "cut", "ups", "downs", *more)
        return rows.drop("rate", "stand").join(small(wanted, n), "sid").withColumn("rate", _rate()).withColumn("copies", _copies())

    gaps = now(plan, []).groupBy("sid").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    state = materialize(plan.join(small(gaps, n), "sid"), "mix-gaps")
    for _ in range(CHANGES):
        near = now(state, ["gap"]).filter((F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies") < MAX_COPIES).otherwise(F.col("copies") > 0))
        best = near.groupBy("sid").agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("size")).alias("left"), F.col("_hash").alias("h"), F.col("size").alias("words"))).alias("b"))
        joined = state.join(small(best, n), "sid", "left").withColumn("up", F.col("gap") > 0)
        changed = F.col("b").isNotNull()
        state, found = _kept(joined.select(
            *[c for c in state.columns if c not in ("ups", "downs", "gap")], F.when(changed & F.col("up"), F.concat("ups", F.array("b.h"))).otherwise(F.col("ups")).alias("ups"), F.when(changed & ~F.col("up"), F.concat("downs", F.array("b.h"))).otherwise(F.col("downs")).alias("downs"),
            F.when(changed, F.col("gap") - F.when(F.col("up"), F.col("b.words")).otherwise(-F.col("b.words"))).otherwise(F.col("gap")).alias("gap"), changed.alias("changed"),
        ), F.col("changed"), "mix-changes")
        state = state.drop("changed")
        if not found:
            break
    return state


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, keep: list[str] | None = None) -> DataFrame:
    """Adds size, source_size, target, rate and copies to the kept columns, a row a document."""
    keep = keep or ["doc_id"]
    thin = materialize(sizes(docs).select("_source", "size", "_hash"), "mix-sized")
    sources = with_targets(ranked_sources(thin), weights)
    counts = materialize(thin.groupBy(F.col("_source").alias("source"), "size").agg(F.count("*").alias("n")), "mix-counts")
    duals = materialize(solve_duals(counts, sources).withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")), "mix-solved")
    n = duals.count()
    keyed: Callable[[DataFrame], DataFrame] = lambda df: df.withColumn("sid", F.xxhash64(F.col("_source").isNull(), "_source"))
    rows = keyed(thin).join(small(duals.select("sid", "lam", "mean"), n), "sid").withColumn("rate", _rate()).select("sid", "size", "_hash", "rate").withColumn("stand", _stand())
    plan = narrow_gaps(rows, find_cuts(rows, duals))
    known = materialize(plan.select("sid", F.col("size").alias("source_size"), "target", "mean", "lam", "cut", "ups", "downs"), "mix-plan")
    kept = F.struct(*keep).alias("_kept")
    out = keyed(sizes(docs.select(kept, "doc_id", "text", "source"))).drop("text")
    out = out.join(small(known, n), "sid").withColumn("rate", _rate()).withColumn("copies", _copies())
    return out.select("_kept.*", "size", "source_size", "target", "rate", "copies")
