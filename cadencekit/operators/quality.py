"""Reports: tick counters, exact tails, pair structure, acceptance windows and losses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadencekit.functions.costs import costs_fit
from cadencekit.operators.ordered import Ordered, Running, join_on, ordered
from cadencekit.operators.rates import median_upper, nearest_rank
from cadencekit.session import materialise

# Sample counts, loss limits and ages.
WARMUPS, MIN_COSTS, STEADY_COSTS, COST_ROWS = 2, 6, 16, 32
VIDEO_LOSS_LIMIT, AUDIO_LOSS_LIMIT = 5, 0
INGRESS_ROWS, INGRESS_AGE_S = 10, 0.25
PART_SHARE, BATCH_SHARE = 0.9, 1.5
PUBLISH_EVERY_US = 120_000


# Position of a tail in n sorted values, counted from 0.  The three are not the same.
RANKS: dict[str, Callable[[Column], Column]] = {
    "floor_n": lambda n: F.least(n - 1, F.floor(n * F.lit(0.95))),
    "floor_n_minus_1": lambda n: F.floor((n - 1) * F.lit(0.95)),
    "ceil_n_minus_1": lambda n: F.ceil(n * F.lit(0.95)) - 1,
}


def exact_tail(df: DataFrame, keys: Sequence[str], value: str, rank: str = "floor_n",
               out: str = "p95") -> DataFrame:
    """Exact nearest-rank tail and row count per key, without gathering a key's values.

    Equal values are counted together first; ranks then run over the distinct values, which stay
    parallel even for one huge key.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    s = ordered(counted, keys, [value]).running(_upto=Running("sum", F.col("_n")))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("n"))
    ranked = join_on(s.done(), totals, keys).withColumn("_rank", RANKS[rank](F.col("n")))
    hit = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
    return ranked.filter(hit).select(*keys, F.col(value).alias(out), "n")


def selected_tails(df: DataFrame, keys: Sequence[str], value: str, ranks: Sequence[str] = tuple(RANKS),
                   spread: float = 0.001, accuracy: int = 10_000) -> DataFrame:
    """Exact nearest-rank tails ``p95_<rank>`` and row count per key, for few keys with very many different values.

    A mergeable sketch first gives each key two values around its tail.  A second scan counts the rows below them and shuffles only the
    counts of the values in between, about ``2 * spread`` of the rows; the exact elements come from there.  Keys whose tail
    lies outside, which a sketch can't rule out, go through ``exact_tail``.  Null values don't count.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, value)
    tails = F.array(F.lit(0.95 - spread), F.lit(0.95 + spread))
    around = materialise(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, tails, accuracy).alias("_around")))
    near = join_on(known, around, keys).filter(F.col(value) <= F.col("_around")[1])
    # All that lies below counts under null, which sorts first.
    counted = (near.groupBy(*keys, F.when(F.col(value) >= F.col("_around")[0], F.col(value)).alias("_value"))
               .agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("_n")))
    s = ordered(counted, keys, ["_value"]).running(_upto=Running("sum", F.col("_n"))).done()

    def hit(rank: str) -> Column:
        at = RANKS[rank](F.col("n"))
        return F.col("_value").isNotNull() & (at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_n"))

    found = materialise(s.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(hit(r), F.col("_value"))).alias(f"p95_{r}") for r in ranks]))
    missed = found.filter(" or ".join(f"p95_{r} is null" for r in ranks)).select(*keys)
    if missed.isEmpty():
        return found
    again = join_on(known, missed, keys, "left_semi")
    exact = missed
    for r in ranks:
        tail = exact_tail(again, keys, value, r, f"p95_{r}")
        exact = join_on(exact, tail.drop("n") if r != ranks[0] else tail, keys)
    return join_on(found, missed, keys, "left_anti").unionByName(exact)


def tick_counters(df: DataFrame, keys: Sequence[str], tick: Column, kind: str,
                  kinds: Sequence[str], elapsed_s: Column) -> DataFrame:
    """Counts per tick and kind, and each as a whole rate over the time that really passed."""
    counts = {k: F.count_if(F.col(kind) == k) for k in kinds}
    out = df.groupBy(*keys, tick.alias("tick")).agg(
        *[c.alias(f"n_{k}") for k, c in counts.items()], elapsed_s.alias("elapsed_s"))
    rate = lambda k: F.when(F.col("elapsed_s") > 0, F.round(F.col(f"n_{k}") / F.col("elapsed_s")))
    return out.withColumns({f"fps_{k}": rate(k).cast("long") for k in kinds})


def cost_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and tail (rank ``floor(0.95 n)``) of processing times per key."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return join_on(means, exact_tail(df, keys, value, "floor_n"), keys)


def interval_p95(s: Ordered, time: str, rows: int = 120, within: Sequence[str] = ()) -> Ordered:
    """Tail of the last presentation intervals; 0 before the first, times going back are skipped."""
    s = s.running(_top=Running("max", F.when(F.col(time) > 0, F.col(time)), inclusive=False))
    step = F.when((F.col("_top").isNotNull()) & (F.col(time) > F.col("_top")), F.col(time) - F.col("_top"))
    s = s.withColumn("interval", step)
    # Count only real intervals, so that skipped rows do not push older ones out of the frame.
    s = s.running(_nth=Running("count", F.col("interval")))
    s = s.trailing_span("_nth", rows, within, peers=False, _list=lambda w: F.collect_list("interval").over(w))
    index = F.floor((F.size("_list") - 1) * F.lit(0.95)).cast("int")
    picked = F.when(F.size("_list") > 0, F.get(F.array_sort("_list"), index)).otherwise(0)
    return s.withColumn("interval_p95", picked).drop("_top", "_nth", "_list")


def acceptance_p95(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Tail used by acceptance gates (rank ``ceil(0.95 n) - 1``)."""
    return exact_tail(df, keys, value, "ceil_n_minus_1")


def pair_structure(df: DataFrame, keys: Sequence[str], time: str, generated: str,
                   phases: int = 2) -> DataFrame:
    """Verdict per source sequence: ``complete``, ``incomplete``, ``bad_order`` or ``no_endpoint``.

    Exactly one endpoint, the expected phases before it, all at different times.
    """
    made, end = F.col(generated), ~F.col(generated)
    out = df.groupBy(*keys).agg(
        F.count_if(end).alias("endpoints"), F.count_if(made).alias("generated"),
        F.count_distinct(F.when(made, F.col(time))).alias("_times"),
        F.max(F.when(made, F.col(time))).alias("_last"), F.max(F.when(end, F.col(time))).alias("_end"))
    in_order = (F.col("_times") == phases) & (F.col("_last") < F.col("_end"))
    verdict = (F.when(F.col("endpoints") == 0, "no_endpoint").when(F.col("endpoints") > 1, "bad_order")
               .when(F.col("generated") < phases, "incomplete").when(F.col("generated") > phases, "bad_order")
               .when(in_order, "complete").otherwise("bad_order"))
    return out.withColumn("verdict", verdict).drop("_times", "_last", "_end")


def distinct_presented(s: Ordered, seq: str = "seq") -> DataFrame:
    """Presented sources per key: a redraw or an older sequence does not count again."""
    s = s.running(_top=Running("max", F.col(seq), inclusive=False))
    fresh = F.col("_top").isNull() | (F.col(seq) > F.col("_top"))
    return s.done().groupBy(*s.keys).agg(
        F.count_if(fresh).alias("presented"), F.count_if(~fresh).alias("repeats"))


def presented_sketch(df: DataFrame, keys: Sequence[str], epoch: str, seq: str = "seq", lg_k: int = 12) -> DataFrame:
    """About how many distinct sources each key has presented, for tables too large to order.

    One sketch per key and epoch, of at most ``2^lg_k`` small counters whatever the rows, then their union per key.  A
    sequence counts once in each epoch.  ``estimate`` has a standard error of 1.04 / sqrt(2^lg_k), 1.6 % by default;
    small counts are exact.  Unlike ``distinct_presented``, an older sequence that is new counts too.
    """
    shown = F.struct(epoch, seq)
    known = df.filter(F.col(seq).isNotNull()).withColumn("_shown", F.xxhash64(shown))
    sketches = known.groupBy(*keys, epoch).agg(F.hll_sketch_agg("_shown", F.lit(lg_k)).alias("_sketch"))
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias("estimate"))


def acceptance(df: DataFrame, keys: Sequence[str], time: str, window: int, generated: str,
               interval: str, source_range: tuple[float, float], generated_range: tuple[float, float],
               output_range: tuple[float, float], p95_limit: float, seconds: float) -> DataFrame:
    """Verdict of each tumbling window: three rates inside their ranges and the tail under its limit."""
    ticked = df.withColumn("win", F.floor(F.col(time) / window).cast("long"))
    group = [*keys, "win"]
    counts = ticked.groupBy(*group).agg(
        (F.count_if(~F.col(generated)) / F.lit(seconds)).alias("source_fps"),
        (F.count_if(F.col(generated)) / F.lit(seconds)).alias("generated_fps"),
        (F.count("*") / F.lit(seconds)).alias("output_fps"))
    tails = acceptance_p95(ticked, group, interval).drop("n")
    out = join_on(counts, tails, group)
    ok = (F.col("source_fps").between(*source_range) & F.col("generated_fps").between(*generated_range)
          & F.col("output_fps").between(*output_range)
          & F.coalesce(F.col("p95") <= p95_limit, F.lit(False)))
    return out.withColumn("passed", ok)


def acceptance_gate(windows: DataFrame, keys: Sequence[str], need: int) -> DataFrame:
    """k-of-n gate over acceptance windows."""
    return windows.groupBy(*keys).agg(
        F.count_if("passed").alias("n_passed"), F.count("*").alias("n_windows"),
        (F.count_if("passed") >= need).alias("accepted"))


def ingress_health(s: Ordered, sample: str, end_s: Column, arrival: str = "arrival_s",
                   min_rows: int = INGRESS_ROWS, max_age_s: float = INGRESS_AGE_S) -> DataFrame:
    """Health of each ingress sample: enough rows, one generation and epoch, rising and fresh."""
    s = s.previous(_sample=F.col(sample), _pts=F.col("pts_ns"))
    step = F.when(F.col("_sample") == F.col(sample), F.col("pts_ns") - F.col("_pts"))
    out = s.withColumn("_step", step).done().groupBy(*s.keys, sample).agg(
        F.count("*").alias("n_rows"), F.count("pts_ns").alias("n_pts"),
        (F.max("generation") - F.min("generation")).alias("_g"),
        (F.max("epoch") - F.min("epoch")).alias("_e"),
        F.min("_step").alias("_step"), F.max(arrival).alias("last_arrival"))
    ok = ((F.col("n_rows") >= min_rows) & (F.col("n_pts") == F.col("n_rows")) & (F.col("_g") == 0)
          & (F.col("_e") == 0) & (F.col("_step") > 0) & (end_s - F.col("last_arrival") <= max_age_s))
    return out.withColumn("healthy", F.coalesce(ok, F.lit(False))).drop("_g", "_e", "_step")


def loss_summary(ledger: DataFrame, keys: Sequence[str], media: str = "media", status: str = "status") -> DataFrame:
    """Losses per session, and whether they call for an alert."""
    lost = F.col(status).isin("dropped", "failed")
    out = ledger.groupBy(*keys).agg(
        F.count_if(lost & (F.col(media) == "video")).alias("video_drops"),
        F.count_if(lost & (F.col(media) == "audio")).alias("audio_drops"))
    alert = (F.col("video_drops") > VIDEO_LOSS_LIMIT) | (F.col("audio_drops") > AUDIO_LOSS_LIMIT)
    return out.withColumn("alert", alert)


def reason_histogram(df: DataFrame, reason: str = "state_reason") -> DataFrame:
    return df.groupBy(reason).count()


def gated_cost(s: Ordered, cost: str, warmups: int = WARMUPS) -> Ordered:
    """Costs worth acting on: none below 6, the upper median below 16, then the tail of 32.

    ``estimate`` falls back to the tail of what there is.  Warm-up rows have neither.
    """
    s = s.number("_n")
    s = s.withColumn("_cost", F.when(F.col("_n") > warmups, F.col(cost)))
    s = s.trailing_rows(COST_ROWS, _list=lambda w: F.collect_list("_cost").over(w))
    values, size = F.col("_list"), F.size("_list")
    tail = F.when(size > 0, nearest_rank(values))
    admission = F.when(size >= STEADY_COSTS, tail).when(size >= MIN_COSTS, median_upper(values))
    return (s.withColumn("admission", admission).withColumn("estimate", F.coalesce(admission, tail))
            .withColumn("warm", F.col("_n") > warmups).drop("_n", "_cost", "_list"))


def over_budget(kind: Column, warm: Column, batch: Column, later: Column, endpoint: Column,
                known_batch: Column, known_later: Column, known_endpoint: Column, phases: Column,
                period: Column, slot: Column) -> Column:
    """Struct of overload verdicts of one finished command; warm-up rows are exempt, and a row without a slot
    has only the verdict on the period.

    ``batch``/``later``/``endpoint`` are sample-gated costs, the ``known`` ones estimates that count
    as 0 when missing.
    """
    count = F.size(phases)
    complete = (count > 0) & batch.isNotNull() & endpoint.isNotNull() & ((count <= 1) | later.isNotNull())
    pair = complete & (slot > 0) & ~costs_fit(batch, later, endpoint, phases, period)
    zero = F.lit(0.0)
    known = (F.coalesce(known_batch, zero) + F.coalesce(known_endpoint, zero)
             + F.greatest(count - 1, F.lit(0)) * F.coalesce(known_later, zero))
    whole = (period > 0) & (known > period)
    own = F.when(kind == "batch", batch).when(kind == "later", later).otherwise(endpoint)
    limit = slot * F.when(kind == "batch", BATCH_SHARE).otherwise(PART_SHARE)
    single = (slot > 0) & (F.coalesce(own, zero) > limit)
    false = F.lit(False)
    return F.struct(
        F.coalesce(warm & pair, false).alias("pair"), F.coalesce(warm & whole, false).alias("whole"),
        F.coalesce(warm & single, false).alias("single"))


def level_peak(df: DataFrame, keys: Sequence[str], time_us: str, level: str,
               every_us: int = PUBLISH_EVERY_US) -> DataFrame:
    """Peak level per publication slot on a fixed grid (``publish_peaks`` is the exact chain)."""
    slot = F.floor(F.col(time_us) / every_us).cast("long").alias("slot")
    return df.groupBy(*keys, slot).agg(F.max(level).alias("peak"))


def snapshot_rollup(df: DataFrame, keys: Sequence[str], visible: str, rates: Sequence[str]) -> DataFrame:
    """Number of visible snapshots per run and the span of each rate in them."""
    spans = [f(r).alias(f"{n}_{r}") for r in rates for n, f in (("min", F.min), ("max", F.max))]
    return df.filter(F.col(visible)).groupBy(*keys).agg(F.count("*").alias("n_visible"), *spans)


def reconcile(received: DataFrame, ledger: DataFrame, keys: Sequence[str], pts: str = "pts_ns") -> DataFrame:
    """Compare what came in with what the ledger accounts for; one row per session and time.

    ``balanced``: as many ledger entries as received rows, and under a single status.
    """
    group = [*keys, pts]
    came = received.groupBy(*group).agg(F.count("*").alias("n_received"))
    noted = ledger.groupBy(*group).agg(
        F.count("*").alias("n_noted"), F.min("status").alias("status"), F.max("status").alias("_other"))
    out = came.join(noted, group, "full_outer").fillna(0, ["n_received", "n_noted"])
    single = F.col("status").eqNullSafe(F.col("_other"))
    return (out.withColumn("balanced", (F.col("n_received") == F.col("n_noted")) & single)
            .withColumn("missing", F.col("n_noted") == 0).withColumn("unknown", F.col("n_received") == 0)
            .drop("_other"))


def ledger_diff(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of one ledger that the other lacks (with multiplicity), marked by side."""
    a, b = a.select(*columns), b.select(*columns)
    return (a.exceptAll(b).withColumn("side", F.lit("only_a"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b"))))


def ledger_common(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows both ledgers hold (with multiplicity); must be empty for disjoint outcomes."""
    return a.select(*columns).intersectAll(b.select(*columns))
