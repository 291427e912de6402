"""Split scores and best thresholds of labelled values, for many nodes at once.

Input: samples (node, label, val). Everything starts from counts by (node, val, label), so repeated values and labels
are folded before anything is dealt out. Running counts are prefix sums over ranges of values: a node with more than
RANGE_ROWS counts is cut at quantiles of its distinct counts (a summary that tasks merge), so that values which are
nearly all in one place spread as evenly as others; each range begins at the sums of those before it, carried over as one
row a range and label. Smaller nodes are one range and carry nothing. The summary depends on the order in which rows
arrive, so the cuts are written once: every part of a plan that deals rows to ranges reads the same ones.

Degenerate splits (nothing on one side) score null. Rows with a null or NaN value or a null label are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

RANGE_ROWS, RANGES = 10_000, 256
METHODS = ("Sc", "MutualInformation", "Entropy", "Balanced", "Mean", "ScWithError")


def checked(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    return method


def part(count: Column, total: Column) -> Column:
    """-p log2 p of p = count / total; 0 for 0."""
    p = count.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    return F.when(count > 0, -p * F.log2(p)).otherwise(0.0)


def _clean(samples: DataFrame) -> DataFrame:
    return samples.where("val is not null and label is not null and not isnan(val)")


def split_counts(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """node, label, left (val <= threshold), right; ``thresholds``: node, threshold, one a node."""
    return _clean(samples).join(thresholds, "node").groupBy("node", "label").agg(F.count_if(F.col("val") <= F.col("threshold")).alias("left"), F.count_if(F.col("val") > F.col("threshold")).alias("right"))


def split_scores(counts: DataFrame, method: str, *keys: str) -> DataFrame:
    """``keys`` (node by default) and score of counts (label, left, right)."""
    keys = keys or ("node",)
    n = [F.sum("left").over(Window.partitionBy(*keys)).alias("nl"), F.sum("right").over(Window.partitionBy(*keys)).alias("nr")]
    rows = counts.select(*keys, "label", "left", "right", *n).withColumn("n", F.col("nl") + F.col("nr"))
    both = F.col("left") + F.col("right")
    joint = F.sum(part(F.col("left"), F.col("n")) + part(F.col("right"), F.col("n")))
    sums = rows.groupBy(*keys).agg(F.sum(part(both, F.col("n"))).alias("hc"), joint.alias("hct"), F.first("nl").alias("nl"), F.first("nr").alias("nr"), F.first("n").alias("n"))
    ht = part(F.col("nl"), F.col("n")) + part(F.col("nr"), F.col("n"))
    mi = F.col("hc") + ht - F.col("hct")
    if method == "ScWithError":
        raise ValueError("ScWithError depends on the order of the values: evaluated() and best_threshold() have it")
    if checked(method) == "Sc":
        score = 2 * mi / F.nullif(F.col("hc") + ht, F.lit(0.0))
    elif method == "MutualInformation":
        score = mi
    elif method == "Entropy":  # of each side's parts over the whole count
        score = F.col("hct")
    else:
        score = F.lit(0.0)
    return sums.select(*keys, F.when((F.col("nl") > 0) & (F.col("nr") > 0), score).alias("score"))


def _running(samples: DataFrame, range_rows: int | None = None) -> DataFrame:
    """node, range, many (ranges of the node), val, label, c (rows), and before them, in the order of values and labels:
    l rows of the label, nth rows; t and n: all rows of the label and the node. Dealt by (node, range)."""
    counts = _clean(samples).groupBy("node", "val", "label").agg(F.count("*").alias("c"))
    cuts = F.percentile_approx(F.col("val").cast("double"), [i / RANGES for i in range(1, RANGES)], RANGES * 40)
    large = counts.groupBy("node").agg(F.count("*").alias("rows"), F.sum("c").alias("all"), cuts.alias("q")).where(F.col("rows") > (RANGE_ROWS if range_rows is None else range_rows))
    large = written(large.select("node", F.array_distinct("q").alias("cuts")))
    # a value that is a cut ends its range
    at = F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("val").cast("double"))), F.lit(0))
    rows = counts.join(large, "node", "left").select("node", at.alias("range"), F.coalesce(F.size("cuts"), F.lit(0)).alias("many"), "val", "label", "c").repartition("node", "range")
    by_label, of_range = Window.partitionBy("node", "range", "label"), Window.partitionBy("node", "range")
    upto = (Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("c").over(by_label.orderBy("val").rowsBetween(*upto)), F.lit(0))
    nth = F.coalesce(F.sum("c").over(of_range.orderBy("val", "label").rowsBetween(*upto)), F.lit(0))
    rows = rows.withColumns({"l": own, "nth": nth, "t": F.sum("c").over(by_label), "n": F.sum("c").over(of_range)})
    # what is carried over: of large nodes only, a row for each range and label
    carried = rows.where("many > 0").groupBy("node", "range", "label").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("node", "label").orderBy("range")
    labels = carried.select("node", "range", "label", F.coalesce(F.sum("c").over(order.rowsBetween(*upto)), F.lit(0)).alias("l0"), F.sum("c").over(Window.partitionBy("node", "label")).alias("all_t"))
    ranges = carried.groupBy("node", "range").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("node").orderBy("range")
    ranges = ranges.select("node", "range", F.coalesce(F.sum("c").over(order.rowsBetween(*upto)), F.lit(0)).alias("n0"), F.sum("c").over(Window.partitionBy("node")).alias("all_n"))
    joined = rows.join(labels, ["node", "range", "label"], "left").join(ranges, ["node", "range"], "left")
    return joined.select(
        "node", "range", "many", "val", "label", "c", (F.col("l") + F.coalesce("l0", F.lit(0))).alias("l"), (F.col("nth") + F.coalesce("n0", F.lit(0))).alias("nth"),
        F.coalesce("all_t", "t").alias("t"), F.coalesce("all_n", "n").alias("n"),
    )


def _carried(steps: DataFrame, *sums: str) -> DataFrame:
    """``steps`` (node, range, many, val, further columns), with ``before_<c>``: the sum of each c over the ranges before, ``all_<c>``: over the
    node, and ``after``: the first value of the next range."""
    of_range = Window.partitionBy("node", "range")
    steps = steps.withColumns({f"all_{c}": F.sum(c).over(of_range) for c in sums})
    totals = steps.where("many > 0").groupBy("node", "range").agg(F.min("val").alias("first"), *(F.sum(c).alias(c) for c in sums))
    node = Window.partitionBy("node")
    order = node.orderBy("range")
    totals = totals.select("node", "range", F.lead("first").over(order).alias("after"), *(F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"before_{c}") for c in sums), *(F.sum(c).over(node).alias(f"node_{c}") for c in sums))
    joined = steps.join(totals, ["node", "range"], "left")
    return joined.withColumns({f"before_{c}": F.coalesce(f"before_{c}", F.lit(0.0)) for c in sums} | {f"all_{c}": F.coalesce(f"node_{c}", f"all_{c}") for c in sums})


def steps_with_error(samples: DataFrame, right: int, range_rows: int | None = None) -> DataFrame:
    """node, range, many, val, label, c, l, nth, t, n of the values' counts (see ``_running``), and step: what they add to
    the sum that ScWithError takes for the common information; ``right``: how often the values count on the right at first.

    The criterion is known to be wrong (a value changes its own label's terms only), but gives usable splits. With l of
    L values on the left of the value's label, r of R on the right, a step is h(l, L) + h(r, R) - h(l + 1, L + 1)
    - h(r - 1, R - 1), h(a, b) = -a / n log2(a / b). The steps of equal values and labels meet, so that only their ends
    count, and are taken at once.
    """
    rows = _running(samples, range_rows)
    return rows.withColumn("step", _gain(right, F.lit(0)) - _gain(right, F.col("c")))


def _gain(right: int, more: Column) -> Column:
    """h(l, L) + h(r, R) of a value's label when ``more`` of its equal values have gone to the left."""
    h = lambda a, b: F.when(a > 0, -a / F.col("n") * F.log2(a / b)).otherwise(0.0)
    return h(F.col("l") + more, F.col("nth") + more) + h(F.col("t") - F.col("l") - more, right * F.col("n") - F.col("nth") - more)


def _halves(left: Column, right: Column, n: Column) -> Column:
    """Entropy of the two sides, of counts that need not add up to n; 0 if one is empty."""
    h = lambda a: -a / n * F.log2(a / n)
    return F.when((left > 0) & (right > 0), h(left) + h(right)).otherwise(0.0)


def _with_error(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """ScWithError of given thresholds: the class entropy counts as 0, the right side's values twice."""
    rows = steps_with_error(samples, 2).join(thresholds, "node")
    there = F.col("val") <= F.col("threshold")
    left = rows.groupBy("node").agg(F.sum(F.when(there, F.col("step"))).alias("i"), F.sum(F.when(there, F.col("c")).otherwise(0)).alias("left"), F.first("n").alias("n"))
    score = 2 * F.col("i") / F.nullif(_halves(F.col("left"), 2 * F.col("n") - F.col("left"), F.col("n")), F.lit(0.0))
    return left.select("node", F.when((F.col("left") > 0) & (F.col("left") < F.col("n")), score).alias("score"))


def _best_with_error(samples: DataFrame, range_rows: int | None = None) -> DataFrame:
    """Every place between two rows is tried, those between equal values and labels too: the counts unfold in their task."""
    rows = steps_with_error(samples, 1, range_rows).withColumn("share", part(F.col("t"), F.col("n")) * F.col("c") / F.col("t"))
    rows = _carried(rows, "step", "share")
    run = Window.partitionBy("node", "range").orderBy("val", "label")
    before = F.coalesce(F.sum("step").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumns({"i0": F.col("before_step") + before, "next": F.coalesce(F.lead("val").over(run), F.col("after"))})
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))))
    left = F.col("nth") + F.col("k")
    i = F.col("i0") + _gain(1, F.lit(0)) - _gain(1, F.col("k"))
    score = F.round(2 * i / F.nullif(F.col("all_share") + _halves(left, F.col("n") - left, F.col("n")), F.lit(0.0)), 12)
    val = F.col("val").cast("double")
    threshold = F.when((F.col("k") < F.col("c")) | F.col("next").isNull(), val).otherwise((val + F.col("next")) / 2)
    rows = rows.select("node", score.alias("score"), threshold.alias("threshold"), left.alias("left")).where("score > 0")
    best = rows.groupBy("node").agg(F.max_by(F.struct("threshold", "score"), F.struct("score", -F.col("left"))).alias("b"))
    return best.select("node", "b.threshold", "b.score")


def roulette(draws: DataFrame, values: DataFrame, most: int | None = None) -> DataFrame:
    """``draws`` (id, u in 0 .. 1) with ``choice``: the first id of ``values`` (id, value: small) whose running sum of
    squared values, negative ones read as 0, reaches u times their sum, over the first ``most`` of them."""
    square = F.pow(F.greatest(F.col("value"), F.lit(0.0)), 2)
    order = Window.orderBy("id")  # one number a direction
    wheel = values.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most) if most else values
    wheel = wheel.select("id", F.sum(square).over(order).alias("upto"))
    slots = wheel.agg(F.array_sort(F.collect_list(F.struct(F.col("upto"), F.col("id")))).alias("slots"), F.max("upto").alias("total"))
    hit = F.filter("slots", lambda s: s.upto >= F.col("u") * F.col("total"))
    return draws.join(F.broadcast(slots)).select("id", "u", F.get(hit, F.lit(0)).id.alias("choice"))


def evaluated(samples: DataFrame, thresholds: DataFrame, method: str) -> DataFrame:
    """node, score of a given threshold for each node."""
    if method == "ScWithError":
        return _with_error(samples, thresholds)
    return split_scores(split_counts(samples, thresholds), method)


def candidates(samples: DataFrame, range_rows: int | None = None) -> DataFrame:
    """node, val, next, c, n, nl, hc, hct of each distinct value: the split after it, ``next`` the value that follows, c
    its rows, nl those up to it; hc the entropy of the labels, hct that of label and side."""
    rows = _running(samples, range_rows)
    after, before = F.col("l") + F.col("c"), F.col("l")
    side = lambda left: part(left, F.col("n")) + part(F.col("t") - left, F.col("n"))
    steps = rows.select("node", "range", "many", "val", "c", "nth", "n", (side(after) - side(before)).alias("dh"), (part(F.col("t"), F.col("n")) * F.col("c") / F.col("t")).alias("share"))
    # the rows are dealt by (node, range) already: nothing moves
    steps = steps.groupBy("node", "range", "many", "val").agg(F.sum("dh").alias("dh"), F.sum("share").alias("share"), F.sum("c").alias("c"), F.min("nth").alias("nth"), F.first("n").alias("n"))
    steps = _carried(steps, "dh", "share")
    run = Window.partitionBy("node", "range").orderBy("val")
    upto = F.sum("dh").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.select("node", "val", F.coalesce(F.lead("val").over(run), F.col("after")).alias("next"), "c", "n", (F.col("nth") + F.col("c")).alias("nl"), F.col("all_share").alias("hc"), (F.col("all_share") + F.col("before_dh") + upto).alias("hct"))


def best_threshold(samples: DataFrame, method: str = "Sc", range_rows: int | None = None) -> DataFrame:
    """node, threshold, score: the best split between distinct neighbours (its midpoint); the smallest on ties.

    Entropy may also split after the last value (threshold: that value). Balanced takes the middle of the values at
    ranks n/2 and n/2 + 1 (of fewer than 3, of what there is), Mean the mean; both score the population variance.
    A node without a split of positive score has no row. ScWithError (see ``steps_with_error``) may split within equal
    values, which go by label; its threshold after the last value is that value. ``range_rows``: counts in a range.
    """
    checked(method)
    if method == "ScWithError":
        return _best_with_error(samples, range_rows)
    if method == "Mean":
        return _clean(samples).groupBy("node").agg(F.avg(F.col("val").cast("double")).alias("threshold"), F.var_pop(F.col("val").cast("double")).alias("score"))
    if method == "Balanced":
        rank = candidates(samples, range_rows)
        low, high = F.least(F.floor(F.col("n") / 2), F.col("n") - 1), F.least(F.floor(F.col("n") / 2) + 1, F.col("n") - 1)
        held = lambda r: (F.col("nl") > r) & (F.col("nl") - F.col("c") <= r)
        middle = rank.groupBy("node").agg(F.max(F.when(held(low), F.col("val").cast("double"))).alias("a"), F.max(F.when(held(high), F.col("val").cast("double"))).alias("b"))
        spread = _clean(samples).groupBy("node").agg(F.var_pop(F.col("val").cast("double")).alias("score"))
        return middle.join(spread, "node").select("node", ((F.col("a") + F.col("b")) / 2).alias("threshold"), "score")
    ht = part(F.col("nl"), F.col("n")) + part(F.col("n") - F.col("nl"), F.col("n"))
    mi = F.col("hc") + ht - F.col("hct")
    score = {"MutualInformation": mi, "Entropy": F.col("hct")}.get(method, 2 * mi / F.nullif(F.col("hc") + ht, F.lit(0.0)))
    rows = candidates(samples, range_rows).withColumn("score", F.round(score, 12))
    rows = rows.where("score > 0") if method == "Entropy" else rows.where("next is not null and score > 0")
    rows = rows.withColumn("threshold", F.when(F.col("next").isNull(), F.col("val").cast("double")).otherwise((F.col("val").cast("double") + F.col("next")) / 2))
    best = rows.groupBy("node").agg(F.max_by(F.struct("threshold", "score"), F.struct(F.col("score"), -F.col("val"))).alias("b"))
    return best.select("node", "b.threshold", "b.score")
