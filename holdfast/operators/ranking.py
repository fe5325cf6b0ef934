"""Running totals over a global order without a global sort, and exact medians.

``Window.orderBy(x)`` without keys moves every row to one task. Here the order is cut at
quantiles of the data, a window runs inside each bucket, and the bucket totals (at most a few
thousand rows whatever the input size) are summed up and joined back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows one bucket should hold; a table below it needs no cut at all.
ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 2048
#: Up to this many rows a median is found by ranking all of them.
RANK_DIRECTLY = 50_000
#: Rows a quantile sketch reads; of larger tables a sample. Sketches only place cuts and
#: brackets, whose results are exact wherever they fall.
SKETCH_ROWS = 4_000_000
#: Rank error of the median sketch is 1 / ACCURACY of the rows.
ACCURACY = 10_000


def _sample(rows: DataFrame, n: int, size: int) -> DataFrame:
    return rows if n <= size else rows.sample(size / n, seed=1)


def _array(values: Sequence[float]) -> Column:
    # One text literal, folded to one array by the optimizer: cheap for thousands of numbers.
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def order_edges(rows: DataFrame, order: str, rows_per_bucket: int | None = None) -> list[float]:
    """Values that cut ``rows`` into buckets of about ``rows_per_bucket`` rows.

    Quantiles, so the cut follows the data however it clusters, and a value held by a third of
    the rows costs only its own bucket. Large tables are sampled for it: the cut steers where
    rows are ranked, never which. Collected once (at most 2,047 numbers) and then used as
    literals: every branch and every re-run of a lost task sees the same edges.
    """
    size = rows_per_bucket or ROWS_PER_BUCKET
    n = rows.agg(F.count(order)).first()[0]
    if n <= size:
        return []
    buckets = min(MAX_BUCKETS, -(-n // size))
    points = ",".join(f"{i}D/{buckets}D" for i in range(1, buckets))
    sketch = F.expr(f"percentile_approx(`{order}`, array({points}), {4 * buckets + 100})")
    found = _sample(rows.select(order), n, max(5_000 * buckets, 100_000)).agg(sketch).first()[0]
    return sorted(set(found or []))


def _position(value: Column, edges: Sequence[float]) -> Column:
    """How many edges are <= value, by binary search over a constant array. Never null, so a
    join on it adds no filter that the optimizer could push down to the scan."""
    if not edges:
        return F.lit(0)
    known, size = _array(edges), len(edges)
    jumps = [1 << i for i in reversed(range(size.bit_length()))]

    def advance(pos: Column, jump: Column) -> Column:
        target = pos + jump
        return F.when((target <= size) & (F.get(known, target - 1) <= value), target).otherwise(pos)

    return F.coalesce(F.aggregate(F.array(*[F.lit(j) for j in jumps]), F.lit(0), advance), F.lit(0))


def running_totals(
    rows: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (),
    carry: Sequence[str] = (), lower: bool = False, edges: Sequence[float] | None = None,
) -> DataFrame:
    """Rows merged by (by, order), with cumulative sums in ascending ``order``.

    For each column c of ``sums`` the result holds c (sum over the merged rows), ``c_before``
    (sum over smaller values in the group) and ``c_total`` (sum over the group); columns of
    ``carry`` are merged only. ``lower`` adds ``c_lower``, c of the next smaller value.

    Single rows cross the network once, after equal values were merged on the map side; the
    bucket totals come from their own scan of the same few columns.
    """
    if edges is None:
        edges = order_edges(rows, order)
    merged = rows.groupBy(*by, order).agg(*[F.sum(c).alias(c) for c in (*sums, *carry)])
    key = F.struct(*by) if by else F.lit(0)
    out = [*by, order, *sums, *carry]
    if not edges:
        return _totals_in_one_bucket(merged.withColumn("__key", key), order, sums, out, lower)
    bucket = _position(F.col(order), edges)
    local = W.partitionBy("__key", "__bucket").orderBy(order)
    inside = local.rowsBetween(W.unboundedPreceding, -1)
    keyed = merged.withColumns({"__key": key, "__bucket": bucket})
    ranked = keyed.withColumns(
        {f"{c}__in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}
        | ({"__prev": F.lag(F.struct(*sums)).over(local)} if lower else {})
    )

    totals = rows.groupBy(key.alias("__key"), bucket.alias("__bucket")).agg(
        *[F.sum(c).alias(f"{c}__sum") for c in sums]
    )
    if lower:
        last = keyed.groupBy("__key", "__bucket").agg(
            F.max_by(F.struct(*sums), F.col(order)).alias("__last")
        )
        totals = totals.join(last, ["__key", "__bucket"])
    group = W.partitionBy("__key")
    so_far = group.orderBy("__bucket")
    before = so_far.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "__key", "__bucket",
        *[F.coalesce(F.sum(f"{c}__sum").over(before), F.lit(0)).alias(f"{c}__off") for c in sums],
        *[F.sum(f"{c}__sum").over(group).alias(f"{c}_total") for c in sums],
        *([F.lag("__last").over(so_far).alias("__below")] if lower else []),
    )
    # Without groups the offsets are at most 2,048 rows; with groups Spark decides by their size.
    joined = ranked.join(offsets if by else F.broadcast(offsets), ["__key", "__bucket"])
    out += [(F.col(f"{c}__off") + F.col(f"{c}__in")).alias(f"{c}_before") for c in sums]
    out += [f"{c}_total" for c in sums]
    if lower:
        below = F.coalesce(F.col("__prev"), F.col("__below"))
        out += [below[c].alias(f"{c}_lower") for c in sums]
    return joined.select(*out)


#: Values sampled for each cut of an order, and the characters of a value that a cut keeps.
PER_CUT, CUT_CHARS = 16, 256


def _quantile_cuts(rows: DataFrame, group: str, order: Sequence[str], buckets: dict[str, int], counts: dict[str, int]) -> DataFrame:
    """(group, cuts): sorted keys that cut each group's order into about ``buckets`` equal parts.

    A sample by hash, the same whenever it is drawn, is sorted per group (at most PER_CUT * MAX_BUCKETS keys), and every
    PER_CUT-th key is a cut. Quantiles follow the values, so neither a common beginning nor an outlier fills one bucket.
    """
    share = F.create_map(*[F.lit(x) for g, b in buckets.items() for x in (g, min(1.0, PER_CUT * b / counts[g]) if b > 1 else 0.0)])
    drawn = F.pmod(F.xxhash64(group, *order), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share[F.col(group)]
    key = F.struct(*[F.substring(c, 1, CUT_CHARS).alias(c) if dict(rows.dtypes)[c] == "string" else c for c in order])
    keys = rows.where(drawn).groupBy(group).agg(F.sort_array(F.collect_list(key)).alias("keys"))
    return keys.select(group, F.filter("keys", lambda x, i: (i > 0) & (i % PER_CUT == 0)).alias("cuts"))


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``position``: the place of a row, from 0, among those of its group in the order of ``order`` (unique in a
    group; nulls first). ``group`` has few values, such as column names. Read several times: pass a table.

    Groups of more than ROWS_PER_BUCKET rows are cut at quantiles of their order, so that no task sorts a whole group as long
    as values differ within their first CUT_CHARS characters.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}  # a row per group
    ascending = W.partitionBy(group).orderBy(*order)
    if max(counts.values(), default=0) <= ROWS_PER_BUCKET:
        return rows.withColumn("position", F.row_number().over(ascending) - 1)
    buckets = {g: min(MAX_BUCKETS, -(-n // ROWS_PER_BUCKET)) for g, n in counts.items()}
    cuts = _quantile_cuts(rows, group, order, buckets, counts)
    jumps = [1 << i for i in reversed(range((4 * MAX_BUCKETS).bit_length()))]
    key = F.struct(*order)

    def advance(pos: Column, jump: Column) -> Column:
        return F.when(F.get("cuts", pos + jump - 1) <= key, pos + jump).otherwise(pos)

    bucket = F.aggregate(F.array(*[F.lit(j) for j in jumps]), F.lit(0), advance)
    # Bounded: a row per group with some thousands of cuts, then a row per cut.
    placed = rows.join(F.broadcast(cuts), group, "left").withColumn("__bucket", F.coalesce(bucket, F.lit(0))).drop("cuts")
    sizes = placed.groupBy(group, "__bucket").agg(F.count("*").alias("__size"))
    before = W.partitionBy(group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(group, "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy(group, "__bucket").orderBy(*order)
    ranked = placed.withColumn("__rank", F.row_number().over(inside))
    place = (F.col("__before") + F.col("__rank") - 1).alias("position")
    return ranked.join(F.broadcast(offsets), [group, "__bucket"]).select(*rows.columns, place)


def _totals_in_one_bucket(
    merged: DataFrame, order: str, sums: Sequence[str], out: Sequence[str], lower: bool
) -> DataFrame:
    """The same columns for a table of at most ROWS_PER_BUCKET rows: one window per group."""
    group = W.partitionBy("__key")
    ascending = group.orderBy(order)
    before = ascending.rowsBetween(W.unboundedPreceding, -1)
    return merged.select(
        *out,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums],
        *[F.sum(c).over(group).alias(f"{c}_total") for c in sums],
        *([F.lag(c).over(ascending).alias(f"{c}_lower") for c in sums] if lower else []),
    )


def _brackets(values: DataFrame, counts: dict[str, int]) -> tuple[dict, dict, int]:
    """Per column a value range around its median and the number of smaller values; and the
    largest count inside a range. A range that misses is replaced by the whole column."""
    n = max(counts.values())
    share = min(1.0, SKETCH_ROWS / n)

    def sketch(c: str) -> Column:
        margin = 3.0 / ACCURACY
        if share < 1:  # six standard errors of a sampled rank
            margin += 3.0 / math.sqrt(max(1.0, counts[c] * share))
        return F.percentile_approx(F.col(c), [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)], ACCURACY)

    rough = _sample(values, n, SKETCH_ROWS).agg(*[sketch(c).alias(c) for c in counts]).first()
    ranges = {c: tuple(rough[c] or (-math.inf, math.inf)) for c in counts}
    found = values.agg(
        *[F.count_if(F.col(c) < lo).alias(f"b_{c}") for c, (lo, _) in ranges.items()],
        *[F.count_if(F.col(c).between(lo, hi)).alias(f"i_{c}") for c, (lo, hi) in ranges.items()],
    ).first()
    below, largest = {}, 0
    for c, total in counts.items():
        under, inside = found[f"b_{c}"], found[f"i_{c}"]
        if under > (total - 1) // 2 or under + inside <= total // 2:
            ranges[c], under, inside = (-math.inf, math.inf), 0, total
        below[c], largest = under, max(largest, inside)
    return ranges, below, largest


def exact_medians(values: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """(feature, median) of every double column, the two middle values averaged.

    A sketch gives a narrow range around each middle, one aggregate counts what lies below it,
    and only the values inside the range (under 1 % of the rows, equal ones merged) are shuffled
    and ranked. A small table is ranked as it is. Columns without values have no row.
    ``counts`` are the numbers of values, if known.
    """
    spark, cols = values.sparkSession, values.columns
    if counts is None:
        counts = values.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first().asDict()
    counts = {c: n for c, n in counts.items() if n}
    if not counts:
        return spark.createDataFrame([], "feature string, median double")
    below, largest = dict.fromkeys(counts, 0), max(counts.values())
    if largest > RANK_DIRECTLY:
        ranges, below, largest = _brackets(values.select(*counts), counts)
        values = values.select(
            *[F.when(F.col(c).between(*ranges[c]), F.col(c)).alias(c) for c in counts]
        )
    small = largest <= ROWS_PER_BUCKET
    rows = values.unpivot([], list(counts), "feature", "value").where("value is not null")
    ranked = running_totals(
        rows.withColumn("n", F.lit(1).cast("long")), "value", ("n",), ("feature",),
        edges=[] if small else None,
    )
    # One rank pair per column name.
    wanted = [(c, (n - 1) // 2 - below[c], n // 2 - below[c]) for c, n in counts.items()]
    ranks = F.broadcast(spark.createDataFrame(wanted, "feature string, low long, high long"))
    middle = ranked.join(ranks, "feature").where(
        (F.col("n_before") <= F.col("high")) & (F.col("n_before") + F.col("n") > F.col("low"))
    )
    return middle.groupBy("feature").agg(((F.min("value") + F.max("value")) / 2).alias("median"))
