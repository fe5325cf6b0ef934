"""Exact, stratified, seeded splits that do not move a row.

Rows of a class are ordered by md5(id-seed), an order no partitioning can change. A split is
then three ranges of that order, so it is enough to find the two hash values at the cuts and
compare: finding them takes prefix histograms of the hash, assigning is a projection. With more
than a handful of classes, counts, sizes and cuts stay tables and the cuts are joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.operators.ranking import positions
from holdfast.session import written

TRAIN, VALIDATION, TEST = "train", "validation", "test"
SPLITS = (TRAIN, VALIDATION, TEST)

#: Hex digits of the hash added per histogram level: at most 4,096 buckets a class and level.
DIGITS = 3
#: A bucket below this many rows is ranked directly instead of being cut once more.
SMALL_BUCKET = 2_000_000
#: Up to this many classes the driver holds counts and cuts; the cuts of more are a table.
LISTED_CLASSES = 16
#: A table of cuts for at most so many classes goes to every task.
BROADCAST_CLASSES = 500_000


def split_key(id_col: str, seed: int, tie_cols: Sequence[str] = ()) -> Column:
    """Text whose order decides the split. ``tie_cols`` tell rows of one id apart."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
    if tie_cols:
        key = F.concat(key, F.md5(F.to_json(F.struct(*tie_cols))))
    return key


def check_ratios(*ratios: float) -> None:
    if not math.isclose(sum(ratios), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"ratios must sum to 1.0, got {sum(ratios)}")


def allocate(counts: Sequence[int], draws: int) -> list[int]:
    """``draws`` items over classes in proportion: largest remainder, ties to the lower class."""
    total = sum(counts)
    exact = [c / total * draws for c in counts]
    given = [math.floor(x) for x in exact]
    order = sorted(range(len(counts)), key=lambda i: (-(exact[i] - given[i]), i))
    for i in order[: draws - sum(given)]:
        given[i] += 1
    return given


def split_sizes(
    counts: Sequence[int], train: float, validation: float, test: float
) -> list[tuple[int, int, int]]:
    """(train, validation, test) rows of each class.

    The held-out part is rounded up, first test from all rows, then validation from the rest
    with its ratio rescaled. The double arithmetic is deliberate: 0.15 of what is left of 1,500
    rows comes to 225.00000000000003 and so to 226 rows.
    """
    n_test = math.ceil(sum(counts) * test)
    rest = allocate(counts, sum(counts) - n_test)
    n_validation = math.ceil(sum(rest) * (validation / (train + validation))) if validation else 0
    kept = allocate(rest, sum(rest) - n_validation)
    return [(k, r - k, c - r) for c, r, k in zip(counts, rest, kept)]


def _allocated(classes: DataFrame, counts: str, total: int, draws: int, name: str) -> DataFrame:
    """``classes`` with a column like ``allocate(counts, draws)``, in the order of ``cls``."""
    exact = F.col(counts).cast("double") / F.lit(float(total)) * F.lit(float(draws))
    given = classes.withColumns({"__floor": F.floor(exact), "__rest": F.floor(exact) - exact, "__all": F.lit("")})
    given = written(given, "split-sizes")
    left = draws - given.agg(F.sum("__floor")).first()[0]
    placed = positions(given, "__all", ["__rest", "cls"])
    more = F.when(F.col("position") < left, 1).otherwise(0)
    return placed.withColumn(name, F.col("__floor") + more).drop("__floor", "__rest", "__all", "position")


def size_table(classes: DataFrame, total: int, train: float, validation: float, test: float) -> DataFrame:
    """(cls, n, n_train, n_validation, n_test): ``split_sizes`` of any number of classes (cls, n)."""
    n_test = math.ceil(total * test)
    rest = _allocated(classes, "n", total, total - n_test, "rest")
    n_validation = math.ceil((total - n_test) * (validation / (train + validation))) if validation else 0
    kept = _allocated(rest, "rest", total - n_test, total - n_test - n_validation, "n_train")
    return written(kept.select(
        "cls", "n", "n_train", (F.col("rest") - F.col("n_train")).alias("n_validation"), (F.col("n") - F.col("rest")).alias("n_test"),
    ), "split-sizes")


@dataclass(frozen=True)
class SplitTable:
    """Fitted split of many classes: (cls, test_key, validation_key) and the sizes as tables."""

    id_col: str
    label: str
    seed: int
    tie_cols: tuple[str, ...]
    cuts: DataFrame
    sizes: DataFrame
    n_classes: int

    def assign(self, df: DataFrame, split: str = "split") -> DataFrame:
        """The table with its split column: a broadcast join, or for very many classes one that shuffles by class."""
        cuts = self.cuts.withColumnRenamed("cls", "__cls")
        if self.n_classes <= BROADCAST_CLASSES:
            cuts = F.broadcast(cuts)
        key = split_key(self.id_col, self.seed, self.tie_cols)
        part = F.when(key <= F.col("test_key"), TEST).when(key <= F.col("validation_key"), VALIDATION).otherwise(TRAIN)
        found = df.join(cuts, F.col(self.label) == F.col("__cls"), "left")
        return found.withColumn(split, F.when(F.col("__cls").isNotNull(), part)).drop("__cls", "test_key", "validation_key")


@dataclass(frozen=True)
class SplitCuts:
    """Fitted split: per class the last key of test and of validation ('' for an empty part)."""

    id_col: str
    label: str
    seed: int
    tie_cols: tuple[str, ...]
    cuts: tuple[tuple[object, str, str], ...]
    sizes: tuple[tuple[object, int, int, int], ...]

    def assign(self, df: DataFrame, split: str = "split") -> DataFrame:
        """The table with its split column. No shuffle, no second table."""
        key = split_key(self.id_col, self.seed, self.tie_cols)
        part = None
        for value, test_key, validation_key in self.cuts:
            here = (
                F.when(F.col("__key") <= test_key, TEST)
                .when(F.col("__key") <= validation_key, VALIDATION)
                .otherwise(TRAIN)
            )
            cond = F.col(self.label) == F.lit(value)
            part = F.when(cond, here) if part is None else part.when(cond, here)
        return df.withColumn("__key", key).withColumn(split, part).drop("__key")


def _bucket(width: int) -> Column:
    return F.substring("key", 1, width).alias("bucket")


def _nth_keys(keyed: DataFrame, hist: dict, targets: dict) -> dict:
    """{name: key} for targets {name: (class, n)}: the n-th smallest key of the class.

    ``hist`` maps (class, prefix) to counts. Each level keeps only the buckets that hold a cut
    (two per class at most) and counts them by a longer prefix; the last level ranks what is
    left. Every collect returns at most 4,096 rows per cut.
    """
    width = DIGITS
    found: dict = {}
    where = {name: (cls, "", n) for name, (cls, n) in targets.items() if n > 0}
    while where:
        for name, (cls, prefix, n) in where.items():
            for bucket, count in sorted(
                (b, c) for (k, b), c in hist.items() if k == cls and b.startswith(prefix)
            ):
                if n <= count:
                    where[name] = (cls, bucket, n)
                    break
                n -= count
        here = {(cls, bucket) for cls, bucket, _ in where.values()}
        pairs = None
        for cls, bucket in sorted(here, key=str):
            cond = (F.col("cls") == F.lit(cls)) & F.col("key").startswith(bucket)
            pairs = cond if pairs is None else pairs | cond
        rows = keyed.where(pairs)
        if width >= 5 * DIGITS or max(hist[c] for c in here) <= SMALL_BUCKET:
            return found | _rank_inside(rows, width, where)
        width += DIGITS
        counted = rows.groupBy("cls", _bucket(width)).count().collect()
        hist = {(r["cls"], r["bucket"]): r["count"] for r in counted}
    return found


def _rank_inside(rows: DataFrame, width: int, where: dict) -> dict:
    # Equal keys are counted before they are ranked: an id that repeats is one row here.
    counts = rows.groupBy("cls", _bucket(width), "key").count()
    upto = F.sum("count").over(W.partitionBy("cls", "bucket").orderBy("key"))
    ranked = counts.withColumn("upto", upto)
    picks = ranked.agg(
        *[
            F.min(F.when((F.col("cls") == F.lit(c)) & (F.col("bucket") == b) & (F.col("upto") >= n),
                         F.col("key"))).alias(f"k{i}")
            for i, (c, b, n) in enumerate(where.values())
        ]
    ).first()
    return {name: picks[f"k{i}"] for i, name in enumerate(where)}


def _cut_table(keyed: DataFrame, hist: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cls, test_key, validation_key): the n-th smallest keys of every class at once.

    Each level keeps the buckets that hold a cut and counts them by a longer prefix, at most 4,096 rows to a window; one number
    a level is collected, to tell whether the buckets are small enough to be ranked.
    """
    part = F.explode(F.array(
        F.struct(F.lit(TEST).alias("part"), F.col("n_test").alias("at")),
        F.struct(F.lit(VALIDATION).alias("part"), (F.col("n_test") + F.col("n_validation")).alias("at"))))
    spots = sizes.select("cls", part.alias("p")).select("cls", "p.part", "p.at", F.lit("").alias("above")).where("at > 0")
    width = DIGITS
    while True:
        above = F.substring("bucket", 1, width - DIGITS) if width > DIGITS else F.lit("")
        upto = F.sum("count").over(W.partitionBy("cls", "above").orderBy("bucket"))
        running = hist.withColumn("above", above).withColumn("upto", upto)
        inside = (F.col("at") > F.col("upto") - F.col("count")) & (F.col("at") <= F.col("upto"))
        met = spots.join(running, ["cls", "above"]).where(inside)
        rest = (F.col("at") - (F.col("upto") - F.col("count"))).alias("at")
        spots = written(met.select("cls", "part", rest, F.col("bucket").alias("above"), "count"), "split-cuts")
        buckets = spots.select("cls", F.col("above").alias("bucket")).distinct()
        here = keyed.withColumn("bucket", F.substring("key", 1, width)).join(buckets, ["cls", "bucket"], "left_semi")
        if width >= 5 * DIGITS or (spots.agg(F.max("count")).first()[0] or 0) <= SMALL_BUCKET:
            break
        width += DIGITS
        hist = written(here.groupBy("cls", _bucket(width)).count(), "split-counts")
        spots = spots.drop("count")
    counts = here.groupBy("cls", "bucket", "key").count()
    upto = F.sum("count").over(W.partitionBy("cls", "bucket").orderBy("key"))
    ranked = counts.withColumn("upto", upto).withColumnRenamed("bucket", "above").drop("count")
    found = spots.drop("count").join(ranked, ["cls", "above"]).where("upto >= at").groupBy("cls").agg(
        *[F.min(F.when(F.col("part") == p, F.col("key"))).alias(f"{p}_key") for p in (TEST, VALIDATION)])
    keys = [F.coalesce(f"{p}_key", F.lit("")).alias(f"{p}_key") for p in (TEST, VALIDATION)]
    return written(sizes.select("cls").join(found, "cls", "left").select("cls", *keys), "split-cuts")


def fit_splits(
    df: DataFrame, label: str, id_col: str, train: float = 0.6, validation: float = 0.2,
    test: float = 0.2, seed: int = 42, tie_cols: Sequence[str] = (),
) -> SplitCuts | SplitTable:
    """Find the cut keys; reads only the id and the label.

    Sizes are exact for unique ids. Of at most LISTED_CLASSES classes 4,096 counts each come to the driver; of more, a few
    totals. Rows that share an id (and all ``tie_cols``) stay together, since tearing them apart is the leak the split must
    avoid.
    """
    check_ratios(train, validation, test)
    keyed = df.select(F.col(label).alias("cls"), split_key(id_col, seed, tie_cols).alias("key"))
    counted = keyed.groupBy("cls", _bucket(DIGITS)).count()
    got = counted.limit((1 << 4 * DIGITS) * LISTED_CLASSES + 1).collect()
    hist = {(r["cls"], r["bucket"]): r["count"] for r in got}
    if any(cls is None or bucket is None for cls, bucket in hist):
        raise ValueError(f"{label} and {id_col} must not be null")
    if len({cls for cls, _ in hist}) > LISTED_CLASSES:
        return _fit_many(keyed, written(counted, "split-counts"), label, id_col, (train, validation, test), seed, tie_cols)
    classes = sorted({cls for cls, _ in hist})
    if not classes:
        raise ValueError("cannot split an empty table")
    counts = [sum(n for (c, _), n in hist.items() if c == cls) for cls in classes]
    if min(counts) < 2:
        raise ValueError(f"the least frequent class of {label} has fewer than 2 rows")
    sizes = split_sizes(counts, train, validation, test)
    targets = {}
    for cls, (_, n_validation, n_test) in zip(classes, sizes):
        targets[cls, TEST] = (cls, n_test)
        targets[cls, VALIDATION] = (cls, n_test + n_validation)
    keys = _nth_keys(keyed, hist, targets)
    return SplitCuts(
        id_col, label, seed, tuple(tie_cols),
        tuple((c, keys.get((c, TEST), ""), keys.get((c, VALIDATION), "")) for c in classes),
        tuple((c, *s) for c, s in zip(classes, sizes)),
    )


def _fit_many(keyed: DataFrame, hist: DataFrame, label: str, id_col: str, ratios: tuple[float, float, float], seed: int,
              tie_cols: Sequence[str]) -> SplitTable:
    classes = hist.groupBy("cls").agg(F.sum("count").alias("n"))
    nulls, n_classes, least, total = classes.agg(
        F.count_if(F.col("cls").isNull()), F.count("*"), F.min("n"), F.sum("n")).first()
    if nulls or hist.where("bucket is null").take(1):
        raise ValueError(f"{label} and {id_col} must not be null")
    if least < 2:
        raise ValueError(f"the least frequent class of {label} has fewer than 2 rows")
    sizes = size_table(classes, total, *ratios)
    return SplitTable(id_col, label, seed, tuple(tie_cols), _cut_table(keyed, hist, sizes), sizes, n_classes)


def stratified_split(
    df: DataFrame, label: str, id_col: str, train: float = 0.6, validation: float = 0.2,
    test: float = 0.2, seed: int = 42, tie_cols: Sequence[str] = (), split: str = "split",
) -> DataFrame:
    """The table with a column naming the split of each row."""
    return fit_splits(df, label, id_col, train, validation, test, seed, tie_cols).assign(df, split)


def early_stopping_indicator(
    df: DataFrame, label: str, id_col: str, fraction: float = 0.1, seed: int = 42,
    flag: str = "is_valid",
) -> DataFrame:
    """A boolean column that holds out a stratified ``fraction`` of the rows."""
    cuts = fit_splits(df, label, id_col, 1.0 - fraction, 0.0, fraction, seed)
    return cuts.assign(df, "__part").withColumn(flag, F.col("__part") == TEST).drop("__part")


_PAIRS = ((TRAIN, VALIDATION), (TRAIN, TEST), (VALIDATION, TEST))


def leakage_counts(df: DataFrame, id_col: str, split: str = "split") -> DataFrame:
    """One row: how many distinct ids each pair of splits shares."""
    seen = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        *[F.bool_or(F.col(split) == s).alias(s) for s in SPLITS]
    )
    return seen.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in _PAIRS])


def require_no_leakage(df: DataFrame, id_col: str, split: str = "split") -> DataFrame:
    """The same table, or an error naming the first pair of splits that share ids."""
    counts = leakage_counts(df, id_col, split).first()
    for a, b in _PAIRS:
        if counts[f"{a}_{b}"]:
            raise ValueError(f"{a}-{b} overlap: {counts[f'{a}_{b}']} ids")
    return df


def split_summary(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Per split its size, positives, positive rate in percent, and share of all rows in percent."""
    parts = df.groupBy(F.col(split).alias("split")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("long")).alias("n_positive"),
    )
    total = F.sum("n").over(W.partitionBy())  # a row per split
    n, positive = F.col("n").cast("double"), F.col("n_positive").cast("double")
    return parts.select(
        "split", "n", "n_positive",
        (positive / n * F.lit(100.0)).alias("positive_rate"),
        (n / total.cast("double") * F.lit(100.0)).alias("share"),
        total.alias("n_total"),
    )
