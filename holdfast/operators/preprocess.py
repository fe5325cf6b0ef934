"""Imputation, scaling and encoding learned from training rows.

The fitted state is a table (feature_group, feature, param, position, number, text), one row per
learned value. Applying it is pure column expressions or, for models, a chain of built-in Spark
ML stages that can be saved and loaded without this package. Columns with very many categories
keep theirs in that table: rows find their slot by a join, and the vector is put together from
column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import scalars as fn
from holdfast.operators.ranking import ACCURACY, exact_medians, positions
from holdfast.session import written
from holdfast.spec import FeatureSpec

EPS = 2.220446049250313e-16
#: Categories of one column that the driver lists and a stage compares; those of a column with more stay in the params table.
MAX_CATEGORIES = 10_000
#: A dictionary of at most so many bytes goes to every task, a larger one is joined by shuffling.
DICTIONARY_BYTES = 64 << 20
#: Up to this many slots of a column are plain comparisons; more go through an index lookup.
PLAIN_SLOTS = 32


def numeric_params(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """feature, median, mean, std, n_missing: mean and population deviation *after* imputing.

    Moments of the imputed column follow from those of the values present and the median, so
    nothing has to be imputed to fit. NaN counts as missing. ``approx`` takes the median from a
    sketch instead of finding it exactly.
    """
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols])
    found = values.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(f"n_{c}") for c in cols],
        *[F.avg(F.col(c)).alias(f"m_{c}") for c in cols],
        *[F.var_pop(F.col(c)).alias(f"v_{c}") for c in cols],
    ).first()
    if approx:
        medians = values.agg(
            *[F.percentile_approx(F.col(c), 0.5, ACCURACY).alias(c) for c in cols]
        ).unpivot([], list(cols), "feature", "median")
    else:
        medians = exact_medians(values, {c: found[f"n_{c}"] for c in cols})
    # One row per column name.
    moments = df.sparkSession.createDataFrame(
        [(c, found["rows"], found[f"n_{c}"], found[f"m_{c}"], found[f"v_{c}"]) for c in cols],
        "feature string, rows long, k long, m double, v double",
    )
    rows, known = F.col("rows").cast("double"), F.col("k").cast("double")
    missing, step = rows - known, F.col("median") - F.col("m")
    mean = F.col("m") + step * missing / rows
    variance = F.col("v") * known / rows + step * step * (known / rows) * (missing / rows)
    # A column that only varies by rounding noise is constant and must not be blown up.
    noise = rows * F.lit(EPS) * variance + F.pow(rows * mean * F.lit(EPS), 2.0)
    std = F.when(variance <= noise, 1.0).otherwise(F.sqrt(variance))
    return moments.join(medians, "feature", "left").select(
        "feature", "median", mean.alias("mean"), std.alias("std"),
        (F.col("rows") - F.col("k")).alias("n_missing"),
    )


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, n) of all columns at once, nulls left out: one shuffle."""
    texts = df.select(*[F.expr(fn.category_text(c)).alias(c) for c in cols])
    long = texts.unpivot([], list(cols), "feature", "value").where("value is not null")
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def _value_order(df: DataFrame, cols: Sequence[str]) -> Column:
    """Sort key of a category text: numbers of numeric columns by size, text by code point."""
    numbers = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    return F.when(F.col("feature").isin(*numbers), F.col("value").try_cast("double"))


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, mode, n, unmapped_count: the most frequent value, the smallest one on ties, and
    how many rows hold a text that two-valued encoding does not know."""
    return _modes(_ordered_counts(df, cols))


def categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, position, value): the sorted distinct values of every column."""
    return _categories(written(_ordered_counts(df, cols), "category-counts"))


def _ordered_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return category_counts(df, cols).withColumn("o", _value_order(df, cols))


def _modes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "o", "value")).alias("best"),
        F.sum(F.when(fn.unmapped_flag("value"), F.col("n")).otherwise(0)).alias("unmapped_count"),
    ).select("feature", F.col("best.value").alias("mode"), (-F.col("best.n")).alias("n"), "unmapped_count")


def _categories(counts: DataFrame) -> DataFrame:
    return positions(counts, "feature", ["o", "value"]).select("feature", "position", "value")


def _param(param: str, position: str | None = None, number: str | None = None, text: str | None = None) -> Column:
    def value(name: str | None, default=None) -> Column:
        return F.lit(default) if name is None else F.col(name)

    return F.struct(
        F.lit(param).alias("param"), value(position, 0).cast("int").alias("position"),
        value(number).cast("double").alias("number"), value(text).cast("string").alias("text"),
    )


def fit_params(df: DataFrame, spec: FeatureSpec, approx: bool = False) -> DataFrame:
    """The params table learned from ``df`` (pass training rows only): one pass over the text
    columns, whose counts are written, and for the numeric ones one for the moments and those of
    the medians."""
    group = F.create_map(*[F.lit(x) for g, c in spec.groups for x in (c, g)])[F.col("feature")]
    parts = []
    if spec.numeric:
        stats = numeric_params(df, spec.numeric, approx)
        params = [_param(p, number=p) for p in ("median", "mean", "std", "n_missing")]
        parts.append(stats.select("feature", F.explode(F.array(*params)).alias("p")))
    if spec.binary or spec.categorical:
        counts = written(_ordered_counts(df, spec.binary + spec.categorical), "category-counts")
        unmapped = F.when(F.col("feature").isin(*spec.binary), _param("unmapped_count", number="unmapped_count"))
        both = F.array_compact(F.array(_param("mode", number="n", text="mode"), unmapped))
        parts.append(_modes(counts).select("feature", F.explode(both).alias("p")))
        if spec.categorical:
            slots = _categories(counts.where(F.col("feature").isin(*spec.categorical)))
            parts.append(slots.select("feature", _param("category", position="position", text="value").alias("p")))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.select(group.alias("feature_group"), "feature", "p.*")


def vector_entries(vector: Column) -> Column:
    """Entries of a vector that are not zero, as array<struct<i: int, x: double>>, without its zeros being made."""
    shape = "v struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
    got = F.from_json(F.to_json(F.struct(vector.alias("v"))), shape)["v"]
    index = F.coalesce(got["indices"], F.sequence(F.lit(0), F.size(got["values"]) - 1))
    return F.filter(F.arrays_zip(index.alias("i"), got["values"].alias("x")), lambda e: e["x"] != 0)


@dataclass(frozen=True)
class Dictionary:
    """All categories of a column: a table (value, position), how many, and about how many bytes."""

    table: DataFrame
    size: int
    bytes: int


@dataclass(frozen=True)
class FittedPreprocessor:
    """Params as plain values, and as tables where a column has very many categories. Columns without any training value are
    left out."""

    spec: FeatureSpec
    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    mode: dict[str, str] = field(default_factory=dict)
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    large: dict[str, Dictionary] = field(default_factory=dict)
    params: DataFrame | None = None

    @classmethod
    def from_params(cls, params: DataFrame, spec: FeatureSpec, listed: int | None = None) -> "FittedPreprocessor":
        """Works the table out once, writes it and reads three numbers per numeric column and the categories of columns that have
        at most ``listed`` (default MAX_CATEGORIES)."""
        listed = MAX_CATEGORIES if listed is None else listed
        params = written(params, "params")
        slots = params.where("param = 'category'").groupBy("feature").agg(
            F.count("*").alias("n"), F.sum(F.octet_length("text") + 16).alias("bytes"))
        sizes = {r["feature"]: (r["n"], r["bytes"]) for r in slots.collect()}
        many = [c for c in spec.categorical if sizes.get(c, (0, 0))[0] > listed]
        got = params.where((F.col("param") != "category") | ~F.col("feature").isin(*many)).collect()
        numbers = {(r["feature"], r["param"]): r["number"] for r in got}
        numeric = {
            c: tuple(numbers[c, p] for p in ("median", "mean", "std"))
            for c in spec.numeric
            if numbers.get((c, "median")) is not None
        }
        mode = {r["feature"]: r["text"] for r in got if r["param"] == "mode"}
        levels: dict[str, list] = {}
        for r in sorted((r for r in got if r["param"] == "category"), key=lambda r: r["position"]):
            levels.setdefault(r["feature"], []).append(r["text"])
        large = {}
        for c in many:
            table = params.where((F.col("param") == "category") & (F.col("feature") == c))
            large[c] = Dictionary(table.select(F.col("text").alias("value"), "position"), *sizes[c])
        return cls(spec, numeric, mode, {c: tuple(v) for c, v in levels.items()}, large, params)

    def kept_levels(self, col: str) -> tuple[str, ...]:
        """Categories that get a slot: of exactly two only the second, if the spec says so."""
        levels = self.levels.get(col, ())
        return levels[1:] if self.spec.drop_if_binary and len(levels) == 2 else levels

    def _listed(self, what: str) -> None:
        for c, d in self.large.items():
            raise ValueError(f"{c} has {d.size} categories, more than {what}")

    def feature_names(self) -> list[str]:
        """``group__column`` and ``group__column_value``, in vector order; ``schema_table`` has those of any number."""
        self._listed("a list of names should hold; take schema_table")
        spec = self.spec
        names = [f"{spec.numeric_prefix}__{c}" for c in spec.numeric if c in self.numeric]
        names += [f"{spec.binary_prefix}__{c}" for c in spec.binary if c in self.mode]
        names += [
            f"{spec.categorical_prefix}__{c}_{v}" for c in spec.categorical for v in self.kept_levels(c)
        ]
        return names

    def _scaled(self, col: str) -> str:
        median, mean, std = (fn.double(x) for x in self.numeric[col])
        value = f"coalesce(nanvl(cast({fn.quoted(col)} as double), null), {median})"
        return f"({value} - ({mean})) / {std}"

    def _filled(self, col: str) -> str:
        return f"coalesce({fn.category_text(col)}, {fn.text(self.mode[col])})"

    def _flag(self, col: str) -> str:
        trues = ", ".join(fn.text(t) for t in fn.TRUE_TEXTS)
        value = f"lower(btrim({self._filled(col)}, {fn.text(fn.WHITESPACE)}))"
        return f"cast({value} in ({trues}) as double)"

    def _slot(self, col: str, value: str) -> str:
        return f"cast({self._filled(col)} = {fn.text(value)} as double)"

    def _dense(self) -> list[tuple[str, str]]:
        """(name, SQL) of the numeric and two-valued features."""
        spec = self.spec
        return [
            (f"{spec.numeric_prefix}__{c}", self._scaled(c)) for c in spec.numeric if c in self.numeric
        ] + [(f"{spec.binary_prefix}__{c}", self._flag(c)) for c in spec.binary if c in self.mode]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """One double column per feature name; unseen categories are zero in every slot."""
        self._listed("a table has columns; take assemble")
        prefix = self.spec.categorical_prefix
        out = self._dense() + [
            (f"{prefix}__{c}_{v}", self._slot(c, v))
            for c in self.spec.categorical for v in self.kept_levels(c)
        ]
        return df.selectExpr(*[fn.quoted(c) for c in keep], *[f"{e} as {fn.quoted(n)}" for n, e in out])

    def stages(self, df: DataFrame, features: str = "features") -> list[Transformer]:
        """Built-in ML stages that append the vector ``features``.

        Short category lists become comparisons in generated code, long ones a hash lookup and a
        sparse block. ``df`` gives the schema only.
        """
        self._listed("stages hold; take assemble")
        spec, dense, indexed = self.spec, self._dense(), []
        # columns between the stages are numbered: names made of category texts could not be parsed
        inputs = [f"__f_{i}" for i in range(len(dense))]
        exprs = [f"{e} as {n}" for n, (_, e) in zip(inputs, dense)]
        for c in spec.categorical:
            kept = self.kept_levels(c)
            if not kept:
                continue
            name = f"__f_{len(inputs)}"
            if len(kept) <= PLAIN_SLOTS:
                names = [f"__f_{len(inputs) + i}" for i in range(len(kept))]
                exprs += [f"{self._slot(c, v)} as {n}" for n, v in zip(names, kept)]
                inputs += names
            else:
                exprs.append(f"concat('=', {self._filled(c)}) as text__{name}")
                indexed.append((name, kept))
                inputs.append(name)
        stages: list[Transformer] = [
            SQLTransformer(statement=f"select *, {', '.join(exprs)} from __THIS__")
        ]
        if indexed:
            stages += [
                StringIndexerModel.from_labels([f"={v}" for v in kept], f"text__{n}", f"index__{n}", "keep")  # never empty
                for n, kept in indexed
            ]
            # 'keep' adds one index for unseen values and dropLast leaves that slot out, so an
            # unseen value is zero in every slot. The encoder reads the sizes from metadata.
            encoder = OneHotEncoder(
                inputCols=[f"index__{n}" for n, _ in indexed], outputCols=[n for n, _ in indexed],
                dropLast=True,
            )
            stages.append(encoder.fit(PipelineModel(list(stages)).transform(df.limit(0))))
        stages.append(VectorAssembler(inputCols=inputs, outputCol=features))
        return stages

    def pipeline(self, df: DataFrame, features: str = "features") -> PipelineModel:
        return PipelineModel(self.stages(df, features))


    def _blocks(self) -> list[tuple[str, int]]:
        """(column, slots) in vector order."""
        spec = self.spec
        return [(c, 1) for c in spec.numeric if c in self.numeric] + [(c, 1) for c in spec.binary if c in self.mode] + [
            (c, self.large[c].size if c in self.large else len(self.kept_levels(c))) for c in spec.categorical]

    def lookup(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__slot_<i>``, the position of its category in each large column, null for unseen ones."""
        for i, (c, d) in enumerate(self.large.items()):
            side = d.table.select(F.col("value").alias("__value"), F.col("position").alias(f"__slot_{i}"))
            if d.bytes <= DICTIONARY_BYTES:
                side = F.broadcast(side)
            df = df.join(side, F.expr(self._filled(c)) == F.col("__value"), "left").drop("__value")
        return df

    def assemble(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with the vector ``features``, whatever the number of categories.

        Slots of large columns are added to the entries of the vector of all others by position; entries are the plain structure
        of a sparse vector, turned into one by way of JSON, the one built-in conversion there is. No slot is named.
        """
        if not self.large:
            return self.pipeline(df, features).transform(df)
        rest = replace(self, large={}, spec=replace(
            self.spec, categorical=tuple(c for c in self.spec.categorical if c not in self.large)))
        found = self.lookup(df)
        plain, width, small, shifts, slots = "__rest", 0, 0, [], {}
        for c, n in self._blocks():
            if c in self.large:
                slots[c] = width
                shifts.append((small, n))
            else:
                small += n
            width += n
        if small:
            found = rest.pipeline(found, plain).transform(found)
            entries = vector_entries(F.col(plain))

            def moved(e: Column) -> Column:
                i = e["i"]
                for start, n in shifts:
                    i = i + F.when(e["i"] >= start, n).otherwise(0)
                return F.struct(i.alias("i"), e["x"].alias("x"))

            parts = [F.transform(entries, moved)]
        else:
            parts = []
        for k, c in enumerate(self.large):
            here = F.struct((F.col(f"__slot_{k}") + slots[c]).cast("int").alias("i"), F.lit(1.0).alias("x"))
            parts.append(F.when(F.col(f"__slot_{k}").isNotNull(), F.array(here)).otherwise(
                F.array().cast("array<struct<i: int, x: double>>")))
        entries = F.array_sort(F.concat(*parts))
        sparse = F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"),
            F.transform(entries, lambda e: e["i"]).alias("indices"), F.transform(entries, lambda e: e["x"]).alias("values"))
        vector = F.from_json(F.to_json(F.struct(sparse.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))["v"]
        return found.select(*[fn.quoted(c) for c in df.columns], vector.alias(features))


def fit_preprocessor(
    train: DataFrame, spec: FeatureSpec, approx: bool = False, listed: int | None = None,
) -> FittedPreprocessor:
    return FittedPreprocessor.from_params(fit_params(train, spec, approx), spec, listed)


def schema_table(fitted: FittedPreprocessor, df: DataFrame) -> DataFrame:
    """(position, feature_group, input_feature, transformed_feature) of the fitted encoder."""
    spec, rows, tables, at = fitted.spec, [], [], 0
    shape = "position int, feature_group string, input_feature string, transformed_feature string"
    for group, c in spec.groups:
        categorical = group == spec.categorical_prefix and c in spec.categorical
        if categorical and c in fitted.large:
            name = F.concat(F.lit(f"{group}__{c}_"), "value")
            tables.append(fitted.large[c].table.select(
                (F.col("position") + at).cast("int").alias("position"), F.lit(group).alias("feature_group"),
                F.lit(c).alias("input_feature"), name.alias("transformed_feature")))
            at += fitted.large[c].size
        elif categorical:
            rows += [(at + i, group, c, f"{group}__{c}_{v}") for i, v in enumerate(fitted.kept_levels(c))]
            at += len(fitted.kept_levels(c))
        elif c in fitted.numeric or c in fitted.mode:
            rows.append((at, group, c, f"{group}__{c}"))
            at += 1
    out = df.sparkSession.createDataFrame(rows, shape)
    for table in tables:
        out = out.unionByName(table)
    return out
