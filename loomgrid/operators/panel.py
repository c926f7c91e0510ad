"""Panels: validation, frequency, aggregation, diagnostics and roll-ups.

A panel is a DataFrame with a series id, a time column (date or timestamp without zone) and a target; missing
targets are NaN or null.  Checks return the offending rows, so an empty result means a valid panel.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SINGLE = "__single__"
STEP_SECONDS = {"hourly": 3600, "daily": 86_400, "weekly": 7 * 86_400}


@dataclass(frozen=True)
class Panel:
    """Column names and roles of a panel; one role a covariate."""

    series: str = "series_id"
    ts: str = "ts"
    y: str = "y"
    freq: str = "daily"
    static: tuple[str, ...] = ()
    known_future: tuple[str, ...] = ()
    historical: tuple[str, ...] = ()
    allow_irregular: bool = False
    allow_missing_targets: bool = False
    allow_missing_covariates: bool = False
    covariates: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        names = (*self.static, *self.known_future, *self.historical)
        if len(set(names)) < len(names) or {self.series, self.ts, self.y} & set(names):
            raise ValueError("a covariate has one role, and its own name")
        if self.freq not in STEP_SECONDS:
            raise ValueError(f"frequency {self.freq}")
        object.__setattr__(self, "covariates", names)

    def window(self) -> W:
        return W.partitionBy(self.series).orderBy(self.ts)


def seconds(ts) -> Column:
    return F.unix_seconds((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def from_dataframe(df: DataFrame, p: Panel) -> DataFrame:
    """The panel's columns in their types; an empty or null id becomes the single series."""
    if missing := [c for c in (p.ts, p.y, *p.covariates) if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    series = F.col(p.series).cast("string") if p.series in df.columns else F.lit(None).cast("string")
    return df.select(F.when(F.coalesce(series, F.lit("")) == "", SINGLE).otherwise(series).alias(p.series), F.col(p.ts), *[F.col(c).cast("double").alias(c) for c in (p.y, *p.covariates)])


def not_finite(df: DataFrame, p: Panel) -> DataFrame:
    """Rows with infinite values, or missing ones that aren't allowed, in target or covariates."""
    bad = F.lit(False)
    for name, missing_ok in [(p.y, p.allow_missing_targets), *((c, p.allow_missing_covariates) for c in p.covariates)]:
        x = F.col(name)
        bad = bad | F.coalesce(F.abs(x) == float("inf"), F.lit(False))
        if not missing_ok:
            bad = bad | x.isNull() | F.isnan(x)
    return df.where(bad)


def duplicate_keys(df: DataFrame, p: Panel) -> DataFrame:
    return df.groupBy(p.series, p.ts).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def frequency_gaps(df: DataFrame, p: Panel) -> DataFrame:
    """Rows whose distance to the series' row before isn't one step."""
    gap = seconds(p.ts) - seconds(F.lag(p.ts).over(p.window()))
    return df.withColumn("gap_seconds", gap).where(F.col("gap_seconds") != STEP_SECONDS[p.freq]).select(p.series, p.ts, "gap_seconds")


def canonical(df: DataFrame, p: Panel) -> DataFrame:
    return df.orderBy(p.series, p.ts)


def validate(df: DataFrame, p: Panel) -> DataFrame:
    """The panel's rows; an error names the first check that finds something."""
    df = from_dataframe(df, p)
    checks = [("values that aren't finite", not_finite(df, p)), ("duplicate keys", duplicate_keys(df, p))]
    if not p.allow_irregular:
        checks.append(("irregular steps", frequency_gaps(df, p)))
    for what, rows in checks:
        if found := rows.take(1):
            raise ValueError(f"{what}: {found[0].asDict()}")
    return df


def observed(df: DataFrame, p: Panel) -> DataFrame:
    """Rows with a target; with each the last time of its series' full frame, the anchor of forecasts."""
    df = df.withColumn("anchor", F.max(p.ts).over(W.partitionBy(p.series)))
    return df.where(F.col(p.y).isNotNull() & ~F.isnan(p.y))


def unobserved_series(df: DataFrame, p: Panel) -> DataFrame:
    """Series without any target."""
    return df.select(p.series).distinct().join(observed(df, p).select(p.series).distinct(), p.series, "left_anti")


def is_panel(df: DataFrame, p: Panel) -> DataFrame:
    """One row: whether any series is named."""
    return df.agg(F.coalesce(F.max(F.col(p.series) != SINGLE), F.lit(False)).alias("is_panel"))


def infer_step(df: DataFrame, p: Panel) -> DataFrame:
    """(series, step_seconds): the most frequent step, the least of equally frequent ones."""
    steps = df.select(p.series, (seconds(p.ts) - seconds(F.lag(p.ts).over(p.window()))).alias("step")).where("step IS NOT NULL")
    counts = steps.groupBy(p.series, "step").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(p.series).agg(F.min_by("step", F.struct(-F.col("n"), F.col("step"))).alias("step_seconds"))


def advance(ts: Column, freq: str, k: Column) -> Column:
    """ts plus k steps; dates stay dates for daily and weekly steps."""
    if freq == "hourly":
        return ts + F.make_dt_interval(hours=k)
    return F.date_add(ts, (k * (7 if freq == "weekly" else 1)).cast("int"))


def future_index(df: DataFrame, p: Panel, horizon: int) -> DataFrame:
    """(series, horizon, ts): the next steps after each series' last time."""
    last = df.groupBy(p.series).agg(F.max(p.ts).alias("__last"))
    steps = last.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(p.series, "horizon", advance(F.col("__last"), p.freq, F.col("horizon")).alias(p.ts))


def check_weights(df: DataFrame, weight: str) -> DataFrame:
    """Rows whose weight is missing, negative or not finite."""
    w = F.col(weight)
    return df.where(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")))


def weighted_rows(df: DataFrame, p: Panel, weight: str) -> DataFrame:
    """One row a series and time: weighted means of target and covariates, and the weights' sum.

    Partial sums are combined before the shuffle, so a hot key costs one row a task.
    """
    w = F.col(weight)
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum(w)).alias(c)
    return df.where(w > 0).groupBy(p.series, p.ts).agg(*[mean(c) for c in (p.y, *p.covariates)], F.sum(w).alias(weight))


def series_diagnostics(df: DataFrame, p: Panel) -> DataFrame:
    """Counts, range, zero share, mean gap of non-zero rows and the longest zero run of each series."""
    w = p.window()
    zero = F.col(p.y) == 0
    rows = df.select(p.series, p.ts, p.y, zero.alias("z"), F.row_number().over(w).alias("i"))
    rows = rows.withColumn("island", F.when(F.col("z"), F.col("i") - F.sum(F.col("z").cast("int")).over(w)))
    runs = rows.where("z").groupBy(p.series, "island").agg(F.count(F.lit(1)).alias("run")).groupBy(p.series).agg(F.max("run").alias("longest_zero_run"))
    nz = F.when(~F.col("z"), F.col("i"))
    base = rows.groupBy(p.series).agg(
        F.count(F.lit(1)).alias("n"), F.min(p.ts).alias("first_ts"), F.max(p.ts).alias("last_ts"), F.min(p.y).alias("min_y"), F.max(p.y).alias("max_y"), F.avg(p.y).alias("mean_y"),
        F.sum(F.col("z").cast("long")).alias("zero_count"), F.count(nz).alias("k"), F.min(nz).alias("a"), F.max(nz).alias("b"),
    )
    out = base.join(runs, p.series, "left")
    frac = F.col("zero_count") / F.col("n")
    return out.select(
        p.series, "n", "first_ts", "last_ts", "min_y", "max_y", "mean_y", "zero_count", frac.alias("zero_fraction"),
        F.when(F.col("k") > 0, F.col("zero_count") / F.col("k")).alias("zero_ratio"),
        F.when(F.col("k") > 1, (F.col("b") - F.col("a")) / (F.col("k") - 1)).alias("mean_nonzero_gap"),
        F.coalesce("longest_zero_run", F.lit(0)).cast("long").alias("longest_zero_run"), (F.col("zero_count") > 0).alias("has_zeros"),
    )


def frame_diagnostics(df: DataFrame, p: Panel) -> DataFrame:
    """Totals over the series' diagnostics."""
    return series_diagnostics(df, p).agg(F.count(F.lit(1)).alias("series"), F.sum("n").alias("n_rows"), F.sum("zero_count").alias("zero_count"), F.max("longest_zero_run").alias("longest_zero_run"), (F.sum("zero_count") / F.sum("n")).alias("zero_fraction"))


def temporal_rollup(df: DataFrame, p: Panel, factor: int) -> DataFrame:
    """(series, block, y): sums of ``factor`` rows in order; series whose length the factor doesn't divide are absent."""
    rows = df.select(p.series, p.y, (F.row_number().over(p.window()) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy(p.series)).alias("n")).where(F.col("n") % factor == 0)
    return rows.groupBy(p.series, F.floor(F.col("i") / factor).alias("block")).agg(F.sum(p.y).alias(p.y))


def roles(p: Panel) -> list[tuple[str, str]]:
    """(covariate, role): static, known_future or historical; names and roles are checked when a panel is made."""
    return [(c, role) for role in ("static", "known_future", "historical") for c in getattr(p, role)]


def varying_statics(df: DataFrame, p: Panel) -> DataFrame:
    """(series, covariate, n): static covariates that have several values in a series."""
    counts = df.groupBy(p.series).agg(*[F.count_distinct(c).alias(c) for c in p.static])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).alias("n")) for c in p.static])).alias("x")
    return counts.select(p.series, pairs).select(p.series, "x.*").where("n > 1") if p.static else df.select(p.series, F.lit("").alias("covariate"), F.lit(0).cast("long").alias("n")).limit(0)


def missing_future(future: DataFrame, p: Panel) -> DataFrame:
    """(series, ts, covariate): known-future covariates that a future row lacks.  Historical ones aren't asked for; those
    that a future frame has anyway are an error."""
    if known := [c for c in p.historical if c in future.columns]:
        raise ValueError(f"historical covariates {known} aren't known ahead")
    if absent := [c for c in p.known_future if c not in future.columns]:
        raise ValueError(f"no columns {absent}")
    if not p.known_future:
        return future.select(p.series, p.ts, F.lit("").alias("covariate")).limit(0)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("bad")) for c in p.known_future])).alias("x")
    return future.select(p.series, p.ts, pairs).where("x.bad").select(p.series, p.ts, "x.covariate")
