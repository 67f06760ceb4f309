"""Named build steps run in name order, or a chosen subset in the given
order (S11), over the layered tables (S6, S7, S10). Each step is a DataFrame
plan written to its layer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from furlong.operators import latest, quality, serving, speed_index
from furlong.operators.form import empty_master
from furlong.sources import tables
from furlong.sources.landing import read_raw


@dataclass
class BuildContext:
    spark: SparkSession
    base: str                      # root of the layered tables
    params: dict = field(default_factory=dict)
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    figures: dict | None = None    # of the serving races, if this run wrote them

    def path(self, layer: str, table: str) -> str:
        return tables.layer_path(self.base, layer, table)

    def read(self, layer: str, table: str) -> DataFrame:
        return tables.read_table(self.spark, self.path(layer, table))

    def write(self, df: DataFrame, layer: str, table: str) -> None:
        """Replace a table and its view."""
        tables.replace_table(df, self.path(layer, table), f"{self.params.get('prefix', 'furlong')}_{layer}.{table}")


def step_create_layers(ctx: BuildContext) -> None:
    tables.create_layers(ctx.spark, ctx.base, ctx.params.get("prefix", "furlong"))
    # an empty master until the index is built, so that the analysis can read it
    tables.create_like(ctx.spark, empty_master(ctx.spark), ctx.path("ml", "speed_index_master"))


def step_build_serving_tables(ctx: BuildContext) -> None:
    spark = ctx.spark
    raw_root = tables.layer_path(ctx.base, "raw")
    ctx.write(latest.latest_races(read_raw(spark, raw_root, "RA")), "core", "ra_latest")
    ctx.write(latest.latest_entries(read_raw(spark, raw_root, "SE")), "core", "se_latest")
    results = ctx.read("raw", "race_results")
    ctx.write(serving.race_summary(results), "core", "race_summary_latest")
    ctx.write(serving.entry_fallback(results), "core", "entry_fallback_latest")
    races, seen = quality.observed(serving.serving_races(ctx.read("core", "race_summary_latest")))
    ctx.write(races, "serving", "serving_races")
    ctx.figures = dict(seen.get)   # of the write just done
    ctx.write(serving.serving_entries(ctx.read("core", "se_latest"), ctx.read("core", "entry_fallback_latest")),
              "serving", "serving_entries")


def step_quality_checks(ctx: BuildContext) -> None:
    races, entries = ctx.read("serving", "serving_races"), ctx.read("serving", "serving_entries")
    as_of = ctx.params.get("as_of")
    ctx.outputs["quality_report"] = quality.quality_report(races, entries, as_of) if ctx.figures is None else \
        quality.report_of_observed(races, entries, ctx.figures, as_of)


def step_build_speed_index(ctx: BuildContext) -> None:
    """Fit the index on ``raw/analysis_view`` and replace master and baseline."""
    master = speed_index.speed_index_master(ctx.read("raw", "analysis_view"), as_of=ctx.params.get("as_of"))
    ctx.write(master, "ml", "speed_index_master")
    ctx.write(speed_index.speed_index_baseline(ctx.read("ml", "speed_index_master")), "ml", "speed_index_baseline")


STEPS: dict[str, Callable[[BuildContext], None]] = {
    "01_create_layers": step_create_layers,
    "02_build_serving_tables": step_build_serving_tables,
    "03_quality_checks": step_quality_checks,
    "04_build_speed_index": step_build_speed_index,
}


class UnknownStep(LookupError):
    pass


def resolve_steps(only: str | list[str] | None = None) -> list[str]:
    """Names of the steps to run: all in name order, or those asked for, in
    the order asked for, as a list or as text with commas."""
    if only is None or only == "" or only == []:
        return sorted(STEPS)
    asked = [x for x in map(str.strip, only.split(",") if isinstance(only, str) else only) if x]
    unknown = [x for x in asked if x not in STEPS]
    if unknown or not asked:
        raise UnknownStep(f"no such step: {', '.join(unknown)}" if unknown else "no step was named")
    return asked


def run_steps(spark: SparkSession, base: str, only=None, **params) -> BuildContext:
    ctx = BuildContext(spark, base, params)
    for name in resolve_steps(only):
        STEPS[name](ctx)
    return ctx
