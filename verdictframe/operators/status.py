"""Step status, gate and composition reports over core records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.scalars import gates_pass, pct, rename_values
from verdictframe.functions.text import bucket_reason
from verdictframe.schemas import GATES, STEP_ORDER


def status_counts(df: DataFrame, status: str | Column, by: Sequence[str] = ()) -> DataFrame:
    c = F.col(status) if isinstance(status, str) else status
    return df.groupBy(*by, F.coalesce(c, F.lit("unset")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def step_stats(df: DataFrame, step: str = "step", status: str = "status") -> DataFrame:
    """Records, ok, failed and skipped per step; ``ok_partial`` counts in none of the three."""
    s = F.coalesce(F.col(status), F.lit(""))
    return df.groupBy(step).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(s == "ok").alias("ok"),
        F.count_if(F.startswith(s, F.lit("failed"))).alias("failed"),
        F.count_if(F.startswith(s, F.lit("skipped"))).alias("skipped"),
    )


def explode_state(df: DataFrame, state: str = "pipeline_state", key: str = "core_id") -> DataFrame:
    return df.select(key, F.explode(state).alias("step", "status"))


def pass_rate(df: DataFrame, by_state: bool = False, validation: str = "validation", state: str = "pipeline_state") -> DataFrame:
    """(passed, total, pct): by the five gates, or by the recorded validate status."""
    if by_state:
        status = F.col(state)["validate"]
        rows = df.where(F.length(status) > 0)
        passed = F.count_if(status == "ok")
    else:
        rows, passed = df, F.count_if(gates_pass(validation))
    counted = rows.agg(passed.alias("passed"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("pass_pct", pct("passed", "total"))


def value_counts(df: DataFrame, column: str, skip_null: bool = True) -> DataFrame:
    rows = df.where(F.length(F.col(column).cast("string")) > 0) if skip_null else df
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)


def gate_breakdown(df: DataFrame, gates: Sequence[str] = GATES) -> DataFrame:
    """Pass, fail, unset and pass percentage per gate; records without any gate are left out."""
    seen = df.where(F.coalesce(*[F.col(g) for g in gates]).isNotNull())
    counts = seen.agg(
        *[F.count_if(F.col(g)).alias(f"{g}|passed") for g in gates],
        *[F.count_if(~F.col(g)).alias(f"{g}|failed") for g in gates],
        *[F.count_if(F.col(g).isNull()).alias(f"{g}|unset") for g in gates],
    )
    entries = [
        F.struct(F.lit(g).alias("gate"), *[F.col(f"{g}|{k}").alias(k) for k in ("passed", "failed", "unset")])
        for g in gates
    ]
    long = counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    total = F.col("passed") + F.col("failed")
    return long.withColumn("pass_pct", F.when(total > 0, 100.0 * F.col("passed") / total).otherwise(0.0))


def gate_failures(df: DataFrame, gates: Sequence[str] = GATES) -> DataFrame:
    """How often each gate is not true among rejected records."""
    truth = {g: F.coalesce(F.col(g), F.lit(False)) for g in gates}
    every = F.lit(True)
    for g in gates:
        every = every & truth[g]
    counts = df.where(~every).agg(*[F.count_if(~truth[g]).alias(g) for g in gates])
    return counts.unpivot([], list(gates), "gate", "failures")


def reason_clusters(df: DataFrame, reasons: str = "rejection_reasons", k: int = 10) -> DataFrame:
    rows = df.select(F.explode(reasons).alias("reason"))
    return top_k(rows.select(bucket_reason("reason").alias("cluster")), "cluster", k)


def provider_breakdown(df: DataFrame, step: str, generators: str = "generators") -> DataFrame:
    provider = F.coalesce(F.col(generators)[step]["provider"], F.lit("unknown"))
    return df.groupBy(provider.alias("provider")).agg(F.count(F.lit(1)).alias("n"))


def strata_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    parts = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("?")) for c in columns]
    return df.groupBy(F.concat_ws("/", *parts).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def composition(
    df: DataFrame, kind: str, provider: str, providers: Sequence[str], validated: str | None = None,
    kind_names: dict[str, str] | None = None,
) -> DataFrame:
    """Type x provider counts with a total row and column, split by validated and diagnostic."""
    label = rename_values(kind, kind_names) if kind_names else F.col(kind)
    valid = F.coalesce(F.col(validated), F.lit(False)) if validated else F.lit(True)
    cells = df.groupBy(F.coalesce(label, F.lit("other")).alias("kind"), F.col(provider).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(valid).alias("_v")
    )
    rows = cells.rollup("kind").agg(
        *[F.sum(F.when(F.col("_p") == p, F.col("_n")).otherwise(0)).alias(f"n_{p}") for p in providers],
        F.sum("_n").alias("total"),
        F.sum("_v").alias("validated"),
        F.grouping("kind").alias("_g"),
    )
    named = F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("kind"))
    return rows.withColumn("kind", named).withColumn("diagnostic", F.col("total") - F.col("validated")).drop("_g")


def input_counts(df: DataFrame, file: str, ids: Sequence[str]) -> DataFrame:
    """Rows and distinct ids per input; ids are reduced in a first aggregate, so no set grows."""
    per_id = df.groupBy(file, *ids).agg(F.count(F.lit(1)).alias("_n"))
    return per_id.groupBy(file).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("unique_ids"))


def latest_step(state: Column | str) -> Column:
    """struct(step, status) of the last step present in the state map."""
    s = F.col(state) if isinstance(state, str) else state
    present = F.filter(F.array(*[F.lit(x) for x in STEP_ORDER]), lambda x: F.map_contains_key(s, x))
    last = F.coalesce(F.try_element_at(present, F.lit(-1)), F.lit("filter"))
    return F.struct(last.alias("step"), F.coalesce(s[last], F.lit("")).alias("status"))


def latest_generation(outputs: Column | str) -> Column:
    """Last generator output, its display name first: provider/model or whichever is given."""
    o = F.try_element_at(F.col(outputs) if isinstance(outputs, str) else outputs, F.lit(-1))
    provider, model = F.nullif(o["generator_provider"], F.lit("")), F.nullif(o["generator_model"], F.lit(""))
    both = F.concat(provider, F.lit("/"), model)
    return F.struct(
        F.coalesce(both, provider, model).alias("generator"), o["mode"].alias("mode"), o["behavior_label"].alias("behavior_label")
    )
