"""Steps in Python that may throw: a failing batch is halved until the bad rows stand alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StringType, StructType

from verdictframe.schemas import STEP_ORDER

MESSAGE_CHARS = 240
_PROBLEM, _BYPASS = "_problem", "_bypass"

Run = Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]


@dataclass(frozen=True)
class BatchStep:
    """A step over Arrow batches, isolated by ``chain`` or ``isolated``.

    ``run`` takes rows of the table before the step and returns rows of ``schema`` (the same columns if None);
    it may drop rows and must not depend on which rows share a batch, since a batch that fails is run
    again in halves. Rows that an earlier step failed go past it, unless ``all_rows``.
    """

    run: Run
    schema: str | None = None
    all_rows: bool = False


def by_record(function: Callable[[dict], dict | None], schema: str) -> Run:
    """A step that maps one record to one record of ``schema``, or to None to drop it."""
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [got for row in batch.to_pylist() if (got := function(row)) is not None]
        return pa.RecordBatch.from_pylist(out, shape)

    return run


def _shaped(rows: pa.RecordBatch | pa.Table, shape: pa.Schema) -> pa.RecordBatch:
    table = pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows
    table = table.select(shape.names).cast(shape).combine_chunks()
    batches = table.to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], shape)


def _as_they_are(rows: pa.RecordBatch, shape: pa.Schema) -> pa.RecordBatch:
    """Rows in the shape after the step: columns that were there before, null in those the step would have added."""
    before = dict(zip(rows.schema.names, rows.columns))
    columns = [before[f.name] if f.name in before and before[f.name].type == f.type else pa.nulls(rows.num_rows, f.type) for f in shape]
    return pa.RecordBatch.from_arrays(columns, schema=shape)


def run_isolated(run: Run, rows: pa.RecordBatch, shape: pa.Schema) -> Iterator[tuple[pa.RecordBatch, str | None]]:
    """(rows of ``shape``, problem): what ``run`` returns, and each row that makes it throw as it was, with the error.

    With b bad rows among n the step runs about 2 b log(n / b) times on ever smaller parts.
    """
    waiting = [rows]
    while waiting:
        part = waiting.pop()
        if not part.num_rows:
            continue
        try:
            yield _shaped(run(part), shape), None
        except Exception as error:  # noqa: BLE001 - whatever a step throws, its row is kept
            if part.num_rows == 1:
                yield _as_they_are(part, shape), f"{type(error).__name__}: {error}"[:MESSAGE_CHARS]
            else:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]


def isolated(df: DataFrame, name: str, step: BatchStep, key: str = "core_id", state: str = "pipeline_state") -> DataFrame:
    """``df`` after one step; rows that make it throw stay as stubs.

    The state map gets an entry for the step: ``failed:unexpected:<type>: <message>`` (240 characters of it) for a
    row that throws, else what the step itself entered, else ``ok``. A stub keeps the columns it had; its key reads
    ``unknown`` where it is null. Rows that failed before are handed on untouched. The table must have the
    state column, a map of strings, before and after. Only errors inside ``run`` are caught: a lost task
    is run again as a whole, and columns computed by Spark have ``try_`` functions of their own.
    """
    after = StructType.fromDDL(step.schema) if step.schema else df.schema
    if state not in after.names:
        raise ValueError(f"the step {name} must keep the column {state}")
    shape = to_arrow_schema(after)
    own = df.columns
    failed = F.exists(F.map_values(state), lambda v: v.startswith("failed"))
    bypass = F.lit(False) if step.all_rows else F.coalesce(failed, F.lit(False))

    def batches(parts):
        for part in parts:
            past = part.column(len(own))
            rows = part.select(own)
            for out, problem, by in _sorted_out(rows, past):
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([problem] * out.num_rows, pa.string()), pa.array([by] * out.num_rows, pa.bool_())], [*shape.names, _PROBLEM, _BYPASS])

    def _sorted_out(rows, past):
        handed_on = rows.filter(past)
        if handed_on.num_rows:
            yield _as_they_are(handed_on, shape), None, True
        for out, problem in run_isolated(step.run, rows.filter(pc.invert(past)), shape):
            yield out, problem, False

    schema = StructType(list(after.fields)).add(_PROBLEM, StringType()).add(_BYPASS, BooleanType())
    done = df.select(*own, bypass.alias(_BYPASS)).mapInArrow(batches, schema)
    entry = F.coalesce(F.concat(F.lit("failed:unexpected:"), F.col(_PROBLEM)), F.try_element_at(state, F.lit(name)), F.lit("ok"))
    states = F.coalesce(F.col(state), F.expr("cast(map() as map<string,string>)"))
    stamped = F.map_concat(F.map_filter(states, lambda k, _: k != name), F.create_map(F.lit(name), entry))
    done = done.withColumn(state, F.when(F.col(_BYPASS), F.col(state)).otherwise(stamped))
    if key in after.names and isinstance(after[key].dataType, StringType):
        done = done.withColumn(key, F.when(F.col(_PROBLEM).isNotNull(), F.coalesce(key, F.lit("unknown"))).otherwise(F.col(key)))
    return done.select(after.names)


def chain(df: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame] | BatchStep], stop_after: str | None = None) -> DataFrame:
    """Apply steps in step order, up to ``stop_after``; a step drops rows by filtering them.

    A step is a function of the table, or a ``BatchStep``, whose errors become stubs. Names outside the
    standard order run last, as given. The chain is one lazy plan.
    """
    order = {name: i for i, name in enumerate(STEP_ORDER)}
    for name in sorted(steps, key=lambda n: order.get(n, len(order))):
        step = steps[name]
        df = isolated(df, name, step) if isinstance(step, BatchStep) else df.transform(step)
        if name == stop_after:
            break
    return df
