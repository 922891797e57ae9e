"""Which texts begin with a text of another table, or are the beginning of one, by one sorted merge."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.session import checkpointed

#: Distinct texts that a task walks through, and characters of them.
ROWS_PER_TASK, CHARS_PER_TASK = 200_000, 1 << 26


class _Walk:
    """Rows of one range in order: the shortest example that the place lies under, and the cases still open.

    In sorted order all texts with a common beginning follow it without a gap. So an example lies under an
    earlier one exactly if the last example that isn't under another (the root) begins it, a case begins
    with an example exactly if the root begins it, and a case begins an example exactly if it begins the next one.
    Open cases each begin the one after, so they are a stack no higher than a text is long.
    """

    def __init__(self, group=None, root: str | None = None):
        self.group, self.root = group, root
        self.open: list[str] = []
        self.first_group, self.first_example, self.started = None, None, False

    def step(self, group, text: str, is_example: bool, is_case: bool) -> list[tuple]:
        """(group, text) of the cases that this row settles as found."""
        found = []
        if not self.started:
            self.first_group, self.started = group, True
        if group != self.group:
            self.group, self.root, self.open = group, None, []
        while self.open and not text.startswith(self.open[-1]):
            self.open.pop()
        if is_example:
            found += [(group, x) for x in self.open]
            self.open = []
            if self.root is None or not text.startswith(self.root):
                self.root = text
            if self.first_example is None and group == self.first_group:
                self.first_example = text
        if is_case:
            if self.root is not None and text.startswith(self.root):
                found.append((group, text))
            else:
                self.open.append(text)
        return found

    def close(self, following: tuple | None) -> list[tuple]:
        """What the next example, in a later range, settles."""
        if following is None or following[0] != self.group:
            return []
        return [(self.group, x) for x in self.open if following[1].startswith(x)]


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _edges(ranges: DataFrame, kind: str) -> DataFrame:
    """Per range: its first and last group, the first example of the first and the root in force at the end."""

    def run(batches):
        walk, number, out = _Walk(), None, []

        def row():
            return (number, walk.first_group, walk.first_example, walk.group, walk.root)

        for part, group, text, is_example, _ in _rows(batches):
            if part != number:
                if number is not None:
                    out.append(row())
                walk, number = _Walk(), part
            walk.step(group, text, is_example, False)
        if number is not None:
            out.append(row())
        shape = pa.schema([("part", pa.int32()), ("first_group", pa.string()), ("first_example", pa.string()), ("last_group", pa.string()), ("root", pa.string())])
        yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in out], shape)

    return ranges.mapInArrow(run, f"part int, first_group {kind}, first_example string, last_group {kind}, root string")


def _carried(edges: list) -> dict[int, tuple]:
    """For each range (group, root) in force before it and (group, example) that comes after it."""
    before: dict[int, tuple] = {}
    state = None
    for e in edges:
        before[e["part"]] = state
        inherited = state[1] if state and state[0] == e["first_group"] else None
        root = e["root"]
        if e["first_group"] == e["last_group"] and inherited is not None and (root is None or root.startswith(inherited)):
            root = inherited
        state = (e["last_group"], root) if root is not None else None
    out: dict[int, tuple] = {}
    state = None
    for e in reversed(edges):
        out[e["part"]] = (before[e["part"]], state)
        if e["first_example"] is not None:
            state = (e["first_group"], e["first_example"])
        elif not (state and e["first_group"] == e["last_group"] == state[0]):
            state = None
    return out


def beside(cases: DataFrame, examples: DataFrame, group: str, text: str, rows_per_task: int = ROWS_PER_TASK, chars_per_task: int = CHARS_PER_TASK) -> DataFrame:
    """Distinct (group, text) of the cases that begin with an example of their group, or begin one.

    Distinct texts of both sides are sorted over ranges and walked through twice: once for what each range
    hands to its neighbours, two texts that go through the driver, and once to settle the cases. Rows are the distinct
    texts, however long they are; there are as many ranges as their number and characters ask for, and each is a
    task of its own. Null groups and texts match nothing.
    """
    sides = cases.select(F.col(group).cast("string").alias("g"), F.col(text).alias("t"), F.lit(False).alias("e"), F.lit(True).alias("c"))
    sides = sides.unionByName(examples.select(F.col(group).cast("string").alias("g"), F.col(text).alias("t"), F.lit(True).alias("e"), F.lit(False).alias("c")))
    rows = checkpointed(sides.where("g IS NOT NULL AND t IS NOT NULL").groupBy("g", "t").agg(F.max("e").alias("e"), F.max("c").alias("c")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars")).first()
    parts = max(1, -(-size["n"] // rows_per_task), -(-(size["chars"] or 0) // chars_per_task))
    ranged = checkpointed(rows.repartitionByRange(parts, "g", "t").select(F.spark_partition_id().alias("part"), "g", "t", "e", "c"))
    ordered = ranged.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "g", "t")
    carried = _carried(sorted(_edges(ordered, "string").collect(), key=lambda r: r["part"]))  # two texts for each range
    shared = cases.sparkSession.sparkContext.broadcast(carried)

    def run(batches):
        walk, number, found = None, None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["g", "t"])

        for part, g, t, is_example, is_case in _rows(batches):
            if part != number:
                if walk is not None:
                    found += walk.close(shared.value[number][1])
                walk, number = _Walk(*(shared.value[part][0] or ())), part
            found += walk.step(g, t, is_example, is_case)
            if len(found) >= 4096:
                yield batch()
                found = []
        if walk is not None:
            found += walk.close(shared.value[number][1])
        yield batch()

    return ordered.mapInArrow(run, "g string, t string").select(F.col("g").alias(group), F.col("t").alias(text))
