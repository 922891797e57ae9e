"""Balanced one-record-per-question datasets from several providers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.operators.ranking import rank_by_hash, rank_by_value
from verdictframe.session import checkpointed

SEPARATOR = "\u001f"  # joins provider names into a class name
KIND = "\u001e"  # stands between a provider of a class and the change type of its record
#: Parts in which the classes take turns, so that none uses up the type targets before the others.
TURNS = 64


def capacity_targets(capacity: Mapping[str, int], target: int) -> dict[str, int]:
    """Equal shares capped at capacity; slack goes, unit by unit, to the largest headroom.

    Giving units to the largest headroom levels the headrooms from above, so the end state is a
    water level: everyone is cut down to it and the remainder goes to the first providers.
    """
    names = list(capacity)
    base = target // len(names)
    targets = {p: min(base, capacity[p]) for p in names}
    taken = _level_off({p: capacity[p] - targets[p] for p in names}, target - sum(targets.values()))
    return {p: targets[p] + taken[p] for p in names}


def _level_off(height: Mapping[str, int], units: int) -> dict[str, int]:
    """How much each column loses when units are removed one by one from the tallest column."""
    units = min(units, sum(h for h in height.values() if h > 0))
    low, high = 0, max([0, *height.values()])
    while low < high:  # smallest level whose removal fits into the units
        mid = (low + high) // 2
        if sum(max(0, h - mid) for h in height.values()) <= units:
            high = mid
        else:
            low = mid + 1
    taken = {p: max(0, h - low) for p, h in height.items()}
    left = units - sum(taken.values())
    for p, h in height.items():
        if left > 0 and h >= low > 0:
            taken[p] += 1
            left -= 1
    return taken


def assign_balanced(
    candidates: DataFrame,
    target: int,
    seed: int = 17,
    key: str = "core_id",
    provider: str = "provider",
    kind: str = "kind",
    validated: str = "is_validated",
) -> DataFrame:
    """One validated record per question with provider counts as even as capacities allow, and types spread.

    Questions fall into classes by the providers that validated them and the change type of each of these
    records; one count for each class that occurs reaches the driver, however many questions there are.
    Questions with one validator go first, then larger sets; a class gives its questions to the provider with
    the largest score, 100 x what it lacks of its target plus what it lacks of the type (a tenth of its
    target for each type). That fixes how many questions of a class go to which provider, and every
    question finds its provider by its rank in the class. Of several records of a provider for a question the
    least type counts.
    """
    valid = candidates.where(F.coalesce(F.col(validated), F.lit(False)))
    per_record = valid.groupBy(key, provider).agg(F.min(F.coalesce(F.col(kind), F.lit("unknown"))).alias("_kind"))
    per_question = per_record.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set(F.concat(provider, F.lit(KIND), "_kind"))), SEPARATOR).alias("class"),
        F.count(F.lit(1)).alias("validators"),
    )
    per_question = checkpointed(per_question)  # read for the class sizes, the ranks and the choice
    sizes = per_question.groupBy("class", "validators").agg(F.count(F.lit(1)).alias("n"))
    classes = [(r["class"], r["validators"], r["n"]) for r in sizes.collect()]
    capacity: dict[str, int] = {}
    for name, _, n in classes:
        for p in name.split(SEPARATOR):
            capacity[p.split(KIND)[0]] = capacity.get(p.split(KIND)[0], 0) + n
    if not capacity:
        return valid.withColumn("validators", F.lit(0).cast("bigint")).limit(0)
    capacity = dict(sorted(capacity.items()))
    plan = _plan_classes(classes, capacity_targets(capacity, target))
    shares = candidates.sparkSession.createDataFrame(plan, "class string, provider string, lo bigint, hi bigint")

    ranked = rank_by_hash(per_question, ["class"], seed, [key], "_pos")
    pos = F.col("_pos") - 1
    chosen = (
        ranked.join(shares, "class")
        .where((pos >= F.col("lo")) & (pos < F.col("hi")))
        .select(key, F.col("provider").alias(provider), "validators")
    )
    return valid.join(chosen, [key, provider])


def _above(level: int, lack: int, type_lack: int) -> int:
    """How many questions a provider can take while its score is above ``level``: 100 x lack + type lack, both falling by one."""
    both = min(type_lack, lack)
    first = max(0, min(both, -(-(100 * lack + type_lack - level) // 101)))
    return first if first < both else max(both, min(lack, -(-(100 * lack - level) // 100)))


def _take(lack: Mapping[str, int], type_lack: Mapping[str, int], units: int) -> dict[str, int]:
    """Units given one by one to the provider of the largest score (the first of equals), as numbers for each."""
    units = min(units, sum(lack.values()))
    low, high = 0, max([0, *[100 * lack[p] + type_lack[p] for p in lack]])
    while low < high:  # smallest level above which no more than the units lie
        mid = (low + high) // 2
        if sum(_above(mid, lack[p], type_lack[p]) for p in lack) <= units:
            high = mid
        else:
            low = mid + 1
    taken = {p: _above(low, lack[p], type_lack[p]) for p in lack}
    left = units - sum(taken.values())
    for p in taken:
        if left > 0 and taken[p] < lack[p] and _above(low - 1, lack[p], type_lack[p]) > taken[p]:
            taken[p] += 1
            left -= 1
    return taken


def _plan_classes(classes: Sequence[tuple[str, int, int]], targets: Mapping[str, int]) -> list[tuple]:
    """Rank intervals per (class, provider) from class sizes and provider targets.

    A class names its providers, each with its change type if that counts. Classes of equally many validators take
    turns in ``TURNS`` parts, like questions in a mixed order.
    """
    lack, typed = dict(targets), {}
    plan = []
    for validators in sorted({v for _, v, _ in classes}):
        level = sorted((name, n) for name, v, n in classes if v == validators)
        parts = {name: [x.split(KIND) if KIND in x else [x, None] for x in name.split(SEPARATOR)] for name, _ in level}
        given = {name: {p: 0 for p, _ in parts[name]} for name, _ in level}
        for turn in range(TURNS):
            for name, n in level:
                units = n * (turn + 1) // TURNS - n * turn // TURNS
                own = {p: lack[p] for p, _ in parts[name]}
                of_type = {p: 0 if t is None else max(0, typed.setdefault((p, t), max(1, targets[p] // 10))) for p, t in parts[name]}
                for p, k in _take(own, of_type, units).items():
                    given[name][p] += k
                    lack[p] -= k
                    t = dict(parts[name])[p]
                    if t is not None:
                        typed[p, t] -= k
        for name, _ in level:
            start = 0
            for p, k in given[name].items():
                if k:
                    plan.append((name, p, start, start + k))
                start += k
    return plan


def gap_fill(chosen: DataFrame, pool: DataFrame, target: int, key: str, seq: str) -> DataFrame:
    """Rows of ``pool`` not chosen yet, in ``seq`` order, up to the shortfall against ``target``."""
    rest = pool.join(chosen.select(key), key, "left_anti")
    ranked = rank_by_value(rest, [], seq, [key], "_rank", limit=target)
    have = chosen.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked.where(F.col("_rank") <= F.lit(target) - have).drop("_rank")


def with_gap_fill(
    chosen: DataFrame, fill: DataFrame, target: int, seq: str, produced: str, key: str = "core_id", provider: str = "provider", default: str = "fill"
) -> DataFrame:
    """``chosen`` and, up to ``target``, records of a fill source whose question isn't chosen, with the column ``origin``.

    Only fill records that have a perturbation (``produced``, an array that isn't empty) count, the last one of a
    question; they are taken in the order of their questions' first rows. They all bear one provider, the
    first that the source names, else ``default``. Columns that only one side has are null on the other.
    """
    usable = fill.where(F.coalesce(F.size(produced) > 0, F.lit(False)) & F.col(key).isNotNull())
    rest = [c for c in fill.columns if c not in (key, provider)]
    last = usable.groupBy(key).agg(F.min(seq).alias("_first"), F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_first", "_r.*")
    named = fill.where(F.col(provider).isNotNull()).agg(F.min_by(provider, seq)).scalar() if provider in fill.columns else F.lit(None)
    pool = last.withColumn(provider, F.coalesce(named, F.lit(default)))
    added = gap_fill(chosen, pool, target, key, "_first").drop("_first")
    return chosen.withColumn("origin", F.lit("validated")).unionByName(added.withColumn("origin", F.lit("gap_fill")), allowMissingColumns=True)
