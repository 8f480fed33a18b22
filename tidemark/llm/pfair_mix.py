"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are shuffled by a seeded hash and cut into blocks. The j-th block (from 1) of a source with
weight w is released at floor((j - 1) / w) and due at ceil(j / w); at each time the released block with the earliest
deadline is placed. So after every slot each source has had within less than one block of its due share. Weights are
exact: whole numbers in the ratio of the targets. The schedule repeats after as many slots as they add up to; only one such
period (or less, where a source is used up before) is computed outside Spark, and a block's slot follows from its number
by a join with that table, which is broadcast only where it is measured to be small. Weights whose period is longer than
``MOST`` slots are refused, with the advice to round them (``whole_weights``).

Every row is placed exactly once. When a source is used up a new phase begins, with the weights of the others scaled
up; the bound holds within each phase. There are as many phases as sources at most; sources, a row each on the driver, may
be some thousands.

Nulls: a null source is a source of its own, with its own weight; null ids and repeated rows are rows like others. Rows of
one source are shuffled by a hash of their ids, those without an id by a hash of all their columns; ties are ordered by id
and all columns, so only rows that are equal in every column can change places. Texts, however long, are carried and never
looked into but for that hash. The last block of a source may be shorter. An empty table gives an empty table. Sources without a weight get the least
weight. Added columns are named by the caller (``slot_col``, ...), so clashing names can be avoided.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SEED, null_safe_key, ranked_within, sized_join, written

PARTS, BLOCK, MOST = 1000, 32, 4_000_000


def exact_weights(weights: dict[str, float]) -> dict[str, int]:
    """The least whole numbers in exactly the ratio of the weights (floats count as the decimals that they print as)."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * unit) for s, w in exact.items()}
    least = math.gcd(*whole.values())
    return {s: n // least for s, n in whole.items()}


def whole_weights(weights: dict[str, float], parts: int = PARTS) -> dict[str, int]:
    """Weights rounded to positive whole parts of ``parts`` (largest remainders), for a caller that wants a short period."""
    parts, total = max(parts, len(weights)), sum(weights.values())
    share = {s: w / total * parts for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in share.items()}
    left = parts - sum(out.values())
    for s in sorted(share, key=lambda s: (out[s] - share[s], s))[: max(left, 0)]:
        out[s] += 1
    while (over := sum(out.values()) - parts) > 0:  # the least parts that were raised to 1 are taken from the largest
        most = max(out, key=lambda s: (out[s], s))
        out[most] -= min(over, out[most] - 1)
    return out


def period(weights: dict[str, int], until: int | None = None) -> dict[str, list[int]]:
    """For each source the slots of its blocks in one period, or in its first ``until`` slots, by earliest deadline first
    among released blocks."""
    parts = sum(weights.values())
    if (parts if until is None else min(parts, until)) > MOST:
        raise ValueError(f"a schedule with these weights repeats after {parts} slots only, more than {MOST}; round them with whole_weights")
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, -(-parts // n), s) for s, n in weights.items()]  # release, deadline, source
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for t in range(parts if until is None else min(parts, until)):
        while waiting and waiting[0][0] <= t:
            _, due, s = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s))
        due, s = heapq.heappop(ready)
        assert t < due
        slots[s].append(t)
        j, n = len(slots[s]), weights[s]
        if j < n:
            heapq.heappush(waiting, (j * parts // n, -(-(j + 1) * parts // n), s))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[dict]:
    """One entry per phase and source: its first block, number of blocks, first slot of the phase, and slots of a period."""
    left, done, out, start = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), [], 0
    phase = 0
    while left:
        w = exact_weights({s: weights[s] for s in left})
        length = sum(w.values())
        # by then the last block of one source is due
        slots = period(w, min(-(-n * length // w[s]) for s, n in left.items()))
        last = {s: (n - 1) // w[s] * length + slots[s][(n - 1) % w[s]] for s, n in left.items() if (n - 1) % w[s] < len(slots[s])}
        end = min(last.values()) + 1  # the first source is used up
        for s in list(left):
            used = end // length * w[s] + sum(t < end % length for t in slots[s])
            if used:
                out.append({"phase": phase, "src": s, "first": done[s], "blocks": used, "start": start, "length": length, "parts": w[s], "slots": slots[s]})
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        start += end
        phase += 1
    return out


def scheduled(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", phase_col: str = "phase", block_col: str = "block", slot_col: str = "slot", pos_col: str = "pos") -> DataFrame:
    """The rows with their phase, block (of the source, from 0), slot (from 0) and place within the block (from 0).

    ``weights``: target weight of each source, kept exactly; by default the square roots of their numbers of rows, in whole
    parts of ``PARTS`` and one at least, which lift small sources over their share.
    """
    spark = docs.sparkSession
    whole = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.withColumn("__src", null_safe_key(F.col(source_col))).withColumn("__w", whole)
    rows = rows.withColumn("__h", F.when(F.col(id_col).isNull(), F.col("__w")).otherwise(F.xxhash64(F.lit(seed), F.col(id_col))))
    counts = {r["__src"]: r["n"] for r in rows.groupBy("__src").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per source
    schema = "phase int, __src string, first long, blocks long, start long, length long, parts long"
    if weights is None:
        target = whole_weights({s: math.sqrt(n) for s, n in counts.items()}) if counts else {}
    else:
        named = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        target = {s: named.get(s, min(named.values())) for s in counts}
    plan = phases({s: -(-n // block) for s, n in counts.items()}, target)
    # one row per phase and source; lengths beyond a long are never reached, and one such period is enough
    most = 2**62
    when = spark.createDataFrame([(p["phase"], p["src"], p["first"], p["blocks"], p["start"], min(p["length"], most), min(p["parts"], most)) for p in plan], schema)
    lists = spark.createDataFrame([(p["phase"], p["src"], p["slots"]) for p in plan], "phase int, __src string, slots array<long>")
    where = written(lists.select("phase", "__src", F.posexplode("slots").alias("k", "__t")), "slots")
    ranked = ranked_within(rows, "__src", "__h", [id_col, "__w"], "__rank", "__total")
    ranked = ranked.withColumn("__block", F.expr(f"(__rank - 1) div {block}")).withColumn("__pos", F.expr(f"cast((__rank - 1) % {block} as int)"))
    own = when.withColumnsRenamed({"phase": "__phase", "first": "__first", "blocks": "__blocks", "start": "__start", "length": "__length", "parts": "__parts"})
    inside = (F.col("__block") >= F.col("__first")) & (F.col("__block") < F.col("__first") + F.col("__blocks"))
    got = ranked.join(F.broadcast(own), "__src").where(inside).withColumn("__local", F.col("__block") - F.col("__first")).withColumn("__k", F.expr("cast(__local % __parts as int)"))
    table = where.withColumnsRenamed({"phase": "__phase", "k": "__k"})
    got = sized_join(got, table, ["__phase", "__src", "__k"])
    slot = F.col("__start") + F.expr("__local div __parts") * F.col("__length") + F.col("__t")
    return got.select(*docs.columns, F.col("__phase").alias(phase_col), F.col("__block").alias(block_col), slot.alias(slot_col), F.col("__pos").alias(pos_col))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` and its columns only, in the order of the schedule across and within partitions."""
    spark = docs.sparkSession
    from .base import partitions

    got = scheduled(docs, phase_col="__p", block_col="__b", slot_col="__slot", pos_col="__at", **options)
    return got.repartitionByRange(partitions(spark), "__slot").sortWithinPartitions("__slot", "__at").select(*docs.columns)
