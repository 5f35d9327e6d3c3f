"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions on the rows.

Each source's rows are cut into blocks of ``block_rows`` rows, whatever the size of the table, and each slot of the mixed
order holds one block. In the ideal fluid schedule a source progresses at its weight over the weights of all sources that
still have blocks, so that its block j is worked on between two times: its release (the first, rounded down) and its
deadline (the second, rounded up). At every slot the released block with the earliest deadline goes next. Every block
then stands between its release and its deadline, and each source's count of blocks deviates from the fluid one by less
than one block at any slot.

The plan does not grow with the table. Weights are whole numbers of blocks in a period, so after K periods of virtual time
every source has done exactly K times its number, or all its blocks: the schedule meets the fluid one and begins anew. A
period in which no source ends is like the one before, so the driver schedules one period for each set of sources that
last, and one for each period in which a source ends: at most (2 * sources + 1) * MAX_PERIOD slots. A row finds its slot
by its block's period and place in it, with arithmetic and a join of that plan.

Weights keep their ratios exactly while their period has at most MAX_PERIOD blocks, and are rounded to MAX_PERIOD blocks
else. Only counts of sources (those with weights, and one group for the rest) reach the driver. Rows take their rank
within a source from a hash, through many units for each source, so that a source with a third of all rows is dealt to
many tasks. All rows are kept: weights decide the order, not the number, and when a source has no rows left, the others
share its weight.

Defined cases: a null or unnamed source belongs to the group of the rest; null ids and texts are hashed like others;
repeated rows are each placed, and rows equal in id and text may swap places; a weight of zero or less raises ValueError;
an empty table gives an empty result; a column of documents that clashes with an added one is kept under its name and the
added one gets underscores in front.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .common import Stored, free_name, named, planned

BLOCK_ROWS, MAX_PERIOD = 16, 4096
#: Rows that a part of the mixed order has when it is written, the most parts, and units of sources to broadcast (32 MB).
CHUNK_ROWS, MAX_PARTS, BROADCAST_UNITS = 16_384, 1 << 16, 1 << 20


def numbers(weights: Sequence[float]) -> list[int]:
    """Blocks of each source in a period, in the ratio of the weights."""
    if not weights or min(weights) <= 0 or not all(map(math.isfinite, weights)):
        raise ValueError("weights must be positive")
    exact = [Fraction(str(w)) for w in weights]
    whole = [int(w * math.lcm(*(x.denominator for x in exact))) for w in exact]
    whole = [n // math.gcd(*whole) for n in whole]
    if sum(whole) <= MAX_PERIOD:
        return whole
    return [max(1, round(n * MAX_PERIOD / sum(whole))) for n in whole]


def windows(blocks: Sequence[int], shares: Sequence[int], first: int) -> list[list[tuple[int, int]]]:
    """(release, deadline), from the begin of period ``first``, of each source's blocks in it. At virtual time v a source
    has done min(v * share, blocks) blocks; the time is the sum over all sources."""

    def at(virtual: Fraction) -> Fraction:
        return sum((min(virtual * s, Fraction(n)) for n, s in zip(blocks, shares, strict=True)), Fraction(0))

    begin = at(Fraction(first))
    out = []
    for n, share in zip(blocks, shares, strict=True):
        times = [at(Fraction(j, share)) - begin for j in range(first * share, min((first + 1) * share, n) + 1)]
        out.append([(math.floor(a), math.ceil(b)) for a, b in zip(times, times[1:], strict=False)])
    return out


def schedule(due: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    """For each slot (source, block, release, deadline), by earliest deadline among released blocks."""
    waiting = [(own[0][0], s, 0) for s, own in enumerate(due) if own]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(sum(map(len, due))):
        while waiting and waiting[0][0] <= slot:
            _, source, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due[source][j][1], source, j))
        deadline, source, j = heapq.heappop(ready)
        out.append((source, j, due[source][j][0], deadline))
        if j + 1 < len(due[source]):
            heapq.heappush(waiting, (due[source][j + 1][0], source, j + 1))
    return out


@dataclass(frozen=True)
class Stretch:
    """Periods first .. last - 1, all scheduled like the first; slot: that of the begin of the first, length: of each."""

    first: int
    last: int
    slot: int
    length: int
    slots: list[tuple[int, int, int, int]]


def stretches(blocks: Sequence[int], shares: Sequence[int]) -> list[Stretch]:
    """The whole schedule: a stretch for the periods between those in which sources end, and one for each of these."""
    ends = sorted({n // s for n, s in zip(blocks, shares, strict=True)} | {-(-n // s) for n, s in zip(blocks, shares, strict=True)} | {0})
    out, slot = [], 0
    for first, last in zip(ends, ends[1:], strict=False):
        slots = schedule(windows(blocks, shares, first))
        out.append(Stretch(first, last, slot, len(slots), slots))
        slot += (last - first) * len(slots)
    return out


def _group(source_column: str, names: list[str]) -> Column:
    """The number of a source's group; the rest have the number after the last name."""
    out = F.lit(len(names))
    for k, name in enumerate(names):
        out = F.when(named(source_column) == name, F.lit(k)).otherwise(out)
    return out


class Plan:
    """What the driver knows about a mixed table: counts, the schedule, and how a row's rank becomes its position."""

    def __init__(self, keyed: DataFrame, group: str, spread: str, weights: Mapping[str, float], rest_weight: float, block_rows: int):
        if block_rows < 1:
            raise ValueError("a block has at least one row")
        every = numbers([*weights.values(), rest_weight])
        self.spark, self.spread, self.block_rows = keyed.sparkSession, spread, block_rows
        totals = {r[0]: r[1] for r in keyed.groupBy(group).agg(F.count("*")).collect()}  # a row for each group
        self.groups = sorted(totals)
        self.rows = [totals[g] for g in self.groups]
        self.shares = [every[g] for g in self.groups]
        self.blocks = [-(-n // block_rows) for n in self.rows]
        self.stretches = stretches(self.blocks, self.shares) if self.groups else []
        self.bits = ranks.units_for(max(self.rows, default=0))
        self.unit = ranks.unit_of(F.col(spread), self.bits)

    def cut_finely(self) -> None:
        """Units of about a thousand rows of the largest group, for places that are known by units."""
        self.bits = ranks.units_for(max(self.rows), 1024)
        self.unit = ranks.unit_of(F.col(self.spread), self.bits)

    def of(self, values: Sequence[int], group: str) -> Column:
        """A number that belongs to the row's group."""
        out = F.lit(1).cast("long")
        for g, value in zip(self.groups, values, strict=True):
            out = F.when(F.col(group) == g, F.lit(value).cast("long")).otherwise(out)
        return out

    def steps(self) -> DataFrame:
        """Rows (group, stretch, q, at, release, deadline): slots of a period by a source's q-th block in it."""
        rows = [[self.groups[s], k, q, at, begin, end] for k, x in enumerate(self.stretches) for at, (s, q, begin, end) in enumerate(x.slots)]
        return planned(self.spark, rows, "step_group int, step_stretch int, step_q long, step_at long, step_release long, step_deadline long")

    def placed(self, df: DataFrame, group: str, rank: str, out: Sequence[str]) -> DataFrame:
        """df with the columns ``out``: block, slot, release, deadline, position of a row by its rank in its group."""
        block, slot, release, deadline, position = out
        period, stretch = free_name(df, "period"), free_name(df, "stretch")
        size = self.block_rows
        share = self.of(self.shares, group)
        cut = df.withColumn(block, F.expr(f"`{rank}` div {size}"))
        cut = cut.withColumn(period, ((F.col(block) - F.col(block) % share) / share).cast("long"))  # exact, as nothing is left over
        later = [F.when(F.col(period) >= x.first, F.lit(1)).otherwise(F.lit(0)) for x in self.stretches[1:]]
        cut = cut.withColumn(stretch, sum(later, F.lit(0)))
        table = lambda pick: F.element_at(F.array(*[F.lit(pick(x)).cast("long") for x in self.stretches]), F.col(stretch) + 1)
        steps = self.steps()
        on = (F.col(group) == steps.step_group) & (F.col(stretch) == steps.step_stretch) & (F.col(block) - F.col(period) * share == steps.step_q)
        joined = cut.join(F.broadcast(steps), on)  # at most (2 * groups + 1) * MAX_PERIOD rows
        begin = table(lambda x: x.slot) + (F.col(period) - table(lambda x: x.first)) * table(lambda x: x.length)
        joined = joined.withColumns({slot: begin + F.col("step_at"), release: begin + F.col("step_release"), deadline: begin + F.col("step_deadline")})
        # Only the last block of a source may have fewer rows: what it lacks is taken off all later slots.
        short = [F.when(F.col(slot) > last, F.lit(lack)).otherwise(F.lit(0)) for last, lack in self.lacks() if lack]
        return joined.withColumn(position, F.col(slot) * size + F.col(rank) % size - sum(short, F.lit(0).cast("long")))

    def lacks(self) -> list[tuple[int, int]]:
        """For each group the slot of its last block, and the rows that this lacks."""
        out = []
        for s, (n, many, share) in enumerate(zip(self.rows, self.blocks, self.shares, strict=True)):
            period, q = divmod(many - 1, share)
            x = next(x for x in self.stretches if x.first <= period < x.last)
            at = next(at for at, (source, j, *_) in enumerate(x.slots) if (source, j) == (s, q))
            out.append((x.slot + (period - x.first) * x.length + at, many * self.block_rows - n))
        return out


def order_hash(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """What orders the rows of a source."""
    return F.xxhash64(named(id_column), F.xxhash64(named(text_column)))


def _keyed(docs: DataFrame, weights: Mapping[str, float], source_column: str, key: Column, group: str, spread: str) -> DataFrame:
    return docs.withColumn(group, _group(source_column, list(weights))).withColumn(spread, key)


NAMES = ("group", "block", "slot", "release", "deadline", "position")


def positions(docs: DataFrame, weights: Mapping[str, float], rest_weight: float, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", block_rows: int = BLOCK_ROWS, prefix: str = "mix_", key: Column | None = None) -> DataFrame:
    """docs with mix_group, mix_block, mix_slot, mix_release, mix_deadline and mix_position (0, 1, ... without gaps). key: the
    order hash, where docs have it in place of the text."""
    group, block, slot, release, deadline, position, spread, unit, before, rank = (free_name(docs, prefix + n) for n in (*NAMES, "hash", "unit", "before", "rank"))
    keyed = _keyed(docs, weights, source_column, order_hash(id_column, text_column) if key is None else key, group, spread)
    plan = Plan(keyed, group, spread, weights, rest_weight, block_rows)
    added = (group, block, slot, release, deadline, position)
    if not plan.groups:
        return docs.limit(0).select(*[named(c) for c in docs.columns], *[F.lit(None).cast("int" if c == group else "long").alias(c) for c in added])
    cut = keyed.withColumn(unit, plan.unit)
    counts = cut.groupBy(group, unit).agg(F.count("*").alias("n"))
    units = ranks.before_units(counts, [group], unit).select(group, unit, F.col("before").alias(before))
    # The window has dealt rows by group and unit already, so that the join moves the counts alone.
    ranked = cut.withColumn(rank, ranks.within_unit([group], unit, [spread])).join(units.hint("merge"), [group, unit]).withColumn(rank, F.col(rank) + F.col(before))
    placed = plan.placed(ranked, group, rank, added[1:])
    return placed.select(*[named(c) for c in docs.columns], *[F.col(c) for c in added])


def mix(docs: DataFrame, weights: Mapping[str, float], rest_weight: float, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """docs, all rows and no other columns, with about ``chunk_rows`` consecutive positions in each partition, in mixed order
    there. Rows move once: a unit of a source goes to the chunk in which its first row has its position (so a chunk's ends
    overlap its neighbours' by a unit of each source), and is ranked there."""
    group, block, slot, release, deadline, position, spread, unit, before, rank, chunk = (free_name(docs, "mix_" + n) for n in (*NAMES, "hash", "unit", "before", "rank", "chunk"))
    keyed = _keyed(docs, weights, source_column, order_hash(id_column, text_column), group, spread)
    plan = Plan(keyed, group, spread, weights, rest_weight, block_rows)
    if not plan.groups:
        return docs
    plan.cut_finely()
    cut = keyed.withColumn(unit, plan.unit)
    counts = cut.groupBy(group, unit).agg(F.count("*").alias("n"))
    begun = ranks.before_units(counts, [group], unit).withColumn(before, F.col("before").cast("long"))
    names = (block, slot, release, deadline, position)
    parts = min(sum(plan.rows) // chunk_rows + 1, MAX_PARTS)
    starts = plan.placed(begun, group, before, names).select(group, unit, before, F.expr(f"cast(`{position}` div {-(-sum(plan.rows) // parts)} as int)").alias(chunk))
    units = Stored(starts, "mixing-units").df
    # Beyond the bound Spark chooses, and may move the rows once more.
    dealt = cut.join(F.broadcast(units) if len(plan.groups) << plan.bits <= BROADCAST_UNITS else units, [group, unit])
    ranked = dealt.repartitionById(parts, F.col(chunk)).withColumn(rank, ranks.within_unit([chunk, group], unit, [spread]) + F.col(before))
    placed = plan.placed(ranked, group, rank, names).sortWithinPartitions(position)
    return placed.select(*[named(c) for c in docs.columns])
