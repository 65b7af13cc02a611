"""Semi-naive fixpoints: each round joins only what the last round added, and is written to the shared folder.

Every fixpoint runs to its end: there is no number of rounds after which it stops with less. A bound is given only where it is
the question (what so many steps reach).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.plans.fragments import can_deal, in_ranges, reached
from factloom.session import drop, materialize, once, rows

#: A frontier of so many rows takes several steps in a round: there the cost of a round is that of starting it.
SMALL, STEPS = 1_000_000, 8
#: Rounds of single moves before paths are doubled, and written tables of a result before they are put together.
SINGLE_ROUNDS, PARTS = 3, 8


class _Found:
    """The rows found so far as a union of written tables, the last of them, and how many steps were done."""

    def __init__(self, first: DataFrame, key: list[str]):
        self.parts, self.key, self.last, self.done = [first], key, first, 0

    @staticmethod
    def start(seed: DataFrame, key: list[str], least: str | None) -> _Found:
        return _Found(materialize(_one(seed, key, least).select(seed.columns), "fixpoint-0", count=True), key)

    def table(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out

    def add(self, candidates: DataFrame, steps: int) -> None:
        """Keep the candidates that aren't known yet."""
        self.done += steps
        self.last = materialize(candidates.join(self.table().select(self.key), self.key, "left_anti"), f"fixpoint-{self.done}", count=True)
        if rows(self.last):
            self.parts.append(self.last)
        if len(self.parts) > PARTS:
            old, self.parts = self.parts, [materialize(self.table(), "fixpoint-known")]
            drop(*(p for p in old if p is not self.last))


def _one(df: DataFrame, key: list[str], least: str | None) -> DataFrame:
    """A row per key, the one with the least of ``least`` if that is given."""
    return df.groupBy(*key).agg(F.min(least).alias(least)) if least else df.dropDuplicates(key)


def iterate(seed: DataFrame, step: Callable[[DataFrame], DataFrame], *, key: list[str] | None = None, least: str | None = None, bound: int | None = None) -> DataFrame:
    """Least set that holds seed and is closed under step; with ``bound`` what so many steps reach.

    ``step`` maps newly found rows to candidates of the same columns. A row is known by ``key`` (default: all columns),
    and the step in which a key is first found keeps its row. ``least`` names the one column outside the key where it
    grows with every step.
    """
    columns, several = seed.columns, key is None or least is not None
    key = key or columns

    def advance(new: DataFrame, steps: int) -> DataFrame:
        layer, every = new, None
        for _ in range(steps):
            layer = _one(step(layer).select(columns), key, least).select(columns)
            every = layer if every is None else every.unionByName(layer)
        return _one(every, key, least).select(columns) if steps > 1 else every

    return _rounds(_Found.start(seed, key, least), advance, steps=2 if several else 1, bound=bound).table()


def _rounds(found: _Found, advance: Callable[[DataFrame, int], DataFrame], *, steps: int, bound: int | None = None, rounds_at_most: int | None = None) -> _Found:
    """Goes on from the last found rows until nothing is new, or for so many steps or rounds; large frontiers take one step a round."""
    taken = 0
    while rows(found.last) and (bound is None or found.done < bound) and (rounds_at_most is None or taken < rounds_at_most):
        now = steps if rows(found.last) <= SMALL else 1
        now = now if bound is None else min(now, bound - found.done)
        found.add(advance(found.last, now), now)
        taken += 1
    return found


def spread(seed: DataFrame, over: DataFrame, at: str = "node", *, hops: str | None = None, bound: int | None = None, start: int = 0) -> DataFrame:
    """Least set that holds seed and, for every row and edge (node, to) from the row's ``at``, the row with ``to`` instead.

    ``over`` is read in every round: a written table, or columns of one. ``hops`` names a column of seed that counts moves;
    of equal rows the one with the fewest stays. ``bound`` ends after so many moves; ``start`` is what the seed's hops are then.

    First every range of nodes is closed by itself (see fragments.py). What leaves a range goes on in rounds from where it came out,
    without a shuffle of what is known while it is small. Where it doesn't end soon, paths run through many ranges, and the
    whole starts again in rounds over all edges:

    A round is a chain of STEPS joins, in which a row may stay where it is instead of moving. After a few rounds paths are
    doubled: the edges of exactly 2, 4, 8 ... steps are made from one another and every row moves along them, so that long
    thin graphs take a number of rounds that is logarithmic in their depth. Where such edges become many (dense graphs,
    whose depth is small) single moves go on instead.
    """
    over = once(over.select("node", "to"), "over") if not hasattr(over, "_factloom_path") else over
    if can_deal(over.schema["node"].dataType, over.schema["to"].dataType, seed.schema[at].dataType) and (bound is None or hops is not None):
        seed = once(seed, "seed", count=True)
        found = _spread_ranges(seed, over.select("node", "to"), at, hops, None if bound is None else start + bound)
        if found is not None:
            return found
    return _spread_rounds(seed, over, at, hops, bound)


#: Rows that are sent to every executor, and rounds of what leaves ranges: those of so few rows, and shuffled ones.
SENT, SENT_ROUNDS, SHUFFLED_ROUNDS = 200_000, 16, 4
#: Rows from which several moves are one round, and moves of such a round.
FEW, SENT_MOVES = 10_000, 4


def _spread_ranges(seed: DataFrame, over: DataFrame, at: str, hops: str | None, limit: int | None) -> DataFrame | None:
    """spread() by ranges; None where what leaves them doesn't end within a few rounds."""
    columns = seed.columns
    first = [at, *(c for c in columns if c != at)]
    closed = in_ranges(over, seed, at, reached(first.index(hops) if hops else None, limit), StructType([seed.schema[c] for c in first]), "ranges")

    def move(new: DataFrame, few: bool) -> DataFrame:
        going = new if limit is None else new.filter(F.col(hops) < limit)
        edges = over.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
        met = edges.join(F.broadcast(going) if few else going, F.col(at) == F.col("_node"))
        return met.select(*((F.col("_to") if c == at else F.col(c) + 1 if c == hops else F.col(c)).cast(seed.schema[c].dataType).alias(c) for c in columns))

    return leave_ranges(closed, columns, hops, move)


def leave_ranges(closed: DataFrame, columns: list[str], least: str | None, move: Callable[[DataFrame, bool], DataFrame]) -> DataFrame | None:
    """Rows that ranges have closed (see in_ranges) and all that their rows outside lead to; None where that doesn't end within a few rounds.

    A row is known by its columns but ``least``, of which the least stays. move gives the rows that one move makes of new ones,
    which are few enough to be sent to every executor if it is told so.
    """
    key = [c for c in columns if c != least]
    inner, parts = closed.filter("NOT _out").select(columns), []

    def better(some: DataFrame, few: bool) -> DataFrame:
        """Rows of some that aren't known, or with more of ``least``."""
        every = inner
        for part in parts:
            every = every.unionByName(part)
        old = _one(every.join(F.broadcast(some.select(key)) if few else some.select(key), key, "left_semi").select(columns), key, least)
        old = old.select(*key, F.col(least).alias("_was") if least else F.lit(0).alias("_was"))
        met = some.join(F.broadcast(old) if few else old, key, "left")
        return met.filter(F.col("_was").isNull() | (F.col(least) < F.col("_was")) if least else F.col("_was").isNull()).select(columns)

    asked = materialize(_one(closed.filter("_out").select(columns), key, least).select(columns), "leaving", count=True, narrow=True)
    sent = shuffled = 0
    while rows(asked):
        few = rows(asked) <= SENT
        sent, shuffled = sent + few, shuffled + (not few)
        if sent > SENT_ROUNDS or shuffled > SHUFFLED_ROUNDS:
            drop(asked, closed, *parts)
            return None
        new = materialize(better(asked, few), "came-out", count=True, narrow=True)
        drop(asked)
        if not rows(new):
            break
        parts.append(new)
        few = rows(new) <= SENT
        layer = every = move(new, few)
        for _ in range(SENT_MOVES - 1 if rows(new) <= FEW else 0):
            layer = move(_one(layer, key, least).select(columns), True)
            every = every.unionByName(layer)
        asked = materialize(_one(every, key, least).select(columns), "leaving", count=True, narrow=True)
    if not parts:
        return inner
    late = parts[0]
    for part in parts[1:]:
        late = late.unionByName(part)
    if not least:
        return inner.unionByName(late)
    late = _one(late, key, least).select(columns)  # what came by another range can be less than what was found inside
    few = sum(map(rows, parts)) <= SENT
    return inner.join(F.broadcast(late.select(key)) if few else late.select(key), key, "left_anti").select(columns).unionByName(late)


def _spread_rounds(seed: DataFrame, over: DataFrame, at: str, hops: str | None, bound: int | None) -> DataFrame:
    columns = seed.columns
    key = [c for c in columns if c != hops]
    one = lambda df: _one(df, key, hops).select(columns)
    nodes = over.select("node").unionByName(over.select(F.col("to").alias("node"))).distinct()
    moves = over.select("node", "to").distinct().withColumn("by", F.lit(1)).unionByName(nodes.select("node", F.col("node").alias("to"), F.lit(0).alias("by")))
    moves = materialize(moves.select(F.col("node").alias("_node"), F.col("to").alias("_to"), F.col("by").alias("_by")), "moves", count=True)

    def moved(df: DataFrame, by: DataFrame) -> DataFrame:
        met = df.join(by, F.col(at) == F.col("_node"))
        return one(met.select(*((F.col("_to") if c == at else F.col(c) + F.col("_by") if c == hops else F.col(c)).alias(c) for c in columns)))

    def advance(new: DataFrame, steps: int) -> DataFrame:
        for _ in range(steps):
            new = moved(new, moves)
        return new

    found = _rounds(_Found.start(seed, key, hops), advance, steps=STEPS, bound=bound, rounds_at_most=None if bound is not None else SINGLE_ROUNDS)
    if bound is not None or not rows(found.last):
        return found.table()
    power, width = moves.filter("_by = 1"), 1
    while rows(found.last):
        # Everything within found.done moves is known and width is at most one more: a move by width leaves no gap.
        found.add(moved(found.table(), power), width)
        if not rows(found.last):
            break
        onward = power.select(F.col("_node").alias("_to"), F.col("_to").alias("_end"))
        longer = power.join(onward, "_to").select("_node", F.col("_end").alias("_to")).distinct()
        longer = materialize(longer.withColumn("_by", F.lit(2 * width)), f"power-{2 * width}", count=True)
        drop(power)
        power, width = longer, 2 * width
        if rows(power) > 2 * rows(moves) + SMALL:
            drop(power)
            return _rounds(found, advance, steps=STEPS).table()
    return found.table()
