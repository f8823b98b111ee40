"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Every source's rows are numbered and cut into blocks. With weight w (the weights add up to 1), block i = 1, 2, ... of
a source is released at slot floor((i - 1) / w) and due by slot ceil(i / w); one block is dealt in each slot, to the
released block with the earliest deadline. With one processor and weights that fill it, earliest deadline first meets
every deadline, so at any slot t a source has been dealt t w blocks, give or take less than one.

Weights are exact fractions. Over their common denominator M they are whole shares, and the schedule repeats every M
slots, so it is worked out for one period and every block finds its slot by arithmetic, without a serial pass over the
rows. When a source has dealt its last block, the others begin a new phase in which their weights fill all slots.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_SOURCES = 10_000
#: Slots of all phases' periods together: what the driver works out and sends.
MAX_PLAN = 1 << 20
SHARD_ROWS = 4096


def shares(weights: dict[str | None, float], frame: int) -> dict[str | None, int]:
    """Whole shares, at least 1 each, that add up to `frame`: largest remainders."""
    if not weights:
        return {}
    if frame < len(weights) or min(weights.values()) <= 0:
        raise ValueError("a frame needs a slot for each source, and weights above 0")
    total = sum(weights.values())
    want = {s: w / total * frame for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in want.items()}
    order = sorted(weights, key=lambda s: (out[s] - want[s], s is None, s or ""))
    k = 0
    while (rest := frame - sum(out.values())) != 0:
        s = order[k % len(order)] if rest > 0 else max(out, key=lambda x: (out[x] - want[x] if out[x] > 1 else -1e18, x or ""))
        out[s] += 1 if rest > 0 else -1
        k += 1
    return out


def exact_shares(weights: dict[str | None, float | Fraction]) -> dict[str | None, int]:
    """The weights over their least common denominator; a float counts as the decimal that it prints."""
    exact = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    if exact and min(exact.values()) <= 0:
        raise ValueError("weights are above 0")
    den = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * den) for s, w in exact.items()}
    div = gcd(*whole.values()) or 1
    return {s: n // div for s, n in whole.items()}


def earliest_deadline(share: dict[str | None, int], left: dict[str | None, int], most: int) -> tuple[dict[str | None, list[int]], bool]:
    """Slots of each source's blocks over one period, or up to the end of the first source, and whether that came.

    Of released blocks with one deadline, that of the source that sorts first (null last) is dealt.
    """
    m = sum(share.values())
    order = {s: k for k, s in enumerate(sorted(share, key=lambda s: (s is None, s or "")))}
    slots: dict[str | None, list[int]] = {s: [] for s in share}
    ready = [(-(-m // n), order[s], s) for s, n in share.items()]
    heapq.heapify(ready)
    waiting: list[tuple[int, int, str | None]] = []
    for t in range(m):
        if t >= most:
            raise ValueError(f"the weights' common denominator {m} is too large: round the weights, or deal larger blocks")
        while waiting and waiting[0][0] <= t:
            _, k, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * m // share[s]), k, s))
        _, k, s = heapq.heappop(ready)  # never empty: released blocks fill every slot
        slots[s].append(t)
        if len(slots[s]) == left[s]:
            return slots, True
        if len(slots[s]) < share[s]:
            heapq.heappush(waiting, (len(slots[s]) * m // share[s], k, s))
    return slots, False


def plan(share: dict[str | None, int], blocks: dict[str | None, int], most: int = MAX_PLAN) -> list[dict]:
    """A row for each phase and source that is left in it: first slot and block, share, period, slots of a period."""
    out, begin, left = [], 0, {s: n for s, n in blocks.items() if n}
    while left:
        div = gcd(*(share[s] for s in left))
        live = {s: share[s] // div for s in left}
        m = sum(live.values())
        slots, ended = earliest_deadline(live, left, most)
        most -= sum(map(len, slots.values()))
        length = 1 + (max(x[-1] for x in slots.values() if x) if ended else min((n - 1) // live[s] * m + slots[s][(n - 1) % live[s]] for s, n in left.items()))
        rest = {}
        for s, n in left.items():
            out.append({"s": s, "slot": begin, "block": blocks[s] - n, "share": live[s], "period": m, "slots": slots[s]})
            dealt = bisect_left(slots[s], length) if ended else length // m * live[s] + bisect_left(slots[s], length % m)
            if n > dealt:
                rest[s] = n - dealt
        begin, left = begin + length, rest
    return out


def target_shares(counts: dict[str | None, int], power: float = 0.7) -> dict[str | None, int]:
    """Target weights by default: the numbers of rows to a power (1: as they are, 0: all alike), as whole thousandths.

    With very many sources the unit is an eighth of an even share. Each source has one unit at least.
    """
    return shares({s: float(n) ** power for s, n in counts.items()}, max(1000, 8 * len(counts)))


def mix(docs: DataFrame, weights: dict[str | None, float | Fraction] | None = None, source: str = "source", block: int = 16) -> DataFrame:
    """docs with mix_slot (long), mix_pos (long, within the slot), mix_release, mix_deadline (long) and in_mix (boolean).

    Every row is kept and dealt once: slot s holds one block of `block` rows, the last block of a source may hold fewer.
    in_mix marks the first phase, in which all sources take part. In every phase the shares of its sources hold with
    less than one block of deviation at each slot, counted from the phase's first slot; releases and deadlines are
    counted so too. Weights: of every source (a null source is one too), as fractions, decimals or whole numbers; a
    source without a weight is an error, and so are weights whose common denominator is too large (MAX_PLAN). The order
    within a source is that of a hash of all columns; repeated rows are grouped and numbered together, so any number of
    copies is dealt apart as other rows are. Texts of any length pass. An empty table gives an empty one. Columns with
    the new names are replaced.
    """
    docs = docs.drop("mix_slot", "mix_pos", "mix_release", "mix_deadline", "in_mix")
    spark = docs.sparkSession
    counts = {r[source]: r["count"] for r in docs.groupBy(source).count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is not None and (missing := set(counts) - set(weights)):
        raise ValueError(f"sources without a weight: {sorted(map(str, missing))[:5]}")
    share = target_shares(counts) if weights is None else exact_shares({s: w for s, w in weights.items() if s in counts})
    phases: dict[str | None, list[dict]] = {s: [] for s in counts}
    for r in plan(share, {s: -(-n // block) for s, n in counts.items()}):
        phases[r["s"]].append({k: v for k, v in r.items() if k != "s"})
    rows = [{"_mx_s": s, "_mx_shards": -(-counts[s] // SHARD_ROWS), "_mx_phases": p} for s, p in phases.items()]
    kind = "array<struct<_mx_s:string,_mx_shards:long,_mx_phases:array<struct<slot:long,block:long,share:long,period:long,slots:array<int>>>>>"
    # a row for each source; its size is bounded by MAX_PLAN
    plans = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind))))
    of = F.col(source).cast("string").eqNullSafe(F.col("_mx_s"))
    every = [F.col(c) for c in docs.columns]
    keyed = docs.withColumn("_mx_k", F.xxhash64(*every)).withColumn("_mx_k2", F.xxhash64(F.lit("again"), *every))
    key = ["_mx_k", "_mx_k2"]
    # equal rows are one group with a count: only small rows are numbered, and a text of many copies moves once
    groups = keyed.groupBy(source, *key).agg(F.count(F.lit(1)).alias("_mx_n")).join(plans.select("_mx_s", "_mx_shards"), of).drop("_mx_s")
    groups = groups.withColumn("_mx_shard", F.pmod(F.shiftright("_mx_k", 20), F.col("_mx_shards"))).withColumnRenamed(source, "_mx_src")
    sizes = groups.groupBy("_mx_src", "_mx_shard").agg(F.sum("_mx_n").alias("_mx_rows"))
    before = lambda w: F.coalesce(F.sum(w[0]).over(w[1].rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_mx_src").alias("_mx_os"), F.col("_mx_shard").alias("_mx_oh"), before(("_mx_rows", W.partitionBy("_mx_src").orderBy("_mx_shard"))).alias("_mx_off"))
    # sums within shards of about SHARD_ROWS rows: no window holds a whole source
    placed = groups.withColumn("_mx_first", before(("_mx_n", W.partitionBy("_mx_src", "_mx_shard").orderBy(*key))))
    placed = placed.join(offsets, F.col("_mx_src").eqNullSafe(F.col("_mx_os")) & (F.col("_mx_shard") == F.col("_mx_oh")))
    placed = placed.select(*key, F.sequence(F.col("_mx_first") + F.col("_mx_off"), F.col("_mx_first") + F.col("_mx_off") + F.col("_mx_n") - 1).alias("_mx_is"))
    numbered = keyed.dropDuplicates(key).join(placed, key).withColumn("_mx_i", F.explode("_mx_is"))
    b = F.floor(F.col("_mx_i") / block)
    dealt = numbered.withColumn("_mx_b", b).join(plans, of)
    dealt = dealt.withColumn("_mx_p", F.expr("element_at(filter(_mx_phases, p -> p.block <= _mx_b), -1)")).withColumn("_mx_j", F.col("_mx_b") - F.col("_mx_p.block"))
    slot = F.expr("_mx_p.slot + _mx_j div _mx_p.share * _mx_p.period + element_at(_mx_p.slots, cast(_mx_j % _mx_p.share as int) + 1)")
    return dealt.select(
        *[F.col(c) for c in docs.columns],
        slot.cast("long").alias("mix_slot"),
        F.pmod("_mx_i", F.lit(block)).cast("long").alias("mix_pos"),
        F.expr("_mx_p.slot + _mx_j * _mx_p.period div _mx_p.share").alias("mix_release"),
        F.expr("_mx_p.slot + ((_mx_j + 1) * _mx_p.period + _mx_p.share - 1) div _mx_p.share").alias("mix_deadline"),
        (F.col("_mx_p.slot") == 0).alias("in_mix"),
    )


def op4(docs: DataFrame) -> DataFrame:
    """The mix of all documents, by source, to weights of their numbers to the power 0.7 in thousandths."""
    return mix(docs).select("doc_id", "source", "mix_slot", "mix_pos", "mix_release", "mix_deadline", "in_mix")
