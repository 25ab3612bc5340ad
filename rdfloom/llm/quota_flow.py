"""Samples that match target shares of categories: quotas by minimum-cost flow.

Cases are cross-classified and counted; only the counts of the wanted strata leave the executors.
For each plan a network routes the sample through the margins: source to the values of the first
category, on to the strata, on to the combinations of the other categories, to the sink. Arcs of a
stratum carry its floor, the rest of its requirement and, dearer, what it has beyond that; margins
have their targets as capacities, with dear arcs beyond them; slack arcs past the strata take what
cannot be routed. What stays unused of a stratum's requirement is its shortfall; units that a short
stratum lacks go to strata with rows to spare that keep the margins, chosen randomly among equals.
The cases of each stratum are then drawn by a seeded hash.

Required is the larger of the floor and share times size, rounded half up. Labels compare apart from
case and blanks; cases with a NULL or blank label belong to no stratum and rows that come twice are
one case. Strata without cases count, with nothing available.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20_240
#: Costs: serving floor and requirement, leaving a margin, more rows of a stratum, slack. A requirement that leaves
#: a margin costs less than any replacement, so no stratum with enough rows goes short for the sake of a margin.
FLOOR, WANTED, OFF_MARGIN, MORE, SLACK = 0, 1, 200, 1_000, 10_000
#: Rows of a stratum are ranked in so many salted parts before they meet.
SALTS = 64


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials; costs are not negative."""

    def __init__(self, nodes: int) -> None:
        self.graph: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, capacity: int, cost: float) -> int:
        self.graph[a].append(len(self.head))
        self.head.append(b)
        self.room.append(int(capacity))
        self.cost.append(cost)
        self.graph[b].append(len(self.head))
        self.head.append(a)
        self.room.append(0)
        self.cost.append(-cost)
        return len(self.head) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, source: int, sink: int) -> int:
        potential = [0.0] * len(self.graph)
        sent = 0
        while True:
            distance = [float("inf")] * len(self.graph)
            via = [-1] * len(self.graph)
            distance[source] = 0.0
            heap = [(0.0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > distance[a] + 1e-9:
                    continue
                for e in self.graph[a]:
                    b = self.head[e]
                    if self.room[e] and d + self.cost[e] + potential[a] - potential[b] < distance[b] - 1e-9:
                        distance[b] = d + self.cost[e] + potential[a] - potential[b]
                        via[b] = e
                        heapq.heappush(heap, (distance[b], b))
            if via[sink] < 0:
                return sent
            for n, d in enumerate(distance):
                if d < float("inf"):
                    potential[n] += d
            amount, n = 10**18, sink
            while n != source:
                amount = min(amount, self.room[via[n]])
                n = self.head[via[n] ^ 1]
            n = sink
            while n != source:
                self.room[via[n]] -= amount
                self.room[via[n] ^ 1] += amount
                n = self.head[via[n] ^ 1]
            sent += amount


def solve(first: list, other: list, floor: list[int], required: list[int], available: list[int], seed: int = SEED) -> tuple[list[int], list[int]]:
    """(quota, shortfall) of each stratum; ``first`` and ``other`` are its values in the two margins."""
    rng = np.random.default_rng(seed)
    rows, columns = sorted(set(first)), sorted(set(other))
    n = len(first)
    source, sink = 0, 1
    row_at = {v: 2 + i for i, v in enumerate(rows)}
    cell_at = [2 + len(rows) + i for i in range(n)]
    column_at = {v: 2 + len(rows) + n + i for i, v in enumerate(columns)}
    net = Flow(2 + len(rows) + n + len(columns))
    for v, at in row_at.items():
        wanted = sum(r for f, r in zip(first, required, strict=True) if f == v)
        net.arc(source, at, wanted, 0)
        net.arc(at, sink, wanted, SLACK)
    parts = []
    for i in range(n):
        low = min(floor[i], required[i], available[i])
        middle = min(required[i], available[i]) - low
        rest = max(0, available[i] - required[i])
        a, b = row_at[first[i]], cell_at[i]
        # beyond the requirement the price rises with what the stratum already gives, and equals fall at random
        step = max(1, required[i] // 4)
        more = [net.arc(a, b, min(step, rest - k * step), MORE + 5 * k + rng.random()) for k in range(min(8, -(-rest // step) if rest else 0))]
        if rest > 8 * step:
            more.append(net.arc(a, b, rest - 8 * step, MORE + 60 + rng.random()))
        parts.append((net.arc(a, b, low, FLOOR), net.arc(a, b, middle, WANTED), more))
        net.arc(b, column_at[other[i]], available[i], 0)
    for v, at in column_at.items():
        wanted = sum(r for o, r in zip(other, required, strict=True) if o == v)
        net.arc(at, sink, wanted, 0)
        net.arc(at, sink, sum(available), OFF_MARGIN)
    net.run(source, sink)
    quota, short = [], []
    for i, (low, middle, more) in enumerate(parts):
        base = net.flow(low) + net.flow(middle)
        quota.append(base + sum(net.flow(e) for e in more))
        short.append(required[i] - base)
    return quota, short


def same_label(label: Column) -> Column:
    """A label apart from case and blanks; NULL where nothing is left."""
    bare = F.upper(F.regexp_replace(label, "[\\s\\u00a0]+", ""))
    return F.when(bare != "", bare)


def _keys(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"k1": same_label(F.col("subqa")), "k2": same_label(F.col("language")), "k3": same_label(F.col("automatic_risk"))})


def classified(cases: DataFrame) -> DataFrame:
    """(case_id, k1, k2, k3) of the cases with all labels, each once."""
    return (
        _keys(cases.select("case_id", "subqa", "language", "automatic_risk").where(F.col("case_id").isNotNull()))
        .select("case_id", "k1", "k2", "k3")
        .where("k1 is not null and k2 is not null and k3 is not null")
        .dropDuplicates()
    )


def quotas(cases: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan, subqa, language, automatic_risk, required, available, quota, shortfall) of every stratum of every plan."""
    counts = classified(cases).groupBy("k1", "k2", "k3").agg(F.count("*").alias("available"))
    wanted = _keys(targets.dropDuplicates(["plan", "subqa", "language", "automatic_risk"])).withColumn(
        "required", F.greatest(F.coalesce("min_rows", F.lit(0)), F.floor(F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0)) + 0.5 + 1e-9)).cast("bigint")
    )
    strata = wanted.join(counts, ["k1", "k2", "k3"], "left").select(
        "plan", "subqa", "language", "automatic_risk", "k1", F.concat_ws("|", "k2", "k3").alias("other"),
        F.coalesce("min_rows", F.lit(0)).cast("bigint").alias("floor"), "required", F.coalesce("available", F.lit(0)).cast("bigint").alias("available"),
    )

    def run(plan: pd.DataFrame) -> pd.DataFrame:
        plan = plan.sort_values(["subqa", "language", "automatic_risk"], kind="stable")
        quota, short = solve(
            plan["k1"].fillna("").tolist(), plan["other"].fillna("").tolist(), plan["floor"].tolist(), plan["required"].tolist(), plan["available"].tolist()
        )
        return plan.assign(quota=quota, shortfall=short)[["plan", "subqa", "language", "automatic_risk", "required", "available", "quota", "shortfall"]]

    return strata.groupBy("plan").applyInPandas(
        run, "plan string, subqa string, language string, automatic_risk string, required bigint, available bigint, quota bigint, shortfall bigint"
    )


def draw(cases: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(plan, subqa, language, automatic_risk, case_id): a sample of every plan, each stratum's quota of its cases.

    A stratum's cases are ranked by hash in salted parts, of which each keeps at most the quota, and
    then together; a quota is at most a plan's size, so no task meets a whole stratum.
    """
    wanted = _keys(quotas(cases, targets).where("quota > 0"))
    pool = classified(cases).join(wanted, ["k1", "k2", "k3"]).withColumn("h", F.xxhash64("plan", "case_id", F.lit(seed)))
    pool = pool.withColumn("salt", F.pmod("h", F.lit(SALTS)))
    stratum = ["plan", "subqa", "language", "automatic_risk"]
    part = Window.partitionBy(*stratum, "salt").orderBy("h", "case_id")
    kept = pool.withColumn("rank", F.row_number().over(part)).where("rank <= quota")
    whole = Window.partitionBy(*stratum).orderBy("h", "case_id")
    return kept.withColumn("rank", F.row_number().over(whole)).where("rank <= quota").select(*stratum, "case_id")
