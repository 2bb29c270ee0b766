"""Splits in which all records of an account land together, by min-cost flow over bundles of alike components.

A component is all records of one account, or one record without an account; `joined_keys` gives components over several keys.
Components are bundled by identical size and label. Min-cost flow fills the quotas of the splits and of each label within them, deviations cost. The flow is rounded to
whole components, largest first, and the members of a bundle go to their splits in the order of a hash, by exact cutoffs.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrill.llm.accounts import account, source_name
from sparkrill.llm.bisect import cutoffs
from sparkrill.operators.components import components as linked
from sparkrill.storage import written

MOVED = 0.001  # of all records: roundings after which the flow is solved again
LABEL_COST, SPLIT_COST = 1, 100


class Flow:
    """Successive shortest paths with potentials."""

    def __init__(self, n: int) -> None:
        self.edges: list[list[int]] = []  # to, capacity, cost
        self.at: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.at[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.at[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> None:
        n = len(self.at)
        potential = [0] * n
        while True:
            distance, via = [None] * n, [-1] * n
            distance[source] = 0
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > distance[a]:
                    continue
                for e in self.at[a]:
                    b, capacity, cost = self.edges[e]
                    if capacity > 0:
                        further = d + cost + potential[a] - potential[b]
                        if distance[b] is None or further < distance[b]:
                            distance[b], via[b] = further, e
                            heapq.heappush(heap, (further, b))
            if distance[sink] is None:
                return
            potential = [p + d if d is not None else p for p, d in zip(potential, distance)]
            amount, b = None, sink
            while b != source:
                amount = self.edges[via[b]][1] if amount is None else min(amount, self.edges[via[b]][1])
                b = self.edges[via[b] ^ 1][0]
            b = sink
            while b != source:
                self.edges[via[b]][1] -= amount
                self.edges[via[b] ^ 1][1] += amount
                b = self.edges[via[b] ^ 1][0]


def _shares(total: int, shares: Sequence[float]) -> list[int]:
    """Whole numbers in these shares that add up to total, by largest remainders."""
    scale = sum(shares)
    exact = [total * s / scale for s in shares]
    whole = [int(x) for x in exact]
    for k in sorted(range(len(shares)), key=lambda k: (whole[k] - exact[k], k))[: total - sum(whole)]:
        whole[k] += 1
    return whole


def _filled(sizes: dict[str, int], by_label: dict[str, list[float]], missing: Sequence[float], shares: Sequence[float]) -> dict[str, list[int]]:
    """Records of each label for each split, by min-cost flow: what a label and a split still lack costs nothing, deviations cost."""
    labels, splits = sorted(sizes), len(shares)
    first_cell = 1 + len(labels)
    first_split = first_cell + len(labels) * splits
    sink = first_split + splits
    flow, rest = Flow(sink + 1), sum(sizes.values())
    arcs = {}
    for k, label in enumerate(labels):
        flow.edge(0, 1 + k, sizes[label], 0)
        lacking = [max(x, 0.0) for x in by_label[label]]
        for s, quota in enumerate(_shares(sizes[label], lacking if sum(lacking) else shares)):
            cell = first_cell + k * splits + s
            arcs[label, s] = flow.edge(1 + k, cell, sizes[label], 0)
            flow.edge(cell, first_split + s, quota, 0)
            flow.edge(cell, first_split + s, sizes[label], LABEL_COST)
    lacking = [max(x, 0.0) for x in missing]
    for s, quota in enumerate(_shares(rest, lacking if sum(lacking) else shares)):
        flow.edge(first_split + s, sink, quota, 0)
        flow.edge(first_split + s, sink, rest, SPLIT_COST)
    flow.run(0, sink)
    return {label: [flow.edges[arcs[label, s] ^ 1][1] for s in range(splits)] for label in labels}


def quotas(bundles: list[tuple[int, str, int, int]], shares: Sequence[float]) -> list[list[int]]:
    """For each bundle (number, label, components, records) how many of its components each split gets.

    The flow gives the records of each label for each split; bundles of one label are alike to it, so that it runs over labels and splits
    only. It is rounded to whole components, bundles of large ones first, each bundle in the proportions that its label's
    flow still has, and solved again for the rest whenever roundings have moved more than MOVED of all records.
    """
    total, splits = sum(b[3] for b in bundles), len(shares)
    missing = [float(q) for q in _shares(total, shares)]
    sizes: dict[str, int] = {}
    for _, label, _, records in bundles:
        sizes[label] = sizes.get(label, 0) + records
    by_label = {label: [float(q) for q in _shares(n, shares)] for label, n in sizes.items()}
    result: list[list[int]] = [[0] * splits for _ in bundles]
    cells: dict[str, list[float]] = {}
    moved = float(total)
    for k in sorted(range(len(bundles)), key=lambda k: (-bundles[k][3] / bundles[k][2], bundles[k][0])):
        _, label, count, records = bundles[k]
        size = records / count
        if moved > MOVED * total:
            cells, moved = {name: [float(x) for x in row] for name, row in _filled(sizes, by_label, missing, shares).items()}, 0.0
        room = [max(x, 0.0) for x in cells[label]]
        whole = [int(count * x / sum(room) + 1e-9) if sum(room) else 0 for x in room]
        for _ in range(count - sum(whole)):
            s = max(range(splits), key=lambda s: (cells[label][s] - whole[s] * size, missing[s] - whole[s] * size, -s))
            whole[s] += 1
            moved += size
        for s, n in enumerate(whole):
            result[k][s] = n
            missing[s] -= n * size
            by_label[label][s] -= n * size
            cells[label][s] -= n * size
        sizes[label] -= records
    return result


def joined_keys(rows: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """(id, key) of each record: records that share a value of any key column, directly or over others, have the same key; one without any value a null key."""
    node = F.xxhash64(F.lit("record"), F.col(id_col).cast("string"))
    edges = [rows.filter(F.col(k).isNotNull()).select(node.alias("u"), F.xxhash64(F.lit(k), F.col(k).cast("string")).alias("v")) for k in keys]
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    found = linked(every, "u", "v").select(F.col("id").alias("u"), F.col("component").cast("string").alias("key"))
    return rows.select(F.col(id_col).alias("id"), node.alias("u")).join(found, "u", "left").select("id", "key")


def components_of(rows: DataFrame) -> DataFrame:
    """(component, n, label) of rows (id, key, label): all rows of a key, or one row without one. The label is the most frequent one, then the smaller."""
    named = rows.withColumn("component", F.coalesce(F.concat(F.lit("k"), F.col("key")), F.concat(F.lit("r"), F.col("id").cast("string"))))
    parts = named.groupBy("component", F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("m"))
    return parts.groupBy("component").agg(F.sum("m").alias("n"), F.max_by("label", F.struct(F.col("m"), F.col("label"))).alias("label"))


def assigned(rows: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """(id, key, split) of rows (id, key, label): no key in two splits, the shares of records as near to the targets as whole keys allow.

    shares: split name and share, not negative, in the order of preference among equals; they need not add up to 1. A null key is nobody's: such rows
    are placed one by one. Null labels are a label; a key's label profile is its most frequent label. Repeated rows count repeatedly and land together.
    An empty table gives an empty table.
    """
    rows = rows.select("id", "key", F.coalesce("label", F.lit("")).alias("label"))
    components = components_of(rows).withColumn("h", F.xxhash64("component"))
    components = written(components.withColumn("bundle", F.concat_ws("\u0001", F.col("n").cast("string"), F.col("label"))), "split-components")
    # Different sizes add up to the rows at most: there are fewer than the root of twice their number, times the labels.
    bundles = [(r.bundle, r.label, r.c, r.w) for r in components.groupBy("bundle", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w")).collect()]
    bundles.sort()
    plan = quotas([(k, label, c, w) for k, (_, label, c, w) in enumerate(bundles)], [s for _, s in shares]) if bundles else []
    spark, last = rows.sparkSession, len(shares) - 1
    needs = []
    for (name, *_), counts in zip(bundles, plan):
        running = 0
        for s, n in enumerate(counts[:-1]):
            running += n
            needs.append((name, s, running, f"{s}\u0001{name}"))
    wanted = spark.createDataFrame(needs, "bundle string, s int, need bigint, cell string")
    # All cutoffs of all splits together; a bundle that goes whole to one side needs none.
    open_cells = wanted.join(components.groupBy("bundle").agg(F.count("*").alias("c")), "bundle").filter("need > 0 and need < c").select("bundle", "cell", "need")
    cut = cutoffs(components.select("bundle", "h").join(open_cells.select("bundle", "cell"), "bundle"), open_cells.select("cell", "need"), "cell", "h", None, 256).select("cell", "cutoff")
    rule = wanted.join(cut, "cell", "left").groupBy("bundle").agg(*[F.max(F.when(F.col("s") == s, F.col(c))).alias(f"{c}{s}") for s in range(last) for c in ("need", "cutoff")], F.lit(0).alias("any"))
    sizes = components.groupBy("bundle").agg(F.count("*").alias("c"))
    split = F.lit(shares[-1][0])
    for s in reversed(range(last)):
        split = F.when((F.col(f"need{s}") > 0) & ((F.col(f"need{s}") >= F.col("c")) | (F.col("h") <= F.col(f"cutoff{s}"))), shares[s][0]).otherwise(split)
    where = components.join(rule, "bundle", "left").join(sizes, "bundle").select("component", split.alias("split"))
    named = rows.withColumn("component", F.coalesce(F.concat(F.lit("k"), F.col("key")), F.concat(F.lit("r"), F.col("id").cast("string"))))
    return named.join(where, "component").select("id", "key", "split")


def post_splits(posts: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, account, split) of every post; split_targets (split, share) is a fixed table."""
    shares = [(r.split, float(r.share)) for r in targets.filter("split is not null and share is not null").orderBy(F.col("share").desc(), "split").collect()]
    rows = posts.select(F.col("id").cast("bigint").alias("id"), account(F.col("author"), F.col("source")).alias("key"), source_name(F.col("source")).alias("label"))
    return assigned(rows, shares).select("id", F.col("key").alias("account"), "split")


def account_members(posts: DataFrame, targets: DataFrame) -> DataFrame:
    """(first_id, id): of each component that the flow keeps together, an account, the smallest post with each other post. Repeated rows give repeated rows."""
    placed = written(post_splits(posts, targets).filter("account is not null and id is not null"), "split-posts")
    firsts = placed.groupBy("account", "split").agg(F.min("id").alias("first_id"))
    return placed.join(firsts, ["account", "split"]).filter("id > first_id").select("first_id", "id")
