"""Mixing sources to target weights, by a min-cost flow for overlapping sources.

Documents are summed by membership pattern (the set of sources they belong to), so that the flow has a node for each
pattern and source and none for documents. A pattern can give its words once at no cost and again at a cost that rises
with each repetition; a source takes its target. The flow says how many words each pattern gives, and documents are then
taken in a seeded order until that many words are reached.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Parts of the seeded order that are summed before the one in which a quota ends is looked at row by row.
PARTS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> dict:
    """Each source's target: the sources, by code point with null last, weigh ``weights`` in turn and share ``share`` of all
    sizes; what is above ``repeats`` times a source's size goes to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, live, out = share * sum(sizes.values()), list(order), dict.fromkeys(order, 0.0)
    while live:
        total = sum(weight[s] for s in live)
        over = [s for s in live if left * weight[s] / total > repeats * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in live}
        for s in over:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in over)
        live = [s for s in live if s not in over]
    return out


def flow(patterns: dict[str, float], members: dict[str, list], quota: dict, repeats: int = REPEATS) -> dict[str, dict]:
    """Words that each pattern gives each of its sources: a min-cost flow by successive shortest paths. A pattern's k-th
    copy costs k - 1 a word (a convex cost), so that words repeat only where a quota can't be filled otherwise."""
    edges: list[list] = []  # to, capacity, cost
    out: dict = {}

    def node(x) -> int:
        return out.setdefault(x, len(out))

    graph: dict[int, list[int]] = {}

    def edge(a, b, capacity: float, cost: float) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0.0, -cost)):
            graph.setdefault(node(x), []).append(len(edges))
            edges.append([node(y), c, w])
        return len(edges) - 2

    begin, end = ("begin",), ("end",)
    node(begin), node(end)
    used: dict[tuple, int] = {}
    for p, size in patterns.items():
        for k in range(repeats):
            edge(begin, ("p", p), float(size), float(k))
        for s in members[p]:
            used[p, s] = edge(("p", p), ("s", s), math.inf, 0.0)
    for s, q in quota.items():
        edge(("s", s), end, float(q), 0.0)
    a, z, least = node(begin), node(end), 1e-9 * max(1.0, sum(patterns.values()))
    while True:
        cost, via, queue = {a: 0.0}, {}, [a]
        for x in queue:  # Bellman-Ford by a queue
            for e in graph.get(x, ()):
                y, c, w = edges[e]
                if c > least and cost[x] + w < cost.get(y, math.inf) - 1e-12:
                    cost[y], via[y] = cost[x] + w, e
                    queue.append(y)
        if z not in via:
            break
        path, x = [], z
        while x != a:
            path.append(via[x])
            x = edges[via[x] ^ 1][0]
        most = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= most
            edges[e ^ 1][1] += most
    given: dict[str, dict] = {}
    for (p, s), e in used.items():
        given.setdefault(p, {})[s] = edges[e ^ 1][1]
    return given


def mix(docs: DataFrame, members, *, seed: int = 17, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, extra: tuple[str, ...] = ()) -> DataFrame:
    """How many words a mix takes of each document.

    ``members``: a column with the array of a document's sources (null is a source of its own). Returns doc_id, members (as
    JSON), size (words), taken (repeats counted) and the columns ``extra``. A document is taken whole, or as often as the
    flow says, but for the one in which its pattern's quota ends: it gives the words still missing. No document gives more
    than ``repeats`` times its size. Null and empty texts have size 0 and give 0. Rows are taken one by one, so that rows
    with equal ids are documents of their own. Reruns agree. An empty table gives none. As many rows as there are patterns
    and sources come to the driver. Also returns the targets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.xxhash64("doc_id", F.lit(seed))
    sized = scratch.keep(docs.select("doc_id", F.to_json(F.array_sort(F.array_distinct(members))).alias("members"), size.alias("size"), order.alias("order"), F.shiftrightunsigned(order, 52).cast("int").alias("part"), *extra), "sized")
    sums = {r.members: int(r.size) for r in sized.groupBy("members").agg(F.sum("size").alias("size")).collect()}
    sources = {p: json.loads(p) for p in sums}
    sizes: dict = {}
    for p, n in sums.items():
        for s in sources[p]:
            sizes[s] = sizes.get(s, 0) + n
    quota = targets(sizes, weights, share, repeats)
    given = flow(sums, sources, quota, repeats)
    rows = []
    for p, n in sums.items():
        words = min(round(sum(given.get(p, {}).values())), repeats * n)
        copies = min(words // n, repeats) if n else 0
        rows.append((p, int(copies), int(words - copies * n)))
    plan = spark.createDataFrame(rows, "members string, copies long, more long")
    parts = sized.groupBy("members", "part").agg(F.sum("size").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("members").orderBy("part")) - F.col("n"))
    edge = parts.join(plan, "members").filter("before <= more").groupBy("members").agg(F.max(F.struct("part", "before")).alias("x"))
    # one row for each pattern, as the driver has seen
    plan = F.broadcast(plan.join(edge.select("members", F.col("x.part").alias("edge"), F.col("x.before").alias("before")), "members", "left"))
    planned = sized.join(plan, "members", "left")
    columns = ["doc_id", "members", "size", *extra]
    whole = planned.filter("part <> edge or edge is null").select(*columns, (F.col("copies") * F.col("size") + F.when(F.col("part") < F.col("edge"), F.col("size")).otherwise(0)).alias("taken"))
    so_far = F.sum("size").over(Window.partitionBy("members").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    last = planned.filter("part = edge").withColumn("left", F.col("more") - F.col("before") - so_far)
    last = last.select(*columns, (F.col("copies") * F.col("size") + F.greatest(F.lit(0), F.least("left", "size"))).alias("taken"))
    return whole.unionByName(last), quota, sizes
