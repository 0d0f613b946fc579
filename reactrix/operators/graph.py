"""Item-to-item walks: all seeds and policies advance together, one keyed join per hop."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions.stats import draw
from ..session import stage


@dataclass(frozen=True)
class Policy:
    """How a hop chooses its next frontier: width, least pool size, depth cap, tiers and order."""

    name: str
    width: int
    least: int
    cap: int
    second_tier: bool = False
    order: str = "best"  # best percentile | random | earliest


# The six walk policies.
POLICIES = (
    Policy("A", 5, 5, 4, True, "best"), Policy("B", 5, 5, 4, True, "random"), Policy("C", 2, 2, 12, False, "random"),
    Policy("C2", 2, 1, 15, False, "random"), Policy("D", 5, 3, 8, False, "best"), Policy("E", 2, 1, 25, False, "earliest"),
)
KEY = ["policy", "seed"]


def _choice_key(policies: Sequence[Policy], hop: int) -> Column:
    """Sort key inside a pool; the top tier goes first, its order is the policy's, the second tier's is random."""
    rnd = draw(F.concat_ws(":", "policy", "seed", F.lit(hop), "item_id"), 1 << 31).cast("double")
    top = F.col("ptier") == "top"
    key = F.when(F.lit(False), F.lit(0.0))
    for p in policies:
        by = {"best": F.when(top, -F.col("pct")).otherwise(1.0 + rnd), "random": rnd,
              "earliest": F.coalesce(F.unix_timestamp("pub_ts"), F.lit(0)).cast("double")}[p.order]
        key = key.when(F.col("policy") == p.name, by)
    return key


def _by_policy(policies: Sequence[Policy], field: str) -> Column:
    return F.element_at(F.create_map(*[x for p in policies for x in (F.lit(p.name), F.lit(getattr(p, field)))]), F.col("policy"))


def related(front: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, src, dst): where the items of a frontier lead. Edges are (src, dst), or memberships (part, item), which
    are followed from item to part to item for the frontier only."""
    if "part" not in edges.columns:
        return front.join(edges, F.col("item_id") == F.col("src")).select(*keys, "src", "dst")
    parts = front.join(edges.withColumnRenamed("item", "src"), F.col("item_id") == F.col("src")).select(*keys, "src", "part")
    return parts.join(edges.withColumnRenamed("item", "dst"), "part").filter("src <> dst").select(*keys, "src", "dst")


def frontier_expansion(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, policies: Sequence[Policy] = POLICIES,
                       depth: int | None = None, budget: int | None = None) -> DataFrame:
    """Every node reached: (policy, seed, hop, item_id, ptier, in_pool, spent, chosen).

    Each hop is written to shared storage, which cuts lineage; the visited set is the union of those tables.
    Pools are counted by aggregation and the next frontier is a pruned top-k, so one very long related list
    is never gathered in a task.
    """
    start = stage(seeds.select(F.explode(F.array(*[F.lit(p.name) for p in policies])).alias("policy"), F.col("item_id").alias("seed")), "frontier")
    frontier = start.select("policy", "seed", F.col("seed").alias("item_id"), F.lit(0).cast("long").alias("spent"))
    visited = start.select("policy", "seed", F.col("seed").alias("item_id"))
    scores = nodes.select("item_id", "ptier", "pct", "pub_ts")
    widest = max(p.width for p in policies)
    reached_tables, chosen_tables = [], []
    for hop in range(1, (max(p.cap for p in policies) if depth is None else depth) + 1):
        live = frontier.filter(F.lit(hop) <= _by_policy(policies, "cap"))
        if budget is not None:
            live = live.filter(F.col("spent") < budget)
        cost = live.groupBy(*KEY).agg((F.max("spent") + F.count("*")).alias("spent"))
        reached = related(live, edges, KEY).select(*KEY, F.col("dst").alias("item_id")).distinct()
        fresh = reached.join(visited, [*KEY, "item_id"], "left_anti").join(scores, "item_id").join(F.broadcast(cost), KEY)
        pool = (F.col("ptier") == "top") | ((F.col("ptier") == "fine") & _by_policy(policies, "second_tier"))
        later = (F.col("ptier") == "fine") & (_by_policy(policies, "order") != "random")
        table = stage(fresh.select(
            *KEY, F.lit(hop).cast("long").alias("hop"), "item_id", "ptier", pool.alias("in_pool"), later.alias("_later"),
            _choice_key(policies, hop).alias("_key"), "spent"), f"hop{hop}")
        enough = table.groupBy(*KEY).agg(F.count_if("in_pool").alias("_n")).filter(F.col("_n") >= _by_policy(policies, "least")).drop("_n")
        best = O.top_per_group(table.filter("in_pool"), KEY, ["_later", "_key", "item_id"], widest, "choice").filter(F.col("choice") <= _by_policy(policies, "width"))
        chosen = stage(best.join(F.broadcast(enough), KEY).select(*KEY, "hop", "item_id", "spent"), f"chosen{hop}")
        reached_tables.append(table.drop("_later", "_key"))
        chosen_tables.append(chosen.select(*KEY, "hop", "item_id", F.lit(True).alias("chosen")))
        visited = visited.unionByName(table.select(*KEY, "item_id"))
        frontier = chosen.select(*KEY, "item_id", "spent")
        if frontier.isEmpty():
            break
    everyone, picked = reduce(DataFrame.unionByName, reached_tables), reduce(DataFrame.unionByName, chosen_tables)
    return everyone.join(picked, [*KEY, "hop", "item_id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def hop_summary(walk: DataFrame) -> DataFrame:
    return walk.groupBy(*KEY, "hop").agg(
        F.count("*").alias("reached"), F.count_if(F.col("ptier") == "top").alias("tops"), F.count_if(F.col("ptier") == "fine").alias("fines"),
        F.count_if("in_pool").alias("pool_n"), F.count_if("chosen").alias("chosen"), F.min(F.when(F.col("chosen"), F.col("item_id"))).alias("least_chosen"))


def hop_requests(walk: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """(policy, seed, hop, requests, finds): one request per frontier item of a hop, also where it reached nothing new."""
    hops = hop_summary(walk).select(*KEY, "hop", "tops", "chosen")
    first = hops.select(*KEY).distinct().select(*KEY, F.lit(1).cast("long").alias("hop"), F.lit(1).cast("long").alias("requests"))
    later = hops.filter((F.col("chosen") > 0) & (F.col("hop") < _by_policy(policies, "cap"))).select(
        *KEY, (F.col("hop") + 1).alias("hop"), F.col("chosen").alias("requests"))
    return first.unionByName(later).join(hops.drop("chosen"), [*KEY, "hop"], "left").select(
        *KEY, "hop", "requests", F.coalesce("tops", F.lit(0)).cast("long").alias("finds"))


def hop_efficiency(requests: DataFrame) -> DataFrame:
    """Finds per request of each policy and hop: how the yield falls along the walk."""
    return requests.groupBy("policy", "hop").agg(F.sum("requests").alias("requests"), F.sum("finds").alias("finds")).withColumn(
        "finds_per_request", F.col("finds") / F.col("requests"))


def best_flows(requests: DataFrame, n: int = 8) -> DataFrame:
    """The n flows with most finds per request; ties go to more finds, then to policy and seed."""
    flows = requests.groupBy(*KEY).agg(F.sum("requests").alias("requests"), F.sum("finds").alias("finds"))
    return flows.withColumn("finds_per_request", F.col("finds") / F.col("requests")).orderBy(
        F.desc("finds_per_request"), F.desc("finds"), *KEY).limit(n)


def walk_status(walk: DataFrame, policies: Sequence[Policy] = POLICIES, budget: int | None = None) -> DataFrame:
    """Depth and status per (policy, seed): censored at the cap or by budget, else dry/pruned where supply ended."""
    ends = walk.groupBy(*KEY).agg(F.max("hop").alias("depth"), F.count_if(F.col("ptier") == "top").alias("tops"), F.count("*").alias("nodes"), F.max("spent").alias("_spent"),
                                  F.max(F.when(F.col("chosen"), F.col("hop"))).alias("_last"))
    going = F.coalesce(F.col("_last") == F.col("depth"), F.lit(False))  # the last hop still chose a frontier
    dry = F.when(_by_policy(policies, "second_tier"), "dry").otherwise("pruned")
    status = F.when(going & (F.col("depth") >= _by_policy(policies, "cap")), "censored_depth")
    if budget is not None:
        status = status.when(going & (F.col("_spent") >= budget), "censored_budget")
    return ends.withColumn("status", status.otherwise(dry)).drop("_spent", "_last")


def two_level_chain(seeds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Seeds to related items (level 1), the two best hits per seed expanded again (level 2); rates per chain."""
    def expand(front, level):
        near = related(front, edges, ["chain", "seed"]).select("chain", "seed", F.col("dst").alias("item_id"), F.lit(level).alias("level")).distinct()
        return near.join(nodes.select("item_id", "kind", "like_rate"), "item_id")

    one = expand(seeds.withColumn("seed", F.col("item_id")), 1)
    hits = O.top_per_group(one.filter("kind = 'signature'"), ["chain", "seed"], [F.desc("like_rate"), "item_id"], 2)
    two = expand(hits.select("chain", "seed", "item_id"), 2)
    return one.unionByName(two).groupBy("chain", "level").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "signature").alias("hits"), F.count_if(F.col("kind").startswith("near")).alias("near_misses"),
        F.avg((F.col("kind") == "signature").cast("double")).alias("hit_rate"))
