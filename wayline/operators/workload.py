"""Provider workload as tables: shared demands, feasibility, ranking, paths, and what to start and stop."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.session import written


def coalesced(demands: DataFrame) -> DataFrame:
    """Equal requirements (site, predicate, arguments) of several consumers are one, with the earliest expiry."""
    return demands.groupBy("site", "predicate", "arguments").agg(F.min("expires_at").alias("expires_at"), F.array_sort(F.collect_set("consumer")).alias("consumers"))


def load(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per plan and node: what new steps need, whether it fits, and the fullest resource's share. Running steps are free."""
    kinds = ("cpu", "memory", "gpu")
    asked = steps.where(~F.col("running")).groupBy("plan", "node").agg(*(F.sum(k).alias(k) for k in kinds))
    rows = asked.join(nodes.select("node", *(F.col(k).alias(f"free_{k}") for k in kinds)), "node")
    share = lambda k: F.when(F.col(k) == 0, 0.0).otherwise(F.coalesce(F.try_divide(F.col(k), F.col(f"free_{k}")), F.lit(float("inf"))))
    return rows.select("plan", "node", *kinds, F.greatest(*map(share, kinds)).alias("peak")).withColumn("fits", F.col("peak") <= 1)


def ranked(plans: DataFrame, best: int = 8) -> DataFrame:
    """The best plans per request: completion, slack, new providers, bytes, peak, quality, and at last the name."""
    order = [F.col("completion_ms"), F.desc_nulls_first("slack_ms"), F.col("new_providers"), F.col("bytes"), F.col("peak"), F.desc("quality"), F.col("plan")]
    return plans.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(*order))).where(F.col("rank") <= best)


def transfer_ms(latency, mbps, size):
    """Latency and transmission time; null where bytes have no known bandwidth."""
    return F.when(size == 0, latency).otherwise(latency + F.try_divide(size * 8, mbps * 1_000_000) * 1000)


def shortest_paths(links: DataFrame, most_hops: int | None = None) -> DataFrame:
    """Least latency between nodes of links (src, dst, latency_ms, mbps), with the narrowest hop's bandwidth.

    An unknown bandwidth makes the whole path's unknown. Paths are joined with paths, so that their hops double in each
    round, until none improves, which takes latencies that are not negative: log2 of the longest path's hops in rounds.
    Where most_hops is given, paths grow hop by hop instead, by at most that many hops after the first.
    """
    best = Window.partitionBy("src", "dst").orderBy("latency_ms", F.desc_nulls_last("mbps"))
    first = lambda df: df.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    hop = written(first(links.select("src", "dst", "latency_ms", "mbps").where("src <> dst")), "links")
    if most_hops is None and hop.where("latency_ms < 0").take(1):
        raise ValueError("a negative latency: paths could improve without end")
    paths = hop
    for _ in count() if most_hops is None else range(most_hops):
        p, h = paths.alias("p"), (paths if most_hops is None else hop).alias("h")
        narrow = F.when(F.col("p.mbps").isNotNull() & F.col("h.mbps").isNotNull(), F.least("p.mbps", "h.mbps"))
        longer = p.join(h, (F.col("p.dst") == F.col("h.src")) & (F.col("p.src") != F.col("h.dst"))).select(F.col("p.src"), F.col("h.dst"), (F.col("p.latency_ms") + F.col("h.latency_ms")).alias("latency_ms"), narrow.alias("mbps"))
        new = written(first(paths.unionByName(longer)), "paths")
        old = paths.select("src", "dst", F.col("latency_ms").alias("was"), F.col("mbps").alias("had"), F.lit(True).alias("known"))
        wider = F.col("latency_ms").eqNullSafe(F.col("was")) & F.col("mbps").isNotNull() & (F.col("had").isNull() | (F.col("mbps") > F.col("had")))
        changed = new.join(old, ["src", "dst"], "left").where(F.col("known").isNull() | (F.col("latency_ms") < F.col("was")) | wider)
        paths, done = new, not changed.take(1)
        if done:
            break
    return paths


def recipes(providers: DataFrame, wanted: str, most_depth: int = 8) -> DataFrame:
    """Chains of enabled providers (provider, input, output) from a source type (input null) to the wanted output."""
    enabled = providers.where("enabled").select("provider", "input", "output")
    chains = enabled.where(F.col("output") == wanted).select(F.array("provider").alias("chain"), "input")
    done = chains.where("input IS NULL")
    for _ in range(most_depth - 1):
        p = enabled.alias("p")
        open_ = chains.where("input IS NOT NULL").alias("c")
        chains = written(open_.join(p, (F.col("p.output") == F.col("c.input")) & ~F.array_contains("c.chain", F.col("p.provider"))).select(F.array_prepend("c.chain", F.col("p.provider")).alias("chain"), F.col("p.input").alias("input")), "recipes")
        if not chains.take(1):
            break
        done = done.unionByName(chains.where("input IS NULL"))
    return done.select("chain", F.size("chain").alias("steps"))


def recipe_trees(providers: DataFrame, raw: list[str], wanted: str, most_depth: int = 8, most: int = 64) -> DataFrame:
    """(recipe, depth) for a type of data, of enabled providers (provider, inputs array, output) over raw types.

    A provider takes all of its inputs, each by any of that type's recipes; a type is never needed for itself. Recipes
    are built from the raw types on, and `most` of a type are kept, shallow ones first and then by name.
    """
    spark = providers.sparkSession
    enabled = providers.where("enabled").select("provider", F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"), "output")
    widest = enabled.agg(F.max(F.size("inputs"))).first()[0] or 0
    known = spark.createDataFrame([(t, t, [t], 0) for t in raw], "type string, recipe string, uses array<string>, depth int")
    rank = Window.partitionBy("type").orderBy("depth", "recipe")
    count = -1
    for depth in range(1, most_depth + 1):
        part = enabled.withColumns({"parts": F.array().cast("array<string>"), "uses": F.array().cast("array<string>")})
        for k in range(widest):
            open_ = part.where(F.size("inputs") > k).join(known.select("type", "recipe", F.col("uses").alias("more")), F.get("inputs", F.lit(k)) == F.col("type"))
            open_ = open_.select("provider", "inputs", "output", F.array_append("parts", F.col("recipe")).alias("parts"), F.array_union("uses", "more").alias("uses"))
            part = part.where(F.size("inputs") <= k).unionByName(open_)
        new = part.where(~F.array_contains("uses", F.col("output"))).select(F.col("output").alias("type"), F.concat("provider", F.lit("("), F.array_join("parts", ","), F.lit(")")).alias("recipe"), F.array_append("uses", F.col("output")).alias("uses"), F.lit(depth).alias("depth"))
        every = known.unionByName(new).groupBy("type", "recipe").agg(F.min(F.struct("depth", "uses")).alias("m")).select("type", "recipe", "m.uses", "m.depth")
        known = written(every.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= most).drop("n"), "recipes")
        before, count = count, known.count()
        if count == before:
            break
    return known.where(F.col("type") == wanted).select("recipe", "depth")


def reconciled(running: DataFrame, wanted: DataFrame) -> DataFrame:
    """START, KEEP or STOP for each (node, provider) of what runs and what is wanted."""
    both = running.select("node", "provider", F.lit(True).alias("r")).distinct().join(wanted.select("node", "provider", F.lit(True).alias("w")).distinct(), ["node", "provider"], "full")
    return both.select("node", "provider", F.when(F.col("r") & F.col("w"), "KEEP").when(F.col("w"), "START").otherwise("STOP").alias("action"))


def start_order(actions: DataFrame, feeds: DataFrame) -> DataFrame:
    """What is to start, with `turn`: consumers before what feeds them, so that nothing is sent before it is heard.

    feeds (node, provider, consumer) are the streams within a node. A turn is the longest way to a provider that feeds
    nobody; in a ring, which has no such order, turns stop growing after as many rounds as there are providers.
    """
    start = actions.where("action = 'START'").select("node", "provider")
    turns = written(start.withColumn("turn", F.lit(0)), "turns")
    edges = written(feeds.join(start, ["node", "provider"], "left_semi").join(start.withColumnRenamed("provider", "consumer"), ["node", "consumer"], "left_semi").where("provider <> consumer"), "feeds")
    for _ in range(turns.count()):
        ahead = edges.join(turns.withColumnRenamed("provider", "consumer"), ["node", "consumer"]).groupBy("node", "provider").agg((F.max("turn") + 1).alias("ahead"))
        new = written(turns.join(ahead, ["node", "provider"], "left").select("node", "provider", F.greatest("turn", F.coalesce("ahead", F.lit(0))).alias("turn")), "turns")
        done = not new.join(turns.withColumnRenamed("turn", "was"), ["node", "provider"]).where("turn > was").take(1)
        turns = new
        if done:
            break
    return turns


def smoothed(samples: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Exponentially weighted throughput per link of samples (link, t, mbps); the first one is taken as it is."""
    from wayline.operators.sequential import fold

    def step(state: dict, row) -> list[tuple]:
        state["v"] = row.mbps if "v" not in state else alpha * row.mbps + (1 - alpha) * state["v"]
        return [(row.link, row.t, state["v"])]

    return fold(samples.select("link", "t", "mbps"), "link", ["t"], dict, step, "link string, t long, smoothed double")
