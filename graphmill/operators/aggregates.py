"""Counts, shares, distributions and audit aggregates.

All are one or two partial aggregates over the input; group keys that can be hot
(a label, a source) are safe because partial results, not rows, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.workspace import checkpointed


def share(count: Column, total: Column, digits: int = 4) -> Column:
    return F.round(count / F.when(total != 0, total), digits)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_shares(df: DataFrame, key: str, k: int = 10, digits: int = 4) -> DataFrame:
    """key, n, share of all rows: the k most frequent keys; ties by key.

    The grand total is a window over the k-per-partition counts' input, so it comes from the groups, not from the rows.
    """
    grouped = df.groupBy(key).agg(F.count("*").alias("n"))
    total = grouped.agg(F.sum("n").alias("total"))
    return grouped.join(F.broadcast(total)).orderBy(F.desc("n"), key).limit(k).select(key, "n", share(F.col("n"), F.col("total"), digits).alias("share"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label, degree of every node, 0 for isolated ones; both directions count."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").select("id", "label", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).groupBy("label").agg(F.min("degree").alias("min_degree"), F.round(F.avg("degree"), 4).alias("avg_degree"), F.max("degree").alias("max_degree"))


#: Missing ids that are broadcast, at most.
BROADCAST = 100_000


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """dangling: the number of edges (src, dst) with an end that is no node's id.

    The distinct ends are held against the nodes, not the edges; these meet the few missing ids only.  A null end is none.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL").distinct()
    missing = checkpointed(ends.join(nodes.select("id"), "id", "left_anti"))
    mark = F.broadcast if missing.count() <= BROADCAST else lambda x: x
    side = lambda end: mark(missing.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")))
    found = edges.select("src", "dst").join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    return found.agg(F.count_if(F.col("_src").isNotNull() | F.col("_dst").isNotNull()).alias("dangling"))


def duplicates(triplets: DataFrame) -> DataFrame:
    """subject, relation, object, n of triplets stated more than once."""
    return counts(triplets, "subject", "relation", "object").where("n > 1")


def extraction_efficiency(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of ratios with their normalcy bands: 2 to 10 entities a chunk, 0.2 to 8 relations an entity, 500 to 5000 nodes."""
    n = chunks.agg(F.count("*").alias("chunks")).join(F.broadcast(entities.agg(F.count("*").alias("entities")))).join(F.broadcast(relations.agg(F.count("*").alias("relations"))))
    per_chunk, per_entity = share(F.col("entities"), F.col("chunks")), share(F.col("relations"), F.col("entities"))

    def band(x: Column, low: float, high: float) -> Column:
        return F.when(x < low, "low").when(x > high, "high").otherwise("normal")

    return n.select("chunks", "entities", "relations", per_chunk.alias("entities_per_chunk"), per_entity.alias("relations_per_entity"), band(per_chunk, 2, 10).alias("entity_band"), band(per_entity, 0.2, 8).alias("relation_band"), band(F.col("entities"), 500, 5000).alias("node_band"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, avg_chars; the row without a doc_id is the whole table."""
    return chunks.rollup("doc_id").agg(F.count("*").alias("n_chunks"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


def counts_by_type(chunks: DataFrame, types: tuple[str, ...] = ("text", "table", "title")) -> DataFrame:
    """doc_id, total, and a column of counts for each content type."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("content_type") == t).alias(f"n_{t}") for t in types))


def versions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row per key with the number of its versions; one shuffle by key."""
    own = Window.partitionBy(key)
    return rows.withColumns({"n_versions": F.count("*").over(own), "_rank": F.row_number().over(own.orderBy(F.desc(order)))}).where("_rank = 1").drop("_rank")


def rolled_up(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Aggregates per key, and one row with `all` for the total."""
    return df.rollup(key).agg(F.grouping(key).alias("_all"), *aggregates).withColumn(key, F.when(F.col("_all") == 1, "all").otherwise(F.col(key))).drop("_all")


def graph_quality(triplets: DataFrame) -> DataFrame:
    """One row: triplets, distinct relations, entities over both ends, triplets per relation, relations per entity."""
    ends = triplets.select(F.explode(F.array("subject", "object")).alias("e")).agg(F.countDistinct("e").alias("entities"))
    base = triplets.agg(F.count("*").alias("triplets"), F.countDistinct("relation").alias("relations"))
    return base.join(F.broadcast(ends)).select("triplets", "relations", "entities", F.round(F.col("triplets") / F.col("relations"), 2).alias("aof"), F.round(F.col("relations") / F.col("entities"), 4).alias("diversity"))


def relation_candidates(triplets: DataFrame, head: str, tail: str, k: int = 5) -> DataFrame:
    """relation, n, score: the relations of triplets that touch head or tail, with their share."""
    touching = triplets.where(F.col("subject").isin(head, tail) | F.col("object").isin(head, tail))
    return top_shares(touching, "relation", k).withColumnRenamed("share", "score")


def benchmark_summary(scores: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """mode, n, sums and rates from wide columns MODE_hit, MODE_accuracy (0 to 2), MODE_completeness (0 to 2)."""
    stacked = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"{m}_hit").alias("hit"), F.col(f"{m}_accuracy").alias("accuracy"), F.col(f"{m}_completeness").alias("completeness")) for m in modes)))
    long = scores.select(stacked.alias("s")).select("s.*")
    out = long.groupBy("mode").agg(F.count("*").alias("n"), *(F.sum(c).cast("long").alias(f"sum_{c}") for c in ("hit", "accuracy", "completeness")))
    return out.select("*", share(F.col("sum_hit"), F.col("n")).alias("hit_rate"), share(F.col("sum_accuracy"), 2 * F.col("n")).alias("accuracy_rate"), share(F.col("sum_completeness"), 2 * F.col("n")).alias("completeness_rate"))


def score_violations(scores: DataFrame, expected: DataFrame, key: str, allowed: dict[str, list]) -> DataFrame:
    """key, problem: ids missing or unknown, and values outside the allowed sets."""
    missing = expected.select(key).join(scores.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    unknown = scores.select(key).join(expected.select(key), key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    out = missing.unionByName(unknown)
    for column, values in allowed.items():
        out = out.unionByName(scores.where(~F.col(column).isin(values) | F.col(column).isNull()).select(key, F.lit(f"bad {column}").alias("problem")))
    return out


def mean_of_ratios(builds: DataFrame, key: str, amount: str, units: str, name: str) -> DataFrame:
    """Mean over builds of amount / units, builds without units left out."""
    return builds.where((F.col(units) > 0) & (F.col(amount) > 0)).groupBy(key).agg(F.count("*").alias("builds"), F.round(F.avg(F.col(amount) / F.col(units)), 6).alias(name))


#: Distinct values of a key that one task puts in order, at most about.
RANKED = 100_000


def quantiles(values: DataFrame, key: str, value: str, q: float, ranked: int = RANKED, accuracy: int = 10_000) -> DataFrame:
    """key, n, top, quantile: the value at index floor((n - 1) * q) of each key's values in order, exactly.

    No key's values are sorted by one task.  A sketch brackets the quantile by rank, the values below are counted, and
    those within are bracketed again until a key has at most `ranked` distinct ones left, each round a few thousandths
    of the last; equal values are one.  Rows without key or value are left out.
    """
    rows = values.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    state = rows.groupBy("_k").agg(F.count("*").alias("n"), F.max("_v").alias("top"), F.min("_v").alias("_low"))
    state = checkpointed(state.select("_k", "n", "top", "_low", F.col("top").alias("_high"), F.floor((F.col("n") - 1) * q).alias("_at")))
    left, before = rows, None
    while True:
        # Within the bracket: how many distinct values (about), and where a narrower bracket would be.
        part = F.col("_at") / F.greatest(F.col("_m") - 1, F.lit(1))
        inside = left.join(state.select("_k", "_low", "_high"), "_k").where("_v BETWEEN _low AND _high").select("_k", "_v")
        sizes = inside.groupBy("_k").agg(F.approx_count_distinct("_v").alias("_d"), F.count("*").alias("_m"), F.percentile_approx("_v", [i / 200 for i in range(201)], accuracy).alias("_p"))
        sizes = checkpointed(sizes)
        widest = sizes.agg(F.max("_d")).first()[0]
        if not widest or widest <= ranked or widest == before:
            break
        before = widest
        place = F.least(F.greatest(F.floor(part * 200).cast("int"), F.lit(1)), F.lit(199))
        low, high = F.get("_p", place - 1), F.get("_p", F.least(place + 2, F.lit(200)))
        narrow = state.join(sizes, "_k").withColumns({"_l": F.when(place <= 1, F.col("_low")).otherwise(low), "_h": F.when(place >= 198, F.col("_high")).otherwise(high)})
        narrow = narrow.select("_k", "n", "top", "_low", "_high", "_at", "_l", "_h")
        counts = inside.join(narrow.select("_k", "_l", "_h"), "_k").groupBy("_k").agg(F.count_if(F.col("_v") < F.col("_l")).alias("_below"), F.count_if(F.col("_v").between(F.col("_l"), F.col("_h"))).alias("_in"))
        moved = narrow.join(counts, "_k")
        fits = (F.col("_at") >= F.col("_below")) & (F.col("_at") < F.col("_below") + F.col("_in"))  # else the sketch was off: stay
        state = checkpointed(moved.select("_k", "n", "top", F.when(fits, F.col("_l")).otherwise(F.col("_low")).alias("_low"), F.when(fits, F.col("_h")).otherwise(F.col("_high")).alias("_high"), F.when(fits, F.col("_at") - F.col("_below")).otherwise(F.col("_at")).alias("_at")))
        left = checkpointed(inside)
    distinct = inside.groupBy("_k", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = distinct.withColumn("_to", upto).join(state, "_k").where("_to > _at").groupBy("_k", "n", "top").agg(F.min("_v").alias("quantile"))
    return found.withColumnRenamed("_k", key)


def robust_scale(values: DataFrame, key: str, value: str, q: float = 0.95, outlier_ratio: float = 1.5) -> DataFrame:
    """Scale per key: the quantile at index floor((n - 1) * q) if the maximum exceeds it by the ratio, else the maximum; 1 at least."""
    out = quantiles(values, key, value, q)
    scale = F.when(F.col("top") > F.col("quantile") * outlier_ratio, F.col("quantile")).otherwise(F.col("top"))
    return out.select(key, F.greatest(scale, F.lit(1.0)).alias("scale"))


def billed_means(calls: DataFrame, billed: Column, duration: str, cost: str) -> DataFrame:
    """One row: billed calls with a duration, and the means of duration and of cost over each one's own non-null rows."""
    own = calls.where(billed & F.col(duration).isNotNull())
    return own.agg(F.count("*").alias("calls"), F.round(F.avg(duration), 4).alias("avg_duration"), F.round(F.avg(cost), 4).alias("avg_cost"))


def ewma(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.2) -> DataFrame:
    """Exponentially weighted mean of a value per key, in order, started at the first value.

    sum over i of alpha * (1 - alpha)^(n - i) * x(i), with weight (1 - alpha)^(n - 1) for the first.  The first of
    `order` is a time: rows are numbered and summed within its days, and a day's sum counts (1 - alpha)^(rows after it),
    so a task holds a key's rows of one day, or its days.
    """
    day = F.to_date(order[0])
    cell = Window.partitionBy(key, "_day")
    placed = rows.withColumn("_day", day).withColumns({"_i": F.row_number().over(cell.orderBy(*order)), "_n": F.count("*").over(cell)})
    weight = F.pow(F.lit(1 - alpha), F.col("_n") - F.col("_i"))
    days = placed.groupBy(key, "_day").agg(F.count("*").alias("_n"), F.sum(weight * F.col(value)).alias("_sum"), F.max(F.when(F.col("_i") == 1, F.col(value))).alias("_first"))
    later = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumns({"_later": later, "_k": F.row_number().over(Window.partitionBy(key).orderBy("_day"))})
    part = F.lit(alpha) * F.pow(F.lit(1 - alpha), "_later") * F.coalesce("_sum", F.lit(0.0))
    start = F.when((F.col("_k") == 1) & F.col("_first").isNotNull(), F.lit(1 - alpha) * F.pow(F.lit(1 - alpha), F.col("_later") + F.col("_n") - 1) * F.col("_first"))
    return days.groupBy(key).agg(F.sum("_n").alias("n"), F.round(F.sum(part) + F.coalesce(F.sum(start), F.lit(0.0)), 6).alias("ewma"))


def document_status(n_images: Column, done: Column, good: Column, long: Column, high: float = 0.9, high_long: float = 0.7) -> Column:
    """NO_IMAGES, NOT_STARTED, IN_PROGRESS, HIGH or DONE from coverage counts."""
    return (
        F.when(n_images == 0, "NO_IMAGES")
        .when(done == 0, "NOT_STARTED")
        .when(done < n_images, "IN_PROGRESS")
        .when((good >= high * n_images) & (long >= high_long * n_images), "HIGH")
        .otherwise("DONE")
    )


def build_cost(chunks: Column, tokens_in: int = 2000, tokens_out: int = 800, price_in: float = 0.28, price_out: float = 1.14) -> Column:
    """Price of a build in proportion to its chunks; prices are for a million tokens."""
    return F.round(chunks * (tokens_in * price_in + tokens_out * price_out) / 1_000_000, 6)


def progress(stages: DataFrame) -> DataFrame:
    """run, overall, eta from stages (run, stage, weight, fraction, runtime, history).

    overall is the weighted fraction done, at most 0.99 before the end; the estimated total blends the run's own pace
    with the history by it, and falls back to whichever exists.
    """
    out = stages.groupBy("run").agg(F.sum(F.col("weight") * F.col("fraction")).alias("_done"), F.sum("weight").alias("_weight"), F.sum("runtime").alias("runtime"), F.max("history").alias("history"))
    overall = F.when(F.col("_done") >= F.col("_weight"), F.lit(1.0)).otherwise(F.least(F.col("_done") / F.col("_weight"), F.lit(0.99)))
    own = F.when(overall > 0, F.col("runtime") / overall)
    total = F.coalesce(own * overall + F.col("history") * (1 - overall), own, F.col("history"))
    return out.select("run", F.round(overall, 4).alias("overall"), F.round(F.greatest(total - F.col("runtime"), F.lit(0.0)), 4).alias("eta"))
