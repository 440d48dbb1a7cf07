"""Graph queries over nodes (id, label, name) and edges (src, rel, dst).

Searches go level by level: a level is a join of the frontier with the edges, the
frontier is broadcast while its counted size allows, and each level is written once,
so plans don't grow with depth.  The edges are written once for a search, one way;
a level reads them both ways, and shuffles them only where its frontier is too large
to broadcast.  Frontiers are bounded by the depth and, where an operator has one, by
its edge limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.text import is_reasonable_match
from graphmill.operators.components import connected_components
from graphmill.operators.joins import containing
from graphmill.workspace import checkpointed

BROADCAST = 100_000


def undirected(edges: DataFrame) -> DataFrame:
    """a, b, and the edge (src, rel, dst) of every edge both ways, in one pass."""
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.select("src", "rel", "dst", F.explode(ways).alias("w")).select("w.a", "w.b", "src", "rel", "dst")


def _stored(edges: DataFrame) -> DataFrame:
    """src, rel, dst, written once for all levels of a search."""
    return checkpointed(edges.select("src", "rel", "dst"))


def _light(rows: DataFrame) -> DataFrame:
    """Written rows, to be broadcast while their counted number allows."""
    return F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows


def search_nodes(nodes: DataFrame, text: str, k: int = 8, priority: tuple[str, ...] = (), least: float = 0.2) -> DataFrame:
    """id, label, name, score: reasonable matches by share of the length, else nodes that contain the text, score 0."""
    name = F.lower("name")
    wanted = text.lower()
    share = F.round(F.least(F.length(name), F.lit(len(wanted))) / F.greatest(F.length(name), F.lit(len(wanted)), F.lit(1)), 4)
    hits = nodes.where(name.contains(wanted) | F.lit(wanted).contains(name)).withColumn("_ok", is_reasonable_match(F.lit(text), F.col("name"), least))
    rank = F.coalesce(*(F.when(F.col("label") == p, i) for i, p in enumerate(priority)), F.lit(len(priority))) if priority else F.lit("").alias("_p")
    scored = hits.withColumn("score", F.when(F.col("_ok"), share).otherwise(0.0))
    top = scored.orderBy(F.desc("score"), rank, "name", "id").limit(k)
    any_ok = F.max(F.col("_ok").cast("int")).over(Window.partitionBy())  # over the k rows
    return top.withColumn("_any", any_ok).where(F.col("_ok") | (F.col("_any") == 0)).select("id", "label", "name", "score")


def related(nodes: DataFrame, edges: DataFrame, seeds: list[str], labels: tuple[str, ...], text: str, k: int = 5) -> DataFrame:
    """The first k nodes (id, label, name) of the labels by id that are next to a seed, else whose name contains the text."""
    wanted = nodes.where(F.col("label").isin(*labels))
    near = undirected(edges).where(F.col("b").isin(*seeds)).select(F.col("a").alias("id")).distinct()
    first = wanted.join(near, "id", "left_semi").withColumn("_tier", F.lit(1)).orderBy("id").limit(k)
    other = wanted.where(F.lower("name").contains(text.lower())).withColumn("_tier", F.lit(2)).orderBy("id").limit(k)
    best = F.min("_tier").over(Window.partitionBy())  # over at most 2 k rows
    return first.unionByName(other).withColumn("_best", best).where("_tier = _best").select("id", "label", "name")


def distances(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, dist of all nodes within depth of the seeds (id).  The edges are read at every level: a stored table."""
    both = undirected(edges).select("a", "b")
    reached = checkpointed(seeds.select("id").distinct().withColumn("dist", F.lit(0)))
    for level in range(1, depth + 1):
        front = reached.where(F.col("dist") == level - 1).select(F.col("id").alias("a"))
        new = both.join(_light(front), "a").select(F.col("b").alias("id")).distinct().join(reached, "id", "left_anti").withColumn("dist", F.lit(level))
        new = checkpointed(new)
        reached = reached.unionByName(new)
    return reached


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """src, rel, dst of the edges on a walk of at most depth edges from a seed: those with an end within depth - 1."""
    edges = _stored(edges)
    near = _light(distances(edges, seeds, depth - 1).select("id"))
    out = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "rel", "dst")).distinct()
    return out if most is None else out.orderBy("src", "rel", "dst").limit(most)


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 6) -> DataFrame:
    """step, id of one shortest undirected path; no rows if there is none.  Of several parents the smallest id counts.

    Two searches, from the start and from the end, go level by level, always the one with the fewer nodes in its last
    level, until these levels share nodes; so neither goes wider than half the path needs.  Those nodes' way to the end
    follows the end's levels back, and the path is read off in one job.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "step int, id string")
    both = undirected(_stored(edges)).select("a", "b")
    seed = lambda node: spark.createDataFrame([(node, None)], "id string, parent string")
    sides = [[seed(start)], [seed(end)]]
    reached, widths = [sides[0][0].select("id"), sides[1][0].select("id")], [1, 1]

    def stepped(front: DataFrame, width: int) -> DataFrame:
        ids = front.select(F.col("id").alias("a"))
        return both.join(F.broadcast(ids) if width <= BROADCAST else ids, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))

    met = None
    while met is None and all(widths) and len(sides[0]) + len(sides[1]) - 2 < most:
        k = 0 if widths[0] <= widths[1] else 1
        level = checkpointed(stepped(sides[k][-1], widths[k]).join(reached[k], "id", "left_anti"))
        sides[k].append(level)
        reached[k] = reached[k].unionByName(level.select("id"))
        widths[k] = level.count()
        shared = sides[0][-1].join(sides[1][-1].select("id"), "id", "left_semi")
        met = None if shared.isEmpty() else shared
    if met is None:
        return spark.createDataFrame([], "step int, id string")
    levels = [*sides[0][:-1], met]
    for back in reversed(sides[1][:-1]):
        last = checkpointed(levels[-1])
        levels[-1] = last
        levels.append(stepped(last, last.count()).join(back.select("id"), "id", "left_semi"))
    # The chain of parents: one row, a join for each step back.
    path = levels[-1].where(F.col("id") == end).select(F.array("id").alias("path"), "parent")
    for level in reversed(levels[:-1]):
        own = level.select(F.col("id").alias("parent"), F.col("parent").alias("_next"))
        path = own.join(F.broadcast(path), "parent").select(F.concat(F.array("parent"), "path").alias("path"), F.col("_next").alias("parent"))
    return path.select(F.posexplode("path").alias("step", "id"))


def trails(edges: DataFrame, starts: list[str], ends: list[str] | None, low: int, high: int, most: int) -> DataFrame:
    """hops, path: undirected trails, no edge twice, by hops and path.

    With ends, trails are walked from both sides and meet: none is built beyond half the hops, and one goes on only
    while its tip is near enough to the other side by exact distance.  Without ends they are walked from the starts.
    """
    edges = _stored(edges)
    key = F.concat_ws("|", "src", "rel", "dst")
    ways = undirected(edges).select("a", "b", key.alias("e"), (F.col("src") == F.col("dst")).alias("_loop"))
    both = ways.where("NOT _loop").drop("_loop").unionByName(ways.where("_loop").drop("_loop").distinct())

    def walked(seeds: list[str], hops: int, near: DataFrame | None) -> list[DataFrame]:
        """Trails of 0 to `hops` hops from the seeds: path, used, at.  near: id, left, the fewest hops from a node to the other side."""
        nodes = edges.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "at string")
        there = undirected(edges).select(F.col("a").alias("at")).join(F.broadcast(nodes), "at", "left_semi").distinct()
        out = [checkpointed(there.select(F.array("at").alias("path"), F.array().cast("array<string>").alias("used"), "at"))]
        for hop in range(1, hops + 1):
            step = both.join(_light(out[-1]), F.col("at") == F.col("a")).where(~F.array_contains("used", F.col("e")))
            step = step.select(F.concat("path", F.array("b")).alias("path"), F.concat("used", F.array("e")).alias("used"), F.col("b").alias("at"))
            if near is not None:
                step = step.join(_light(near.where(F.col("left") <= high - hop).select(F.col("id").alias("at"))), "at", "left_semi").select("path", "used", "at")
            out.append(checkpointed(step) if near is not None or hop < hops else step)
        return out

    found = []
    if ends is None:
        levels = walked(starts, high, None)
        found = [levels[h].select(F.lit(h).alias("hops"), F.array_join("path", " - ").alias("path")) for h in range(low, high + 1)]
    else:
        ids = lambda names: edges.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "id string")
        half = high // 2
        to_end = distances(edges, ids(ends), high - 1).withColumnRenamed("dist", "left")
        to_start = distances(edges, ids(starts), high - 1).withColumnRenamed("dist", "left")
        front, back = walked(starts, high - half, to_end), walked(ends, half, to_start)
        for h in range(low, high + 1):
            other = back[h // 2].select(F.col("at"), F.reverse("path").alias("_rest"), F.col("used").alias("_used"))
            own = front[h - h // 2].join(other, "at").where(~F.arrays_overlap("used", "_used"))
            found.append(own.select(F.lit(h).alias("hops"), F.array_join(F.concat("path", F.slice("_rest", 2, high + 1)), " - ").alias("path")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.orderBy("hops", "path").limit(most)


def neighbours(edges: DataFrame, nodes: DataFrame, seed: Column) -> DataFrame:
    """Of the nodes that `seed` selects: id, rel, direction, other, label, name."""
    ids = nodes.where(seed).select("id")
    out = edges.join(ids, edges["src"] == ids["id"]).select("id", "rel", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    into = edges.join(ids, edges["dst"] == ids["id"]).select("id", "rel", F.lit("in").alias("direction"), F.col("src").alias("other"))
    return out.unionByName(into).join(nodes.select(F.col("id").alias("other"), "label", "name"), "other").select("id", "rel", "direction", "other", "label", "name")


def skeleton(edges: DataFrame, nodes: DataFrame, rel: str, root: Column, depth: int = 3) -> DataFrame:
    """root, id, level of the nodes below the roots by one relation, by chained joins."""
    down = edges.where(F.col("rel") == rel).select(F.col("src").alias("at"), "dst")
    level = nodes.where(root).select(F.col("id").alias("root"), F.col("id").alias("at"))
    out = None
    for i in range(1, depth + 1):
        level = level.join(down, "at").select("root", F.col("dst").alias("at"))
        one = level.select("root", F.col("at").alias("id"), F.lit(i).alias("level"))
        out = one if out is None else out.unionByName(one)
    return out


def communities(hits: DataFrame, nodes: DataFrame, key: str, least: int = 3, show: int = 8) -> DataFrame:
    """key, label, size, members: groups of hits (key, id) with one label that are large enough; the first members by name."""
    rows = hits.join(nodes, "id")
    top = rows.withColumns({"_r": F.row_number().over(Window.partitionBy(key, "label").orderBy("name", "id")), "size": F.count("*").over(Window.partitionBy(key, "label"))})
    return top.where((F.col("size") >= least) & (F.col("_r") <= show)).groupBy(key, "label", "size").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "name"))), lambda m: m["name"]), ",").alias("members"))


def bridges(components: DataFrame, scores: DataFrame, candidates: int = 8) -> DataFrame:
    """Synthetic links that tie every component to the largest one: src, dst, score.

    components: node, component; scores: node, score.  The best `candidates` nodes of each side are considered, and of
    these the best on each side are linked; the largest component's are at most `candidates` rows and are broadcast.
    """
    sized = components.join(scores, "node")
    sizes = sized.groupBy("component").agg(F.count("*").alias("_n"))
    main = sizes.orderBy(F.desc("_n"), "component").limit(1).select(F.col("component").alias("_main"))
    best = Window.partitionBy("component").orderBy(F.desc("score"), "node")
    heads = sized.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= candidates).join(F.broadcast(main))
    hub = heads.where(F.col("component") == F.col("_main")).where("_r = 1").select(F.col("node").alias("dst"), F.col("score").alias("_hub"))
    rest = heads.where((F.col("component") != F.col("_main")) & (F.col("_r") == 1)).select(F.col("node").alias("src"), "score")
    return rest.join(F.broadcast(hub)).select("src", "dst", F.round(F.col("score") + F.col("_hub"), 4).alias("score"))


def components_of(edges: DataFrame) -> DataFrame:
    return connected_components(edges)


def space_edges(points: DataFrame, spaces: DataFrame) -> DataFrame:
    """answer, src, rel, dst, weight: which knowledge points (answer, id, text, applies) guide which spaces (answer, id, name).

    A point that names spaces guides those with an equal, longer or shorter name (0.9).  One that names none guides those
    whose name, or a word of two letters and more of it, is in its text (0.7).  Case is ignored; nulls match nothing.
    """
    own = points.select("answer", F.col("id").alias("text_id"), F.lower("text").alias("text"), F.coalesce("applies", F.array().cast("array<string>")).alias("applies"))
    named = spaces.select("answer", F.col("id").alias("word_id"), F.lower("name").alias("word"))
    said = own.where(F.size("applies") > 0).select("answer", "text_id", F.explode("applies").alias("said")).select("answer", "text_id", F.lower("said").alias("text"))
    longer = containing(said, named, ["answer"])
    turned = containing(named.select("answer", F.col("word_id").alias("text_id"), F.col("word").alias("text")), said.select("answer", F.col("text_id").alias("word_id"), F.col("text").alias("word")), ["answer"])
    explicit = longer.unionByName(turned.select("answer", F.col("word_id").alias("text_id"), F.col("text_id").alias("word_id"))).distinct()
    words = F.filter(F.split("word", r"\s+"), lambda w: F.length(w) > 1)
    terms = named.select("answer", "word_id", F.explode(F.array_distinct(F.concat(F.array("word"), words))).alias("word"))
    implied = containing(own.where(F.size("applies") == 0).select("answer", "text_id", "text"), terms, ["answer"])
    edges = lambda found, weight: found.select("answer", F.col("text_id").alias("src"), F.lit("GUIDES").alias("rel"), F.col("word_id").alias("dst"), F.lit(weight).alias("weight"))
    return edges(explicit, 0.9).unionByName(edges(implied, 0.7))


def inferred_methods(questions: DataFrame, items: DataFrame, methods: list[tuple[str, str]], most: int = 3) -> DataFrame:
    """answer, method, place: the first methods (keyword, name) of an answer, those of its question before its items'.

    questions: answer, text; items: answer, id, name.  Within both, and over items by id, the list's order holds.
    """
    hits = lambda text: F.filter(F.array(*(F.when(F.lower(text).contains(k.lower()), F.struct(F.lit(i).alias("i"), F.lit(m).alias("m"))) for i, (k, m) in enumerate(methods))), lambda h: h.isNotNull())
    asked = questions.select("answer", F.lit(0).alias("tier"), F.lit(None).cast(items.schema["id"].dataType).alias("id"), F.explode(hits(F.col("text"))).alias("h"))
    found = asked.unionByName(items.select("answer", F.lit(1).alias("tier"), "id", F.explode(hits(F.col("name"))).alias("h")))
    first = found.groupBy("answer", F.col("h.m").alias("method")).agg(F.min(F.struct("tier", "id", "h.i")).alias("at"))
    place = F.row_number().over(Window.partitionBy("answer").orderBy("at", "method"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("answer", "method", "place")


def method_edges(methods: DataFrame, points: DataFrame, spaces: DataFrame) -> DataFrame:
    """answer, src, rel, dst, weight of methods (answer, method): GUIDES to the answer's spaces (answer, id), and
    MENTIONED_IN to its points (answer, id, text) whose text contains a word of the method's name, case ignored.

    An answer has a few methods, so its points and spaces meet a small array of them.  Without a method there is no edge.
    """
    own = checkpointed(methods.groupBy("answer").agg(F.collect_set("method").alias("_m")))
    own = F.broadcast(own) if own.count() <= BROADCAST else own  # so texts stay where they are: a few answers may have all points
    guided = spaces.select("answer", "id").distinct().join(own, "answer").select("answer", F.explode("_m").alias("src"), F.lit("GUIDES").alias("rel"), F.col("id").alias("dst"), F.lit(0.8).alias("weight"))
    known = points.select("answer", "id", F.lower("text").alias("_text")).join(own, "answer")
    said = F.filter("_m", lambda m: F.exists(F.split(F.lower(m), r"\s+"), lambda w: F.col("_text").contains(w)))
    told = known.select("answer", F.explode(said).alias("src"), F.lit("MENTIONED_IN").alias("rel"), F.col("id").alias("dst"), F.lit(0.9).alias("weight"))
    return guided.unionByName(told.distinct())
