"""Construction and cleaning of a property graph from extracted facts.

Merges are aggregates with partial results; pairs are made within blocks only, never
over a whole type; rule tables are broadcast.
"""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.functions.text import INVERSE, inverse_relation
from graphmill.operators.components import connected_components
from graphmill.operators.joins import band_join, without
from graphmill.partitioning import dealt
from graphmill.workspace import checkpointed


def merged_entities(mentions: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: mentions, sorted distinct chunk ids, the longest description (ties to the smaller).

    Where mentions have `attributes`, an array, those of all mentions are united, sorted.
    """
    longest = F.min_by("description", F.struct(-F.length("description"), F.col("description")))
    out = mentions.groupBy(*key).agg(F.count("*").alias("mentions"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), longest.alias("description"))
    if "attributes" not in mentions.columns:
        return out
    listed = mentions.select(*key, F.explode("attributes").alias("_a")).groupBy(*key).agg(F.array_sort(F.collect_set("_a")).alias("attributes"))
    return out.join(listed, key, "left").withColumn("attributes", F.coalesce("attributes", F.array().cast(mentions.schema["attributes"].dataType)))


def scope_chains(mentions: DataFrame, parents: dict[str, tuple[str, ...]], scan: DataFrame | None = None) -> DataFrame:
    """chunk, entity, scope: for entities of a type with parent types, the sorted names of these types in the chunk.

    mentions: chunk, entity, type.  The names are gathered once for a chunk and type, not for each entity.  Rows are dealt
    once, by their chunk; scan: what to count for the partitions, see dealt().
    """
    rows = dealt(mentions.select("chunk", "entity", "type"), "chunk", scan=scan).distinct()
    table = mentions.sparkSession.createDataFrame([(t, p) for t, own in parents.items() for p in own], "type string, parent string")
    names = rows.select("chunk", F.col("type").alias("parent"), F.col("entity").alias("name")).join(F.broadcast(table.select("parent").distinct()), "parent", "left_semi")
    above = names.join(F.broadcast(table), "parent").groupBy("chunk", "type").agg(F.array_sort(F.collect_set("name")).alias("scope"))
    kinds = table.select("type").distinct()
    wanted = rows.join(F.broadcast(kinds), "type", "left_semi")
    scopes = above.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("type", "scope"))).alias("_scopes"))
    return wanted.join(scopes, "chunk", "left").select("chunk", "entity", F.coalesce(F.col("_scopes")[F.col("type")], F.array().cast("array<string>")).alias("scope"))


def reviewed(rows: DataFrame, constraints: dict, synonyms: dict, levels: list, accepted: dict, rejected: dict, fallback: bool = True, mention: str = "MENTIONED_IN", holder: str = "CONTAINS") -> DataFrame:
    """rows (subject, subject_type, relation, object, object_type) with action and reason.

    An end that is a page reference is rejected; a relation without a constraint, or ends of the types that it allows,
    need no review.  Of the others, without a fallback, all are rejected; else mentions are accepted, parts of a holder
    that look like a measure are rejected, and pairs of levels decide: `accepted` and `rejected` have them by relation.
    What is left goes to review.  levels: groups of words that name a level, by name, then by name and type.
    """
    from graphmill.functions.text import first_group, mapped

    name = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    kind = lambda c: mapped(F.col(c), synonyms, F.col(c)) if synonyms else F.col(c)
    page = r"^(p{1,2}\.?\s*\d+|\d+\s*页|page\s*\d+)$"
    relation = F.upper(F.trim("relation"))
    known = F.array(*map(F.lit, constraints)) if constraints else F.array().cast("array<string>")
    fits = F.lit(False)
    for r, (subjects, objects) in constraints.items():
        fits = fits | ((relation == r) & kind("subject_type").isin(*subjects) & kind("object_type").isin(*objects))
    measure = name("object").rlike(r"[:：]|不小于|不大于|>=|<=|≥|≤|\d+\s*(m²|㎡|m|mm|cm|%|℃|°c)$|\d+\s*[x×]\s*\d+")
    level = lambda n, t: first_group(F.col(n), levels, first_group(F.concat_ws(" ", F.col(n), kind(t)), levels, F.lit("")))
    pair = F.concat_ws(">", relation, level("subject", "subject_type"), level("object", "object_type"))
    pairs = lambda table: pair.isin(*(f"{r}>{a}>{b}" for r, own in table.items() for a, b in own)) if table else F.lit(False)
    rules = [
        (name("subject").rlike(page) | name("object").rlike(page), "reject", "page_reference"),
        (~F.array_contains(known, relation), "skip", "no_constraint"),
        (F.coalesce(fits, F.lit(False)), "skip", "schema_match"),
        (F.lit(not fallback), "reject", "schema_mismatch"),
        (relation == mention, "accept", "mention"),
        ((relation == holder) & measure, "reject", "attribute_fragment"),
        (pairs(accepted), "accept", "levels"),
        (pairs(rejected), "reject", "levels"),
    ]
    action, reason = F.lit("review"), F.lit("ambiguous")
    for cond, what, why in reversed(rules):
        action, reason = F.when(cond, what).otherwise(action), F.when(cond, why).otherwise(reason)
    return rows.withColumns({"action": action, "reason": reason})


def with_inverse(edges: DataFrame, confidence: float = 0.85) -> DataFrame:
    """Edges (src, rel, dst, confidence), and the inverse of those whose relation has one, at `confidence`."""
    forward = F.struct("src", "rel", "dst", "confidence", F.lit(False).alias("is_inverse"))
    back = F.struct(F.col("dst").alias("src"), inverse_relation(F.col("rel")).alias("rel"), F.col("src").alias("dst"), F.lit(confidence).alias("confidence"), F.lit(True).alias("is_inverse"))
    both = F.when(F.col("rel").isin(*INVERSE), F.array(forward, back)).otherwise(F.array(forward))
    return edges.select(F.explode(both).alias("e")).select("e.*")


def evidence(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Per edge the highest confidence, sorted distinct chunk and document ids and the number of statements."""
    return edges.groupBy(*keys).agg(
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"),
        F.array_sort(F.collect_set("doc_id")).alias("support_doc_ids"),
        F.count("*").alias("support_count"),
    )


def near_mentions(rows: DataFrame, at: str, window: int, least: int) -> DataFrame:
    """Pairs of a document's rows (doc_id, entity, position `at`) at most `window` apart, both ways round, right columns suffixed _r.

    Only pairs of entities that can be near `least` times are there: with n and m rows in the document they are so at most
    n * m times.  One of the two has the root of `least` or more rows then, so these rows alone are held against all, and
    pairs of entities that a document names once are neither built nor shuffled.
    """
    bar = math.isqrt(max(least, 1) - 1) + 1
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "entity")))
    found = band_join(counted.where(F.col("_n") >= bar), counted, ["doc_id"], at, window)
    found = found.where((F.col("entity") != F.col("entity_r")) & (F.col(at) != F.col(f"{at}_r")) & (F.col("_n") * F.col("_n_r") >= least))
    own = [c for c in rows.columns if c != "doc_id"]
    turn = lambda a, b: F.struct(*(F.col(f"{c}{a}").alias(c) for c in own), *(F.col(f"{c}{b}").alias(f"{c}_r") for c in own))
    ways = F.when(F.col("_n_r") >= bar, F.array(turn("", "_r"))).otherwise(F.array(turn("", "_r"), turn("_r", "")))
    return found.select("doc_id", F.explode(ways).alias("_w")).select("doc_id", "_w.*")


def cooccurrence(mentions: DataFrame, existing: DataFrame | None = None, window: int = 3, least: int = 2) -> DataFrame:
    """doc_id, a, b, support: ordered pairs of entities in different chunks of a document at most `window` apart.

    mentions: doc_id, sequence, entity.  The range join is bucketed by position, and pairs with an edge either way go.
    """
    rows = mentions.select("doc_id", "sequence", "entity").distinct()
    pairs = near_mentions(rows, "sequence", window, least).where(F.col("sequence") < F.col("sequence_r"))
    out = pairs.groupBy("doc_id", F.col("entity").alias("a"), F.col("entity_r").alias("b")).agg(F.count("*").alias("support")).where(F.col("support") >= least)
    return out if existing is None else without(out, existing.select("a", "b"), ["a", "b"], both_ways=("a", "b"))


def cooccurrence_edges(mentions: DataFrame, existing: DataFrame, rules: dict, window: int = 3, least: int = 2, plain: bool = True) -> DataFrame:
    """a, rel, b, confidence, support, doc_id, is_inverse: edges from entities that stand near one another.

    mentions: doc_id, sequence, entity, type; existing: src, rel, dst.  Chunks without entities don't count as distance,
    and each ordered pair of near chunks counts.  rules: (type of a, type of b) -> (relation, confidence), at least 0.6;
    other pairs are CO_OCCUR with 0.5, or 0.6 from three on, and only if `plain`.  No edge is made beside a stronger one
    of the same two, or twice.  Of several documents, and of both directions of a rule, the first by doc_id, a, b counts.
    Relations that have an inverse get that edge, too.
    """
    rows = mentions.select("doc_id", "sequence", "entity", "type").distinct()
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("sequence"))
    rows = rows.withColumn("at", place).drop("sequence")
    near = near_mentions(rows, "at", window, least)
    pairs = near.groupBy("doc_id", F.col("entity").alias("a"), F.col("entity_r").alias("b")).agg(F.count("*").alias("support"), F.max("type").alias("_ta"), F.max("type_r").alias("_tb")).where(F.col("support") >= max(1, least))
    table = mentions.sparkSession.createDataFrame([(a, b, r, float(c)) for (a, b), (r, c) in rules.items()], "_ta string, _tb string, rel string, _c double")
    pairs = pairs.join(F.broadcast(table), ["_ta", "_tb"], "left").withColumn("rel", F.coalesce("rel", F.lit("CO_OCCUR")))
    common = F.col("rel") == "CO_OCCUR"
    base = F.coalesce("_c", F.lit(0.5))
    confidence = F.when(~common | (F.col("support") >= max(least, 3)), F.greatest(base, F.lit(0.6))).otherwise(base)
    pairs = pairs.withColumn("confidence", confidence)
    if not plain:
        pairs = pairs.where(~common)
    strong = existing.where("rel <> 'CO_OCCUR'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = without(pairs, strong, ["a", "b"], both_ways=("a", "b"))
    pairs = checkpointed(without(pairs, existing.select(F.col("src").alias("a"), "rel", F.col("dst").alias("b")), ["a", "rel", "b"]))  # read twice
    order = F.struct("doc_id", "a", "b")
    two = {"_x": F.least("a", "b"), "_y": F.greatest("a", "b")}
    first = pairs.withColumns(two).where(~common).groupBy("_x", "_y").agg(F.min(order).alias("_first"))
    pairs = pairs.withColumns(two).join(first, ["_x", "_y"], "left")
    kept = pairs.where(F.when(common, F.col("_first").isNull() | (order < F.col("_first"))).otherwise(order == F.col("_first")))
    row = F.min(F.struct("doc_id", "confidence", "support")).alias("_row")
    out = kept.groupBy("a", "rel", "b").agg(row).select("a", "rel", "b", "_row.confidence", "_row.support", "_row.doc_id", F.lit(False).alias("is_inverse"))
    back = out.where(F.col("rel").isin(*INVERSE)).select(F.col("b").alias("a"), inverse_relation(F.col("rel")).alias("rel"), F.col("a").alias("b"), "confidence", "support", "doc_id", F.lit(True).alias("is_inverse"))
    return out.unionByName(back)


def optimized(triplets: DataFrame, names: DataFrame, relation: Column, order: list[str], least: float = 0.3) -> DataFrame:
    """Triplets (subject, relation, object, confidence) with names (old, new) and the relation in their standard form.

    relation: the standard form of column `relation`; SKIP or nothing leaves it as it is.  Statements about oneself,
    without a relation or of little confidence go; of equal ones, case aside, the first in order stays.  Each distinct
    relation is put in its form once.
    """
    valid = triplets.where(F.col("confidence") >= least)
    form = F.when(F.coalesce(relation, F.lit("")).isin("", "SKIP"), F.col("relation")).otherwise(relation)
    forms = triplets.select("relation").distinct().select(F.col("relation").alias("_raw"), form.alias("_form")).where(~F.coalesce("_form", F.lit("")).isin("", "SKIP"))
    columns = triplets.columns
    moved = renamed(valid.join(forms, F.col("relation").eqNullSafe(F.col("_raw"))).withColumn("relation", F.col("_form")).select(columns), names, scan=triplets)
    key = {f"_{c}": F.lower(c) for c in ("subject", "relation", "object")}
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return dealt(moved.where("subject <> object").withColumns(key), *key, scan=triplets).groupBy(*key).agg(first.alias("_row")).select("_row.*")


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / total length of the longest matching blocks, as difflib counts them."""
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


#: Names of a block that are held against those of another cell in one key of the join.
CELL = 2048


def fuzzy_pairs(names: DataFrame, kind: str, name: str, least: float = 0.9, score=matching_ratio, cell: int = CELL) -> DataFrame:
    """kind, a, b, score: all pairs of distinct names of a kind whose ratio is at least `least` (above 0).

    A ratio counts matched characters, so it is at most 2 * common / (length a + length b) with the characters that both
    have, repeats counted.  A name's characters, numbered by occurrence, are a set; put in one order for all names (rare
    ones first), two sets with so much in common share one of the first n - ceil(n * least / (2 - least)) + 1 members of
    each.  Names are blocked by these, and no pair is missed.  Blocks of more than `cell` names are dealt to cells, and
    each cell meets each cell under its own key.  A score other than the ratio must keep to the same bound.
    """
    chars = F.array_sort(F.split(name, ""))
    numbered = F.transform(chars, lambda x, i: F.concat(x, (i - F.array_position(chars, x) + 1).cast("string")))
    distinct = names.select(kind, name).where(F.length(name) > 0).distinct().withColumn("_set", numbered)
    members = distinct.select(kind, name, "_set", F.explode("_set").alias("_block"))
    # The counts only order the members: bounded by the alphabet, and the same for all names.
    counts = distinct.select(F.explode("_set").alias("_block")).groupBy("_block").agg(F.count("*").alias("_n"))
    first = F.row_number().over(Window.partitionBy(kind, name).orderBy("_n", "_block"))
    prefix = F.size("_set") - F.ceil(F.size("_set") * (least / (2 - least)) - 1e-9) + 1
    keyed = members.join(F.broadcast(counts), "_block").withColumn("_first", first).where(F.col("_first") <= prefix).drop("_n", "_first")
    cells = keyed.groupBy(kind, "_block").agg(F.ceil(F.count("*") / cell).cast("int").alias("_cells"))
    keyed = keyed.join(cells, [kind, "_block"]).withColumn("_own", F.pmod(F.xxhash64(name), F.col("_cells")).cast("int"))
    keyed = keyed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    a = keyed.select(kind, "_block", F.col("_own").alias("_x"), F.col("_other").alias("_y"), F.col(name).alias("a"), F.col("_set").alias("_a"))
    b = keyed.select(kind, "_block", F.col("_other").alias("_x"), F.col("_own").alias("_y"), F.col(name).alias("b"), F.col("_set").alias("_b"))
    needed = least * (F.size("_a") + F.size("_b")) - 1e-9
    pairs = a.join(b, [kind, "_block", "_x", "_y"]).where((F.col("a") < F.col("b")) & (2 * F.least(F.size("_a"), F.size("_b")) >= needed))
    pairs = pairs.where(2 * F.size(F.array_intersect("_a", "_b")) >= needed).select(kind, "a", "b").distinct()
    return pairs.withColumn("score", score(F.col("a"), F.col("b"))).where(F.col("score") >= least).withColumn("score", F.round("score", 4))


def redirects(merges: DataFrame) -> DataFrame:
    """node, target for merge pairs (src, dst), chains followed: the smallest id of the connected component."""
    return connected_components(merges).select("node", F.col("component").alias("target"))


def repointed(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with both ends moved (node, target), self loops dropped, duplicates merged."""
    src, dst = moves.select(F.col("node").alias("src"), F.col("target").alias("_s")), moves.select(F.col("node").alias("dst"), F.col("target").alias("_d"))
    out = edges.join(src, "src", "left").join(dst, "dst", "left").select(F.coalesce("_s", "src").alias("src"), "rel", F.coalesce("_d", "dst").alias("dst"))
    return out.where("src <> dst").distinct()


def renamed(triplets: DataFrame, names: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Triplets with one step of renaming (old, new) at both ends.  scan: what to count for the partitions, see dealt()."""
    s, o = names.select(F.col("old").alias("subject"), F.col("new").alias("_s")), names.select(F.col("old").alias("object"), F.col("new").alias("_o"))
    scan = triplets if scan is None else scan
    moved = dealt(dealt(triplets, "subject", scan=scan).join(s, "subject", "left"), "object", scan=scan).join(o, "object", "left")
    return moved.withColumns({"subject": F.coalesce("_s", "subject"), "object": F.coalesce("_o", "object")}).drop("_s", "_o")


def first_statements(triplets: DataFrame, order: list[str]) -> DataFrame:
    """Keep-first de-duplication of (subject, relation, object)."""
    first = F.min_by(F.struct(*triplets.columns), F.struct(*order))
    return triplets.groupBy("subject", "relation", "object").agg(first.alias("_row")).select("_row.*")


def strongest_statements(triplets: DataFrame) -> DataFrame:
    """The same by lower-case key with the highest confidence."""
    key = [F.lower(c).alias(c) for c in ("subject", "relation", "object")]
    return triplets.groupBy(*key).agg(F.max("confidence").alias("confidence"))


def latent_candidates(mentions: DataFrame, existing: DataFrame, most: int, cell: int = CELL) -> DataFrame:
    """a, b, docs: unordered pairs of entities of a document without an edge either way, by number of documents.

    mentions: doc_id, entity.  All entities of a document make pairs.  Documents of more than `cell` entities are dealt
    to cells, and each cell meets each cell under its own key.
    """
    rows = mentions.select("doc_id", "entity").where("entity IS NOT NULL").distinct()
    cells = rows.groupBy("doc_id").agg(F.ceil(F.count("*") / cell).cast("int").alias("_cells"))
    rows = rows.join(cells, "doc_id").withColumn("_own", F.pmod(F.xxhash64("entity"), F.col("_cells")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    a = rows.select("doc_id", F.col("_own").alias("_x"), F.col("_other").alias("_y"), F.col("entity").alias("a"))
    b = rows.select("doc_id", F.col("_other").alias("_x"), F.col("_own").alias("_y"), F.col("entity").alias("b"))
    pairs = a.join(b, ["doc_id", "_x", "_y"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("docs"))
    return without(pairs, existing.select("a", "b"), ["a", "b"], both_ways=("a", "b")).orderBy(F.desc("docs"), "a", "b").limit(most)


def relabelled(nodes: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """Nodes with the label of the first rule whose condition holds; `changed` marks them."""
    out = F.col("label")
    for cond, label in reversed(rules):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return nodes.withColumn("_new", out).withColumn("changed", F.col("_new") != F.col("label")).withColumn("label", F.col("_new")).drop("_new")


def unwrapped(values: Column) -> Column:
    """The element of a list of one, else null."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def upserted(target: DataFrame, new: DataFrame, key: str, value: str, listed: str) -> DataFrame:
    """Full outer upsert: the new value wins, lists are united and sorted."""
    t, n = target.select(key, F.col(value).alias("_tv"), F.col(listed).alias("_tl")), new.select(key, F.col(value).alias("_nv"), F.col(listed).alias("_nl"))
    none = F.array().cast(target.schema[listed].dataType)
    return t.join(n, key, "full").select(key, F.coalesce("_nv", "_tv").alias(value), F.array_sort(F.array_union(F.coalesce("_tl", none), F.coalesce("_nl", none))).alias(listed))
