"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII
characters.  A fingerprint is a k-gram hash that is the smallest in some run of w
neighbouring k-gram hashes; two texts that share k + w - 1 words share a fingerprint
at the same place in these words.

A window is WINDOW consecutive words of an item, or the whole item if it is shorter.
Equal windows of all items are one, with the set of items that have it.  A window is
found by the fingerprint of its first k + w - 1 words.  Windows are put in classes by
length, and each class that occurs is searched with the longest k + w - 1 that its
shortest window allows, so no window is too short to be found; a benchmark without
short items is one pass over the documents.

1. Documents are cut to fingerprints and joined with those of the benchmark.  What is
   kept of a document is its number of words and the places of fingerprints hit.
2. Only documents with a hit are read again, with their words around each place, and
   each window that has the fingerprint is compared word by word.
3. Covered words are counted by start, and found windows are turned into items by
   their sets, each set once for a document.

Texts aren't shuffled, but for those with hits.  Broadcast are the benchmark's
fingerprints and windows, if there are at most BROADCAST of them, and the keys of
documents with hits, if there are at most KEYS; beyond these bounds the same is joined
by shuffle.

Defined cases
    A null text has no words, n_words 0 and no items.  Rows with equal doc_id and
    text get a row each, with equal values.  A null doc_id is a value like others;
    doc_id may have any plain type.  Items without words are left out; repeated items
    count once for an item_id; an item with a null id hits words but is in no list.
    Very long texts: a text has under 2^28 words, as Spark's arrays hold no more.
    Columns besides doc_id and text aren't read.  Empty tables: no documents give no
    rows, no items give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmill.llm.textarrays import free_name
from graphmill.workspace import checkpointed

WINDOW = 13
#: Shortest item of a class, k, w; k + w - 1 is the first of these.
CLASSES = [(13, 6, 8), (8, 4, 5), (4, 2, 3), (2, 2, 1), (1, 1, 1)]
#: Most windows of a benchmark that are broadcast (about 250 bytes each), and keys of documents (16 bytes).
BROADCAST, KEYS = 200_000, 1_000_000
_POSITION = 28  # bits of a packed fingerprint that hold its place
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = "".join(chr(c) for c in range(0x80) if not (chr(c).isdigit() or chr(c).isalpha()))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    trimmed = F.trim(plain)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " +"))


def _shifted(x: str, by: int) -> Column:
    return F.slice(F.col(x), F.lit(by + 1), F.size(x))


def fingerprints(rows: DataFrame, k: int, w: int) -> DataFrame:
    """The rows with `_fps`: distinct fingerprints of `_words`, packed as hash (35 bits) and place (28 bits)."""
    rows = rows.withColumn("_g", F.transform("_words", lambda x: F.xxhash64(x)))
    size, last = 1, "_g"
    if k > 1:
        rows = rows.withColumn("_g2", F.zip_with("_g", _shifted("_g", 1), lambda a, b: F.xxhash64(a, b)))
        size, last = 2, "_g2"
    while size < k:
        rows = rows.withColumn(f"_g{size + 2}", F.zip_with(last, _shifted("_g2", size), lambda a, b: F.xxhash64(a, b)))
        size, last = size + 2, f"_g{size + 2}"
    whole = F.slice(last, F.lit(1), F.greatest(F.size("_words") - (k - 1), F.lit(0)))
    rows = rows.withColumn("_m", F.transform(whole, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 29), _POSITION).bitwiseOR(i.cast("long"))))
    span, last = 1, "_m"
    while span < w:
        step = min(span, w - span)
        rows = rows.withColumn(f"_m{span + step}", F.zip_with(last, _shifted(last, step), lambda a, b: F.least(a, b)))
        span, last = span + step, f"_m{span + step}"
    return rows.withColumn("_fps", F.array_distinct(last)).drop(*(c for c in ("_g", *(f"_g{i}" for i in range(2, k + 1, 2)), *(f"_m{i}" for i in range(2, w + 1)), "_m")))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, _POSITION)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND((1 << _POSITION) - 1).cast("int")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key (_a, _b) of rows that are equal in these."""
    return docs.select("doc_id", "text").withColumns({"_a": F.xxhash64("doc_id", "text"), "_b": F.xxhash64(F.lit(1), "text", "doc_id")})


def _windows(items: DataFrame, low: int, longest: int, top: bool, k: int, w: int) -> DataFrame:
    """_win, _fp, _q, _size, _set, _items of the different windows of items (item_id, _item) of low to longest words.

    top: longer items, too, in windows of `longest` words.
    _fp: fingerprint of the first k + w - 1 words, at _q; _set names the items that have the window.
    """
    own = items.where(F.size("_item") >= low) if top else items.where(F.size("_item").between(low, longest))
    size = F.least(F.size("_item"), F.lit(longest))
    starts = F.sequence(F.lit(0), F.size("_item") - size)
    cut = own.select("item_id", F.explode_outer(F.transform(starts, lambda i: F.slice("_item", i + 1, size))).alias("_win"))
    sets = cut.groupBy("_win").agg(F.array_sort(F.collect_set("item_id")).alias("_items")).withColumn("_set", F.sha2(F.to_json("_items"), 256))
    first = fingerprints(sets.withColumn("_words", F.slice("_win", 1, k + w - 1)), k, w)
    mark = F.element_at("_fps", 1)
    return first.where(F.size("_fps") > 0).select("_win", _hash(mark).alias("_fp"), _place(mark).alias("_q"), F.size("_win").alias("_size"), "_set", "_items")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items of every row of docs; _a, _b are keys of rows that are equal in doc_id and text.

    items: sorted array of the item_ids, as text, that have a window in the document; n_hit: words in any of these.
    """
    keyed, key = _keyed(docs), ["_a", "_b"]
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("_item")).where(F.size("_item") > 0).distinct()
    classes = [c for c in CLASSES if c[0] <= window]
    bounds = [(low, min(window, high - 1), k, w) for (low, k, w), high in zip(classes, [1 << 31, *(c[0] for c in classes)])]
    kind = F.coalesce(*(F.when(F.size("_item") >= low, F.lit(low)) for low, _, _, _ in bounds))
    present = {r[0] for r in items.select(kind.alias("kind")).distinct().collect()}  # at most one row a class
    counted, found, sets = None, None, None
    for low, longest, k, w in [b for n, b in enumerate(bounds) if b[0] in present or n == 0]:
        marks = checkpointed(_windows(items, low, longest, longest == window, k, w))
        small = marks.count() <= BROADCAST
        cut = fingerprints(keyed.withColumn("_words", words(F.col("text"))), k, w)
        # One packed row for each fingerprint, and for the document itself one below zero with its number of words.
        packed = cut.select("doc_id", *key, F.explode(F.concat(F.array(-(F.size("_words").cast("long") + 1)), "_fps")).alias("_v"))
        packed = packed.withColumn("_fp", F.when(F.col("_v") >= 0, _hash(F.col("_v"))))
        wanted = marks.select("_fp", F.lit(True).alias("_hit")).distinct()
        hits = packed.join(F.broadcast(wanted) if small else wanted, "_fp", "left").where((F.col("_v") < 0) | F.col("_hit"))
        seen = hits.groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.count_if(F.col("_v") < 0).alias("_rows"), F.min("_v").alias("_least"), F.collect_set(F.when(F.col("_v") >= 0, F.col("_v"))).alias("_places"))
        seen = checkpointed(seen)  # read by two branches below; small beside the texts
        if counted is None:
            counted = seen.select("doc_id", *key, "_rows", (-F.col("_least") - 1).cast("long").alias("n_words"))
        if low in present:
            part = _extend(keyed, seen, marks, longest, k, small)
            found = part if found is None else found.unionByName(part)
            own = marks.select("_set", "_items").distinct()
            sets = own if sets is None else sets.unionByName(own)
    if found is None:
        return _expand(counted.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")}))
    found = checkpointed(found)  # read twice below, and the texts are gone from here on
    before = F.max("_end").over(W.partitionBy(*key).orderBy("_start", "_end").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.col("_end") - F.greatest(F.col("_start"), F.coalesce(before, F.lit(0))), F.lit(0))
    cover = found.select(*key, "_start", "_end").distinct().withColumn("_fresh", fresh).groupBy(*key).agg(F.sum("_fresh").cast("long").alias("n_hit"))
    listed = found.select(*key, "_set").distinct().join(sets.distinct(), "_set").select(*key, F.explode("_items").alias("item_id")).distinct()
    by_item = listed.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = counted.join(cover, key, "left").join(by_item, key, "left")
    return _expand(out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))}))


def _expand(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "_a", "_b", "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_k")).drop("_k")


def _extend(keyed: DataFrame, seen: DataFrame, marks: DataFrame, longest: int, k: int, small: bool) -> DataFrame:
    """_a, _b, _start, _end, _set of every window that a document has word for word at one of its places."""
    key = ["_a", "_b"]
    hit = seen.where(F.size("_places") > 0).select(*key, "_places")
    ids = hit.select(*key)
    # The texts of other documents go before the join that shuffles.
    texts = keyed.select(*key, "text").join(F.broadcast(ids), key, "left_semi") if ids.count() <= KEYS else keyed.select(*key, "text")
    texts = texts.join(hit, key).dropDuplicates(key).select(*key, "_places", words(F.col("text")).alias("_words"))
    reach = longest - k
    around = F.transform("_places", lambda v: F.struct(_hash(v).alias("_fp"), _place(v).alias("p"), F.slice("_words", F.greatest(_place(v) - reach, F.lit(0)) + 1, F.lit(longest + reach)).alias("part")))
    rows = texts.select(*key, F.explode_outer(around).alias("h")).select(*key, "h.*")
    windows = marks.select("_fp", "_q", "_size", "_win", "_set")
    rows = rows.join(F.broadcast(windows) if small else windows, "_fp")
    at, base = F.col("p") - F.col("_q"), F.greatest(F.col("p") - reach, F.lit(0))
    same = (at >= 0) & (F.slice("part", F.greatest(at - base, F.lit(0)) + 1, F.col("_size")) == F.col("_win"))
    return rows.where(same).select(*key, at.alias("_start"), (at + F.col("_size")).alias("_end"), "_set")


def contaminated() -> Column:
    """The contract's rule: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, all columns, that the rule does not call contaminated."""
    bad = checkpointed(find(docs, benchmark).where(contaminated()).select("_a", "_b").distinct())
    own = [free_name(docs, "_a"), free_name(docs, "_b")]
    keys = dict(zip(own, (F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id"))))
    bad = bad.toDF(*own)
    return docs.withColumns(keys).join(F.broadcast(bad) if bad.count() <= KEYS else bad, own, "left_anti").select(docs.columns)
