"""Column functions over text: normalisation, keys, extraction, scoring, citations.

All are built-in expressions, so a projection that uses them stays in the JVM and
filters on plain columns still reach the scan.  Term lists and tables that depend
on the domain are parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

# Numerals that are read as digits before a suffix.
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10"}
FULL_ROMAN = {"Ⅰ": "1", "Ⅱ": "2", "Ⅲ": "3", "Ⅳ": "4", "Ⅴ": "5"}
CHINESE = {"一": "1", "二": "2", "三": "3", "四": "4", "五": "5"}
NUMBERED = "级|类|型|室|间|区"
#: Relations that have an inverse.
INVERSE = {"CONTAINS": "BELONGS_TO", "BELONGS_TO": "CONTAINS", "REQUIRES": "REQUIRED_BY", "REQUIRED_BY": "REQUIRES"}


def half_width(s: Column) -> Column:
    return F.translate(s, FULL_WIDTH, HALF_WIDTH)


def normalize_numbers(s: Column, suffixes: str = f"level|type|room|grade|{NUMBERED}") -> Column:
    """Half width; Roman and Chinese numerals before a suffix as digits; no white space.

    A Roman numeral of Latin letters counts only where no letter or digit stands before it.
    """
    out = half_width(s)
    before = rf"(?=\s*(?:{suffixes}))"
    for roman in sorted(ROMAN, key=lambda r: (-len(r), r)):
        out = F.regexp_replace(out, rf"\b{roman}{before}", ROMAN[roman])
    for sign, digit in (FULL_ROMAN | CHINESE).items():
        out = F.regexp_replace(out, sign + before, digit)
    return F.regexp_replace(out, r"\s+", "")


def canonical(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Normalised lower-case name, or what the alias table has for it."""
    key = F.lower(normalize_numbers(F.coalesce(name, F.lit(""))))
    return mapped(key, {k.lower(): v for k, v in aliases.items()}, key) if aliases else key


def mapped(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), otherwise)


def scope_key(names: Column) -> Column:
    cleaned = F.transform(names, lambda n: F.lower(normalize_numbers(n)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(cleaned, lambda n: n != ""))), "/")


def stable_id(kind: Column, name: Column, scope: Column) -> Column:
    return F.concat(F.lit("entity_"), F.substring(F.sha2(F.lower(F.concat(kind, F.lit(":"), name, F.lit("|"), scope)).cast("binary"), 256), 1, 16))


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def chunk_key(source: Column, number: Column, text: Column) -> Column:
    return F.md5(F.concat(source, number.cast("string"), text).cast("binary"))


def cache_key(query: Column, filters: Column) -> Column:
    """filters: map of strings; the order of its entries doesn't matter."""
    entries = F.transform(F.array_sort(F.map_entries(filters)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.substring(F.md5(F.concat(F.lower(F.trim(query)), F.lit("|"), F.array_join(entries, "&")).cast("binary")), 1, 16)


def embedding_key(text: Column, model: str, url: str) -> Column:
    return F.concat_ws("::", F.sha2(text.cast("binary"), 256), F.lit(model), F.lit(url))


def inverse_relation(rel: Column) -> Column:
    return mapped(rel, INVERSE, F.lit(None).cast("string"))


def is_quantitative(text: Column, patterns: tuple[str, ...] = (r"[0-9]+\.?[0-9]*\s*(mm|cm|m|kg|%)", r"[<>]=?\s*[0-9]", r"[0-9]+\s*-\s*[0-9]+", r"[0-9]{2,}")) -> Column:
    return F.when(reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns)), "quantitative").otherwise("qualitative")


def sanitized(name: Column, fallback: str = "RELATED_TO") -> Column:
    kept = F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_]", "")
    return F.when(kept == "", fallback).otherwise(kept)


def normalized_relation(name: Column, standard: tuple[str, ...], aliases: dict[str, str], skip: tuple[str, ...] = ()) -> Column:
    """Standard relation for a raw name: alias, SKIP word, standard name in any case, else RELATED_TO."""
    key = F.trim(F.coalesce(name, F.lit("")))
    known = F.when(F.upper(key).isin(*standard), F.upper(key))
    alias = mapped(F.lower(key), aliases, F.lit(None).cast("string"))
    dropped = F.when(F.lower(key).isin(*skip), "SKIP") if skip else F.lit(None).cast("string")
    return F.when(key == "", "RELATED_TO").otherwise(F.coalesce(alias, dropped, known, F.lit("RELATED_TO")))


def refined_relation(context: Column, source_type: Column, target_type: Column, keywords: list[tuple[str, str, float]], types: list[tuple[str, str, str, float]]) -> Column:
    """struct(rel, conf): first keyword in the context, then the type pair, else CO_OCCUR 0.5."""
    out = F.struct(F.lit("CO_OCCUR").alias("rel"), F.lit(0.5).alias("conf"))
    for a, b, rel, conf in reversed(types):
        out = F.when((source_type == a) & (target_type == b), F.struct(F.lit(rel).alias("rel"), F.lit(conf).alias("conf"))).otherwise(out)
    for word, rel, conf in reversed(keywords):
        out = F.when(context.contains(word), F.struct(F.lit(rel).alias("rel"), F.lit(conf).alias("conf"))).otherwise(out)
    return out


def sentence_about(text: Column, name: Column, most: int = 160) -> Column:
    """First sentence that contains the name, else the head of the text; cut with an ellipsis."""
    first = F.get(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s.contains(name)), F.lit(0))
    return shortened(F.coalesce(first, text), most)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms))


def year(text: Column, low: int = 1990, high: int = 2030) -> Column:
    """First acceptable year by patterns in falling order of trust."""
    patterns = (r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b", r"(?:year|in)\s+((?:19|20)\d{2})\b", r"\(((?:19|20)\d{2})\)", r"\b((?:19|20)\d{2})\b", r"((?:19|20)\d{2})")
    tries = []
    for p in patterns:
        found = F.regexp_extract(F.regexp_substr(text, F.lit(p)), r"((?:19|20)\d{2})", 1).try_cast("int")
        tries.append(F.when(found.between(low, high), found))
    return F.coalesce(*tries)


def normalized_bbox(page: Column, box: Column, width: float = 595.0, height: float = 842.0) -> Column:
    """[page, x0, y0, x1, y1] in parts of the page, in order and within 0..1."""

    def part(i: int, size: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(box[i] / size, 4)))

    x0, y0, x1, y1 = part(0, width), part(1, height), part(2, width), part(3, height)
    return F.array(page.cast("double"), F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def html_text(html: Column, caption: Column | None = None) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))
    return plain if caption is None else F.trim(F.concat(F.coalesce(caption, F.lit("")), F.lit(" "), plain))


def image_links(markdown: Column) -> Column:
    """Array of (alt, url) of Markdown images."""
    pattern = F.lit(r"!\[([^\]]*)\]\(([^)\s]+)\)")
    return F.arrays_zip(F.regexp_extract_all(markdown, pattern, F.lit(1)).alias("alt"), F.regexp_extract_all(markdown, pattern, F.lit(2)).alias("url"))


def rewritten_links(markdown: Column, paths: dict[str, str]) -> Column:
    """The text with image links mapped; other text is left alone."""
    return reduce(lambda t, kv: F.regexp_replace(t, r"(!\[[^\]]*\]\()" + "\\Q" + kv[0] + "\\E" + r"(\))", "$1" + kv[1].replace("$", "\\$") + "$2"), sorted(paths.items()), markdown)


def tokens(text: Column, pattern: str = "[a-z]{2,}", stop: tuple[str, ...] = ()) -> Column:
    out = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.array_except(out, F.array(*map(F.lit, stop))) if stop else F.array_distinct(out)


def ngrams(words: Column, low: int = 2, high: int = 3, most: int = 5) -> Column:
    """Runs of neighbouring words, glued, at most `most` of each length."""
    parts = []
    for n in range(low, high + 1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.least(F.size(words) - (n - 1), F.lit(most)))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, _glued(words, n)))
    return F.concat(*parts)


def _glued(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), "")


def synonyms(word: Column, table: dict[str, list[str]]) -> Column:
    """Exact entry, else entries whose key contains the word or is contained in it; sorted."""
    exact = F.coalesce(*(F.when(word == k, F.array(*map(F.lit, v))) for k, v in table.items()), F.lit(None).cast("array<string>"))
    near = F.flatten(F.array(*(F.when(word.contains(k) | F.lit(k).contains(word), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in table.items())))
    return F.array_sort(F.array_distinct(F.coalesce(exact, near)))


def expansion(words: Column, others: Column, more: Column, most: int = 20) -> Column:
    """Keywords, then n-grams, then the first ten synonyms; distinct, cut."""
    return F.slice(F.array_distinct(F.concat(words, others, F.slice(more, 1, 10))), 1, most)


def distinct_ignoring_case(words: Column) -> Column:
    lower = F.transform(words, lambda w: F.lower(w))
    return F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_position(lower, F.lower(s["w"])) == s["i"] + 1), lambda s: s["w"])


def concept_expansion(term: Column, equal: Column, related: Column, narrower: Column, broader: Column, most: int = 15) -> Column:
    """The term, 5 synonyms, 8 related, 3 narrower and 2 broader concepts; trimmed, distinct ignoring case, cut.

    Each array is in its provider's order; a null one is empty.
    """
    first = lambda words, n: F.slice(F.coalesce(words, F.array().cast("array<string>")), 1, n)
    words = F.concat(F.array(term), first(equal, 5), first(related, 8), first(narrower, 3), first(broader, 2))
    clean = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w.isNotNull() & (w != ""))
    return F.slice(distinct_ignoring_case(clean), 1, most)


def query_kind(text: Column, relation: list[str], community: list[str], mixed: list[str]) -> Column:
    return F.when(contains_any(text, mixed), "mixed").when(contains_any(text, relation), "relation").when(contains_any(text, community), "community").otherwise("entity")


def first_contained(text: Column, terms: list[str]) -> Column:
    return F.coalesce(*(F.when(text.contains(t), F.lit(t)) for t in terms), F.lit(None).cast("string"))


def section_parts(heading: Column) -> Column:
    """struct(chapter, title, subsection) of headings such as `Chapter 3 Name` or `3.2 Name`."""
    return F.struct(
        F.nullif(F.regexp_extract(heading, r"(?i)^chapter\s+([0-9ivx]+)", 1), F.lit("")).alias("chapter"),
        F.nullif(F.regexp_extract(heading, r"^(?:[0-9]+(?:\.[0-9]+)*\s+|(?i:chapter\s+[0-9ivx]+\s+))(.+)$", 1), F.lit("")).alias("title"),
        F.nullif(F.regexp_extract(heading, r"^([0-9]+\.[0-9.]*[0-9])", 1), F.lit("")).alias("subsection"),
    )


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def web_key(url: Column, title: Column, snippet: Column) -> Column:
    """What tells web results apart: the address, else the title and the first 80 characters."""
    return F.when(url != "", url).otherwise(F.concat(title, F.lit("|"), F.substring(snippet, 1, 80)))


def web_relevance(domain: Column, topic: Column, case: Column, query: Column, raw: Column) -> Column:
    score = F.lit(0.55) + F.when(domain, 0.25).otherwise(0.0) + F.when(topic, 0.10).otherwise(0.0) + F.when(case, 0.05).otherwise(0.0) + F.when(query, 0.05).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.coalesce(raw, F.lit(0.0))), F.lit(0.95)), 4)


def entity_relevance(text: Column, name: Column, attributes: Column, description: Column) -> Column:
    by_name = F.when(text.contains(name), 1000 + F.least(F.length(name), F.lit(50))).otherwise(0)
    by_attribute = F.size(F.filter(attributes, lambda a: text.contains(a))) * 80
    return by_name + by_attribute + F.when((F.length(description) < 80) & text.contains(description), 20).otherwise(0)


def _share(*rules: tuple[Column, float]) -> Column:
    return F.round(F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in rules])), 4)


def case_quality(media: Column, parameters: Column, novel: Column, length: Column) -> Column:
    """Quality of a case, 0 to 1: media, detailed parameters, novelty, and the length of its content in two steps."""
    return _share((media, 0.3), (parameters, 0.3), (novel, 0.2), (length >= 200, 0.1), (length >= 500, 0.1))


def method_quality(description: Column, spaces: Column, supported: Column) -> Column:
    """Quality of a design method: described, meant for named spaces, backed by a source, with a figure and its unit."""
    return _share((F.length(description) >= 50, 0.3), (F.size(spaces) > 0, 0.2), (supported, 0.3), (description.rlike("[0-9][m²㎡Pa%级]"), 0.2))


def plain_quality(measured: Column, description: Column, regulated: Column, applied: Column, media: Column) -> Column:
    """Quality of any other entity: figures, a description, rules, uses, media."""
    return _share((measured, 0.2), (F.length(description) >= 30, 0.3), (regulated, 0.2), (applied, 0.2), (media, 0.1))


def retrieval_quality(n: Column, top: Column, mean: Column, cites: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 * F.least(n / 5, F.lit(1.0)) + 0.4 * top + 0.3 * mean + 0.3 * F.least(cites / 3, F.lit(1.0)))


def fusion_score(entities: Column, chunks: Column, relations: Column, complementary: Column) -> Column:
    part = lambda x, n: F.least(x / n, F.lit(1.0))
    return F.round(0.3 * part(entities, 10) + 0.3 * part(chunks, 15) + 0.2 * part(relations, 10) + 0.2 * complementary, 2)


def page_span(pages: Column) -> Column:
    """P1-P9 of an array of page labels, P1 for one page."""
    numbers = F.filter(F.transform(pages, lambda p: F.regexp_replace(p, "[^0-9]", "").try_cast("int")), lambda p: p.isNotNull())
    low, high = F.array_min(numbers), F.array_max(numbers)
    return F.when(low == high, F.concat(F.lit("P"), low.cast("string"))).otherwise(F.concat(F.lit("P"), low.cast("string"), F.lit("-P"), high.cast("string")))


def citations(text: Column) -> Column:
    """Distinct citation numbers in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)))


def _replaced(text: Column, opening: str, pattern: str, render) -> Column:
    """The text with what the pattern matches, which begins with `opening`, replaced by render(match)."""
    pieces = F.split(text, f"(?={opening})")
    found = lambda p: F.regexp_extract(p, f"^(?:{pattern})", 0)
    put = lambda p: F.concat(render(found(p)), F.substr(p, F.length(found(p)) + 1))
    return F.array_join(F.transform(pieces, lambda p: F.when(found(p) != "", put(p)).otherwise(p)), "")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once, where `use` names it often or in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bracketed(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")


def _digits(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1))


def split_citation_groups(text: Column) -> Column:
    """[1,2] as [1][2]: groups of any length, with plain or full-width separators."""
    return _replaced(text, r"\[", r"\[\s*[0-9]+(?:\s*[,;，、；]\s*[0-9]+)+\s*\]", lambda m: _bracketed(_digits(m)))


def expanded_citation_ranges(text: Column, most: int = 30) -> Column:
    """[1-3] as [1][2][3]; a range over more than `most` steps as its two ends.  Numbers have up to nine digits."""

    def spread(m: Column) -> Column:
        ends = F.transform(_digits(m), lambda n: n.cast("int"))
        low, high = F.least(ends[0], ends[1]), F.greatest(ends[0], ends[1])
        return _bracketed(F.when(high - low > most, F.array(low, high)).otherwise(F.sequence(low, F.least(high, low + most))))

    return _replaced(text, r"\[", r"\[[0-9]{1,9}\s*[-–—~～]\s*[0-9]{1,9}\]", spread)


def _runs(text: Column, render) -> Column:
    """Runs of two citations and more, with the white space in and after them, replaced by render(sorted numbers)."""
    marked = F.regexp_replace(text, r"((?:\[[0-9]{1,9}\]\s*){2,})", "\uffff$1\uffff")
    run = lambda p: F.array_sort(F.array_distinct(F.transform(_digits(p), lambda n: n.cast("int"))))
    # Marks come in pairs, so every second piece is a run.
    return F.array_join(F.transform(F.split(marked, "\uffff"), lambda p, i: F.when(i % 2 == 1, render(run(p))).otherwise(p)), "")


def sorted_citation_runs(text: Column) -> Column:
    """Neighbouring citations in rising order, each once.  The text has no U+FFFF, which is no character."""
    return _runs(text, _bracketed)


def collapsed_citation_runs(text: Column) -> Column:
    """The same, and three and more numbers without a gap as [first-last]."""

    def short(n: Column) -> Column:
        whole = (F.size(n) > 2) & (F.array_max(n) - F.array_min(n) == F.size(n) - 1)
        return F.when(whole, F.concat(F.lit("["), F.array_min(n).cast("string"), F.lit("-"), F.array_max(n).cast("string"), F.lit("]"))).otherwise(_bracketed(n))

    return _runs(text, short)


def renumbered_citations(text: Column) -> Column:
    """Citation numbers by first appearance, from 1."""
    order = citations(text)
    pieces = F.split(text, r"(?=\[[0-9]+\])")
    number = lambda p: F.regexp_extract(p, r"^\[([0-9]+)\]", 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(number(p) != "", F.concat(F.lit("["), F.array_position(order, number(p)).cast("string"), F.regexp_replace(p, r"^\[[0-9]+", ""))).otherwise(p)), "")


def missing_citations(text: Column, n: Column) -> Column:
    wanted = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.array_except(wanted, citations(text))


def answer_violations(text: Column, n_sources: Column, most_chars: int = 4000) -> Column:
    """Names of the rules that an answer breaks."""
    cited = F.transform(citations(text), lambda c: c.cast("int"))
    rules = F.array(
        F.when(F.size(cited) == 0, "no citation"),
        F.when(F.exists(cited, lambda c: (c < 1) | (c > n_sources)), "unknown citation"),
        F.when(F.length(text) > most_chars, "too long"),
        F.when(F.trim(text) == "", "empty"),
    )
    return F.filter(rules, lambda r: r.isNotNull())


def aligned_images(text: Column, n_images: Column) -> Column:
    """Image placeholders [IMG:k] renumbered from 1 in order; those without an image go."""
    pieces = F.split(text, r"(?=\[IMG:[0-9]+\])")
    number = lambda p: F.regexp_extract(p, r"^\[IMG:([0-9]+)\]", 1)
    valid = lambda p: (number(p) != "") & (F.coalesce(number(p).try_cast("int"), F.lit(0)) <= n_images)
    kept = F.array_distinct(F.transform(F.filter(pieces, valid), number))
    return F.array_join(F.transform(pieces, lambda p: F.when(number(p) == "", p).when(valid(p), F.concat(F.lit("[IMG:"), F.array_position(kept, number(p)).cast("string"), F.regexp_replace(p, r"^\[IMG:[0-9]+", ""))).otherwise(F.regexp_replace(p, r"^\[IMG:[0-9]+\]", ""))), "")


def _image(i: Column, caption: Column, label: str) -> Column:
    return F.concat(F.lit(f"({label} "), i.cast("string"), F.lit(": "), caption, F.lit(")\n[IMG:"), i.cast("string"), F.lit("]"))


def appended_images(text: Column, captions: Column, label: str = "Figure") -> Column:
    """The text, and after it a captioned placeholder for every image that it has none of."""
    here = F.transform(F.regexp_extract_all(text, F.lit(r"\[IMG:([0-9]{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))
    all_images = F.transform(captions, lambda c, i: F.struct((i + 1).alias("i"), c.alias("c")))
    missing = F.filter(all_images, lambda s: ~F.array_contains(here, s["i"]))
    block = F.array_join(F.transform(missing, lambda s: _image(s["i"], s["c"], label)), "\n\n")
    return F.when(F.size(missing) > 0, F.concat(F.rtrim(text), F.lit("\n\n"), block)).otherwise(text)


def injected_images(text: Column, captions: Column, heading: str, catalogue: str, label: str = "Figure") -> Column:
    """Captioned placeholders after the paragraphs of the section of that heading, else after those from the second on.

    Image k follows paragraph k, those beyond the last paragraph the last one.  The list of sources under the heading
    `catalogue` stays as it is, and so does a text with placeholders or without images.
    """
    clean = lambda c: F.regexp_replace(c, r"\s+\z", "")

    def cut(head: Column) -> Column:
        """struct(before, body, later) of the text before the list of sources."""
        named = F.regexp_extract(head, rf"(?ms)\A(.*?^### *\Q{heading}\E *\n)", 1)
        before = F.when(named != "", named).otherwise(F.regexp_extract(head, r"(?s)\A(.*?\n\n)", 1))
        rest = _let(before, lambda b: F.struct(b.alias("before"), F.substr(head, F.length(b) + 1).alias("rest")))
        later = lambda r: F.when(head.rlike(rf"(?m)^### *\Q{heading}\E *$"), F.regexp_extract(r["rest"], r"(?ms)(^### .*)\z", 1)).otherwise("")
        return _let(rest, lambda r: _let(later(r), lambda x: F.struct(r["before"].alias("before"), F.substr(r["rest"], F.lit(1), F.length(r["rest"]) - F.length(x)).alias("body"), x.alias("later"))))

    def filled(body: Column) -> Column:
        found = F.filter(F.split(body, "\n{2,}"), lambda p: F.trim(p) != "")
        whole = _let(found, lambda f: F.when(F.size(f) > 0, F.transform(f, clean)).otherwise(F.array(F.lit(""))))
        images = F.transform(captions, lambda c, i: F.concat(F.lit("\n\n"), _image(i + 1, c, label)))

        def placed(both: Column) -> Column:
            p, images = both["p"], both["images"]
            own = lambda at: F.when(at < F.size(p) - 1, F.slice(images, at + 1, 1)).otherwise(F.slice(images, at + 1, F.size(images)))
            return F.array_join(F.transform(p, lambda x, at: F.concat(x, F.array_join(own(at), ""))), "\n\n")

        return _let(F.struct(whole.alias("p"), images.alias("images")), placed)

    end = F.regexp_instr(text, F.lit(rf"(?m)^### *\Q{catalogue}\E *$"))
    halves = _let(end, lambda e: F.struct(F.when(e > 0, F.substr(text, F.lit(1), e - 1)).otherwise(text).alias("head"), F.when(e > 0, F.concat(F.lit("\n\n"), F.substr(text, e))).otherwise("").alias("tail")))
    joined = lambda c: clean(F.concat(c["before"], filled(c["body"]), F.when(c["later"] != "", F.concat(F.lit("\n\n"), c["later"])).otherwise("")))
    return F.when((F.size(captions) <= 0) | text.contains("[IMG:"), text).otherwise(_let(halves, lambda h: F.concat(_let(cut(h["head"]), joined), h["tail"])))


def relative_path(path: Column, root: str) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^" + "\\Q" + root.rstrip("/") + "\\E" + "/?", "")


def page_location(page: Column, chapter: Column, title: Column, section: Column) -> Column:
    """Where a passage stands, as `12|Chapter 3 Wards|3.1 Rooms`; what is null or empty is left out, a chapter without title too."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("|", page.cast("string"), F.nullif(F.concat_ws(" ", F.when(filled(title).isNotNull(), filled(chapter)), filled(title)), F.lit("")), filled(section))


def complete_citation(fields: dict[str, Column], root: str, unknown: str = "unknown source", api: str = "/api/v1") -> Column:
    """A citation struct with its required fields source, location and snippet never null, other fields as given.

    A missing source is `unknown`; paths are made relative to the root; pdfUrl stands in for a missing pdf_url, which
    loses the prefix of the service.
    """
    text = lambda name, default: F.coalesce(fields.get(name, F.lit(None).cast("string")), F.lit(default)).alias(name)
    out = {name: text(name, "") for name in ("location", "snippet")}
    out["source"] = F.coalesce(F.nullif(fields["source"], F.lit("")), F.lit(unknown)).alias("source")
    for name, value in fields.items():
        if name in ("file_path", "document_path"):
            out[name] = relative_path(value, root).alias(name)
        elif name not in out and name not in ("pdf_url", "pdfUrl"):
            out[name] = value.alias(name)
    links = [F.nullif(fields[name], F.lit("")) for name in ("pdf_url", "pdfUrl") if name in fields]
    if links:
        out["pdf_url"] = F.regexp_replace(F.coalesce(*links), f"^\\Q{api}\\E(?=/)", "").alias("pdf_url")
    return F.struct(*out.values())


def json_in(text: Column) -> Column:
    """The outermost JSON object in a messy text, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def retry_delay(attempt: Column, cap: float = 60.0) -> Column:
    return F.least(F.lit(cap), F.pow(F.lit(2.0), F.least(F.lit(8), attempt - 1)))


def page_spec(spec: Column) -> Column:
    """1,3-5,8 as [1, 3, 4, 5, 8]."""
    part = F.transform(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda p: F.split(p, "-"))
    ranges = F.transform(F.filter(part, lambda p: p[0].rlike("^[0-9]+$")), lambda p: F.sequence(p[0].cast("int"), F.greatest(p[0].cast("int"), F.coalesce(F.get(p, F.lit(1)).try_cast("int"), p[0].cast("int")))))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def normalized_title(title: Column) -> Column:
    """Basename without book-title marks, with .pdf."""
    base = F.translate(F.regexp_extract(title, r"([^/\\]+)$", 1), "《》", "")
    return F.when(F.lower(base).endswith(".pdf"), base).otherwise(F.concat(base, F.lit(".pdf")))


def page_numbers(text: Column, most: int = 10) -> Column:
    """Page numbers 1..10000 that a query names as p12, page 12 or pages 3-5 (their ends), in order; longer numbers are none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?:p|page|pages)\s*\.?\s*([0-9]{1,5})(?![0-9])"), F.lit(1))
    ends = F.regexp_extract_all(F.lower(text), F.lit(r"(?:p|page|pages)\s*\.?\s*[0-9]{1,5}\s*-\s*([0-9]{1,5})(?![0-9])"), F.lit(1))
    numbers = F.transform(F.concat(found, ends), lambda n: n.cast("int"))
    return F.slice(F.array_distinct(F.filter(numbers, lambda n: n.between(1, 10000))), 1, most)


def must_include(query: Column, most: int = 5) -> Column:
    """Terms in full-width or square brackets."""
    return F.slice(F.array_distinct(F.regexp_extract_all(query, F.lit("[\\[【]([^\\]】]+)[\\]】]"), F.lit(1))), 1, most)


def is_reasonable_match(query: Column, name: Column, least: float = 0.2) -> Column:
    """Equal, or one contains the other and the shorter has two characters and the share of the longer's length."""
    q, n = F.lower(F.trim(query)), F.lower(F.trim(name))
    shorter, longer = F.least(F.length(q), F.length(n)), F.greatest(F.length(q), F.length(n))
    return (q == n) | ((q.contains(n) | n.contains(q)) & (shorter >= 2) & (shorter / F.when(longer > 0, longer) >= least))


def whitelisted(props: Column, allowed: list[str]) -> Column:
    return F.map_filter(props, lambda k, v: k.isin(allowed))


def tidy_layout(text: Column) -> Column:
    """Citations of a heading move to the end of the line after it, leading ones to the end of their line; decorative
    symbols go and a code fence begins a line of its own."""
    out = F.regexp_replace(text, "[■□◆◇★☆●►▶]+[ \\t]*", "")
    out = F.regexp_replace(out, r"([^\n`])```", "$1\n```")
    out = F.regexp_replace(out, r"(?m)^(#+ [^\n\[]*?)[ \t]*((?:\[[0-9]+\])+)[ \t]*\n([^\n#][^\n]*)", "$1\n$3$2")
    return F.regexp_replace(out, r"(?m)^((?:\[[0-9]+\])+)[ \t]*([^\n\[][^\n]*)$", "$2$1")


def moved_table_citations(text: Column, note: str = "Sources of the table: ") -> Column:
    """Citations in the rows of a Markdown table go to a note below it, each once, in order of appearance.

    A table is a line with a bar, a line of dashes and bars, and the lines with bars that follow.  The text has no U+FFFF.
    """
    row = r"[^\n\uFFFF]*\|[^\n\uFFFF]*"
    rule = r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*"
    marked = F.regexp_replace(text, rf"(?m)(^{row}\n{rule}\n)({row}(?:\n{row})*)", "$1\uffff$2\uffff")

    def moved(body: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(body, r"\[[0-9]+\]", ""), r"[ \t]{2,}", " ")
        sources = F.array_join(F.transform(citations(body), lambda n: F.concat(F.lit("["), n, F.lit("]"))), "")
        return F.when(sources != "", F.concat(plain, F.lit("\n\n" + note), sources, F.lit("\n"))).otherwise(body)

    return F.array_join(F.transform(F.split(marked, "\uffff"), lambda p, i: F.when(i % 2 == 1, moved(p)).otherwise(p)), "")


def evidence_line(number: Column, snippet: Column, source: Column, page: Column, most: int = 80) -> Column:
    """One line of a Markdown list of evidence."""
    return F.concat(F.lit("- ["), number.cast("string"), F.lit("] "), shortened(snippet, most), F.lit(" ("), source, F.lit(", p. "), page.cast("string"), F.lit(")"))


# Words that name a perspective or an entity type, tried in this order.
PERSPECTIVES = [
    (("规范", "标准", "gb", "code"), "规范要求"),
    (("案例", "项目", "图集", "参考", "方案"), "案例数据"),
    (("论文", "学术", "研究", "journal"), "学术观点"),
    (("运营", "管理", "指南", "流程"), "运营建议"),
]
SOURCE_PERSPECTIVES = {"规范标准": "规范要求", "学术文献": "学术观点", "图集书籍": "案例数据", "会议纪要": "会议纪要"}
ENTITY_TYPES = [
    (("间", "室", "走廊", "卫生间", "候诊", "护士站", "办公室", "诊室", "复苏室", "库房", "机房", "缓冲", "刷手", "配餐"), "空间"),
    (("方法", "原则", "策略", "工艺", "流程"), "设计方法"),
    (("案例", "项目", "工程"), "案例"),
    (("规范", "标准", "文件", "文献", "指南", "图集", "手册", "资料集"), "资料来源"),
    (("部", "中心", "科", "区"), "功能分区"),
]


def first_group(text: Column, groups: list[tuple[tuple[str, ...], str]], otherwise: Column) -> Column:
    """The value of the first group of which the text contains a word; case is ignored."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    out = otherwise
    for words, value in reversed(groups):
        out = F.when(contains_any(lower, list(words)), F.lit(value)).otherwise(out)
    return out


def perspective(category: Column, source_type: Column, groups=PERSPECTIVES, by_source=None, otherwise: str = "现状调研") -> Column:
    """By the category's words (the source type stands in for an empty one), then by the source type."""
    by_source = SOURCE_PERSPECTIVES if by_source is None else by_source
    known = F.when(F.coalesce(category, F.lit("")) != "", category).otherwise(source_type)
    return first_group(known, groups, mapped(source_type, by_source, F.lit(otherwise)) if by_source else F.lit(otherwise))


def soft_type(name: Column, groups=ENTITY_TYPES, document: str = "资料来源", otherwise: str = "空间") -> Column:
    """Entity type by a name's words; file names and titles in book marks are documents; no name, the default."""
    lower = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    file = lower.contains(".pdf") | lower.endswith(".doc") | lower.endswith(".docx") | (lower.contains("《") & lower.contains("》"))
    return F.when(lower == "", F.lit(otherwise)).when(file, F.lit(document)).otherwise(first_group(lower, groups, F.lit(otherwise)))
