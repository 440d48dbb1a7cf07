"""Small tables with every awkward case, shared by the operators' tests."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Columns besides the ones that operators read, with names that operators use for their own results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, class_id long, n_words long, label int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def awkward(seed: int = 1) -> list[tuple]:
    """Null and empty texts, ties, repeated rows, near copies, shared passages, a long text, non-ASCII, a null doc_id."""
    rng = random.Random(seed)
    passage = sentence(rng, 40)
    base = sentence(rng, 60)
    near = base.split()
    near[30] = "changed"
    texts = [
        None,
        "",
        "   \n\t ",
        "one",
        "a b c d",
        base,
        base,
        " ".join(near),
        sentence(rng, 5) + " " + passage + " " + sentence(rng, 30),
        sentence(rng, 9) + "\n" + passage.replace(" ", "  "),
        passage,
        "the the the the the the the the the the the the the the the the the the",
        "the the the the the the the the the the the the the the the the",
        "Ünïcödé größe " + sentence(rng, 20),
        " ".join(sentence(rng, 12) for _ in range(400)),
        "<|im_end|> \\ <| plain",
        "12345 67890 !!!",
        "x" * 5000,
    ]
    rows = [(i, t, "en" if i % 3 else None, "src", len(t) if t else None, 0.5, 7, -1, -2, i % 2) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, passage, "en", None, None, None, None, None, None, None))
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)
