from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "score", "rank"] and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_point_knows_of_the_optional_parts():
    optional = re.compile(r"graphmill[./]llm|corpus_pipeline")
    for path in ROOT.rglob("*.py"):
        inside = path.relative_to(ROOT).parts
        if inside[:2] in (("graphmill", "llm"), ("tests", "llm")) or path.name in ("__spark_entry__.py", "corpus_pipeline.py", "test_entry.py", "bench.py"):
            continue
        assert not optional.search(path.read_text()), path
