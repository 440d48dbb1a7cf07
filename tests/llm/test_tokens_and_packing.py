from __future__ import annotations

import numpy as np
import pytest

from graphmill.llm import packing as P
from graphmill.llm import separator_scan as S
from graphmill.llm import tokens
from graphmill.llm.queries import END_OF_DOCUMENT, VOCABULARY
from graphmill.workspace import folder
from tests.llm.common import SCHEMA, awkward, documents


def reference(text: str | None, plain: bool = False) -> list[int]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = plain
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_the_vocabularys(spark, sf_dir, monkeypatch, plain):
    monkeypatch.setattr(tokens, "PART", 2000)
    encoder = tokens.Encoder(VOCABULARY, plain)
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftext| >", "word <|endoftext|>\n" * 1500]
    for t in [*texts, *(r[1] for r in awkward()), "<|endoftext|> a  b\n\n\tc 's d'll é漢字🙂 " * 300]:
        assert encoder.encode(t or "").tolist() == reference(t, plain)
    assert (50256 in encoder.encode("hello <|endoftext|> world")) == (not plain)


def test_separator_scan_by_hand(spark, monkeypatch):
    """Documents cut by block edges, whole blocks without a separator, empty documents, an open end, several groups of blocks."""
    monkeypatch.setattr(S, "GROUP", 3)
    rng = np.random.Generator(np.random.PCG64(4))
    rows, want = [], set()
    for file, sizes in enumerate([[3, 0, 40, 5, 0, 0, 7], [100], [0], [], [1] * 30]):
        ids = np.concatenate([np.zeros(0, np.uint16), *(np.append(rng.integers(0, 9, n), 99).astype(np.uint16) for n in sizes)])
        if file % 2 == 0:
            ids = np.append(ids, np.full(file + 1, 5, np.uint16))
            want.add((file, len(sizes), file + 1, False))
        want |= {(file, k, n, True) for k, n in enumerate(sizes)}
        rows += [(file, b, ids[at : at + 8].astype("<u2").tobytes()) for b, at in enumerate(range(0, len(ids), 8))]
    blocks = spark.createDataFrame([(a, b, bytearray(d)) for a, b, d in rows], S.BLOCKS)
    got = {tuple(r) for r in S.scan(blocks, 99).select("file", "ordinal", "n_tokens", "complete").collect()}
    assert got == want


def test_flat_files_are_read(spark, monkeypatch, tmp_path):
    """Real files of ids, some longer than a block, one empty."""
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.Generator(np.random.PCG64(6))
    want = []
    for k, sizes in enumerate([[3, 0, 40, 5], [100], [], [0, 0, 1]]):
        ids = np.concatenate([np.zeros(0, "<u2"), *(np.append(rng.integers(0, 9, n), 99).astype("<u2") for n in sizes)])
        (tmp_path / f"f{k}.bin").write_bytes(ids.astype("<u2").tobytes())
        want += [(f"f{k}.bin", i, n) for i, n in enumerate(sizes)]
    blocks = S.read_flat(spark, str(tmp_path))
    names = blocks.select("file", "name").distinct()
    got = S.scan(blocks, 99).join(names, "file").collect()
    assert sorted((r.name.rsplit("/", 1)[1], r.ordinal, r.n_tokens) for r in got) == want
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole id"):
        S.read_flat(spark, str(tmp_path)).count()


def test_clashing_columns_and_other_ids(spark):
    docs = spark.createDataFrame([("a", "one two", 1, 2), (None, "three <|endoftext|>", 3, 4)], "doc_id string, text string, sequence_id long, ids int")
    rows = P.pack(docs, VOCABULARY, length=64).collect()
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {("a", 3), (None, len(reference("three <|endoftext|>")) + 1)}
    with pytest.raises(TypeError):
        S.write_flat(docs, VOCABULARY, END_OF_DOCUMENT, folder(spark, "t"))


def test_a_very_long_text_is_packed_whole(spark):
    text = "word and word. " * 200_000
    rows = P.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), VOCABULARY).toPandas().sort_values("start")
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in rows.ids])
    assert ids.tolist() == [*tokens.Encoder(VOCABULARY).encode(text).tolist(), 1] and rows.length.max() <= 2048


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    docs = documents(spark)
    out = S.count_tokens(spark, docs, VOCABULARY, END_OF_DOCUMENT, folder(spark, "t")).toPandas()
    want = sorted((-1 if r[0] is None else r[0], len(reference(r[1], True))) for r in awkward())
    assert sorted((int(a) if a == a else -1, n) for a, n in zip(out.doc_id, out.n_tokens)) == want
    empty = S.count_tokens(spark, spark.createDataFrame([], SCHEMA), VOCABULARY, END_OF_DOCUMENT, folder(spark, "t"))
    assert empty.count() == 0


def cheapest(at, cost, length) -> int:
    """The objective by trying every earlier cut."""
    f = [0] * len(at)
    for j in range(1, len(at)):
        f[j] = min(f[i] + length - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= length) + cost[j]
    return f[-1]


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_optimal(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    at = np.cumsum(np.append(0, rng.integers(1, 20, 200)))
    cost = rng.integers(0, 30, 201)
    cuts = P.best_cuts(at, cost, 64, True)
    price = sum(64 - (b - a) for a, b in zip(cuts, cuts[1:])) + sum(int(cost[np.searchsorted(at, c)]) for c in cuts[1:])
    assert np.diff(cuts).max() <= 64 and cuts[-1] == at[-1] and price == cheapest(at.tolist(), cost.tolist(), 64)


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(P, "STRETCH", 3000)
    docs = documents(spark)
    pieces = P.pack(docs, VOCABULARY, length=256).toPandas()
    want = sorted((r[0] if r[0] is not None else -1, tuple([*reference(r[1]), 1])) for r in awkward())
    got, padding = [], 0
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.append(0, own.length.cumsum())[:-1].tolist() and own.length.sum() <= 256
        n = int(own.length.sum())
        padding += 0 if n & (n - 1) == 0 else 256 - n
    pieces["doc_id"] = pieces.doc_id.fillna(-1)
    pieces = pieces.sort_values(["doc_id", "sequence_id", "offset"])
    open_ids: dict = {}
    for r in pieces.itertuples():
        ids = open_ids.setdefault((r.doc_id, r.sequence_id >> 40), [])
        if r.start == 0 and ids and len(ids) >= r.doc_tokens:
            got.append((int(r.doc_id), tuple(ids)))
            ids = open_ids[(r.doc_id, r.sequence_id >> 40)] = []
        assert r.start == len(ids)
        ids += np.frombuffer(r.ids, "<u4").tolist()
    got += [(int(k[0]), tuple(v)) for k, v in open_ids.items()]
    assert sorted(got) == want
    assert padding <= 0.1 * pieces.length.sum()
    assert P.pack(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0
