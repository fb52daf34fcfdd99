import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import bpe, mix

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZER_DIR), reason="no tokenizer files here")

TEXTS = ["", " ", "\n\n  x", "Hello, world's 12345 tests!", "naïve Straße 中文没有空格。 ไทย क्या 🙂👩‍🔧", "a" * 3000, "ab" * 999, "a <|endo" + "ftext|> b", "\x00﻿　é", "don't'll'ved", "  lead", "trail  "]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_same_ids_as_the_public_tokenizer(reference):
    own = bpe.tables(bpe.read_vocabulary())
    for t in TEXTS:
        assert own.encode(t) == reference(t)
        assert own.decode(own.encode(t)).decode() == t


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.json")) if not hasattr(test_any_text, "t") else test_any_text.t
    t.encode_special_tokens = True
    test_any_text.t = t
    own = bpe.tables(bpe.read_vocabulary())
    assert own.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)).decode() == text


def test_memory_changes_nothing(monkeypatch):
    own = bpe.tables(bpe.read_vocabulary())
    before = [own.encode(t) for t in TEXTS]
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    own.memory.clear()
    assert [own.encode(t) for t in TEXTS] == before


def test_encode_table(spark):
    rows = [(1, t, "x", [9]) for t in TEXTS[:4]] + [(None, None, "y", None), (2, None, "z", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, ids array<int>")
    got = bpe.encode(df).collect()
    assert len(got) == 6
    assert [r.ids for r in got if r.doc_id in (None, 2)] == [[], []]
    back = bpe.decode(bpe.encode(df))
    assert sorted(r.text for r in back.collect()) == sorted([*TEXTS[:4], "", ""])
    assert bpe.encode(df.limit(0)).count() == 0
    counted = bpe.count(df, ["doc_id", "k"]).collect()
    assert sum(r.n_tokens for r in counted) == sum(len(r.ids) for r in got)


def docs(spark):
    rows = [(i, "s" + "ab"[i % 2], f"word number {i} of the source", 0) for i in range(400)]
    rows += [(1000 + i, "rare", f"rare text {i}", 0) for i in range(9)]
    rows += [(2000, "sa", None, 0), (2001, "sa", "", 0), (2002, None, "orphan", 0), (1, "sa", "the same id again", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, slice int")


def targets(spark):
    rows = [("m", "sa", 0.5, 1), ("m", "sb", 0.3, 1), ("m", "rare", 0.2, 4), ("gone", "sa", 0.5, None), ("gone", "missing", 0.5, 3), ("empty", "missing", 1.0, 1)]
    return spark.createDataFrame(rows, "mix_id string, source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    chosen, shares = mix.mix(docs(spark), targets(spark))
    rows = chosen.collect()
    by = {(r.mix_id, r.source): r for r in shares.collect()}
    assert len(by) == 6
    longest = 12
    for r in by.values():
        if r.mix_id == "m":
            assert abs(r.tokens - r.target_share * r.budget) <= longest
            assert r.actual_share == pytest.approx(r.target_share, abs=0.06)
    assert by["gone", "missing"].actual_share == 0 and by["gone", "sa"].actual_share == 1
    assert by["empty", "missing"].tokens == 0
    assert max(r.copy for r in rows if r.source == "rare") <= 4
    assert all(r.copy == 1 for r in rows if r.source != "rare")
    times = [(r.mix_id, r.finish) for r in rows]
    assert times == sorted(times)
    again = mix.mix(docs(spark).repartition(7), targets(spark))[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert {r.doc_id for r in rows}.isdisjoint({2000, 2001, 2002})


def test_budget_and_empty(spark):
    _, shares = mix.mix(docs(spark), targets(spark), budget=100)
    assert {r.mix_id: r.budget for r in shares.collect()}["m"] == 100
    chosen, shares = mix.mix(docs(spark).limit(0), targets(spark))
    assert chosen.count() == 0
    assert shares.agg(F.sum("tokens")).first()[0] == 0
    assert mix.mix(docs(spark), targets(spark).limit(0))[1].count() == 0


def test_finish_is_the_prefix_sum_over_the_share(spark):
    chosen, shares = mix.mix(docs(spark), targets(spark))
    for source, share in (("sa", 0.5), ("rare", 0.2)):
        total = 0
        for r in sorted((r for r in chosen.collect() if (r.mix_id, r.source) == ("m", source)), key=lambda r: r.finish):
            total += r.n_tokens
            assert r.finish == pytest.approx(total / share)
