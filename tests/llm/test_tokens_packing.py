import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm.packing import fullest, minimum_slack, pack
from ferrule.llm.tokens import TOKENIZER, Encoder, Merges, count_tokens, encode

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def merges():
    return Merges.load(TOKENIZER)


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ019 \n\t'sdt.,_-()éüñß漢字あ😀\x1c\x85\u200b\u3000"), st.characters(max_codepoint=0x24F)), max_size=80))
def test_as_the_public_library(merges, public, text):
    assert Encoder(merges).encode([text])[0] == public.encode(text, add_special_tokens=False).ids


def test_long_words_and_special_strings(merges, public):
    texts = ["ab" * 30_000, "a" * 5001, "<|endoftext|> x<|endoftext|>", "=" * 999, " " * 777 + "x"]
    assert Encoder(merges).encode(texts) == [public.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "k long, text string, ids string")
    got = sorted((r["k"], r["ids"]) for r in encode(df.drop("ids"), ["k"]).collect() if r["k"] != 3)
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, [])]
    assert sorted((r["k"], r["n_tokens"]) for r in count_tokens(df, ["k"]).where("k <> 3").collect()) == [(1, 2), (1, 2), (2, 0)]
    assert encode(df, ["k"]).where("k = 3").first()["ids"] is None
    assert encode(df.limit(0), ["k"]).collect() == []


def test_fullest_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 60)
        sums = {0}
        for s, n in counts.items():
            sums = {t + s * k for t in sums for k in range(n + 1) if t + s * k <= room}
        got = fullest(counts, room)
        assert sum(s * n for s, n in got.items()) == max(sums)
        assert all(n <= counts[s] for s, n in got.items())


def test_plan_places_everything():
    rng = random.Random(2)
    counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(40)}
    left = dict(counts)
    plan = minimum_slack(counts, 100)
    for chosen, times in plan:
        assert sum(s * n for s, n in chosen.items()) <= 100
        for s, n in chosen.items():
            left[s] -= n * times
    assert not any(left.values())


def test_containers(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 7, 7, 7, 50, 99, 100, 101, 250, rng.randrange(1, 100)]), "c") for i in range(300)] + [(5, 7, "c")]
    got = pack(spark.createDataFrame(rows, "doc_id long, n int, container string"), "doc_id", "n", 100, part=3).collect()
    use, end = {}, {}
    for r in got:
        if r["container"] is not None:
            use.setdefault(r["container"], []).append((r["offset"], r["size"]))
    for parts in use.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 100
    assert sum(r["size"] or 0 for r in got) == sum(n or 0 for _, n, _ in rows)
    assert sum(r["container"] is None for r in got) == sum(not n for _, n, _ in rows)
    assert all(r["size"] == 100 for r in got if r["piece"] == 0 and dict((a, b) for a, b, _ in rows)[r["doc_id"]] in (101, 250))
    full = sum(r["size"] or 0 for r in got) / (100 * len(use))
    assert full > 0.97
    assert pack(spark.createDataFrame([], "doc_id long, n int"), "doc_id", "n").collect() == []
