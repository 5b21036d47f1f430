import random

import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from cellseason.llm import token_counts
from cellseason.llm.token_counts import EditedText, PieceCounts, count_edited, load_encoder

from .helpers import no_documents, odd_documents

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encode():
    with open(PATH, "rb") as f:
        return load_encoder(f.read(), P.PATTERN)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_edits_give_what_a_new_count_gives(encode, monkeypatch, block):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    rng, pattern, counts = random.Random(block), regex.compile(P.PATTERN), PieceCounts(encode)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "l", "s", "1", "2", ".", "é", "ll", "'re", " the"]
    for _ in range(1500):
        state = EditedText("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))), pattern, counts)
        for _ in range(4):
            start = rng.randint(0, len(state.text))
            state.edit(start, rng.randint(start, min(len(state.text), start + rng.choice([0, 1, 5, 30]))), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 0, 1, 2, 8]))))
            assert [n for sizes, _ in state.tree.blocks for n in sizes] == [len(p) for p in pattern.findall(state.text)]
            assert (state.tree.tokens[1], state.tree.chars[1]) == (len(encode(state.text)), len(state.text))


def test_small_edits_touch_little(encode):
    state = EditedText("word " * 20000, regex.compile(P.PATTERN), PieceCounts(encode))
    for at in (0, 50000, 99000):
        state.edit(at, at + 3, "new")
    assert state.reencoded < 20 and state.tree.tokens[1] == len(encode(state.text))


def edits(*found):
    return F.array(*[F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("stop"), F.lit(t).cast("string").alias("insert")) for a, b, t in found])


def test_odd_rows(spark, encode):
    steps = [(2, 5, "XYZ q"), (-4, None, "start "), (10**6, 10**7, " end"), (7, 3, None), (None, 1, None)]
    got = count_edited(odd_documents(spark).withColumn("edits", edits(*steps)), PATH, P.PATTERN).collect()
    texts = sorted((r.text or "" for r in odd_documents(spark).collect()), key=lambda t: (len(encode(t)), t))
    assert sorted(r.n_tokens for r in got) == [len(encode(t)) for t in texts]

    def edited(t):
        for start, stop, insert in steps:
            a = min(max(0, start or 0), len(t))
            t = t[:a] + (insert or "") + t[min(max(a, stop or 0), len(t)) :]
        return t

    assert sorted((r.n_tokens_edited, r.n_chars_edited) for r in got) == sorted((len(encode(edited(t))), len(edited(t))) for t in texts)
    none = odd_documents(spark).withColumn("edits", F.lit(None).cast("array<struct<start:int,stop:int,insert:string>>"))
    assert all(r.n_tokens == r.n_tokens_edited and not r.n_reencoded for r in count_edited(none, PATH, P.PATTERN).collect())
    assert count_edited(no_documents(spark).withColumn("edits", edits((0, 1, ""))), PATH, P.PATTERN).collect() == []
