import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cellseason.llm.bpe import TrieEncoder, Vocabulary, encode_decode

from .helpers import no_documents, odd_documents

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        return TrieEncoder(Vocabulary(f.read())), Tokenizer.from_file(PATH)


def same(both, texts):
    mine, theirs = both
    for got, want, text in zip(mine.encode(texts), theirs.encode_batch(texts, add_special_tokens=False), texts):
        assert got == (" ".join(map(str, want.ids)), theirs.decode(want.ids, skip_special_tokens=False)), text


def test_random_words(both):
    rng = random.Random(2)
    alphabet = list("aabcdeeefghiijlmnoprsttuvwxyz") + ["é", "ß", "'s", "'", "!", " ", "  ", "\n", "1", "09", "漢", "🙂", "Σ", "İ", "é", "<|endoftext|>", "<|startoftext|>", "</w>", " ", "\x00", " "]
    same(both, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)])


def test_repeated_letters_and_long_words(both):
    same(both, ["a" * n for n in range(60)] + ["ab" * n for n in range(40)] + ["aab" * n for n in range(40)] + ["x" * 5000, "!" * 300, "hello" * 500])


def test_all_characters(both):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 40000):
        same(both, [" ".join(f"a{c}b" for c in points[j : j + 500]) for j in range(i, min(len(points), i + 40000), 500)])


def test_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in encode_decode(docs, PATH, full=True).collect()}
    for d in docs.collect():
        want = both[1].encode(d.text, add_special_tokens=False)
        r = got[d.doc_id]
        assert r.ids == want.ids and r.n_tokens == len(want.ids) and r.decoded == both[1].decode(want.ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_odd_rows(spark):
    got = encode_decode(odd_documents(spark), PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 11 and sum(r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == empty for r in got) == 4
    assert encode_decode(no_documents(spark), PATH).collect() == []
