"""BPE encoding and decoding by prefix-sharing trie traversal.

Greedy-merge BPE has one valid token sequence for a symbol string: each token encodes to itself and each neighbouring pair
encodes to itself. So the encoding of a prefix is its last token after the encoding of what stands before that token, and all
words with a common prefix share the last-token states of that prefix. Distinct words are walked in sorted order, which is the
depth-first order of their trie: the states of the path to the current node are kept, a new word only extends them.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Remembered words and token pairs of a task; beyond, the memory starts anew. It holds no results, so this only costs time.
CACHE = 150_000
NEVER = 1 << 60

#: What is outside the ranges that have not changed since long.
_RARE = "[^\x00-\u0240\u0300-\u0377\u0390-\u0481\u2010-\u2027\u2030-\u205e\u20a0-\u20b0\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b))) for b in range(256)]


class Vocabulary:
    """What the tokenizer file says; only BPE files with byte-level symbols and a suffix of last symbols are read."""

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in reversed([*enumerate(model["merges"])])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern).findall
        self.bytes = byte_symbols()
        # Letters and digits added by late Unicode versions are split as the tokenizers library does, by that library.
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.rare = re.compile(_RARE).search
        self.normalizer = Tokenizer.from_str(text).normalizer
        self.splitter = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)

    def words(self, text: str) -> list[str]:
        """Of the composed form, each character in lower case by itself. White space only separates words and is dropped."""
        if self.rare(text):
            return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def symbols(self, token: str) -> list[str]:
        """Of a token: its characters, the last one with the suffix if the token has it."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def spines(self, token: str) -> tuple[list, list] | None:
        """Of the merges of a token by itself: the ranks at which its last and its first part change, with that part.

        None if the string isn't a token that encodes to itself. Merges go by rank, leftmost first.
        """
        if token not in self.ids:
            return None
        parts, ranks = self.symbols(token), self.ranks
        last, first = [(-1, parts[-1])], [(-1, parts[0])]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = ranks.get((parts[i], parts[i + 1]))
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                first.append((best, parts[0]))
            if at == len(parts) - 1:
                last.append((best, parts[-1]))
        return last, first


class TrieEncoder:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.alone: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ids: dict = {}
        self.tokens: dict = {}

    def _spines(self, token: str):
        if token not in self.alone:
            if len(self.alone) > CACHE:
                self.alone.clear()
            self.alone[token] = self.v.spines(token)
        return self.alone[token]

    def _pair(self, left: str, right: str) -> bool:
        """Whether the two tokens side by side stay as they are: no merge over their border comes before those inside them."""
        if len(self.pairs) > 2 * CACHE:
            self.pairs.clear()
        ok, own = False, self._spines(right)
        if own is not None:
            a, b, ranks = self._spines(left)[0], own[1], self.v.ranks
            i = j = 0
            while True:
                rank = ranks.get((a[i][1], b[j][1]))
                next_a = a[i + 1][0] if i + 1 < len(a) else NEVER
                next_b = b[j + 1][0] if j + 1 < len(b) else NEVER
                if rank is not None and rank < next_a and rank <= next_b:
                    break
                if next_a == next_b == NEVER:
                    ok = True
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
        self.pairs[left, right] = ok
        return ok

    def walk(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word. A state is the last token of a node and the length of the path before it."""
        paths = []
        for word in words:
            syms = [self.v.bytes[b] for b in word.encode("utf-8")]
            syms[-1] += self.v.end
            paths.append((syms, word))
        paths.sort(key=lambda x: x[0])
        out: dict[str, list[str]] = {}
        path: list[str] = []
        last: list[str] = []
        before: list[int] = []
        pairs = self.pairs
        for syms, word in paths:
            keep = 0
            for a, b in zip(path, syms):
                if a != b:
                    break
                keep += 1
            del last[keep:], before[keep:]  # back to the last shared node of the trie
            path = syms
            for i in range(keep, len(syms)):
                token, start = syms[i], i
                while start:  # only one suffix of the path is valid after the last token of what stands before it
                    key = (last[start - 1], token)
                    ok = pairs.get(key)
                    if ok is None:
                        ok = self._pair(*key)
                    if ok:
                        break
                    start -= 1
                    token = syms[start] + token
                if not start and self._spines(token) is None:
                    raise ValueError(f"no token for the symbol {syms[i]!r}")
                last.append(token)
                before.append(start)
            tokens, at = [], len(syms)
            while at:
                tokens.append(last[at - 1])
                at = before[at - 1]
            out[word] = tokens[::-1]
        return out

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text its decimal ids and its tokens, each joined by one space."""
        special, split = self.v.special, []
        fresh: set[str] = set()
        for text in texts:
            if self.v.split_special and self.v.split_special.search(text):
                found: list = []
                for piece in self.v.split_special.split(text):
                    found += [(piece,)] if piece in special else self.v.words(piece)
                fresh.update(w for w in found if isinstance(w, str))
            else:
                found = self.v.words(text)
                fresh.update(found)
            split.append(found)
        if len(self.ids) > CACHE:
            self.ids, self.tokens = {}, {}
        fresh.difference_update(self.ids)
        for word, tokens in self.walk(list(fresh)).items():
            self.ids[word], self.tokens[word] = " ".join([str(self.v.ids[t]) for t in tokens]), " ".join(tokens)
        for text, n in special.items():
            self.ids[(text,)], self.tokens[(text,)] = str(n), text
        return [(" ".join(map(self.ids.__getitem__, found)), " ".join(map(self.tokens.__getitem__, found))) for found in split]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row a document: ``id_col``, n_tokens, ids_sha256, decoded_sha256; with ``full`` also ids and decoded themselves.

    The digests are of the decimal ids joined by one space and of the tokens joined by one space, which is what decoding gives
    for a file without a decoder. Null counts as empty: no tokens and the digests of an empty string. Strings of special tokens in
    a text become those tokens. Repeated rows are encoded one by one; other columns are ignored. The vocabulary file is read by
    the driver and sent along (its size does not depend on the data); documents are only mapped over.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        coder = TrieEncoder(Vocabulary(shared.value))

        def run(batch):
            out = {"id": batch["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if full else {})
            for ids, decoded in coder.encode([t or "" for t in batch["text"]]):
                out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if full:
                    out["ids"].append([int(x) for x in ids.split()])
                    out["decoded"].append(decoded)
            return out

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, schema, rows=500).withColumnRenamed("id", id_col)
