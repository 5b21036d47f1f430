"""Edit-aware token counts: a segment tree over the pre-tokens of each document; an edit re-encodes only what it touches."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Pre-tokens of a leaf block of the tree when it is built.
BLOCK = 64
#: Remembered pre-tokens of a task; beyond, the memory starts anew.
CACHE = 150_000


class PieceCounts(dict):
    """Pre-token -> how many tokens it has."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


class CountTree:
    """Leaves are pre-tokens (characters, tokens) in blocks; the inner nodes hold sums over the blocks below, node i over 2i and 2i + 1."""

    def __init__(self, sizes: list[int], counts: list[int]):
        self.blocks = [(sizes[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(sizes), BLOCK)] or [([], [])]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (s, c) in enumerate(self.blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(s), sum(c)
        for i in range(self.width - 1, 0, -1):
            self._add_up(i)

    def _add_up(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def put(self, at: int, sizes: list[int], counts: list[int]) -> None:
        """New leaves for block ``at``; sums change on its path to the root only."""
        self.blocks[at] = (sizes, counts)
        i = self.width + at
        self.chars[i], self.tokens[i] = sum(sizes), sum(counts)
        while i > 1:
            i //= 2
            self._add_up(i)

    def find(self, end: int) -> tuple[int, int, int]:
        """Block, place in it and start of the first leaf that ends at ``end`` or later; past the last leaf if none does."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if start + self.chars[i] < end:
                start += self.chars[i]
                i += 1
        at = min(i - self.width, len(self.blocks) - 1)
        if at < i - self.width:  # beyond the last block
            return at, len(self.blocks[at][0]), self.chars[1]
        for place, size in enumerate(self.blocks[at][0]):
            if start + size >= end:
                return at, place, start
            start += size
        return at, len(self.blocks[at][0]), start


class EditedText:
    """A text with its tree. ``pattern`` looks right only, and at most one character past what decides a match."""

    def __init__(self, text: str, pattern, counts: PieceCounts):
        self.text, self.pattern, self.known = text, pattern, counts
        pieces = pattern.findall(text)
        self.tree = CountTree(list(map(len, pieces)), list(map(counts.__getitem__, pieces)))
        self.reencoded = 0

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replaces [start, stop) by ``insert``. Leaves that end before start - 1 stay; from the first other leaf on, pre-tokens are
        matched anew until one ends after the edit where, by the shift of the edit, an old leaf ended: from there all is as before."""
        shift = len(insert) - (stop - start)
        self.text = self.text[:start] + insert + self.text[stop:]
        tree = self.tree
        block, place, at = tree.find(max(1, start - 1))
        first, kept = block, [x[:place] for x in tree.blocks[block]]
        old_end, fresh = at, ([], [])
        emptied = []
        match = self.pattern.match
        while True:
            while old_end < stop or old_end + shift < at:  # the next old leaf
                if place == len(tree.blocks[block][0]):
                    if block + 1 == len(tree.blocks):
                        break
                    emptied.append(block)
                    block, place = block + 1, 0
                    continue
                old_end += tree.blocks[block][0][place]
                place += 1
            if at >= start + len(insert) and old_end + shift == at and old_end >= stop or at == len(self.text):
                break
            m = match(self.text, at)
            fresh[0].append(m.end() - at)
            fresh[1].append(self.known[m.group()])
            at = m.end()
        if at == len(self.text) and old_end + shift != at:  # no old leaf is left
            emptied += range(block, len(tree.blocks))
            rest = [], []
        else:
            rest = [x[place:] for x in tree.blocks[block]]
        self.reencoded += len(fresh[0])
        for i in emptied:
            if i != first:
                tree.put(i, [], [])
        if block != first and block not in emptied:
            tree.put(block, *rest)
            rest = [], []
        tree.put(first, kept[0] + fresh[0] + rest[0], kept[1] + fresh[1] + rest[1])


def load_encoder(ranks_file: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def count_edited(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """One row a document: ``id_col``, n_tokens, n_pretokens, n_tokens_edited, n_chars_edited, n_reencoded (pre-tokens matched anew).

    ``edits_col``: array<struct<start, stop, insert>> in code points, applied in order, each to the text as the ones before left it.
    Bounds beyond the text are cut to it, a stop before its start counts as the start, null bounds as 0, null inserts as empty, null
    arrays and null edits as no edit. Null texts count as empty and have no tokens. Repeated rows are counted one by one. ``ranks_path``
    is a byte-level BPE rank file, read by the driver and sent along. Documents are only mapped over.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        import regex

        counts, compiled = PieceCounts(load_encoder(shared.value, pattern)), regex.compile(pattern)

        def run(batch):
            out = {"id": batch["id"]} | {k: [] for k in ("n_tokens", "n_pretokens", "n_tokens_edited", "n_chars_edited", "n_reencoded")}
            for text, edits in zip(batch["text"], batch["edits"]):
                state = EditedText(text or "", compiled, counts)
                out["n_tokens"].append(state.tree.tokens[1])
                out["n_pretokens"].append(sum(len(b[0]) for b in state.tree.blocks))
                for e in edits or []:
                    if e is not None:
                        start = min(max(0, e["start"] or 0), len(state.text))
                        state.edit(start, min(max(start, e["stop"] or 0), len(state.text)), e["insert"] or "")
                out["n_tokens_edited"].append(state.tree.tokens[1])
                out["n_chars_edited"].append(state.tree.chars[1])
                out["n_reencoded"].append(state.reencoded)
            return out

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits")), make,
                     f"id {kind}, n_tokens long, n_pretokens long, n_tokens_edited long, n_chars_edited long, n_reencoded long")
    return found.withColumnRenamed("id", id_col)
