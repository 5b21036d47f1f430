"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, one scan of every text."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

WINDOW = 13
#: An automaton takes windows of so many characters at most (a benchmark of about 0.6 MB); a larger benchmark is scanned by several, one after
#: the other, each built once for ROWS documents.
PATTERN_CHARS, ROWS = 8_000_000, 4096

# Bytes of words stay (A-Z lower-cased), every other byte becomes a space. In UTF-8, non-ASCII characters only have high bytes.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[str, tuple[int, set[str]]]:
    """Padded window text (one byte a character) -> its number of words and the items that hold it."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            key = f" {b' '.join(part).decode('latin-1')} "
            found.setdefault(key, (len(part), set()))[1].add(item_id)
    return found


def blocks(found: dict[str, tuple[int, set[str]]], chars: int = PATTERN_CHARS) -> list[list[tuple[str, int, set[str]]]]:
    out: list[list] = []
    room = 0
    for key in sorted(found):
        if not out or room < len(key):
            out.append([])
            room = chars
        out[-1].append((key, *found[key]))
        room -= len(key)
    return out


def automaton(block: list[tuple[str, int, set[str]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for key, n, ids in block:
        a.add_word(key, (len(key), n, ids))
    a.make_automaton()
    return a


def scan(w: list[bytes], a) -> tuple[list[tuple[int, int]], set[str]]:
    """Ranges [first, after) of words that an automaton hits, and the items with an occurring window."""
    text = f" {b' '.join(w).decode('latin-1')} "
    ranges, ids, starts = [], set(), None
    for end, (size, n, own) in a.iter(text):
        if starts is None:  # of each word in the normalised text
            starts = list(accumulate((len(x) + 1 for x in w), initial=1))
        first = bisect_left(starts, end - size + 2)
        ranges.append((first, first + n))
        ids |= own
    return ranges, ids


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges."""
    out: list[tuple[int, int]] = []
    for first, after in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(after, out[-1][1]))
        else:
            out.append((first, after))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as code-point offsets [start, stop) of the original text."""
    if not ranges:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    heads = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80]  # first bytes of the code points
    return [{"start": bisect_right(heads, at[i][0]) - 1, "stop": bisect_left(heads, at[j - 1][1])} for i, j in ranges]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, share: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: ``id_col``, the columns of ``keep``, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Words inside any
    occurrence are hit. ``contaminated``: n_hit > 0 and share * n_hit >= n_words. ``spans`` are the hit passages as code-point
    offsets of the original text. Null and empty texts have no words and are clean; items without words match nothing; a null
    item id counts as one id, written as an empty string. Repeated rows are judged one by one; other columns are ignored.
    The items are a test set that fits the driver, as do their windows, about 13 times their size; documents are only mapped over, nothing
    is shuffled. No documents give no rows, no items clean documents; very long texts are judged whole.
    """
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).collect()
    shared = docs.sparkSession.sparkContext.broadcast(blocks(item_windows([(r.i, r.t) for r in rows], window)))

    def make():
        parts = shared.value
        kept = automaton(parts[0]) if len(parts) == 1 else None

        def judge(batch):
            out = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")}
            texts = batch.pop("judged_text")
            found = [([], set()) for _ in texts]
            for part in parts:
                a = kept or automaton(part)
                for text, (ranges, ids) in zip(texts, found):
                    w = words(text)
                    more = scan(w, a) if w else ((), ())
                    ranges += more[0]
                    ids.update(more[1])
            for text, (ranges, ids) in zip(texts, found):
                w, ranges = words(text), merged(ranges)
                hit = sum(b - a for a, b in ranges)
                out["n_words"].append(len(w))
                out["n_hit"].append(hit)
                out["n_items"].append(len(ids))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
                out["contaminated"].append(hit > 0 and share * hit >= len(w))
                out["spans"].append(original_spans(text, ranges) if ranges else [])
            return batch | out

        return judge

    columns = [id_col, *[c for c in keep if c != id_col]]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return map_rows(docs.select(*[F.col(c) for c in columns], F.col(text_col).alias("judged_text")), make,
                    schema + ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
                    "spans array<struct<start:long,stop:long>>", 256 if len(shared.value) < 2 else ROWS)
