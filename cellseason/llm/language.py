"""Language identification by compression: the dictionary that makes a text smallest names its language."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

UNDETERMINED = "und"
#: The fit is bounded: so many different texts of a language, so many characters of each, so many bytes of a dictionary.
SAMPLE_TEXTS, SAMPLE_CHARS, DICT_BYTES = 128, 2000, 112 << 10
LEVEL = 12
#: Share of the second smallest size by which the smallest must be smaller; below, the document is rejected.
MARGIN = 0.01
#: Texts are compressed in pieces of so many bytes at most, each afresh: what a dictionary saves, and so the margin, does not shrink with length.
PIECE = 16 << 10
#: Put before every piece, equal for all languages: blocks of a few bytes would be stored as they are.
LEAD = b"0123456789" * 20

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Runs of letters in lower case, one space between them."""
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


def fit_dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries of the languages of labelled rows, from a bounded sample: of each remainder of the text hashes the smallest.

    Null languages, null texts and texts without a letter teach nothing. Equal texts count once.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.substring(text_col, 1, SAMPLE_CHARS).alias("part"))
    least = F.min(F.struct("h", "part")).alias("s")  # kept where the rows are: one row a language, place and task is exchanged
    sample = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("place")).agg(least).select("lang", "s.*").collect()
    out: dict[str, bytes] = {}
    for r in sorted(sample, key=lambda r: (r.lang, -r.h)):
        out[r.lang] = out.get(r.lang, b"") + letters(r.part) + b" "
    return {lang: content[-DICT_BYTES:] for lang, content in out.items()}


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> dict:
    import zstandard

    out = {}
    for lang, content in sorted(dictionaries.items()):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        out[lang] = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
    return out


def classify(text: str | None, coders: dict, empty: dict[str, int]) -> tuple[str, float]:
    """Language and margin, both by the sizes of all pieces of the text together; ties go to the first name."""
    body = letters(text)
    if not body or not coders:
        return UNDETERMINED, 0.0
    step = -(-len(body) // -(-len(body) // PIECE))
    pieces = [LEAD + body[i : i + step] for i in range(0, len(body), step)]
    sizes = sorted((max(0, sum(len(c.compress(piece)) - empty[lang] for piece in pieces)), lang) for lang, c in coders.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: ``id_col``, the columns of ``keep``, lang_pred, score (0 to 1: the margin), accepted.

    ``lang_pred`` is a learned language, or ``und`` for a null text, a text without a letter, or if nothing was learned; those
    are rejected, as are texts with a margin below ``margin`` (with one learned language the margin is 1). Whole texts are
    compressed, whatever their length, in equal pieces of at most PIECE bytes. Repeated rows are judged one by one. The dictionaries are bounded and sent along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        coders = compressors(shared.value)
        empty = {lang: len(c.compress(LEAD)) for lang, c in coders.items()}

        def run(batch):
            got = [classify(text, coders, empty) for text in batch.pop("judged_text")]
            return batch | {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got],
                            "accepted": [g[0] != UNDETERMINED and g[1] >= margin for g in got]}

        return run

    columns = [id_col, *[c for c in keep if c != id_col]]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    source = docs.select(*[F.col(c) for c in columns], F.col(text_col).alias("judged_text"))
    return map_rows(source, make, schema + ", lang_pred string, score double, accepted boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2
