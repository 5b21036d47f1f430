"""Text rules as column expressions. Regular expressions use UNIX line mode so that only a line feed
ends a line, and spell out the Unicode classes of letters, digits and blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
HEADING = r"^(#{1,6})[%s]+(.+)$" % BLANK
#: Bounds of chunks that are copied at a step.
_RUN = 256


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(_c(c), "^[%s]+|[%s]+\\z" % (BLANK, BLANK), "")


def anchor(title) -> Column:
    """Link anchor of a title: lower case, punctuation removed, runs of blanks and dashes to one dash."""
    kept = F.regexp_replace(F.lower(_c(title)), "[^%s%s-]" % (WORD, BLANK), "")
    return F.regexp_replace(kept, "[-%s]+" % BLANK, "-")


def lines(text) -> Column:
    return F.split(_c(text), "\n", -1)


def file_lines(text) -> Column:
    """Lines as a file reader yields them: no empty last line after a final line feed."""
    t = _c(text)
    body = F.when(t.endswith("\n"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(lines(body))


def occurrences(text, query: str | Column) -> Column:
    """Case-insensitive count of non-overlapping hits."""
    q = F.lower(F.lit(query) if isinstance(query, str) else query)
    low = F.lower(_c(text))
    return ((F.length(low) - F.length(F.replace(low, q, F.lit("")))) / F.length(q)).cast("int")


def preview(text, query: str, width: int = 200) -> Column:
    """Text around the first hit, half the width on each side, with ellipses where it is cut."""
    t, half = _c(text), width // 2
    pos = F.locate(query.lower(), F.lower(t)) - 1
    start = F.greatest(F.lit(0), pos - half)
    end = F.least(F.length(t), pos + len(query) + half)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(t, start + 1, end - start),
                   F.when(end < F.length(t), "...").otherwise(""))
    return F.when(pos < 0, "").otherwise(strip(cut))


def clean_text(c) -> Column:
    """Runs of spaces to one, at most one blank line in a row, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(_c(c), " +", " "), "\n{3,}", "\n\n"))


def word_count(c) -> Column:
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, "[%s]+" % BLANK, -1)))


def section_title(content) -> Column:
    return F.nullif(F.regexp_extract(_c(content), r"(?md)^# Section \d+: (.+)$", 1), F.lit(""))


def section_source(content) -> Column:
    return F.nullif(F.regexp_extract(_c(content), r"(?md)> Extrait de: (.+)$", 1), F.lit(""))


def section_level(content) -> Column:
    return F.nullif(F.regexp_extract(_c(content), r"(?md)> Niveau: (\d+)$", 1), F.lit("")).cast("int")


def without_navigation(content) -> Column:
    """Section body without the trailing navigation block, trimmed."""
    return strip(F.regexp_replace(_c(content), r"(?s)---\n\n## Navigation.*", ""))


def definitions(text, term: str, limit: int = 3) -> Column:
    """First lines that hold the term followed by a colon."""
    return F.slice(F.regexp_extract_all(_c(text), F.lit(r"(?mid)^.*%s.*:.*$" % term), F.lit(0)), 1, limit)


def links(text) -> Column:
    """Markdown links as an array of ``{label, target}``."""
    rx = F.lit(r"(?d)\[(.+?)\]\((.+?)\)")
    t = _c(text)
    return F.arrays_zip(F.regexp_extract_all(t, rx, F.lit(1)).alias("label"), F.regexp_extract_all(t, rx, F.lit(2)).alias("target"))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(text, size: int = 1000, overlap: int = 200) -> Column:
    """Overlapping chunks as an array of ``{start, end, text}`` (0-based): each chunk ends at its last line feed
    when that lies past the middle and text remains. ``end`` may pass the end of the text.

    The text is cut once into pieces of ``size`` characters, so a window lies in two neighbouring pieces and no step looks at the text
    before it. A per-row fold over the chunk number finds the bounds; its state is the bounds and the next start. Bounds are
    kept in runs of at most ``_RUN``, so that a step copies one run and not all of them."""
    if size // 2 + 1 <= overlap:
        raise ValueError("overlap must stay below half the chunk size, or a chunk might not advance")
    t = _c(text)
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(t) / F.lit(size // 2 + 1 - overlap)).cast("int")))
    bounds = "array<struct<start:int,end:int>>"

    def window(pieces: Column, at: Column, width: Column) -> Column:
        k = F.floor(at / F.lit(size)).cast("int")
        both = F.concat(F.get(pieces, k), F.coalesce(F.get(pieces, k + 1), F.lit("")))
        return F.substring(both, at - k * size + 1, width)

    def fold(pieces: Column) -> Column:
        state = F.struct(F.array().cast(f"array<{bounds}>").alias("full"), F.array().cast(bounds).alias("run"), F.lit(0).alias("at"), F.length(t).alias("n"))

        def advance(s, _):
            at, n = s["at"], s["n"]
            # distance of the last line feed from the end of the window, 0 when there is none
            gap = F.when(at + size < n, F.locate("\n", F.reverse(window(pieces, at, F.lit(size))))).otherwise(0)
            end = _once(gap, lambda g: (at + size - F.when((g > 0) & (size - g > size // 2), g).otherwise(0)).cast("int"))
            grown = _once(end, lambda e: _once(F.struct(at.alias("start"), e.alias("end")), lambda span: F.struct(
                F.when(F.size(s["run"]) >= _RUN, F.concat(s["full"], F.array(s["run"]))).otherwise(s["full"]).alias("full"),
                F.when(F.size(s["run"]) >= _RUN, F.array(span)).otherwise(F.concat(s["run"], F.array(span))).alias("run"),
                (e - overlap).cast("int").alias("at"), n.alias("n"))))
            return F.when(at < n, grown).otherwise(s)

        return F.aggregate(steps, state, advance, lambda s: F.concat(F.flatten(s["full"]), s["run"]))

    def cut(pieces: Column) -> Column:
        return F.transform(fold(pieces), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), window(pieces, s["start"], s["end"] - s["start"]).alias("text")))

    return _once(F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % size), F.lit(0)), cut)
