"""Text functions: trimming, token estimates, content hashes, chunking and the plain analyser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 3
#: White space that trimming removes (fixed value), as a character class for Java and RE2.
TRIM_CLASS = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: its characters
TRIMMED = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
TOKEN = r"[\p{L}\p{N}]+"
#: Boundaries from coarse to fine; after the last, text is cut between characters.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def estimate_tokens(text: Column) -> Column:
    """UTF-8 bytes over three, rounded up: an upper bound in thirds of what a byte-level vocabulary needs."""
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN)


def content_hash(text: Column) -> Column:
    return F.sha2(trim(text), 256)


def embedding_input(title: Column, segment: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), segment)


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; the place in the array is the position."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def _finer(pieces: Column, pattern: str, max_tokens: int) -> Column:
    def cut(piece: Column) -> Column:
        return F.when(estimate_tokens(piece) <= max_tokens, F.array(piece)).otherwise(F.filter(F.split(piece, pattern), lambda x: x != ""))

    return F.flatten(F.transform(pieces, cut))


def split_to_fit(text: Column, max_tokens: int) -> Column:
    """Pieces within the budget that join to the text again; only pieces over the budget are cut finer."""
    pieces = F.filter(F.array(text), lambda x: x != "")
    for sep in SEPARATORS:
        pieces = _finer(pieces, "(?<=" + sep.replace(".", "\\.") + ")", max_tokens)
    return _finer(pieces, "", max_tokens)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def rows_of(items: Column) -> Column:
    """An array cut in about as many arrays as each has items. An array that grows item by item is copied each time: over rows that takes n^1.5, not n^2."""

    def cut(every: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(every))), F.lit(1)).cast("int")
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(every) / w).cast("int") - 1, F.lit(0))), lambda i: F.slice(every, i * w + 1, w)))

    return let(items, cut)


def pack(pieces: Column, max_tokens: int) -> Column:
    """Join neighbours greedily up to the budget; segments are trimmed and blank ones dropped."""

    def step(s: Column, piece: Column) -> Column:
        full = (s["now"] != "") & (estimate_tokens(F.concat(s["now"], piece)) > max_tokens)
        return F.struct(
            F.when(full, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]).alias("out"),
            F.when(full, piece).otherwise(F.concat(s["now"], piece)).alias("now"),
        )

    def row(s: Column, pieces: Column) -> Column:
        none = F.struct(F.array().cast("array<string>").alias("out"), s["now"].alias("now"))
        done = F.aggregate(pieces, none, step)
        return let(done, lambda d: F.struct(F.when(F.size(d["out"]) > 0, F.concat(s["rows"], F.array(d["out"]))).otherwise(s["rows"]).alias("rows"), d["now"].alias("now")))

    state = F.struct(F.array().cast("array<array<string>>").alias("rows"), F.lit("").alias("now"))
    joined = F.aggregate(rows_of(pieces), state, row, lambda s: F.concat(F.flatten(s["rows"]), F.array(s["now"])))
    return F.filter(F.transform(joined, lambda x: trim(x)), lambda x: x != "")


def chunk_text(text: Column, max_tokens: int) -> Column:
    """Segments of a text, each within `max_tokens` by estimate_tokens; null gives an empty array."""
    return pack(split_to_fit(F.coalesce(text, F.lit("")), max_tokens), max_tokens)
