"""Validators and small string functions, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\D", "")


def min_digits(x: Column, n: int) -> Column:
    return F.length(digits_of(x)) >= n


def luhn(x: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = digits_of(x)
    return F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def aba(x: Column) -> Column:
    """Nine digits weighted 3, 7, 1; a multiple of ten above zero."""
    d = digits_of(x)
    at = lambda i: F.coalesce(F.substring(d, i, 1).try_cast("int"), F.lit(0))
    total = sum((at(i) * (3, 7, 1)[(i - 1) % 3] for i in range(1, 10)), F.lit(0))
    return (F.length(d) == 9) & (total % 10 == 0) & (total > 0)


#: Validators by name. A caller's own is added with :func:`validator`.
CHECKS: dict[str, Callable[[Column], Column]] = {"luhn": luhn, "aba": aba}


def validator(name: str, check: Callable[[Column], Column]) -> None:
    """Name a check for patterns: a function from the match, a Column, to whether it stands."""
    if name in CHECKS and CHECKS[name] is not check:
        raise ValueError(f"there is a validator {name}")
    CHECKS[name] = check


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blocks(x: Column) -> Column:
    """What stands in for a removed string: as many blocks as it is long, twelve at most."""
    return F.repeat(F.lit("█"), F.least(F.length(x), F.lit(12)))


def mask(x: Column) -> Column:
    """First and last two characters for reports; four or fewer are hidden whole."""
    s = squeeze(x)
    return F.when(F.length(s) <= 4, F.repeat(F.lit("*"), F.length(s))).otherwise(F.concat(F.left(s, F.lit(1)), F.repeat(F.lit("*"), F.length(s) - 3), F.right(s, F.lit(2))))


def occurrences(text: Column, x: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, x, F.lit("")))) / F.length(x)).cast("int")


def line_of(text: Column, x: Column) -> Column:
    """Number of the line in which x first occurs."""
    head = F.call_function("substring_index", text, x, F.lit(1))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def safe_name(x: Column, ordinal: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(x, r"[^A-Za-z0-9._-]", "_"), F.lit("")), F.concat(F.lit("attachment"), ordinal.cast("string")))


def output_name(name: Column, new: str | None = None) -> Column:
    """stem_redacted.ext, or stem_ext_redacted.new where the format changes."""
    ext = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    return F.concat(stem, F.lit("_redacted"), ext) if new is None else F.when(F.lower(ext) == new, F.concat(stem, F.lit("_redacted"), ext)).otherwise(F.concat(stem, F.lit("_"), F.regexp_replace(ext, r"^\.", ""), F.lit("_redacted" + new)))


def latin1(x: Column) -> Column:
    """Tabs as two spaces, no carriage returns, ? for what latin-1 lacks."""
    return F.regexp_replace(F.replace(F.replace(x, F.lit("\t"), F.lit("  ")), F.lit("\r"), F.lit("")), r"[^\x{0}-\x{ff}]", "?")


def decode(content: Column) -> Column:
    """UTF-8, or latin-1 where it is no valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def rectangle(box: Column, width: Column, height: Column) -> Column:
    """A normalised box (x, y, w, h; origin bottom left) as page corners from the top left."""
    return F.struct((box.x * width).alias("x0"), ((1 - box.y - box.h) * height).alias("y0"), ((box.x + box.w) * width).alias("x1"), ((1 - box.y) * height).alias("y1"))


def latin1_losses(x: Column) -> Column:
    """How many characters :func:`latin1` replaces by a question mark."""
    return F.regexp_count(x, F.lit(r"[^\x{0}-\x{ff}]"))


def decode_note(content: Column) -> Column:
    """What a report says of a text that is no valid UTF-8; null where it is."""
    return F.when(~F.is_valid_utf8(content.cast("string")), F.lit("not UTF-8; read as latin-1"))


#: Fixed value: characters that a sheet's title can have.
TITLE = 31


def sheet_title(redacted: Column, ordinal: Column) -> Column:
    """A redacted sheet title as a workbook can hold it; Sheet_n where nothing usable is left."""
    cut = F.substring(redacted, 1, TITLE)
    return F.when((F.trim(cut) == "") | cut.rlike(r"[\[\]:*?/\\]") | cut.isNull(), F.concat(F.lit("Sheet_"), ordinal.cast("string"))).otherwise(cut)


def wrap(x: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, words kept whole where they fit, longer ones on a line of their own."""
    words = F.filter(F.split(squeeze(x), " "), lambda w: w != "")

    def add(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.size(lines) > 0
        joined = F.concat(last, F.lit(" "), w)
        return F.when(fits & (F.length(joined) <= width), F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(joined))).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(words, F.array().cast("array<string>"), add)
