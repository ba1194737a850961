"""Column expressions over raw cells.  All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming takes off, and characters that cannot be seen.
SPACE_CLASS = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WIDE_SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
CONTROLS = r"\x00-\x1F\x7F\x{200B}-\x{200D}\x{FEFF}"
HIDDEN = r"\x00-\x1F\x7F\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}"
#: Characters that windows-1252 has at the bytes 0x80 to 0x9F, and those bytes as code points.
CP1252_SPECIALS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
#: Spellings of a missing value: those that pandas reads as missing, and further ones.
KNOWN_NULL_TOKENS = ("na", "n/a", "#na", "#n/a", "nan", "-nan", "null", "none", "<na>", "nil")
EXTRA_NULL_TOKENS = ("-", "--", "?", ".", "nc", "n.c.", "inconnu", "unknown", "vide", "empty")

# How numbers, dates and times are written.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
YMD = rf"^(\d{{4}})([-/])(\d{{1,2}})\2(\d{{1,2}})(?:[T ]{_CLOCK})?$"
DMY = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}})(?:[ T]{_CLOCK})?$"
TIME = rf"^{_CLOCK}$"


def js_trim(c: Column) -> Column:
    """Take white space of every kind off both ends (``trim`` knows the plain space only)."""
    return F.regexp_replace(c, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty, or white space only."""
    return F.coalesce(js_trim(c) == "", F.lit(True))


def parse_number(c: Column, decimal_comma: bool = False) -> Column:
    """The number a cell holds as a double, else null.

    Spaces of three kinds may stand anywhere; with ``decimal_comma`` the first
    comma of a cell without a point is the point.  Words like NaN, type
    suffixes and hexadecimal digits are no numbers, nor is what overflows.
    """
    bare = F.regexp_replace(js_trim(c), r"[ \x{A0}\x{202F}]", "")
    if decimal_comma:
        bare = F.when(bare.contains(".") | ~bare.contains(","), bare).otherwise(F.regexp_replace(bare, r"^([^,]*),", "$1."))
    value = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def _clock_ms(text: Column, pattern: str, first: int) -> Column:
    """Milliseconds of the clock groups; 0 if there is no clock, null if it is impossible."""
    part = lambda k: F.regexp_extract(text, pattern, first + k)
    number = lambda k: F.when(part(k) == "", F.lit(0)).otherwise(part(k).try_cast("int"))
    hour, minute, second = number(0), number(1), number(2)
    milli = F.rpad(part(3), 3, "0").substr(1, 3).try_cast("int")
    ok = (hour <= 23) & (minute <= 59) & (second <= 59)
    return F.when(ok, ((hour * 60 + minute) * 60 + second) * 1000 + F.coalesce(milli, F.lit(0)))


def parse_temporal(c: Column, order: str) -> Column:
    """A date (``ymd``, ``dmy``) as milliseconds since 1970 UTC, a ``time`` as milliseconds since midnight, else null.

    Impossible days and clocks are null.  Years below 100 are those years.
    """
    t = js_trim(c)
    if order == "time":
        return F.when(t.rlike(TIME), _clock_ms(t, TIME, 1)).cast("double")
    pattern = YMD if order == "ymd" else DMY
    group = lambda k: F.regexp_extract(t, pattern, k).try_cast("int")
    year, month, day = (group(1), group(3), group(4)) if order == "ymd" else (group(4), group(3), group(1))
    midnight = F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    days = F.datediff(midnight.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return F.when(t.rlike(pattern), days * 86_400_000 + _clock_ms(t, pattern, 5)).cast("double")


def format_temporal(value: Column, order: str, with_time: bool = False) -> Column:
    """Milliseconds as text: yyyy-MM-dd or dd/MM/yyyy, with HH:mm[:ss] if asked for; a time is HH:mm:ss."""
    if order == "time":
        s = F.floor(value / 1000)
        two = lambda x: F.lpad(F.floor(x).cast("long").cast("string"), 2, "0")
        return F.concat(two(s / 3600), F.lit(":"), two((s % 3600) / 60), F.lit(":"), two(s % 60))
    at = F.timestamp_millis(F.floor(value).cast("long"))
    day = F.date_format(at, "yyyy-MM-dd" if order == "ymd" else "dd/MM/yyyy")
    if not with_time:
        return day
    clock = F.when(F.second(at) == 0, F.date_format(at, "HH:mm")).otherwise(F.date_format(at, "HH:mm:ss"))
    return F.concat(day, F.lit(" "), clock)


def null_token(c: Column) -> Column:
    """``known``, ``extra`` or null: whether the trimmed cell spells a missing value."""
    low = F.lower(js_trim(c))
    return F.when(low.isin(*KNOWN_NULL_TOKENS), "known").when(low.isin(*EXTRA_NULL_TOKENS), "extra")


def value_pattern(c: Column) -> Column:
    """The shape of a trimmed cell: each digit 9, each run of capitals A, each run of small letters a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(js_trim(c), r"\d", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")


def remove_controls(c: Column) -> Column:
    """Drop control and zero-width characters."""
    return F.regexp_replace(c, f"[{CONTROLS}]", "")


def title_case(c: Column) -> Column:
    """Small letters, but capitals at the start and after white space, hyphen or apostrophe."""
    words = F.split(F.lower(c), r"(?<=[\s\x{A0}\x{202F}\-'\x{2019}])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def fix_mojibake(c: Column) -> Column:
    """UTF-8 that was read as windows-1252, read rightly; null for a cell that is not damaged this way."""
    as_bytes = F.translate(c, CP1252_SPECIALS, CP1252_BYTES)
    marked = c.rlike("[ÃÂâ]") & as_bytes.rlike(r"^[\x{00}-\x{FF}]*$")
    latin = F.when(marked, as_bytes).otherwise(F.lit(""))
    fixed = F.try_validate_utf8(F.encode(latin, "iso-8859-1").cast("string"))
    return F.when(marked & (fixed != c) & ~F.coalesce(fixed.contains("�"), F.lit(False)), fixed)


def _marked_letters() -> tuple[str, str]:
    """All characters that canonical decomposition takes apart into one character and marks (U+0300 to U+036F), and that character."""
    from unicodedata import normalize

    bare = {chr(c): "".join(x for x in normalize("NFD", chr(c)) if not "\u0300" <= x <= "\u036f") for c in range(0xC0, 0xD800)}
    pairs = [(c, b) for c, b in bare.items() if len(b) == 1 and b != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


MARKED, UNMARKED = _marked_letters()


def strip_accents(c: Column) -> Column:
    """Letters of any script without their marks; marks that stand alone are dropped."""
    return F.translate(F.regexp_replace(c, r"[\x{300}-\x{36F}]", ""), MARKED, UNMARKED)


def loose_key(c: Column) -> Column:
    """A spelling without accents, capitals and punctuation, single spaces between words."""
    bare = F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(bare, r" +", " "))


def visible_text(c: Column) -> Column:
    """A cell in which odd spaces show as ⍽, spaces at the ends or doubled as ␣, hidden characters as ‹hex›."""
    shown = F.regexp_replace(c, f"[{WIDE_SPACES}]", "⍽")
    chars = F.split(shown, "")
    named = lambda x: F.concat(F.lit("‹"), F.lpad(F.hex(F.ascii(x)), 4, "0"), F.lit("›"))
    shown = F.array_join(F.transform(chars, lambda x: F.when(x.rlike(f"^[{HIDDEN}]$"), named(x)).otherwise(x)), "")
    head, tail = F.regexp_extract(shown, r"^( *)", 1), F.regexp_extract(shown, r"[^ ]( +)$", 1)
    body = F.substr(shown, F.length(head) + 1, F.length(shown) - F.length(head) - F.length(tail))
    return F.concat(F.repeat(F.lit("␣"), F.length(head)), _doubled(body), F.repeat(F.lit("␣"), F.length(tail)))


def _doubled(c: Column) -> Column:
    """All but the first of several spaces in a row as ␣."""
    return F.regexp_replace(c, r"(?<= ) ", "␣")


def difference(target: Column, variant: Column) -> Column:
    """How a variant is written differently, as array<string>: what cannot be seen comes first."""
    hidden = variant.rlike(f"[{HIDDEN}]") & ~target.rlike(f"[{HIDDEN}]")
    wide = variant.rlike(f"[{WIDE_SPACES}]")
    flat = F.regexp_replace(F.regexp_replace(variant, f"[{HIDDEN}]", ""), f"[{WIDE_SPACES}]", " ")
    tidy = F.regexp_replace(js_trim(flat), r" {2,}", " ")
    rest = F.when(tidy == target, F.lit(None)).when(F.lower(tidy) == F.lower(target), "capital letters").when(
        F.lower(strip_accents(tidy)) == F.lower(strip_accents(target)), "accents"
    ).otherwise("spelling")
    kinds = F.array_compact(
        F.array(
            F.when(hidden, "hidden character"),
            F.when(wide, "non-breaking space"),
            F.when(flat != tidy, "spaces"),
            rest,
        )
    )
    return F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("spelling")))
