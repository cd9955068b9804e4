"""Scalar text functions as Column expressions (they stay inside the JVM)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One ``word_punct`` token; the same pattern holds in Java, RE2 and the ``regex`` module.
WORD_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\t\n\x0B\f\r\x85]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_count(c: Column | str) -> Column:
    """``word_punct`` tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(_col(c), F.lit(WORD_PUNCT)), F.lit(0))


def strip(c: Column | str) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.regexp_replace(_col(c), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


#: Unicode white space; the same class holds in Java and RE2.
SPACE = r"[\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85]"


def normalize_for_id(c: Column | str) -> Column:
    """Text as it enters an id: zero-width characters gone, white space (no-break space too) collapsed to single spaces."""
    plain = F.regexp_replace(_col(c), r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", "")
    return F.trim(F.regexp_replace(plain, SPACE + "+", " "))


# Lower-case letters of other alphabets in Latin spelling.
SPELLED = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "ı": "i",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o",
    "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}


def _ascii_table() -> tuple[str, str]:
    """Letters and signs that decompose canonically to one letter that is ASCII or spelled by one letter, and accents, by rule."""
    pairs = [(letter, latin) for letter, latin in SPELLED.items() if len(latin) == 1]
    for code in (*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x1E00, 0x1F00), 0x212A, 0x212B):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        base = SPELLED.get(base, base)
        if marks and len(base) == 1 and base.isascii() and base.isalpha() and all(unicodedata.combining(m) for m in marks) or code in (0x212A, 0x212B):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FOREIGN, _PLAIN = _ascii_table()


def ascii_fold(c: Column | str) -> Column:
    """Accented Latin letters, and lower-case Cyrillic and Greek ones, as ASCII; all other non-ASCII characters vanish."""
    text = _col(c)
    for letter, latin in SPELLED.items():
        if len(latin) > 1:
            text = F.replace(text, F.lit(letter), F.lit(latin))
    return F.regexp_replace(F.translate(text, _FOREIGN, _PLAIN), r"[^\x00-\x7F]", "")


def slug(c: Column | str) -> Column:
    """Lower-case ASCII words joined by hyphens; empty if there are none."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(F.lower(_col(c)))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def camel(c: Column | str) -> Column:
    """ASCII word runs, each capitalised, without a space; ``Untitled`` if there are none."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.initcap(w))
    joined = F.array_join(runs, "")
    return F.when(joined == "", F.lit("Untitled")).otherwise(joined)


def one_line(c: Column | str) -> Column:
    """Line ends to spaces, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "\n", " "))


def normalize_newlines(c: Column | str) -> Column:
    """CRLF and CR to LF."""
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def trim_blank_lines(c: Column | str) -> Column:
    """Drop blank lines at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"^([ \t]*\n)+", ""), r"(\n[ \t]*)+$", "")


def clean_subtitles(c: Column | str) -> Column:
    """Spoken text of an SRT or VTT file.

    In this order: byte-order mark, ``WEBVTT`` line, cue times, numbers alone
    on a line, runs of blank lines, outer white space.
    """
    t = F.regexp_replace(_col(c), r"\x{FEFF}", "")
    t = F.regexp_replace(t, r"^(?i:WEBVTT)[^\n]*\n+", "")
    time = r"([0-9]+:)?[0-9]{1,2}:[0-9]{2}([.,][0-9]+)?"
    t = F.regexp_replace(t, rf"(?md)^[ \t\r\x0B\f]*{time}[ \t\r]*-->[ \t\r]*{time}[ \t\r]*$", "")
    t = F.regexp_replace(t, r"(?md)^[0-9]+[ \t\r]*$", "")
    t = F.regexp_replace(t, r"\n[ \t\n\x0B\f\r]*\n", "\n")
    return strip(t)


def natural_key(c: Column | str) -> Column:
    """Sort key in which ``file2`` comes before ``file10``: digit runs by length and value, of any length, the rest in lower case."""
    parts = F.regexp_extract_all(F.lower(_col(c)), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("\x01"), F.lpad(F.length(F.regexp_replace(p, "^0+([0-9])", "$1")).cast("string"), 10, "0"), F.lit("."), F.regexp_replace(p, "^0+([0-9])", "$1"))).otherwise(p)), "")


def wikilinks(c: Column | str) -> Column:
    """Distinct targets of ``[[...]]`` outside code: left of the bar, last path segment, without ``.md``."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), "(?s)```.*?```", ""), "`[^`]*`", "")
    inner = F.regexp_extract_all(bare, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))

    def target(x: Column) -> Column:
        left = F.trim(F.element_at(F.split(x, r"\|"), 1))
        return F.regexp_replace(F.element_at(F.split(left, "/"), -1), r"\.md$", "")

    return F.array_distinct(F.filter(F.transform(inner, target), lambda x: x != ""))


def strip_section(c: Column | str, heading: str) -> Column:
    """Remove an H2 section up to the next H2."""
    return F.regexp_replace(_col(c), rf"(?ms)^## {heading}[ \t]*\n.*?(?=^## |\z)", "")


def section(c: Column | str, heading: str, longest: int = 480) -> Column:
    """Text of an H2 section on one line, at most ``longest`` characters; empty if there is none."""
    body = F.regexp_extract(_col(c), rf"(?msi)^## {heading}[ \t]*\n(.*?)(?=^## |\z)", 1)
    return F.substring(F.trim(F.regexp_replace(body, r"[ \t\n\x0B\f\r]+", " ")), 1, longest)


def sanitize_markdown(c: Column | str) -> Column:
    """LF line ends, no byte-order mark, a leading fence on a line of its own."""
    t = F.regexp_replace(normalize_newlines(c), r"^\x{FEFF}", "")
    return F.when(t.startswith("```"), F.concat(F.lit("\n"), t)).otherwise(t)


def first_filled(*columns: Column | str) -> Column:
    """The first text that is not blank; null if all are."""
    return F.coalesce(*[F.when(strip(c) != "", _col(c)) for c in columns])


# What stands before the root of an HTML page: marks, blanks, declarations, comments.
_PAGE = r"(?is)\A[\s\x{FEFF}\x{A0}]*(?>(?><\?xml[^>]*>|<!--.*?-->)\s*)*+<(?:!doctype\s+html|html|head|body)(?=[\s/>])"
_FENCED = r"(?ms)^ {0,3}```.*?^ {0,3}```[ \t\r]*$"
_CUE = r"(?m)^[ \t\x{FEFF}]*(?:\d+:)?\d{1,2}:\d{2}(?:[.,]\d+)?[ \t]*-->[ \t]*(?:\d+:)?\d{1,2}:\d{2}"


def is_html_page(text: Column) -> Column:
    """A page that begins with a doctype or an HTML root, in any case, after a byte-order mark, blanks and comments."""
    return text.rlike(_PAGE)


def is_subtitles(text: Column) -> Column:
    """A text with the times of a cue on a line of their own, outside fenced code."""
    return F.regexp_replace(text, _FENCED, "").rlike(_CUE)
