"""The text normalizer: an ordered chain of native expressions.

Removal deletes the match and leaves nothing in its place. White space, digits and word
characters are Unicode's; word boundaries around hashes, versions and numbers are ASCII's.
Lengths are bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

#: Name, pattern, replacement, in the order in which they apply. Loops that can't help by
#: giving back are possessive, as Java's regular expressions keep a stack frame for a group that may.
#: Brackets that are no link are matched, too, and put back, so that none is searched for twice.
PATTERNS = (
    ("strip_markdown", r"\[([^\]]*+)\]\([^)]*+\)|(\[[^\]]*+(?:\](?:\([^)]*+\z)?+|\z))", "$1$2"),
    ("strip_urls", r"(?iU)\[?https?://\S+\]?", ""),
    ("strip_emails", r"(?U)(?<!\S)\S[^\s@]*+@\S+\.\S+", ""),  # from a run's start to its first @: later ones match no more
    ("strip_hashes", rf"{_EDGE}[0-9a-fA-F]{{32,}}{_EDGE}", ""),
    ("strip_hex", r"0x[0-9a-fA-F]+", ""),
    ("strip_paths", r"(?U)(?:/[\w.\-]++){2,}+", ""),
    ("strip_versions", rf"(?U){_EDGE}v?\d+\.\d+(?:(?:\.\d++(?!{_EDGE}))*+\.\d+{_EDGE})++", ""),  # parts up to the last that ends at an edge
    ("strip_issues", r"(?U)#\d+", ""),
    ("strip_users", r"(?U)/?u/\S+", ""),
    ("strip_boards", r"(?U)/?r/\S+", ""),
    ("strip_numbers", rf"(?U){_EDGE}\d{{6,}}{_EDGE}", ""),
    ("collapse_punct", r"([!?.,:;])\1{2,}", "$1$1"),
    ("collapse_ws", r"(?U) \s+|[^\S ]\s*", " "),  # single spaces are left as they are
)


#: What a text must hold for a rule to match at all, cheaper to look for than the rule's pattern:
#: a literal, or a pattern after ``~``.
_SIGNS = {
    "strip_markdown": "](",
    "strip_urls": "://",
    "strip_emails": "@",
    "strip_hashes": "~[0-9a-fA-F]{32}",
    "strip_hex": "0x",
    "strip_paths": "/",
    "strip_versions": r"~\p{Nd}\.\p{Nd}+\.\p{Nd}",
    "strip_issues": "#",
    "strip_users": "u/",
    "strip_boards": "r/",
    "strip_numbers": r"~\p{Nd}{6}",
    "collapse_punct": "~[!?.,:;]{3}",
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pattern_step(name: str) -> Callable[[Column], Column]:
    pattern, to = next((p, t) for n, p, t in PATTERNS if n == name)
    sign = _SIGNS.get(name)
    if sign is None:
        return lambda text: F.regexp_replace(text, pattern, to)
    holds = (lambda x: F.rlike(x, F.lit(sign[1:]))) if sign[0] == "~" else (lambda x: F.contains(x, F.lit(sign)))
    return lambda text: once(text, lambda x: F.when(holds(x), F.regexp_replace(x, pattern, to)).otherwise(x))


def trim_lower(text: Column, lowercase: bool = True) -> Column:
    """``text``, white space already single spaces, without those at its ends, in lower case."""
    return F.lower(F.trim(text)) if lowercase else F.trim(text)


def alpha_words(text: Column) -> Column:
    """Words with an alphabetic character, one space between."""
    return F.rtrim(F.regexp_replace(text, r"(?<=^| )[^\p{IsAlphabetic} ]*(?: |\z)", ""))


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest start of ``text`` of whole characters within ``most`` bytes; 0 leaves it whole."""
    if most <= 0:
        return text

    def cut(x: Column) -> Column:
        raw = F.encode(x, "UTF-8")
        # A character has at most four bytes: one of these four cuts is at a character's edge.
        tries = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most))]
        return F.when(F.octet_length(x) <= most, x).otherwise(F.coalesce(*tries, F.lit("")))

    return once(text, cut)


def reject_short(text: Column, min_bytes: int) -> Column:
    return once(text, lambda x: F.when(F.octet_length(x) >= min_bytes, x))


def normalize(text: Column, *, lowercase: bool = True, max_bytes: int = 256, min_bytes: int = 10, prefix: str = "passage: ") -> Column:
    """The whole chain; null where nothing long enough is left. The prefix counts in no limit."""
    for name, _, _ in PATTERNS:
        text = pattern_step(name)(text)
    text = truncate_bytes(alpha_words(trim_lower(text, lowercase)), max_bytes)
    text = reject_short(text, min_bytes)
    return F.concat(F.lit(prefix), text) if prefix else text


def surviving(df: DataFrame, text: Column, *keep: str, name: str = "norm_text", **options) -> DataFrame:
    """``keep`` columns and the normalized text of rows that something is left of.

    The text is exploded from an array of one or none, so that the chain is evaluated once and
    not again in a filter that is pushed below it.
    """
    left = F.filter(F.array(normalize(text, **options)), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(left).alias(name))
