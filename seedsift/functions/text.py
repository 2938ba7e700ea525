"""String building blocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CYRILLIC = "а-яёіїєґА-ЯЁІЇЄҐ"
LATIN = "a-zA-Z"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def settled(c: Column) -> Column:
    """The same value, computed where it stands: the optimizer pushes later filters below a column by copying its
    expression into them, which repeats long ones for every element of an array; it leaves this one alone."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def norm(c) -> Column:
    """Lower case, without white space at the ends: the key of most dedupes."""
    return F.regexp_replace(F.lower(col(c)), r"(?U)^\s+|\s+$", "")


def squeeze(c) -> Column:
    """norm() with inner white space collapsed to one blank."""
    return F.regexp_replace(norm(c), r"(?U)\s+", " ")


def words(c) -> Column:
    """The words of a squeezed text; an empty text has none."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def count_of(c, chars: str) -> Column:
    """How many characters of a regular expression's class stand in a text."""
    return F.length(F.regexp_replace(col(c), f"[^{chars}]", ""))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def latin_share(c) -> Column:
    lat, cyr = count_of(c, LATIN), count_of(c, CYRILLIC)
    return share(lat, lat + cyr)


def cyrillic_share(c) -> Column:
    lat, cyr = count_of(c, LATIN), count_of(c, CYRILLIC)
    return share(cyr, lat + cyr)


def occurrences(c, needle) -> Column:
    """Occurrences that do not overlap; of the empty string, one more than there are characters."""
    c, needle = col(c), col(needle)
    n = (F.length(c) - F.length(F.replace(c, needle, F.lit("")))) / F.length(needle)
    return F.when(F.length(needle) == 0, F.length(c) + 1).otherwise(n).cast("int")


def is_digits(c) -> Column:
    return col(c).rlike(r"^\p{Nd}+$")


def strip_tags(c) -> Column:
    """A suggestion without markup."""
    return F.regexp_replace(F.regexp_replace(col(c), "<[^>]+>", ""), r"(?U)^\s+|\s+$", "")


def _bare_words(c) -> Column:
    bare = F.regexp_replace(F.lower(col(c)), r"[^а-яёa-z0-9\s]", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def fingerprint(c) -> Column:
    """Distinct bare words, sorted: the same for any order of the words."""
    return F.array_join(F.array_sort(F.array_distinct(_bare_words(c))), "|")


#: Short words that count in a stem fingerprint.
KEPT_SHORT = ("до", "из")


def stem_fingerprint(c) -> Column:
    """Distinct crude stems, sorted; words of one or two letters are left out."""
    long = F.filter(_bare_words(c), lambda w: (F.length(w) > 2) | w.isin(*KEPT_SHORT))
    stem = F.transform(
        long,
        lambda w: F.when(F.length(w) > 6, F.substring(w, F.lit(1), F.length(w) - 3))
        .when(F.length(w) > 4, F.substring(w, F.lit(1), F.length(w) - 2))
        .otherwise(w),
    )
    return F.array_join(F.array_sort(F.array_distinct(stem)), "|")


def estimate_tokens(c) -> Column:
    """A rough number of model tokens: 0.55 for a Cyrillic letter, 0.27 for any other character, and one."""
    cyr = count_of(c, "а-яёА-ЯЁ")
    return (0.55 * cyr + 0.27 * (F.length(col(c)) - cyr)).cast("int") + 1


def detect_language(c) -> Column:
    cyr = col(c).rlike("[\u0400-\u04ff]")
    return F.when(cyr & F.lower(col(c)).rlike("[іїєґ]"), F.lit("uk")).when(cyr, F.lit("ru")).otherwise(F.lit("en"))


#: The 64 length characters of a targeting code, in order.
UULE_KEYS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def uule(name) -> Column:
    """The targeting code of a canonical place name: prefix, a character for its length, base64 of the name."""
    c = col(name)
    at = F.least(F.length(c), F.lit(63)) + 1
    key = F.substring(F.lit(UULE_KEYS), at, F.lit(1))
    return F.concat(F.lit("w+"), key, F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", ""))
