"""String functions of the rule engine, as Column expressions, with the SQL text of each beside it.

The white-space and dash classes are written out, since what ``\\s`` covers differs between engines.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, as dashes and as separators.
_SPACES = "\\t-\\r {a0}{1680}{2000}-{200a}{2028}{2029}{202f}{205f}{3000}{feff}"
_DASHES = "{2010}-{2014}{2212}"


def _java(text: str) -> str:
    import re

    return re.sub(r"\{([0-9a-f]+)\}", lambda m: "\\u" + m[1].rjust(4, "0"), text)


def _re2(text: str) -> str:
    import re

    return re.sub(r"\{([0-9a-f]+)\}", lambda m: "\\x{" + m[1] + "}", text)


WS, WS_SQL = (f"[{f(_SPACES)}]" for f in (_java, _re2))
#: Runs of white space that are not a single space already.
_RUNS = f" {WS}+|[{_java(_SPACES.replace(' ', ''))}]{WS}*"
DASH, DASH_SQL = (f"[{f(_DASHES)}]" for f in (_java, _re2))
FLEX, FLEX_SQL = (f"[{f(_SPACES)}{f('{200b}')}{f(_DASHES)}-]" for f in (_java, _re2))


def norm(s: Column) -> Column:
    """White space collapsed to single spaces and trimmed; case and dashes kept; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), _RUNS, " "))


def norm_sql(s: str) -> str:
    return f"trim(regexp_replace(coalesce({s}, ''), '{WS_SQL}+', ' ', 'g'))"


def composed(s: Column) -> Column:
    """Canonical composition (NFC). Only texts that hold a combining mark leave the JVM, the others pass as nulls."""
    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))

    return F.coalesce(compose(F.when(s.rlike(r"[\p{M}\u1100-\u11ff\u212a\u212b\u2126]"), s)), s)


def composed_sql(s: str) -> str:
    return f"nfc_normalize({s})"


def dashes_tight(s: Column) -> Column:
    """Dashes folded to '-' without spaces around them, white space collapsed; case kept."""
    dashed = F.regexp_replace(norm(s), DASH, "-")
    return F.trim(F.regexp_replace(dashed, f"{WS}*-{WS}*", "-"))


def dashes_tight_sql(s: str) -> str:
    return f"trim(regexp_replace(regexp_replace({norm_sql(s)}, '{DASH_SQL}', '-', 'g'), '{WS_SQL}*-{WS_SQL}*', '-', 'g'))"


def variant_key(s: Column) -> Column:
    """``dashes_tight`` of the composed text: two spellings of one character are one."""
    return dashes_tight(composed(s))


def variant_key_sql(s: str) -> str:
    return dashes_tight_sql(composed_sql(s))


def rule_key(s: Column) -> Column:
    """``dashes_tight`` in lower case: two rules with one key are one rule."""
    return F.lower(dashes_tight(s))


def rule_key_sql(s: str) -> str:
    return f"lower({dashes_tight_sql(s)})"


def flexible_key(s: Column, compose: bool = False) -> Column:
    """All separators and dashes removed, of the text as it is or of the composed text."""
    return F.regexp_replace(F.coalesce(composed(s) if compose else s, F.lit("")), FLEX, "")


def flexible_key_sql(s: str, compose: bool = False) -> str:
    return f"regexp_replace(coalesce({composed_sql(s) if compose else s}, ''), '{FLEX_SQL}', '', 'g')"


def count_of(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal; 0 for an empty one."""
    return F.when(F.length(needle) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.greatest(F.length(needle), F.lit(1))).cast("long"))


def count_of_sql(text: str, needle: str) -> str:
    return f"CASE WHEN length({needle}) = 0 THEN 0 ELSE (length({text}) - length(replace({text}, {needle}, ''))) // greatest(length({needle}), 1) END"


def folded(s: Column) -> Column:
    """Accents stripped, dashes folded, collapsed, lower case."""
    return F.lower(norm(F.regexp_replace(strip_accents(s), DASH, "-")))


def folded_sql(s: str) -> str:
    return f"lower({norm_sql(f'regexp_replace(strip_accents(coalesce({s}, chr(32))), {chr(39)}{DASH_SQL}{chr(39)}, {chr(39)}-{chr(39)}, {chr(39)}g{chr(39)})')})"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Characters that decompose to one character and combining marks, with that character; then the marks, which go."""
    import unicodedata

    plain = {}
    for c in map(chr, range(0x80, 0x10000)):
        if not "\ud800" <= c <= "\udfff" and not unicodedata.combining(c):
            left = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if left != c and len(left) == 1:
                plain[c] = left
    marks = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(c))
    return "".join(plain) + marks, "".join(plain.values())


def strip_accents(s: Column) -> Column:
    """Canonical decomposition without combining marks, by one translation table; null as empty."""
    old, new = _accents()
    return F.translate(F.coalesce(s, F.lit("")), old, new)


def tightened(s: Column) -> Column:
    """``folded`` without spaces around - : / _ and the full stop."""
    return F.regexp_replace(folded(s), " *([-:/_.]) *", "$1")


def tightened_sql(s: str) -> str:
    return f"regexp_replace({folded_sql(s)}, ' *([-:/_.]) *', '\\1', 'g')"


#: Confusable folds: what each mode maps after lower-casing and dropping all but letters and digits.
CONFUSABLE = {"o": ("o", "0"), "oi": ("oi", "01"), "oil": ("oil", "011"), "bar": ("oil", "011")}


def confusable_key(s: Column, mode: str = "o") -> Column:
    """A key in which look-alikes are one: letters and digits without accents, with o as 0 and, by mode, i and l as 1.

    Mode ``bar`` also takes an upright bar as 1. Spaces and dashes go, so the key of several words is that of
    each, one after the other.
    """
    old, new = CONFUSABLE[mode]
    plain = F.lower(strip_accents(s))
    plain = F.translate(plain, "|", "1") if mode == "bar" else plain
    return F.translate(F.regexp_replace(plain, r"[^a-z0-9]", ""), old, new)


def confusable_keys(words: Column, mode: str = "o") -> Column:
    """``confusable_key`` of each word of an array of words without spaces, by one pass over all of them."""
    old, new = CONFUSABLE[mode]
    plain = F.lower(strip_accents(F.array_join(words, " ", "")))
    plain = F.translate(plain, "|", "1") if mode == "bar" else plain
    return F.split(F.translate(F.regexp_replace(plain, r"[^a-z0-9 ]", ""), old, new), " ")


def confusable_key_sql(s: str, mode: str = "o") -> str:
    old, new = CONFUSABLE[mode]
    plain = f"lower(strip_accents(coalesce({s}, '')))"
    plain = f"translate({plain}, '|', '1')" if mode == "bar" else plain
    return f"translate(regexp_replace({plain}, '[^a-z0-9]', '', 'g'), '{old}', '{new}')"


_LOW, _HIGH = "abcdefghijklmnopqrstuvwxyzO", "ABCDEFGHIJKLMN0PQRSTUVWXYZ0"


def code_key(s: Column) -> Column:
    """ASCII letters in upper case, with O as 0."""
    return F.translate(F.coalesce(s, F.lit("")), _LOW, _HIGH)


def code_key_sql(s: str) -> str:
    return f"translate(coalesce({s}, ''), '{_LOW}', '{_HIGH}')"


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """1 - edit distance / longer length; 0 if either is empty, or if it is below ``least``, beyond which the distance is not worked out."""
    longer = F.greatest(F.length(a), F.length(b))
    distance = F.levenshtein(a, b) if least <= 0 else F.call_function("levenshtein", a, b, F.floor(longer * (1 - least) + 1e-9).cast("int"))
    return F.when((F.length(a) == 0) | (F.length(b) == 0) | (distance < 0), 0.0).otherwise(1.0 - distance / longer)


def similarity_sql(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter length over longer; 0 if both are empty. A cheap bound on ``similarity``."""
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def length_ratio_sql(a: str, b: str) -> str:
    return f"least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b}), 1)"


def abbreviation_kept(target: Column, candidate_key: Column) -> Column:
    """A target that begins with one letter and a full stop needs a candidate whose key begins with that letter."""
    return ~target.rlike(r"^[A-Za-z]\.") | F.startswith(candidate_key, F.lower(F.substring(target, 1, 1)))


def rounded_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def duration(ms: Column) -> Column:
    """Milliseconds for people: whole ones below a second, two decimals of seconds below ten, one from there on."""
    tenths, hundredths = rounded_half_up(ms / 100.0).cast("long"), rounded_half_up(ms / 10.0).cast("long")
    long = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), tenths % 10, F.lit(" s"))
    short = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(" s"))
    return F.when(ms >= 10_000, long).when(ms >= 1_000, short).otherwise(F.concat(rounded_half_up(ms).cast("long"), F.lit(" ms")))


def quoted(text: str) -> str:
    """A literal as a regular expression, for Java and RE2 alike."""
    return "".join("\\" + c if c in "\\.^$|?*+()[]{}-" else c for c in text)


def flexible_pattern(find: str, separators: str = FLEX) -> str:
    """A pattern for all spellings of a text: its characters other than separators, with any separators between."""
    import re

    letters = re.sub(FLEX, "", find)
    return (separators + "*").join(map(quoted, letters))


def literal(text: str) -> str:
    """A replacement that is taken literally."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def literal_sql(text: str) -> str:
    """The same for RE2, as the inside of an SQL string."""
    return text.replace("\\", "\\\\").replace("'", "''")


#: What the CP1252 code page can hold beyond Latin-1, as a character class.
ENCODABLE = r"^[\u0000-\u007f -ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]*$"
