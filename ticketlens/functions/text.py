"""Scalar text functions (H1-H9, H12-H14, H16) as JVM-side Column expressions.

Nothing here runs Python per row: every function returns a
``pyspark.sql.Column`` built from built-ins, so it stays inside
whole-stage codegen.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.constants import PREVIEW_CHARS

# Python's ``str.split()`` / ``str.strip()`` whitespace set, written with
# ``\x{..}`` escapes understood by both Java regex and RE2.
WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Word characters as in a unicode ``\w`` (letters, numbers, underscore).
WORD_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower(c) -> Column:
    """H1."""
    return F.lower(_col(c))


def strip(c) -> Column:
    """H4: remove leading/trailing whitespace (unicode set, unlike ``trim``)."""
    ws = WHITESPACE_CLASS
    return F.regexp_replace(_col(c), f"^{ws}+|{ws}+$", "")


def words(c) -> Column:
    """Whitespace-separated words, empty strings removed; null stays null."""
    parts = F.split(_col(c), WHITESPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != F.lit(""))


def word_count(c) -> Column:
    """H2: number of whitespace-separated words; blank text gives 0."""
    c = _col(c)
    return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(F.size(words(c)))


def char_length(c) -> Column:
    """H3."""
    return F.length(_col(c))


def contains_any(c, keywords) -> Column:
    """Case-insensitive substring test against any keyword.

    One ``rlike`` over literal-quoted alternatives, one scan of the text.
    Null text gives null (callers treat it as "no match").
    """
    low = F.lower(_col(c))
    kws = [kw.lower() for kw in keywords]
    if not kws:
        return F.lit(False)
    quoted = [r"\Q" + k.replace(r"\E", r"\E\\E\Q") + r"\E" for k in kws]
    return low.rlike("|".join(quoted))


def replace_chain(c, pairs, suffix: str = "", lowercase: bool = True) -> Column:
    """H6: ordered find/replace chain (each pair sees the previous output)."""
    out = _col(c)
    if lowercase:
        out = F.lower(out)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    if suffix:
        out = F.concat(out, F.lit(suffix))
    return out


def preview(c, n: int = PREVIEW_CHARS) -> Column:
    """H7: first ``n`` characters, plus "..." when the text is longer."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def low_confidence_reason(conf, threshold) -> Column:
    """H9: ``Low confidence (45.1% < 85% threshold)``."""
    return F.concat(F.lit("Low confidence ("), percent_1(conf),
                    F.lit(f"% < {float(threshold) * 100.0:.0f}% threshold)"))


def percent_1(share) -> Column:
    """A share as percent with one digit, as C's ``%.1f`` prints ``share * 100``:
    rounded by the double's exact binary value (30.45 is below the middle),
    ties to even.  Java's formatter rounds the shortest decimal instead.

    x is split exactly into hi + lo, so that hi * 10 and lo * 10 are exact too;
    a sum of two doubles always has its true sign, which decides the digit.
    """
    x = _col(share).cast("double") * F.lit(100.0)
    # exact: |x| below 2^20 keeps 32 high bits; both products fit a double
    hi = F.floor(x * F.lit(1024.0)).cast("double") / F.lit(1024.0)
    lo = x - hi
    whole = F.floor(hi * 10.0).cast("double")
    part, more = hi * 10.0 - whole, lo * 10.0  # both exact; only signs of sums are used below
    up = (part - 1.0) + more >= 0.0
    k = whole + F.when(up, 1.0).otherwise(0.0)
    over = F.when(up, (part - 1.5) + more).otherwise((part - 0.5) + more)
    half = (over > 0.0) | ((over == 0.0) & (F.pmod(k, F.lit(2.0)) == 1.0))
    tenths = (k + F.when(half, 1.0).otherwise(0.0)).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


#: Syllables that split into letters by a rule.
_HANGUL = range(0xAC00, 0xD7A4)


@lru_cache(maxsize=1)
def accent_translation() -> tuple[str, str, str, list[tuple[str, str]]]:
    """H12 rule over all code points: NFKD, then combining marks removed.

    ``(src, dst, deleted, longer)``: characters that become one other
    character, characters that vanish, and those that become several.
    """
    src, dst, deleted, longer = [], [], [], []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF or cp in _HANGUL:
            continue
        ch = chr(cp)
        full = unicodedata.normalize("NFKD", ch)
        base = "".join(x for x in full if not unicodedata.combining(x))
        if base == ch:
            continue
        if not base:
            deleted.append(ch)
        elif len(base) == 1:
            src.append(ch)
            dst.append(base)
        else:
            longer.append((ch, base))
    return "".join(src), "".join(dst), "".join(deleted), longer


def strip_accents(c) -> Column:
    """NFKD without combining marks, for every code point.

    Texts in Latin letters need only ``translate``, which replaces single
    characters and deletes marks.  Characters with longer forms (ligatures,
    Hangul, fractions) are looked up one by one, and only in texts that hold one.
    """
    src, dst, deleted, longer = accent_translation()
    c = _col(c)
    one = F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, src + deleted, dst)).otherwise(c)
    table = F.from_json(F.lit(json.dumps(dict(longer), ensure_ascii=False)), "map<string,string>")
    each = F.transform(F.regexp_extract_all(one, F.lit("(?s)."), 0),
                       lambda x: F.when(F.ascii(x).between(_HANGUL[0], _HANGUL[-1]), _jamo(F.ascii(x) - _HANGUL[0]))
                       .otherwise(F.coalesce(F.try_element_at(table, x), x)))
    holds = F.length(F.translate(one, "".join(ch for ch, _ in longer), "")) < F.length(one)
    holds |= one.rlike(f"[\\x{{{_HANGUL[0]:X}}}-\\x{{{_HANGUL[-1]:X}}}]")
    # no longer form is ASCII or a letter of Latin-1: most texts need no look at each character
    return F.when(c.rlike(r"[^\x00-\x7F\xC0-\xFF]") & holds, F.array_join(each, "")).otherwise(one)


def _jamo(s: Column) -> Column:
    """Syllable number -> its two or three letters (the rule of the standard)."""
    def letters(start: int, n: int) -> Column:
        return F.array(*[F.lit(chr(start + i)) for i in range(n)])
    tail = F.array(F.lit(""), *[F.lit(chr(0x11A8 + i)) for i in range(27)])
    return F.concat(F.element_at(letters(0x1100, 19), F.floor(s / 588).cast("int") + 1),
                    F.element_at(letters(0x1161, 21), F.floor(s % 588 / 28).cast("int") + 1),
                    F.element_at(tail, (s % 28).cast("int") + 1))


def tokens(c) -> Column:
    """Lowered, accent-stripped word tokens of two or more characters."""
    return F.regexp_extract_all(strip_accents(F.lower(_col(c))), F.lit(WORD_TOKEN_PATTERN), 0)


def bigrams(tok) -> Column:
    """Adjacent pairs of an array of tokens, joined by one space."""
    tok = _col(tok)
    n = F.greatest(F.size(tok) - 1, F.lit(0))
    return F.zip_with(F.slice(tok, 1, n), F.slice(tok, 2, n),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def ngrams_1_2(tok) -> Column:
    """Unigrams followed by bigrams."""
    tok = _col(tok)
    return F.concat(tok, bigrams(tok))


def as_string(c) -> Column:
    """H16."""
    return _col(c).cast("string")
