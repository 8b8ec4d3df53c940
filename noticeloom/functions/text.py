"""Text functions on columns. Every normaliser keeps its own rules; they are not interchangeable.

No match is null, never an empty string. All functions pass nulls through unless they say otherwise.
"""

from __future__ import annotations

import functools
import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@functools.cache
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case texts of which every match of a pattern holds one; none if that cannot be told.

    Of a sequence the longest plain run counts, or what all branches of an alternation need; what may be left out does not count.
    """
    from re import _parser as parser

    def of(items) -> tuple[str, ...]:
        best, run = (), ""

        def better(found: tuple[str, ...]) -> None:
            nonlocal best
            if found and min(map(len, found)) > (min(map(len, best)) if best else 1):
                best = found

        for kind, what in items:
            name = str(kind)
            if name == "LITERAL" and what < 128:
                run += chr(what).lower()
                continue
            better((run,))
            run = ""
            if name == "SUBPATTERN":
                better(of(what[3]))
            elif name == "ATOMIC_GROUP":
                better(of(what))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and what[0] > 0:
                better(of(what[2]))
            elif name == "BRANCH":
                branches = [of(b) for b in what[1]]
                if all(branches):
                    better(tuple(dict.fromkeys(x for b in branches for x in b)))
        better((run,))
        return best

    try:
        return of(parser.parse(pattern.replace(r"\z", r"\Z")))
    except Exception:  # a pattern that only the other dialect knows
        return ()


def may_match(lower: Column, *patterns: str) -> Column:
    """Whether any of the patterns could match, by the texts that they need; `lower` is the text in lower case."""
    out = F.lit(False)
    for pattern in patterns:
        texts = needed(pattern)
        if not texts:
            return F.lit(True)
        for t in texts:
            out = out | F.contains(lower, F.lit(t))
    return out


@functools.cache
def begins(pattern: str) -> tuple[str, ...]:
    """Lower-case texts with one of which every match of a pattern begins; none if that cannot be told."""
    from re import _parser as parser

    def of(items) -> tuple[str, ...]:
        run = ""
        for kind, what in items:
            name = str(kind)
            if name == "LITERAL" and what < 128:
                run += chr(what).lower()
            elif run or name not in ("AT", "SUBPATTERN", "BRANCH"):
                break
            elif name == "SUBPATTERN":
                return of(what[3])
            elif name == "BRANCH":
                branches = [of(b) for b in what[1]]
                return tuple(dict.fromkeys(x for b in branches for x in b)) if all(branches) else ()
        return (run,) if len(run) > 2 else ()

    try:
        return of(parser.parse(pattern.replace(r"\z", r"\Z")))
    except Exception:  # a pattern that only the other dialect knows
        return ()


def lowered(text) -> Column:
    """Lower case, every character in its place: where a letter becomes two, only A-Z change."""
    t = _col(text)
    return once(F.lower(t), lambda low: F.when(F.length(low) == F.length(t), low).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase)))


def from_begin(text, lower: Column, pattern: str) -> Column:
    """The text from a character before the first place where a match could begin, null without one; the text if that cannot be told.

    `lower` is the text as `lowered` has it. A pattern's first match is the same in both.
    """
    starts = [(F.contains(lower, F.lit(t)), F.instr(lower, F.lit(t))) for t in begins(pattern)]
    if not starts:
        return F.when(may_match(lower, pattern), _col(text))
    first = starts[0][1] if len(starts) == 1 else F.least(*(F.when(held, at) for held, at in starts))
    # Most patterns are in few texts: `contains` is the quick way to tell.
    return F.when(functools.reduce(Column.__or__, (held for held, _ in starts)) & may_match(lower, pattern), F.substring(_col(text), F.greatest(first - 1, F.lit(1)), F.lit(1 << 30)))


def once(value: Column, use) -> Column:
    """`use(value)`, where the value is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apart(value: Column) -> Column:
    """`value`, and the step that has it stands outside of the code that Spark generates for a whole stage: methods too long for the JVM's compiler are interpreted."""
    return once(value, lambda v: v)


def grab(text, pattern: str, group: int = 1) -> Column:
    """First match's group, or null. A plain `nullif` would match twice."""
    return once(F.regexp_extract(_col(text), pattern, group), lambda found: F.when(found != "", found))


def first_of(text, patterns: list[str], group: int = 1) -> Column:
    """First pattern, in order, that matches."""
    return F.coalesce(*(grab(text, p, group) for p in patterns))


#: Runs of white space that are not one space already.
SPACES = r"\s{2,}|[\t\n\x0B\f\r]"


def replace(text, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(_col(text), pattern, by)


def squeeze(text) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(replace(text, SPACES, " "))


def blank_to_null(text) -> Column:
    return once(F.trim(_col(text)), lambda t: F.when(t != "", t))


def reuse_key(address) -> Column:
    """Address key for reuse across cases: upper case without . , #."""
    return squeeze(replace(F.upper(_col(address)), r"[.,#]"))


def comparison_key(text) -> Column:
    """Upper-case letters and digits; anything else is one space."""
    return F.trim(replace(F.upper(_col(text)), r"[^A-Z0-9]+", " "))


def legal_token(text) -> Column:
    """Upper case without . , ' and double quotes; null is empty."""
    return squeeze(replace(F.upper(F.coalesce(_col(text), F.lit(""))), r"[.,'\"]"))


def plain_token(text) -> Column:
    return F.lower(F.trim(_col(text)))


def filing_number(text) -> Column:
    """Filing number without white space, dots, hyphens and underscores; leading zeros stay."""
    return F.nullif(replace(F.upper(F.trim(_col(text))), r"[\s.\-_]"), F.lit(""))


def _unaccented() -> tuple[str, str]:
    """Latin letters that decompose into one ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text) -> Column:
    """Latin letters without their marks, and no combining marks. Stays in the JVM."""
    return replace(F.translate(_col(text), *_unaccented()), "[̀-ͯ]")


def name_variant(text) -> Column:
    return squeeze(replace(F.upper(strip_accents(text)), r"[.,]"))


def address_key(text) -> Column:
    return squeeze(replace(F.lower(_col(text)), r"[.,]"))


def city_key(text) -> Column:
    return F.upper(F.trim(_col(text)))


def notice_text(text) -> Column:
    """Unix line ends; runs of blanks and tabs, and Unicode spaces, as one space; lines stay."""
    unix = F.replace(_col(text), F.lit("\r\n"), F.lit("\n"))
    plain = once(unix, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(replace(t, "[  -   　]", " ")))
    return once(plain, lambda t: F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), replace(t, r"[ \t]{2,}|\t", " ")).otherwise(t))


def clean_address(text) -> Column:
    """Squeezed, without trailing . , ; and with a space in a house number like 508E."""
    return F.regexp_replace(F.trim(replace(replace(text, SPACES, " "), r"[.,;]+\z")), fixed.GLUED_DIRECTION, "$1 $2$3")


def clean_name(text) -> Column:
    return F.trim(replace(replace(replace(text, r"[:;]+", " "), r"\s+", " "), r"[.,;]+\z"))


def clean_party(text) -> Column:
    return F.trim(replace(replace(text, SPACES, " "), r"[.,;]+\z"))


def overlap(a, b, key=legal_token) -> Column:
    """Both present and equal, or one holds the other, after `key`. False when either is missing."""
    x, y = key(a), key(b)
    full = (F.coalesce(F.length(x), F.lit(0)) > 0) & (F.coalesce(F.length(y), F.lit(0)) > 0)
    return F.coalesce(full & ((x == y) | F.contains(x, y) | F.contains(y, x)), F.lit(False))


def search_text(text) -> Column:
    """Legal text for a search: comments on legibility, brackets, slashes and quotes out; short texts null."""
    plain = replace(replace(replace(text, fixed.META_COMMENT, " "), r"[()/]", " "), r"[\"'#;]", " ")
    found = squeeze(plain)
    return F.when(F.length(found) >= 3, found)


def legal_cache_key(subdivision, lot, block, raw) -> Column:
    """Key of a resolved legal description; null when there is nothing to key by."""
    place, text = legal_token(subdivision), legal_token(raw)
    return F.when(place != "", F.concat(F.lit("SUBDIVISION:"), place, F.lit("|LOT:"), legal_token(lot), F.lit("|BLOCK:"), legal_token(block))).when(
        text != "", F.concat(F.lit("RAWTEXT:"), text)
    )


def street_term(address) -> Column:
    """An address up to its last street word, else without city, state and zip; no direction after the number."""
    through = grab(address, rf"(?is)^(.*\b(?:{fixed.STREET_SUFFIXES})\b\.?)")
    street = F.coalesce(F.trim(through), replace(F.trim(replace(address, fixed.CITY_STATE_ZIP)), r",\z"))
    return F.regexp_replace(street, fixed.HOUSE_DIRECTION, "$1 $2")


def subdivision_term(subdivision) -> Column:
    return F.coalesce(blank_to_null(replace(subdivision, fixed.SUBDIVISION_SUFFIX)), _col(subdivision))


def surname(name) -> Column:
    """Last word of a name, upper case."""
    return F.upper(F.element_at(F.split(F.trim(_col(name)), r"\s+"), -1))


def is_prefix_truncation(old, new) -> Column:
    a, b = F.upper(F.trim(_col(old))), F.upper(F.trim(_col(new)))
    return F.coalesce((F.length(a) > 0) & (F.length(a) < F.length(b)) & F.startswith(b, a), F.lit(False))


def redact(text) -> Column:
    """Connection strings and keys masked."""
    return replace(replace(text, r"(?i)\b(postgres(?:ql)?|mysql)://[^\s'\"]+", "$1://***"), r"(?i)\b((?:api[_-]?key|token|secret)\s*[=:]\s*)\S+", "$1***")


def barcode_number(text) -> Column:
    """Document number of a decoded cover barcode."""
    return grab(F.trim(_col(text)), fixed.BARCODE)


def tracking_number(text) -> Column:
    return grab(F.substring(_col(text), 1, 300), fixed.TRACKING_NUMBER)


def outside_county(address) -> Column:
    """Names a city elsewhere and has no zip of the county."""
    zip_code = grab(address, r"\b(\d{5})\b")
    return F.coalesce(_col(address).rlike(fixed.OTHER_COUNTY_CITIES) & ~F.coalesce(F.startswith(zip_code, F.lit(fixed.COUNTY_ZIP_PREFIX)), F.lit(False)), F.lit(False))


def known_elsewhere(address) -> Column:
    found = F.lit(False)
    for p in fixed.COURTHOUSE_ADDRESSES:
        found = found | F.coalesce(_col(address).rlike(p), F.lit(False))
    return found


def word_bigrams(text) -> Column:
    """Distinct neighbouring words of a notice without its document header."""
    words = F.filter(F.split(comparison_key(replace(text, r"(?i)^Doc-\d+\s*")), " "), lambda w: w != "")
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws("_", a, b)))


def bigram_hashes(text) -> Column:
    """Distinct hashes of `word_bigrams`, without making their texts; none of a null text's."""
    key = comparison_key(replace(text, r"(?i)^Doc-\d+\s*"))
    words = F.when(key != "", F.split(key, " ")).otherwise(F.array().cast("array<string>"))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))


def role_of_context(text, address) -> Column:
    """Whose address it is: the first role that the words around it name, else the whole text; AMBIGUOUS without either.

    Around is 200 characters before and 50 after; of a text that does not hold the address, its first 2,000.
    """
    t, own = _col(text), F.coalesce(_col(address), F.lit(""))
    at = F.instr(F.lower(t), F.lower(own))
    start = F.greatest(at - fixed.ROLE_BEFORE, F.lit(1))
    around = F.when(at > 0, F.substring(t, start, at - start + F.length(own) + fixed.ROLE_AFTER)).otherwise(F.substring(t, 1, fixed.ROLE_HEAD))

    def role(where: Column) -> Column:
        named = F.array_compact(F.array(*(F.when(where.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(r)) for r, patterns in fixed.ADDRESS_ROLES.items())))
        return F.get(named, F.lit(0))

    told = F.filter(F.transform(F.array(around, t), role), lambda r: r.isNotNull())
    return F.when(F.length(t) > 0, F.coalesce(F.get(told, F.lit(0)), F.lit("AMBIGUOUS"))).otherwise("AMBIGUOUS")
