"""Names of people and organisations on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import _col, clean_name, name_variant, once, replace, squeeze, strip_accents

TEXTS = "array<string>"


def _words(text: Column, pattern: str = r"\s+") -> Column:
    return F.filter(F.split(text, pattern), lambda w: w != "")


def merge_suffixes(names) -> Column:
    """A part that is only Jr., III or the like goes back to the name before it."""

    def step(done: Column, name: Column) -> Column:
        join = F.trim(name).rlike(fixed.SUFFIX_ONLY) & (F.size(done) > 0)
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(", ", F.try_element_at(done, F.lit(-1)), F.trim(name))))
        return F.when(join, longer).otherwise(F.concat(done, F.array(name)))

    return F.aggregate(_col(names), F.array().cast(TEXTS), step)


def split_names(text) -> Column:
    """People of a list like `A B, A SINGLE PERSON, AND C D, Jr.`: no marital status, suffixes kept."""
    parts = F.transform(F.split(clean_name(text), fixed.NAME_SEPARATORS), F.trim)
    return merge_suffixes(F.filter(parts, lambda n: (n != "") & ~n.rlike(fixed.MARITAL_STATUS)))


def is_name_list(text) -> Column:
    """Reads as a run of capitalised words rather than a piece of a sentence."""
    t = F.trim(_col(text))
    return F.coalesce(F.length(t).between(4, 200) & t.rlike(fixed.NAME_LIST), F.lit(False))


def wrapped_name(captured, after) -> Column:
    """A name cut at a middle initial, with its next line if that line continues it."""
    name = F.trim(_col(captured))
    line = F.trim(F.nullif(F.regexp_extract(_col(after), r"^[ \t]*\n[ \t]*([^\n]+)", 1), F.lit("")))
    goes_on = name.rlike(r"(?:^|\s)[A-Z]\.\z") & line.isNotNull() & ~F.contains(F.substring(line, 1, 40), F.lit(":")) & line.rlike("^[A-Z]")
    return F.when(F.coalesce(goes_on, F.lit(False)), F.concat_ws(" ", name, line)).otherwise(name)


def party_text(text) -> Column:
    """A name as `reads_as_party` looks at it: squeezed, without trailing . , ;"""
    return replace(squeeze(text), r"[.,;]+\z")


def reads_as_party(plain: Column) -> Column:
    """`is_party` of a text that `party_text` made."""
    ok = F.length(plain).between(3, 200) & plain.rlike("^[A-Z]") & ~plain.rlike("|".join(f"(?:{p})" for p in fixed.NOT_A_PARTY))
    return F.coalesce(ok, F.lit(False))


def is_party(text) -> Column:
    """An organisation's or person's name rather than a title, a label, an address or a sentence."""
    return once(party_text(text), reads_as_party)


def is_entity(name) -> Column:
    return F.trim(_col(name)).rlike(fixed.ENTITY_MARKERS)


def people(name) -> Column:
    """People that an owner's name stands for: `SURNAME, A & B`, `A and B`, `A ET UX`; an entity as it is."""
    full = F.trim(_col(name))
    own = F.trim(replace(full, fixed.JOINT_MARKERS))
    last = F.regexp_extract(own, r"^([A-Za-zÀ-ÿ'\-]+),\s*(.+)\z", 1)
    firsts = _words(F.regexp_extract(own, r"^([A-Za-zÀ-ÿ'\-]+),\s*(.+)\z", 2), r"(?i)\s*(?:&|\band\b)\s*")
    joined = _words(own, r"(?i)\s*(?:,?\s*&\s*|\s+and\s+)\s*")
    without_role = F.filter(F.transform(joined, lambda s: F.trim(F.regexp_replace(F.trim(s), r"(?i)^(wife|husband|spouse)\s+", ""))), lambda s: s != "")
    return (
        F.when(is_entity(full), F.array(strip_accents(full)))
        .when(last != "", F.transform(firsts, lambda f: F.concat_ws(" ", F.trim(f), last)))
        .when(F.size(joined) > 1, without_role)
        .otherwise(F.array(own))
    )


def _person_variants(person: Column) -> Column:
    words = _words(squeeze(replace(strip_accents(person), r"[.,]")), " ")
    own = F.filter(words, lambda w: ~F.upper(w).isin(fixed.NAME_SUFFIXES))
    suffix = F.slice(F.filter(words, lambda w: F.upper(w).isin(fixed.NAME_SUFFIXES)), 1, 1)
    first, last = F.slice(own, 1, 1), F.slice(own, -1, 1)
    rest, start = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))
    spell = lambda *parts: name_variant(F.array_join(F.concat(*parts), " "))
    more = F.array(spell(first, last, suffix), spell(last, first, suffix), spell(first, last), spell(last, start, suffix), spell(rest, first, suffix))
    return F.when(F.size(words) == 0, F.array().cast(TEXTS)).otherwise(
        F.concat(F.array(spell(words)), F.when(F.size(own) >= 2, more).otherwise(F.array().cast(TEXTS)))
    )


def variants(name) -> Column:
    """Spellings of an owner's name to compare by: as given, first-last, last-first, rotations."""
    return F.when(is_entity(name), F.array(name_variant(F.trim(_col(name))))).otherwise(F.array_distinct(F.flatten(F.transform(people(name), _person_variants))))


def ocr_fold(text) -> Column:
    """Digits that are read for letters, as those letters."""
    return F.translate(_col(text), "015", "OIS")


def spelt(name) -> Column:
    """All spellings of a name, read errors aside."""
    return F.transform(variants(name), ocr_fold)


def related(a, b) -> Column:
    """Any spelling of one name is a spelling of the other, read errors aside."""
    return F.coalesce(F.arrays_overlap(spelt(a), spelt(b)), F.lit(False))


def surname_tokens(name) -> Column:
    """Surnames of people; of an entity every telling word."""
    telling = F.filter(_words(replace(F.upper(strip_accents(F.trim(_col(name)))), r"[.,]")), lambda w: (F.length(w) > 1) & ~w.isin(fixed.GENERIC_ENTITY_WORDS))
    last = F.transform(people(name), lambda p: F.try_element_at(_words(F.trim(F.regexp_replace(F.upper(strip_accents(p)), r"[.,]", ""))), F.lit(-1)))
    return F.when(is_entity(name), telling).otherwise(F.filter(last, lambda w: w.isNotNull() & (w != "")))


def surnames_match(a, b) -> Column:
    return F.coalesce(F.arrays_overlap(surname_tokens(a), surname_tokens(b)), F.lit(False))


def significant_tokens(name) -> Column:
    words = _words(replace(F.upper(_col(name)), r"[.,]"), r"[\s&]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(fixed.NAME_SUFFIXES)))


def owner_conflicts(owner, names) -> Column:
    """Both known and not one telling word in common."""
    return tokens_conflict(significant_tokens(owner), F.flatten(F.transform(_col(names), significant_tokens)), names)


def tokens_conflict(own, theirs, names) -> Column:
    """`owner_conflicts` of telling words that are known already: an owner's, and those of all `names`."""
    own = _col(own)
    known = own.isNotNull() & (F.size(own) > 0) & (F.coalesce(F.size(_col(names)), F.lit(0)) > 0)
    return F.coalesce(known & ~F.arrays_overlap(own, _col(theirs)), F.lit(False))


def any_name(names, test) -> Column:
    """Whether a test holds for any name of an array; false for null or empty ones."""
    return F.coalesce(F.exists(_col(names), test), F.lit(False))
