"""Canonical numbers and months in labels and texts: the atoms A(.)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rdfloom.functions.text import normalize_label, split_triple

#: Month names in English, Spanish and Catalan and their numbers.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "gener": 1, "febrer": 2, "marc": 3, "març": 3, "maig": 5, "juny": 6,
    "juliol": 7, "agost": 8, "setembre": 9, "novembre": 11, "desembre": 12,
}

_COMPOUND = "(?U)(?<!\\w)\\d+(?:[-/:]\\d+)+(?!\\w)"
_NUMBER = "(?U)(?<!\\w)\\d+(?:[.,]\\d+)*(?!\\w)"


def _plain_number(text: Column) -> Column:
    """A decimal in its shortest form; whole numbers, as doubles hold them, without a fraction."""
    whole = F.regexp_replace(text, "^0+(?=\\d)", "")
    value = text.try_cast("double")
    fraction = F.regexp_replace(F.regexp_replace(whole, "0+$", ""), "\\.$", "")
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(fraction)


def _canonical(token: Column, language: Column) -> Column:
    dot, comma = F.instr(token, "."), F.instr(token, ",")
    pieces = F.split(token, "[.,]")
    thousands_mark = F.when(language.isin("es", "ca"), ".").when(language == "en", ",").otherwise("")
    last_comma = F.length(token) - F.instr(F.reverse(token), ",")
    last_dot = F.length(token) - F.instr(F.reverse(token), ".")
    both = F.when(last_dot > last_comma, F.replace(token, F.lit(","), F.lit(""))).otherwise(
        F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    )
    mark = F.when(dot > 0, ".").otherwise(",")
    grouped = (F.size(pieces) > 2) | ((F.length(F.element_at(pieces, -1)) == 3) & (mark == thousands_mark))
    one = F.when(grouped, F.regexp_replace(token, "[.,]", "")).otherwise(F.replace(token, F.lit(","), F.lit(".")))
    return F.when((dot > 0) & (comma > 0), both).when((dot > 0) | (comma > 0), one).otherwise(token)


def numeric_atoms(text: Column, language: Column) -> Column:
    """Distinct atoms of a text: the parts of dates and times, numbers in canonical form, and months.

    Separators are read by language (``1.234`` is a thousand in Spanish and Catalan, ``1,234`` in
    English). NULL and blank texts give an empty array.
    """
    plain = normalize_label(text, exact=False)  # numbers and dates need no tables
    parts = F.transform(
        F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(_COMPOUND), F.lit(0)), lambda c: F.split(c, "[-/:]"))),
        lambda p: F.coalesce(p.try_cast("decimal(38,0)").cast("string"), p),
    )
    rest = F.regexp_replace(plain, _COMPOUND, " ")
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(_NUMBER), F.lit(0)), lambda t: _plain_number(_canonical(t, language)))
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in (pair[0], str(pair[1]))])
    months = F.filter(F.transform(F.split(F.trim(rest), "\\s+"), lambda w: F.try_element_at(names, w)), lambda m: m.isNotNull())
    return F.array_distinct(F.concat(parts, numbers, months))


def triple_atoms(triples: Column, language: Column) -> Column:
    """Distinct atoms over all fields of all triples."""
    def fields(t: Column) -> Column:
        s = split_triple(t)
        return F.flatten(F.array(*[numeric_atoms(s[k], language) for k in ("s", "p", "o")]))

    return F.array_distinct(F.flatten(F.transform(triples, fields)))


def retention(needed: Column, held: Column) -> Column:
    """Share of the needed atoms that are held; NULL where none is needed."""
    return F.when(F.size(needed) > 0, F.size(F.array_intersect(needed, held)) / F.size(needed))
