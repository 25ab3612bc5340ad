"""Scalar text functions as column expressions.

Every function maps NULL as its docstring says and is a composition of built-in functions; the few
that need Unicode tables Spark lacks (compatibility forms, HTML names, case folding) take an Arrow
function only for the texts that need it.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's ``\\s`` sees it.
WS = "(?U)[\\s\\x1c-\\x1f]"
QUOTES_BLANKS = " \t\n\r\"'"


def normalize_space(text: Column) -> Column:
    """White space collapsed to single blanks and stripped; NULL gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{WS}+", " "))


def normalize_csv(text: Column) -> Column:
    """normalize_space, with the texts nan, none and null (any case) as ''."""
    plain = normalize_space(text)
    return F.when(F.lower(plain).isin("nan", "none", "null"), F.lit("")).otherwise(plain)


@F.pandas_udf(T.StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", html.unescape(v)))


@F.pandas_udf(T.StringType())
def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else html.unescape(v))


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else v.casefold())


def _strip(text: Column, characters: str = QUOTES_BLANKS) -> Column:
    return F.btrim(text, F.lit(characters))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compatible_all(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else [unicodedata.normalize("NFKC", html.unescape(x)) for x in v])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded_all(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else [x.casefold() for x in v])


#: Characters whose compatibility form is another one, and those whose case folding is not the lower case: all beyond
#: Latin letters, and the few among them. Texts without any stay in the JVM.
_FORMS = "[^\\x00-\\x9f\\u00a1-\\u00a7\\u00a9\\u00ab-\\u00ae\\u00b0\\u00b1\\u00b6\\u00b7\\u00bb\\u00bf-\\u0131\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e\\u0180-\\u01c3\\u01cd-\\u01f0\\u01f4-\\u024f]|&"
_FOLDS = "[^\\x00-\\u01ef\\u01f1-\\u024f]|ß"


def _bare_label(text: Column) -> Column:
    return _strip(F.regexp_replace(F.replace(F.regexp_replace(text, "@[A-Za-z-]+\\s*$", ""), F.lit("_"), F.lit(" ")), f"{WS}+", " "))


def normalize_label(text: Column, exact: bool = True) -> Column:
    """N(.): HTML names, compatibility forms, space, a language tag at the end, underscores, quotes, case folding.

    NULL gives ''. Only texts with a character that needs them go to Python's Unicode tables. Inside functions over
    array elements, where Spark runs no Python, take ``normalize_labels`` of the array; without ``exact`` the tables
    are left out.
    """
    plain = normalize_space(text)
    if not exact:
        return F.lower(_bare_label(plain))
    plain = F.when(plain.rlike(_FORMS), normalize_space(_compatible(F.when(plain.rlike(_FORMS), plain)))).otherwise(plain)
    bare = _bare_label(plain)
    return F.when(bare.rlike(_FOLDS), _folded(F.when(bare.rlike(_FOLDS), bare))).otherwise(F.lower(bare))


def normalize_labels(texts: Column) -> Column:
    """``normalize_label`` of every element of an array; NULL gives NULL."""
    plain = F.transform(texts, normalize_space)
    needs = F.exists(plain, lambda x: x.rlike(_FORMS))
    plain = F.when(needs, F.transform(_compatible_all(F.when(needs, plain)), normalize_space)).otherwise(plain)
    bare = F.transform(plain, _bare_label)
    needs = F.exists(bare, lambda x: x.rlike(_FOLDS))
    return F.when(needs, _folded_all(F.when(needs, bare))).otherwise(F.transform(bare, F.lower))


def generator_label(text: Column) -> Column:
    """The label form of the perturbation generators: datatype and language tags and quotes go first."""
    bare = F.regexp_replace(F.regexp_replace(normalize_space(text), "\\^\\^xsd:[A-Za-z]+\\s*$", ""), "@[A-Za-z-]+\\s*$", "")
    return F.lower(F.trim(F.regexp_replace(F.replace(_strip(bare), F.lit("_"), F.lit(" ")), f"{WS}+", " ")))


def clean_rdf_label(text: Column, exact: bool = False) -> Column:
    """A label for display in a serialised triple: no datatype, language tag, quotes or underscores; case kept."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    if exact:
        plain = F.when(plain.contains("&"), _unescaped(plain)).otherwise(plain)
    bare = F.regexp_replace(F.regexp_replace(plain, "\\^\\^xsd:[A-Za-z]+\\s*$", ""), "@[A-Za-z-]+\\s*$", "")
    return F.trim(F.regexp_replace(F.replace(_strip(bare, "\"' "), F.lit("_"), F.lit(" ")), f"{WS}+", " "))


def display_label(text: Column) -> Column:
    """Underscores as blanks, quotes stripped, space normalised."""
    return normalize_space(_strip(F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" "))))


def _parts(triple: Column) -> Column:
    return F.transform(F.split(F.coalesce(triple, F.lit("")), "\\|"), lambda x: F.trim(x))


def _triple(s: Column, p: Column, o: Column) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"))


def split_triple(triple: Column) -> Column:
    """STRUCT<s, p, o>; fewer than three fields give three blanks, more are part of the object."""
    parts = _parts(triple)
    ok = F.size(parts) >= 3
    pick = lambda i: F.when(ok, F.get(parts, F.lit(i))).otherwise("")
    return _triple(pick(0), pick(1), F.when(ok, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "|")).otherwise(""))


def split_triple_strict(triple: Column) -> Column:
    """STRUCT<s, p, o>; anything but three fields gives three blanks."""
    parts = _parts(triple)
    pick = lambda i: F.when(F.size(parts) == 3, F.get(parts, F.lit(i))).otherwise("")
    return _triple(pick(0), pick(1), pick(2))


def parse_triple_line(line: Column) -> Column:
    """STRUCT<s, p, o> of a line split at ' | ' into at most three, else at '|'; NULL where that gives no three fields."""
    spaced, bare = F.split(line, " \\| ", 3), F.split(line, "\\|", 3)
    parts = F.when(F.size(spaced) == 3, spaced).otherwise(bare)
    field = lambda i: F.trim(F.get(parts, F.lit(i)))
    return F.when(F.size(parts) == 3, _triple(field(0), field(1), field(2)))


def split_triple_text(text: Column) -> Column:
    """STRUCT<s, p, o>; further fields join the object by ' | ', fewer than three stay whole as the subject."""
    parts = _parts(text)
    ok = F.size(parts) >= 3
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), " | ")
    return _triple(
        F.when(ok, F.get(parts, F.lit(0))).otherwise(F.trim(F.coalesce(text, F.lit("")))),
        F.when(ok, F.get(parts, F.lit(1))).otherwise(""),
        F.when(ok, rest).otherwise(""),
    )


def join_triple(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws(" | ", s, p, o)


def serialize_triple(triple: Column) -> Column:
    """``[S] s [P] p [O] o`` of the cleaned fields."""
    t = split_triple(triple)
    return F.concat(F.lit("[S] "), clean_rdf_label(t["s"]), F.lit(" [P] "), clean_rdf_label(t["p"]), F.lit(" [O] "), clean_rdf_label(t["o"]))


def serialize_triple_set(triples: Column) -> Column:
    return F.array_join(F.transform(triples, serialize_triple), " ")


def textual_units(text: Column) -> Column:
    """Sentences: cut at white space behind ``.``, ``!`` or ``?``; blank texts give an empty array."""
    plain = normalize_space(text)
    return F.filter(F.split(plain, "(?<=[.!?])\\s+"), lambda u: F.trim(u) != "")


def sentence_split(text: Column) -> Column:
    """Sentences, cut only where a capital letter or a digit follows."""
    return F.filter(F.split(normalize_space(text), "(?<=[.!?])\\s+(?=[A-ZÁÉÍÓÚÀÈÒÏÜÇÑ0-9])"), lambda u: F.trim(u) != "")


def first_sentence(text: Column) -> Column:
    return F.coalesce(F.get(sentence_split(text), F.lit(0)), normalize_space(text))


def tokens(text: Column) -> Column:
    """Tokens between blanks of the normalised text; none for blank texts."""
    plain = normalize_space(text)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def token_windows(words: Column, size: int = 10, step: int = 8, least: int = 6) -> Column:
    """Windows of ``size`` tokens every ``step`` tokens that hold at least ``least``, as texts."""
    n = F.size(words)
    starts = F.when(n >= least, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    kept = F.filter(starts, lambda i: F.least(F.lit(size), n - i) >= least)
    return F.transform(kept, lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def is_malformed_component(text: Column) -> Column:
    """Blank, a placeholder, or with source markup; an address never is."""
    plain = normalize_space(text)
    address = plain.rlike("(?i)^(?:<https?://[^>]+>|https?://\\S+)$")
    return ~address & ((plain == "") | plain.rlike("(?i)^(?:none|null|nan|n/?a|unknown|undefined)$") | plain.rlike("@[Ee][Nn]\\b|\\^\\^"))


def is_camel_case(text: Column) -> Column:
    return text.rlike("[a-zà-ÿ][A-Z]")


def is_probable_literal(text: Column) -> Column:
    """With a digit, a datatype or quotes around it; NULL is none."""
    plain = F.coalesce(text, F.lit(""))
    return plain.rlike("\\d") | plain.contains("^^xsd:") | plain.rlike("^\\s*[\"'].*[\"']\\s*$")


def is_number_symbol(text: Column) -> Column:
    """Has a digit and no letter."""
    return text.rlike("\\d") & ~text.rlike("\\p{L}")


def perturb_number(token: Column) -> Column:
    """The first run of digits one higher (one lower at 999999999), as wide as before; without digits unchanged."""
    digits = F.regexp_extract(token, "\\d+", 0)
    number = digits.cast("decimal(38,0)")
    changed = F.when(number == 999999999, number - 1).otherwise(number + 1).cast("string")
    padded = F.lpad(changed, F.greatest(F.length(digits), F.length(changed)), "0")
    return F.when(digits == "", token).otherwise(F.overlay(token, padded, F.regexp_instr(token, F.lit("\\d+")), F.length(digits)))


def first_shared_number(triples: Column, text: Column) -> Column:
    """The first numeric token of the triples that stands in the text; NULL if there is none."""
    found = F.regexp_extract_all(F.array_join(triples, " "), F.lit("\\d+(?:[.,/:-]\\d+)*"), F.lit(0))
    return F.get(F.filter(found, lambda t: F.contains(text, t)), F.lit(0))


def replace_once_ci(text: Column, old: Column, new: Column) -> Column:
    """The first occurrence of ``old`` in any case replaced; unchanged if it is not there or blank."""
    at = F.position(F.lower(old), F.lower(text))
    return F.when((F.length(old) == 0) | (at == 0), text).otherwise(F.overlay(text, new, at, F.length(old)))


def stable_hash(text: Column, digits: int = 12, modulus: int = 2**32 - 1) -> Column:
    """The first hexadecimal digits of SHA-256 as a number below the modulus."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("bigint"), F.lit(modulus))


def variant_id(kind: str, language: Column, *parts: Column) -> Column:
    """``kind__language__`` and twelve digits of SHA-1 over the parts."""
    return F.concat_ws("__", F.lit(kind), language, F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))


def to_triple_token(text: Column) -> Column:
    """Blanks collapsed into underscores."""
    return F.regexp_replace(F.trim(text), f"{WS}+", "_")


def relation_token(text: Column) -> Column:
    """Words joined with capital first letters from the second on; the rest of each word unchanged."""
    words = F.split(normalize_space(text), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1_000_000)))), "")


def split_camel_case(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-zà-ÿ])(?=[A-ZÀ-Ý])", " ")


def strip_quotes_and_language(text: Column) -> Column:
    """The content of ``"..."`` with an optional language tag; other texts unchanged."""
    inner = F.regexp_extract(F.trim(text), "^\"(.*)\"(?:@[A-Za-z-]+)?$", 1)
    return F.when(F.trim(text).rlike("^\".*\"(?:@[A-Za-z-]+)?$"), inner).otherwise(F.trim(text))


def swap_day_month(text: Column, to_european: bool = True) -> Column:
    """``mm?dd?yyyy`` and ``dd?mm?yyyy`` exchanged where the month is at most 12; NULL where it is no such date."""
    pattern = "^(\\d{1,2})([-/.])(\\d{1,2})([-/.])(\\d{4})$"
    a, s1, b, s2, y = (F.regexp_extract(text, pattern, i) for i in range(1, 6))
    month = (a if to_european else b).try_cast("int")
    return F.when(text.rlike(pattern) & (month <= 12), F.concat(b, s1, a, s2, y))


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens without punctuation."""
    plain = F.trim(F.regexp_replace(F.lower(normalize_space(text)), "(?U)[^\\w\\s]+", " "))
    return F.array_distinct(F.filter(F.split(plain, " +"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the token sets; two empty texts give 1, one gives 0."""
    x, y = token_set(a), token_set(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def has_mojibake(text: Column) -> Column:
    return text.rlike("[ÃÂ\ufffd]")


def safe_threshold(value: Column, default: float = 0.9) -> Column:
    """The threshold, or the default where it is NULL or outside (0, 1]."""
    return F.when((value > 0) & (value <= 1), value).otherwise(default)


def bracket_answer(text: Column, prefix: str = "verbalization:") -> Column:
    """The last ``[...]`` of a generated answer without a leading prefix, else the whole."""
    bare = F.regexp_replace(normalize_space(text), f"(?i)^{re.escape(prefix)}\\s*", "")
    found = F.regexp_extract_all(bare, F.lit("\\[([^\\[\\]]*)\\]"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1))).otherwise(bare)


def align_key(*parts: Column, separator: str = "|") -> Column:
    """The parts joined; NULL parts count as ''."""
    return F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def forms_json(entries: Column) -> Column:
    """A map of forms and counts as JSON with sorted keys; entries is ARRAY<STRUCT<form, n>>."""
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def case_hash(key: Column) -> Column:
    """Twelve hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(key, 256), 1, 12)


#: Spellings of the codes, apart from case and region.
SPELLINGS = {
    "en": ("en", "eng", "english", "inglés", "anglès", "anglais"),
    "es": ("es", "spa", "esp", "spanish", "español", "castellano", "castilian", "espanyol", "espagnol"),
    "ca": ("ca", "cat", "catalan", "catalán", "català", "valencian", "valencià"),
    "fr": ("fr", "fra", "fre", "french", "francés", "francès", "français"),
}


def label_code(label: Column) -> Column:
    """The language a label names, whatever its spelling and region; NULL where it names none of SPELLINGS."""
    base = F.element_at(F.split(F.regexp_replace(F.lower(label), "^[\\s\\u00a0]+|[\\s\\u00a0]+$", ""), "[-_ .@]"), 1)
    out = F.lit(None).cast("string")
    for code, spellings in SPELLINGS.items():
        out = F.when(base.isin(*spellings), code).otherwise(out)
    return out
