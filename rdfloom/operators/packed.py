"""Fields that pack several values: one row per value, with its position.

The scheme is the same for every packing:

1. Characters of the private range used as placeholders are escaped, so no input can collide.
2. Quoted spans are replaced by indexed placeholders ``\\uE000<n>\\uE001``.
3. What is left holds delimiters only outside quotes; it is split where a delimiter is
   followed by the start of another value (triples) or follows a count (counted forms).
4. Each piece loses list marks and blanks, placeholders are looked up in the array of spans,
   and ``posexplode`` gives the positions.

Everything is a composition of built-in string and array expressions; there is no Python
in the executors and no shuffle.

Defined results: NULL, blank or empty-list fields give no row; a field with one value gives
one row with position 1; empty pieces take no position; other columns of the input may have
any name, since only the id and the field are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, CUT, ESC = "\ue000", "\ue001", "\ue002", "\ue003"
MARK = f"{OPEN}\\d+{SHUT}"
#: White space of any kind, no-break space and zero-width marks included.
WS = "[\\s\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff]"
#: Delimiters between packed values. Blanks around them belong to them.
#: A backslash before one makes it an ordinary character.
DELIMITER = "(?:(?<!\\\\)(?:<br\\s*/?>|\\|\\||///?|&&|##|[;,\\n\\r\\t¦~•])|(?<=\\s)[/·](?=\\s))"
#: Quotes that open a value and close it. Single quotes count only where a value can begin and end,
#: so apostrophes inside words are ordinary characters.
QUOTED = (
    '"(?:[^"\\\\]|\\\\.|"")*"'
    "|(?<=(?:^|[\\[{(,;:=|/~¦\\t\\n])\\s{0,3})'(?:[^'\\\\]|\\\\.|''|'(?=\\p{L}))*'(?=\\s*(?:[\\]}),;:=|/~¦]|$|\\n|\\t))"
)
BULLET = f"(?:{WS}*(?:[-*•–—·]|\\(?\\d{{1,3}}[.)]){WS}+)"


def _escape(text: Column) -> Column:
    for i, c in enumerate((ESC, OPEN, SHUT, CUT)):
        text = F.replace(text, F.lit(c), F.lit(f"{ESC}{i}"))
    return text


def _unescape(text: Column) -> Column:
    for i, c in reversed(list(enumerate((ESC, OPEN, SHUT, CUT)))):
        text = F.replace(text, F.lit(f"{ESC}{i}"), F.lit(c))
    return text


def _spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))


def _masked(text: Column) -> Column:
    """The text with the n-th quoted span written as placeholder n."""
    parts = F.split(F.regexp_replace(text, QUOTED, CUT), CUT)
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(SHUT), p))), ""
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def _unquote(span: Column) -> Column:
    """The content of a quoted span, its escapes resolved."""
    inner = F.substring(span, 2, F.length(span) - 2)
    decoded = F.coalesce(F.try_element_at(F.from_json(F.concat(F.lit("["), span, F.lit("]")), "array<string>"), F.lit(1)), inner)
    quote = F.left(span, F.lit(1))
    simple = F.regexp_replace(F.replace(inner, F.concat(quote, quote), quote), "\\\\(.)", "$1")
    return F.when(span.startswith('"') & inner.contains("\\") & ~inner.contains('""'), decoded).otherwise(
        F.when(inner.contains("\\") | inner.contains('""') | inner.contains("''"), simple).otherwise(inner)
    )


def _restore(piece: Column, spans: Column) -> Column:
    """A piece that is one quoted span becomes its content; inside other pieces spans return verbatim."""
    whole = F.regexp_extract(piece, f"^{OPEN}(\\d+){SHUT}$", 1)
    found = F.regexp_extract_all(piece, F.lit(f"{OPEN}(\\d+){SHUT}"), F.lit(1))
    inside = F.aggregate(
        found, piece, lambda acc, n: F.replace(acc, F.concat(F.lit(OPEN), n, F.lit(SHUT)), F.get(spans, n.cast("int")))
    )
    return F.when(whole != "", _unquote(F.get(spans, whole.cast("int")))).otherwise(F.when(F.size(found) > 0, inside).otherwise(
        F.regexp_replace(piece, "\\\\([;,|/\\\\~])", "$1")
    ))


def _unlist(text: Column) -> Column:
    """Without the brackets or braces around the whole."""
    return F.regexp_replace(text, f"^{WS}*[\\[{{]{WS}*([\\s\\S]*?){WS}*[\\]}}]{WS}*$", "$1")


def triple_items(field: Column) -> Column:
    """Array of the triples ``S | P | O`` packed in a string.

    A delimiter counts only where another triple begins behind it: a quoted span that ends at a
    delimiter, or text with a field bar before any further delimiter. Commas, slashes and
    semicolons inside objects therefore stay. NULL gives NULL.
    """
    text = _escape(field)
    spans = _spans(text)
    numbered = F.regexp_replace(
        _unlist(_masked(text)),
        f"{WS}+(?:\\(\\d{{1,3}}\\)|(?<=[^|]\\s)\\d{{1,3}}[.)]){WS}+(?=[^|;\\n\\t]+ \\| [^|]+ \\| |{MARK}{WS}*(?:\\(|\\d|$))",
        "\n",
    )
    begins = f"(?={WS}*(?:{DELIMITER}|{WS})*{BULLET}?(?:{MARK}{WS}*(?:$|{DELIMITER}|{BULLET})|(?:(?!{DELIMITER})[^|])*{WS}\\|{WS}|$))"
    pieces = F.split(F.regexp_replace(numbered, f"{WS}*{DELIMITER}{begins}", CUT), CUT)
    return F.transform(
        F.filter(
            F.transform(pieces, lambda p: F.regexp_replace(p, f"^(?:{WS}|{DELIMITER})*{BULLET}?{WS}*|(?:{WS}|{DELIMITER})+$", "")),
            lambda p: (p != "") & ~p.rlike(f"^(?:[-*•–—]|\\(?\\d{{1,3}}[.)])$"),
        ),
        lambda p: _unescape(_strip(_restore(p, spans))),
    )


def form_items(field: Column) -> Column:
    """Array of the forms of a counted list, without their counts.

    Counts are written ``form: 3``, ``form=3``, ``form (3)`` or ``3 x form``; maps and lists of
    records, as JSON or as literals, come down to the first. A delimiter counts only behind a
    count (or before one, if counts come first), so delimiters inside forms stay. NULL gives NULL.
    """
    text = _escape(field)
    spans = _spans(text)
    record = F.regexp_replace(
        _masked(text), f"\\{{\\s*{MARK}\\s*:\\s*({MARK})\\s*,\\s*{MARK}\\s*:\\s*(\\d+)\\s*\\}}", "$1: $2"
    )
    record = F.regexp_replace(record, f"\\{{\\s*{MARK}\\s*:\\s*(\\d+)\\s*,\\s*{MARK}\\s*:\\s*({MARK})\\s*\\}}", "$2: $1")
    flat = _strip(_unlist(record))
    ends = f"(?=\\s*(?:{DELIMITER}|\\||$))"
    count = f"(?:\\s*[:=]\\s*\\d+|\\s*\\(\\s*\\d+\\s*\\)|\\s+[x×]\\s*\\d+){ends}"
    behind = F.split(F.regexp_replace(flat, count, CUT), CUT)
    before = F.transform(
        F.split(F.regexp_replace(flat, f"\\s*(?:{DELIMITER}|\\|)\\s*(?=\\d+\\s*[x×]\\s)", CUT), CUT),
        lambda p: F.regexp_replace(p, "^\\s*\\d+\\s*[x×]\\s+", ""),
    )
    plain = F.split(F.regexp_replace(flat, f"{WS}*(?:[;\\n\\t¦~]|\\|\\||{WS}\\|{WS}){WS}*", CUT), CUT)
    pieces = F.when(flat.rlike("^\\s*\\d+\\s*[x×]\\s"), before).when(flat.rlike(count), behind).otherwise(plain)
    return F.transform(
        F.filter(
            F.transform(pieces, lambda p: F.regexp_replace(p, f"^(?:{WS}|{DELIMITER}|\\|)*{BULLET}?{WS}*|(?:{WS}|{DELIMITER}|\\|)+$", "")),
            lambda p: p != "",
        ),
        lambda p: _unescape(_strip(_restore(p, spans))),
    )


def explode_packed(frame: DataFrame, id_column: str, items: Column, source: str) -> DataFrame:
    """(source_table, row_id, pos, item) of one table; rows delivered twice count once.

    Equal ids hold equal fields, so the narrow result is made distinct, not the wide input.
    """
    return (
        frame.select(F.lit(source).alias("source_table"), F.col(id_column).cast("bigint").alias("row_id"), F.posexplode(items).alias("p", "item"))
        .where(F.col("item") != "")
        .select("source_table", "row_id", (F.col("p") + 1).cast("int").alias("pos"), "item")
        .dropDuplicates(["source_table", "row_id", "pos"])
    )
