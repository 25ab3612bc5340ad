"""Corpus directories of XML: listing, parsing per file, errors, and flat views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rdfloom.functions.text import normalize_space
from rdfloom.operators.integrity import declared_size

#: Target languages and the element of their triples.
TRIPLES = {"en": ("modifiedtripleset", "mtriple"), "es": ("spanishtripleset", "striple"), "ca": ("catalantripleset", "ctriple"), "en_bt": ("enbttripleset", "bttriple")}
LABELS = {"es": "Spanish", "ca": "Catalan"}
SCHEMA = (
    "entries STRUCT<entry: ARRAY<STRUCT<_category: STRING, _eid: STRING, _size: STRING, _shape: STRING, _shape_type: STRING, "
    + ", ".join(f"{a}: STRUCT<{b}: ARRAY<STRING>>" for a, b in TRIPLES.values())
    + ", lex: ARRAY<STRUCT<_VALUE: STRING, _lang: STRING, _lid: STRING>>>>>"
)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, usable): every XML file below the root; hidden parts and checkpoints are not usable.

    A binary listing without content: no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(root).select("path")
    name = F.regexp_replace("path", "^.*/", "")
    inside = F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/'))}/", "")
    return files.select("path", (~name.endswith("-checkpoint.xml") & ~inside.rlike("(^|/)\\.")).alias("usable"))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(xml_path, split, triple_bucket, entries): one row a usable file; entries is NULL where it does not parse."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.xml")
    path = F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{re.escape(root.rstrip('/'))}/", "")
    parts = F.split("xml_path", "/")
    usable = raw.select(path.alias("xml_path"), "value").where(~F.col("xml_path").endswith("-checkpoint.xml") & ~F.col("xml_path").rlike("(^|/)\\."))
    parsed = usable.select("xml_path", F.from_xml("value", SCHEMA, {"rowTag": "benchmark"})["entries"]["entry"].alias("entries"))
    place = lambda i: F.when(F.size(parts) > i + 1, parts[i]).otherwise("unknown")
    return parsed.select("xml_path", place(0).alias("split"), place(1).alias("triple_bucket"), "entries")


def errors(files: DataFrame) -> DataFrame:
    return files.where("entries is null").select("xml_path", F.lit("not well-formed").alias("error"))


def _list(column: Column) -> Column:
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))


def entries(files: DataFrame) -> DataFrame:
    """One row an entry: keys, declared and expected size, triples by language and lexicalisations."""
    rows = files.where("entries is not null").select("xml_path", "split", "triple_bucket", F.posexplode("entries").alias("place", "e"))
    size = declared_size(F.col("e._size"))
    triples = {f"triples_{k}": _list(F.col(f"e.{a}.{b}")) for k, (a, b) in TRIPLES.items()}
    out = rows.select(
        "xml_path", "split", "triple_bucket", "place", F.col("e._category").alias("category"), F.col("e._eid").alias("eid"),
        F.concat_ws("::", "xml_path", "e._eid").alias("record_key"), F.col("e._size").alias("declared_size_raw"), size.alias("declared_size"), size.isNotNull().alias("declared_size_valid"),
        *[c.alias(n) for n, c in triples.items()], F.coalesce("e.lex", F.array().cast("array<struct<_VALUE:string,_lang:string,_lid:string>>")).alias("lex"),
    )
    return out.withColumn("expected_triple_count", F.coalesce("declared_size", F.size("triples_en")))


def lexicalisations(entries_: DataFrame) -> DataFrame:
    """(record_key, place, lang, lid, text): all of them, duplicates and blanks too; those without a language left out."""
    lex = entries_.select("record_key", F.posexplode("lex").alias("place", "l"))
    text = F.coalesce("l._VALUE", F.lit(""))
    return lex.where(F.coalesce("l._lang", F.lit("")) != "").select(
        "record_key", "place", F.col("l._lang").alias("lang"), F.coalesce("l._lid", F.lit("")).alias("lid"), normalize_space(text).alias("text")
    )


def integrity_entries(entries_: DataFrame, languages: tuple[str, ...] = ("es", "ca")) -> DataFrame:
    """One row an entry and target language, with the lists the structural checks read."""
    pick = lambda lang, f: F.transform(F.filter("lex", lambda x: x["_lang"] == lang), lambda x: F.trim(F.coalesce(x[f], F.lit(""))))
    keep = ["record_key", "xml_path", "split", "triple_bucket", "category", "eid", "declared_size_raw", "declared_size", "declared_size_valid", "expected_triple_count"]
    each = F.inline(F.array(*[
        F.struct(
            F.lit(lang).alias("language"), F.lit(LABELS.get(lang, lang)).alias("language_label"), F.col("triples_en").alias("source_triples"), F.col(f"triples_{lang}").alias("target_triples"),
            pick("en", "_lid").alias("english_lids"), pick(lang, "_lid").alias("target_lids"), pick(lang, "_VALUE").alias("target_texts"),
        ) for lang in languages
    ]))
    return entries_.select(*keep, "lex", *[f"triples_{k}" for k in TRIPLES]).select(*keep, each)


def manifest(entries_: DataFrame, languages: tuple[str, ...] = ("es", "ca")) -> DataFrame:
    """One row a lexicalisation and target language: full outer alignment of the English and the target ids."""
    lex = lexicalisations(entries_)
    first = lex.groupBy("record_key", "lang", "lid").agg(F.min_by("text", "place").alias("text"), F.count("*").alias("n"))
    source = first.where("lang = 'en'").select("record_key", "lid", F.col("text").alias("source_text")).withColumn("language", F.explode(F.array(*[F.lit(x) for x in languages])))
    target = first.where(F.col("lang").isin(*languages)).select("record_key", "lid", F.col("lang").alias("language"), F.col("text").alias("target_text"), (F.col("n") > 1).alias("xml_duplicate_target_lex"))
    both = source.join(target, ["record_key", "lid", "language"], "full")
    return both.select(
        F.concat_ws("::", "record_key", "lid").alias("base_pair_key"), "record_key", "lid", "language", "source_text", "target_text",
        F.coalesce("xml_duplicate_target_lex", F.lit(False)).alias("xml_duplicate_target_lex"),
    )
