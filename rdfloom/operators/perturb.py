"""Controlled corruption of entries: every type is one projection over the rows it applies to.

Rows carry ``record``, ``lid``, ``language``, ``source_triples``, ``target_triples``, ``source_text``,
``target_text``, ``target_lids``, ``target_texts``. Choices (which triple, which role) are hashes of
record and type, so a variant is the same in every run and on any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rdfloom.operators.integrity import CHECKS
from rdfloom.functions.text import display_label, first_sentence, first_shared_number, is_probable_literal, join_triple, perturb_number, replace_once_ci, sentence_split, split_triple_strict, variant_id

C = F.col


def _pick(n: Column, kind: str) -> Column:
    """A hash choice below n."""
    return F.pmod(F.xxhash64("record", "lid", F.lit(kind)), F.greatest(n, F.lit(1))).cast("int")


def _replace_at(items: Column, at: Column, new: Callable[[Column], Column]) -> Column:
    return F.transform(items, lambda x, i: F.when(i == at, new(x)).otherwise(x))


def _component(triple: Column, role: Column, new: Callable[[Column], Column]) -> Column:
    t = split_triple_strict(triple)
    field = lambda k, i: F.when(role == i, new(t[k])).otherwise(t[k])
    return join_triple(field("s", 0), field("p", 1), field("o", 2))


def delete_triple(rows: DataFrame) -> DataFrame:
    at = _pick(F.size("target_triples"), "delete")
    return rows.where(F.size("target_triples") >= 2).withColumn("target_triples", F.filter("target_triples", lambda x, i: i != at))


def duplicate_triple(rows: DataFrame) -> DataFrame:
    at = _pick(F.size("target_triples"), "duplicate")
    doubled = F.flatten(F.transform("target_triples", lambda x, i: F.when(i == at, F.array(x, x)).otherwise(F.array(x))))
    return rows.where(F.size("target_triples") >= 1).withColumn("target_triples", doubled)


def missing_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"target_text": F.lit(""), "target_texts": F.transform("target_texts", lambda x: F.lit(""))})


def wrong_lid(rows: DataFrame) -> DataFrame:
    return rows.withColumn("target_lids", F.transform("target_lids", lambda x, i: F.when(i == 0, F.concat(x, F.lit("_NOISE"))).otherwise(x))).where(F.size("target_lids") > 0)


def duplicate_lid(rows: DataFrame) -> DataFrame:
    return rows.where((F.size("target_lids") > 0) & (F.size("target_texts") > 0)).withColumns(
        {"target_lids": F.concat("target_lids", F.slice("target_lids", 1, 1)), "target_texts": F.concat("target_texts", F.slice("target_texts", 1, 1))}
    )


def _change_component(rows: DataFrame, kind: str, role: Column | None, new: Callable[[Column], Column]) -> DataFrame:
    at = _pick(F.size("target_triples"), kind)
    chosen = _pick(F.lit(3), kind + "role") if role is None else role
    return rows.where(F.size("target_triples") > 0).withColumn("target_triples", _replace_at(C("target_triples"), at, lambda t: _component(t, chosen, new)))


def placeholder_component(rows: DataFrame) -> DataFrame:
    return _change_component(rows, "placeholder", F.lit(2), lambda x: F.lit("NULL"))


def missing_component(rows: DataFrame) -> DataFrame:
    return _change_component(rows, "missing", None, lambda x: F.lit(""))


def source_markup(rows: DataFrame) -> DataFrame:
    return _change_component(rows, "markup", None, lambda x: F.concat(x, F.lit("@en")))


def predicate_retention(rows: DataFrame) -> DataFrame:
    """A target predicate replaced by the source's."""
    at = _pick(F.least(F.size("target_triples"), F.size("source_triples")), "retention")
    source = split_triple_strict(F.get("source_triples", at))["p"]
    return rows.where((F.size("target_triples") > 0) & (F.size("source_triples") > 0)).withColumn(
        "target_triples", _replace_at(C("target_triples"), at, lambda t: _component(t, F.lit(1), lambda x: source))
    )


def _pool(rows: DataFrame, words: Column, buckets: int) -> DataFrame:
    """(language, bucket, others): two words at most for each language and hash bucket to substitute with; bucket -1 stands for those that are empty."""
    ends = F.array(F.min("e"), F.max("e")).alias("others")
    found = rows.select("language", F.explode(words).alias("e")).where(C("e") != "").withColumn("bucket", F.pmod(F.xxhash64("e"), F.lit(buckets)).cast("int"))
    own = found.groupBy("language", "bucket").agg(ends)
    return own.unionByName(own.select("language", F.explode("others").alias("e")).groupBy("language").agg(ends).withColumn("bucket", F.lit(-1)))


def _with_other(rows: DataFrame, pool: DataFrame, buckets: int, kind: str, own: Column) -> DataFrame:
    """The rows with ``other``, a word that is not their own: of their bucket, or of the language. Pools are as small as their buckets."""
    keyed = rows.withColumn("bucket", _pick(F.lit(buckets), kind))
    every = pool.where("bucket = -1").select("language", C("others").alias("_every"))
    joined = keyed.join(pool, ["language", "bucket"], "left").join(every, "language", "left")
    choice = F.filter(F.concat(F.coalesce("others", "_every"), C("_every")), lambda x: display_label(x) != display_label(own))
    return joined.withColumn("other", F.get(choice, F.lit(0))).where("other is not null").drop("bucket", "others", "_every")


def _entities(triples: Column) -> Column:
    """Subjects and objects that are no literals, in order."""
    fields = F.flatten(F.transform(triples, lambda t: F.array(split_triple_strict(t)["s"], split_triple_strict(t)["o"])))
    return F.filter(fields, lambda e: (e != "") & ~is_probable_literal(e))


def entity_substitution(rows: DataFrame, buckets: int = 64) -> DataFrame:
    """The object (or the subject, where the object is a literal) of one triple replaced by another entity of the language."""
    at = _pick(F.size("target_triples"), "entity")
    t = split_triple_strict(F.get("target_triples", at))
    role = F.when(is_probable_literal(t["o"]), 0).otherwise(2)
    own = F.when(role == 0, t["s"]).otherwise(t["o"])
    keyed = _with_other(rows.where(F.size("target_triples") > 0), _pool(rows, _entities(C("target_triples")), buckets), buckets, "entitypool", own)
    return keyed.withColumn("target_triples", _replace_at(C("target_triples"), at, lambda x: _component(x, role, lambda y: C("other")))).drop("other")


def predicate_substitution(rows: DataFrame, buckets: int = 64) -> DataFrame:
    """The predicate of one triple replaced by another predicate of the language."""
    at = _pick(F.size("target_triples"), "predicate")
    words = F.transform("target_triples", lambda t: split_triple_strict(t)["p"])
    keyed = _with_other(rows.where(F.size("target_triples") > 0), _pool(rows, words, buckets), buckets, "predicatepool", split_triple_strict(F.get("target_triples", at))["p"])
    return keyed.withColumn("target_triples", _replace_at(C("target_triples"), at, lambda x: _component(x, F.lit(1), lambda y: C("other")))).drop("other")


def entity_substitution_text(rows: DataFrame, buckets: int = 64) -> DataFrame:
    """The first entity of the triples that the text names replaced in it by another entity of the language; the triples stay."""
    shown = F.transform(_entities(C("target_triples")), display_label)
    named = rows.withColumn("_e", F.get(F.filter(shown, lambda e: F.contains(F.lower("target_text"), F.lower(e))), F.lit(0))).where("_e is not null")
    keyed = _with_other(named, _pool(rows, _entities(C("target_triples")), buckets), buckets, "textpool", C("_e"))
    return keyed.withColumn("target_text", replace_once_ci(C("target_text"), C("_e"), display_label(C("other")))).drop("_e", "other")


def alternative_reference(rows: DataFrame) -> DataFrame:
    """Benign: the text replaced by the next other text of the same entry and language."""
    others = F.filter("target_texts", lambda x: (F.trim(x) != "") & (x != C("target_text")))
    return rows.withColumn("_o", others).where(F.size("_o") > 0).withColumn("target_text", F.get("_o", _pick(F.size("_o"), "alternative"))).drop("_o")


def literal_text_only(rows: DataFrame) -> DataFrame:
    token = first_shared_number(C("target_triples"), C("target_text"))
    return rows.withColumn("_t", token).where("_t is not null").withColumn("target_text", replace_once_ci(C("target_text"), C("_t"), perturb_number(C("_t")))).drop("_t")


def literal_both(rows: DataFrame) -> DataFrame:
    """A number changed in the text and in the triples, there as a whole number only."""
    token = first_shared_number(C("target_triples"), C("target_text"))
    changed = rows.withColumn("_t", token).where("_t is not null")
    whole = F.concat(F.lit("(?<!\\d)(?<!\\d[.,/:-])\\Q"), C("_t"), F.lit("\\E(?![.,/:-]?\\d)"))
    return changed.withColumns({
        "target_text": replace_once_ci(C("target_text"), C("_t"), perturb_number(C("_t"))),
        "target_triples": F.transform("target_triples", lambda x: F.regexp_replace(x, whole, perturb_number(C("_t")))),
    }).drop("_t")


def omit_one_sentence(rows: DataFrame) -> DataFrame:
    """A sentence other than the first left out; texts of at least three."""
    parts = rows.withColumn("_s", sentence_split(C("target_text"))).where(F.size("_s") >= 3)
    at = F.lit(1) + _pick(F.size("_s") - 1, "omit")
    return parts.withColumn("target_text", F.array_join(F.filter("_s", lambda x, i: i != at), " ")).drop("_s")


def omit_to_first_sentence(rows: DataFrame) -> DataFrame:
    return rows.where(F.size(sentence_split(C("target_text"))) >= 3).withColumn("target_text", first_sentence(C("target_text")))


def full_copy(rows: DataFrame) -> DataFrame:
    return rows.where(F.length(F.trim("source_text")) > 0).withColumn("target_text", C("source_text"))


def clause_insertion(rows: DataFrame) -> DataFrame:
    return rows.where(F.length(F.trim("source_text")) > 0).withColumn("target_text", F.concat_ws(" ", "target_text", first_sentence(C("source_text"))))


def plausible_addition(rows: DataFrame) -> DataFrame:
    """A template sentence that no triple supports, about the first subject or object that is no literal."""
    name = display_label(F.get(_entities(C("target_triples")), F.lit(0)))
    text = F.when(C("language") == "ca", F.concat(name, F.lit(" és un lloc conegut."))).otherwise(F.concat(name, F.lit(" es un lugar conocido.")))
    return rows.where(F.size(_entities(C("target_triples"))) > 0).withColumn("target_text", F.concat_ws(" ", "target_text", text))


def with_donor(rows: DataFrame, donors: DataFrame) -> DataFrame:
    """The rows with the text of their donor record; donors: (record, donor), or (record, language, donor)."""
    text = rows.groupBy(C("record").alias("donor"), "language").agg(F.min(F.when(F.trim("target_text") != "", C("target_text"))).alias("donor_text"))
    return rows.join(donors, [c for c in ("record", "language") if c in donors.columns]).join(text, ["donor", "language"]).where(F.length("donor_text") > 0)


def wrong_record_text(rows: DataFrame, donors: DataFrame) -> DataFrame:
    return with_donor(rows, donors).withColumn("target_text", C("donor_text")).drop("donor", "donor_text")


def unrelated_addition(rows: DataFrame, donors: DataFrame) -> DataFrame:
    return with_donor(rows, donors).withColumn("target_text", F.concat_ws(" ", "target_text", first_sentence(C("donor_text")))).drop("donor", "donor_text")


#: Types that need the rows only, by name: the generator and the checks or metrics it should move.
TYPES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "qa1_delete_triple": (delete_triple, "target_triple_parity"),
    "qa1_duplicate_triple": (duplicate_triple, "target_triple_parity"),
    "qa1_missing_text": (missing_text, "target_text_present"),
    "qa1_wrong_lid": (wrong_lid, "lexicalisation_id_alignment"),
    "qa1_duplicate_lid": (duplicate_lid, "lexicalisation_id_unique"),
    "qa1_placeholder_component": (placeholder_component, "target_rdf_well_formed"),
    "qa1_missing_component": (missing_component, "target_rdf_well_formed"),
    "qa1_source_markup": (source_markup, "target_rdf_well_formed"),
    "qa2_entity_substitution_triple": (entity_substitution, "text"),
    "qa2_predicate_substitution_triple": (predicate_substitution, "text"),
    "qa2_entity_substitution_text": (entity_substitution_text, "minimum_text_groundedness"),
    "benign_alternative_reference": (alternative_reference, ""),
    "qa2_structured_predicate_retention": (predicate_retention, "structured_predicate_review_flag"),
    "qa2_literal_text_only": (literal_text_only, "target_text_literal_retention"),
    "qa2_literal_both": (literal_both, "source_target_literal_preservation"),
    "qa2_omit_one_sentence": (omit_one_sentence, "minimum_triple_coverage"),
    "qa2_omit_to_first_sentence": (omit_to_first_sentence, "minimum_triple_coverage"),
    "qa2_unsupported_addition_plausible": (plausible_addition, "minimum_text_groundedness"),
    "qa3_full_english_copy": (full_copy, "full_english_copy_detected"),
    "qa3_english_clause_insertion": (clause_insertion, "code_switch"),
}


#: Types that need donors as well.
DONOR_TYPES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "qa2_wrong_record_text": wrong_record_text,
    "qa2_unsupported_addition_unrelated": unrelated_addition,
}


def variants(rows: DataFrame, names: list[str] | None = None, donors: DataFrame | None = None) -> DataFrame:
    """The clean rows and every chosen type's variants, with ``corruption_type`` and ``variant_id``; unchanged variants are dropped.

    Without ``names`` all types are made, with ``donors`` (record, donor) those of DONOR_TYPES too.
    """
    out = rows.withColumns({"corruption_type": F.lit("clean"), "variant_id": variant_id("clean", C("language"), C("record"), C("lid"), C("language"))})
    marked = rows.withColumn("_before", F.to_json(F.struct(*[c for c in rows.columns])))
    for name in names or [*TYPES, *(DONOR_TYPES if donors is not None else ())]:
        made = TYPES[name][0](marked) if name in TYPES else DONOR_TYPES[name](marked, donors)
        made = made.where(F.to_json(F.struct(*[c for c in rows.columns])) != C("_before")).select(*rows.columns)
        out = out.unionByName(
            made.withColumns({"corruption_type": F.lit(name), "variant_id": variant_id(name, C("language"), C("record"), C("lid"), C("language"))})
        )
    return out


def manifest_issues(manifest: DataFrame) -> DataFrame:
    """(rule, variant_id) of every variant that breaks a rule."""
    rules = {
        "blank_variant_id": F.coalesce(C("variant_id"), F.lit("")) == "",
        "blank_record": F.coalesce(C("record").cast("string"), F.lit("")) == "",
        "unknown_language": ~C("language").isin("es", "ca"),
        "unknown_type": ~C("corruption_type").isin("clean", *TYPES, *DONOR_TYPES),
        "missing_triples": C("target_triples").isNull(),
        "missing_source": F.size("source_triples") < 1,
    }
    broken = manifest.select("variant_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    twice = manifest.groupBy("variant_id").agg(F.count("*").alias("n")).where("n > 1").select("variant_id", F.lit("duplicate_variant_id").alias("rule"))
    return broken.unionByName(twice).select("rule", "variant_id")


def detection(checked: DataFrame, *by: str) -> DataFrame:
    """By corruption type: variants, and the share whose expected check fails."""
    expected = F.create_map(*[F.lit(x) for n, (_, c) in TYPES.items() if n.startswith("qa1_") for x in (n, c)])
    value = F.create_map(*[x for c in CHECKS for x in (F.lit(c), C(c))])
    detected = ~F.try_element_at(value, F.try_element_at(expected, C("corruption_type")))
    return checked.where(C("corruption_type").startswith("qa1_")).groupBy("corruption_type", *by).agg(
        F.count("*").alias("variants"), F.avg(F.coalesce(detected, F.lit(False)).cast("double")).alias("detection_rate")
    )


def inconsistent_mappings(components: DataFrame, keys: list[str], source: str, target: str, record: str, items: int = 20, least: int = 5, share: float = 0.3) -> DataFrame:
    """Rows of the most frequent items of each group with a share of their target forms changed by a suffix, and ``changed``.

    ``components`` are mapping rows; an item is a source component with at least ``least`` records, the
    ``items`` most frequent of each group (by number, then name) are taken, and a hash of record and item
    picks the rows to change.
    """
    counted = components.groupBy(*keys, source).agg(F.count_distinct(record).alias("_n")).where(C("_n") >= least)
    top = counted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), source))).where(C("_r") <= items).select(*keys, source)
    rows = components.join(top, [*keys, source])
    chosen = F.pmod(F.xxhash64(record, source), F.lit(1_000)) < int(share * 1_000)
    return rows.withColumn("changed", chosen).withColumn(target, F.when(C("changed"), F.concat(C(target), F.lit(" alt"))).otherwise(C(target)))


def benign_variation(components: DataFrame, keys: list[str], source: str, raw: str, record: str, items: int = 20, least: int = 5, share: float = 0.3) -> DataFrame:
    """As ``inconsistent_mappings``, with target forms changed only in case and blanks, which normalisation undoes; 0 as share gives the clean control."""
    made = inconsistent_mappings(components, keys, source, raw, record, items, least, share)
    plain = F.regexp_replace(raw, " alt$", "")
    return made.withColumn(raw, F.when(C("changed"), F.concat(F.lit(" "), F.upper(F.replace(plain, F.lit(" "), F.lit("_"))))).otherwise(C(raw)))


def consistency_detection(profile_before: DataFrame, profile_after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, harmed, detected): items whose mapping became inconsistent, by the review signal before and after."""
    a = profile_before.select(*keys, C("mapping_review_signal").alias("_a"))
    b = profile_after.select(*keys, C("mapping_review_signal").alias("_b"))
    return b.join(a, keys, "left").select(*keys, F.coalesce(~C("_a"), F.lit(False)).alias("consistent_before"), C("_b").alias("inconsistency_detected"))
