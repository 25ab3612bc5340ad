"""Queries on structure, mappings, joins and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rdfloom.functions import text as X
from rdfloom.operators import generation, integrity, mapping, preservation, registry, sampling, variation
from rdfloom.session import table

#: Normalised space and malformed components in SQL.
_NS = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x{{A0}}]+', ' ', 'g'))"
_BAD = (
    "(not regexp_full_match(" + _NS + ", '(?i)(?:<https?://[^>]+>|https?://\\S+)') and (" + _NS + " = '' or regexp_full_match(" + _NS + ", '(?i)(?:none|null|nan|n/?a|unknown|undefined)') or regexp_matches(" + _NS + ", '@[Ee][Nn]\\b|\\^\\^')))"
)
_ENTRIES = "(select distinct * from qa11_entries)"


def _field(triple: str, k: int) -> str:
    part = f"list_transform(string_split({triple}, '|'), lambda z: trim(z))"
    if k < 3:
        return f"(case when len({part}) >= 3 then {part}[{k}] else '' end)"
    return f"(case when len({part}) >= 3 then array_to_string({part}[3:], '|') else '' end)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qa11_entries").dropDuplicates(["record_key", "language"])


def entry_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.entry_integrity(_entries(spark, sf_dir)).select("record_key", "language", *integrity.CHECKS, "record_integrity", "source_declared_parity")


_INTEGRITY = f"""
select record_key, language,
  coalesce(expected_triple_count >= 0 and len(target_triples) = expected_triple_count, false) as target_triple_parity,
  len(target_texts) > 0 and len(list_filter(target_texts, lambda x: {_NS.format('x')} = '')) = 0 as target_text_present,
  len(english_lids) > 0 and list_sort(list_distinct(list_transform(english_lids, lambda x: {_NS.format('x')}))) = list_sort(list_distinct(list_transform(target_lids, lambda x: {_NS.format('x')}))) as lexicalisation_id_alignment,
  len(target_lids) > 0 and len(list_filter(target_lids, lambda x: {_NS.format('x')} = '')) = 0 and len(list_distinct(list_transform(target_lids, lambda x: {_NS.format('x')}))) = len(target_lids) as lexicalisation_id_unique,
  len(target_triples) > 0 and len(list_filter(target_triples, lambda x: {_BAD.format(_field('x', 1))} or {_BAD.format(_field('x', 2))} or {_BAD.format(_field('x', 3))})) = 0 as target_rdf_well_formed,
  case when declared_size_valid then len(source_triples) = declared_size end as source_declared_parity
from {_ENTRIES}"""
_CHECKED = f"(select *, target_triple_parity and target_text_present and lexicalisation_id_alignment and lexicalisation_id_unique and target_rdf_well_formed as record_integrity from ({_INTEGRITY}))"


def integrity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = integrity.integrity_summary(integrity.entry_integrity(_entries(spark, sf_dir)), "language")
    return out.select("language", "entries", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


def integrity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.integrity_risk(integrity.entry_integrity(_entries(spark, sf_dir))).select("record_key", "language", "failed_checks", "automatic_risk")


def component_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.component_rows(_entries(spark, sf_dir), "record_key", "language").where("source_normalized <> '' and target_normalized <> ''")


_LABEL = "lower(trim(regexp_replace(replace(regexp_replace(" + _NS + ", '@[A-Za-z-]+\\s*$', ''), '_', ' '), '\\s+', ' ', 'g'), ' \t\n\r\"'''))"
_COMPONENTS = f"""
with e as (select record_key, language, source_triples, target_triples from {_ENTRIES} where len(source_triples) = len(target_triples) and len(target_triples) = expected_triple_count),
p as (select record_key, language, i - 1 as triple_index, source_triples[i] as a, target_triples[i] as b from e, unnest(range(1, len(source_triples) + 1)) as t(i)),
c as (
  select record_key, language, triple_index, 'subject' as role, 'entity_or_value' as component_type, {_field('a', 1)} as source_raw, {_field('b', 1)} as target_raw from p
  union all select record_key, language, triple_index, 'predicate', 'predicate', {_field('a', 2)}, {_field('b', 2)} from p
  union all select record_key, language, triple_index, 'object', 'entity_or_value', {_field('a', 3)}, {_field('b', 3)} from p),
r as (select *, {_LABEL.format('source_raw')} as source_normalized, {_LABEL.format('target_raw')} as target_normalized from c)"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.component_rows(_entries(spark, sf_dir), "record_key", "language")
    return mapping.mapping_profile(rows, ["language", "component_type", "source_normalized"], "target_normalized", "source_raw")


def mapping_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).select(
        "language", "component_type", "source_normalized", "occurrences", "target_form_count", "dominant_target_form", "dominant_target_count",
        F.round("dominant_mapping_rate", 9).alias("dominant_mapping_rate"), "mapping_review_signal",
    )


_PROFILE = f"""{_COMPONENTS},
f as (select language, component_type, source_normalized, target_normalized, count(*) as n from r where source_normalized <> '' and target_normalized <> '' group by 1, 2, 3, 4),
q as (select language, component_type, source_normalized, sum(n)::bigint as occurrences, count(*) as target_form_count,
  arg_min(target_normalized, struct_pack(a := -n, b := target_normalized)) as dominant_target_form, max(n) as dominant_target_count from f group by 1, 2, 3 having sum(n) >= 2)"""


def mapping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapping.mapping_summary(_profile(spark, sf_dir), "language", "component_type")
    return out.withColumns({c: F.round(c, 9) for c in ("weighted_dominant_rate", "review_rate")})


def mapping_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.mapping_risk(_profile(spark, sf_dir)).where("mapping_review_signal").select("language", "component_type", "source_normalized", "occurrences", "automatic_risk")


def supplier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey")
    return mapping.mapping_profile(rows, ["l_partkey"], "l_suppkey").select(
        "l_partkey", "occurrences", "target_form_count", "dominant_target_form", "dominant_target_count", F.round("dominant_mapping_rate", 9).alias("dominant_mapping_rate")
    )


def mapping_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.component_rows(_entries(spark, sf_dir), "record_key", "language").where("component_type = 'predicate' and source_normalized <> ''")
    return mapping.context_examples(rows, ["language", "source_normalized"], "target_normalized", "record_key")


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples with the code their label names as ``lang``, whatever its spelling."""
    return table(spark, sf_dir, "examples").withColumn("lang", X.label_code(F.col("lang")))


def outer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _examples(spark, sf_dir).dropDuplicates(["example_id"]).where(F.col("target").isNotNull())
    keys = ["split", "bucket", "xml_file", "eid", "lid"]
    return variation.outer_align(rows.where("lang = 'en'"), rows.where("lang = 'ca'"), keys, "target")


def comparison_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "verbalisation_registry", F.concat_ws("::", "xml_path", "eid").alias("record"), F.col("source_lid").alias("lid"), F.col("source_en").alias("text"))
    return variation.comparison_reference(rows, "record", "lid", "text")


def donor_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variation.donor_select(_entries(spark, sf_dir), "record_key", "expected_triple_count", "category")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "verbalisation_registry", "xml_path", "eid", "source_lid", F.upper("status").alias("status"), "processed_at", "final_ca").distinct()
    return registry.latest_per_key(rows, ["xml_path", "eid", "source_lid"], "processed_at", "status", "final_ca")


def pending_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "verbalisation_registry", "xml_path", "eid", "source_lid", F.upper("status").alias("status"))
    return registry.pending(rows, rows.where("status = 'OK'"), ["xml_path", "eid", "source_lid"]).distinct()


def vote_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "verbalisation_registry").drop("loaded_at").distinct()
    t = X.safe_threshold(F.col("vote_threshold"))
    return rows.where(F.col("sim_nllb_madlad").isNotNull()).groupBy("category").agg(
        F.count("*").alias("rows"), F.count_if(F.col("sim_nllb_madlad") >= t).alias("nllb_madlad"), F.count_if(F.col("sim_nllb_salamandra") >= t).alias("nllb_salamandra"),
        F.count_if(F.col("sim_madlad_salamandra") >= t).alias("madlad_salamandra"),
    )


def distinct_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.distinct_components(_entries(spark, sf_dir).where("language = 'ca'"), "source_triples")


def triple_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "qa12_variable_mappings", "language", "component_type", "source_example", "dominant_target_form").where("language = 'ca' and source_example is not null and dominant_target_form is not null")
    pick = lambda kind: known.where(F.col("component_type") == kind).groupBy(F.col("source_example").alias("token")).agg(F.min("dominant_target_form").alias("output"))
    rows = _entries(spark, sf_dir).where("language = 'ca'").select("record_key", "source_triples")
    return registry.rewrite_triples(rows, ["record_key"], "source_triples", pick("entity_or_value"), pick("predicate")).select("record_key", F.array_join("source_triples", "\n").alias("rewritten"))


def registry_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["xml_path", "eid", "lid"]
    lex = _examples(spark, sf_dir).where("lang = 'ca' and target is not null").select(F.concat_ws("/", "split", "bucket", "xml_file").alias("xml_path"), "eid", "lid", "target").groupBy(*key).agg(F.min("target").alias("text"))
    done = table(spark, sf_dir, "verbalisation_registry").where("upper(status) = 'OK' and final_ca is not null").select("xml_path", "eid", F.col("source_lid").alias("lid"), "final_ca", "processed_at").groupBy(*key).agg(F.max_by("final_ca", F.struct("processed_at", "final_ca")).alias("final_ca"))
    return registry.registry_sync(lex, done, key, "text", "final_ca").groupBy("action").agg(F.count("*").alias("rows"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "verbalisation_registry", "xml_path", "eid", "source_lid", "processed_at", "ca_nllb", "ca_madlad").where("ca_nllb is not null and ca_madlad is not null").distinct()
    return rows.select("xml_path", "eid", "source_lid", "processed_at", F.round(X.token_jaccard(F.regexp_replace("ca_nllb", "[^ -~]", ""), F.regexp_replace("ca_madlad", "[^ -~]", "")), 9).alias("jaccard"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cases", "case_id", "target_text", "english_text", "record_or_component").dropDuplicates(["case_id"])
    return rows.select(
        "case_id", X.normalize_space(F.col("english_text")).alias("plain"), F.size(X.textual_units(F.col("english_text"))).alias("units"),
        F.size(X.tokens(F.col("english_text"))).alias("tokens"), F.size(X.token_windows(X.tokens(F.col("english_text")))).alias("windows"),
        X.split_camel_case(F.col("record_or_component")).alias("words"), X.to_triple_token(F.col("record_or_component")).alias("token"),
        X.case_hash(F.col("case_id")).alias("digest"),
    )


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cases", "case_id", "english_text").dropDuplicates(["case_id"])
    return rows.select("case_id", F.posexplode(X.token_windows(X.tokens(F.col("english_text")))).alias("window_index", "window_text"))


def triple_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir).select("record_key", "language", F.posexplode("target_triples").alias("i", "t"))
    s = X.split_triple(F.col("t"))
    return rows.select("record_key", "language", "i", s["s"].alias("s"), s["p"].alias("p"), s["o"].alias("o"), X.is_camel_case(s["p"]).alias("camel"), X.is_malformed_component(s["o"]).alias("malformed"))


def predicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.col("source_triples"), F.col("target_triples")
    return _entries(spark, sf_dir).select(
        "record_key", "language", preservation.alignment_valid(s, t).alias("alignment_valid"), preservation.structured_predicate_kept(s, t).alias("structured_predicate_kept")
    )


def expansion_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cases", "case_id", "subqa", "english_text", "target_text").dropDuplicates(["case_id"]).where("english_text <> '' and target_text <> ''")
    r = rows.select("subqa", variation.expansion_ratio(F.col("target_text"), F.col("english_text")).alias("r"))
    return r.groupBy("subqa").agg(F.count("*").alias("texts"), F.round(F.avg("r"), 8).alias("mean"), F.round(F.median("r"), 8).alias("median"), F.round(F.stddev_samp("r"), 8).alias("deviation"))


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "examples", "example_id", "split", "bucket", "xml_file", "eid", "lid", "lang", "prompt", "target").dropDuplicates(["example_id"]).where("prompt is not null and target is not null")
    return generation.training_set(rows).select("example_id", "align_key", F.length("prompt").alias("prompt_characters"))


def generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "examples", "example_id", "split", "category", "target").dropDuplicates(["example_id"])
    return generation.generation_report(rows, "split", "category")


def in_all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _examples(spark, sf_dir).dropDuplicates(["example_id"]).where("lang in ('en', 'es', 'ca')")
    key = F.concat_ws("|||", "split", "category", "eid").alias("align")
    return sampling.in_all_languages(rows.select("example_id", "lang", key), "align", "lang", 3)


_CASES = "(select distinct * exclude (loaded_at) from cases)"
_EX = "(select distinct * exclude (loaded_at) from examples)"
#: The examples with the code that a label names, by the definition of ``label_code``.
_BASE = "string_split_regex(regexp_replace(lower(lang), '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g'), '[-_ .@]')[1]"
_CODE = "case " + " ".join(f"when {_BASE} in ({', '.join(repr(x) for x in spellings)}) then '{code}'" for code, spellings in X.SPELLINGS.items()) + " end"
_EXL = f"(select * replace ({_CODE} as lang) from {_EX})"
_TOKENS = "case when " + _NS + " = '' then [] else string_split(" + _NS + ", ' ') end"

QUERIES = {
    "entry_integrity": entry_integrity, "integrity_summary": integrity_summary, "integrity_risk": integrity_risk, "component_rows": component_rows, "mapping_profile": mapping_profile,
    "mapping_summary": mapping_summary, "mapping_review": mapping_review, "supplier_profile": supplier_profile, "mapping_examples": mapping_examples, "outer_align": outer_align,
    "comparison_reference": comparison_reference, "donor_select": donor_select, "latest_per_key": latest_per_key, "pending_keys": pending_keys, "vote_agreement": vote_agreement,
    "distinct_components": distinct_components, "triple_rewrite": triple_rewrite, "registry_sync": registry_sync, "jaccard_pairs": jaccard_pairs, "text_functions": text_functions,
    "token_windows": token_windows, "triple_fields": triple_fields, "predicate_flags": predicate_flags, "expansion_ratio": expansion_ratio, "training_set": training_set,
    "generation_report": generation_report, "in_all_languages": in_all_languages,
}

ORACLE = {
    "entry_integrity": f"select record_key, language, target_triple_parity, target_text_present, lexicalisation_id_alignment, lexicalisation_id_unique, target_rdf_well_formed, record_integrity, source_declared_parity from {_CHECKED}",
    "integrity_summary": f"select language, count(*) as entries, " + ", ".join(f"round(avg({c}::int), 9) as {c}_rate" for c in (*integrity.CHECKS, "record_integrity", "source_declared_parity")) + f" from {_CHECKED} group by 1",
    "integrity_risk": f"select record_key, language, f as failed_checks, case when f >= 2 or not lexicalisation_id_alignment or not target_rdf_well_formed then 'High' when f = 1 then 'Medium' else 'Low' end as automatic_risk from (select *, " + " + ".join(f"(not {c})::int" for c in integrity.CHECKS) + f" as f from {_CHECKED})",
    "component_rows": f"{_COMPONENTS} select record_key, language, triple_index::int as triple_index, role, component_type, source_raw, target_raw, source_normalized, target_normalized from r where source_normalized <> '' and target_normalized <> ''",
    "mapping_profile": f"{_PROFILE} select *, round(dominant_target_count / occurrences, 9) as dominant_mapping_rate, target_form_count > 1 as mapping_review_signal from q",
    "mapping_summary": f"{_PROFILE} select language, component_type, count(*) as recurring_items, sum(occurrences)::bigint as observations, round(sum(dominant_target_count) / sum(occurrences), 9) as weighted_dominant_rate, sum((target_form_count > 1)::int)::bigint as review_items, round(avg((target_form_count > 1)::int), 9) as review_rate from q group by 1, 2",
    "mapping_review": f"{_PROFILE} select language, component_type, source_normalized, occurrences, case when dominant_target_count / occurrences < 0.9 then 'High' else 'Medium' end as automatic_risk from q where target_form_count > 1",
    "supplier_profile": "with f as (select l_partkey, l_suppkey, count(*) as n from lineitem group by 1, 2) select l_partkey, sum(n)::bigint as occurrences, count(*) as target_form_count, arg_min(l_suppkey, struct_pack(a := -n, b := l_suppkey)) as dominant_target_form, max(n) as dominant_target_count, round(max(n) / sum(n), 9) as dominant_mapping_rate from f group by 1 having sum(n) >= 2",
    "mapping_examples": f"{_COMPONENTS}, v as (select language, source_normalized, target_normalized, min(record_key) as o from r where component_type = 'predicate' and source_normalized <> '' group by 1, 2, 3), k as (select *, row_number() over (partition by language, source_normalized order by o, target_normalized) as rn from v) select language, source_normalized, string_agg(target_normalized, '; ' order by rn) as examples from k where rn <= 4 group by 1, 2",
    "outer_align": f"with e as (select * from {_EXL} where target is not null), a as (select split, bucket, xml_file, eid, lid, min(target) as source_text from e where lang = 'en' group by all), b as (select split, bucket, xml_file, eid, lid, min(target) as target_text, count(*) as n from e where lang = 'ca' group by all) select split, bucket, xml_file, eid, lid, source_text, target_text, coalesce(n, 0) > 1 as duplicate_target from a full join b using (split, bucket, xml_file, eid, lid)",
    "comparison_reference": f"with f as (select xml_path || '::' || eid as record, source_lid as lid, min(source_en) as t from verbalisation_registry where {_NS.format('source_lid')} <> '' and {_NS.format('source_en')} <> '' group by 1, 2) select f.record, f.lid, o.lid as comparison_lid, o.t as comparison_text from f left join lateral (select g.lid, g.t from f g where g.record = f.record and g.lid <> f.lid order by g.lid, g.t limit 1) o on true",
    "donor_select": """with k as (select distinct record_key as r, expected_triple_count as e, category as c, sha256('donor|' || record_key) as h from qa11_entries),
q as (select *, ('0x' || substr(h, 1, 4))::int % 64 as b from k),
na as (select e, b, arg_min(r, h) as r, arg_min(c, h) as c from q group by 1, 2), nb as (select q.e, q.b, arg_min(q.r, h) as r, arg_min(q.c, h) as c from q join na using (e, b) where q.c <> na.c group by 1, 2),
sa as (select e, arg_min(r, h) as r, arg_min(c, h) as c from q group by 1), sb as (select q.e, arg_min(q.r, h) as r, arg_min(q.c, h) as c from q join sa using (e) where q.c <> sa.c group by 1),
sc as (select q.e, arg_min(q.r, h) as r from q join sa using (e) where q.r <> sa.r group by 1), ea as (select arg_min(r, h) as r from q), ec as (select arg_min(q.r, h) as r from q, ea where q.r <> ea.r)
select q.r as record_key, coalesce(case when na.c <> q.c then na.r end, case when nb.c <> q.c then nb.r end, case when sa.c <> q.c then sa.r end, case when sb.c <> q.c then sb.r end,
  case when sa.r <> q.r then sa.r end, case when sc.r <> q.r then sc.r end, case when ea.r <> q.r then ea.r end, case when ec.r <> q.r then ec.r end) as donor
from q left join na using (e, b) left join nb using (e, b) left join sa using (e) left join sb using (e) left join sc using (e) cross join ea left join ec on true""",
    "latest_per_key": "with r as (select distinct xml_path, eid, source_lid, upper(status) as status, processed_at, final_ca from verbalisation_registry) select xml_path, eid, source_lid, status, processed_at, final_ca from r qualify row_number() over (partition by xml_path, eid, source_lid order by processed_at desc nulls last, status desc nulls last, final_ca desc nulls last) = 1",
    "pending_keys": "with r as (select distinct xml_path, eid, source_lid, upper(status) as status from verbalisation_registry) select * from r where not exists (select 1 from r d where d.status = 'OK' and d.xml_path = r.xml_path and d.eid = r.eid and d.source_lid = r.source_lid)",
    "vote_agreement": "with r as (select distinct * exclude (loaded_at), case when vote_threshold > 0 and vote_threshold <= 1 then vote_threshold else 0.9 end as t from verbalisation_registry where sim_nllb_madlad is not null) select category, count(*) as rows, count(*) filter (sim_nllb_madlad >= t) as nllb_madlad, count(*) filter (sim_nllb_salamandra >= t) as nllb_salamandra, count(*) filter (sim_madlad_salamandra >= t) as madlad_salamandra from r group by 1",
    "distinct_components": f"with t as (select unnest(source_triples) as t from {_ENTRIES} where language = 'ca'), s as (select case when len(string_split(t, ' | ')) >= 3 then ' | ' else '|' end as d, t from t), f as (select trim(string_split(t, d)[1]) as a, trim(string_split(t, d)[2]) as b, trim(case when d = '|' then array_to_string(string_split(t, '|')[3:], '|') else array_to_string(string_split(t, ' | ')[3:], ' | ') end) as c from s where len(string_split(t, d)) >= 3) select kind, token, count(*) as records from (select 'entity' as kind, a as token from f union all select 'relation', b from f union all select 'entity', c from f) group by 1, 2",
    "triple_rewrite": f"with e as (select record_key, source_triples from {_ENTRIES} where language = 'ca'), p as (select record_key, i, source_triples[i] as t from e, unnest(range(1, len(source_triples) + 1)) as u(i)), s as (select *, case when len(string_split(t, ' | ')) >= 3 then ' | ' else '|' end as d from p), f as (select record_key, i, coalesce(case when len(string_split(t, d)) >= 3 then trim(string_split(t, d)[1]) end, '') as a, coalesce(case when len(string_split(t, d)) >= 3 then trim(string_split(t, d)[2]) end, '') as b, coalesce(case when len(string_split(t, d)) >= 3 then trim(case when d = '|' then array_to_string(string_split(t, '|')[3:], '|') else array_to_string(string_split(t, ' | ')[3:], ' | ') end) end, '') as c from s), m as (select component_type, source_example, min(dominant_target_form) as o from qa12_variable_mappings where language = 'ca' group by 1, 2) select record_key, string_agg(coalesce(x.o, a) || ' | ' || coalesce(y.o, b) || ' | ' || coalesce(z.o, c), chr(10) order by i) as rewritten from f left join m x on x.component_type = 'entity_or_value' and x.source_example = a left join m y on y.component_type = 'predicate' and y.source_example = b left join m z on z.component_type = 'entity_or_value' and z.source_example = c group by 1",
    "registry_sync": f"with l as (select split || '/' || bucket || '/' || xml_file as xml_path, eid, lid, min(target) as o from {_EXL} where lang = 'ca' and target is not null group by all), r as (select xml_path, eid, source_lid as lid, arg_max(final_ca, struct_pack(a := processed_at, b := final_ca)) as n from verbalisation_registry where upper(status) = 'OK' and final_ca is not null group by all) select case when n is null then 'kept' when o is null then 'inserted' when o = n then 'unchanged' else 'updated' end as action, count(*) as rows from l full join r using (xml_path, eid, lid) group by 1",
    "jaccard_pairs": "with r as (select distinct xml_path, eid, source_lid, processed_at, regexp_replace(ca_nllb, '[^ -~]', '', 'g') as x, regexp_replace(ca_madlad, '[^ -~]', '', 'g') as y from verbalisation_registry where ca_nllb is not null and ca_madlad is not null), t as (select *, list_distinct(list_filter(string_split(trim(regexp_replace(lower(x), '[^\\w\\s]+', ' ', 'g')), ' '), lambda w: w <> '')) as a, list_distinct(list_filter(string_split(trim(regexp_replace(lower(y), '[^\\w\\s]+', ' ', 'g')), ' '), lambda w: w <> '')) as b from r) select xml_path, eid, source_lid, processed_at, round(case when len(a) + len(b) = 0 then 1.0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end, 9) as jaccard from t",
    "text_functions": f"select case_id, {_NS.format('english_text')} as plain, len(list_filter(string_split(regexp_replace({_NS.format('english_text')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::int as units, len({_TOKENS.format('english_text')})::int as tokens, len(list_filter(range(0, len({_TOKENS.format('english_text')}), 8), lambda i: least(10, len({_TOKENS.format('english_text')}) - i) >= 6))::int as windows, regexp_replace(record_or_component, '([a-zà-ÿ])([A-ZÀ-Ý])', '\\1 \\2', 'g') as words, regexp_replace(trim(record_or_component), '\\s+', '_', 'g') as token, substr(sha256(case_id), 1, 12) as digest from {_CASES}",
    "token_windows": f"with t as (select case_id, {_TOKENS.format('english_text')} as w from {_CASES}), s as (select case_id, w, unnest(list_filter(range(0, len(w), 8), lambda i: least(10, len(w) - i) >= 6)) as i from t) select case_id, (i / 8)::int as window_index, array_to_string(w[i + 1 : i + 10], ' ') as window_text from s",
    "triple_fields": f"with t as (select record_key, language, i - 1 as i, target_triples[i] as t from {_ENTRIES}, unnest(range(1, len(target_triples) + 1)) as u(i)), f as (select record_key, language, i::int as i, {_field('t', 1)} as s, {_field('t', 2)} as p, {_field('t', 3)} as o from t) select *, regexp_matches(p, '[a-zà-ÿ][A-Z]') as camel, {_BAD.format('o')} as malformed from f",
    "predicate_flags": f"with e as (select record_key, language, list_transform(source_triples, lambda t: {_field('t', 2)}) as a, list_transform(target_triples, lambda t: {_field('t', 2)}) as b from {_ENTRIES}), v as (select *, coalesce(len(a) = len(b) and len(a) > 0 and len(list_filter(a, lambda x: {_LABEL.format('x')} = '')) = 0 and len(list_filter(b, lambda x: {_LABEL.format('x')} = '')) = 0, false) as ok from e) select record_key, language, ok as alignment_valid, case when ok then len(list_filter(range(1, len(a) + 1), lambda i: {_LABEL.format('a[i]')} = {_LABEL.format('b[i]')} and regexp_matches(a[i], '[a-zà-ÿ][A-Z]'))) > 0 end as structured_predicate_kept from v",
    "expansion_ratio": f"with r as (select subqa, len({_TOKENS.format('target_text')}) / greatest(len({_TOKENS.format('english_text')}), 1) as r from {_CASES} where english_text <> '' and target_text <> '') select subqa, count(*) as texts, round(avg(r), 8) as mean, round(median(r), 8) as median, round(stddev_samp(r), 8) as deviation from r group by 1",
    "training_set": f"select example_id, concat_ws('|', coalesce(split, ''), coalesce(bucket, ''), coalesce(xml_file, ''), coalesce(eid, ''), coalesce(lid, ''), coalesce(lang, '')) as align_key, length(prompt)::int as prompt_characters from {_EX} where prompt is not null and target is not null",
    "generation_report": f"select split, category, count(*) as rows, count(*) filter ({_NS.format('target')} <> '') as non_empty from {_EX} group by 1, 2",
    "in_all_languages": f"with r as (select example_id, lang, split || '|||' || category || '|||' || eid as align from {_EXL} where lang in ('en', 'es', 'ca')) select * from r where align in (select align from r group by 1 having count(distinct lang) >= 3)",
}
