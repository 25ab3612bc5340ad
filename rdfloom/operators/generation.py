"""Prompts, training sets and the evaluation of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdfloom.functions.similarity import bleu, bleu_counts, chrf_pp, meteor_exact, rouge_l, sentence_bleu
from rdfloom.functions.text import align_key, normalize_space


def prompt(instruction: Column, triples: Column, shots: Column | None = None) -> Column:
    """Instruction, worked examples if any, and the triples, one a line."""
    lines = F.array_join(F.transform(triples, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.concat_ws("\n\n", *([instruction, shots, lines] if shots is not None else [instruction, lines]))


def messages(prompt_text: Column, answer: Column | None = None) -> Column:
    """Chat messages as JSON."""
    user = F.struct(F.lit("user").alias("role"), prompt_text.alias("content"))
    turns = [user] if answer is None else [user, F.struct(F.lit("assistant").alias("role"), answer.alias("content"))]
    return F.to_json(F.array(*turns))


def training_set(pairs: DataFrame, quality: str | None = None, threshold: float | None = None) -> DataFrame:
    """Pairs with an alignment key and messages, above a quality threshold (strictly) where one is given."""
    kept = pairs if quality is None else pairs.where(F.col(quality) > threshold)
    parts = ["split", "bucket", "xml_file", "eid", "lid", "lang"]
    return kept.withColumns({"align_key": align_key(*[F.col(p) for p in parts]), "messages": messages(F.col("prompt"), F.col("target"))})


def length_bucketed(rows: DataFrame, *by: str, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by the given columns, so batches hold like lengths."""
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def reference_scores(candidates: DataFrame, references: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """(key, scores): the best of each metric over the references of a candidate; BLEU over all of them together.

    Blank candidates and references are left out.
    """
    usable = candidates.where(normalize_space(F.col(candidate)) != "")
    known = references.where(normalize_space(F.col(reference)) != "").select(key, reference)
    pairs = usable.join(known, key)
    ratio = F.length(candidate) / F.greatest(F.length(reference), F.lit(1))
    scored = pairs.withColumns({"rouge_l": rouge_l(F.col(candidate), F.col(reference)), "chrf_pp": chrf_pp(F.col(candidate), F.col(reference)), "meteor_exact": meteor_exact(F.col(candidate), F.col(reference)), "_r": ratio})
    best = scored.groupBy(key, candidate).agg(
        F.max("rouge_l").alias("rouge_l"), F.max("chrf_pp").alias("chrf_pp"), F.max("meteor_exact").alias("meteor_exact"),
        F.min_by("_r", F.struct(F.abs(F.col("_r") - 1), F.col(reference))).alias("expansion_ratio"), F.array_sort(F.collect_list(reference)).alias("_refs"),
    )
    return best.withColumns({"sentence_bleu": sentence_bleu(F.col(candidate), F.col("_refs")), "bleu_counts": bleu_counts(F.col(candidate), F.col("_refs"))}).drop("_refs")


def corpus_bleu(scores: DataFrame, *by: str) -> DataFrame:
    """(by, n, corpus_bleu) from the summed n-gram counts of the segments."""
    total = scores.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("bleu_counts")[i]) for i in range(10)]).alias("c"))
    return total.select(*by, "n", bleu(F.col("c")).alias("corpus_bleu"))


def summaries(scores: DataFrame, first: str, second: str, metrics: list[str]) -> DataFrame:
    """Means at three levels, (), (first) and (first, second), by grouping sets in one pass; NULL marks a total."""
    return scores.rollup(first, second).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def generation_report(rows: DataFrame, *by: str, answer: str = "target") -> DataFrame:
    """Rows and non-blank answers by group."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(normalize_space(F.col(answer)) != "").alias("non_empty"))


def type_token_ratio(words: Column) -> Column:
    """Distinct per all tokens, lower case; NULL for none."""
    return F.try_divide(F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))), F.size(words))


def gap(a: Column, b: Column) -> Column:
    """Difference in per cent of the first; NULL where that is 0."""
    return F.try_divide(100.0 * (b - a), a)
