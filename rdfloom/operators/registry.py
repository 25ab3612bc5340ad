"""Registries of machine translations: votes, latest entries, resumption and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rdfloom.functions.similarity import sequence_ratio
from rdfloom.functions.text import has_mojibake, normalize_space, parse_triple_line, safe_threshold, token_jaccard
from rdfloom.operators.statistics import knee_threshold


def latest_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the given columns, by one aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.`{c}`").alias(c) for c in rest]).select(*rows.columns)


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def similarities(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """The rows with ``_ij``, the sequence ratio of candidates i and j; rows that have them stay as they are."""
    if "_01" in rows.columns:
        return rows
    text = [normalize_space(F.col(c)) for c in candidates]
    return rows.withColumns({
        f"_{i}{j}": sequence_ratio(text[i], text[j]) for i in range(len(candidates)) for j in range(i + 1, len(candidates))
    })


def _without(made: DataFrame, rows: DataFrame) -> DataFrame:
    """The frame without similarities that its rows did not bring."""
    return made if "_01" in rows.columns else made.drop("_01", "_02", "_12")


def vote_details(rows: DataFrame, candidates: list[str], threshold: Column) -> DataFrame:
    """The three similarities, rounded to four places, and whether each pair agrees."""
    scored = similarities(rows, candidates)
    out = {}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        out[f"similarity_{i}{j}"] = F.round(f"_{i}{j}", 4)
        out[f"agree_{i}{j}"] = F.col(f"_{i}{j}") >= threshold
    return scored.withColumns(out).drop("_01", "_02", "_12")


def majority_vote(rows: DataFrame, candidates: list[str], threshold: Column, name: str = "voted") -> DataFrame:
    """Greedy vote of three candidates: clusters by similarity to their first member, the largest cluster's medoid,
    or the medoid of all where no two agree. Blank candidates do not vote; none gives ''."""
    a, b, c = (normalize_space(F.col(x)) for x in candidates)
    s01, s02, s12 = (F.col(x) for x in ("_01", "_02", "_12"))
    t = safe_threshold(threshold)
    scored = similarities(rows, candidates)
    has = [x != "" for x in (a, b, c)]
    near01, near02, near12 = has[0] & has[1] & (s01 >= t), has[0] & has[2] & (s02 >= t), has[1] & has[2] & (s12 >= t)
    mean = {
        0: F.when(has[0], 1 + F.when(has[1], s01).otherwise(0) + F.when(has[2], s02).otherwise(0)),
        1: F.when(has[1], 1 + F.when(has[0], s01).otherwise(0) + F.when(has[2], s12).otherwise(0)),
        2: F.when(has[2], 1 + F.when(has[0], s02).otherwise(0) + F.when(has[1], s12).otherwise(0)),
    }

    def medoid(*who: int) -> Column:
        best, value = None, None
        for i in who:
            best = F.coalesce(mean[i], F.lit(-1.0)) if best is None else F.greatest(best, F.coalesce(mean[i], F.lit(-1.0)))
        value = F.lit("")
        for i in reversed(who):
            value = F.when(F.coalesce(mean[i], F.lit(-1.0)) == best, (a, b, c)[i]).otherwise(value)
        return F.when(best < 0, "").otherwise(value)

    # the first member of a cluster is the earliest candidate; in a pair both are equally central
    vote = (
        F.when(near01 & near02, medoid(0, 1, 2)).when(near01, a).when(near02, a).when(near12, b).otherwise(medoid(0, 1, 2))
    )
    return _without(scored.withColumn(name, vote), rows)


def component_vote(rows: DataFrame, candidates: list[str], threshold: Column, penalty: float = 0.0, name: str = "voted") -> DataFrame:
    """Vote by connected components: a pair that agrees is alone in the choice; the most central wins, broken text costing a penalty."""
    text = [normalize_space(F.col(x)) for x in candidates]
    s = {(0, 1): F.col("_01"), (0, 2): F.col("_02"), (1, 2): F.col("_12")}
    t = safe_threshold(threshold)
    near = {k: v >= t for k, v in s.items()}
    edges = sum((v.cast("int") for v in near.values()), F.lit(0))
    bad = [F.when(has_mojibake(x), penalty).otherwise(0.0) for x in text]
    score = [s[0, 1] + s[0, 2] - bad[0], s[0, 1] + s[1, 2] - bad[1], s[0, 2] + s[1, 2] - bad[2]]

    def best(*who: int) -> Column:
        top = F.greatest(*[score[i] for i in who]) if len(who) > 1 else score[who[0]]
        out = text[who[-1]]
        for i in reversed(who[:-1]):
            out = F.when(score[i] == top, text[i]).otherwise(out)
        return out

    one = edges == 1
    vote = F.when(one & near[0, 1], best(0, 1)).when(one & near[0, 2], best(0, 2)).when(one & near[1, 2], best(1, 2)).otherwise(best(0, 1, 2))
    return _without(similarities(rows, candidates).withColumn(name, vote), rows)


def precedence(*sources: Column) -> Column:
    """The first source that is not blank: pass-through, label, alias, vote."""
    return F.coalesce(*[F.when(normalize_space(s) != "", s) for s in sources])


def rewrite_triples(entries: DataFrame, key: list[str], triples: str, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(key, triples) with every field replaced by its dictionary entry where there is one, order kept.

    entities and relations: (token, output). Joins by token, so a dictionary may be of any size.
    """
    parts = entries.select(*key, F.posexplode(triples).alias("_i", "_t")).withColumn("_x", parse_triple_line(F.col("_t")))
    kind = lambda k, f: f.select(F.lit(k).alias("_k"), F.col("token").alias("_token"), F.col("output").alias("_output"))
    dictionary = kind("e", entities).unionByName(kind("r", relations)).dropDuplicates(["_k", "_token"])
    fields = parts.select(*key, "_i", F.inline(F.array(*[
        F.struct(F.lit(n).alias("_n"), F.lit(k).alias("_k"), F.coalesce(F.col(f"_x.{f}"), F.lit("")).alias("_token")) for n, (k, f) in enumerate((("e", "s"), ("r", "p"), ("e", "o")))
    ])))
    named = fields.join(dictionary, ["_k", "_token"], "left").withColumn("_v", F.coalesce("_output", "_token"))
    lines = named.groupBy(*key, "_i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda s: s["_v"]), " | ").alias("_line"))
    return lines.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_line"))), lambda s: s["_line"]).alias(triples))


def registry_sync(lexicalisations: DataFrame, registry: DataFrame, key: list[str], text: str, final: str) -> DataFrame:
    """Texts after the registry's finals are applied, with what happened to each: updated, inserted, kept, unchanged."""
    joined = lexicalisations.select(*key, F.col(text).alias("_old")).join(registry.select(*key, F.col(final).alias("_new")), key, "full")
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return joined.select(*key, F.coalesce("_new", "_old").alias(text), action.alias("action"))


def text_pair_class(a: Column, b: Column, ratio: Column, near: float = 0.97) -> Column:
    """EXACT, EXACT_MINUS_PUNCT, NEAR_EXACT (by ratio or token Jaccard) or DIFFERENT."""
    x, y = normalize_space(a), normalize_space(b)
    bare = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), "(?U)[^\\w\\s]", ""), " +", " "))
    return F.when(x == y, "EXACT").when(bare(x) == bare(y), "EXACT_MINUS_PUNCT").when((ratio >= near) | (token_jaccard(x, y) >= near), "NEAR_EXACT").otherwise("DIFFERENT")


def distinct_components(entries: DataFrame, triples: str) -> DataFrame:
    """(kind, token, records): the entities and relations of all triples, and in how many triples each occurs."""
    parts = entries.select(F.explode(triples).alias("t")).select(parse_triple_line(F.col("t")).alias("x")).where("x is not null")
    rows = parts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"x.{f}").alias("token")) for k, f in (("entity", "s"), ("relation", "p"), ("entity", "o"))])))
    return rows.groupBy("kind", "token").agg(F.count("*").alias("records"))


def first_places(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def filtered_vote(rows: DataFrame, candidates: list[str], threshold: Column, rejected: list[Column], closeness: list[Column], old: Column, name: str = "voted") -> DataFrame:
    """Vote among the candidates that are not rejected (say, as English): of a pair that agrees the one closest to the source,
    else the closest of all left; equals go by centrality, then by order. Nothing left keeps the old value."""
    text = [normalize_space(F.col(x)) for x in candidates]
    t = safe_threshold(threshold)
    left = [(x != "") & ~F.coalesce(r, F.lit(False)) for x, r in zip(text, rejected, strict=True)]
    s = {(0, 1): F.col("_01"), (0, 2): F.col("_02"), (1, 2): F.col("_12")}
    near = {k: left[k[0]] & left[k[1]] & (v >= t) for k, v in s.items()}
    edges = sum((v.cast("int") for v in near.values()), F.lit(0))
    center = [F.when(left[1], s[0, 1]).otherwise(0) + F.when(left[2], s[0, 2]).otherwise(0), F.when(left[0], s[0, 1]).otherwise(0) + F.when(left[2], s[1, 2]).otherwise(0), F.when(left[0], s[0, 2]).otherwise(0) + F.when(left[1], s[1, 2]).otherwise(0)]
    paired = [F.when(edges == 1, near[0, 1] | near[0, 2]).otherwise(True), F.when(edges == 1, near[0, 1] | near[1, 2]).otherwise(True), F.when(edges == 1, near[0, 2] | near[1, 2]).otherwise(True)]
    options = F.array_compact(F.array(*[
        F.when(left[i] & paired[i], F.struct((-F.coalesce(closeness[i], F.lit(-1.0))).alias("a"), (-center[i]).alias("b"), F.lit(i).alias("c"), text[i].alias("v"))) for i in range(3)
    ]))
    best = F.get(F.array_sort(options), F.lit(0))
    return similarities(rows, candidates).withColumn(name, F.coalesce(best["v"], old)).drop("_01", "_02", "_12")


def parity(items: DataFrame, record: str, language: str, reference: str = "en") -> DataFrame:
    """(language, records, matching, match_rate): records whose number of items equals that of the reference language."""
    counted = items.groupBy(record, language).agg(F.count("*").alias("_n"))
    base = counted.where(F.col(language) == reference).select(record, F.col("_n").alias("_r"))
    others = items.where(F.col(language) != reference).select(language).distinct()
    every = base.crossJoin(F.broadcast(others)).join(counted, [record, language], "left")
    return every.groupBy(language).agg(F.count("*").alias("records"), F.count_if(F.col("_n") == F.col("_r")).alias("matching")).withColumn("match_rate", F.try_divide("matching", "records"))


def back_translation_diff(original: DataFrame, returned: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, status): how a text differs from its back translation, or which side is missing."""
    both = original.select(*keys, F.col(text).alias("_a")).join(returned.select(*keys, F.col(text).alias("_b")), keys, "full")
    status = F.when(F.col("_a").isNull(), "MISSING_ORIGINAL").when(F.col("_b").isNull(), "MISSING_RETURNED")
    return both.select(*keys, status.otherwise(text_pair_class(F.col("_a"), F.col("_b"), sequence_ratio(F.col("_a"), F.col("_b")))).alias("status"))


def quality_registry(scored: DataFrame, key: str, by: list[str], score: str, tail: float = 0.25) -> DataFrame:
    """(key, by, quality, threshold, kept): the best score of each key over its references, kept above the knee of the lower tail (strictly)."""
    best = scored.groupBy(key, *by).agg(F.max(score).alias("quality"))
    return best.join(knee_threshold(best, by, "quality", tail), by).withColumn("kept", F.col("quality") > F.col("threshold"))
