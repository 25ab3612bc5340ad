"""Language validity and leakage (QA3.1): a detector and the flags on its probabilities."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, IDF, Normalizer, RegexTokenizer, StringIndexer  # noqa: I001
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdfloom.functions.text import normalize_space, token_windows, tokens

CONFIDENCE, SHARE = 0.70, 0.25


def char_wb(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded with one blank on either side."""
    words = F.transform(F.filter(F.split(F.lower(normalize_space(text)), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(word: Column, n: int) -> Column:
        last = F.length(word) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>")
        )

    return F.flatten(F.transform(words, lambda w: F.concat(*[grams(w, n) for n in range(low, high + 1)])))


class Detector:
    """char_wb TF-IDF and multinomial logistic regression with balanced classes."""

    def __init__(self, stages: list, labels: list[str]) -> None:
        self.stages, self.labels = stages, labels

    @classmethod
    def fit(cls, texts: DataFrame, text: str, label: str, features: int = 60_000, least: int = 2, iterations: int = 40) -> Detector:
        """texts: a bounded training sample, rows (text, label); blank texts and NULL labels are left out."""
        known = texts.where(F.col(label).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(label).alias("label_text"), char_wb(F.col(text)).alias("grams"))
        index = StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc").fit(known)
        counts = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=features, minDF=least).fit(known)
        idf = IDF(inputCol="tf", outputCol="tfidf").fit(counts.transform(known))
        norm = Normalizer(inputCol="tfidf", outputCol="features")
        ready = norm.transform(idf.transform(counts.transform(index.transform(known))))
        sizes = {r["label"]: r["n"] for r in ready.groupBy("label").agg(F.count("*").alias("n")).collect()}
        total = sum(sizes.values())
        weights = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (float(k), total / (len(sizes) * n))])
        model = LogisticRegression(maxIter=iterations, regParam=1e-4, weightCol="w", family="multinomial").fit(ready.withColumn("w", weights[F.col("label")]))
        return cls([counts, idf, norm, model], list(index.labels))

    def probabilities(self, texts: DataFrame, text: str, output: str = "probabilities") -> DataFrame:
        """The rows with MAP<language, probability>."""
        out = texts.withColumn("grams", char_wb(F.col(text)))
        for stage in self.stages:
            out = stage.transform(out)
        p = vector_to_array("probability")
        return out.withColumn(output, F.map_from_arrays(F.array(*[F.lit(x) for x in self.labels]), p)).drop(
            "grams", "tf", "tfidf", "features", "rawPrediction", "probability", "prediction"
        )


def group_holdout(frame: DataFrame, key: str, share: float = 0.2, seed: str = "holdout") -> tuple[DataFrame, DataFrame]:
    """(training, holdout) rows, whole groups of a key by hash."""
    held = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return frame.where(~held), frame.where(held)


def predicted(probabilities: Column) -> Column:
    """STRUCT<language, confidence>: the most probable language, first in order among equals."""
    ranked = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    best = F.get(ranked, F.lit(0))
    return F.struct(best["k"].alias("language"), (-best["v"]).alias("confidence"))


def language_flags(rows: DataFrame, probabilities: str, expected: str, source: str, target: str, confidence: float = CONFIDENCE) -> DataFrame:
    """valid_target_language, wrong_language_detected and full_english_copy_detected for every row."""
    best = predicted(F.col(probabilities))
    return rows.withColumn("_b", best).withColumns({
        "predicted_language": F.col("_b.language"),
        "language_confidence": F.col("_b.confidence"),
        "valid_target_language": (F.col("_b.language") == F.col(expected)) & (F.try_element_at(F.col(probabilities), F.col(expected)) >= confidence),
        "wrong_language_detected": (F.col("_b.language") != F.col(expected)) & (F.col("_b.confidence") >= confidence),
        "full_english_copy_detected": normalize_space(F.col(target)) == normalize_space(F.col(source)),
    }).drop("_b")


def window_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, window_index, window_text) of the eligible token windows."""
    return rows.select(key, F.posexplode(token_windows(tokens(F.col(text)))).alias("window_index", "window_text"))


def code_switch(windows: DataFrame, key: str, p_english: Column, confidence: float = CONFIDENCE, share: float = SHARE) -> DataFrame:
    """(key, windows, english_window_share, code_switch): English in at least a quarter of the windows."""
    return windows.groupBy(key).agg(
        F.count("*").alias("windows"), F.avg((p_english >= confidence).cast("double")).alias("english_window_share")
    ).withColumn("code_switch", F.col("english_window_share") >= share)


def expected_known(detector_labels: list[str], rows: DataFrame, expected: str) -> DataFrame:
    """The rows, failing at run time if one expects a language the detector does not know."""
    known = F.col(expected).isin(detector_labels)
    return rows.withColumn(expected, F.when(known, F.col(expected)).otherwise(F.raise_error(F.concat(F.lit("unknown language "), F.coalesce(F.col(expected), F.lit("NULL"))))))


def smooth_idf(n: int, df: int) -> float:
    """The inverse document frequency the detector uses."""
    return math.log((n + 1) / (df + 1))


def language_status(flagged: DataFrame, *by: str) -> DataFrame:
    """By group: the shares of valid, wrong and uncertain language, the last being what the others leave."""
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    out = flagged.groupBy(*by).agg(F.count("*").alias("texts"), share("valid_target_language").alias("valid"), share("wrong_language_detected").alias("wrong"))
    return out.withColumn("uncertain", F.greatest(F.lit(0.0), 1 - F.col("valid") - F.col("wrong")))
