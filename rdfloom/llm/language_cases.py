"""Missing and wrong language labels of whole tables, and the languages of segments.

Defined results: NULL, blank and placeholder texts have no running text and give no row, and so do
responses that only repeat their prompt; a NULL id gives no row; rows that come twice count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdfloom.llm.langid import LEAST_WORDS, OTHER, OTHER_WORDS, LanguageModel, label_code, segments
from rdfloom.llm.pairs import is_copy, is_empty
from rdfloom.llm.textvec import chunks


def labelled_texts(frame: DataFrame, source: str, key: str, text: str, label: str, prompt: Column | None = None) -> DataFrame:
    """(source_table, row_key, code, text, prompt) of one table; code is NULL where the label is no language code."""
    return frame.select(
        F.lit(source).alias("source_table"),
        F.col(key).cast("string").alias("row_key"),
        label_code(F.col(label)).alias("code"),
        F.col(text).alias("text"),
        (F.lit(None).cast("string") if prompt is None else prompt).alias("prompt"),
    ).where(F.col("row_key").isNotNull() & (F.length(F.trim("text")) > 0))


def wrong_labels(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """(source_table, row_key, lang, confidence): the languages of every text whose label is missing or not the only one of them."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            rows = []
            found = known.languages(batch["text"].tolist())
            columns = (batch[c].tolist() for c in ("source_table", "row_key", "code", "text", "prompt"))
            for source, key, code, text, prompt, f in zip(*columns, found, strict=True):
                if code is not None and (f.held == [code] or len(f.held) == 1 and f.may_be(code)):
                    continue
                if is_empty(text) or prompt is not None and is_copy(prompt, text):
                    continue
                rows += [(source, key, language, p) for language, p in zip(f.held, f.sure, strict=True)]
            yield pd.DataFrame(rows, columns=["source_table", "row_key", "lang", "confidence"])

    return texts.mapInPandas(run, "source_table string, row_key string, lang string, confidence double").dropDuplicates(
        ["source_table", "row_key", "lang"]
    )


def segment_languages(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """(source_table, row_key, segment, begin, length, lang, confidence): every segment of running text with its language.

    ``begin`` counts characters from 0; neighbouring pieces of one language are one segment. A piece that fits none of
    the languages is ``und``, with the confidence of the best of them.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            content = batch["text"].tolist()
            sources, keys = batch["source_table"].tolist(), batch["row_key"].tolist()
            rows = []
            for low, high in chunks(content, 300_000):
                cut = segments(content[low:high])
                score, sure = known.scores(cut), known.confidence(cut)
                best = sure.argmax(1)
                other = (cut.words >= OTHER_WORDS) & (score.max(1) < known.floor) if len(best) else best
                last = None
                for k in range(len(best)):
                    if cut.words[k] < LEAST_WORDS:
                        continue
                    i = low + int(cut.text[k])
                    language, p = OTHER if other[k] else known.classes[best[k]], float(sure[k, best[k]])
                    if last and last[0] == i and last[5] == language:
                        last[4] = int(cut.end[k])
                        last[6] = max(last[6], p)
                        continue
                    number = last[2] + 1 if last and last[0] == i else 1
                    last = [i, None, number, int(cut.begin[k]), int(cut.end[k]), language, p]
                    rows.append(last)
            yield pd.DataFrame(
                [(sources[i], keys[i], n, b, e - b, language, p) for i, _, n, b, e, language, p in rows],
                columns=["source_table", "row_key", "segment", "begin", "length", "lang", "confidence"],
            )

    return texts.mapInPandas(
        run, "source_table string, row_key string, segment int, begin int, length int, lang string, confidence double"
    ).dropDuplicates(["source_table", "row_key", "segment"])
