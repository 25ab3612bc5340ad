"""Records of evaluation splits that occur again, exactly or almost, in the training split.

Two records overlap if they state the same set of facts and their texts are the same up to small
differences in wording, order, case, accents and marks. The set of facts partitions the records;
inside a partition the hashed word bigrams of the evaluation records are matched against those of
the training records, and the containment of the smaller in the larger decides.

Bigrams and a containment of 0.7 instead of five-word shingles and 0.8: the wanted pairs differ by
single words and by the order of whole sentences, and short texts would lose most of their longer
shingles to one such difference, while equal facts already bound what is compared.

Copies are compared once: texts with the same words in the same order are one class, classes are
compared, and pairs of records follow from pairs of classes. Candidates come from a prefix filter
that loses no pair (of n bigrams, n - ceil(0.7 n) + 1 of the rarest must meet the other's), keyed by
facts and bigram, so one set of facts that a third of all rows share is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdfloom.operators.packed import triple_items
from rdfloom.session import cut

CONTAINMENT = 0.7
_FROM = "áàâäãåāéèêëēíìîïīóòôöõøōúùûüūýÿçñß"
_TO = "aaaaaaaeeeeeiiiiiooooooouuuuuyycns"
#: Months without accents; a text that names another month states another date.
MONTHS = (
    "january february march april may june july august september october november december enero febrero marzo abril mayo junio julio agosto "
    "septiembre octubre noviembre diciembre gener febrer marc maig juny juliol agost setembre octubre novembre desembre janvier fevrier mars avril "
    "mai juin juillet aout septembre octobre novembre decembre"
).split()
#: Function words that values hold too.
SMALL = ["the", "and", "del", "las", "los", "les", "dels", "des", "sur", "con", "amb", "for", "per", "por"]


def plain(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.regexp_replace(F.lower(text), "\\p{Mn}+", ""), _FROM, _TO)


def fact_set(triples: Column) -> Column:
    """Sorted distinct facts of a packed field, without case, accents, quotes and underscores."""
    one = lambda t: F.trim(F.regexp_replace(F.regexp_replace(plain(t), "[\"'“”«»‘’`_\\s]+", " "), "\\s*\\|\\s*", "|"))
    return F.array_sort(F.array_distinct(F.transform(triple_items(triples), one)))


def coarse_key(triples: Column) -> Column:
    """A hash of the distinct words of three characters or more in a packed field.

    Fields that hold equal facts have equal keys: packings differ in marks, list numbers and tags only,
    which are shorter, and in escapes, which are resolved first where there are any.
    """
    text = F.when(triples.contains("\\"), F.array_join(triple_items(triples), "\n")).otherwise(triples)
    bare = F.regexp_replace(F.translate(text, "_", " "), "(?m)(?:^|(?<=\\s))\\(?\\d{1,3}[.)](?=\\s)", " ")
    return F.xxhash64(F.array_sort(F.array_distinct(F.regexp_extract_all(plain(bare), F.lit("[\\p{L}\\p{N}]{3,}"), F.lit(0)))))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(plain(F.regexp_replace(text, "\\[\\s*\\d{1,3}\\s*\\]|</?[a-zA-Z][^<>]{0,40}>", " ")), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def bigrams(words: Column) -> Column:
    """Distinct hashes of neighbouring words; of a single word, its own."""
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))),
            lambda i: F.xxhash64(F.get(words, i - 1), F.coalesce(F.get(words, i), F.lit(""))),
        )
    )


def overlaps(records: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(train_id, eval_id) of overlapping records.

    records: (id, split, triples, target). ``train`` is the training split, every other non-null split
    evaluation. Records without facts or without words overlap with nothing; rows that come twice
    count once.
    """
    words = F.col("words")
    known = records.where(F.col("id").isNotNull() & F.col("split").isNotNull() & (F.length(F.trim("triples")) > 0) & (F.length(F.trim("target")) > 0)).select(
        "id", (F.lower(F.trim("split")) == "train").alias("train"), "triples", "target", coarse_key(F.col("triples")).alias("coarse")
    )
    # first by a key that equal facts share whatever their packing; few records get past it
    shared = cut(known.groupBy("coarse").agg(F.max("train").alias("a"), F.min("train").alias("b")).where("a and not b").select("coarse"))
    # cut here, or the filter on the parsed facts would move below the join and parse every record
    kept = cut(known.join(shared, "coarse", "left_semi").drop("coarse"))
    base = cut(
        kept.select("id", "train", fact_set(F.col("triples")).alias("facts"), word_list(F.col("target")).alias("words"))
        .where((F.size("facts") > 0) & (F.size(words) > 0))
        .select("id", "train", F.md5(F.array_join("facts", "\n")).alias("key"), F.xxhash64(words, F.lit(1)).alias("text"), F.xxhash64(words).alias("text2"), "facts", "words")
        .dropDuplicates(["id"])
    )
    # sets of facts that both sides state; the sums are formed before anything is shuffled
    both = base.groupBy("key").agg(F.max("train").alias("a"), F.min("train").alias("b")).where("a and not b").select("key")
    members = base.join(both, "key", "left_semi").select("key", "text", "text2", "train", "id", "facts", "words")
    members = cut(members)
    name = ["key", "text", "text2"]
    classes = members.groupBy(*name).agg(
        F.first("facts").alias("facts"), F.first("words").alias("words"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval")
    )
    classes = cut(classes.withColumn("grams", bigrams(words)).withColumn("class", F.xxhash64(*name)))
    gram = classes.select("key", "class", "in_train", "in_eval", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    seen = gram.groupBy("key", "gram").agg(F.count("*").alias("df"))
    ranked = gram.join(seen, ["key", "gram"]).groupBy("key", "class", "in_train", "in_eval", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("order")
    )
    least = F.col("n") - F.ceil(F.col("n") * containment) + 1
    prefix = ranked.select("key", "class", "in_train", "in_eval", F.explode(F.slice("order", F.lit(1), least.cast("int"))).alias("g")).select("key", "class", "in_train", "in_eval", F.col("g.gram").alias("gram"))

    def side(frame: DataFrame, flag: str, column: str) -> DataFrame:
        return frame.where(flag).select("key", "gram", F.col("class").alias(column))

    candidates = (
        side(prefix, "in_eval", "e").join(side(gram, "in_train", "t"), ["key", "gram"]).select("e", "t")
        .unionByName(side(gram, "in_eval", "e").join(side(prefix, "in_train", "t"), ["key", "gram"]).select("e", "t"))
        .distinct()
    )
    left = classes.select(F.col("class").alias("e"), F.col("words").alias("we"), F.col("grams").alias("ge"), "facts")
    right = classes.select(F.col("class").alias("t"), F.col("words").alias("wt"), F.col("grams").alias("gt"))
    values = F.filter(
        F.array_distinct(F.flatten(F.transform("facts", lambda f: F.regexp_extract_all(F.regexp_replace(f, "\\|[^|]*\\|", "|"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))))),
        lambda w: (F.length(w) > 2) & ~w.isin(SMALL),
    )
    apart = F.array_union(F.array_except("we", "wt"), F.array_except("wt", "we"))
    same_values = ~F.exists(apart, lambda w: w.rlike("\\d") | w.isin(MONTHS) | F.array_contains(values, w))
    share = F.size(F.array_intersect("ge", "gt")) / F.least(F.size("ge"), F.size("gt"))
    matched = candidates.join(left, "e").join(right, "t").where((share >= containment) & same_values).select("e", "t")
    ids = members.select(F.xxhash64(*name).alias("class"), "train", "id")
    evaluation = ids.where(~F.col("train")).select(F.col("class").alias("e"), F.col("id").alias("eval_id"))
    training = ids.where("train").select(F.col("class").alias("t"), F.col("id").alias("train_id"))
    return matched.join(evaluation, "e").join(training, "t").select("train_id", "eval_id")
