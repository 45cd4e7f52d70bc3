"""Quality rules: base signals of a text, and its divergence from its language.

Base signals are counts.  The method's verdict compares two histograms of a text with
those of its language (all texts of that ``lang`` together, null being one of its own):
character classes, and the language's ``COMMON`` most frequent words against all other
words.  A text whose Jensen-Shannon distance (base 2, 0 to 1) from either exceeds a fixed
bound is rejected.  Texts below the guards' lengths are not judged by the histogram
concerned, as short texts diverge by chance.  Only DataFrame functions are used.

Defined cases: a null or blank text has no words and fails the base rule; a language
without a word has no word histogram, and nothing is judged by it; repeated rows each
get their row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
COMMON = 20
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.30
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = 100
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "other")


def _without(column: Column, pattern: str) -> Column:
    return F.regexp_replace(column, F.lit(pattern), F.lit(""))


def _words(text: Column) -> Column:
    """The words: every white space becomes a blank, and what stands between blanks is a word."""
    for c in "\t\n\v\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _count(column: Column, characters: str) -> Column:
    """Characters of ``column`` in a regular expression's class."""
    return F.length(_without(column, f"[^{characters}]+")).cast("long")


def signals(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang and ``keep``, the base signals, and the character classes' counts.

    Most characters are small letters and blanks: one pass takes them out, and the
    other classes are counted in the short rest.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "lang", *keep, text.alias("t"), _words(text).alias("w"), _without(text, r"[\p{Ll} ]+").alias("r"))
    d = d.select("*", F.transform("w", lambda w: F.xxhash64(w)).alias("h"), (F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit("")))).cast("long").alias("blanks"))
    windows = F.when(F.size("h") >= 3, F.transform(F.sequence(F.lit(0), F.size("h") - 3), lambda i: F.struct(F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).alias("key"), i.alias("i"))))
    d = d.select("*", F.sort_array(windows).alias("s"))
    twice = F.filter("s", lambda x, i: (F.get("s", i + 1)["key"] == x["key"]) | (F.get("s", i - 1)["key"] == x["key"]))
    d = d.select("*", F.transform(twice, lambda x: x["i"]).alias("p"))
    covered = F.array_union(F.array_union("p", F.transform("p", lambda i: i + 1)), F.transform("p", lambda i: i + 2))
    inked = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    d = d.select("*", inked.alias("lines"))
    spaces = F.col("blanks") + _count(F.col("r"), r"\t-\r")
    upper, digit, mark = _count(F.col("r"), r"\p{Lu}\p{Lt}"), _count(F.col("r"), r"\p{Nd}"), _count(F.col("r"), r".,;:!?'\"()\-")
    lower = (F.length("t") - F.col("blanks") - F.length("r")).cast("long")
    other = F.length("r").cast("long") - _count(F.col("r"), r"\t-\r") - upper - digit - mark
    n_words, repeats = F.size("w").cast("long"), F.coalesce(F.size(covered), F.lit(0)).cast("long")
    d = d.select(
        "doc_id", "lang", *keep, "t", "w", n_words.alias("n_words"), (F.length("t") - spaces).cast("long").alias("word_chars"),
        _count(F.col("r"), r"#*$%&|<>").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("p") > 0, repeats).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"), F.array(lower, upper, digit, spaces, mark, other).alias("classes"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(docs: DataFrame) -> DataFrame:
    """A row for each language: the counts of its character classes, its common words and their counts
    (the last count is of all other words), over all its texts."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("lang", text.alias("t"), _without(text, r"[\p{Ll} ]+").alias("r"))
    d = d.select("*", (F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit("")))).cast("long").alias("blanks"))
    white = _count(F.col("r"), r"\t-\r")
    upper, digit, mark = _count(F.col("r"), r"\p{Lu}\p{Lt}"), _count(F.col("r"), r"\p{Nd}"), _count(F.col("r"), r".,;:!?'\"()\-")
    counts = d.select("lang", (F.length("t") - F.col("blanks") - F.length("r")).cast("long").alias("lower"), upper.alias("upper"), digit.alias("digit"), (F.col("blanks") + white).alias("space"), mark.alias("punctuation"), (F.length("r").cast("long") - white - upper - digit - mark).alias("other"))
    classes = counts.groupBy("lang").agg(F.array(*[F.sum(c) for c in CLASSES]).alias("ref_classes"))
    words = docs.select("lang", F.explode(_words(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # the rank limit is pushed below the window's exchange, so a task sends at most COMMON words of a language
    words = written(words, "rules-words")
    top = words.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= COMMON)
    listed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    both = classes.join(listed.withColumnRenamed("lang", "l1"), F.col("lang").eqNullSafe(F.col("l1")), "left").join(total.withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")), "left")
    rest = F.col("total") - F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return both.select("lang", "ref_classes", F.transform("top", lambda x: x["word"]).alias("ref_words"), F.concat(F.transform("top", lambda x: x["n"]), F.array(rest)).alias("ref_counts"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    sides = F.zip_with(p, q, lambda a, b: F.struct((a / total(p)).alias("a"), (b / total(q)).alias("b")))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(sides, F.lit(0.0), lambda s, x: s + half(x["a"], x["b"]) + half(x["b"], x["a"])) / 2))


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The signals of every row of ``docs``, both distances (null: not judged) and ``kept``."""
    refs = written(references(docs), "rules-references").withColumnRenamed("lang", "ref_lang")
    d = signals(docs, keep).join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    # places of the text's words in the list of common words; 0 where a word isn't listed
    d = d.withColumn("places", F.transform("w", lambda w: F.array_position("ref_words", F.lower(w))))
    d = d.withColumn("common", F.filter("places", lambda x: x > 0))
    counts = F.transform(F.sequence(F.lit(1), F.size("ref_words")), lambda k: (F.size("common") - F.size(F.array_remove("common", k.cast("long")))).cast("long"))
    d = d.withColumn("counts", F.concat(counts, F.array(F.col("n_words") - F.size("common"))))
    d = d.withColumn("class_distance", F.when(F.length("t") >= MIN_CLASS_CHARS, distance(F.col("classes"), F.col("ref_classes"))))
    d = d.withColumn("word_distance", F.when((F.col("n_words") >= MIN_COMMON_WORDS) & (F.size("ref_words") > 0), distance(F.col("counts"), F.col("ref_counts"))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    # a generator of one row: conditions on the verdict stay above it; pushed below, they would put every
    # step of the signals into one expression and compute it again and again
    row = F.struct(
        "doc_id", "lang", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"),
    )
    return d.select(F.inline(F.array(row)))
