"""Quality rules with distribution divergence, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, let, materialise

# Very common words of four languages.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
}
LANGS = tuple(COMMON_WORDS)
OTHER = "other"
#: Patterns of character classes that share no character; what none of them matches is the last class.
SYMBOLS = r"[#*$%&|<>]"
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[^\x00-\x7F]", SPACE, SYMBOLS, r"[.,;:!?]")
#: Documents whose distances to their language's reference reach these are dropped.
MAX_CLASS_DISTANCE = 0.2
MAX_WORD_DISTANCE = 0.3
#: Shorter texts have too few events for a distance to mean anything.
MIN_CHARS = 200
MIN_WORDS = 50


def _windows(words: Column) -> Column:
    """The 3-word windows of an array as strings; words hold no spaces, so equal strings are equal windows."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.arrays_zip(*[F.slice(words, i, n) for i in (1, 2, 3)]).cast("array<string>")


def _repeated_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more in the array.

    Only texts with such a window take the part with lambdas, which are interpreted.
    """

    def count(grams: Column) -> Column:
        marked = F.sort_array(F.transform(grams, lambda g, i: F.struct(F.xxhash64(g).alias("g"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda x, k: F.get(s, k - 1)["g"].eqNullSafe(x["g"]) | F.get(s, k + 1)["g"].eqNullSafe(x["g"])
            spots = F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
            return F.size(F.array_distinct(F.flatten(spots)))

        return let(marked, covered)

    once = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(once, F.lit(0)).otherwise(count(windows)).cast("long")


def _lang(lang: Column) -> Column:
    return F.when(lang.isin(*LANGS), lang).otherwise(F.lit(OTHER))


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id, the language of reference, the base counts and two histograms of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = _lang(F.coalesce(F.col("lang").cast("string"), F.lit("")))
    size = max(map(len, COMMON_WORDS.values()))
    common = F.element_at(F.create_map(*[y for k in LANGS for y in (F.lit(k), F.array(*[F.lit(w) for w in COMMON_WORDS[k]]))], F.lit(OTHER), F.array(*[F.lit("")] * size)), lang)
    # Each step names what the next one uses more than once, which keeps the steps apart in the plan.
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        lang.alias("reference"),
        F.length(text).cast("long").alias("n_chars"),
        F.regexp_replace(text, CLASSES[0] + "+", "").alias("rest"),
        F.array_remove(F.split(text, SPACE + "+"), "").alias("words"),
        F.split(text, "\n").alias("lines"),
        F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "").alias("letters"),
        common.alias("known"),
    )
    # The first class has been removed from ``rest`` and the others are apart from it.
    classes = [F.col("n_chars") - F.length("rest"), *[F.regexp_count("rest", F.lit(c)) for c in CLASSES[1:]]]
    # One pass over the letters for each common word; a loop over words of the text would be interpreted.
    bins = F.transform("known", lambda w: (F.size("letters") - F.size(F.array_remove("letters", w))).cast("long"))
    counted = cut.select(
        "doc_id", "reference", "n_chars", "lines",
        F.size("words").cast("long").alias("n_words"),
        _windows(F.col("words")).alias("windows"),
        F.size("letters").alias("n_letters"),
        *[c.cast("long").alias(f"class{i}") for i, c in enumerate(classes)],
        bins.alias("bins"),
    )
    full = F.filter("lines", lambda x: F.rlike(x, F.lit(NOT_SPACE)))
    repeated_lines = F.when(F.size(F.array_distinct("lines")) == F.size("lines"), F.lit(0)).otherwise(let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))))

    def whole(parts: list[Column], total: Column) -> Column:
        """The counts, and what is left of the total."""
        return F.array(*parts, total - sum(parts[1:], parts[0]))

    return counted.select(
        "doc_id", "reference", "n_chars", "n_words",
        (F.col("n_chars") - F.col(f"class{CLASSES.index(SPACE)}")).alias("word_chars"),
        _repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.col(f"class{CLASSES.index(SYMBOLS)}").alias("n_symbols"),
        repeated_lines.cast("long").alias("n_dup_lines"),
        whole([F.col(f"class{i}") for i in range(len(CLASSES))], F.col("n_chars")).alias("classes"),
        whole([F.get("bins", F.lit(i)) for i in range(size)], F.col("n_letters").cast("long")).alias("common"),
    )


def _shares(counts: Column) -> Column:
    return let(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def quality_rules(
    docs: DataFrame,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Base counts, both distances and the verdict, one row for every row of ``docs``.

    The reference of a language is the sum of the histograms of all documents in it;
    a null or unknown language is measured against all such documents.  A document is
    kept if the base rules hold and, given enough characters or words, neither of its
    histograms is further from the reference than allowed.  A null text has no words
    and fails.  Very long texts are counted whole; extra columns are ignored.
    """
    features = materialise(quality_features(docs), "quality")
    bins = [("classes", len(CLASSES) + 1), ("common", max(map(len, COMMON_WORDS.values())) + 1)]
    sums = features.groupBy("reference").agg(*[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in bins for i in range(n)])
    # At most one row for each language of COMMON_WORDS and one for all others.
    references = sums.select("reference", *[_shares(F.array(*[F.col(f"{c}{i}") for i in range(n)])).alias(f"{c}_ref") for c, n in bins])
    rows = features.join(F.broadcast(references), "reference")
    rows = rows.withColumns(
        {
            "class_distance": F.when(F.col("n_chars") >= min_chars, jensen_shannon(_shares(F.col("classes")), F.col("classes_ref"))),
            "word_distance": F.when((F.col("n_words") >= min_words) & (F.col("reference") != OTHER), jensen_shannon(_shares(F.col("common")), F.col("common_ref"))),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    far = F.coalesce(F.col("class_distance") >= max_class_distance, F.lit(False)) | F.coalesce(F.col("word_distance") >= max_word_distance, F.lit(False))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance")
    )
