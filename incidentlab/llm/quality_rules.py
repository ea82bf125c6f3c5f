"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with
those of its language over all documents, by Jensen-Shannon distance (base 2, from 0 to 1). Counts
and references cover all rows; the references are a few numbers for each language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, stage, text_key

SYMBOLS = "#*$%&|<>"

#: Fixed lists: frequent function words, the bins of the word histogram; the rest is "other".
COMMON_WORDS = {
    "de": "der die das und in zu den von mit auf für ist im nicht ein eine sich dem des als auch",
    "en": "the of and to in that is was for it with as be on by at this are from or an have not",
    "es": "de la que el en y los del se las por un para con no una su al lo como más pero",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas plus ce avec",
}

#: Bins of the character histogram, as classes of a regular expression; the rest is "other".
CHAR_CLASSES = {
    "lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r"[\x20\x09-\x0D]",
    "stop": r"[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>]",
}


@dataclass(frozen=True)
class Rules:
    """Parameters of the verdict. A histogram is judged only from its minimum size on. Words are
    held to a distance of ``max_word_distance`` + ``word_scatter`` / sqrt(words), as the histogram
    of a short text scatters more."""

    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20
    min_chars: int = 300
    max_char_distance: float = 0.30
    min_text_words: int = 50
    max_word_distance: float = 0.10
    word_scatter: float = 2.8
    common_words: dict = field(default_factory=lambda: dict(COMMON_WORDS))


def _repeat_words(words: Column, k: int) -> Column:
    """Words that lie in a window of k words found twice or more in the text."""

    def covered(windows: Column) -> Column:
        entries = F.sort_array(
            F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            last = F.size(s) - 1
            hit = F.filter(s, lambda x, j: (
                ((j > 0) & (F.get(s, j - 1)["h"] == x["h"]))
                | ((j < last) & (F.get(s, j + 1)["h"] == x["h"]))))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        # starts in order: each adds the words up to the next start, k at most
        def total(starts: Column) -> Column:
            first = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-k).alias("last"))
            return F.aggregate(
                starts, first,
                lambda a, i: F.struct(
                    (a["sum"] + F.least(F.lit(k), i - a["last"])).alias("sum"), i.alias("last")),
                lambda a: a["sum"])

        return let(let(entries, repeated), total)

    def counted(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - k),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return let(words, lambda w: F.when(
        F.size(w) <= k, F.lit(0).cast("long")).otherwise(counted(w)))


def base_counts(docs: DataFrame, rules: Rules, text: str = "text") -> dict[str, Column]:
    """Counts of one text as columns; null texts have none of anything."""
    body = F.coalesce(docs[text], F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(body, "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    return {
        "words": words,
        "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda s: (F.size(s) - F.size(F.array_distinct(s)))).cast("long"),
        "n_repeat_words": _repeat_words(words, rules.window),
    }


def _classes(body: Column) -> list[Column]:
    """Counts of each character class, the last one "other"."""
    counts = [F.length(F.regexp_replace(body, f"{c}+", "")) for c in CHAR_CLASSES.values()]
    own = [(F.length(body) - c).cast("double") for c in counts]
    other = F.length(body).cast("double")
    for c in own:
        other = other - c
    return [*own, F.greatest(other, F.lit(0.0))]


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts of one length."""

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def unit(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0.0), lambda s, v: s + v),
                   lambda total: F.transform(x, lambda v: v / total))

    parts = let(unit(p), lambda a: let(unit(q), lambda b: F.zip_with(
        a, b, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(
        parts, F.lit(0.0), lambda s, v: s + v) / 2))


def _total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, v: s + v)


def profile(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id",
            text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: the base counts and both histograms (``classes``, ``commons``)."""
    vocabulary = vocabulary_of(rules)
    src = docs.select(
        docs[id_col].alias("id"), docs[text].alias("text"),
        F.coalesce(docs[lang], F.lit("")).alias("lang")).withColumn("key", text_key())
    body = F.coalesce(F.col("text"), F.lit(""))
    counts = base_counts(src, rules)
    base = src.select(
        "id", "key", "lang", F.array(*_classes(body)).alias("classes"),
        *[c.alias(n) for n, c in counts.items()],
    ).withColumn("n_words", F.size("words").cast("long")).drop("words")

    # listed words, counted per text on the side that reads it; a text's bins are few rows
    found = src.select("id", "key", F.explode(
        F.split(F.lower(F.col("text")), r"[^\p{L}]+")).alias("w"))
    found = found.where(F.col("w").isin(vocabulary)).groupBy("id", "key", "w").agg(
        F.count("*").cast("double").alias("n"))
    per_doc = found.groupBy("id", "key").agg(
        F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("m"))
    bins = F.transform(F.lit(vocabulary), lambda w: F.coalesce(
        F.element_at(F.col("m"), w), F.lit(0.0)))
    per_doc = per_doc.select(F.col("id").alias("id2"), F.col("key").alias("key2"),
                             bins.alias("commons"))
    none = F.array_repeat(F.lit(0.0), len(vocabulary))
    listed = base.join(
        per_doc, base["id"].eqNullSafe(per_doc["id2"]) & (base["key"] == per_doc["key2"]), "left",
    ).select(*base.columns, F.coalesce("commons", none).alias("commons"))
    # the last bin holds the words that are not listed
    return listed.withColumn("commons", F.concat("commons", F.array(F.greatest(
        F.lit(0.0), F.col("n_words") - _total("commons")))))


def references(profiles: DataFrame, rules: Rules = Rules()) -> dict[str, tuple[list, list]]:
    """Summed histograms of each listed language, and of all documents under ''. Languages are a
    parameter, so this is a handful of rows whatever the size of the table."""
    n_classes, n_words = len(CHAR_CLASSES) + 1, len(vocabulary_of(rules)) + 1
    listed = F.when(F.col("lang").isin(list(rules.common_words)), F.col("lang")).otherwise("")
    rows = profiles.groupBy(listed.alias("lang")).agg(
        F.array(*[F.sum(F.get("classes", F.lit(i))) for i in range(n_classes)]).alias("c"),
        F.array(*[F.sum(F.get("commons", F.lit(i))) for i in range(n_words)]).alias("w"),
    ).collect()
    refs = {r["lang"]: (list(r["c"]), list(r["w"])) for r in rows}
    if refs:
        refs[""] = tuple([sum(v) for v in zip(*[r[k] for r in refs.values()])] for k in (0, 1))
    return refs


def vocabulary_of(rules: Rules) -> list[str]:
    return sorted({w for words in rules.common_words.values() for w in words.split()})


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text: str = "text",
          lang: str = "lang") -> DataFrame:
    """One row per input row: the base counts, both distances and the verdict.

    Distances are those to the nearest language reference, so that a wrong or missing language
    label costs nothing. A null or empty text has no words and fails. Null ids are kept. Repeated
    rows get equal results. Columns other than the three named are ignored, whatever their names.
    An empty table gives no rows. A text with fewer characters or words than the guards ask is not
    judged by that histogram (its distance is null); words are counted whether listed or not.
    """
    profiles = stage(profile(docs, rules, id_col, text, lang))
    refs = references(profiles, rules)

    def nearest(column: str, k: int, enough: int) -> Column:
        known = [r[k] for r in refs.values() if sum(r[k]) > 0]
        total = _total(column)
        if not known:
            return F.lit(None).cast("double")
        apart = F.array_min(F.array(*[_divergence(F.col(column), F.lit(r)) for r in known]))
        return F.when((total > 0) & (total >= enough), apart)

    repeated = 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    failed = (F.col("n_words") < rules.min_words) | repeated
    most = rules.max_word_distance + rules.word_scatter / F.sqrt(
        F.greatest(F.lit(1.0), _total("commons")))
    far = (F.coalesce(F.col("char_distance") > rules.max_char_distance, F.lit(False))
           | F.coalesce(F.col("word_distance") > F.col("most"), F.lit(False)))
    return profiles.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", failed.alias("base_failed"),
        nearest("classes", 0, rules.min_chars).alias("char_distance"),
        nearest("commons", 1, rules.min_text_words).alias("word_distance"),
        most.alias("most"),
    ).withColumn("kept", ~F.col("base_failed") & ~far).drop("most")
