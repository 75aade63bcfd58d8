"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule bounds a ratio of the text's counts from below, from above or both.
``judge`` adds the counts, the name of every rule a text breaks and the
verdict; there is no user function, shuffle or second read of the table.

Null and empty texts have no words: all counts are 0, base_failed is true.
Rows are independent; an empty table gives no rows; other columns are left
out unless ``keep`` names them, and a kept column called like a new one gives
way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of other characters than these.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition within a text counts.
WINDOW = 5
#: Frequent function words of the corpus's languages (fixed values).
STOP_WORDS = ["the", "of", "and", "to", "in", "that", "is", "for", "with", "on", "de", "la", "le", "et", "les", "des",
              "en", "un", "une", "du", "el", "los", "que", "y", "por", "con", "para", "der", "die", "und", "das", "den",
              "von", "zu", "ist", "mit", "auf"]


@dataclass(frozen=True)
class Rule:
    """The ratio ``top / bottom`` must lie in [least, most]; texts with a bottom of under ``from_size`` are not judged by it."""

    name: str
    top: str
    bottom: str
    least: float | None = None
    most: float | None = None
    from_size: int = 1


#: The method's own rules, beside the fixed base rule.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0, 20),
    Rule("symbols", "n_symbols", "n_words", None, 0.30),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None, 60),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.50, 6),
)


def repeated_words(words: Column, n: Column, size: int) -> Column:
    """Words in windows of ``size`` words that the text holds twice or more.

    64-bit window hashes that all differ prove that nothing repeats; other
    texts sort the windows themselves, so the count is exact.
    """
    last = n - size
    at = F.sequence(F.lit(0), last)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    pairs = F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, size), " ").alias("w"), i.alias("i"))))

    def starts(p: Column) -> Column:
        twin = F.transform(p, lambda x, k: F.when((F.get(p, k - 1)["w"] == x["w"]) | (F.get(p, k + 1)["w"] == x["w"]), x["i"]))
        return F.array_sort(F.array_compact(twin))

    def covered(s: Column) -> Column:
        return F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(s, k + 1) - x, F.lit(size)))),
                           F.lit(0), lambda a, b: a + b)

    # one-element arrays bind a value once for the functions above
    exact = F.get(F.transform(F.array(pairs), lambda p: F.get(F.transform(F.array(starts(p)), covered), F.lit(0))), F.lit(0))
    differ = F.get(F.transform(F.array(hashed), lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0))
    return F.when(n < size, 0).when(differ, 0).otherwise(exact).cast("long")


def broken(rule: Rule) -> Column:
    """The rule's name if the counts break it, else null."""
    ratio = F.col(rule.top) / F.col(rule.bottom)
    out = F.lit(False)
    if rule.least is not None:
        out = out | (ratio < rule.least)
    if rule.most is not None:
        out = out | (ratio > rule.most)
    return F.when((F.col(rule.bottom) >= max(1, rule.from_size)) & out, F.lit(rule.name))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ``base_failed``, ``broken_rules`` array<string> and ``kept`` of each row."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "text_chars"]
    own = [c for c in dict.fromkeys(keep) if c not in [*counts, "base_failed", "broken_rules", "kept"]]
    t, stops = F.col("__text"), F.array(*map(F.lit, STOP_WORDS))
    read = docs.select(*own, F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"))
    split = read.select(*own, "__text", F.array_remove(F.split(t, SEPARATORS), "").alias("__words"),
                        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    words, lines = F.col("__words"), F.col("__lines")
    measured = split.select(
        *own, F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words, F.size(words), WINDOW).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.array_contains(stops, F.lower(w)))).cast("long").alias("n_stop_words"),
        F.length(t).cast("long").alias("text_chars"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = measured.select(*own, *counts, failed.alias("base_failed"),
                              F.array_compact(F.array(*map(broken, rules)) if rules else F.array(F.lit(None).cast("string"))).alias("broken_rules"))
    return verdict.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
