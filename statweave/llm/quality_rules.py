"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Each rule bounds one ratio of a document and applies from a number of words on. All measures come from two arrays,
the words and the lines, so one pass over the text serves all rules; no user function, join or shuffle is involved.
The share of stop words is judged only where the words are mostly basic Latin letters: the table holds words of
languages written so, and says nothing about others.
Null texts have no words; a text of white space has no words and no lines that count; equal rows give equal results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP

WINDOW = 5

#: Very frequent words of languages in Latin letters, in lower case.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are with as be by at this from or",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur",
    "es": "de la que el en y los del se las por un para con no una su al lo como",
    "it": "di che il e la un per non del si le della sono con i",
    "pt": "de que o e do da em um para com os no se na por",
    "nl": "de het een van en in is dat op te zijn voor met niet aan",
    "sv": "och att det som en på är av för den till inte med",
    "da": "og at det er en til af på den som ikke med for",
    "fi": "ja on ei se oli että hän mutta ovat kun",
    "pl": "w i na z się do nie że jest to o jak",
    "cs": "a se v na je že s z o i do to",
    "tr": "ve bir bu da de için ile çok ne olarak",
    "hu": "a az és hogy nem egy is ez meg volt",
    "ro": "și de în a la cu pe nu un este din",
    "id": "yang dan di itu dengan untuk tidak ini dari dalam",
    "vi": "và của là có cho không một các được trong",
}
STOP_SET = sorted({w for words in STOP_WORDS.values() for w in words.split()})


class Rule(NamedTuple):
    name: str
    measure: str
    low: float | None
    high: float | None
    words: int = 0
    given: str | None = None  # a share that must be half at least for the rule to apply


#: The threshold table. Measures are columns of ``measures``.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0, 20),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_share", 0.02, None, 60, "latin_share"),
    Rule("repeated_lines", "dup_line_share", None, 0.5, 20),
    Rule("shouting", "upper_share", None, 0.6, 10),
    Rule("marks", "mark_share", None, 0.4, 20),
)


def _split_words(text: Column) -> Column:
    body = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, GAP))


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in ``words``."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    prints = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
    pairs = F.sort_array(F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(p: Column, k: Column, all_pairs: Column) -> Column:
        return (F.get(all_pairs, k - 1)["h"] == p["h"]) | (F.get(all_pairs, k + 1)["h"] == p["h"])

    def places(sorted_pairs: Column) -> Column:
        flagged = F.transform(sorted_pairs, lambda p, k: F.when(twice(p, k, sorted_pairs), p["i"]))
        return F.sort_array(F.filter(flagged, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def let(value: Column, f) -> Column:
        return F.get(F.transform(F.array(value), f), F.lit(0))

    heavy = let(pairs, lambda p: let(places(p), covered))
    some = F.size(F.array_distinct(prints)) < F.size(words) - WINDOW + 1
    return F.when(F.size(words) <= WINDOW, F.lit(0)).when(some, heavy).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the ratios the rules bound)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", "text", _split_words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words").cast("long")

    def gone(chars: str) -> Column:
        return (F.length("text") - F.length(F.regexp_replace("text", chars, ""))).cast("long")

    base = base.select(
        "doc_id",
        n.alias("n_words"),
        F.aggregate("words", F.lit(0), lambda s, w: s + F.length(w)).cast("long").alias("word_chars"),
        gone(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_SET))).cast("long").alias("n_stop"),
        gone(r"[A-Z]").alias("n_upper"),
        gone(r"[A-Za-z]").alias("n_latin"),
        gone(r"[^A-Za-z\x20\x09-\x0D\x{80}-\x{10FFFF}.,]").alias("n_marks"),
    )

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return base.select("*", per("word_chars", "n_words").alias("mean_word_chars"), per("n_symbols", "n_words").alias("symbols_per_word"), per("n_dup_lines", "n_lines").alias("dup_line_share"), per("n_stop", "n_words").alias("stop_share"), per("n_latin", "word_chars").alias("latin_share"), per("n_upper", "word_chars").alias("upper_share"), per("n_marks", "word_chars").alias("mark_share"))


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of ``measures`` breaks."""
    broken = []
    for r in rules:
        value = F.col(r.measure)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        if r.given is not None:
            bad = bad & (F.col(r.given) >= 0.5)
        broken.append(F.when(bad & (F.col("n_words") >= r.words), F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the measures, base_failed, the broken rules and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measures(docs).withColumn("base_failed", base).withColumn("broken", failures(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
