"""Quality rules: a threshold table compiled into one projection of built-in functions.

:data:`RULES` names a measure, the least and the most it may be.  :func:`measures` gives the measures of a text as columns
and :func:`verdict` the conjunction of all rules, so a rule is a row of data and the whole filter is one ``select`` over
whole texts, without user functions and without a shuffle.

Defined results: null and empty texts have no words, all counts 0, fail the base rule and are not kept; every row is judged
by itself, repeated rows too; extra columns pass through :func:`keep_good`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import SPACES

SYMBOLS = "#*$%&|<>"
#: Fixed word list: frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to in is that it for on with as was be by this are or der die das und ist von den mit ein eine zu im le la les des et un une est que dans pour el los las una por con del en de y se"
    .split()
)
#: So many words may go without a stop word, for a short clean text can do so by chance.
FREE_WORDS = 20
#: measure, least, most (None: no bound).  Ratios are per word or per line; that of stop words is per word beyond FREE_WORDS.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 10, None),
    ("mean_word_chars", 1.5, 20),
    ("symbol_ratio", None, 0.25),
    ("dup_line_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text."""
    return let(trimmed(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(ws: Column, size: int = 5) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    hashes = F.when(F.size(ws) >= size, F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            beside = lambda e, k, d: F.coalesce(F.get(s, k + d)["x"] == e["x"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda e, k: beside(e, k, -1) | beside(e, k, 1)), lambda e: e["i"]))

        def length(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, starts), length))

    return let(hashes, covered).cast("long")


def measures(text: Column) -> Column:
    """All measures of a text as one struct; the arrays they share are made once."""
    full = F.coalesce(text, F.lit(""))

    def counts(ws: Column) -> Column:
        lines = F.filter(F.split(full, "\n"), lambda x: trimmed(x) != "")
        stop = F.size(F.filter(ws, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?"))).isin(*STOP_WORDS)))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                word_chars(full).alias("word_chars"),
                n_symbols(full).alias("n_symbols"),
                F.size(ls).cast("long").alias("n_lines"),
                n_dup_lines(ls).alias("n_dup_lines"),
                n_repeat_words(ws).alias("n_repeat_words"),
                stop.cast("long").alias("n_stop_words"),
            ),
        )

    return let(words(full), counts)


def rule(name: str, least: float | None, most: float | None, m: Column) -> Column:
    """One row of the threshold table as a condition; ratios are compared by products, so no division by 0 occurs."""
    over = {
        "n_words": (m["n_words"], F.lit(1)),
        "mean_word_chars": (m["word_chars"], m["n_words"]),
        "symbol_ratio": (m["n_symbols"], m["n_words"]),
        "dup_line_ratio": (m["n_dup_lines"], m["n_lines"]),
        "stop_word_ratio": (m["n_stop_words"], m["n_words"] - FREE_WORDS),
    }
    top, base = over[name]
    out = F.lit(True)
    if least is not None:
        out = out & (top >= base * F.lit(least))
    if most is not None:
        out = out & (top <= base * F.lit(most))
    return out


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def verdict(m: Column, rules=RULES) -> Column:
    """True if the base rule and every row of the threshold table hold."""
    out = ~base_failed(m)
    for r in rules:
        out = out & rule(*r, m)
    return out


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row for each row of docs: doc_id, the measures, base_failed, kept."""
    m = F.col("m")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", *[m[c].alias(c) for c in cols], base_failed(m).alias("base_failed"), verdict(m, rules).alias("kept"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    return docs.where(let(measures(F.col("text")), lambda m: verdict(m, rules)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
