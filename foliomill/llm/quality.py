"""Quality rules: a table of thresholds compiled into one projection.

Every rule names a measure and the range it must lie in.  Measures are counts and ratios of
length, symbols, stop words and lines, all written as DataFrame expressions over the one row;
there are no user functions, joins or shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import SPACE_CLASS, text_or_empty

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "als auch auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie sind und von war wir zu "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas pour que qui sur un une vous "
    "al como con del el en es la las lo los más no o para pero por que se sin su sus un una y"
).split()
WINDOW = 5


@dataclass(frozen=True)
class Threshold:
    """The measure must lie between least and most, in texts of at least from_words words."""

    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0

    def broken(self) -> Column:
        value, out = F.col(self.measure), F.lit(False)
        if self.least is not None:
            out = out | (value < self.least)
        if self.most is not None:
            out = out | (value > self.most)
        return out & (F.col("n_words") >= self.from_words) if self.from_words else out


#: The base rules, and the rules that come on top of them.
BASE = (Threshold("n_words", least=10), Threshold("repeat_percent", most=20))
TABLE = (
    Threshold("word_length", least=2, most=14),
    Threshold("symbol_ratio", most=0.15),
    Threshold("stop_word_ratio", least=0.05, from_words=25),
    Threshold("dup_line_ratio", most=0.4, from_words=25),
    Threshold("letter_word_ratio", least=0.6),
    Threshold("shout_ratio", most=0.25),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text holds twice or more.

    Windows are sorted by a hash (of their words' hashes) and place; neighbours with equal hashes
    count as equal only if their words are.  Texts whose hashes all differ stop before the sort.
    """

    def hashed(of_word: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(of_word) - WINDOW), lambda i: F.xxhash64(*[F.get(of_word, i + k) for k in range(WINDOW)]))

    def count(ws: Column, hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(rows: Column) -> Column:
            def same(j: Column, k: Column) -> Column:
                a, b = F.get(rows, j), F.get(rows, k)
                return (a["h"] == b["h"]) & (F.slice(ws, a["i"] + 1, WINDOW) == F.slice(ws, b["i"] + 1, WINDOW))

            places = F.filter(
                F.sequence(F.lit(0), F.size(rows) - 1),
                lambda k: F.when(k > 0, same(k - 1, k)).otherwise(False) | F.when(k < F.size(rows) - 1, same(k, k + 1)).otherwise(False))
            return F.array_sort(F.transform(places, lambda k: F.get(rows, k)["i"]))

        def covered(at: Column) -> Column:  # the union of the windows that begin at these places
            steps = F.sequence(F.lit(1), F.size(at) - 1)
            inner = F.when(F.size(at) > 1, F.aggregate(steps, F.lit(0), lambda s, k: s + F.least(F.lit(WINDOW), F.get(at, k) - F.get(at, k - 1)))).otherwise(0)
            return F.when(F.size(at) > 0, inner + WINDOW).otherwise(0)

        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, _let(placed, lambda rows: _let(repeated(rows), covered))).otherwise(0)

    of_words = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(of_words, lambda h: _let(hashed(h), lambda hs: count(words, hs))))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures to each row; null texts have no words.  Columns of these names are replaced."""
    symbol, space = r"[#*$%&|<>]", SPACE_CLASS
    text = text_or_empty(F.col(f"`{text_col}`"))
    words = F.filter(F.split(text, space + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    stop = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    base = df.select(F.struct("*").alias("__row"), text.alias("__t"), words.alias("__w"), lines.alias("__l"))  # so that no name clashes
    counted = base.select(
        "*", F.size("__w").cast("long").alias("__n_words"), F.length(F.array_join("__w", "")).cast("long").alias("__word_chars"),
        F.regexp_count("__t", F.lit(symbol)).cast("long").alias("__n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__n_dup_lines"),
        _repeat_words(F.col("__w")).cast("long").alias("__n_repeat_words"),
        F.size(F.filter("__w", lambda w: w.isin(*stop))).alias("__stop"),
        F.size(F.filter("__w", lambda w: ((w >= "A") & (w < "[")) | ((w >= "a") & (w < "{")) | (w >= "\x80"))).alias("__letter"),
        F.size(F.filter("__w", lambda w: F.endswith(w, F.lit("!!")))).alias("__shout"),
        F.size("__l").alias("__n_lines"))
    per_word = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("__n_words"), F.lit(0)), F.lit(0.0))
    new = {
        "n_words": F.col("__n_words"), "word_chars": F.col("__word_chars"), "n_symbols": F.col("__n_symbols"),
        "n_dup_lines": F.col("__n_dup_lines"), "n_repeat_words": F.col("__n_repeat_words"),
        "repeat_percent": 100 * per_word("__n_repeat_words"), "word_length": per_word("__word_chars"), "symbol_ratio": per_word("__n_symbols"),
        "stop_word_ratio": per_word("__stop"), "letter_word_ratio": per_word("__letter"), "shout_ratio": per_word("__shout"),
        "dup_line_ratio": F.coalesce(F.col("__n_dup_lines") / F.nullif(F.col("__n_lines"), F.lit(0)), F.lit(0.0)),
    }
    return counted.select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def _any(rules: tuple[Threshold, ...]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | rule.broken()
    return out


def judge(df: DataFrame, text_col: str = "text", base: tuple[Threshold, ...] = BASE, table: tuple[Threshold, ...] = TABLE) -> DataFrame:
    """Add the measures, base_failed, broken_rules (names of the measures out of range) and kept.

    Empty and null texts have no words and fail the base rules.  Each row stands for itself, so
    repeated rows get equal verdicts and an empty table gives an empty result.  Texts of any length
    are measured whole.  Columns with the names of the outputs are replaced.
    """
    measured = measures(df, text_col)
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.measure)) for r in table]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")) if base is BASE else _any(base)
    added = {"base_failed": failed, "broken_rules": broken, "kept": ~failed & ~_any(table)}
    return measured.select(*[F.col(f"`{c}`") for c in measured.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `df` whose verdict is kept, with its columns."""
    judged = judge(df.select(F.struct("*").alias("__row"), F.col(f"`{text_col}`").alias("__text")), "__text")
    # A filter pushed below the projection would compute the measures again for each place it
    # names them; it stays above a column that isn't deterministic.
    fenced = judged.select("__row", "kept", F.monotonically_increasing_id().alias("__fence"))
    return fenced.where(F.col("kept") & (F.col("__fence") >= 0)).select("__row.*")
