"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the words and lines of one row, so
the whole table is one narrow scan: no user function, no shuffle, and nothing
whose size depends on the number of rows.

Defined results: null or blank text has no words, every measure is 0 (ratios
null) and the row fails; repeated rows are judged alike, one result each; a row
with a null id keeps it. Only the id and text columns are read, so further
columns, whatever their names, do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, WORD_GAP, let


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= measure <= high``; an open end is None. A null
    measure (a ratio without a denominator) passes."""
    measure: str
    low: float | None = None
    high: float | None = None


#: The common function words of the four languages of the corpus.
STOP_WORDS = tuple(sorted(set(
    "the and of to in is that it for with as this by be was are on at or from an have not "
    "der die das und ist von mit den ein zu nicht auf für im sich dem des eine als auch "
    "le la les de des et un une du que qui est pour dans par sur pas au en il elle "
    "el los las y una por con para se del lo como más su al".split())))

#: The production thresholds. A word of prose is 2 to 15 characters long on
#: average, carries few symbols, and is now and then a function word.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_word_ratio", None, 0.10),
    Rule("stop_word_ratio", 0.05, None),
    Rule("upper_char_ratio", None, 0.40),
    Rule("dup_line_ratio", None, 0.40),
    Rule("ellipsis_line_ratio", None, 0.30),
    Rule("bullet_line_ratio", None, 0.90),
)

#: Repeated windows of one text up to which they are looked up one by one; a
#: text with more has its windows sorted with their positions. Both are exact.
FEW = 32


def _marks(marked: Column) -> Column:
    """Words under the 3-word windows at the given ascending positions."""
    return let(marked, lambda a: F.aggregate(
        F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a), F.lit(1))),
                   lambda p, n: F.least(F.lit(3), F.coalesce(n - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda s, x: s + x))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in ``words``.

    Windows are compared by their 64-bit hashes. The sorted hashes show which
    occur again; most texts have none or few, and the positions of those are
    looked up. In a text with many, equal windows are neighbours once (hash,
    position) pairs are sorted."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def again(h: Column) -> Column:
        def twice(s: Column) -> Column:
            return F.array_distinct(F.array_compact(F.zip_with(
                s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x == y, x))))

        def looked_up(d: Column) -> Column:
            return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)),
                            lambda p: p.isNotNull())

        def neighbours(z: Column) -> Column:
            at = lambda i: F.get(z, i)["h"]
            return F.sort_array(F.filter(F.transform(z, lambda x, i: F.when(
                x["h"].eqNullSafe(at(i - 1)) | x["h"].eqNullSafe(at(i + 1)), x["i"])),
                lambda p: p.isNotNull()))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(F.sort_array(h), twice), lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long"))
                   .when(F.size(d) <= FEW, _marks(looked_up(d)))
                   .otherwise(_marks(let(pairs, neighbours))))

    return F.when(F.size(words) > 3, let(hashes, again)).otherwise(F.lit(0).cast("long"))


def words_of(text: Column) -> Column:
    body = F.btrim(text, F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_GAP))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def counts(text: Column, w: Column, ln: Column) -> dict[str, Column]:
    """What is counted in a text with the words ``w`` and the lines ``ln``."""
    number = lambda xs, test: F.size(F.filter(xs, test)).cast("long")
    without = lambda p: (F.length(text) - F.length(F.regexp_replace(text, p, ""))).cast("long")
    stop = [x for s in STOP_WORDS for x in (s, s.capitalize())]
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": without(r"[#*$%&|<>]+"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        "n_repeat_words": repeat_words(w),
        "n_lines": F.size(ln).cast("long"),
        "n_stop_words": number(w, lambda t: t.isin(*stop)),
        "n_upper": without(r"\p{Lu}+"),
        "n_ellipsis_lines": number(ln, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")),
        "n_bullet_lines": number(ln, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "‣")),
    }


#: The ratios of the threshold table, as (part, whole).
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_word_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "upper_char_ratio": ("n_upper", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
}
COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
           "n_stop_words", "n_upper", "n_ellipsis_lines", "n_bullet_lines")


def ratio(m: Column, name: str) -> Column:
    part, whole = RATIOS[name]
    return F.try_divide(m[part].cast("double"), m[whole].cast("double"))


def passes(m: Column, rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one boolean expression over the counts ``m``."""
    ok = F.lit(True)
    for r in rules:
        x = ratio(m, r.measure)
        for limit in ([] if r.low is None else [x >= r.low]) + ([] if r.high is None else [x <= r.high]):
            ok = ok & F.coalesce(limit, F.lit(True))
    return ok


def judged(text: Column, rules: tuple[Rule, ...] = RULES, min_words: int = 50, repeat_pct: int = 50) -> Column:
    """A struct of all measures, ``base_failed`` and ``kept``. Words, lines and
    counts are each bound once inside the expression, so it may stand in a
    filter as well as in a projection."""
    def decided(m: Column) -> Column:
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > repeat_pct * m["n_words"])
        return F.struct(*[m[k].alias(k) for k in COUNTED], *[ratio(m, k).alias(k) for k in RATIOS],
                        failed.alias("base_failed"), (~failed & passes(m, rules)).alias("kept"))

    def over(t: Column) -> Column:
        return let(F.struct(words_of(t).alias("w"), lines_of(t).alias("l")), lambda x: let(
            F.struct(*[c.alias(k) for k, c in counts(t, x["w"], x["l"]).items()]), decided))

    return let(F.coalesce(text, F.lit("")), over)


def score_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``id_col``, all measures, ``base_failed`` and ``kept``."""
    m = [*COUNTED, *RATIOS, "base_failed", "kept"]
    out = df.select(F.col(id_col).alias("_id"), judged(F.col(text_col), rules).alias("_m"))
    return out.select(F.col("_id").alias(id_col), *[F.col("_m")[k].alias(k) for k in m])


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass."""
    return df.where(judged(F.col(f"`{text_col}`"), rules)["kept"])
