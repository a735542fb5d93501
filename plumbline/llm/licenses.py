"""License scans by diagonal voting, with DataFrame operations only.

Every rolling word k-gram of every text is hashed and joined with the k-grams of
the license templates. A match at text position p and template position q votes
for the diagonal p - q; the votes of a diagonal are one place where the template
may stand, and neighbouring diagonals (some words put in or left out) are merged.
A merged place is accepted if enough different k-grams of the template voted.
Words are compared directly for every match, so a hash alone decides nothing.

Licenses share wording. At each text position the accepted place that matches most
words of its template holds the position, and a place that holds less than half of
its positions gives way: a Lesser GPL notice is not a GPL one, nor a license text
with a share-alike clause the one without. Base phrases stay whatever holds them.

The templates are a parameter of bounded size (MAX_TEMPLATE_WORDS is checked), so
their k-grams are broadcast; texts are not shuffled, only matches are, and those
are keyed by text. Repeated rows are one text's matches, merged before the shuffle.
Nothing is kept per source or per template beyond one text's matches.

Defined results: a null text is empty; a text without a match has zero places
and null positions; a very long text is scanned whole, at one row per match; of
places that match equally many words, that of the first template holds a position;
repeated rows get one result each; an empty table gives an empty result; null ids
are kept; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ALNUM_GAP, ascii_lower, split_words
from plumbline.llm.license_texts import TEMPLATES, Template

#: Words of a k-gram; a template with fewer is one k-gram.
K = 4
#: Diagonals so far apart or nearer are merged.
SLACK = 3
#: Share of a template's k-grams that must match.
COVERAGE = 0.6
#: Words of all templates: their k-grams are broadcast, some 100 bytes each.
MAX_TEMPLATE_WORDS = 500_000


def _hash(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from ``at``. Past the end words are null and the hash
    is of fewer; the comparison of the words themselves rejects such a match."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(tpl, k, q, gram, h): every k-gram of every template."""
    if sum(len(t.words) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
    rows = []
    for n, t in enumerate(templates):
        w = t.words
        k = min(K, len(w))
        rows += [(n, k, q, w[q:q + k]) for q in range(len(w) - k + 1)]
    grams = spark.createDataFrame(rows, "tpl int, k int, q int, gram array<string>")
    by_size = F.coalesce(*[F.when(F.col("k") == k, _hash(F.col("gram"), F.lit(0), k)) for k in range(1, K + 1)])
    return grams.withColumn("h", by_size)


def votes(texts: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, th, tpl, p, q) of all matching k-grams of ``texts`` (id, th, w).

    The explodes and the join are one code-generated stage: a text's words are
    held once and no row is made before a hash matches. ``explode_outer`` as
    ``explode`` adds a filter on the words, which would split every text twice."""
    w = F.col("w")
    at = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1))
    rolled = texts.select("id", "th", "w", F.explode_outer(at).alias("p"))
    rolled = rolled.select("id", "th", "w", "p", F.explode(F.array(*[_hash(w, F.col("p"), k) for k in sizes])).alias("g"))
    met = rolled.join(F.broadcast(grams), F.col("g") == F.col("h"))
    return met.where(F.slice(w, F.col("p") + 1, F.col("k")) == F.col("gram")).select("id", "th", "tpl", "p", "q")


def places(hits: DataFrame, about: DataFrame) -> DataFrame:
    """(id, th, label, base, first, end, coverage) of all accepted places that hold
    their positions.

    A base phrase stands on one diagonal, whole; neighbouring diagonals of another
    template are one place, which needs COVERAGE of the template's k-grams, each
    counted once. ``hits`` may hold a match several times."""
    each = hits.distinct().repartition("id", "th").join(F.broadcast(about), "tpl").withColumn("diagonal", F.col("p") - F.col("q"))
    w = Window.partitionBy("id", "th", "tpl").orderBy("diagonal", "p")
    apart = F.col("diagonal") - F.lag("diagonal").over(w) > F.when(F.col("base"), 0).otherwise(SLACK)
    each = each.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("run", F.sum("apart").over(w))
    place = Window.partitionBy("id", "th", "tpl", "run")
    each = each.withColumn("seen", F.size(F.collect_set("q").over(place)))  # at most the template's k-grams
    each = each.where(F.col("seen") >= F.when(F.col("base"), 1.0).otherwise(COVERAGE) * F.col("grams"))
    strength = F.struct((F.col("seen") + F.col("k")).alias("words"), (-F.col("tpl")).alias("tpl"), F.col("run"))
    holder = F.max("strength").over(Window.partitionBy("id", "th", "p", "base"))
    each = each.withColumn("strength", strength).withColumn("holds", F.col("base") | (F.col("strength") == holder))
    out = each.groupBy("id", "th", "tpl", "run").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.min("p").alias("first"), (F.max("p") + F.first("k")).alias("end"),
        (F.first("seen") / F.first("grams")).alias("coverage"), F.avg(F.col("holds").cast("int")).alias("held"))
    return out.where(F.col("held") >= 0.5)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base``, ``first_word`` and
    ``last_word`` (starts of base places), ``base_labels``, ``labels`` (sorted
    arrays), ``score`` (the best coverage) and ``spans`` (label, first word, end
    word and coverage of every accepted place)."""
    spark = df.sparkSession
    grams = template_grams(spark, templates)
    length = [len(t.words) for t in templates]
    about = spark.createDataFrame([(n, t.label, t.base, length[n] - min(K, length[n]) + 1, min(K, length[n]))
                                   for n, t in enumerate(templates)], "tpl int, label string, base boolean, grams int, k int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"),
                      split_words(ascii_lower(text), ALNUM_GAP).alias("w"))
    sizes = sorted({min(K, n) for n in length})
    found = places(votes(texts, grams, sizes), about)
    start = F.when(F.col("base"), F.col("first")).cast("long")
    found = found.groupBy("id", "th").agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"), F.max("coverage").alias("score"),
        F.sort_array(F.collect_list(F.struct("first", "end", "label", "coverage"))).alias("spans"))
    found = found.select(F.col("id").alias("fid"), F.col("th").alias("fth"), *[c for c in found.columns if c not in ("id", "th")])
    number = texts.select("id", "th", F.size("w").cast("long").alias("n_words"))
    out = number.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word", "last_word", F.sort_array(F.coalesce("base_labels", none)).alias("base_labels"),
        F.sort_array(F.coalesce("labels", none)).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
