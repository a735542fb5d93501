"""URL filters by a temporal list join, with DataFrame operations only.

List entries are dated events: on a day a key (a host, or a domain with all its
hosts) is added to a category or removed from it. They become validity intervals
per key and category; an as-of join evaluates every capture against the entries
that were active at its fetch day, for its host and every parent domain.

The join is on (key, period, part): an interval stands in each period of PERIOD
days that it touches, and captures of one key are dealt by period and by PARTS
parts of their id, so that a host with a third of all captures is split at least
PARTS ways. The list side repeats PARTS times, whatever the data.

Defined results: a null url or fetch day is blocked by nothing; events with a
null key, category or day are no events; of several events of one key, category
and day a removal goes last; adding what is listed, or removing what is not,
changes nothing; repeated rows get one result each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a join period.
PERIOD = 64
#: Parts that the captures of one key and period are dealt to.
PARTS = 16
#: The end of an interval that is still open.
OPEN = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def domain_keys(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    up = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array_join(
        F.slice(labels, i + 1, n), "."))
    return F.when(host.isNotNull(), up)


def validity(events: DataFrame, key: str = "key", category: str = "category", day: str = "day",
             action: str = "action") -> DataFrame:
    """(key, category, since, until): intervals with an exclusive end, from dated
    ``add`` and ``remove`` events."""
    e = events.select(F.col(key).alias("key"), F.col(category).alias("category"), F.col(day).cast("date").alias("since"),
                      F.col(action).alias("action")).dropna().distinct()
    # One event counts per key, category and day.
    e = e.groupBy("key", "category", "since").agg(F.max("action").alias("action"))
    w = Window.partitionBy("key", "category").orderBy("since")
    e = e.withColumn("before", F.lag("action").over(w))
    e = e.where(F.col("before").isNull() | (F.col("before") != F.col("action")))
    e = e.withColumn("until", F.coalesce(F.lead("since").over(w), F.lit(OPEN).cast("date")))
    return e.where("action = 'add'").select("key", "category", "since", "until")


def evaluate(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url",
             day_col: str = "fetched") -> DataFrame:
    """One row per input row: id, ``host``, fetch day, ``blocked``, ``n_entries``,
    the sorted ``categories`` and the longest matching key (``matched``)."""
    src = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"),
                          F.col(day_col).cast("date").alias("day"))
    src = src.withColumn("row", F.struct("id", "host", "day"))
    span = src.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    listed = validity(events)
    period = lambda d: F.floor(F.unix_date(d) / PERIOD).cast("int")
    if span.lo is None:
        listed = listed.where(F.lit(False))
    lo, hi = F.lit(span.lo).cast("date"), F.lit(span.hi).cast("date")
    seen = listed.where((F.col("since") <= hi) & (F.col("until") > lo))
    seen = seen.withColumn("period", F.explode(F.sequence(
        period(F.greatest("since", lo)), period(F.least(F.date_sub("until", 1), hi)))))
    seen = seen.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    asked = src.where(F.col("host").isNotNull() & F.col("day").isNotNull()).distinct().select(
        "row", "day", F.explode(domain_keys(F.col("host"))).alias("key"))
    asked = asked.withColumns({"period": period(F.col("day")),
                               "part": F.pmod(F.xxhash64("row.id"), F.lit(PARTS)).cast("int")})
    hit = asked.join(seen, ["key", "period", "part"]).where("since <= day and day < until")
    found = hit.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sort_array(F.collect_set("category")).alias("categories"),
        F.max_by("key", F.struct(F.length("key"), "key")).alias("matched"))
    found = found.select(F.col("row").alias("hit_row"), "n_entries", "categories", "matched")
    out = src.join(found, F.col("row").eqNullSafe(F.col("hit_row")), "left")
    return out.select(F.col("id").alias(id_col), "host", F.col("day").alias(day_col),
                      F.col("n_entries").isNotNull().alias("blocked"),
                      F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"),
                      F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "matched")
