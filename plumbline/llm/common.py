"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

from plumbline.session import scratch_path

#: The two word definitions of the query contracts.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Keys that :func:`attach` treats as hot. By counting, a key outside the
#: HOT_KEYS most frequent holds at most 1/HOT_KEYS of all rows.
HOT_KEYS = 1000
#: Bytes of JSON up to which the row of a hot key is broadcast (2 MB in all), and
#: the copies that a wider one is dealt in.
MAX_WIDTH = 2000
WIDE_PARTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, gap: str = WORD_GAP) -> Column:
    """The maximal runs of non-gap characters; null and blank text give none.
    The gaps' characters are ASCII. The ends are trimmed by character set: a
    pattern anchored at the end is tried from every gap of the text."""
    ends = "".join(c for c in map(chr, range(128)) if re.fullmatch(gap, c))
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(ends))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, gap))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with any column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage is cut, and
    lost executors cost no recomputation of what stands before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_width(schema: StructType) -> bool:
    """Whether no column's values vary in size."""
    return not any(isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType, VariantType)) for f in schema)


def attach(left: DataFrame, right: DataFrame, key: str, row_id: str, weight: str,
           keep_unmatched: bool = True) -> DataFrame:
    """Join each row of ``left`` with its one row of ``right`` (unique in
    ``key``) although one key may hold most of ``left``.

    ``weight`` is the number of left rows of the key. The HOT_KEYS heaviest keys
    are joined by broadcast, the others, each at most 1/HOT_KEYS of all rows, by a
    shuffle join, where the hot rows are dealt by ``row_id`` so that none piles up.
    At most HOT_KEYS rows of MAX_WIDTH bytes are broadcast, whatever the size: of a
    hot row that is wider only its key's hash is, and it takes the shuffle join in
    WIDE_PARTS copies, among which ``row_id`` deals the left rows of its key. Null
    keys match nothing. Columns: those of ``left``, then those of ``right`` but ``key``."""
    cols = [c for c in right.columns if c != key]
    whole = F.struct(F.col(key).alias("_hk"), F.struct(*cols).alias("_hot"))
    fixed = bounded_width(right.schema)
    if fixed:
        hot = right.orderBy(F.desc(weight), key).limit(HOT_KEYS).select(whole.alias("_h"), F.lit(False).alias("_wide"))
        on = F.col(key) == F.col("_h._hk")
        parts = F.array(F.lit(0).cast("long"))
        cold = right
    else:
        # Rows that are too wide lose their content before the sort carries them.
        narrow = F.octet_length(F.to_json(F.struct(*right.columns))) <= MAX_WIDTH
        hot = right.select(F.xxhash64(key).alias("_hh"), F.col(weight).alias("_hw"), F.when(narrow, whole).alias("_h"))
        hot = store(hot.orderBy(F.desc("_hw"), "_hh").limit(HOT_KEYS).dropDuplicates(["_hh"]).select(
            "_hh", "_h", F.col("_h").isNull().alias("_wide")), "hot-keys")
        on = (F.xxhash64(key) == F.col("_hh")) & (F.col("_wide") | (F.col(key) == F.col("_h._hk")))
        wide = hot.where("_wide").select(F.col("_hh").alias("_wh"))
        cold = right.join(F.broadcast(wide), F.xxhash64(key) == F.col("_wh"), "left")
        parts = F.when(F.col("_wh").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.sequence(F.lit(0).cast("long"), F.lit(WIDE_PARTS - 1).cast("long")))
    cold = cold.select(F.col(key).alias("_ck"), F.struct(*cols).alias("_cold"), F.explode(parts).alias("_cs"))
    alone = F.xxhash64(row_id, F.lit("hot")).bitwiseOR(F.lit(1).cast("long"))
    spread = F.when(F.col("_wide"), F.pmod(F.xxhash64(row_id, F.lit("wide")), F.lit(WIDE_PARTS).cast("long"))) \
        .when(F.col("_h").isNotNull() | F.col(key).isNull(), alone).otherwise(F.lit(0).cast("long"))
    out = left.join(F.broadcast(hot), on, "left").withColumn("_s", spread)
    out = out.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left")
    got = F.coalesce("_h._hot", "_cold")
    if not keep_unmatched:
        out = out.where(got.isNotNull())
    return out.select(*left.columns, *[got[c].alias(c) for c in cols])
