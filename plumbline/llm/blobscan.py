"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. The
ledger is a Parquet table with one row per (blob, rule version) that has been
scanned, holding the spans found. A scan takes one text per blob, sets the rules
that the ledger holds for it off against all, runs only those that it lacks,
appends to the ledger, and joins the findings back to all paths. A second
run over the same history scans nothing; a new rule version scans every blob
once, for that rule alone.

Scale: copies are scanned once, whatever their paths. Texts are shuffled once, by
blob, after a map-side reduction to one text per blob and task, so no group of
copies makes a task hot. Findings return to the paths through
``common.attach``, which broadcasts the 1000 most frequent blobs and shuffles
the others. An append that is repeated after a failure only repeats rows, which
reading the ledger drops.

Defined results: a null text is empty and has no findings; texts of any length are
scanned whole; a null path is kept; repeated rows get one result each, also under
one path with different texts; of findings that start together the kind listed first
comes first; an empty table gives an empty result; columns other than path and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import attach, store
from plumbline.session import scratch_path


@dataclass(frozen=True)
class SecretRule:
    """A pattern whose matches, leftmost and without overlap, are findings if
    ``group`` has ``least`` characters or more. Raise ``version`` with every change."""
    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1
    cue: str = ""  # a text without it has no match

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base patterns of the query contract, in its order.
BASE_RULES = (
    SecretRule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
               least=8, group=2),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=16, cue="AKIA"),
    SecretRule("hex", r"[0-9a-f]{32,}", least=32),
)
#: A key block from BEGIN to its END line; if END is missing, to the last base64
#: line, also where lines are indented, quoted or escaped.
KEY_BLOCK = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----"
    r"""|(?:(?:[ \t\r\n>"'+,]|\\[rn])*+(?:(?:Proc-Type|DEK-Info|Comment): [^\r\n\\]*"""
    r"""|[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/]+={1,2}|[A-Za-z0-9+/=]+(?=[ \t]*(?:[\r\n"'\\]|\Z))))*+)""")
#: Further credentials with a recognisable form.
FORM_RULES = (
    SecretRule("private_key", KEY_BLOCK, version=2, cue="PRIVATE KEY-----"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", cue="eyJ"),
    SecretRule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]++:[^\s:/@]++@", version=2, cue="://"),
    SecretRule("bearer", r"(?ai:\bbearer\x20+([A-Za-z0-9._~+/=-]+))", least=20, group=1),
    SecretRule("prefixed", r"\b(?:ghp|gho|ghs|ghu|xox[abpr]|sk_live|rk_live)[_-][A-Za-z0-9-]{16,}"),
)
RULES = BASE_RULES + FORM_RULES

LEDGER_SCHEMA = "blob binary, rule string, spans array<struct<start:int,end:int>>"


def spans_of(rule: SecretRule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Findings of one rule, as code point positions with an exclusive end."""
    if rule.cue and rule.cue not in text:
        return []
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scanner(rules: tuple[SecretRule, ...]) -> Callable:
    by_key = {r.key: r for r in rules}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {k: re.compile(r.pattern) for k, r in by_key.items()}
        for b in batches:
            out = [(blob, k, [{"start": s, "end": e} for s, e in spans_of(by_key[k], compiled[k], text or "")])
                   for blob, text, keys in zip(b["blob"], b["text"], b["rules"], strict=True) for k in keys]
            yield pd.DataFrame(out, columns=["blob", "rule", "spans"])
    return run


def read_ledger(spark: SparkSession, path: str | None, rules: tuple[SecretRule, ...]) -> DataFrame:
    """The ledger's rows for the given rule versions; none yet if unwritten."""
    if path is None:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return rows.where(F.col("rule").isin([r.key for r in rules]))


def update_ledger(df: DataFrame, ledger: str, rules: tuple[SecretRule, ...] = RULES, text_col: str = "text") -> None:
    """Scan the (blob, rule version) pairs of ``df`` that ``ledger`` lacks and
    append their findings to it."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one text per blob, reduced map-side: repeated rows and copies leave a task once
    blobs = texts.groupBy(F.unhex(F.sha2("text", 256)).alias("blob")).agg(F.first("text").alias("text"))
    seen = read_ledger(spark, ledger, rules).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    unseen = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    todo = blobs.join(seen, "blob", "left").select("blob", "text", unseen.alias("rules")).where(F.size("rules") > 0)
    todo.mapInPandas(scanner(rules), LEDGER_SCHEMA).write.mode("append").parquet(ledger)


def findings_by_blob(spark: SparkSession, ledger: str, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(blob, found): the blob's findings as (start, rank of the kind, kind, end)
    in that order; blobs without findings have no row."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.kind))])
    one = read_ledger(spark, ledger, rules).where(F.size("spans") > 0).select(
        "blob", F.explode("spans").alias("s"), rank[F.col("rule")].alias("rank"), kind[F.col("rule")].alias("kind"))
    row = F.struct(F.col("s.start").alias("start"), "rank", "kind", F.col("s.end").alias("end"))
    return one.groupBy("blob").agg(F.sort_array(F.collect_set(row)).alias("found"))


def scan_history(df: DataFrame, ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES,
                 path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per input row: ``path_col``, ``blob`` (SHA-256) and ``found``, the
    findings in text order (empty if none). ``ledger`` names the table to go on
    with; without one a fresh ledger is made in the shared scratch folder."""
    spark = df.sparkSession
    ledger = ledger or scratch_path(spark, "secret-ledger")
    update_ledger(df, ledger, rules, text_col)
    paths = df.select(F.col(path_col).alias("_path"),
                      F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob"))
    found = findings_by_blob(spark, ledger, rules)
    n = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("_n")).join(found, "blob")
    out = attach(paths, store(n, "secret-findings"), "blob", "_path", "_n")
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return out.select(F.col("_path").alias(path_col), "blob", F.coalesce("found", empty).alias("found"))


def without_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    rules: tuple[SecretRule, ...] = BASE_RULES + FORM_RULES, mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every finding's characters replaced by ``mask``; overlapping
    findings become one. The scan runs over the ledger, the masking by id."""
    cols = df.columns
    found = scan_history(df.select(id_col, text_col), rules=rules, path_col=id_col, text_col=text_col)
    found = found.where(F.size("found") > 0).dropDuplicates([id_col, "blob"]).select(
        F.col(id_col).alias("_fid"), F.col("blob").alias("_fblob"), "found")
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    same = F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_fid")) & \
        (F.unhex(F.sha2(F.col(f"_row.`{text_col}`"), 256)) == F.col("_fblob"))
    out = held.join(found, same, "left")
    text = F.col(f"_row.`{text_col}`")
    # Pieces between findings; a finding inside an earlier one adds nothing.
    state = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("done")), lambda s, x: F.when(
        x["end"] <= s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.concat(
            s["done"], F.when(x["start"] >= s["at"], F.concat(text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit(mask)))
            .otherwise(F.lit(""))).alias("done"))))
    masked = F.when(F.col("found").isNull(), text).otherwise(
        F.get(F.transform(F.array(state), lambda s: F.concat(s["done"], text.substr(s["at"] + 1, F.length(text)))), F.lit(0)))
    return out.select(*[masked.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in cols])
