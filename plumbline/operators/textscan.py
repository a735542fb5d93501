"""Text tables as Spark jobs (§2.14): code-block extraction and
classification, regex lint of query texts, provenance-footer and
question-spec parsing, reference-doc checks and correction scans.

Whole texts are scanned JVM-side (regexp_extract_all / rlike); lexicons and
catalogs are small frames joined after a size check. Regex only -- no SQL
parser."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import safe_div
from plumbline.operators.compare import term_hits
from plumbline.operators.joins import broadcast_bounded
from plumbline.session import spread_small_scan

# First words that mark a clause fragment rather than a query.
FRAGMENT_WORDS = ["WHERE", "GROUP", "ORDER", "HAVING", "AND", "OR", "JOIN", "FROM"]
# Provenance footer fields, in template order.
FOOTER_FIELDS = ["Source", "Confidence", "Reviewed", "Freshness", "Owner", "Population",
                 "Open assumptions", "Caveats"]
# Question-spec fields that must be filled before analysis.
SPEC_FIELDS = ["Population", "Time basis", "Grain", "Measure", "Comparison"]
# Required sections of a domain reference doc.
DOC_SECTIONS = ["Quick Reference", "Required Filters", "Canonical Tables", "Gotchas", "Measures",
                "Common Query Patterns", "Cross-References"]
# Correction signals and their example phrasings.
CORRECTION_SIGNALS = [
    ("wrong source", "that's not the table we use"),
    ("missing filter", "you need to exclude"),
    ("wrong definition", "we count regrettable differently"),
    ("reconciliation failure", "that doesn't match the dashboard"),
    ("stale knowledge", "we renamed that field"),
    ("scope error", "that shouldn't include"),
]

WS_TRIM = r"^\s+|\s+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, WS_TRIM, "")


def t_sql_blocks(docs: DataFrame, id_col: str, text: str, open_re: str, close_re: str,
                 comment_prefix: str = "--") -> DataFrame:
    """Every fenced block of every whole document, classified as
    illustrative (comment-only), placeholder/elided, clause fragment or
    executable, with its line count."""
    pat = f"(?s){open_re}(.*?){close_re}"
    blocks = spread_small_scan(docs).select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(pat), 1)).alias("block_no", "block"))
    kept = F.filter(F.split("block", "\n"), lambda l: ~_strip(l).startswith(comment_prefix))
    stripped = _strip(F.array_join(kept, "\n"))
    first = F.upper(F.split(stripped, r"\s+")[0])
    cls = (F.when(stripped == "", "illustrative")
           .when(stripped.contains("<!--") | stripped.contains("..."), "placeholder")
           .when(first.isin(FRAGMENT_WORDS), "clause fragment").otherwise("executable"))
    return blocks.select(id_col, F.col("block_no").cast("long").alias("block_no"),
                         F.size(F.split("block", "\n")).cast("long").alias("n_lines"), cls.alias("classification"))


IDENT = r"[A-Za-z_][A-Za-z0-9_.]*"
#: Names of a parameter list up to which it is compiled into the scan.
MAX_COMPILED_NAMES = 10_000


def _names(listed: DataFrame) -> DataFrame:
    """The distinct lower-case names in the first column of a parameter list."""
    name = F.lower(F.col(listed.columns[0]))
    return listed.select(name.alias("__name")).where(name.isNotNull()).distinct()


def _compiled(names: DataFrame) -> list[str] | None:
    """The names, or None where they are more than MAX_COMPILED_NAMES."""
    got = [r[0] for r in names.limit(MAX_COMPILED_NAMES + 1).collect()]  # a parameter
    return got if len(got) <= MAX_COMPILED_NAMES else None


def t_sql_lint(queries: DataFrame, id_col: str, text: str, deprecated: DataFrame,
               allowed_tables: DataFrame) -> DataFrame:
    """Regex features of each query text: SELECT DISTINCT, a join with no
    as-of predicate, a percentage with no denominator column, deprecated
    identifiers and tables missing from the documented list. One scan: the
    name lists are parameters, compiled into it as hash sets; no rows are made
    of identifiers. A list of more than MAX_COMPILED_NAMES names is joined
    instead, with one row per identifier. A null text has null features and no
    names; repeated rows get one result each."""
    queries = spread_small_scan(queries)
    t = F.col(text)
    distinct = t.rlike(r"(?i)(?:^|[^A-Za-z0-9_])select\s+distinct(?:$|[^A-Za-z0-9_])")
    join_no_asof = t.rlike(r"(?i)(?:^|[^A-Za-z0-9_])join(?:$|[^A-Za-z0-9_])") & \
        ~t.rlike(r"(?i)effective_start|effective_end|is_current|snapshot_date")
    pct_no_den = t.rlike(r"(?i)100(?:\.0)?\s*\*|percent") & ~t.rlike(r"(?i)denominator|(?:^|[^A-Za-z0-9_])den(?:$|[^A-Za-z0-9_])")
    found = lambda pattern: F.transform(
        F.coalesce(F.regexp_extract_all(t, F.lit(pattern), 1), F.array().cast("array<string>")), F.lower)
    ids, tabs = found(f"({IDENT})"), found(rf"(?i)(?:from|join)\s+({IDENT})")
    flags = [distinct.alias("select_distinct"), join_no_asof.alias("join_without_asof"), pct_no_den.alias("pct_without_denominator")]
    old, known = _names(deprecated), _names(allowed_tables)
    old_list, known_list = _compiled(old), _compiled(known)
    if old_list is not None and known_list is not None:
        out = queries.select(id_col, *flags, F.size(F.filter(ids, lambda i: i.isin(old_list))).cast("long").alias("n_deprecated"),
                             F.size(F.filter(tabs, lambda i: ~i.isin(known_list))).cast("long").alias("n_undocumented_tables"))
    else:
        each = queries.withColumn("__row", F.monotonically_increasing_id()).select("__row", id_col, *flags, F.explode_outer(F.concat(
            F.transform(ids, lambda i: F.struct(F.lit("id").alias("__kind"), i.alias("__name"))),
            F.transform(tabs, lambda i: F.struct(F.lit("table").alias("__kind"), i.alias("__name"))))).alias("__at"))
        each = each.select("*", "__at.*").drop("__at")
        listed = old.withColumn("__kind", F.lit("id")).unionByName(known.withColumn("__kind", F.lit("table")))
        each = each.join(broadcast_bounded(listed.withColumn("__in", F.lit(True)), 100_000), ["__kind", "__name"], "left")
        out = each.groupBy("__row").agg(
            F.first(id_col).alias(id_col), *[F.first(c).alias(c) for c in ("select_distinct", "join_without_asof", "pct_without_denominator")],
            F.count_if((F.col("__kind") == "id") & F.col("__in").isNotNull()).alias("n_deprecated"),
            F.count_if((F.col("__kind") == "table") & F.col("__in").isNull()).alias("n_undocumented_tables")).drop("__row")
    return out.withColumn("n_findings", F.col("select_distinct").cast("int") + F.col("join_without_asof").cast("int")
                          + F.col("pct_without_denominator").cast("int") + F.col("n_deprecated")
                          + F.col("n_undocumented_tables"))


def _field(text: Column, name: str) -> Column:
    v = F.regexp_extract(text, rf"(?m)^\*\*{name}:\*\*[ \t]*(.*)$", 1)
    filled = (_strip(v) != "") & ~_strip(v).rlike(r"^\[.*\]$")
    return F.when(filled, _strip(v))


def _parse_fields(df: DataFrame, keep: Sequence[str], text: str, fields: Sequence[str]) -> DataFrame:
    cols = {f: _field(F.col(text), f) for f in fields}
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(f)) for f, c in cols.items()]))
    return df.select(*keep, *[c.alias(f.lower().replace(" ", "_")) for f, c in cols.items()],
                     F.size(missing).cast("long").alias("n_missing"),
                     F.array_join(missing, ", ").alias("missing_fields"))


def t_footer_parse(answers: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """Provenance fields parsed from each answer; missing-field list."""
    return _parse_fields(answers, keep, text, FOOTER_FIELDS)


def t_spec_check(specs: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """Which of population / time / grain / measure / comparison are filled."""
    return _parse_fields(specs, keep, text, SPEC_FIELDS)


def t_doc_check(docs: DataFrame, id_col: str, text: str, as_of, max_age_days: int = 90,
                sections: Sequence[str] = DOC_SECTIONS) -> DataFrame:
    """Reference-doc hygiene: a named owner, last_verified age, required
    sections present, TODO count."""
    docs = spread_small_scan(docs)
    t = F.col(text)
    owner = _strip(F.regexp_extract(t, r"(?m)^owner:[ \t]*(.*)$", 1))
    has_owner = (owner != "") & ~owner.startswith("<!--")
    lv = F.regexp_extract(t, r"(?m)^last_verified:[ \t]*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    lvd = F.when(lv != "", F.try_to_date(lv, "yyyy-MM-dd"))
    missing = F.array_compact(F.array(*[F.when(~t.rlike(f"(?m)^## {s}"), F.lit(s)) for s in sections]))
    age = F.datediff(F.lit(as_of), lvd).cast("long")
    return docs.select(id_col, has_owner.alias("has_owner"), lvd.alias("last_verified"), age.alias("age_days"),
                       F.coalesce(age > max_age_days, F.lit(True)).alias("stale"),
                       F.size(missing).cast("long").alias("n_missing_sections"),
                       F.size(F.regexp_extract_all(t, F.lit("(TODO)"), 1)).cast("long").alias("todo_count"))


def t_doc_refs(docs: DataFrame, id_col: str, text: str, catalog: DataFrame) -> DataFrame:
    """Backtick-quoted `table` or `table.column` names in docs that the
    catalog (table_name, column_name) does not know: names whose first part is no
    table, nor, standing alone, a column. One row per place, from one scan of the
    texts; only the names found meet the catalog, in one anti join."""
    refs = spread_small_scan(docs).select(id_col, F.explode(F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][A-Za-z0-9_.]*)`"), 1))
                       .alias("ref"))
    parts = F.split("ref", r"\.")
    name = lambda c, alone: F.struct(F.lower(c).alias("__name"), F.lit(alone).alias("__alone"))
    names = F.array(name("table_name", True), name("table_name", False), name("column_name", True))
    known = catalog.select(F.explode(names).alias("k")).select("k.*").distinct()
    r = refs.withColumns({"__name": F.lower(parts[0]), "__alone": F.size(parts) == 1})
    return r.join(broadcast_bounded(known, 1_000_000), ["__name", "__alone"], "left_anti").select(id_col, "ref")


def t_corrections(turns: DataFrame, conv: str, turn: str, role: str, text: str, lexicon: DataFrame,
                  user_role: str = "user", extra: Sequence[str] = ()) -> DataFrame:
    """Correction signals in user turns: one row per hit with its signal
    category, the turn position and whether it answers an assistant turn
    (``lag`` within the conversation)."""
    from plumbline.operators.sequence import keyed_window
    t = keyed_window(turns, conv, [turn], lag=[role])  # skew-safe per conversation
    t = t.withColumn("after_assistant", F.coalesce(F.col(f"prev_{role}") == "assistant", F.lit(False))) \
        .drop(f"prev_{role}")
    u = t.where(F.col(role) == user_role)
    return term_hits(u, conv, text, lexicon, extra=[turn, "after_assistant", *extra]) \
        .withColumnRenamed("category", "signal")


def t_corrections_summary(hits: DataFrame, conv: str) -> DataFrame:
    """Volume per signal and term, and whether the same correction recurs
    across conversations."""
    return hits.groupBy("signal", "term").agg(F.count("*").alias("n_hits"),
                                              F.count_distinct(conv).alias("n_conversations"),
                                              F.count_if("after_assistant").alias("n_after_assistant")) \
        .withColumn("repeated", F.col("n_conversations") > 1)


def t_corrections_volume(hits: DataFrame, period: str, turns: DataFrame) -> DataFrame:
    """Hits per signal and period, per 1000 of the period's ``turns`` (``period``,
    ``n_turns``), with the change from the period that the signal last occurred in."""
    v = hits.groupBy("signal", period).agg(F.count(F.lit(1)).alias("n_hits")).join(turns, period)
    before = F.lag("n_hits").over(Window.partitionBy("signal").orderBy(period))  # one row per period
    return v.select("signal", period, "n_turns", "n_hits", F.round(safe_div(F.col("n_hits") * 1000, "n_turns"), 6).alias("per_1000_turns"),
                    (F.col("n_hits") - before).alias("change"))
