"""§2.14 text tables (documents, pages, conversations) as Spark jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import textscan as X
from plumbline.operators.compare import lexicon_frame
from plumbline.plans.q_compare import FUNCTION_WORDS, LEX_SQL, TOKENS_SQL
from plumbline.plans.registry import query
from plumbline.sources.tables import TABLE_NAMES, Tables

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
SCRIPT_OPEN, SCRIPT_CLOSE = "<script[^>]*>", "</script>"
BLOCKS = f"regexp_extract_all(html, '(?s){SCRIPT_OPEN}(.*?){SCRIPT_CLOSE}', 1)"


@query("t_sql_blocks", f"""
WITH b AS (SELECT page_id, unnest({BLOCKS}) AS block, unnest(range(0, len({BLOCKS}))) AS block_no FROM pages),
c AS (SELECT *, {STRIP.format(x="array_to_string(list_filter(string_split(block, chr(10)), lambda l: NOT starts_with(" + STRIP.format(x="l") + ", '//')), chr(10))")} AS stripped FROM b)
SELECT page_id, CAST(block_no AS BIGINT) AS block_no, CAST(len(string_split(block, chr(10))) AS BIGINT) AS n_lines,
       CASE WHEN stripped = '' THEN 'illustrative'
            WHEN contains(stripped, '<!--') OR contains(stripped, '...') THEN 'placeholder'
            WHEN upper(regexp_split_to_array(stripped, '\\s+')[1]) IN ({", ".join(f"'{w}'" for w in X.FRAGMENT_WORDS)})
              THEN 'clause fragment'
            ELSE 'executable' END AS classification
FROM c""")
def t_sql_blocks(spark, sf):
    """Every script block of every whole page, classified by the block rules
    (comment prefix '//')."""
    p = Tables(spark, sf).pages
    return X.t_sql_blocks(p, "page_id", "html", SCRIPT_OPEN, SCRIPT_CLOSE, "//")


DEPRECATED = ["department"]
TEXT_ID = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"
IDENT_RE = "[A-Za-z_][A-Za-z0-9_.]*"


@query("t_sql_lint", f"""
WITH q AS (SELECT {TEXT_ID} AS text_id, text FROM conversations),
dep AS (SELECT text_id, count(*) AS n FROM (SELECT text_id, unnest(regexp_extract_all(text, '({IDENT_RE})', 1)) AS i FROM q) x
        WHERE lower(i) IN ({", ".join(f"'{d}'" for d in DEPRECATED)}) GROUP BY 1),
tb AS (SELECT text_id, count(*) AS n FROM (SELECT text_id, unnest(regexp_extract_all(text, '(?i)(?:from|join)\\s+({IDENT_RE})', 1)) AS t FROM q) x
       WHERE lower(t) NOT IN ({", ".join(f"'{n}'" for n in TABLE_NAMES)}) GROUP BY 1),
f AS (SELECT q.text_id,
             regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])select\\s+distinct(?:$|[^A-Za-z0-9_])') AS select_distinct,
             regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])join(?:$|[^A-Za-z0-9_])')
               AND NOT regexp_matches(text, '(?i)effective_start|effective_end|is_current|snapshot_date') AS join_without_asof,
             regexp_matches(text, '(?i)100(?:\\.0)?\\s*\\*|percent')
               AND NOT regexp_matches(text, '(?i)denominator|(?:^|[^A-Za-z0-9_])den(?:$|[^A-Za-z0-9_])') AS pct_without_denominator,
             coalesce(dep.n, 0) AS n_deprecated, coalesce(tb.n, 0) AS n_undocumented_tables
      FROM q LEFT JOIN dep ON dep.text_id = q.text_id LEFT JOIN tb ON tb.text_id = q.text_id)
SELECT *, CAST(select_distinct AS INTEGER) + CAST(join_without_asof AS INTEGER) + CAST(pct_without_denominator AS INTEGER)
          + n_deprecated + n_undocumented_tables AS n_findings FROM f""")
def t_sql_lint(spark, sf):
    """Every conversation turn linted as a query text against the documented
    tables (the driver tables) and a deprecated-identifier list."""
    c = Tables(spark, sf).conversations
    q = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text_id"),
                 "text")
    dep = spark.createDataFrame([(d,) for d in DEPRECATED], "name string")
    allowed = spark.createDataFrame([(n,) for n in TABLE_NAMES], "name string")
    return X.t_sql_lint(q, "text_id", "text", dep, allowed)


def _fields_sql(fields, where_role):
    cols = []
    for f in fields:
        v = f"{STRIP.format(x=f'regexp_extract(text, ' + repr(f'(?m)^[*][*]{f}:[*][*][ \t]*(.*)$') + ', 1)')}"
        cols.append((f, v))
    sel = ", ".join(f"CASE WHEN {v} <> '' AND NOT regexp_matches({v}, '^\\[.*\\]$') THEN {v} END AS "
                    f"{f.lower().replace(' ', '_')}" for f, v in cols)
    names = [f.lower().replace(" ", "_") for f in fields]
    missing = "list_filter([" + ", ".join(f"CASE WHEN {n} IS NULL THEN '{f}' END" for f, n in zip(fields, names)) + \
        "], lambda x: x IS NOT NULL)"
    return f"""WITH p AS (SELECT conv_id, turn, {sel} FROM conversations WHERE role = '{where_role}')
SELECT *, CAST(len({missing}) AS BIGINT) AS n_missing, array_to_string({missing}, ', ') AS missing_fields FROM p"""


@query("t_footer_parse", _fields_sql(X.FOOTER_FIELDS, "assistant").replace("[*][*]", "\\*\\*"))
def t_footer_parse(spark, sf):
    c = Tables(spark, sf).conversations.where(F.col("role") == "assistant")
    return X.t_footer_parse(c, ["conv_id", "turn"], "text")


@query("t_spec_check", _fields_sql(X.SPEC_FIELDS, "user").replace("[*][*]", "\\*\\*"))
def t_spec_check(spark, sf):
    c = Tables(spark, sf).conversations.where(F.col("role") == "user")
    return X.t_spec_check(c, ["conv_id", "turn"], "text")


DOC_AS_OF = dt.date(2024, 1, 30)


@query("t_doc_check", f"""
WITH d AS (SELECT doc_id, text, {STRIP.format(x="regexp_extract(text, '(?m)^owner:[ \\t]*(.*)$', 1)")} AS owner,
                  regexp_extract(text, '(?m)^last_verified:[ \\t]*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS lv FROM documents),
e AS (SELECT *, CASE WHEN lv <> '' THEN TRY_CAST(lv AS DATE) END AS last_verified FROM d)
SELECT doc_id, owner <> '' AND NOT starts_with(owner, '<!--') AS has_owner, last_verified,
       date_diff('day', last_verified, DATE '{DOC_AS_OF}') AS age_days,
       coalesce(date_diff('day', last_verified, DATE '{DOC_AS_OF}') > 90, true) AS stale,
       CAST(""" + " + ".join(f"(CASE WHEN regexp_matches(text, '(?m)^## {s}') THEN 0 ELSE 1 END)"
                              for s in X.DOC_SECTIONS) + """ AS BIGINT) AS n_missing_sections,
       CAST(len(regexp_extract_all(text, '(TODO)', 1)) AS BIGINT) AS todo_count FROM e""")
def t_doc_check(spark, sf):
    """Every document checked as a reference doc as of 2024-01-30."""
    return X.t_doc_check(Tables(spark, sf).documents, "doc_id", "text", DOC_AS_OF)


@query("t_doc_refs", """
WITH cat AS (SELECT lower(table_name) AS t, lower(column_name) AS c FROM information_schema.columns
             WHERE table_name IN (""" + ", ".join(f"'{n}'" for n in TABLE_NAMES) + """)),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_.]*)`', 1)) AS ref FROM documents),
p AS (SELECT doc_id, ref, lower(string_split(ref, '.')[1]) AS p0,
             CASE WHEN len(string_split(ref, '.')) > 1 THEN lower(string_split(ref, '.')[2]) END AS p1 FROM r)
SELECT doc_id, ref FROM p
WHERE NOT (p0 IN (SELECT t FROM cat)
           OR EXISTS (SELECT 1 FROM cat WHERE cat.t = p.p0 AND cat.c = p.p1)
           OR (p1 IS NULL AND p0 IN (SELECT c FROM cat)))""")
def t_doc_refs(spark, sf):
    """Backtick-quoted names in every document vs the catalog of the driver
    tables (names and columns read from the Parquet schemas)."""
    t = Tables(spark, sf)
    cat = spark.createDataFrame([(n, c) for n in TABLE_NAMES for c in getattr(t, n).columns],
                                "table_name string, column_name string")
    return X.t_doc_refs(t.documents, "doc_id", "text", cat)


@query("t_corrections", "WITH " + LEX_SQL + f""",
c AS (SELECT conv_id, turn, role, text,
             coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant', false) AS after_assistant
      FROM conversations),
d AS (SELECT conv_id, turn, after_assistant, {TOKENS_SQL} AS t FROM c WHERE role = 'user'),
u AS (SELECT conv_id, after_assistant, unnest(t) AS term, 1 AS n_words FROM d),
b AS (SELECT conv_id, after_assistant, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term,
             2 AS n_words FROM d),
hits AS (SELECT * FROM (SELECT * FROM u UNION ALL SELECT * FROM b) x JOIN lex USING (term, n_words))
SELECT category AS signal, term, count(*) AS n_hits, count(DISTINCT conv_id) AS n_conversations,
       count(CASE WHEN after_assistant THEN 1 END) AS n_after_assistant, count(DISTINCT conv_id) > 1 AS repeated
FROM hits GROUP BY category, term""")
def t_corrections(spark, sf):
    """Lexicon signals in user turns of every conversation (rehearsal lexicon:
    function words, since the invented prose carries no correction phrases)."""
    c = Tables(spark, sf).conversations
    hits = X.t_corrections(c, "conv_id", "turn", "role", "text", lexicon_frame(spark, FUNCTION_WORDS))
    return X.t_corrections_summary(hits, "conv_id")


@query("t_corrections_volume", "WITH " + LEX_SQL + f""",
c AS (SELECT conv_id, conv_id % 12 + 1 AS month, role, text FROM conversations),
m AS (SELECT month, count(*) AS n_turns FROM c WHERE role = 'user' GROUP BY month),
d AS (SELECT month, {TOKENS_SQL} AS t FROM c WHERE role = 'user'),
u AS (SELECT month, unnest(t) AS term, 1 AS n_words FROM d),
b AS (SELECT month, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term, 2 AS n_words FROM d),
hits AS (SELECT month, category AS signal FROM (SELECT * FROM u UNION ALL SELECT * FROM b) x JOIN lex USING (term, n_words)),
v AS (SELECT signal, month, n_turns, count(*) AS n_hits FROM hits JOIN m USING (month) GROUP BY signal, month, n_turns)
SELECT signal, month, n_turns, n_hits, round(1000.0 * n_hits / n_turns, 6) AS per_1000_turns,
       n_hits - lag(n_hits) OVER (PARTITION BY signal ORDER BY month) AS change FROM v""")
def t_corrections_volume(spark, sf):
    """Signals in user turns per month (the rehearsal's month of a conversation
    follows from its id, as the turns carry no date)."""
    c = Tables(spark, sf).conversations.withColumn("month", F.col("conv_id") % 12 + 1)
    hits = X.t_corrections(c, "conv_id", "turn", "role", "text", lexicon_frame(spark, FUNCTION_WORDS), extra=["month"])
    turns = c.where(F.col("role") == "user").groupBy("month").agg(F.count(F.lit(1)).alias("n_turns"))
    return X.t_corrections_volume(hits, "month", turns)


@query("t_corrections_stream", "WITH " + LEX_SQL + f""",
d AS (SELECT conv_id, {TOKENS_SQL} AS t FROM conversations WHERE role = 'user'),
u AS (SELECT conv_id, unnest(t) AS term, 1 AS n_words FROM d),
b AS (SELECT conv_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term,
             2 AS n_words FROM d),
hits AS (SELECT * FROM (SELECT * FROM u UNION ALL SELECT * FROM b) x JOIN lex USING (term, n_words))
SELECT category AS signal, term, count(*) AS n_hits, count(DISTINCT conv_id) AS n_conversations
FROM hits GROUP BY category, term""")
def t_corrections_stream(spark, sf):
    """The correction scan as a Structured Streaming job over arriving
    conversation turns (stateless hits appended to a sink), summarised in
    batch over the sink."""
    from plumbline.streaming import run_term_hits_stream
    t = Tables(spark, sf)
    hits = run_term_hits_stream(spark, f"{sf.rstrip('/')}/conversations.parquet", t.conversations.schema,
                                "conv_id", "text", lexicon_frame(spark, FUNCTION_WORDS),
                                where=F.col("role") == "user")
    return hits.groupBy(F.col("category").alias("signal"), "term").agg(
        F.count("*").alias("n_hits"), F.count_distinct("conv_id").alias("n_conversations"))
