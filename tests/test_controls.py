"""Negative controls: clean input -> zero findings; corrupted -> the audit fires."""

import datetime as dt
import json

from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import telemetry as E
from plumbline.operators import textscan as X
from plumbline.functions.json import flatten_json
from plumbline.operators.etl import etl_history


def test_unique(spark):
    clean = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert A.a_unique(clean, ["a", "b"]).first().is_unique
    dup = clean.unionByName(spark.createDataFrame([(1, 1)], "a int, b int"))
    r = A.a_unique(dup, ["a", "b"]).first()
    assert not r.is_unique and r.duplicated_keys == 1


def test_effective_dates(spark):
    ch = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1), (1, dt.date(2020, 6, 1), 2)], "k int, start date, ref int")
    h = etl_history(ch, "k", "start", "ref")
    r = A.a_effective(h, "k", "start", "effective_end", "is_current").first()
    assert (r.overlaps, r.gaps, r.end_before_start, r.keys_multi_current) == (0, 0, 0, 0)
    bad = h.withColumn("effective_end", F.when(F.col("ref") == 1, F.lit(dt.date(2020, 12, 31)))
                       .otherwise(F.col("effective_end"))).withColumn("is_current", F.lit(True))
    r = A.a_effective(bad, "k", "start", "effective_end", "is_current").first()
    assert r.overlaps == 1 and r.keys_multi_current == 1


def test_orphans(spark):
    dim = spark.createDataFrame([(1,), (2,)], "id int")
    assert A.a_orphans(spark.createDataFrame([(1,), (2,)], "fk int"), dim, "fk", "id").first().orphan_rows == 0
    assert A.a_orphans(spark.createDataFrame([(1,), (3,)], "fk int"), dim, "fk", "id").first().orphan_rows == 1


def test_population_match(spark):
    den = spark.createDataFrame([(1,), (2,)], "k int")
    assert A.a_population_match(spark.createDataFrame([(1,)], "k int"), den, "k").first().not_in_denominator == 0
    assert A.a_population_match(spark.createDataFrame([(1,), (9,)], "k int"), den, "k").first().not_in_denominator == 1


def test_schema_drift(spark):
    s = spark.createDataFrame([("t", "a", "BIGINT")], "table_name string, column_name string, data_type string")
    assert A.a_schema_drift(s, s).count() == 0
    act = spark.createDataFrame([("t", "a", "string")], "table_name string, column_name string, data_type string")
    assert A.a_schema_drift(s, act).first().status == "type_changed"


MD = """intro
```sql
-- only a comment
```
```sql
SELECT ... FROM t
```
```sql
WHERE x = 1
```
```sql
SELECT count(*) FROM dim_worker
```
"""


def test_sql_blocks_classification(spark):
    docs = spark.createDataFrame([(1, MD)], "id int, text string")
    got = [r.classification for r in X.t_sql_blocks(docs, "id", "text", "```sql\n", "```").orderBy("block_no").collect()]
    assert got == ["illustrative", "placeholder", "clause fragment", "executable"]


def test_sql_lint(spark):
    q = spark.createDataFrame([("ok", "SELECT count(*) FROM orders WHERE snapshot_date = DATE '2020-01-01'"),
                               ("bad", "SELECT DISTINCT department FROM raw_table JOIN orders ON x = y")],
                              "id string, text string")
    dep = spark.createDataFrame([("department",)], "c string")
    allowed = spark.createDataFrame([("orders",)], "c string")
    r = {x.id: x for x in X.t_sql_lint(q, "id", "text", dep, allowed).collect()}
    assert r["ok"].n_findings == 0
    assert r["bad"].select_distinct and r["bad"].join_without_asof
    assert r["bad"].n_deprecated == 1 and r["bad"].n_undocumented_tables == 1


FOOTER = """---
**Source:** governed table — `dim_worker_snapshot`
**Confidence:** Medium
**Reviewed:** not reviewed
**Freshness:** data through 2026-06-30
**Owner:** People Analytics
**Population:** regular workers
**Open assumptions:** none
**Caveats:** none
"""


def test_footer_parse(spark):
    a = spark.createDataFrame([(1, FOOTER), (2, "**Source:** raw exploration\n**Confidence:** [High | Low]")],
                              "id int, text string")
    r = {x.id: x for x in X.t_footer_parse(a, ["id"], "text").collect()}
    assert r[1].n_missing == 0 and r[1].confidence == "Medium"
    assert r[2].n_missing == 7 and r[2].missing_fields.startswith("Confidence")


def test_doc_check(spark):
    doc = ("---\nowner: Dana\nlast_verified: 2024-01-01\n---\n## Quick Reference\n## Required Filters\n"
           "## Canonical Tables\n## Gotchas\n## Measures\n## Common Query Patterns\n## Cross-References\nTODO x")
    d = spark.createDataFrame([(1, doc), (2, "owner: <!-- name -->\n")], "id int, text string")
    r = {x.id: x for x in X.t_doc_check(d, "id", "text", dt.date(2024, 2, 1)).collect()}
    assert r[1].has_owner and r[1].n_missing_sections == 0 and r[1].todo_count == 1 and not r[1].stale
    assert not r[2].has_owner and r[2].n_missing_sections == 7 and r[2].stale


def test_explode_nested_results(spark, tmp_path):
    doc = {"mode": "skills", "agent_model": "m", "skill_loading": "per-slice", "repeats": 3,
           "slices": {"s1": [{"id": "e1", "negative": False, "trap": "t", "passed": 1.5, "total": 2,
                              "runs": [1, 2], "assertions": [{"assertion": 1, "verdict": "PASS"}]}],
                      "s2": []}}
    p = tmp_path / "run.json"
    p.write_text(json.dumps(doc))
    df = spark.read.schema(E.NESTED_SCHEMA).option("multiLine", True).json(str(p))
    long = E.e_explode(df)
    assert sorted((r.slice, r.eval_id, r.run_no, r.passed) for r in long.collect()) == [
        ("s1", "e1", 0, 1), ("s1", "e1", 1, 2)]
    s = E.e_score(long).first()
    assert (s.n_runs, s.passed, s.n_lost) == (2, 1.5, 1)


def test_flatten_nested_json(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [10, 20]}, "d": "x"}')], "id int, j string")
    out = flatten_json(df, "id", "j", "a struct<b: int, c: array<int>>, d string")
    assert sorted((r.path, r.value) for r in out.collect()) == [
        ("a.b", "1"), ("a.c[0]", "10"), ("a.c[1]", "20"), ("d", "x")]


def test_read_docs_and_classify_blocks(spark, tmp_path):
    from plumbline.sources.tables import read_docs
    (tmp_path / "a.md").write_text(MD)
    (tmp_path / "b.md").write_text("no code here\n")
    docs = read_docs(spark, str(tmp_path / "*.md"))
    assert docs.count() == 2
    out = X.t_sql_blocks(docs, "path", "text", "```sql\n", "```")
    assert out.count() == 4 and out.where(F.col("classification") == "executable").count() == 1


def test_correction_signals_lexicon(spark):
    from plumbline.operators.compare import lexicon_frame
    turns = spark.createDataFrame([
        (1, 0, "user", "How many people left last year?"),
        (1, 1, "assistant", "Attrition was 12%."),
        (1, 2, "user", "Odd: that doesn't match the dashboard my team keeps, so you need to exclude interns first."),
        (2, 0, "user", "We renamed that field when the plants merged.")], "conv int, turn int, role string, text string")
    hits = X.t_corrections(turns, "conv", "turn", "role", "text", lexicon_frame(spark, X.CORRECTION_SIGNALS))
    got = sorted((r.conv, r.turn, r.signal, r.after_assistant) for r in hits.collect())
    assert got == [(1, 2, "missing filter", True), (1, 2, "reconciliation failure", True),
                   (2, 0, "stale knowledge", False)]
