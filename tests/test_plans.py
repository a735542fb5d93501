"""Plan-level guards over every registered query: no cross joins (Cartesian
or broadcast nested-loop joins) and no Python UDF evaluation nodes."""

import contextlib
import io

import __spark_entry__ as E
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas")


def test_no_cross_joins_or_python_udfs(spark):
    bad = {}
    for name, build in E.queries().items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            build(spark, SF_SMALL).explain(mode="formatted")
        hits = [w for w in FORBIDDEN if w in buf.getvalue()]
        if hits:
            bad[name] = hits
    assert bad == {}
