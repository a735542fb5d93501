"""The license scan against a brute-force version, and texts that share wording."""

import re
from collections import defaultdict

import pytest

from plumbline.llm import licenses
from plumbline.llm.license_texts import BASE, BODIES, NOTICES, TEMPLATES, creative_commons, gnu_notices
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FILLER = "a red kite flew over the old mill while the farmer mended his gate and sang to the hens "


def words_of(text):
    return RUN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, templates=TEMPLATES):
    """(n_words, base starts, base labels, labels, score) by comparing every position of a
    text with every position of every template."""
    w = words_of(text)
    found = []
    for n, t in enumerate(templates):
        tw = words_of(t.text)
        k = min(licenses.K, len(tw))
        grams = [tw[q:q + k] for q in range(len(tw) - k + 1)]
        votes = defaultdict(set)
        for p in range(len(w) - k + 1):
            for q, g in enumerate(grams):
                if w[p:p + k] == g:
                    votes[p - q].add((p, q))
        runs, before = [], None
        for d in sorted(votes):
            if before is None or d - before > (0 if t.base else licenses.SLACK):
                runs.append(set())
            runs[-1] |= votes[d]
            before = d
        for number, run in enumerate(runs):
            seen = len({q for _, q in run})
            if seen >= len(grams) * (1 if t.base else licenses.COVERAGE):
                found.append((t, n, number, k, seen, run, seen / len(grams)))
    holder = {}
    for t, n, number, k, seen, run, _ in found:
        for p, _ in run:
            key = (p, t.base)
            holder[key] = max(holder.get(key, (0, 0, 0)), (seen + k, -n, number))
    kept = [f for f in found if f[0].base or
            2 * sum(holder[p, False] == (f[4] + f[3], -f[1], f[2]) for p, _ in f[5]) >= len(f[5])]
    starts = sorted(p for f in kept if f[0].base for p in [min(p for p, _ in f[5])])
    return (len(w), starts, sorted({f[0].label for f in kept if f[0].base}), sorted({f[0].label for f in kept}),
            max([f[6] for f in kept], default=0.0))


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan_licenses(df).collect()}


def agrees(row, want):
    n, starts, base, labels, score = want
    assert (row.n_words, row.n_base, row.base_labels, row.labels) == (n, len(starts), base, labels)
    assert (row.first_word, row.last_word) == ((starts[0], starts[-1]) if starts else (None, None))
    assert row.score == pytest.approx(score)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op6_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, starts, base, labels, score = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (n, len(starts), ",".join(base), ",".join(labels))
        assert r.score == pytest.approx(score)


def body(label, of=BODIES):
    return next(t.text for t in of if t.label == label)


def test_whole_edited_and_partial_texts_equal_brute_force(spark):
    mit = body("mit")
    edited = FILLER + mit.replace("to any person", "to any natural person").replace("merge, ", "") + FILLER
    texts = [t.text for t in TEMPLATES] + [edited, mit[100:], mit + FILLER + mit, mit * 3, body("bsd").replace("3. Neither", "Neither"),
                                           "CC BY-NC 4.0 and cc by, cc-by-nc-sa", "isc license isc license", FILLER * 40]
    got = scan(spark, texts)
    for i, text in enumerate(texts):
        agrees(got[i], brute(text))


def test_shared_wording_gets_the_label_of_the_longest_match(spark):
    lesser = next(t.text for t in gnu_notices() if t.label == "lgpl")
    nc_sa = "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."
    tail = body("mit").split("subject to the following")[1]
    agpl = "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"
    isc = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"
    got = scan(spark, [lesser, nc_sa, FILLER + body("mit")[90:], agpl, isc, "Licensed under CC BY-NC 4.0.", tail[:60], body("gpl", gnu_notices())])
    labels = [got[i].labels for i in range(8)]
    assert labels == [["lgpl"], ["cc-by-nc-sa"], ["mit"], ["agpl"], ["isc"], ["cc-by", "cc-by-nc"], [], ["gpl"]]
    assert got[5].base_labels == ["cc-by"] and got[0].base_labels == [] and got[7].base_labels == ["gpl"]


def test_every_template_is_found_under_its_label(spark):
    got = scan(spark, [FILLER + t.text + " " + FILLER for t in TEMPLATES])
    for i, t in enumerate(TEMPLATES):
        assert t.label in got[i].labels and got[i].score == 1.0


def test_repeated_rows_long_texts_and_null_ids(spark):
    notice = NOTICES[0].text
    long = FILLER * 2_000 + notice
    df = spark.createDataFrame([(1, notice)] * 3 + [(None, notice)] * 3 + [(None, "mit license")] + [(2, long), (3, None), (4, "")],
                               "doc_id long, text string")
    rows = licenses.scan_licenses(df).collect()
    assert sorted((r.doc_id or 0, tuple(r.labels), r.n_base) for r in rows) == sorted(
        [(1, ("mit",), 0)] * 3 + [(0, ("mit",), 0)] * 3 + [(0, ("mit",), 1), (2, ("mit",), 0), (3, (), 0), (4, (), 0)])
    assert next(r for r in rows if r.doc_id == 2).spans[0].first == len(words_of(FILLER)) * 2_000


def test_library(spark):
    assert {t.label for t in creative_commons()} == {"cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd"}
    assert [t.text for t in BASE] == ["gnu general public license", "apache license", "cc by", "mit license"]
    with pytest.raises(ValueError):
        licenses.template_grams(spark, (licenses.Template("x", "a b c d " * 200_000),))
