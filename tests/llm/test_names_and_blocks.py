"""Surrogates against brute force, wide hot rows, benchmark blocks, edge rows of the pipeline's stages and of the URL filter."""

import random
import re
import string
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from plumbline.llm import common, decontam, surrogates, urlfilter

SF = "/root/testdata/sf0.01"


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r for r in sorted(surrogates.replace_pii(df, "k").collect(), key=lambda r: r.doc_id)]


def test_names_leave_no_part(spark):
    texts = ["Mr John Smith Jones, later Smith or JONES", "Mr Jean-Luc Picard and Jean-Luc", "Mrs O'Brien's dog, d'Artagnan",
             "Frau Müller-Lüdenscheidt und Lüdenscheidt", "Prof. Dr. Anna van der Berg", "Mr d'Artagnan", "Ms. de la Cruz",
             "г-жа Анна Петрова", "Κύριος Νίκος Παππάς", "السيد خالد حسن", "श्री अमित शर्मा", "Dr 王小明", "Mr SMITH"]
    parts = ["John|Smith|Jones|JONES", "Jean|Luc|Picard", "Brien", "Müller|Lüdenscheidt", "Anna|Berg", "Artagnan", "Cruz",
             "Анна|Петрова", "Νίκος|Παππάς", "خالد|حسن", "अमित|शर्मा", "王|小|明", "SMITH"]
    out = replaced(spark, texts)
    for r, p in zip(out, parts, strict=True):
        assert not re.search(p, r.text), r.text
    assert regex.fullmatch(r"Mr \p{Lu}\p{Ll}+-\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+ and \p{Lu}\p{Ll}+-\p{Lu}\p{Ll}+", out[1].text)
    assert regex.fullmatch(r"Mrs O'\p{Lu}\p{Ll}+'s dog, d'Artagnan", out[2].text)
    a, b = regex.fullmatch(r"Frau \p{Lu}\p{Ll}+-(\p{Lu}\p{Ll}+) und (\p{Lu}\p{Ll}+)", out[3].text).groups()
    assert a == b
    assert out[4].text.startswith("Prof. Dr. ") and " van der " in out[4].text
    assert out[6].text.startswith("Ms. de la ") and out[12].text[3:].isupper()
    scripts = [(7, "IsCyrillic"), (8, "IsGreek"), (9, "IsArabic"), (10, "IsDevanagari"), (11, "IsHan")]
    for i, s in scripts:
        assert regex.fullmatch(rf"\S+(?: [\p{{{s}}}\p{{M}}]+)+", out[i].text), out[i].text


def test_network_and_bank_forms(spark):
    texts = ["2001:DB8:85A3::8A2E:370:7334", "2001:db8:85a3:0:0:8a2e:370:7334", "std::dead::beef 12:30:45", "DE89 3704 0044 0532 0130 00",
             "DE89370400440532013000", "4111 1111 1111 1111"]
    out = [r.text for r in replaced(spark, texts)]
    groups = [g for g in out[0].lower().split(":") if g]
    assert out[0] == out[0].upper() and "::" in out[0] and groups == [g for g in out[1].split(":") if g != "0"]
    assert out[2] == texts[2]
    assert out[3].replace(" ", "") == out[4] != texts[4] and [len(x) for x in out[3].split()] == [4, 4, 4, 4, 4, 2]
    moved = out[4][4:] + out[4][:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and out[4][:2] == "DE"
    digits = [int(c) for c in out[5].replace(" ", "")][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0 and out[5] != texts[5]


def test_long_texts_do_not_overflow(spark):
    out = replaced(spark, ["a@b" + ".c" * 50_000, "Mr " + "A'b" * 20_000, "Dr " + "X" * 100_000, "1:" * 50_000, None, ""])
    assert [r.n_entities for r in out] == [1, 1, 1, 0, 0, 0] and out[4].text is None and out[5].text == ""


def normal(kind, value):
    return value.lower() if kind == "email" else re.sub(r"[^+\d]", "", value) if kind in ("phone", "ssn", "card") else value


def test_surrogates_against_brute_force(spark):
    """Over a whole table: text outside entities stays, one entity has one
    surrogate, two have two, and none of them is an original."""
    simple = {"email": r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "phone": r"\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,3}",
              "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.]\d|\w)"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    old = {r.doc_id: r.text for r in docs.collect()}
    rows = surrogates.replace_pii(docs, "k").collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(old))
    made, seen = defaultdict(set), 0
    for r in rows:
        if r.n_entities == 0:
            assert r.text == old[r.doc_id]
            continue
        for kind, pattern in simple.items():
            before, after = re.findall(pattern, old[r.doc_id]), re.findall(pattern, r.text)
            assert len(before) == len(after) == r[f"n_{kind}"]
            for a, b in zip(before, after, strict=True):
                made[kind, normal(kind, a)].add(normal(kind, b))
                seen += 1
        if r.n_name == 0:
            gaps = "|".join(simple.values())
            if r.n_entities == sum(r[f"n_{k}"] for k in simple):
                assert re.split(gaps, old[r.doc_id]) == re.split(gaps, r.text)
    assert seen > 0 and all(len(s) == 1 for s in made.values())
    flat = [(k, next(iter(s))) for (k, _), s in made.items()]
    assert len(set(flat)) == len(flat) and not set(flat) & set(made)


def test_attach_wide_hot_rows(spark):
    """A hot key whose row is too wide for a broadcast, beside narrow ones."""
    big = "".join(random.Random(1).choices(string.ascii_letters, k=5_000))
    left = spark.range(3_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "wide").when(F.col("id") % 3 == 1, "thin").when(
        F.col("id") % 30 == 2, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    keys = left.groupBy("key").agg(F.count(F.lit(1)).alias("w")).where("key <> 'k5'")
    right = keys.withColumn("payload", F.when(F.col("key") == "wide", F.lit(big)).otherwise(F.concat(F.lit("p-"), "key")))
    for keep in (True, False):
        got = Counter((r.id, r.key, r.payload, r.w) for r in common.attach(left, right, "key", "id", "w", keep_unmatched=keep).collect())
        how = "left" if keep else "inner"
        want = Counter((r.id, r.key, r.payload, r.w) for r in left.join(right, "key", how).collect())
        assert got == want
    assert not common.bounded_width(right.schema) and common.bounded_width(spark.range(1).schema)


def test_benchmark_blocks(spark):
    """Many blocks give what one gives, with repeated and null rows and ids."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 2, 5, 13, 30))))) for i in range(40)] + [(None, "w1 w2"), (99, None)]
    docs = [(i, " ".join(word() for _ in range(rng.choice((0, 3, 50, 200))))) for i in range(60)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, docs[8][1]), (100, None)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")

    def run(words):
        out = decontam.find_contamination(df, bench, window=4, max_block_words=words).collect()
        # spans of one text may be cut otherwise; the words under them are the same
        cover = lambda r: tuple(sorted({i for s in r.spans for i in range(s.s, s.e)}))
        return Counter((r.doc_id, r.n_words, cover(r), r.n_hit, tuple(r["items"]), r.contaminated) for r in out)

    one = run(10_000)
    assert one == run(50) and sum(one.values()) == len(docs) and any(k[5] for k in one)
    clean = lambda w: Counter(map(tuple, decontam.keep_clean(df, bench, window=4, max_block_words=w).collect()))
    assert clean(10_000) == clean(50)


def test_pipeline_stage_edges(spark, tmp_path):
    """Null, empty, long and repeated rows and an empty table through every stage."""
    import corpus_pipeline
    prose = "the quick brown fox of the north and a lazy dog in the garden was seen by them on the way to town. "
    long = "\n".join(f"the line {i} of this text has some words that are its own, and the end is here." for i in range(3_000))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    rows = [(1, None), (2, ""), (3, prose), (None, long), (4, long), (4, long), (5, long + " password = abcdefgh12345")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select(*[df[c] if c in df.columns else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), SF).count() == 0, name
        got = stage(spark, df, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns, name
        ids = [r.doc_id for r in got.collect()]
        assert not Counter(ids) - Counter(i for i, _ in rows), name
        if name in ("secret scan", "bpe encoding"):
            assert Counter(ids) == Counter(i for i, _ in rows), name
    masked = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, df, SF).collect()}
    assert "abcdefgh12345" not in masked[5] and masked[5].startswith(long) and masked[1] is None and masked[2] == ""


def test_url_filter_edges(spark):
    """Repeated and tied captures, null days and urls, events of one day."""
    events = spark.createDataFrame([
        ("a.example", "ads", "2024-01-01", "add"), ("a.example", "ads", "2024-01-10", "remove"), ("a.example", "ads", "2024-01-10", "add"),
        ("example", "adult", "2024-01-01", "add"), ("b.a.example", "ads", "2024-02-01", "add"), (None, "ads", "2024-01-01", "add"),
        ("a.example", None, "2024-01-01", "add"), ("a.example", "ads", None, "add")], "key string, category string, day string, action string")
    rows = [(1, "http://b.a.example/x", "2024-01-09"), (1, "http://b.a.example/x", "2024-01-09"), (2, "http://b.a.example/x", "2024-01-10"),
            (3, "http://b.a.example:80/", "2024-02-01"), (4, None, "2024-01-05"), (5, "http://a.example/", None), (None, "HTTP://A.Example/", "2024-01-01"),
            (6, "no url", "2024-01-05"), (7, "", "2024-01-05"), (8, "http://x.a.example/" + "p" * 100_000, "2023-12-31")]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("key", F.lit("clash"))
    got = Counter((r.page_id, r.blocked, tuple(r.categories), r.matched) for r in urlfilter.evaluate(df, events).collect())
    assert got == Counter([(1, True, ("ads",), "a.example")] * 2 + [
        (2, False, (), None), (3, True, ("ads",), "b.a.example"), (4, False, (), None), (5, False, (), None),
        (None, True, ("ads",), "a.example"), (6, False, (), None), (7, False, (), None), (8, False, (), None)])
    assert urlfilter.evaluate(df.where("false"), events).count() == 0
    assert not any(r.blocked for r in urlfilter.evaluate(df, events.where("false")).collect())
