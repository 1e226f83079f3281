"""Fingerprints against exact sets of shingles."""

import re

import pytest
from pyspark.sql import functions as F

from logfold.llm import fingerprints as fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i}" for i in range(3000))
ROWS = [(9, "One two three four five six."), (7, None), (4, "été à la ÎLE 😀 x y z ab cd"), (3, LONG), (2, LONG + " tail"), (1, "ab"), (-5, "  \n ")]


def exact(text):
    words = WORD.findall(text.translate(LOW))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def alike(a, b):
    a, b = exact(a), exact(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_exact_sets(spark):
    docs = spark.createDataFrame([(*r, "f", 1) for r in ROWS], "doc_id bigint, text string, fingerprint string, n_chars int").repartition(3)
    found = {r.doc_id: r for r in fp.fingerprints(docs).collect()}
    assert len(found) == len(ROWS)
    texts = [t or "" for _, t in ROWS]
    for k, (i, _) in enumerate(ROWS):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        r = found[i]
        assert (r.n_chars, r.edited) == (len(text), edited)
        for got, want, sets in ((r.near_edited, alike(text, edited), exact(text) | exact(edited)), (r.near_next, alike(text, after), exact(text) | exact(after))):
            assert got == pytest.approx(want, abs=0 if len(sets) <= fp.K else 0.15)
        assert len(r.fingerprint) == 16 * min(fp.K, len(exact(text)))
        assert r.n_shingles == pytest.approx(len(exact(text)), rel=0 if len(exact(text)) < fp.K else 0.3)


def test_odd_rows(spark):
    kinds = "doc_id bigint, text string"
    assert fp.fingerprints(spark.createDataFrame([], kinds)).count() == 0
    one = fp.fingerprints(spark.createDataFrame([(5, "a b c d e f")], kinds)).collect()[0]
    assert (one.edited, one.near_next) == ("a b c d a b", 1.0)
    # Repeated rows, several texts of one id, and null ids, which come after all others.
    rows = [(5, "zz"), (5, "aaaaaa"), (5, "aaaaaa"), (8, "123456"), (None, "qqq"), (None, None)]
    found = sorted((r.doc_id or 0, r.edited) for r in fp.fingerprints(spark.createDataFrame(rows, kinds)).collect())
    assert found == [(0, ""), (0, "qq1"), (5, "aaaa"), (5, "aaaa"), (5, "zz"), (8, "1234aa")]


def test_many_ids_beyond_a_bucket(spark):
    docs = spark.range(0, 3_000_000, 7919).selectExpr("id as doc_id", "concat('text ', id, ' of many') as text")
    rows = sorted(fp.fingerprints(docs).collect(), key=lambda r: -r.doc_id)
    for a, b in zip(rows, [*rows[1:], rows[0]]):
        own, after = f"text {a.doc_id} of many", f"text {b.doc_id} of many"
        assert a.edited == own[:len(own) - len(own) // 3] + after[:len(own) // 3]


def test_parts_merge(spark):
    sketches = spark.createDataFrame([(1, LONG), (1, "one more text of some words"), (2, None), (3, "")], "g int, text string")
    sketches = sketches.withColumn("s", fp.sketch(F.col("text")))
    found = {r.g: r.s for r in fp.merge_groups(sketches, ["g"], "s").collect()}
    assert found[2] == found[3] == []
    first = [r.s for r in sketches.filter("g = 1").collect()]
    assert found[1] == sorted({*first[0], *first[1]})[:fp.K]
    # A text cut in two that share their seam of four words.
    words = LONG.split(" ")
    two = spark.createDataFrame([(" ".join(words[:1504]), " ".join(words[1500:]), LONG)], "a string, b string, whole string")
    row = two.select(fp.merged(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("m"), fp.sketch(F.col("whole")).alias("w"),
                     fp.containment(fp.sketch(F.col("a")), fp.sketch(F.col("whole"))).alias("c")).collect()[0]
    assert row.m == row.w and row.c == 1.0


def test_no_python_in_the_plan(spark):
    plan = fp.fingerprints(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
