import re

import pytest

from logfold.functions.text import ascii_contains, clock, first_line, indent_trace, trace
from pyspark.sql import functions as F

TEXTS = ["", "abc", "ABC", "aXc", "a%c", "a_c", "a\\c", "été", "ÉTÉ", "K", "k", "a\nb c", "x.y", "xzy", "aab",
         "\\E.", "a\U0001f600c", "b ... a"]
PATTERNS = ["abc", "a_c", "a%c", "%", "_", "\\", "é", "Ét", "k", "K", ".", "x.Y", "B%a", "__b", "\\E", "9", "a_%_c", "A\nB"]


def like(text, pattern):
    """Like with only ASCII letters folded, on a text short enough for a naive match."""
    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    shape = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in fold(pattern))
    return re.search(shape, fold(text), re.S) is not None


@pytest.mark.parametrize("pattern", PATTERNS)
def test_like(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r["t"]: r["m"] for r in df.select("t", ascii_contains(F.col("t"), pattern).alias("m")).collect()}
    assert got == {t: like(t, pattern) for t in TEXTS}


def test_pieces_of_a_message(spark):
    df = spark.createDataFrame([("05-01 10:00:00.123", "a\nb\n\nc"), ("10:00", "one"), ("123456", "\nx"), ("", "")], "ts string, m string")
    got = [tuple(r) for r in df.select(clock(F.col("ts")), first_line(F.col("m")), trace(F.col("m")),
                                       indent_trace(trace(F.col("m")))).collect()]
    assert got == [("10:00:00.123", "a", "b\n\nc", "  b\n  \n  c\n"), ("10:00", "one", "", ""), ("123456", "", "x", "  x\n"), ("", "", "", "")]


@pytest.mark.parametrize("lines", [[], ["frame 0"], ["frame 0", "", "  frame 2"], [f"#{k} pc {k * 17:08x}" for k in range(40)]])
def test_every_line_of_a_trace_is_indented(spark, lines):
    df = spark.createDataFrame([("\n".join(lines),)], "t string")
    assert df.select(indent_trace(F.col("t"))).first()[0] == "".join(f"  {x}\n" for x in lines)
