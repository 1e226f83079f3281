import pytest

from logfold.functions.parse import parse_lines, rejected_lines, to_long
from pyspark.sql import functions as F

H = "03-17 22:41:09.507"
LINE = H + "  81  92 W Radio : link: up"
# line, then (pid, tid, level, tag, message) or None
CASES = [
    # A line that ends anywhere before its tag is closed is none; after that, what is left is the message.
    *[(LINE[:k], None) for k in range(LINE.index(": link") + 2)],
    *[(LINE[:k], (81, 92, "W", "Radio", LINE[LINE.index("link"):k])) for k in range(LINE.index("link"), len(LINE) + 1)],
    *[(f"{H} 81 92 {c} Radio : on", (81, 92, c, "Radio", "on")) for c in "VDIWEF"],
    *[(f"{H} 81 92 {c} Radio : on", None) for c in "XSvw5-"],
    (f"{H[:10]}  81  92 W Radio : short clock", None), (f"{H[:-1]}  81 W Radio : one number", None), (f"{H}  81  92 W   : no tag", None),
    (H + "  12345678 I Tag : x", None),
    (H + "1234 5678ITag: x", (1234, 5678, "I", "Tag", "x")),
    (H + "  1234  5678 I  : a: msg", None),
    (H + "  1234  5678 I Tag :", None),
    ("any eighteen chars 1 2 I T: m", (1, 2, "I", "T", "m")),
    (H + "  1  2 I a:b : c", (1, 2, "I", "a:b", "c")), (H + "  1  2 I :x : c", (1, 2, "I", ":x", "c")),
    (H + "  1  2 I \t : c", None),
    (H + "  1  2 I \t　T a : c", (1, 2, "I", "T a", "c")),
    (H + "  1  2 I été : c", (1, 2, "I", "été", "c")),
    (H + "  1  2 I T : a b\rc\n d", (1, 2, "I", "T", "a b\rc\n d")),
    (H + "  1  2 I T : $1 \\2", (1, 2, "I", "T", "$1 \\2")),
    (H + "  9999999999999999999  00000000000000000000007 I T : x", (0, 7, "I", "T", "x")),
    (H + "  1  2", None), (H + "  1  2 I", None), (H + "  1  2 I ", None), (H + "  1 I T : x", None),
    # The timestamp is 18 bytes: a character may end there, but not straddle it.
    (H[:-2] + "é 1 2 I T: m", (1, 2, "I", "T", "m")), (H[:-1] + "é1 2 I T: m", None),
]


def test_cases(lines_frame):
    frame = lines_frame({"d": [(i, line) for i, (line, _) in enumerate(CASES)]})
    rows = {r["seq"]: r for r in parse_lines(frame).collect()}
    got = {i: (r["pid"], r["tid"], r["level"], r["tag"], r["msg"]) for i, r in rows.items()}
    assert got == {i: want for i, (_, want) in enumerate(CASES) if want}
    assert all(r["ts"].encode() == CASES[i][0].encode()[:18] for i, r in rows.items())
    rejected = {r["seq"] for r in rejected_lines(frame).collect()}
    assert rejected == {i for i, (_, want) in enumerate(CASES) if want is None}


@pytest.mark.parametrize("text,number", [("", 0), ("0", 0), ("1", 1), ("12345", 12345), ("9999999999999999999", 0),
                                         ("99999999999999999999", 0), ("9223372036854775807", 2**63 - 1),
                                         ("9223372036854775808", 0)])
def test_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "s string").select(to_long(F.col("s"))).first()[0] == number
