"""Entropy spans against counts of every window, and texts that are one long string."""

import math
import random
import re
from collections import Counter

import pytest

from logfold.llm.secret_scan import ALLOWED, CANDIDATE, HEX_BITS, MIXED_BITS, PLACEHOLDER, WINDOW, redact, scan_secrets, secret_digest

random.seed(7)
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MIXED = "".join(random.choice(BASE64) for _ in range(1000))


def spans(text):
    """[(start, end)] of joined windows, by the counts of each window for itself."""
    out = []
    for m in re.finditer(CANDIDATE, text):
        if re.fullmatch(ALLOWED, m[0]):
            continue
        bound = HEX_BITS if re.fullmatch("[0-9a-fA-F]+", m[0]) else MIXED_BITS
        for k in range(len(m[0]) - WINDOW + 1):
            window = m[0][k:k + WINDOW]
            bits = -sum(n / WINDOW * math.log2(n / WINDOW) for n in Counter(window).values())
            if bits >= bound - 1e-9 and not re.search(PLACEHOLDER, window):
                a = m.start() + k
                if out and out[-1][1] >= a:
                    out[-1] = (out[-1][0], a + WINDOW)
                else:
                    out.append((a, a + WINDOW))
    return out


def some(alphabet, n):
    return "".join(random.choice(alphabet) for _ in range(n))


TEXTS = [
    None, "", "x" * 19, "aZ3kQ9xL2mW8vR5tY7nB", "see " + some("abcdef", 30) + some("0123456789abcdef", 300), some("aB1", 900),
    some(BASE64, 237) + " " + some(BASE64, 256) + " " + some(BASE64, 257), "é " + some("AAAABBBBCCCCDDDDEEEEfffggg123", 3000),
    some(BASE64, 100) + "example" + some(BASE64, 500) + "12345678" + some(BASE64, 30), some("abcdefghijklmnop/_-", 500), some("0123456789ABCDEF", 2000),
    " ".join(some("aaaaaaaaaaaaab1C", 60) + some(BASE64, 25) for _ in range(40)),
]


def test_spans_equal_counts_of_every_window(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for r in scan_secrets(frame).collect():
        base = {(x["s"], x["e"]) for x in r.base}
        want = [x for x in spans(r.text or "") if not any(a <= x[0] and x[1] <= e for a, e in base)]
        assert [(x["s"], x["e"]) for x in r.found if x["kind"] == "entropy"] == want, r.doc_id


@pytest.mark.parametrize("size", [10_000, 1_000_000])
def test_long_strings(spark, size):
    """Data without blanks, paths of many parts and digests, of any length: linear, without recursion, masked whole."""
    texts = ["see " + MIXED * (size // 1000), "see " + "Ab/" * (size // 3) + "ab end", "0123456789abcdef" * (size // 16), "a1 " * (size // 3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r for r in secret_digest(frame).collect()}
    assert rows[0].spans == f"entropy:4:{len(texts[0])}"
    assert rows[1].spans == "" and rows[3].spans == ""
    assert (rows[2].n_hex, rows[2].spans) == (1, f"hex:0:{len(texts[2])}")
    masked = {r.doc_id: r.text for r in redact(frame).collect()}
    assert masked == {0: "see [SECRET]", 1: texts[1], 2: "[SECRET]", 3: texts[3]}


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "aZ3kQ9xL2mW8vR5tY7nB", "b", "f", 5)], "doc_id int, text string, base string, found string, row int")
    row = scan_secrets(frame).collect()[0]
    assert row.row == 5 and [x["kind"] for x in row.found] == ["entropy"] and row.base == []
