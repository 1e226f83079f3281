"""The trie against one built turn by turn."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest

from logfold.llm.conversation_trie import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """{(conv_id, depth): the other columns} of turns with distinct contents wherever turns are equal."""
    turns = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        turns[c].append((r or "", x or ""))
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0) + sum(out[k][4] for k in kids[p])
        leaves = sum(out[k][3] for k in kids[p]) or 1
        ends = ",".join(map(str, sorted(c for c in members[p] if whole[c] == p)))
        out[p] = (min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return {(min(members[p]), len(p)): v for p, v in out.items()}


def found(trie):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.collect()}


def many():
    rows = [(None, 1, "user", "of no one"), (-7, 3, "user", "below zero"), (-7, None, None, None), (1000, 5, "user", "")]
    for c in range(70):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3 if c % 5 else c} with words") for t in range(c % 7)]
    # One conversation much longer than the others, and equal ones.
    rows += [(200, t, "user", f"long {t}") for t in range(300)]
    return rows + [(c, t, "user", f"same {t}") for c in range(400, 460) for t in range(4)]


@pytest.mark.parametrize("bits", [16, 2])
def test_against_plain_code(spark, bits):
    rows = many()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], KINDS + ", depth int, node int").repartition(5)
    assert found(prefix_trie(frame, bits)) == plain(rows)


def test_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert found(prefix_trie(table)) == plain(rows)


def test_odd_tables(spark):
    assert prefix_trie(spark.createDataFrame([], KINDS)).count() == 0
    # A conversation whose only turn is replaced by nothing is a member of the root alone.
    assert zlib.crc32(b"22") % 4 > 0
    only = found(prefix_trie(spark.createDataFrame([(22, 0, "user", "x")], KINDS)))
    assert only == {(22, 0): (None, 1, 0, 1, 0, hashlib.sha256(b"22").hexdigest())}
    # Equal turns and repeated rows are turns of their own, in an order by content.
    ties = [(40, None, "user", "b"), (40, None, "user", "b"), (40, 1, "user", "c"), (40, 1, "user", "c")]
    assert [r.depth for r in prefix_trie(spark.createDataFrame(ties, KINDS)).sort("depth").collect()] == [0, 1, 2, 3, 4]
