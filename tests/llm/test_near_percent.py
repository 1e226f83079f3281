"""The similarity of near copies: 85 % in op5, 80 % in the pipeline's stage."""

import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from logfold.llm import minhash_dedup, shingles

# (first id, words replaced at the end of 400): the sets share (396 - n) of (396 + n) shingles.
PLANTED = [(10 * k, n) for k, n in enumerate([0, 20, 30, 33, 36, 40, 43, 44, 45, 60], 1)]


def _texts():
    for i, n in PLANTED:
        words = [f"d{i}w{k}" for k in range(400)]
        yield i, " ".join(words)
        yield i + 1, " ".join(words[:400 - n] + [f"other{k}" for k in range(n)] if n else words)


def _shared(n):
    return 100 * (396 - n) / (396 + n)


def test_near_copies_by_similarity(spark):
    docs = spark.createDataFrame(list(_texts()), "doc_id bigint, text string")
    assert sum(80 <= _shared(n) < 85 for _, n in PLANTED) >= 4 and any(_shared(n) < 80 for _, n in PLANTED)
    for percent, rows in (
        (80, corpus_pipeline.drop_near_copies(spark, docs, "").collect()),
        (85, minhash_dedup.minhash_dedup(docs).filter("kept").collect()),
    ):
        gone = {i + 1 for i, n in PLANTED if _shared(n) >= percent}
        assert {r.doc_id for r in rows} == {i for i, _ in PLANTED} | {i + 1 for i, _ in PLANTED} - gone, percent


def test_stage_equals_brute_force_at_80(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root, between = {i: i for i in sets}, 0
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                between += 100 * both < 85 * len(sets[a] | sets[b])
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    assert between
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {i for i, r in root.items() if i == r}


def test_loss_at_the_threshold():
    assert (minhash_dedup.symbols_apart(85), minhash_dedup.symbols_apart(80)) == (14, 17)
    assert 17 == minhash_dedup.SURE_APART and max(minhash_dedup.lost(80, 17), minhash_dedup.lost(85, 14)) <= minhash_dedup.LOSS
    with pytest.raises(ValueError):
        minhash_dedup.symbols_apart(70)
    # Drawn signatures at 80 %: what is lost is what the formula says, and all within the distance meet.
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 16, (200_000, shingles.SYMBOLS)).astype(np.uint16)
    two = np.where(rng.random(one.shape) < 0.2, one ^ 1, one).astype(np.uint16)
    met = (shingles.index_keys(one) == shingles.index_keys(two)).any(axis=1)
    near = (one != two).sum(axis=1)
    assert (near[~met] > minhash_dedup.SURE_APART).all()
    for apart in (11, 12):
        assert 0.7 < (near > apart).mean() / minhash_dedup.lost(80, apart) < 1.4


def _linked(spark, texts, percent):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    return {r.doc_id: r.component_id for r in minhash_dedup.minhash_dedup(docs, percent=percent).collect()}


def _brute(texts, percent):
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root


def test_large_group_of_near_copies_and_a_common_passage(spark, monkeypatch):
    """Copies that are near some of each other only, more than the leaders of a key, beside texts that share a passage."""
    for name, few in (("LEADERS", 4), ("SWEPT", 40), ("GROUP_ROWS", 30)):
        monkeypatch.setattr(minhash_dedup, name, few)
    rng = np.random.default_rng(5)
    base, passage, texts = [f"b{k}" for k in range(200)], " ".join(f"p{k}" for k in range(60)), {}
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, 200, 1 + i % 2):
            words[k] = f"x{i}y{k}"
        texts[int(i)] = " ".join(words)
    for i in range(150, 300):
        texts[int(i)] = passage + " " + " ".join(f"u{i}w{k}" for k in range(int(rng.integers(8, 200))))
    # A chain: each is near the next alone.
    for i in range(300, 330):
        texts[i] = " ".join(f"c{k}" for k in range((i - 300) * 12, (i - 300) * 12 + 200))
    for percent in (85,):
        want = _brute(texts, percent)
        assert len(set(want.values())) < 250
        assert _linked(spark, texts, percent) == want


def test_texts_of_one_id_are_joined(spark):
    """Id 5 has texts A and B; 3 shares B, 9 is near A: all are one component."""
    words = lambda first: " ".join(f"w{first + k}" for k in range(300))
    rows = [(5, words(0)), (5, words(900)), (3, words(900)), (9, words(0) + " x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in minhash_dedup.minhash_dedup(docs).collect()} == {(5, 3), (3, 3), (9, 3)}


def test_a_task_gives_no_more_links_than_join_its_components():
    """Leaders, each its own component, near every class of the key's largest component and near each other."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 62, 3, dtype=np.uint64))) for _ in range(80)]
    # The last is far from all others.
    sets.append(np.append(base[:100], rng.integers(0, 1 << 62, 100, dtype=np.uint64)))
    sets[-1].sort()
    signs = np.tile(rng.integers(0, 1 << 16, shingles.SYMBOLS).astype(np.uint16).view(np.int16), (81, 1))
    key = shingles.index_keys(signs.view(np.uint16))[0]

    def table(which, at):
        return pa.table({
            "key": pa.array(np.full(len(which), key[at])), "class_id": pa.array(which, pa.int64()),
            "component": pa.array([0 if i < 40 else i for i in which], pa.int64()),
            "signature": pa.array(list(signs[which]), pa.list_(pa.int16())),
            "place": pa.array([None if i < 40 else i - 39 for i in which], pa.int32()),
            "shingles": pa.array([sets[i].tobytes() for i in which], pa.binary()),
        })

    everything = [pa.concat_tables([table(which, at) for at in range(len(key))]) for which in (list(range(81)), list(range(40, 81)))]
    links = list(zip(*minhash_dedup._linked_in(14, 85)(None, *everything).to_pydict().values()))
    # 41 near components: the largest one and 40 leaders.
    assert len(links) == len(set(links)) == 40
    root = {i: 0 if i < 40 else i for i in range(81)}
    for a, b in links:
        assert a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
        root = {i: root[a] if r == root[b] else r for i, r in root.items()}
    assert len({root[i] for i in range(80)}) == 1 and root[80] == 80
