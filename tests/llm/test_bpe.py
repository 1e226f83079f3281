"""Joins of chunks against the library, wherever chunks are cut."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logfold.llm import bpe
from logfold.llm.pretokens import Pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "word", " ", "  ", "\n", "<|endoftext|>", "é", "'s", "12", "! ", "x y ", "ing of ", "を", "\t ", " the", " plain words of a text "]


@pytest.fixture(scope="module")
def vocabulary():
    return Pieces(PATH)


def want(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(12))
def test_cores_of_any_choice(vocabulary, seed):
    draw = random.Random(seed)
    text = "".join(draw.choice(PARTS) for _ in range(1500))
    found = bpe.cores(text)
    for known in (found, found[::2], draw.sample(found, len(found) // 2), []):
        shared = [(a, b, vocabulary.encode([text[a:b]])[0]) for a, b in sorted(known)]
        assert np.frombuffer(bpe.stitched(text, shared, vocabulary), vocabulary.type).tolist() == want(text)


@pytest.mark.parametrize("seed", range(12))
def test_joins_are_widened_until_they_agree(vocabulary, seed):
    """Chunks cut within words and runs of blanks have other ids at their ends than the text has there."""
    draw = random.Random(seed)
    text = "".join(draw.choice([p for p in PARTS if p != "<|endoftext|>"]) for _ in range(800))
    cuts = sorted(draw.sample(range(1, len(text)), 20))
    shared = [(a, b, vocabulary.encode([text[a:b]])[0]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
    assert b"".join(ids for _, _, ids in shared) != np.array(want(text), vocabulary.type).tobytes()
    assert np.frombuffer(bpe.stitched(text, shared, vocabulary), vocabulary.type).tolist() == want(text)


def test_chunks_follow_the_content():
    draw = random.Random(3)
    shared = " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(4000))
    own = ["start " * 50 + shared, "another beginning, " * 31 + shared + " and an end"]
    first, second = ({t[a:b] for a, b in bpe.cores(t)} for t in own)
    assert len(first & second) > 0.8 * len(first)


def test_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.encode(docs, PATH, decoded=True).collect()
    ids = Tokenizer.from_file(PATH).encode_batch(list(texts.values()), add_special_tokens=False)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: e.ids for i, e in zip(texts, ids)}
    assert {r.doc_id: r.text for r in rows} == texts
    one = bpe.encode(docs.limit(0), PATH, decoded=True)
    assert one.columns == ["doc_id", "ids", "text"] and one.count() == 0
