"""Token alignment against plain Python over whole texts, on rows that end, begin or consist of odd characters."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logfold.llm import alignment

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
PARTS = ["a", "word", " ", "  ", "\n", "<|endoftext|>", "é", "'s", "12", "! ", "ing", "を", "\t ", "\x00", "\x1f", "\x85", "\xa0", " ",
         "😀", "é", "<s>", "<0x41>", "\r\n", "½", "٣", "क्", "_", "don't", "x=1;", " the", "\U00010000", "�"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*PATHS)


class Plain:
    """The alignment of whole texts, one token after the other."""

    def __init__(self, aligner):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = aligner.bytes_a, aligner.bytes_b

    def text(self, text):
        """(n_a, n_b, links, groups)."""
        if not text:
            return 0, 0, [], ""
        full = f" {text}"
        a, b = self.a.encode(full, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(self.bytes_a[i] for i in a) != full.encode() or b"".join(self.bytes_b[i] for i in b) != full.encode():
            return 0, 0, [], ""
        links, groups, i, j, of_a, of_b = [], [], 0, 0, [a[0]], [b[0]]
        end_a, end_b = len(self.bytes_a[a[0]]), len(self.bytes_b[b[0]])
        while True:
            links.append((a[i], b[j]))
            both = end_a == end_b
            if both:
                groups.append(",".join(map(str, of_a)) + "|" + ",".join(map(str, of_b)))
                of_a, of_b = [], []
                if i + 1 == len(a):
                    return len(a), len(b), links, ";".join(groups)
            next_a, next_b = both or end_a < end_b, both or end_b < end_a
            if next_a:
                i += 1
                of_a.append(a[i])
                end_a += len(self.bytes_a[a[i]])
            if next_b:
                j += 1
                of_b.append(b[j])
                end_b += len(self.bytes_b[b[j]])

    def rows(self, docs):
        found = [(i, *self.text(t)) for i, t in docs]
        count = Counter(pair for _, _, _, links, _ in found for pair in links)
        best = {}
        for (_, b), n in count.items():
            best[b] = max(n, best.get(b, 0))
        return sorted(
            (i, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(count[p] == best[p[1]] for p in links),
             sum(count[p] for p in links), groups) for i, n_a, n_b, links, groups in found)


def odd_texts(n):
    draw = random.Random(n)
    fixed = [None, "", " ", "  ", "the ", "the  ", "a! ", "\n", "\n ", " the", "x \t", "▁", "a▁b", "a▁ ", "é ", "😀 ", "12 ", "the  ▁"]
    return fixed + ["".join(draw.choices(PARTS, k=draw.choice([2, 3, 8, 40]))) for _ in range(n)]


def test_a_blank_ends_a_text(aligner):
    for text in ("the ", "a! ", "é ", "x  y "):
        found = aligner.align(aligner.words(text))
        assert found.valid.all() and found.counts.sum(0).tolist()[:2] == [*Plain(aligner).text(text)[:2]], text


def test_odd_rows(spark, aligner):
    docs = list(enumerate(odd_texts(400)))
    docs += [(3, "the "), (3, "the "), (5, "a ▁")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, alignment.align_tokens(frame, *PATHS).collect())) == Plain(aligner).rows(docs)


def test_parts_are_known_from_block_to_block(aligner, monkeypatch):
    """A task aligns a part once, and again only after it has forgotten what it knew; results stay the same."""
    asked, small = [], alignment.Aligner._small
    monkeypatch.setattr(alignment.Aligner, "_small", lambda self, segments: asked.append(len(segments)) or small(self, segments))
    blocks = [sorted({w for t in odd_texts(n) if t for w in aligner.words(t)}) for n in (50, 60, 50)]

    def shown(own, words):
        of = own.align(words)
        return of.counts.tolist(), of.groups, of.links.tolist(), of.valid.tolist()

    want = [shown(alignment.Aligner(*PATHS), words) for words in blocks]
    alone, asked[:] = list(asked), []
    keeps = alignment.Aligner(*PATHS)
    assert [shown(keeps, words) for words in blocks] == want
    assert asked[0] == alone[0] and 0 < asked[1] < alone[1] and asked[2] == 0
    asked[:] = []
    monkeypatch.setattr(alignment, "CACHED_BYTES", 0)
    forgets = alignment.Aligner(*PATHS)
    assert [shown(forgets, words) for words in blocks] == want and asked == alone
