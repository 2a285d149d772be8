"""Piece encoding against the public library."""

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from llm.odd import TEXTS, documents, empty

from banterscope.llm import pieces
from banterscope.llm.queries import piece_vocabulary


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary())


def check(texts, library):
    coder = pieces.loaded(piece_vocabulary())
    got = coder.encode(texts)
    told = coder.decode(pieces._lists(got))
    for text, own, decoded in zip(texts, got, told, strict=True):
        ids = library.encode(text)
        assert np.frombuffer(own, np.int32).tolist() == ids, text[:80]
        assert decoded == library.decode(ids), text[:80]


def test_odd_texts_encode_as_the_library_does(library):
    check(["", " ", "  a  b ", "\tx\n\ny ", "▁▁ a▁b ▁", "你好 😀", "<s> </s> <unk> <0x41>", "\x00a", "a" * 300 + " " * 100 + "b", "\n\n \n", "It's\r\nok 12345 ½²", " x", "ﬁ é é"], library)
    check(["xyz" * 20_000 + " " + "ab" * 300], library)


def test_random_texts_encode_as_the_library_does(library):
    r = random.Random(5)
    letters = "abcdefghinorstuy 'éß01,.\n你   "
    check(["".join(r.choice(letters) for _ in range(r.randint(1, 150))) for _ in range(1000)], library)
    known = list(pieces.loaded(piece_vocabulary()).ids)
    check(["".join(r.choice(known) for _ in range(r.randint(1, 20))) for _ in range(2000)], library)


def test_chunks_go_back_alone_and_together():
    """Steps of one chunk and of many give the same pieces; some longest matches have to be given back."""
    coder = pieces.loaded(piece_vocabulary())
    r = random.Random(8)
    chunks = list({"▁" + "".join(r.choice("ensthirog") for _ in range(r.randint(2, 14))) for _ in range(400)})
    together, _, firsts = coder.backtrack(chunks)
    back = 0
    for k, chunk in enumerate(chunks):
        alone = coder.backtrack([chunk])[0]
        assert alone.tolist() == together[firsts[k] : firsts[k + 1]].tolist()
        points = np.array([ord(c) for c in chunk])
        at, greedy = 0, []
        longest = coder._longest(points)
        while at < len(chunk):
            greedy.append(int(longest[at]))
            at += len(coder.strings[greedy[-1]])
        back += greedy != alone[:-1].tolist()
    assert back > 20


def test_pairs_are_told_alike_one_by_one():
    coder = pieces.loaded(piece_vocabulary())
    r = np.random.default_rng(4)
    own = np.array(sorted(coder.ids.values()))
    a, b = r.choice(own[:3000], 2000), r.choice(own[:3000], 2000)
    assert coder.stay_apart(a, b).tolist() == [coder._stays(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_any_ids_decode_as_the_library_does(library):
    coder = pieces.loaded(piece_vocabulary())
    r = random.Random(2)
    lists = [[1, 22557], [22557, 1, 22557], [0, 264], [264, 0], [1, 259], [28705, 28705, 13], [3 + 0xE4, 3 + 0xBD, 264], [3 + 0xED, 3 + 0xA0, 3 + 0x80], []]
    lists += [[r.randrange(3, 400) for _ in range(r.randint(1, 12))] for _ in range(300)]
    got = coder.decode(pieces._lists([np.array(x, np.int32).tobytes() for x in lists]))
    assert got == [library.decode(x) for x in lists]


def test_rows(spark, library):
    rows = pieces.encode(documents(spark), piece_vocabulary(), decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((i, tuple(library.encode(t or ""))) for i, t in TEXTS)
    again = pieces.decode(pieces.encode(documents(spark), piece_vocabulary()), piece_vocabulary()).collect()
    assert Counter((r.doc_id, r.decoded) for r in again) == Counter((r.doc_id, r.decoded) for r in rows)
    assert pieces.encode(empty(spark), piece_vocabulary()).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [None, 264, None])], "doc_id long, ids array<int>")
    assert sorted(tuple(r) for r in pieces.decode(lists, piece_vocabulary()).collect()) == [(1, ""), (2, ""), (3, "a")]


def test_bytes_that_are_no_text(spark, library):
    rows = spark.sql("select 1 doc_id, cast(unhex('61FF62') as string) text")
    assert pieces.encode(rows, piece_vocabulary()).first().ids == library.encode("a�b")
