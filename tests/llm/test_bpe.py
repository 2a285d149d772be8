import random
from collections import Counter

import numpy as np
import pytest
from llm.odd import TEXTS, documents, empty
from tokenizers import Tokenizer

from banterscope.llm import bpe
from banterscope.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def check(texts, library):
    coder = bpe.loaded(vocabulary())
    got = coder.encode(texts)
    told = coder.decode(bpe._lists(got)).to_pylist()
    for text, own, decoded in zip(texts, got, told, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own, np.int32).tolist() == ids, text[:80]
        assert decoded == library.decode(ids, skip_special_tokens=False)


def test_odd_texts_encode_as_the_library_does(library):
    check(
        ["", "  ", "It's we'll I'VE <|endoftext|>x<|startoftext|> a<|", "é é Σίσυφος ΑΣ", "\x1cA\x1db a\x85b\xa0c", "a" * 300 + "b" * 7, "'S''s''", "😀👍🏽 ½ ²"],
        library,
    )


def test_random_words_encode_as_the_library_does(library):
    r = random.Random(5)
    check(["".join(r.choice("abcdefghinorstuy 'éß01,.") for _ in range(r.randint(1, 120))) for _ in range(800)], library)


def test_some_proposals_fail_and_are_merged():
    coder = bpe.loaded(vocabulary())
    symbols = np.frombuffer(b"thonwhing", np.uint8).astype(np.int64)
    symbols[-1] += 256
    proposed = coder.propose(symbols, np.array([0]), np.array([9]))[0]
    merged = coder.merge([symbols])[0]
    assert "".join(coder.strings[t] for t in proposed) == "".join(coder.strings[t] for t in merged) == "thonwhing</w>"


def test_rows(spark, library):
    rows = bpe.encode(documents(spark), vocabulary(), decoded=True).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    expect = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == expect
    again = bpe.decode(bpe.encode(documents(spark), vocabulary()), vocabulary()).collect()
    assert Counter((r.doc_id, r.decoded) for r in again) == Counter((r.doc_id, r.decoded) for r in rows)
    assert bpe.encode(empty(spark), vocabulary()).count() == 0
