import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from histlab.llm.packing import END_ID, WordEncoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def ids_of(whole, text):
    return [*whole.encode(text, add_special_tokens=False).ids, END_ID]


def test_words(whole):
    rng, own = random.Random(5), WordEncoder(PATH)
    signs = ["a", "B", "the", " ", "\n", "é", "'s", "12", "!", ".", "...", "\xa0", "́", "̈", "T", "Ω", "Σ", "𝔘", "\x1f", "\x85", "<|", "<|endoftext|>", "İ", "ß", "ﬁ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["<|STARTOFTEXT|>", "", " "]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        got, counts = own.encode_all(pa.array(part), END_ID)
        for text, ids, n in zip(part, got.to_pylist(), counts, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(whole, text), text
            assert n == len(ids) // 4
    got, counts = own.encode_all(pa.array([], pa.string()), END_ID)
    assert len(got) == 0 and len(counts) == 0


def check(rows, docs, whole, window):
    want = {}
    for doc_id, text in docs:
        want.setdefault(doc_id, []).append(ids_of(whole, text))
    by_doc, filled = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for doc_id, all_ids in want.items():
        lists = sorted(map(tuple, all_ids))
        if len(set(lists)) == len(lists) == 1:
            pieces = sorted(by_doc[doc_id, len(lists[0])], key=lambda r: r["start"])
            joined = b"".join(bytes(p["ids"]) for p in pieces)
            assert np.frombuffer(joined, "<u4").tolist() == list(lists[0])
            assert [p["start"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)]).tolist()[:-1]
    assert sum(r["length"] for r in rows) == sum(len(x) for ids in want.values() for x in ids)
    last = max(filled)
    for sequence, spans in filled.items():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end == window or sequence == last and end <= window
    assert sorted(filled) == list(range(last + 1))


def test_odd(odd, none, whole):
    from .conftest import texts_of

    check(pack(odd, PATH).collect(), texts_of(odd), whole, 2048)
    check(pack(odd, PATH, window=7).collect(), texts_of(odd), whole, 7)
    assert pack(none, PATH).count() == 0
