import random

import public_tokenizers
import pytest
import tiktoken

from histlab.llm.byte_bpe import ByteBPE, PieceEncoding, decode_ids, encode_texts, encoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = ["a", "b", "the", " ", "  ", "\n", "é", "'s", "12", "!", "\xa0", "́", "Ω", "𝔘", "\x1f", "\x85"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder(RANKS, public_tokenizers.PATTERN).bpe.ranks, special_tokens={})


def ids_of(data):
    return memoryview(data).cast("I").tolist()


def test_random_texts(library):
    rng, own = random.Random(1), encoder(RANKS, public_tokenizers.PATTERN)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["a" * 4000, " " * 4000, "<|endoftext|>"]
    for text in texts:
        got = own.encode(text)
        assert ids_of(got) == library.encode_ordinary(text), text
        assert own.bpe.decode(ids_of(got)) == text.encode()


def test_appends_and_edits():
    rng = random.Random(2)
    bpe: ByteBPE = encoder(RANKS, public_tokenizers.PATTERN).bpe
    for _ in range(200):
        data = bytes(rng.choice(b"abcde the in") for _ in range(rng.randint(0, 300)))
        piece = PieceEncoding(bpe, data)
        start = rng.randint(0, len(data))
        end, new = min(len(data), start + rng.randint(0, 5)), bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 8)))
        piece.replace(start, end, new)
        data = data[:start] + new + data[end:]
        assert piece.data == data and piece.ids() == (bpe.merge(data) if data else [])
        piece.append(b"hello")
        assert piece.ids() == bpe.merge(data + b"hello")
    far = PieceEncoding(bpe, b"ab" * 5000)
    far.replace(10, 11, b"c")
    assert far.computed < 500


def test_odd(odd, none, library):
    df = encode_texts(odd.drop("ids"), RANKS, public_tokenizers.PATTERN)
    rows = decode_ids(df, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert ids_of(bytes(r["ids"])) == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    with pytest.raises(ValueError):
        encode_texts(odd, RANKS, public_tokenizers.PATTERN)
    assert decode_ids(encode_texts(none.drop("ids"), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0
