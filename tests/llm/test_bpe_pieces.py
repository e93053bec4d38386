"""Byte-pair encoding: what a piece costs and how it is kept."""

import hashlib

from dubsar.llm import bpe
from dubsar.llm.queries import tokenizer_path

TEXTS = ["", " ", "a", " a b", "a  b", "thonwhre then, thonwhre, x. thonwhre", "é ü, 中文. don't \"q\" a.b ½. ǅ, ab\nc", "x <|endoftext|> y, x"]


def _plain(codec: bpe.Codec, text: str) -> tuple[int, str, str]:
    ids = codec.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def test_a_word_before_a_mark_is_merged_once_and_kept_without_its_bytes(monkeypatch):
    codec, merged = bpe.Codec(tokenizer_path("byte_bpe_50k.json")), []
    monkeypatch.setattr(bpe.Merges, "symbols_of", lambda self, raw, own=bpe.Merges.symbols_of: merged.append(raw) or own(self, raw))
    codec.digest("x thonwhre thonwhre, y thonwhre.")
    assert merged.count(b" thonwhre") == 1
    assert type(codec._pieces["thonwhre"]) is type(codec._pieces["thonwhre,"]) is str
    assert [codec.digest(t) for t in TEXTS] == [_plain(codec, t) for t in TEXTS]


def test_pieces_that_decode_to_something_else(monkeypatch):
    codec = bpe.Codec(tokenizer_path("byte_bpe_50k.json"))
    (mark,) = codec.encode(",")
    codec.vocabulary[mark] = b"\xff;"
    word = codec.encode(" then")[0]
    codec.vocabulary[word] = b"?"
    codec._raw = [codec.vocabulary[i] for i in codec.merges.numbered_ids()]
    assert [codec.digest(t) for t in [*TEXTS, *TEXTS]] == [_plain(codec, t) for t in [*TEXTS, *TEXTS]]
