"""Byte-pair encoding with a queue of merge ranks over a linked list of symbols.

A pre-token starts as single symbols in a doubly linked list. A heap holds the rank
of each adjacent pair that has one; popping an entry whose symbols have changed
since is skipped as stale. Decoding concatenates vocabulary strings.

Texts are cut where no token can cross: before a space that a non-blank follows.
What a piece encodes to is kept in a bounded cache, so memory does not grow with
the vocabulary of the corpus.

Defined results: null is the empty text, which has no tokens; a pair of equal rank
merges at its leftmost place first; repeated rows and other columns pass unchanged,
an input column that an output column shadows, in whatever case, is dropped; an empty
table gives an empty result. One narrow stage without a shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dubsar.llm.shared import free_name, other_columns, per_process, small_batches

#: Pieces a cache takes in before it starts anew; the filling before is kept beside it, so what recurs is never worked out twice.
CACHE = 250_000
# Fixed value: how a byte-level tokenizer cuts a text into pre-tokens.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_TWO_BLANKS = re.compile(r" \s|\s  ")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols = byte_symbols()
        self.bytes = {s: b for b, s in enumerate(self.symbols)}
        # Symbols are numbered here; _pairs[a][b] is the rank at which b joins a, _made what they become.
        number: dict[str, int] = {}
        known = lambda s: number.setdefault(s, len(number))
        for s in self.symbols:  # a byte's symbol has the byte as its number
            known(s)
        self._last = [known(s + self.end) for s in self.symbols]
        pairs: dict[int, dict[int, int]] = {}
        self._made: list[int] = []
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pairs.setdefault(known(left), {})[known(right)] = rank
            self._made.append(known(left + right))
        none: dict[int, int] = {}
        self._pairs = [pairs.get(k, none) for k in range(len(number))]
        self._ids = [self.ids.get(s, -1) for s in number]

    def merge(self, sym: list[int]) -> list[int]:
        """Apply merges by rank, leftmost first, until none is left. Consumes sym."""
        n = len(sym)
        if n < 2:
            return sym
        pairs, made, push, pop = self._pairs, self._made, heapq.heappush, heapq.heappop
        # The rank of the pair that starts at each place; a queued entry of another rank is stale.
        now = [pairs[a].get(b, -1) for a, b in zip(sym, sym[1:])]  # noqa: B905
        now.append(-1)
        bits = n.bit_length()  # small numbers are cheaper
        queue = [r << bits | i for i, r in enumerate(now) if r >= 0]
        if not queue:
            return sym
        heapq.heapify(queue)
        mask = (1 << bits) - 1
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            top = pop(queue)
            i, r = top & mask, top >> bits
            if now[i] != r:
                continue  # stale: one of the two has been merged meanwhile
            j = after[i]
            sym[i] = new = made[r]
            sym[j] = now[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                now[i] = r = pairs[new].get(sym[k], -1)
                if r >= 0:
                    push(queue, r << bits | i)
            else:
                now[i] = -1
            if (h := before[i]) >= 0:
                now[h] = r = pairs[sym[h]].get(new, -1)
                if r >= 0:
                    push(queue, r << bits | h)
        return [s for s in sym if s >= 0]

    def symbols_of(self, raw: bytes) -> list[int]:
        """Symbols of one pre-token, merged."""
        sym = list(raw)
        if sym and self.end:
            sym[-1] = self._last[sym[-1]]
        return self.merge(sym)

    def encode_word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token; symbols outside the vocabulary give none."""
        ids = self._ids
        return [i for s in self.symbols_of(raw) if (i := ids[s]) >= 0]

    def numbered_ids(self) -> list[int]:
        """The id of every symbol by its number, -1 where it has none."""
        return self._ids

    def strings(self) -> dict[int, bytes]:
        """Id -> the bytes it stands for."""
        out = {i: bytes(self.bytes[c] for c in s) for s, i in self.ids.items() if all(c in self.bytes for c in s)}
        return out | {i: s.encode() for s, i in self.special.items()}


class Codec:
    """Encode and decode whole texts."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.vocabulary = self.merges.strings()
        self._special = re.compile("|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        self._mark = os.path.commonprefix(list(self.merges.special))  # no special string without it
        #: Ids of pre-tokens and of pieces, joined by commas; of a piece that decodes to anything but itself also what it decodes to.
        self._words: dict[str, str] = {}
        self._pieces: dict[str, str | tuple[str, bytes]] = {}
        self._before: dict[str, str | tuple[str, bytes]] = {}
        #: Id in decimal and vocabulary string of every symbol; None where a symbol has no id.
        known = [(str(i), self.vocabulary[i]) if i >= 0 and i in self.vocabulary else None for i in self.merges.numbered_ids()]
        self._say, self._raw = [k and k[0] for k in known], [k and k[1] for k in known]
        self._whole = all(known)

    def _word(self, word: str) -> str:
        if (ids := self._words.get(word)) is None:
            if 2 * len(self._words) >= CACHE:
                self._words.clear()
            ids = self._words[word] = ",".join(map(str, self.merges.encode_word(word.encode())))
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self._special.finditer(text) if self._special and self._mark in text else ():
            for w in CUT.findall(text[at : m.start()]):
                out += self._ids(w)
            out.append(self.merges.special[m[0]])
            at = m.end()
        for w in CUT.findall(text[at:] if at else text):
            out += self._ids(w)
        return out

    def _ids(self, word: str) -> list[int]:
        return list(map(int, ids.split(","))) if (ids := self._word(word)) else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocabulary[i] for i in ids).decode("utf-8", "replace")

    def _letters(self, key: str) -> str | tuple[str, bytes]:
        """The piece of a blank and the letters of key, which is one pre-token beyond doubt."""
        if (got := self._pieces.get(key)) is None and (got := self._before.get(key)) is None:
            raw = b" " + key.encode()
            sym = self.merges.symbols_of(raw)
            say, back = self._say, self._raw
            got, back = ",".join([say[s] for s in sym]), b"".join([back[s] for s in sym])
            if back != raw:
                got = (got, back)
        return self._kept(key, got)

    def _piece(self, piece: str, key: str | None = None) -> str | tuple[str, bytes]:
        """Ids joined by commas, with what they decode to where that is not the piece; kept under key, the piece without its blank."""
        if key and self._whole and key.isalpha():
            return self._letters(key)
        if key and (got := self._before.get(key)) is not None:
            return self._kept(key, got)
        if key and self._whole and (end := key[-1]) in ".,;:!?" and (stem := key[:-1]).isalpha():  # two pre-tokens
            known, mark = self._letters(stem), self._word(end)
            if type(known) is str and mark and b"".join(map(self.vocabulary.__getitem__, map(int, mark.split(",")))) == end.encode():
                return self._kept(key, f"{known},{mark}")
        ids = self.encode(piece)
        back = b"".join([self.vocabulary[i] for i in ids])
        got = ",".join(map(str, ids))
        return self._kept(key, got if got and back == piece.encode() else (got, back))

    def _kept(self, key: str | None, got: str | tuple[str, bytes]) -> str | tuple[str, bytes]:
        if key is not None and len(key) <= 64:
            if len(self._pieces) >= CACHE:
                self._before, self._pieces = self._pieces, {}
            self._pieces[key] = got
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        """Tokens, SHA-256 of the ids joined by commas, SHA-256 of what they decode to."""
        if not text or text[0] == " " or _TWO_BLANKS.search(text):
            pieces, parts = [text], [self._piece(text)]
        else:
            pieces = text.split(" ")
            get, piece = self._pieces.get, self._piece
            parts = [piece(pieces[0])]
            parts += [get(x) or piece(" " + x, x) for x in pieces[1:]]
        try:
            ids, back = ",".join(parts), text.encode()
        except TypeError:  # some piece decodes to something else
            ids = ",".join([i for p in parts if (i := p if type(p) is str else p[0])])
            back = b"".join([p[1] if type(p) is tuple else (" " * (k > 0) + x).encode() for k, (p, x) in enumerate(zip(parts, pieces, strict=True))])
        try:
            back.decode()
        except UnicodeDecodeError:
            back = back.decode("utf-8", "replace").encode()
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with token_ids array<int> in place of text."""
    return _per_text(docs, text, [("token_ids", pa.list_(pa.int32()))], "token_ids array<int>", lambda: (c := per_process(Codec, tokenizer)) and (lambda t: (c.encode(t),)))


def decode(docs: DataFrame, tokenizer: str, ids: str = "token_ids") -> DataFrame:
    """docs with text, the vocabulary strings of ids concatenated."""
    return _per_text(docs, ids, [("text", pa.string())], "text string", lambda: (c := per_process(Codec, tokenizer)) and (lambda t: (c.decode(t),)), empty=())


def digests(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 in place of text: encodes, then decodes the ids."""
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _per_text(docs, text, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: per_process(Codec, tokenizer).digest)


def _per_text(docs: DataFrame, text: str, fields: list, ddl: str, make, empty="") -> DataFrame:
    small_batches(docs.sparkSession)
    rest = other_columns(docs.columns, text, [n for n, _ in fields])
    body = free_name(docs.columns, "_text")
    own = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").alias(body))
    kept = own.drop(body).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), ddl])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            rows = [work(t if t is not None else empty) for t in b.column(b.num_columns - 1).to_pylist()]
            new = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*rest, *(n for n, _ in fields)])

    return own.mapInArrow(run, schema)
