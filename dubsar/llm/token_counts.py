"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, offline, before a
job starts: each is cut into symbols and merged, and only those that end as the one
token they name enter the table, which is then sent to the workers (it is no larger
than the vocabulary). A pre-token in that table counts one without any merging; the
rest are merged.

The tokenizer normalises to NFC, lower-cases character by character and drops
white space; special strings inside a text are one token each.

Defined results: null is the empty text with no bytes and no tokens; an empty table
gives an empty result; repeated rows and other columns pass unchanged, an input
column that an output column shadows, in whatever case, is dropped; ties cannot occur. No shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dubsar.llm.bpe import CACHE, Merges
from dubsar.llm.shared import free_name, other_columns, per_process, small_batches

# Fixed value: how the tokenizer cuts a normalised text.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LIMIT = 2048


def whole_tokens(merges: Merges) -> set[bytes]:
    """What the vocabulary strings with an end mark stand for, if it merges into that one token."""
    end = merges.end
    found = set()
    for s, i in merges.ids.items():
        body = s.removesuffix(end)
        if s.endswith(end) and body and all(c in merges.bytes for c in body):
            if merges.encode_word(raw := bytes(merges.bytes[c] for c in body)) == [i]:
                found.add(raw)
    return found


def lowered(text: str) -> str:
    """Lower case of each character by itself: no final sigma."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def proved(path: str) -> frozenset[bytes]:
    """The table of a tokenizer file."""
    return frozenset(whole_tokens(Merges(path)))


class Counter:
    """Counts texts; whole is the table proved beforehand."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.whole: frozenset[bytes] = frozenset()
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")")
        self._pieces: dict[bytes, int] = {}
        self._words: dict[bytes, int] = {}

    def _word(self, raw: bytes) -> int:
        if raw in self.whole:
            return 1
        if (n := self._words.get(raw)) is None:
            if len(self._words) >= CACHE:
                self._words.clear()
            n = self._words[raw] = len(self.merges.encode_word(raw))
        return n

    def _piece(self, piece: bytes) -> int:
        n = 0
        for k, part in enumerate(self._special.split(piece.decode())):
            n += 1 if k % 2 else sum(self._word(w.encode()) for w in CUT.findall(lowered(unicodedata.normalize("NFC", part))))
        if len(piece) <= 64:
            if len(self._pieces) >= CACHE:
                self._pieces.clear()
            self._pieces[piece] = n
        return n

    def count(self, raw: bytes) -> int:
        """Tokens of a text in UTF-8. White space ends every token, so pieces between it count alone."""
        get = self._pieces.get
        return sum([n if (n := get(p)) is not None else self._piece(p) for p in raw.split()])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit in place of text."""
    small_batches(docs.sparkSession)
    new = ("n_bytes", "n_tokens", "over_limit")
    rest = other_columns(docs.columns, text, new)
    table = docs.sparkSession.sparkContext.broadcast(per_process(proved, tokenizer))
    body = free_name(docs.columns, "_text")
    own = docs.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(body))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop(body).schema), "n_bytes long, n_tokens long, over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(Counter, tokenizer)
        counter.whole = table.value
        for b in batches:
            raw = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            n = [counter.count(t) for t in raw]
            cols = [pa.array([len(t) for t in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*rest, *new])

    return own.mapInArrow(run, schema)
