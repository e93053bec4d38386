"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item has a 64-bit SimHash of its 5-word shingles, weighted by how
often each occurs. In a document, windows of each item length slide word by word, and
their prints are looked up in a multi-index of that length's items: prints are cut into
BLOCKS blocks, and two that differ in at most RADIUS bits differ in some block by at
most RADIUS // BLOCKS bits, so looking up all values that near in every block finds all
fingerprints within the radius. The exact weighted Jaccard of the shingles (sum of
minima over sum of maxima) against the threshold verifies each candidate.

A window that reaches the threshold holds at least 3/7 of its own and the item's
shingles together (for 0.75), so windows with fewer shingles that occur in any item
need no print; this bound is exact, and no item is picked by it.

At similarity 0.75 a bit differs with probability 0.172, so 11 of 64 are expected; more
than RADIUS differ with a probability of about 1e-6, which is what the index may miss.

Words are runs of anything but ASCII blanks, ASCII lower-cased. An item of fewer
than five words is one shingle, and a window must equal it. A document shorter than
an item is compared as a whole.

Items go to the workers in blocks of bounded size; more items mean more passes, not
more memory. Defined results: null or blank texts match nothing on either side;
empty tables give an empty result; repeated documents each give their rows;
repeated items are reported each under its id; items of null id are searched like
others and reported under a null one; of windows
of equal similarity the first is reported; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dubsar.llm.shared import small_batches, stored, with_key

WORDS, SIMILARITY = 5, 0.75
RADIUS, BLOCKS = 27, 8
#: Window starts of a document that are printed at once.
SEGMENT = 16_384
#: Characters of item text handed to the workers at once.
BLOCK_CHARS = 16_000_000
OUT = "doc_id long, item_id long, similarity double, start_word int, n_words int"


def _hash(shingle: tuple) -> int:
    return int.from_bytes(hashlib.blake2b(b"\n".join(shingle), digest_size=8).digest(), "little")


def shingles(words: list[bytes]) -> list[tuple]:
    return [tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))] if words else []


def _signs(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 values +1 or -1 per hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of size shingles, by differences of one running sum."""
    total = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(_signs(hashes), axis=0, dtype=np.int32)])
    return _packed(total[size:] - total[:-size])


class HammingIndex:
    """Fingerprints by block; near() returns all within the radius.

    A block has a row for each value it can have, naming the items whose block is near enough to that value.
    """

    def __init__(self, fingerprints: list[int], radius: int = RADIUS, blocks: int = BLOCKS) -> None:
        self.prints = np.array(fingerprints, np.uint64)
        self.radius = radius
        width = 64 // blocks
        self.shifts, self.mask = [np.uint64(width * k) for k in range(blocks)], np.uint64((1 << width) - 1)
        values = np.arange(1 << width, dtype=np.uint64)[:, None]
        self.rows = [np.bitwise_count(values ^ (self.prints >> shift & self.mask)[None, :]) <= radius // blocks for shift in self.shifts]

    def near(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in fingerprints, and the items within the radius of each."""
        found = []
        step = max(1, (1 << 22) // max(1, len(self.prints)))
        for at in range(0, len(fingerprints), step):
            part = fingerprints[at : at + step]
            seen = np.zeros((len(part), len(self.prints)), bool)
            for shift, rows in zip(self.shifts, self.rows, strict=True):
                seen |= rows[(part >> shift & self.mask).astype(np.int64)]
            which, item = np.nonzero(seen)
            fine = np.bitwise_count(part[which] ^ self.prints[item]) <= self.radius
            found.append((which[fine] + at, item[fine]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


class Items:
    """A block of benchmark items, ready to search documents."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        parsed = [(i, w) for i, t in rows if (w := t.encode().lower().split())]
        self.ids = [i for i, _ in parsed]
        self.lengths = [len(w) for _, w in parsed]
        self.bags = [Counter(shingles(w)) for _, w in parsed]
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, n in enumerate(self.lengths):
            if n >= WORDS:
                by_length[n].append(k)
        #: Items of each length in words, with the index of their prints.
        self.groups = {}
        for n, members in sorted(by_length.items()):
            own = [int(simhashes(np.array([_hash(x) for x in shingles(parsed[k][1])], np.uint64), n - WORDS + 1)[0]) for k in members]
            self.groups[n] = (members, HammingIndex(own))
        self.words: dict[bytes, int] = {}
        for _, w in parsed:
            for x in w:
                self.words.setdefault(x, len(self.words) + 1)
        #: All shingles of items, and short items by their words.
        self.known: set[tuple] = set()
        self.short: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, bag in enumerate(self.bags):
            for s in bag:
                if self.lengths[k] >= WORDS:
                    self.known.add(s)
                else:
                    self.short[len(s)][s].append(k)
        #: A bit for each possible value of a cheap key of five word numbers: a shingle whose bit is off is in no item.
        self.bits = np.zeros(1 << 22, bool)
        self.mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
        for s in self.known:
            self.bits[self._keys(np.array([self.words[x] for x in s], np.uint64))] = True

    def _keys(self, numbers: np.ndarray) -> np.ndarray:
        n = len(numbers) - WORDS + 1
        key = np.zeros(n, np.uint64)
        for k in range(WORDS):
            key += numbers[k : k + n] * self.mult[k]
        return key >> np.uint64(42)

    def search(self, text: bytes) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window of each item that reaches the threshold."""
        words = text.lower().split()
        numbers = np.fromiter((self.words.get(w, 0) for w in words), np.uint64, len(words))
        found: dict[int, tuple[float, int, int]] = {}
        for size, by in self.short.items():
            for p in range(len(words) - size + 1) if numbers.any() else ():
                for item in by.get(tuple(words[p : p + size]), ()):
                    found.setdefault(item, (1.0, p, size))
        if len(words) >= WORDS and self.known:
            here = self.bits[self._keys(numbers)]
            for k in range(WORDS):
                here &= numbers[k : len(words) - WORDS + 1 + k] > 0
            for p in np.flatnonzero(here).tolist():  # the bits name some others, too
                here[p] = tuple(words[p : p + WORDS]) in self.known
            if here.any():
                self._long(words, np.concatenate([[0], np.cumsum(here)]), found)
        return [(self.ids[k], *v) for k, v in sorted(found.items())]

    def _long(self, words: list[bytes], known: np.ndarray, found: dict) -> None:
        """Windows of every item length whose known shingles may suffice; known: their running count."""
        n = len(words) - WORDS + 1
        windows = []
        for length, (members, index) in self.groups.items():
            size = min(length - WORDS + 1, n)
            inside = known[size:] - known[:-size]
            # A window needs this many of an item's shingles to reach the threshold.
            starts = np.flatnonzero(inside >= SIMILARITY / (1 + SIMILARITY) * (size + length - WORDS + 1))
            if len(starts):
                windows.append((size, starts, members, index))
        if not windows:
            return
        first, last = min(int(w[1][0]) for w in windows), max(int(w[1][-1]) for w in windows)
        for lo in range(first, last + 1, SEGMENT):
            here = [(size, own, members, index) for size, starts, members, index in windows if len(own := starts[(starts >= lo) & (starts < lo + SEGMENT)])]
            if not here:
                continue
            end = max(int(own[-1]) + size for size, own, _, _ in here)
            seen = [tuple(words[q : q + WORDS]) for q in range(lo, end)]
            signs = _signs(np.fromiter(map(_hash, seen), np.uint64, len(seen)))
            total = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])
            for size, own, members, index in here:
                at = own - lo
                for k, m in zip(*(x.tolist() for x in index.near(_packed(total[at + size] - total[at]))), strict=True):
                    item, p = members[m], int(at[k])
                    value = weighted_jaccard(Counter(seen[p : p + size]), self.bags[item])
                    if value >= SIMILARITY and (item not in found or value > found[item][0]):
                        found[item] = (value, lo + p, size + WORDS - 1)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Item rows in blocks of at most BLOCK_CHARS characters, streamed partition by partition."""
    block, size = [], 0
    for r in items.where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


_SEARCHED: dict[str, Items] = {}


def _search_of(key: str, sent: Broadcast) -> Items:
    """Items of the block named key, built once a Python worker; only the latest block is held."""
    if key not in _SEARCHED:
        _SEARCHED.clear()
        _SEARCHED[key] = Items(sent.value)
    return _SEARCHED[key]


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of OUT: each document and item of which some window is similar enough."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = spark.createDataFrame([], OUT)
    for n, block in enumerate(_blocks(items.select(F.col("item_id").cast("long"), "text"))):
        sent = spark.sparkContext.broadcast(block)
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            search = _search_of(key, sent)
            for b in batches:
                rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True) for hit in search.search(t)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        found = texts.mapInArrow(run, OUT)
        out = found if n == 0 else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark passage."""
    keyed, key = with_key(docs, "contaminated-keyed")
    bad = stored(contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(bad, key, "left_anti").select(docs.columns)
