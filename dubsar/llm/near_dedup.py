"""Near-duplicate classes by HyperMinHash.

A document's set holds its distinct 5-word shingles (ASCII lower-cased; with fewer
words the whole sequence is the one shingle). For each of K buckets the smallest
hash is kept as a register: 6 bits of leading-zero count, 10 bits of mantissa.
Four registers make a band. Documents with equal sets are first collapsed into one
representative, so a group of copies is one row in all that follows.

Candidates are pairs that share a band. First every band bucket names one member as
centre, and the others are compared with it: pairs grow with members. Links make
components; rounds with other centres follow while they still merge much of what is
open. Then, in buckets that hold more than one component, members of different
components are compared with each other, whatever the bucket's size: no partner is
capped and no pair that shares a band is left out. Of those pairs only plausible ones
become rows, since the conditions are part of the join:

- sizes: the smaller set has at least 75 % of the larger one's shingles (exact);
- parities: every shingle flips one of PARITY bits, so the number of bits in which two
  documents differ is at most the number of shingles that only one of them has, which
  the threshold bounds by a seventh of both sizes (exact);
- one bit a register: of K bits at most SKETCH_BITS differ, where the threshold leads
  one to expect 16 (over six standard errors).

A collision-corrected Jaccard estimate from the registers discards what is five
standard errors or more below the threshold; the rest is confirmed on the full sets.

Defined results: null or blank text has the empty set, is linked with nothing and
is its own class; an empty table gives an empty result; each row is judged by its own
text, so rows that repeat an id each get their class; a row with a null id takes the
class of what it is linked with, null where nothing there has an id; columns other
than id and text are not read. Ties fall to the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubsar.llm.shared import small_batches, stored, with_key

K, ROWS = 128, 4
BANDS = K // ROWS
WORDS, SIMILARITY = 5, 75
MANTISSA = 10
#: What the estimate may lie below the threshold: five standard errors.
SLACK = 0.2
#: Bits of two 128-bit sketches (one bit a register) that may differ.
SKETCH_BITS = 40
PARITY = 1024
#: Another centre round is worth while as long as a member has more partners of other components than this on average, and the last round found links.
PARTNERS, MOST_ROUNDS = 256, 8
#: Members of a bucket that one key of the last join holds on its left side.
BLOCK = 1024
#: Ids broadcast at most (8 bytes each).
MOST_BROADCAST = 2_000_000
_MULT = np.random.default_rng(20240229).integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(20240301).integers(0, 2**63, K, dtype=np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)
_WORDS_KEPT = 100_000
#: What the join conditions look at: size, one bit a register, parities.
FACTS = ["n", "s0", "s1", *(f"p{k}" for k in range(PARITY // 64))]


class _Hashes(dict):
    """Word -> 64-bit hash, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(raw: bytes, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text in UTF-8."""
    ws = raw.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) < words:
        whole = hashlib.blake2b(b"\n".join(ws), digest_size=8, person=b"short").digest()
        return np.frombuffer(whole, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = len(ws) - words + 1
    acc = np.zeros(n, np.uint64)
    for k in range(words):
        acc = (acc ^ h[k : k + n]) * _MIX[k % 5]
        acc ^= acc >> np.uint64(29)
    return np.unique(_mixed(acc))


def registers(s: np.ndarray) -> np.ndarray:
    """K registers of a non-empty set: leading zeros of the smallest hash, then the bits after its first one."""
    low = np.full(K, np.uint64(2**64 - 1))
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        for k in range(0, K, 32):
            h = part[None, :] * _MULT[k : k + 32, None] + _ADD[k : k + 32, None]
            np.minimum(low[k : k + 32], (h ^ (h >> np.uint64(32))).min(axis=1), out=low[k : k + 32])
    part, exponent = np.frexp(np.maximum(low, 1).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    return (zeros << MANTISSA) | np.minimum((2 * part - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint16)


def parities(s: np.ndarray) -> np.ndarray:
    """PARITY bits, each set if an odd number of the set's shingles falls on it, as 64-bit numbers."""
    odd = np.bincount((s >> np.uint64(20) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, less the share that equal by chance."""
    ratio = n / np.maximum(m, 1)
    chance = 0.1699194871597391 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal / K - chance) / (1 - chance), 0, 1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for b in batches:
        raw = b.column(1).cast(pa.binary())
        ns, keys, regs, facts = [], [], [], np.zeros((b.num_rows, len(FACTS) - 1), np.int64)
        for i in range(b.num_rows):
            s = shingle_set(raw[i].as_py(), hashes)
            ns.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            if len(s):
                r = registers(s)
                facts[i, :2] = np.packbits((r & 1).astype(bool)).view(np.int64)
                facts[i, 2:] = parities(s)
            regs.append(r.tobytes() if len(s) else b"")
        columns = [b.column(0), pa.array(keys, pa.binary()), pa.array(regs, pa.binary()), pa.array(ns, pa.int64()), *(pa.array(facts[:, k]) for k in range(facts.shape[1]))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "set_key", "regs", *FACTS])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set as bytes, under the key that names the set; a batch of texts gives several batches of sets."""
    hashes = _Hashes()
    for b in batches:
        raw = b.column(0).cast(pa.binary())
        keys, sets, size = [], [], 0
        for i in range(b.num_rows):
            sets.append(shingle_set(raw[i].as_py(), hashes).tobytes())
            keys.append(hashlib.blake2b(sets[-1], digest_size=16).digest())
            size += len(sets[-1])
            if size > 4_000_000 or i == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["set_key", "s"])
                keys, sets, size = [], [], 0


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, regs and sets of both) those whose estimate allows the threshold and whose sets meet it."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        columns = [batch.column(k) for k in range(2, 6)]
        for i in range(batch.num_rows):
            ra, rb = (np.frombuffer(c[i].as_buffer(), np.uint16) for c in columns[:2])
            x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in columns[2:])
            if estimate(np.count_nonzero(ra == rb), len(x), len(y)) < SIMILARITY / 100 - SLACK:
                continue
            both = np.concatenate([x, y])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            good[i] = 100 * shared >= SIMILARITY * (len(both) - shared)
        mask = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _bands(regs: Column) -> Column:
    """One 64-bit bucket key per band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(regs, k * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) those whose full sets are similar enough."""
    spark = sets.sparkSession
    pairs = stored(pairs, "near-pairs")
    n = pairs.count()
    if not n:
        return pairs
    if 2 * n <= MOST_BROADCAST:  # else both sides are shuffled whole
        sets = sets.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()), "uid", "left_semi")
    side = lambda x: sets.select(F.col("uid").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("s").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "regs_a", "regs_b", "s_a", "s_b")
    small_batches(spark)
    return stored(both.mapInArrow(_confirmed, "a long, b long"), "near-links")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id, comp: the smallest id reachable, for every id that an edge names.

    Alternates a step towards the smallest neighbour with pointer jumping; each
    state is a table in shared storage, of as many files as its rows need. Nothing is
    gathered but counts.
    """
    rows = 2 * edges.count()
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct(), "near-edges", rows)
    now = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("id"), "comp"), "near-comp", rows)
    for _ in range(most):
        near = both.join(now.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("seen"))
        step = now.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "comp", F.least("comp", F.coalesce("seen", "comp")).alias("next"))
        jump = step.join(now.select(F.col("id").alias("next"), F.col("comp").alias("far")), "next", "left")
        new = stored(jump.select("id", "comp", F.least("next", F.coalesce("far", "next")).alias("next")), "near-comp", rows)
        moved = new.where("comp <> next").limit(1).count()
        now = new.select("id", F.col("next").alias("comp"))
        if not moved:
            return now
    raise RuntimeError("components did not settle")


def _relabelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """members (uid, ...) with their component; those that no edge names are their own."""
    return members.join(comp.withColumnRenamed("id", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))


def _may_link(a: str, b: str) -> Column:
    """Whether size, sketch and parities of two sides (FACTS with a suffix) allow the threshold."""
    c = lambda name, side: F.col(name + side)
    apart = lambda names: reduce(Column.__add__, (F.bit_count(c(x, a).bitwiseXOR(c(x, b))) for x in names))
    sizes = 100 * F.least(c("n", a), c("n", b)) >= SIMILARITY * F.greatest(c("n", a), c("n", b))
    # An intersection of at least SIMILARITY % of the union leaves this share of both sizes to what only one side has.
    odd = (100 + SIMILARITY) * apart(FACTS[3:]) <= (100 - SIMILARITY) * (c("n", a) + c("n", b))
    return sizes & (apart(FACTS[1:3]) <= SKETCH_BITS) & odd


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _of_centres(placed: DataFrame, order: Column) -> DataFrame:
    """Pairs of each bucket's centre, the first by order, with members of other components."""
    centre = placed.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "uid", "comp", *FACTS)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    centres = centre.select("bucket", *(F.col(f"c.{x}").alias(f"{x}_c") for x in ("uid", "comp", *FACTS)))
    return placed.join(centres, "bucket").where((F.col("comp") != F.col("comp_c")) & _may_link("", "_c")).select(*_pair("uid", "uid_c")).distinct()


def _within(placed: DataFrame) -> DataFrame:
    """All plausible pairs of members of different components that share a bucket.

    A large bucket is cut into blocks on the left and repeated for each on the right, so that no key holds all its pairs.
    """
    sizes = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    here = placed.join(sizes.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "bucket")
    here = stored(here, "near-open")
    named = lambda side: [F.col(x).alias(f"{x}_{side}") for x in ("uid", "comp", *FACTS)]
    left = here.select("bucket", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("block"), *named("l"))
    right = here.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *named("r"))
    both = left.join(right, ["bucket", "block"]).where((F.col("uid_l") < F.col("uid_r")) & (F.col("comp_l") != F.col("comp_r")) & _may_link("_l", "_r"))
    return both.select(F.col("uid_l").alias("a"), F.col("uid_r").alias("b")).distinct()


def _partners(placed: DataFrame) -> float:
    """How many members of other components in its buckets a member of an open bucket has on average."""
    by = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).cast("double").alias("k"))
    open_ = by.groupBy("bucket").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("own"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    r = open_.agg(F.sum(F.col("size") * F.col("size") - F.col("own")).alias("pairs"), F.sum("size").alias("members")).first()
    return r["pairs"] / r["members"] if r["members"] else 0.0


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    facts = ", ".join(f"{x} long" for x in FACTS)
    signed = stored(texts.mapInArrow(_sign, f"id long, set_key binary, regs binary, {facts}").withColumn("uid", F.monotonically_increasing_id()), "near-signed")
    full = signed.where("n > 0")
    # One row stands for all rows of equal sets; its number, not its id, names the class from here on.
    classes = stored(full.groupBy("set_key").agg(F.min("uid").alias("uid"), F.min("id").alias("id")), "near-classes")
    reps = full.drop("id").join(classes.select("uid"), "uid", "left_semi")
    banded = reps.select("uid", F.explode(_bands(F.col("regs"))).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stored(banded.join(shared, "bucket"), "near-met")
    known = met.groupBy("uid").agg(F.sum("size").alias("met"))
    open_ = stored(reps.join(known, "uid"), "near-reps")
    members = stored(met.drop("size").join(open_.select("uid", "met", *FACTS), "uid"), "near-members")
    sets = _sets_of(open_, classes, texts)
    # First who meets most others: in all its buckets a group then has few centres, near its middle.
    placed = members.withColumn("comp", F.col("uid"))
    links = [_linked(_of_centres(placed, -F.col("met")), sets)]
    comp = components(links[0])
    for k in range(1, MOST_ROUNDS + 1):
        placed = stored(_relabelled(members, comp), "near-placed")
        if k == MOST_ROUNDS or not links[-1].limit(1).count() or _partners(placed) <= PARTNERS:
            break
        links.append(_linked(_of_centres(placed, F.xxhash64("uid", F.lit(k))), sets))
        comp = components(reduce(DataFrame.unionByName, links))
    links.append(_linked(_within(placed), sets))
    if links[-1].limit(1).count():
        comp = components(reduce(DataFrame.unionByName, links))
    by_class = stored(classes.join(comp.withColumnRenamed("id", "uid"), "uid").select("set_key", "id", "comp"), "near-joined")
    smallest = by_class.groupBy("comp").agg(F.min("id").alias("least")).select("comp", "least")
    least = by_class.join(smallest, "comp").select("set_key", "least")
    # Classes of one text that nothing is linked with have their label already.
    labelled = full.select("id", "n", "set_key").join(classes.select("set_key", F.col("id").alias("own")), "set_key", "left").join(least, "set_key", "left")
    out = labelled.select("id", "n", F.coalesce("least", "own").alias("comp")).unionByName(signed.where("n = 0").select("id", "n", F.col("id").alias("comp")))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def _sets_of(open_: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """uid, regs and s, the full shingle set, of the representatives in open buckets, worked out anew from their texts."""
    wanted = stored(open_.select("uid", "set_key", "regs").join(classes.select("uid", "id"), "uid"), "near-wanted")
    ids = wanted.select(F.col("id").alias("_id")).distinct()
    if wanted.count() <= MOST_BROADCAST:  # else both sides are shuffled
        ids = F.broadcast(ids)
    again = texts.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(_sets, "set_key binary, s binary")
    return stored(wanted.select("uid", "set_key", "regs").join(again, "set_key").dropDuplicates(["uid"]).drop("set_key"), "near-sets")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs without those whose class has an earlier row: one row of each class stays, that of smallest id.

    Rows that repeat an id are documents of their own, of which one stays if their texts are alike; null ids come last.
    An empty table stays empty; columns pass unchanged, whatever their names.
    """
    numbered, key = with_key(docs)
    keep = near_classes(numbered, key).where(F.col(key) == F.col("component_id")).select(key)
    return numbered.join(keep, key, "left_semi").select(docs.columns)
