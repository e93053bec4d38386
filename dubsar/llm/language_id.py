"""Language identification by string kernels.

Two texts are alike as they have the same letter n-grams: for each length from 1 to
SPECTRUM the cosine of their presence vectors, averaged (a blended spectrum, presence
instead of counts). Letters are lower-cased and every run of other characters is one
blank, also at both ends. Nyström: the kernel is only ever taken against LANDMARKS
texts, and a one-versus-rest ridge regression is solved in the space they span. Scoring
is two matrix products a batch: presence of the batch by landmarks, kernel values by
weights of the languages.

Learning is bounded: at most PER_LANGUAGE texts of a language and TRAIN_ROWS in all,
chosen by the hash of doc_id; landmarks are the first LANDMARKS of these, turn by turn
over the languages, of at most LANDMARK_CHARS characters. The n-grams of the kernel are
the MOST_GRAMS that most landmarks have (characters: MOST_CHARS); a text's other
n-grams count for nothing. Every document is scored by its whole text, in pieces where
it is long. Rows with null lang or doc_id teach nothing.

Defined results: null texts and texts without a letter are "und" with score 0; texts
that share nothing with any landmark get the most frequent language, ties too; without
labelled rows all are "und"; held_out is false for a null doc_id; repeated rows are
scored each, and teach once; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dubsar.llm.shared import small_batches, stored

SPECTRUM = 3
LANDMARKS, LANDMARK_CHARS = 160, 20_000
PER_LANGUAGE, TRAIN_ROWS = 400, 4_000
MOST_CHARS, MOST_GRAMS = 512, 8_192
#: Weight of the penalty, a part of the number of rows.
RIDGE = 1e-3
#: Characters and texts looked at together; they bound what a task holds.
PIECE, ROWS = 1 << 17, 64
#: Parts of a language that are ranked apart before its sample is drawn.
SALTS = 64
HELD_OUT_OF, HELD_OUT = 4, 2
UNKNOWN = "und"
BLANK = 1


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


@functools.cache
def _folded() -> np.ndarray:
    """The lower-case letter of every code point, 32 for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in (*range(0xD800), *range(0xE000, 0x32000)):
        if (c := chr(i)).isalpha():
            table[i] = ord(c.lower()[0])
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Spectrum:
    """Presence vectors over a closed set of n-grams: state 0 is none, states 1 to A are the characters, one table leads from a gram and a character to the longer gram."""

    def __init__(self, texts: list[str]) -> None:
        folded = [self._spaced(_folded()[_points(t)]) for t in texts]
        seen = Counter(c for f in folded for c in np.unique(f).tolist())
        chars = [32, *sorted((c for c in seen if c != 32), key=lambda c: (-seen[c], c))[: MOST_CHARS - 1]]
        self.chars = np.array(chars, np.uint32)
        classes = self._classes()
        had: Counter = Counter()
        for f in folded:
            c = classes[f]
            for n in range(2, SPECTRUM + 1):
                windows = np.lib.stride_tricks.sliding_window_view(c, n) if len(c) >= n else np.empty((0, n), c.dtype)
                had.update(map(tuple, np.unique(windows[(windows > 0).all(axis=1)], axis=0).tolist()))
        states = {(i,): i for i in range(1, len(chars) + 1)}
        # The more frequent first, then the shorter: a gram never comes before the one that it extends.
        for g in sorted(had, key=lambda g: (-had[g], len(g), g))[: MOST_GRAMS - len(chars)]:
            states[g] = len(states) + 1
        self.size = len(states) + 1
        self.step = np.zeros((self.size, len(chars) + 1), np.uint16)
        self.length = np.zeros(self.size, np.uint8)
        for g, s in states.items():
            self.length[s] = len(g)
            if len(g) > 1:
                self.step[states[g[:-1]], g[-1]] = s

    def _classes(self) -> np.ndarray:
        """The number of every folded character, 0 for unknown letters."""
        table = np.zeros(0x110000, np.uint16)
        table[self.chars] = np.arange(1, len(self.chars) + 1)
        return table

    @functools.cached_property
    def classes(self) -> np.ndarray:
        """The same for every code point."""
        return self._classes()[_folded()]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "classes"}

    @staticmethod
    def _spaced(f: np.ndarray) -> np.ndarray:
        """Folded characters of one text with a blank at both ends and single ones between."""
        f = np.concatenate(([32], f, [32]))
        return f[np.concatenate(([True], (f[1:] != 32) | (f[:-1] != 32)))]

    def _mark(self, here: np.ndarray, rows: np.ndarray, c: np.ndarray) -> None:
        """Mark the grams of characters c, each of the text rows; none across texts."""
        flat, rows = here.reshape(-1), rows * self.size
        state = c
        flat[rows + state] = 1
        for n in range(2, SPECTRUM + 1):
            state = self.step[state[:-1], c[n - 1 :]]
            flat[rows[n - 1 :] + np.where(rows[n - 1 :] == rows[: len(rows) - n + 1], state, 0)] = 1

    def presence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each of some few texts, each length's part of length 1; and whether the text has a letter."""
        here = np.zeros((len(texts), self.size), np.float32)
        letters = np.zeros(len(texts), bool)
        held: list[int] = []
        chars = 0

        def together() -> None:
            c = self.classes[_points("".join(f" {texts[i]} " for i in held))]
            rows = np.repeat(np.array(held, np.int32), [len(texts[i]) + 2 for i in held])
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] != BLANK) | (c[:-1] != BLANK) | (rows[1:] != rows[:-1])
            letters[rows[c != BLANK]] = True
            self._mark(here, rows[keep], c[keep])

        for i, text in enumerate(texts):
            if text is None:
                continue
            if len(text) > PIECE:
                letters[i] = self._long(here, i, text)
                continue
            if held and chars + len(text) > PIECE:
                together()
                held, chars = [], 0
            held.append(i)
            chars += len(text) + 2
        if held:
            together()
        here[:, 0] = 0
        for n in range(1, SPECTRUM + 1):
            of = self.length == n
            here[:, of] /= np.sqrt(np.maximum(here[:, of].sum(axis=1, keepdims=True), 1))
        return here, letters

    def _long(self, here: np.ndarray, i: int, text: str) -> bool:
        """A long text in pieces; each begins with what the last one ended with."""
        tail, found = np.array([BLANK], np.uint16), False
        for at in range(0, len(text) + 1, PIECE):
            c = np.concatenate((tail, self.classes[_points(text[at : at + PIECE] or " ")]))
            if at + PIECE >= len(text):
                c = np.append(c, np.uint16(BLANK))
            found |= bool((c[len(tail) :] != BLANK).any())
            c = c[np.concatenate(([True], (c[1:] != BLANK) | (c[:-1] != BLANK)))]
            self._mark(here, np.full(len(c), i, np.int32), c)
            tail = c[-(SPECTRUM - 1) :]
        return found


class Model:
    """Landmarks and the weights of each language on them."""

    def __init__(self, landmarks: list[str]) -> None:
        self.spectrum = Spectrum(landmarks)
        self.landmarks = self.spectrum.presence(landmarks)[0].T.copy()
        self.languages: list[str] = []
        self.weights = np.zeros((len(landmarks), 0))

    def kernel(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        values, letters = np.empty((len(texts), self.landmarks.shape[1]), np.float32), np.empty(len(texts), bool)
        for at in range(0, len(texts), ROWS):
            here, letters[at : at + ROWS] = self.spectrum.presence(texts[at : at + ROWS])
            values[at : at + ROWS] = here @ self.landmarks / SPECTRUM
        return values, letters

    def fit(self, values: np.ndarray, langs: list[str]) -> None:
        """One-versus-rest ridge regression on kernel values (rows by landmarks); each language weighs the same."""
        count = Counter(langs)
        self.languages = sorted(count, key=lambda x: (-count[x], x))
        own = np.array([[1.0 if x == y else -1.0 for y in self.languages] for x in langs])
        weight = np.array([len(langs) / (len(count) * count[x]) for x in langs])[:, None]
        among = self.landmarks.T.astype(float) @ self.landmarks / SPECTRUM
        left = values.T @ (weight * values) + RIDGE * len(langs) * among + 1e-6 * np.eye(len(among))
        self.weights = np.linalg.solve(left, values.T @ (weight * own))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        values, letters = self.kernel(texts)
        said = values @ self.weights
        best = said.argmax(axis=1)
        score = np.where(letters, np.clip((said.max(axis=1) + 1) / 2, 0, 1), 0.0)
        return [self.languages[b] if known else UNKNOWN for b, known in zip(best, letters, strict=True)], score


def _sample(docs: DataFrame) -> DataFrame:
    """lang, turn, text of the rows to learn from, at most TRAIN_ROWS; stored."""
    labelled = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out("doc_id")).select("doc_id", "lang").distinct()
    hashed = labelled.withColumn("hash", F.xxhash64("doc_id")).withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    turn = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "doc_id"))
    # The first of a language are among the first of each of its parts.
    few = hashed.withColumn("turn", turn("lang", "salt")).where(F.col("turn") <= PER_LANGUAGE)
    chosen = few.withColumn("turn", turn("lang")).where(F.col("turn") <= PER_LANGUAGE).select("doc_id", "lang", "turn").orderBy("turn", "lang").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", "lang", "text").where("text IS NOT NULL").join(F.broadcast(chosen), ["doc_id", "lang"])
    return stored(texts.groupBy("doc_id", "lang", "turn").agg(F.min("text").alias("text")).select("lang", "turn", "text"), "language-sample")


def learn(docs: DataFrame) -> Model | None:
    """A model from the labelled rows (doc_id, lang, text) that are not held out; None without any."""
    spark = docs.sparkSession
    small_batches(spark, 256, 2 << 20)
    sample = _sample(docs)
    fit = sample.where(F.length("text") <= LANDMARK_CHARS).where(F.col("text").rlike(r"\p{L}"))
    landmarks = [r["text"] for r in fit.orderBy("turn", "lang").limit(LANDMARKS).collect()]  # at most LANDMARKS texts of bounded length
    if not landmarks:
        return None
    model = Model(landmarks)
    sent = spark.sparkContext.broadcast(model)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, letters = sent.value.kernel(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tolist() if has else None for r, has in zip(k, letters, strict=True)], pa.list_(pa.float32()))], ["lang", "k"])

    rows = sample.select("lang", "text").mapInArrow(values, "lang string, k array<float>").where("k IS NOT NULL").orderBy("lang", "k").collect()  # at most TRAIN_ROWS rows of LANDMARKS numbers
    model.fit(np.array([r["k"] for r in rows], float), [r["lang"] for r in rows])
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark, 256, 2 << 20)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if sent.value is None:
                said, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            else:
                said, score = sent.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
