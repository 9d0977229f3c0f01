"""Language identification, word first with backoff to ever shorter character n-grams.

A word is a maximal run of letters (Unicode's categories L), lower-cased. A known word scores each language by its smoothed log frequency there.
An unseen word is scored by character n-grams of itself between word ends (``^word$``): by its longest known ones,
n = ``max_gram`` first, and by shorter ones only where none of n is known. A text's score is the softmax of its
languages' mean scores per word with the sharpness of ``SHARP`` words, times the prior; the best language wins.

The prior is each language's share of all labelled rows. Words and n-grams are counted, every occurrence (a text of more
than TEXT_WORDS words weighs as one of so many, or one repeated line could be most of a language), in a bounded sample of whole labelled rows: of each language those whose id hash falls under a share that leaves ``max_train_rows``
rows and ``MAX_TRAIN_CHARS`` characters on average in all, dealt evenly, so that a rare language has all its rows where it
has few. All that the sample holds is kept; the sample's rows and characters bound the model that is broadcast.

Edge cases: a null text or one without a letter is ``und`` with score 0; without labelled rows every text is; a text
with letters of which not even one is known (another script) gets the most frequent language, with score 0, as nothing
of it speaks for any; ties go to the language first by code point; repeated rows are judged alike; null ids are judged, and hashed as an empty id; extra columns pass through
``keep_known``. Whole texts are scored, whatever their length.

Scale: prediction is one pass without a shuffle. A worker keeps scores of words it has met in a bounded cache, and scores
the words that some texts have and it lacks all at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import clear_of, drop_path, pieces, stash

MAX_TRAIN_ROWS = 8192
MAX_TRAIN_CHARS = 1 << 26
MAX_GRAM = 5
SHARP = 8.0
MIN_SCORE = 0.5
CACHE = 250_000
#: Words of a text that count in full, and parts of a count (whole numbers add up to the same in any order).
TEXT_WORDS, UNIT = 1000, 1024
#: Distinct words whose n-grams a training task counts before it hands the counts on.
TRAIN_WORDS = 25_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """The words of a text. The pattern also takes numbers that are no digits (fractions, Roman numerals); they part words."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ("".join(c if c.isalpha() else " " for c in x).split() if not x.isalpha() else (x,))]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between its ends; for n = 1 its letters alone."""
    if n == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log probabilities of each language for known words and n-grams."""

    def __init__(self, counts: Iterable[tuple[str, int, str, float]], rows: dict[str, int], max_gram: int = MAX_GRAM) -> None:
        """counts: (language, n, key, count), n = 0 for words; rows: training rows by language."""
        self.langs = sorted(rows)
        self.max_gram = max_gram
        at = {lang: i for i, lang in enumerate(self.langs)}
        #: Row numbers of words (0) and of n-grams by n, and the rows.
        self.rows: list[dict[str, int]] = [{} for _ in range(max_gram + 1)]
        given: list[tuple[list[int], list[int], list[float]]] = [([], [], []) for _ in range(max_gram + 1)]
        for lang, n, key, count in counts:
            row = self.rows[n].setdefault(key, len(self.rows[n]))
            for held, v in zip(given[n], (row, at[lang], count), strict=True):
                held.append(v)
        self.scores: list[np.ndarray] = []
        for table, (row, lang_at, count) in zip(self.rows, given, strict=True):
            sums = np.zeros((len(table), len(self.langs)))
            np.add.at(sums, (np.array(row, int), np.array(lang_at, int)), count)
            self.scores.append((np.log(sums + 0.5) - np.log(sums.sum(0) + 0.5 * (len(table) + 1))).astype(np.float32))
        total = sum(rows.values())
        self.prior = np.array([math.log(rows[lang] / total) for lang in self.langs]) if total else np.zeros(0)

    def of_words(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's score for each language, and whether anything of it is known."""
        out, known = np.zeros((len(wanted), len(self.langs)), np.float32), np.zeros(len(wanted), bool)
        left = list(range(len(wanted)))
        for n in range(self.max_gram + 1):
            # Words first (0), then their n-grams from the longest to the shortest.
            size = 0 if n == 0 else self.max_gram + 1 - n
            get = self.rows[size].get
            rows, met, sizes, rest = [], [], [], []
            for i in left:
                found = [r for g in (grams(wanted[i], size) if size else (wanted[i],)) if (r := get(g)) is not None]
                if found:
                    rows += found
                    met.append(i)
                    sizes.append(len(found))
                else:
                    rest.append(i)
            if met:
                first = np.cumsum(sizes) - sizes
                out[met] = np.add.reduceat(self.scores[size][rows], first, 0) / np.array(sizes, np.float32)[:, None]
                known[met] = True
            left = rest
        return out, known

    def texts(self, given: list[str | None], known: Known) -> list[tuple[str, float]]:
        """Language and score of each text."""
        found = [words(t) if t else [] for t in given]
        known.begin(found)
        out = []
        for ws in found:
            if not ws or not self.langs:
                out.append(("und", 0.0))
                continue
            sums = known.table[list(map(known.__getitem__, ws))].sum(axis=0, dtype=np.float64)
            if not (n := sums[-1]):
                out.append((self.langs[int(self.prior.argmax())], 0.0))
                continue
            score = sums[:-1] / n * min(n, SHARP) + self.prior
            p = np.exp(score - score.max())
            p /= p.sum()
            best = int(p.argmax())
            out.append((self.langs[best], float(p[best])))
        return out


class Known(dict):
    """Rows of words in a table of scores for each language and a last column: 1, or 0 where nothing of a word is known."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.table = np.zeros((1 << 12, len(model.langs) + 1), np.float32)

    def begin(self, texts: list[list[str]]) -> None:
        """Learn the words of these texts; forget all others when there are too many."""
        new = {w for ws in texts for w in ws if w not in self}
        if len(self) + len(new) > CACHE:
            self.clear()
            new = {w for ws in texts for w in ws}
        if not new or not self.model.langs:
            return
        fresh = list(new)
        while len(self) + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        at = len(self)
        self.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        scores, known = self.model.of_words(fresh)
        self.table[at : at + len(fresh), :-1] = scores
        self.table[at : at + len(fresh), -1] = known


def shares(rows: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's rows in a sample of most rows: dealt evenly, what one lacks goes to the others."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(rows) - k))
        out[lang] = take / n
        left -= take
    return out


def train(rows: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, max_gram: int = MAX_GRAM, max_train_chars: int = MAX_TRAIN_CHARS) -> Model:
    """A model of labelled rows (doc_id, text, lang); those with a null text or language are no use."""
    labelled = rows.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text") + 1).alias("chars")).collect()
    docs, chars = {r.lang: r.rows for r in sizes}, {r.lang: r.chars for r in sizes}
    if sum(docs.values()) > max_train_rows or sum(chars.values()) > max_train_chars:
        by_rows, by_chars = shares(docs, max_train_rows), shares(chars, max_train_chars)
        given = [(lang, int(min(by_rows[lang], by_chars[lang]) * (1 << 30))) for lang in docs]
        quota = rows.sparkSession.createDataFrame(given, "lang string, quota long")
        spot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30))
        labelled = labelled.join(quota, "lang").where(spot < F.col("quota"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the words of some documents at a time."""
        for batch in pieces(batches):
            seen: Counter[tuple[str, str]] = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                unit = UNIT * min(1.0, TEXT_WORDS / max(len(found), 1))
                for w, n in Counter(found).items():
                    seen[lang, w] += max(1, round(n * unit))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "key", "count"])

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the n-grams of some distinct words at a time."""
        for batch in pieces(batches, TRAIN_WORDS):
            seen: Counter[tuple[str, int, str]] = Counter()
            for lang, w, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for size in range(1, max_gram + 1):
                    for g in grams(w, size):
                        seen[lang, size, g] += k
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array([k[2] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "n", "key", "count"])

    counted = labelled.select("text", "lang").mapInArrow(count, "lang string, key string, count long").groupBy("lang", "key").agg(F.sum("count").alias("count"))
    held, held_path = stash(counted, "langid-words")
    spelt = held.mapInArrow(spell, "lang string, n int, key string, count long").groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))
    kept, path = stash(held.select("lang", F.lit(0).alias("n"), "key", "count").unionByName(spelt), "langid-counts")
    table = kept.withColumn("count", F.col("count") / UNIT).toArrow()
    for p in (held_path, path):
        drop_path(rows.sparkSession, p)
    # Column by column and piece by piece: rows of Python objects would take the driver far more memory.
    counts = (row for piece in table.to_batches(max_chunksize=4096) for row in zip(*(piece.column(c).to_pylist() for c in ("lang", "n", "key", "count")), strict=True))
    return Model(counts, docs, max_gram)


def predict(docs: DataFrame, model: Model, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its score as two more columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    raw = clear_of("raw_text", docs.columns)
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value)
        for batch in pieces(batches):
            said = shared.value.texts(batch.column(len(names)).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=[*names, lang_col, score_col])

    schema = docs.withColumns({lang_col: F.lit("").cast("string"), score_col: F.lit(0.0)}).schema
    return docs.withColumn(raw, F.col("text").cast("string")).mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(f"not ({HELD_OUT})").select("doc_id", "text", "lang")


HELD_OUT = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 3 = 1"


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs whose language is known with min_score at least; it rejects texts without letters, of which nothing is known, and garbled ones."""
    lang, score = clear_of("lang_pred", docs.columns), clear_of("lang_score", docs.columns)
    told = predict(docs, train(training_rows(docs)), lang, score)
    return told.where((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    given = docs.select(F.col("doc_id").cast("long"), F.expr(HELD_OUT).alias("held_out"), F.col("text").cast("string"))
    return predict(given, train(training_rows(docs))).select("doc_id", "held_out", "lang_pred", "score")
