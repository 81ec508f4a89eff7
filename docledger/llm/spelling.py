"""Spelling variants: words one edit apart, by searches in bidirectional FM-indexes.

A word one edit away from another one holds either its first or its second half unchanged, at
its own start or end. So every word is dealt out as an entry under each first and last part
that a word of nearly its length may ask for, and as a question under its own two halves.
Parts with very many entries are split by the hash of the entry, and questions about them go
to every split, so no task holds a part whole and no pairs of a part are formed.

A task strings its entries together, with a delimiter before each, and indexes that text and
its reverse (Burrows-Wheeler transform, wavelet matrix). Ranks of suffixes that begin with a
pattern are an interval in each index, and a search keeps both in step, so a pattern can grow
at either end. A question matches one half exactly, grows it to the delimiter beside it, then
grows across the other half, where one step may replace, insert or leave out a letter, up to
the delimiter at the other side. The one suffix left names the entry. All questions of one
length move together, a letter at a time.

``variants`` then takes for each word its most frequent near word if that is frequent enough,
and follows these links to the last one by doubling.

Defined results: null and empty texts have no words; a null id reads ``null``. Counts run over
all rows, repeated ones too. A word may be of any length. Ties go to the smallest word in
code-point order. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .fm_index import Index
from .tables import save, small

RUN = r"[A-Za-zÀ-ÿ]+"
#: Entries of one index, and of one part before it is split.
ENTRIES = 8_000
PART = 4_000


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, run``: every maximal run of letters, A-Z lower-cased."""
    found = F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))
    run = F.explode(found)
    low = F.translate(F.col("run"), string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("doc_id"), run.alias("run")).withColumn("run", low)


def vocabulary(words: DataFrame, word: str | Column, letters: int = 6, least: int = 5) -> DataFrame:
    """``word, n`` of the words of at least ``letters`` code points that occur ``least`` times; saved."""
    every = words.select(F.col(word).alias("word") if isinstance(word, str) else word.alias("word"))
    counts = every.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return save(counts.where(F.col("n") >= least), "vocabulary")


class Dictionary:
    """Both indexes of a list of distinct words, each behind a delimiter (symbol 0)."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.letters = np.unique(points)
        sizes = np.array([len(w) for w in words])
        self.at = np.cumsum(sizes + 1) - sizes - 1  # of each word's delimiter
        ring = np.zeros(int(sizes.sum()) + len(words), np.int64)
        inside = np.ones(len(ring), bool)
        inside[self.at] = False
        ring[inside] = np.searchsorted(self.letters, points) + 1
        self.forward, self.reverse = Index(ring), Index(ring[::-1])

    def codes(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of symbols; -1 for a letter that no entry has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        at = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == points
        return np.where(known, at + 1, -1).astype(np.int64)

    def near(self, words: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word's and an entry's number: one edit apart, with the first (or last) half unchanged."""
        code, half = self.codes(words), len(words[0]) // 2
        border = np.zeros((len(words), 1), np.int64)
        if first:  # grow the first half to its front, then across the second half
            exact, other = np.hstack([code[:, :half][:, ::-1], border]), code[:, half:]
            ahead, behind = self.forward, self.reverse
        else:
            exact, other = np.hstack([code[:, half:], border]), code[:, :half][:, ::-1]
            ahead, behind = self.reverse, self.forward
        state = _every(ahead.size, len(words))
        for k in range(exact.shape[1]):
            state = _grow(ahead, state, exact[:, k])
        q, lo, twin, size = _one_edit(behind, (state[0], state[2], state[1], state[3]), other)
        entry = self.forward.suffixes[twin if first else lo]
        return q, np.searchsorted(self.at, entry)


def _every(size: int, n: int) -> tuple:
    """``(question, start, start in the other index, size)`` of patterns of no symbols."""
    return np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, size)


def _grow(index: Index, state: tuple, symbols: np.ndarray) -> tuple:
    """Patterns with their question's symbol in front, if some suffix begins so."""
    q, lo, twin, size = state
    q, lo, twin, size = (x[symbols[q] >= 0] for x in (q, lo, twin, size))
    new, left, less = index.step(symbols[q], lo, size)
    some = left > 0
    return q[some], new[some], (twin + less)[some], left[some]


def _join(*states: tuple) -> tuple:
    return tuple(np.concatenate(part) for part in zip(*states))


def _one_edit(index: Index, exact: tuple, other: np.ndarray) -> tuple:
    """Grow across ``other`` (a row per question) with exactly one edit, up to the delimiter."""
    n, long = other.shape
    edited = tuple(x[:0] for x in exact)
    for j in range(long + 1):
        q, lo, twin, size = exact
        want = other[:, j] if j < long else np.full(n, -1)
        source, symbol, new, left, less = index.children(lo, size)
        asked = want[q[source]]
        child = (q[source], new, twin[source] + less, left)
        changed = tuple(x[(symbol > 0) & (symbol != asked)] for x in child)
        edited = _join(edited, changed)  # a letter more; one equal to the next goes behind it
        if j == long:
            break
        nothing = other[q, j] != (other[q, j + 1] if j + 1 < long else -2)  # of equal letters the last one is left out
        edited = _join(_grow(index, edited, want), changed, tuple(x[nothing] for x in exact))
        exact = tuple(x[symbol == asked] for x in child)
    return _grow(index, edited, np.zeros(n, np.int64))


def near_words(vocabulary: DataFrame, letters: int = 6) -> DataFrame:
    """``word, near, near_n``: every two words one edit apart, both ways. ``vocabulary``: ``word, n``, saved, distinct."""
    size = F.length("word")
    asks = [size + k for k in (-1, 0, 1)]  # lengths of the words that may ask for an entry

    def part(long: Column, first: bool) -> Column:
        half = F.floor(long / 2).cast("int")
        return F.concat(F.lit("<"), F.substring("word", F.lit(1), half)) if first else F.concat(F.lit(">"), F.substring("word", size - long + half + 1, long - half))

    parts = [F.when(a >= letters, part(a, first)) for a in asks for first in (True, False)]
    entries = vocabulary.select("word", "n", F.explode(F.array_compact(F.array_distinct(F.array(*parts)))).alias("part"))
    questions = vocabulary.select("word", F.explode(F.array(part(size, True), part(size, False))).alias("part"))
    counts = entries.groupBy("part").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > PART)
    splits = small(save(counts.select("part", F.ceil(F.col("held") / PART).cast("int").alias("splits")), "splits"))
    bins = max(1, -(-4 * vocabulary.count() // ENTRIES))

    def binned(rows: DataFrame, split: Column) -> DataFrame:
        found = rows.join(splits, "part", "left").withColumn("splits", F.coalesce("splits", F.lit(1))).withColumn("split", split)
        return found.withColumn("bin", F.pmod(F.xxhash64("part", "split"), F.lit(bins)))

    held = binned(entries, F.pmod(F.xxhash64("word"), F.col("splits")).cast("int")).select("bin", "word", "n")
    asked = binned(questions, F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    asked = asked.select("bin", F.col("word").alias("asked"), F.startswith("part", F.lit("<")).alias("first"))

    def work(key, left, right):
        counted = dict(zip(left.column("word").to_pylist(), left.column("n").to_pylist()))
        groups: dict = {}
        for word, first in set(zip(right.column("asked").to_pylist(), right.column("first").to_pylist())):
            groups.setdefault((len(word), first), []).append(word)
        out: list = []
        if counted and groups:
            held = Dictionary(sorted(counted))
            for (long, first), words in sorted(groups.items()):
                q, entry = held.near(words, first)
                pairs = {(words[a], held.words[b]) for a, b in zip(q.tolist(), entry.tolist())}
                # what begins with the first half is found from that half
                out += [p for p in pairs if first or not p[1].startswith(p[0][: long // 2])]
        columns = [[p[0] for p in out], [p[1] for p in out], [counted[p[1]] for p in out]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])

    found = held.groupBy("bin").cogroup(asked.groupBy("bin")).applyInArrow(work, "word STRING, near STRING, near_n LONG")
    return found.dropDuplicates(["word", "near"])  # an entry may be in a bin under several parts


def variants(vocabulary: DataFrame, letters: int = 6, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of a saved ``vocabulary`` (``word, n``).

    The form is the most frequent near word, if it occurs ``ratio`` times as often; the root is
    the last of the forms that follow one another. Counts grow along a chain, so it ends.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = near_words(vocabulary, letters).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = vocabulary.join(near, "word", "left")
    frequent = -F.col("best.minus") >= ratio * F.col("n")
    rows = save(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n")), "forms")
    links = save(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = save(links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if not moved.where("moved").head(1):
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
