"""Benchmark passages in documents, paraphrased ones too, by latent semantic retrieval.

Documents are read as overlapping passages of words, three times as long as the
longest benchmark item and half a passage apart, so a stretch of one and a half
items lies whole in some passage. Passages and items are TF-IDF vectors
over the items' words, a vocabulary bounded by the benchmark; document
frequencies count the passages of all documents. A randomised SVD of the
passages that can hold an item gives the latent space: random directions are
multiplied by the passage matrix and its transpose in tasks, and what is summed
has one row for a word of the vocabulary. Passages and items that are near in
that space are candidates and judged first; all other pairs that the word test
below admits are judged too if some stretch has enough of the item's words, so what the
space does not span is not lost. A candidate is a leak if the longest common
subsequence of its words with the item's, within a stretch of at most one and
a half items, covers ``COVER`` of the item, or ``PARAPHRASE`` of it when it also
covers nearly all of the item's answer, its last ``ANSWER`` words.

A passage can hold an item only if it has ``PARAPHRASE`` of the item's words (all, if the item has
fewer than ``LEAST``); other passages are counted but not looked at further. This leaves out no leak.

Words are runs of letters and digits in lower case. Items without words are
left out; items of fewer than ``LEAST`` words must occur word for word. Null
and empty texts hold no leak. Items that are equal are found alike, repeated rows
are judged alike, a null item id stays null. An empty table gives no rows.
The benchmark is the stated query set, held by every task: ``ITEMS`` items at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from oddlines.llm.common import partitions
from oddlines.llm.words import distinct, hashed_words, portions
from oddlines.storage import materialize

ITEMS = 20_000  # items that are searched for at once
RANK = 128
COVER = 0.75
PARAPHRASE = 0.6
ANSWER = 8
CELLS = 1 << 21  # of the matrix of passages and words that is multiplied at a time
LEAST = 8
NEAR = 0.1  # cosine in the latent space from which a passage is judged without a count by stretches

# 1: letter, digit or byte of a longer character; all else parts words
LETTERS = np.zeros(256, np.uint8)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass
class Items:
    """The benchmark as word ids; ids follow the sorted hashes ``vocabulary``."""

    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray
    passage: int  # words of a passage

    def least(self) -> np.ndarray:
        """The words of each item that a passage must have at the least."""
        lengths = np.array([len(w) for w in self.words])
        return np.where(lengths < LEAST, lengths, PARAPHRASE * lengths - 1e-9)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each word of a text, -1 for one that no item has."""
        at = np.searchsorted(self.vocabulary, hashes)
        at = np.minimum(at, len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def read_items(rows: pd.DataFrame) -> Items | None:
    hashes, bounds = hashed_words(list(rows["text"]), LETTERS)
    keep = np.flatnonzero(np.diff(bounds))
    if not len(keep):
        return None
    vocabulary = distinct(hashes)
    words = [np.searchsorted(vocabulary, hashes[bounds[i] : bounds[i + 1]]) for i in keep]
    ids = [rows["item_id"].iloc[i] for i in keep]
    return Items(ids, words, vocabulary, 3 * max(map(len, words)))


def can_hold(items: Items, known: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which passages hold ``PARAPHRASE`` of some item's words, in whatever order; no leak does with fewer.

    Also in how many passages each word of the items occurs.
    """
    lengths, least = np.array([len(w) for w in items.words]), items.least()
    flat, starts = np.concatenate(items.words), np.append(0, np.cumsum(lengths)[:-1])
    step = max(1, (1 << 21) // len(flat))
    found, counts = [np.zeros(0, np.int64)], np.zeros(len(items.vocabulary), np.int64)
    for begin in range(0, len(start), step):
        low, high = start[begin : begin + step], stop[begin : begin + step]
        size = high - low
        row = np.repeat(np.arange(len(low)), size)
        at = np.arange(size.sum()) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size) + np.repeat(low, size)
        holds = np.zeros((len(low), len(items.vocabulary) + 1), np.uint8)
        holds[row, known[at]] = 1
        holds[:, -1] = 0  # words of no item
        counts += holds[:, :-1].sum(axis=0, dtype=np.int64)
        common = np.add.reduceat(holds[:, flat], starts, axis=1, dtype=np.int32)
        found.append(begin + np.flatnonzero((common >= least).any(axis=1)))
    return np.concatenate(found), counts


def passages_of(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, words, df): the passages that can hold an item, and one row a task that counts all passages.

    ``df`` has for each word of the items the number of passages with it, and
    last the number of passages; it is null in the rows of passages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, half = len(items.vocabulary), max(1, items.passage // 2)
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            begin, docs_ = 0, batch["doc_id"].to_numpy()
            for part in portions(list(batch["text"])):
                hashes, bounds = hashed_words(part, LETTERS)
                known, lengths = items.known(hashes), np.diff(bounds)
                n = np.maximum(1, -(-lengths // half) - 1)  # a later passage begins only if it has new words
                owner = np.repeat(np.arange(len(part)), n)
                piece = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
                start = bounds[owner] + piece * half
                stop = np.minimum(bounds[owner + 1], start + items.passage)
                keep, counts = can_hold(items, known, start, stop)
                df[:size] += counts
                df[size] += len(start)
                if len(keep):
                    words = [known[x:y].astype(np.int32) for x, y in zip(start[keep].tolist(), stop[keep].tolist())]
                    yield pd.DataFrame({"doc_id": docs_[begin + owner[keep]], "words": words, "df": None})
                begin += len(part)
        yield pd.DataFrame({"doc_id": [None], "words": [None], "df": [df]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    # each task counts once: their number follows the cores, not the files
    few = docs.select("doc_id", "text").coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)
    return few.mapInPandas(run, f"doc_id {kind}, words array<int>, df array<long>")


def frequencies(passages: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Document frequencies of the items' words over all passages, and the number of passages."""
    counted = passages.filter("df IS NOT NULL").select(F.posexplode("df").alias("word", "n")).groupBy("word").agg(F.sum("n"))
    df = np.zeros(size + 1, np.int64)
    for word, n in counted.collect():  # a row a word of the benchmark
        df[word] = n
    return df[:size], int(df[size])


def tfidf(rows: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors as (row, word, weight) entries; words of no item count for the length only by their number."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    words = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    keep = words >= 0
    keys = np.sort(owner[keep] * len(idf) + words[keep])
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, tf = keys[starts], np.diff(np.append(starts, len(keys)))
    owner, words = keys // len(idf), keys % len(idf)
    weight = (1 + np.log(tf)) * idf[words]
    norm = np.sqrt(np.bincount(owner, weight * weight, minlength=len(rows)))
    return owner, words, weight / np.where(norm > 0, norm, 1)[owner]


def _dense(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The unit TF-IDF vectors as a matrix; callers bound the rows by the words."""
    owner, words, weight = tfidf(rows, idf)
    out = np.zeros((len(rows), len(idf)), np.float32)
    out[owner, words] = weight
    return out


def _blocks(batch: pd.DataFrame, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    step = max(1, CELLS // size)
    for begin in range(0, len(batch), step):
        yield begin, [np.asarray(w) for w in batch["words"][begin : begin + step]]


def latent_basis(passages: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = 1, seed: int = 7) -> np.ndarray:
    """The ``rank`` leading right singular vectors of the passage matrix, by randomised subspace iteration.

    Each round multiplies the basis by the matrix and its transpose: tasks send
    sums with a row for a word, which add up as they come in.
    """
    size = len(idf)
    rank = min(rank, size)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, rank)))[0]
    spark = passages.sparkSession

    def times(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((basis.astype(np.float32), idf))  # words of the benchmark times rank

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((size, rank))
            base, weights = shared.value
            for batch in batches:
                for _, rows in _blocks(batch, size):
                    matrix = _dense(rows, weights)
                    total += matrix.T @ (matrix @ base)
            at = np.flatnonzero(total.any(axis=1))
            if len(at):
                yield pd.DataFrame({"word": at.astype(np.int32), "sums": list(total[at])})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for word, row in zip(batch["word"], batch["sums"]):
                    sums[word] = sums.get(word, 0) + np.asarray(row)
            if sums:
                yield pd.DataFrame({"word": list(sums), "sums": list(sums.values())})

        schema = "word int, sums array<double>"
        parts = passages.select("words").mapInPandas(run, schema).repartition(partitions(spark), "word").mapInPandas(add, schema)
        out = np.zeros((size, rank))
        for word, row in parts.collect():
            out[word] = row
        return out

    for _ in range(rounds):
        basis = np.linalg.qr(times(basis))[0]
    return basis


def common_length(item: list[int], text: list[int], width: int) -> int:
    """The longest common subsequence of ``item`` with any ``width`` neighbouring words of ``text``.

    One bit a word of the item; every stretch of the width that begins at a word of the item is tried.
    """
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    places = [i for i, w in enumerate(text) if w in masks]
    best, end = 0, 0
    for n, start in enumerate(places):
        while end < len(places) and places[end] < start + width:
            end += 1
        if end - n <= best:
            continue
        row = full
        for i in places[n:end]:
            hit = row & masks[text[i]]
            row = ((row + hit) | (row - hit)) & full
        best = max(best, len(item) - row.bit_count())
        if best == len(item):
            break
    return best


def dense_enough(item: np.ndarray, text: np.ndarray, mine: np.ndarray) -> bool:
    """Whether some stretch has as many places with words of the item as a leak has words in common with it.

    ``mine`` is all False, a place for each word id and one more, and is left so.
    """
    mine[item] = True
    places = np.flatnonzero(mine[text])
    mine[item] = False
    if len(item) < LEAST:
        width, least = len(item), len(item)
    else:
        width, least = len(item) + len(item) // 2, int(np.ceil(PARAPHRASE * len(item) - 1e-9))
    return bool(len(places) >= least and (places[least - 1 :] - places[: len(places) - least + 1] < width).any())


def is_leak(item: np.ndarray, text: np.ndarray) -> tuple[bool, float]:
    """Whether a passage holds an item, and how much of it."""
    words, found = item.tolist(), text.tolist()
    if len(words) < LEAST:
        hit = any(found[i : i + len(words)] == words for i in range(len(found) - len(words) + 1))
        return hit, float(hit)
    width = len(words) + len(words) // 2
    cover = common_length(words, found, width) / len(words)
    if cover >= COVER or cover < PARAPHRASE:
        return cover >= COVER, cover
    answer = words[-ANSWER:]
    return common_length(answer, found, len(answer) + 2) >= len(answer) - 1, cover


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cover): each document and item it holds, with the best cover."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    item = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item}, cover double"
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    groups = -(-rows.count() // ITEMS)
    found = spark.createDataFrame([], schema)
    for group in range(groups):  # a benchmark is small: one group unless it has over ITEMS items
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group)
        items = read_items(part.toPandas().sort_values(["item_id", "text"], kind="stable"))
        if items is not None:
            found = found.union(_leaks_of(docs, items, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("cover").alias("cover"))


def _leaks_of(docs: DataFrame, items: Items, schema: str) -> DataFrame:
    stored = materialize(passages_of(docs, items), "passages")
    df, n = frequencies(stored, len(items.vocabulary))
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    passages = stored.filter("df IS NULL").select("doc_id", "words")
    basis = latent_basis(passages, idf)
    blocks = _blocks(pd.DataFrame({"words": items.words}), len(idf))
    latent = np.concatenate([_dense(rows, idf) @ basis for _, rows in blocks])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast((items, idf, basis, latent))  # ITEMS items at most

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, idf, basis, latent = shared.value
        lengths, least = np.array([len(w) for w in items.words]), items.least()
        flat, starts = np.concatenate(items.words), np.append(0, np.cumsum(lengths)[:-1])
        mine = np.zeros(len(idf) + 1, bool)
        holds = np.zeros(len(idf) + 1, bool)  # the last: words of no item
        for batch in batches:
            out = []
            for begin, rows in _blocks(batch, len(idf)):
                own = _dense(rows, idf) @ basis
                own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
                near = own @ latent.T >= NEAR
                for i in range(len(rows)):
                    holds[rows[i]] = True
                    # too few of an item's words at all, in whatever order, and it cannot be there
                    enough = np.add.reduceat(holds[flat], starts, dtype=np.int64) >= least
                    for j in np.flatnonzero(enough).tolist():
                        if not near[i, j] and not dense_enough(items.words[j], rows[i], mine):
                            continue
                        hit, cover = is_leak(items.words[j], rows[i])
                        if hit:
                            out.append((batch["doc_id"].iloc[begin + i], items.ids[j], cover))
                    holds[rows[i]] = False
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "cover"])

    spread = passages.repartition(partitions(docs.sparkSession))
    return spread.mapInPandas(judge, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no item; a row is named by its id, null or not, and its text, so it alone decides about itself."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.col("text").cast("string")))
    rows = docs.withColumn("_row", key)
    held = find_leaks(rows.select(F.col("_row").alias("doc_id"), "text"), benchmark)
    held = materialize(held.select(F.col("doc_id").alias("_row")).distinct(), "leaks")
    return rows.join(held, "_row", "left_anti").select(*docs.columns)
