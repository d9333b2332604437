"""Byte-level BPE by speculation: longest matches are proposed and pairs of neighbours verified.

A split of a word into tokens is the one that merging gives if and only if
each token, and each two neighbours, re-encode to themselves. So each new
word of a batch gets the tokens of greedy longest match, all neighbouring
pairs of the batch are tested as one array against the pairs known so far (a
new pair is merged exactly once), and only words with a failing pair are
merged exactly. Vocabulary and merges come from a tokenizer file whose path is
a parameter; the file must be readable on every executor.

Null texts count as empty. Texts are never cut; a text of over a million
characters is taken in slices of words. Rows are independent, so repeated
rows and ties give repeated results, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from oddlines.llm.common import bound_batches
from oddlines.llm.words import give_back

# Fixed value: how byte-level BPE splits text into words before merging.
WORD = regex.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
LONG_TEXT, SLICE = 1 << 21, 1 << 16
CACHE, PAIRS = 96 << 20, 800_000  # bytes of words with their ids, and pairs, that a task remembers
NONE = np.iinfo(np.int32).max
WIDE = 48  # longer words are merged one by one
ALONE = 0xFFFF  # in a pair: no right neighbour


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.ids = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for order, merge in enumerate(spec["model"]["merges"]):
            left, right = (bytes(byte_of[c] for c in t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[self.ids[left], self.ids[right]] = (order, self.ids[left + right])
        keys = np.array([a << 16 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        # a last key that no pair has, so that every search ends on an entry
        self.pair_keys = np.append(keys[order], np.int64(1) << 40)
        self.pair_rank = np.append(np.array([r for r, _ in self.rank.values()], np.int32)[order], NONE)
        self.pair_made = np.append(np.array([m for _, m in self.rank.values()], np.int32)[order], NONE)
        self.single = [self.ids[bytes([b])] for b in range(256)]
        child: dict[int, int] = {}  # trie of the vocabulary: node and byte to node
        ends = [-1]
        for token, i in self.ids.items():
            node = 0
            for b in token:
                node = child.setdefault(node << 8 | b, len(child) + 1)
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        edges = np.array(sorted(child.items()), np.int64)
        self.edge_keys = np.append(edges[:, 0], np.int64(1) << 40)
        self.edge_to = np.append(edges[:, 1], 0)
        self.ends = np.array(ends, np.int64)
        self.known: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cached = 0  # bytes
        specials = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of equals."""
        parts = [self.single[b] for b in word]
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (found := rank.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j] = rank[left, right][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := rank.get((parts[i], parts[k])):
                    heapq.heappush(heap, (found[0], i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (found := rank.get((parts[h], parts[i]))):
                heapq.heappush(heap, (found[0], h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; ``NONE`` where there is no merge or a side is empty (-1)."""
        keys = left.astype(np.int64) << 16 | right
        at = np.searchsorted(self.pair_keys, keys)
        hit = (self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == keys) & (left >= 0) & (right >= 0)
        at = np.where(hit, at, len(self.pair_keys) - 1)
        return self.pair_rank[at], self.pair_made[at]

    def _merged_block(self, words: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        tokens = np.array(self.single, np.int32)[raw]
        tokens[np.arange(width) >= np.fromiter(map(len, words), np.int64, len(words))[:, None]] = -1
        tokens = np.pad(tokens, ((0, 0), (0, 1)), constant_values=-1)
        rank, made = self._found(tokens[:, :-1], tokens[:, 1:])
        out: list[list[int]] = [[]] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            best = rank.argmin(axis=1)
            go = rank[np.arange(len(rows)), best] != NONE
            for row, ids in zip(rows[~go].tolist(), tokens[~go].tolist()):
                out[row] = ids[: ids.index(-1)]
            rows, best, tokens, rank, made = rows[go], best[go], tokens[go], rank[go], made[go]
            if not len(rows):
                break
            line = np.arange(len(rows))
            tokens[line, best] = made[line, best]
            # all that stands behind the merged pair moves one place to the left
            behind = np.arange(tokens.shape[1] - 1) > best[:, None]
            tokens = np.pad(np.where(behind, tokens[:, 1:], tokens[:, :-1]), ((0, 0), (0, 1)), constant_values=-1)
            rank = np.where(behind, np.pad(rank[:, 1:], ((0, 0), (0, 1)), constant_values=NONE), rank)
            made = np.where(behind, np.pad(made[:, 1:], ((0, 0), (0, 1)), constant_values=NONE), made)
            rank[line, best], made[line, best] = self._found(tokens[line, best], tokens[line, best + 1])
            left = np.maximum(best - 1, 0)
            r, m = self._found(tokens[line, left], tokens[line, left + 1])
            rank[line, left], made[line, left] = r, m
        return out

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words, one merge of every word at a time."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for begin in range(0, len(order), 8192):
            block = order[begin : begin + 8192]
            width = len(words[block[-1]])
            if width > WIDE:
                for i in block:
                    out[i] = self.merged(words[i])
            elif width:
                for i, ids in zip(block, self._merged_block([words[i] for i in block], width)):
                    out[i] = ids
        return out

    def greedy(self, word: bytes) -> list[int]:
        ids, at, out = self.ids, 0, []
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                if (found := ids.get(word[at:end])) is not None:
                    out.append(found)
                    at = end
                    break
        return out

    def greedy_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words as one array, and where the tokens of each word begin."""
        buf = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        ends = np.cumsum([len(w) for w in words])
        at = ends - np.fromiter(map(len, words), np.int64, len(words))
        live = np.arange(len(words))
        long = [i for i, w in enumerate(words) if len(w) > 4 * WIDE]
        found = [(i, self.greedy(words[i])) for i in long]
        owners = [np.array([i for i, t in found for _ in t], np.int64)]
        tokens = [np.array([x for _, t in found for x in t], np.int64)]
        live = np.delete(live, long)
        at, ends = at[live], ends[live]
        node, best, best_end = np.zeros(len(live), np.int64), np.full(len(live), -1), at.copy()
        while len(live):
            keys = node << 8 | buf[at]
            edge = np.searchsorted(self.edge_keys, keys)
            hit = (self.edge_keys[edge] == keys) & (at < ends)
            node = np.where(hit, self.edge_to[edge], 0)
            at = at + hit
            token = np.where(hit, self.ends[node], -1)
            best, best_end = np.where(token >= 0, token, best), np.where(token >= 0, at, best_end)
            miss = ~hit
            owners.append(live[miss])
            tokens.append(best[miss])
            at = np.where(miss, best_end, at)
            going = hit | (at < ends)
            live, at, ends, node, best, best_end = (x[going] for x in (live, at, ends, node, best, best_end))
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        return token[np.argsort(owner, kind="stable")], np.append(0, np.cumsum(np.bincount(owner, minlength=len(words))))

    def fit(self, keys: np.ndarray) -> np.ndarray:
        """Whether two neighbours (or, with ``ALONE`` at the right, one token) re-encode to themselves."""
        names = keys.tolist()
        new = [k for k in names if k not in self.known]
        pairs = [[k >> 16] if k & ALONE == ALONE else [k >> 16, k & ALONE] for k in new]
        again = self.merged_all([b"".join(self.bytes[i] for i in pair) for pair in pairs])
        self.known.update((k, ids == pair) for k, ids, pair in zip(new, again, pairs))
        return np.fromiter(map(self.known.__getitem__, names), bool, len(names))

    def learn(self, words: set[str]) -> None:
        """Have the tokens of all these words in the cache, which is emptied first if it is full."""
        if self.cached > CACHE:
            self.cache.clear()
            self.cached = 0
        if len(self.known) > PAIRS:
            self.known.clear()
        names = list(words.difference(self.cache))
        if not names:
            return
        raw = [w.encode() for w in names]
        flat, bounds = self.greedy_all(raw)
        right = np.append(flat[1:], ALONE)
        right[bounds[1:] - 1] = ALONE  # the last token of a word has no neighbour
        keys, at = np.unique(np.concatenate([flat << 16 | right, flat << 16 | ALONE]), return_inverse=True)
        good = self.fit(keys)[at]
        good = np.logical_and.reduceat(good[: len(flat)] & good[len(flat) :], bounds[:-1]).tolist()
        exact = iter(self.merged_all([w for w, fine in zip(raw, good) if not fine]))
        ids, cuts = flat.astype("<u4").tobytes(), (4 * bounds).tolist()
        for name, fine, begin, end in zip(names, good, cuts[:-1], cuts[1:]):
            self.cache[name] = ids[begin:end] if fine else array("I", next(exact)).tobytes()
            self.cached += 200 + 4 * len(name)  # with what an entry takes besides

    def forget(self) -> None:
        """Empty the caches: a worker that waits for tasks of other stages holds its memory beside theirs."""
        self.cache.clear()
        self.known.clear()
        self.cached = 0

    def parts(self, text: str) -> Iterator[tuple[list[str], bytes]]:
        """The text in order, as slices of words and the id of the special token behind each (or nothing)."""
        at = 0
        found = self.split.finditer(text) if self.split else ()
        cuts = [(m.start(), m.end(), self.special[m.group()].to_bytes(4, "little")) for m in found]
        for start, end, special in [*cuts, (len(text), len(text), b"")]:
            plain = text[at:start]
            if len(plain) < LONG_TEXT:
                yield WORD.findall(plain), special
            else:
                found = (m.group() for m in WORD.finditer(plain))
                while words := list(islice(found, SLICE)):
                    yield words, b""
                yield [], special
            at = end

    def encode(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """For each text its ids as little-endian 32-bit integers, in slices; words are learnt a batch at a time."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) < LONG_TEXT):
                size += len(texts[end])
                end += 1
            if end == begin + 1:
                yield self._alone(texts[begin])
            else:
                split = [list(self.parts(t)) for t in texts[begin:end]]
                self.learn({w for parts in split for words, _ in parts for w in words})
                for parts in split:
                    yield (b"".join(map(self.cache.__getitem__, words)) + special for words, special in parts)
            begin = end

    def _alone(self, text: str) -> Iterator[bytes]:
        for words, special in self.parts(text):
            self.learn(set(words))
            yield b"".join(map(self.cache.__getitem__, words)) + special

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = True, keep_decoded: bool = False) -> DataFrame:
    """Add ``n_tokens``, the SHA-256 of ids and of decoded text and, if asked for, ``ids`` and ``decoded``.

    Columns of these names in ``docs`` are replaced. Rows go out in parts of about ``LONG_TEXT`` characters.
    """
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    made |= {"ids": "array<int>"} if keep_ids else {}
    made |= {"decoded": "string"} if keep_decoded else {}
    kept = [c for c in docs.columns if c not in made]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    schema += "".join(f", {name} {kind}" for name, kind in made.items())

    def encoded(bpe: Bpe, texts: list[str]) -> list[pa.Array]:
        counts, hashes, text_hashes, ids, plains = [], [], [], [], []
        for parts in bpe.encode(texts):
            n, ids_hash, text_hash, plain = 0, hashlib.sha256(), hashlib.sha256(), []
            for part in parts:
                n += len(part) // 4
                ids_hash.update(part)
                decoded = bpe.decode(part)
                text_hash.update(decoded)
                if keep_ids:
                    ids.append(part)
                if keep_decoded:
                    plain.append(decoded)
            counts.append(n)
            hashes.append(ids_hash.hexdigest())
            text_hashes.append(text_hash.hexdigest())
            plains.append(b"".join(plain).decode("utf-8", "replace"))
        columns = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(text_hashes, pa.string())]
        if keep_ids:
            ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))))
        if keep_decoded:
            columns.append(pa.array(plains, pa.string()))
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            source = batch.schema.names.index(text)
            places = [i for i, name in enumerate(batch.schema.names) if name in kept]
            ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(source)), 0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + LONG_TEXT, "right")))
                part = batch.slice(begin, end - begin)
                begin = end
                new = encoded(bpe, [value or "" for value in part.column(source).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *new], [*kept, *made])
            give_back()
        bpe.forget()
        give_back()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    return encode_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), path, keep_ids=False).drop("text")
