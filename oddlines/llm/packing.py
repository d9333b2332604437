"""Fixed windows of tokens, each filled with texts that are lexically near its first one.

1. Texts become token ids. A text of a window or more fills whole windows by
   itself; what is left of it, always less than a window, goes on. Each task also
   counts in how many texts every token occurs: a table with at most as many rows as the vocabulary.
2. What is left is laid out by its two tokens of most weight and cut into ranges,
   so that like texts come into the same range, and a token that a third of all
   texts share is only a run that the next token, and then the row, cuts further.
3. A task goes through its range in shards of ``SHARD`` texts, with a BM25
   index of each: postings by token, weights by the counts over all texts. The first
   unused text is a seed; the index returns its unused neighbours, best first, and they
   fill the seed's window. The text that overflows it is cut there, and its rest is
   the next seed. A window that a shard leaves open goes on with the next shard.

A task's last window is cut into sequences whose lengths are powers of two, which need
no padding; all others are full. Null and empty texts are one end token. Texts are
never shortened; repeated rows, rows of one id and null ids are packed row by row, ties go by row.
An empty table gives no rows. Columns other than those named are not read. The
tokenizer's file must be readable on every executor.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from oddlines.llm.common import bound_batches, partitions
from oddlines.storage import materialize

SHARD = 2048  # texts in one index
NEIGHBOURS = 32  # taken from the index at a time
USED = 0.75  # an index is rid of used texts when only this part of its texts is left
K1, B = 1.2, 0.75  # the usual constants of BM25
CACHE = 48 << 20  # bytes of pieces with their ids that a task remembers
PORTION, AT_ONCE = 1 << 20, 1 << 18  # bytes of text that are taken, and tokens that are counted, at a time
_SPACES = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
# How the word tokenizer takes words apart, for signs that lower case is all there is to normalise of (ASCII
# and composed Latin letters). Classes of bytes: 0 space, 1 letter, 2 digit, 3 other; _ODD: first bytes of other signs.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[32], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 0, 1, 1, 2
_ODD = np.zeros(256, bool)
_ODD[[*range(0xC0, 0xC3), *range(0xC6, 0x100)]] = True
_ODD_PAIRS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")  # the multiplication and division signs, capital I with dot
_SHORT = re.compile(rb"'(?:[stmd]|re|ve|ll)")
_WORD_END = "</w>"
_WIDE = 16  # bytes of a piece that make its key
_KEPT = [np.array([(1 << 8 * min(max(n - k, 0), 8)) - 1 for n in range(_WIDE + 1)], np.uint64) for k in (0, 8)]
_BLANK = [~kept & np.uint64(0x2020202020202020) for kept in _KEPT]


def starts_of(text: bytes, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of a text of plain signs in lower case begin and end: runs of letters or others, digits, 's and such."""
    kind = _CLASS[buf]
    begins = np.empty(len(kind) + 1, bool)
    begins[:1], begins[-1] = True, True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:-1])
    begins[:-1] |= kind == 2
    for found in _SHORT.finditer(text):
        at, end = found.span()
        if not at or kind[at - 1] != 3:  # else it is the end of a run of other signs
            begins[at + 1], begins[end] = False, True
    edges = np.flatnonzero(begins)
    piece = kind[edges[:-1]] != 0
    return edges[:-1][piece], edges[1:][piece]


class Pieces:
    """Numbers of pieces by their bytes: up to ``_WIDE`` bytes by an open table of whole keys, longer ones by name."""

    def __init__(self, bits: int = 17):
        self.names: dict[bytes, int] = {}
        self.count = self.bytes = 0
        self.keys = [np.zeros(1 << bits - 1, np.uint64) for _ in _KEPT]
        self.slots = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: list[np.ndarray]) -> np.ndarray:
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The number of each key, -1 if it has none."""
        slot = self._slot(keys)
        out = self.slots[slot]
        left = np.flatnonzero((out >= 0) & ((self.keys[0][out] != keys[0]) | (self.keys[1][out] != keys[1])))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.slots) - 1)
            found = out[left] = self.slots[slot]
            more = (found >= 0) & ((self.keys[0][found] != keys[0][left]) | (self.keys[1][found] != keys[1][left]))
            left, slot = left[more], slot[more]
        return out

    def _place(self, numbers: np.ndarray) -> None:
        slot = self._slot([own[numbers] for own in self.keys])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & (len(self.slots) - 1)

    def add(self, keys: list[np.ndarray], names: list[bytes]) -> None:
        """Number new and different keys, then new names, in order."""
        first, self.count = self.count, self.count + len(keys[0])
        keyed = np.arange(first, self.count, dtype=np.int32)
        self.names.update(zip(names, range(self.count, self.count + len(names))))
        self.count += len(names)
        self.bytes += 48 * (self.count - first) + 112 * len(names) + sum(map(len, names))
        full = self.count > len(self.keys[0])
        while self.count > len(self.keys[0]):
            self.keys = [np.append(own, np.zeros(len(own), np.uint64)) for own in self.keys]
        for own, new in zip(self.keys, keys):
            own[keyed] = new
        if full:
            old = self.slots[self.slots >= 0]
            self.slots = np.full(2 * len(self.keys[0]), -1, np.int32)
            self._place(old)
        self._place(keyed)


class WordIds:
    """Ids of texts by the tokenizers library, which is asked once for each piece (a run of letters or signs, a digit).

    Words with other signs than plain ones, or with a special token, are not taken apart here.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tokenizer in (self.tokenizer, self.merger):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        # pieces come in lower case and taken apart, so that only merging is left to do
        self.merger.normalizer = None
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), letters])
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.mark, self.mark_id = self.special[0], self.tokenizer.token_to_id(self.special[0])
        self.rare = [*_ODD_PAIRS, *map(str.encode, self.special)]
        self.ends = np.zeros(self.size, bool)  # tokens that end a word
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(_WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = Pieces()
        self.bounds = np.zeros(1 << 17, np.int64)  # where the ids of each piece begin, and the last ones end
        self.store = np.zeros(1 << 19, self.kind)

    def _ids(self, text: str, tokenizer) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, keys: list[np.ndarray], ids: np.ndarray, ends: np.ndarray, names: list[bytes]) -> None:
        """Note the ids of new keys, then new names."""
        n, total = self.known.count, int(self.bounds[self.known.count])
        self.known.add(keys, names)
        while self.known.count >= len(self.bounds):
            self.bounds = np.append(self.bounds, np.zeros(len(self.bounds), np.int64))
        while total + len(ids) > len(self.store):
            self.store = np.append(self.store, np.zeros(len(self.store), self.kind))
        self.store[total : total + len(ids)] = ids
        self.bounds[n + 1 : self.known.count + 1] = total + ends

    def _merge(self, keys: list[np.ndarray], keyed: list[bytes], names: list[bytes]) -> None:
        """Ask for new pieces: those of ``keys`` (their bytes are ``keyed``), then longer ones."""
        if keyed or names:  # each is one word to the library, and its last token says so
            ids = self._ids(b" ".join(keyed + names).decode(), self.merger)
            self._learn(keys, ids, np.flatnonzero(self.ends[ids]) + 1, names)

    def _odd(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words with signs or tokens that are not plain."""
        new = list(dict.fromkeys(w for w in words if w not in self.known.names))
        alone = [w for w in new if any(s.encode() in w for s in self.special)]
        found = [self._ids(w.decode(), self.tokenizer) for w in alone]
        apart = list(set(new).difference(alone))
        if apart:  # the library tells what stands on either side of a special token apart
            ids = self._ids(self.mark.join(map(bytes.decode, apart)), self.tokenizer)
            found += np.split(ids[ids != self.mark_id], np.flatnonzero(ids == self.mark_id) - np.arange(len(apart) - 1))
        if found:
            none = [np.zeros(0, np.uint64)] * len(_KEPT)
            self._learn(none, np.concatenate(found), np.cumsum(list(map(len, found))), alone + apart)
        return np.fromiter(map(self.known.names.__getitem__, words), np.int32, len(words))

    def _portion(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of texts that are learnt together; what is known is forgotten first if it is much."""
        if self.known.bytes + self.kind.itemsize * int(self.bounds[self.known.count]) > CACHE:
            self.forget()
        text = b" ".join(texts).translate(_SPACES)
        try:
            text.decode()
        except UnicodeDecodeError:
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
            text = b" ".join(texts).translate(_SPACES)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        text, words, places = self._plain(text)
        buf = np.frombuffer(text + b" " * _WIDE, np.uint8)
        begins, ends = starts_of(text, buf[: len(text)])
        numbers = self._numbers(text, buf, begins, ends)
        numbers[np.searchsorted(begins, places)] = self._odd(words)
        sizes = self.bounds[numbers + 1] - self.bounds[numbers]
        sums = np.append(0, np.cumsum(sizes))
        ids = self.store[np.repeat(self.bounds[numbers] - sums[:-1], sizes) + np.arange(sums[-1])]
        cuts = sums[np.searchsorted(begins, at)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield ids[a:b]

    def _plain(self, text: bytes) -> tuple[bytes, list[bytes], list[int]]:
        """The text in lower case; words that are not plain, and their places, where one sign is left of them."""
        odd = np.flatnonzero(_ODD[np.frombuffer(text, np.uint8)])
        if found := [m.start() for rare in self.rare if rare in text for m in re.finditer(re.escape(rare), text)]:
            odd = np.sort(np.append(odd, found))
        odd = odd.tolist()
        words, places, parts, i, end = [], [], [], 0, 0
        while i < len(odd):
            begin, before = text.rfind(b" ", 0, odd[i]) + 1, end
            end = text.find(b" ", odd[i])
            end = len(text) if end < 0 else end
            words.append(text[begin:end])
            places.append(begin)
            parts += [text[before:begin], b"!".ljust(end - begin)]
            i = bisect_left(odd, end, i)
        text = b"".join([*parts, text[end:]])
        return text.lower() if text.isascii() else text.decode().lower().encode(), words, places

    def _numbers(self, text: bytes, buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every piece, new ones too."""
        lengths = np.minimum(ends - begins, _WIDE)
        eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))  # the eight bytes from each place on
        keys = [eight[begins + 8 * k] & kept[lengths] | blank[lengths] for k, (kept, blank) in enumerate(zip(_KEPT, _BLANK))]
        numbers = self.known.find(keys)
        long = np.flatnonzero(ends - begins > _WIDE)
        names = [text[a:b] for a, b in zip(begins[long].tolist(), ends[long].tolist())]
        new = numbers < 0
        new[long] = False
        new = np.flatnonzero(new)
        new = new[np.lexsort([own[new] for own in keys])]
        differ = np.ones(len(new), bool)
        differ[1:] = (keys[0][new[1:]] != keys[0][new[:-1]]) | (keys[1][new[1:]] != keys[1][new[:-1]])
        first = new[differ]
        keyed = [text[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist())]
        numbers[new] = self.known.count + np.cumsum(differ) - 1
        self._merge([own[first] for own in keys], keyed, list(set(names).difference(self.known.names)))
        numbers[long] = np.fromiter(map(self.known.names.__getitem__, names), np.int32, len(names))
        return numbers

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of every text; short texts are learnt together, a long one by portions of its words."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= PORTION):
                size += len(texts[end])
                end += 1
            if size <= PORTION:
                yield from self._portion(texts[begin:end])
            else:
                yield np.concatenate([ids for part in self._cut(texts[begin]) for ids in self._portion([part])])
            begin = end

    def _cut(self, text: bytes) -> Iterator[bytes]:
        text = text.translate(_SPACES)
        begin = 0
        while begin < len(text):
            end = text.find(b" ", begin + PORTION)
            end = len(text) if end < 0 else end
            yield text[begin:end]
            begin = end


_LOADED: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def counted(lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text its different tokens in order: the text's place, the token, how often it is there."""
    kind, bits = (np.uint32, 16) if len(lengths) <= 1 << 16 and ids.dtype.itemsize == 2 else (np.uint64, 32)
    keys = np.repeat(np.arange(len(lengths), dtype=kind), lengths) << kind(bits) | ids.astype(kind)
    keys.sort()
    first = np.flatnonzero(np.append(np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))
    tf, keys = np.diff(first, append=len(keys)), keys[first]
    return (keys >> kind(bits)).astype(np.int64), (keys & kind((1 << bits) - 1)).astype(np.int64), tf


def heaviest(owner: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The place of every text's largest weight, the first of equals. Each text has a token at least."""
    begins = np.searchsorted(owner, np.arange(texts))
    at = np.flatnonzero(weight == np.maximum.reduceat(weight, begins)[owner])
    return at[np.searchsorted(at, begins)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class _Pieces:
    """Pieces as columns until they are sent on."""

    NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self):
        self.columns: list[list] = [[] for _ in self.NAMES]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def arrays(self, id_type: pa.DataType) -> list[pa.Array]:
        return [pa.array(self.columns[0], id_type)] + [pa.array(c, pa.int64()) for c in self.columns[1:]]


def _schema(id_type: str) -> str:
    return f"doc_id {id_type}, " + ", ".join(f"{name} long" for name in _Pieces.NAMES[1:])


def token_table(docs: DataFrame, path: str, window: int, end: int) -> DataFrame:
    """Full windows (kind 0), what is left of texts (1, with ``ids`` and ``row``) and each task's counts (2)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(path)
        held = np.zeros(max(words.size, end + 1), np.int64)
        texts = tokens = sequences = rows = 0
        task = TaskContext.get().partitionId() << 32
        arrow_id = None

        def count(found: list[np.ndarray]) -> None:
            if found:
                terms = counted(np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found))[1]
                np.add(held, np.bincount(terms, minlength=len(held)), out=held)

        def batch(kind: int, pieces: _Pieces, ids: list[bytes | None], row: list[int | None], counts: list) -> pa.RecordBatch:
            n = len(ids)
            columns = [pa.array([kind] * n, pa.int32()), *pieces.arrays(arrow_id), pa.array(ids, pa.binary())]
            columns += [pa.array(row, pa.int64()), pa.array([c[0] for c in counts] or [None] * n, pa.list_(pa.int32()))]
            columns += [pa.array([c[1] for c in counts] or [None] * n, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["kind", *pieces.NAMES, "ids", "row", "terms", "counts"])

        for source in batches:
            arrow_id = source.column("doc_id").type
            full, rest, ids, numbers, waiting = _Pieces(), _Pieces(), [], [], 0
            raw = [t or b"" for t in source.column("text").to_pylist()]
            fresh, size = [], 0  # not counted yet
            for doc_id, found in zip(source.column("doc_id").to_pylist(), words.of(raw)):
                found = np.append(found, np.array([end], words.kind))
                n, start = len(found), 0
                fresh.append(found)
                size += n
                if size > AT_ONCE:
                    count(fresh)
                    fresh, size = [], 0
                texts, tokens = texts + 1, tokens + n
                while n - start >= window:
                    full.add(doc_id, start, window, crc(found[start : start + window]), n, 2 * (task + sequences) + 1, 0)
                    start, sequences = start + window, sequences + 1
                if start < n:
                    rest.add(doc_id, start, n - start, None, n, None, None)
                    ids.append(found[start:].tobytes())
                    numbers.append(2 * task + rows)
                    rows, waiting = rows + 1, waiting + len(ids[-1])
                if waiting > 4 << 20:
                    yield batch(1, rest, ids, numbers, [])
                    rest, ids, numbers, waiting = _Pieces(), [], [], 0
            count(fresh)
            for kind, pieces, more, row in ((0, full, [None] * len(full.columns[0]), None), (1, rest, ids, numbers)):
                if more:
                    yield batch(kind, pieces, more, row or more, [])
        if texts:
            total = _Pieces()
            total.add(None, None, texts, None, tokens, None, None)
            used = np.flatnonzero(held)
            yield batch(2, total, [None], [None], [(used.astype(np.int32), held[used])])

    schema = f"kind int, {_schema(id_type)}, ids binary, row long, terms array<int>, counts array<long>"
    return docs.mapInArrow(run, schema)


class Bm25:
    """Inverted index of one shard."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        self.texts = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        owner, self.terms, tf = counted(lengths, np.concatenate(texts))  # by text, for queries
        self.begins = np.searchsorted(owner, np.arange(len(texts) + 1))
        order = np.argsort(self.terms.astype(np.uint16) if len(idf) <= 1 << 16 else self.terms, kind="stable")
        owner, tf = owner[order], tf[order]
        weight = idf[self.terms[order]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean))
        self.owner, self.weight = owner, weight
        self.postings = np.searchsorted(self.terms[order], np.arange(len(idf) + 1))

    def query(self, i: int) -> np.ndarray:
        return self.terms[self.begins[i] : self.begins[i + 1]]

    def keep(self, wanted: np.ndarray) -> None:
        """Leave the other texts out of the postings; they score 0 from here on, and no other score changes."""
        live = wanted[self.owner]
        self.postings = np.append(0, np.cumsum(live))[self.postings]
        self.owner, self.weight = self.owner[live], self.weight[live]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        begin, held = self.postings[terms], self.postings[terms + 1] - self.postings[terms]
        at = np.repeat(begin - np.append(0, np.cumsum(held)[:-1]), held) + np.arange(held.sum())
        return np.bincount(self.owner[at], self.weight[at], self.texts)


def neighbours(scores: np.ndarray, unused: np.ndarray) -> Iterator[int]:
    """Unused texts, best first; of equals the first one."""
    left = np.flatnonzero(unused)
    own = scores[left]
    if len(left) > NEIGHBOURS:
        least = np.partition(own, len(own) - NEIGHBOURS)[len(own) - NEIGHBOURS]
        near = left[own > least]
        yield from near[np.argsort(-scores[near], kind="stable")].tolist()
        left, own = left[own <= least], own[own <= least]
    yield from left[np.argsort(-own, kind="stable")].tolist()


class _Packer:
    """Fills the windows of one task."""

    def __init__(self, idf: np.ndarray, mean: float, window: int):
        self.idf, self.mean, self.window = idf, mean, window
        self.first = 2 * (TaskContext.get().partitionId() << 32)
        self.sequences = 0
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the window being filled
        self.room = window
        self.seed: np.ndarray | None = None  # the tokens of its first text

    def close(self, out: _Pieces) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in self.open:
            out.add(doc_id, start, len(ids), crc(ids), doc_tokens, self.first + 2 * self.sequences, offset)
            offset += len(ids)
        self.sequences += 1
        self.open, self.room, self.seed = [], self.window, None

    def shard(self, rows: list[tuple], out: _Pieces) -> None:
        """Pack the texts of one shard; the last window may stay open."""
        index = Bm25([r[2] for r in rows], self.idf, self.mean)
        unused, taken = np.ones(len(rows), bool), np.zeros(len(rows), np.int64)
        following, first, indexed = None, 0, len(rows)

        def take(i: int) -> int | None:
            doc_id, start, ids, doc_tokens = rows[i]
            at = int(taken[i])
            part = ids[at : at + self.room]
            self.open.append((doc_id, start + at, part, doc_tokens))
            self.room -= len(part)
            taken[i] += len(part)
            unused[i] = taken[i] < len(ids)
            return i if unused[i] else None

        while True:
            if self.seed is None:
                while first < len(rows) and not unused[first]:
                    first += 1
                if first == len(rows):
                    return
                seed = first if following is None else following
                self.seed, following = index.query(seed), None
                take(seed)
            if (left := np.count_nonzero(unused)) < USED * indexed:
                index.keep(unused)
                indexed = left
            for i in neighbours(index.scores(self.seed), unused):
                if not self.room:
                    break
                following = take(i)
            if self.room:
                return  # all texts are used
            self.close(out)

    def finish(self, out: _Pieces) -> None:
        """Cut the open window into sequences whose lengths are powers of two."""
        pieces, filled = self.open, self.window - self.room
        while filled:
            size = 1 << (filled.bit_length() - 1)
            filled -= size
            rest, self.open = pieces, []
            pieces = []
            for doc_id, start, ids, doc_tokens in rest:
                part = ids[:size]
                size -= len(part)
                if len(part):
                    self.open.append((doc_id, start, part, doc_tokens))
                if len(part) < len(ids):
                    pieces.append((doc_id, start + len(part), ids[len(part) :], doc_tokens))
            self.close(out)


def pack(docs: DataFrame, path: str, window: int = 4096, end: int = 2, shard: int = SHARD) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = _schema(id_type)
    table = materialize(token_table(docs, path, window, end), "tokens")
    counts = table.filter("kind = 2")
    texts, tokens = counts.agg(F.sum("length"), F.sum("doc_tokens")).first()
    held = counts.select(F.explode(F.arrays_zip("terms", "counts")).alias("c")).groupBy("c.terms").agg(F.sum("c.counts"))
    held = held.collect()  # at most a row a token of the vocabulary
    idf = np.zeros(max((t for t, _ in held), default=0) + 1)
    for term, n in held:
        idf[term] = np.log1p((texts - n + 0.5) / (n + 0.5))
    mean = tokens / texts if texts else 1.0
    kind = loaded(path).kind

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.zeros((2, batch.num_rows), np.int32)
            ids = [np.frombuffer(raw.as_buffer(), kind) for raw in batch.column("ids")]
            if ids:
                owner, terms, tf = counted(np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids))
                weight = idf[terms] * tf / (tf + K1)
                first = heaviest(owner, weight, len(ids))
                best[0] = terms[first]
                weight[first] = -1
                second = heaviest(owner, weight, len(ids))
                best[1] = np.where(second == first, 0, terms[second])
            names = [*batch.schema.names, "one", "two"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best[0]), pa.array(best[1])], names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows, id_type = _Packer(idf, mean, window), [], None

        def sent(out: _Pieces) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(out.arrays(id_type), list(_Pieces.NAMES))

        for batch in batches:
            id_type = batch.column("doc_id").type
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
            for doc_id, start, ids, doc_tokens in zip(*columns):
                rows.append((doc_id, start, np.frombuffer(ids, kind), doc_tokens))
                if len(rows) == shard:
                    out, done, rows = _Pieces(), rows, []
                    packer.shard(done, out)
                    yield sent(out)
        out = _Pieces()
        if rows:
            packer.shard(rows, out)
        packer.finish(out)
        if out.columns[0]:
            yield sent(out)

    rests = table.filter("kind = 1").select("doc_id", "start", "ids", "doc_tokens", "row")
    rests = rests.mapInArrow(weigh, f"doc_id {id_type}, start long, ids binary, doc_tokens long, row long, one int, two int")
    rests = rests.repartitionByRange(partitions(spark), "one", "two", "row").sortWithinPartitions("one", "two", "row")
    return table.filter("kind = 0").select(*_Pieces.NAMES).union(rests.mapInArrow(fill, schema))
