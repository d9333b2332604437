"""Exact removal of repeated byte strings, by columns of a multi-document suffix order.

A byte goes if some ``length``-byte string that covers it also starts
elsewhere, in the same text or another. Each such string has one anchor, its
leftmost k-gram of least hash, which depends on its bytes alone; strings that
are equal have equal anchors at equal offsets. Neighbouring strings with one anchor
form a piece, and pieces with equal anchors, set out by their anchor, are the
collection that is built up column by column: each round inserts one symbol of
every piece, from the last column to the first, reorders the pieces by it
(the order of the collection's Burrows-Wheeler transform at that column) and
updates the common prefixes of neighbours. Where two neighbours share
``length`` symbols, the strings that begin in this column are equal. Rounds
are numpy steps over many anchors at once; pieces come in sequentially from a
shuffle sorted by anchor, and what a task holds is bounded by ``ROWS`` pieces.

Only anchors that occur twice have pieces, equal pieces are one with a weight under a
128-bit hash, and texts that are equal are one text. Where pieces occur is looked up last, when it is known which of
their strings are repeated. An anchor with over ``HOT`` different pieces would be too large for one task: its pieces are
cut in two by how far a string starts before the anchor, and each half goes under what all its strings
have in common around it. Equal strings stay together, and parts go through the same rounds. Parts still
too large are cut again; at the eighth cut a part is one string.

Null texts count as empty; shorter texts than ``length`` lose nothing; matches
never cross texts. Repeated rows are copies and so go whole if long enough.
Texts of any length are read in overlapping stretches. An empty table gives no
rows. Only ``doc_id`` and ``text`` are read. Texts are told apart by length and a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from oddlines.llm.common import bound_batches, partitions
from oddlines.llm.words import span_hashes
from oddlines.storage import materialize, new_path

LENGTH = 200
GRAM = 24
STRETCH = 1 << 20  # bytes looked at together
HOT = 5000
ROWS = 12_000
NOTES = 1 << 18  # occurrences that a task gathers before it hands them on
_TEXT = "t long, n int"


def _store(df: DataFrame, label: str) -> DataFrame:
    """A work table packed tighter than others: pieces hold several times the bytes they stand for."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first start, last start, anchor place, anchor hash) of the pieces, as arrays for some texts at a time."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= STRETCH):
            size += len(texts[end])
            end += 1
        part = texts[begin:end]
        step = STRETCH if len(part) == 1 else size + 1
        joined = part[0] if len(part) == 1 else b"".join(part)
        sizes = np.array([len(t) for t in part])
        edges = np.append(0, np.cumsum(sizes))
        for low in range(0, max(1, len(joined) - length + 1), step):
            buf = np.frombuffer(joined, np.uint8)[low : low + step + length - 1]
            if len(buf) < length:
                continue
            starts = np.arange(len(buf) - gram + 1)
            hashes = span_hashes(buf, starts, starts + gram)
            keys = (hashes >> np.uint64(24) << np.uint64(24)) | starts.astype(np.uint64)
            anchor = (_least(keys, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
            at = np.arange(len(anchor))
            owner = np.searchsorted(edges, at + low, side="right") - 1
            inside = at + low + length <= edges[owner + 1]
            at, anchor, owner = at[inside], anchor[inside], owner[inside]
            if not len(at):
                continue
            new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
            last = np.append(new[1:], len(at)) - 1
            o = owner[new]
            base = low - edges[o]
            yield o + begin, at[new] + base, at[last] + base, anchor[new] + base, hashes[anchor[new]].view(np.int64)
        begin = end


def _raw(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def anchors(texts: DataFrame) -> DataFrame:
    """(t, n, key, c): the anchors of each text and how often they occur."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t, n = batch["t"].to_numpy(), batch["n"].to_numpy()
            for owner, _, _, _, key in pieces(_raw(batch["text"])):
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | np.concatenate([[True], key[1:] != key[:-1]]))
                count = np.diff(np.append(new, len(key)))
                yield pd.DataFrame({"t": t[owner[new]], "n": n[owner[new]], "key": key[new], "c": count})

    return texts.mapInPandas(run, f"{_TEXT}, key long, c long")


def _digest(offset: int, content: bytes) -> tuple[int, int]:
    raw = hashlib.blake2b(offset.to_bytes(2, "little") + content, digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def cut_pieces(texts: DataFrame, where: bool) -> DataFrame:
    """Pieces with the wanted anchors (``keys``) under key and digest.

    With ``where`` (t, n, s) of their occurrences, else what they hold: ``offset``, how far the
    first string starts before the anchor, ``content``, the bytes of all strings, and
    ``weight``, how often they occur; equal ones of up to ``NOTES`` neighbours are one row.
    """
    schema = "key long, one long, two long, " + (f"{_TEXT}, s int" if where else "offset int, content binary, weight long")

    def told(found: dict[tuple, list]) -> Iterator[pd.DataFrame]:
        rows = [(*name, *held) for name, held in found.items()]
        for begin in range(0, len(rows), 4000):
            yield pd.DataFrame(rows[begin : begin + 4000], columns=["key", "one", "two", "offset", "content", "weight"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = _raw(batch["text"])
            wanted = [np.sort(np.asarray(k, np.int64)) for k in batch["keys"]]
            ids = list(zip(batch["t"].tolist(), batch["n"].tolist()))
            copies = batch["copies"].tolist()
            found: dict[tuple, list] = {}
            places: list[tuple] = []
            for owner, first, last, place, key in pieces(raw):
                for i in np.unique(owner):
                    rows = np.flatnonzero(owner == i)
                    pick = rows[_among(key[rows], wanted[i])]
                    for f, l, p, k in zip(first[pick].tolist(), last[pick].tolist(), place[pick].tolist(), key[pick].tolist()):
                        content = raw[i][f : l + LENGTH]
                        name = (k, *_digest(p - f, content))
                        if where:
                            places.append((*name, *ids[i], f))
                        elif name in found:
                            found[name][2] += copies[i]
                        else:
                            found[name] = [p - f, content, copies[i]]
                if len(places) >= NOTES:
                    yield pd.DataFrame(places, columns=["key", "one", "two", "t", "n", "s"])
                    places = []
                if len(found) >= NOTES // 16:
                    yield from told(found)
                    found = {}
            if places:
                yield pd.DataFrame(places, columns=["key", "one", "two", "t", "n", "s"])
            yield from told(found)

    return texts.mapInPandas(run, schema)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def repeated(groups: np.ndarray, offsets: np.ndarray, contents: list[bytes], weights: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray]]:
    """(piece, its starts whose string is repeated) for pieces sorted by group.

    Column by column from the right: ``order`` sorts the pieces of each group by
    what follows the column, ``common[i]`` is the length that the pieces at i - 1 and
    i share from there.
    """
    n, middle = len(contents), length - gram
    sizes = np.fromiter(map(len, contents), np.int64, n)
    matrix = np.zeros((n, middle + length), np.uint16)  # 0: outside the piece
    flat = np.frombuffer(b"".join(contents), np.uint8).astype(np.uint16) + np.uint16(1)
    row = np.repeat(np.arange(n), sizes)
    column = np.arange(len(flat)) - np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.repeat(middle - offsets, sizes)
    matrix[row, column] = flat
    columns = np.ascontiguousarray(matrix.T)
    first, last = middle - offsets, middle - offsets + sizes - length  # columns in which strings start
    rank = np.cumsum(np.diff(groups, prepend=groups[:1]) != 0)
    hit = np.zeros((middle + 1, n), bool)
    order = np.arange(n)
    common = np.where(np.diff(rank, prepend=-1) == 0, 1 << 20, 0)  # before any column all of a group are alike
    for j in range(middle + length - 1, -1, -1):
        symbol = columns[j][order]
        name = rank[order] * 512 + symbol
        if np.all(name[1:] >= name[:-1]):
            same = np.concatenate([[False], name[1:] == name[:-1]])
            common = np.where(same, np.minimum(common + 1, 1 << 20), 0)
        else:
            moved = np.argsort(name, kind="stable")
            name = name[moved]
            same = np.flatnonzero(name[1:] == name[:-1]) + 1
            # between two pieces that now stand together lay pieces with other symbols
            bounds = np.stack([moved[same - 1] + 1, moved[same] + 1], axis=1).ravel()
            shared = np.minimum.reduceat(np.append(common, 1 << 20), bounds)[::2] if len(same) else common[:0]
            common = np.zeros(n, np.int64)
            common[same] = np.minimum(shared + 1, 1 << 20)
            order = order[moved]
        if j <= middle:
            # pieces that never differed have no bound yet but the columns read so far
            long = np.minimum(common, middle + length - j) >= length
            near = long.copy()
            near[:-1] |= long[1:]
            hit[j, order] = near
    for i in range(n):
        starts = np.arange(first[i], last[i] + 1)
        yield i, starts[hit[starts, i] | (weights[i] > 1)] - first[i]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of neighbouring numbers."""
    if len(values):
        cuts = np.flatnonzero(np.diff(values) != 1)
        yield from zip(values[np.append(0, cuts + 1)].tolist(), values[np.append(cuts, len(values) - 1)].tolist())


def repeats_of(distinct: DataFrame) -> DataFrame:
    """(key, one, two, low, high): which starts of each piece are repeated, ``high`` included; each piece is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            kept.append(batch)
            held += len(batch)
            if held >= ROWS:
                rows = pd.concat(kept, ignore_index=True)
                final = rows["key"].iloc[-1]
                done, rest = rows[rows["key"] != final], rows[rows["key"] == final]
                yield from judge(done)
                kept, held = [rest], len(rest)  # an anchor's pieces are at most HOT
        if kept:
            yield from judge(pd.concat(kept, ignore_index=True))

    def judge(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        keys, weights = rows["key"].to_numpy(), rows["weight"].to_numpy()
        contents = [bytes(c) for c in rows["content"]]
        alone = np.concatenate([[True], keys[1:] != keys[:-1]]) & np.concatenate([keys[1:] != keys[:-1], [True]])
        out: list[tuple] = []

        def note(i: int, starts: np.ndarray) -> None:
            out.extend((keys[i], rows["one"].iat[i], rows["two"].iat[i], low, high) for low, high in _runs(starts))

        for i in np.flatnonzero(alone & (weights > 1)).tolist():  # the only piece of its anchor, but more than once
            note(i, np.arange(len(contents[i]) - LENGTH + 1))
        several = np.flatnonzero(~alone)
        if len(several):
            offsets, some = rows["offset"].to_numpy()[several], [contents[i] for i in several.tolist()]
            for i, starts in repeated(keys[several], offsets, some, weights[several]):
                note(int(several[i]), starts)
        if out:
            yield pd.DataFrame(out, columns=["key", "one", "two", "low", "high"])

    columns = distinct.select("key", "one", "two", "offset", "content", "weight")
    in_order = columns.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return in_order.mapInPandas(run, "key long, one long, two long, low int, high int")


_PART = "key long, one long, two long, of long, of_one long, of_two long, near int, far int, shift int, offset int, content binary, weight long"


def halves(parts: DataFrame) -> DataFrame:
    """Each part of a piece (starts ``near`` to ``far`` bytes before the anchor) cut in two, under new keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                content, last = bytes(r.content), len(r.content) - LENGTH
                middle = (r.near + r.far) // 2
                for near, far in ((r.near, middle), (middle + 1, r.far)):
                    low, high = max(0, r.offset - far), min(last, r.offset - near)
                    if low > high:
                        continue
                    # what every string of this half holds, whichever it is
                    common = content[r.offset - near : r.offset - far + LENGTH]
                    name = hashlib.blake2b(b"%d %d " % (r.key, near) + common, digest_size=8).digest()
                    part, offset = content[low : high + LENGTH], r.offset - low
                    key = int.from_bytes(name, "little", signed=True)
                    out.append((key, *_digest(offset, part), r.of, r.of_one, r.of_two, near, far, r.shift + low, offset, part, r.weight))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PART.split(", ")])

    return parts.mapInPandas(run, _PART)


def _whole(pieces: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of the pieces whose key is not hot, and those whose key is."""
    return pieces.join(hot, "key", "left_anti"), pieces.join(hot, "key", "left_semi")


def repeated_starts(distinct: DataFrame) -> DataFrame:
    """(key, one, two, low, high) of all pieces, those of hot anchors in parts."""
    name = ["key", "one", "two"]
    hot = materialize(distinct.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "hot")
    if hot.isEmpty():
        return repeats_of(distinct)
    cold, rest = _whole(distinct, hot)
    found = [repeats_of(cold)]
    of = [F.col(c).alias(a) for c, a in zip(name, ("of", "of_one", "of_two"))]
    parts = rest.select(*name, *of, F.lit(0).alias("near"), F.lit(LENGTH - GRAM).alias("far"), F.lit(0).alias("shift"), "offset", "content", "weight")
    while not hot.isEmpty():
        parts = _store(halves(parts), "parts")
        merged = parts.groupBy(*name).agg(
            F.first("offset").alias("offset"), F.first("content").alias("content"), F.sum("weight").alias("weight")
        )
        # at the end a part is one string, and equal strings are one row
        hot = materialize(merged.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "hot")
        done, rest = _whole(merged, hot)
        told = parts.join(repeats_of(done), name).select(
            F.col("of").alias("key"), F.col("of_one").alias("one"), F.col("of_two").alias("two"),
            (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high"),
        )
        found.append(materialize(told, "told"))
        parts = parts.join(hot, "key", "left_semi").select(*[c.split()[0] for c in _PART.split(", ")])
    return reduce(DataFrame.union, found)


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with ``kept`` if asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", text.alias("text")).withColumns(
        {"t": F.xxhash64("text"), "n": F.octet_length("text").cast("int")}
    )
    texts = docs.filter(F.col("n") >= LENGTH)
    groups = materialize(texts.groupBy("t", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "texts")
    found = _store(anchors(texts.select("t", "n", "text")), "anchors")
    twice = found.groupBy("key").agg(F.sum("c").alias("all")).filter("all > 1").select("key")
    wanted = found.select("t", "n", "key").distinct().join(twice, "key").groupBy("t", "n").agg(F.collect_list("key").alias("keys"))
    wanted = materialize(wanted.join(groups, ["t", "n"]), "wanted")
    one = texts.join(wanted, ["t", "n"]).filter(F.col("doc_id").eqNullSafe(F.col("rep")))
    one = one.select("t", "n", "text", "keys", "copies")
    name = ["key", "one", "two"]
    distinct = _store(cut_pieces(one, False).groupBy(*name).agg(
        F.first("offset").alias("offset"), F.first("content").alias("content"), F.sum("weight").alias("weight")
    ), "pieces")
    starts = repeated_starts(distinct).groupBy(*name).agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    places = cut_pieces(one, True).join(materialize(starts, "starts"), name).select("t", "n", "s", F.explode("runs").alias("r"))
    spans = places.select("t", "n", (F.col("s") + F.col("r.low")).alias("low"), (F.col("s") + F.col("r.high")).alias("high"))
    spans = spans.groupBy("t", "n").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = materialize(spans, "spans")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, spans_ in zip(batch["doc_id"], batch["text"], batch["spans"]):
                raw = (text or "").encode()
                kept, at, removed, n_spans = [], 0, 0, 0
                if spans_ is not None:
                    for low, high in sorted((s["low"], s["high"] + LENGTH) for s in spans_):
                        if low > at or not n_spans and low == at:
                            kept.append(raw[at:low])
                            n_spans += 1
                            removed += high - low
                            at = high
                        elif high > at:
                            removed += high - at
                            at = high
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, len(raw), removed, n_spans, hashlib.sha256(left).hexdigest(), *([left] if keep_bytes else [])))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else [])]
            yield pd.DataFrame(out, columns=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = docs.join(spans, ["t", "n"], "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(keep, schema + (", kept binary" if keep_bytes else ""))
