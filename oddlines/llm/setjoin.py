"""Near-duplicate texts by an exact Jaccard join over word shingles.

Equal sets are one set. The others meet through index lists: a set's tokens,
ordered by hash, are cut into blocks at fixed positions, and each block's
content is a key. Two sets that reach the similarity differ in at most d
tokens, so with more than d blocks they agree in at least one of them; whole
blocks that differ are skipped unread. The number of blocks is fixed for a
class of sizes, and a set also enters the class below if it can be the larger
side of a pair there. A set of no more filled blocks than its partners may differ in (a short one) enters its
rarest-by-hash prefix tokens besides, since a pair might agree in empty blocks only. A set that agrees with each
partner in more filled blocks than it has common ones stays out of the lists of common blocks. Which blocks
are common is told from a sample of the texts; it decides about work, never about links.

Lists with the same sets are one list. Inside a list, sets are told apart by
sketches of ``SKETCH`` bits and more (the parity of the tokens that fall on each bit): as many bits
as differ, so many tokens differ at least, so a pair beyond what the similarity allows is left out without
its texts, and no pair within it is. The bits grow with the tokens that may differ, so that sketches of long texts
tell as much as those of short ones; a longer one is folded to the length of a shorter one. Sets joined by pairs
that are left form a candidate group. A list of over ``CELL`` sets is not looked into; its sets are one group with
its first one. Only texts that a bit filter of fixed size knows to be in a candidate group are moved.

Inside a group the intersections of a set with all others are derived from those of
the set most like it whose answers are known: only tokens in which the two differ are looked up, and
added or taken off. Groups of over ``GROUP`` sets or ``TOKENS`` tokens are cut into blocks, and each two blocks meet in
a task of their own; no pair is left out and none is written: what comes out
is one root and one number of links a set.

Null and empty texts have the empty set, which is linked with nothing. A text of
fewer words than a shingle has its whole word sequence as its only shingle.
Rows with equal texts, repeated rows included, are linked with each other. A
null doc_id is never a component's name; it stands only where there is no other.
An empty table gives no rows. Only ``doc_id`` and ``text`` are read. Sets and
shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from oddlines.llm.common import bound_batches, components, partitions
from oddlines.llm.words import arrow_portions, give_back, hashed_words, mix, portions, shingle_sets
from oddlines.storage import materialize

GROUP, TOKENS = 1500, 1_000_000  # sets, and tokens of sets, of a part of a group; two parts meet in a task
SKETCH, CELL = 1024, 4096  # least bits of a sketch, sets of a list that are told apart by sketches
SAMPLE, COMMON, MOST_COMMON = 32, 16, 1 << 17  # one text in so many, held by so many of them: a common block; of these at most
FILTER = 1 << 25  # bits of the filter of texts in candidate groups
ENTRIES, HELD = 1 << 18, 1 << 21  # list entries that a task sends at a time and that it holds of a bucket
SPARE = 3  # least blocks beyond those that may differ
_PREFIX = 0x94D049BB133111EB


@cache
def classes(percent: int) -> list[tuple[int, int, int, int]]:
    """(lower size, upper size, largest size of a partner, tokens that may differ) of each class."""
    cuts, size = [1], 1.0
    while size < 1 << 40:
        size *= 1.5
        if int(size + 1) > cuts[-1]:
            cuts.append(int(size + 1))
    found = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        most = high - 1
        partner = most * 100 // percent
        found.append((low, most, partner, (most + partner) * (100 - percent) // (100 + percent)))
    return found


def keys_of(tokens: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """The index lists that a set of sorted hashes enters; those of ``common`` blocks only if it may need them."""
    n, out = len(tokens), []
    if not n:
        return np.zeros(0, np.int64)
    table, content = classes(percent), mix(tokens)
    first = next(k for k, (low, most, _, _) in enumerate(table) if low <= n <= most)
    k = first
    while k >= 0 and n <= table[k][2]:
        differ = table[k][3]
        if differ:
            blocks = differ + max(SPARE, differ // 16)
            at = ((tokens >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            starts = np.flatnonzero(np.diff(at, prepend=np.uint64(blocks)))
            sums = np.add.reduceat(content, starts)
            lists = mix(sums ^ (at[starts] + np.uint64((k + 1) << 40)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            largest = n * 100 // percent if k == first else table[k][1]  # partner in this class
            agreed = len(starts) - (n + largest) * (100 - percent) // (100 + percent)  # filled ones, with any partner, at least
            if common is not None and len(common) and agreed > 0:
                at = np.minimum(np.searchsorted(common, lists), len(common) - 1)
                rare = common[at] != lists
                if len(lists) - rare.sum() < agreed:
                    lists = lists[rare]
            out.append(lists.view(np.uint64))
            if agreed <= 0:  # all blocks in which a pair agrees may be empty
                prefix = n - -(-n * percent // 100) + 1
                out.append(mix(content[:prefix] ^ np.uint64(_PREFIX * (2 * k + 1) % 2**64)))
        k -= 1
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def token_sets(texts: list[str | None], shingle: int) -> Iterator[np.ndarray]:
    for part in portions(texts):
        words, bounds = hashed_words(part)
        yield from shingle_sets(words, bounds, shingle)


def _token_sets(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    for _, texts in arrow_portions(batch.column("text")):
        words, bounds = hashed_words(texts)
        yield from shingle_sets(words, bounds, shingle)


def set_id(tokens: np.ndarray) -> int:
    total = mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sketch_bits(n: int, percent: int) -> int:
    """Four to eight times as many bits as tokens in which a set of this size and a partner may differ."""
    return max(SKETCH, 1 << (8 * n * (100 - percent) // percent | 1).bit_length() - 1)


def sketch(tokens: np.ndarray, bits: int = SKETCH) -> bytes:
    """For each bit (a power of two in all) the parity of the tokens that fall on it."""
    at = (mix(tokens) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of words, longer ones as those of ``size`` bytes that the same sets have."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for own in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == own)
        raw = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint64)
        out[at] = np.bitwise_xor.reduce(raw.reshape(len(at), own // size, size // 8), axis=1)
    return out


def index_rows(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, digest, sid, n, sketch): each text's set, its size and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(set_id(s), len(s), sketch(s, sketch_bits(len(s), percent))) for s in _token_sets(batch, shingle)]
            sid, n, bits = zip(*sets) if sets else ((), (), ())
            columns = [batch.column("doc_id"), batch.column("digest")]
            columns += [pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "sid", "n", "sketch"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, digest long, sid long, n long, sketch binary")


def common_keys(docs: DataFrame, shingle: int, percent: int, sample: int = SAMPLE, least: int = COMMON) -> np.ndarray:
    """Lists that ``least`` texts of a sample enter, those with most texts; a choice of bounded size."""
    some = docs.filter(F.pmod(F.xxhash64("digest"), F.lit(sample)) == 0)
    keys = list_entries(some, shingle, percent, 1).select(F.explode("keys").alias("key"))
    often = keys.groupBy("key").count().filter(F.col("count") >= least)
    found = often.orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()
    return np.sort(np.array([r["key"] for r in found], np.int64))


def list_entries(docs: DataFrame, shingle: int, percent: int, buckets: int, common: np.ndarray | None = None) -> DataFrame:
    """(bucket, keys, sids): which sets enter which lists, many entries a row."""

    def sent(keys: list[np.ndarray], sids: list[int]) -> pa.RecordBatch:
        owner = np.repeat(np.array(sids, np.int64), [len(k) for k in keys])
        key = np.concatenate([*keys, np.zeros(0, np.int64)])
        bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort([key, bucket])
        bucket = bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = pa.array(np.append(starts, len(bucket)).astype(np.int32))
        columns = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (key, owner)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *columns], ["bucket", "keys", "sids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sids: dict[int, None] = {}
        held = 0
        for batch in batches:
            for tokens in _token_sets(batch, shingle):
                sid = set_id(tokens)
                if not len(tokens) or sid in sids:
                    continue
                sids[sid] = None
                keys.append(keys_of(tokens, percent, common))
                held += len(keys[-1])
                if held > ENTRIES:
                    yield sent(keys, list(sids))
                    keys, sids, held = [], {}, 0
        if held:
            yield sent(keys, list(sids))

    return docs.select("text").mapInArrow(run, "bucket int, keys array<long>, sids array<long>")


def _unique_entries(keys: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries once, by key and set, and where each list begins."""
    order = np.lexsort([sids, keys])
    keys, sids = keys[order], sids[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1]))[: len(keys)]
    keys, sids = keys[new], sids[new]
    return keys, sids, np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


def lists(entries: DataFrame, cell: int, most: int) -> DataFrame:
    """(list, sids) of every list of two sets or more; a null name marks sets that stay together unseen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting, held, limit = None, [], 0, most
        hot: dict[int, int] = {}  # first set of each list that is not looked into

        def batch(names: list, sids: list[np.ndarray]) -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *map(len, sids)]).astype(np.int32))
            flat = pa.array(np.concatenate([*sids, np.zeros(0, np.int64)]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["list", "sids"])

        def unseen(key: int, sids: np.ndarray) -> np.ndarray:
            return np.append(hot.setdefault(key, int(sids[0])), sids)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held, limit
            keys, sids, starts = _unique_entries(*(np.concatenate(x) for x in zip(*waiting)))
            count = np.diff(np.append(starts, len(keys)))
            at = [i for i in np.flatnonzero(count > 1 if hot else count > cell).tolist() if count[i] > cell or int(keys[starts[i]]) in hot]
            at += [i for i in np.flatnonzero(count == 1).tolist() if int(keys[starts[i]]) in hot] if hot else []
            if at:
                yield batch([None] * len(at), [unseen(int(keys[starts[i]]), sids[starts[i] : starts[i] + count[i]]) for i in at])
            rest = np.ones(len(starts), bool)
            rest[at] = False
            if last:
                rest &= count > 1
            inside = np.repeat(rest, count)
            keys, sids, starts = _unique_entries(keys[inside], sids[inside])
            if last and len(keys):
                held_by = np.add.reduceat(mix(sids.view(np.uint64)), starts) + np.diff(np.append(starts, len(keys))).astype(np.uint64)
                _, pick = np.unique(held_by, return_index=True)
                ends = np.append(starts, len(keys))
                yield batch(held_by[pick].view(np.int64).tolist(), [sids[starts[i] : ends[i + 1]] for i in pick.tolist()])
            waiting, held = ([], 0) if last else ([(keys, sids)], len(keys))
            limit = max(most, 2 * held)

        for source in batches:
            for i in range(source.num_rows):
                if source.column("bucket")[i].as_py() != bucket:
                    if waiting:
                        yield from flush(True)
                    bucket, hot, limit = source.column("bucket")[i].as_py(), {}, most
                keys, sids = (source.column(c)[i].values.to_numpy() for c in ("keys", "sids"))
                waiting.append((keys, sids))
                held += len(keys)
                if held > limit:
                    yield from flush(False)
        if waiting:
            yield from flush(True)

    n = partitions(entries.sparkSession)
    dealt = entries.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "list long, sids array<long>")


def may_link(bits: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sketches and sizes can reach the similarity; never false for those that do."""
    differ = np.bitwise_count(bits ^ other).sum(axis=-1, dtype=np.int64)
    total = n + m
    common = -(-percent * total // (100 + percent))
    return (differ <= total - 2 * common) & (common <= np.minimum(n, m))


def _reached(sids: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """For each set of one list the first set that it is joined with by pairs that may be linked."""
    first, left = sids.copy(), np.arange(len(sids))
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            i = queue.pop()
            near = may_link(bits[left], n[left], bits[i], n[i], percent)
            first[left[near]] = sids[root]
            queue.extend(left[near].tolist())
            left = left[~near]
    return first


def candidate_pairs(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sid, root): pairs that join the sets of every candidate group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for last, batch in _with_last(batches):
            columns = [batch.column(c).to_numpy() for c in ("list", "sid", "n")]
            sketches = batch.column("sketch").to_pylist()
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest[0], columns)]
                sketches = rest[1] + sketches
            name, sid, n = columns
            starts = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
            ends = np.append(starts[1:], len(name))
            if not last and len(starts):  # the batch's last list may go on
                rest = [x[starts[-1] :] for x in columns], sketches[starts[-1] :]
                starts, ends = starts[:-1], ends[:-1]
            pair = starts[ends - starts == 2]
            least = np.fromiter((min(len(sketches[i]), len(sketches[i + 1])) for i in pair.tolist()), np.int64, len(pair))
            told, roots = [sid[:0]], [sid[:0]]
            for size in np.unique(least).tolist():
                own = pair[least == size]
                one, other = (folded([sketches[i] for i in x.tolist()], size) for x in (own, own + 1))
                near = own[may_link(one, n[own], other, n[own + 1], percent)]
                told.append(sid[near + 1])
                roots.append(sid[near])
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a > 2:
                    bits = folded(sketches[a:b], min(map(len, sketches[a:b])))
                    told.append(sid[a:b])
                    roots.append(_reached(sid[a:b], n[a:b], bits, percent))
            told, roots = np.concatenate(told), np.concatenate(roots)
            other = told != roots
            yield pa.RecordBatch.from_arrays([pa.array(told[other]), pa.array(roots[other])], ["sid", "root"])

    small = found.filter("list IS NOT NULL").dropDuplicates(["list"]).select("list", F.explode("sids").alias("sid"))
    cells = small.join(sets.select("sid", "n", "sketch"), "sid").select("list", "sid", "n", "sketch")
    cells = cells.repartition(partitions(found.sparkSession), "list").sortWithinPartitions("list", "sid")
    unseen = found.filter("list IS NULL").select(F.explode("sids").alias("sid"), F.col("sids")[0].alias("root"))
    return cells.mapInArrow(run, "sid long, root long").union(unseen).filter("sid != root").distinct()


def _bit(digest: Column) -> tuple[Column, Column]:
    """The row and the place in it of a digest's bit in the filter."""
    at = F.pmod(F.xxhash64(digest), F.lit(FILTER))
    return F.shiftright(at, 15), at.bitwiseAND(F.lit((1 << 15) - 1))


def with_digest_among(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows whose digest is among these, and a few others: a filter of ``FILTER`` bits is all that moves."""
    row, place = _bit(F.col("digest"))
    bits = digests.select(row.alias("row"), place.alias("place")).groupBy("row").agg(F.bitmap_construct_agg("place").alias("bits"))
    row, place = _bit(docs["digest"])
    held = F.conv(F.hex(F.substring(bits["bits"], F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    told = F.getbit(held, place.bitwiseAND(F.lit(7)).cast("int")) == 1
    return docs.join(F.broadcast(bits), (bits["row"] == row) & told, "left_semi")


def _with_last(items: Iterator) -> Iterator[tuple[bool, object]]:
    before = None
    for item in items:
        if before is not None:
            yield False, before
        before = item
    if before is not None:
        yield True, before


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the others it is linked with; with ``side`` only those on the other side.

    A set's numbers of common tokens are those of the most similar set that has
    them, plus the holders of each token that only it has, less those of each token it lacks.
    """
    g, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(g), sizes)
    holders = owner[np.argsort(flat, kind="stable")]  # by token
    begins = np.append(0, np.cumsum(np.bincount(flat, minlength=len(tokens))))
    bounds = np.append(0, np.cumsum(sizes))

    def held(which: np.ndarray) -> np.ndarray:
        """How many of these tokens each set holds."""
        counts = begins[which + 1] - begins[which]
        at = np.repeat(begins[which] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        return np.bincount(holders[at], minlength=g)

    known = np.zeros((g, g), np.int32)
    likeness, pivot = np.zeros(g), np.full(g, -1)
    for i in range(g):
        own = flat[bounds[i] : bounds[i + 1]]
        p = pivot[i]
        if p < 0:
            common = held(own)
        else:
            his = flat[bounds[p] : bounds[p + 1]]
            common = known[p] + held(np.setdiff1d(own, his, True)) - held(np.setdiff1d(his, own, True))
        known[i] = common
        union = sizes[i] + sizes - common
        closer = common > likeness * union
        closer[: i + 1] = False
        likeness[closer], pivot[closer] = common[closer] / union[closer], i
        hit = 100 * common >= percent * union
        hit[i] = False
        if side is not None:
            hit &= side != side[i]
        yield i, np.flatnonzero(hit)


def _roots(g: int, links: list[np.ndarray]) -> list[int]:
    parent = list(range(g))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, others in enumerate(links):
        for j in others.tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(g)]


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row.

    Linked are texts with 100 * intersection >= ``percent`` * union of their sets;
    ``n_links`` counts the rows a row is linked with.
    """
    return _classes(docs, shingle, percent, group).select("doc_id", "n_shingles", "component_id", "n_links")


def _classes(
    docs: DataFrame, shingle: int, percent: int, group: int = GROUP, cell: int = CELL, most: int = HELD
) -> DataFrame:
    """What ``near_duplicates`` tells, with each row's digest and whether it stands for its component."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("digest", F.xxhash64("text"))
    index = materialize(index_rows(docs, shingle, percent), "index")
    # a row is named by its id and its text's digest: an id may be null or name several texts
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    sets = index.filter("n > 0").groupBy("sid").agg(
        F.min(row).alias("row"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    sets = materialize(sets.select("sid", "copies", "n", "sketch", F.col("row.doc_id").alias("rep"), "row"), "sets")
    common = common_keys(docs, shingle, percent)
    found = materialize(lists(list_entries(docs, shingle, percent, 2 * partitions(spark), common), cell, most), "lists")
    groups = materialize(components(candidate_pairs(found, sets, percent), "sid", "root"), "candidates")

    # tasks are cut by the number of sets and by what they hold
    load = F.greatest(F.count("*") / group, F.sum("n") / TOKENS)
    named = materialize(groups.withColumnRenamed("node", "sid").join(sets, "sid"), "named")
    held = named.groupBy("root").agg(load.alias("load"))
    buckets = 1 + int(named.agg(load).first()[0] or 0)
    parts = F.ceil("load")
    part = F.pmod(F.xxhash64("sid"), parts)
    placed = named.join(held, "root").select(
        "sid", "rep", "copies", "root", part.alias("part"), F.col("row.digest").alias("of"),
        F.when(parts == 1, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.col("root")).alias("place"),
        # a part of a cut group meets each part, itself included, in a task of their own
        F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"),
    )
    placed = placed.withColumn("task", F.struct("place", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")))
    some = with_digest_among(docs, named.select(F.col("row.digest").alias("digest")))
    match = (some.digest == placed.of) & some.doc_id.eqNullSafe(placed.rep)
    work = some.join(placed, match).select("task", "root", "sid", "copies", "part", "text")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        found = list(token_sets(list(rows["text"]), shingle))
        own = [set_id(s) == sid for s, sid in zip(found, rows["sid"])]  # digests may be equal by chance
        rows["tokens"] = pd.Series(found, dtype=object)
        rows = rows[own].drop_duplicates("sid").sort_values("sid")
        out = []
        for _, block in rows.groupby("root"):
            if len(block) < 2:
                continue
            sid, copies = block["sid"].to_numpy(), block["copies"].to_numpy()
            side = block["part"].to_numpy() if block["part"].nunique() > 1 else None
            links = [others for _, others in linked(list(block["tokens"]), percent, side)]
            for i, r in enumerate(_roots(len(block), links)):
                if len(links[i]):
                    out.append((sid[i], sid[r], copies[links[i]].sum()))
        del rows, found
        give_back()
        return pd.DataFrame(out, columns=["sid", "root", "links"]).astype("int64")

    work = work.repartition(partitions(docs.sparkSession), "task")
    links = materialize(work.groupBy("task").applyInPandas(compare, "sid long, root long, links long"), "links")
    roots = components(links, "sid", "root").withColumnRenamed("node", "sid")
    counts = links.groupBy("sid").agg(F.sum("links").alias("links"))
    told = sets.join(roots, "sid", "left").join(counts, "sid", "left")
    told = told.withColumn("root", F.coalesce("root", "sid"))
    names = told.groupBy("root").agg(F.min("row").alias("first"))
    told = materialize(told.join(names, "root").select(
        "sid", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ), "classes")
    some = F.col("n") > 0
    return index.select("doc_id", "digest", "sid", "n").join(told, "sid", "left").select(
        "doc_id",
        "digest",
        F.col("n").alias("n_shingles"),
        F.when(some, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        # is this row, or one of the same id and text, the first of its component
        (~some | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest")))).alias("kept"),
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: the one of smallest id, a null id last, and of several texts of that id one.

    Of repeated rows (same id, same text) one stays; texts without words all stay.
    """
    told = materialize(_classes(docs, shingle, percent), "told")
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "digest"]
    others = told.filter("NOT kept").select(*key).distinct()
    twice = told.filter("kept AND n_shingles > 0").groupBy(*key).count().filter("count > 1").drop("count")
    rows = docs.withColumns({
        "_no_id": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_digest": F.xxhash64(F.col("text").cast("string"))
    })

    def among(keys: DataFrame):
        return (rows._no_id == keys.no_id) & (rows._id == keys.id) & (rows._digest == keys.digest)

    rows = rows.join(others, among(others), "left_anti")
    single = rows.join(twice, among(twice), "left_anti")
    repeated = rows.join(twice, among(twice), "left_semi").dropDuplicates(["_no_id", "_id", "_digest"])
    return single.unionByName(repeated).select(*docs.columns)
