"""Secrets in text: fixed patterns first, then automata learnt from the credentials these find.

The fixed patterns give labelled credentials of three kinds. For each kind a
prefix tree of a bounded sample is folded into a probabilistic automaton by
merging states whose outgoing frequencies are statistically compatible
(Hoeffding's bound, taken down the tree). A further automaton is learnt from
runs of credential signs that no pattern touched. Every candidate of every text,
a run of ``LEAST`` such signs or more, is then scored: the best
log-likelihood a sign under a credential automaton less that under the
background. Candidates above the threshold give spans of kind ``format``, also where
they hold or overlap a span of a fixed pattern, unless one covers them whole; the fixed spans always stay.

Null and empty texts have no spans. Texts are scanned whole; offsets are code
points. Rows are independent of each other, so ties and repeated rows repeat;
the sample holds distinct strings, lowest hash first, whatever the
partitioning. Without labelled credentials of a kind (as in an empty table)
the kind has no automaton, and without any no ``format`` span is given.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, Window as W

KINDS = ("assign", "access", "hex", "format")
# The base patterns and the shortest value, key and hexadecimal run that count.
# Keys and runs always extend to their last sign, so asking for the length in the pattern drops the same matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
ACCESS_LONG = re.compile(r"AKIA[A-Z0-9]{14,}")
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
LONG = 4096  # labelled strings of more signs are not drawn into the sample

SAMPLE = 800  # strings a kind that an automaton is learnt from
ALPHA = 0.05  # risk of refusing a merge of equal states
MARGIN = 0.75  # bits a sign by which a candidate must be likelier as a credential


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    assigned = ASSIGN.finditer(text) if ":" in text or "=" in text else ()
    found = [(m.start(), 0, m.end()) for m in assigned if m.end(2) - m.start(2) >= LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS_LONG.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def credential(text: str, span: tuple[int, int, int]) -> str:
    """The credential itself: of an assignment its value."""
    start, kind, end = span
    return ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of credential signs that no span of a fixed pattern covers whole; they may hold or overlap one."""
    joined: list[tuple[int, int]] = []
    for start, _, end in taken:
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(joined) and joined[at][1] < end:
            at += 1
        if at == len(joined) or joined[at][0] > start:
            yield start, end


def _apart(runs: Iterator[tuple[int, int]], taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Those of the runs that touch no span of a fixed pattern."""
    spans, at, reach = sorted((s, e) for s, _, e in taken), 0, 0
    for start, end in runs:
        while at < len(spans) and spans[at][0] < end:
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= start:
            yield start, end


def sign(c: str) -> str:
    """Signs that formats do not tell apart stand for each other."""
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "g"
    return "A" if "A" <= c <= "Z" else c


SIGNS = {ord(c): sign(c) for c in map(chr, range(33, 127))}


@dataclass
class Automaton:
    """Per state: how often strings pass, end there, and where each sign leads (next state, count)."""

    passed: list[int] = field(default_factory=lambda: [0])
    ended: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, tuple[int, int]]] = field(default_factory=lambda: [{}])

    def cost_table(self) -> list[dict[str, tuple[int, float]]]:
        """Log2 probability of each move; an unseen one shares one count with 70 signs."""
        out = []
        for n, moves in zip(self.passed, self.moves):
            row = {s: (to, math.log2(k / (n + 1))) for s, (to, k) in moves.items()}
            row[""] = (0, math.log2(1 / (70 * (n + 1))))
            out.append(row)
        return out


def learn(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """Prefix tree of the strings, then state merging in breadth-first order (red and blue states)."""
    tree = Automaton()
    for text in strings:
        node = 0
        tree.passed[0] += 1
        for s in text.translate(SIGNS):
            if s not in tree.moves[node]:
                tree.passed.append(0)
                tree.ended.append(0)
                tree.moves.append({})
                tree.moves[node][s] = (len(tree.passed) - 1, 0)
            to, k = tree.moves[node][s]
            tree.moves[node][s] = (to, k + 1)
            node = to
            tree.passed[node] += 1
        tree.ended[node] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def apart(k1: int, n1: int, k2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(k1 / n1 - k2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            p, q = pair = todo.pop()
            if p == q or pair in seen:
                continue
            seen.add(pair)
            n, m = tree.passed[p], tree.passed[q]
            if apart(tree.ended[p], n, tree.ended[q], m):
                return False
            for s in tree.moves[p].keys() | tree.moves[q].keys():
                (to, k), (too, j) = tree.moves[p].get(s, (-1, 0)), tree.moves[q].get(s, (-1, 0))
                if apart(k, n, j, m):
                    return False
                if to >= 0 and too >= 0:
                    todo.append((to, too))
        return True

    def fold(a: int, b: int) -> None:
        """Add the subtree ``b`` to the state ``a``."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            tree.passed[p] += tree.passed[q]
            tree.ended[p] += tree.ended[q]
            for s, (too, j) in tree.moves[q].items():
                if s in tree.moves[p]:
                    to, k = tree.moves[p][s]
                    tree.moves[p][s] = (to, k + j)
                    todo.append((to, too))
                else:
                    tree.moves[p][s] = (too, j)

    red, blue = [0], [(0, s) for s in sorted(tree.moves[0])]
    while blue:
        parent, s = blue.pop(0)
        node, k = tree.moves[parent][s]
        if node in red:
            continue
        for state in red:
            if compatible(state, node):
                tree.moves[parent][s] = (state, k)
                fold(state, node)
                known = {(p, x) for p, x in blue}
                blue += [(r, x) for r in red for x in sorted(tree.moves[r]) if tree.moves[r][x][0] not in red and (r, x) not in known]
                break
        else:
            red.append(node)
            blue += [(node, x) for x in sorted(tree.moves[node])]
    index = {state: i for i, state in enumerate(red)}
    return Automaton(
        [tree.passed[r] for r in red],
        [tree.ended[r] for r in red],
        [{s: (index[to], k) for s, (to, k) in tree.moves[r].items()} for r in red],
    )


def bits(table: list[dict[str, tuple[int, float]]], signs: str) -> float:
    """Log2 likelihood a sign of a string (translated to ``SIGNS``); after an unseen move it starts anew."""
    state, total = 0, 0.0
    for s in signs:
        row = table[state]
        state, cost = row.get(s) or row[""]
        total += cost
    return total / max(1, len(signs))


@dataclass
class Grammar:
    """Cost tables of the credential kinds and of the background."""

    kinds: list[list[dict[str, tuple[int, float]]]]
    background: list[dict[str, tuple[int, float]]]
    margin: float

    def score(self, candidate: str) -> float:
        signs = candidate.translate(SIGNS)
        return max(bits(k, signs) for k in self.kinds) - bits(self.background, signs)


def labelled(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(kind, value): for each kind and for ``background`` the ``sample`` distinct strings of lowest hash.

    Each batch hands on at most ``sample`` strings a kind, and so does each task.
    """

    def lowest(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.drop_duplicates().sort_values(["rank", "value"]).groupby("kind").head(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"kind": [], "rank": [], "value": []})
        for batch in batches:
            rows = []
            for value in batch[text]:
                if not value:
                    continue
                taken = base_spans(value)
                rows += [(KINDS[span[1]], credential(value, span)) for span in taken]
                rows += [("background", value[s:e]) for s, e in _apart(candidates(value, taken), taken)]
            new = pd.DataFrame([r for r in rows if len(r[1]) <= LONG], columns=["kind", "value"]).drop_duplicates()
            new["rank"] = [xxhash.xxh64_intdigest(v) >> 1 for v in new["value"]]
            kept = lowest(pd.concat([kept, new]) if len(kept) else new)
        if len(kept):
            yield kept[["kind", "rank", "value"]]

    drawn = docs.select(F.col(text).cast("string").alias(text)).mapInPandas(run, "kind string, rank long, value string")
    group = F.pmod(F.spark_partition_id(), F.lit(256)).alias("part")
    for keys in (["kind", "part"], ["kind"]):  # in two steps, so that no task gets the strings of all tasks
        drawn = drawn.select("kind", "rank", "value", *([group] if "part" in keys else [])).distinct()
        order = W.partitionBy(*keys).orderBy("rank", "value")
        drawn = drawn.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).drop("n")
    return drawn.select("kind", "value")


def infer(docs: DataFrame, text: str = "text", sample: int = SAMPLE, margin: float = MARGIN) -> Grammar | None:
    """Learn the automata; at most ``sample`` strings for each of four kinds reach the driver."""
    strings: dict[str, list[str]] = {}
    for kind, value in sorted(map(tuple, labelled(docs, text, sample).collect())):
        strings.setdefault(kind, []).append(value)
    background = strings.pop("background", [])
    if not strings:
        return None
    kinds = [learn(strings[k]).cost_table() for k in sorted(strings)]
    return Grammar(kinds, learn(background).cost_table(), margin)


def find_secrets(docs: DataFrame, grammar: Grammar | None, text: str = "text") -> DataFrame:
    """Add ``secrets``: array of (kind, start, end), by start and then kind; a column of that name is replaced."""
    docs = docs.drop("secrets")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema += ", secrets array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for batch in batches:
            column = []
            for value in batch[text]:
                spans = base_spans(value) if value else []
                if value and grammar is not None:
                    for start, end in list(candidates(value, spans)):
                        word = value[start:end]
                        if word not in known:
                            if len(known) > 100_000:
                                known.clear()
                            known[word] = grammar.score(word) > grammar.margin
                        if known[word]:
                            spans.append((start, 3, end))
                column.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)])
            yield batch.assign(secrets=column)

    return docs.mapInPandas(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """doc_id with counts and the digest of the fixed kinds and all spans as text."""
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "format")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("secrets")).alias("spans"),
    )


def redact(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Put ``mark`` in place of each span (overlapping ones as one) and drop ``secrets``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.drop("secrets").schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for value, spans in zip(batch[text], batch["secrets"]):
                if value and len(spans):
                    parts, at = [], 0
                    for s in sorted(spans, key=lambda s: s["start"]):
                        if s["start"] >= at:
                            parts += [value[at : s["start"]], mark]
                        at = max(at, s["end"])
                    value = "".join([*parts, value[at:]])
                texts.append(value)
            yield batch.drop(columns="secrets").assign(**{text: texts})

    return found.mapInPandas(run, schema)
