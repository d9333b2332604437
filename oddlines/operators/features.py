"""TF-IDF features in long form: one row per (key, term)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oddlines.functions.text import mask_tokens, mask_tokens_legacy, words
from oddlines.storage import materialize, scratch, spread

MAX_FEATURES = 1000
SENT_TERMS = 1 << 18  # terms of all models together that are sent to every executor: some 20 MB


def fill_missing(df: DataFrame) -> DataFrame:
    """Nulls of text columns become ``missing``."""
    return df.fillna("missing")


def prepare_text(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Add ``event_clean`` and ``combined`` (level, source and masked event).

    Mined lines without an event take the template as event, the folder as
    source and INFO as level.
    """
    if "template" in df.columns and "event" not in df.columns:
        df = df.withColumns(
            {"event": F.col("template"), "source": F.col("source_folder"), "level": F.lit("INFO")}
        )
    mask = mask_tokens_legacy if legacy else mask_tokens
    filled = fill_missing(df).withColumn("event_clean", mask(F.col("event")))
    return filled.withColumn("combined", F.concat_ws(" ", "level", "source", "event_clean"))


def word_rows(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """One row per single word of each text: ``key``, ``term``."""
    return _term_rows(df, key, text, lambda tokens: tokens)


def ngram_rows(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """One row per word and per pair of neighbouring words of each text."""
    pairs = _neighbours(df, key, text)
    both = F.array("first", F.concat("first", F.lit(" "), "second"))
    return pairs.select(*key, F.explode(both).alias("term")).filter("term IS NOT NULL")


def stopped_rows(df: DataFrame, key: Sequence[str], text: str, stop_words: Sequence[str]) -> DataFrame:
    """One row per word outside ``stop_words``; the list is a fixed one of a few hundred."""
    stops = F.array(*[F.lit(w) for w in stop_words])
    return _term_rows(df, key, text, lambda tokens: F.filter(tokens, lambda t: ~F.array_contains(stops, t)))


def _term_rows(df: DataFrame, key: Sequence[str], text: str, terms) -> DataFrame:
    return _tokens(df, key, text).select(*key, F.explode(terms(F.col("_tokens"))).alias("term"))


def _tokens(df: DataFrame, key: Sequence[str], text: str, moved: bool = True) -> DataFrame:
    # Texts are spread by key before they are taken apart: the far larger term
    # rows are then counted and normalised in place, with no shuffle of their own.
    rows = df.select(*key, text)
    return (spread(rows, *key) if moved else rows).select(*key, words(F.col(text)).alias("_tokens"))


def _neighbours(df: DataFrame, key: Sequence[str], text: str, moved: bool = True) -> DataFrame:
    """One row per word of each text: the word as ``first``, the next as ``second``, null behind the last one."""
    following = F.slice("_tokens", 2, F.greatest(F.size("_tokens"), F.lit(1)))
    zipped = F.arrays_zip(F.col("_tokens").alias("first"), following.alias("second"))
    return _tokens(df, key, text, moved).select(*key, F.inline(zipped).alias("first", "second"))


def term_counts(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Times each term occurs in each text: ``key``, ``term``, ``tf``."""
    return rows.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_counts(counts: DataFrame, freq: str | None = None, model: Sequence[str] = ()) -> DataFrame:
    """Occurrences ``cf`` and rows ``df`` of every term; pre-aggregated before the shuffle."""
    times = F.col(freq) if freq else F.lit(1).cast("long")
    return counts.groupBy(*model, "term").agg(F.sum(F.col("tf") * times).alias("cf"), F.sum(times).alias("df"))


def vocabulary(
    rows: DataFrame,
    key: Sequence[str],
    max_features: int = MAX_FEATURES,
    freq: str | None = None,
    model: Sequence[str] = (),
) -> DataFrame:
    """The most frequent terms (ties by term) of term rows: ``term``, ``term_id``, ``cf``, ``df``.

    ``term_id`` numbers the chosen terms in ascending order; ``freq`` says how
    often a text counts. With ``model`` columns each value of them gets a
    vocabulary of its own. The terms are chosen by their totals alone, so only
    the chosen ones are then counted text by text.
    """
    totals = rows.groupBy(*model, "term").agg(F.sum(_times(freq)).alias("cf"))
    return _chosen(totals, rows, key, max_features, freq, model)


def ngram_vocabulary(
    df: DataFrame,
    key: Sequence[str],
    text: str,
    max_features: int = MAX_FEATURES,
    freq: str | None = None,
    model: Sequence[str] = (),
    moved: bool = True,
) -> DataFrame:
    """``vocabulary`` of the words and pairs of neighbouring words of texts.

    A pair is at most as frequent as either of its words. So pairs are counted
    only where both words reach the count of the ``max_features``-th word: the
    others, nearly all there are, cannot be among the chosen terms. Counting by
    word needs no texts of one key together: with ``moved`` false, for texts in
    a stored table of many files, they are taken apart where they lie.
    """
    pairs = _neighbours(df, [*model, *key, *([freq] if freq else [])], text, moved)
    words_of = pairs.groupBy(*model, F.col("first").alias("term")).agg(F.sum(_times(freq)).alias("cf"))
    with scratch(df.sparkSession, "frequent"):
        words_of = materialize(words_of, "words")
        least = _top(words_of, max_features, model).groupBy(*model).agg(
            F.when(F.count(F.lit(1)) == max_features, F.min("cf")).otherwise(0).alias("_least")
        )
        frequent = words_of.join(least, list(model)) if model else words_of.crossJoin(F.broadcast(least))
        frequent = materialize(frequent.filter("cf >= _least").drop("_least"), "frequent")
    sent = _sent(frequent)
    for place in ("first", "second"):
        pairs = pairs.join(sent.select(*model, F.col("term").alias(place)), [*model, place])
    totals = pairs.groupBy(*model, "first", "second").agg(F.sum(_times(freq)).alias("cf"))
    totals = totals.select(*model, F.concat_ws(" ", "first", "second").alias("term"), "cf")
    totals = frequent.select(totals.columns).unionByName(totals)
    return _chosen(totals, ngram_rows(df, [*model, *key, *([freq] if freq else [])], text), key, max_features, freq, model)


def _times(freq: str | None) -> Column:
    return F.col(freq) if freq else F.lit(1).cast("long")


def _sent(terms: DataFrame) -> DataFrame:
    """A stored table of terms, sent to the executors if its rows are few: by term the far larger rows of texts would move."""
    return F.broadcast(terms) if terms.count() <= SENT_TERMS else terms


def _top(totals: DataFrame, max_features: int, model: Sequence[str]) -> DataFrame:
    if not model:
        return totals.orderBy(F.desc("cf"), "term").limit(max_features)
    rank = F.row_number().over(W.partitionBy(*model).orderBy(F.desc("cf"), "term"))
    return totals.withColumn("_rank", rank).filter(F.col("_rank") <= max_features).drop("_rank")


def _chosen(
    totals: DataFrame, rows: DataFrame, key: Sequence[str], max_features: int, freq: str | None, model: Sequence[str]
) -> DataFrame:
    """The top terms by ``totals``, numbered, with their number of texts."""
    top = _top(totals, max_features, model)
    # at most max_features rows of one model are numbered in one task
    numbered = top.withColumn("term_id", F.row_number().over(W.partitionBy(*model).orderBy("term")) - 1)
    numbered = materialize(numbered, "terms")
    known = rows.join(_sent(numbered).select(*model, "term"), [*model, "term"])
    weight = [freq] if freq else []
    texts = known.select(*model, *key, *weight, "term").distinct()
    per_term = texts.groupBy(*model, "term").agg(F.sum(_times(freq)).alias("df"))
    return numbered.join(per_term, [*model, "term"])


def with_idf(vocab: DataFrame, n_rows: Column) -> DataFrame:
    """Add ``idf`` = ln((1 + n) / (1 + df)) + 1."""
    return vocab.withColumn("idf", F.log((1 + n_rows) / (1 + F.col("df"))) + 1)


def _known_terms(rows: DataFrame, vocab: DataFrame, key: Sequence[str], model: Sequence[str]) -> DataFrame:
    """Raw weights ``x`` = tf x idf of the vocabulary's terms.

    Other terms are dropped before anything is counted. A vocabulary is at most
    a fixed number of terms a model, so it is broadcast when there is one
    model; with several (it is then stored) when all of them have few enough.
    """
    small = (_sent if model else F.broadcast)(vocab).select(*model, "term", "term_id", "idf")
    known = rows.join(small, [*model, "term"])
    counted = known.groupBy(*model, *key, "term", "term_id", "idf").agg(F.count(F.lit(1)).alias("tf"))
    return counted.withColumn("_x", F.col("tf") * F.col("idf"))


def tfidf(rows: DataFrame, vocab: DataFrame, key: Sequence[str], model: Sequence[str] = ()) -> DataFrame:
    """Weights of the vocabulary's terms in term rows, scaled to length 1 in each text."""
    raw = _known_terms(rows, vocab, key, model)
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(W.partitionBy(*model, *key)))
    return raw.select(*model, *key, "term", "term_id", "tf", (F.col("_x") / length).alias("weight"))


def sparse_vectors(
    rows: DataFrame, vocab: DataFrame, key: Sequence[str], texts: DataFrame, model: Sequence[str] = ()
) -> DataFrame:
    """One row per row of ``texts``: ``terms`` (ids, ascending) and ``weights``, length 1.

    Texts none of whose terms is known keep an empty vector.
    """
    keys = [*model, *key]
    entry = F.struct(F.col("term_id"), F.col("_x").alias("x"))
    known = (
        _known_terms(rows, vocab, key, model)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))  # as long as the vocabulary at most
    )
    squares = F.aggregate("_entries", F.lit(0.0), lambda acc, e: acc + e["x"] * e["x"])
    # the length is bound by an outer lambda; as a column it would be worked out anew for each entry
    scaled = F.transform(
        F.array(F.sqrt(squares)), lambda length: F.transform("_entries", lambda e: e["x"] / length)
    )
    shaped = known.select(
        *keys,
        F.transform("_entries", lambda e: e["term_id"]).alias("terms"),
        F.element_at(scaled, 1).alias("weights"),
    )
    return texts.join(shaped, keys, "left").withColumns(
        {
            "terms": F.coalesce("terms", F.array().cast("array<int>")),
            "weights": F.coalesce("weights", F.array().cast("array<double>")),
        }
    )


def wide(vectors: DataFrame, key: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """One named column for each term, in the order of the term ids; a text without known terms has zeros.

    ``vectors`` are those of ``sparse_vectors``; the row of a text is filled in place, nothing is shuffled.
    """
    size = len(terms)
    filled = F.aggregate(
        F.arrays_zip("terms", "weights"),
        F.array_repeat(F.lit(0.0), 0),
        lambda acc, e: F.concat(acc, F.array_repeat(F.lit(0.0), e["terms"] - F.size(acc)), F.array(e["weights"])),
    )
    dense = F.concat(filled, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(filled)))
    rows = vectors.select(*key, dense.alias("_dense"))
    return rows.select(*key, *[F.col("_dense")[i].alias(term) for i, term in enumerate(terms)])


def shape(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Number of rows and of features."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", vocab.agg(F.count(F.lit(1))).scalar().alias("n_features")
    )


def row_sums(vectors: DataFrame, key: Sequence[str]) -> DataFrame:
    """The sum of each text's weights; 0 for a text without known terms."""
    return vectors.select(*key, F.aggregate("weights", F.lit(0.0), lambda acc, x: acc + x).alias("weight_sum"))
