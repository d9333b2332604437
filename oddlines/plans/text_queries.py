"""Masking, preparing and vectorising text."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddlines.functions.text import mask_tokens, mask_tokens_legacy
from oddlines.operators import features as f
from oddlines.plans import tables as t
from oddlines.plans.registry import query
from oddlines.storage import materialize


@query(
    "fill_missing",
    """SELECT d.doc_id, d.lang, coalesce(l.toxic::VARCHAR, 'missing') AS toxic
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def fill_missing(spark, sf_dir):
    labels = t.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"))
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return f.fill_missing(docs.join(labels, "doc_id", "left"))


def _maskable(spark, sf_dir):
    """Document texts, and event lines that hold every kind of volatile token."""
    docs = t.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    user = F.col("user_id").cast("string")
    line = F.concat(
        F.lit("Addr 0x"), F.hex("event_id"), F.lit(" from 10.0."), (F.col("user_id") % 256).cast("string"),
        F.lit(".1 port "), user, F.lit(" x"), user, F.lit(" 999.1.2.3.4 "), user, F.lit(" "), user,
    )
    events = t.table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("key"), line.alias("text")
    )
    return docs.unionByName(events)


_MASKABLE = """maskable AS (
  SELECT 'd' || doc_id::VARCHAR AS key, text FROM documents
  UNION ALL
  SELECT 'e' || event_id::VARCHAR, 'Addr 0x' || to_hex(event_id) || ' from 10.0.' || (user_id % 256)::VARCHAR
    || '.1 port ' || user_id::VARCHAR || ' x' || user_id::VARCHAR || ' 999.1.2.3.4 ' || user_id::VARCHAR || ' '
    || user_id::VARCHAR
  FROM events)"""


@query("mask_tokens", f"WITH {_MASKABLE} SELECT key, {t.sql_mask('text')} AS masked FROM maskable")
def masked(spark, sf_dir):
    return _maskable(spark, sf_dir).select("key", mask_tokens(F.col("text")).alias("masked"))


@query("mask_tokens_legacy", f"WITH {_MASKABLE} SELECT key, {t.sql_mask('text', legacy=True)} AS masked FROM maskable")
def masked_legacy(spark, sf_dir):
    return _maskable(spark, sf_dir).select("key", mask_tokens_legacy(F.col("text")).alias("masked"))


@query(
    "prepare_text",
    f"""SELECT doc_id AS seq, source_folder, template, event, source, level, event_clean,
        level || ' ' || source || ' ' || event_clean AS combined
    FROM (SELECT doc_id, source AS source_folder, text AS template, text AS event, source, 'INFO' AS level,
                 {t.sql_mask('text')} AS event_clean FROM documents)""",
)
def prepare_text(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("source_folder"), F.col("text").alias("template")
    )
    return f.prepare_text(docs)


def _documents(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", "text")


TOKENS = r"""toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)"""
GRAMS = (
    TOKENS
    + """,
grams AS (
  SELECT doc_id, unnest(w) AS term FROM toks
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term)"""
)
VOCAB = (
    GRAMS
    + """,
top_terms AS (
  SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 1000),
voc AS (SELECT term, cf, df, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_id,
               ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1 AS idf FROM top_terms)"""
)
WEIGHTS = (
    VOCAB
    + """,
raw AS (SELECT doc_id, term, term_id, tf, tf * idf AS x FROM tf JOIN voc USING (term)),
weights AS (SELECT doc_id, term, term_id, tf, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
)


@query("tokenize_counts", f"WITH {TOKENS} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY ALL")
def tokenize_counts(spark, sf_dir):
    return f.term_counts(f.word_rows(_documents(spark, sf_dir), ["doc_id"], "text"), ["doc_id"])


def _grams(spark, sf_dir):
    return f.ngram_rows(_documents(spark, sf_dir), ["doc_id"], "text")


@query("ngram_counts", f"WITH {GRAMS} SELECT doc_id, term, tf FROM tf")
def ngram_counts(spark, sf_dir):
    return f.term_counts(_grams(spark, sf_dir), ["doc_id"])


@query("vocabulary", f"WITH {VOCAB} SELECT term, term_id, cf, df FROM voc")
def vocabulary(spark, sf_dir):
    return f.ngram_vocabulary(_documents(spark, sf_dir), ["doc_id"], "text")


def _fitted(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    n_rows = docs.agg(F.count(F.lit(1))).scalar()
    return f.with_idf(vocabulary(spark, sf_dir), n_rows)


@query("idf_table", f"WITH {VOCAB} SELECT term, df, round(idf, 6) AS idf FROM voc")
def idf_table(spark, sf_dir):
    return _fitted(spark, sf_dir).select("term", "df", F.round("idf", 6).alias("idf"))


def _weights(spark, sf_dir):
    vocab = materialize(_fitted(spark, sf_dir), "vocabulary")
    return f.tfidf(_grams(spark, sf_dir), vocab, ["doc_id"])


@query("tfidf_weights", f"WITH {WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "tfidf_transform",
    rf"""WITH {VOCAB},
    new_toks AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM conversations),
    new_grams AS (
      SELECT conv_id, turn, unnest(w) AS term FROM new_toks
      UNION ALL
      SELECT conv_id, turn, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM new_toks),
    new_raw AS (
      SELECT conv_id, turn, term_id, count(*) * any_value(idf) AS x
      FROM new_grams JOIN voc USING (term) GROUP BY conv_id, turn, term_id)
    SELECT conv_id, turn, count(term_id)::INTEGER AS n_terms, round(coalesce(sum(w), 0), 6) AS weight_sum,
           round(coalesce(sum(w * term_id), 0), 3) AS id_sum
    FROM conversations LEFT JOIN (
      SELECT conv_id, turn, term_id, x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)) AS w FROM new_raw) v
    USING (conv_id, turn) GROUP BY conv_id, turn""",
)
def tfidf_transform(spark, sf_dir):
    """The vocabulary of the documents applied to the conversations; unknown words are left out."""
    vocab = materialize(_fitted(spark, sf_dir), "vocabulary")
    talks = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    grams = f.ngram_rows(talks, ["conv_id", "turn"], "text")
    vectors = f.sparse_vectors(grams, vocab, ["conv_id", "turn"], talks.drop("text"))
    total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    by_id = F.aggregate(F.zip_with("terms", "weights", lambda i, w: i * w), F.lit(0.0), lambda a, w: a + w)
    return vectors.select(
        "conv_id", "turn", F.size("terms").alias("n_terms"), F.round(total, 6).alias("weight_sum"),
        F.round(by_id, 3).alias("id_sum"),
    )


def _vectors(spark, sf_dir):
    """Vectors of all documents, and the terms of the vocabulary by id."""
    vocab = materialize(_fitted(spark, sf_dir), "vocabulary")
    docs = _documents(spark, sf_dir)
    vectors = f.sparse_vectors(_grams(spark, sf_dir), vocab, ["doc_id"], docs.select("doc_id"))
    # as many names as the vocabulary may have terms
    return vectors, [r["term"] for r in vocab.select("term_id", "term").orderBy("term_id").collect()]


@query("tfidf_wide")
def tfidf_wide(spark, sf_dir):
    """Every document with a column for each term of the vocabulary."""
    vectors, terms = _vectors(spark, sf_dir)
    rounded = vectors.withColumn("weights", F.transform("weights", lambda w: F.round(w, 6)))
    return f.wide(rounded, ["doc_id"], terms)


@query(
    "tfidf_wide_cells",
    f"""WITH {WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight, (SELECT count(*) FROM voc) AS n_columns FROM weights
    WHERE round(weight, 6) <> 0""",
)
def tfidf_wide_cells(spark, sf_dir):
    """The cells of the wide table that are not zero, under the names of their columns."""
    table = tfidf_wide(spark, sf_dir)
    terms = table.columns[1:]
    cells = F.filter(F.array(*[F.struct(F.lit(x).alias("term"), F.col(f"`{x}`").alias("weight")) for x in terms]), lambda c: c["weight"] != 0)
    return table.select("doc_id", F.inline(cells)).withColumn("n_columns", F.lit(len(terms)).cast("long"))


@query(
    "feature_shape",
    f"WITH {VOCAB} SELECT (SELECT count(*) FROM documents) AS n_rows, count(*) AS n_features FROM voc",
)
def feature_shape(spark, sf_dir):
    return f.shape(_documents(spark, sf_dir), vocabulary(spark, sf_dir))


@query(
    "feature_row_sums",
    f"""WITH {WEIGHTS} SELECT doc_id, round(coalesce(sum(weight), 0), 6) AS weight_sum
    FROM documents LEFT JOIN weights USING (doc_id) GROUP BY doc_id""",
)
def feature_row_sums(spark, sf_dir):
    vectors, _ = _vectors(spark, sf_dir)
    return f.row_sums(vectors, ["doc_id"]).select("doc_id", F.round("weight_sum", 6).alias("weight_sum"))
