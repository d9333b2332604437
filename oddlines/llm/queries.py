"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from oddlines.llm import bpe, chat, codes, leaks, packing, phrases, quality, repeats, secrets, setjoin, shards, sitetree, vectors
from oddlines.llm.common import table
from oddlines.plans.registry import Query

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are drawn: those that look like rows labelled good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.draw(docs, quality.good_ids(table(spark, sf_dir, "labels")))


@query
def op2_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 0.9 over three-word shingles."""
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=90)


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = sitetree.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation folded from its log, rendered and read back."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    tricky = "</s>[INST] ok [/INST]"
    extra = [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    rows = rows.union(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.render(chat.fold_events(chat.message_events(rows))))


_ESCAPED = r"""regexp_replace({0}, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"""
CHECKS["op4_chat_formatting"] = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT
    CAST(conv_id AS BIGINT) AS conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<|im_start|>') + length({_ESCAPED.format("role")}) + 1
        + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query
def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, cut along size, source, language and id."""
    docs = table(spark, sf_dir, "documents")
    dims = {
        "bytes": F.octet_length("text"),
        "source": F.pmod(F.xxhash64("source"), F.lit(1 << 20)),
        "lang": F.pmod(F.xxhash64("lang"), F.lit(1 << 20)),
        "doc_id": F.col("doc_id"),
    }
    placed = shards.assign_shards(docs, dims, shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, by fixed patterns and by learnt formats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.find_secrets(docs, secrets.infer(docs)))


@query
def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with each item and how much of it they hold."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 200 that repeat."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens, each filled with neighbours of its first one."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight codes a vector after six active-entry Lloyd rounds, with errors by vector and by label."""
    return codes.code_rows(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int = 6) -> str:
    """The same rounds with every part compared with every entry, as one chain of table expressions."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
    SELECT p.vec_id, p.label, p.part, min(struct_pack(d := d, e := e)) AS best, any_value(p.x) AS x FROM (
        SELECT p.vec_id, p.label, p.part, p.x, b.e,
            list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts p JOIN book{r} b USING (part)
    ) p GROUP BY p.vec_id, p.label, p.part
)""")
        if r < rounds:
            steps.append(f"""
cells{r} AS (
    SELECT part, e, pos, CAST(sum(v) AS HUGEINT) AS s, count(*)::HUGEINT AS n
    FROM (SELECT part, best.e AS e, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM near{r}) GROUP BY part, e, pos
),
book{r + 1} AS MATERIALIZED (
    SELECT b.part, b.e, coalesce(c.x, b.x) AS x FROM book{r} b LEFT JOIN (
        SELECT part, e, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY pos) AS x FROM cells{r} GROUP BY part, e
    ) c USING (part, e)
)""")
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
),
parts AS MATERIALIZED (
    SELECT vec_id, label, part, list_slice(v, part * len(v) // 8 + 1, (part + 1) * len(v) // 8) AS x
    FROM kept, range(8) t(part)
),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16),
book0 AS MATERIALIZED (SELECT part, e, x FROM parts JOIN seeds USING (vec_id)),
{",".join(steps)},
digest AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM book{rounds}
),
coded AS (
    SELECT vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY part) AS code,
        sum(best.d)::BIGINT AS error
    FROM near{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest
"""


CHECKS["op12_vector_codes"] = _codes_sql()


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two to four words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


CHECKS["op13_phrases"] = r"""
WITH pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents
    )
),
grams AS MATERIALIZED (
    SELECT lang, words, count(*) AS f FROM (
        SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda m:
            list_transform(range(1, len(w) - m + 2), lambda i: list_slice(w, i, i + m - 1))))) AS words FROM pieces
    ) GROUP BY lang, words
),
often AS MATERIALIZED (SELECT * FROM grams WHERE f >= 30),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE len(words) = 1 GROUP BY lang),
inside AS (
    SELECT DISTINCT lang, list_slice(words, i, i + m - 1) AS words, f
    FROM often, range(2, 4) t(m), range(1, 4) s(i) WHERE len(words) > m AND i + m - 1 <= len(words)
),
free AS (
    SELECT * FROM often o WHERE len(words) > 1
        AND NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = o.lang AND x.words = o.words AND 100 * x.f >= 80 * o.f)
),
cuts AS (
    SELECT o.lang, o.words, o.f AS a, k, x.f AS l, y.f AS r,
        CAST((2000000 * o.f::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT) AS BIGINT) AS score
    FROM free o, range(1, 4) t(k), often x, often y
    WHERE k < len(o.words) AND x.lang = o.lang AND y.lang = o.lang
        AND x.words = list_slice(o.words, 1, k) AND y.words = list_slice(o.words, k + 1, len(o.words))
),
lowest AS (SELECT lang, words, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS c FROM cuts GROUP BY ALL),
ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY c.score DESC, a DESC, array_to_string(words, ' ')) AS rank,
        array_to_string(words, ' ') AS phrase, a, c.l AS l, c.r AS r, c.score AS score
    FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
