"""The registered queries of this subpackage and, where SQL can say it, the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.llm.ann import search
from skyloom.llm.collocations import collocations
from skyloom.llm.common import read
from skyloom.llm.exact_dedup import exact_groups
from skyloom.llm.minhash import near_duplicates
from skyloom.llm.mixing import mixing_rates
from skyloom.llm.packing import pack
from skyloom.llm.paragraphs import repeated_paragraphs
from skyloom.llm.passages import repeated_passages
from skyloom.llm.periodic_runs import digest, periodic_runs, repeating_tail
from skyloom.llm.preference import preference_segments, swapped_answers
from skyloom.llm.quality import quality_scores
from skyloom.llm.simhash import simhash_components
from skyloom.llm.token_counts import token_counts
from skyloom.llm.url_filter import filter_urls, train
from skyloom.llm.url_labels import labelled_urls

#: The rules of the url filter.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]


#: Shares of tokens by language that the mix shall have.
LANGUAGE_WEIGHTS = {"en": 0.60, "de": 0.155, "fr": 0.155, "es": 0.09}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), URL_RULES, train(labelled_urls(spark)))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    digest = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), LANGUAGE_WEIGHTS)


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(read(spark, sf_dir, "documents"))


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"), keep="largest")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_segments(*swapped_answers(read(spark, sf_dir, "conversations")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(read(spark, sf_dir, "documents"), prepare=repeating_tail))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash_near_dedup, op3_packing, op4_mixing, op5_paragraph_dedup, op5_passage_dedup, op6_quality_classifier, op7_nearest_neighbours, op8_exact_dedup, op9_token_counts, op10_preference_format, op11_collocations, op12_periodic_runs, op13_minhash_near_dedup)}

ORACLES = {
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM d""",
    "op11_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
words AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM placed, (VALUES (1), (2), (3), (4)) AS s(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 30),
cuts AS (SELECT lang, m, phrase, f AS a, w, unnest(range(1, m)) AS k FROM often WHERE m > 1),
scored AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, f, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m)) AS i FROM often WHERE m > 2), (VALUES (2), (3)) AS t(s) WHERE s < m AND i + s - 1 <= m),
longer AS (SELECT lang, phrase, max(f) AS longest FROM inside GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON b.lang = g.lang AND b.phrase = g.phrase WHERE longest IS NULL OR 100 * longest < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON ranked.lang = totals.lang WHERE rank <= 2000""",
    "op10_preference_format": """
WITH rows AS (SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
answers AS (SELECT pair_id, turn AS last_turn, text AS last_text FROM rows WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) = 1),
partners AS (SELECT *, coalesce(lead(last_text) OVER (ORDER BY md5(CAST(pair_id AS VARCHAR)), pair_id),
  first_value(last_text) OVER (ORDER BY md5(CAST(pair_id AS VARCHAR)), pair_id)) AS other FROM answers),
chosen AS (SELECT r.pair_id, turn, role, text, role = 'assistant' AND turn = last_turn AND text = last_text AS answer, other
  FROM rows r JOIN partners p ON r.pair_id = p.pair_id AND turn <= last_turn),
rejected AS (SELECT DISTINCT pair_id, turn, role, CASE WHEN answer THEN other ELSE text END AS text FROM chosen),
a AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS pos FROM chosen),
b AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS pos FROM rejected),
j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos, a.role AS arole, a.text AS atext, b.role AS brole, b.text AS btext,
  a.role = b.role AND a.text = b.text AS same FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.pos = b.pos),
ends AS (SELECT pair_id, min(pos) AS stop FROM j WHERE same IS NOT TRUE GROUP BY pair_id),
parts AS (SELECT j.pair_id, 'prompt' AS part, pos - 1 AS position, arole AS role, atext AS text FROM j JOIN ends e ON j.pair_id = e.pair_id WHERE pos < stop
  UNION ALL SELECT j.pair_id, 'chosen', pos - stop, arole, atext FROM j JOIN ends e ON j.pair_id = e.pair_id WHERE pos >= stop AND arole IS NOT NULL
  UNION ALL SELECT j.pair_id, 'rejected', pos - stop, brole, btext FROM j JOIN ends e ON j.pair_id = e.pair_id WHERE pos >= stop AND brole IS NOT NULL),
shown AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered, part <> 'prompt' AND role = 'assistant' AS train FROM parts),
placed AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS BIGINT) AS start FROM shown)
SELECT pair_id, part, position, role, rendered, start, train, CASE WHEN train THEN start + length(role) + 13 END AS train_start,
  CASE WHEN train THEN length(rendered) - length(role) - 13 END AS train_length FROM placed""",
}
