"""Checked queries: vocabularies, encoding, padding, streams, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.arrays import multi_hot, pad_left
from skyloom.operators import sequences as sq
from skyloom.operators import text as tx
from skyloom.registry import query
from skyloom.session import cut_lineage

SP = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
DOCS = f"docs AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '{SP}') IF x <> ''] AS t FROM documents)"
TOKS = f"{DOCS}, toks AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM docs)"


def vocab_sql(specials, min_freq=0, max_size=None):
    lead = " UNION ALL ".join(f"SELECT '{s}' AS token, {i} AS token_id, CAST(NULL AS BIGINT) AS n" for i, s in enumerate(specials))
    limit = f" WHERE no <= {max_size}" if max_size else ""
    return f"""cnt AS (SELECT token, count(*) AS n FROM toks GROUP BY 1 HAVING count(*) >= {min_freq}),
 vocab AS ({lead} UNION ALL SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + {len(specials)} AS INTEGER), n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, token) AS no FROM cnt){limit})"""


MARKS = ["<pad>", "<bos>", "<eos>", "<unk>"]


def joined(arr):
    return F.array_join(F.transform(arr, lambda v: v.cast("string")), " ")


@query("vo_01_build_vocab", f"WITH {TOKS}, {vocab_sql(MARKS, 3)} SELECT * FROM vocab")
def build_vocab(t):
    return tx.build_vocab(t.documents, "text", specials=MARKS, min_freq=3)


@query("vo_01_build_vocab_chars", f"""WITH toks AS (SELECT unnest([x FOR x IN string_split(text, '') IF x <> '']) AS token FROM conversations), {vocab_sql(['<unk>'], 0, 60)} SELECT * FROM vocab""")
def build_chars(t):
    return tx.build_vocab(t.conversations, "text", level="char", max_size=60)


@query("vo_02_encode", f"""WITH {TOKS}, {vocab_sql(MARKS, 3)}, e AS (SELECT doc_id, string_agg(CAST(coalesce(v.token_id, 3) AS VARCHAR), ' ' ORDER BY pos) AS ids, count(*) AS n FROM toks LEFT JOIN vocab v ON v.token = toks.token GROUP BY 1)
SELECT d.doc_id, '1 ' || coalesce(ids || ' ', '') || '2' AS ids, CAST(coalesce(n, 0) + 2 AS INTEGER) AS length FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id""")
def encode(t):
    vocab = tx.build_vocab(t.documents, "text", specials=MARKS, min_freq=3)
    out = tx.encode(t.documents, "doc_id", "text", vocab, specials=MARKS, bos="<bos>", eos="<eos>")
    return out.select("doc_id", joined("input_ids").alias("ids"), "length")


@query("vo_02_encode_truncated", f"""WITH {TOKS}, {vocab_sql(MARKS, 0, 5000)}, e AS (SELECT doc_id, string_agg(CAST(coalesce(v.token_id, 3) AS VARCHAR), ' ' ORDER BY pos) AS ids FROM toks LEFT JOIN vocab v ON v.token = toks.token WHERE pos < 62 GROUP BY 1)
SELECT d.doc_id, '1 ' || coalesce(ids || ' ', '') || '2' AS ids FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id""")
def encode_short(t):
    vocab = tx.build_vocab(t.documents, "text", specials=MARKS, max_size=5000)
    out = tx.encode(t.documents, "doc_id", "text", vocab, l_max=64, specials=MARKS, bos="<bos>", eos="<eos>")
    return out.select("doc_id", joined("input_ids").alias("ids"))


LENGTHS = f"{DOCS}, l AS (SELECT doc_id, len(t) AS n FROM docs)"


def lengths_frame(t):
    return t.documents.select("doc_id", F.transform(tx.tokenize("text"), lambda x: F.length(x)).alias("ids"))


def padded_sql(goal, value):
    """Contents and length of padded word lengths; ``goal`` is an expression over ``n``."""
    return f"""WITH {DOCS}, l AS (SELECT doc_id, [length(x) FOR x IN t] AS ids, len(t) AS n FROM docs), g AS (SELECT *, CAST({goal} AS BIGINT) AS goal FROM l)
SELECT doc_id, CAST(n AS INTEGER) AS length, array_to_string(list_concat(ids, [{value} FOR k IN range(goal - n)]), ' ') AS ids FROM g"""


@query("vo_03_pad_batch", padded_sql("max(n) OVER (PARTITION BY doc_id // 16)", -100))
def pad_batch(t):
    batches = lengths_frame(t).withColumn("batch", F.floor(F.col("doc_id") / 16))
    return tx.pad(batches, "ids", "batch", -100, ["batch"]).select("doc_id", "length", joined("ids").alias("ids"))


@query("vo_03_pad_pow2", padded_sql("pow(2, ceil(log2(greatest(n, 1)) - 1e-12))", 0))
def pad_pow2(t):
    return tx.pad(lengths_frame(t), "ids", "pow2", 0).select("doc_id", "length", joined("ids").alias("ids"))


@query("wn_16_left_pad", f"WITH {LENGTHS} SELECT doc_id, CAST(greatest(n, 100) AS INTEGER) AS padded, CAST(least(n, 20) AS INTEGER) AS context, CAST(n AS INTEGER) AS shifted FROM l")
def left_pad(t):
    df = lengths_frame(t)
    return df.select("doc_id", F.size(pad_left("ids", 100, 0)).alias("padded"), F.size(sq.trim_context("ids", 20)).alias("context"), F.size(sq.shift_array("ids", 0)).alias("shifted"))


@query("pf_26_every_kth_item", f"WITH {DOCS} SELECT doc_id, array_to_string([t[i] FOR i IN generate_series(1, len(t), 5)], ' ') AS words FROM docs")
def kth_item(t):
    return t.documents.select("doc_id", F.array_join(sq.every_kth_item(tx.tokenize("text"), 5), " ").alias("words"))


@query("vo_04_label_encode", "SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS label_id FROM part")
def label_encode(t):
    return tx.label_encode(t.part.select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "p_brand", "label_id")


@query("vo_04_char_transcripts", """WITH c AS (SELECT conv_id, turn, unnest([x FOR x IN string_split(text, '') IF x <> '']) AS token, generate_subscripts([x FOR x IN string_split(text, '') IF x <> ''], 1) AS pos FROM conversations),
 v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM c)) SELECT conv_id, turn, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos), '') AS ids FROM conversations LEFT JOIN c USING (conv_id, turn) LEFT JOIN v USING (token) GROUP BY 1, 2""")
def char_transcripts(t):
    df = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("key"), "conv_id", "turn", "text")
    chars = df.select(F.explode(tx.tokenize("text", "char")).alias("token"))
    table = tx.label_table(chars, "token", "token_id").withColumn("n", F.lit(None).cast("long"))
    coded = tx.encode(df.select("key", "text"), "key", "text", table, specials=[""], unk="", level="char")
    # a key appears once per (conversation, turn)
    parts = F.split("key", "-")
    return coded.select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), joined("input_ids").alias("ids"))


CODED = f"{TOKS}, {vocab_sql(MARKS, 3)}, coded AS (SELECT doc_id, pos, coalesce(v.token_id, 3) AS id FROM toks LEFT JOIN vocab v ON v.token = toks.token)"


def coded_frame(t):
    vocab = tx.build_vocab(t.documents, "text", specials=MARKS, min_freq=3)
    return cut_lineage(tx.encode(t.documents, "doc_id", "text", vocab, specials=MARKS)), vocab


@query("vo_05_token_stream", f"""WITH {CODED}, s AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS a, (SELECT count(*) FROM coded) // 8 AS w FROM coded),
 m AS (SELECT id, a // w AS r, a % w AS c, w FROM s WHERE a < w * 8), k AS (SELECT DISTINCT r, w, c // 32 AS st FROM m WHERE c < w - 1),
 i AS (SELECT m.r, st, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY c) AS input_ids FROM k JOIN m ON m.r = k.r AND c >= greatest(0, st * 32 + 32 - 64) AND c < least(st * 32 + 32, k.w - 1) GROUP BY 1, 2),
 g AS (SELECT m.r, st, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY c) AS target_ids FROM k JOIN m ON m.r = k.r AND c >= st * 32 + 1 AND c < least(st * 32 + 32, k.w - 1) + 1 GROUP BY 1, 2)
SELECT i.r AS "row", i.st AS step, input_ids, target_ids FROM i JOIN g ON g.r = i.r AND g.st = i.st""")
def token_stream(t):
    coded, _ = coded_frame(t)
    out = tx.token_stream(coded, "doc_id", "input_ids", batch=8, l_max=64, n_context=2)
    return out.select("row", "step", joined("input_ids").alias("input_ids"), joined("target_ids").alias("target_ids"))


@query("vo_06_pack_sentences", f"""WITH {CODED}, z AS (SELECT doc_id, count(*) AS n, md5(concat_ws('|', CAST(doc_id AS VARCHAR), '13')) AS h FROM coded GROUP BY 1),
 o AS (SELECT doc_id, CAST(('0x' || substr(h, 25, 8)) AS BIGINT) % 4 AS stream, h, n FROM z WHERE n > 1),
 b AS (SELECT *, coalesce(sum(n - 1) OVER (PARTITION BY stream ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
 p AS (SELECT stream, CAST(before AS BIGINT) + x.pos AS a, x.id AS x, y.id AS y FROM b JOIN coded x ON x.doc_id = b.doc_id JOIN coded y ON y.doc_id = x.doc_id AND y.pos = x.pos + 1)
SELECT stream, a // 128 AS "row", string_agg(CAST(x AS VARCHAR), ' ' ORDER BY a) AS input_ids, string_agg(CAST(y AS VARCHAR), ' ' ORDER BY a) AS target_ids FROM p GROUP BY 1, 2 HAVING count(*) = 128""")
def pack(t):
    coded, _ = coded_frame(t)
    out = tx.pack_sentences(coded, "doc_id", "input_ids", 128, 4, 13)
    return out.select("stream", "row", joined("input_ids").alias("input_ids"), joined("target_ids").alias("target_ids"))


@query("vo_07_decode", f"""WITH {CODED} SELECT d.doc_id, coalesce(string_agg(v.token, ' ' ORDER BY pos), '') AS text FROM documents d LEFT JOIN coded c ON c.doc_id = d.doc_id AND c.id <> 3 LEFT JOIN vocab v ON v.token_id = c.id GROUP BY 1""")
def decode(t):
    coded, vocab = coded_frame(t)
    return tx.decode(coded, "doc_id", "input_ids", vocab, exclude=[3])


@query("sc_23_tokenize_expr", """SELECT event_id, array_to_string([x FOR x IN regexp_split_to_array(replace(replace(replace(s, ']', 'X'), '(', ''), ')', ''), ' +') IF x <> ''], '|') AS tokens
FROM (SELECT event_id, '( [MAX ' || CAST(event_id AS VARCHAR) || ' ( ' || event_type || ' ) ] )' AS s FROM events)""")
def expr(t):
    s = F.concat(F.lit("( [MAX "), F.col("event_id").cast("string"), F.lit(" ( "), F.col("event_type"), F.lit(" ) ] )"))
    return t.events.select("event_id", F.array_join(tx.tokenize(s, "expr"), "|").alias("tokens"))


@query("sc_20_multi_hot_labels", "SELECT o_custkey, CAST(bool_or(o_orderstatus = 'F') AS INTEGER) AS has_f, CAST(bool_or(o_orderstatus = 'O') AS INTEGER) AS has_o, CAST(bool_or(o_orderstatus = 'P') AS INTEGER) AS has_p FROM orders GROUP BY 1")
def multi(t):
    sets = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s")).withColumn("h", multi_hot("s", ["F", "O", "P"]))
    return sets.select("o_custkey", *[F.col("h")[i].alias(n) for i, n in enumerate(("has_f", "has_o", "has_p"))])
