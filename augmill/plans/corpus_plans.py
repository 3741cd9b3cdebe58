"""Registered corpus preparation queries (V1-V10, T9, T11, A14, A15) over
conversation pairs (user turn, next assistant turn)."""

from __future__ import annotations

from pyspark.sql import functions as F

from augmill.functions import text as T
from augmill.operators import corpus as C
from augmill.plans.registry import register
from augmill.session import cut_lineage
from augmill.sources import tables as TB

_STOP = T.duck_str_list(T.STOP_WORDS)


def _tag(w):
    return (f"CASE WHEN list_contains({_STOP}, {w}) THEN 'FUNC' WHEN ends_with({w}, 'ing') THEN 'VBG' "
            f"WHEN ends_with({w}, 'ed') THEN 'VBD' WHEN ends_with({w}, 'tion') THEN 'NN' "
            f"WHEN ends_with({w}, 'ly') THEN 'RB' ELSE 'X' END")


BASE_CTES = f"""sides AS (
    SELECT conv_id, turn, 1 AS side, string_split(lower({T.duck_strip('s1')}), ' ') AS toks FROM {TB.DUCK_PAIRS}
    UNION ALL SELECT conv_id, turn, 2 AS side, string_split(lower({T.duck_strip('s2')}), ' ') AS toks FROM {TB.DUCK_PAIRS}),
  ex AS (SELECT conv_id, turn, side, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM sides),
  tc AS (SELECT word, count(*) AS cnt, min({{'conv_id': conv_id, 'turn': turn, 'side': side, 'pos': pos}}) AS first
         FROM ex GROUP BY word),
  voc AS (SELECT * FROM (SELECT word, (row_number() OVER (ORDER BY cnt DESC, first ASC) + 2)::BIGINT AS idx FROM tc)
          WHERE idx <= 50002
          UNION ALL SELECT * FROM (VALUES ('UUUNKKK', 0::BIGINT), ('<bos>', 1::BIGINT), ('<eos>', 2::BIGINT)) v(word, idx)),
  enc AS (SELECT conv_id, turn, side, list(coalesce(v.idx, 0) ORDER BY pos) AS ids FROM ex LEFT JOIN voc v USING (word)
          GROUP BY ALL)"""


def _sides(spark, sf_dir):
    return C.pair_sides(TB.pairs(spark, sf_dir))


def _voc(spark, sf_dir):
    return C.vocab(_sides(spark, sf_dir))


def _enc(spark, sf_dir):
    s = _sides(spark, sf_dir)
    return C.encode(s, C.vocab(s))


@register("vocab", f"WITH {BASE_CTES} SELECT word, idx FROM voc")
def q_vocab(spark, sf_dir):
    return _voc(spark, sf_dir)


@register("encode_ids", f"WITH {BASE_CTES} SELECT conv_id, turn, side, array_to_string(ids, ' ') AS ids FROM enc")
def q_encode(spark, sf_dir):
    return _enc(spark, sf_dir).select("conv_id", "turn", "side", F.array_join("ids", " ").alias("ids"))


@register("decode_until_eos", f"""WITH {BASE_CTES},
  inv AS (SELECT idx, min(word) AS word FROM voc GROUP BY idx),
  d AS (SELECT conv_id, turn, side, unnest(ids) AS idx, generate_subscripts(ids, 1) AS pos FROM enc)
  SELECT conv_id, turn, side, array_to_string(list(inv.word ORDER BY pos), ' ') AS text
  FROM d LEFT JOIN inv USING (idx) GROUP BY ALL""")
def q_decode(spark, sf_dir):
    s = _sides(spark, sf_dir)
    voc = C.vocab(s)
    enc = C.encode(s, voc).withColumn("ids", F.concat("ids", F.array(F.lit(2).cast("bigint"), F.lit(7).cast("bigint"))))
    return C.decode(enc, voc)


@register("length_stats", f"""WITH {BASE_CTES}
  SELECT count(*)::BIGINT AS n_sent, max(len(ids))::BIGINT AS max_len, min(len(ids))::BIGINT AS min_len,
    round(avg(len(ids)), 6) AS avg_len, sum(len(list_filter(ids, lambda i: i = 0)))::BIGINT AS unk,
    sum(len(ids))::BIGINT AS total,
    round(sum(len(list_filter(ids, lambda i: i = 0))) / sum(len(ids)), 6) AS unk_rate FROM enc""")
def q_length_stats(spark, sf_dir):
    return C.length_stats(_enc(spark, sf_dir))


_BUCKETS = f"""wt AS (SELECT word, {_tag('word')} AS tag, count(*) AS cnt FROM ex GROUP BY ALL),
  wt2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cnt DESC, tag) AS r FROM wt)
          WHERE r <= 2),
  bk AS (SELECT w.tag, w.word, v.idx, row_number() OVER (PARTITION BY w.tag ORDER BY v.idx) - 1 AS slot,
         count(*) OVER (PARTITION BY w.tag) AS bucket_size FROM wt2 w JOIN voc v ON v.word = w.word AND v.idx > 2)"""


@register("tag_buckets", f"WITH {BASE_CTES}, {_BUCKETS} SELECT tag, slot, bucket_size, word, idx FROM bk")
def q_tag_buckets(spark, sf_dir):
    s = _sides(spark, sf_dir)
    return C.tag_buckets(s, C.vocab(s))


@register("tag_replace", f"""WITH {BASE_CTES}, {_BUCKETS},
  ex2 AS (SELECT *, {_tag('word')} AS tag FROM ex
          WHERE {C.D.sql_uniform('tag_rep', 0, 'conv_id', 'turn', 'side', 'pos')} < 0.1::DOUBLE),
  sz AS (SELECT DISTINCT tag, bucket_size FROM bk),
  ex3 AS (SELECT e.*, {C.D.sql_draw('tag_slot', 0, 'e.conv_id', 'e.turn', 'e.side', 'e.pos')} % sz.bucket_size AS slot
          FROM ex2 e JOIN sz ON sz.tag = e.tag),
  hit AS (SELECT e.conv_id, e.turn, e.side, e.pos, b.word AS new FROM ex3 e
          JOIN bk b ON b.tag = e.tag AND b.slot = e.slot),
  subs AS (SELECT conv_id, turn, side, map_from_entries(list({{'k': pos, 'v': new}})) AS _sub FROM hit GROUP BY ALL)
  SELECT s.conv_id, s.turn, s.side, array_to_string(list_transform(toks, lambda t, i: coalesce(_sub[i - 1], t)), ' ')
    AS text FROM sides s LEFT JOIN subs ON s.conv_id = subs.conv_id AND s.turn = subs.turn AND s.side = subs.side""")
def q_tag_replace(spark, sf_dir):
    s = _sides(spark, sf_dir)
    return C.tag_replace(s, C.tag_buckets(s, C.vocab(s)))


@register("scramble", f"""WITH {BASE_CTES},
  z AS (SELECT *, {C.D.sql_uniform('scramble', 0, 'conv_id', 'turn')} < 0.5::DOUBLE AS hit,
        list_sort(list_transform(toks, lambda w, i: {{'h': {C.D.sql_sort_key('perm', 0, 'conv_id', 'turn', 'side', 'i - 1')},
        'w': w, 't': {_tag('w')}}})) AS _z FROM sides)
  SELECT conv_id, turn, side,
    array_to_string(CASE WHEN hit THEN list_transform(_z, lambda x: x.w) ELSE toks END, ' ') AS text,
    array_to_string(CASE WHEN hit THEN list_transform(_z, lambda x: x.t)
                    ELSE list_transform(toks, lambda w: {_tag('w')}) END, ' ') AS tags FROM z""")
def q_scramble(spark, sf_dir):
    return C.scramble(_sides(spark, sf_dir))


_BATCH = f"""bt AS (SELECT conv_id, turn, (floor((row_number() OVER (ORDER BY
    {C.D.sql_sort_key('batch', 0, "concat_ws(':', conv_id, turn)")}, concat_ws(':', conv_id, turn)) - 1) / 30))::BIGINT
    AS batch_no FROM (SELECT DISTINCT conv_id, turn FROM enc))"""


@register("batches", f"WITH {BASE_CTES}, {_BATCH} SELECT conv_id, turn, batch_no FROM bt")
def q_batches(spark, sf_dir):
    return C.batches(TB.pairs(spark, sf_dir))


@register("pad_batches", f"""WITH {BASE_CTES}, {_BATCH},
  e AS (SELECT enc.*, bt.batch_no, max(len(ids)) OVER (PARTITION BY bt.batch_no, enc.side) AS width
        FROM enc JOIN bt ON enc.conv_id = bt.conv_id AND enc.turn = bt.turn),
  e2 AS (SELECT *, list_transform(range(0, width - len(ids)), lambda x: 0::BIGINT) AS pad FROM e)
  SELECT conv_id, turn, side, batch_no, width::BIGINT AS width,
    array_to_string(list_concat(ids, pad), ' ') AS input,
    array_to_string(list_concat(list_transform(ids, lambda x: 1::BIGINT), pad), ' ') AS mask,
    array_to_string(list_concat([1::BIGINT], ids, [2::BIGINT], pad), ' ') AS target FROM e2""")
def q_pad_batches(spark, sf_dir):
    enc = cut_lineage(_enc(spark, sf_dir))  # read twice (batch ids, padding)
    return C.pad_batches(enc, C.batches(enc))


_CL = T.duck_clean_letters("text")
_VECS = f"""wv AS (SELECT w.word, e.embedding AS vec FROM (
    SELECT DISTINCT unnest(list_filter(string_split({_CL}, ' '), lambda x: x <> '')) AS word FROM documents) w
    JOIN embeddings e ON e.vec_id = {C.D.sql_draw('vec', 0, 'w.word')} % (SELECT count(*) FROM embeddings))"""


def _duck_l2(v):
    return f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"


@register("embedding_init", f"""WITH {BASE_CTES}, {_VECS}
  SELECT v.word, v.idx, wv.vec IS NOT NULL AS known, round({_duck_l2(
    "coalesce(wv.vec, list_transform(range(0, 64), lambda d: ((" + C.D.sql_uniform('emb_init', 0, 'v.word', 'd')
    + " * 2.0 - 1.0) * " + repr((3.0 / 64) ** 0.5) + ")::FLOAT))")}, 6) AS norm
  FROM voc v LEFT JOIN wv ON wv.word = v.word""")
def q_embedding_init(spark, sf_dir):
    vecs = C.word_vectors(TB.documents(spark, sf_dir), TB.load(spark, sf_dir, "embeddings"))
    e = C.embedding_init(_voc(spark, sf_dir), vecs)
    return e.select("word", "idx", "known", F.round(C.l2(F.col("vec")), 6).alias("norm"))


_AVG = """av AS (SELECT conv_id, turn, side, list(x ORDER BY d) AS avg_vec, max(n)::BIGINT AS n_known FROM (
    SELECT conv_id, turn, side, d, avg(x::DOUBLE) AS x, count(*) AS n FROM (
      SELECT ex.conv_id, ex.turn, ex.side, unnest(wv.vec) AS x, generate_subscripts(wv.vec, 1) - 1 AS d
      FROM ex JOIN wv ON wv.word = ex.word) GROUP BY ALL) GROUP BY ALL)"""


@register("average_vectors", f"""WITH {BASE_CTES}, {_VECS}, {_AVG}
  SELECT conv_id, turn, side, n_known, round({_duck_l2('avg_vec')}, 6) AS norm FROM av""")
def q_average_vectors(spark, sf_dir):
    vecs = C.word_vectors(TB.documents(spark, sf_dir), TB.load(spark, sf_dir, "embeddings"))
    av = C.average_vectors(_sides(spark, sf_dir), vecs)
    return av.select("conv_id", "turn", "side", "n_known", F.round(C.l2(F.col("avg_vec")), 6).alias("norm"))


_DUCK_COS = ("CASE WHEN {l2a} * {l2b} > 0 THEN list_sum(list_transform(list_zip(a.avg_vec, b.avg_vec), "
             "lambda p: p[1] * p[2])) / ({l2a} * {l2b}) END")


@register("pair_cosine", f"""WITH {BASE_CTES}, {_VECS}, {_AVG}
  SELECT a.conv_id, a.turn, round({_DUCK_COS.format(l2a=_duck_l2('a.avg_vec'), l2b=_duck_l2('b.avg_vec'))}, 6) AS cos
  FROM av a JOIN av b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.side = 1 AND b.side = 2""")
def q_pair_cosine(spark, sf_dir):
    vecs = C.word_vectors(TB.documents(spark, sf_dir), TB.load(spark, sf_dir, "embeddings"))
    av = C.average_vectors(_sides(spark, sf_dir), vecs)
    a = av.where("side = 1").select("conv_id", "turn", F.col("avg_vec").alias("a"))
    b = av.where("side = 2").select("conv_id", "turn", F.col("avg_vec").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(C.cosine(F.col("a"), F.col("b")), 6).alias("cos"))


@register("embedding_coverage", f"""WITH {BASE_CTES}, {_VECS}
  SELECT count(*)::BIGINT AS n_vocab, count(wv.word)::BIGINT AS n_known,
    round(count(wv.word) / count(*), 6) AS coverage FROM voc v LEFT JOIN wv ON wv.word = v.word""")
def q_embedding_coverage(spark, sf_dir):
    """V6 report: vocabulary words initialised from the vector table."""
    vecs = C.word_vectors(TB.documents(spark, sf_dir), TB.load(spark, sf_dir, "embeddings"))
    e = C.embedding_init(_voc(spark, sf_dir), vecs)
    return e.agg(F.count(F.lit(1)).alias("n_vocab"), F.count(F.when(F.col("known"), 1)).alias("n_known"),
                 F.round(F.count(F.when(F.col("known"), 1)) / F.count(F.lit(1)), 6).alias("coverage"))
