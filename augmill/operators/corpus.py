"""Corpus preparation (V1-V10) and the tag-based augmenters.

Sentences are pair sides: lowercased, stripped, split on single spaces.
The vocabulary is the top-K tokens (count desc, first occurrence asc); its
size is bounded by K, which is what makes broadcasting it safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augmill.functions import draws as D
from augmill.functions import text as T
from augmill.operators.common import barrier
from augmill.operators.indexing import global_index
from augmill.session import cut_lineage

UNK, BOS, EOS = 0, 1, 2
SPECIALS = [("UUUNKKK", UNK), ("<bos>", BOS), ("<eos>", EOS)]


def pair_sides(pairs: DataFrame) -> DataFrame:
    """(conv_id, turn, s1, s2) -> (conv_id, turn, side, toks)."""
    s1 = pairs.select("conv_id", "turn", F.lit(1).alias("side"), T.split_keep_empty(T.lower_strip(F.col("s1"))).alias("toks"))
    s2 = pairs.select("conv_id", "turn", F.lit(2).alias("side"), T.split_keep_empty(T.lower_strip(F.col("s2"))).alias("toks"))
    return s1.unionByName(s2)


def token_counts(sides: DataFrame) -> DataFrame:
    """V1 input: (word, cnt, first) with first = earliest (conv_id, turn, side, pos)."""
    ex = sides.select("conv_id", "turn", "side", F.posexplode("toks").alias("pos", "word"))
    return ex.groupBy("word").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min(F.struct("conv_id", "turn", "side", "pos")).alias("first"))


def _smallest(rows: DataFrame, key: str, n: int, bins: int = 4096) -> DataFrame:
    """The n rows with the smallest ``key`` (bigint), and all that tie with the last of them: histograms of
    at most ``bins`` + 1 rows narrow the range in which the n-th lies, until it is a single value."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    before = 0
    while lo is not None and hi > lo:
        width = max(1, -(-(hi - lo + 1) // bins))
        at = F.floor((F.col(key) - lo) / width).cast("bigint")
        for bin_, found in sorted(rows.where(F.col(key).between(lo, hi)).groupBy(at.alias("bin")).count().collect()):
            if before + found >= n:
                lo, hi = lo + bin_ * width, min(hi, lo + (bin_ + 1) * width - 1)
                break
            before += found
        else:
            break
    return rows if lo is None else rows.where(F.col(key) <= hi)


def top_counts(counts: DataFrame, k: int) -> DataFrame:
    """The k rows of (word, cnt, first struct<conv_id, ...>) with the largest count, of equal ones those met
    first. The count of the k-th is found from histograms, so only the ties at the cut-off are ordered,
    and of those only the ones of the conversation in which the cut falls."""
    counts = cut_lineage(counts)
    if counts.count() <= k:
        return counts
    negative = counts.withColumn("_n", -F.col("cnt"))
    kept = _smallest(negative, "_n", k)
    total = kept.count()
    if total <= k:
        return kept.drop("_n")
    last = kept.agg(F.max("_n")).first()[0]
    sure, ties = kept.where(F.col("_n") < last), kept.where(F.col("_n") == last).withColumn("_c", F.col("first.conv_id"))
    wanted = k - sure.count()
    ties = _smallest(ties, "_c", wanted)
    if ties.count() > wanted:
        edge = ties.agg(F.max("_c")).first()[0]
        inside = ties.where(F.col("_c") < edge)
        ties = inside.unionByName(ties.where(F.col("_c") == edge).orderBy("first").limit(wanted - inside.count()))
    return sure.unionByName(ties.drop("_c")).drop("_n")


def vocab(sides: DataFrame, k: int = 50000) -> DataFrame:
    """V1+V2: top-k words get index rank+3; 0/1/2 are reserved."""
    top = top_counts(token_counts(sides), k)
    # the unpartitioned window only sees the k survivors of the top-k (bounded by k)
    ranked = top.withColumn("idx", (F.row_number().over(Window.orderBy(F.desc("cnt"), F.asc("first"))) + 2).cast("bigint"))
    specials = sides.sparkSession.createDataFrame(SPECIALS, "word string, idx bigint")
    return ranked.select("word", "idx").unionByName(specials)


def encode(sides: DataFrame, voc: DataFrame) -> DataFrame:
    """V3: ids in token order; unknown -> 0. ``voc`` is bounded by K: broadcast."""
    ex = sides.select("conv_id", "turn", "side", F.posexplode("toks").alias("pos", "word"))
    ids = ex.join(F.broadcast(voc), "word", "left").withColumn("id", F.coalesce("idx", F.lit(UNK)))
    return ids.groupBy("conv_id", "turn", "side").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def decode(enc: DataFrame, voc: DataFrame) -> DataFrame:
    """Ids up to the first EOS back to words, joined by spaces."""
    ex = enc.select("conv_id", "turn", "side", F.posexplode(T.ids_until_eos(F.col("ids"), EOS)).alias("pos", "idx"))
    inv = F.broadcast(voc.groupBy("idx").agg(F.min("word").alias("word")))
    w = ex.join(inv, "idx", "left")
    return w.groupBy("conv_id", "turn", "side").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
        .alias("text"))


def length_stats(enc: DataFrame) -> DataFrame:
    """T11 + V4: #sentences, max/min/avg length, unk count, total, rate."""
    e = enc.withColumn("n", F.size("ids")).withColumn("u", F.size(F.filter("ids", lambda i: i == UNK)))
    return e.agg(
        F.count(F.lit(1)).alias("n_sent"), F.max("n").cast("bigint").alias("max_len"),
        F.min("n").cast("bigint").alias("min_len"), F.round(F.avg("n"), 6).alias("avg_len"),
        F.sum("u").cast("bigint").alias("unk"), F.sum("n").cast("bigint").alias("total"),
        F.round(F.sum("u") / F.sum("n"), 6).alias("unk_rate"))


def suffix_tag(w: F.Column) -> F.Column:
    """Fixed tagging rule used as the stand-in for a POS tagger."""
    return (F.when(T.is_stop(w), "FUNC").when(w.endswith("ing"), "VBG").when(w.endswith("ed"), "VBD")
            .when(w.endswith("tion"), "NN").when(w.endswith("ly"), "RB").otherwise("X"))


def tag_buckets(sides: DataFrame, voc: DataFrame, top_tags: int = 2) -> DataFrame:
    """V5: per word its top tags (count desc, tag asc), vocab words only -> (tag, slot, word, idx)."""
    ex = sides.select(F.explode("toks").alias("word")).withColumn("tag", suffix_tag(F.col("word")))
    wt = ex.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("cnt"))
    wt = wt.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("cnt"), F.asc("tag"))))
    wt = wt.where(F.col("r") <= top_tags).join(F.broadcast(voc.where(F.col("idx") > EOS)), "word")
    # bounded by K vocabulary words: a per-tag window is safe here
    wt = wt.withColumn("slot", (F.row_number().over(Window.partitionBy("tag").orderBy("idx")) - 1).cast("bigint"))
    wt = wt.withColumn("bucket_size", F.count(F.lit(1)).over(Window.partitionBy("tag")))
    return wt.select("tag", "slot", "bucket_size", "word", "idx")


def tag_replace(sides: DataFrame, buckets: DataFrame, p: float = 0.1, seed: int = 0) -> DataFrame:
    """Each token, with probability p, becomes a uniform word of its tag's
    bucket. Tokens are rows; the drawn ones meet the K-bounded (broadcast)
    bucket tables; each side is re-collected in position order."""
    key = (F.col("conv_id"), F.col("turn"), F.col("side"))
    ex = sides.select(*key, F.posexplode_outer("toks").alias("pos", "word"))
    drawn = D.uniform("tag_rep", seed, *key, F.col("pos")) < F.lit(float(p))
    ex = ex.withColumn("dtag", F.when(drawn, suffix_tag(F.col("word"))))
    sizes = buckets.select(F.col("tag").alias("dtag"), "bucket_size").distinct()
    ex = ex.join(F.broadcast(sizes), "dtag", "left")
    ex = ex.withColumn("slot", F.pmod(D.draw("tag_slot", seed, *key, F.col("pos")), F.col("bucket_size")))
    b = buckets.select(F.col("tag").alias("dtag"), "slot", F.col("word").alias("new"))
    ex = ex.join(F.broadcast(b), ["dtag", "slot"], "left")
    out = ex.groupBy("conv_id", "turn", "side").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "word").alias("w")))), lambda x: x["w"]), " ")
        .alias("text"))
    return out


def scramble(sides: DataFrame, p: float = 0.5, seed: int = 0) -> DataFrame:
    """With probability p (one draw per pair) permute both sides; words
    and their tags move together."""
    s = sides.withColumn("tags", F.transform("toks", suffix_tag))
    hit = D.uniform("scramble", seed, F.col("conv_id"), F.col("turn")) < F.lit(float(p))
    s = barrier(s, _z=F.array_sort(F.transform(F.arrays_zip(F.col("toks").alias("w"), F.col("tags").alias("t")),
                                               lambda x, i: F.struct(D.sort_key("perm", seed, F.col("conv_id"), F.col("turn"),
                                                                                F.col("side"), i).alias("h"),
                                                                     x["w"].alias("w"), x["t"].alias("t")))))
    w = F.when(hit, F.transform("_z", lambda x: x["w"])).otherwise(F.col("toks"))
    t = F.when(hit, F.transform("_z", lambda x: x["t"])).otherwise(F.col("tags"))
    return s.select("conv_id", "turn", "side", F.array_join(w, " ").alias("text"), F.array_join(t, " ").alias("tags"))


def batches(pairs: DataFrame, batch_size: int = 30, seed: int = 0) -> DataFrame:
    """V7: a permutation (hash order of the pair id) of the pairs (conv_id, turn, ...), cut into consecutive
    blocks of ``batch_size``; the last one may be short."""
    pairs = pairs.select("conv_id", "turn").distinct().withColumn("_pid", F.concat_ws(":", "conv_id", "turn"))
    idx = global_index(pairs, [], D.sort_key("batch", seed, F.col("_pid")), "_pid", size_out=None)
    return idx.select("conv_id", "turn", F.floor(F.col("idx") / batch_size).cast("bigint").alias("batch_no"))


def pad_batches(enc: DataFrame, batch_no: DataFrame) -> DataFrame:
    """V8: pad to the batch max, mask 1/0, target = BOS + ids + EOS (width max+2)."""
    e = enc.join(batch_no, ["conv_id", "turn"])
    e = e.withColumn("width", F.max(F.size("ids")).over(Window.partitionBy("batch_no", "side")))
    pad = F.array_repeat(F.lit(0).cast("bigint"), (F.col("width") - F.size("ids")).cast("int"))
    return e.select(
        "conv_id", "turn", "side", "batch_no", F.col("width").cast("bigint").alias("width"),
        F.array_join(F.concat("ids", pad), " ").alias("input"),
        F.array_join(F.concat(F.array_repeat(F.lit(1).cast("bigint"), F.size("ids")), pad), " ").alias("mask"),
        F.array_join(F.concat(F.array(F.lit(BOS).cast("bigint")), "ids", F.array(F.lit(EOS).cast("bigint")), pad), " ")
        .alias("target"))


def word_vectors(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Stand-in vector file: every cleaned corpus word -> embeddings[draw % rows]; vec_id is 0..rows-1."""
    words = docs.select(F.explode(T.split_nonempty(T.clean_letters(F.col("text")))).alias("word")).distinct()
    words = words.withColumn("vec_id", F.pmod(D.draw("vec", 0, F.col("word")), F.lit(max(1, embeddings.count()))))
    return words.join(embeddings.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("word", "vec")


def embedding_init(voc: DataFrame, vectors: DataFrame, dim: int = 64, seed: int = 0) -> DataFrame:
    """V6: the known vector, else uniform in [-sqrt(3/dim), sqrt(3/dim)] per (word, d)."""
    bound = (3.0 / dim) ** 0.5
    j = voc.join(vectors, "word", "left")
    rnd = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (
        (D.uniform("emb_init", seed, F.col("word"), d) * 2.0 - 1.0) * bound).cast("float"))
    return j.select("word", "idx", F.col("vec").isNotNull().alias("known"), F.coalesce("vec", rnd).alias("vec"))


def l2(vec: F.Column) -> F.Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: F.Column, b: F.Column) -> F.Column:
    """sum(a*b)/(|a||b|); NULL when a norm is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"),
                      lambda s, x: s + x)
    den = l2(a) * l2(b)
    return F.when(den > 0, dot / den)


def average_vectors(rows: DataFrame, vectors: DataFrame, dim: int = 64, keys: tuple = ("conv_id", "turn", "side")) -> DataFrame:
    """V9: mean vector over the known tokens of each row of ``toks``. A row's words are counted before
    they meet the vectors, and the sums are ``dim`` plain aggregates: no row per token or dimension."""
    words = rows.select(*keys, F.explode("toks").alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    j = words.join(vectors, "word")
    sums = j.groupBy(*keys).agg(F.sum("n").alias("n_known"), *[
        F.sum(F.col("n") * F.col("vec")[d].cast("double")).alias(f"_s{d}") for d in range(dim)])
    return sums.select(*keys, F.array(*[F.col(f"_s{d}") / F.col("n_known") for d in range(dim)]).alias("avg_vec"),
                       F.col("n_known").cast("bigint").alias("n_known"))
