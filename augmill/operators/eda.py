"""A1-A5 EDA: synonym replacement, random insertion, random swap, random
deletion, and their combination.

Plan: the row's tokens are joined with the synonym table once (shuffle on
word, or a broadcast when AQE finds the table small) and re-collected in
order into ``syn_at``, aligned with the words (shuffle on src_id, bounded by
the row's length). Every technique is then row-local: array higher-order
functions over the row's words with positional access, and hash draws keyed
by (src_id, candidate, position).
Intermediates that a lambda reads are put behind a one-row Generate
(:func:`barrier`) so Catalyst does not re-evaluate them per element.

Deviations from the reference (documented): insert positions and drawn words
refer to the original word list; swaps use 2n distinct positions paired up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augmill.functions import draws as D
from augmill.functions import text as T
from augmill.operators.common import barrier, fan_out

TECHS = ["sr", "ri", "rs", "rd"]


def cleaned(df: DataFrame) -> DataFrame:
    """(src_id, text, label) -> + ctext, words, n."""
    rows = df.select("src_id", "text", "label").withColumn("ctext", T.clean_letters(F.col("text")))
    return rows.withColumn("words", T.split_nonempty(F.col("ctext"))).withColumn("n", F.size("words").cast("bigint"))


def prepare(df: DataFrame, syn: DataFrame) -> DataFrame:
    """(src_id, text, label) -> + ctext, words, n, syn_at.

    ``syn_at`` is aligned with ``words``: the synonym list of the word at each
    position, or NULL. It comes from one token-level join with the synonym
    table and one ordered re-collect per row, so the techniques read synonyms
    by position in O(1) instead of scanning a per-row map (Spark map lookups
    are linear scans)."""
    rows = cleaned(df)
    toks = rows.select("src_id", F.posexplode("words").alias("pos", "word"))
    aligned = (
        toks.join(syn.select("word", "syns"), "word", "left")
        .groupBy("src_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "syns"))), lambda x: x["syns"]).alias("syn_at"))
    )
    return rows.join(aligned, "src_id", "left")


def _gated(gate, expr):
    return expr if gate is None else F.when(gate, expr)


def _n_of(alpha: float) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(float(alpha)) * F.col("n")).cast("bigint"))


def synonym_replacement(df: DataFrame, alpha: float, seed: int, out: str = "new_words", gate=None) -> DataFrame:
    """A1: the n first (by hash) distinct non-stop words that have synonyms are
    replaced everywhere by one hash-drawn synonym each. The n-th smallest word
    hash is a threshold, so each position decides on its own (linear)."""
    key = (F.col("src_id"), F.col("cand"))
    pairs = F.arrays_zip(F.col("words").alias("w"), F.col("syn_at").alias("s"))
    cand_h = F.array_sort(F.array_distinct(F.transform(
        F.filter(pairs, lambda x: (~T.is_stop(x["w"])) & x["s"].isNotNull()),
        lambda x: D.sort_key("sr", seed, *key, x["w"]))))
    df = barrier(df, _thr=_gated(gate, F.when(F.size(cand_h) > 0, F.element_at(
        cand_h, F.least(F.size(cand_h), _n_of(alpha).cast("int"))))))
    new = F.transform(pairs, lambda x: F.when(
        x["s"].isNotNull() & ~T.is_stop(x["w"]) & (D.sort_key("sr", seed, *key, x["w"]) <= F.col("_thr")),
        F.element_at(x["s"], (F.pmod(D.draw("sr_pick", seed, *key, x["w"]), F.size(x["s"])) + 1).cast("int")))
        .otherwise(x["w"]))
    new = F.flatten(F.transform(new, lambda x: F.split(x, " ")))
    return df.withColumn(out, _gated(gate, new)).drop("_thr")


def random_insertion(df: DataFrame, alpha: float, seed: int, out: str = "new_words", gate=None) -> DataFrame:
    """A2: n insertions; each tries up to 9 drawn words for one with synonyms
    and inserts its first synonym before a drawn original position."""
    key = (F.col("src_id"), F.col("cand"))
    n = F.col("n")

    def found(k):
        tries = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda d: F.element_at(
            "syn_at", (F.pmod(D.draw("ri_word", seed, *key, k, d), n) + 1).cast("int")))
        return F.get(F.get(F.filter(tries, lambda s: s.isNotNull()), 0), 0)

    df = barrier(df, _ins=_gated(gate, F.filter(F.transform(
        F.sequence(F.lit(1), _n_of(alpha).cast("int")),
        lambda k: F.struct(F.pmod(D.draw("ri_idx", seed, *key, k), n).alias("p"), F.lit(0).alias("o"),
                           k.cast("bigint").alias("k"), found(k).alias("w"))),
        lambda x: x["w"].isNotNull())))
    orig = F.transform("words", lambda w, j: F.struct(j.cast("bigint").alias("p"), F.lit(1).alias("o"),
                                                        F.lit(0).cast("bigint").alias("k"), w.alias("w")))
    new = F.transform(F.array_sort(F.concat(orig, F.col("_ins"))), lambda x: x["w"])
    return df.withColumn(out, _gated(gate, new)).drop("_ins")


def random_swap(df: DataFrame, alpha: float, seed: int, out: str = "new_words", gate=None) -> DataFrame:
    """A3: the first 2n positions of a hash order are swapped pairwise; rows of
    fewer than two words are unchanged. One sort builds the whole permutation
    (position -> source position), so lookups are positional, O(n log n)."""
    key = (F.col("src_id"), F.col("cand"))
    df = barrier(df, _srt=_gated(gate, F.array_sort(F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(0).cast("bigint"))),
        lambda i: F.struct(D.sort_key("rs", seed, *key, i).alias("h"), i.alias("i"))))))
    two_n = (F.lit(2) * _n_of(alpha)).cast("int")
    perm = F.transform("_srt", lambda x, r: F.struct(x["i"].alias("pos"), F.when(
        r < two_n, F.try_element_at("_srt", F.when(r % 2 == 0, r + 2).otherwise(r).cast("int"))["i"])
        .otherwise(x["i"]).alias("src")))
    df = barrier(df, _perm=_gated(gate, F.transform(F.array_sort(perm), lambda x: x["src"])))
    swapped = F.transform("words", lambda w, j: F.element_at("words", (F.element_at("_perm", j + 1) + 1).cast("int")))
    return df.withColumn(out, _gated(gate, F.when(F.col("n") < 2, F.col("words")).otherwise(swapped))).drop("_srt", "_perm")


def random_deletion(df: DataFrame, p: float, seed: int, out: str = "new_words", gate=None) -> DataFrame:
    """A4: keep each word when its draw is > p; all dropped -> one drawn word;
    one-word rows unchanged."""
    key = (F.col("src_id"), F.col("cand"))
    df = barrier(df, _kept=_gated(gate, F.filter("words", lambda w, i: D.above(float(p), "rd", seed, *key, i))))
    pick = F.array(F.element_at("words", (F.pmod(D.draw("rd_pick", seed, *key), F.col("n")) + 1).cast("int")))
    new = (F.when(F.col("n") == 1, F.col("words"))
           .when(F.size("_kept") == 0, pick).otherwise(F.col("_kept")))
    return df.withColumn(out, _gated(gate, new)).drop("_kept")


TECH_FN = {"sr": synonym_replacement, "ri": random_insertion, "rs": random_swap, "rd": random_deletion}


def single_technique(df: DataFrame, syn: DataFrame | None, tech: str, naug: int = 2, alpha: float = 0.1,
                     seed: int = 1) -> DataFrame:
    """A1-A4 alone: ``naug`` copies of every row with at least one word. Swap and deletion ("rs", "rd")
    take no synonyms and stay row-local, so they run on streams too."""
    base = (prepare(df, syn) if tech in ("sr", "ri") else cleaned(df)).where(F.col("n") > 0)
    c = fan_out(base, naug).withColumnRenamed("copy_no", "cand")
    c = TECH_FN[tech](c, alpha, seed)
    return c.select("src_id", F.lit(f"eda_{tech}").alias("technique"), F.col("cand").alias("copy_no"),
                    F.array_join("new_words", " ").alias("text"), "label", F.lit(False).alias("is_original"))


def eda(df: DataFrame, syn: DataFrame, naug: int = 8, alpha_sr: float = 0.1, alpha_ri: float = 0.1,
        alpha_rs: float = 0.1, p_rd: float = 0.1, seed: int = 1) -> DataFrame:
    """A5: int(naug/4)+1 candidates per technique, naug of them kept (hash
    order), each re-cleaned; the cleaned original is appended; blank rows dropped."""
    m = int(naug / 4) + 1
    params = {"sr": alpha_sr, "ri": alpha_ri, "rs": alpha_rs, "rd": p_rd}
    enabled = [t for t in TECHS if params[t] > 0]
    n_cand = m * len(enabled)
    base = prepare(df.where(T.not_blank(F.col("text"))), syn)
    orig = base.select("src_id", F.lit("eda").alias("technique"), F.lit(0).cast("bigint").alias("copy_no"),
                       F.col("ctext").alias("text"), "label", F.lit(True).alias("is_original"))
    if not enabled or naug <= 0:  # nothing to draw from: the cleaned originals alone
        return orig.where(T.not_blank(F.col("text")))
    n_kept = int(naug) if naug >= 1 else n_cand
    picks = F.slice(F.array_sort(F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(n_cand - 1).cast("bigint")),
        lambda c: F.struct(D.sort_key("eda_pick", seed, F.col("src_id"), c).alias("h"), c.alias("c")))), 1, n_kept)
    cands = base.where(F.col("n") > 0).select("*", F.posexplode(picks).alias("pos", "pk"))
    if naug < 1:  # not a number of copies but the expected one: each candidate is kept with an equal chance
        cands = cands.where(D.uniform("eda_keep", seed, F.col("src_id"), F.col("pk.c")) < naug / n_cand)
    cands = cands.select("*", F.col("pk.c").alias("cand"), (F.col("pos") + 1).cast("bigint").alias("copy_no"))
    # one pass: every technique's intermediates are gated by CASE WHEN on the
    # candidate's technique, so each row computes only its own technique
    tech_of = (F.col("cand") / F.lit(m)).cast("bigint")
    outs = []
    for t_i, tech in enumerate(enabled):
        cands = TECH_FN[tech](cands, params[tech], seed, out=f"_new_{tech}", gate=tech_of == t_i)
        outs.append(f"_new_{tech}")
    aug = cands.select("src_id", "copy_no", "label", F.coalesce(*outs).alias("new_words"))
    aug = aug.select("src_id", F.lit("eda").alias("technique"), "copy_no",
                     T.clean_letters(F.array_join("new_words", " ")).alias("text"), "label",
                     F.lit(False).alias("is_original"))
    return orig.unionByName(aug).where(T.not_blank(F.col("text")))


# DuckDB twin ------------------------------------------------------------------

def _dd(purpose, seed, *parts):
    return D.sql_draw(purpose, seed, *parts)


def _nof(alpha):
    return f"greatest(1, CAST(floor({alpha}::DOUBLE * n) AS BIGINT))"


def duck_prepare(source: str, syn: str) -> str:
    cl = T.duck_clean_letters("text")
    return f"""r AS (SELECT src_id, text, label, ctext, words, len(words)::BIGINT AS n FROM (
      SELECT src_id, text, label, {cl} AS ctext,
             list_filter(string_split({cl}, ' '), lambda x: x <> '') AS words FROM {source})),
  hits AS (SELECT x.src_id, map_from_entries(list({{'k': x.word, 'v': s.syns}})) AS smap
      FROM (SELECT DISTINCT src_id, word FROM (SELECT src_id, unnest(words) AS word FROM r)) x
      JOIN {syn} s ON x.word = s.word GROUP BY x.src_id),
  p AS (SELECT r.*, hits.smap FROM r LEFT JOIN hits ON r.src_id = hits.src_id)"""


def duck_tech(tech: str, alpha: float, seed: int):
    """Stages of the technique over (src_id, cand, words, n, smap): a list of
    (column, expression) computed one CTE after another, the last one being
    ``new_words``. Staging keeps per-row lists out of per-word lambdas."""
    stop = T.duck_str_list(T.STOP_WORDS)
    if tech == "sr":
        chosen = (f"list_sort(list_transform(list_filter(list_distinct(words), lambda w: NOT list_contains({stop}, w) "
                  f"AND smap[w] IS NOT NULL), lambda w: {{'h': {D.sql_sort_key('sr', seed, 'src_id', 'cand', 'w')}, "
                  f"'w': w}}))[1:{_nof(alpha)}]")
        repl = (f"map_from_entries(list_transform(_chosen, lambda x: {{'k': x.w, 'v': smap[x.w][1 + "
                f"({_dd('sr_pick', seed, 'src_id', 'cand', 'x.w')} % len(smap[x.w]))]}}))")
        new = ("flatten(list_transform(list_transform(words, lambda w: coalesce(_repl[w], w)), "
               "lambda x: string_split(x, ' ')))")
        return [("_chosen", chosen), ("_repl", repl), ("new_words", new)]
    if tech == "ri":
        found = (f"list_filter(list_transform(range(1, 10), lambda d: smap[words[1 + "
                 f"({_dd('ri_word', seed, 'src_id', 'cand', 'k', 'd')} % n)]]), lambda s: s IS NOT NULL)[1][1]")
        ins = (f"list_filter(list_transform(range(1, {_nof(alpha)} + 1), lambda k: {{'p': "
               f"{_dd('ri_idx', seed, 'src_id', 'cand', 'k')} % n, 'o': 0, 'k': k::BIGINT, 'w': {found}}}), "
               f"lambda x: x.w IS NOT NULL)")
        orig = "list_transform(words, lambda w, j: {'p': (j - 1)::BIGINT, 'o': 1, 'k': 0::BIGINT, 'w': w})"
        return [("_ins", ins), ("new_words", f"list_transform(list_sort(list_concat({orig}, _ins)), lambda x: x.w)")]
    if tech == "rs":
        srt = (f"list_sort(list_transform(range(0, n), lambda i: {{'h': "
               f"{D.sql_sort_key('rs', seed, 'src_id', 'cand', 'i')}, 'i': i}}))")
        perm = (f"list_transform(list_sort(list_transform(_srt, lambda x, r: {{'pos': x.i, 'src': CASE WHEN r - 1 < "
                f"2 * {_nof(alpha)} THEN _srt[CASE WHEN (r - 1) % 2 = 0 THEN r + 1 ELSE r - 1 END].i ELSE x.i END}})), "
                f"lambda x: x.src)")
        new = "CASE WHEN n < 2 THEN words ELSE list_transform(words, lambda w, j: words[_perm[j] + 1]) END"
        return [("_srt", srt), ("_perm", perm), ("new_words", new)]
    if tech == "rd":
        kept = f"list_filter(words, lambda w, i: {D.sql_uniform('rd', seed, 'src_id', 'cand', 'i - 1')} > {alpha}::DOUBLE)"
        new = (f"CASE WHEN n = 1 THEN words WHEN len(_kept) = 0 THEN "
               f"[words[1 + ({_dd('rd_pick', seed, 'src_id', 'cand')} % n)]] ELSE _kept END")
        return [("_kept", kept), ("new_words", new)]
    raise ValueError(tech)


def duck_stages(rel: str, stages, prefix: str) -> tuple[str, str]:
    """CTE text applying ``stages`` to ``rel``; returns (ctes, last name)."""
    ctes, prev = [], rel
    for k, (col, expr) in enumerate(stages):
        name = f"{prefix}{k}"
        ctes.append(f"{name} AS (SELECT *, {expr} AS {col} FROM {prev})")
        prev = name
    return ",\n  ".join(ctes), prev


def duck_single_technique(source: str, syn: str, tech: str, naug: int = 2, alpha: float = 0.1, seed: int = 1) -> str:
    ctes, last = duck_stages("c", duck_tech(tech, alpha, seed), "s")
    return f"""WITH {duck_prepare(source, syn)},
  c AS (SELECT p.*, unnest(range(1, {naug + 1})) AS cand FROM p WHERE n > 0),
  {ctes}
  SELECT src_id, 'eda_{tech}' AS technique, cand AS copy_no, array_to_string(new_words, ' ') AS text,
         label, false AS is_original FROM {last}"""


def duck_eda(source: str, syn: str, naug: int = 8, alpha: float = 0.1, seed: int = 1) -> str:
    m = naug // 4 + 1
    n_cand = 4 * m
    picks = (f"list_sort(list_transform(range(0, {n_cand}), lambda c: {{'h': "
             f"{D.sql_sort_key('eda_pick', seed, 'src_id', 'c')}, 'c': c}}))[1:{naug}]")
    src = f"(SELECT * FROM {source} WHERE {T.duck_not_blank('text')})"
    stage_ctes, branches = [], []
    for i, t in enumerate(TECHS):
        ctes, last = duck_stages(f"(SELECT * FROM c WHERE cand // {m} = {i})", duck_tech(t, alpha, seed), f"{t}_")
        stage_ctes.append(ctes)
        branches.append(f"SELECT src_id, copy_no, label, new_words FROM {last}")
    stage_ctes = ",\n  ".join(stage_ctes)
    branches = " UNION ALL ".join(branches)
    return f"""WITH {duck_prepare(src, syn)},
  c AS (SELECT * EXCLUDE (pk), pk.c AS cand FROM (
      SELECT p.*, unnest({picks}) AS pk, generate_subscripts({picks}, 1)::BIGINT AS copy_no FROM p WHERE n > 0)),
  {stage_ctes},
  aug AS ({branches})
  SELECT * FROM (
    SELECT src_id, 'eda' AS technique, 0::BIGINT AS copy_no, ctext AS text, label, true AS is_original FROM p
    UNION ALL
    SELECT src_id, 'eda' AS technique, copy_no, {T.duck_clean_letters("array_to_string(new_words, ' ')")} AS text,
           label, false AS is_original FROM aug)
  WHERE {T.duck_not_blank('text')}"""
