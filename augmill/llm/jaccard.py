"""Exact Jaccard links between the n-gram sets of documents, by a token-group matrix.

1. Every text becomes its set of hashed word n-grams; texts with equal sets are one class
   from here on, represented by the smallest id.
2. Linked sets differ in at most d = n - ceil(t n) n-grams of either. Of every set a hashed
   sample of all n-grams, twice that share, is listed (and if it has no more than d, the
   next by hash, up to d + 1). An n-gram of the sample that no other class lists is in no
   other class, so a class with more than d such n-grams links with nothing and is done.
   The others have *leading* n-grams: their first d + 1 in the order of the sample, rarest
   first, then the rest by hash. Linked classes share a leading n-gram.
3. Such classes are partitioned into groups of about ``GROUP`` members by their most
   common leading n-gram; a larger group is dealt out by hash. The token-group matrix says
   which leading n-grams occur in which group; each group also has the union of its members'
   n-grams.
4. Members of a group are compared with each other. Then classes are queries to the other
   groups that the matrix names: the overlap with the group's union bounds the overlap with
   any member, and only a group whose bound reaches the threshold is opened. For each n-gram
   the matrix also holds the largest component among the group's members that lead with it.
   First one class of each component asks the groups of the largest components, which joins
   the pieces of a family of copies; then one class of each component asks all groups with
   a larger component; then every class does. A pair that is connected already isn't
   compared and the smaller component asks, so that a family of m copies costs about m
   comparisons; no pair between different components that can link is left out.
5. Links make components (``components.py``).

Groups that many classes ask are split by hash of the asking class.

Edge cases: a null or empty text, or one without words, has an empty set and is a
component of its own; a text of fewer than n words has its whole sequence as one n-gram;
repeated rows are in one class and each gives a row; a row with a null id belongs to the
component of the equal set that has an id, else to none (null); an empty table gives an
empty table. Only id and text are read, so other columns may clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augmill.sources.tables import load, spread

from .common import BLOCK_BYTES, SpanHash, byte_values, chunks, discard, mix, runs, stored, text_buffer
from .components import components
from .registry import register

GROUP = 512
ASKING = 1_000
#: Listed n-grams that a task gets, about.
TASK_NGRAMS = 250_000
#: An n-gram that more than so many of a sample of so many classes list is common, and the number of classes it counts as.
COMMON, SAMPLE, MOST_CLASSES = 200, 20_000, 1 << 60
#: Candidate classes up to which their ids (8 bytes each) are broadcast to the scan of the texts.
BROADCAST_IDS = 2_000_000
#: Meetings of classes and groups (about 50 bytes each) up to which they are broadcast to the scan of the sets.
BROADCAST_ROWS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_VALUES = byte_values(5)


def ngram_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of the distinct n-grams of each row, ascending."""
    start, end, row = runs(_WORD[data], offs)
    h = SpanHash(_LOWER[data], _VALUES)(start, end)
    words = np.bincount(row, minlength=len(offs) - 1)
    first = np.cumsum(words) - words
    full = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.empty(0, np.int64)
    g = np.zeros(len(full), np.uint64)
    for k in range(n):
        g = mix(g + h[full + k])
    short = np.flatnonzero((words > 0) & (words < n))
    few = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        has = words[short] > k
        few[has] = mix(few[has] + h[first[short[has]] + k])
    few = mix(few + np.uint64(n))
    g, r = np.concatenate([g, few]), np.concatenate([row[full], short])
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return r[new], g[new]


def _sampled(percent: int) -> int:
    """N-grams whose hash modulo 100 is below this are the sample."""
    return min(100, 2 * (100 - percent))


def _describe(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, n, s1, s2, listed): size, digest and listed n-grams of every row's set."""
    limit = np.uint64(_sampled(percent))

    def work(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for lo, hi in chunks(offs, BLOCK_BYTES):
                r, g = ngram_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n)
                size = np.bincount(r, minlength=hi - lo)
                at = np.concatenate([[0], np.cumsum(size)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g ^ np.uint64(x)))]) for x in (11, 12345678901)]
                s1, s2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                inside = g % np.uint64(100) < limit
                sampled = np.bincount(r[inside], minlength=hi - lo)
                spare = size - -(-percent * size // 100)  # d
                before = np.concatenate([[0], np.cumsum(~inside)])
                nth = before[:-1] - before[at[:-1]][r]  # place among the row's others; they ascend by hash
                keep = inside | (nth < (spare + 1 - sampled)[r])
                listed = np.bincount(r[keep], minlength=hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(listed)]), pa.int32()), pa.array(g[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(s1), pa.array(s2), lists],
                                                 names=["id", "n", "s1", "s2", "listed"])

    return texts.mapInArrow(work, "id bigint, n bigint, s1 bigint, s2 bigint, listed array<bigint>")


def _representatives(rows: DataFrame) -> DataFrame:
    """(id, n, listed): one row of every class, that with the smallest id."""
    least = rows.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("id"))
    one = rows.join(least, ["s1", "s2", "id"], "left_semi")
    twice = rows.where("n > 0 AND id IS NOT NULL").groupBy("id").count().where("count > 1")
    return (one.dropDuplicates(["id"]) if twice.head(1) else one).select("id", "n", "listed")


def _common(classes: DataFrame) -> np.ndarray:
    """N-grams that more than ``COMMON`` of a hashed sample of about ``SAMPLE`` classes list, ascending."""
    every = max(1, classes.count() // SAMPLE)
    lists = classes.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.explode("listed").alias("g"))
    many = lists.groupBy("g").count().where(F.col("count") > COMMON)
    return np.sort(many.select("g").toPandas()["g"].to_numpy(np.int64))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Ids and sizes of the rows, and (row, n-gram) of what they list."""
    col = batch.column(2)
    size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    return ids, n, np.repeat(np.arange(len(ids)), size), col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(task: np.ndarray, *values: np.ndarray) -> pa.RecordBatch | None:
    """One row per task with the values that go to it, as bytes."""
    if not len(task):
        return None
    order = np.argsort(task, kind="stable")
    first = np.flatnonzero(np.diff(task[order], prepend=-1))
    cols = [pa.array([x.tobytes() for x in np.split(v[order], first[1:])], pa.binary()) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(task[order][first]), *cols], names=["task", *"abc"[: len(values)]])


def _bucket(x: np.ndarray, tasks: int) -> np.ndarray:
    return (mix(x.view(np.uint64)) % np.uint64(tasks)).astype(np.int64)


def _leading(classes: DataFrame, percent: int) -> DataFrame:
    """(id, n, g, classes): the leading n-grams of candidate classes that other classes list too.

    Lists are dealt out by n-gram, which finds those of several classes, and what is shared by
    class. Common n-grams are shared for certain; they count as the most frequent ones and go
    to their classes at once, so that none of them gathers in a task.
    """
    limit = np.uint64(_sampled(percent))
    sent = classes.sparkSession.sparkContext.broadcast(_common(classes))
    listed = classes.agg(F.sum(F.size("listed").cast("bigint"))).first()[0] or 0
    tasks = max(1, -(-listed // TASK_NGRAMS))

    def is_common(g):
        common = sent.value
        return common[np.minimum(np.searchsorted(common, g), len(common) - 1)] == g if len(common) else np.zeros(len(g), bool)

    def by_ngram(batches):
        for batch in batches:
            ids, _, row, g = _flat(batch)
            rare = ~is_common(g)
            if out := _packed(_bucket(g[rare], tasks), ids[row[rare]], g[rare]):
                yield out

    def shared(part: pd.DataFrame) -> pd.DataFrame:
        ids, g = (np.frombuffer(b"".join(part[c]), np.int64) for c in "ab")
        order = np.argsort(g, kind="stable")
        ids, g = ids[order], g[order]
        begin = np.flatnonzero(np.diff(g, prepend=~g[:1]))
        size = np.diff(np.append(begin, len(g)))
        many = np.repeat(size, size)
        out = _packed(_bucket(ids[many > 1], tasks), ids[many > 1], g[many > 1], many[many > 1])
        return out.to_pandas() if out else pd.DataFrame({"task": pd.Series(dtype="int64"), "a": [], "b": [], "c": []})

    def by_class(batches):
        """Sizes, as (id, n, -1 - listed n-grams of the sample), and common n-grams."""
        for batch in batches:
            ids, n, row, g = _flat(batch)
            inside = np.bincount(row[g.view(np.uint64) % np.uint64(100) < limit], minlength=len(ids))
            hot = is_common(g)
            a = np.concatenate([ids, ids[row[hot]]])
            if out := _packed(_bucket(a, tasks), a, np.concatenate([n, g[hot]]),
                              np.concatenate([-1 - inside, np.full(hot.sum(), MOST_CLASSES)]).astype(np.int64)):
                yield out

    def chosen(part: pd.DataFrame) -> pd.DataFrame:
        ids, g, classes = (np.frombuffer(b"".join(part[c]), np.int64) for c in "abc")
        sizes = classes < 0
        own = np.argsort(ids[sizes])
        own_id, n, every = ids[sizes][own], g[sizes][own], (-1 - classes[sizes])[own]
        at, g, classes = np.searchsorted(own_id, ids[~sizes]), g[~sizes], classes[~sizes]
        sampled = g.view(np.uint64) % np.uint64(100) < limit
        alone = every - np.bincount(at[sampled], minlength=len(own_id))
        spare = n - -(-percent * n // 100)
        order = np.lexsort((g, classes, ~sampled, at))
        at, g, classes, sampled = at[order], g[order], classes[order], sampled[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = (alone <= spare)[at] & (~sampled | (place < (spare + 1 - alone)[at]))
        return pd.DataFrame({"id": own_id[at[keep]], "n": n[at[keep]], "g": g[keep], "classes": classes[keep]})

    packed = "task bigint, a binary, b binary, c binary"
    found = classes.mapInArrow(by_ngram, "task bigint, a binary, b binary").groupBy("task").applyInPandas(shared, packed)
    return classes.mapInArrow(by_class, packed).unionByName(found).groupBy("task").applyInPandas(
        chosen, "id bigint, n bigint, g bigint, classes bigint")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(id, grams binary): the sorted n-grams of every row."""

    def work(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for lo, hi in chunks(offs, BLOCK_BYTES):
                r, g = ngram_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n)
                cut = np.cumsum(np.bincount(r, minlength=hi - lo))[:-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in np.split(g, cut)], pa.binary())],
                                                 names=["id", "grams"])

    return texts.mapInArrow(work, "id bigint, grams binary")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    x, y = len(a), len(b)
    if 100 * min(x, y) < percent * max(x, y):
        return False
    both = _overlap(a, b)
    return 100 * both >= percent * (x + y - both)


def _inside(percent: int):
    """Links among the members of a group: a spanning forest of its components."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids, sets = part["id"].tolist(), [np.frombuffer(x, np.uint64) for x in part["grams"]]
        pieces: list[list[int]] = []
        out = []
        for i in range(len(ids)):
            near = [p for p in pieces if any(_linked(sets[i], sets[j], percent) for j in p)]
            out += [(ids[p[0]], ids[i]) for p in near]
            pieces = [p for p in pieces if not any(p is q for q in near)] + [sorted([*(j for p in near for j in p), i])]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return work


def _asked(percent: int):
    """Links between classes that ask a group and its members of other components."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        members, asking, out = part[~part["asks"]], part[part["asks"]], []
        if len(members) and len(asking):
            sets = [np.frombuffer(x, np.uint64) for x in members["grams"]]
            union = np.unique(np.concatenate(sets))
            ids, comps = members["id"].tolist(), members["comp"].tolist()
            for x, comp, raw in zip(asking["id"].tolist(), asking["comp"].tolist(), asking["grams"], strict=True):
                own = np.frombuffer(raw, np.uint64)
                if 100 * _overlap(own, union) < percent * len(own):
                    continue  # no member can have enough
                met = {comp}
                for i, c, other in zip(ids, comps, sets, strict=True):
                    if c not in met and _linked(own, other, percent):
                        met.add(c)
                        out.append((x, i))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return work


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): every row, with the smallest id that links of at least
    ``percent`` per cent reach."""
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(_describe(texts, n, percent), "ngram-rows")
    shared = stored(_leading(_representatives(rows), percent), "leads")
    # the listed n-grams have done their work: from here on the digests are enough
    every, rows = rows, stored(rows.select("id", "n", "s1", "s2"), "ngram-digests")
    discard(every)

    # groups of candidate classes
    member = shared.groupBy("id").agg(F.max(F.struct("classes", "g"))["g"].alias("key"), F.max("n").alias("n"))
    size = member.groupBy("key").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    member = stored(member.join(size, "key").select("id", "n", "key", F.pmod(F.xxhash64("id"), "parts").alias("part")), "members")
    ids = member.select("id")
    wanted = texts.where("id IS NOT NULL").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    sets = stored(_sets(wanted, n).dropDuplicates(["id"]) if _repeated(member, wanted) else _sets(wanted, n), "ngram-sets")
    group = ["key", "part"]

    links = stored(member.join(sets, "id").groupBy(*group).applyInPandas(_inside(percent), "a bigint, b bigint"), "links")
    # an n-gram of one group names no other
    named = shared.select("id", "g").join(member.select("id", *group), "id").select("g", *group).distinct()
    several = named.groupBy("g").agg(F.count("*").alias("groups")).where("groups > 1").select("g")
    every, shared = shared, stored(shared.join(several, "g"), "leads")
    discard(every)
    asked = None
    for step in ("largest", "pieces", "all"):
        comp = components(links)
        now = member.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        weight = now.groupBy("comp").agg(F.count("*").alias("weight"))
        now = stored(now.join(weight, "comp").withColumn("rank", F.struct("weight", "comp")).drop("weight"), "components")
        held = shared.select("id", "g").join(now, "id")
        matrix = held.groupBy("g", *group).agg(F.max("rank").alias("top"), F.min("n").alias("least"), F.max("n").alias("most"))
        largest = matrix.groupBy("g").agg(F.max(F.struct("top", *group, "least", "most")).alias("x")).select("g", "x.*")
        asks = held.withColumnsRenamed({"key": "own_key", "part": "own_part"})
        if step != "all":
            asks = asks.groupBy("g", "comp").agg(F.min(F.struct("id", "own_key", "own_part", "n", "rank")).alias("x")).select("g", "comp", "x.*")
        # of two components the smaller asks, so a family of copies asks nobody but larger ones
        asks = asks.join(largest.select("g", F.col("top").alias("limit")), "g").where("rank < limit").drop("limit")
        pairs = asks.join(largest if step == "largest" else matrix, "g").where(
            "rank < top AND (key <> own_key OR part <> own_part)"
            f" AND 100 * most >= {percent} * n AND 100 * n >= {percent} * least")
        pairs = pairs.select("id", "comp", *group).distinct() if step == "all" else (
            pairs.groupBy("comp", *group).agg(F.min("id").alias("id")).select("id", "comp", *group))
        if asked is not None:  # what a class has asked a group is settled for good
            pairs = pairs.join(asked, ["id", *group], "left_anti").select("id", "comp", *group)
        pairs = stored(pairs, "asks")
        asked = pairs.select("id", *group) if asked is None else asked.unionByName(pairs.select("id", *group))
        load_ = pairs.groupBy(*group).agg(F.ceil(F.count("*") / ASKING).alias("shares"))
        asking = pairs.join(load_, group).withColumn("share", F.pmod(F.xxhash64("id"), "shares")).drop("shares")
        members = now.join(load_, group).select(
            "id", "comp", *group, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"))
        by = [*group, "share"]
        # who meets where is short: where it can be broadcast, the sets move once, to where they meet
        both = stored(members.select(*by, "id", "comp", F.lit(False).alias("asks")).unionByName(
            asking.select(*by, "id", "comp", F.lit(True).alias("asks"))), "meetings")
        met = sets.join(F.broadcast(both) if both.count() <= BROADCAST_ROWS else both, "id")
        found = met.groupBy(*by).applyInPandas(_asked(percent), "a bigint, b bigint")
        # the stars of the components say all that their links did
        before, links = links, stored(comp.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found), "links")
        for table in (before, now, both):
            discard(table)

    comp = components(links)
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("id")).join(comp, "id", "left").select(
        "s1", "s2", F.coalesce("component", "id").alias("component_id"))
    return rows.select("id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _repeated(member: DataFrame, wanted: DataFrame) -> bool:
    """Whether some candidate id has several rows."""
    return wanted.select("id").count() > member.count()


@register("op5_jaccard")
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(load(spark, sf_dir, "documents"), "doc_id"), 3, 90)
