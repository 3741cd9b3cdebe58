"""Joins and dedup over all documents: brute force, planted cases and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from augmill.llm import decontaminate, jaccard, suffix_dedup
from augmill.llm import components as component_steps
from augmill.llm.common import stored
from augmill.llm.components import components


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def families(seed=3):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = sentence(rng, rng.randint(8, 120)).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    part = {i: i for i in sets}
    find = lambda x: x if part[x] == x else find(part[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components(spark, docs, odd_rows):
    for n, percent in ((3, 90), (5, 80)):
        rows = families() + [(1000 + i, t) for i, t in odd_rows if i is not None]
        got = jaccard.jaccard_components(docs(rows), n, percent).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, percent)
    lone = jaccard.jaccard_components(docs([(None, "a b c"), (3, "a b c"), (None, "d e f")])).collect()
    assert sorted(str(r.component_id) for r in lone) == ["3", "3", "None"]
    assert jaccard.jaccard_components(docs([])).count() == 0


def test_common_ngrams_go_to_their_classes(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 1)
    rows = families(4)
    got = jaccard.jaccard_components(docs(rows), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 90)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted((r for r in set(rows) if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(raw[p : p + length])
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    return out


def test_repeats_are_cut(spark, docs, odd_rows):
    rng = random.Random(5)
    shared = [sentence(rng, 40) for _ in range(4)]
    rows = [(k, " ".join([sentence(rng, rng.randint(0, 30)), rng.choice(shared), sentence(rng, 5), rng.choice(shared)[rng.randint(0, 60):]])) for k in range(60)]
    rows += [(2000 + i, t) for i, t in odd_rows if i is not None] + [(None, shared[0])]
    got = suffix_dedup.remove_repeats(docs(rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: bytes(r.kept) for r in got if r.doc_id is not None} == brute_repeats(rows, 100)
    assert all(r.n_bytes - sum(s.end - s.start for s in r.spans) == len(r.kept) for r in got)
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


def test_merge_is_the_order_of_all_suffixes():
    rng = random.Random(2)
    texts = [sentence(rng, 30)[:150] for _ in range(6)]
    texts += [texts[0], texts[1][20:140]]
    shards = [np.concatenate([np.append(np.frombuffer(t.encode(), np.uint8) + np.uint8(1), np.uint8(0)) for t in texts[k : k + 2]]) for k in range(0, 8, 2)]
    order = suffix_dedup.merged_order(shards, 100)
    base = np.concatenate([[0], np.cumsum([len(s) for s in shards])])
    assert sorted(order.tolist()) == list(range(base[-1]))

    def prefix(p):
        k = int(np.searchsorted(base, p, "right")) - 1
        return np.roll(shards[k], -(p - base[k]))[:100].tobytes()

    keys = [prefix(int(p)) for p in order]
    assert keys == sorted(keys)


def test_hot_seeds_meet_by_window(spark, docs, monkeypatch):
    """With every seed hot, all windows are dealt out one by one; the result is the same."""
    rng = random.Random(8)
    shared = sentence(rng, 60)
    rows = [(k, sentence(rng, 6) + shared[rng.randint(0, 80):] + sentence(rng, 6)) for k in range(30)]
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    got = suffix_dedup.remove_repeats(docs(rows)).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == brute_repeats(rows, 100)


@pytest.mark.parametrize("n_hot", [0, 3])
def test_stretches_do_not_depend_on_the_block(n_hot):
    """A chunk is read in blocks of whole texts; long ones are blocks of their own."""
    rng = random.Random(9)
    texts = [sentence(rng, rng.randint(0, 90)) for _ in range(40)] + ["", sentence(rng, 400)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = suffix_dedup.stretches(data, offs, 100)
    seeds = np.sort(whole[3])[:n_hot]
    want = suffix_dedup._apart(data, offs, 100, seeds)
    parts = []
    for lo, hi in suffix_dedup.chunks(offs, 700):
        row, *rest = suffix_dedup._apart(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], 100, seeds)
        parts.append((row + lo, *rest))
    assert len(parts) > 10
    key = lambda x: sorted(zip(*(c.tolist() for c in x), strict=True))
    assert key([np.concatenate(x) for x in zip(*parts, strict=True)]) == key(want)


def test_windows_of_hot_seeds_count_as_rows(spark, docs, monkeypatch):
    """What a first task gets is planned from the rows that taking hot seeds apart makes, not from the text's length."""
    rng = random.Random(10)
    shared = sentence(rng, 60)
    texts = docs([(k, sentence(rng, 6) + shared + sentence(rng, 6)) for k in range(30)]).select(F.col("doc_id").alias("id"), "text")
    cold = suffix_dedup._hot_seeds(texts, 100)
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    hot, rows = suffix_dedup._hot_seeds(texts, 100)
    assert len(cold[0]) == 0 and len(hot) and rows == suffix_dedup._stretch_rows(texts, 100, hot).count() > 3 * cold[1]


def test_a_family_in_one_task_takes_few_steps(spark, monkeypatch):
    """Links that a task reads are stars before the first step; a small task finds the same components."""
    rng = random.Random(12)
    links = [(k, k + 1) for k in range(300)] + [(5000 + k, 5000 + rng.randrange(90)) for k in range(60)] + [(-7, 9000), (9000, -7), (4, 4)]
    rng.shuffle(links)
    smallest = {}
    for a, b in links:
        both = smallest.get(a, {a}) | smallest.get(b, {b})
        smallest.update(dict.fromkeys(both, both))
    want = {x: min(smallest[x]) for a, b in links if a != b for x in (a, b)}
    tables = []
    monkeypatch.setattr(component_steps, "stored", lambda df, label: tables.append(label) or stored(df, label))
    for size, most in ((1 << 20, 2), (7, 20)):
        monkeypatch.setattr(component_steps, "TASK_LINKS", size)
        tables.clear()
        got = components(spark.createDataFrame(links, "a bigint, b bigint").coalesce(1)).collect()
        assert len(got) == len(want) and {r.id: r.component for r in got} == want
        assert len(tables) <= most


def test_settled_windows_in_a_row_are_one_row(spark, docs):
    """A passage of hot seeds that a task reads many times gives one row per document, not one per window."""
    rng = random.Random(11)
    shared = sentence(rng, 60)
    rows = [(k, shared + " " + sentence(rng, 3)) for k in range(50)] + [(100, shared[:50]), (101, shared + shared)]
    texts = docs(rows).select(F.col("doc_id").alias("id"), "text").coalesce(1)
    hot = np.sort(np.array([r.seed for r in suffix_dedup._stretch_rows(texts, 100, np.empty(0, np.uint64)).collect()], np.int64).view(np.uint64))
    got = [r for r in suffix_dedup._stretch_rows(texts, 100, np.unique(hot)).collect() if r.repeat]
    assert len(got) == 51 and sum(r.windows for r in got if r.id < 100) >= 49 * (len(shared) - 99)


def test_windows_in_a_row_join():
    doc, start, windows = (np.array(x) for x in ([7, 3, 3, 3, 3, 7], [5, 10, 0, 4, 30, 0], [2, 1, 4, 6, 5, 4]))
    assert [x.tolist() for x in suffix_dedup._in_rows(doc, start, windows)] == [[3, 3, 7, 7], [0, 30, 0, 5], [11, 5, 4, 2]]
    assert [len(x) for x in suffix_dedup._in_rows(doc[:0], start[:0], windows[:0])] == [0, 0, 0]


@pytest.mark.parametrize("letters, width", [(2, 8), (30, 3), (200, 2)])
def test_merge_takes_as_many_symbols_as_fit(letters, width):
    rng = np.random.default_rng(3)
    text = rng.integers(1, letters + 1, 200_000).astype(np.uint8)
    text[70_000:71_000] = text[100:1100]
    shards = np.split(text, [60_000, 150_000])
    orders = [suffix_dedup.shard_order(t, 100) for t in shards]
    assert suffix_dedup._ranked([x for _, x in orders])[0] == width
    order = suffix_dedup.merged_order(shards, 100)
    cyclic = [np.concatenate([t, t[:100]]).tobytes() for t in shards]
    base = [0, 60_000, 150_000]
    keys = [cyclic[j][p - base[j] : p - base[j] + 100] for p, j in zip(order.tolist(), (np.searchsorted(base, order, "right") - 1).tolist(), strict=True)]
    assert sorted(order.tolist()) == list(range(200_000)) and all(a <= b for a, b in zip(keys, keys[1:], strict=False))


def test_a_shard_is_sorted_four_times(monkeypatch):
    rng = np.random.default_rng(5)
    text = np.tile(rng.integers(1, 30, 700).astype(np.uint8), 6)  # equal beyond any number of symbols
    calls, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(len(a[0])) or sort(*a, **k))
    monkeypatch.setattr(np, "unique", None)  # hashes every value
    order, first = suffix_dedup.shard_order(text, 100)
    assert len(calls) == 4  # to 8, 24, 72 and 216 symbols
    cyclic = np.concatenate([text, text[:100]]).tobytes()
    keys = [cyclic[p : p + 100] for p in order.tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(text)))
    assert [x[:8] for x in keys] == [int(x).to_bytes(8, "big") for x in first]
    assert suffix_dedup._ranked([first[:0], first, first])[0] == 8


def test_leaks(spark, docs, odd_rows):
    rng = random.Random(4)
    items = [(k, sentence(rng, 12) + ". " + sentence(rng, 8) + ".") for k in range(30)] + [(30, None), (31, ""), (None, sentence(rng, 20))]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(k, sentence(rng, 300) + " " + (items[k % 30][1].upper() if k % 3 == 0 else "") + " " + sentence(rng, 200)) for k in range(60)]
    rows += [(5000 + i, t) for i, t in odd_rows if i is not None] + [(100, items[32][1]), (101, items[0][1].split(".")[0])]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(rows), table).collect()}
    assert got == {(k, k % 30) for k in range(0, 60, 3)} | {(100, None)}  # the question alone isn't a leak
    assert decontaminate.find_leaks(docs([]), table).count() == 0
    assert decontaminate.find_leaks(docs(rows), table.where("false")).count() == 0


def test_leaks_of_long_items(spark, docs):
    rng = random.Random(8)
    long, short = sentence(rng, 1980) + ". " + sentence(rng, 20) + ".", sentence(rng, 15) + ". " + sentence(rng, 5) + "."
    table = spark.createDataFrame([(1, long), (2, short)], "item_id bigint, text string")
    copy = f"{sentence(rng, 333)} {long} {sentence(rng, 50)}"
    half = " ".join(long.split()[:700])  # neither half of the question nor the answer
    rows = [(1, copy), (2, f"{sentence(rng, 90)} {half} {sentence(rng, 90)}"), (3, long), (4, f"{sentence(rng, 70)} {short}")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs(rows), table).collect()}
    assert set(got) == {(1, 1), (3, 1), (4, 2)}
    assert got[1, 1].question_overlap > 0.99 and got[1, 1].answer_overlap == 1.0


def test_passages_across_a_block_edge_are_searched():
    # an item of 4 essential and 30 common words, so that it needs some of both
    common = [f"c{k}" for k in range(30)]
    rare = [f"r{k}" for k in range(4)]
    hashes = {w: decontaminate.text_words(w)[0] for w in (*common, *rare)}
    w = np.array([hashes[x] for x in (*common, *rare)], np.uint64)
    impact = np.array([0.34 / 30] * 30 + [0.66 / 4] * 4)
    idf = np.array([1.0] * 30 + [9.0] * 4)
    order = np.argsort(w)
    text = " ".join([*common, *rare])
    index = decontaminate.Index([7], [text], [(w[order], impact[order], idf[order])])
    copy = [*common, *rare[:3]]  # an edited copy: 0.34 + 0.495
    threshold, step = 0.8, decontaminate.STEP
    for offset in range(2 * step):
        words = [f"x{k}" for k in range(offset)] + copy + [f"y{k}" for k in range(200)]
        rows = [" ".join(f"z{k}" for k in range(45)), " ".join(words)]  # a row before it, whose empty block isn't a passage
        data = np.frombuffer("".join(rows).encode(), np.uint8)
        offs = np.array([0, len(rows[0]), len(data)])
        known = {x: v for x, v in zip((*common, *rare), impact, strict=True)}
        want = max(sum(known.get(x, 0) for x in words[k : k + 2 * step]) for k in range(0, len(words), step))
        got = list(decontaminate._search_rows(index, data, offs, threshold, 0.0))
        assert [(r, i) for r, i, *_ in got] == ([(1, 0)] if want >= threshold else []), offset
        assert not got or abs(got[0][2] - want) < 1e-9, offset


def test_wand_finds_all_above_the_threshold(spark):
    rng = np.random.default_rng(3)
    lists = []
    for _ in range(120):
        w = np.unique(rng.integers(1, 60, 12)).astype(np.uint64)
        x = rng.random(len(w))
        lists.append((w, x / x.sum(), rng.random(len(w))))
    index = decontaminate.Index(list(range(120)), [""] * 120, lists)
    for _ in range(200):
        terms = sorted(set(rng.integers(0, len(index.keys), 25).tolist()))
        words = {int(index.keys[t]) for t in terms}
        want = {k for k, (w, x, _) in enumerate(lists) if sum(v for a, v in zip(w.tolist(), x, strict=True) if a in words) >= 0.5}
        assert {k for k, _ in index.search(terms, 0.5)} == want


def test_repeated_rows_stay_once(spark, docs, sf_dir):
    rng = random.Random(9)
    texts = [sentence(rng, 40) for _ in range(6)]
    rows = [(1, texts[0])] * 3 + [(2, texts[1]), (2, texts[2]), (2, texts[1])] + [(3, texts[0])] + [(4, None)] * 2 + [(None, texts[5])] * 2
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs(rows), sf_dir).collect()]
    want = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (4, None), (None, texts[5]), (None, texts[5])]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test")
        assert after.columns == corpus_pipeline.COLUMNS and 0 < after.count() <= docs.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
