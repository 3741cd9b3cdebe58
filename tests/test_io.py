"""Sources and sinks (S-rows) on small files written to the test's own folder."""

import pytest

from augmill.sources import files as FS


def test_labelled_csv_bom_crlf_quotes(spark, tmp_path):
    p = tmp_path / "data.csv"
    p.write_bytes("﻿text,label\r\n\"say \"\"hi\"\", ok\",1\r\n\"two\nlines\",0\r\n,2\r\n".encode("utf-8"))
    rows = FS.read_labelled_csv(spark, str(p)).collect()
    assert [r.text for r in rows] == ['say "hi", ok', "two\nlines", None]
    assert [r.label for r in rows] == ["1", "0", "2"]


def test_labelled_csv_missing_column(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("sentence,label\nx,1\n")
    with pytest.raises(ValueError):
        FS.read_labelled_csv(spark, str(p))


def test_tsv_fields_rejects(spark, tmp_path):
    p = tmp_path / "pairs.tsv"
    p.write_text("A b\tC d\nonly one field\n\nx\ty\tz\n")
    good, bad = FS.read_tsv_fields(spark, str(p), 2, lower=True)
    assert [(r.f1, r.f2) for r in good.collect()] == [("a b", "c d")]
    assert bad.count() == 2


def test_vectors_and_sts(spark, tmp_path):
    v = tmp_path / "vec.txt"
    v.write_text("cat 0.5 -1.0\ndog 1 2\n")
    rows = {r.word: r.vec for r in FS.read_word_vectors(spark, str(v)).collect()}
    assert rows["cat"] == [0.5, -1.0] and rows["dog"] == [1.0, 2.0]
    s = tmp_path / "sts.tsv"
    s.write_text("a\tb\tc\td\t3.5\tone two\tone three\n")
    r = FS.read_sts(spark, str(s)).first()
    assert r.score == 3.5 and r.s1 == "one two"


def test_length_shards(spark, tmp_path):
    (tmp_path / "3_candidates.txt").write_text("a b c\tDT NN VB\t(S (NP a))\n")
    (tmp_path / "12_candidates.txt").write_text("x\tNN\t(S x)\n")
    got = sorted((r.len_bucket, r.sent) for r in FS.read_length_shards(spark, str(tmp_path)).collect())
    assert got == [(3, "a b c"), (12, "x")]


def test_sinks_and_materialize(spark, tmp_path):
    df = spark.createDataFrame([(1, "aeda", 0, "x y", 1, True), (1, "aeda", 1, ". x y", 1, False)],
                               "src_id long, technique string, copy_no long, text string, label int, is_original boolean")
    FS.write_augmented(df, str(tmp_path / "aug"))
    assert spark.read.parquet(str(tmp_path / "aug")).count() == 2
    FS.write_generated_tsv(df, str(tmp_path / "gen"))
    back = spark.read.option("sep", "\t").schema("text string, label string").csv(str(tmp_path / "gen"))
    assert sorted(r.text for r in back.collect()) == [". x y", "x y"]
    calls = []

    def build():
        calls.append(1)
        return df

    FS.materialize(spark, build, str(tmp_path / "m"))
    assert FS.materialize(spark, build, str(tmp_path / "m")).count() == 2
    assert len(calls) == 1


def test_align_parallel(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "k long, text string")
    t = spark.createDataFrame([(1, "X Y"), (2, "Z")], "k long, tags string")
    assert FS.align_parallel(d, t, "k").count() == 2
    t2 = spark.createDataFrame([(1, "X Y")], "k long, tags string")
    with pytest.raises(ValueError):
        FS.align_parallel(d, t2, "k")


def test_positional_csv_windows_1252(spark, tmp_path):
    p = tmp_path / "aeda.csv"
    p.write_bytes("sentence,label\ncafé “quoted”,1\nshort\nempty label,\n,\n\"a, \"\"b\"\"\",2\nthree,3,more\n\"one, field\"\n".encode("cp1252"))
    good, short = FS.positional_csv(spark, str(p), encoding="windows-1252")
    assert [(r.text, r.label) for r in good.collect()] == [
        ("café “quoted”", "1"), ("empty label", ""), ("", ""), ('a, "b"', "2"), ("three", "3")]
    assert [r.raw for r in short.collect()] == ["short", '"one, field"']
    assert FS.read_positional_csv(spark, str(p), "windows-1252").count() == 5
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_positional_csv_round_trip(spark, tmp_path):
    texts = ["plain", "", ' "quoted, comma" ', "two\nlines", "naïve – dash…", FS.WINDOWS_1252]
    df = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text string, label int").coalesce(1)
    for encoding in ("UTF-8", "windows-1252"):
        FS.write_positional_csv(df, str(tmp_path / encoding), encoding)
        back = FS.read_positional_csv(spark, str(tmp_path / encoding), encoding).collect()
        assert sorted((int(r.label), r.text) for r in back) == list(enumerate(texts))


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_of_many_splits_are_numbered_in_order(spark, tmp_path, small_splits):
    lines = [f"line {k} " + "x" * (k % 37) + "\r" * (k % 2) for k in range(400)] + ["", ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-1.txt").write_bytes("\n".join(lines[250:]).encode() + b"\n")
    (tmp_path / "in" / "part-0.txt").write_bytes("\n".join(lines[:250]).encode() + b"\n")
    numbered = FS.numbered_lines(spark, str(tmp_path / "in"))
    assert numbered.rdd.getNumPartitions() > 20
    assert [r.value for r in numbered.orderBy("line_no").collect()] == lines
    assert sorted(r.line_no for r in numbered.collect()) == list(range(402))


def test_files_are_aligned_by_line_and_the_rest_is_reported(spark, tmp_path, small_splits):
    (tmp_path / "data.txt").write_text("".join(f"text {k}\n" for k in range(120)))
    (tmp_path / "tags.txt").write_text("".join(f"TAG{k} and more of it\n" for k in range(117)))
    sides = [FS.numbered_lines(spark, str(tmp_path / f"{x}.txt")) for x in ("data", "tags")]
    met, alone = FS.align_lines(*sides)
    assert sorted((r.line_no, r.text, r.tags) for r in met.collect()) == [(k, f"text {k}", f"TAG{k} and more of it") for k in range(117)]
    assert sorted((r.line_no, r.side, r.value) for r in alone.collect()) == [(k, "data", f"text {k}") for k in range(117, 120)]
    met, alone = FS.align_lines(*sides[::-1])
    assert {r.side for r in alone.collect()} == {"tags"}


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.txt").write_text("")
    numbered = FS.numbered_lines(spark, str(tmp_path / "none.txt"))
    assert numbered.collect() == [] and FS.align_lines(numbered, numbered)[0].collect() == []


def test_sts_rejects(spark, tmp_path):
    (tmp_path / "sts.tsv").write_text("a\tb\tc\td\t3.5\tone\ttwo\textra\nshort\tline\na\tb\tc\td\tno number\tone\ttwo\n")
    good, bad = FS.sts_rows(spark, str(tmp_path / "sts.tsv"))
    assert [(r.score, r.s1, r.s2) for r in good.collect()] == [(3.5, "one", "two")] and bad.count() == 2


def test_length_shards_round_trip(spark, tmp_path):
    rows = [(k % 4 + 1, f"s{k}", "A B", f"(S {k})") for k in range(20)]
    FS.write_length_shards(spark.createDataFrame(rows, "len_bucket int, sent string, pos string, parse string").repartition(3), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{k}_candidates.txt" for k in range(1, 5)]
    assert sorted(tuple(r) for r in FS.read_length_shards(spark, str(tmp_path)).collect()) == sorted(rows)


def test_generated_text_keeps_its_order(spark, tmp_path):
    rows = [(k, f"text\t{k}" if k % 3 else None, k % 2) for k in range(50)]
    df = spark.createDataFrame(rows, "id int, text string, label int").repartition(4)
    FS.write_generated_tsv(df, str(tmp_path / "gen"), ["id"])
    back = FS.read_generated_tsv(spark, str(tmp_path / "gen")).orderBy("line_no").collect()
    assert [tuple(r) for r in back] == [(k, f"text {k}" if k % 3 else "", str(k % 2)) for k in range(50)]


def test_materialised_tables_follow_their_inputs(spark, tmp_path):
    source, made = tmp_path / "in.txt", []

    def build():
        made.append(1)
        return spark.read.text(str(source))

    def table(**params):
        return sorted(r.value for r in FS.materialize(spark, build, str(tmp_path / "kept"), (str(source),), **params).collect())

    source.write_text("one\n")
    assert table(n=1) == ["one"] and table(n=1) == ["one"] and len(made) == 1
    assert table(n=2) == ["one"] and len(made) == 2
    source.write_text("one\ntwo\n")
    assert table(n=1) == ["one", "two"] and len(made) == 3


def test_two_writers_leave_one_table(spark, tmp_path):
    """The second writer finds the key taken when it is done: it drops its copy and reads the first one's."""
    def slow():
        FS.materialize(spark, lambda: spark.createDataFrame([(1,)], "x int"), str(tmp_path / "kept"), n=1)
        return spark.createDataFrame([(2,)], "x int")

    assert [r.x for r in FS.materialize(spark, slow, str(tmp_path / "kept"), n=1).collect()] == [1]
    assert len([p for p in (tmp_path / "kept").iterdir() if not p.name.startswith(".")]) == 1
