"""Rows that the queries' tables don't hold: no copies, null texts and labels, blanks, all rates 0."""

from augmill.operators import splits
from augmill.operators.aeda import aeda
from augmill.operators.eda import eda
from augmill.sources import files


def rows(spark, data):
    return spark.createDataFrame(data, "src_id bigint, text string, label bigint")


def test_no_copies(spark):
    df = rows(spark, [(1, "a few words", 0), (2, "other words here", 1)])
    assert [r.copy_no for r in aeda(df, naug=0).collect()] == [0, 0]


def test_null_text_gets_a_mark(spark):
    out = aeda(rows(spark, [(1, None, 0)]), naug=1).where("copy_no = 1").collect()
    assert len(out) == 1 and out[0].text is not None and out[0].text.strip() != ""


def test_rates_of_zero_leave_the_cleaned_originals(spark):
    df = rows(spark, [(1, "A few Words!", 0)])
    syn = spark.createDataFrame([], "word string, syns array<string>")
    out = eda(df, syn, alpha_sr=0, alpha_ri=0, alpha_rs=0, p_rd=0).collect()
    assert [(r.copy_no, r.text) for r in out] == [(0, "a few words ")]


def test_rows_without_a_label_stay(spark):
    df = rows(spark, [(k, f"text {k}", None if k % 3 == 0 else 0) for k in range(9)])
    assert splits.undersample(df, reduce_labels=(1,)).count() == 9
    assert splits.label_index(df).count() == 9


def test_csv_keeps_blanks(spark, tmp_path):
    df = spark.createDataFrame([("  lead and trail ", "x", "eda")], "text string, label string, technique string")
    files.write_augmented(df, str(tmp_path / "c"), "csv")
    back = files.read_labelled_csv(spark, str(tmp_path / "c" / "technique=eda")).collect()
    assert [r.text for r in back] == ["  lead and trail "]


def test_generated_rows_stay_whole(spark, tmp_path):
    df = spark.createDataFrame([("tab\there\nand line", "x")], "text string, label string")
    files.write_generated_tsv(df, str(tmp_path / "t"))
    good, bad = files.read_tsv_fields(spark, str(tmp_path / "t"), 2)
    assert [(r.f1, r.f2) for r in good.collect()] == [("tab here and line", "x")] and bad.count() == 0


def test_fields_are_stripped_before_they_are_counted(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("a\tb\t\n\ta\tb\n")
    good, bad = files.read_tsv_fields(spark, str(tmp_path / "f.tsv"), 2)
    assert good.count() == 2 and bad.count() == 0
