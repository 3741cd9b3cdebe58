"""Stream = batch for the row-local operators, also when the query is stopped between files and goes on."""

import pytest
from pyspark.sql import functions as F

from augmill.functions import text as T
from augmill.operators.aeda import aeda
from augmill.operators.eda import single_technique
from augmill.sources import tables as TB
from augmill.streaming import stream as ST

CASES = {
    "aeda": (ST.stream_aeda, lambda df: aeda(df, naug=2)),
    "deletion": (ST.stream_deletion, lambda df: single_technique(df, None, "rd", naug=2)),
    "clean": (ST.stream_clean, lambda df: df.select("src_id", T.clean_letters(F.col("text")).alias("text"), "label")),
}


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", list(CASES))
def test_stream_equals_batch_over_restarts(spark, sf_dir, tmp_path, name):
    start, batch = CASES[name]
    docs = TB.load(spark, sf_dir, "documents")
    folder, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    parts = [docs.where(F.col("doc_id") % 3 == k) for k in range(3)]

    def run():
        query = start(ST.labelled_stream(spark, sf_dir, folder=folder), out, ckpt)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for k, part in enumerate(parts):  # a file, a start, a stop; the next start finds its place
        part.coalesce(1).write.mode("append").parquet(folder)
        run()
        if k == 1:
            run()  # nothing new: nothing twice
    assert rows_of(ST.read_output(spark, out)) == rows_of(batch(TB.labelled(spark, sf_dir)))


def test_files_beside_the_tables(spark, sf_dir, tmp_path):
    query = ST.stream_clean(ST.labelled_stream(spark, sf_dir), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert ST.read_output(spark, str(tmp_path / "out")).count() == TB.labelled(spark, sf_dir).count()
