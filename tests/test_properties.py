"""Property tests: text rules on random strings, batched into one DataFrame per example."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from augmill.functions import text as T

ALPHABET = "abcXYZ éüßÉ’'-\t\n.,!?;:0123456789\"()[]#"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=60))
def test_text_rules_match_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = df.select("id", T.clean_letters(F.col("t")).alias("c"),
                     T.clean_letters(T.clean_letters(F.col("t"))).alias("c2"), T.split_ws(F.col("t")).alias("ws"),
                     T.split_nonempty(F.col("t")).alias("ne"), T.not_blank(F.col("t")).alias("nb")).collect()
    for r in rows:
        t = texts[r.id]
        assert set(r.c) <= set(" abcdefghijklmnopqrstuvwxyz") and "  " not in r.c and not r.c.startswith(" ")
        assert [x for x in r.c if x != " "] == [x for x in t.lower() if "a" <= x <= "z"]
        assert r.c2 == r.c
        assert r.ws == t.split()
        assert r.ne == [w for w in t.split(" ") if w]
        assert r.nb == bool(t.strip())
