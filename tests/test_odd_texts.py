"""Texts that the given tables lack, against the SQL of the queries that read them."""

import __spark_entry__ as e
from tests.harness import compare

#: Unassigned before Unicode 14 or 15: letters, numbers and punctuation.
LATER = "؝ࡰౝ⹝鿿ꟙ\U00010570\U000105bc\U00011b09\U00012ff2\U00016ac9\U0001e4f9\U0002b739\U000323af"


def test_character_classes(spark, con, tmp_path):
    texts = ["", None, "", " ", "\n", "♩=120", "가a1.", "\u0000\U0001f3b5é", *LATER, "a" + LATER + "+"]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, ""), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = con.cursor()
    own.sql(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(e.queries()["char_class"](spark, str(tmp_path)), e.oracle_sql()["char_class"], own) == ""
