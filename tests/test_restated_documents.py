"""The query of restated texts against its SQL on texts that the tables have few of: lines that end before a number, numbers that
open a text, stand twice or are part of longer ones."""

import random
import tempfile

import duckdb
from support import normal

from strideframe.plans import figures

TEXTS = ["Ends.\n4801146876264569 goes on", "a -\n5 b", "12 km and 12 min", "12 12", "12", "v.12 then 12", "1,2345 and 1,234", "at 1.2.3 or 1.2", "a -7 b 7", "7", "- 5 min", None, ""]


def test_restated_documents_of_odd_texts_equal_sql(spark):
    rng = random.Random(4)
    bits = ["load", "set ", " ", " ", ", ", ".", ".\n", "-", " – ", "x", "5", "17", "1,200", "3.25", "km", " min", "%", "é", "(", "\n"]
    texts = [t for t in TEXTS for _ in range(3)] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    at = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet/*.parquet')")
    found = con.execute(figures.RESTATED)
    df = figures.restated_documents(spark, at)
    columns = [d[0] for d in found.description]
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(found.fetchall(), columns)
