"""What extraction costs a notice: no Python, and patterns from where they can begin."""

from pyspark.sql import functions as F

from noticeloom.functions import text as T
from noticeloom.functions import values as V
from noticeloom.operators import extract


def test_fields_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "located at 99 Low St, Mission, TX 78572\n12 N Oak Rd, McAllen, TX 78501")], "doc_id int, text string")
    told = extract.fields(df)
    assert "Python" not in told._jdf.queryExecution().executedPlan().toString()
    # Only the first is marked as someone else's if its words are not within the second's 150 letters.
    far = df.withColumn("text", F.concat(F.lit("located at 99 Low St, Mission, TX 78572\n"), F.repeat(F.lit("x "), 80), F.lit("\n12 N Oak Rd, McAllen, TX 78501")))
    got = [r["a"] for r in df.union(far).select(extract.stated_address(F.col("text"))["text"].alias("a")).collect()]
    assert got == [None, "12 N Oak Rd, McAllen, TX 78501"]


def test_patterns_begin_at_their_texts(spark):
    assert T.begins(r"(?im)^Date:?") == ("date",) and T.begins(r"(?i)(?:Lender|Payee):") == ("lender", "payee")
    assert T.begins(r"(?i)(?:All of )?Lot\s+") == () and T.begins(r"(?<!x)abc") == () and T.begins(r"(\b[A-Z])") == ()
    texts = ["İİİ Recording DATE: x\nDate: May 5, 2005", "Date: 6/7/2008", "no", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", T.lowered("t"))
    assert all(len(r["t"]) == len(r["low"]) for r in df.where("t is not null").collect())
    got = [r["d"] for r in df.select(V.first_date(V.from_label(F.col("t"), r"(?im)^Date:?", 200, F.col("low"))).alias("d")).collect()]
    assert got == ["2005-05-05", "2008-06-07", None, None, None]
