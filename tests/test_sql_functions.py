from pyspark.sql import functions as F

from corpusloom.functions.prompts import train_prompt
from corpusloom.functions.sql import register
from corpusloom.functions.text import extract_response
from corpusloom.operators.splitting import explode_chunks, window_units
from tests.conftest import plan_of


def test_sql_functions_equal_the_columns(spark):
    register(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.createOrReplaceTempView("sql_docs")
    prompts = spark.sql("select doc_id, train_prompt('I', text, 'O') as p from sql_docs")
    want = docs.select("doc_id", train_prompt(F.lit("I"), F.col("text"), F.lit("O")).alias("p"))
    assert prompts.exceptAll(want).count() == 0
    prompts.createOrReplaceTempView("sql_prompts")
    answers = spark.sql("select distinct extract_response(p) as a, extract_response('none') as b from sql_prompts").collect()
    assert [tuple(r) for r in answers] == [("O", None)]
    assert prompts.select(extract_response(F.col("p"))).distinct().count() == 1
    assert spark.sql("select strip_text('\\t a ') as s").first().s == "a"


def test_window_chunks_in_sql(spark):
    register(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.createOrReplaceTempView("sql_docs")
    got = spark.sql("select doc_id, posexplode(u) as (chunk_no, chunk) from (select doc_id, window_units(text) as u from sql_docs)")
    want = explode_chunks(docs, window_units(F.col("text")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert "Join" not in plan_of(got) and "Exchange" not in plan_of(got)
