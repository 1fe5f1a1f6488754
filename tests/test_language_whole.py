from __future__ import annotations

from pyspark.sql import functions as F

from vellumframe.functions.text import language_sql


def languages(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.expr(language_sql("text")).alias("x"))
    return [(r["x"]["lang"], r["x"]["conf"]) for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_script_is_counted_over_the_whole_text(spark):
    text = "это предложение " * 320 + "the cat is in the house and the dog is out of it " * 400
    found = languages(spark, [text[:5000], text])
    assert found[0][0] == "ru" and found[1][0] == "en"


def test_scripts(spark):
    texts = {"ar": "هذه جملة مكتوبة باللغة العربية", "he": "זה משפט שנכתב בעברית כאן", "hi": "यह वाक्य हिंदी में लिखा गया है", "ko": "이 문장은 한국어로 작성되었습니다 그렇죠", "ja": "これはひらがなとカタカナのぶんしょうです", "zh": "这是一个用中文写的句子这是一个用中文写的句子", "el": "αυτή είναι μια πρόταση στα ελληνικά", None: "1234567890 1234567890 12"}
    assert [x for x, _ in languages(spark, list(texts.values()))] == list(texts)
