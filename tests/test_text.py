import uuid

import pytest
from pyspark.sql import functions as F

from qanat.functions import text as T
from qanat.functions import vectors as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize(
    ("question", "number"),
    [("Article 1022", 1022), ("Art.1022", 1022), ("Art 1022", 1022), ("المادة ١٠٢٢", 1022), ("مادة 1022", 1022), ("بالمادة ۵", 5), ("Article # 12", 12), ("Article 2000 and article 5", None), ("art. 1022", None), ("Articles 5", None), ("article1022", None), ("article 5x", None), ("", None)],
)
def test_detect_article(spark, question, number):
    assert one(spark, question, T.detect_article) == number


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.clean, "‏a   b\t c\n\n\n\nd é ", "a b c\n\nd é"),
        (T.collapse, " a  b\n\tc ", "a b c"),
        (T.collapse, None, ""),
        (T.ascii_digits, "٠١٩۵", "0195"),
        (T.repair_lam_alef, "ال وال إال االحوال", "لا ولا إال الاحوال"),
        (T.repair_dates, "في ٥١ يناير سنة ٨٤٩١ المادة ٨٤٩١", "في ١٥ يناير سنة ١٩٤٨ المادة ٨٤٩١"),
        (T.repair_dates, "31 مايو سنة 1948", "31 مايو سنة 1948"),
        (T.normalise_arabic, "أَحـمد کی", "احمد كي"),
        (T.arabic_for_embedding, "الرقابة١ ( سنة 1948 ) ٢ (١)", "الرقابة سنة 1948 ٢"),
        (T.strip_think, "<think>a\nb</think>\n\n answer ", "answer"),
        (T.strip_think, "left</think> answer", "answer"),
        (T.first_sentence, "One two.  Three.", "One two."),
        (T.strip_title, " - Title: –", "Title"),
        (T.slug, "a b/ç-d", "a_b_ç_d"),
        (T.script_of, "مادة a", "ar"),
        (T.script_of, "12", "unknown"),
        (T.token_estimate, "one two three", 5),
        (T.token_estimate, "مادة واحدة", 5),
        (T.token_estimate, "", 0),
        (T.prompt_tokens, "", 1),
        (T.prompt_tokens, "12345", 2),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


def test_columns_of_a_line(spark):
    got = one(spark, "Article 1   in force     مادة ١", T.split_columns)
    assert (got["en"], got["ar"]) == ("Article 1 in force", "مادة ١")
    got = one(spark, "12 The owner of مادة القانون 7 may sell", T.split_columns)
    assert (got["en"], got["ar"]) == ("12 The owner of may sell", "مادة القانون 7")


@pytest.mark.parametrize("name", ["art0147-ar-00", "a147-ar-0", "é"])
def test_point_id_is_a_version_5_uuid(spark, name):
    assert one(spark, name, V.point_id) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_same_digits(spark):
    row = spark.createDataFrame([("٣", "12"), ("۳", "12"), ("3", "12")], "t string, w string").select(T.same_digits(F.col("t"), F.col("w")).alias("y")).collect()
    assert [r["y"] for r in row] == ["١٢", "۱۲", "12"]


def test_a_line_is_cut_once_for_both_columns(spark):
    lines = ["\t one\ttwo   مادة ١ ", "a\u2003 b", "\u2003", "", None, "only", "Law of 5 أحكام عامة end  x", "\u00a0\u00a0x \t y"]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").withColumn("s", T.split_columns(F.col("line")))
    assert [tuple(r["s"]) if r["s"] else None for r in got.orderBy("i").collect()] == [("one two", "مادة ١"), ("a b", ""), ("", ""), ("", ""), (None, None), ("only", ""), ("Law of 5 end x", "أحكام عامة"), ("x y", "")]
    assert got.select("s.en", "s.ar")._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2  # one of the pieces, one of a mixed piece's words
