import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T

CASES = {
    "Cafés, crème brûlée": ["cafes", "creme", "brulee"],
    "wi-fi Wi-Fi": ["wi-fi", "wi", "fi"],
    "Don't stop": ["don't", "don", "t", "stop"],
    "--- ___ '": [],
    "x" * 65 + " short": ["short"],
    "日本語 テキスト": None,
    "snake_case_name": ["snake_case_name", "snake", "case", "name"],
    "": [],
}


def tokens(spark, text, camel=False):
    return spark.createDataFrame([(text,)], "t string").select(T.tokenize(F.col("t"), camel)).first()[0]


@pytest.mark.parametrize("text", CASES)
def test_tokens(spark, text):
    got = tokens(spark, text)
    assert got == T.py_tokenize(text)
    if CASES[text] is not None:
        assert got == CASES[text]


def test_camel_case(spark):
    assert tokens(spark, "getUserName HTMLParser", True) == ["getusername", "get", "user", "name", "htmlparser", "html", "parser"]
    assert tokens(spark, "getUserName") == ["getusername"]
    assert tokens(spark, "H2O COVID-19 Hello", True) == ["h2o", "covid-19", "covid", "19", "hello"]


def test_null_text_has_no_tokens(spark):
    assert tokens(spark, None) == []


def test_jvm_and_driver_agree_on_odd_letters(spark):
    rnd = random.Random(3)
    # Letters that every Unicode version in use knows.
    letters = [chr(c) for c in range(33, 0x3100) if unicodedata.ucd_3_2_0.category(chr(c)) != "Cn"]
    texts = ["".join(rnd.choices(letters + [" ", "-", "'"] * 200, k=25)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokenize(F.col("t"), True)).collect()
    different = [t for t, got in rows if got != T.py_tokenize(t, True)]
    assert len(different) <= 3  # the property Diacritic still differs a little between versions


def test_spans_point_into_the_original(spark):
    text = "Élan, wi-fi — naïve déjà-vu!\nend"
    rows = T.token_spans(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").orderBy("pos").collect()
    assert [text[r.start : r.start + r.length] for r in rows] == ["Élan", "wi-fi", "naïve", "déjà-vu", "end"]
    assert rows[1].variants == ["wi-fi", "wi", "fi"]


@pytest.mark.parametrize(
    "content,body",
    [("---\na: 1\n---\nbody", 13), ("---\r\na\r\n---\r\nb", 13), ("no", 0), ("a\n---\nb\n---\n", 0), ("---\nx\n---", 9), (None, 0)],
)
def test_frontmatter(spark, content, body):
    assert spark.createDataFrame([(content,)], "c string").select(T.frontmatter_end(F.col("c"))).first()[0] == body


def test_line_of_offset_and_extension(spark):
    row = spark.createDataFrame([("a\nbb\nc", "Dir.x/File", "A/b.MD")], "t string, p string, q string").select(
        *[T.line_of_offset(F.col("t"), F.lit(i)) for i in (0, 1, 2, 4, 5)], T.extension(F.col("p")), T.extension(F.col("q")), T.file_type(F.lit("a.PNG"))
    ).first()
    assert tuple(row) == (0, 0, 1, 1, 2, "x/file", "md", "image")


def test_significant_terms(spark):
    def run(terms, query=None):
        df = spark.createDataFrame([(terms, query or [])], "t array<string>, q array<string>")
        return df.select(T.significant_for_query(F.col("t"), F.col("q")) if query else T.significant_terms(F.col("t"))).first()[0]

    assert run(["a", "of", "recovery"]) == ["recovery"]
    assert run(["a", "of"]) == ["a", "of"]
    assert run(["of", "recovered"], ["of", "recover"]) == ["recovered"]
    assert run(["of", "recovered"], ["file", "recover"]) == ["of", "recovered"]
