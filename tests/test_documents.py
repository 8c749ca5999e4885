from pyspark.sql import functions as F

from shoal.functions import text
from shoal.operators import documents as docs
from shoal.sources import schemas


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.t for r in df.select("i", fn(F.col("t")).alias("t")).orderBy("i").collect()]


def test_code_block(spark):
    html = "a<pre><code>x<y</code></pre>b"
    assert apply(spark, text.strip_markup_dropping_code, html) == ["ab"]
    assert apply(spark, text.strip_markup_and_code_spans, html) == ["a x b"]
    assert apply(spark, text.strip_markup, html) == ["a x b"]


def test_back_ticks(spark):
    raw = "one ```two\nthree``` four `five` six"
    assert apply(spark, text.strip_markup_and_code_spans, raw) == ["one four six"]
    assert apply(spark, text.strip_markup, raw) == ["one ```two three``` four `five` six"]


def test_null_and_white_space(spark):
    for fn in (text.strip_markup, text.strip_markup_and_code_spans, text.strip_markup_dropping_code):
        assert apply(spark, fn, None, " a  \x0b b ") == ["", "a b"]


def test_entities_decode_once(spark):
    raw = "&amp;lt; &lt;b&gt; &#233;&#x20AC; &unknown; a & b"
    assert apply(spark, text.strip_markup_dropping_code, raw) == ["&lt; <b> é€ &unknown; a & b"]


def corpus(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.CORPUS)


def test_gap_numbering_and_nesting(spark):
    row = (1, "T", "<p>B</p>", [("",), ("x",)], [("ans", [("",), ("reply",)]), ("", None)])
    out = docs.full_documents(corpus(spark, row)).first()
    assert out.full_text == "标题: T 问题: B 问题评论2: x 回答1: ans 回答1评论2: reply"
    assert (out.answer_count, out.text_length) == (2, len(out.full_text))


def test_missing_arrays(spark):
    out = docs.full_documents(corpus(spark, (1, "title here", None, None, None))).first()
    assert (out.full_text, out.answer_count) == ("标题: title here", 0)


def test_truncation(spark):
    title = "t" * 65
    rows = [(1, title, "b" * 5000, None, None), (2, "", "b" * 5000, None, None), (3, "short", "", None, None)]
    out = {r.question_id: r for r in docs.full_documents(corpus(spark, *rows)).collect()}
    assert out[1].text_length == 3930
    assert out[1].full_text.startswith(f"标题: {title} 问题: bbb")
    assert out[2].text_length == 4000
    assert 3 not in out  # 9 characters, not longer than 10


def test_long_title_leaves_only_the_prefix(spark):
    out = docs.full_documents(corpus(spark, (1, "t" * 3000, "b" * 3000, None, None))).first()
    assert out.text_length == 3000 + 5


def test_clean_corpus_needs_all_fields(spark):
    rows = [(1, "a", "<code>x</code>b", None, None), (2, None, "b", None, None), (3, "a", None, None, None)]
    out = docs.clean_corpus(corpus(spark, *rows)).collect()
    assert [(r.id, r.text, r.title) for r in out] == [(1, "a [SEP] b", "a")]


def test_flat_combination_with_a_crowded_id(spark):
    rows = [(1, i, "" if i % 7 == 0 else f"p{i}") for i in range(20000)] + [(2, 0, "only")]
    df = spark.createDataFrame(rows, "id long, pos int, part string")
    out = {r.id: r for r in docs.combine_flat(df, "id", "pos", "part").collect()}
    whole = " ".join(p for i, _, p in rows if i == 1 and p)
    assert (out[1].full_length, out[1].text) == (len(whole), whole[:4000])
    assert out[2].text == "only"


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "w array<string>")
    got = [sorted(r[0]) for r in df.select(text.ngrams(F.col("w"), 1, 2)).collect()]
    assert got == [["a", "a b", "b", "b c", "c"], ["x"], []]
