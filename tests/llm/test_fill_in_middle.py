"""Documents cut in three: brute force over code points and units, exact restoration, the SQL."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gridsift.llm import fill_in_middle, registry

FOLDER = "/root/testdata/sf0.001"
PATTERNS = {"characters": r"(?s).", "words": r"[^\t-\r ]+|[\t-\r ]", "pieces": r"[^\t-\r 0-9!-/:-@\[-`{-~]{1,4}|[\t-\r 0-9!-/:-@\[-`{-~]"}
TEXTS = [
    "", None, "a", "ab", "plain words here", "tabs\tand\nlines\r\n\n", "héllo wörld, naïve 12345!", "🙂🙂 emoji‍ 漢字かな", "<P>", "has <S> inside", "near <M", "<<P", "> <P S>", " ", "x" * 9_000 + " y", "1.5 + 2,7 = {ok}", "NUL\x00byte",
]


def expected(doc_id, text, pattern, sentinels=("<P>", "<S>", "<M>")):
    text = text or ""
    p, s, m = sentinels
    units = re.findall(pattern, text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(x in text for x in sentinels) or h[2] % 100 >= 90:
        return "plain", n, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if h[3] % 100 < 20 else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return ("spm" if h[3] % 100 < 20 else "psm"), n, len(prefix), len(middle), out


@pytest.mark.parametrize("kind", list(PATTERNS))
def test_equals_brute_force_and_is_restored(spark, kind):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id at all"), (3, "same id"), (3, "same id")]
    cut = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), kind)
    got = cut.withColumn("again", fill_in_middle.restore(F.col("fim_form"), F.col("fim_output"))).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    want = sorted([(i, t, *expected(i, t, PATTERNS[kind]), t or "") for i, t in rows], key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r["fim_form"] for r in got} == {"plain", "psm", "spm"}


def test_query_equals_sql(spark, duck):
    df = registry.QUERIES["op12_fill_in_middle"](spark, FOLDER)
    cursor = duck.execute(registry.ORACLES["op12_fill_in_middle"])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


def test_extra_and_clashing_columns_and_nothing(spark):
    docs = spark.createDataFrame([(1, "some text", 5, "x", 7, "y", "z")], "doc_id long, text string, FIM_Form int, `a.b` string, Text2 int, `c``d` string, fim_output string")
    out = fill_in_middle.transform(docs)
    assert out.columns == ["doc_id", "text", "a.b", "Text2", "c`d", *fill_in_middle.ADDED]
    assert out.first()[2:5] == ("x", 7, "y")
    assert fill_in_middle.transform(docs.where("false")).count() == 0
    same = spark.createDataFrame([(1, "some text", "other")], "doc_id long, text string, Text string")
    assert fill_in_middle.transform(same).first()[1:3] == ("some text", "other")


def test_own_sentinels(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(i, f"text {i} with <P>") for i in range(40)] + [(99, "a [mid] b")], "doc_id long, text string")
    cut = fill_in_middle.transform(docs, sentinels=marks)
    rows = cut.withColumn("again", fill_in_middle.restore(F.col("fim_form"), F.col("fim_output"), marks)).collect()
    assert all(r["again"] == r["text"] for r in rows)
    assert all(r["fim_output"] == expected(r["doc_id"], r["text"], r"(?s).", marks)[4] for r in rows)
    for bad in (("<a>", "<a>", "<b>"), ("ab", "bc", "x"), ("a", "abc", "x")):
        with pytest.raises(ValueError):
            fill_in_middle.transform(docs, sentinels=bad)
