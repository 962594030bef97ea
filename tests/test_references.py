"""Character references decoded by column expressions, against the standard library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from strandline.functions import html as fn

RNG = random.Random(3)


def test_all_references(spark):
    texts = [f"a&{k}b&{k.rstrip(';')}=c" for k in sorted(html5)]
    numbers = [*range(0x170), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000,
               10 ** 9, 10 ** 30]
    texts += [f"&#{n};&#x{n:x}z&#X{n:X};&#00{n} 7" for n in numbers]
    alphabet = ["&", "#", "x", ";", "amp", "lt", "not", "notin", "copy", "frac12", "39", "A", " ", "\n", "é", "😀", "\\", "%", "$1"]
    texts += ["".join(RNG.choices(alphabet, k=RNG.randrange(12))) for _ in range(4000)] + ["&" * 3000, "&" + "w" * 5000, ""]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = {r["i"]: (r["d"], r["a"]) for r in df.select("i", fn.decode(F.col("t")).alias("d"), fn.decode_all(
        F.array("t", F.lit("x"))).alias("a")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (html.unescape(t), [html.unescape(t), "x"]), t
    assert got[-1][0] is None


def test_no_python_in_the_plans(spark):
    pages = spark.createDataFrame([(1, "http://h/a/b.html?x#y", "<title>A &amp; B | C</title><a href='?q=1&amp;r'>L&eacute;</a>"),
                                   (2, "http://h/data/set-2/", "<p>none</p>"), (3, "http://h", ""), (4, None, None)],
                                  "page_id int, url string, html string")
    for plan in (fn.page_titles(pages, url="url"), fn.page_links(pages), fn.storage_candidates(pages), fn.page_kind(pages)):
        assert "Python" not in plan._jdf.queryExecution().optimizedPlan().toString()
    titles = {r["page_id"]: r["title"] for r in fn.page_titles(pages, url="url").collect()}
    assert titles == {1: "A & B", 2: "set-2", 3: "h", 4: ""}
    assert [(r["url"], r["label"]) for r in fn.page_links(pages).collect()] == [("http://h/a/b.html?q=1&r", "Lé")]
