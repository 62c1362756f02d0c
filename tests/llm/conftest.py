from __future__ import annotations

import random

import pytest

LOREM = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you one we all were her she there would their will when who him been has more if no out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()


def _texts() -> list[str | None]:
    r = random.Random(7)
    say = lambda n: " ".join(r.choice(LOREM) + r.choice(["", "", "er", "ing", "s", ","]) for _ in range(n))
    base, shared = say(300), say(60)
    near = base.split(" ")
    near[150] = "changed"
    long = say(6000)
    return [
        None, "", "   \n\t ", "one", "two words", "ÄÖ é 中文 🙂 mixed ÉCOLE", base, base, " ".join(near), say(40) + " " + shared + " " + say(40), say(50) + "\n" + shared, long + " " + shared,
        "again and again and again\n" * 40, "<|endoftext|> a <|endoftext|>b", "x" * 9000, say(120), say(200), "A\x00B " * 30, "\x1c\x85 odd spaces   here", say(80).upper() + " $$$ %%% ###",
        "9" * 60, "-" * 200 + " end", say(90), say(90) + "\r\n\r\n" + say(10),
    ]


@pytest.fixture(scope="session")
def texts():
    return _texts()


@pytest.fixture(scope="session")
def rows(texts):
    out = [(i * 3, t, ["en", "de", None, "fr"][i % 4], ["a", "a", "b", None][i % 4], 0 if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[6], (None, "a document without an id " * 20, "en", "b", 500)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def small(spark, rows, tmp_path_factory):
    """A folder of tables with null, empty, repeated and long rows."""
    d = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({}).repartition(3).selectExpr("*", "1 AS size", "2 AS chunk", "'x' AS fp").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(18, 1, 0), (45, 1, 0), (48, 1, 0), (57, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    urls = [(1, "http://Sub.Example.org/en/12?x"), (2, "https://example.org/es/a"), (3, "x.com/fr/"), (4, None), (5, "https://a.com/de/z#q"), (6, "https://free-casino-bonus.net/xxx"), (7, "ftp://Ünï.COM/fr/x"), (8, "http://"), (8, "http://")]
    spark.createDataFrame(urls, "page_id bigint, url string").selectExpr("*", "'' AS html", "'h' AS host").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d
