from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
RUN = "9" * 50_000
BASE = [f"tok{i * 7 % 1009}" for i in range(300)]
NEAR = " ".join([*BASE[:150], "changed", *BASE[151:]])
EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "Hello there", "en", "a"), (5, "HELLO there", "en", "b"), (5, "HELLO there", "en", "b"), (6, "one", "en", None), (7, "ONE", "en", "b"),
    (8, LONG, "en", "c"), (9, LONG, "en", "c"), (10, RUN, "en", "c"), (11, "é漢😀  x y", "fr", "c"), (None, "no id at all", "en", "a"), (None, "no id at all", "en", "a"), (12, "a@b.co 1.2.3.4 4111 1111 1111 1111 +44 20 7946 0958", "en", "a"),
    (13, " ".join(BASE), "en", "a"), (14, NEAR, "en", "b"), (15, " ".join(["new"] * 30 + BASE[40:140] + ["end"] * 30), "de", "b"), (16, "@@@@ ++++ .... ----", "en", "d"), (17, "x" * 20_000, "en", "d"),
]
PAGES = [
    (1, "https://A.Example.ORG/es/1?x", "<body><nav>menu</nav><article><h1>T</h1><p>One&amp;two<br>three<p>Four</article><footer>f</footer>"), (2, None, None), (3, "no scheme", ""), (3, "no scheme", ""),
    (4, "http://host.com/fr/9#z", "<p>" + "word " * 30_000), (5, "http://sub.host.com/de/", "<div class='sidebar'>side</div><div>Main  text</div><section id=comments><p>hi</p></section>"), (None, "ftp://x.org", "<script>var a='<p>no</p>'</script>plain"),
    (6, "http://spam-farm.example.org/x", "<<<>>><p unclosed='x"), (7, "https://example.org/en/12", "<article></article>"),
]


VECTORS = [(1, [1.0, 0.5], 1), (2, [2.0, 1.0], 1), (2, [2.0, 1.0], 1), (3, None, 1), (None, [1.0, 0.5], None), (4, [0.0, 0.0], 2), (5, [None, 1.0], 2), (6, [1.0], 1)]


def write_tables(spark, folder, docs, pages, labels, vectors=()):
    made = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) as n_chars")
    # Extra columns with names that helpers use.
    for name in ("h", "_n", "_row", "target", "shards", "at", "node", "score", "digest", "_kept", "size", "ids", "n_tokens", "words", "hash", "n_bytes", "keep", "piece", "_salt"):
        made = made.selectExpr("*", f"'{name}' as {name}")
    made.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rule").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as cell", "3 as h").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """Nulls, blanks, repeats, long texts and columns with clashing names."""
    return write_tables(spark, tmp_path_factory.mktemp("edge"), EDGE, PAGES, [(4, 1, 0), (5, None, None), (None, 1, 1), (12, 1, 1), (12, 1, 0)], VECTORS)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
