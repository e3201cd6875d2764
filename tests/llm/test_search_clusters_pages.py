"""Search, clustering and page extraction beside SQL and brute force."""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import clusters, oracle, page_samples, pages, queries, search
from tessera.llm.textops import map_batches
from tests.compare import same, tables

from . import fixtures

FIXED = "item_id long, text string, doc_id string, rank long, term long, id long, item long, score long"


@pytest.mark.parametrize("name", ["op11_centroids", "op13_search"])
def test_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), tables(sf_dir), oracle.SQL[name])


def plain_terms(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_search(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found_search(df) -> list[tuple]:
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


ITEMS = [(1, "The RIVER and the Stone"), (2, None), (3, ""), (4, "..."), (5, "unheard of before"), (None, "lichen moss très"), (1, "copper 7 lantern"), (6, "the"), (7, "zzzz")]


def test_search_beside_brute_force_with_odd_rows(spark, monkeypatch):
    docs = fixtures.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in ITEMS], "item_id long, text string, doc_id string, rank int, term int, id int, item int, score int")
    expected = plain_search(rows, ITEMS)
    assert found_search(search.search(docs, items)) == expected
    # Small blocks, tables and passes give the same.
    monkeypatch.setattr(search, "BLOCK_DOCS", 64)
    monkeypatch.setattr(search, "TABLE_TERMS", 3)
    monkeypatch.setattr(search, "PASS_TERMS", 5)
    assert found_search(search.search(docs.repartition(3), items)) == expected
    assert found_search(search.search(docs, items, k=1)) == plain_search(rows, ITEMS, 1)


def test_search_takes_long_texts_and_ties(spark):
    long = "river " * 400_000 + "ocean " * 300_000  # 4 MB
    docs = [(k, "same words here") for k in (9, 3, 5, 3)] + [(1, long), (None, "same words here"), (2, "x" * 2_000_000), (4, "x" * 2_000_000)]
    items = [(1, "same here"), (2, "ocean river"), (3, "x" * 2_000_000)]
    df = search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found_search(df) == plain_search(docs, items)


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(fixtures.empty(spark), items).collect() == []
    assert search.search(fixtures.unique_documents(spark), items.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " . ")], "doc_id long, text string")
    assert search.search(blank, items).collect() == []
    assert dict(search.search(blank, items).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_an_index_can_be_written_and_searched_again(spark, tmp_path):
    docs = fixtures.unique_documents(spark)
    terms = np.unique(np.array([r["term"] for r in search.item_terms(spark.createDataFrame([(1, "river stone moss")], "item_id long, text string")).collect()], np.int64).view(np.uint64))
    blocks = search.postings(docs, terms).cache()
    total = blocks.selectExpr("sum(n_docs) as n", "sum(n_terms) as l").first()
    search.build_index(blocks, search._frequencies(blocks, len(terms)), total["n"], total["l"]).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    first, second = (sorted(map(tuple, search.search_index(index, [np.arange(3)], 5).collect())) for _ in range(2))
    assert first == second and len(first) >= 5


def plain_clusters(rows: list[tuple], k: int = 16, rounds: int = 3) -> list[tuple]:
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
        if n < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    most = (1 << 63) - 1
    d = [min(most, far(v, c[a])) for (_, v), a in zip(kept, at, strict=True)]
    of = [min(most, sum(x for x, a in zip(d, at, strict=True) if a == j)) for j in range(len(c))]
    return sorted(((i, a, x, of[a], min(most, sum(d)), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d, strict=True)), key=str)


def found_clusters(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_clusters_beside_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    v = lambda scale=0.2: [float(x) for x in rng.normal(0, scale, 64)]
    base = v()
    rows = [(k, v()) for k in range(60)] + [(100 + k, base) for k in range(30)] + [(7, v()), (7, base), (None, v()), (None, base)]
    rows += [(200, None), (201, [1.0] * 63), (202, [*v()[:-1], None]), (203, [*v()[:-1], float("nan")]), (204, [*v()[:-1], float("inf")]), (205, []), (206, [0.0] * 64), (207, [-0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "ids": F.lit(1), "raw": F.lit(2)})
    assert found_clusters(clusters.cluster_vectors(df)) == plain_clusters(rows)
    assert found_clusters(clusters.cluster_vectors(df.repartition(5))) == plain_clusters(rows)
    few = rows[:5]
    assert found_clusters(clusters.cluster_vectors(spark.createDataFrame(few, "vec_id long, embedding array<double>"))) == plain_clusters(few)


def test_clusters_of_ties_and_large_numbers(spark):
    # Many equal distances: corners of a cube of whole numbers.
    cube = [(k, [float(k >> b & 1) for b in range(6)] + [0.0] * 58) for k in range(64)]
    assert found_clusters(clusters.cluster_vectors(spark.createDataFrame(cube, "vec_id long, embedding array<double>"))) == plain_clusters(cube)
    big = cube[:20] + [(k, [s * 4e6 + k] * 64) for s, k in ((1, 100), (-1, 101), (1, 102))] + [(103, [1e9] * 64)]
    assert found_clusters(clusters.cluster_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>"))) == plain_clusters(big)
    assert clusters.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_exponion_compares_less_than_all(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-40, 40, (4000, 16))).astype(np.int64)
    now, cluster, upper, lower, before = centres + 5, np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros(4000), None
    for _ in range(3):
        c = clusters.Centroids(now, before)
        cluster, upper, lower, computed = clusters.assign(x, cluster, upper, lower, c)
        d = ((x[:, None] - now[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        assert (upper + 1e-3 >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(np.partition(d, 1, axis=1)[:, 1]) + 1e-3).all()
        before, now = now, now + rng.integers(-2, 3, now.shape)
    assert computed < 0.1 * d.size  # after the first round bounds and balls leave little


def plain_article(page: str) -> str:
    """Main text of the given pages, which all mark it: between the tags of the article."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]*>", " ", part)) for part in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(t for t in (" ".join(p.split()) for p in parts) if t)


def test_pages_of_the_table(spark, sf_dir):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = queries.op12_html(spark, sf_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["text"] == plain_article(rows[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_held_out_layouts():
    tree, right, blocks, clean = pages.train(), 0, 0, []
    for page, main in page_samples.samples(seed=77):
        found = pages.blocks(page)
        good = pages.predict(tree, pages.features(found)) >= 0.5
        truth = np.array([b.text in set(main) for b in found])
        right, blocks = right + int((good == truth).sum()), blocks + len(found)
        clean.append((good == truth).all())
    assert right / blocks > 0.97
    assert all(clean[:5 * page_samples.PAGES])  # layouts that mark the article


CASES = [
    (None, ""),
    ("", ""),
    ("<article>", ""),
    ("<article><p>A &amp; B &lt;i&gt; &#233;&#x41;&nbsp;x &am</p></article>", "A & B <i> éA x &am"),
    ("<article><p>one<p>two<br>three <b>fo</b>ur</article><footer>no</footer>", "one\ntwo three four"),
    ("<article><script>var x='</p><p>no'</script><p>yes</p><style>p{}</style><!-- <p>no</p> --></article>", "yes"),
    ("<article><p>yes</p><section class='reader-comments'><article><p>" + "a long remark of a reader. " * 20 + "</p></article></section></article>", "yes"),
    ("<article><p>yes</p><aside><p>no</p></aside><form><p>no</p></form><div class='ad'>no</div><p>also</p></article>", "yes\nalso"),
    ("<article><p>kept to the end", "kept to the end"),
    ("<article><p title='a > b' data-x=\"<p>no\">yes</p></article>", "yes"),
    ("<article><p>yes</p><!-- never closed <p>no</p>", "yes"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ("<ARTICLE><P>upper</P></ARTICLE>", "upper"),
    ("<main><h1>Short</h1><p>text</p></main><footer>no</footer>", "Short\ntext"),
    ("<article>a < b and c<3 </ d> e</article>", "a < b and c<3 e"),
    ("<article><p>a\t\n b　c</p></article>", "a b c"),
]


def test_pages_with_odd_markup_and_rows(spark):
    rows = [(k % 7 or None, f"u{k}", page, "t", "x") for k, (page, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `a.b` string")
    found = pages.main_text(df)
    assert found.columns == ["page_id", "url", "a.b", "text"]
    assert {r["url"]: r["text"] for r in found.collect()} == {f"u{k}": text for k, (_, text) in enumerate(CASES)}
    assert pages.main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("part", ["<a ", "<p class=\"", "<!--", "<div>", "<p>x", "</p", "<script>", "&amp;", "<", "<a href='", "<li>y</li>"])
def test_long_pages_take_time_by_their_length(part):
    page = "<article><p>begin</p>" + part * (2_000_000 // len(part))
    assert pages.blocks(page)[0].text == "begin"


def test_sizes_of_batches_with_units(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("64m", "2m", "1g", "1000000b"):
            spark.conf.set(name, size)
            assert map_batches(spark.range(3), lambda b: b, "id bigint").count() == 3
    finally:
        spark.conf.set(name, before)
