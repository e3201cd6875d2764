import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, credentials, embeddings, oracle, queries

from ..compare import same, tables
from .fixtures import documents, empty, prose
from .test_text_operators import BLANK, check_mix, filled, shingles
from .test_text_operators import components as components_of


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * (0.05 if i % 3 else 0.6)).tolist(), None if i % 17 == 0 else i % 2) for i in range(90)]
    rows += [(90 + k, rows[4][1], 0) for k in range(5)] + [(95, None, 0), (96, [0.0] * 8, 0), (97, [float("nan")] * 8, 1), (98, [None] * 8, 1), (99, [1.0, 2.0], 1), (100, [2.0, 4.0], 1), (101, [], 0), (4, rows[4][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("size", F.lit(1)), rows


def brute(rows, cosine):
    good = [(k, i, np.array(v, float), y) for k, (i, v, y) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v) and y is not None]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, _, x, p in good:
        for b, _, y, q in good:
            if a < b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[a], links[b] = links[a] + 1, links[b] + 1
                ra, rb = root(a), root(b)
                if rows[ra][0] > rows[rb][0]:
                    ra, rb = rb, ra
                parent[rb] = ra
    return sorted((rows[k][0], links[k], rows[root(k)][0]) for k in range(len(rows)))


@pytest.mark.parametrize("kind", ["double", "float"])
@pytest.mark.parametrize("block,leaf", [(4 << 20, 128), (7 * 64, 3)])
def test_vectors(spark, monkeypatch, block, leaf, kind):
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", block)
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    df, rows = vectors(spark)
    if kind == "float":
        df = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = embeddings.near_duplicate_vectors(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows, 0.93)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 75), (7, 7), (60, 60)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 50, 75: 50, 50: 50}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), tables(sf_dir), oracle.SQL[name])


def test_every_query_runs_and_returns_a_row_for_each_input_row(spark, sf_dir):
    for name, f in queries.QUERIES.items():
        if name == "op13_search":  # rows for each item, tested beside SQL
            continue
        table = {"op7_embeddings": "embeddings", "op11_centroids": "embeddings", "op12_html": "pages"}.get(name, "documents")
        assert f(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count(), name


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf_dir):
    docs = documents(spark)
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
    assert docs.count() > 0


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = empty(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == empty(spark).columns


def test_stages_beside_brute_force(spark, sf_dir, tmp_path):
    """Each stage on what the one before it kept."""
    from tokenizers import Tokenizer

    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), dict(corpus_pipeline.STAGES)
    planted = f'{prose(900, 70)} password = "hunter2hunter2" {prose(901, 20)}'
    docs = docs.unionByName(docs.limit(1).select(F.lit(900001).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(planted).alias("text"), "lang", "source", F.lit(len(planted)).cast(docs.schema["n_chars"].dataType).alias("n_chars")))

    def run(name, docs):
        stages[name](spark, docs, sf_dir).write.parquet(str(tmp_path / name.split()[0]))
        return spark.read.parquet(str(tmp_path / name.split()[0]))

    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    good = run("quality rules", docs)
    want = {r[0] for r in tables(sf_dir).sql(f"select doc_id from ({oracle.OP9}) where kept").fetchall()} | {900001}
    assert set(texts(good)) == want and good.count() == len(want) < docs.count()
    unique = run("MinHash near-dedup", good)
    found = components_of({i: shingles(t, 5) for i, t in texts(good).items()})
    assert set(texts(unique)) == {i for i, c in found.items() if i == c} and unique.count() < good.count()
    masked = run("secret scans", unique)
    before, after = texts(unique), texts(masked)
    assert set(before) == set(after)
    spans = {r["doc_id"]: r["spans"] for r in credentials.find_secrets(unique).collect()}
    changed = 0
    for i, t in before.items():
        out, end = "", 0
        for x in spans[i]:
            if x["start"] >= end:
                out += t[end : x["start"]] + credentials.MASK
            end = max(end, x["end"])
        assert after[i] == out + t[end:]
        changed += after[i] != t
        assert not any(len(m.group(group)) >= least for pattern, group, least in credentials.BASE.values() for m in pattern.finditer(after[i]))
    assert changed and all(r["n_chars"] == len(r["text"]) for r in masked.select("n_chars", "text").collect())
    taken = run("mixing sources to target weights", masked)
    times = {r["doc_id"]: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    rows, size = [], {r["doc_id"]: (r["source"], len(BLANK.findall(r["text"].encode()))) for r in masked.collect()}
    total = {}
    for source, n in size.values():
        total[source] = total.get(source, 0) + n
    order = sorted(total)
    target = filled(total, {x: corpus_pipeline.WEIGHTS[i % 3] for i, x in enumerate(order)}, corpus_pipeline.REPEATS)
    rows = [(i, source, n, total[source], target[source], n * times.get(i, 0)) for i, (source, n) in size.items()]
    check_mix(rows, 0.1)
    tokens = run("BPE encoding and decoding", taken)
    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts(taken).items()}
    want = sorted((r["doc_id"], len(v := ids[r["doc_id"]]), digest(",".join(map(str, v))), digest(library.decode(v, skip_special_tokens=False))) for r in taken.select("doc_id").collect())
    assert sorted(map(tuple, tokens.collect())) == want


def test_pipeline_keeps_what_each_stage_keeps(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert out["n_tokens"].min() > 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.quality_rules(spark, docs, sf_dir), sf_dir)
    assert set(out["doc_id"]) <= {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert out.groupby("doc_id").size().max() <= corpus_pipeline.REPEATS


def test_vectors_without_id_or_of_one_id_keep_their_links(spark):
    """Rows of one id that are far apart, and rows without id, each with a near neighbour."""
    e = lambda k, by=0.0: [1.0 if i == k else by if i == 7 else 0.0 for i in range(8)]
    rows = [(1, e(0), 1), (1, e(1), 1), (2, e(0, 0.1), 1), (None, e(1), 1), (7, e(1, 0.1), 1), (None, e(2), 1), (9, e(2, 0.1), 1), (None, e(3), 1), (None, e(3, 0.1), 1), (None, None, 1), (5, e(4), None)]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want = [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (None, 2, 1, False), (7, 2, 1, False), (None, 1, 9, False), (9, 1, 9, True), (None, 1, None, False), (None, 1, None, False), (None, 0, None, False), (5, 0, 5, True)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
