import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.functions import vectors as V
from docketlake.operators import dense, evaluate, fusion, lexical, rerank
from docketlake.operators.components import connected_components


def test_exact_search_equals_brute_force_with_ties(spark):
    random = np.random.default_rng(1)
    x = random.integers(0, 3, (200, 4)).astype(float)
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "doc long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)] + [(50, None)], "query_id long, query_vector array<float>")
    found = {(r.query_id, r["rank"]): (r.doc, r.distance) for r in dense.exact(entries, asked, 9).collect()}
    for i in range(7):
        d = ((x - x[i]) ** 2).sum(1)
        for rank, doc in enumerate(sorted(range(200), key=lambda j: (d[j], j))[:9], 1):
            assert found[i, rank] == (doc, d[doc])


def test_many_queries_in_blocks_give_what_one_block_gives(spark, monkeypatch):
    random = np.random.default_rng(11)
    x = random.normal(size=(700, 8))
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc long, embedding array<float>").repartition(3)
    asked = entries.where("doc < 300").select(F.col("doc").alias("query_id"), F.col("embedding").alias("query_vector"))
    key = lambda df: sorted((r.query_id, r["rank"], r.doc, r.distance) for r in df.collect())
    whole = key(dense.exact(entries, asked, 4))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 600)
    monkeypatch.setattr(dense, "TILE", 4000)
    assert key(dense.exact(entries, asked, 4)) == whole and len(whole) == 1200

    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in random.integers(0, 40, 12))) for i in range(200)], "doc long, text string")
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i}") for i in range(39)], "query_id long, query string")
    index = lexical.build(texts, "doc", "text")
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc, r.score) for r in df.collect())
    whole = rows(lexical.top(index, queries, 5))
    monkeypatch.setattr(lexical, "QUERY_TERMS", 7)
    monkeypatch.setattr(lexical, "SCORES", 100)
    assert rows(lexical.top(index, queries, 5)) == whole and len(whole) == 39 * 5


def test_probing_all_clusters_is_exact(spark):
    random = np.random.default_rng(2)
    entries = spark.createDataFrame([(i, random.normal(size=6).tolist()) for i in range(150)], "doc long, embedding array<float>")
    asked = entries.where("doc < 5").select(F.col("doc").alias("query_id"), F.col("embedding").alias("query_vector"))
    centres = dense.train_clusters(entries, "embedding", 5)
    some = dense.search_cells(dense.build_cells(entries, centres), asked, 4, 5)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc) for r in df.collect())
    assert key(some) == key(dense.exact(entries, asked, 4))


def test_pq_search_finds_nine_tenths_of_the_neighbours(spark, tmp_path):
    from docketlake.plans import catalog

    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=64).tolist()) for i in range(1500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    truth = {(r.query_id, r.doc) for r in catalog.QUERIES["knn_exact"](spark, str(tmp_path)).collect()}
    found = {(r.query_id, r.doc) for r in catalog.QUERIES["pq_search"](spark, str(tmp_path)).collect()}
    assert len(found) == len(truth) and len(found & truth) >= 0.85 * len(truth)


@pytest.mark.parametrize("kind", ["ivf_flat", "ivf_sq8", "ivf_pq"])
def test_an_index_of_any_kind_finds_nine_tenths_of_the_neighbours(spark, kind):
    from docketlake.plans import index as I

    class Scattered:
        """Vectors in all directions, the same for the same text."""

        dimension = 16

        def embed(self, texts):
            return [np.random.default_rng(len(text)).normal(size=16).tolist() for text in texts]

    random = np.random.default_rng(4)
    entries = spark.createDataFrame([(i, random.normal(size=16).tolist()) for i in range(600)], "doc_index long, embedding array<float>")
    index = I.DocumentIndex(spark, Scattered(), options=I.Options(index_kind=kind, probes=1))
    index.adopt("t", "chunks", entries.select("doc_index", F.lit("f").alias("file"), F.lit("x").alias("text"), "embedding"))
    asked = spark.createDataFrame([(i, "pergunta " + "x" * i) for i in range(1, 40)], "query_id int, query string")
    truth = dense.exact(entries, index._asked(asked), 5, "doc_index")
    assert index.recall("t", "chunks", 5) is None
    found = evaluate.recall_against(index.dense(asked, "t", "chunks", 5), truth).first()
    assert found.recall >= 0.8 and index.recall("t", "chunks", 5) >= 0.9


@pytest.mark.parametrize(("n", "kind", "lists"), [(1, "flat", 1), (100_000, "flat", 316), (100_001, "ivf_flat", 316), (250_001, "ivf_sq8", 500), (900, "flat", 30), (100, "flat", 3)])
def test_kind_and_lists_follow_the_size(n, kind, lists):
    assert dense.choose_kind(n) == kind
    assert dense.list_count(n) == lists


def test_small_indexes_fall_back():
    assert dense.choose_kind(999, "ivf_sq8") == dense.choose_kind(255, "ivf_pq") == "ivf_flat"
    with pytest.raises(ValueError):
        dense.choose_kind(5, "tree")


def test_bm25_equals_the_formula(spark):
    texts = ["alfa beta gama", "beta beta delta", "gama", "", "epsilon zeta eta"]
    entries = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc long, text string")
    queries = spark.createDataFrame([(0, "beta beta gama"), (1, "nada")], "query_id long, query string")
    docs = [t.split() for t in texts] + [[]]
    n, average = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    want = {}
    for i, d in enumerate(docs):
        s = sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / average)) for t in "beta beta gama".split() if t in d)
        if s > 0:
            want[9 if i == 5 else i] = round(s, 6)
    found = {r.doc: r.score for r in lexical.top(lexical.build(entries, "doc", "text"), queries, 10).collect()}
    assert found == pytest.approx(want)


def test_fusion_breaks_ties_by_dense_then_lexical_rank(spark):
    schema = "query_id int, doc int, rank int"
    made = fusion.fuse(spark.createDataFrame([(1, 7, 1), (1, 8, 2)], schema), spark.createDataFrame([(1, 9, 1), (1, 8, 2)], schema), 3)
    assert [(r.doc, r.dense_rank, r.bm25_rank) for r in made.orderBy("rank").collect()] == [(8, 1, 1), (7, 0, None), (9, None, 0)]
    assert fusion.pool_size(5, 1000) == 50 and fusion.pool_size(20, 60) == 60 and fusion.pool_size(5, 1000, 7) == 7


def test_reranking_takes_the_best_passage_once_per_query(spark):
    long_text = " ".join(["vazio"] * 700 + ["agulha"] + ["vazio"] * 300)
    rows = spark.createDataFrame([(1, "agulha", 10, "nada aqui", 1), (1, "agulha", 11, long_text, 2), (1, "agulha", 12, "", 3)], "query_id int, query string, doc int, text string, rank int")
    assert rerank.passages(rows).where("doc = 11").count() == 4
    made = rerank.rerank(rows, rerank.OverlapReranker(), 2).orderBy("rank").collect()
    assert [(r.doc, r.rerank_score) for r in made] == [(11, 1.0), (10, 0.0)]
    with pytest.raises(ValueError):
        rerank.rerank(rows, None)


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "a", "uma  passagem\nlonga"), (1, 2, "b", "x"), (2, 1, "c", "y"), (2, 2, "b", "zz")], "query_id int, rank int, file string, text string")
    labelled = spark.createDataFrame([(1, ["a"], "passagem longa"), (2, ["b"], None), (3, ["q"], "nada")], "query_id int, relevant_files array<string>, relevant_text string")
    row = evaluate.metrics(results, labelled).first()
    assert (row.recall_at_k, row.mrr, row.n_queries) == (round(2 / 3, 6), 0.5, 3)
    assert row.passage_recall_at_k == 0.5 and row.avg_result_chars == (19 + 1 + 1 + 2) / 4
    empty = evaluate.metrics(results.limit(0), labelled.limit(0)).first()
    assert (empty.recall_at_k, empty.mrr, empty.passage_recall_at_k, empty.avg_result_chars) == (0.0, 0.0, None, 0.0)


def test_mean_pool_equals_the_formula(spark):
    x = np.array([[3.0, 4.0], [0.0, 0.0], [1.0, 0.0]])
    made = V.mean_pool(spark.createDataFrame([("f", v.tolist()) for v in x], "file string, v array<float>"), ["file"], "v").first().embedding
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    mean = unit.mean(0)
    assert made == pytest.approx((mean / np.linalg.norm(mean)).tolist())


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 10), (5, 5), (None, 3)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_new_vectors_lie_between_neighbours_and_do_not_depend_on_partitions(spark):
    from docketlake.operators import synthesis

    random = np.random.default_rng(5)
    x = random.normal(size=(40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seeds = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    made = {r.number: r.embedding for r in synthesis.synthesize(seeds, 100, noise=0.0).collect()}
    again = {r.number: r.embedding for r in synthesis.synthesize(seeds.repartition(7), 100, noise=0.0).collect()}
    assert len(made) == 100 and all(made[k] == pytest.approx(again[k]) for k in made)
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in made.values())
    near = synthesis.neighbours(seeds, 3).where("vec_id = 4").orderBy("place").collect()
    d = np.linalg.norm(x - x[4], axis=1)
    assert [r.partner for r in near] == sorted((i for i in range(40) if i != 4), key=lambda i: d[i])[:3]
    assert synthesis.synthesize(seeds, 7).count() == 7


def test_an_index_by_codes_keeps_fewer_bytes(spark):
    random = np.random.default_rng(6)
    entries = spark.createDataFrame([(i, random.normal(size=16).tolist()) for i in range(1200)], "doc long, embedding array<float>")
    centres = dense.train_clusters(entries, "embedding", 4)
    size = lambda cells: cells.blocks.agg(F.sum(F.length("payload"))).first()[0]
    flat, sq8, pq = (dense.build_cells(entries, centres, kind, 4) for kind in ("ivf_flat", "ivf_sq8", "ivf_pq"))
    assert (size(flat), size(sq8), size(pq)) == (1200 * 64, 1200 * 16, 1200 * 4)
    assert dense.bytes_per_vector("ivf_sq8", 1024) == 1032 and dense.bytes_per_vector("ivf_pq", 1024, 64) == 72


def test_clusters_without_neighbours_and_other_dimensions(spark):
    entries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (None, [1.0, 1.0])], "doc long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, query_vector array<double>")
    assert [(r.doc, r.distance, r.similarity) for r in dense.exact(entries, asked, 5).orderBy("rank").collect()] == [(1, 0.0, 1.0), (2, 2.0, 0.0)]
    assert dense.exact(entries, asked.limit(0), 5).count() == 0 and dense.exact(entries.limit(0), asked, 5).count() == 0
    index = lexical.build(spark.createDataFrame([], "doc long, text string"), "doc", "text")
    assert lexical.top(index, spark.createDataFrame([(1, "laudo"), (2, None)], "query_id long, query string"), 3).count() == 0


def test_equal_queries_are_searched_once(spark, monkeypatch):
    from docketlake.operators import blocks

    met, meet = [], blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda entries, queries, *rest: met.append(queries.count()) or meet(entries, queries, *rest))
    random = np.random.default_rng(5)
    x = random.integers(0, 4, (3000, 3)).astype(float)
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, x[i % 90].tolist()) for i in range(180)], "query_id long, query_vector array<float>")
    found = {(r.query_id, r["rank"]): (r.doc, r.distance) for r in dense.exact(entries, asked, 20).collect()}
    for i in range(180):
        d = ((x - x[i % 90]) ** 2).sum(1)
        assert [found[i, rank] for rank in range(1, 21)] == [(j, d[j]) for j in sorted(range(len(x)), key=lambda j: (d[j], j))[:20]]

    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in random.zipf(1.3, 8) % 50)) for i in range(500)], "doc long, text string")
    queries = spark.createDataFrame([(i, f"w1 w{i % 7} w{i % 7 + 20}") for i in range(70)], "query_id long, query string")
    index = lexical.build(texts, "doc", "text")
    few, all_ = lexical.top(index, queries, 5).collect(), lexical.top(index, queries, 500).collect()
    assert met[0] == len(np.unique(x[:90], axis=0)) and met[1] == 7
    # what the bounds left out is not among the best
    assert {(r.query_id, r.doc, r.score, r["rank"]) for r in few} == {(r.query_id, r.doc, r.score, r["rank"]) for r in all_ if r["rank"] <= 5} and len(few) == 350


def test_passages_are_chosen_where_the_candidate_is(spark):
    text = " ".join(["outro"] * 700 + ["prazo"] + ["fim"] * 100)
    rows = spark.createDataFrame([(1, "prazo", 10, text, 1), (1, "prazo", 11, "um texto curto", 2)], "query_id long, query string, doc long, text string, rank int")
    for size, most, shown in ((150, 4, [0, 1, 8, 9]), (150, 3, [0, 8, 9])):
        chosen = rerank.passages(rows, size, most)
        assert [r.passage_no for r in chosen.orderBy("passage_no").collect() if r.doc == 10] == shown
        assert "Exchange" not in chosen._jdf.queryExecution().toString()
        assert {r.doc: r.n_passages for r in rerank.passage_counts(rows, size, most).collect()} == {10: most, 11: 1}
