"""Every operator takes nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from docketlake.llm import encodings, leaks, lookalikes, neardup, neighbours, packing, pieces, scans, subjects
from docketlake.llm.catalog import TOKENIZERS

LONG = "palavra longa, ação. " * 8000
CLASHING = ["word", "n", "token", "content", "group", "a", "b", "unit", "kind", "ids", "piece_text", "subject", "class_id", "line"]


@pytest.fixture(scope="module")
def nasty(spark):
    rows = [(1, None, None), (2, "", "f"), (3, " \n\t ", "f"), (4, LONG, "f"), (5, "x" * 100_000, None), (6, "a\x00b 漢字 \ud7ff", "f"), (None, "texto sem id", "f"), (7, "texto repetido " * 30, "g"), (7, "texto repetido " * 30, "g"), (8, "texto repetido " * 30, "g"), (9, "\u200b\u0301", "g")]
    table = spark.createDataFrame(rows, "doc_index long, text string, file string")
    return table.select("*", *(F.lit("z").alias(c) for c in CLASHING))


def operators():
    items = lambda t: t.sparkSession.createDataFrame([(1, "texto repetido " * 20), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    labels = lambda t: t.sparkSession.createDataFrame([(None, None, None), (4, "tax", None)], "doc_id long, subject string, labeled_by string")
    named = lambda t: t.withColumnRenamed("doc_index", "doc_id")
    fields = lambda t: t.select(F.lit("f").alias("field"), F.col("doc_index").alias("id"), F.col("text").alias("content")).where("id is not null and length(content) > 0")
    return {
        "scans": lambda t: scans.Evidence(t, "doc_index", "text", "file").cases(),
        "scans repaired": lambda t: scans.repaired(t, "doc_index", "text", "file"),
        "encodings": lambda t: encodings.affected(t, "doc_index", "text"),
        "encodings repaired": lambda t: encodings.repaired(t, "doc_index", "text"),
        "pieces": lambda t: pieces.split_oversized(t, "doc_index", "text", ("file", "word")),
        "lookalikes": lambda t: lookalikes.normalised(fields(t)),
        "neardup pairs": lambda t: neardup.similar_pairs(t, "doc_index", "text"),
        "neardup groups": lambda t: neardup.similar_groups(t, "doc_index", "text"),
        "packing": lambda t: packing.containers(packing.token_counts(named(t), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")),
        "leaks": lambda t: leaks.leaks(named(t), items(t)),
        "leaks cut": lambda t: leaks.without_leaks(named(t), items(t)),
        "subjects": lambda t: subjects.assigned(named(t), labels(t), items(t)),
    }


@pytest.mark.parametrize("name", list(operators()))
def test_anything_is_taken(nasty, name):
    found = operators()[name](nasty).collect()
    ids = [r[0] for r in found]
    if name == "neardup pairs":
        assert sorted((r.id_a, r.id_b) for r in found) == [(7, 8)]
    if name == "leaks cut":
        assert len(found) == 11 and sum(r.n_spans > 0 for r in found) == 3
    if name == "pieces":
        assert set(ids) == {4, 5}
    if name == "packing":
        assert set(ids) == {3, 4, 5, 6, 7, 8, 9}


@pytest.mark.parametrize("name", list(operators()))
def test_empty_tables_give_no_rows(nasty, name):
    assert operators()[name](nasty.limit(0)).count() == 0


def test_vectors_of_any_kind(spark):
    rows = [(1, None, "t"), (2, [], "t"), (3, [0.0, 0.0], "t"), (4, [1.0, None], "t"), (5, [1.0, 2.0], None), (6, [1.0, 2.0], "t"), (6, [1.0, 2.0], "t"), (7, [1.0, 2.0], "t"), (None, [1.0, 2.0], "t"), (8, [float("inf"), 1.0], "t")]
    table = spark.createDataFrame(rows, "group long, v array<float>, unit string")
    found = {(r.id, r.neighbour) for r in neighbours.nearest(table, "group", "v", ("unit",), dim=2, stages=2).collect()}
    assert found == {(6, 7), (7, 6)}
