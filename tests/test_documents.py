import logging

import pytest
from pyspark.sql import functions as F

from docketlake.operators import rerank, sections as S
from docketlake.plans.index import DocumentIndex, IndexMissing
from docketlake.sources import documents as D, pages as P, providers
from docketlake.streaming import arrivals
from tests.conftest import LetterCounts


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-32", "cp1252"])
def test_decoding(encoding):
    assert D.decode_text("ação às 10h".encode(encoding)) == "ação às 10h"


def test_undecodable_bytes_are_an_error():
    with pytest.raises(ValueError):
        D.decode_text(b"\xff\x81\xfe\x81")


def test_scan_reads_known_extensions_and_keeps_errors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.TXT").write_text("conteúdo", "utf-8")
    (tmp_path / "b.md").write_text("x")
    (tmp_path / "c.txt").write_text(" \n")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    read = D.read(D.scan(spark, str(tmp_path)))
    assert [r.content for r in D.readable(read).collect()] == ["conteúdo"]
    assert [r.error for r in D.failed(read).collect()] == ["no extractor for .pdf"]
    assert D.scan(spark, str(tmp_path), 1).count() == 1 and D.scan(spark, str(tmp_path), 0).count() == 3
    assert D.readable(D.read(D.scan(spark, str(tmp_path)), {".pdf": lambda raw: "de pdf"})).count() == 2


def test_patterns_are_whole_words(spark):
    rows = spark.createDataFrame([("o lar da criança",), ("declarar",), ("Solicitação",), ("solicita",), ("Processo: 1",)], "line string")
    schema = S.parse_schema([("Casa ", [" lar ", ""]), ("pedido", ["solicita"]), ("Autos do", ["processo:"]), ("", ["x"]), ("vazio", [])])
    assert [s.name for s in schema] == ["casa", "pedido", "autos_do"]
    assert [r.s for r in rows.select(S.matched_section("line", schema).alias("s")).collect()] == ["casa", None, None, "pedido", "autos_do"]
    assert rows.where(F.col("line").rlike(S.pattern([]))).count() == 0


def test_sections_go_on_when_they_open_again(spark):
    text = "topo\nDOS FATOS\num\nDO DIREITO\ndois\nDOS FATOS\ntrês\n"
    schema = S.parse_schema([("fatos", ["dos fatos"]), ("direito", ["do direito"])])
    made = {r.section_name: r.section_text for r in S.split(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), ["id"], "t", schema).collect()}
    assert made == {"cabecalho": "topo", "fatos": "DOS FATOS\num\nDOS FATOS\ntrês", "direito": "DO DIREITO\ndois", "completo": text.strip()}


def test_pages(spark):
    pages = spark.createDataFrame([("f", 0, "x" * 60, False), ("f", 6, None, False), ("f", 7, "curto", False), ("f", 8, "y" * 60 + "(cid:3)", False), ("f", 9, "z" * 60, True)], "file string, page_no int, text string, error boolean")
    sorted_out = P.triage(pages)
    assert [r.page_no for r in sorted_out.where("is_problematic").orderBy("page_no").collect()] == [6, 7, 8, 9]
    runs = P.runs(spark.createDataFrame([("f", n) for n in (0, 6, 7, 8)], "file string, page_no int"))
    assert sorted((r.first_page, r.last_page) for r in runs.collect()) == [(0, 0), (6, 8)]
    read = spark.createDataFrame([("f", 6, " lida "), ("f", 7, " ")], "file string, page_no int, recognised string")
    assert P.merge(sorted_out, read).first().text == "x" * 60 + "\nlida"


def test_recognition_fails_loudly(spark):
    runs = spark.createDataFrame([("f", 0, 1)], "file string, first_page int, last_page int")
    files = spark.createDataFrame([("f", bytearray(b"x"))], "path string, content binary")
    with pytest.raises(P.RecognitionUnavailable):
        P.recognise(runs, files, lambda raw, a, b: [raw] * (b - a + 1), None)
    read = P.recognise(runs, files, lambda raw, a, b: [raw] * (b - a + 1), lambda image: image.decode() + "!")
    assert [r.recognised for r in read.collect()] == ["x!", "x!"]


def test_dimension():
    assert providers.resolve_dimension("text-embedding-3-small") == 1536 and providers.resolve_dimension("x", 7) == 7
    with pytest.raises(ValueError):
        providers.resolve_dimension("x")


def test_vectors_come_in_the_order_of_the_texts(spark):
    class Shuffled:
        dimension = 1

        def embed(self, texts):
            return [(place, [float(len(text))]) for place, text in reversed(list(enumerate(texts)))]

    class Short:
        dimension = 1

        def embed(self, texts):
            return []

    rows = spark.createDataFrame([("a",), ("bbb",), (None,), ("cc",)], "t string").coalesce(1)
    assert [r.v for r in rows.select(providers.embedder(Shuffled(), 2)("t").alias("v")).collect()] == [[1.0], [3.0], None, [2.0]]
    with pytest.raises(Exception, match="another number"):
        rows.select(providers.embedder(Short())("t")).collect()


class Chat:
    def __init__(self):
        self.calls = 0

    def complete_structured(self, prompt, json_schema):
        self.calls += 1
        return {"sections": [{"name": "Fatos", "patterns": ["dos fatos"]}]}


def test_index_lives_through_build_save_load_and_append(spark, tmp_path):
    base, saved = tmp_path / "in", "file://" + str(tmp_path / "saved")
    base.mkdir()
    (base / "a.txt").write_text("cabeçalho\nDOS FATOS\no contrato foi rescindido", "utf-8")
    (base / "b.txt").write_text("laudo pericial 0829366-83 sobre o imóvel", "utf-8")
    chat = Chat()
    index = DocumentIndex(spark, LetterCounts(), chat)
    assert index.build("peca", str(base), saved)
    assert chat.calls == 1 and index.is_loaded(["peca"], ["full", "sections", "chunks"]) and not index.is_loaded([], [])
    assert index.search("082936683", "peca", "chunks", use_hybrid=True)[0].startswith("laudo") is True
    assert index.search("...", "peca", "chunks") == []
    (tmp_path / "none").mkdir()
    assert not index.build("peca", str(tmp_path / "none")) and index.is_loaded(["peca"], ["chunks"])

    other = DocumentIndex(spark, LetterCounts())
    with pytest.raises(IndexMissing):
        other.search("laudo", "peca", "chunks")
    assert len(other.search("laudo", "peca", "chunks", saved=saved)) == 2
    assert other.load(saved, ["peca", "outra"]) == {"peca": ["full", "sections", "chunks"]}
    assert [s.name for s in other.schemas["peca"]] == ["fatos"]
    other.append("peca", spark.createDataFrame([("c.txt", "parecer novo")], "file string, content string"))
    asked = spark.createDataFrame([(1, "parecer novo", ["c.txt"], "parecer  novo")], "query_id int, query string, relevant_files array<string>, relevant_text string")
    row = other.evaluate(asked, "peca", ["chunks"], 3, use_hybrid=True).first()
    assert (row.recall_at_k, row.mrr, row.passage_recall_at_k) == (1.0, 1.0, 1.0)
    other.save("peca", saved)
    again = DocumentIndex(spark, LetterCounts())
    again.load(saved, ["peca"])
    assert len(again.search("novo", "peca", "chunks", k=9)) == 3
    again.unload("peca", "chunks")
    assert again.is_loaded(["peca"], ["full"]) and not again.is_loaded(["peca"], ["chunks"])
    with pytest.raises(ValueError):
        again.evaluate(asked, "peca", ["chunks"])


def documents_of(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, content string")


def numbers(index, strategy="chunks", type_="t"):
    return sorted((r.doc_index, r.file) for r in index._loaded[type_, strategy].entries.collect())


def test_entries_are_numbered_by_file_and_place_and_on_from_the_last(spark):
    index = DocumentIndex(spark, LetterCounts())
    long_text = " ".join(f"p{i}" for i in range(1200))
    index.build_from("t", documents_of(spark, ("b", "um"), ("c", "dois"), ("a", long_text)).repartition(3))
    assert numbers(index) == [(0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c")]
    index.append("t", documents_of(spark, ("aa", "novo")))
    assert numbers(index)[-1] == (6, "aa") and numbers(index, "full")[-1] == (3, "aa")


def test_an_index_of_one_entry_can_be_appended_to(spark):
    index = DocumentIndex(spark, LetterCounts())
    index.build_from("t", documents_of(spark, ("a", "contrato antigo")))
    index.append("t", documents_of(spark, ("b", "contrato novo")))
    assert numbers(index) == [(0, "a"), (1, "b")]
    assert sorted(index.search("contrato", "t", "chunks", use_hybrid=True)) == ["contrato antigo", "contrato novo"]


def test_an_index_goes_on_after_it_was_saved_where_it_was_loaded(spark, tmp_path):
    saved = "file://" + str(tmp_path / "saved")
    first = DocumentIndex(spark, LetterCounts())
    first.build_from("t", documents_of(spark, ("a", "contrato antigo")))
    first.save("t", saved)
    index = DocumentIndex(spark, LetterCounts())
    for round_ in range(3):
        index.load(saved, ["t"])
        index.append("t", documents_of(spark, (f"n{round_}", f"contrato novo {round_}")))
        index.save("t", saved)
        assert len(index.search("contrato", "t", "chunks", k=9)) == round_ + 2
    again = DocumentIndex(spark, LetterCounts())
    again.load(saved, ["t"], ["chunks"])
    assert len(again.search("contrato", "t", "chunks", k=9)) == 4
    # the newest save and the one before it
    assert len(list((tmp_path / "saved" / "_meta" / "t").glob("*.json"))) == 2
    assert len(list((tmp_path / "saved" / "data" / "t" / "chunks").iterdir())) == 2


def test_a_save_that_fails_leaves_the_one_before_it(spark, tmp_path, monkeypatch):
    saved = "file://" + str(tmp_path / "saved")
    index = DocumentIndex(spark, LetterCounts())
    index.build_from("t", documents_of(spark, ("a", "contrato antigo")))
    index.save("t", saved)
    index.append("t", documents_of(spark, ("b", "contrato novo")))
    index._loaded["t", "full"].n = 99
    with pytest.raises(RuntimeError):
        index.save("t", saved)
    again = DocumentIndex(spark, LetterCounts())
    assert again.load(saved, ["t"]) == {"t": ["full", "chunks"]}
    assert again.search("contrato", "t", "chunks") == ["contrato antigo"]
    assert len(list((tmp_path / "saved" / "data" / "t" / "chunks").iterdir())) == 1


def test_results_have_the_scores_of_their_search(spark):
    index = DocumentIndex(spark, LetterCounts(), reranker=rerank.OverlapReranker())
    index.build_from("t", documents_of(spark, ("a", "contrato de aluguel"), ("b", "laudo do perito"), ("c", "sentença final")))
    asked = spark.createDataFrame([(1, "contrato de aluguel"), (2, "contrato de aluguel"), (3, "laudo")], "query_id int, query string")
    plain = index.compare(asked, "t", ["chunks", "full"], 2).collect()
    assert {(r.query_id, r.strategy) for r in plain} == {(1, "chunks"), (1, "full"), (3, "chunks"), (3, "full")}
    first = next(r for r in plain if (r.query_id, r.strategy, r["rank"]) == (1, "chunks", 1))
    assert (first.file, first.distance, first.similarity, first.rrf_score) == ("a", 0.0, 1.0, None)
    fused = index.retrieve(asked, "t", "chunks", 1, use_hybrid=True, use_rerank=True).where("query_id = 1").first()
    assert (fused.file, fused.rerank_score, fused.dense_rank, fused.bm25_rank) == ("a", 1.0, 0, 0)
    with pytest.warns(DeprecationWarning):
        found, scores = index.generate_search(["laudo", "never"], ["perito"], "t", ["chunks"], use_hybrid=True)
    assert {r.query_id for r in found.collect()} == {0} and scores.first().n == 1


def test_paged_documents_are_read_with_tools(spark, tmp_path):
    (tmp_path / "a.txt").write_text("texto", "utf-8")
    (tmp_path / "b.pdf").write_bytes(b"B")
    (tmp_path / "c.docx").write_bytes(b"C")
    (tmp_path / "d.DOC").write_bytes(b"broken")

    def to_pdf(content, ending):
        if content == b"broken":
            raise ValueError("no office file")
        return content + ending.encode()

    extract = lambda raw: ["pagina " * 20, None] if raw == b"B" else ["outra " * 20]
    render = lambda raw, first, last: [raw] * (last - first + 1)
    tools = P.PageTools(extract, render, lambda image: "lida", to_pdf)
    read = {r.path.rsplit("/")[-1]: (r.text, r.error) for r in D.read(D.scan(spark, str(tmp_path)), tools=tools).collect()}
    assert read["a.txt"] == ("texto", None) and read["b.pdf"][0] == "pagina " * 20 + "\nlida" and read["c.docx"][0] == "outra " * 20
    assert read["d.DOC"] == (None, "ValueError: no office file")
    with pytest.raises(P.RecognitionUnavailable):
        D.read(D.scan(spark, str(tmp_path)), tools=P.PageTools(extract, render, None, to_pdf)).collect()
    assert P.png_base64(b"x") == "data:image/png;base64,eA=="


def test_json_and_npy_sources_and_reports(spark, tmp_path):
    import json

    import numpy as np

    (tmp_path / "q.json").write_text(json.dumps([{"query": "um", "relevant_files": ["a"], "relevant_text": None}, {"query": "dois", "relevant_files": [], "relevant_text": "x"}]))
    assert [tuple(r) for r in D.labelled_queries(spark, str(tmp_path / "q.json")).orderBy("query_id").collect()] == [(0, "um", ["a"], None), (1, "dois", [], "x")]
    matrix = np.arange(20, dtype=np.float32).reshape(5, 4)
    np.save(tmp_path / "v.npy", matrix)
    rows = D.npy_vectors(spark, str(tmp_path / "v.npy"), 2).orderBy("row").collect()
    assert [r.row for r in rows] == list(range(5)) and rows[3].embedding == matrix[3].tolist()
    D.write_report(spark.createDataFrame([("chunks", 0.9)], "strategy string, recall double"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).select("strategy", "recall").first() == ("chunks", 0.9)


def test_measurements(spark):
    from docketlake.plans import measure

    index = DocumentIndex(spark, LetterCounts(), reranker=rerank.OverlapReranker())
    index.build_from("t", documents_of(spark, ("a", "contrato de aluguel"), ("b", "laudo do perito")))
    labelled = spark.createDataFrame([(1, "laudo", ["b"], None)], "query_id int, query string, relevant_files array<string>, relevant_text string")
    assert {r.mode: r.recall_at_k for r in measure.dense_and_hybrid(index, labelled, "t", ["chunks"], 2).collect()} == {"dense": 1.0, "hybrid": 1.0}
    rows = measure.with_and_without_rerank(index, labelled, "t", ["chunks"], 1).collect()
    assert {r.rerank for r in rows} == {True, False} and all(r.seconds_per_query > 0 for r in rows)
    assert measure.rerank_sweep(index, labelled, "t", ["chunks"], (1, 2), (1,), 1).count() == 2
    crossed = measure.cross_evaluated({"x": index, "y": index}, {"p": labelled, "q": labelled.limit(0)}, "t", ["chunks"], 2)
    assert crossed.count() == 4 and set(measure.cross_table(crossed).columns) == {"index", "strategy", "p", "q"}
    assert measure.seconds_per_query(lambda q: index.dense(q, "t", "chunks", 1), labelled.select("query_id", "query")) > 0


def test_failed_calibration_is_not_cached(spark, caplog):
    class Broken:
        def complete_structured(self, prompt, json_schema):
            raise RuntimeError("down")

    index = DocumentIndex(spark, LetterCounts(), Broken())
    with caplog.at_level(logging.WARNING):
        index.build_from("t", spark.createDataFrame([("a", "um texto")], "file string, content string"))
    assert "down" in caplog.text and "t" not in index.schemas and index.is_loaded(["t"], ["full", "chunks"])


def test_arriving_files_are_appended_once_and_failures_kept(spark, tmp_path):
    base, target, failed, checkpoint = (str(tmp_path / name) for name in ("in", "out", "failed", "cp"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ansi.TXT").write_bytes("petição".encode("cp1252"))
    (tmp_path / "in" / "wide.txt").write_bytes("sentença".encode("utf-16"))
    (tmp_path / "in" / "broken.txt").write_bytes(b"\xff\x81\xfe\x81")
    for round_ in range(2):
        (tmp_path / "in" / f"{round_}.txt").write_text(f"documento {round_}", "utf-8")
        arrivals.append_chunks(arrivals.arriving(spark, base), target, failed, checkpoint, lambda c: F.array_repeat(F.length(c).cast("float"), 2), 2).awaitTermination()
    assert sorted(r.chunk_text for r in spark.read.parquet(target).collect()) == ["documento 0", "documento 1", "petição", "sentença"]
    assert [r.file.rsplit("/")[-1] for r in spark.read.parquet(failed).collect()] == ["broken.txt"]


def test_copies_are_found_in_every_chunk_of_every_file(spark, tmp_path):
    from docketlake.plans import catalog

    said = [f"palavra{i}" for i in range(12)]
    passage = " ".join(said)
    chunks = [("a", 0, "nada"), ("a", 1, f"Antes, a{passage.upper()}s\n depois"), ("b", 0, "nada"), ("c", 0, passage.replace(" ", " \n")), ("d", 0, " ".join(said[:11])), ("d", 1, None)]
    asked = [(1, ["a"], passage), (2, ["b", "c"], passage), (3, ["d"], passage), (4, ["c"], " ".join(said[:11])), (5, None, passage), (6, ["a", "a"], "x " + passage), (7, ["a"], None), (8, [None], passage)]
    spark.createDataFrame(chunks, "file string, chunk_index int, chunk_text string").write.parquet(f"{tmp_path}/chunks_metadata.parquet")
    spark.createDataFrame(asked, "query_id long, relevant_files array<string>, relevant_text string").write.parquet(f"{tmp_path}/labeled_queries.parquet")
    found = sorted(map(tuple, catalog.QUERIES["looks_copied_anywhere"](spark, str(tmp_path)).collect()))
    assert found == [(1, True), (2, True), (3, False), (4, False), (5, False), (6, True), (8, False)]


def test_a_schema_too_large_for_the_driver_is_an_error(spark, tmp_path):
    from docketlake.plans import catalog

    rows = spark.range(catalog.MOST_SECTIONS + 1).selectExpr("'t' document_type", "cast(id as int) position", "concat('s', id) section_name", "array('x') patterns")
    rows.write.parquet(f"{tmp_path}/section_schema.parquet")
    spark.createDataFrame([(1, "t", "x")], "doc_id long, document_type string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(ValueError):
        catalog.QUERIES["section_split"](spark, str(tmp_path))
