"""The queries of this subpackage by name, and their equivalents in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlake.llm import encodings, leaks, lookalikes, neardup, neighbours, packing, pieces, scans, subjects
from docketlake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Where the public tokenizers' vocabulary files are.
TOKENIZERS = "/opt/tokenizers"


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where there is any."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query(
    "p1_found",
    """
    WITH v AS (SELECT vec_id, document_type AS t, strategy AS s, embeddings::DOUBLE[] AS e FROM indices
               WHERE vec_id IS NOT NULL AND embeddings IS NOT NULL AND len(embeddings) = 64 AND document_type IS NOT NULL AND strategy IS NOT NULL),
    u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
    p AS (SELECT a.vec_id AS x, b.vec_id AS y,
                 row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS r
          FROM u a JOIN u b ON a.t = b.t AND a.s = b.s AND a.vec_id <> b.vec_id)
    SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM p WHERE r <= 10
    """,
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which at least one is among the 10 most similar of the other."""
    found = p1_nearest(spark, sf_dir)
    return found.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()


@query("p1_nearest")
def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar vectors of every vector, with rank and similarity."""
    return neighbours.nearest(table(spark, sf_dir, "indices"), "vec_id", "embeddings", ("document_type", "strategy"))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and the kinds of scan noise in them."""
    evidence = scans.Evidence(table(spark, sf_dir, "chunks_metadata"), "doc_index", "chunk_text", "file")
    return evidence.cases().withColumnRenamed("id", "doc_index")


@query("p2_repaired")
def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy chunks as continuous paragraphs."""
    return scans.repaired(table(spark, sf_dir, "chunks_metadata"), "doc_index", "chunk_text", "file").withColumnRenamed("id", "doc_index")


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a wrong encoding has garbled anywhere."""
    return encodings.affected(table(spark, sf_dir, "chunks_metadata"), "doc_index", "chunk_text").withColumnRenamed("id", "doc_index")


@query("p3_restored")
def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled chunks with their text restored as far as it can be."""
    return encodings.repaired(table(spark, sf_dir, "chunks_metadata"), "doc_index", "chunk_text").withColumnRenamed("id", "doc_index")


@query(
    "p4_found",
    r"""
    SELECT doc_index FROM chunks_metadata
    WHERE length(regexp_replace(chunk_text, '^[\s\x{85}\x{A0}\x{1C}-\x{1F}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}\x0B]+|[\s\x{85}\x{A0}\x{1C}-\x{1F}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}\x0B]+$', '', 'g')) > 8000
    """,
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized chunks: those of which the splitter made pieces."""
    return p4_pieces(spark, sf_dir).where("piece = 0").select("doc_index")


@query("p4_pieces")
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return pieces.split_oversized(table(spark, sf_dir, "chunks_metadata"), "doc_index", "chunk_text", ("file",))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, id, content) of the queries and chunks."""
    asked = table(spark, sf_dir, "labeled_queries").select(F.lit("query").alias("field"), F.col("query_id").alias("id"), F.col("query").alias("content"))
    chunks = table(spark, sf_dir, "chunks_metadata").select(F.lit("chunk_text").alias("field"), F.col("doc_index").alias("id"), F.col("chunk_text").alias("content"))
    return asked.unionAll(chunks).where("id is not null and length(content) > 0")


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold characters standing for others of the same look; garbled chunks are left out."""
    found = lookalikes.judged(_texts(spark, sf_dir)).select("field", F.col("id").alias("row_id")).distinct()
    garbled = p3_found(spark, sf_dir).select(F.lit("chunk_text").alias("field"), F.col("doc_index").alias("row_id"))
    return found.join(garbled, ["field", "row_id"], "left_anti")


@query("p5_normalised")
def p5_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that were not in ordinary form, in ordinary form."""
    return lookalikes.normalised(_texts(spark, sf_dir)).withColumnRenamed("id", "row_id")


@query(
    "p6_found",
    r"""
    WITH w AS (SELECT doc_index, regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}]+') AS w FROM chunks_metadata WHERE chunk_text IS NOT NULL),
    s AS (SELECT doc_index, list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS s FROM w WHERE len(w) >= 20),
    x AS (SELECT doc_index, len(s) AS n, unnest(s) AS g FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_index ORDER BY df, g) AS p FROM (SELECT *, count(*) OVER (PARTITION BY g) AS df FROM x)),
    c AS (SELECT DISTINCT l.doc_index AS a, m.doc_index AS b FROM r l JOIN r m ON l.g = m.g AND l.doc_index < m.doc_index
          WHERE l.p <= l.n - ceil(0.6 * l.n) + 1 AND m.p <= m.n - ceil(0.6 * m.n) + 1)
    SELECT a AS doc_index_a, b AS doc_index_b FROM c JOIN s l ON l.doc_index = a JOIN s m ON m.doc_index = b
    WHERE len(list_intersect(l.s, m.s)) >= 0.6 * (len(l.s) + len(m.s) - len(list_intersect(l.s, m.s)))
    """,
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose sets of three-word sequences have a similarity of at least 0.6."""
    pairs = neardup.similar_pairs(table(spark, sf_dir, "chunks_metadata"), "doc_index", "chunk_text", threshold=0.6, width=3)
    return pairs.select(F.col("id_a").alias("doc_index_a"), F.col("id_b").alias("doc_index_b"))


@query("p6_groups")
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that have near-duplicates, each with its class, its group and its class's number of links."""
    groups = neardup.similar_groups(table(spark, sf_dir, "chunks_metadata"), "doc_index", "chunk_text", threshold=0.6, width=3)
    return groups.withColumnRenamed("id", "doc_index")


@query("p7_containers")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text or piece of a text, in tokens of a public tokenizer."""
    sizes = packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    return packing.containers(sizes).withColumnRenamed("id", "doc_id")


@query("p7_slack")
def p7_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers have how many items and how much unused space."""
    filled = p7_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_items"))
    return filled.select((2048 - F.col("used")).alias("unused"), "n_items").groupBy("unused", "n_items").agg(F.count("*").alias("n_containers"))


@query(
    "p8_found",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(list_slice(w, k, k + 14), ' '))) AS g FROM d WHERE len(w) >= 15),
    ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(list_slice(w, k, k + 14), ' '))) AS g FROM i WHERE len(w) >= 15)
    SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
    """,
)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items with which they share 15 consecutive words."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query("p8_clean_documents")
def p8_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the leaked spans cut out, or dropped where most of it is leaked."""
    return leaks.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the subjects that at least three of their sentences are about."""
    found = subjects.assigned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "subjects"))
    return found.select(F.col("id").alias("doc_id"), "subject")


@query("p9_composition")
def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents treat each subject, and their share of all documents; several subjects count each."""
    documents = table(spark, sf_dir, "documents")
    total = documents.agg(F.count("*").alias("total"))
    counts = p9_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_documents"))
    return counts.join(F.broadcast(total)).select("subject", "n_documents", F.round(F.col("n_documents") / F.col("total"), 6).alias("share"))
