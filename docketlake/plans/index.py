"""A document index: built, saved, loaded, appended to and searched.

A saved index is Parquet, a folder for each save of a type's strategy, and for
each save of a type a small numbered JSON file that names the folders, the
section schema and the embedding prefix. The file is written last, so a save
that fails leaves the one before it in force. All searches take a batch of
queries; one query is a batch of one.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
import warnings
from collections import defaultdict
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlake.functions import text as T
from docketlake.operators import dense, evaluate, fusion, lexical, rerank, sections, units
from docketlake.session import checkpointed
from docketlake.sources import documents as D, providers

log = logging.getLogger(__name__)
STRATEGIES = ("full", "sections", "chunks")


#: The scores of a result, by the kind of search that gives them.
SCORES = {"distance": "double", "similarity": "double", "rrf_score": "double", "dense_rank": "int", "bm25_rank": "int", "rerank_score": "double"}


class IndexMissing(LookupError):
    """A document type's strategy is neither loaded nor saved."""


@dataclass(frozen=True)
class Options:
    """How an index is built and searched."""

    chunk_words: int = T.CHUNK_WORDS
    embedding_batch: int = 100
    document_prefix: str = ""
    query_prefix: str = ""
    index_kind: str = "auto"
    kind_thresholds: tuple[int, int] = (dense.FLAT_UP_TO, dense.IVF_FLAT_UP_TO)
    probes: int = 32
    rrf_k: int = fusion.RRF_K


@dataclass
class _Loaded:
    """The entries of one type and strategy, and what is derived from them."""

    entries: DataFrame
    n: int
    lexical: lexical.Bm25Index | None = None
    cells: dense.Cells | None = None
    #: By k, the (probes, candidates) that a search needs, and the recall measured with them.
    depths: dict[int, tuple[tuple[int, int], float]] = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)


class DocumentIndex:
    """Entries of documents by type and strategy, with dense, lexical and fused search."""

    def __init__(
        self,
        spark: SparkSession,
        embedding: providers.EmbeddingProvider,
        chat: providers.ChatProvider | None = None,
        reranker: providers.RerankProvider | None = None,
        structure: providers.StructureProvider | None = None,
        options: Options = Options(),
        **removed,
    ):
        for name in removed:
            warnings.warn(f"the option {name} has no effect", DeprecationWarning, stacklevel=2)
        self.spark, self.embedding, self.chat, self.reranker, self.structure, self.options = spark, embedding, chat, reranker, structure, options
        self.schemas: dict[str, list[sections.Section]] = {}
        self._loaded: dict[tuple[str, str], _Loaded] = {}
        self._lock = threading.Lock()
        self._locks: dict[tuple[str, str], threading.Lock] = defaultdict(threading.Lock)

    # --- building -------------------------------------------------------------------------------------------------

    def _embed(self):
        return providers.embedder(self.embedding, self.options.embedding_batch)

    def build(self, document_type: str, base: str, saved: str | None = None, limit: int | None = None, **readers) -> bool:
        """Reads a folder's documents and builds all strategies; False, with everything left as it was, without documents."""
        found = D.readable(checkpointed(D.read(D.scan(self.spark, base, limit), **readers)))
        return self.build_from(document_type, found, saved)

    def build_from(self, document_type: str, documents: DataFrame, saved: str | None = None) -> bool:
        """Builds all strategies from documents (file, content)."""
        documents = checkpointed(documents)
        if documents.isEmpty():
            log.warning("no documents of type %s", document_type)
            return False
        made = self._strategies(document_type, documents, saved)
        for strategy in STRATEGIES:
            self._loaded.pop((document_type, strategy), None)
        for strategy, entries in made.items():
            numbered, n = self._numbered(entries, 0)
            if n:
                self._loaded[document_type, strategy] = _Loaded(numbered, n)
        if saved:
            self.save(document_type, saved)
        return True

    def adopt(self, document_type: str, strategy: str, entries: DataFrame) -> None:
        """Takes entries (doc_index, file, text, embedding) that were made elsewhere as a loaded strategy; their numbers must be unique."""
        kept = checkpointed(entries.select("doc_index", "file", F.coalesce("text", F.lit("")).alias("text"), F.col("embedding").cast("array<float>").alias("embedding")))
        self._loaded[document_type, strategy] = _Loaded(kept, kept.count())

    def term_frequencies(self, document_type: str, strategy: str) -> DataFrame:
        """(term, df): in how many entries a term stands."""
        return lexical.frequencies(self._bm25(self._get(document_type, strategy)).texts)

    def _strategies(self, document_type: str, documents: DataFrame, saved: str | None) -> dict[str, DataFrame]:
        dim, prefix = self.embedding.dimension, self.options.document_prefix
        chunks = checkpointed(units.embedded(units.chunks(documents, ["file"], "content", self.options.chunk_words), "chunk_text", self._embed(), dim, prefix))
        made = {"chunks": chunks, "full": units.full(documents, chunks, ["file"], "content", dim)}
        if self.structure:
            found = providers.structured(documents, self.structure)
            made["sections"] = units.sections_of(found, ["file"], self._embed(), dim, prefix, self.options.chunk_words)
        else:
            schema = self.section_schema(document_type, documents, saved)
            if schema:
                made["sections"] = units.sections(documents, ["file"], "content", schema, self._embed(), dim, prefix, self.options.chunk_words)
        return made

    def section_schema(self, document_type: str, documents: DataFrame | None = None, saved: str | None = None, force: bool = False) -> list[sections.Section]:
        """The known schema of a type, else the saved one, else one that the chat provider is asked for."""
        if force or document_type not in self.schemas:
            stored = None if force else self._read_meta(saved, document_type).get("sections")
            if stored is not None:
                self.schemas[document_type] = sections.parse_schema([(s["name"], s["patterns"]) for s in stored])
            elif self.chat and documents is not None:
                samples = [r.content for r in documents.orderBy("file").select(F.substring("content", 1, 4000).alias("content")).limit(5).collect()]
                try:
                    self.schemas[document_type] = sections.calibrate(samples, document_type, self.chat)
                except Exception as error:  # not cached: the next build asks again
                    log.warning("no sections for %s: %s", document_type, error)
                    return []
        return self.schemas.get(document_type, [])

    @staticmethod
    def _numbered(entries: DataFrame, first: int) -> tuple[DataFrame, int]:
        """``entries`` with text and doc_index, and their number: counted from ``first`` by file, then by place in it.

        Sorted by ranges, so that a task numbers its own rows from where the
        ranges before it end; only the ranges' sizes are brought together.
        """
        order = [c for c in ("file", "chunk_index", "section_no", "section_name") if c in entries.columns]
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ranged = entries.withColumn("text", units.entry_text(entries)).repartitionByRange(*order).sortWithinPartitions(*order)
        ranged = checkpointed(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_at", at))
        sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
        starts, n = [], first
        for range_, size in sizes:
            starts.append((range_, n))
            n += size
        begin = entries.sparkSession.createDataFrame(starts, "_range int, _first long")
        # a row for each range
        numbered = ranged.join(F.broadcast(begin), "_range").withColumn("doc_index", F.col("_first") + F.col("_at")).drop("_range", "_first", "_at")
        return numbered, n - first

    # --- state ----------------------------------------------------------------------------------------------------

    def is_loaded(self, types: list[str], strategies: list[str]) -> bool:
        """Whether every type has every strategy; False for empty lists."""
        return bool(types and strategies) and all((t, s) in self._loaded for t in types for s in strategies)

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _versions(self, saved: str, document_type: str) -> list[tuple[int, str]]:
        """The saves of a type, oldest first, with their files."""
        fs, folder = self._files(f"{saved}/_meta/{quote(document_type, safe='')}")
        if not fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(folder))
        return sorted((int(name[:-5]), f"{folder.toString()}/{name}") for name in names if name.endswith(".json") and name[:-5].isdigit())

    def _read_meta(self, saved: str | None, document_type: str) -> dict:
        """What the newest save of a type says; nothing without one."""
        versions = self._versions(saved, document_type) if saved else []
        return self._meta(versions[-1][1]) if versions else {}

    def _meta(self, path: str) -> dict:
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def save(self, document_type: str, saved: str) -> None:
        """Writes the loaded strategies of a type; what the save before it had and this one has not is no longer found.

        The files of that save stay for those who read them; older ones are removed.
        """
        versions = self._versions(saved, document_type)
        written: dict[str, str] = {}
        folder = f"{saved}/_meta/{quote(document_type, safe='')}"
        number = versions[-1][0] + 1 if versions else 1
        staged = f"{folder}/{uuid.uuid4().hex}"
        try:
            for strategy in STRATEGIES:
                loaded = self._loaded.get((document_type, strategy))
                if loaded is None:
                    continue
                written[strategy] = target = f"{saved}/data/{quote(document_type, safe='')}/{strategy}/{uuid.uuid4().hex}"
                loaded.entries.write.parquet(target)
                if self.spark.read.parquet(target).count() != loaded.n:
                    raise RuntimeError("not all entries were written")
            meta = {"document_prefix": self.options.document_prefix, "strategies": {s: path.removeprefix(f"{saved}/") for s, path in written.items()}}
            if document_type in self.schemas:
                meta["sections"] = [{"name": s.name, "patterns": list(s.patterns)} for s in self.schemas[document_type]]
            fs, path = self._files(staged)
            out = fs.create(path, True)
            out.write(bytearray(json.dumps(meta, ensure_ascii=False).encode()))
            out.close()
            if not fs.rename(path, self._files(f"{folder}/{number:08d}.json")[1]):
                raise RuntimeError(f"save {number} of {document_type} was not put in force")
        except BaseException:
            for path in [*written.values(), staged]:
                fs, target = self._files(path)
                fs.delete(target, True)
            raise
        for strategy, path in written.items():
            self._loaded[document_type, strategy].entries = self.spark.read.parquet(path)
        kept = {*written.values(), *(f"{saved}/{path}" for _, file in versions[-1:] for path in self._meta(file).get("strategies", {}).values())}
        for _, file in versions[:-1]:
            for path in [f"{saved}/{p}" for p in self._meta(file).get("strategies", {}).values()] + [file]:
                if path not in kept:
                    fs, target = self._files(path)
                    fs.delete(target, True)

    def load(self, saved: str, types: list[str], strategies: list[str] = list(STRATEGIES)) -> dict[str, list[str]]:
        """Loads what the newest saves of the types have of the strategies; the result names what was found."""
        found: dict[str, list[str]] = {}
        for document_type in types:
            meta = self._read_meta(saved, document_type)
            if meta and meta.get("document_prefix", "") != self.options.document_prefix:
                log.warning("%s was embedded with another document prefix", document_type)
            if "sections" in meta:
                self.schemas[document_type] = sections.parse_schema([(s["name"], s["patterns"]) for s in meta["sections"]])
            for strategy in strategies:
                if strategy in meta.get("strategies", {}):
                    entries = self.spark.read.parquet(f"{saved}/{meta['strategies'][strategy]}")
                    self._loaded[document_type, strategy] = _Loaded(entries, entries.count())
                    found.setdefault(document_type, []).append(strategy)
                else:
                    log.warning("no saved %s of %s", strategy, document_type)
        return found

    def unload(self, document_type: str | None = None, strategy: str | None = None) -> None:
        """Forgets a strategy, a type or everything."""
        for key in [k for k in self._loaded if document_type in (None, k[0]) and strategy in (None, k[1])]:
            del self._loaded[key]

    def append(self, document_type: str, documents: DataFrame) -> None:
        """Adds documents (file, content) to the loaded strategies of a type; what was derived is dropped.

        Their entries are numbered on from the last one. All strategies are made before any changes.
        """
        if not any(t == document_type for t, _ in self._loaded):
            raise IndexMissing(f"{document_type} is not loaded")
        made = self._strategies(document_type, checkpointed(documents), None)
        joined = {}
        for strategy, entries in made.items():
            old = self._loaded.get((document_type, strategy))
            if old is not None:
                last = old.entries.agg(F.max("doc_index")).first()[0]
                more, n = self._numbered(entries, 0 if last is None else last + 1)
                joined[strategy] = _Loaded(old.entries.unionByName(more, allowMissingColumns=True), old.n + n)
        for strategy, loaded in joined.items():
            self._loaded[document_type, strategy] = loaded

    # --- searching ------------------------------------------------------------------------------------------------

    def _get(self, document_type: str, strategy: str, saved: str | None = None) -> _Loaded:
        """The loaded entries; loads them first where they are only saved. Only callers of the same strategy wait for one another."""
        key = document_type, strategy
        with self._lock:
            lock = self._locks[key]
        with lock:
            if key not in self._loaded and saved:
                self.load(saved, [document_type], [strategy])
            if key not in self._loaded:
                raise IndexMissing(f"{strategy} of {document_type}")
            return self._loaded[key]

    def _asked(self, queries: DataFrame) -> DataFrame:
        """Queries (query_id, query) with vectors; those without words are left out."""
        usable = queries.where(F.size(T.clean_tokens("query")) > 0).select("query_id", T.strip("query").alias("query"))
        return units.embedded(usable, "query", self._embed(), self.embedding.dimension, self.options.query_prefix).withColumnRenamed("embedding", "query_vector")

    def dense(self, queries: DataFrame, document_type: str, strategy: str, k: int = 10, saved: str | None = None) -> DataFrame:
        """(query_id, doc, distance, similarity, rank); the kind of search follows from the size of the index.

        A search that is not exact probes as many clusters, and reranks as many
        candidates by their stored vectors, as a recall of 0.9 needs. That is
        measured once for each ``k``; ``recall`` tells what was measured.
        """
        loaded = self._get(document_type, strategy, saved)
        asked = checkpointed(self._asked(queries))
        n = loaded.n
        kind = dense.choose_kind(n, self.options.index_kind, thresholds=self.options.kind_thresholds)
        if kind == "flat":
            return dense.exact(loaded.entries, asked, k, "doc_index")
        with loaded.lock:
            if loaded.cells is None:
                centres = dense.train_clusters(loaded.entries, "embedding", dense.list_count(n))
                loaded.cells = dense.build_cells(loaded.entries, centres, kind, doc="doc_index")
            cells = loaded.cells

            def search(queries: DataFrame, k: int, depth: tuple[int, int]) -> DataFrame:
                found = dense.search_cells(cells, queries, max(k, depth[1]), depth[0])
                return dense.reranked(found, loaded.entries, queries, k, "doc_index") if kind != "ivf_flat" else found.where(F.col("rank") <= k)

            if k not in loaded.depths:
                probes = dense.doubled(min(self.options.probes, len(cells.centres)), len(cells.centres))
                wide = dense.doubled(4 * k, max(4 * k, n)) if kind != "ivf_flat" else [k]
                steps = max(len(probes), len(wide))
                depths = [(probes[min(i, len(probes) - 1)], wide[min(i, len(wide) - 1)]) for i in range(steps)]
                loaded.depths[k] = dense.deep_enough(search, loaded.entries, k, depths, "doc_index")
                log.info("%s of %s: %s probes and candidates for a recall of %.3f of %d", strategy, document_type, *loaded.depths[k], k)
        return search(asked, k, loaded.depths[k][0])

    def recall(self, document_type: str, strategy: str, k: int = 10) -> float | None:
        """The recall of the ``k`` nearest measured for the dense search; 1 where it is exact, none before the first search."""
        loaded = self._get(document_type, strategy)
        if dense.choose_kind(loaded.n, self.options.index_kind, thresholds=self.options.kind_thresholds) == "flat":
            return 1.0
        return loaded.depths[k][1] if k in loaded.depths else None

    def _bm25(self, loaded: _Loaded) -> lexical.Bm25Index:
        with loaded.lock:
            if loaded.lexical is None:
                made = lexical.build(loaded.entries, "doc_index", "text")
                loaded.lexical = lexical.Bm25Index(made.texts, checkpointed(made.terms), checkpointed(made.corpus))
            return loaded.lexical

    def hybrid(self, queries: DataFrame, document_type: str, strategy: str, k: int = 10, pool: int | None = None, saved: str | None = None) -> DataFrame:
        """(query_id, doc, rrf_score, dense_rank, bm25_rank, rank)."""
        loaded = self._get(document_type, strategy, saved)
        size = fusion.pool_size(k, loaded.n, pool)
        found = lexical.top(self._bm25(loaded), queries.where(F.size(T.clean_tokens("query")) > 0), size)
        return fusion.fuse(self.dense(queries, document_type, strategy, size), found, k, self.options.rrf_k)

    def retrieve(
        self, queries: DataFrame, document_type: str, strategy: str, k: int = 5, use_hybrid: bool = False, use_rerank: bool = False, saved: str | None = None,
        pool: int | None = None, passages: int = rerank.PASSAGES,
    ) -> DataFrame:
        """The k best entries of each query, with all their scores.

        Columns: query_id, doc, rank, file, text and SCORES; a score is null
        where the kind of search has none. A reranker sees ``pool`` candidates,
        4k and at least 20 where it is not given, and at most ``passages`` of each.
        """
        entries = self._get(document_type, strategy, saved).entries.select(F.col("doc_index").alias("doc"), "file", "text")
        if use_rerank and self.reranker is None:
            raise ValueError("reranking needs a provider")
        wide = (pool or max(4 * k, 20)) if use_rerank else k
        found = self.hybrid(queries, document_type, strategy, wide) if use_hybrid else self.dense(queries, document_type, strategy, wide)
        found = found.join(entries, "doc")
        if use_rerank:
            found = checkpointed(found)
            candidates = found.select("query_id", "doc", "rank", "text").join(queries.select("query_id", "query"), "query_id")
            best = rerank.rerank(candidates, self.reranker, k, most=passages).select("query_id", "doc", "rerank_score", "rank")
            found = found.drop("rank").join(best, ["query_id", "doc"])
        scores = [F.col(c) if c in found.columns else F.lit(None).cast(kind).alias(c) for c, kind in SCORES.items()]
        return found.select("query_id", "doc", "rank", "file", "text", *scores)

    def search(self, query: str, document_type: str, strategy: str, k: int = 5, use_hybrid: bool = False, use_rerank: bool = False, saved: str | None = None) -> list[str]:
        """The texts of the best entries for one query, best first; none for a query without words."""
        one = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        self._get(document_type, strategy, saved)
        if one.where(F.size(T.clean_tokens("query")) > 0).isEmpty():
            return []
        return [r.text for r in self.retrieve(one, document_type, strategy, k, use_hybrid, use_rerank).orderBy("rank").collect()]

    def compare(self, queries: DataFrame, document_type: str, strategies: list[str], k: int = 15, use_hybrid: bool = False) -> DataFrame:
        """The results of every strategy for the distinct queries, as ``retrieve`` gives them, with the strategy."""
        queries = checkpointed(queries.groupBy("query").agg(F.min("query_id").alias("query_id")).select("query_id", "query"))
        parts = [self.retrieve(queries, document_type, s, k, use_hybrid).withColumn("strategy", F.lit(s)) for s in strategies]
        made = parts[0]
        for part in parts[1:]:
            made = made.unionByName(part)
        return made

    def heuristic_scores(self, compared: DataFrame, keywords: list[str], seconds: dict[str, float]) -> DataFrame:
        """Deprecated: (strategy, mean_score, std_score, n) of what ``compare`` gave, by a mixed score that does not measure relevance.

        ``seconds`` is the time that a query took in each strategy. Use ``evaluate`` with labelled queries.
        """
        warnings.warn("the heuristic score does not measure relevance: use evaluate with labelled queries", DeprecationWarning, stacklevel=2)
        made = None
        for strategy, time_of_one in seconds.items():
            hits = compared.where(F.col("strategy") == strategy)
            fused = evaluate.heuristic(hits.where("rrf_score is not null"), "rrf_score", keywords, time_of_one, hybrid=True)
            plain = evaluate.heuristic(hits.where("rrf_score is null"), "distance", keywords, time_of_one)
            part = fused.unionByName(plain).withColumn("strategy", F.lit(strategy))
            made = part if made is None else made.unionByName(part)
        return evaluate.strategy_summary(made)

    def generate_search(self, received: list[str], keywords: list[str], document_type: str, strategies: list[str], use_hybrid: bool = False) -> tuple[DataFrame, DataFrame]:
        """Deprecated: the 20 best entries of every strategy for the first of the queries, and the strategies' heuristic scores."""
        one = self.spark.createDataFrame([(0, received[0])], "query_id int, query string")
        found, seconds = None, {}
        for strategy in strategies:
            began = time.perf_counter()
            part = checkpointed(self.compare(one, document_type, [strategy], 20, use_hybrid))
            seconds[strategy] = time.perf_counter() - began
            found = part if found is None else found.unionByName(part)
        return found, self.heuristic_scores(found, keywords, seconds)

    def evaluate(self, labelled: DataFrame, document_type: str, strategies: list[str], k: int = 5, use_hybrid: bool = False, use_rerank: bool = False, **search) -> DataFrame:
        """The quality of each strategy over labelled queries (query_id, query, relevant_files, relevant_text)."""
        missing = [s for s in strategies if (document_type, s) not in self._loaded]
        if missing:
            raise ValueError(f"not loaded: {missing}")
        made = None
        for strategy in strategies:
            part = evaluate.metrics(checkpointed(self.retrieve(labelled, document_type, strategy, k, use_hybrid, use_rerank, **search)), labelled).withColumn("strategy", F.lit(strategy))
            made = part if made is None else made.unionByName(part)
        return made
