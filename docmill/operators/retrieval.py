"""Ranking: lexical and dense top-k, fusion, boosts, ordered dedupe, relevance, cross-references.

Queries are rows, so a batch is one plan. Query vectors travel to the corpus in blocks of bounded size,
and every corpus row is scored where it lies; a top-k keeps at most k rows for each query and task
before the one shuffle by query.
Ties always fall to the input order or the id, so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import rules
from ..functions.text import squeeze
from .index import asked_idf, doc_lengths, document_frequencies, tokens

#: Rows and bytes of a block of queries that travels to the vectors, and how many of them are multiplied at once.
BATCH_ROWS, QUERY_BYTES, MATRIX_QUERIES = 8192, 64 << 20, 256
#: Queries of a block of a lexical search, and words of the texts that are scored at once.
SEARCH_QUERIES, SEARCH_TOKENS = 65_536, 4_000_000
#: Scores that agree to so many digits are ties: sums of doubles depend on the order of their terms.
TIE_DIGITS = 9


def top(rows: DataFrame, k: int, order: list[Column], by: tuple[str, ...] = ("query_id",), rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1. Spark keeps k a group before the shuffle (WindowGroupLimit)."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


# ---------------------------------------------------------------- scoring


def bm25(queries: DataFrame, posted: DataFrame, lengths: DataFrame, stats: DataFrame, *, k1: float = rules.BM25_K1, b: float = rules.BM25_B, avgdl: float | None = None) -> DataFrame:
    """query_id, id, bm25_score of all documents that share a term with a query (repeated query terms count)."""
    avgdl = (lengths.agg(F.avg("dl")).first()[0] or 0.0) if avgdl is None else avgdl
    terms = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    wanted = terms.join(stats, "term").select("query_id", "term", "qf", "idf")
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("qf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    return posted.join(wanted, "term").join(lengths, "id").groupBy("query_id", "id").agg(F.sum(part).alias("bm25_score"))


def bm25_top(scores: DataFrame, k: int) -> DataFrame:
    """The best k with a positive score."""
    return top(scores.where("bm25_score > 0"), k, [F.round("bm25_score", TIE_DIGITS).desc(), F.col("id")])


def dense(queries: DataFrame, vectors: DataFrame, k: int, *, where: Column | None = None) -> DataFrame:
    """query_id, id, dense_distance (cosine distance of unit vectors), rank: exact nearest neighbours.

    The queries are a stated set against all rows. They travel in blocks whose number is fixed by their count,
    so a block is bounded whatever the batch; each block is one matrix product a batch of vectors, and a task
    gives the k nearest of all its vectors. Vectors that are null or of another length than the queries' are left out.
    """
    vectors = (vectors if where is None else vectors.where(where)).select("id", "embedding")
    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    count, longest = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    n_blocks = max(1, -(-count // max(1, min(BATCH_ROWS, QUERY_BYTES // (8 * max(1, longest or 1))))))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    parts = [_nearest(asked.where(block == i), vectors, k) for i in range(n_blocks)]
    return top(reduce(DataFrame.unionByName, parts), k, [F.round("dense_distance", TIE_DIGITS), F.col("id")])


def _nearest(asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, dense_distance: the k nearest of each task's vectors, for one block of queries."""
    held = asked.toArrow().combine_chunks()
    shared = asked.sparkSession.sparkContext.broadcast(held)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (vectors, "id"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = shared.value["query_id"].combine_chunks(), shared.value["embedding"]
        sizes = pc.list_value_length(rows).to_numpy()
        by_size = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        matrices = {n: np.array(rows.take(pa.array(at)).to_pylist()).reshape(len(at), n) for n, at in by_size.items()}
        best = {n: _Least(len(at), k) for n, at in by_size.items()}
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for n, matrix in matrices.items():
                fit = batch.filter(pa.array(lengths == n))
                if not fit.num_rows:
                    continue
                points = fit.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                for i in range(0, len(matrix), MATRIX_QUERIES):
                    best[n].add(i, 1 - matrix[i : i + MATRIX_QUERIES] @ points.T, fit.column("id").to_numpy(zero_copy_only=False))
        for n, found in best.items():
            for q, near, distance in found.rows():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(by_size[n][q])), pa.array(near, batch.column("id").type), pa.array(distance)], names=["query_id", "id", "dense_distance"])

    return vectors.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, dense_distance double")


class _Least:
    """The k least values of each row of a matrix whose columns come in batches; ties of TIE_DIGITS go by id.

    Once k are held, a batch costs one comparison a value: only what may enter is put in order.
    """

    def __init__(self, n: int, k: int) -> None:
        self.k, self.values, self.ids = k, np.full((n, k), np.inf), None

    def add(self, first: int, values: np.ndarray, ids: np.ndarray) -> None:
        """Values of the rows from `first` on, a column an id; inf never enters."""
        if self.ids is None:
            self.ids = np.zeros(self.values.shape, ids.dtype)
        limit = self.values[first : first + len(values), -1]
        if np.isinf(limit).any() and values.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(values, self.k - 1, axis=1)[:, self.k - 1])
        row, column = np.nonzero(values <= np.minimum(limit + 10.0**-TIE_DIGITS, np.finfo(float).max)[:, None])
        if not len(row):
            return
        met = np.unique(row)
        value = np.concatenate([values[row, column], self.values[first + met].ravel()])
        own, row = np.concatenate([ids[column], self.ids[first + met].ravel()]), np.concatenate([row, np.repeat(met, self.k)])
        order = np.lexsort((own.astype(str) if own.dtype == object else own, np.round(value, TIE_DIGITS), row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.values[first + row[kept], place[kept]], self.ids[first + row[kept], place[kept]] = value[order][kept], own[order][kept]

    def rows(self, size: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, id, value) of what is held, `size` rows of the matrix at a time."""
        for i in range(0, 0 if self.ids is None else len(self.values), size):
            row, place = np.nonzero(np.isfinite(self.values[i : i + size]))
            yield i + row, self.ids[i + row, place], self.values[i + row, place]


def bm25_search(queries: DataFrame, docs: DataFrame, k: int, *, k1: float = rules.BM25_K1, b: float = rules.BM25_B) -> DataFrame:
    """query_id, id, bm25_score, rank: the best k documents (id, text) of each query of a large batch, as `bm25_top` of `bm25` gives them.

    Weights of the asked terms travel to the texts; every text is scored where it lies, for all queries of a block,
    and a task gives at most k rows a query. No pair of a query and a document is shuffled before that.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")).toArrow()
    # dictionary order keeps the sums' order fixed
    asked = asked.sort_by([("query_id", "ascending"), ("term", "ascending")])
    n, avgdl = doc_lengths(docs).agg(F.count(F.lit(1)), F.avg("dl")).first()
    idf = asked_idf(document_frequencies(docs), pc.unique(asked["term"]).to_pylist(), n)
    idf = pa.table({"term": pa.array(idf, pa.string()), "idf": pa.array(idf.values(), pa.float64())})
    ids = pc.unique(asked["query_id"])
    parts = [
        _scored(asked.filter(pc.is_in(asked["query_id"], ids[i : i + SEARCH_QUERIES])).join(idf, "term", join_type="inner"), docs, k, k1, b, avgdl or 1.0, queries.schema["query_id"].dataType.simpleString())
        for i in range(0, max(1, len(ids)), SEARCH_QUERIES)
    ]
    return bm25_top(reduce(DataFrame.unionByName, parts), k)


def _scored(asked: pa.Table, docs: DataFrame, k: int, k1: float, b: float, avgdl: float, kind: str) -> DataFrame:
    """query_id, id, bm25_score: the k best of each task's documents; `asked`: query_id, term, qf, idf."""
    asked = asked.sort_by([("query_id", "ascending"), ("term", "ascending")]).combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = pc.unique(shared.value["term"]), pc.unique(shared.value["query_id"])
        term = pc.index_in(shared.value["term"], words).to_numpy()
        weight = shared.value["qf"].to_numpy() * shared.value["idf"].to_numpy() * (k1 + 1)
        ends = np.searchsorted(pc.index_in(shared.value["query_id"], ids).to_numpy(), np.arange(len(ids) + 1))
        best, kind_of_id = _Least(len(ids), k), None
        for batch in batches:
            kind_of_id = batch.column("id").type
            used = pc.sum(batch.column("terms").value_lengths()).as_py() or 0
            step = max(1, batch.num_rows * SEARCH_TOKENS // max(used, SEARCH_TOKENS))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                length = part.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                found = pc.index_in(part.column("terms").flatten(), words).fill_null(-1).to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(len(length)), length)[found >= 0]
                key, tf = np.unique(found[found >= 0].astype(np.int64) * len(length) + at, return_counts=True)
                at = key % len(length)
                share = tf / (tf + k1 * (1 - b + b * length[at] / avgdl))
                starts = np.searchsorted(key, np.arange(len(words) + 1) * len(length))
                for q in range(0, len(ids), MATRIX_QUERIES):
                    score = np.zeros((min(MATRIX_QUERIES, len(ids) - q), len(length)))
                    for row in range(len(score)):
                        for j in range(ends[q + row], ends[q + row + 1]):
                            own = slice(starts[term[j]], starts[term[j] + 1])
                            score[row, at[own]] += weight[j] * share[own]
                    best.add(q, np.where(score > 0, -score, np.inf), part.column("id").to_numpy(zero_copy_only=False))
        for q, near, value in best.rows():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(near, kind_of_id), pa.array(-value)], names=["query_id", "id", "bm25_score"])

    rows = docs.select("id", tokens(F.col("text")).alias("terms"))
    return rows.mapInArrow(run, f"query_id {kind}, id {rows.schema['id'].dataType.simpleString()}, bm25_score double")


def fuse(*sources: tuple[DataFrame, str, float], k: int = rules.RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of (hits with query_id, id, rank and a score, that score's name, weight).

    An id found by several sources keeps each one's score; `first_source` and `first_rank` tell
    where it was met first.
    """
    scores = [name for _, name, _ in sources]
    parts = [
        hits.select("query_id", "id", F.lit(i).alias("_s"), "rank", (F.lit(weight) / (k + F.col("rank"))).alias("_w"), *[(F.col(n) if n == name else F.lit(None).cast("double")).alias(n) for n in scores])
        for i, (hits, name, weight) in enumerate(sources)
    ]
    both = reduce(DataFrame.unionByName, parts)
    first = F.min(F.struct("_s", "rank"))
    fused = both.groupBy("query_id", "id").agg(F.sum("_w").alias("rrf_score"), first.alias("_first"), *[F.max(n).alias(n) for n in scores])
    return fused.select("query_id", "id", "rrf_score", F.col("_first._s").alias("first_source"), F.col("_first.rank").alias("first_rank"), *scores)


def dense_only(hits: DataFrame) -> DataFrame:
    """Dense hits where there are no lexical ones: no fused score, so boosts and the dense order decide."""
    return hits.select("query_id", "id", F.lit(None).cast("double").alias("rrf_score"), F.lit(0).alias("first_source"), F.col("rank").alias("first_rank"), "dense_distance")


# ---------------------------------------------------------------- boosts


def _number(c: Column, default: int) -> Column:
    return F.coalesce(F.nullif(c.cast("string").try_cast("int"), F.lit(0)), F.lit(default))


def boost(kind: str, meta: Column, rrf: Column, domain: Column | None = None) -> Column:
    """Score of a hit by recency, rank of the law and status.

    kind: `domain` (years count within the domain, others are pushed down), `plain` (years always
    count), `spec` (plain without the review penalty), `service` (years alone).
    """
    base = F.coalesce(rrf, F.lit(0.0))
    year = F.coalesce(F.nullif(_number(meta["publication_year"], 0), F.lit(0)), _number(meta["year"], 0))
    if kind == "service":
        return base + F.when(year != 0, F.least(F.greatest(year - 1945, F.lit(0)), F.lit(100)) / 10000).otherwise(0.0)
    recent = F.least(F.greatest(year - 2000, F.lit(0)), F.lit(40)) / 1000  # a quotient is the decimal's nearest double, a product may not be
    active = F.when(F.lower(F.coalesce(meta["active_status"], F.lit(""))) == "berlaku", 0.030).otherwise(0.0)
    years = F.when(domain, recent).otherwise(-0.100) if kind == "domain" else recent
    rank = F.greatest(F.lit(0), 6 - _number(meta["regulation_hierarchy"], rules.UNKNOWN_HIERARCHY)) * 3 / 1000
    review = F.when(F.coalesce(meta["quality_status"], F.lit("")) == "needs_review", 0.010).otherwise(0.0)
    return base + active + years + rank - (F.lit(0.0) if kind == "spec" else review)


def pre_score(query: Column, meta: Column) -> Column:
    """Penalty before reranking: inactive laws far down; named articles, recent and high laws up."""
    pasal = F.lower(F.coalesce(meta["pasal_id"], F.lit("")))
    year, rank = _number(meta["year"], 0), _number(meta["regulation_hierarchy"], 5)
    out = 1.0 + F.when(F.lower(F.coalesce(meta["active_status"], F.lit(""))) != "berlaku", 5.0).otherwise(0.0)
    out = out - F.when((pasal != "") & F.contains(F.lower(query), pasal), 0.5).otherwise(0.0)
    out = out - F.when(year > 2020, 0.2).when(year > 2010, 0.1).otherwise(0.0) - F.when(rank <= 2, 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.1), out)


ARTICLE_KEY = ("source_file", "pasal_id", "chunk_kind", "chunk_index")


def dedupe_top(hits: DataFrame, k: int, *, score: str = "final_score", ties: tuple[str, ...] = ("ord",), key: tuple[str, ...] = ARTICLE_KEY) -> DataFrame:
    """Best hit of each key, then the best k of each query."""
    order = [F.desc(score), *[F.col(t) for t in ties]]
    return top(top(hits, 1, order, ("query_id", *key), "_of_key").drop("_of_key"), k, order)


# ---------------------------------------------------------------- queries


def by_ids(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunks; what the chunks lack is left out."""
    return hits.join(chunks, "id")


def hybrid(dense_hits: DataFrame, chunks: DataFrame, k: int, *, meta: Column, sparse: DataFrame | None = None, kind: str = "domain", domain: Column | None = None) -> DataFrame:
    """The k best chunks of each query: dense and lexical hits fused and boosted, or dense hits alone; one a (source, article, kind, index)."""
    fused = dense_only(dense_hits) if sparse is None else fuse((dense_hits, "dense_distance", rules.DENSE_WEIGHT), (sparse, "bm25_score", rules.SPARSE_WEIGHT))
    rows = by_ids(fused, chunks)
    rows = rows if domain is None else rows.where(domain)
    rows = rows.withColumn("final_score", boost(kind, meta, F.col("rrf_score"), domain)).withColumn("_tied", F.round("final_score", TIE_DIGITS))
    return dedupe_top(rows, k, score="_tied", ties=("first_source", "first_rank", "id")).drop("_tied")


def retrieve_context(queries: DataFrame, search: Callable[[DataFrame], DataFrame], chunks: DataFrame, k: int, *, haystack: Column, narrow: Column, merge: str = "first", scorer=None, depth: int | None = None) -> DataFrame:
    """From questions (query_id, query) to their context: variants, search, merge, rerank, relevance.

    `search` takes variants (query_id, variant, query) and gives hits (query_id, variant, id, rank, final_score).
    Out: the chunks' columns with query_id, query, rank, context_relevance_score, context_rank.
    """
    depth = max(6 * k, 18) if depth is None else depth
    hits = merge_candidates(search(query_variants(queries)), merge)
    order = [F.col("variant"), F.col("rank"), F.col("id")] if merge == "first" else [F.desc("final_score"), F.col("variant"), F.col("rank"), F.col("id")]
    met = top(hits, depth, order, rank="_met").drop("rank").withColumnRenamed("_met", "rank")
    rows = by_ids(met, chunks).join(queries.select("query_id", "query"), "query_id")
    rows = rerank(rows, depth, None if scorer is None else lambda query, text: scorer(expanded(query), text))
    return relevant(rows, k, haystack=haystack, narrow=narrow)


def first_of_each(docs: DataFrame, limit: int, *, key: tuple[str, ...] = ("source_file", "pasal_id", "chunk_index", "id")) -> DataFrame:
    """Context documents without repeats, in order of rank; `limit` a query."""
    return top(top(docs, 1, [F.col("rank")], ("query_id", *key), "_of_key").drop("_of_key"), limit, [F.col("rank")], rank="place")


def expanded(query: Column, expansions=rules.EXPANSIONS) -> Column:
    """The query with the expansions that any of their triggers calls for."""
    low = F.lower(query)
    return squeeze(F.concat_ws(" ", query, *[F.when(q.any_of(low, triggers), F.lit(more)) for triggers, more in expansions]))


def query_variants(queries: DataFrame, expansions=rules.EXPANSIONS) -> DataFrame:
    """query_id, variant (1: as asked, 2: expanded where that differs), query."""
    both = F.array_distinct(F.array(F.col("query"), expanded(F.col("query"), expansions)))
    return queries.select("query_id", F.posexplode(both).alias("_at", "query")).select("query_id", (F.col("_at") + 1).alias("variant"), "query")


def query_terms(query: Column, stopwords=rules.STOPWORDS) -> Column:
    found = F.array_distinct(tokens(query))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*stopwords))


def merge_candidates(hits: DataFrame, how: str = "best") -> DataFrame:
    """One row of each (query, id): that with the `best` score, or the `first` met (variant, then rank)."""
    pick = F.max_by if how == "best" else F.min_by
    by = F.struct(F.col("final_score"), -F.col("variant"), -F.col("rank")) if how == "best" else F.struct("variant", "rank")
    return hits.groupBy("query_id", "id").agg(pick(F.struct("variant", "rank", "final_score"), by).alias("_hit")).select("query_id", "id", "_hit.*")


def rerank(hits: DataFrame, k: int, scorer=None) -> DataFrame:
    """By a scorer (Column, Column) -> Column of (query, text), else as they stand."""
    if scorer is None:
        return top(hits, k, [F.col("rank")], rank="_rerank").drop("_rerank")
    scored = hits.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    return top(scored.drop("rank"), k, [F.desc("rerank_score"), F.col("id")])


def relevance(query: Column, haystack: Column, score: Column, expansions=rules.EXPANSIONS) -> Column:
    """Share of the expanded query's terms in the text, less 0.25 if no specific term of the question occurs, plus a little of the score."""
    wide, asked = query_terms(expanded(query, expansions)), query_terms(query)
    hay = F.lower(haystack)
    share = F.size(F.filter(wide, lambda t: F.contains(hay, t))) / F.greatest(F.size(wide), F.lit(1))
    special = F.filter(asked, lambda t: ~t.isin(*rules.GENERIC_TERMS))
    miss = F.when((F.size(special) > 0) & ~F.exists(special, lambda t: F.contains(hay, t)), 0.25).otherwise(0.0)
    return F.when(F.size(wide) == 0, 1.0).otherwise(share - miss + F.coalesce(F.least(score, F.lit(1.0)), F.lit(0.0)) * 0.05)


def specific_overlap(query: Column, haystack: Column) -> Column:
    special = F.filter(query_terms(query), lambda t: ~t.isin(*rules.GENERIC_TERMS))
    hay = F.lower(haystack)
    return (F.size(special) == 0) | F.exists(special, lambda t: F.contains(hay, t))


def relevant(docs: DataFrame, k: int, *, haystack: Column, narrow: Column, order: str = "rank", score: str = "final_score") -> DataFrame:
    """The k most relevant documents of each query; a query that keeps none gets its first document."""
    query = F.col("query")
    terms = F.size(query_terms(expanded(query)))
    judged = docs.withColumn("context_relevance_score", relevance(query, haystack, F.col(score)))
    value = F.col("context_relevance_score")
    overlap = F.bround(F.greatest(value, F.lit(0.0)) * F.greatest(terms, F.lit(1)))
    fits = specific_overlap(query, narrow) & ((terms == 0) | (overlap >= 1)) & (value > 0)
    best = top(judged.where(fits), k, [F.desc("context_relevance_score"), F.col(order)], rank="context_rank")
    # both tops keep a few rows a query and task before their shuffle; no query's rows meet as a whole
    first = top(docs.withColumn("context_relevance_score", F.lit(None).cast("double")), 1, [F.col(order)], rank="context_rank")
    return best.unionByName(first.join(best.select("query_id").distinct(), "query_id", "left_anti"))


def reference_key(kind: Column, nomor: Column, published: Column, year: Column) -> list[Column]:
    """Join keys of a regulation."""
    return [q.regulation_kind(kind).alias("k_kind"), F.trim(F.coalesce(nomor, F.lit(""))).alias("k_nomor"), F.coalesce(F.nullif(published, F.lit(0)), year, F.lit(0)).alias("k_year")]


def cross_references(primary: DataFrame, chunks: DataFrame, referenced: Column, *, limit: int, topic_guard: bool = True) -> DataFrame:
    """Articles of the same regulation that the primary documents refer to, as further context.

    primary: query_id, rank, reg, source_file, pasal_id and what `referenced` reads; chunks: reg, pasal_id,
    source_file, id, ord. With `topic_guard` an article counts only if that number already is among the
    query's primaries. An article already there (source, article) is skipped; of repeated articles the first by
    order counts.
    """
    asked = primary.select("query_id", "rank", "reg", "pasal_id", F.posexplode(referenced).alias("at", "target")).where(F.lower("target") != F.lower("pasal_id"))
    asked = asked.withColumn("_t", F.lower("target"))
    if topic_guard:
        asked = asked.join(primary.select("query_id", F.lower("pasal_id").alias("_t")).distinct(), ["query_id", "_t"], "left_semi")
    first = top(chunks.withColumn("_t", F.lower("pasal_id")), 1, [F.col("ord")], ("reg", "_t"), "_n").select("reg", "_t", F.col("pasal_id").alias("found_pasal"), "source_file", "id")
    found = asked.join(first, ["reg", "_t"])
    seen = primary.select("query_id", "source_file", F.col("pasal_id").alias("found_pasal"))
    fresh = found.join(seen, ["query_id", "source_file", "found_pasal"], "left_anti")
    once = top(fresh, 1, [F.col("rank"), F.col("at")], ("query_id", "source_file", "found_pasal"), "_n").drop("_n")
    return top(once.withColumnRenamed("rank", "from_rank"), limit, [F.col("from_rank"), F.col("at")], rank="xref_rank").select("query_id", "id", "source_file", F.col("found_pasal").alias("pasal_id"), "from_rank", "xref_rank", F.lit(0.99).alias("context_relevance_score"))


def siblings(main: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, id, text: all parts of the hit's article in order, the hit itself between marks."""
    rows = main.select("query_id", F.col("id").alias("main_id"), "source_file", "pasal_id").join(chunks.select("id", "source_file", "pasal_id", "chunk_index", "text", "ord"), ["source_file", "pasal_id"])
    shown = F.when(F.col("id") == F.col("main_id"), F.concat(F.lit(">>> "), F.col("text"), F.lit(" <<<"))).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "ord", shown.alias("t"))))
    return rows.groupBy("query_id", F.col("main_id").alias("id")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def context_text(docs: DataFrame, *, citation: Column, text: Column, longest: int | None = None, label: str = "SUMBER HUKUM") -> DataFrame:
    """query_id, context: numbered blocks in order of rank."""
    shown = F.trim(text) if longest is None else F.left(F.trim(text), F.lit(longest))
    blocks = F.array_sort(F.collect_list(F.struct("rank", citation.alias("c"), shown.alias("t"))))
    block = lambda b, i: F.concat(F.lit(label + " "), (i + 1).cast("string"), F.lit(": "), b["c"], F.lit("\n"), b["t"])
    return docs.groupBy("query_id").agg(F.array_join(F.transform(blocks, block), "\n\n").alias("context"))


def reference_list(docs: DataFrame, citation: Column) -> DataFrame:
    """query_id, citation, place: distinct citations in order of first appearance. A query's documents are the few of its context."""
    first = docs.select("query_id", "rank", citation.alias("citation")).groupBy("query_id", "citation").agg(F.min("rank").alias("rank"))
    return top(first, 1 << 30, [F.col("rank"), F.col("citation")], rank="place").select("query_id", "citation", "place")
