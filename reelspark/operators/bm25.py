"""BM25 text search for batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from reelspark.functions.text import tokens
from reelspark.operators.skew import small_side
from reelspark.session import materialize, parallelism


def corpus_terms(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, term, tf, length) of the documents (doc_id, text) that have any token."""
    words = tokens(F.col("text"))
    rows = docs.select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("length"), F.explode("w").alias("term"))
    return rows.groupBy("doc_id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """Rows (term, df): in how many documents a term occurs."""
    return corpus_terms(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: Scores are summed in whole units of this size, so that the order of the sum does not matter.
UNIT = 1e-12


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Rows (query_id, doc_id, score) of all documents that share a term with a query.

    ``docs`` has (doc_id, text), ``queries`` (query_id, text). A term that a query repeats
    counts as often. The corpus is read once, and only the queries' terms of it move, by
    document, so that no frequent term is gathered in a task; what is known of terms and
    queries is sent to all tasks where it is small. Scores are rounded to 9 digits, so that
    equal documents tie. Null texts have no terms; documents without tokens count for the
    mean length. A doc_id must not repeat.
    """
    wanted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = small_side(wanted)
    words = docs.select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("length"), F.explode(F.array_append("w", F.lit(None).cast("string"))).alias("term"))
    terms = small_side(wanted.select("term").distinct().withColumn("asked", F.lit(True)))
    # The row without a term stands for the document itself.
    kept = words.join(terms, "term", "left").where("term is null or asked").select("doc_id", "length", "term")
    counted = materialize(kept.repartition(parallelism(docs), "doc_id").groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf")))
    n, total = counted.where("term is null").agg(F.count(F.lit(1)), F.sum("length")).collect()[0]
    mean = (total or 0) / n if n else 0.0
    postings = counted.where("term is not null")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = small_side(wanted.join(df.select("term", idf.alias("idf")), "term"))
    norm = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / F.lit(mean or 1.0))
    part = F.round(F.col("idf") * F.col("tf") * (k1 + 1) / norm * F.col("times") / F.lit(UNIT)).cast("bigint")
    # Postings lie by document: what a document adds up to stays in its task.
    scored = postings.repartition(parallelism(docs), "doc_id").join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("units"))
    return scored.select("query_id", "doc_id", F.round(F.col("units") * F.lit(UNIT), 9).alias("score"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Rows (query_id, doc_id, score, rank): the ``k`` best documents per query, ties by doc_id."""
    return best_documents(docs, queries, None, k, k1, b).drop("key")


def best_per_key(scores: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, key, doc_id, score, rank): the best document of every key, then the ``k`` best keys.

    ``keys`` maps doc_id to the key its evidence counts for (a keyframe, say); documents
    without a key are dropped. All documents are scored before they are grouped.
    """
    joined = scores.join(keys.where("key is not null"), "doc_id")
    return _first_keys(joined, k)


def _first_keys(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best keys of every query in rows (query_id, key, doc_id, score), each with its best document."""
    best = scored.groupBy("query_id", "key").agg(F.min(F.struct((F.lit(0.0) - F.col("score")).alias("neg"), F.col("doc_id"))).alias("b"))
    rows = best.select("query_id", "key", F.col("b.doc_id").alias("doc_id"), (F.lit(0.0) - F.col("b.neg")).alias("score"))
    place = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


#: Terms of distinct documents that a task holds, and of queries.
BLOCK_TERMS, QUERY_TERMS = 400_000, 500_000


def best_documents(docs: DataFrame, queries: DataFrame, keys: DataFrame | None, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Rows (query_id, key, doc_id, score, rank) as of ``best_per_key(bm25_scores(docs, queries), keys, k)``.

    Without ``keys`` every document is its own key. The scores of a query never leave the
    task that adds them up. Documents of the same words are alike to any query, so they are
    scored once, as a bag of words; of a bag the 2 ``k`` first keys are kept: fewer than
    ``k`` of them can stand before with a better bag, so ``k`` are left. Blocks of bags meet
    blocks of queries, and each pair of blocks gives at most ``k`` keys a query.
    """
    tasks = parallelism(docs)
    word = F.explode(tokens(F.col("text")))
    wanted = materialize(queries.select("query_id", word.alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))
    # Tokens have no spaces.
    bags = materialize(docs.select("doc_id", F.array_join(F.array_sort(tokens(F.col("text"))), " ").alias("bag")))
    words = F.when(F.col("bag") == "", F.array().cast("array<string>")).otherwise(F.split("bag", " "))
    counts = materialize(bags.groupBy("bag").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.array_distinct(words)).withColumn("length", F.size(words)))
    n, total, terms = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("length")), F.sum(F.size("w"))).collect()[0]
    mean = (total or 0) / n if n else 0.0
    df = counts.select("n", F.explode("w").alias("term")).join(small_side(wanted.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = wanted.join(small_side(df.select("term", idf.alias("idf"))), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "times", "idf")).alias("terms"))
    held = bags.where("bag <> ''")
    if keys is None:
        held = held.select("bag", F.col("doc_id").alias("key"), "doc_id")
    else:
        held = held.join(keys.where("key is not null").select("doc_id", "key"), "doc_id").groupBy("bag", "key").agg(F.min("doc_id").alias("doc_id"))
    place = F.row_number().over(W.Window.partitionBy("bag").orderBy("key"))
    held = held.withColumn("place", place).where(F.col("place") <= 2 * k).groupBy("bag").agg(F.collect_list(F.struct("key", "doc_id")).alias("held"))
    blocks = -(-(terms or 1) // BLOCK_TERMS)
    turns = max(-(-tasks // blocks), -(-wanted.count() // QUERY_TERMS))
    part = _even(docs.sparkSession, blocks * turns, tasks)
    block, turn = F.pmod(F.xxhash64("bag"), F.lit(blocks)), F.pmod(F.xxhash64("query_id"), F.lit(turns))
    left = held.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda t: part[(block * turns + t).cast("int")])))
    right = asked.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: part[(x * turns + turn).cast("int")])))
    key_type = held.schema["held"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), *[T.StructField(f.name, f.dataType) for f in key_type.fields], T.StructField("score", T.DoubleType())])
    pairs = left.repartition(tasks, "part").groupBy("part").cogroup(right.repartition(tasks, "part").groupBy("part"))
    return _first_keys(pairs.applyInArrow(_scorer(k, k1, b, mean or 1.0, to_arrow_schema(schema)), schema), k)


def _even(spark: SparkSession, n: int, tasks: int) -> Column:
    """``n`` numbers whose hashes are dealt to ``tasks`` partitions in turn, as an array."""
    found: list[list[int]] = [[] for _ in range(tasks)]
    most = -(-n // tasks)
    start, step = 0, 20 * (n + tasks)
    while any(len(x) < most for x in found):
        for number, task in spark.range(start, start + step, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(tasks))).collect():
            if len(found[task]) < most:
                found[task].append(number)
        start += step
    return F.array(*[F.lit(found[i % tasks][i // tasks]).cast("bigint") for i in range(n)])


def _scorer(k: int, k1: float, b: float, mean: float, schema: pa.Schema):
    def run(bags: pa.Table, asked: pa.Table) -> pa.Table:
        if not bags.num_rows or not asked.num_rows:
            return schema.empty_table()
        n = bags.num_rows
        words = pc.split_pattern(bags.column("bag").combine_chunks(), " ")
        lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        terms = pc.list_flatten(asked.column("terms").combine_chunks())
        n_terms = pc.list_value_length(asked.column("terms").combine_chunks()).to_numpy()
        code = pc.fill_null(pc.index_in(pc.struct_field(terms, "term"), value_set=coded.dictionary), -1).to_numpy().astype(np.int64)
        times = pc.struct_field(terms, "times").to_numpy()
        there = code >= 0
        idf = np.zeros(len(coded.dictionary))
        idf[code[there]] = pc.struct_field(terms, "idf").to_numpy()[there]
        # Postings by term, then bag.
        of, bag = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), lengths)
        used = idf[of] > 0
        posting, tf = np.unique(of[used] * n + bag[used], return_counts=True)
        of, bag = posting // n, posting % n
        starts = np.searchsorted(of, np.arange(len(idf) + 1))
        base = idf[of] * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * lengths[bag] / mean))
        held = bags.column("held").combine_chunks()
        sizes = pc.list_value_length(held).to_numpy().astype(np.int64)
        first = np.cumsum(sizes) - sizes
        flat = pc.list_flatten(held)
        keys, documents = pc.struct_field(flat, "key"), pc.struct_field(flat, "doc_id")
        by_key, by_doc = (pc.rank(x, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) for x in (keys, documents))
        parts: dict[tuple[int, int], np.ndarray] = {}
        units = np.zeros(n, np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        for q, size in enumerate(n_terms.tolist()):
            units[:] = 0
            for t, often in zip(code[at : at + size].tolist(), times[at : at + size].tolist()):
                if t >= 0:
                    own = slice(starts[t], starts[t + 1])
                    if (t, often) not in parts:
                        parts[t, often] = np.floor(base[own] * often / UNIT + 0.5).astype(np.int64)
                    units[bag[own]] += parts[t, often]
            at += size
            which, level = _first_members(units, k, first, sizes, by_key, by_doc)
            out.append((np.full(len(which), q), which, level))
        q, which, level = (np.concatenate(x) for x in zip(*out))
        columns = [asked.column("query_id").combine_chunks().take(pa.array(q)), keys.take(pa.array(which)), documents.take(pa.array(which)), pa.array(level / 1e9)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _levels(units: np.ndarray) -> np.ndarray:
    """Scores in units of the ninth digit, which they are rounded to."""
    return np.floor(units * UNIT * 1e9 + 0.5).astype(np.int64)


def _first_members(units: np.ndarray, k: int, first: np.ndarray, sizes: np.ndarray, by_key: np.ndarray, by_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all bags' members (documents with their keys) the best one of each of the ``k`` best keys, and their levels."""
    n, m = len(units), k
    while True:
        # All bags as good as the m-th, ties alike; keys that several bags share may ask for more of them.
        least = np.partition(units, n - m)[n - m] if m < n else 0
        near = np.flatnonzero(units > max(0, least - 2_000))
        level = _levels(units[near])
        if least > 0:
            good = level >= _levels(np.array([least]))[0]
            near, level = near[good], level[good]
        size = sizes[near]
        member = np.arange(size.sum()) + np.repeat(first[near] - (np.cumsum(size) - size), size)
        level = np.repeat(level, size)
        order = np.lexsort((by_doc[member], by_key[member], -level))
        _, once = np.unique(by_key[member][order], return_index=True)
        if least <= 0 or len(once) >= k:
            chosen = order[np.sort(once)[:k]]
            return member[chosen], level[chosen]
        m *= 4
