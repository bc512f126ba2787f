"""Document frequency, tf-idf ranking and the cosine family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.numbers import inverse_document_frequency
from spanloom.operators.topk import top_per_group
from spanloom.session import cut, small, with_scalar


def whitespace_terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, term: one row per token between white space; null and empty texts have none."""
    return docs.select(F.col(doc_id).alias("doc"), F.explode(F.split(F.col(text), r"[ \t\n\r\f\x0B]+")).alias("term")).filter("term <> ''")


def term_frequencies(terms: DataFrame) -> DataFrame:
    """doc, term, tf."""
    return terms.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """term, df from the (doc, term) counts: no second distinct."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def n_documents(tf: DataFrame) -> DataFrame:
    """One row: the number of documents with a term."""
    return tf.agg(F.count_distinct("doc").alias("n_docs"))


def with_idf(tf: DataFrame, smooth: bool = False) -> DataFrame:
    """tf with df, n_docs, z (terms in the document) and idf. The count of documents is one broadcast row; df joins by term."""
    z = tf.groupBy("doc").agg(F.sum("tf").alias("z"))
    j = with_scalar(tf.join(document_frequencies(tf), "term").join(z, "doc"), n_documents(tf))
    return j.withColumn("idf", inverse_document_frequency(F.col("n_docs"), F.col("df"), smooth))


def important_terms(tf: DataFrame, k: int, least: float = 1e-4) -> DataFrame:
    """doc, term, score, rank: the k terms with the largest tf * idf of at least `least`."""
    scored = with_idf(tf).withColumn("score", F.col("tf") * F.col("idf")).filter(F.col("score") >= least)
    return top_per_group(scored.select("doc", "term", "score"), ["doc"], [F.col("score").desc(), F.col("term")], k)


def average_idf(tf: DataFrame) -> DataFrame:
    """doc, avg_idf: (sum of idf over its tokens + 1) / (tokens + 1) (M8)."""
    return with_idf(tf).groupBy("doc").agg(((F.sum(F.col("idf") * F.col("tf")) + 1) / (F.sum("tf") + 1)).alias("avg_idf"))


def idf_table(tf: DataFrame) -> DataFrame:
    """term, idf of a collection, and a row with a null term for terms that it lacks (df 1; M1)."""
    table = with_scalar(document_frequencies(tf), n_documents(tf)).select("term", inverse_document_frequency(F.col("n_docs"), F.col("df")).alias("idf"))
    return table.unionByName(n_documents(tf).select(F.lit(None).cast("string").alias("term"), F.log(F.col("n_docs").cast("double")).alias("idf")))


def weighed(tf: DataFrame, idfs: DataFrame, kind: str = "plain", temperature: float = 1.0) -> DataFrame:
    """doc, term, w, idf of vectors weighed by another collection's idf_table; the kinds are those of components()."""
    unseen = idfs.filter("term is null").select(F.col("idf").alias("__unseen"))
    z = tf.groupBy("doc").agg(F.sum("tf").alias("z"))
    x = with_scalar(tf.join(idfs.filter("term is not null"), "term", "left"), unseen).withColumn("idf", F.coalesce("idf", "__unseen")).join(z, "doc")
    return x.select("doc", "term", _component(kind, temperature).alias("w"), "idf")


def _component(kind: str, temperature: float) -> Column:
    share = F.col("tf") / F.col("z")
    return {"plain": share * F.sqrt("idf"), "exp": share * F.exp(F.sqrt("idf") * temperature), "maxexp": share}[kind]


def components(tf: DataFrame, kind: str = "plain", temperature: float = 1.0) -> DataFrame:
    """doc, term, w for the cosine family: plain (tf/z) sqrt(idf), exp (tf/z) exp(sqrt(idf) t) (M2, M3); idf for maxexp (M4)."""
    return with_idf(tf).select("doc", "term", _component(kind, temperature).alias("w"), "idf")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df) else df


def cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_l, doc_r, sim of two sets of sparse vectors (doc, term, w): equi-join on the term, only pairs that share one.

    The right side should be a stated, bounded set of vectors (queries, label prototypes); the join is never all against all.
    Where its size allows, it is broadcast, so a term that is in every document of the left gathers nothing.
    """
    right = cut(right.select("doc", "term", "w"), "bounded")
    norm = lambda df: df.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = (
        left.select(F.col("doc").alias("doc_l"), "term", F.col("w").alias("wl"))
        .join(_bounded(right.select(F.col("doc").alias("doc_r"), "term", F.col("w").alias("wr"))), "term")
        .groupBy("doc_l", "doc_r").agg(F.sum(F.col("wl") * F.col("wr")).alias("dot"))
    )
    j = dot.join(norm(left).select(F.col("doc").alias("doc_l"), F.col("norm").alias("nl")), "doc_l").join(norm(right).select(F.col("doc").alias("doc_r"), F.col("norm").alias("nr")), "doc_r")
    return j.filter("nl > 0 and nr > 0").select("doc_l", "doc_r", (F.col("dot") / (F.col("nl") * F.col("nr"))).alias("sim"))


def cosine_maxexp(left: DataFrame, right: DataFrame, temperature: float = 1.0) -> DataFrame:
    """The variant whose components are scaled by the largest idf of the pair (M4): (tf/z) sqrt(exp(idf / max idf * t)).

    The pair's maximum is known only per pair, so norms can't be computed beforehand; pairs that share a term are formed
    first, then both vectors are joined to their pairs.
    """
    right = cut(right.select("doc", "term", "w", "idf"), "bounded")
    pairs = left.select(F.col("doc").alias("doc_l"), "term").join(_bounded(right.select(F.col("doc").alias("doc_r"), "term")), "term").select("doc_l", "doc_r").distinct()
    top = lambda df, d: df.groupBy(F.col("doc").alias(d)).agg(F.max("idf").alias(f"m_{d}"))
    pairs = pairs.join(top(left, "doc_l"), "doc_l").join(top(right, "doc_r"), "doc_r").select("doc_l", "doc_r", F.greatest("m_doc_l", "m_doc_r").alias("m"))
    w = F.col("w") * F.sqrt(F.exp(F.when(F.col("m") > 0, F.col("idf") / F.col("m")).otherwise(0.0) * temperature))
    side = lambda df, d: pairs.join(df.withColumnRenamed("doc", d), d).select("doc_l", "doc_r", "term", w.alias("v"))
    both = side(left, "doc_l").select("*", F.lit(0).alias("s")).unionByName(side(right, "doc_r").select("*", F.lit(1).alias("s")))
    per = both.groupBy("doc_l", "doc_r", "term").agg(F.sum(F.when(F.col("s") == 0, F.col("v"))).alias("a"), F.sum(F.when(F.col("s") == 1, F.col("v"))).alias("b"))
    sq = lambda c: F.sqrt(F.sum(F.coalesce(F.col(c) * F.col(c), F.lit(0.0))))
    return per.groupBy("doc_l", "doc_r").agg((F.sum(F.coalesce(F.col("a") * F.col("b"), F.lit(0.0))) / (sq("a") * sq("b"))).alias("sim"))


def cosine_against(left: DataFrame, right: DataFrame, maxexp: bool = False, temperature: float = 1.0, block: int = 1_000) -> DataFrame:
    """doc_l, doc_r, sim as cosine() or, with maxexp, cosine_maxexp() give them, for a left side of any size.

    The right side is a stated query set: its vectors are sent to all tasks in blocks of about `block` documents. A document
    of the left side meets a whole block in one matrix product, so no row per shared term is made or shuffled.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    types = [dict(df.dtypes)["doc"] for df in (left, right)]
    schema = f"doc_l {types[0]}, doc_r {types[1]}, sim double"
    docs = left.groupBy("doc").agg(F.collect_list(F.struct("term", "w", "idf")).alias("terms"))
    right = right.select("doc", "term", "w", "idf")
    parts = None
    blocks = max(1, -(-right.select("doc").distinct().count() // block))
    for b in range(blocks):
        held = right.filter(F.pmod(F.xxhash64("doc"), F.lit(blocks)) == b).collect()
        if not held:
            continue
        ids, vocabulary = sorted({r.doc for r in held}), sorted({r.term for r in held})
        at = [{x: i for i, x in enumerate(xs)} for xs in (ids, vocabulary)]
        # what travels is as long as the block's vectors; the matrices are made in the task
        cells = tuple(np.array(x) for x in ([at[0][r.doc] for r in held], [at[1][r.term] for r in held], [r.w for r in held], [r.idf for r in held]))

        def run(batches, ids=ids, vocabulary=vocabulary, cells=cells):
            names, words = pa.array(ids), pa.array(vocabulary)
            weight, there = (np.zeros((len(ids), len(vocabulary)), t) for t in (np.float64, np.float32))
            weight[cells[:2]], there[cells[:2]] = cells[2], 1
            idfs = np.zeros(weight.shape if maxexp else (0, 0))
            if maxexp:
                idfs[cells[:2]] = cells[3]

            def scaled(w, idf, m):
                return w * np.sqrt(np.exp(idf / m * temperature)) if m > 0 else w * 1.0

            def sims(n, rows, cols, hit, w, r):
                dense = np.zeros((n, len(vocabulary)))
                dense[rows[hit], cols[hit]] = w[hit]
                norms = np.sqrt(np.bincount(rows, w * w, minlength=n))[:, None] * np.sqrt((r * r).sum(axis=1))[None, :]
                return np.divide(dense @ r.T, norms, out=np.zeros(norms.shape), where=norms > 0), norms > 0

            for batch in batches:
                for start in range(0, batch.num_rows, 128):
                    part = batch.slice(start, 128)
                    n, lists = part.num_rows, part.column(1)
                    rows = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                    term, w, idf = lists.flatten().flatten()
                    w, idf = w.to_numpy(zero_copy_only=False), idf.to_numpy(zero_copy_only=False)
                    cols = pc.index_in(term, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
                    hit = cols >= 0
                    shared = np.zeros((n, len(vocabulary)), np.float32)
                    shared[rows[hit], cols[hit]] = 1
                    ok = shared @ there.T > 0
                    if maxexp:
                        top = np.zeros(n)
                        np.maximum.at(top, rows, idf)
                        largest = np.maximum.outer(top, idfs.max(axis=1))
                        sim = np.zeros(ok.shape)
                        for m in np.unique(largest[ok]):
                            # only the documents and items that have a pair with this maximum
                            mine = largest == m
                            keep, items = mine.any(axis=1), np.flatnonzero(mine.any(axis=0))
                            sel = keep[rows]
                            new = np.cumsum(keep) - 1
                            got, _ = sims(int(keep.sum()), new[rows[sel]], cols[sel], hit[sel], scaled(w[sel], idf[sel], m), scaled(weight[items], idfs[items], m))
                            box = np.ix_(keep, items)
                            sim[box] = np.where(mine[box], got, sim[box])
                    else:
                        sim, positive = sims(n, rows, cols, hit, w, weight)
                        ok &= positive
                    i, j = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), names.take(pa.array(j)), pa.array(sim[i, j])], names=["doc_l", "doc_r", "sim"])

        part = docs.mapInArrow(run, schema)
        parts = part if parts is None else parts.unionByName(part)
    return left.sparkSession.createDataFrame([], schema) if parts is None else parts
