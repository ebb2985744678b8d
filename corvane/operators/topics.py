"""Latent Dirichlet allocation by collapsed Gibbs sampling.

Documents are dealt by hash into chunks of about CHUNK words. An iteration counts words and topics, joins to each chunk
the counts of its own words, and samples all topics of a chunk against them; so no task holds the vocabulary. Words
are sampled TURNS of a document's at a time: those of one turn see the counts that the turns before left in the chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.iteration import cut, stored

#: Bytes of the word-topic table, which is on the driver once it is trained.
LIMIT = 1 << 30
#: Words of a chunk.
CHUNK = 1 << 18
#: Turns in which a document's words are sampled, and numbers of a step's tables.
TURNS, CELLS = 8, 1 << 19


def _stream(seed: int, doc) -> np.random.Generator:
    """A document's random numbers, by its whole id."""
    return np.random.default_rng([seed, *hashlib.blake2b(repr(doc).encode(), digest_size=16).digest()])


def _counts(docs: DataFrame) -> DataFrame:
    """(w, z, n): how often each word has each topic."""
    pairs = docs.select(F.explode(F.arrays_zip(F.col("words").alias("w"), F.col("assigned").alias("z"))).alias("p"))
    return pairs.groupBy(F.col("p")["w"].alias("w"), F.col("p")["z"].cast("long").alias("z")).agg(F.count("*").alias("n"))


def _table(counts: DataFrame, voc: int, topics: int) -> np.ndarray:
    """Word-topic counts as an array."""
    rows = counts.toArrow()
    out = np.zeros(voc * topics, np.int64)
    w = rows["w"].to_numpy()
    if len(w) and not 0 <= w.min() <= w.max() < voc:
        raise ValueError("a word id is outside of the vocabulary")
    out[w * topics + rows["z"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(voc, topics)


def _entries(spark, table: np.ndarray) -> DataFrame:
    w, z = np.nonzero(table)
    return spark.createDataFrame(pa.table({"w": w.astype(np.int64), "z": z.astype(np.int64), "n": table[w, z].astype(np.int64)}))


def _chunked(docs: DataFrame) -> DataFrame:
    """The documents with the chunk that each is dealt to."""
    words = docs.agg(F.sum(F.size("words"))).first()[0] or 0
    return docs.withColumn("chunk", F.pmod(F.xxhash64(F.col("docid"), F.lit("chunk")), F.lit(words // CHUNK + 1)))


def _words_of(docs: DataFrame) -> DataFrame:
    """(chunk, w): the distinct words of each chunk."""
    return docs.select("chunk", F.explode("words").alias("w")).distinct()


def _by_chunk(docs: DataFrame, words: DataFrame, counts: DataFrame, topics: int, run, schema: str) -> DataFrame:
    """run(documents, places of their words among the chunk's, counts of these by topic) of each chunk."""
    sent = words.join(counts, "w")

    def call(held: pa.Table, found: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held, sort_keys=[("docid", "ascending")])).combine_chunks() if len(held) else held
        own, w = np.unique(_flat(held, "words"), return_inverse=True)
        table = np.zeros((len(own), topics))
        table[np.searchsorted(own, found["w"].to_numpy()), found["z"].to_numpy()] = found["n"].to_numpy()
        return run(held, w, table)

    return docs.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(call, schema)


def _flat(table: pa.Table, column: str) -> np.ndarray:
    """The elements of a column of lists, one after the other."""
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _sizes(table: pa.Table) -> np.ndarray:
    return pc.list_value_length(table["words"]).to_numpy().astype(np.int64)


def _sample(docs: DataFrame, words: DataFrame, counts: DataFrame, totals: np.ndarray, voc: int, alpha: float, beta: float, seed: int, update: bool) -> DataFrame:
    topics = len(totals)
    schema = docs.schema

    def run(held: pa.Table, w: np.ndarray, local: np.ndarray) -> pa.Table:
        total = totals.astype(float)
        size, z = _sizes(held), _flat(held, "assigned").copy()
        doc = np.repeat(np.arange(len(size)), size)
        draws = np.concatenate([_stream(seed, x).random(n) for x, n in zip(held["docid"].to_pylist(), size)])
        mine = np.zeros((len(size), topics))
        np.add.at(mine, (doc, z), 1)
        place = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        for turn in range(TURNS):
            for i in np.array_split(at := np.flatnonzero(place % TURNS == turn), len(at) * topics // CELLS + 1):
                own = np.zeros((len(i), topics))
                own[np.arange(len(i)), z[i]] = 1
                seen, all_, here = (local[w[i]], total[None], mine[doc[i]] - own)
                if update:
                    seen, all_ = seen - own, all_ - own
                p = np.cumsum((np.maximum(seen, 0) + beta) / (np.maximum(all_, 0) + voc * beta) * (here + alpha), axis=1)
                new = np.minimum((p < (draws[i] * p[:, -1])[:, None]).sum(1), topics - 1)
                np.add.at(mine, (doc[i], z[i]), -1)
                np.add.at(mine, (doc[i], new), 1)
                if update:
                    np.add.at(local, (w[i], z[i]), -1)
                    np.add.at(local, (w[i], new), 1)
                    total += np.bincount(new, minlength=topics) - np.bincount(z[i], minlength=topics)
                z[i] = new
        kind = held.schema.field("assigned").type
        made = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(z).cast(kind.value_type))
        return held.set_column(held.schema.get_field_index("assigned"), "assigned", made)

    # written: a checkpoint keeps the optimizer's guess of its size, and that of a cogroup multiplies with each iteration
    return stored(_by_chunk(docs, words, counts, topics, run, schema))


def _prepared(df: DataFrame, topics: int, seed: int, doc: str, word: str, count: str) -> DataFrame:
    each = F.explode(F.array_repeat(F.col(word).cast("long"), F.col(count).cast("int"))).alias("w")
    words = df.filter(F.col(count) > 0).select(F.col(doc).alias("docid"), each).groupBy("docid").agg(F.array_sort(F.collect_list("w")).alias("words"))
    assigned = F.transform("words", lambda w, i: F.pmod(F.xxhash64(F.col("docid"), w, i, F.lit(seed)), F.lit(topics)))
    return cut(_chunked(cut(words.withColumn("assigned", assigned))))


def lda_train(df: DataFrame, voc_size: int, topic_num: int, iter_num: int, alpha: float, beta: float, seed: int = 0, doc: str = "docid", word: str = "wordid", count: str = "count") -> dict:
    """{model: (voc_size, topic_num, alpha, beta, counts), output: (docid, words, assigned, topic_count)}; word ids from 0."""
    if voc_size * topic_num * 8 > LIMIT:
        raise ValueError("the word-topic table is too large: cut the vocabulary or the topics")
    docs = _prepared(df, topic_num, seed, doc, word, count)
    words = stored(_words_of(docs))
    for i in range(iter_num):
        totals = np.zeros(topic_num, np.int64)
        for r in docs.select(F.explode("assigned").alias("z")).groupBy("z").count().toLocalIterator():  # a row for each topic
            totals[r.z] = r["count"]
        docs = _sample(docs, words, _counts(docs), totals, voc_size, alpha, beta, seed + i + 1, True)
    table = _table(_counts(docs), voc_size, topic_num)
    return {"model": {"counts": table, "voc_size": voc_size, "topic_num": topic_num, "alpha": alpha, "beta": beta}, "output": _with_topics(docs, topic_num)}


def _with_topics(docs: DataFrame, topics: int) -> DataFrame:
    each = F.transform(F.sequence(F.lit(0), F.lit(topics - 1)), lambda k: F.size(F.filter("assigned", lambda z: z == k)))
    return docs.select("docid", F.size("words").alias("wordcount"), "words", F.col("assigned").alias("topic_assignment"), each.alias("topic_count"))


def lda_predict(df: DataFrame, model: dict, iter_num: int = 20, seed: int = 0, doc: str = "docid", word: str = "wordid", count: str = "count") -> DataFrame:
    """Topics of new documents under a trained model."""
    docs = _prepared(df, model["topic_num"], seed, doc, word, count)
    words, counts = stored(_words_of(docs)), stored(_entries(df.sparkSession, model["counts"]))
    for i in range(iter_num):
        docs = _sample(docs, words, counts, model["counts"].sum(0), model["voc_size"], model["alpha"], model["beta"], seed + i + 1, False)
    return _with_topics(docs, model["topic_num"])


def _rows(spark, table: np.ndarray, key: str, value: str) -> DataFrame:
    """A table's rows, numbered, as arrays."""
    lists = pa.LargeListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1]), np.ascontiguousarray(table, np.int64).ravel())
    made = spark.createDataFrame(pa.table({key: np.arange(len(table), dtype=np.int32), value: lists}))
    return made.select(F.col(key).cast("int").alias(key), F.col(value).cast("array<long>").alias(value))


def lda_word_topic_count(spark, model: dict) -> DataFrame:
    return _rows(spark, model["counts"], "wordid", "topic_count")


def lda_topic_word_count(spark, model: dict) -> DataFrame:
    return _rows(spark, model["counts"].T, "topicid", "word_count")


lda_parse_model = lda_word_topic_count


def lda_topic_desc(model: dict, vocabulary: DataFrame, top_k: int) -> DataFrame:
    """(topicid, wordid, prob, word): words of the top_k ranks of each topic; ties can give more."""
    cells = lda_word_topic_count(vocabulary.sparkSession, model).select("wordid", F.posexplode("topic_count").alias("topicid", "n"))
    beta, voc = model["beta"], model["voc_size"]
    total = F.element_at(F.array(*[F.lit(int(n)) for n in model["counts"].sum(0)]), F.col("topicid") + 1)
    ranked = cells.withColumn("prob", (F.col("n") + beta) / (total + voc * beta)).withColumn("r", F.rank().over(Window.partitionBy("topicid").orderBy(F.desc("prob"))))
    return ranked.filter(F.col("r") <= top_k).join(vocabulary, "wordid").select("topicid", "wordid", "prob", "word")


def lda_perplexity(model: dict, output: DataFrame) -> float:
    """exp of the negative mean log-probability of the words."""
    alpha, beta, voc, totals = model["alpha"], model["beta"], model["voc_size"], model["counts"].sum(0)

    def run(held: pa.Table, w: np.ndarray, table: np.ndarray) -> pa.Table:
        size = _sizes(held)
        topic = _flat(held, "topic_count").reshape(len(size), -1) + alpha
        topic = topic / topic.sum(1, keepdims=True)
        phi = (table + beta) / (totals + voc * beta)
        doc = np.repeat(np.arange(len(size)), size)
        ll = sum(np.log((phi[w[i]] * topic[doc[i]]).sum(1)).sum() for i in np.array_split(np.arange(len(w)), len(w) * len(totals) // CELLS + 1))
        return pa.table({"ll": [float(ll)], "n": [len(w)]})

    docs = cut(_chunked(output.select("docid", "words", "topic_count")))
    r = _by_chunk(docs, stored(_words_of(docs)), _entries(output.sparkSession, model["counts"]), len(totals), run, "ll double, n long").agg(F.sum("ll"), F.sum("n")).first()
    return float(np.exp(-r[0] / r[1]))
