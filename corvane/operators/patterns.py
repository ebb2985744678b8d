"""Patterns over ordered events, frequent item sets, naive Bayes, term counts, cross validation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.checks import expr, names, need_columns, quoted

_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Stands for rows that match no symbol; no pattern can name it.
_NONE = "~"


def path(df: DataFrame, partition, order: str, pattern: str, symbols: dict[str, str] | str, aggregates: list, persist_rows: bool = False):
    """Aggregates over the rows of each partition that match a pattern of symbols.

    `symbols` maps names to predicates (or "NAME:=predicate, ..."); a row gets the first in order whose predicate
    holds. Symbols are joined in `order` and tested without regard to case; of several possible matches
    of a partition the last start counts, and partitions without a match are dropped. With `persist_rows` the
    result is (aggregated, matched rows).
    """
    groups = names(partition)
    need_columns(df, *groups)
    if isinstance(symbols, str):
        found = re.findall(r"(\w+)\s*:=\s*(.*?)(?=,\s*\w+\s*:=|$)", symbols, re.S)
        symbols = {n: p.strip() for n, p in found}
    lowered = [n.lower() for n in symbols]
    if len(set(lowered)) != len(lowered):
        raise ValueError("a symbol is defined twice")
    if len(symbols) > len(_SYMBOLS):
        raise ValueError(f"at most {len(_SYMBOLS)} symbols")
    letters = dict(zip(lowered, _SYMBOLS))
    coded = pattern.lower()
    for name in sorted(letters, key=len, reverse=True):
        coded = re.sub(rf"(?<![\w\x00]){re.escape(name)}(?!\w)", "\x00" + letters[name], coded)
    coded = coded.replace("\x00", "")
    re.compile(coded)
    case = None
    for name, predicate in symbols.items():
        case = (F if case is None else case).when(expr(predicate), F.lit(letters[name.lower()]))
    symbol = case.otherwise(F.lit(_NONE))
    w = Window.partitionBy(*groups).orderBy(*[expr(o) for o in names(order)])
    rows = df.withColumn("_symbol", symbol).withColumn("_place", F.row_number().over(w))
    line = rows.groupBy(*groups).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_symbol"))), lambda e: e["_symbol"]), "").alias("_line"))
    head = F.regexp_extract("_line", f"(?i)^(.*)(?:{coded})", 1)
    hit = line.filter(F.col("_line").rlike(f"(?i){coded}")).withColumn("_from", F.length(head) + 1)
    rest = F.expr("substring(_line, _from)")
    match = hit.withColumn("_len", F.length(F.regexp_extract(rest, f"(?i)^(?:{coded})", 0))).drop("_line")
    match = match.select(*[F.col(quoted(g)).alias(f"_g{i}") for i, g in enumerate(groups)], "_from", "_len")
    same = F.lit(True)
    for i, g in enumerate(groups):  # a null key is a partition of its own
        same = same & F.col(quoted(g)).eqNullSafe(F.col(f"_g{i}"))
    matched = rows.join(match, same).filter((F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_from") + F.col("_len")))
    names_of = {letter: name for name, letter in zip(symbols, _SYMBOLS)}
    named = F.coalesce(*[F.when(F.col("_symbol") == k, F.lit(v)) for k, v in names_of.items()])
    tuples = matched.select(*[F.col(quoted(c)) for c in df.columns], named.alias("symbol"), (F.col("_place") - F.col("_from") + 1).alias("match_place"))
    out = tuples.groupBy(*groups).agg(*[expr(a) for a in aggregates])
    return (out, tuples) if persist_rows else out


# association rules


def rules_of(items):
    """Column: all splits of a sorted item set into (pre, post), both non-empty."""
    items = F.col(items) if isinstance(items, str) else items
    n = F.size(items)
    last = F.pow(F.lit(2), n).cast("int") - 2
    side = lambda m, bit: F.filter(items, lambda e, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == bit)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), last), lambda m: F.struct(side(m, 1).alias("pre"), side(m, 0).alias("post"))))


def assoc_rules(df: DataFrame, tid: str, item: str, support: float, confidence: float, max_items: int | None = None) -> DataFrame:
    """Rules of frequent item sets: ruleid, pre, post, count, support, confidence, lift, conviction.

    Support is a share of the transactions; conviction is 0 where confidence is 1. Repeated items of a
    transaction count once.
    """
    from pyspark.ml.fpm import FPGrowth

    clean = df.select(F.col(quoted(tid)).alias("t"), F.col(quoted(item)).cast("string").alias("i")).dropna().distinct()
    baskets = clean.groupBy("t").agg(F.collect_set("i").alias("items"))
    n = baskets.count()
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets
    sets = sets.select(F.array_sort("items").alias("items"), F.col("freq").cast("long"))
    if max_items:
        sets = sets.filter(F.size("items") <= max_items)
    whole = sets.filter(F.size("items") > 1).select("freq", F.explode(rules_of("items")).alias("r")).select("freq", "r.pre", "r.post")
    joined = whole.join(sets.select(F.col("items").alias("pre"), F.col("freq").alias("n_pre")), "pre").join(sets.select(F.col("items").alias("post"), F.col("freq").alias("n_post")), "post")
    conf, post = F.col("freq") / F.col("n_pre"), F.col("n_post") / F.lit(n)
    made = joined.select("pre", "post", F.col("freq").alias("count"), (F.col("freq") / F.lit(n)).alias("support"), conf.alias("confidence"), (conf / post).alias("lift"), F.when(conf == 1, 0.0).otherwise((1 - post) / (1 - conf)).alias("conviction"))
    made = made.filter(F.col("confidence") >= confidence)
    return made.select(F.xxhash64("pre", "post").alias("ruleid"), "pre", "post", "count", "support", "confidence", "lift", "conviction")


# naive Bayes: attributes are an array; numeric ones (places from 1) follow a normal law


def _whole(attributes: str):
    """Attributes are there, none of them null."""
    return F.col(quoted(attributes)).isNotNull() & ~F.exists(quoted(attributes), lambda e: e.isNull())


def nb_train(df: DataFrame, cls: str, attributes: str, numeric: list[int] = (), smoothing: float = 1.0) -> dict[str, DataFrame]:
    """{priors, feature_probs, numeric_stats}: class counts; counts of each class and attribute value, with the number of values; means and variances.

    Rows with a null class, null attributes or a null among them are left out.
    """
    whole = df.filter(F.col(quoted(cls)).isNotNull() & _whole(attributes)).select(F.col(quoted(cls)).alias("class"), F.col(quoted(attributes)).alias("values"))
    rows = whole.select("class", F.posexplode("values").alias("p", "value")).select("class", (F.col("p") + 1).alias("attr"), "value")
    priors = whole.groupBy("class").agg(F.count("*").alias("class_cnt"))
    all_rows = whole.agg(F.count("*").alias("all_cnt"))
    priors = priors.crossJoin(F.broadcast(all_rows))  # one row
    nominal = rows.filter(~F.col("attr").isin(list(numeric))) if numeric else rows
    counts = nominal.groupBy("class", "attr", "value").agg(F.count("*").alias("cnt"))
    values = nominal.select("attr", "value").distinct()
    sizes = values.groupBy("attr").agg(F.count("*").alias("attr_cnt"))
    # a class has few values of each attribute, and classes are few: every pair gets a row, with zero counts
    pairs = priors.select("class").join(values, how="cross")
    probs = pairs.join(counts, ["class", "attr", "value"], "left").join(sizes, "attr").select("class", "attr", "value", F.coalesce("cnt", F.lit(0)).alias("cnt"), "attr_cnt")
    numbers = rows.filter(F.col("attr").isin(list(numeric))) if numeric else rows.filter("false")
    stats = numbers.groupBy("class", "attr").agg(F.avg(F.col("value").cast("double")).alias("attr_mean"), F.var_samp(F.col("value").cast("double")).alias("attr_var"))
    return {"priors": priors, "feature_probs": probs, "numeric_stats": stats, "smoothing": smoothing}


#: Rows of a model's table up to which it is sent to all tasks.
SENT_ROWS = 200_000


#: Classes times attributes up to which a row is scored where it is.
SENT_CELLS = 1_000


def nb_probs(model: dict, df: DataFrame, key: str, attributes: str) -> DataFrame:
    """(key, class, log_prob, nb_prob): log10 scores and normed probabilities; a gap of over 300 powers of ten counts as zero.

    Each row with whole attributes (one at least) gets a score for each class; values that training didn't see add nothing. Rows with
    the same key are scored one by one.
    """
    found = _nb_scored(model, df, key, attributes)
    if found is None:
        scored = _nb_joined(model, df, key, attributes)
        w = Window.partitionBy("_row")
        gap = F.col("log_prob") - F.max("log_prob").over(w)
        rel = F.when(gap < -300, 0.0).otherwise(F.pow(F.lit(10.0), gap))
        return scored.withColumn("_r", rel).select("_row", "key", "class", "log_prob", (F.col("_r") / F.sum("_r").over(w)).alias("nb_prob")).drop("_row")
    rel = F.transform("_s", lambda e: F.when(e["log_prob"] - F.col("_m") < -300, 0.0).otherwise(F.pow(F.lit(10.0), e["log_prob"] - F.col("_m"))))
    total = F.aggregate("_r", F.lit(0.0), lambda s, e: s + e)
    each = F.zip_with("_s", "_r", lambda e, r: F.struct(e["class"].alias("class"), e["log_prob"].alias("log_prob"), (r / F.col("_total")).alias("nb_prob")))
    normed = found.withColumn("_r", rel).withColumn("_total", total).select("key", F.explode(each).alias("e"))
    return normed.select("key", "e.class", "e.log_prob", "e.nb_prob")


def _nb_logs(model: dict) -> tuple[DataFrame, DataFrame]:
    """Classes with log10 priors, and log10 probabilities of values by class and attribute."""
    s = float(model["smoothing"])
    priors = model["priors"].withColumn("prior", F.log10(F.col("class_cnt") / F.col("all_cnt")))
    probs = model["feature_probs"].join(F.broadcast(priors.select("class", "class_cnt")), "class")
    probs = probs.filter((F.lit(s) > 0) | (F.col("cnt") > 0)).select("class", "attr", "value", F.log10((F.col("cnt") + s) / (F.col("class_cnt") + s * F.col("attr_cnt"))).alias("l"))
    return priors, probs


def _nb_numeric(value, mean, var):
    z = value.try_cast("double") - mean
    return (-0.5 * F.log(2 * F.pi() * var) - z * z / (2 * var)) / F.log(F.lit(10.0))


def _nb_scored(model: dict, df: DataFrame, key: str, attributes: str) -> DataFrame | None:
    """(key, _s: class and log_prob of each class, _m: the largest), a row for a row; None if the model is too large to be sent to all tasks."""
    from corvane.operators.iteration import stored

    priors, probs = _nb_logs(model)
    probs = stored(probs)
    classes = [(r["class"], r.prior) for r in priors.select("class", "prior").limit(SENT_CELLS + 1).toLocalIterator()]
    nominal = [r.attr for r in probs.select("attr").distinct().limit(SENT_CELLS + 1).toLocalIterator()]
    if probs.count() > SENT_ROWS or len(classes) * len(nominal) > SENT_CELLS:
        return None
    numeric = {(r.attr, r["class"]): r for r in model["numeric_stats"].limit(SENT_CELLS + 1).toLocalIterator()}
    if len(numeric) > SENT_CELLS:
        return None
    rows = df.filter(_whole(attributes) & (F.size(quoted(attributes)) > 0)).select(F.col(quoted(key)).alias("key"), F.col(quoted(attributes)).alias("_v"))
    for a in sorted(nominal):  # a value's logs, class by class
        logs = F.array(*[F.max(F.when(F.col("class") == F.lit(c), F.col("l"))) for c, _ in classes])
        own = probs.filter(F.col("attr") == a).groupBy(F.col("value").alias("_value")).agg(logs.alias(f"_l{a}"))
        rows = rows.withColumn("_at", F.get("_v", F.lit(a - 1))).join(F.broadcast(own), F.col("_at") == F.col("_value"), "left").drop("_at", "_value")
    number = lambda v: F.lit(v).cast("double")
    scores = []
    for j, (c, prior) in enumerate(classes):
        total = number(prior)
        for a in sorted({*nominal, *(a for a, _ in numeric)}):
            r = numeric.get((a, c))
            terms = [F.get(f"_l{a}", F.lit(j))] if a in nominal else []
            terms += [_nb_numeric(F.get("_v", F.lit(a - 1)), number(r.attr_mean), number(r.attr_var))] if r is not None else []
            total = total + F.coalesce(*terms, F.lit(0.0))
        scores.append(F.struct(F.lit(c).cast(model["priors"].schema["class"].dataType).alias("class"), total.alias("log_prob")))
    made = rows.select("key", (F.array(*scores) if scores else F.array().cast("array<struct<class:string,log_prob:double>>")).alias("_s"))
    return made.withColumn("_m", F.array_max(F.transform("_s", lambda e: e["log_prob"])))


def _nb_joined(model: dict, df: DataFrame, key: str, attributes: str) -> DataFrame:
    """(_row, key, class, log_prob): values are joined to a large model by shuffles."""
    priors, probs = _nb_logs(model)
    whole = df.filter(_whole(attributes)).select(F.col(quoted(key)).alias("key"), F.col(quoted(attributes)).alias("values"), F.monotonically_increasing_id().alias("_row"))
    cells = whole.crossJoin(F.broadcast(priors.select("class", "prior")))  # classes are few
    cells = cells.select("_row", "key", "class", "prior", F.posexplode("values").alias("p", "value")).withColumn("attr", F.col("p") + 1)
    joined = cells.join(probs, ["class", "attr", "value"], "left").join(F.broadcast(model["numeric_stats"]), ["class", "attr"], "left")
    numeric = _nb_numeric(F.col("value"), F.col("attr_mean"), F.col("attr_var"))
    return joined.groupBy("_row", "key", "class").agg((F.first("prior") + F.coalesce(F.sum(F.coalesce("l", numeric)), F.lit(0.0))).alias("log_prob"))


def argmax(df: DataFrame, groups: list[str], key: str, value: str) -> DataFrame:
    """For each group all keys that attain the largest value, sorted."""
    top = df.groupBy(*groups).agg(F.max(value).alias("_m"))
    return df.join(top, groups).filter(F.col(value) == F.col("_m")).groupBy(*groups).agg(F.array_sort(F.collect_list(key)).alias(key))


def nb_classify(model: dict, df: DataFrame, key: str, attributes: str) -> DataFrame:
    """(key, class): the classes of the largest probability; ties are all given."""
    found = _nb_scored(model, df, key, attributes)
    if found is None:
        return argmax(nb_probs(model, df, key, attributes), ["key"], "class", "log_prob")
    # only a row's best classes can be the best of its key
    best = found.select("key", F.explode(F.filter("_s", lambda e: e["log_prob"] == F.col("_m"))).alias("e"))
    return argmax(best.select("key", "e.class", "e.log_prob"), ["key"], "class", "log_prob")


# terms


def term_frequency(df: DataFrame, doc_id: str, words: str, compute_vocab: bool = False):
    """(doc, word, count), or with a vocabulary ((doc, wordid, count), (wordid, word)); ids from 0 in word order."""
    doc = F.col(quoted(doc_id))
    if (df.groupBy(doc).count().agg(F.max("count")).first()[0] or 0) <= 1:  # each row is a document: nothing to shuffle
        counts = df.select(doc, F.explode(_counted(F.col(quoted(words)))).alias("_e")).select(doc, "_e.word", "_e.count")
    else:
        counts = df.select(doc, F.explode(quoted(words)).alias("word")).filter("word IS NOT NULL").groupBy(doc, "word").agg(F.count("*").alias("count"))
    if not compute_vocab:
        return counts
    vocabulary = _numbered(counts.select("word").distinct(), "word", "wordid")
    return counts.join(vocabulary, "word").select(doc_id, "wordid", "count"), vocabulary


def _counted(words):
    """Column: the distinct elements of an array that aren't null, each with its count."""
    from corvane.functions.arrays import let

    def runs(s):
        first = F.filter(F.transform(s, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda e: (e["at"] == 0) | ~F.get(s, e["at"] - 1).eqNullSafe(e["word"]))
        return let(first, lambda f: F.transform(f, lambda e, i: F.struct(e["word"].alias("word"), (F.coalesce(F.get(f, i + 1)["at"], F.size(s)) - e["at"]).cast("long").alias("count"))))

    return let(F.sort_array(F.filter(words, lambda w: w.isNotNull())), runs)


def _numbered(values: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values numbered from 0 in order: ranges are numbered by themselves and shifted by the ranges before."""
    from corvane.operators.iteration import cut

    ordered = cut(values.repartitionByRange(column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ordered.withColumn("_own", own).join(F.broadcast(before), "_part").select((F.col("_own") + F.col("_before")).cast("long").alias(name), column)


def doc_vectors(dictionary: DataFrame, id_col: str, term_col: str, documents: DataFrame, doc_col: str, doc_term: str, count_col: str | None = None) -> DataFrame:
    """(doc, sparse_vector): for each document the counts of the dictionary's terms, by ids from 0."""
    from corvane.functions.svec import from_positions

    n = dictionary.agg((F.max(id_col) + 1).cast("int").alias("n")).first()[0]
    counts = documents.groupBy(doc_col, doc_term).agg((F.sum(count_col) if count_col else F.count("*")).cast("double").alias("c"))
    hits = counts.join(dictionary.select(F.col(term_col).alias(doc_term), F.col(id_col).alias("_id")), doc_term)
    lists = hits.groupBy(doc_col).agg(F.collect_list((F.col("_id") + 1).cast("long")).alias("p"), F.collect_list("c").alias("v"))
    return lists.select(doc_col, from_positions("p", "v", n).alias("sparse_vector"))


# cross validation


def folds(df: DataFrame, k: int, seed: int = 0, id_col: str | None = None) -> DataFrame:
    """The table with _fold (from 0): rows in random order, cut so that fold sizes differ by one at most."""
    from corvane.operators.iteration import cut
    from corvane.operators.order import running

    keyed = cut(df.withColumn("_key", F.rand(seed) if id_col is None else (F.pmod(F.xxhash64(quoted(id_col), F.lit(seed)), F.lit(2**52)) / float(2**52))))
    n = keyed.count()
    placed = running(keyed, "_key", {"_place": F.lit(1).cast("long")})
    big, size = n % k, n // k
    edge = big * (size + 1)
    p = F.col("_place") - 1
    fold = F.when(p < edge, F.floor(p / (size + 1))).otherwise(big + F.floor((p - edge) / max(size, 1)))
    return placed.withColumn("_fold", F.least(fold, F.lit(k - 1)).cast("int")).drop("_key", "_place")


def cross_validation(df: DataFrame, train, predict, metric, explored: list, k: int = 10, seed: int = 0) -> DataFrame:
    """(value, mean, stddev) of metric(predict(model, rows)) over k folds, for each explored parameter value.

    train(rows, value) gives a model, predict(model, rows) a table, metric(table) a number.
    """
    from corvane.operators.iteration import cut

    cut_rows = cut(folds(df, k, seed))
    out = []
    for value in explored:
        scores = []
        for i in range(k):
            model = train(cut_rows.filter(F.col("_fold") != i).drop("_fold"), value)
            scores.append(float(metric(predict(model, cut_rows.filter(F.col("_fold") == i).drop("_fold")))))
        s = pd.Series(scores)
        out.append((str(value), float(s.mean()), float(s.std(ddof=1)) if k > 1 else 0.0))
    return df.sparkSession.createDataFrame(out, "value string, mean double, stddev double")


def mse_error(df: DataFrame, prediction: str, actual: str) -> DataFrame:
    return df.agg(F.avg((expr(prediction) - expr(actual)) ** 2).alias("mean_squared_error"))


def misclassification_avg(df: DataFrame, prediction: str, actual: str) -> DataFrame:
    return df.agg(F.avg(F.when(expr(prediction).eqNullSafe(expr(actual)), 0.0).otherwise(1.0)).alias("avg_misclassification"))


def accuracy(df: DataFrame, prediction: str, actual: str) -> DataFrame:
    return df.agg(F.avg(F.when(expr(prediction) == expr(actual), 1.0).otherwise(0.0)).alias("accuracy"))


def logregr_accuracy(coef, x, y):
    """Column: 1 where the logistic prediction is right, else 0."""
    from corvane.operators.regress import logregr_predict

    return F.when(logregr_predict(coef, x) == expr(y), 1.0).otherwise(0.0)
