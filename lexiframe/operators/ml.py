"""Fitted models and the evaluation loops around them (stratified hold-out, k folds, stacking, the tuning grid).

Features are sparse until the F test has chosen a bounded number of columns. Linear models are MLlib's, and so are forests
of more rows than a task may hold (others are grown in tasks, see ``forests``); boosted trees are ``boosting``'s, whose fits of several folds share their jobs. Fits that
do not depend on each other run side by side from threads of the driver."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting as B
from . import forests as FO
from . import models as M
from ..functions import text as X
from ..sources import tables as TB


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], width: int = 6) -> list:
    """Results of independent jobs, at most ``width`` at a time: fewer than a small machine's cores, so that the many
    short jobs of a boosted fit do not wait behind forests."""
    with ThreadPoolExecutor(width) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def threshold(df: DataFrame, prob: str, cut: float = 0.5) -> DataFrame:
    """Class 1 when probability >= cut; the probability is kept only for class 1."""
    c1 = F.col(prob) >= cut
    return df.select("article_id", c1.cast("int").alias("predicted"),
                     X.r6(F.when(c1, F.col(prob)).otherwise(0)).alias("probability"))


def anova_f(long: DataFrame, classes: DataFrame, keys: Sequence[str], label: str, x: str) -> DataFrame:
    """``keys`` and ``f_score``: one-way ANOVA F (between-class over within-class mean squares) of each column of a sparse
    long table, in which a zero has no row. ``classes`` has (label, ``nc``): rows of each class, zeros included. Sums of
    the stored entries are all it takes. No score where there is no variance within the classes."""
    per = long.groupBy(*keys, label).agg(F.sum(x).alias("_s"), F.sum(F.col(x) * F.col(x)).alias("_q"))
    per = per.join(F.broadcast(classes), label)  # one row per class
    t = per.groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.sum(F.col("_s") * F.col("_s") / F.col("nc")).alias("_b"))
    whole = F.broadcast(classes.agg(F.sum("nc").alias("_n"), F.count(F.lit(1)).alias("_k")))
    between = (F.col("_b") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_k") - 1)
    within = (F.col("_q") - F.col("_b")) / (F.col("_n") - F.col("_k"))
    return t.join(whole).select(*keys, X.r6(F.try_divide(between, within)).alias("f_score"))


def select_k(scores: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The ``k`` columns of the highest scores, ties by name, with their ``rank`` from 0; a bounded table."""
    top = scores.where("f_score is not null").orderBy(F.desc("f_score"), *keys).limit(k)
    return M.ranked(top, [F.desc("f_score"), *keys], "rank")


def model_frame(spark, d, articles: DataFrame) -> DataFrame:
    """article_id, label, the lemmatised passage as ``text``, and the feature frame as doubles (0 where a ratio
    has no denominator)."""
    from ..plans import q_features as QF
    cols = [F.coalesce(F.expr(c).cast("double"), F.lit(0.0)).alias(n) for n, c, _ in QF.all_features()]
    return QF.chain(spark, d, articles).select("article_id", F.col("label").cast("double").alias("label"), F.col("lemma_text").alias("text"), *cols)


def labeled_frame(spark, d) -> DataFrame:
    from ..plans import views as V
    return model_frame(spark, d, V.labelled_articles(spark, d).filter(F.col("label").isNotNull()))


KEYS = ["kind", "name"]
MIN_DF, MAX_DF = 0.005, 0.7


def numeric_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in ("article_id", "label", "text")]


def numeric_long(frame: DataFrame) -> DataFrame:
    """(article_id, label, kind, name, value): the numbers of a model frame that are not zero."""
    cols = numeric_columns(frame)
    long = frame.select("article_id", "label", *cols).unpivot(["article_id", "label"], cols, "name", "value")
    return long.where("value <> 0").select("article_id", "label", F.lit("feature").alias("kind"), "name", "value")


@dataclass
class Features:
    """What turns a model frame into vectors: the terms' document frequencies in the fitted rows, the number of these,
    and the chosen columns (``kind``, ``name``, ``rank``)."""

    vocabulary: DataFrame
    n_docs: int
    chosen: DataFrame

    def long(self, frame: DataFrame, tf: DataFrame | None = None) -> DataFrame:
        """(article_id, label, kind, name, value) of all terms of the vocabulary and all numbers, zeros left out."""
        terms = self.terms(frame, tf).select("article_id", F.lit("term").alias("kind"), "name", "value")
        return terms.join(frame.select("article_id", "label"), "article_id").select("article_id", "label", *KEYS, "value").unionByName(numeric_long(frame))

    def terms(self, frame: DataFrame, tf: DataFrame | None = None) -> DataFrame:
        """(article_id, name, value): weights of the vocabulary's terms, a table that is bounded by the least share of
        documents. ``tf``: the counts, if they are stored; else only the vocabulary's are made, where the text is."""
        known = F.broadcast(self.vocabulary)
        tf = counted(frame, known.select("term")) if tf is None else tf
        return M.tfidf_long(tf, "article_id", known, self.n_docs, rounded=False).select("article_id", F.col("term").alias("name"), F.col("weight").alias("value"))

    def transform(self, frame: DataFrame, long: DataFrame | None = None) -> DataFrame:
        """article_id, label and ``features``, a vector whose attributes carry the chosen names. An article's entries are
        put in order and the zeros between them filled in; an article whose terms come twice is an error."""
        terms = self.terms(frame) if long is None else long.where("kind = 'term'")
        rows = self.chosen.orderBy("rank").collect()  # bounded by the selection
        names = [f"{r['kind']}:{r['name']}" for r in rows]
        entry = F.struct(F.col("rank").cast("int").alias("rank"), "value")
        per = terms.join(F.broadcast(self.chosen.where("kind = 'term'").select("name", "rank")), "name").groupBy("article_id").agg(
            F.map_from_entries(F.collect_list(entry)).alias("_m"))
        none = F.lit(None).cast("array<struct<rank:int,value:double>>")
        numbers = [F.struct(F.lit(i).alias("rank"), F.col(r["name"]).alias("value")) for i, r in enumerate(rows) if r["kind"] == "feature"]
        own = F.filter(F.array(*numbers), lambda e: e["value"] != 0) if numbers else F.coalesce(none, F.array())
        entries = F.transform(F.map_entries("_m"), lambda e: F.struct(e["key"].alias("rank"), e["value"].alias("value")))
        out = frame.select("article_id", "label", own.alias("_n")).join(per, "article_id", "left").select(
            "article_id", "label", F.sort_array(F.concat("_n", F.coalesce(entries, F.array()))).alias("_e"))

        def zeros(after, before):
            return F.array_repeat(F.lit(0.0), (before - after - 1).cast("int"))

        def rank(i):
            return F.coalesce(F.get("_e", i)["rank"], F.lit(-1))

        runs = F.transform("_e", lambda e, i: F.concat(zeros(rank(i - 1), e["rank"]), F.array(e["value"])))
        rest = zeros(rank(F.size("_e") - 1), F.lit(len(names)))
        out = out.select("article_id", "label", array_to_vector(F.concat(F.flatten(runs), rest)).alias("features"))
        return out.withMetadata("features", {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]}, "num_attrs": len(names)}})

    def save(self, path: str) -> None:
        TB.write_table(self.vocabulary, "vocabulary", path=f"{path}/vocabulary")
        TB.write_table(self.chosen.withColumn("n_docs", F.lit(self.n_docs)), "chosen", path=f"{path}/chosen")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Features:
        chosen = spark.read.parquet(f"{path}/chosen")
        return Features(spark.read.parquet(f"{path}/vocabulary"), chosen.first()["n_docs"], chosen.drop("n_docs"))


def compressed(df: DataFrame) -> DataFrame:
    """``df`` with its vectors ``features`` in the smaller of the dense and the sparse form, names kept: of a thousand
    columns an article has some fifty, and fits read and keep the vectors many times."""
    out = VectorAssembler(inputCols=["features"], outputCol="_v").transform(df)
    out = out.select(*[F.col("_v").alias(c) if c == "features" else c for c in df.columns])
    return out.withMetadata("features", df.schema["features"].metadata)


def names_of(df: DataFrame, features: str = "features") -> list[str]:
    """The names that a vector column carries, by place."""
    return [a["name"] for a in df.schema[features].metadata["ml_attr"]["attrs"]["numeric"]]


def named_values(df: DataFrame, features: str = "features") -> DataFrame:
    """(article_id, name, value): the entries of named vectors that are not zero."""
    names = F.lit(names_of(df, features))
    pairs = F.arrays_zip(names.alias("name"), vector_to_array(features).alias("value"))
    return df.select("article_id", F.inline(F.filter(pairs, lambda p: p["value"] != 0)))


def counted(frame: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(article_id, term, tf) of the words and pairs of words of ``text``, or of those in a table of terms."""
    tokens = M.by_document(frame.select("article_id", "text"), "article_id", frame.count()).select("article_id", M.doc_tokens("text").alias("_t"))
    return M.term_counts(tokens.select("article_id", M.uni_bi_grams(F.col("_t")).alias("_g")), "article_id", "_g", terms)


def term_table(frame: DataFrame) -> DataFrame:
    """(article_id, term, tf) of the words and pairs of words of ``text``, stored: read for df and for weights."""
    return TB.stored(counted(frame), "term-counts")


def scored_columns(lab: DataFrame) -> tuple[Features, DataFrame, DataFrame]:
    """Features before selection, their long table, and (kind, name, f_score) for each term and number."""
    tf = term_table(lab)
    n = lab.count()
    vocabulary = TB.stored(M.vocabulary(M.document_frequency_from_tf(tf), n, MIN_DF, MAX_DF), "vocabulary")
    features = Features(vocabulary, n, None)
    long = TB.stored(features.long(lab, tf), "feature-long")
    classes = lab.groupBy("label").agg(F.count(F.lit(1)).alias("nc"))
    return features, long, anova_f(long, classes, KEYS, "label", "value")


def fit_features(lab: DataFrame, top_k: int = 1000) -> tuple[Features, DataFrame]:
    """Lemmas -> uni+bi-grams -> counts (df 0.5 %..70 %, no cap on terms) x smooth idf + 1 -> L2 -> + numbers -> the
    ``top_k`` columns by F test; and the vectors of the fitted rows."""
    features, long, scores = scored_columns(lab)
    features.chosen = TB.stored(select_k(scores, KEYS, top_k), "chosen")
    return features, features.transform(lab, long)


def with_weights(df: DataFrame) -> DataFrame:
    return M.balanced_weights(df, "label")


def fitted_frame(spark, d, corpus: DataFrame | None = None) -> tuple[Features, DataFrame]:
    """Features fitted on the labelled articles, and their named vectors with class weights, written once: every fit and
    fold reads them, and not the texts. ``corpus``: the stored model frame of all articles, if there is one."""
    lab = TB.stored(labeled_frame(spark, d), "labelled") if corpus is None else corpus.filter(F.col("label").isNotNull())
    features, vectors = fit_features(lab)
    return features, rows_table(with_weights(vectors), "training-vectors")


_kept: dict[tuple, object] = {}


def kept(spark, d, name: str, make: Callable):
    """What ``make`` gives, made once for each application and folder; the folder's tables must not change meanwhile."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def training_frame(spark, d) -> DataFrame:
    return kept(spark, d, "training", lambda: fitted_frame(spark, d))[1]


def rows_table(df: DataFrame, name: str) -> DataFrame:
    """Vectors written and read in few partitions: every task of a forest's fit sends sums for all nodes of a level,
    however few rows it has."""
    t = TB.stored(df, name)
    return t.coalesce(max(1, -(-t.count() // B.ROWS)))


def rf_base():
    return RandomForestClassifier(numTrees=1000, maxDepth=4, weightCol="weight", seed=42)


def forest(trees: int, depth: int, least_leaf: int, columns: str, bootstrap: bool = True, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=least_leaf, featureSubsetStrategy=columns,
                                  bootstrap=bootstrap, weightCol="weight", seed=seed)


def forests() -> dict[str, tuple[RandomForestClassifier, int]]:
    """The reference's best-F1, best-precision and best-recall forests, and the least rows with which each splits a node
    (which MLlib lacks: the fitted trees are cut there, see ``forests``). Unlimited depth is MLlib's most, 30."""
    return {
        "best_f1": (forest(2000, 30, 2, "sqrt"), 45),
        "best_precision": (forest(2000, 30, 1, "sqrt"), 2),
        "best_recall": (forest(400, 10, 4, "all"), 10),
    }


#: the reference's boosted trees: its library's 100 rounds at rate 0.3 and depth 7, positives ten times as heavy
BOOSTED = B.Settings(loss="logistic", rounds=100, rate=0.3, depth=7, l2=1.0, least_hessian=1.0, positive=10.0)
#: the reference's boosted regressor: 500 rounds, 19 leaves, rows and columns drawn anew each round
BOOSTED_REGRESSOR = B.Settings(loss="squared", rounds=500, rate=0.01716485155812008, leaves=19, l1=0.003188447814669599, l2=0.0010228604507564066,
                               least_rows=46, least_hessian=0.001, row_share=0.75, column_share=0.8, base="mean")


def with_split(t: DataFrame, share: float) -> DataFrame:
    """``t`` with ``fold`` 0 for a stratified hold-out of a share, 1 for the rest."""
    s = M.stratified_split(t, "label", "article_id", share, seed=42)
    return s.withColumn("fold", F.when(F.col("is_test") == 1, 0).otherwise(1)).drop("is_test")


def _split(t: DataFrame, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    s = rows_table(with_split(t, share), "split")
    return s.filter("fold = 1").drop("fold"), s.filter("fold = 0").drop("fold")


def _score(pred: DataFrame) -> DataFrame:
    raw = "probability" if "probability" in pred.columns else "rawPrediction"
    return pred.select("article_id", vector_to_array(raw)[1].alias("s"))


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


TREES = 100  # of a part of a forest, which is what the driver's JVM holds of a fit at a time
FITS = threading.BoundedSemaphore(16)  # parts that are fitted at a time, of all forests together


def forest_parts(train: DataFrame, est: RandomForestClassifier) -> list[str]:
    """Saved forests that are together the forest of ``est``: of ``TREES`` trees each, fitted side by side, with seeds of
    their own. Trees do not depend on each other, so this is one forest; a fit on few rows has few tasks, and so one
    after the other would leave most cores idle."""
    spark = train.sparkSession

    def part(i, trees):
        with FITS:
            return FO.saved(spark, est.copy({est.numTrees: trees, est.seed: est.getSeed() + 1_000_003 * i}).fit(train))

    n = est.getNumTrees()
    return side_by_side(spark, [lambda i=i: part(i, min(TREES, n - i * TREES)) for i in range(-(-n // TREES))], spark.sparkContext.defaultParallelism)


def fit_forest(train: DataFrame, est: RandomForestClassifier) -> FO.Nodes:
    return FO.nodes_at(train.sparkSession, forest_parts(train, est))


def forest_rows(train: DataFrame) -> FO.Binned | None:
    """The binned rows from which tasks grow the trees of ``train``'s forests; none if they are too many for a task."""
    first = train.select("features").first()
    if first is None or train.count() * len(first["features"]) > FO.WHOLE:
        return None
    return FO.binned(train)


def forest_nodes(train: DataFrame, est: RandomForestClassifier, least_split: int, rows: FO.Binned | None = None, depth: int | None = None) -> DataFrame:
    """The nodes of a forest that splits no node of fewer rows, see ``forests_alike``."""
    return forests_alike(train, [(est, least_split)], rows, depth)[0]


def forests_alike(train: DataFrame, made: Sequence[tuple[RandomForestClassifier, int]], rows: FO.Binned | None = None, depth: int | None = None) -> list[DataFrame]:
    """The nodes of forests that differ in the least rows in a leaf and to split a node: grown together in tasks, or by
    MLlib from more rows than a task may hold. ``rows``: ``forest_rows(train)`` if they are known. ``depth``: a limit beyond
    MLlib's, for trees that are grown in tasks."""
    rows = forest_rows(train) if rows is None else rows
    if rows is None:
        return [FO.node_table(train.sparkSession, forest_parts(train, est)) for est, _ in made]
    est = made[0][0]
    limits = [(e.getMinInstancesPerNode(), max(2, n)) for e, n in made]
    return FO.grow_forests(rows, est.getNumTrees(), depth or est.getMaxDepth(), limits, est.getFeatureSubsetStrategy(), est.getOrDefault(est.bootstrap), est.getSeed())


def forest_scores(train: DataFrame, test: DataFrame, est: RandomForestClassifier, least_split: int, rows: FO.Binned | None = None) -> DataFrame:
    """article_id and score of ``test`` by a forest fitted on ``train``; stored, so that no model stays."""
    return TB.stored(FO.probabilities(test, forest_nodes(train, est, least_split, rows), "article_id", least_split), "forest-scores")


def linear_scores(train: DataFrame, test: DataFrame, est) -> DataFrame:
    return TB.stored(_score(est.fit(train).transform(test)), "linear-scores")


def report(scores: DataFrame, test: DataFrame, model_name: str, cut: float = 0.5) -> DataFrame:
    """Class report of scores (article_id, s) of labelled rows."""
    p = test.select("article_id", "label").join(scores, "article_id").withColumn("pred", (F.col("s") > cut).cast("int"))
    return M.class_report(p, "label", "pred").withColumn("model", F.lit(model_name))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_and_report(spark, d, est, name: str | None = None) -> DataFrame:
    train, test = _split(training_frame(spark, d))
    return report(forest_scores(train, test, est, 0), test, name or type(est).__name__)


def boosted_report(spark, d) -> DataFrame:
    """The boosted trees on a stratified 90/10 split."""
    t = rows_table(with_split(training_frame(spark, d), 0.1), "split")
    _, out = B.fit_boosted(t, BOOSTED, [0], "article_id")
    scores = out.select(F.col("id").cast("long").alias("article_id"), probability(F.col("margin")).alias("s"))
    return report(scores, t.filter("fold = 0"), "boosted")


def rf_variants_report(spark, d) -> DataFrame:
    """The three tuned forests on a stratified 80/20 split."""
    train, test = _split(training_frame(spark, d), 0.2)
    made, rows = forests(), forest_rows(train)
    scores = side_by_side(spark, [lambda e=e, n=n: forest_scores(train, test, e, n, rows) for e, n in made.values()])
    return union([report(s, test, name) for name, s in zip(made, scores)])


def svc(penalty: float | None = None, weight: str | None = None) -> Pipeline:
    args = {**({} if penalty is None else {"regParam": penalty}), **({} if weight is None else {"weightCol": weight})}
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled"), LinearSVC(featuresCol="scaled", **args)])


def linear_report(spark, d) -> DataFrame:
    train, test = _split(training_frame(spark, d))
    if train.count() > B.ROWS:  # a step of these fits sends one vector a task, so they may be many
        train, test = FO.spread(compressed(train)), FO.spread(compressed(test))
    lr = LogisticRegression(weightCol="weight", maxIter=100)
    jobs = [lambda: linear_scores(train, test, svc(weight="weight")), lambda: linear_scores(train, test, lr)]
    a, b = side_by_side(spark, jobs)
    return report(a, test, "linear_svc", 0.0).unionByName(report(b, test, "logistic"))


def fold_col(df: DataFrame, k: int, name: str = "fold", key: str = "article_id", seed: int = 7) -> DataFrame:
    return df.withColumn(name, (F.abs(F.xxhash64(key, F.lit(seed))) % k).cast("int"))


def linear_models(n: int) -> dict:
    """The stack's linear models for a fit on ``n`` rows: C = 1 is a penalty of 1 / n here, and all rows weigh alike."""
    return {"svc": svc(1 / n), "lr": LogisticRegression(regParam=1 / n, maxIter=100, standardization=False)}


def stacked(train: DataFrame, test: DataFrame, k: int = 5, width: int = 6) -> DataFrame:
    """article_id and score of ``test`` by the stack: out-of-fold scores of the six base models over ``train`` (k fits
    each, and one on all of it for ``test``) are the features of a logistic regression. Forests balance the classes,
    boosted trees weigh positives tenfold. All fits but the last one run side by side."""
    columns = ["article_id", "label", "weight", "features", "inner"]
    train = fold_col(train, k, "inner", seed=8).select(*columns)
    rows = rows_table(train.unionByName(test.withColumn("inner", F.lit(k)).select(*columns)), "stack-rows")
    sizes = {r["inner"]: r["count"] for r in rows.groupBy("inner").count().collect()}  # k + 1 rows
    n = sum(c for f, c in sizes.items() if f < k)
    fits = [f for f in sizes if f < k] + [k]  # the last one is fitted on all of ``train``

    def seen(f):
        return rows.filter((F.col("inner") != f) & (F.col("inner") < k))

    def boosted():
        out = B.fit_boosted(rows, BOOSTED, fits, "article_id", fold_col="inner", held=k)[1]
        return out.select(F.col("id").cast("long").alias("article_id"), probability(F.col("margin")).alias("s"))

    def one(name, f):
        test_rows = rows.filter(F.col("inner") == f)
        if name in forests():
            return forest_scores(seen(f), test_rows, *forests()[name], binned[f])
        return linear_scores(seen(f), test_rows, linear_models(n - (sizes[f] if f < k else 0))[name])

    names = [*forests(), *linear_models(n)]
    binned = dict(zip(fits, side_by_side(rows.sparkSession, [lambda f=f: forest_rows(seen(f)) for f in fits], width)))
    got = side_by_side(rows.sparkSession, [boosted, *[lambda m=m, f=f: one(m, f) for f in fits for m in names]], width)
    by_model = {"boosted": got[0], **{m: union(got[1 + i::len(names)]) for i, m in enumerate(names)}}
    meta = rows.select("article_id", "label", "inner")
    for m, s in by_model.items():
        meta = meta.join(s.withColumnRenamed("s", m), "article_id")
    meta = TB.stored(VectorAssembler(inputCols=list(by_model), outputCol="features").transform(meta), "stack-scores")
    final = LogisticRegression(regParam=1 / n, maxIter=100, standardization=False).fit(meta.filter(F.col("inner") < k))
    return TB.stored(_score(final.transform(meta.filter(F.col("inner") == k))), "stacked")


def stacking_report(spark, d, k: int = 5) -> DataFrame:
    """The stack of six base models, evaluated on a stratified hold-out of a fifth."""
    train, test = _split(training_frame(spark, d), 0.2)
    return report(stacked(train, test, k), test, "stacking")


SCORERS = ["precision", "recall", "f1", "accuracy"]


def scorers() -> list[Column]:
    """The four scorers from counts; one without a denominator is 0."""
    def share(a, b):
        return F.coalesce(X.safe_div(a, b), F.lit(0.0))

    return [share(F.col("tp"), F.col("pp")).alias("precision"), share(F.col("tp"), F.col("ap")).alias("recall"),
            share(2 * F.col("tp"), F.col("pp") + F.col("ap")).alias("f1"), share(F.col("right"), F.col("n")).alias("accuracy")]


def fold_scores(t: DataFrame, scores: DataFrame) -> DataFrame:
    """(fold, precision, recall, f1, accuracy) of out-of-fold scores (article_id, s) over the ``fold`` column of ``t``."""
    p = t.select("article_id", "label", "fold").join(scores, "article_id").withColumn("pred", (F.col("s") > 0.5).cast("int"))
    hit, said, is_one = (F.col("pred") == 1) & (F.col("label") == 1), F.col("pred") == 1, F.col("label") == 1
    counts = p.groupBy("fold").agg(F.count_if(hit).alias("tp"), F.count_if(said).alias("pp"), F.count_if(is_one).alias("ap"),
                                   F.count_if(F.col("pred") == F.col("label")).alias("right"), F.count(F.lit(1)).alias("n"))
    return counts.select("fold", *scorers())


#: folds of each regressor
REGRESSION_FOLDS = {"rf": 5, "gbt": 10}


def summary(scores: DataFrame, model: str, k: int, names: Sequence[str]) -> DataFrame:
    every = [(c, F.col(c) if c in names else F.lit(None).cast("double")) for c in (*SCORERS, "rmse")]
    r = scores.agg(*[X.r6(F.avg(v)).alias(f"mean_{c}") for c, v in every], *[X.r6(F.stddev_pop(v)).alias(f"std_{c}") for c, v in every])
    return r.select(F.lit(model).alias("model"), F.lit(k).alias("folds"), "*")


def cross_validate(spark, d, k: int = 10, width: int = 6) -> DataFrame:
    """One row per model: the mean and population std over its folds of precision, recall, F1 and accuracy for the
    best-F1 forest and the boosted trees (k folds), and of the RMSE for the two regressors."""
    t = rows_table(fold_col(training_frame(spark, d), k), "fold-rows")
    data = TB.stored(regression_frame(spark, d), "regression-rows")
    r5, r10 = (rows_table(fold_col(data, n, key="id"), "regression-folds") for n in REGRESSION_FOLDS.values())
    folds = [r["fold"] for r in t.select("fold").distinct().collect()]  # k at most
    est, least = forests()["best_f1"]
    jobs = [lambda: boosted_scores(t, folds), lambda: boosted_rmse(r10)]
    jobs += [lambda f=f: forest_rmse(r5, f) for f in range(REGRESSION_FOLDS["rf"])]
    n = len(jobs)
    jobs += [lambda f=f: forest_scores(t.filter(F.col("fold") != f), t.filter(F.col("fold") == f), est, least) for f in folds]
    got = side_by_side(spark, jobs, width)
    return union([summary(fold_scores(t, union(got[n:])), "best_f1", k, SCORERS), summary(fold_scores(t, got[0]), "boosted", k, SCORERS),
                  summary(union(got[2:n]), "rf_regressor", REGRESSION_FOLDS["rf"], ["rmse"]), summary(got[1], "gbt_regressor", REGRESSION_FOLDS["gbt"], ["rmse"])])


def cross_validate_stack(spark, d, k: int = 10, inner: int = 5) -> DataFrame:
    """The summary row of the stack over k folds: k times the fits of a stack."""
    t = rows_table(fold_col(training_frame(spark, d), k), "fold-rows")
    folds = [r["fold"] for r in t.select("fold").distinct().collect()]
    scores = [stacked(t.filter(F.col("fold") != f).drop("fold"), t.filter(F.col("fold") == f).drop("fold"), inner) for f in folds]
    return summary(fold_scores(t, union(scores)), "stacking", k, SCORERS)


def boosted_scores(t: DataFrame, folds: Sequence[int]) -> DataFrame:
    out = B.fit_boosted(t, BOOSTED, folds, "article_id")[1]
    return out.select(F.col("id").cast("long").alias("article_id"), probability(F.col("margin")).alias("s"))


@dataclass(frozen=True)
class Grid:
    """Values of the tuned parameters; depth 0 is unlimited. The default is the reference's grid, 3,000 settings."""

    trees: tuple[int, ...] = tuple(int(600 + 1400 * i / 9) for i in range(10))
    depth: tuple[int, ...] = (20, 40, 60, 80, 0)
    least_split: tuple[int, ...] = tuple(5 + 5 * i for i in range(10))
    least_leaf: tuple[int, ...] = (2, 4, 8)
    bootstrap: tuple[bool, ...] = (True, False)
    columns: str = "sqrt"


DEEPEST = 30  # MLlib's limit: the most for fits of more rows than a task may hold
UNLIMITED = 1 << 30


def grid_trials(train: DataFrame, grid: Grid, k: int = 5, width: int = 6) -> DataFrame:
    """One row per setting: ``trial``, its parameters and the mean of four scorers over k stratified folds. The trees of a
    fold with and without bootstrap serve all other parameters: those of the least leaves grow together, and one forest
    answers every number of trees, depth and least number of rows to split."""
    spark = train.sparkSession
    t = rows_table(M.stratified_folds(train, "label", "article_id", k), "grid-rows")
    depths = sorted({x or UNLIMITED for x in grid.depth})

    def grown(f, boot):
        made = [(forest(max(grid.trees), min(max(depths), DEEPEST), leaf, grid.columns, boot), min(grid.least_split)) for leaf in grid.least_leaf]
        return forests_alike(t.filter(F.col("fold") != f), made, rows[f], max(depths))

    def counts(f, leaf, boot):
        out = FO.grid_counts(t.filter(F.col("fold") == f), nodes[f, boot][grid.least_leaf.index(leaf)], grid.trees, grid.least_split, depths)
        return TB.stored(out.select("*", F.lit(f).alias("fold"), F.lit(leaf).alias("least_leaf"), F.lit(boot).alias("bootstrap")), "grid-counts")

    rows = side_by_side(spark, [lambda f=f: forest_rows(t.filter(F.col("fold") != f)) for f in range(k)], width)
    fits = [(f, b) for f in range(k) for b in grid.bootstrap]
    nodes = dict(zip(fits, side_by_side(spark, [lambda f=f, b=b: grown(f, b) for f, b in fits], width)))
    got = union(side_by_side(spark, [lambda f=f, a=a, b=b: counts(f, a, b) for f, b in fits for a in grid.least_leaf], width))
    means = got.select("fold", "trees", "least_split", "least_leaf", "bootstrap", F.col("depth").alias("_depth"), *scorers()).groupBy(
        "trees", "least_split", "least_leaf", "bootstrap", "_depth").agg(*[F.avg(c).alias(f"mean_{c}") for c in SCORERS])
    labels = F.broadcast(spark.createDataFrame([(x, x or UNLIMITED) for x in grid.depth], "depth long, _depth long"))
    order = ["bootstrap", "depth", "least_leaf", "least_split", "trees"]
    return M.ranked(means.join(labels, "_depth").select(*order, *[f"mean_{c}" for c in SCORERS]), order, "trial")


def refit_best(train: DataFrame, trials: DataFrame, scorer: str = "f1") -> tuple[FO.Nodes, dict]:
    """The forest of the best trial by a scorer, fitted on all of ``train``, and the trial; its nodes are cut at
    the trial's ``least_split`` when it scores."""
    best = trials.orderBy(F.desc(f"mean_{scorer}"), "trial").first().asDict()
    est = forest(best["trees"], min(best["depth"] or DEEPEST, DEEPEST), best["least_leaf"], "sqrt", best["bootstrap"])
    return FO.Nodes(forest_nodes(train, est, best["least_split"], depth=best["depth"] or UNLIMITED).toArrow()), best


#: what the queries run: every setting of the reference
GRID = Grid()


def whole_trials(spark, d) -> DataFrame:
    """Trials of ``GRID`` on nine tenths of the labelled articles, written once."""
    return kept(spark, d, "trials", lambda: TB.stored(grid_trials(_split(training_frame(spark, d))[0], GRID), "trials"))


def refit_report(spark, d) -> DataFrame:
    """The trial of the best F1 of the whole grid, refitted on nine tenths and reported on the rest."""
    train, test = _split(training_frame(spark, d))
    nodes, best = refit_best(train, whole_trials(spark, d))
    return report(TB.stored(FO.probabilities(test, nodes, "article_id", best["least_split"]), "forest-scores"), test, "grid_best_f1")


def save_scorer(spark, features: Features, model: RandomForestClassificationModel | DataFrame, least_split: int, path: str) -> None:
    """The chosen features and a fitted forest, or its nodes, below a folder that driver and executors share."""
    features.save(path)
    TB.write_table(model if isinstance(model, DataFrame) else FO.node_table(spark, [FO.saved(spark, model)]), "nodes", path=f"{path}/forest")
    spark.createDataFrame([(least_split,)], "least_split int").write.mode("overwrite").parquet(f"{path}/settings")


def load_scorer(spark, path: str) -> tuple[Features, DataFrame, int]:
    nodes = spark.read.parquet(f"{path}/forest")
    return Features.load(spark, path), nodes, spark.read.parquet(f"{path}/settings").first()["least_split"]


def corpus_frame(spark, d) -> DataFrame:
    """The stored model frame of all articles, labelled or not."""
    from ..plans import views as V
    return TB.stored(model_frame(spark, d, V.labelled_articles(spark, d)), "corpus-frame")


def score_articles(spark, d, path: str, rows: DataFrame | None = None) -> DataFrame:
    """Class and probability of every article by a saved scorer; nothing is fitted. ``rows``: ``corpus_frame(spark, d)``
    if it is known."""
    features, nodes, least_split = load_scorer(spark, path)
    rows = corpus_frame(spark, d) if rows is None else rows
    s = FO.probabilities(features.transform(rows), nodes, "article_id", least_split)
    return s.select("article_id", (F.col("s") > 0.5).cast("int").alias("predicted"), F.when(F.col("s") > 0.5, F.col("s")).otherwise(0.0).alias("probability"))


def saved_scorer(spark, d, corpus: DataFrame | None = None) -> str:
    """The folder of the best-F1 forest, fitted on all labelled articles and saved."""
    def make():
        features, t = kept(spark, d, "training", lambda: fitted_frame(spark, d, corpus))
        est, least = forests()["best_f1"]
        path = TB.table_dir(spark, "scorer")
        save_scorer(spark, features, forest_nodes(t, est, least), least, path)
        return path

    return kept(spark, d, "scorer", make)


def score_corpus(spark, d) -> DataFrame:
    """Fit and score over one frame: the features of an article are made once, also if it is labelled."""
    rows = corpus_frame(spark, d)
    return score_articles(spark, d, saved_scorer(spark, d, rows), rows)


def regression_frame(spark, d) -> DataFrame:
    """All writer features and a score per writer. The score stand-in is the mean value of the writer's views; time and
    edit features are of the other events alone, so none holds the score; text measures are of the writer's text, 0 where
    there is none."""
    from ..plans import q_keystrokes as QK
    from ..plans import views as V
    from . import keystrokes as K
    views = V.table(spark, d, "events").filter("event_type = 'view'")
    log = QK.event_log(spark, d).join(views.select("event_id"), "event_id", "left_anti")
    text = QK.writer_texts(spark, d)
    text = text.select("id", *[c.alias(k) for k, c in {**K.punct_features(F.col("final_text")), **K.word_features(F.col("final_text"))}.items()])
    feats = K.time_features(log).join(K.edit_features(log), "id").join(text, "id", "left")
    ev = views.groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("score"))
    data = feats.join(ev, "id").na.fill(0)
    cols = [c for c in data.columns if c not in ("id", "score")]
    data = data.select("id", "score", *[F.col(c).cast("double").alias(c) for c in cols])
    return VectorAssembler(inputCols=cols, outputCol="features").transform(data).select("id", "score", "features")


def forest_regressor():
    return RandomForestRegressor(labelCol="score", numTrees=1000, seed=42)


def forest_rmse(data: DataFrame, f: int) -> DataFrame:
    """(fold, rmse) of the forest fitted without a fold of ``data``."""
    pred = forest_regressor().fit(data.filter(F.col("fold") != f)).transform(data.filter(F.col("fold") == f))
    return TB.stored(M.rmse_mse(pred, "score", "prediction").select("rmse"), "fold-rmse").withColumn("fold", F.lit(f))


def boosted_rmse(data: DataFrame) -> DataFrame:
    """(fold, rmse) of the boosted regressor over the ``fold`` column of ``data``; all folds in the same jobs."""
    folds = [r["fold"] for r in data.select("fold").distinct().collect()]  # a bounded number
    out = B.fit_boosted(data, BOOSTED_REGRESSOR, folds, "id", "score")[1]
    return out.groupBy("fold").agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("margin"), 2))).alias("rmse"))


def regress(spark, d, kind: str) -> DataFrame:
    """Writer features -> score regression, RMSE on a random 80/20 split."""
    data = rows_table(fold_col(regression_frame(spark, d), 5, key="id", seed=42), "regression-rows")  # fold 0 is the test
    if kind == "rf":
        pred = forest_regressor().fit(data.filter("fold <> 0")).transform(data.filter("fold = 0")).select(F.col("score").alias("label"), "prediction")
    else:
        pred = B.fit_boosted(data, BOOSTED_REGRESSOR, [0], "id", "score")[1].select("label", F.col("margin").alias("prediction"))
    return M.rmse_mse(pred, "label", "prediction").withColumn("model", F.lit(kind))
