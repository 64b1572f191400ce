"""Text classifier: train, select, score, describe, save/load (ML-4..ML-7, IO-9).

The reference fine-tunes a transformer on one GPU. The Spark counterpart is a
distributed Spark ML pipeline over character n-grams (works for Chinese and
for space-separated languages alike):

    StringIndexer(label) -> RegexTokenizer(chars) -> NGram(2)
      -> HashingTF(unigrams) + HashingTF(bigrams) -> VectorAssembler -> IDF
      -> LogisticRegression(multinomial)

Model choice follows the reference's rule (best macro-F1 on the dev split)
over a small parameter grid; every candidate fit is a distributed job.
Scoring maps the probability vector to ``intent``, ``confidence`` and a
``probs`` map with JVM-side array functions (no Python per row).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import (IDF, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize_label_id
from . import softmax, topics
from .evaluate import macro_scores


def build_pipeline(num_features: int = 1 << 16, reg_param: float = 0.0, max_iter: int = 50,
                   text_col: str = "text", label_col: str = "label") -> Pipeline:
    """ML-4: the training pipeline (character unigrams + bigrams, TF-IDF, LR)."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc",
                      handleInvalid="error"),
        RegexTokenizer(inputCol=text_col, outputCol="chars", pattern="", gaps=True, toLowercase=False,
                       minTokenLength=1),
        NGram(n=2, inputCol="chars", outputCol="bigrams"),
        HashingTF(inputCol="chars", outputCol="tf1", numFeatures=num_features),
        HashingTF(inputCol="bigrams", outputCol="tf2", numFeatures=num_features),
        VectorAssembler(inputCols=["tf1", "tf2"], outputCol="tf"),
        IDF(inputCol="tf", outputCol="features", minDocFreq=1),
        LogisticRegression(featuresCol="features", labelCol="label_idx", family="multinomial",
                           regParam=reg_param, maxIter=max_iter),
    ])


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def score(model: PipelineModel, df: DataFrame, digits: int = 4, keep: tuple = ()) -> DataFrame:
    """ML-5: ``intent``, ``confidence`` (rounded) and ``probs`` per row, in batch.

    Rows with an empty text are rejected by the caller's contract check (FL-6),
    not here; this function scores whatever it is given.
    """
    labels = labels_of(model)
    lab = F.array(*[F.lit(x) for x in labels])
    out = model.transform(df.withColumn("label", F.lit(labels[0]))) if "label" not in df.columns \
        else model.transform(df)
    out = out.withColumn("__p", vector_to_array("probability"))
    best = F.array_position(F.col("__p"), F.array_max("__p")).cast("int")
    return out.select(*keep, "text",
                      F.element_at(lab, best).alias("intent"),
                      F.round(F.array_max("__p"), digits).alias("confidence"),
                      F.map_from_arrays(lab, F.transform("__p", lambda v: F.round(v, digits))).alias("probs"))


def fit_best(train: DataFrame, dev: DataFrame, reg_params=(0.0, 0.01), num_features: int = 1 << 16,
             max_iter: int = 50) -> tuple[PipelineModel, DataFrame]:
    """Fit one model per grid point; keep the best dev macro-F1 (ties: first).

    The feature stages are fitted once and both featurised sets are persisted, so
    every grid point's L-BFGS iterations and its scores on dev read cached vectors
    instead of re-tokenising the text. Returns the model and the grid results.
    """
    spark = train.sparkSession
    stages = build_pipeline(num_features, 0.0, max_iter).getStages()
    counting = Pipeline(stages=stages[:-2]).fit(train)
    counted = counting.transform(train).select("label_idx", "tf").persist()  # texts are taken apart once, for IDF and training
    weights = stages[-2].fit(counted)
    x = weights.transform(counted).select("label_idx", "features").persist()
    held = weights.transform(counting.transform(dev)).select("text", "label", "features").persist()
    rows, best, best_f1 = [], None, None
    try:
        x.count()
        counted.unpersist()
        for rp in reg_params:
            lr = stages[-1].copy({stages[-1].regParam: float(rp)}).fit(x)
            pred = score(PipelineModel([counting.stages[0], lr]), held, keep=("label",)).select(F.col("label").alias("y"), F.col("intent").alias("pred"))
            f1 = macro_scores(pred).first()["f1"]
            rows.append((float(rp), float(f1)))
            if best_f1 is None or f1 > best_f1:
                best, best_f1 = PipelineModel([*counting.stages, weights, lr]), f1
    finally:
        counted.unpersist()
        x.unpersist()
        held.unpersist()
    return best, spark.createDataFrame(rows, "reg_param DOUBLE, macro_f1 DOUBLE")


def fit_rounds(train: DataFrame, dev: DataFrame, rounds: int = 20, iterations: int = 5, patience: int = 3, num_features: int = 1 << 12,
               seed: int = 42, text_col: str = "text", label_col: str = "label") -> tuple[PipelineModel, DataFrame]:
    """ML-4: train in rounds and keep the round with the best macro-F1 on ``dev``.

    Each round goes on from the weights of the one before with ``iterations`` more steps
    of L-BFGS over the whole training set, is scored on ``dev`` and kept if it beats all
    before (ties: the earlier one). After ``patience`` rounds without a better one training
    stops. The classifier is a softmax regression over hashed character unigrams and
    bigrams, a network without hidden layers, trained on sparse rows (``softmax``).
    Features are counted once in Arrow batches (``grams``) and read from the shared folder;
    the model has Spark ML's stages for the same ones. Returns the best model and the
    curve ``(round, iterations, loss, macro_f1, best)``."""
    spark = train.sparkSession
    indexer = StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="error").fit(train)
    x = softmax.counted_rows(indexer.transform(train), num_features, "label_idx", text_col)
    held = softmax.named_rows(dev, num_features, label_col, text_col)
    idf = softmax.inverse_frequencies(x, num_features)
    labels = list(indexer.labels)
    classes = max(2, len(labels))
    blank = spark.createDataFrame([(0.0, Vectors.sparse(num_features, {}))], ["label_idx", "features"])
    # initialWeights=None as ever: Spark then starts from weights of its own, whatever the seed
    net = MultilayerPerceptronClassifier(layers=[num_features, classes], maxIter=0, seed=seed, solver="l-bfgs", labelCol="label_idx",
                                         featuresCol="features", initialWeights=None)
    loss_at = softmax.objective(x, classes, softmax.weighed(idf))
    weights, best, rows, since = net.fit(blank).weights.toArray(), None, [], 0  # no steps: the first weights
    for number in range(1, rounds + 1):
        weights, loss = softmax.minimize(loss_at, weights, iterations, 1e-9)
        f1 = float(macro_scores(softmax.predicted(held, weights, labels, softmax.weighed(idf))).first()["f1"] or 0.0)
        better = best is None or f1 > best[1]
        rows.append((number, number * iterations, loss, f1))
        best, since = ((weights, f1, number), 0) if better else (best, since + 1)
        if since >= patience:
            break
    fitted = net.copy({net.initialWeights: Vectors.dense(best[0])}).fit(blank)  # no steps: a model with these weights
    curve = spark.createDataFrame([(*r, r[0] == best[2]) for r in rows], "round INT, iterations INT, loss DOUBLE, macro_f1 DOUBLE, best BOOLEAN")
    stages = [RegexTokenizer(inputCol=text_col, outputCol="chars", pattern="", gaps=True, toLowercase=False, minTokenLength=1),
              NGram(n=2, inputCol="chars", outputCol="bigrams"),
              SQLTransformer(statement="SELECT *, concat(chars, bigrams) AS grams FROM __THIS__"),
              HashingTF(inputCol="grams", outputCol="tf", numFeatures=num_features),
              ElementwiseProduct(inputCol="tf", outputCol="weights", scalingVec=Vectors.dense(idf)),
              Normalizer(inputCol="weights", outputCol="features")]
    return PipelineModel([indexer, *stages, fitted]), curve


def model_info(model: PipelineModel, path: str | None = None, max_length: int | None = None) -> DataFrame:
    """ML-7: one row describing the model."""
    spark = SparkSession.getActiveSession()
    lr = model.stages[-1]
    labels = labels_of(model)
    n_params = lr.numFeatures * lr.numClasses + lr.numClasses
    return spark.createDataFrame(
        [(path, max_length, len(labels), labels, int(lr.numFeatures), int(n_params))],
        "model_path STRING, max_length INT, num_labels INT, intent_labels ARRAY<STRING>, "
        "num_features INT, model_size BIGINT")


def save(model: PipelineModel, path: str) -> None:
    """IO-9: the labels travel inside the model (StringIndexer stage)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def induce_label_space(questions: DataFrame, max_labels: int = 25, text_col: str = "text",
                       vocab_size: int = 1 << 16, top_terms: int = 5,
                       token_pattern: str = r"(?U)\W+|(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}])|(?=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}])",
                       other_cosine: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """ML-6: a label space from unlabelled questions (re-aimed from an LLM call).

    TF-IDF of unit length over words of any script, and over single characters and
    pairs of neighbours (as all tokens are paired) where a script has no blanks ->
    spherical k-means with k = max_labels - 1 (``topics``); each cluster becomes a label
    named by the heaviest terms of its centre. A text whose cosine with its centre is below
    ``other_cosine``, or far below those of its cluster, or that has no term, gets OTHER, the
    fallback the reference always allows. Terms of one text count too; of more than
    ``vocab_size`` the most frequent stay. Returns
    ``(label_space(id, name, description, keywords), assignments(text, label_id))``.
    """
    found = topics.spherical_kmeans(questions, max(2, max_labels - 1), text_col, token_pattern, vocab_size)
    heavy = found.centres.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "term"))) \
        .filter(F.col("place") <= top_terms)
    keywords = heavy.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    named = keywords.select(F.concat(F.lit("CLUSTER_"), F.col("cluster").cast("string")).alias("id"), F.transform("t", lambda x: x["term"]).alias("keywords"))
    space = named.select("id", F.get("keywords", F.lit(0)).alias("name"),
                         F.concat(F.lit("Questions about: "), F.array_join("keywords", ", ")).alias("description"), "keywords")
    other = questions.sparkSession.createDataFrame([("OTHER", "OTHER", "Questions that fit no other label.", [])], space.schema)
    space = space.unionByName(other).withColumn("id", sanitize_label_id(F.col("id"), F.col("name")))
    keyed = questions.select(text_col, topics.text_key(text_col).alias("key"))
    near = ~F.col("far") & (F.col("cosine") >= other_cosine)
    assign = keyed.join(found.assigned, "key", "left") \
        .select(text_col, F.when(near, F.concat(F.lit("CLUSTER_"), F.col("cluster").cast("string"))).otherwise("OTHER").alias("label_id"))
    return space, assign
