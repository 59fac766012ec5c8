"""The area classifier: text features, two model families, selection by F1 on a validation split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions.text import labelled_values, value_tokens

from .evaluating import label_quality

#: The weights of the two classes in training.
WEIGHTS = {0: 1.0, 1: 2.0}


def text_input(df: DataFrame, size: int = 32) -> DataFrame:
    """features text `s` of e_name and e_category, and its words framed and padded to `size`."""
    from placeloom.functions.text import framed_single, tokens

    s = labelled_values([("e_name", F.col("e_name")), ("e_category", F.col("e_category"))])
    out = df.withColumn("s", s)
    return out.withColumns({k: v for k, v in framed_single(tokens(F.lower("s")), size).items()})


def token_input(df: DataFrame, size: int = 16) -> DataFrame:
    """words: exactly `size` words of the values, filled up with `padding`."""
    return df.withColumn("words", F.slice(F.concat(value_tokens([F.col("e_name"), F.col("e_category")]), F.array_repeat(F.lit("padding"), size)), 1, size))


def looked_up(df: DataFrame, vectors: DataFrame, key: str, width: int) -> DataFrame:
    """key, embedded: the mean of the words' vectors (word, vec); unknown words count as the mean of all vectors."""
    mean = vectors.agg(F.array(*[F.avg(F.element_at("vec", i + 1)) for i in range(width)]).alias("_mean"))
    w = df.select(key, F.explode("words").alias("word")).join(vectors, "word", "left").join(F.broadcast(mean))
    v = F.coalesce("vec", "_mean")
    return w.groupBy(key).agg(F.array(*[F.avg(F.element_at(v, i + 1)) for i in range(width)]).alias("embedded"))


def _pipeline(family: str, seed: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import HashingTF, Word2Vec

    if family == "bert":
        return [Pipeline(stages=[HashingTF(inputCol="words", outputCol="v", numFeatures=4096), LogisticRegression(featuresCol="v", labelCol="e_type", weightCol="w", regParam=r)]) for r in (0.001, 0.01, 0.1)]
    if family == "lstm":
        return [Pipeline(stages=[Word2Vec(inputCol="words", outputCol="v", vectorSize=32, minCount=1, seed=seed), MultilayerPerceptronClassifier(featuresCol="v", labelCol="e_type", layers=[32, k, 2], seed=seed)]) for k in (8, 16)]
    raise ValueError(f"unknown family {family}; there are bert, lstm")


def selected(train: DataFrame, valid: DataFrame, family: str = "bert", seed: int = 1):
    """The fitted pipeline with the best F1 on valid; both need e_name, e_category, e_type."""
    weight: Column = F.when(F.col("e_type") > 0, WEIGHTS[1]).otherwise(WEIGHTS[0])
    ready = lambda d: token_input(d).withColumn("w", weight).withColumn("e_type", F.col("e_type").cast("double"))
    a, b = ready(train).cache(), ready(valid).cache()
    best = None
    for p in _pipeline(family, seed):
        m = p.fit(a)
        f1 = label_quality(m.transform(b), F.col("prediction"), F.col("e_type")).first().f1
        if best is None or f1 > best[0]:
            best = (f1, m)
    a.unpersist()
    b.unpersist()
    return best[1]


def predicted(model, df: DataFrame) -> DataFrame:
    return model.transform(token_input(df).withColumn("e_type", F.col("e_type").cast("double")))
