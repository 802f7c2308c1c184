"""Training, scoring and batch inference of recommendations and of text classifiers, with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import features as X
from . import ranking as K
from . import sampling as S
from .fm import FMModel, fit_fm


def train_fm(df: DataFrame, indices: list[str], numbers: list[str], label: str = "label", factor_size: int = 4, weight: str | None = None, max_iter: int = 30, seed: int = 42) -> FMModel:
    """A factorisation machine with linear terms on vocabulary indices and numbers, each row by its weight."""
    return fit_fm(df, indices, numbers, label, factor_size, weight, max_iter, seed)


def score(model: FMModel, df: DataFrame) -> DataFrame:
    """df with score, the probability of label 1."""
    return model.transform(df)


def train_sentiment(df: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14) -> PipelineModel:
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+", toLowercase=True)
    tf = HashingTF(inputCol="_w", outputCol="_f", numFeatures=features)
    return Pipeline(stages=[words, tf, LogisticRegression(featuresCol="_f", labelCol=label, regParam=0.01, maxIter=20)]).fit(df)


def score_sentiment(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("_w", "_f", "probability", "rawPrediction", "prediction")


def preprocess(df: DataFrame, fields: list[str], train_end: str, valid_end: str, negatives: float = 1, cutoff: int = 2, seed: int = 42, key: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables of a training run from interactions: encoded rows with split and derived features,
    vocabulary, look-ups, sizes and counts. Statistics come from the train rows alone. key: columns that
    name a row, for its seeded negatives (see add_negatives)."""
    stored = Scratch(df.sparkSession, "preprocess")
    split = stored.put(S.time_split(df, "ts", train_end, valid_end), "split")
    train = split.where("split = 'train'")
    # Stored, so that Spark knows how small it is beside the rows.
    vocab = stored.put(X.build_vocab(train, fields, cutoff), "vocab")
    lookups = {"items": X.item_stats(train).drop("positives"), "categories": X.user_counts(train, "category"), "regions": X.user_counts(train, "region"), "users": X.user_stats(train)}
    maxima = lookups["categories"].agg(F.max("cnt").alias("max_category")).crossJoin(lookups["regions"].agg(F.max("cnt").alias("max_region")))
    rows = S.add_negatives(split, negatives, seed, attributes=("category", "tier", "region"), key=key)
    rows = X.encode(X.exp_features(X.attach_exp(rows, lookups), maxima), vocab, fields)
    return {"features": rows, "vocab": vocab, "sizes": X.feature_sizes(vocab), "meta": X.split_meta(split), **lookups}


def batch_inference(candidates: DataFrame, model: FMModel, version: str, generated: Column, top: int = 20) -> DataFrame:
    """Encoded candidates (member, anonymous, restaurant, …) as ranked lists, ready for write_recs."""
    return K.rank_candidates(score(model, candidates), version, generated, top=top).withColumn("dt", F.date_format("generated_at", "yyyy-MM-dd"))
