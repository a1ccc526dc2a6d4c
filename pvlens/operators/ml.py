"""Models the original only describes, re-aimed as distributed Spark ML jobs
(ML1, ML2). They are not the described methods: ML1 is a TF-IDF logistic
regression, not a fine-tuned transformer; ML2 is k-means on the given
embedding vectors, not UMAP + HDBSCAN (there is no density-based noise
label; every point gets a cluster)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_severity_model(train: DataFrame, text_col: str = "text", label_col: str = "label",
                       num_features: int = 1 << 16, max_iter: int = 10,
                       reg_param: float = 0.01) -> PipelineModel:
    """ML1: whitespace tokens (lower-cased) -> hashed term counts -> IDF ->
    multinomial logistic regression on the encoded V4 labels. Hashing keeps
    the feature space fixed, so no vocabulary is collected to the driver."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"\s+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter,
                           regParam=reg_param, family="multinomial"),
    ])
    return pipe.fit(train.withColumn("_label", F.col(label_col).cast("double")))


def predict_severity(model: PipelineModel, df: DataFrame, keys: list[str]) -> DataFrame:
    return model.transform(df).select(*keys, F.col("prediction").cast("int").alias("prediction"))


def cluster_embeddings(df: DataFrame, vec_col: str = "embedding", k: int = 8,
                       seed: int = 42, max_iter: int = 20) -> DataFrame:
    """ML2: k-means (k-means|| init, distributed Lloyd iterations) on the
    embedding vectors; adds ``cluster``."""
    data = df.withColumn("_vec", array_to_vector(F.col(vec_col)))
    model = KMeans(featuresCol="_vec", predictionCol="cluster", k=k, seed=seed,
                   maxIter=max_iter).fit(data)
    return model.transform(data).drop("_vec")
