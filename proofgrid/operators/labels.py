"""Label consistency: a model that never sees the contributor it judges, and the neighbours' agreement."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.operators.components import shared_table


def held_out_folds(samples: DataFrame, folds: int = 5, least_groups: int = 3, least_rows: int = 20) -> DataFrame:
    """``samples`` with fold: one for each contributor if enough of them have enough rows (at most ``folds`` * 4 folds,
    contributors dealt by hash beyond), otherwise ``folds`` by a hash of the id; unattributed rows always by hash."""
    n = samples.filter("contributor IS NOT NULL").groupBy("contributor").count().filter(F.col("count") >= least_rows).count()
    by_hash = F.pmod(F.xxhash64("sample_id"), F.lit(folds)).cast("int")
    if n < least_groups:
        return samples.withColumn("fold", by_hash)
    most = min(n, 4 * folds)
    return samples.withColumn("fold", F.when(F.col("contributor").isNull(), -1 - by_hash).otherwise(F.pmod(F.xxhash64("contributor"), F.lit(most))).cast("int"))


def label_model(samples: DataFrame, folds: int = 5, penalty: float = 0.3) -> DataFrame:
    """(sample_id, contributor, declared, predicted, p_declared, p_predicted) for samples (sample_id, contributor, label, embedding)."""
    labelled = samples.filter("label IS NOT NULL").select("sample_id", "contributor", F.col("label").cast("string").alias("declared"), array_to_vector("embedding").alias("features"))
    indexer = StringIndexer(inputCol="declared", outputCol="y", stringOrderType="alphabetAsc").fit(labelled)
    rows = shared_table(held_out_folds(indexer.transform(labelled), folds).withColumn("x", vector_to_array("features")).drop("features")).withColumn("features", array_to_vector("x")).drop("x")
    names = F.array(*map(F.lit, indexer.labels))
    out = None
    for (fold,) in sorted(map(tuple, rows.select("fold").distinct().collect())):
        train = rows.filter(F.col("fold") != fold)
        model = LogisticRegression(labelCol="y", regParam=1 / (penalty * max(1, train.count())), elasticNetParam=0.0, standardization=False, maxIter=100).fit(train)
        part = model.transform(rows.filter(F.col("fold") == fold)).withColumn("p", vector_to_array("probability"))
        part = part.select("sample_id", "contributor", "declared", F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"), F.col("p")[F.col("y").cast("int")].alias("p_declared"), F.array_max("p").alias("p_predicted"))
        out = part if out is None else out.unionByName(part)
    return shared_table(out)


def inconsistent(model: DataFrame, agreement: DataFrame, least: float = 0.6, most: float = 0.3) -> DataFrame:
    """Samples whose confident prediction, neighbours and own-class threshold all speak against the declared label."""
    threshold = F.avg("p_declared").over(Window.partitionBy("declared"))
    rows = model.withColumn("threshold", threshold).join(agreement, "sample_id")
    hit = (F.col("predicted") != F.col("declared")) & (F.col("p_predicted") >= least) & (F.col("agreement") <= most) & (F.col("p_declared") < F.col("threshold"))
    return rows.filter(hit).withColumn("score", 1 - (F.col("agreement") + F.col("p_declared")) / 2)
