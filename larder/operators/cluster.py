"""Clusters of ingredients and recipes with Spark's ML library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.vectors import l2_distance
from larder.sources.workdir import materialize

#: Columns of the macro profile.
MACRO = ("energy_kcal", "protein_g", "saturated_fats_g", "fat_g", "carb_g", "fiber_g", "sugar_g")


def scaled(df: DataFrame, cols: Sequence[str], center: bool = True) -> DataFrame:
    """Adds the vector ``scaled`` of the columns, bad values as 0, each to deviation 1 and (with center) mean 0."""
    clean = df.withColumns({c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in cols})
    together = VectorAssembler(inputCols=list(cols), outputCol="_raw").transform(clean)
    return StandardScaler(withMean=center, withStd=True, inputCol="_raw", outputCol="scaled").fit(together).transform(together).drop("_raw")


def _clusters(df: DataFrame, cols: Sequence[str], axes: int, prefix: str, model, center: bool = True) -> DataFrame:
    """Projection to ``axes`` columns, a cluster on it and the distance to its centroid."""
    wide = scaled(df, cols, center)
    low = PCA(k=axes, inputCol="scaled", outputCol="_pca").fit(wide).transform(wide).drop("scaled")
    fitted = model.setFeaturesCol("_pca").setPredictionCol(f"cluster_{prefix}").fit(low)
    out = centroid_distance(fitted.transform(low), fitted.clusterCenters(), "_pca", f"cluster_{prefix}", f"dist_{prefix}_centroid")
    return out.withColumn("_axes", vector_to_array("_pca")).withColumns({f"pca_{prefix}_{i + 1}": F.col("_axes")[i] for i in range(axes)}).drop("_pca", "_axes")


def centroid_distance(df: DataFrame, centers: list, vector: str, cluster: str, out: str) -> DataFrame:
    """Distance of each row to the centroid of its cluster; centroids are few and part of the expression."""
    table = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centers))
    return df.withColumn(out, l2_distance(vector_to_array(vector), F.get(table, F.col(cluster))))


def macro_clusters(df: DataFrame, cols: Sequence[str] = MACRO, axes: int = 3, k: int = 3, seed: int = 42) -> DataFrame:
    return _clusters(df, cols, axes, "macro", KMeans(k=k, seed=seed))


def micro_clusters(df: DataFrame, cols: Sequence[str], axes: int = 2, k: int = 4, seed: int = 42) -> DataFrame:
    return _clusters(df, cols, axes, "micro", KMeans(k=k, seed=seed))


def total_clusters(df: DataFrame, cols: Sequence[str], axes: int = 2, k: int = 3, seed: int = 42) -> DataFrame:
    """Clusters from a divisive hierarchy. Values are not centred: the first division moves the centre in proportion to its length."""
    return _clusters(df, cols, axes, "total", BisectingKMeans(k=k, seed=seed), center=False)


def cluster_profile(df: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    """Mean of every column per cluster, and its size."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in cols))


def knee(explained: Sequence[float]) -> int:
    """How many axes to keep: where the curve of their summed variance is furthest above its chord from nothing to all."""
    total = [0.0]
    for x in explained:
        total.append(total[-1] + float(x))
    n = len(explained)
    return max(range(1, n + 1), key=lambda i: (round(total[i] - total[-1] * i / n, 9), -i)) if n else 0


def recipe_clusters(df: DataFrame, vector: str = "embedding", axes: int | None = None, ks: Sequence[int] = (3, 4, 5, 6), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows with cluster_km, x and y at the k of the best silhouette, and the table of k, silhouette, explained, axes.

    Without ``axes`` their number (two at least) is the knee of the explained variance, from the one pass that sums the covariance
    of all axes. The projection is written once; every k and its silhouette read it. Rows with a null vector are left out.
    """
    rows = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    some = rows.where(F.col(vector).isNotNull())
    if axes is None:
        first = some.select(F.size(vector)).first()
        full = PCA(k=first[0], inputCol="_v", outputCol="_pca").fit(some) if first else None
        axes = max(2, knee(list(full.explainedVariance))) if full else 2
    pca = PCA(k=axes, inputCol="_v", outputCol="_pca").fit(some)
    low, best, scores = materialize(pca.transform(some).drop("_v"), "projected"), None, []
    for k in ks:
        got = KMeans(k=k, seed=seed, featuresCol="_pca", predictionCol="cluster_km").fit(low).transform(low)
        score = ClusteringEvaluator(featuresCol="_pca", predictionCol="cluster_km").evaluate(got)
        scores.append((k, float(score), float(sum(pca.explainedVariance)), axes))
        if best is None or score > best[0]:
            best = (score, got)
    axes_of = vector_to_array("_pca")
    table = df.sparkSession.createDataFrame(scores, "k int, silhouette double, explained double, axes int")
    return best[1].withColumns({"x": axes_of[0], "y": axes_of[1]}).drop("_pca"), table
