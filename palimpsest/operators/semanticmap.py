"""From text units to a labelled map: windows, two coordinates, clusters, keywords and previews.

Coordinates are the first two principal components and clusters are k-means with a
fixed seed, both of Spark's ML library over all rows; neighbour embeddings and
density clusters, whose results cannot be reproduced, are left out.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from palimpsest.operators.records import window_previews
from palimpsest.operators.search import cluster_labels, rolling_windows, usable_vectors
from palimpsest.session import checkpoint

#: Rows below which there is nothing to fit: their own first entries are the map, without clusters.
FEWEST = 5


def project(rows: DataFrame, vector: str, *, clusters: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``x``, ``y`` and ``cluster``; rows without a usable vector have none of them.

    An axis points to where its largest coefficient is positive.  With fewer than five
    usable rows x and y are the vector's first entries (0 where it has none) and the
    cluster is -1.  Vectors must have one length.
    """
    wide = rows.withColumn("_v", F.transform(vector, lambda x: x.cast("double")))
    good = usable_vectors(wide, "_v")
    n = good.limit(FEWEST).count()
    if n < FEWEST:
        x, y = (F.coalesce(F.get("_v", F.lit(k)), F.lit(0.0)) for k in (0, 1))
        placed = good.withColumns({"x": x, "y": y, "cluster": F.lit(-1)})
    else:
        fit = good.withColumn("_u", array_to_vector("_v"))
        size = len(fit.select("_v").first()[0])
        pca = PCA(k=min(2, size), inputCol="_u", outputCol="_p").fit(fit)
        axes = pca.pc.toArray()
        signs = [1.0 if axes[abs(axes[:, k]).argmax(), k] >= 0 else -1.0 for k in range(axes.shape[1])]
        at = vector_to_array("_p")
        x = F.get(at, F.lit(0)) * signs[0]
        y = F.get(at, F.lit(1)) * signs[1] if len(signs) > 1 else F.lit(0.0)
        model = KMeans(k=clusters, seed=seed, featuresCol="_u", predictionCol="cluster").fit(fit)
        placed = model.transform(pca.transform(fit)).withColumns({"x": x, "y": y}).drop("_u", "_p")
    rest = wide.withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double"), "cluster": F.lit(None).cast("int")})
    bad = rest.join(good.select("_v").distinct(), "_v", "left_anti")
    return placed.unionByName(bad).drop("_v")


def semantic_map(units: DataFrame, vectors: DataFrame, track: str, order: str, *, budget: int = 1500, overlap: int = 1, clusters: int = 8, stop: list[str] | None = None) -> DataFrame:
    """(track, window_no, first, last, x, y, cluster, label, preview) of the windows that have a vector.

    ``units`` are texts (track, order, kind, text), ``vectors`` one row for each window
    (track, window_no, vector).  A cluster's label is its three best keywords; a
    preview is the text of a window's first message.
    """
    windows = checkpoint(rolling_windows(units, track, order, "text", budget, overlap))
    points = checkpoint(project(windows.join(vectors, [track, "window_no"]), "vector", clusters=clusters).drop("vector", "characters"))
    body = units.select(F.col(track).alias("_t"), F.col(order).alias("_o"), "text")
    held = points.withColumn("_o", F.explode(F.sequence("first", "last"))).withColumnRenamed(track, "_t").join(body, ["_t", "_o"])
    texts = held.groupBy("_t", "window_no", "cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "text"))), lambda r: r["text"]), "\n").alias("text"))
    texts = texts.select(F.concat_ws("/", "_t", "window_no").alias("id"), F.when(F.col("cluster") >= 0, F.col("cluster").cast("string")).alias("cluster"), "text")
    names = cluster_labels(texts, "cluster", "id", "text", stop or []).select(F.when(F.col("cluster") == "", -1).otherwise(F.col("cluster").try_cast("int")).alias("cluster"), "label")
    previews = window_previews(windows, units, track, order)
    return points.join(names, "cluster", "left").join(previews, [track, "window_no"], "left").select(track, "window_no", "first", "last", "x", "y", "cluster", "label", "preview")
