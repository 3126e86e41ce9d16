"""Clustering, classification and transforms of bands: MLlib where it has the method, aggregates and small matrices otherwise.

What reaches the driver are centres, covariances and counts: a few numbers for each
class and pair of bands, whatever the number of cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats

#: Classes that are fitted at the same time, one against the rest: their rounds are many short jobs.
TOGETHER = 8


def vectors(cells: DataFrame, bands: Sequence[str], scaling: str | None = "standard") -> DataFrame:
    """Cells whose bands are all known, with ``features``, scaled to unit deviation or by quartiles."""
    from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler

    known = cells.dropna(subset=list(bands))
    known = VectorAssembler(inputCols=list(bands), outputCol="features" if scaling is None else "_raw").transform(known)
    if scaling is None:
        return known
    scaler = {"standard": lambda: StandardScaler(withMean=True, inputCol="_raw", outputCol="features"), "robust": lambda: RobustScaler(withCentering=True, inputCol="_raw", outputCol="features")}[scaling]()
    return scaler.fit(known).transform(known).drop("_raw")


def clusters(cells: DataFrame, bands: Sequence[str], k: int, method: str = "kmeans", scaling: str | None = "standard", seed: int = 1, rounds: int = 100) -> DataFrame:
    """Cells with ``label`` from 1 to k; labels are ordered by the mean of the first band. No cells give no rows."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans

    if cells.dropna(subset=list(bands)).isEmpty():
        return _none(cells, label="int")
    data = vectors(cells, bands, scaling)
    kind = KMeans if method == "kmeans" else BisectingKMeans
    found = kind(k=k, seed=seed, maxIter=rounds, featuresCol="features", predictionCol="_k").fit(data).transform(data).drop("features")
    return ordered_labels(found, "_k", bands[0])


def _none(cells: DataFrame, **columns: str) -> DataFrame:
    """No rows, with further columns."""
    return cells.where("false").withColumns({n: F.lit(None).cast(kind) for n, kind in columns.items()})


def ordered_labels(cells: DataFrame, raw: str, band: str) -> DataFrame:
    means = sorted((r.m, r[raw]) for r in cells.groupBy(raw).agg(F.avg(band).alias("m")).collect())
    places = F.create_map(*[x for n, (_, k) in enumerate(means) for x in (F.lit(k), F.lit(n + 1))]) if means else F.create_map()
    return cells.withColumn("label", (places[F.col(raw)] if means else F.lit(None).cast("int"))).drop(raw)


def spread_ratio(labelled: DataFrame, bands: Sequence[str]) -> DataFrame:
    """The variance ratio criterion of a labelling."""
    return stats.variance_ratio(labelled, "label", bands)


def _distances(bands: Sequence[str], centres, metrics) -> list[Column]:
    """Squared distance of a cell to each centre, under a matrix for each."""
    out = []
    for c, m in zip(centres, metrics, strict=True):
        d = [F.col(b) - float(v) for b, v in zip(bands, c, strict=True)]
        out.append(sum((F.lit(float(m[i][j])) * d[i] * d[j] for i in range(len(d)) for j in range(len(d)) if m[i][j]), F.lit(0.0)))
    return out


def _moments(weighted: DataFrame, bands: Sequence[str], weights: list[Column]):
    """For each class: its weight, mean and covariance under a weight of each row, in one aggregate."""
    import numpy as np

    pairs = [(i, j) for i in range(len(bands)) for j in range(i, len(bands))]
    exprs = []
    for n, w in enumerate(weights):
        exprs += [F.sum(w).alias(f"w{n}"), *[F.sum(w * F.col(b)).alias(f"m{n}_{i}") for i, b in enumerate(bands)], *[F.sum(w * F.col(bands[i]) * F.col(bands[j])).alias(f"c{n}_{i}_{j}") for i, j in pairs]]
    r = weighted.agg(*exprs).first()
    out = []
    for n in range(len(weights)):
        w = r[f"w{n}"] or 0.0
        if w <= 0:
            out.append((0.0, None, None))
            continue
        mean = np.array([r[f"m{n}_{i}"] / w for i in range(len(bands))])
        cov = np.zeros((len(bands), len(bands)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{n}_{i}_{j}"] / w - mean[i] * mean[j]
        out.append((w, mean, cov))
    return out


def _metric(cov, kind: str):
    """The distance matrix of a class: Euclidean, or Mahalanobis with unit determinant; nearly singular covariances are conditioned."""
    import numpy as np

    n = len(cov)
    if kind == "euclidean":
        return np.eye(n)
    values, axes = np.linalg.eigh(cov)
    values = np.maximum(values, max(values.max(), 1e-30) / 1e10)
    return np.exp(np.log(values).mean()) * (axes / values) @ axes.T


def start_centres(cells: DataFrame, bands: Sequence[str], k: int) -> list[list[float]]:
    """Centres at equal steps from the least to the greatest value of each band."""
    r = cells.agg(*[f(b).alias(f"{n}{i}") for i, b in enumerate(bands) for n, f in (("a", F.min), ("b", F.max))]).first()
    return [[r[f"a{i}"] + (r[f"b{i}"] - r[f"a{i}"]) * (n + 0.5) / k for i in range(len(bands))] for n in range(k)]


def crisp_means(cells: DataFrame, bands: Sequence[str], k: int, metric: str = "euclidean", rounds: int = 50, threshold: float = 0.01, centres=None) -> DataFrame:
    """Cells with the ``label`` of the nearest centre, by Lloyd's rounds of one aggregate each.

    Ends when the sum of distances falls by less than ``threshold`` percent, or
    rises (then the round before counts). An empty class takes the farthest cell. No
    cells give no rows.
    """
    if cells.dropna(subset=list(bands)).isEmpty():
        return _none(cells, label="int")
    data = cells.dropna(subset=list(bands)).select("*", *[F.col(b).cast("double").alias(f"_b{i}") for i, b in enumerate(bands)])
    own = [f"_b{i}" for i in range(len(bands))]
    centres = centres or start_centres(data, own, k)
    shape, best, last = [_metric([[1.0 if i == j else 0.0 for j in own] for i in own], "euclidean")] * k, None, float("inf")
    for _ in range(rounds):
        d = F.array(*_distances(own, centres, shape))
        near = data.withColumn("_d", F.array_min(d)).withColumn("_k", F.array_position(d, F.col("_d")).cast("int"))
        total, far = near.agg(F.sum("_d").alias("t"), F.max_by(F.array(*own), "_d").alias("f")).first()
        if total is None or total > last:
            break
        best, gain, last = (centres, shape), (last - total) / last * 100 if last not in (0.0, float("inf")) else float("inf"), total
        if gain < threshold:
            break
        found = _moments(near, own, [F.when(F.col("_k") == n + 1, 1.0).otherwise(0.0) for n in range(k)])
        centres = [m.tolist() if m is not None else list(far) for _, m, _ in found]
        shape = [_metric(c, metric) if c is not None else shape[n] for n, (_, _, c) in enumerate(found)]
    d = F.array(*_distances(own, *best)) if best else F.array(F.lit(0.0))
    return data.withColumn("label", F.array_position(d, F.array_min(d)).cast("int")).drop(*own)


def fuzzy_means(cells: DataFrame, bands: Sequence[str], k: int, exponent: float = 2.0, metric: str = "euclidean", rounds: int = 50, threshold: float = 0.01, centres=None) -> DataFrame:
    """Cells with memberships u1..uk (d^(-1/(m-1)) over their sum, of squared distances), the ``label`` of the greatest, and ``entropy``, their normalised class entropy. No cells give no rows."""
    if cells.dropna(subset=list(bands)).isEmpty():
        return _none(cells, **{f"u{n + 1}": "double" for n in range(k)}, label="int", entropy="double")
    data = cells.dropna(subset=list(bands)).select("*", *[F.col(b).cast("double").alias(f"_b{i}") for i, b in enumerate(bands)])
    own = [f"_b{i}" for i in range(len(bands))]
    centres = centres or start_centres(data, own, k)
    shape, last, best = [_metric([[1.0 if i == j else 0.0 for j in own] for i in own], "euclidean")] * k, float("inf"), None

    def members(centres, shape) -> DataFrame:
        d = data.withColumn("_d", F.array(*[F.greatest(x, F.lit(1e-10)) for x in _distances(own, centres, shape)]))
        p = F.transform("_d", lambda x: F.pow(x, F.lit(-1.0 / (exponent - 1))))
        d = d.withColumn("_p", p).withColumn("_s", F.aggregate("_p", F.lit(0.0), lambda a, x: a + x))
        return d.select("*", *[(F.col("_p")[n] / F.col("_s")).alias(f"u{n + 1}") for n in range(k)])

    for _ in range(rounds):
        now = members(centres, shape)
        objective = now.agg(F.sum(sum((F.pow(f"u{n + 1}", F.lit(exponent)) * F.col("_d")[n] for n in range(k)), F.lit(0.0)))).first()[0]
        if objective is None or objective > last:
            break
        best, gain, last = (centres, shape), (last - objective) / last * 100 if last not in (0.0, float("inf")) else float("inf"), objective
        if gain < threshold:
            break
        found = _moments(now, own, [F.pow(f"u{n + 1}", F.lit(exponent)) for n in range(k)])
        centres = [m.tolist() for _, m, _ in found]
        shape = [_metric(c, metric) for _, _, c in found]
    out = members(*(best or (centres, shape)))
    u = F.array(*[f"u{n + 1}" for n in range(k)])
    entropy = -F.aggregate(u, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0)) / F.ln(F.lit(float(k)))
    return out.withColumns({"label": F.array_position(u, F.array_max(u)).cast("int"), "entropy": entropy}).drop("_d", "_p", "_s", *own)


def compactness(members: DataFrame, bands: Sequence[str], k: int, exponent: float = 2.0) -> DataFrame:
    """The Xie-Beni index of memberships u1..uk (distances within over the least squared distance of two centres) and the mean class entropy; no row without members."""
    if members.isEmpty():
        return members.select(F.lit(0.0).alias("xie_beni"), F.lit(0.0).alias("class_entropy")).where("false")
    found = _moments(members, list(bands), [F.pow(f"u{n + 1}", F.lit(exponent)) for n in range(k)])
    centres = [m for _, m, _ in found]
    apart = min(float(((a - b) ** 2).sum()) for i, a in enumerate(centres) for b in centres[:i])
    unit = [[[1.0 if i == j else 0.0 for j in bands] for i in bands]] * k
    within = sum((F.pow(f"u{n + 1}", F.lit(exponent)) * d for n, d in enumerate(_distances(bands, centres, unit))), F.lit(0.0))
    return members.agg((F.sum(within) / (F.count(F.lit(1)) * apart)).alias("xie_beni"), F.avg("entropy").alias("class_entropy"))


def classify(known: DataFrame, cells: DataFrame, bands: Sequence[str], label: str, method: str = "forest", seed: int = 1) -> DataFrame:
    """``cells`` with ``found``, by a classifier of ``known``: a decision tree, a random forest or linear support vectors, one class against the rest."""
    from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    names = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(known.dropna(subset=[label]))
    vector = VectorAssembler(inputCols=list(bands), outputCol="features", handleInvalid="skip")
    common = {"labelCol": "_y", "featuresCol": "features", "predictionCol": "_p"}
    model = {"tree": lambda: DecisionTreeClassifier(seed=seed, **common), "forest": lambda: RandomForestClassifier(seed=seed, numTrees=50, **common), "vectors": lambda: OneVsRest(classifier=LinearSVC(maxIter=50), parallelism=TOGETHER, **common)}[method]()
    fitted = model.fit(vector.transform(names.transform(known.dropna(subset=[label]))).select("_y", "features"))
    if method == "vectors":  # each class's plane is a column, where the model's own transform calls a function a row and class
        scores = F.array(*[sum((F.col(b).cast("double") * float(w) for b, w in zip(bands, m.coefficients, strict=True)), F.lit(float(m.intercept))) for m in fitted.models])
        best = F.array_position(scores, F.array_max(scores)).cast("int")
        return cells.dropna(subset=list(bands)).withColumn("found", F.element_at(F.array(*map(F.lit, names.labels)), best))
    out = fitted.transform(vector.transform(cells))
    return out.withColumn("found", F.element_at(F.array(*map(F.lit, names.labels)), F.col("_p").cast("int") + 1)).drop("features", "_p", "rawPrediction", "probability")


def covariance_of(cells: DataFrame, bands: Sequence[str]):
    """Mean vector and sample covariance matrix, from one aggregate."""
    import numpy as np

    rows = {(r.a, r.b): r.value for r in stats.pair_table(cells, bands, "cov").collect()}
    mean = cells.dropna(subset=list(bands)).agg(*[F.avg(b) for b in bands]).first()
    return np.array(mean, float), np.array([[rows.get((a, b), rows.get((b, a))) for b in bands] for a in bands], float)


def _axes(cov):
    """Eigenvalues in falling order and their axes as rows, each with its largest part positive."""
    import numpy as np

    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    axes = axes[:, order].T
    return values[order], axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]


def project(cells: DataFrame, bands: Sequence[str], mean, axes, prefix: str) -> DataFrame:
    """New columns prefix1.. with the cells' places on the axes."""
    new = {f"{prefix}{n + 1}": sum((F.lit(float(w)) * (F.col(b) - float(m)) for b, w, m in zip(bands, axis, mean, strict=True)), F.lit(0.0)) for n, axis in enumerate(axes)}
    return cells.dropna(subset=list(bands)).withColumns(new)


def principal_components(cells: DataFrame, bands: Sequence[str], n: int | None = None) -> tuple[DataFrame, list[float]]:
    """Cells with pc1.., and the share of the variance that each explains."""
    mean, cov = covariance_of(cells, bands)
    values, axes = _axes(cov)
    return project(cells, bands, mean, axes[: n or len(bands)], "pc"), (values / values.sum()).tolist()


def reconstruct(components: DataFrame, cells: DataFrame, bands: Sequence[str], n: int) -> DataFrame:
    """Bands rebuilt from the first n components of :func:`principal_components` of ``cells``."""
    mean, cov = covariance_of(cells, bands)
    _, axes = _axes(cov)
    return components.withColumns({b: sum((F.lit(float(axes[k][i])) * F.col(f"pc{k + 1}") for k in range(n)), F.lit(float(mean[i]))) for i, b in enumerate(bands)})


def noise_fractions(cells: DataFrame, bands: Sequence[str], n: int | None = None, keys: Sequence[str] = ()) -> tuple[DataFrame, list[float]]:
    """Cells (row, col, bands) with mnf1..: components by their signal over the noise, which the differences of diagonal neighbours show; and these ratios.

    ``keys`` (scene) part rasters in one table; neighbours are of one raster.
    """
    import numpy as np

    other = cells.select(*keys, (F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), *[F.col(b).alias(f"_{b}") for b in bands])
    steps = cells.join(other, [*keys, "row", "col"]).select(*[((F.col(b) - F.col(f"_{b}")) / 2**0.5).alias(b) for b in bands])
    mean, cov = covariance_of(cells, bands)
    noise_values, noise_axes = _axes(covariance_of(steps, bands)[1])
    whiten = noise_axes / np.sqrt(np.maximum(noise_values, 1e-12 * noise_values.max()))[:, None]
    values, axes = _axes(whiten @ cov @ whiten.T)
    return project(cells, bands, mean, (axes @ whiten)[: n or len(bands)], "mnf"), values.tolist()
