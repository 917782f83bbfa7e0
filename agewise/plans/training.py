"""Forest training, cross-validation, tuning and the training run.

Preprocessing (median imputation, population scaling, balanced weights) is learnt on the training part
of every fold.  Cross-validation and the search work on *prepared folds*: each fold is imputed, scaled
and weighed once and checkpointed, and the draws fit forests alone, so the number of preprocessing jobs
does not depend on the draws.  The forest is Spark ML's ``RandomForestClassifier`` (distributed tree
induction); differences from the original library are parameters Spark does not have: no
minimum-samples-to-split (dropped), depth capped at 30 where the original allows unlimited depth, and
binned split candidates (``maxBins``).
"""

from __future__ import annotations

import itertools
import json
import os
import random
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as FX
from ..operators.prep import BalancedWeights, MedianImputer, PopulationScaler
from ..session import checkpoint_dir, materialize
from .grown_forest import WHOLE_ROWS, GrownForest, bin_table, cross_votes, fit_grown

#: Bytes of features that a task of a fit reads from a prepared fold.
FOLD_TASK_BYTES = 16 << 20
#: From so many bytes of features on, a forest is fitted in so many parts, whose trees add up.
PART_BYTES, PARTS = 2 << 20, 24
#: From so many bytes on its trees are grown next to their rows and are a table (:mod:`.grown_forest`).
GROWN_BYTES = 4 << 20
#: From so many fits on, the forests of a cross-validation or search of any size are grown and scored in one step.
SEARCH_FITS = 24
MAX_DEPTH_CAP = 30  # Spark's limit; stands in for "unlimited"


@dataclass(frozen=True)
class ForestConfig:
    # defaults: the original three-tier model (agewise.fixed.FOREST), with
    # balanced class weights and impute + scale
    n_trees: int = FX.FOREST["n_trees"]
    max_depth: int | None = FX.FOREST["max_depth"]
    min_leaf: int = FX.FOREST["min_leaf"]
    max_features: str = FX.FOREST["max_features"]
    seed: int = FX.SEED
    scale: bool = True
    balanced: bool = True
    bootstrap: bool = True
    max_bins: int = 32
    # histogram budget per task (Spark's default): every concurrent task may
    # hold this much, so raise it only where executors have the heap for it
    # (on sf0.1, 1024 instead of 256 fitted 500 trees in 19 s instead of 26 s)
    max_memory_mb: int = 256


# the original random search grid (min-split axis dropped) and binary model
TUNING_GRID = FX.TUNING_GRID
BINARY_FOREST = ForestConfig(**FX.BINARY_FOREST, scale=False)


def _depth(d):
    return MAX_DEPTH_CAP if d is None else min(int(d), MAX_DEPTH_CAP)


def preprocessing(features: list[str], label: str, cfg: ForestConfig) -> list:
    """Impute -> (scale) -> (balanced weights) -> assemble: all that is learnt before the forest."""
    imputed = [f"_imp_{i}" for i in range(len(features))]
    stages = [MedianImputer(inputCols=list(features), outputCols=imputed)]
    cols = imputed
    if cfg.scale:
        scaled = [f"_std_{i}" for i in range(len(features))]
        stages.append(PopulationScaler(inputCols=imputed, outputCols=scaled))
        cols = scaled
    if cfg.balanced:
        stages.append(BalancedWeights(labelCol=label, weightCol="_weight"))
    return [*stages, VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="keep")]


def forest(label: str, cfg: ForestConfig) -> RandomForestClassifier:
    """The forest alone, over assembled features (and weights)."""
    rf = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=cfg.n_trees,
                                maxDepth=_depth(cfg.max_depth), minInstancesPerNode=cfg.min_leaf,
                                featureSubsetStrategy=cfg.max_features, seed=cfg.seed, maxBins=cfg.max_bins,
                                maxMemoryInMB=cfg.max_memory_mb, bootstrap=cfg.bootstrap,
                                # node ids cached between levels: no re-descent of the trees per pass
                                cacheNodeIds=True)
    return rf.setWeightCol("_weight") if cfg.balanced else rf


def forest_pipeline(features: list[str], label: str, cfg: ForestConfig) -> Pipeline:
    """M5: impute -> (scale) -> (balanced weights) -> assemble -> random forest."""
    return Pipeline(stages=[*preprocessing(features, label, cfg), Forest(label, cfg)])


def forest_stage(model: PipelineModel):
    return model.stages[-1]


def forest_parts(stage) -> list:
    """The random forests whose trees make up a fitted forest."""
    return stage.stages[:-1] if isinstance(stage, PipelineModel) else [stage]


class Votes(Model, DefaultParamsReadable, DefaultParamsWritable):
    """The outcome of a forest fitted in parts: their trees' votes added up, as one forest adds its trees'."""

    parts = Param(Params._dummy(), "parts", "number of parts", typeConverter=TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, parts=None, classes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        n, k = self.getOrDefault(self.parts), self.getOrDefault(self.classes)
        df = df.withColumns({f"_votes_{i}": vector_to_array(f"_votes_{i}") for i in range(n)})
        df = df.withColumn("_votes", F.array(*[sum((F.col(f"_votes_{i}")[c] for i in range(1, n)), F.col("_votes_0")[c]) for c in range(k)]))
        total = sum((F.col("_votes")[c] for c in range(1, k)), F.col("_votes")[0])
        return df.withColumns({
            "rawPrediction": array_to_vector("_votes"), "probability": array_to_vector(F.transform("_votes", lambda v: v / total)),
            "prediction": (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double"),
        }).drop("_votes", *[f"_votes_{i}" for i in range(n)])


class Forest(Estimator):
    """A random forest over assembled features.

    Spark's trees are grown from histograms of all nodes of a pass, which every partition of the rows makes in full
    and sends; so a fit costs less the fewer partitions it has, and uses no more cores than partitions.  On more
    than ``PART_BYTES`` of features the rows go to few partitions, and the trees are dealt to ``PARTS`` forests of
    other seeds, which are fitted next to one another and vote together (:class:`Votes`).  Spark also holds all nodes
    on the driver; on more than ``GROWN_BYTES`` the trees are a table instead (:class:`.grown_forest.GrownForest`)."""

    def __init__(self, label: str, cfg: ForestConfig):
        super().__init__()
        self.label, self.cfg = label, cfg

    def _fit(self, df: DataFrame):
        cfg, columns = self.cfg, [self.label, "_features", *["_weight"] * self.cfg.balanced]
        rows = materialize(df.select(*columns))  # a fit passes over it many times
        size = feature_bytes(rows)
        if size <= PART_BYTES or cfg.n_trees < PARTS:
            return forest(self.label, cfg).fit(rows)
        if size > GROWN_BYTES:
            return fit_grown(bin_table(rows, self.label, cfg.balanced, cfg.max_bins), cfg)
        rows = rows.coalesce(max(1, -(-size // FOLD_TASK_BYTES)))
        with ThreadPoolExecutor(rows.sparkSession.sparkContext.defaultParallelism) as pool:
            return fit_parts(rows, self.label, cfg, pool)


def feature_bytes(rows: DataFrame) -> int:
    """Bytes of the assembled features, label and weight of a table, as doubles."""
    first = rows.select("_features").first()
    return 0 if first is None else rows.count() * 8 * (len(first[0]) + 2)


def fit_parts(rows: DataFrame, label: str, cfg: ForestConfig, pool) -> PipelineModel:
    """The forest's trees in ``PARTS`` forests, fitted in the pool."""
    share = [cfg.n_trees // PARTS + (i < cfg.n_trees % PARTS) for i in range(PARTS)]
    seeds = random.Random(cfg.seed)
    configs = [replace(cfg, n_trees=n, seed=seeds.randrange(1 << 31)) for n in share]
    parts = list(pool.map(lambda c: forest(label, c).fit(rows), configs))
    for i, part in enumerate(parts):
        part.setRawPredictionCol(f"_votes_{i}").setProbabilityCol("").setPredictionCol("")
    return PipelineModel(stages=[*parts, Votes(parts=PARTS, classes=parts[0].numClasses)])


def evaluator(label: str, metric: str = "f1") -> MulticlassClassificationEvaluator:
    """Spark's "f1" is the support-weighted F1."""
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)


def prepared_folds(df: DataFrame, features: list[str], label: str, fold_col: str, cfg: ForestConfig, k: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """Of every fold the other folds' rows and its own, as a forest reads them: preprocessing learnt on the
    former, applied to both, checkpointed."""
    keep = [F.col(label).cast("double").alias(label), "_features", *["_weight"] * cfg.balanced]
    out = []
    for f in range(k):
        model = Pipeline(stages=preprocessing(features, label, cfg)).fit(df.filter(F.col(fold_col) != f))
        ready = materialize(model.transform(df).select((F.col(fold_col) == f).alias("_held"), *keep))
        tasks = -(-ready.count() * 8 * (len(features) + 2) // FOLD_TASK_BYTES)  # every fit passes over it many times
        ready = ready.coalesce(max(1, tasks))
        out.append((ready.filter(~F.col("_held")), ready.filter("_held")))
    return out


def weighted_f1(counts: dict) -> float:
    """Spark's "f1" from rows by (label, prediction): every label's F1 (0 where undefined) by its share of the rows."""
    total, score = sum(counts.values()), 0.0
    for c in {label for label, _ in counts}:
        true, support = counts.get((c, c), 0), sum(n for (label, _), n in counts.items() if label == c)
        said = sum(n for (_, pred), n in counts.items() if pred == c)
        precision, recall = true / said if said else 0.0, true / support
        score += (2 * precision * recall / (precision + recall) if true else 0.0) * support / total
    return score


def _scored_where_grown(rows: list[int], sizes: list[int], configs: list[ForestConfig]) -> bool:
    """Whether forests are grown and scored in one step (:func:`.grown_forest.cross_votes`): those of large folds, as
    far as a task can hold a fold's rows, and those of a search, whose draws then share their trees."""
    return (min(c.n_trees for c in configs) >= PARTS and 0 < min(rows) and max(rows) <= WHOLE_ROWS
            and (min(sizes) > GROWN_BYTES or len(configs) * len(sizes) > SEARCH_FITS))


def _fold_scores(folds: list, label: str, configs: list[ForestConfig], parallelism: int) -> list[list[float]]:
    """Weighted F1 of every configuration on every fold; the fits are independent jobs, ``parallelism`` at a time."""
    sizes = [feature_bytes(train) for train, _ in folds]
    if _scored_where_grown([train.count() for train, _ in folds], sizes, configs):
        binned = [(bin_table(train, label, configs[0].balanced, configs[0].max_bins), held) for train, held in folds]
        counts = cross_votes(binned, label, configs)
        return [[weighted_f1(counts[f, i]) for f in range(len(folds))] for i in range(len(configs))]
    ev = evaluator(label)
    cores = folds[0][0].sparkSession.sparkContext.defaultParallelism
    same = configs[0]  # binned once a fold: bins and weights are the same in all configurations
    binned = [bin_table(train, label, same.balanced, same.max_bins) if size > GROWN_BYTES else None
              for (train, _), size in zip(folds, sizes, strict=True)]

    def one(task) -> float:
        cfg, (train, held), size, table = task
        if size <= PART_BYTES or cfg.n_trees < PARTS:
            model = forest(label, cfg).fit(train)
        elif table is None:
            model = fit_parts(train, label, cfg, shared)
        else:
            model = fit_grown(table, cfg, -(-2 * cores // max(1, parallelism)))
        return ev.evaluate(model.transform(held))

    # a few forests at a time, each in parts: what is fitted at once fills the cores, and few forests are held
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool, ThreadPoolExecutor(max(parallelism, cores)) as shared:
        scores = list(pool.map(one, [(cfg, *fold) for cfg in configs for fold in zip(folds, sizes, binned, strict=True)]))
    return [scores[i:i + len(folds)] for i in range(0, len(scores), len(folds))]


def cv_scores(df: DataFrame, features: list[str], label: str, fold_col: str, cfg: ForestConfig,
              k: int = 5, parallelism: int = 4, folds: list | None = None) -> DataFrame:
    """M6: weighted F1 of every fold (fit on the other folds), with mean and population std as extra rows
    ``fold = -1`` / ``-2``.  ``folds``: the prepared folds, where they are at hand."""
    folds = folds or prepared_folds(df, features, label, fold_col, cfg, k)
    scores = _fold_scores(folds, label, [cfg], parallelism)[0]
    mean = sum(scores) / k
    std = (sum((s - mean) ** 2 for s in scores) / k) ** 0.5
    rows = [(i, s) for i, s in enumerate(scores)] + [(-1, mean), (-2, std)]
    return df.sparkSession.createDataFrame(rows, "fold int, f1_weighted double")


def sample_grid(n_iter: int, seed: int = 42, grid: dict | None = None) -> list[dict]:
    """M7: ``n_iter`` distinct combinations drawn without replacement."""
    grid = grid or TUNING_GRID
    keys = list(grid)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    return random.Random(seed).sample(combos, min(n_iter, len(combos)))


def random_search(df: DataFrame, features: list[str], label: str, fold_col: str, base: ForestConfig,
                  n_iter: int = FX.SEARCH_DRAWS, seed: int = FX.SEED, k: int = FX.FOLDS, parallelism: int = 4,
                  grid: dict | None = None, folds: list | None = None):
    """M7: cross-validated random search; returns (results DataFrame, best
    config, best PipelineModel refit on all rows)."""
    draws = sample_grid(n_iter, seed, grid)
    folds = folds or prepared_folds(df, features, label, fold_col, base, k)
    configs = [replace(base, **d) for d in draws]
    metrics = [sum(scores) / k for scores in _fold_scores(folds, label, configs, parallelism)]
    best_i = max(range(len(metrics)), key=lambda i: (metrics[i], -i))
    rows = [(i, d["n_trees"], d["max_depth"], d["min_leaf"], d["max_features"], float(m), i == best_i)
            for i, (d, m) in enumerate(zip(draws, metrics))]
    res = df.sparkSession.createDataFrame(rows, "draw int, n_trees int, max_depth int, min_leaf int, "
                                                "max_features string, mean_f1 double, best boolean")
    best = configs[best_i]
    return res, best, forest_pipeline(features, label, best).fit(df)


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """M9 (forest): impurity importances of the fitted forest, one row per feature."""
    spark = SparkSession.getActiveSession()
    if isinstance(forest_stage(model), GrownForest):
        return spark.createDataFrame(list(zip(features, forest_stage(model).importances())), "feature string, importance double")
    parts = forest_parts(forest_stage(model))
    vals = parts[0].featureImportances.toArray()
    if len(parts) > 1:  # every tree with a split counts the same
        grown = [sum(t.numNodes > 1 for t in part.trees) for part in parts]
        vals = sum(n * part.featureImportances.toArray() for n, part in zip(grown, parts, strict=True)) / max(1, sum(grown))
    vals = vals.tolist()
    return spark.createDataFrame(list(zip(features, [float(v) for v in vals])), "feature string, importance double")


def model_path(spark: SparkSession, name: str) -> str:
    """A folder for the versions of a model, under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "models", f"{name}-{uuid.uuid4().hex[:12]}")


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's file system layer has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def model_versions(path: str) -> list[str]:
    """Versions that are complete, oldest first: those whose manifest has been written to the end."""
    spark = SparkSession.getActiveSession()
    done = [v for v in _children(spark, os.path.join(path, "manifests"))
            if "_SUCCESS" in _children(spark, os.path.join(path, "manifests", v))]
    return [v for v in done if v in _children(spark, os.path.join(path, "versions"))]


def save_model(model: PipelineModel, path: str, features: list[str], metadata: dict, keep: int = 2) -> str:
    """A new version of the model under ``path``; returns its name.

    The pipeline is written first.  The manifest (feature order, run facts, ``saved_at``) comes last and makes the
    version visible; a version that was interrupted has none and is never read.  Versions, complete or not, that
    are older than the newest ``keep`` complete ones are removed."""
    spark = SparkSession.getActiveSession()
    now = datetime.now(timezone.utc)
    version = f"{now.strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:6]}"
    model.write().save(os.path.join(path, "versions", version))
    meta = dict(metadata, feature_columns=list(features), saved_at=now.isoformat())
    spark.createDataFrame([(json.dumps(meta, default=str),)], "metadata string").coalesce(1) \
        .write.text(os.path.join(path, "manifests", version))
    oldest = model_versions(path)[-keep:][0]
    for part in ("manifests", "versions"):  # the manifest goes first, so a version without it is never half there
        for v in _children(spark, os.path.join(path, part)):
            if v < oldest:
                fs, p = _hadoop(spark, os.path.join(path, part, v))
                fs.delete(p, True)
    return version


def load_model(path: str, version: str | None = None) -> tuple[PipelineModel, dict]:
    """The newest complete version (or the one asked for) with its manifest."""
    spark = SparkSession.getActiveSession()
    there = model_versions(path)
    if not there or version is not None and version not in there:
        raise FileNotFoundError(f"no complete model version{'' if version is None else ' ' + version} under {path}")
    version = version or there[-1]
    meta = json.loads(spark.read.text(os.path.join(path, "manifests", version)).first()[0])
    return PipelineModel.load(os.path.join(path, "versions", version)), meta


def config_dict(cfg: ForestConfig) -> dict:
    return asdict(cfg)
