"""Classification results: confusion, scores, seeds, best epochs and overlaps of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, classes: list, true: str = "true", pred: str = "pred") -> DataFrame:
    """(true, pred, n) for all pairs of classes, zeros kept."""
    spark = predictions.sparkSession
    kind = predictions.schema[true].dataType.simpleString()
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], f"true {kind}, pred {kind}")
    counts = predictions.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def accuracy(predictions: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return predictions.agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def class_scores(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1 by class of a confusion table, 0 on empty denominators."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    hits = F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0))
    by_true = cells.groupBy(F.col("true").alias("class")).agg(F.sum("n").alias("support"), hits.alias("tp"))
    by_pred = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    rows = by_true.join(by_pred, "class").withColumns({"precision": rate("tp", "predicted"), "recall": rate("tp", "support")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rows.select("class", "support", "precision", "recall", f1.alias("f1"))


def macro_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def weighted_loss(rows: DataFrame, by: list[str], batch: str = "batch", loss: str = "loss") -> DataFrame:
    """Mean of batch means, each weighted by its batch's size."""
    sized = rows.groupBy(*by, batch).agg(F.avg(loss).alias("_m"), F.count(loss).alias("_n"))
    return sized.groupBy(*by).agg((F.sum(F.col("_m") * F.col("_n")) / F.sum("_n")).alias("loss"), F.sum("_n").alias("n"))


def batch_mean_loss(rows: DataFrame, by: list[str], batch: str = "batch", loss: str = "loss") -> DataFrame:
    """Mean of batch means."""
    return rows.groupBy(*by, batch).agg(F.avg(loss).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("loss"))


def seed_summary(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation over seeds, 0 for a single run."""
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), *(a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_std"))))


def seed_runs(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Each run's values beside the mean and sample deviation over its seeds."""
    over = Window.partitionBy(*by)
    return runs.select(*runs.columns, *(a for v in values for a in (F.avg(v).over(over).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v).over(over), F.lit(0.0)).alias(f"{v}_std"))))


def best_epochs(history: DataFrame, rules: dict[str, str], by: str = "run") -> DataFrame:
    """Best epochs by validation accuracy, one column a rule; on ties the ``first``, the ``last``, or the one of the lower loss (``loss``), then the first."""
    back = (-F.col("epoch")).alias("b")
    keys = {"first": [back], "last": [F.col("epoch").alias("e")], "loss": [(-F.col("validation_loss")).alias("l"), back]}
    return history.groupBy(by).agg(*(F.max_by("epoch", F.struct("validation_accuracy", *keys[rule])).alias(name) for name, rule in rules.items()))


def best_epoch(history: DataFrame, rule: str = "first", by: str = "run") -> DataFrame:
    return best_epochs(history, {"best_epoch": rule}, by)


def errors(predictions: DataFrame) -> DataFrame:
    """(model, sample_id) of wrong predictions."""
    return predictions.filter(F.col("true") != F.col("pred")).select("model", "sample_id").distinct()


def error_masks(predictions: DataFrame, models: list[str]) -> DataFrame:
    """(sample_id, mask): one row a sample that a model gets wrong, its wrong models as bits in sorted order; at most 63 models.

    One shuffle, after a partial union of bits; every overlap below comes from this table.
    """
    if len(models) > 63:
        raise ValueError("a mask holds 63 models")
    wrong = predictions.filter(F.col("true") != F.col("pred")).select("sample_id", "model")
    return _masks(wrong, models)


def _masks(wrong: DataFrame, models: list[str]) -> DataFrame:
    bits = F.create_map(*(x for i, m in enumerate(sorted(models)) for x in (F.lit(m), F.lit(1 << i).cast("long"))))
    return wrong.groupBy("sample_id").agg(F.bit_or(F.try_element_at(bits, F.col("model"))).alias("mask")).filter("mask is not null")


def mask_jaccard(masks: DataFrame, models: list[str]) -> DataFrame:
    """Sizes of intersection and union and their ratio for each pair of models, 1 where both have no errors.

    Samples are counted by mask; the pairs come from the masks that occur.
    """
    ordered = sorted(models)
    pairs = [(i, j) for i in range(len(ordered)) for j in range(i + 1, len(ordered))]
    has = lambda i: F.getbit("mask", F.lit(i)) == 1
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    cells = [F.struct(F.lit(ordered[i]).alias("left"), F.lit(ordered[j]).alias("right"), count(has(i) & has(j)).alias("intersection"), count(has(i) | has(j)).alias("union")) for i, j in pairs]
    rows = masks.agg(F.array(*cells).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*") if cells else masks.sparkSession.createDataFrame([], "left string, right string, intersection long, union long")
    return rows.withColumn("jaccard", F.when(F.col("union") == 0, 1.0).otherwise(F.col("intersection") / F.col("union")))


def mask_common(masks: DataFrame, models: list[str]) -> DataFrame:
    """Samples that every model gets wrong."""
    return masks.filter(F.col("mask") == (1 << len(models)) - 1).select("sample_id")


def mask_unique(masks: DataFrame, models: list[str]) -> DataFrame:
    """(model, sample_id) that only one model gets wrong."""
    names = F.array(*map(F.lit, sorted(models)))
    return masks.filter(F.bit_count("mask") == 1).select(F.element_at(names, F.round(F.log2("mask")).cast("int") + 1).alias("model"), "sample_id")


def mask_counts(masks: DataFrame, models: list[str]) -> DataFrame:
    """(models, n): how many samples just these models get wrong."""
    names = F.array(*map(F.lit, sorted(models)))
    of = F.filter(names, lambda x, i: F.getbit("mask", i) == 1)
    return masks.groupBy("mask").agg(F.count("*").alias("n")).select(F.array_join(of, ",").alias("models"), "n")


def error_jaccard(wrong: DataFrame, models: list[str]) -> DataFrame:
    """``mask_jaccard`` of (model, sample_id) rows."""
    return mask_jaccard(_masks(wrong, models), models)


def common_errors(wrong: DataFrame, n_models: int) -> DataFrame:
    """Samples that every one of ``n_models`` models gets wrong, from (model, sample_id) rows."""
    return wrong.groupBy("sample_id").agg(F.countDistinct("model").alias("_n")).filter(F.col("_n") == n_models).select("sample_id")


def unique_errors(wrong: DataFrame) -> DataFrame:
    """(model, sample_id) that only one model gets wrong."""
    return wrong.groupBy("sample_id").agg(F.count("*").alias("_n"), F.min("model").alias("model")).filter("_n = 1").select("model", "sample_id")


def error_records(predictions: DataFrame) -> DataFrame:
    """Per sample with an error: the true label and each model's prediction."""
    rows = predictions.groupBy("sample_id", "true").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "pred")))).alias("predictions"), F.sum((F.col("true") != F.col("pred")).cast("int")).alias("_wrong"))
    return rows.filter("_wrong > 0").drop("_wrong")
