"""Scores of classifier runs.  Every job reduces the predictions map-side first."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.ranking import percentiles, values_at_ranks
from veilspark.session import broadcast_if_small, write_through
from veilspark.operators.verdict import LABELS

Z95 = 1.96  # fixed value
# Severity of letting a document through, from open to closed.  Errors towards
# `classify_safe` leak; errors away from it cost convenience.
OPEN_LABEL = "classify_safe"


def _label_rows(like: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """One row per label: the fixed label list, a handful of values."""
    return like.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(name))


def pair_counts(predictions: DataFrame) -> DataFrame:
    """(expected, predicted, n)."""
    return predictions.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Counts with one row per expected and one column per predicted label, zeros shown."""
    counts = (
        predictions.where(F.col("expected").isin(*labels) & F.col("predicted").isin(*labels))
        .groupBy("expected")
        .agg(*[F.count(F.when(F.col("predicted") == x, 1)).alias(x) for x in labels])
    )
    return (
        _label_rows(predictions, labels, "expected")
        .join(counts, "expected", "left")
        .select("expected", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in labels])
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def class_report(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(label, precision, recall, f1, support); 0 where a denominator is 0.

    A prediction off the label list is a miss of its expected class only.
    """
    counts = pair_counts(predictions)
    right = F.col("expected") == F.col("predicted")
    per_label = (
        counts.select(
            F.explode(
                F.array(
                    F.struct(
                        F.col("expected").alias("label"),
                        F.when(right, F.col("n")).otherwise(0).alias("tp"),
                        F.lit(0).cast("long").alias("fp"),
                        F.when(right, 0).otherwise(F.col("n")).alias("fn"),
                    ),
                    F.struct(
                        F.col("predicted").alias("label"),
                        F.lit(0).cast("long").alias("tp"),
                        F.when(right, 0).otherwise(F.col("n")).alias("fp"),
                        F.lit(0).cast("long").alias("fn"),
                    ),
                )
            ).alias("c")
        )
        .groupBy("c.label")
        .agg(*[F.sum(f"c.{x}").cast("long").alias(x) for x in ("tp", "fp", "fn")])
    )
    tp, fp, fn = (F.coalesce(F.col(x), F.lit(0)) for x in ("tp", "fp", "fn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return (
        _label_rows(predictions, labels, "label")
        .join(per_label, "label", "left")
        .select("label", p.alias("precision"), r.alias("recall"), (tp + fn).cast("long").alias("support"))
        .withColumn(
            "f1",
            _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
        .select("label", "precision", "recall", "f1", "support")
    )


def overall_metrics(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row: n, correct, accuracy, macro averages and support-weighted averages."""
    right = F.col("expected") == F.col("predicted")
    totals = pair_counts(predictions).select("n", F.when(right, F.col("n")).otherwise(0).alias("correct"))
    scores = class_report(predictions, labels)
    weight = F.sum("support").cast("double")

    def weighted(name: str) -> Column:
        return _ratio(F.sum(F.col(name) * F.col("support")), weight)

    # A label's row has no counts and a count's row has no scores; nulls are not averaged.
    return (
        scores.unionByName(totals, allowMissingColumns=True)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
            F.coalesce(F.sum("correct"), F.lit(0)).cast("long").alias("correct"),
            F.avg("f1").alias("macro_f1"),
            F.avg("precision").alias("macro_precision"),
            F.avg("recall").alias("macro_recall"),
            weighted("f1").alias("weighted_f1"),
            weighted("precision").alias("weighted_precision"),
            weighted("recall").alias("weighted_recall"),
        )
        .withColumn("accuracy", _ratio(F.col("correct"), F.col("n")))
    )


def latency_percentiles(
    calls: DataFrame, group: Sequence[str], value: str = "latency_ms", order: str = "call_id"
) -> DataFrame:
    """Cold first call and exact p50, p95, p99 of the later ones, by linear interpolation."""
    group = list(group)
    cold = calls.groupBy(*group).agg(
        F.min(order).alias("_first"), F.min_by(value, order).alias("cold_ms")
    )
    cold = write_through(calls.sparkSession, cold, "cold")
    warm = calls.join(broadcast_if_small(cold.select(*group, "_first")), group).where(F.col(order) > F.col("_first"))
    found = percentiles(warm, group, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return cold.join(found, group, "left").select(
        *group, "cold_ms", F.coalesce("n", F.lit(0)).alias("warm_calls"),
        *[F.coalesce(p, F.lit(0.0)).alias(p) for p in ("p50", "p95", "p99")],
    )


def latency_nearest_rank(calls: DataFrame, group: Sequence[str], value: str = "latency_ms") -> DataFrame:
    """Median, p95 at rank max(1, floor(0.95 n)), and maximum, all exact."""
    n = F.col("n")
    found = values_at_ranks(
        calls,
        group,
        value,
        {
            "_lo": F.floor((n + 1) / 2),
            "_hi": F.floor(n / 2) + 1,
            "p95": F.greatest(F.lit(1), F.floor(n * F.lit(0.95))),
            "max_ms": n,
        },
    )
    return found.select(*group, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"), "p95", "max_ms")


def wilson(correct: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval."""
    share = correct / n
    mid = share + z * z / (2 * n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (mid - half) / scale, (mid + half) / scale


def wilson_interval(predictions: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Accuracy with its 95 % interval, per group or over all."""
    low, high = wilson(F.col("correct"), F.col("n"))
    return (
        predictions.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(F.col("expected") == F.col("predicted"), 1)).alias("correct"),
        )
        .select(
            *group, "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"),
            low.alias("low"), high.alias("high"),
        )
    )


def direction(expected: Column, predicted: Column) -> Column:
    """correct, fail_open, over_restrict or cross."""
    strict = F.create_map(
        F.lit("classify_safe"), F.lit(0), F.lit("flag_pii"), F.lit(1),
        F.lit("block_transfer"), F.lit(2), F.lit("request_permission"), F.lit(2),
    )
    want, got = F.try_element_at(strict, expected), F.try_element_at(strict, predicted)
    return (
        F.when(expected == predicted, "correct")
        .when(predicted == OPEN_LABEL, "fail_open")
        .when(got > want, "over_restrict")
        .otherwise("cross")
    )


def error_direction(predictions: DataFrame) -> DataFrame:
    """(expected, predicted, direction, n) of the wrong predictions."""
    return (
        pair_counts(predictions)
        .where(F.col("expected") != F.col("predicted"))
        .select("expected", "predicted", direction(F.col("expected"), F.col("predicted")).alias("direction"), "n")
    )


def release_gate(
    predictions: DataFrame,
    group: Sequence[str] = ("run",),
    min_accuracy: float = 0.949,
    min_low: float = 0.886,
    max_p50_ms: float = 400.0,
) -> DataFrame:
    """One row per run: accuracy, its lower bound, leaks and warm median against their limits."""
    group = list(group)
    low, _ = wilson(F.col("correct"), F.col("n"))
    leak = direction(F.col("expected"), F.col("predicted")) == "fail_open"
    counted = predictions.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("expected") == F.col("predicted"), 1)).alias("correct"),
        F.count(F.when(leak, 1)).alias("fail_open"),
        F.min("case_id").alias("_first"),
    )
    counted = write_through(predictions.sparkSession, counted, "counted")
    firsts = broadcast_if_small(counted.select(*group, "_first"))
    warm = predictions.join(firsts, group).where(F.col("case_id") > F.col("_first"))
    # the middle call, upper one of two
    median = values_at_ranks(warm, group, "latency_ms", {"p50": F.floor(F.col("n") / 2) + 1}).drop("n")
    return (
        counted.join(median, group, "left")
        .select(
            *group, "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"),
            low.alias("low"), "fail_open", "p50",
        )
        .withColumn("accuracy_ok", F.col("accuracy") >= min_accuracy)
        .withColumn("low_ok", F.col("low") >= min_low)
        .withColumn("fail_open_ok", F.col("fail_open") == 0)
        .withColumn("latency_ok", F.coalesce(F.col("p50") <= max_p50_ms, F.lit(False)))
        .withColumn(
            "passed", F.col("accuracy_ok") & F.col("low_ok") & F.col("fail_open_ok") & F.col("latency_ok")
        )
    )


def regression_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, status): fixed, newly_broken, still_broken, still_right, added or removed."""
    old = before.select("case_id", (F.col("expected") == F.col("predicted")).alias("_was"))
    new = after.select("case_id", (F.col("expected") == F.col("predicted")).alias("_is"))
    return old.join(new, "case_id", "full").select(
        "case_id",
        F.when(F.col("_is").isNull(), "removed")
        .when(F.col("_was").isNull(), "added")
        .when(~F.col("_was") & F.col("_is"), "fixed")
        .when(F.col("_was") & ~F.col("_is"), "newly_broken")
        .when(~F.col("_was"), "still_broken")
        .otherwise("still_right")
        .alias("status"),
    )


def dataset_checks(
    cases: DataFrame,
    files: DataFrame,
    other: DataFrame,
    required: DataFrame | None = None,
    min_cases: int = 90,
    max_spread: int = 25,
    labels: Sequence[str] = LABELS,
) -> DataFrame:
    """(check, passed, detail) for a labelled case list (path, label).

    `files` holds the paths that exist, `other` the paths of a set that must not
    be touched, `required` those that must be among the cases.
    """
    per_label = cases.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    valid = F.col("label").isin(*labels)
    spread = F.coalesce(F.max(F.when(valid, F.col("n"))) - F.min(F.when(valid, F.col("n"))), F.lit(0))
    counted = per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cases"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).cast("long").alias("invalid"),
        F.count(F.when(valid, 1)).alias("classes"),
        spread.cast("long").alias("spread"),
    )
    def rows(frame: DataFrame, *checks: tuple[str, Column, Column]) -> DataFrame:
        structs = [
            F.struct(F.lit(name).alias("check"), ok.alias("passed"), detail.cast("long").alias("detail"))
            for name, ok, detail in checks
        ]
        return frame.select(F.inline(F.array(*structs)))

    def none_of(name: str, frame: DataFrame) -> DataFrame:
        n = F.col("n")
        return rows(frame.agg(F.count(F.lit(1)).alias("n")), (name, n == 0, n))

    paths = cases.select("path").distinct()
    checks = [
        rows(
            counted,
            ("enough_cases", F.col("cases") >= min_cases, F.col("cases")),
            ("labels_valid", F.col("invalid") == 0, F.col("invalid")),
            ("all_classes_present", F.col("classes") == len(labels), F.col("classes")),
            ("class_balance", F.col("spread") <= max_spread, F.col("spread")),
        ),
        none_of("files_exist", paths.join(files.select("path"), "path", "left_anti")),
        none_of("no_overlap", paths.join(other.select("path"), "path", "left_semi")),
    ]
    if required is not None:
        lacking = required.select("path").distinct().join(paths, "path", "left_anti")
        checks.append(none_of("required_present", lacking))
    return reduce(DataFrame.unionByName, checks)


def sweep_summary(folds: DataFrame) -> DataFrame:
    """(prompt, C, mean and population deviation of macro-F1 and accuracy) from per-fold scores."""
    return folds.groupBy("prompt", "C").agg(
        F.avg("f1").alias("mean_f1"),
        F.stddev_pop("f1").alias("std_f1"),
        F.avg("acc").alias("mean_acc"),
        F.stddev_pop("acc").alias("std_acc"),
    )


def select_winner(sweep: DataFrame, near: float = 0.005, grid: Sequence[str] = ("prompt", "C")) -> DataFrame:
    """Adds `rank` by mean F1, ties in grid order, and `near_tie` with the winner.

    The sweep has one row per setting, tens of rows for any training-set size.
    """
    order = [F.col("mean_f1").desc(), *[F.col(g) for g in grid]]
    everything = Window.partitionBy(F.lit(1))
    return sweep.withColumn("rank", F.row_number().over(everything.orderBy(*order))).withColumn(
        "near_tie",
        (F.col("mean_f1") >= F.max("mean_f1").over(everything) - near) & (F.col("rank") > 1),
    )


def cv_results_by_c(sweep: DataFrame, prompt: str, chosen_c: float) -> DataFrame:
    """One row: the chosen prompt's metrics as a map from C; a stub entry if it was never swept."""
    entry = F.struct(
        F.col("mean_f1").alias("macro_f1_mean"), F.col("std_f1").alias("macro_f1_std"),
        F.col("mean_acc").alias("accuracy_mean"), F.col("std_acc").alias("accuracy_std"),
        F.lit(None).cast("string").alias("note"),
    )
    nothing = F.struct(
        *[
            F.lit(None).cast("double").alias(x)
            for x in ("macro_f1_mean", "macro_f1_std", "accuracy_mean", "accuracy_std")
        ],
        F.lit("no sweep results available; metrics not recorded").alias("note"),
    )
    stub = F.map_from_arrays(F.array(F.lit(float(chosen_c))), F.array(nothing))
    found = sweep.where(F.col("prompt") == prompt).agg(
        F.collect_list(F.struct(F.col("C").cast("double").alias("key"), entry.alias("value"))).alias("_e")
    )
    return found.select(
        F.lit(prompt).alias("prompt"),
        F.when(F.size("_e") > 0, F.map_from_entries("_e")).otherwise(stub).alias("cv_results"),
    )
