"""Evaluation of preprocessing arms and presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions.numbers import percent_change, ratio
from vaultspark.operators import imaging

#: Columns of the two exports, in order (fixed values).
ARM_COLUMNS = ["file_name", "conf_band", "document_tier", "baseline_conf", "baseline_chars", "winner_arm", "winner_conf", "winner_chars", "conf_improvement", "is_improved", "skew_angle", "occupancy_ratio", "arms_evaluated"]
PRESET_COLUMNS = [
    "preset_name", "document_tier", "before_chars", "after_chars", "char_improvement_pct", "before_words", "after_words", "word_improvement_pct", "before_confidence", "after_confidence", "confidence_delta",
    "skew_before", "skew_after", "occupancy_before", "occupancy_after", "blur_before", "blur_after", "composite_score",
]


def mean_confidence(words: DataFrame) -> DataFrame:
    """page_id, confidence (mean over words, four places; 0 without words) and text, from words (page_id, at, word, confidence)."""
    per = words.groupBy("page_id").agg(F.round(F.avg("confidence"), 4).alias("confidence"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    return per.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def arms(candidates: DataFrame) -> DataFrame:
    """page_id, arm, conf_delta and char_delta_pct against the original, and is_winner."""
    won = imaging.winner(candidates).select("page_id", "baseline_conf", "baseline_chars", "winner_arm")
    met = candidates.filter(F.col("confidence").isNotNull()).join(won, "page_id")
    return met.select("page_id", "arm", F.round(F.col("confidence") - F.col("baseline_conf"), 4).alias("conf_delta"), percent_change(F.col("baseline_chars").cast("double"), F.col("chars").cast("double")).alias("char_delta_pct"), (F.col("arm") == F.col("winner_arm")).alias("is_winner"))


def improved(won: DataFrame) -> DataFrame:
    """Winners with conf_improvement and is_improved."""
    return won.withColumn("conf_improvement", F.round(F.col("winner_conf") - F.col("baseline_conf"), 4)).withColumn("is_improved", F.col("conf_improvement") > 0)


def composite(delta: Column, chars: Column, words: Column) -> Column:
    """0.55 of the confidence gained and 0.30 and 0.15 of the changes of characters and words, from percent."""
    return 0.55 * delta + 0.30 * (chars / 100.0) + 0.15 * (words / 100.0)


def presets(runs: DataFrame) -> DataFrame:
    """Runs (page_id, preset_name, before_ and after_ confidence, chars and words) with their changes and composite_score."""
    c = lambda n: F.col(n).cast("double")
    out = runs.withColumns({"confidence_delta": F.round(c("after_confidence") - c("before_confidence"), 4), "char_improvement_pct": percent_change(c("before_chars"), c("after_chars")), "word_improvement_pct": percent_change(c("before_words"), c("after_words")), "text_length_ratio": ratio(c("after_chars"), c("before_chars"))})
    return out.withColumn("composite_score", F.round(composite(F.col("confidence_delta"), F.col("char_improvement_pct"), F.col("word_improvement_pct")), 6))


def ranked(scored: DataFrame) -> DataFrame:
    """Presets of each page by falling composite score."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("composite_score"), "preset_name")))


def best(scored: DataFrame) -> DataFrame:
    """page_id, preset_name, composite_score and negative: whether even the best is worse than nothing."""
    return ranked(scored).filter("place = 1").select("page_id", "preset_name", "composite_score", (F.col("composite_score") < 0).alias("negative"))
