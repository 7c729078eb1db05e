"""Images: modality, findings, quality tiers, preprocessing arms and plans."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark import lexicons as L
from vaultspark import models
from vaultspark.functions.strings import lookup, rx


def pipeline_of(file_name: Column) -> Column:
    """imaging for an image's suffix, or else text."""
    return F.when(F.concat(F.lit("."), F.lower(F.element_at(F.split(file_name, r"\."), -1))).isin(L.IMAGE_SUFFIXES), "imaging").otherwise("text")


def modality(path: Column) -> Column:
    """By the first pattern in the file's stem and folder."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = F.when(name.rlike(r"^.+\.[^.]+\z"), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)
    text, out = F.concat_ws(" ", stem, F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))), F
    for pattern, kind in L.MODALITIES:
        out = out.when(text.rlike(rx(pattern, "i")), kind)
    return out.otherwise("unknown_scan")


def scan_prompt(kind: Column) -> Column:
    """What a vision model is asked of a scan, by its modality, or by default."""
    return F.concat(lookup(kind, L.SCAN_PROMPTS, L.DEFAULT_SCAN_PROMPT), F.lit(L.SCAN_RULE))


def describe(images: DataFrame, provider, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """image_id, modality and description of scans (image_id, path, image): three attempts each, "" where all fail."""
    def run(batches):
        for pdf in batches:
            found = [models.insistent(lambda x=x, p=p: provider.look([x], [p])[0].strip(), other="", sleep=sleep) for x, p in zip(map(bytes, pdf["image"]), pdf["prompt"], strict=True)]
            yield pd.DataFrame({"image_id": pdf["image_id"], "modality": pdf["modality"], "description": found})

    asked = images.withColumn("modality", modality(F.col("path"))).withColumn("prompt", scan_prompt(F.col("modality")))
    return asked.select("image_id", "modality", "prompt", "image").mapInPandas(run, "image_id long, modality string, description string")


def score_phrases(images: DataFrame, provider) -> DataFrame:
    """image_id, ordinal, phrase and score (to four places) of chest radiographs (image_id, path, image) against the fixed phrases; others have no rows."""
    def run(batches):
        for pdf in batches:
            rows = [(i, k, p, round(float(s), 4)) for i, scores in zip(pdf["image_id"], provider.match([bytes(x) for x in pdf["image"]], L.CHEST_PHRASES), strict=True) for k, (p, s) in enumerate(zip(L.CHEST_PHRASES, scores, strict=True))]
            yield pd.DataFrame(rows, columns=["image_id", "ordinal", "phrase", "score"])

    chest = images.filter(modality(F.col("path")) == "chest_xray")
    return chest.select("image_id", "image").mapInPandas(run, "image_id long, ordinal int, phrase string, score double")


def findings(scores: DataFrame, described: DataFrame) -> DataFrame:
    """image_id, is_abnormal, abnormal_flags (phrases from 0.22 up, normal ones aside, in order) and top_normal. scores: image_id, ordinal, phrase, score; described: image_id, description."""
    normal = F.col("phrase").isin(L.NORMAL_PHRASES)
    flagged = F.when((F.col("score") >= L.ABNORMAL_SCORE) & ~normal, F.struct("ordinal", "phrase"))
    per = scores.groupBy("image_id").agg(F.sort_array(F.collect_list(flagged)).alias("f"), F.max_by(F.when(normal, F.col("phrase")), F.when(normal, F.struct(F.col("score"), -F.col("ordinal")))).alias("top_normal"))
    flags = F.transform(F.coalesce("f", F.array()), lambda x: x["phrase"])
    return described.join(per, "image_id", "left").select("image_id", (F.coalesce(F.size("f"), F.lit(0)) > 0).alias("__any"), F.col("description").rlike(rx(r"\bABNORMAL\b")).alias("__said"), F.array_join(flags, " | ").alias("abnormal_flags"), "top_normal").select("image_id", (F.col("__any") | F.col("__said")).alias("is_abnormal"), "abnormal_flags", "top_normal")


def tier(sharpness: Column, noise: Column, contrast: Column, skew: Column, occupancy: Column, handwriting: Column, component: Column, stroke: Column) -> Column:
    """The document's tier, by the first rule that holds."""
    turn = F.abs(skew)
    sharp, quiet = sharpness >= L.SHARP_MIN, noise <= L.NOISE_HIGH
    bent = (turn >= L.SKEW_MODERATE) | ((occupancy < L.OCCUPANCY_MODERATE) & (turn >= L.SKEW_TRIVIAL)) | (occupancy < L.OCCUPANCY_LOW)
    d, h = L.DIGITAL, L.HANDWRITING
    digital = (sharpness >= d["sharpness"]) & (contrast >= d["contrast"]) & (noise <= d["noise"]) & (turn < L.SKEW_MODERATE) & (occupancy >= d["occupancy"])
    return (
        F.when(digital, "HIGH_QUALITY").when(bent & sharp & quiet, "TILTED_SCAN").when(~bent & ((contrast < L.CONTRAST_LOW) | ~sharp | ~quiet), "LOW_QUALITY").when(bent & (~sharp | ~quiet), "MOBILE_CAPTURE")
        .when((handwriting >= h["score"]) & (component >= h["component"]) & (stroke >= h["stroke"]), "HANDWRITTEN").otherwise("CLEAN_SCAN")
    )


def preset_of(tier_: Column) -> Column:
    return lookup(tier_, {"HIGH_QUALITY": "digital_pdf", "TILTED_SCAN": "tilted_scan", "LOW_QUALITY": "low_quality_scan", "MOBILE_CAPTURE": "mobile_capture", "HANDWRITTEN": "handwritten"}, "clean_scan")


def blur_score(sharpness: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - sharpness / L.BLUR_SPAN)


def band(confidence: Column) -> Column:
    out = F
    for least, name in L.BANDS:
        out = out.when(confidence >= least, name)
    return out.otherwise("low")


def arms(confidence: Column, skew: Column, occupancy: Column) -> Column:
    """Preprocessing arms to try: by band, with deskewing and cropping added where geometry asks."""
    own = F
    for name, listed in L.ARMS.items():
        own = own.when(band(confidence) == name, F.array(*(F.lit(a) for a in listed)).cast("array<string>"))
    none = F.array().cast("array<string>")
    turned = F.array_union(own, F.when(F.abs(skew) >= L.DESKEW_AT, F.array(F.lit("deskew_only"))).otherwise(none))
    cropped = F.array_union(turned, F.when(occupancy < L.CROP_BELOW, F.array(F.lit("crop_only"))).otherwise(none))
    return F.when(band(confidence) == "high", none).otherwise(cropped)


def plan(preset: Column, sharpness: Column, noise: Column, contrast: Column, skew: Column, boxed: Column) -> Column:
    """The preset's steps whose gates let them pass, in order."""
    has = lambda step: preset.isin([name for name, steps in L.PRESETS.items() if step in steps])
    turn = F.abs(skew)
    gates = [
        ("perspective", (turn >= L.SKEW_MODERATE) | boxed), ("deskew", turn >= L.SKEW_TRIVIAL), ("denoise", noise >= L.DENOISE_MIN), ("handwriting", F.lit(True)), ("clahe", contrast < L.CLAHE_MAX),
        ("blur_recovery", sharpness < L.BLUR_MAX), ("sharpen", ~has("blur_recovery")), ("threshold", ~has("handwriting") & (contrast < L.THRESHOLD_MAX)), ("border", F.lit(True)),
    ]
    return F.array_compact(F.array(*(F.when(has(name) & on, F.lit(name)) for name, on in gates)))


def parameters(preset: Column) -> Column:
    """The preset's steps with their parameters, as a map of step to a map of name to value."""
    inner = lambda values: F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v))))) if values else F.create_map().cast("map<string,double>")
    out = F
    for name, steps in L.PRESETS.items():
        out = out.when(preset == name, F.create_map(*(x for step, values in steps.items() for x in (F.lit(step), inner(values)))) if steps else F.create_map().cast("map<string,map<string,double>>"))
    return out


def winner(candidates: DataFrame) -> DataFrame:
    """page_id, baseline_conf, conf_band, winner_arm and winner_conf: the most confident arm if strictly better than the original. candidates: page_id, arm, ordinal, confidence, chars (arm `original` is the baseline; failed arms have no confidence)."""
    base = F.col("arm") == "original"
    per = candidates.groupBy("page_id").agg(F.max(F.when(base, F.col("confidence"))).alias("baseline_conf"), F.max(F.when(base, F.col("chars"))).alias("baseline_chars"), F.max(F.when(~base & F.col("confidence").isNotNull(), F.struct("confidence", (-F.col("ordinal")).alias("o"), "arm", "chars"))).alias("b"))
    won = F.coalesce(F.col("b.confidence") > F.col("baseline_conf"), F.lit(False))
    pick = lambda f, other: F.when(won, F.col(f"b.{f}")).otherwise(other)
    return per.select("page_id", "baseline_conf", "baseline_chars", band(F.col("baseline_conf")).alias("conf_band"), pick("arm", F.lit("original")).alias("winner_arm"), pick("confidence", F.col("baseline_conf")).alias("winner_conf"), pick("chars", F.col("baseline_chars")).alias("winner_chars"))


def kernels(gray: np.ndarray) -> tuple[float, float, float, float, float]:
    """Sharpness (variance of the Laplacian), noise (deviation from a 5x5 Gaussian), contrast, brightness and text density (share below Otsu's threshold)."""
    g = gray.astype(np.float64)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    taps = np.array([1, 4, 6, 4, 1]) / 16
    q = np.pad(g, 2, mode="reflect") if min(g.shape) > 2 else np.pad(g, 2, mode="edge")
    rows = sum(t * q[k : k + g.shape[0]] for k, t in enumerate(taps))
    smooth = sum(t * rows[:, k : k + g.shape[1]] for k, t in enumerate(taps))
    histogram = np.bincount(gray.reshape(-1), minlength=256).astype(float)
    below, mass = np.cumsum(histogram), np.cumsum(histogram * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((mass[-1] * below / below[-1] - mass) ** 2 / (below * (below[-1] - below)))
    cut = int(between.argmax())
    return float(laplacian.var()), float((g - smooth).std() / 255), float((np.percentile(g, 95) - np.percentile(g, 5)) / 255), float(g.mean() / 255), float((gray <= cut).mean())


def measure(images: DataFrame) -> DataFrame:
    """image_id and the kernels of gray images (image_id, width, pixels as bytes)."""
    def run(batches):
        for pdf in batches:
            found = [kernels(np.frombuffer(p, np.uint8).reshape(-1, w)) for p, w in zip(pdf["pixels"], pdf["width"], strict=True)]
            yield pd.DataFrame([(i, *f) for i, f in zip(pdf["image_id"], found, strict=True)], columns=["image_id", "sharpness", "noise", "contrast", "brightness", "text_density"])

    return images.select("image_id", "width", "pixels").mapInPandas(run, "image_id long, sharpness double, noise double, contrast double, brightness double, text_density double")
