"""Files: plain text, pages of images and PDFs behind a provider, and tables."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark import lexicons as L
from vaultspark import models
from vaultspark.functions.strings import without_bom

TEXT_SUFFIXES = [".txt", ".md", ".text"]


def suffix(path):
    """The suffix of a path with its dot, in lower case."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """file_path, file_name, suffix and text of text files: UTF-8 without marks; undecodable bytes are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = raw.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), suffix(F.col("path")).alias("suffix"), "content")
    return named.filter(F.col("suffix").isin(TEXT_SUFFIXES)).select("file_path", "file_name", "suffix", without_bom(decoded(F.col("content"))).alias("text"))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8; Spark's own decoder raises on malformed bytes."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def pages(files: DataFrame, rasterise) -> DataFrame:
    """A row per page of binary files (file_path, content): page (from 1) and image. rasterise: bytes to a list of images, on the executors."""
    def run(batches):
        for pdf in batches:
            rows = [(p, n, image) for p, c in zip(pdf["file_path"], pdf["content"], strict=True) for n, image in enumerate(rasterise(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["file_path", "page", "image"])

    return files.select("file_path", "content").mapInPandas(run, "file_path string, page int, image binary")


def join_pages(pages: DataFrame, separator: str = "\n\n", marked: bool = True) -> DataFrame:
    """file_path and the text of its filled pages (file_path, page, text) in order, each under its number."""
    filled = pages.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    body = F.concat(F.lit("[PAGE "), F.col("page").cast("string"), F.lit("]\n"), F.col("text")) if marked else F.col("text")
    listed = filled.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("page", body.alias("t")))).alias("l"))
    return listed.select("file_path", F.array_join(F.transform("l", lambda x: x["t"]), separator).alias("text"))


def is_digital(pages: DataFrame, least: int = 50) -> DataFrame:
    """file_path and whether its pages' text layers have so many characters together."""
    return pages.groupBy("file_path").agg((F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))) >= least).alias("is_digital"))


def read_text(images: DataFrame, provider, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Pages (file_path, page, image) with text and confidence by the provider's reader; a page that three attempts fail on has neither."""
    def run(batches):
        for pdf in batches:
            found = [models.insistent(lambda x=x: provider.read([x])[0], other=("", 0.0), sleep=sleep) for x in map(bytes, pdf["image"])]
            yield pd.DataFrame([(p, n, t, round(c, 4)) for p, n, (t, c) in zip(pdf["file_path"], pdf["page"], found, strict=True)], columns=["file_path", "page", "text", "confidence"])

    return images.select("file_path", "page", "image").mapInPandas(run, "file_path string, page int, text string, confidence double")


def see_pages(images: DataFrame, provider, prompt: str = L.PAGE_PROMPT, pace: float = L.PAGE_PACE, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Pages (file_path, page, image) with text by a vision model: three attempts each, a pause after each page, "" where all fail."""
    def run(batches):
        for pdf in batches:
            texts = []
            for x in map(bytes, pdf["image"]):
                texts.append(models.insistent(lambda x=x: provider.look([x], [prompt])[0].strip(), other="", sleep=sleep))
                sleep(pace)
            yield pd.DataFrame({"file_path": pdf["file_path"], "page": pdf["page"], "text": texts})

    return images.select("file_path", "page", "image").mapInPandas(run, "file_path string, page int, text string")


def broken_pages(pages: DataFrame) -> DataFrame:
    """file_path and the text of all its pages (file_path, page, text) in order, empty ones too, between page breaks."""
    listed = pages.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
    return listed.select("file_path", F.array_join(F.transform("l", lambda x: x["t"]), L.PAGE_BREAK).alias("text"))
