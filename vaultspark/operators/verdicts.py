"""Replies of models, read with care."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark import lexicons as L
from vaultspark import models
from vaultspark.functions.strings import rx, strip


def _json(raw: Column, schema: str) -> Column:
    """The reply as an object, with or without code fences; null if it is none."""
    bare = strip(F.regexp_replace(raw, rx(r"```(?:json)?|```"), ""))
    plain, inner = F.from_json(raw, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}), F.from_json(bare, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(plain["_bad"].isNull() & raw.rlike(r"(?s)^\s*\{.*\}\s*\z"), plain).when(inner["_bad"].isNull() & bare.rlike(r"(?s)^\{.*\}\z"), inner)


def verdict(raw: Column) -> Column:
    """verdict (verified, missing or uncertain), status and explanation; anything unreadable is uncertain, with a fixed explanation."""
    found = F.when(~raw.startswith("[ERROR]"), _json(raw, "verdict string, explanation string"))
    said = F.lower(F.coalesce(found["verdict"], F.lit("uncertain")))
    kind = F.when(found.isNull() | ~said.isin("verified", "missing"), "uncertain").otherwise(said)
    why = F.when(found.isNull(), L.UNAVAILABLE).otherwise(F.coalesce(found["explanation"], F.lit("No explanation provided.")))
    return F.struct(kind.alias("verdict"), F.when(kind == "uncertain", "needs_review").otherwise(kind).alias("status"), why.alias("explanation"))


def verification(raw: Column) -> Column:
    """verified and explanation; an unreadable reply is verified if it says true anywhere."""
    found = _json(raw, "verified boolean, explanation string")
    yes = F.when(found.isNull(), F.contains(F.lower(raw), F.lit("true"))).otherwise(F.coalesce(found["verified"], F.lit(False)))
    why = F.when(found.isNotNull(), F.coalesce(found["explanation"], F.lit("No explanation provided."))).when(raw == "", "Verification response was unreadable.").otherwise(F.substring(raw, 1, 300))
    return F.struct(yes.alias("verified"), why.alias("explanation"))


def supported(raw: Column) -> Column:
    """Whether a one-word verdict says so and not its opposite."""
    up = F.upper(raw)
    return F.contains(up, F.lit("SUPPORTED")) & ~F.contains(up, F.lit("NOT SUPPORTED"))


def verify_answers(answers: DataFrame, provider) -> DataFrame:
    """question_id, verified and explanation of answers (question_id, answer, context); those without either are not sent to the model."""
    full = (F.coalesce("answer", F.lit("")) != "") & (F.coalesce("context", F.lit("")) != "")
    prompt = F.concat(F.lit(L.VERIFY_PROMPT + "\n\nCONTEXT:\n"), "context", F.lit("\n\nANSWER:\n"), "answer")
    asked = models.ask(answers.filter(full).select("question_id", prompt.alias("prompt")), provider)
    judged = asked.select("question_id", verification(F.col("reply")).alias("v")).select("question_id", "v.verified", "v.explanation")
    return judged.unionByName(answers.filter(~full).select("question_id", F.lit(False).alias("verified"), F.lit(L.VERIFY_SKIPPED).alias("explanation")))
