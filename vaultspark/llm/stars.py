"""Texts of pairs brought together: each leader with its members, in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members that meet their leader in one group; more are split, and the leader's text goes to each part.
GROUP = 256


def together(pairs: DataFrame, texts: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Rows (lead, part, member, text, extra...), each leader's text (member null) before its members'.

    pairs: lead, member and extra columns; texts: key and text, one row a key.
    """
    extra = extra or []
    parts = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    kinds = dict(pairs.dtypes)
    members = pairs.join(parts, "lead").select("lead", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), "member", *extra)
    leads = parts.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(kinds["member"]).alias("member"), *(F.lit(None).cast(kinds[c]).alias(c) for c in extra))
    wanted = members.unionByName(leads).withColumn("key", F.coalesce("member", "lead"))  # one join moves a text once
    return wanted.join(texts, "key").select("lead", "part", "member", "text", *extra).repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("member").asc_nulls_first())
