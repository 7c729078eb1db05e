"""Expressions and operators on small tables, with results worked out by hand."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultspark import models
from vaultspark.functions import numbers, strings, validators
from vaultspark.operators import evaluation, imaging, questions, retrieval, text, vault, workflow
from vaultspark.sources import files, sinks
from vaultspark.streaming import ingest


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def check_digit(digits: str) -> str:
    d, p = validators.dihedral(), validators.permutations()
    for x in "0123456789":
        c = 0
        for i, ch in enumerate(reversed(digits + x)):
            c = d[c][p[i % 8][int(ch)]]
        if c == 0:
            return x


def test_tables_of_the_checksum():
    assert validators.dihedral()[5] == [5, 9, 8, 7, 6, 0, 4, 3, 2, 1] and validators.permutations()[7] == [7, 0, 4, 6, 9, 1, 3, 2, 5, 8]


@settings(max_examples=15, deadline=None)
@given(st.integers(2 * 10**10, 10**11 - 1), st.integers(0, 11), st.integers(1, 9))
def test_checksum_finds_single_errors_and_swaps(spark, number, place, step):
    good = str(number) + check_digit(str(number))
    wrong = good[:place] + str((int(good[place]) + step) % 10) + good[place + 1 :]
    k = min(place, 10)
    swapped = good[:k] + good[k + 1] + good[k] + good[k + 2 :]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (good, wrong, swapped)], "x string").select(validators.verhoeff_valid(F.col("x"))).collect()]
    assert got == [True, False, swapped == good]


def test_identity_numbers(spark):
    assert one(spark, "2341 2341 2346", validators.national_id_valid) and not one(spark, "2341 2341 2347", validators.national_id_valid)
    assert not one(spark, "12ab", validators.verhoeff_valid) and not one(spark, "", validators.national_id_valid)
    assert one(spark, "abcpe1234z", validators.tax_holder_valid) and not one(spark, "ABCQE1234Z", validators.tax_holder_valid)


@pytest.mark.parametrize(("q", "fixed"), [("diagn0sis", "diagnosis"), ("d1ab3tes", "diabetes"), ("500mg", "500mg"), ("a00b", "a00b"), ("rna  x", "ma x"), ("user@mail", "useramail"), ("hba1c", "hbaic")])
def test_repair(spark, q, fixed):
    assert one(spark, q, questions.repair) == fixed


def test_correction_and_routes(spark):
    got = values(spark, [("paracetmol, now",), ("asprin is fine",), ("1 the",)], "x string", questions.correct(F.col("x")))
    assert [g[0] for g in got] == ["paracetamol now", "aspirin is fine", "1 the"]
    assert one(spark, "allergy before surgery", questions.question_class) == "ALLERGY_QUERY" and one(spark, "hello", questions.question_class) == "RAG_QUERY"


def test_class_ties_go_to_the_first(spark):
    assert one(spark, "rx claim", text.doc_type) == "prescription" and one(spark, "outpatient", text.doc_type) == "insurance" and one(spark, "", text.doc_type) == "unknown"


def test_allergens(spark):
    assert one(spark, "Allergic to penicillin. Also intolerant to nuts.", strings.allergens) == ["penicillin", "nuts"]
    assert one(spark, "NKDA, allergic to x.", strings.allergens) == ["NKDA (No Known Drug Allergies)"] and one(spark, None, strings.allergens) == []


def test_garbage_and_years(spark):
    assert one(spark, "a b cd", strings.is_garbage) and one(spark, " ", strings.is_garbage) and not one(spark, "fine words here a", strings.is_garbage)
    assert one(spark, "31/01/20", strings.year) is None and one(spark, "on 5 May 2019", strings.year) == "2019"


def test_chunks_of_odd_documents(spark):
    kinds = [(None, "unknown"), ("", "unknown"), ("text", "biopsy_report"), ("Findings: a\nImpression: b", "imaging_report"), ("x" * 30, "lab_report")]
    got = values(spark, kinds, "t string, k string", F.size(text.chunks(F.col("t"), F.col("k"))))
    assert [g[0] for g in got][1:] == [0, 1, 2, 1]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=25))
def test_packing_of_sentences_loses_no_word(spark, sizes):
    body = " ".join(" ".join(f"w{k}x{j}" for j in range(n)) + "." for k, n in enumerate(sizes))
    got = spark.createDataFrame([(body,)], "t string").select(text.pack_sentences(F.col("t"), 80, 20)).first()[0]
    assert set(" ".join(got).split()) == set(body.split()) and all(len(c.split()) <= 80 + 20 for c in got)


def test_fusion_is_symmetric_in_scores(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "question_id long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "question_id long, chunk_id string, rank int")
    texts = spark.createDataFrame([("a", "ta"), ("b", "tb"), ("c", "tc")], "chunk_id string, text string")
    x, y = ({r["text"]: r["rrf_score"] for r in retrieval.fuse(p, q, texts).collect()} for p, q in ((a, b), (b, a)))
    assert x == y and x["tb"] == round(1 / 62 + 1 / 61, 6)


def test_confidence(spark):
    hits = spark.createDataFrame([(1, k, 0.5, 0.03, "diagnosis" if k < 4 else "lab") for k in range(1, 6)], "question_id long, position int, rerank_score double, rrf_score double, semantic_type string")
    r = retrieval.confidence(hits).first()
    assert r["confidence"] == round(0.75 * 40 + 0.03 * 30 + 0.6 * 30, 1) and r["quality"] == "LOW" and "agreement=0.60" in r["reason"]
    assert retrieval.rerank_confidence(hits).first()["confidence"] == 55.0


def test_cosine_and_unit(spark):
    rows = [([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0])]
    got = values(spark, rows, "a array<double>, b array<double>", F.round(numbers.cosine(F.col("a"), F.col("b")), 6), numbers.unit(F.col("a")))
    assert got == [(1.0, [0.6, 0.8]), (0.0, [1.0, 0.0])]


def test_lexical_dates_of_the_timeline(spark):
    rows = [(1, "f1", 0, "c1", "31/01/2020", "x", [], [], None, None, None), (1, "f2", 0, "c2", "01/02/2024", "x", [], [], None, None, None), (1, "f3", 0, "c3", None, "lab_report", [], [], None, None, None)]
    schema = "patient_id long, file_name string, chunk_index int, chunk_id string, visit_date string, doc_type string, diagnosis array<string>, drugs array<string>, surgery_type string, doctor_name string, hospital string"
    df = spark.createDataFrame(rows, schema)
    got = vault.timeline(df).orderBy("place").collect()
    assert [r["source"] for r in got] == ["f1", "f2", "f3"] and got[2]["event"] == "Lab Report on file" and got[2]["year"] == "Unknown Year"
    assert vault.summary(df.withColumn("text", F.lit(""))).first()["latest_visit"] == "31/01/2020"


def test_access_rules(spark):
    appts = spark.createDataFrame([("p1", "d1", "accepted"), ("p2", "d1", "pending")], "patient_id string, doctor_id string, status string")
    staff = spark.createDataFrame([("d1", "City")], "id string, hospital string")
    asked = spark.createDataFrame([(1, "doctor", "d1", None, "p1"), (2, "doctor", "d1", None, "p2"), (3, "tpa", "x", "CITY", "p1"), (4, "tpa", "x", None, "p1"), (5, "visitor", "x", None, "p1"), (6, "patient", "p2", None, "p2")], "request_id int, role string, requester_id string, requester_hospital string, patient_id string")
    for fix, want in ((False, [True, False, True, False, True, True]), (True, [True, False, True, False, False, True])):
        assert [r["allowed"] for r in workflow.access(asked, appts, staff, fix).orderBy("request_id").collect()] == want


def test_tokens_are_new_and_unambiguous(spark):
    rows = spark.range(500).withColumnRenamed("id", "admission_id")
    first = workflow.mint_tokens(rows, spark.createDataFrame([], "token string"))
    again = workflow.mint_tokens(rows, first.select("token"))
    got = [r["token"] for r in first.collect()] + [r["token"] for r in again.collect()]
    assert len(set(got)) == 1000 and not set("01OI") & set("".join(got)) and {len(t) for t in got} == {8}


def test_arms_and_winner(spark):
    got = values(spark, [(0.95, 9.0, 0.1), (0.85, 9.0, 0.1), (0.1, 0.0, 0.9)], "c double, s double, o double", imaging.arms(F.col("c"), F.col("s"), F.col("o")))
    assert [len(g[0]) for g in got] == [0, 4, 5]
    rows = [(1, "original", 0, 0.7, 10), (1, "x", 1, 0.7, 20), (2, "original", 0, 0.5, 10), (2, "x", 1, 0.6, 5), (2, "y", 2, None, 5)]
    won = {r["page_id"]: r["winner_arm"] for r in imaging.winner(spark.createDataFrame(rows, "page_id int, arm string, ordinal int, confidence double, chars int")).collect()}
    assert won == {1: "original", 2: "x"}
    assert evaluation.arms(spark.createDataFrame(rows, "page_id int, arm string, ordinal int, confidence double, chars int")).count() == 4


def test_kernels():
    flat = np.full((20, 20), 100, np.uint8)
    assert imaging.kernels(flat)[:3] == (0.0, 0.0, 0.0)
    half = np.concatenate([np.zeros((20, 10), np.uint8), np.full((20, 10), 255, np.uint8)], 1)
    sharp, _, contrast, bright, dense = imaging.kernels(half)
    assert sharp > 1000 and contrast == 1.0 and bright == 0.5 and dense == 0.5


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfplain \xff text")
    (tmp_path / "b.png").write_bytes(b"no")
    assert [(r["file_name"], r["text"]) for r in files.plain_text(spark, str(tmp_path)).collect()] == [("a.txt", "plain � text")]


def test_pages(spark):
    pages = spark.createDataFrame([("f", 2, "two"), ("f", 1, "one"), ("f", 3, " ")], "file_path string, page int, text string")
    assert files.join_pages(pages).first()["text"] == "[PAGE 1]\none\n\n[PAGE 2]\ntwo" and not files.is_digital(pages).first()["is_digital"]
    split = files.pages(spark.createDataFrame([("f", bytearray(b"ab"))], "file_path string, content binary"), lambda b: [b[:1], b[1:]])
    assert [(r["page"], bytes(r["image"])) for r in split.collect()] == [(1, b"a"), (2, b"b")]
    assert files.read_text(split, models.Offline()).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.replace_partitions(df, str(tmp_path / "t"), "k")
    sinks.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), str(tmp_path / "t"), "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]
    sinks.csv(df, str(tmp_path / "c"), ["v", "gone", "k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["v", "gone", "k"]
    sinks.json(df, str(tmp_path / "j"))
    sinks.append(df, str(tmp_path / "a"))
    sinks.append(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.parquet(str(tmp_path / "a")).count() == 4


def test_models(spark):
    calls = []

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 overloaded")
        return prompts

    assert models.patient(flaky, ["p"], sleep=calls.append) == ["p"] and models.patient(lambda: 1 / 0).startswith("[ERROR]")
    got = models.ask(spark.createDataFrame([("p",), (None,)], "prompt string"), models.Offline()).collect()
    assert all("uncertain" in r["reply"] for r in got)
    assert pd.Series(models.Offline().score([("a b", "b c"), ("", "")])).round(3).tolist() == [0.333, 0.0]


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    schema = "patient_id string, file_name string, file_path string, text string, extraction_method string"
    rows = [("p", f"f{k}", f"f{k}", t, "plaintext") for k, t in enumerate(["Rx\nTab Aspirin 75 mg once daily", "CBC\nHaemoglobin: 12 g/dL\nLipid profile\nGlucose: 90 mg/dL fine", "nothing"])]
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    docs = ingest.documents(spark, str(tmp_path / "in"), schema, files=1)
    ingest.start(ingest.chunks(docs), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    cols = ["chunk_id", "doc_type", "semantic_type", "chunk_index", "text"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(cols).collect())) == sorted(map(tuple, text.ingest(batch).select(cols).collect()))


def test_counts_in_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = ingest.documents(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "))
    ingest.counts(stream, "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("day_counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start().awaitTermination()
    assert spark.table("day_counts").agg(F.sum("n")).first()[0] == events.count()


def test_notices_are_told_once(spark, tmp_path):
    for k in range(2):
        spark.sql(f"select id, cast(id % 3 as long) as ahead_count, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, {k} * 3) as at from range(12)").write.mode("append").parquet(str(tmp_path / "in"))
    rows = ingest.documents(spark, str(tmp_path / "in"), "id long, ahead_count long, at timestamp", files=1)
    ingest.start(ingest.notices(rows), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [i for i in range(12) if i % 3 <= 1]


def test_the_queue_monitor_replaces_touched_days_only(spark, tmp_path):
    from vaultspark.operators import workflow

    schema = "id long, patient_id long, doctor_id long, type string, status string, time timestamp, checked_in_at string"
    every = spark.sql("select id, id as patient_id, id % 2 as doctor_id, 'new' as type, 'checked_in' as status, timestamp'2024-01-01 08:00:00' + make_interval(0, 0, 0, cast(id % 3 as int)) as time, cast(null as string) as checked_in_at from range(30)")
    staff = spark.sql("select id, cast(id * 5 as int) as drift from range(2)")
    every.write.parquet(str(tmp_path / "all"))
    for ids in ("id < 30", "id = 7"):  # all, then a change of one appointment
        every.filter(ids).write.mode("append").parquet(str(tmp_path / "changes"))
        changes = ingest.documents(spark, str(tmp_path / "changes"), schema)
        ingest.queue_monitor(changes, lambda: spark.read.parquet(str(tmp_path / "all")), staff, str(tmp_path / "sink"), str(tmp_path / "state")).awaitTermination()
    got = {(r["id"], r["position"]) for r in spark.read.parquet(str(tmp_path / "sink")).collect()}
    assert got == {(r["id"], r["position"]) for r in workflow.queue(every, staff).collect()}


def test_pages_and_scans_are_tried_three_times(spark):
    from vaultspark import models

    waits, calls = [], []

    def call():
        calls.append(1)
        raise RuntimeError("no")

    assert models.insistent(call, other="", sleep=waits.append) == "" and len(calls) == 3 and waits == [10, 20]
