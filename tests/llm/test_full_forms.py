"""Surrogates of forms that have fewer values than they would need."""

import itertools
import re
import string

from pyspark.sql import functions as F

from tidemark.llm import pii


def test_full_forms_get_longer_surrogates(spark):
    emails = [("email", f"{a}@{b}.co") for a, b in itertools.islice(itertools.product(string.ascii_lowercase, repeat=2), 500)]
    cards = [("card", f"4111{i:08d}") for i in range(20)]
    ids = spark.createDataFrame(emails + cards, "kind string, id string")
    rows = [tuple(r) for r in pii.assign_surrogates(ids).collect()]
    assert {r[:2] for r in rows} == {*emails, *cards} and len(rows) == 520
    assert len({(k, s.lower()) for k, _, s in rows}) == 520 and not {s.lower() for _, _, s in rows} & {i for _, i, _ in rows}
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.co", s) for k, _, s in rows if k == "email") and any(len(s) > 6 for k, _, s in rows if k == "email")
    assert all(len(s) == 12 for k, _, s in rows if k == "card")


def test_full_phone_numbers_in_texts(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.format_string("call +1%04d now", "id").alias("text"))
    got = pii.replace_pii(docs).collect()
    assert len(got) == 6000 and all(re.fullmatch(r"call \+1\d{4,} now", r["text"]) for r in got)
    assert len({r["text"] for r in got}) == 6000 and not {r["text"] for r in got} & {f"call +1{n:04d} now" for n in range(6000)}
