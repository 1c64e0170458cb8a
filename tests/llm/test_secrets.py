"""Secrets: blocks, tokens and address passwords, values without bounds, and texts of many candidates."""

import hashlib
import re
import time

from klaxon.llm import secrets

from support_llm import documents

PEM = "MIIEowIBAAKCAQEA7x\nQ29kZSBpcyBub3Qg\nYSBzZWNyZXQ=\n"
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP-mB92K27uhbUJU1p1r"


def test_credentials_that_no_name_introduces(spark):
    texts = [f"x\n-----BEGIN RSA PRIVATE KEY-----\n{PEM}-----END RSA PRIVATE KEY-----\ny",
             f"-----BEGIN PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC\n\n{PEM}-----END PRIVATE KEY-----",
             f"Authorization: Bearer {JWT}, then", "postgres://user:hunter!pw@db.host/x", "see https://host:8080/path@x and a:b@c",
             "-----BEGIN PRIVATE KEY----- without an end", "-----BEGIN CERTIFICATE-----\nplain words\n-----END CERTIFICATE-----"]
    want = {0: "\n" + PEM, 1: f"\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC\n\n{PEM}", 2: JWT, 3: "hunter!pw"}
    found = secrets.candidates(documents(spark, list(enumerate(texts)))).withColumn("label", secrets.format_label()).collect()
    assert {r["doc_id"]: r["value"] for r in found if r["label"] == 1} == want
    assert all(texts[r["doc_id"]][r["start"]:].startswith(r["value"]) for r in found)
    filler = [(100 + i, f"call 4{i}12345678 or part-{i}00 of order 2024-01-{i % 28 + 1:02d}") for i in range(60)]
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(documents(spark, list(enumerate(texts)) + filler)).collect()}
    assert all(clean[i] == texts[i].replace(v, secrets.MASK) for i, v in want.items())
    assert all(clean[i] == text for i, text in filler)


def test_values_have_no_bound(spark):
    quoted = "a1" + "\\\"" * 5000 + "B!"
    joined = "aB12" + "&x" * 3000 + "&" + "z" * 10
    texts = [f'password="{quoted}" end', f"token={joined},", "token=aB1!cD2.&page=2", "token=aB1!cD2.&&x.) end", "password=.... end", "password='" + "a" * 100_000]
    want = [quoted, joined, "aB1!cD2", "aB1!cD2.&&x", None, "a" * 100_000]
    found = secrets.candidates(documents(spark, list(enumerate(texts)))).collect()
    for i, value in enumerate(want):
        assert [r["value"] for r in found if r["doc_id"] == i] == ([] if value is None else [value]), i


def test_neighbours_and_places_over_many_blocks(spark):
    """Every place and left text of a long text equals what the text holds; the count is beyond several blocks of the running sums."""
    parts = [f"é{'x' * (i % 7)}1234567{i}" + ("," if i % 3 else " = ") for i in range(3 * secrets.BLOCK + 7)]
    text = "".join(parts) + "end"
    found = secrets.candidates(documents(spark, [(1, text), (2, None), (3, ""), (4, "1234567a")])).collect()
    mine = sorted((r["pos"], r["start"], r["value"], r["left"], r["right"]) for r in found if r["doc_id"] == 1)
    spans = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9_+/-])[A-Za-z_+/-]*[0-9][A-Za-z0-9_+/-]{7,}", text)]
    assert mine == [(i, a, text[a:b], text[max(0, a - 48):a][-48:], re.split(secrets_gap, text[b:])[0][:24]) for i, (a, b) in enumerate(spans)]
    assert [(r["start"], r["left"], r["right"]) for r in found if r["doc_id"] == 4] == [(0, "", "")]


secrets_gap = r"(?<![A-Za-z0-9_+/-])[A-Za-z_+/-]*[0-9][A-Za-z0-9_+/-]{7,}"


def test_a_text_of_many_candidates_takes_time_in_proportion(spark):
    made = [k for k in ("AKIA" + hashlib.md5(str(i).encode()).hexdigest()[:16].upper() for i in range(61_000)) if not re.search(r"(.)\1{5}|1234567", k)]
    keys = lambda n: [(1, " ".join(made[:n]))]
    secrets.redacted(documents(spark, keys(100))).count()
    started = time.time()
    n = 60_000
    assert secrets.candidates(documents(spark, keys(n))).count() == n
    assert time.time() - started < 15
    masked = secrets.redacted(documents(spark, keys(20_000) + [(i, f"call 4{i}12345678") for i in range(10, 90)]))
    text = masked.where("doc_id = 1").first()["text"]
    assert text == " ".join([secrets.MASK] * 20_000)
