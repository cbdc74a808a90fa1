"""Personal data in the spellings that real tables have."""

import re

import pytest
from pyspark.sql import functions as F

from dyadloom.llm import pii

HEX = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"


def test_capital_secrets_and_telephones_before_addresses(spark):
    texts = [f'TOKEN = "{HEX.upper()}"', f"token {HEX}", "+1 (826) 555-4081 190.137.223.204", "call +1 (826) 555-4081.", "+16635556869 10.1.2.3", "+33 1 42.68.53.10 now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, mapping = pii.replace(docs, "k")
    out = {r.row.doc_id: r.row.text for r in rows.collect()}
    kinds = {r.found: r.kind for r in mapping.collect()}
    assert kinds == {HEX.upper(): "secret", HEX: "secret", "+1 (826) 555-4081": "phone", "190.137.223.204": "ip", "+16635556869": "phone", "10.1.2.3": "ip", "+33 1 42.68.53.10": "phone"}
    capital, small = re.search('"([0-9A-F]{40})"', out[0])[1], out[1].split()[1]
    assert capital.lower() == small != HEX
    assert out[2].rsplit(" ", 1)[0] == out[3].removeprefix("call ").removesuffix(".") != "+1 (826) 555-4081"
    assert not any(part in out[2] + out[4] for part in ("223.204", "10.1.2.3", "6635556869"))


def test_nothing_found_survives_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, _ = pii.replace(docs, "k")
    # plain patterns of our own, not the module's
    plain = r"[A-Za-z0-9.]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\b[0-9a-fA-F]{40}\b|\bAKIA[0-9A-Z]{16}\b|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
    found = lambda df, c: {r.x.lower() for r in df.select(F.explode(F.regexp_extract_all(F.col(c), F.lit(plain), F.lit(0))).alias("x")).distinct().collect()}
    before = found(docs, "text")
    assert before and not before & found(rows.select("row.text"), "text")


def _after(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.row.text for r in sorted(pii.replace(docs, key)[0].collect(), key=lambda r: r.row.doc_id)]


def test_people_in_all_their_mentions(spark):
    texts = [
        "Mr John Smith came. Mr Smith left; Smith and John are one. MR JOHN SMITH shouted.", "Mrs Smith is his wife.", "Alice Johnson wrote to Γιώργος Παπαδόπουλος.",
        "Dr. 王小明 and 李明先生", "The Market opened. Smith is nobody here.",
    ]
    out = _after(spark, texts)
    given, family = re.match(r"Mr (\w+) (\w+) came", out[0]).groups()
    assert out[0] == f"Mr {given} {family} came. Mr {family} left; {family} and {given} are one. MR {given.upper()} {family.upper()} shouted."
    assert out[1] == f"Mrs {family} is his wife." and {given, family}.isdisjoint({"John", "Smith"})
    assert not re.search("Alice|Johnson|Γιώργος|Παπαδόπουλος", out[2]) and re.search(r"to [\u0370-\u03ff]+ς [\u0370-\u03ff]+\.", out[2])
    assert not re.search("王小明|李明", out[3]) and re.fullmatch(r"Dr\. [\u4e00-\u9fff]{3} and [\u4e00-\u9fff]{2}先生", out[3])
    assert out[4] == texts[4]
    assert _after(spark, texts) == out != _after(spark, texts, "another")


def _mod97(account):
    a = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97


def test_formats_and_check_digits(spark):
    texts = [
        "+1 (663) 555-6869", "(663) 555-6869", "192.168.0.1 172.20.1.1 10.0.0.7 8.8.8.8", "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 33",
        "4111111111111111 4111111111111112", "2001:db8::ff00:42:8329 at 10:30:45", "fe80:0:0:0:202:b3ff:fe1e:8329",
    ]
    out = _after(spark, texts)
    assert re.sub(r"\D", "", out[0])[1:] == re.sub(r"\D", "", out[1]) != "6635556869" and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", out[1])
    a, b, c, d = out[2].split()
    assert a.startswith("192.168.") and re.match(r"172\.(1[6-9]|2\d|3[01])\.", b) and c.startswith("10.") and not d.startswith(("10.", "127.", "192.168.", "172.")) and not set(out[2].split()) & set(texts[2].split())
    spaced, plain = out[3].split(" and ")
    assert spaced.replace(" ", "") == plain != "GB82WEST12345698765432" and _mod97(plain) == 1 and plain[:2] == "GB"
    assert out[4] == texts[4]  # check digits that do not hold: no account
    card, number = out[5].split()
    assert number == "4111111111111112" and card != "4111111111111111" and sum((int(x) * (1 + k % 2)) - 9 * (int(x) * (1 + k % 2) > 9) for k, x in enumerate(reversed(card))) % 10 == 0
    assert "8329" not in out[6] and out[6].endswith(" at 10:30:45") and "::" in out[6] and "b3ff" not in out[7]


def test_hard_rows(spark):
    rows = [(None, "Mr John Smith a@b.example.com", 1, "x"), (None, None, None, None), (1, "", 0, "y"), (1, "a@b.example.com " + "w " * 200_000 + "a@b.example.com", 5, None), (1, "a@b.example.com", 5, "z"), (1, "a@b.example.com", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, found string")
    out = pii.replace(docs, "k")[0].select("row.*").collect()
    assert out[0].__fields__ == docs.columns and len(out) == len(rows)
    assert not any("a@b.example.com" in (r.text or "") for r in out) and all(r.n_chars == (len(r.text) if r.text else r.n_chars) for r in out)
    alike = [r.text for r in out if r.found == "z"]
    assert alike[0] == alike[1] and sum(alike[0] in (r.text or "") for r in out) == 4
    with pytest.raises(ValueError):
        pii.replace(docs, "")
