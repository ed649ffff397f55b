"""Surrogates: they end on every input, are distinct, consistent and keyed; nothing found stays."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.llm import pii


def replaced(spark, texts, key="k", extra=""):
    rows = [(i, t) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), key=key).collect()}


def numbers(text):
    return re.findall(r"\+[\d -]*\d", text)


def test_small_formats_end(spark):
    """All of the code, all values of a format, and a format whose every surrogate is an entity."""
    texts = ["row +4 ------ 4 end"] + [f"call +1 ------ {d} end" for d in range(10)] + [f"id {a}{b}{c}-00-0000" for a in "01" for b in "01" for c in "01"]
    got = replaced(spark, texts)
    assert numbers(got[0].text) and "".join(re.findall(r"[+\d]", got[0].text)) != "+44"
    found = [re.sub(r"\D", "", got[i].text) for i in range(11)]
    assert len(set(found)) == 11 and not set(found) & {"44", *(f"1{d}" for d in range(10))}


def test_every_initial(spark):
    texts = [f"Mr. {c}. Stone spoke." for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    got = replaced(spark, texts)
    first = [got[i].text.split()[1] for i in range(26)]
    assert len(set(first)) == 26 and len({got[i].text.split()[2] for i in range(26)}) == 1


def test_no_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        replaced(spark, ["row +4 ------ 4 end"])


def test_key(spark):
    df = spark.createDataFrame([("email|x@y.zz|0",)], "m string")
    for key in ("k", "a longer key " * 20):
        got = df.select(pii.mac(key, F.col("m")).alias("h")).first().h
        assert got == hmac.new(key.encode(), b"email|x@y.zz|0", hashlib.sha256).hexdigest()
    with pytest.raises(TypeError):
        pii.replace_entities(df)
    a, b = (replaced(spark, ["mail x.yz@mail.example.com now"], key=k)[0].text for k in ("one", "two"))
    assert a != b


MIXED = [
    "Mr. Karl Smith met Smith and Anna Jones. Karl left.",
    "Mrs. Karla Jones; mail karla.jones@site.example.org or KARLA.JONES@site.example.org, call +1 (212) 555-0101.",
    "Call +1-212-555-0101 or +1 212 555 0102. Card 4111 1111 1111 1111, 4111-1111-1111-1111 at 10.0.0.7 and 10.0.0.8.",
    "Г-н Иван Петров и Петров. Herr Otto Braun.",
    "token = 0123456789abcdef0123456789abcdef and 123-45-6789, 123-45-6780. GB29 NWBK 6016 1331 9268 19.",
    None, "", "Nothing to see here, in plain words.", "Mr. Karl Smith met Smith and Anna Jones. Karl left.",
]


def test_properties(spark):
    """By hand of each text's mentions: none stays, one entity has one surrogate everywhere, different entities differ."""
    got = replaced(spark, MIXED)
    assert got[5].text == "" == got[6].text and got[7].text == MIXED[7] and got[0].text == got[8].text
    secret = "Smith Karl karla.jones 555-0101 555-0102 1111 10.0.0.7 10.0.0.8 Петров Иван Otto Braun 0123456789abcdef 123-45 NWBK".split()
    for row in got.values():
        assert not any(re.search(rf"(?i)(?<!\w){re.escape(x)}(?!\w)", row.text) for x in secret), row.text
    words = re.findall(r"[^\W\d_]+", got[0].text)
    assert words[2] == words[4] and words[1] == words[8] and words[1] != words[2]
    mails = re.findall(r"\S+@[\w.]+", got[1].text)
    assert len({m.lower().rstrip(".,") for m in mails}) == 1
    digits = lambda t: re.sub(r"\D", "", t)
    one, other = digits(got[1].text.split("call ")[1]), [digits(x) for x in re.findall(r"\+1[- ()\d]+\d", got[2].text)]
    assert one == other[0] != other[1]
    cards = [digits(x) for x in re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[2].text)]
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(cards[0]))
    assert cards[0] == cards[1] and total % 10 == 0 and "-" in got[2].text.split("Card")[1]
    assert re.search(r"^Г-н [А-Я][а-я]+ ([А-Яа-я]+) и \1\.", got[3].text)


def test_entities_are_distinct_and_consistent(spark):
    kinds = {"email": [f"user{i}@host{i % 7}.example.com" for i in range(200)], "phone": [f"+49{i:04d}" for i in range(300)], "card": [f"4{i:015d}" for i in range(50)], "ssn": [f"12345{i:04d}" for i in range(50)], "ipv4": [f"1.1.1.{i}" for i in range(250)], "family": [f"name{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)], "given_f": [f"anna{chr(97 + i)}" for i in range(26)], "initial": list("abcdefghijklmnopqrstuvwxyz")}
    rows = [(k, n) for k, ns in kinds.items() for n in ns]
    schema = StructType([StructField("kind", StringType()), StructField("norm", StringType())])
    got = [tuple(r) for r in pii.settle(spark.createDataFrame(rows, schema), "k").select("kind", "norm", "sur").collect()]
    assert sorted((k, n) for k, n, _ in got) == sorted(rows)
    by = defaultdict(set)
    for k, n, s in got:
        assert s not in kinds[k], (k, n, s)
        by[k].add(s)
    assert all(len(by[k]) == len(kinds[k]) for k in kinds)
    assert all(s[-1] == "a" for k, _, s in got if k == "given_f")


def test_nulls_repeats_clashing_columns_and_long_texts(spark):
    long = "word " * 200_000 + "mail x@y.example.com " + "word " * 10
    rows = [(None, "mail x@y.example.com", "a"), (None, "mail x@y.example.com", "b"), (1, long, "c"), (1, long, "c"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").selectExpr("*", "1 as mentions", "2 as has", "3 as text_key", "4 as sur", "5 as names")
    got = pii.replace_entities(df, key="k").collect()
    assert len(got) == 5 and sum(r.n_entities for r in got) == 4
    short = {r.text for r in got if r.doc_id is None}
    assert len(short) == 1 and all(len(r.text) > 900_000 and r.text.split("mail ")[1].split()[0] == short.copy().pop().split()[1] for r in got if r.doc_id == 1)
    assert pii.replace_entities(df.limit(0), key="k").count() == 0


def mod97(iban):
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def test_one_name_a_word(spark):
    """Forms of address and places in a mention don't make two persons of one; genders are those of the document."""
    got = replaced(spark, [
        "Mrs. Anna Smith met us. Dr. Anna Smith left. Miss Anna smiled; Anna too.", "Sir Isaac Newton wrote. Sir Isaac slept, and Newton's dog.",
        "Madame Paris lives in Paris. Later Paris sang.", "Prof. Kim Lee and Mr. Lee Marvin; Lee.", "Mr. Robin Hale. Mrs. Robin Hale.",
    ])
    a = re.findall(r"\w+", got[0].text)
    assert a[1] == a[6] == a[10] == a[12] and a[2] == a[7] and len({a[1], a[2], "Anna", "Smith"}) == 4
    assert a[1].lower().endswith(tuple(pii.SYLLABLES["latin"]["given_f"])) and a[2].lower().endswith(tuple(pii.SYLLABLES["latin"]["family"]))
    b = re.findall(r"\w+", got[1].text)
    assert b[1] == b[5] and b[2] == b[8] and b[1].lower().endswith(tuple(pii.SYLLABLES["latin"]["given_m"]))
    c = re.findall(r"\w+", got[2].text)
    assert c[1] == c[6] != "Paris" and c[4] == "Paris"
    d = re.findall(r"\w+", got[3].text)
    assert d[2] == d[5] == d[7]
    e = re.findall(r"\w+", got[4].text)
    assert e[1] == e[4] and e[2] == e[5] and [got[i].n_entities for i in range(5)] == [4, 3, 2, 3, 2]


def test_accounts_and_cards(spark):
    accounts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR7630006000011234567890189", "NL91 ABNA 0417 1643 00"]
    assert all(mod97(a) == 1 for a in accounts)
    kept = ["1059743005344", "9783161484100", "0883958382058010", "4429820930819526"]
    cards = ["4429820930819525", "4111 1111 1111 1111", "3782-822463-10005", "1234 5678 9012 3456"]
    got = replaced(spark, [f"pay {x} now" for x in accounts + kept + cards])
    new = [got[i].text[4:-4] for i in range(12)]
    for old, sur in zip(accounts, new[:4], strict=True):
        assert sur != old and sur[:2] == old[:2] and mod97(sur) == 1 and [c.isdigit() for c in sur[4:]] == [c.isdigit() for c in old[4:]]
    assert new[4:8] == kept and all(got[i].n_entities == 0 and got[i].kinds == "" for i in range(4, 8))
    for old, sur in zip(cards, new[8:], strict=True):
        assert sur != old and re.sub(r"\d", "0", sur) == re.sub(r"\d", "0", old)
        assert (luhn(re.sub(r"\D", "", old)) == 0) <= (luhn(re.sub(r"\D", "", sur)) == 0)
