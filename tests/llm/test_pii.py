import re

import pytest
from pyspark.sql import functions as F

from gradelattice.llm import pii

ROWS = [
    (1, "Mail a.b+c@mail.example.com, or A.B+C@MAIL.EXAMPLE.COM! Also x@other.org."),
    (2, "call +1 (017) 555-7713 or +1-017-555-7713; not 555-7713"),
    (3, "card 4539578763621486 and 4539 5787 6362 1486, ip 10.0.0.255. v1.2.3.4.5"),
    (4, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" ssn 078-05-1120 DE89 3704 0044 0532 0130 00'),
    (5, "Mr. John Smith met Mrs. Smith and Herr Anna; господин Иванов и госпожа Анна Иванова"),
    (6, None), (7, ""), (8, "clean text, version 2.0, 1234 & $1 \\1"), (None, "x@other.org"), (1, "x@other.org"), (1, "x@other.org"),
    (9, "filler words here " * 8000 + "x@other.org"), (10, "a@b.co" * 1 + " c@b.co d@b.co"),
]


@pytest.fixture(scope="module")
def done(spark):
    docs = spark.createDataFrame([(i, t, "q", 5) for i, t in ROWS], "doc_id bigint, text string, row_ string, n bigint")
    return docs, [r for r in pii.pseudonymise(docs, count_into="n").collect()]


def of(rows, i):
    return [r.text for r in rows if r.doc_id == i]


def test_rows_and_columns(done):
    docs, rows = done
    assert len(rows) == len(ROWS) and rows[0].__fields__ == ["doc_id", "text", "row_", "n"]
    assert of(rows, 6) == [None] and of(rows, 7) == [""] and of(rows, 8) == [ROWS[7][1]]
    assert [r.n for r in rows if r.doc_id == 5] == [5] and [r.n for r in rows if r.doc_id == 8] == [0]


def test_coreference_format_and_distinctness(done):
    _, rows = done
    mail = re.findall(r"\S+@[\w.]+\w", of(rows, 1)[0]) if "Mail" in of(rows, 1)[0] else re.findall(r"\S+@[\w.]+\w", [t for t in of(rows, 1) if "Mail" in t][0])
    assert mail[0].upper() == mail[1] and mail[0] != "a.b+c@mail.example.com" and mail[0].endswith(".example.com") and re.fullmatch(r"[a-z]\.[a-z]\+[a-z]@[a-z]{4}\.example\.com", mail[0])
    other = {t for t in of(rows, 1) if "Mail" not in t} | set(of(rows, None)) | {of(rows, 9)[0].split()[-1]} | {mail[2]}
    assert len(other) == 1 and other != {"x@other.org"}
    phones = re.findall(r"\+[\d ()-]+\d", of(rows, 2)[0])
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0]) and of(rows, 2)[0].endswith("not 555-7713")
    text = of(rows, 3)[0]
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", text)
    digits = cards[0]
    assert digits == cards[1].replace(" ", "") != "4539578763621486" and digits[0] == "4" and text.endswith("v1.2.3.4.5") and "10.0.0.255" not in text
    doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    assert sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    assert re.fullmatch(r'token = "[0-9a-f]{40}" ssn \d{3}-\d{2}-\d{4} DE\d\d( \d{4}){4} \d\d', of(rows, 4)[0])
    assert len(set(of(rows, 10)[0].split())) == 3


def test_names_keep_gender_script_and_family(done):
    _, rows = done
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) and Herr (\w+); господин (\w+) и госпожа (\w+) (\w+)", of(rows, 5)[0])
    given, smith, smith2, anna, ivanov, given_f, ivanova = m.groups()
    assert smith == smith2 != "Smith" and not given.endswith("a") and given_f.endswith("а") and ivanov != ivanova
    assert all(re.fullmatch("[А-Я][а-я]+", x) for x in (ivanov, given_f, ivanova)) and re.fullmatch("[A-Z][a-z]+", given)


def test_nothing_found_remains(done, spark):
    docs, rows = done
    find = lambda ts: {m for t in ts if t for m in re.findall(r"[\w.+]+@[\w.]+\w|\d{16}|[0-9a-f]{40}|\d{3}-\d{2}-\d{4}", t)}
    assert not find(t for _, t in ROWS) & find(r.text for r in rows)


def test_collisions_are_drawn_again(spark):
    values = spark.range(9_000).select(F.lit("ssn").alias("kind"), F.format_string("%04d", "id").alias("value"))
    got = pii._dictionary(values, "k").toPandas()
    assert got.surrogate.is_unique and not set(got.value) & set(got.surrogate)


def test_repeatable_and_keyed(spark):
    docs = spark.createDataFrame([(1, "x@other.org 10.1.2.3")], "doc_id bigint, text string")
    texts = [pii.pseudonymise(docs, key=k).first().text for k in ("a", "a", "b")]
    assert texts[0] == texts[1] != texts[2] and pii.pseudonymise(docs).columns == docs.columns
    assert pii.pseudonymise(docs.limit(0)).count() == 0


def test_domains_with_little_to_draw_are_settled(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = ["x@-.-", "a@--.com", "a@\u0663.com", "\u0663\u0664@\u00b2-\u00bd.org", *(f"me@{c}.com" for c in letters)]
    docs = spark.createDataFrame(list(enumerate(mails)), "doc_id bigint, text string")
    domain = {mails[r.doc_id].split("@")[1]: r.text.split("@")[1] for r in pii.pseudonymise(docs).collect()}
    assert len(domain) == len(set(domain.values())) == len(mails) and not set(domain) & set(domain.values())
    assert all(new.rsplit(".", 1)[1] == old.rsplit(".", 1)[1] and re.fullmatch(r"[a-z0-9.-]+", new) for old, new in domain.items())
    assert all("\u0663" not in r.text for r in pii.pseudonymise(docs).collect())


def test_addresses_grow_when_their_format_is_taken(spark):
    row = spark.range(1).select(F.lit("ip").alias("kind"), F.lit("10.1.2.3").alias("value"), F.lit(pii.LENGTHEN + 3).alias("draw"))
    stream = pii._drawn(F.col("kind"), F.col("value"), F.col("draw"), "k")
    assert re.fullmatch(r"(\d+\.){4}\d{3}", row.select(pii._surrogate(F.col("kind"), F.col("value"), F.col("draw"), stream)).first()[0])


def changed(spark, text):
    return pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().text


def test_names_recur_without_their_title(spark):
    text = "Mr. Abel Stone called. Later Stone said that Abel agreed. Stonehenge stood; stone fell. Abel Stone left, Abel-Stone's too."
    got = changed(spark, text)
    given, family = re.match(r"Mr\. (\w+) (\w+) called", got).groups()
    assert got == text.replace("Abel", given).replace("Stonehenge", "#").replace("Stone", family).replace("#", "Stonehenge")
    assert "Abel" not in got and not re.search(r"\bStone\b", got)
    other = changed(spark, "Stone and Abel are no names here, write to a@b.com")
    assert other.startswith("Stone and Abel are no names here")


def test_country_codes_and_account_checks(spark):
    for number, code in (("+44 20 7946 0958", "+44 "), ("+1 212 555 0100", "+1 "), ("+353 21 555 0100", "+353 "), ("+4915112345678", "+49")):
        got = changed(spark, f"call {number} now")
        assert got.startswith(f"call {code}") and got != f"call {number} now" and len(got) == len(f"call {number} now")
    same = changed(spark, "+44 20 7946 0958 or +442079460958").split(" or ")
    assert re.sub(r"\D", "", same[0]) == re.sub(r"\D", "", same[1])

    def valid(iban):
        moved = re.sub(" ", "", iban)[4:] + re.sub(" ", "", iban)[:4]
        return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    for iban in ("DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"):
        got = changed(spark, f"to {iban}.")[3:-1]
        assert valid(iban) and valid(got) and got != iban and got[:2] == iban[:2]


def test_the_key_is_the_callers(spark):
    docs = spark.createDataFrame([(1, "mail jo@host.com")], "doc_id bigint, text string")
    texts = {k: pii.pseudonymise(docs, key=k).first().text for k in (None, "a", "b")}
    assert len(set(texts.values())) == 3
    spark.conf.set(pii.KEY_SETTING, "a")
    try:
        assert pii.pseudonymise(docs).first().text == texts["a"]
    finally:
        spark.conf.unset(pii.KEY_SETTING)
