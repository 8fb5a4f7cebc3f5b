"""Pseudonyms: values in every printed form, nothing of a secret left, one-to-one across written dates."""

import datetime as dt
import re

from pyspark.sql import functions as F

from workpanel.llm.pii import pseudonymise


def hidden(spark, texts, key="key"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pseudonymise(df, key).orderBy("doc_id").collect()]


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_printed_accounts_cards_and_timestamps(spark):
    got = hidden(spark, ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19 WITH CARE", "3782 822463 10005",
                         "378282246310005", "at 2024-01-31T10:00:00Z", "2024-01-31", "DE89 3704 0044 0532 0130 01", "ABCD 1234 5678 NOTE"])
    assert got[0].replace(" ", "") == got[1] != "DE89370400440532013000" and mod97(got[1]) == 1 and re.fullmatch(r"DE\d\d(?: \d{4}){4} \d\d", got[0])
    uk = re.fullmatch(r"(GB\d\d NWBK \d{4} \d{4} \d{4} \d\d) WITH CARE", got[2])[1]
    assert mod97(uk.replace(" ", "")) == 1 and "6016 1331" not in uk
    assert got[3].replace(" ", "") == got[4] != "378282246310005" and re.fullmatch(r"\d{4} \d{6} \d{5}", got[3])
    assert got[5] == f"at {got[6]}T10:00:00Z" and got[6] != "2024-01-31"
    assert got[7:] == ["DE89 3704 0044 0532 0130 01", "ABCD 1234 5678 NOTE"]


def test_nothing_of_a_secret_stays(spark):
    long, dotted = "Ab1" * 5000, ".".join(["eyJhbGciOiJIUzI1NiJ9", "payloadpayload_12", "sig-nature+99"])
    got = hidden(spark, [f"token={long} end", f"api_key: {dotted}.", f"again secret = {dotted}", "token=short"])
    assert re.fullmatch(rf"token=[0-9a-f]{{{len(long)}}} end", got[0]) and len(set(re.findall(".{128}", got[0][6:-4]))) == len(long) // 128
    assert re.fullmatch(rf"api_key: ([0-9a-f]{{{len(dotted)}}})\.", got[1]) and got[1][9:-1] == got[2][15:] and got[3] == "token=short"


def test_dates_meet_nowhere(spark):
    days = [dt.date(1999, 1, 1) + dt.timedelta(k) for k in range(1500)]
    texts = [d.strftime("%d/%m/%Y") for d in days] + [d.strftime("%m/%d/%Y") for d in days if d.day > 12]
    got = hidden(spark, texts)
    assert len(set(got)) == len(set(texts)) == len(texts)
    assert all(dt.datetime.strptime(x, "%d/%m/%Y") for x in got[:len(days)])
    assert all(dt.datetime.strptime(x, "%m/%d/%Y").day > 12 for x in got[len(days):])


def test_numbers_stay_valid_and_one_to_one(spark):
    texts = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in range(1, 200)]
    got = hidden(spark, texts)
    assert len(set(got)) == len(texts) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in got)
    mails = hidden(spark, [f"a{k}@b.org" for k in range(500)])
    assert len(set(mails)) == 500 and all(re.fullmatch(r"user\d{19}@mail\.invalid", x) for x in mails)


def test_clashing_names_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(1, "ip 10.0.0.1", "a", "b")] * 3 + [(None, None, None, None)], "doc_id long, text string, _found string, _MADE string")
    got = pseudonymise(df, "k").collect()
    assert len(got) == 4 and [c for c in pseudonymise(df, "k").columns] == ["doc_id", "text", "_found", "_MADE", "n_pseudonyms"]
    assert len({r["text"] for r in got if r["text"]}) == 1 and sorted(r["_found"] or "" for r in got) == ["", "a", "a", "a"]
    assert pseudonymise(df.filter(F.lit(False)), "k").count() == 0
