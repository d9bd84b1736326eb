import hashlib
import random
import re

from fieldloom.llm import pii
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def keeps(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and pii.luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text) if keeps(k, m[0])]


AUTOMATON = pii.anchors()
PIECES = st.sampled_from(["@", ".", "-", "+", " ", "(", ")", "a", "Z", "_", "%", "é", "😀", "0", "1", "25", "192.168.0.1", "4111111111111111", "4111 1111-1111 1111", "+49 30 123456", "x.y@b-c.de", "://", "٣", "\n", "iban ", "0000256"])


@given(st.lists(PIECES, max_size=25).map("".join))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.spans_of(text, AUTOMATON) if s[0] in BASE] == brute(text)


def test_added_kinds():
    text = "kONto: DE89 3704 0044 0532 0130 00, see https://u:p@ex.org/a?b=1). account no. 12-345-678; accounts of 1999"
    got = [(k, text[a:b]) for k, a, b in pii.spans_of(text, AUTOMATON) if k not in BASE]
    assert got == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "12-345-678"), ("url", "https://u:p@ex.org/a?b=1")]
    one = lambda t: [(k, t[a:b]) for k, a, b in pii.spans_of(t, AUTOMATON) if k not in BASE]
    assert one("İban gb82 west 1234 5698 7654 32.") == []  # folded by ASCII only where lower case is longer
    assert one("IBAN gb82 west 1234 5698 7654 32.") == [("account", "gb82 west 1234 5698 7654 32")]
    assert one("IBAN GB82 WEST 1234 5698 7654 33") == one("IBAN GB82 WEST 1234 5698 7654 3") == one("IBAN ZZ82 1234 5678") == []
    assert one("SSN: 123-45-6789 and ssn 666-45-6789, ssn 123-00-6789") == [("account", "123-45-6789")]
    assert one("Passport no. C01X00T47, passport office") == [("account", "C01X00T47")]
    assert one('my token = "04dbebab91ab85687d33eeaaf9ac"; API_KEY: sk-1234567890abcd, the secret of life, tokens are abcdefabcdefabcd') == [("secret", "04dbebab91ab85687d33eeaaf9ac"), ("secret", "sk-1234567890abcd")]


def test_recall_of_all_spans(spark):
    rng = random.Random(6)
    made = {
        "email": lambda: f"user{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "phone": lambda: f"+49 30 {rng.randrange(10**6, 10**7)}",
        "url": lambda: f"https://ex{rng.randrange(99)}.org/p",
        "secret": lambda: f'token = "{rng.getrandbits(160):040x}"',
        "account": lambda: f"Iban DE{98 - int(f'{(n := rng.randrange(10**17, 10**18))}131400') % 97:02d}{n}",
    }
    docs = [(i, f"Some words {made[k]()} and others", k) for i, k in enumerate(list(made) * 50)] + [(10**6 + i, "Only plain words of 3 or 4 letters, a token of thanks", None) for i in range(50)]
    rows = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string, kind string")).collect()
    kinds = {r.doc_id: {s.kind for s in r.spans} for r in rows}
    assert all(k in kinds[i] if k else not kinds[i] for i, _, k in docs)


def test_whole_table_and_edges(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "a@b.co"), (-1, None), (-2, ""), (-3, "9" * 3000), (-4, "1." * 3000), (-5, "a@" * 3000), (-6, "dup a@b.co"), (-6, "dup a@b.co")], "doc_id long, text string")
    docs = table.union(extra).selectExpr("doc_id", "text", "'clash' AS spans")
    rows = pii.digests(pii.find_pii(docs)).collect()
    want = sorted((repr(d), t or "") for d, t in docs.select("doc_id", "text").collect())
    assert len(rows) == len(want)
    expected = sorted((d, [sum(k == b for k, *_ in brute(t)) for b in BASE], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest()) for d, t in want)
    assert sorted((repr(r.doc_id), [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in rows) == expected
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or 10.0.0.1", "k"), (2, None, None)], "doc_id long, text string, spans string")
    twice = pii.redact(docs.union(docs.where("doc_id = 1")).withColumn("start", F.lit(7)))
    assert twice.count() == 3 and twice.columns == ["doc_id", "text", "spans", "start"] and pii.redact(docs.limit(0)).count() == 0
    assert [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "mail [email] or [ip]", "k"), (2, None, None)]
