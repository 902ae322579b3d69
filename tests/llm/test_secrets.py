import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from sumfold.llm import secrets
from tests.llm.helpers import frame, odd_texts, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


TRICKY = [
    "password=abc token: 'abcdef123' api_key = \"Zz9/+=._-\" APIKEY:short1", "secret=token : abcdef99", "AKIAAKIA" + "Z9" * 12, "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "x" + "0a" * 12 + "g" + "f" * 23,
    "😀 token=ünicode secret: ééé password = aaaaaa", "token=" + "a" * 5000, "Password : hunter2 " * 300, "TOKEN='" + "0f" * 20 + "'", "passwd:=abcdefg", "api__key=abcdefgh", "token" + " " * 50 + "=" + " " * 50 + "abcdefg",
]


@pytest.fixture(scope="module")
def llr(spark):
    docs = frame(spark, [prose(60, s) for s in range(60)])
    return secrets.train(secrets.labelled_samples(docs, strings=800))


def test_base_spans_equal_brute_force(spark, llr):
    texts = [*odd_texts(), *TRICKY]
    rng = random.Random(3)
    texts += ["".join(rng.choice(["token", "=", " ", "abc", "09af", "AKIA", "Z" * 9, ":", "'", "é", "\n", "secret", "deadbeef"]) for _ in range(60)) for _ in range(60)]
    found = secrets.scan(frame(spark, texts), llr)
    own = F.filter("secret_spans", lambda s: s["kind"] < 3)
    rows = found.select("text", "secret_spans", F.sha2(secrets.joined(own), 256).alias("d")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(r.text or "")
        assert [(s.start, s.kind, s.end) for s in r.secret_spans if s.kind < 3] == want and r.d == digest(want)


def test_markov_finds_random_strings_only(spark, llr):
    rng = random.Random(11)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_uppercase + string.digits]
    hidden = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(24, 40))) for _ in range(40)]
    texts = [prose(20, s) + " " + h + " " + prose(20, s + 1) for s, h in enumerate(hidden)]
    plain = [prose(40, 900 + s) + " riverStoneGarden get_morning_letter_id2 winter-2024-01-30/market 2024-01-30-12-00-00" for s in range(40)]
    rows = {r.doc_id: r for r in secrets.scan(frame(spark, texts + plain), llr).collect()}
    hit = 0
    for i, h in enumerate(hidden):
        at = texts[i].index(h)
        hit += any(s.start <= at and s.end >= at + len(h) for s in rows[i].secret_spans)
    assert hit >= 38
    assert sum(len(rows[len(texts) + s].secret_spans) for s in range(40)) == 0


def test_redaction(spark, llr):
    texts = [*odd_texts(), *TRICKY, "a token=abcdef12 b " + "0f" * 20 + " c"]
    found = secrets.scan(frame(spark, texts), llr)
    for r in found.select("text", "secret_spans", secrets.redacted(F.col("text"), F.col("secret_spans")).alias("out")).collect():
        if r.text is None:
            assert r.out is None
            continue
        want, at = "", 0
        for s in r.secret_spans:
            if s.start >= at:
                want += r.text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert r.out == want + r.text[at:]


def test_no_documents(spark):
    docs = frame(spark, [])
    assert secrets.scan(docs, secrets.train(secrets.labelled_samples(docs, strings=10))).collect() == []


def test_samples_with_nulls(spark):
    rows = spark.createDataFrame([("abc", True), (None, True), ("x", False), ("ab", None), ("the", False)], "string string, secret boolean")
    assert len(secrets.train(rows)) == len(secrets.ALPHABET) ** 2
