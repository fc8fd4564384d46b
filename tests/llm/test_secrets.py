import hashlib
import random
import re

from tests.llm.helpers import documents
from tidemark.llm import secrets


def expected(text):
    text = text or ""
    out = []
    assign = re.compile(r"""(?a)(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()


TEXTS = [
    "", None, "token = 'abcdef'", "token=token:abcdefgh", "PassWord : xyz", "api_key=ABCDEFG api-key=no apikey: \"0123456789\"", "x" * 50000 + "😀secret=hunter22" + "é" * 30000,
    "AKIA" + "A" * 16, "AKIAAKIAAKIA" + "B" * 8, "AKIA" + "A" * 15, "xAKIA" + "Z9" * 20 + "x", "0" * 24, "g" + "af09" * 6 + "z", "0" * 23, "ABCDEF" * 9, "token=" + "ab12" * 10,
    "-----BEGIN RSA PRIVATE KEY-----", "secret=\nabcdefg", "secret=  'a.b-c_d/e+f='", "ſecret=abcdefgh", "toKen=abcdef", "token=abcdefg " * 40,
]


def test_many_matches_in_one_text(spark):
    """More matches than one step of the walk takes, and names of other columns that clash."""
    texts = ["é token=abcdefg, " * 700, "0123456789abcdef01234567 " * 256, "0123456789abcdef01234567 " * 257 + "secret: abcdefgh"]
    docs = documents(spark, texts).withColumnRenamed("lang", "path").withColumnRenamed("source", "blob").withColumnRenamed("n_chars", "findings")
    found, _ = secrets.scan(docs)
    rows = {r["path"]: r["all"] for r in found.select("path", secrets.joined(["assign", "access", "hex"]).alias("all")).collect()}
    assert rows == {i: ",".join(f"{k}:{a}:{b}" for a, _, k, b in expected(t)) for i, t in enumerate(texts)}


def test_findings(spark):
    rng = random.Random(3)
    alphabet = ["token", "secret", "=", ":", " ", '"', "'", "AKIA", "0123abcd", "F", "deadbeef", "zz", "é", "-", "\n"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(150)] + TEXTS[:6]
    found, _ = secrets.scan(documents(spark, texts))
    rows = found.select("path", secrets.joined(["assign", "access", "hex"]).alias("base"), secrets.joined([r.kind for r in secrets.RULES]).alias("all")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in expected(texts[r["path"]]))
        assert r["base"] == want, texts[r["path"]][:80]
    assert any("pem" in r["all"] for r in rows)


def test_ledger(spark):
    docs = documents(spark, ["token=abcdefg", "token=abcdefg", "plain", None])
    found, ledger = secrets.scan(docs)
    assert ledger.select("blob").distinct().count() == 3 and ledger.count() == 3 * len(secrets.RULES)
    more = documents(spark, ["token=abcdefg", "secret=1234567"], 10)
    again, fresh = secrets.scan(more, ledger)
    assert fresh.select("blob").distinct().count() == 1
    assert {r["path"]: r["findings"].get("assign") for r in again.collect()}.keys() == {10, 11}
    assert all(r["findings"].get("assign") for r in again.collect())
    newer = tuple(secrets.SecretRule(r.kind, r.pattern, r.group, r.least, 2 if r.kind == "hex" else 1) for r in secrets.RULES)
    _, fresh = secrets.scan(more, ledger, newer)
    assert sorted((r["kind"], r["n"]) for r in fresh.groupBy("kind").count().withColumnRenamed("count", "n").collect()) == [("access", 1), ("assign", 1), ("hex", 2), ("jwt", 1), ("pem", 1)]


def test_null_ids_and_empty(spark):
    found, _ = secrets.scan(documents(spark, [("token=abcdefg",), "x", ("token=abcdefg",)]))
    assert sorted((r["path"] is None, len(r["findings"])) for r in found.collect()) == [(False, 0), (True, 1), (True, 1)]
    found, ledger = secrets.scan(documents(spark, ["x"]).limit(0))
    assert found.count() == ledger.count() == 0
