import hashlib
import random
import re

from pyspark.sql import functions as F

from locusgrid.llm import pii as P

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def checksum(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else None,
            "card": 14 <= len(digits) <= 19 and checksum(digits), "phone": 10 <= len(digits) <= 15}[kind]


def slow(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(PATTERNS.items())
             for m in p.finditer(text or "") if holds(kind, m[0])]
    return [f"{k}:{a}:{z}" for a, _, z, k in sorted(found)]


TEXTS = [
    None, "", "é 東 a@b.c, x@y z@@w.q a@b.c_d@e.f. a@b.c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.255 1.2.3.4567",
    "4111 1111-1111 1111 4111111111111112 +1 (555) 123-4567.", "4111111111111111" * 3, "+1 23 +49 (30) 1234567890",
    "x@y.z," * 200 + "12 " * 300, "+" * 50 + "1234567890", "user@1.2.3.4 1.2.3.4@host.org",
    "." * 2000 + "@" + "a." * 2000, "5" * 3000 + "." + "6" * 3000, "00000000000000000000255.1.1.1",
]


def test_fixed_kinds_match_brute_force(spark, docs):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choices(list("1234567890") + list("aé.@+- ()_"), k=r.randint(0, 200))) for _ in range(300)]
    rows = list(enumerate(texts))
    found = P.chosen_spans(P.with_spans(docs(rows).select("doc_id", "text")), [], {})
    got = found.select("doc_id", P.written(F.col("_spans")).alias("spans")).collect()
    for x in got:
        assert x.spans == ",".join(slow(texts[x.doc_id])), texts[x.doc_id]


def test_find_and_redact(spark, docs):
    r = random.Random(2)
    rows = []
    for i in range(300):
        word = "".join(r.choices("abcdef0123456789", k=20)) + "a1"
        rows.append((i, f"say token = \"{word}\" twice" if i % 3 == 0 else f"plain {word} here +1 555 123 45{i:03}"))
    rows += [(900, None), (901, ""), (901, ""), (None, "me@mail.example.com")]
    got = {x.doc_id: x for x in P.find(docs(rows)).collect()}
    assert P.find(docs(rows)).count() == len(rows)
    for i, text in rows:
        base = slow(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i].spans.split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(b.startswith(k) for b in base) for k in PATTERNS]
    assert all("secret:" in got[i].spans or slow(rows[i][1]) for i in range(0, 300, 3))
    assert not any("secret:" in got[i].spans for i in range(300) if i % 3)
    changed = P.redact(docs(rows))
    new = {x.doc_id: x for x in changed.collect()}
    assert changed.columns == docs(rows).columns and new[900].text is None and new[901].text == ""
    assert new[None].text == "[EMAIL]" and new[None].n_chars == 7
    assert new[0].text == 'say token = "[SECRET]" twice' and "[PHONE]" in new[1].text
    assert P.find(docs([])).count() == 0 and P.redact(docs([])).count() == 0


def test_trees_learn_a_threshold(spark):
    rows = [(*[0] * len(P.FEATURES), 0, i % 5) for i in range(50)] + [
        (20, *[0] * (len(P.FEATURES) - 1), 1, i % 5) for i in range(50)]
    sample = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in P.FEATURES) + ", label int, fold long")
    trees = P.boost(sample, 3)
    assert trees[0][0][0] == "digits" and P.thresholds(sample, trees)["number"] > -1
    assert P.boost(sample.filter("false"), 3) == [] and P.thresholds(sample.filter("false"), trees)["secret"] > 1e9


def test_numbers_outside_fixed_spans_are_added(spark, docs):
    named = ["Phone: 555-{0:03}-4567", "card no. 4000.1234.{0:04}.1", "IBAN DE89 3704 0044 0532 01{0:04}"]
    others = ["order 7301{0:03}-55", "ref 12-{0:05}-9", "call me at +1 555 123 45{0:03}", "build 20240131{0:03}"]
    rows = [(i, f"see {(named + others)[i % 7].format(i)} there") for i in range(700)]
    got = {x.doc_id: x for x in P.find(docs(rows)).collect()}
    for i, text in rows:
        assert ("number:" in got[i].spans) == (i % 7 < 3 and not slow(text)), (text, got[i].spans)
    assert not slow(rows[0][1]) and "number:" in got[0].spans
    assert not {"plus", "luhn"} & set(P.FEATURES)


def test_the_sample_is_bounded_where_ids_repeat(spark):
    rows = [(5, f"text {i}") for i in range(300)] + [(i, "b") for i in range(10, 20)] + [(None, "c")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.sample(df, train_docs=4).collect()
    assert len(got) == len({r["_id"] for r in got}) == 4
    assert P.sample(df.filter("doc_id = 5"), train_docs=4).collect() == [(5, "text 0")]


def test_thresholds_come_from_all_documents(spark, docs):
    # Credentials only in documents that no sample of 4,000 has.
    ids = [r.id for r in spark.range(6000).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, f"say token = \"a1b2c3d4e5f6{i:04}\" now" if n >= 5000 else f"Phone: 555-{i:04}-4567") for n, i in enumerate(ids)]
    plain = P.candidates(P.with_spans(docs(rows).select("text"))).cache()
    counted = P.counted(plain)
    assert counted.count() < 100 and counted.agg(F.sum("n")).first()[0] == plain.count()
    trees, cuts = P.learn(docs(rows))
    assert cuts["secret"] < float("inf") and P.thresholds(plain.filter("fold = 0 and free"), trees) == cuts


def test_redaction_uses_thresholds_of_all_documents(spark, docs):
    ids = [r.id for r in spark.range(6000).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, f"say token = \"a1b2c3d4e5f6{i:04}\" now" if n >= 5000 else f"Phone: 555-{i:04}-4567" if n % 2 else f"order 7301{i:04}-55") for n, i in enumerate(ids)]
    got = [x.text for x in P.redact(docs(rows)).collect() if x.text.startswith("say")]
    assert len(got) == 1000 and set(got) == {"say token = \"[SECRET]\" now"}, sorted(set(got))[:3]
