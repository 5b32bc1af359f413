import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import pii, queries

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(x):
    total = 0
    for k, c in enumerate(reversed(x)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain(t):
    """The base spans by Python's own patterns."""
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15)
            if good:
                out.append((m.start(), n, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


CARD, OTHER = "4111111111111111", "5500005555555559"
ODD = [
    None, "", "x", "a.b@c.d e@f a@b..c a@b.c. @a.b x@y.z@w.v a_b@c-d.e_f@g.h %@1.2", "😀é a@b.c 😀", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.0255.1 1.2.3 1..2.3.4 0.0.0.0 00000000300.1.1.1",
    CARD, f"{CARD} {OTHER}", f"x{CARD}y", "4111 1111 1111 1111", "4111-1111-1111 1111", "4111  1111 1111 1111", f"+{CARD}", "0" * 14, "0" * 19, "0" * 20, f"{CARD}-", f" {CARD} 9", "1 2 3 4 5 6 7 8 9 0 1 2 3 4",
    "+1 (743) 555-3824", "+1 (743) 555-3824 1.2.3.4", "+1 (2) ", "++1234567890", "+1.234.567.8901.", "+12-", "+1 (269) 555-3296 4524132264652876 x", "+123456789012345+1234567890", " a@b.c 1.2.3.4", "ab@cd 12",
    "1" * 5000, "1 " * 5000, "1.2.3.4 " * 700, "a." * 4000 + "@b.c", "a@" + "b." * 4000 + "c", "+1 " * 3000, "a" * 9000 + "@b.c", "\n".join(["a@b.c", "+1 (743) 555-3824", CARD] * 150),
]


def test_base_spans_equal_plain_patterns(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "id long, text string")
    got = {r.id: r.s for r in pii.base_spans(df).select("id", pii.written_form("base").alias("s")).collect()}
    for k, t in enumerate(ODD):
        assert got[k] == ",".join(plain(t)), (k, (t or "")[:60])


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.text for r in queries.read(spark, sf, "documents").collect()}
    rows = queries.QUERIES["op4_pii"](spark, sf).collect()
    assert len(rows) == len(docs)
    added = []
    for r in rows:
        base, spans = plain(docs[r.doc_id]), r.spans.split(",") if r.spans else []
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))
        added += [(x.split(":")[0], docs[r.doc_id][slice(*map(int, x.split(":")[1:]))]) for x in spans if x not in base]
    # what a neighbour hid from the base patterns, and nothing else
    assert added and all(k == "card" and luhn(x) and len(x) == 16 or k == "phone" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x) for k, x in added)


def test_no_python_on_the_main_path(spark, sf):
    plan = queries.QUERIES["op4_pii"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_boosting_separates_and_scores_as_in_sql(spark):
    cells = [({"f_kind": k, "f_valid": v, "f_shape": 0, "f_before": b, "f_after": 3, "f_hint": 0}, 50.0 * v * (b != 2), 40.0 * (1 - v) + 30.0 * (b == 2)) for k in range(4) for v in range(2) for b in range(5)]
    model = pii.boost(cells)
    for x, p, n in cells:
        assert (model.score(x) > 0.5) == (p > n)
    df = spark.createDataFrame([(x,) for x, _, _ in cells], "c struct<" + ", ".join(f"{f}: int" for f in pii.FEATURES) + ">")
    for r in df.select("c", F.expr(model.sql("c")).alias("s")).collect():
        assert r.s == pytest.approx(model.score(r.c.asDict()))
    assert not pii.boost([]).trees and not pii.boost([(cells[0][0], 5.0, 0.0)]).trees


def test_redaction(spark):
    text = "é 😀 a@b.c and +1 (743) 555-3824 end"
    rows = [(1, text, [("email", 4, 9), ("phone", 14, 31)]), (2, text, []), (3, None, []), (4, "abcdef", [("ip", 0, 4), ("card", 2, 5)]), (5, "ab", [("ip", 0, 2)])]
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<kind: string, start: bigint, end: bigint>>")
    got = {r.id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "é 😀 [EMAIL] and [PHONE] end", 2: text, 3: None, 4: "[IP]f", 5: "[IP]"}


def test_redaction_of_long_texts(spark):
    """Many spans, pieces over several blocks, spans inside others, against plain slicing."""
    import random

    rnd, rows = random.Random(4), []
    for k, (size, many) in enumerate([(9000, 400), (20_000, 3), (4096, 1), (8192, 2), (30_000, 3000), (50, 0)]):
        text = "".join(rnd.choices("aé😀 x", k=size))
        spans = sorted((s, min(size, s + rnd.randint(1, 30))) for s in rnd.sample(range(size - 1), many))
        if k == 2:
            spans = [(0, 4096)]
        rows.append((k, text, [("ip", s, e) for s, e in spans]))
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<kind: string, start: bigint, end: bigint>>")
    got = {r.id: r.text for r in pii.redact(df).collect()}
    for k, text, spans in rows:
        want, last = "", 0
        merged = []
        for _, s, e in spans:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            want += text[last:s] + "[IP]"
            last = e
        assert got[k] == want + text[last:]


def corpus(spark, many, texts):
    """So many base spans of a kind, ill-formed numbers, and the texts."""
    rows = [f"the mail is user{k}@example.com and tel +1 (743) 555-{1000 + k}, card {CARD} of 10.0.{k % 256}.7 or 411111111111{1000 + k}" for k in range(many)]
    return spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *rows])], "doc_id long, text string")


HIDDEN = ["name (at) host (dot) com", "call (743) 555-3824 today", "jane.doe [at] mail.example.org", "x 4111-1111-1111-1112 y", "5500005555555559 0000000000000000000000", "256.256.1.1 and 300.2.1.4"]


@pytest.mark.parametrize("many", [0, 5, 400])
def test_other_forms_are_found_at_every_size(spark, many):
    """Written-out signs and phones without a country are added; ill-formed numbers never are."""
    got = {r.doc_id: r.s for r in pii.find(corpus(spark, many, HIDDEN)).select("doc_id", pii.written_form("spans").alias("s")).collect()}
    assert [got[k] for k in range(6)] == ["email:0:24", "phone:5:19", "email:0:30", "", "card:0:16", ""]


def test_a_kind_of_look_alikes_adds_nothing(spark):
    """Where held-out candidates of a kind are all ill-formed, its threshold is out of reach."""
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    df = spark.createDataFrame([(k, f"{'x' * k} no {4111111111110000 + k} here") for k in range(200)], "doc_id long, text string").where("doc_id % 10 <> 1")
    found = pii.candidates(pii.base_spans(df)).withColumn("base", F.expr(f"cast(array() as {spans})"))
    assert pii.fit(found.where("exists(candidates, c -> c.f_valid = 0)")).thresholds["card"] > 1


def test_frames(spark):
    """Nulls, copies, clashing columns, no rows, a corpus without any candidates."""
    df = spark.createDataFrame([(1, None, 3), (None, "a@b.c", 3), (1, "a@b.c", 3), (1, "a@b.c", 3)], "doc_id long, text string, base int")
    got = sorted((r.doc_id or 0, r.s) for r in pii.find(df).select("doc_id", pii.written_form("spans").alias("s")).collect())
    assert got == [(0, "email:0:5"), (1, ""), (1, "email:0:5"), (1, "email:0:5")]
    assert pii.find(df.where("false")).count() == 0
    assert pii.find(df.where("text is null")).count() == 1
