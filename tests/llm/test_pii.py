import hashlib
import re

from bitloom.llm import pii

from .helpers import SF, clashing, docs, duck, rows

CARD, BAD = "4539 1488 0343 6467", "4539 1488 0343 6468"
IBAN = "GB82 WEST 1234 5698 7654 32"


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in kinds.items()}
    base = ",".join(f"{k}:{s}:{e}" for k, spans in found.items() for s, e in spans)
    return [len(v) for v in found.values()], hashlib.sha256(base.encode()).hexdigest(), base


CASES = [
    None, "", "a@b.c", "write to joe.x+y@mail-1.example.com, or é@b.de and a@b.c_d@e.f g@@h.i @j.k l@m", "x@y.z." * 20, "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1 1.1.1.256 99999999999999999999.1.1.1",
    f"card {CARD} no {BAD} {CARD.replace(' ', '-')} {CARD.replace(' ', '')}", f"{CARD} {CARD}", "0000000000000", "4539  1488 0343 6467", "+1 (017) 555-7713 +49-30-1234 +12345678 +1234567890123456 +1 2", "🙂🙂 +1 (017) 555-7713 é a@b.cd",
    f"my account iban is {IBAN}.", f"serial {IBAN.replace('82', '83')}", "7" * 5000, "a" * 5000 + "@b.c", "1-" * 3000, "+1" + "(" * 2000 + "2", "1.1.1.1" * 50, "+1+1+1 555 1234567",
    "x@a" + ".a" * 20_000, "x@" + "a." * 20_000, "7" * 100_000 + ".1.1.1", "1.1." * 20_000, "bob@b.com, 10.0.0.1 or +1 555 123 4567 é " * 2_000,
]


def test_planted_cases(spark):
    got = {r["doc_id"]: r for r in pii.digests(pii.find_pii(clashing(docs(spark, list(enumerate(CASES)))))).collect()}
    for i, text in enumerate(CASES):
        counts, digest, base = plain(text)
        r = got[i]
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) == (counts, digest), text
        assert r["spans"].startswith(base)
    at = CASES[12].index(IBAN)
    assert f"iban:{at}:{at + len(IBAN)}" in got[12]["spans"] and "iban" not in got[13]["spans"]


def test_tables_match_sql(spark):
    table = docs(spark, list(enumerate(c for c in CASES if c is None or len(c) < 2000)))
    assert rows(pii.digests(pii.find_pii(table))) == duck(pii.oracle_sql(), documents=table)
    path = f"{SF}/documents.parquet"
    assert rows(pii.digests(pii.find_pii(spark.read.parquet(path)))) == duck(pii.oracle_sql(), documents=path)


def test_context_moves_scores(spark):
    table = docs(spark, [(1, f"credit card {CARD}"), (2, f"tracking {CARD}"), (3, f"xx {CARD}")])
    score = {r["doc_id"]: r["pii"][0]["score"] for r in pii.find_pii(table).collect()}
    assert score[1] > score[3] > score[2]
    # A label before two matches in a row counts for both; what confirmed them goes with them.
    both = pii.find_pii(docs(spark, [(1, f"credit card: {CARD}, {CARD}"), (2, f"{IBAN} serial part"), (3, f"{IBAN}")])).collect()
    spans = {r["doc_id"]: r["pii"] for r in both}
    assert [round(s["score"], 1) for s in spans[1]] == [1.0, 1.0] and {s["confirmed_by"] for s in spans[1]} == {"luhn"}
    assert [s["kind"] for s in spans[2]] == [] and [s["confirmed_by"] for s in spans[3]] == ["mod97"]


def test_planted_documents_are_found(spark):
    """Every document of the tables in which one of the base kinds' plain patterns confirms a match is found, no other."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"] for r in table.collect() if sum(plain(r["text"])[0])}
    found = {r["doc_id"] for r in pii.digests(pii.find_pii(table)).where("n_pii > 0").collect()}
    assert want and want <= found and len(found - want) <= 0.02 * len(want)


def test_redact_repeats_nulls_and_empty_tables(spark):
    table = clashing(docs(spark, [(1, "mail a@b.cd now"), (1, "mail a@b.cd now"), (None, None), (2, f"{CARD}, 1.2.3.4"), (3, "")]))
    assert sorted(map(repr, (r["text"] for r in pii.redact(table).collect()))) == sorted(map(repr, ["mail <email> now", "mail <email> now", None, "<card>, <ip>", ""]))
    assert pii.redact(table).columns == table.columns
    assert rows(pii.find_pii(table.limit(0))) == []
    assert len(rows(pii.find_pii(table))) == 5
