import hashlib
import re

from text_fixtures import SF_DIR, documents, odd_rows

from pingtrace.llm import pii

WORDS = ["a", "b.c", "@", "@x", "-", ".", "1", "23", "255", "256", "0012", " ", "  ", "+", "+1", "(", "4111 1111 1111 1111",
         "4111111111111111", "é", "😀", "\n", "a@b.co", "1.2.3.4", ".5", " ssn 123-45-6789 ", "%", "_"]


def luhn(digits: str) -> bool:
    doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text: str | None):
    found = []
    for rank, (kind, pattern) in enumerate(
        {
            "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        }.items()
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, m.end(), kind))
    found.sort()
    counts = [sum(f[3] == k for f in found) for k in ("email", "ip", "card", "phone")]
    return (*counts, hashlib.sha256(",".join(f"{k}:{b}:{e}" for b, _, e, k in found).encode()).hexdigest())


def check(frame, rows):
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    got = sorted(map(tuple, frame.select(columns).collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=str)


def test_base_spans(spark, monkeypatch):
    rows = odd_rows(WORDS, 600) + [(10_000, "1.1.1.1 " * 2000), (10_001, "a" * 50_000 + "@b.c"), (10_002, "a@" + "b." * 30_000 + "c")]
    monkeypatch.setattr(pii, "table", lambda *_: documents(spark, rows))
    check(pii.op8_pii(spark, ""), rows)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check(pii.op8_pii(spark, SF_DIR), rows)


def test_checksums_and_context(spark):
    rows = [(1, "pay DE89 3704 0044 0532 0130 00 now"), (2, "pay DE88 3704 0044 0532 0130 00 now"),
            (3, "his ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "ssn 666-45-6789"), (6, "my card 4111111111111111"),
            (7, "xx 4111111111111111")]
    found = {r.doc_id: r for r in pii.find_pii(documents(spark, rows)).collect()}
    assert [len(found[k].iban) for k in (1, 2)] == [1, 0]
    assert [len(found[k].ssn) for k in (3, 4, 5)] == [1, 0, 0]
    assert found[6].card[0].score > found[7].card[0].score
    assert found[1].iban[0].text == "DE89 3704 0044 0532 0130 00"


def test_near_words_on_both_sides_decide(spark):
    pairs = [
        ("ip", "the server is 10.1.2.3 now", "version 10.1.2.3 now"),
        ("ip", "10.1.2.3 is the address", "10.1.2.3 is the release"),
        ("phone", "call +34 911 222 333", "sum +34 911 222 333"),
        ("phone", "+34 911 222 333 (mobile)", "+34 911 222 333 (total)"),
        ("ssn", "123-45-6789 is his social number", "123-45-6789 is his part"),
        ("ip", "his IP: 10.1.2.3", "the ship 10.1.2.3 and more"),  # words count from their beginning
    ]
    rows = [(2 * k + j, p[j + 1]) for k, p in enumerate(pairs) for j in (0, 1)]
    frame = documents(spark, rows)
    decided = {r.doc_id: r for r in pii.find_pii(frame, whole_base=False).collect()}
    whole = {r.doc_id: r for r in pii.find_pii(frame).collect()}
    for k, (kind, *_) in enumerate(pairs):
        with_, without = decided[2 * k][kind], decided[2 * k + 1][kind]
        assert len(with_) == 1 and with_[0].score >= pii.LEAST_SCORE and without == [], k
        if kind != "ssn":
            assert [len(whole[i][kind]) for i in (2 * k, 2 * k + 1)] == [1, 1]
            assert whole[2 * k + 1][kind][0].score < pii.LEAST_SCORE


def test_query_returns_scores(spark, monkeypatch):
    rows = [(1, "mail a@b.co, version 1.2.3.4 of 4111111111111111 x"), (2, None)]
    monkeypatch.setattr(pii, "table", lambda *_: documents(spark, rows))
    found = {r.doc_id: r for r in pii.op8_pii(spark, "").collect()}
    assert found[1].spans == "email:5:11,ip:21:28,card:32:48"
    assert found[1].scores == "1.00,0.30,0.70" and found[1].n_likely == 2
    assert (found[2].spans, found[2].scores, found[2].n_likely) == ("", "", 0)


def test_account_numbers_in_a_row(spark):
    de, spaced, gb, no = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947"
    mt = "MT84MALT011000012345MTLCAST001S"
    cases = [
        (f"IBAN {de} Please pay", [de]),
        (f"IBAN {spaced} BIC COBADEFF", [spaced]),
        (f"IBAN {de} 2 days", [de]),
        (f"é {spaced} {gb} {no} {mt} END", [spaced, gb, no, mt]),
        (f"{de},{gb}", [de, gb]),
        (f"FR12 {de} A1 B2C3D4 E5F6", [de]),  # what begins like a number takes in none
        (f"{no} 1 {spaced}", [no, spaced]),
        (f"{de}X", []),
        (f"X{de}", []),
        ("DE88370400440532013000 Please", []),
        ("ZZ89370400440532013000", []),
    ]
    found = {r.doc_id: r.iban for r in pii.find_pii(documents(spark, [(k, t) for k, (t, _) in enumerate(cases)])).collect()}
    for k, (text, want) in enumerate(cases):
        assert [s.text for s in found[k]] == want
        assert [text[s.start : s.end] for s in found[k]] == want


def test_empty_table(spark):
    assert pii.find_pii(documents(spark, [])).collect() == []
