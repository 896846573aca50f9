import hashlib
import random
import re

from pyspark.sql import functions as F

from cohortflow.llm.pii import KINDS, _possible, bootstrap_patterns, find_personal_data, mask, personal_data_report


def luhn(s):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(s))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def brute(text):
    x, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x)
            if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x)
            if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(rows, by_id):
    for r in rows:
        spans = brute(by_id(r))
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert set(listed(spans).split(",")) <= set(r["spans"].split(","))


def test_documents_against_brute_force(documents, texts):
    rows = personal_data_report(documents).collect()
    assert len(rows) == len(texts)
    check(rows, lambda r: texts[r["doc_id"]])
    clean = [r for r in rows if not brute(texts[r["doc_id"]])]
    assert clean and all(r["spans"] == "" for r in clean)


CASES = ["x@y.z", "a@b.c_x@d.e", "a.b+c@q-r.s.t.", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 300.1.2.3.4",
         "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111 1111 1111 1112", "+1 (375) 555-4393", "+12345678901234567 +1 555 555 5555.",
         None, "", "é@x.de ü+49 (30) 1234 567", "@@@ a@b a@b. a@b..c 1..2.3.4", "1 2 3 4" * 3000, "4111111111111111" * 2,
         "9" * 50000, "a" * 50000 + "@", "a@b.c " * 1000, "😀 10.1.2.3 😀 u@v.w"]


def test_cases_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    check(personal_data_report(df).collect(), lambda r: CASES[r["doc_id"]])


def test_awkward_rows(awkward, no_documents):
    rows = personal_data_report(awkward).collect()
    assert len(rows) == awkward.count() and personal_data_report(no_documents).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert [by[10][f"n_{k}"] for k in KINDS] == [1, 1, 0, 1] and by[2]["spans"] == ""


def test_patterns_learned_from_seeds_find_unseen_identifiers(spark):
    seen = [(i, f"hello patient phone +1 (375) 555-{1000 + i} and patient phone {70000 + i}-X ok customer mail u{i}@x.org "
                f"fine the cat {i}23456 of the house") for i in range(60)]
    clean = [(1000 + i, "nothing here of the house and the cat sat 98765 times") for i in range(60)]
    df = spark.createDataFrame(seen + clean, "doc_id long, text string")
    patterns = bootstrap_patterns(df)
    assert {(p, k) for p, k, _ in patterns} == {("customer mail", "email"), ("patient phone", "phone")}
    found = {r["doc_id"]: r for r in find_personal_data(df, patterns).withColumn("m", mask(F.col("text"), F.col("spans"))).collect()}
    assert found[3]["m"] == ("hello patient phone [PHONE] and patient phone [PHONE] ok customer mail [EMAIL] "
                             "fine the cat 323456 of the house")
    assert all(found[1000 + i]["m"] == found[1000 + i]["text"] for i in range(60))


def test_seeds_and_identifiers_of_several_words(spark):
    card = lambda i: next(f"4111 1111 {i:04d} {k:04d}" for k in range(10000) if luhn(f"41111111{i:04d}{k:04d}"))
    seen = [f"please charge my card {card(i)} today and ring the office on +49 (30) 1234-{1000 + i} or write to the box u{i}@x.org soon"
            for i in range(12)]
    seen[3] = seen[3].replace(card(3), card(3).replace(" ", "-"))
    more = ["charge my card 4111 1111 1111 1112, thanks", "the office on 030 1234567 ok", "the office on (555) 123 - 4567.",
            "to the box jane.doe@localhost please", "charge my card", "rows 1 2 3 4 5 6 7 of the table 12345 at home@work"]
    df = spark.createDataFrame(list(enumerate(seen + more)), "doc_id long, text string")
    assert {(p, k) for p, k, _ in bootstrap_patterns(df)} == {("my card", "card"), ("office on", "phone"), ("the box", "email")}
    rows = {r["doc_id"]: r["spans"] for r in personal_data_report(df).collect()}
    assert [rows[12 + i] for i in range(6)] == ["card:15:34", "phone:14:25", "phone:14:30", "email:11:29", "", ""]


def test_common_words_are_ruled_out_by_a_part_of_the_texts(spark):
    rng = random.Random(2)
    fill = lambda: " ".join(rng.choice(["of the", "in a", "to it"]) for _ in range(60))
    rows = [f"{fill()} of the u{i}@x.org {fill()} reach me at v{i}@y.org" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    support = spark.createDataFrame([("of the", "email", 300), ("me at", "email", 300)], "pattern string, kind string, most long")
    assert [r["pattern"] for r in _possible(df, support, 0.5, 8).collect()] == ["me at"]
    assert bootstrap_patterns(df) == [("me at", "email", 1.0)]


def test_support_does_not_grow_with_the_corpus_or_with_copies(spark):
    rare = [f"ask our desk {i} write to u{i}@rare.org ok" for i in range(8)] + ["ask our desk write to AB-12345 ok"]
    many = [f"common mail v{i}@x.org ok" for i in range(2500)] + ["one page mail w@x.org ok"] * 1500
    copied = ["".join(f" see page w{i}@copy.org" for i in range(9))] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rare + many + copied)], "doc_id long, text string")
    patterns = {(p, k) for p, k, _ in bootstrap_patterns(df)}
    assert patterns == {("write to", "email"), ("common mail", "email")}
    spans = {r["doc_id"]: r["spans"] for r in personal_data_report(df).collect()}
    assert spans[8] == "email:22:30" and len(spans) == df.count()


def test_mask_overlaps_and_nulls(spark):
    df = spark.createDataFrame([(1, "call +1 555 555 55.10.0.0 now"), (2, None), (3, "plain")], "doc_id long, text string")
    rows = {r["doc_id"]: r["m"] for r in find_personal_data(df, []).withColumn("m", mask(F.col("text"), F.col("spans"))).collect()}
    assert rows[2] is None and rows[3] == "plain" and rows[1] == "call [PHONE] now"
