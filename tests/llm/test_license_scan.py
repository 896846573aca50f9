import re
import time

import pytest

from cohortflow.llm.license_scan import BASE, HINT, NAMED, RULES, VERSIONED, Rule, license_report, scan_licenses

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UP, LOW)))


def brute(text, rules=RULES):
    """Row of one text by plain loops: every rule on the joined words, then pairwise containment."""
    words = words_of(text)
    norm = " " + " ".join(words) + " "
    base = sorted((i, BASE[p]) for p in BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
    spans = []
    for k, r in enumerate(rules):
        if all(w in words for w in r.keywords):
            for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", norm):
                start = norm[:m.start()].count(" ") - 1
                spans.append((start, start + len(m[0].split()), r.priority, k, r.label))
    spans.sort(key=lambda s: (s[0], -s[1], s[2], s[3]))
    kept = [s for j, s in enumerate(spans)
            if not any(e[0] <= s[0] and e[1] >= s[1] and e[2] <= s[2] for e in spans[:j])]
    return len(words), base, kept


def check(rows, by_id):
    for r in rows:
        n, base, kept = brute(by_id(r))
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({b for _, b in base}))
        assert r["labels"] == ",".join(sorted({b for _, b in base} | {s[4] for s in kept}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(base or kept)


UNGATED = ["released under GPL v2", "GPL v3", "expat license", "zero clause BSD", "ASL 2.0", "CC zero", "end user license agreement",
           "licenced under", "Creative Commons Attribution Share Alike", "Creative Commons Attribution NoDerivs",
           "Creative Commons Attribution non commercial share alike", "PNG reference library license",
           "Boost Software License version 1.0", "unauthorised copying of this file", "released under the expat licence"]


def test_keywords_never_hide_a_match(spark, texts):
    """Every signature on every text without its keywords finds what the gated scan finds."""
    signatures = tuple(Rule(r.label, r.priority, (), r.regex) for r in dict.fromkeys((Rule(r.label, r.priority, (), r.regex) for r in RULES)))
    plain = sorted({v for r in RULES for v in expanded(r.regex)})
    own = UNGATED + plain + [t for t in list(texts.values())[:150] if t]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in license_report(df).collect()}
    for k, t in enumerate(own):
        _, base, kept = brute(t, signatures)
        assert got[k] == {b for _, b in base} | {s[4] for s in kept}, t
        assert got[k] or k >= len(UNGATED), t


def expanded(regex):
    """Texts that a signature matches: every alternative and class, optional parts left out and put in."""
    m = re.search(r"\(\?:([^()]*)\)(\??)", regex) or re.search(r"\[([a-z]+)\]()", regex) or re.search(r"(.)(\?)", regex)
    if not m:
        return {v.replace(r"\d", "2") for v in regex.split("|")}
    options = m[1].split("|") if m[0].startswith("(") else list(m[1])
    options = [options[0], options[-1], *([""] if m[2] else [])] if "(" in regex[m.end():] else [*options, *([""] if m[2] else [])]
    return set().union(*[expanded(regex[:m.start()] + o + regex[m.end():]) for o in options])


def test_hundreds_of_rules():
    assert len(RULES) >= 200 and {r.priority for r in RULES} == {0, 1, 2, 3}


def test_documents_against_brute_force(documents, texts):
    rows = license_report(documents).collect()
    assert len(rows) == len(texts)
    check(rows, lambda r: texts[r["doc_id"]])


CASES = [
    "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "cc by cc by cc by 4.0",
    "GNU General Public License GNU Lesser General Public License, version 2.1", "MIT License " * 700,
    "mit licence, MIT-License mit license", "the unlicense and WTFPL and zlib license and the mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", None, "", "license"]


def test_cases_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    check(license_report(df).collect(), lambda r: CASES[r["doc_id"]])


def test_awkward_rows(awkward, no_documents):
    rows = license_report(awkward).collect()
    assert len(rows) == awkward.count() and license_report(no_documents).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[10]["base_labels"] == "mit" and by[2]["n_words"] == 0 and by[3]["labels"] == "" and by[7]["n_words"] == 30000


@pytest.mark.parametrize("inner,survives", [(HINT, False), (NAMED, False), (VERSIONED, False), (0, True)])
def test_suppression_by_containment_and_priority(spark, inner, survives):
    rules = (Rule("outer", VERSIONED, ("alpha",), "alpha beta gamma"), Rule("inner", inner, ("beta",), "beta"))
    df = spark.createDataFrame([(1, "alpha beta gamma beta")], "doc_id long, text string")
    found = scan_licenses(df, rules).first()["detections"]
    assert sorted((d["label"], d["start"], d["stop"]) for d in found) == sorted(
        [("outer", 0, 3), ("inner", 3, 4)] + ([("inner", 1, 2)] if survives else []))


def test_time_grows_with_a_texts_hits_and_not_their_square(spark):
    df = spark.createDataFrame([(1, "mit license apache license x " * 60000)], "doc_id long, text string")
    began = time.time()
    row = license_report(df).first()
    assert (row["n_base"], row["first_word"], row["last_word"]) == (120000, 0, 5 * 60000 - 3) and row["base_labels"] == "apache,mit"
    assert time.time() - began < 60
