"""License scan: ordered signature rules over normalised words, as DataFrame expressions only.

A text is lower-cased (A-Z), cut into words and joined again with single spaces, so every
signature is one regular expression over plain words. A rule runs only on texts that hold
all of its keywords (a hash intersection of the text's words with the rule keywords). Keywords are words
that every match holds: a signature whose alternatives share none has one rule per keyword set.
Its hits become word intervals; an interval inside one of the same or a better priority is
suppressed. Base phrases are always reported.

Null texts count as empty: no words, no places, empty labels, score 0. Repeated rows give
repeated rows; other columns of the input are not read, so clashing names do not matter.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import ascii_lower, scan_array

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: base phrases and their labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
        "mit license": "mit"}

RULE_TYPE = "array<struct<id:int,label:string,priority:int,keywords:array<string>,regex:string>>"

GRANT, VERSIONED, NAMED, HINT = 0, 1, 2, 3          # priorities, best first
WEIGHT = {GRANT: 1.0, VERSIONED: 0.9, NAMED: 0.7, HINT: 0.4}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    regex: str


L = "licen[cs]e"
V = "(?:version |v |v)?"

# label | spdx id in words | keywords of the names | full name with version | bare name
# Each line gives up to five signatures: SPDX tag, grant sentence, versioned name, bare name, notice.
_FAMILIES = [
    ("apache-1.0", "apache 1 0", "apache", rf"apache (?:software )?{L} {V}1 0", ""),
    ("apache-1.1", "apache 1 1", "apache", rf"apache (?:software )?{L} {V}1 1", ""),
    ("apache-2.0", "apache 2 0", "apache", rf"apache (?:software )?{L} {V}2(?: 0)?|apache 2(?: 0)?|licenses {L} 2 0", rf"apache (?:software )?{L}|asl 2(?: 0)?"),
    ("mit", "mit", "mit", rf"(?:the )?mit {L}", rf"mit x11 {L}|expat {L}|mit style {L}"),
    ("mit-0", "mit 0", "mit", "mit 0|mit no attribution", ""),
    ("x11", "x11", "x11", rf"x11 {L}", "x consortium"),
    ("isc", "isc", "isc", rf"isc {L}", "internet systems consortium"),
    ("0bsd", "0bsd", "0bsd", "0bsd|zero clause bsd", ""),
    ("bsd-1-clause", "bsd 1 clause", "bsd", rf"bsd 1 clause|1 clause bsd|one clause bsd(?: {L})?", ""),
    ("bsd-2-clause", "bsd 2 clause", "bsd", rf"bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd(?: {L})?", "freebsd " + L),
    ("bsd-3-clause", "bsd 3 clause", "bsd", rf"bsd 3 clause|3 clause bsd|three clause bsd|(?:new|modified|revised) bsd(?: {L})?", rf"bsd {L}|bsd style {L}"),
    ("bsd-4-clause", "bsd 4 clause", "bsd", rf"bsd 4 clause|4 clause bsd|original bsd(?: {L})?", ""),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", "gnu", rf"gnu general public {L} {V}1(?: 0)?", "gnu gpl v1"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", "gnu", rf"gnu general public {L} {V}2(?: 0)?", "gnu gpl (?:version |v)?2"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", "gnu", rf"gnu general public {L} {V}3(?: 0)?", "gnu gpl (?:version |v)?3"),
    ("gpl", "gpl", "gnu", rf"gnu general public {L}", "gnu gpl"),
    ("gplv2", "gplv2", "gplv2", "gplv2|gpl v2", ""),
    ("gplv3", "gplv3", "gplv3", "gplv3|gpl v3", ""),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", "gnu", rf"gnu (?:lesser|library) general public {L} {V}2(?: 0)?", "gnu lgpl v?2"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "gnu", rf"gnu lesser general public {L} {V}2 1", "gnu lgpl v?2 1"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", "gnu", rf"gnu lesser general public {L} {V}3(?: 0)?", "gnu lgpl v?3"),
    ("lgpl", "lgpl", "lesser", rf"lesser general public {L}", "gnu lgpl"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", "affero", rf"affero general public {L}(?: {V}3(?: 0)?)?", "gnu affero gpl"),
    ("gfdl-1.1", "gfdl 1 1", "documentation", rf"gnu free documentation {L} {V}1 1", ""),
    ("gfdl-1.2", "gfdl 1 2", "documentation", rf"gnu free documentation {L} {V}1 2", ""),
    ("gfdl-1.3", "gfdl 1 3", "documentation", rf"gnu free documentation {L} {V}1 3", rf"gnu free documentation {L}"),
    ("mpl-1.0", "mpl 1 0", "mozilla", rf"mozilla public {L} {V}1 0", ""),
    ("mpl-1.1", "mpl 1 1", "mozilla", rf"mozilla public {L} {V}1 1", ""),
    ("mpl-2.0", "mpl 2 0", "mozilla", rf"mozilla public {L} {V}2(?: 0)?", rf"mozilla public {L}"),
    ("epl-1.0", "epl 1 0", "eclipse", rf"eclipse public {L} {V}1(?: 0)?", ""),
    ("epl-2.0", "epl 2 0", "eclipse", rf"eclipse public {L} {V}2(?: 0)?", rf"eclipse public {L}"),
    ("edl-1.0", "edl 1 0", "eclipse", rf"eclipse distribution {L} {V}1(?: 0)?", rf"eclipse distribution {L}"),
    ("cddl-1.0", "cddl 1 0", "distribution", rf"common development and distribution {L} {V}1 0", ""),
    ("cddl-1.1", "cddl 1 1", "distribution", rf"common development and distribution {L} {V}1 1", rf"common development and distribution {L}"),
    ("cpl-1.0", "cpl 1 0", "common", rf"common public {L}(?: {V}1 0)?", ""),
    ("eupl-1.1", "eupl 1 1", "european", rf"european union public {L} {V}1 1", ""),
    ("eupl-1.2", "eupl 1 2", "european", rf"european union public {L} {V}1 2", rf"european union public {L}"),
    ("artistic-1.0", "artistic 1 0", "artistic", rf"artistic {L} {V}1 0", ""),
    ("artistic-2.0", "artistic 2 0", "artistic", rf"artistic {L} {V}2(?: 0)?", rf"artistic {L}"),
    ("bsl-1.0", "bsl 1 0", "boost", rf"boost software {L}(?: {V}1 0)?", ""),
    ("busl-1.1", "busl 1 1", "business", rf"business source {L}(?: {V}1 1)?", ""),
    ("sspl-1.0", "sspl 1 0", "server", rf"server side public {L}(?: {V}1)?", ""),
    ("elastic-2.0", "elastic 2 0", "elastic", rf"elastic {L} {V}2(?: 0)?", rf"elastic {L}"),
    ("zlib", "zlib", "zlib", rf"zlib {L}|zlib libpng {L}", ""),
    ("libpng", "libpng", "libpng", rf"libpng {L}|png reference library {L}", ""),
    ("openssl", "openssl", "openssl", rf"openssl {L}|openssl ssleay {L}", ""),
    ("curl", "curl", "curl", rf"curl {L}", ""),
    ("unlicense", "unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl", "do what the fuck you want to public license"),
    ("psf-2.0", "psf 2 0", "python", rf"python software foundation {L}(?: {V}2(?: 0)?)?", rf"psf {L}"),
    ("python-2.0", "python 2 0", "python", rf"python {L} 2 0", ""),
    ("php-3.01", "php 3 01", "php", rf"php {L} {V}3 01", rf"php {L}"),
    ("ruby", "ruby", "ruby", rf"ruby {L}|ruby s {L}", ""),
    ("postgresql", "postgresql", "postgresql", rf"postgresql {L}", ""),
    ("ms-pl", "ms pl", "microsoft", rf"microsoft public {L}", ""),
    ("ms-rl", "ms rl", "microsoft", rf"microsoft reciprocal {L}", ""),
    ("ofl-1.1", "ofl 1 1", "sil", rf"sil open font {L}(?: {V}1 1)?", ""),
    ("upl-1.0", "upl 1 0", "universal", rf"universal permissive {L}(?: {V}1 0)?", ""),
    ("ncsa", "ncsa", "ncsa", rf"ncsa open source {L}|university of illinois ncsa", ""),
    ("afl-3.0", "afl 3 0", "academic", rf"academic free {L}(?: {V}3 0)?", ""),
    ("osl-3.0", "osl 3 0", "open", rf"open software {L} {V}3 0", rf"open software {L}"),
    ("odbl-1.0", "odbl 1 0", "database", rf"open database {L}(?: {V}1 0)?", ""),
    ("odc-by-1.0", "odc by 1 0", "attribution", rf"open data commons attribution {L}", ""),
    ("pddl-1.0", "pddl 1 0", "domain", "public domain dedication and licen[cs]e", ""),
    ("cc0-1.0", "cc0 1 0", "cc0", "cc0 1 0(?: universal)?|cc zero", "cc0"),
    ("cc-by-1.0", "cc by 1 0", "cc", "cc by 1 0", ""),
    ("cc-by-2.0", "cc by 2 0", "cc", "cc by 2 0", ""),
    ("cc-by-2.5", "cc by 2 5", "cc", "cc by 2 5", ""),
    ("cc-by-3.0", "cc by 3 0", "cc", "cc by 3 0", ""),
    ("cc-by-4.0", "cc by 4 0", "cc", "cc by 4 0", "cc by"),
    ("cc-by-sa-2.0", "cc by sa 2 0", "cc", "cc by sa 2 0", ""),
    ("cc-by-sa-3.0", "cc by sa 3 0", "cc", "cc by sa 3 0", ""),
    ("cc-by-sa-4.0", "cc by sa 4 0", "cc", "cc by sa 4 0", "cc by sa"),
    ("cc-by-nc-3.0", "cc by nc 3 0", "cc", "cc by nc 3 0", ""),
    ("cc-by-nc-4.0", "cc by nc 4 0", "cc", "cc by nc 4 0", "cc by nc"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "cc", "cc by nd 4 0", "cc by nd"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "cc", "cc by nc sa 4 0", "cc by nc sa"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "cc", "cc by nc nd 4 0", "cc by nc nd"),
]

# signatures that stand alone: (label, priority, keywords, regex)
_SINGLES = [
    ("cc-by-4.0", NAMED, "creative commons attribution", r"creative commons attribution(?: 4 0)?(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-sa-4.0", VERSIONED, "creative sharealike", r"creative commons attribution share ?alike(?: 4 0)?(?: international)?"),
    ("cc-by-nc-4.0", VERSIONED, "creative noncommercial", r"creative commons attribution non ?commercial(?: 4 0)?(?: international)?"),
    ("cc-by-nd-4.0", VERSIONED, "creative noderivatives", r"creative commons attribution no ?deriv(?:ative)?s(?: 4 0)?(?: international)?"),
    ("cc-by-nc-sa-4.0", GRANT, "creative noncommercial sharealike", r"creative commons attribution non ?commercial share ?alike(?: 4 0)?(?: international)?"),
    ("cc-by-4.0", VERSIONED, "creativecommons by", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", VERSIONED, "creativecommons by", r"creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", VERSIONED, "creativecommons sa", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", VERSIONED, "creativecommons nc", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", VERSIONED, "creativecommons nd", r"creativecommons org licenses by nd 4 0"),
    ("cc0-1.0", VERSIONED, "creativecommons zero", r"creativecommons org publicdomain zero 1 0"),
    ("apache-2.0", VERSIONED, "apache licenses", r"www apache org licenses(?: licen[cs]e 2 0)?"),
    ("mit", VERSIONED, "opensource mit", r"opensource org licen[cs]es? mit(?: licen[cs]e)?(?: php)?"),
    ("bsd-2-clause", VERSIONED, "opensource bsd", r"opensource org licen[cs]es? bsd 2 clause"),
    ("bsd-3-clause", VERSIONED, "opensource bsd", r"opensource org licen[cs]es? bsd 3 clause"),
    ("gpl", NAMED, "gnu licenses", r"www gnu org (?:copyleft|licenses)(?: gpl)?(?: \d(?: 0)?)?(?: html)?"),
    ("mpl-2.0", VERSIONED, "mozilla mpl", r"mozilla org mpl 2 0"),
    ("epl-2.0", VERSIONED, "eclipse legal", r"eclipse org legal epl (?:2 0|v20)"),
    ("mit", GRANT, "permission hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", NAMED, "software without warranty", r"the software is provided as is without warranty of any kind express or implied"),
    ("isc", GRANT, "permission modify distribute", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd-2-clause", NAMED, "redistribution source binary", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", NAMED, "endorse promote products", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", NAMED, "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("gpl", GRANT, "redistribute gnu", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", GRANT, "redistribute lesser", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("agpl-3.0", GRANT, "redistribute affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", HINT, "merchantability fitness", r"implied warranty of merchantability or fitness for a particular purpose"),
    ("zlib", NAMED, "misrepresented origin", r"the origin of this software must not be misrepresented"),
    ("bsl-1.0", NAMED, "boost machine", r"boost software licen[cs]e version 1 0"),
    ("unlicense", GRANT, "unencumbered domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", NAMED, "public domain", r"(?:dedicated to|released into|placed in) the public domain"),
    ("public-domain", HINT, "public domain", r"in the public domain"),
    ("proprietary", NAMED, "rights reserved", r"all rights reserved"),
    ("proprietary", GRANT, "proprietary confidential", r"proprietary and confidential"),
    ("proprietary", NAMED, "unauthorized copying", r"unauthori[sz]ed copying of this file"),
    ("proprietary", NAMED, "commercial license", r"commercial licen[cs]e agreement"),
    ("proprietary", NAMED, "eula", r"end user licen[cs]e agreement|eula"),
    ("unknown", HINT, "licensed", r"licen[cs]ed under(?: the)?(?: terms)?"),
    ("unknown", HINT, "spdx", r"spdx licen[cs]e identifier"),
]


# words that stand in too many texts to be keywords of their own, if a signature has others
_COMMON = set("the of and or under by to in is as be for any with this that terms released distributed available covered "
              "software public version without source new original do what you".split())


def _variants(regex: str) -> set[str]:
    """Alternatives of a signature without its optional parts; words that are not sure to stand whole hold a mark."""
    found = re.search(r"\(\?:([^()]*)\)(\??)", regex)
    if found:
        options = found[1].split("|")
        apart = all(o.endswith(" ") for o in options) or all(o.startswith(" ") for o in options)
        swap = ["" if apart else "~"] if found[2] else options
        return set().union(*[_variants(regex[:found.start()] + o + regex[found.end():]) for o in swap])
    found = re.search(r"\[([a-z]+)\]", regex)
    if found:
        return set().union(*[_variants(regex[:found.start()] + o + regex[found.end():]) for o in found[1]])
    return set(re.sub(r"(\S*) \?", r"~\1~", regex).split("|"))


def keyword_sets(regex: str, wanted: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Keyword sets of which every match holds one: of each alternative the wanted words, else its rarest looking word."""
    out = set()
    for v in _variants(regex):
        words = [w for w in v.split() if re.fullmatch("[a-z0-9]+", w)]
        own = tuple(w for w in wanted if w in words)
        out.add(own or (min(words, key=lambda w: (w in _COMMON, w.isdigit(), w.startswith("licen"), -len(w), w)),))
    return sorted(s for s in out if not any(set(o) < set(s) for o in out))


def _rules() -> tuple[Rule, ...]:
    out = []
    for label, spdx, keyword, full, bare in _FAMILIES:
        out.append(Rule(label, GRANT, ("spdx",), rf"spdx licen[cs]e identifier {spdx}"))
        out.append(Rule(label, GRANT, (keyword,),
                        rf"(?:licen[cs]ed|released|distributed|available|covered) (?:under|by) (?:the )?(?:terms of the )?(?:{full})"))
        out.append(Rule(label, VERSIONED, (keyword,), full))
        if bare:
            out.append(Rule(label, NAMED, (bare.split()[0],) if bare[0].isalpha() and "|" not in bare
                            else (keyword,), bare))
    out += [Rule(label, p, tuple(k.split()), rx) for label, p, k, rx in _SINGLES]
    return tuple(Rule(r.label, r.priority, k, r.regex) for r in out for k in keyword_sets(r.regex, r.keywords))


RULES = _rules()


def _anchored(regex: str) -> str:
    return f"(?<= )(?:{regex})(?= )"


def _rule_table(rules) -> Column:
    """The rules as one constant array (folded once, when the query is optimised)."""
    rows = [{"id": i, "label": r.label, "priority": r.priority, "keywords": list(r.keywords),
             "regex": _anchored(r.regex)} for i, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), RULE_TYPE)


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _intervals(hit: Column) -> Column:
    """Word intervals of one rule's hits, from the hits and the text pieces between them."""
    steps = F.transform(hit["found"], lambda m, i: F.struct(
        _spaces(m).alias("inner"), _spaces(F.get(hit["between"], i)).alias("gap")))
    stop = lambda at, s: at + s["gap"] + s["inner"]
    placed = scan_array(steps, F.lit(-1), stop, lambda at, s: F.struct((at + s["gap"]).alias("start"), (stop(at, s) + 1).alias("stop")),
                        "struct<start:int,stop:int>")
    return F.coalesce(placed, F.array().cast("array<struct<start:int,stop:int>>"))


def _unsuppressed(spans: Column) -> Column:
    """Keep spans that no earlier span of the same or a better priority contains.

    Spans come sorted by start, then longest, then priority, so a container always stands
    before what it contains and one running maximum of stops per priority decides.
    """
    tiers = sorted(WEIGHT)
    reach = lambda a, s: F.greatest(*[F.when(s["priority"] >= p, a[f"t{p}"]).otherwise(-1) for p in tiers])
    kept = scan_array(
        spans, F.struct(*[F.lit(-1).alias(f"t{p}") for p in tiers]),
        lambda a, s: F.struct(*[F.when((s["priority"] == p) & (s["stop"] > a[f"t{p}"]), s["stop"]).otherwise(a[f"t{p}"])
                                .alias(f"t{p}") for p in tiers]),
        lambda a, s: reach(a, s) < s["stop"], "boolean")
    marked = F.filter(F.arrays_zip(spans.alias("span"), kept.alias("kept")), lambda z: z["kept"])
    return F.transform(marked, lambda z: z["span"])


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per document: word count, base phrase places and the detections left after suppression.

    Columns: the id, ``n_words``, ``base`` (array of label, start word, stop word) and
    ``detections`` (array of start, stop, priority, rule id, label).
    """
    keywords = sorted({k for r in rules for k in r.keywords} | {p.split()[0] for p in BASE})
    base_rules = tuple(Rule(label, NAMED, (phrase.split()[0],), phrase) for phrase, label in BASE.items())
    words = docs.select(F.col(id_col), F.regexp_extract_all(
        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))
    gated = words.select(
        id_col, F.size("words").cast("long").alias("n_words"), "words",
        F.array_intersect("words", F.array(*[F.lit(k) for k in keywords])).alias("hints"))
    norm = F.when(F.size("hints") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    lined = gated.select(id_col, "n_words", "hints", norm.alias("norm"))

    def hits(table: Column) -> Column:
        open_rules = F.filter(table, lambda r: F.forall(r["keywords"], lambda k: F.array_contains(F.col("hints"), k)))
        found = F.transform(open_rules, lambda r: F.struct(
            r["id"].alias("id"), r["label"].alias("label"), r["priority"].alias("priority"), r["regex"].alias("regex"),
            F.regexp_extract_all(F.col("norm"), r["regex"], F.lit(0)).alias("found")))
        return F.transform(F.filter(found, lambda h: F.size(h["found"]) > 0), lambda h: F.struct(
            h["id"].alias("id"), h["label"].alias("label"), h["priority"].alias("priority"),
            h["found"].alias("found"), F.split(F.col("norm"), h["regex"], F.lit(-1)).alias("between")))

    matched = lined.select(
        id_col, "n_words",
        F.when(F.col("norm").isNotNull(), hits(_rule_table(rules))).alias("hits"),
        F.when(F.col("norm").isNotNull(), hits(_rule_table(base_rules))).alias("base_hits"))
    spans = F.flatten(F.transform("hits", lambda h: F.transform(_intervals(h), lambda s: F.struct(
        s["start"].alias("start"), (-s["stop"]).alias("back"), h["priority"].alias("priority"), h["id"].alias("rule"),
        s["stop"].alias("stop"), h["label"].alias("label")))))
    base = F.flatten(F.transform("base_hits", lambda h: F.transform(_intervals(h), lambda s: F.struct(
        h["label"].alias("label"), s["start"].alias("start"), s["stop"].alias("stop")))))
    placed = matched.select(id_col, "n_words", F.array_sort(spans).alias("spans"), base.alias("base"))
    return placed.select(id_col, "n_words", "base",
                         F.when(F.size("spans") > 0, _unsuppressed(F.col("spans"))).alias("detections"))


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, first and last base place, labels and a confidence.

    Null and empty texts have no words, no labels and score 0; repeated rows repeat; an empty table gives an empty result; other
    columns are not read. Of detections with one interval the better priority stays, of equal ones the first rule. A very long text
    costs time in proportion to its length and hits, in one task.
    """
    found = scan_licenses(docs)
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    no_labels = F.array().cast("array<string>")
    base_labels = F.coalesce(F.transform("base", lambda b: b["label"]), no_labels)
    own = F.coalesce(F.transform("detections", lambda d: d["label"]), no_labels)
    weight = lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv]), p)
    starts = F.transform("base", lambda b: b["start"])
    return found.select(
        "doc_id", "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(base_labels).alias("base_labels"), labels(F.concat(base_labels, own)).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: weight(d["priority"]))), F.lit(0.0)),
                   F.when(F.size("base") > 0, F.lit(WEIGHT[NAMED])).otherwise(F.lit(0.0))).alias("score"))
