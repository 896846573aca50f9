"""Personal data by fixed forms and by bootstrapped contexts, as DataFrame expressions only.

Base kinds have fixed forms (expressions below; possessive, so that long runs stay linear). The
bootstrap starts from the base entities, written in one word or several: the two words before one are a candidate pattern. What
could be an identifier of no fixed form is a run of number words (digits, brackets, dashes), a word with a digit or a
word with an @ (for e-mail patterns only). Spark counts, over all texts, how often a pattern's words stand before any word, and links
patterns to the seeds and unseen identifiers that follow them. Reliabilities then flow through this
graph for a few rounds: a pattern's is the trusted share of all its places, an unseen
identifier's is the mean of its patterns'. Identifiers after a high-confidence pattern
are reported with the pattern's kind, unless a base span covers them.

A pattern must precede MIN_SUPPORT different seed entities in MIN_SUPPORT different texts, whatever the size of
the corpus and however often a text is copied. A pattern's reliability is at most its identifiers by its places, so
places counted in a part of the texts can already rule it out: most word pairs are common and fall in the first
SHARES of the texts; the places of the others are counted in all. Patterns stay DataFrames: the optimiser sends small tables to
all tasks and deals large ones out by pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import NON_SPACE, running_spans, scan_array, settle

KINDS = ("email", "ip", "card", "phone")            # fixed values, in report order
_LOCAL = "[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"

MIN_SUPPORT = 5             # different seed entities that a pattern precedes, and different texts, at least
CONFIDENCE = 0.5            # reliability from which a pattern is used
ROUNDS = 3
SHARES = (64, 8)            # parts of the texts (one in so many) whose places can rule patterns out
IDENTIFIER_CHARS = 5        # shortest unseen identifier
MOST_DIGITS = 19            # of an unseen identifier, as of the longest base kind
NO_SPANS = "array<struct<start:int,kind_no:int,stop:int>>"
PATTERNS = "pattern string, kind string, trust double"
_SPACE = r"[\x20\x09-\x0D]"
_NUMBER = r"""(?=[()\[\]+./-]*+[0-9])[0-9()\[\]+./-]++(?=[,;:!?"'>]*+(?:[\x20\x09-\x0D]|$))"""
# a run of number words, perhaps with single dashes between them, else one word with a digit or an @
IDENTIFIER = (rf"(?<![^\x20\x09-\x0D])(?:{_NUMBER}(?:[\x20\t]++(?:[-/][\x20\t]++)?+{_NUMBER})*+"
              r"|(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++)")
MENTION = "struct<pattern:string,kind:string,instance:string,start:int,stop:int,wordy:boolean>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _placed(text: Column, form: str) -> Column:
    """Matches of a form: array of (h, s, p), the match, its span and the text since the match before; null for none."""
    hits, pieces = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)
    steps = lambda h, p: F.transform(h, lambda m, i: F.struct(F.length(F.get(p, i)).alias("gap"), F.length(m).alias("size")))
    packed = F.array(F.struct(hits.alias("h"), pieces.alias("p")))
    placed = F.transform(packed, lambda x: F.arrays_zip(
        x["h"].alias("h"), running_spans(steps(x["h"], x["p"])).alias("s"), F.slice(x["p"], 1, F.size(x["h"])).alias("p")))
    # a cheap test first: most texts hold no match of a kind
    return F.when(text.rlike(form.replace(r"\G|", "")), placed[0])


def _kind_spans(kind: str, text: Column) -> Column:
    """Valid matches of one kind: array of (start, kind number, stop) in code points, or null for none."""
    return F.transform(F.filter(_placed(text, FORMS[kind]), lambda z: _valid(kind, z["h"])), lambda z: F.struct(
        z["s"]["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), z["s"]["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    none = F.array().cast(NO_SPANS)
    return F.array_sort(F.concat(*[F.coalesce(_kind_spans(k, text), none) for k in KINDS]))


def _trimmed(w: Column) -> Column:
    """Without brackets, quotes and punctuation around a word; of several words only a full stop goes."""
    one = F.regexp_replace(w, r"""^[(\[<"']++|(?<![.,;:!?)\]>"'])[.,;:!?)\]>"']++$""", "")
    return F.when(w.rlike(_SPACE), F.regexp_replace(w, r"(?<!\.)\.++$", "")).otherwise(one)


def _leading(w: Column) -> Column:
    """Characters that ``_trimmed`` takes off the front."""
    return F.when(w.rlike(_SPACE), 0).otherwise(F.length(w) - F.length(F.regexp_replace(w, r"""^[(\[<"']++""", "")))


def _before(words: Column, i: Column) -> Column:
    """The pattern of word i: the two words before it, lower case; null for the first word."""
    return F.when(i > 0, F.lower(F.concat_ws(" ", F.when(i > 1, F.get(words, i - 2)), F.get(words, i - 1))))


def _pattern(piece: Column, i: Column) -> Column:
    """The pattern of match i, from the text since the match before: its last two words, of the first piece perhaps one.

    Words that the matches are part of do not count; null where the context is another match.
    """
    own = F.regexp_replace(F.when(i > 0, F.regexp_replace(piece, r"^[^\x20\x09-\x0D]++", "")).otherwise(piece),
                           r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++$", "")
    last = F.array(F.slice(F.reverse(F.regexp_extract_all(own, F.lit(NON_SPACE), F.lit(0))), 1, 2))
    return F.transform(last, lambda w: F.lower(F.when(F.size(w) == 2, F.concat_ws(" ", w[1], w[0])).when(
        (F.size(w) == 1) & (i == 0), w[0])))[0]


def _seeds(kind: str, placed: Column) -> Column:
    """Valid matches of a kind with their patterns, as MENTION."""
    marked = F.transform(placed, lambda z, i: F.when(_valid(kind, z["h"]), F.struct(
        _pattern(z["p"], i).alias("pattern"), F.lit(kind).alias("kind"), F.lower(z["h"]).alias("instance"),
        z["s"]["start"].alias("start"), z["s"]["stop"].alias("stop"), F.lit(False).alias("wordy"))))
    return F.filter(marked, lambda m: m["pattern"].isNotNull())


def _covered(kind: str, text: Column, placed: Column) -> Column:
    """The text with valid matches of a kind as letters, place by place."""
    parts = F.transform(placed, lambda z: F.concat(z["p"], F.when(_valid(kind, z["h"]), F.repeat(F.lit("x"), F.length(z["h"])))
                                                   .otherwise(z["h"])))
    return F.when(F.size(placed) > 0, F.concat(F.array_join(parts, ""), F.element_at(F.split(text, FORMS[kind], -1), -1))
                  ).otherwise(text)


def _unseen(placed: Column) -> Column:
    """Identifiers of no base form with their patterns, as MENTION; ``wordy`` are those without a digit."""
    def mention(z, i):
        own = _trimmed(z["h"])
        start = z["s"]["start"] + _leading(z["h"])
        fits = (F.length(own) >= IDENTIFIER_CHARS) & (F.length(_digits(own)) <= MOST_DIGITS) & own.rlike("[0-9]|.@.")
        return F.when(fits, F.struct(
            _pattern(z["p"], i).alias("pattern"), F.lit(None).cast("string").alias("kind"), F.lower(own).alias("instance"),
            start.alias("start"), (start + F.length(own)).alias("stop"), (~own.rlike("[0-9]")).alias("wordy")))

    return F.filter(F.transform(placed, mention), lambda m: m["pattern"].isNotNull())


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Seeds and unseen identifiers by text: page (hash of the text), the fields of MENTION and n, the text's copies.

    ``kind`` is null for unseen ones.
    """
    rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.unhex(F.sha2(text_col, 256)).alias("page"), F.col(text_col).alias("t"))
    rows = rows.withColumn("c", F.col("t"))
    for k in KINDS:
        rows = rows.withColumn(f"z_{k}", _placed(F.col("t"), FORMS[k]))
        rows = rows.withColumn("again", _placed(F.col("c"), FORMS[k])).withColumn("c", _covered(k, F.col("c"), F.col("again")))
    rows = rows.withColumn("z", _placed(F.col("c"), IDENTIFIER))
    none = F.array().cast(f"array<{MENTION}>")
    found = F.concat(*[F.coalesce(_seeds(k, F.col(f"z_{k}")), none) for k in KINDS], F.coalesce(_unseen(F.col("z")), none))
    return (rows.select("page", F.explode(found).alias("m")).select("page", "m.*")
            .groupBy("page", "pattern", "kind", "instance", "start", "stop", "wordy").agg(F.count("*").alias("n")))


def pattern_places(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each of the patterns stands before any word, over all texts."""
    words = docs.select(F.regexp_extract_all(text_col, F.lit(NON_SPACE), F.lit(0)).alias("words"))
    at = words.select(F.explode(F.transform("words", lambda w, i: _before(F.col("words"), i))).alias("pattern"))
    return at.join(patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("places"))


def _possible(docs: DataFrame, support: DataFrame, confidence: float, share: int) -> DataFrame:
    """Patterns of ``support`` that the places in one text of ``share`` do not rule out."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    places = pattern_places(part, support.select("pattern").distinct())
    return support.join(places, "pattern", "left").where(
        F.coalesce(F.col("places"), F.lit(0)) * confidence <= F.col("most")).select(*support.columns)


def learn_patterns(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE,
                   seen: DataFrame | None = None) -> DataFrame:
    """High-confidence patterns: pattern, kind, trust; of a pattern's kinds the most trusted, of equal trust the last by name.

    ``seen`` are settled mentions of ``docs``, if there are some already.
    """
    seen = settle(mentions(docs), "mentions") if seen is None else seen
    counts = seen.groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("seeds"), F.countDistinct("page").alias("pages"),
                                                 F.sum("n").alias("n"))
    unseen = counts.where("kind IS NULL").select("pattern", F.col("n").alias("others"))
    support = settle(counts.where("kind IS NOT NULL").where(F.least("seeds", "pages") >= MIN_SUPPORT).join(unseen, "pattern", "left")
                     .select("pattern", "kind", (F.col("n") + F.coalesce("others", F.lit(0))).alias("most")), "support")
    for share in SHARES:
        support = settle(_possible(docs, support, confidence, share), "support")
    places = settle(pattern_places(docs, support.select("pattern").distinct()), "places")
    # the graph: a pattern of a kind, its seeds of this kind and its unseen identifiers
    other = seen.groupBy("pattern", F.col("kind").alias("seed_kind"), "instance", "wordy").agg(F.sum("n").alias("n"))
    graph = settle(other.join(support, "pattern").where("seed_kind = kind OR seed_kind IS NULL AND (NOT wordy OR kind = 'email')")
                   .select("pattern", "kind", "instance", F.col("seed_kind").isNotNull().alias("seed"), "n"), "graph")
    trust = support.select("pattern", "kind", F.lit(0.0).alias("trust"))
    for _ in range(rounds):
        instances = (graph.join(trust, ["pattern", "kind"]).groupBy("kind", "instance")
                     .agg(F.when(F.max("seed"), 1.0).otherwise(F.sum(F.col("n") * F.col("trust")) / F.sum("n")).alias("trust")))
        trust = settle(graph.join(instances, ["kind", "instance"]).groupBy("pattern", "kind")
                       .agg(F.sum(F.col("n") * F.col("trust")).alias("trusted")).join(places, "pattern")
                       .select("pattern", "kind", (F.col("trusted") / F.col("places")).alias("trust")), "trust")
    best = trust.where(F.col("trust") >= confidence).groupBy("pattern").agg(F.max(F.struct("trust", "kind")).alias("best"))
    return settle(best.select("pattern", "best.kind", "best.trust"), "patterns")


def bootstrap_patterns(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE) -> list[tuple[str, str, float]]:
    """``learn_patterns`` as a sorted list, to look at; jobs pass the DataFrame on."""
    return sorted(tuple(r) for r in learn_patterns(docs, rounds, confidence).collect())


def _discovered(seen: DataFrame, patterns: DataFrame) -> DataFrame:
    """Unseen identifiers after a pattern, by text: page (the text's hash) and more (spans like the base ones)."""
    kinds = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    learned = patterns.select("pattern", F.col("kind").alias("own"), F.element_at(kinds, F.col("kind")).alias("kind_no"))
    found = seen.where("kind IS NULL").join(learned, "pattern").where("NOT wordy OR own = 'email'")
    return settle(found.groupBy("page").agg(F.collect_set(F.struct("start", "kind_no", "stop")).alias("more")), "found")


def find_personal_data(docs: DataFrame, patterns: DataFrame | list[tuple[str, str, float]] | None = None,
                       text_col: str = "text") -> DataFrame:
    """The input with ``base`` and ``spans``: sorted arrays of (start, kind number, stop), in code points.

    ``patterns`` come from ``learn_patterns`` or ``bootstrap_patterns``; null learns them from ``docs``.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    seen = settle(mentions(texts), "mentions")
    learned = learn_patterns(texts, seen=seen) if patterns is None else patterns
    if isinstance(learned, list):
        learned = docs.sparkSession.createDataFrame(learned, PATTERNS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(NO_SPANS)
    # a text is joined with what was found in it by its hash
    joined = docs.withColumn("__page", F.unhex(F.sha2(text, 256))).join(_discovered(seen, learned).select(
        F.col("page").alias("__page"), F.col("more").alias("__more")), "__page", "left")
    found = joined.withColumn("base", base_spans(text))
    free = F.filter("__more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return found.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(free, none)))).drop("__page", "__more")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, base_sha256, spans.

    Null texts count as empty and texts without matches have empty lists (the hash is that of the empty
    string). Repeated rows repeat; an empty table gives an empty result; only doc_id and text are read. A pattern trusted alike
    for two kinds is of the kind last by name. Very long texts are worked on whole, in one task each.
    """
    found = find_personal_data(docs.select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind_no"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans by the first one's."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    parts = scan_array(spans, F.lit(0), lambda at, s: F.greatest(at, s["stop"]), lambda at, s: F.when(s["start"] < at, "").otherwise(
        F.concat(F.substring(text, at + 1, s["start"] - at), F.get(tags, s["kind_no"]))), "string")
    last = F.array_max(F.transform(spans, lambda s: s["stop"]))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))).otherwise(text)
