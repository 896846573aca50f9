"""DuckDB SQL for those text operators whose whole results it can express."""

from __future__ import annotations


def centroid_clustering(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Plain rounds of assignment and floored means over all vectors and centroids."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS cluster, v
  FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {k})"""]
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT r.vec_id, r.v, unnest(r.best) FROM (
    SELECT n.vec_id, n.v, min({{'distance': list_sum(list_transform(list_zip(n.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))),
                               'cluster': c.cluster}}) AS best
    FROM (SELECT row_number() OVER () AS row, * FROM kept) n, c{t} c GROUP BY n.row, n.vec_id, n.v) r)""")
        if t < rounds:
            steps.append(f"""
m{t} AS (
  SELECT cluster, place, sum(x) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS place FROM a{t}) GROUP BY cluster, place),
c{t + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(u.v, c.v) AS v FROM c{t} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM m{t} GROUP BY cluster) u USING (cluster))""")
    return f"""WITH {",".join(steps)}
SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


def archived_pages() -> str:
    """Sizes, base32 SHA-1 digests and revisits of all pages."""
    digit = "(instr('0123456789abcdef', substr(h, CAST(5 * i // 4 AS INTEGER) + {0}, 1)) - 1)"
    letter = f"((16 * {digit.format(1)} + {digit.format(2)}) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31"
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({letter} AS INTEGER) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN original IS NULL OR page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM f"""


SPACED = r"[^\x20\x09-\x0D]+"


def license_base() -> str:
    """Places of the base phrases of the license scan."""
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}    # fixed values
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()})) AS place FROM d"
        for p, label in phrases.items())
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     h AS ({places}),
     g AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                  array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


def quality_base() -> str:
    """Word, symbol, line and repetition counts of whole texts."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
     s AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
     x AS (SELECT doc_id, i, w[i:i + 4] AS five FROM s),
     r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM x),
     c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1)
           GROUP BY doc_id),
     l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '{SPACED}')) AS lines FROM d),
     q AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
           FROM d JOIN l ON d.doc_id = l.doc_id LEFT JOIN c ON d.doc_id = c.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q"""


def personal_data_base() -> str:
    """Valid matches of the base forms of personal data."""
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
             "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}       # fixed values
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    # every second digit from the right counts double, less nine beyond nine
    luhn = (f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, j: CAST(c AS INTEGER) * (2 - j % 2) "
            f"- CASE WHEN j % 2 = 0 AND CAST(c AS INTEGER) > 4 THEN 9 ELSE 0 END)) % 10 = 0")
    valid = {"email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda o: CAST(o AS HUGEINT) > 255)) = 0",
             "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 10 AND 15"}
    counts = ", ".join(f"CAST(len(list_filter(regexp_extract_all(text, '{forms[k]}'), lambda m: {valid[k]})) AS BIGINT) AS n_{k}" for k in forms)
    return f"SELECT doc_id, {counts} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
