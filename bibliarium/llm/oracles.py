"""DuckDB SQL with the results of the queries that SQL can express, over the same tables.

Words are cut and letters folded as the operators do it. Places of matches come from the lengths of the matches and of
what stands between them.
"""

from __future__ import annotations

#: Fixed values of the contract's patterns, as RE2 takes them.
WORD = r"[^\x20\x09-\x0D]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN_KEY = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = ASSIGN_KEY + r"""[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(name: str, kind: str, rank: int, pattern: str, keep: str) -> str:
    """A table of (doc_id, kind, rank, s, e) of a pattern's matches m of which keep holds."""
    p = _quoted(pattern)
    return f"""{name}_l AS (SELECT doc_id, regexp_extract_all(t, {p}) AS ms, regexp_split_to_array(t, {p}) AS gaps FROM d),
  {name}_u AS (SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS k FROM {name}_l),
  {name}_p AS (SELECT doc_id, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM {name}_u),
  {name} AS (SELECT doc_id, '{kind}' AS kind, {rank} AS rank, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM {name}_p WHERE {keep})"""


def _spans(kinds: list[tuple[str, str, str]], order: str) -> str:
    """doc_id, a count of each kind and the digest of all spans, in the order given."""
    tables = ",\n  ".join(_matches(f"k{i}", k, i, p, keep) for i, (k, p, keep) in enumerate(kinds))
    every = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(kinds)))
    counts = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in kinds)
    return f"""WITH {DOCS}, {tables},
  spans AS ({every})
  SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}), '')) AS base_sha256
  FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id"""


SECRETS = _spans([
    ("assign", ASSIGN, rf"""length(regexp_replace(m, {_quoted("^" + ASSIGN_KEY + r"[\"']?\x20*[:=]\x20*[\"']?")}, '')) >= 12"""),
    ("access", ACCESS, "length(m) >= 18"),
    ("hex", HEX, "length(m) >= 16"),
], "s, rank")

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
PERSONAL = _spans([
    ("email", EMAIL, "true"),
    ("ip", IP, "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
    ("card", CARD, f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) ELSE CAST(x AS INT) * 2 - CASE WHEN CAST(x AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"),
    ("phone", PHONE, f"length({_DIGITS}) BETWEEN 9 AND 15"),
], "rank, s")

QUALITY = f"""WITH {DOCS}, w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
  three AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
  grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM three),
  twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
  repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY doc_id),
  lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
  made AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
    FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN repeats ON repeats.doc_id = w.doc_id)
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM made"""

FINGERPRINTS = f"""WITH {DOCS}, o AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS follow FROM d)
  SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(t[1 : n - n // 2] || follow[1 : n // 2]) AS edited_sha256 FROM o"""

_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
TOKENS = f"""WITH k AS (SELECT doc_id, {_CRC.format("CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out, list_append(regexp_extract_all({FOLDED.format("coalesce(text, '')")}, '{WORD}'), ' ') AS w FROM documents),
  u AS (SELECT doc_id, held_out, unnest(w) AS w FROM k), c AS (SELECT w, count(*) AS c FROM u WHERE NOT held_out GROUP BY w),
  s AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
  SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
    round(sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))), 4) AS base_score
  FROM u LEFT JOIN c ON c.w = u.w CROSS JOIN s GROUP BY doc_id"""

JACCARD = f"""WITH RECURSIVE k AS (SELECT doc_id, regexp_extract_all({FOLDED.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
  g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM k),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b),
  low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
  SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, least(k.doc_id, coalesce(low.b, k.doc_id)) AS component_id, coalesce(many.n, 0) AS n_links
  FROM k LEFT JOIN n ON n.doc_id = k.doc_id LEFT JOIN low ON low.a = k.doc_id LEFT JOIN many ON many.a = k.doc_id"""

REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
  w AS (SELECT doc_id, i, md5_number(h[2 * i + 1 : 2 * i + 400]) AS k FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
  r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
  f AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS fresh FROM r),
  j AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM f),
  runs AS (SELECT doc_id, j, min(i) AS lo, max(i) + 200 AS hi FROM j GROUP BY 1, 2),
  gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
  kept AS (SELECT d.doc_id, any_value(d.n) AS n, count(lo) AS spans, coalesce(sum(hi - lo), 0) AS gone, coalesce(string_agg(h[2 * before + 1 : 2 * lo], '' ORDER BY lo), '') || any_value(h)[2 * coalesce(max(hi), 0) + 1 :] AS left_over
    FROM d LEFT JOIN gaps ON gaps.doc_id = d.doc_id GROUP BY d.doc_id)
  SELECT doc_id, n AS n_bytes, CAST(gone AS BIGINT) AS n_removed, spans AS n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM kept"""

WHITENING = """WITH ok AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT) + 100000) AS x FROM ok),
  c AS (SELECT r, vec_id, generate_subscripts(x, 1) AS j, unnest(x) AS c FROM x),
  s AS (SELECT j, sum(c) AS s, count(*) AS n FROM c GROUP BY j)
  SELECT any_value(vec_id) AS vec_id, CAST(any_value(n) AS BIGINT) AS n, CAST(sum((n * c - s) * (n * c - s)) AS BIGINT) AS deviation FROM c JOIN s ON s.j = c.j GROUP BY r"""


def _step(fault: str, role: str) -> str:
    """The states' best (cost, audit) after a row, each as text that sorts by cost, then by audit; q0 to q3 are those before."""

    def arc(q: str, cost: str, letter: str, when: str = "true") -> str:
        return f"CASE WHEN {when} THEN lpad(CAST(CAST(left({q}, 6) AS BIGINT) + {cost} AS VARCHAR), 6, '0') || substr({q}, 7) || '{letter}' END"

    extra, free = f"CASE WHEN {fault} = 't' THEN 1 ELSE 0 END", f"{fault} NOT IN ('b', 'd')"
    into = {0: [], 1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}
    cols = []
    for q, ways in into.items():
        arcs = [arc(f"q{q}", "3", "D")]
        arcs += [arc(f"q{p}", extra, "K", f"{free} AND left({role}, 1) = '{x}'") for p, x in ways]
        arcs += [arc(f"q{p}", f"2 + {extra}", "R", free) for p, x in ways if x != "s"]
        cols.append(f"least({', '.join(arcs)}, NULL) AS q{q}" if len(arcs) > 1 else f"{arcs[0]} AS q{q}")
    return ", ".join(cols)


def _inserts(table: str) -> str:
    """A subquery with the states' best when rows may be inserted there: one, or two in a row."""

    def ins(q: str) -> str:
        return f"lpad(CAST(CAST(left({q}, 6) AS BIGINT) + 2 AS VARCHAR), 6, '0') || substr({q}, 7) || 'I'"

    two = f"least(q2, {ins('q0')}, {ins('q1')}, {ins('q3')})"
    return f"(SELECT * EXCLUDE (q2, q3, x2, x3), least(x2, {ins('x3')}) AS q2, least(x3, {ins('x2')}) AS q3 FROM (SELECT *, {two} AS x2, q3 AS x3 FROM {table}))"


#: Damage and faults as the contract has them; the cheapest audit by a recursive table over places, one row a conversation.
CONVERSATIONS = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
  d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
  o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS t FROM d),
  f AS (SELECT conv_id, turn, role, text, i, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
  c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
  p(conv_id, i, q0, q1, q2, q3) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM f
    UNION ALL SELECT f.conv_id, f.i, STEP FROM {{}} AS p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1),
  e AS (SELECT p.conv_id, least(q0, q3) AS best FROM {{}} AS p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i),
  a AS (SELECT conv_id, CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit FROM e),
  u AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos FROM a WHERE audit <> ''),
  w AS (SELECT conv_id, edit, pos, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS nth, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lines FROM u),
  l AS (SELECT w.conv_id, pos, CASE WHEN edit = 'K' THEN f.role WHEN (lines - nth) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END AS line
    FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE edit <> 'D'),
  r AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY pos) AS repaired FROM l GROUP BY conv_id),
  every AS (SELECT DISTINCT conv_id FROM conversations)
  SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
  FROM every LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM every.conv_id""".replace("STEP", _step("f.fault", "f.role")).format(_inserts("p"), _inserts("p"))

PASSAGES = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
  g AS (SELECT r, i, md5_number(array_to_string(w[i : i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
  again AS (SELECT r, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
  fresh AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 35, true) AS fresh FROM again),
  j AS (SELECT r, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY i) AS j FROM fresh),
  runs AS (SELECT r, j, min(i) AS lo, max(i) + 35 AS hi FROM j GROUP BY 1, 2),
  gaps AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS before FROM runs),
  parts AS (SELECT g.r, lo, w[before : lo - 1] AS part FROM gaps AS g JOIN d ON d.r = g.r UNION ALL SELECT d.r, len(w) + 1 AS lo, w[coalesce(m.hi, 1) :] AS part FROM d LEFT JOIN (SELECT r, max(hi) AS hi FROM runs GROUP BY r) AS m ON m.r = d.r),
  kept AS (SELECT r, string_agg(array_to_string(part, ' '), ' ' ORDER BY lo) AS t, sum(len(part)) AS n FROM parts WHERE len(part) > 0 GROUP BY r)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r"""
