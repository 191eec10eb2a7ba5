"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP10 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

# op11: CRC-32 byte by byte, pairs by words with one position left out
OP11 = r"""
WITH RECURSIVE
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i))),
occurs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(0, length(code) // 2), lambda i:
      (strpos('0123456789ABCDEF', code[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', code[2 * i + 2]) - 1)),
    lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1]))) AS h
  FROM (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM occurs), crc_table),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
          FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
one_way AS (SELECT DISTINCT h.word, h.n, v.word AS near, v.n AS near_n FROM holes AS h JOIN v ON h.rest = v.word),
near AS (SELECT * FROM one_way UNION ALL SELECT near, near_n, word, n FROM one_way
         UNION ALL SELECT x.word, x.n, y.word, y.n FROM holes AS x JOIN holes AS y
           ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS form_n,
                min(encode(near)) FILTER (near_n = top) AS near
         FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN form_n >= 2 * n THEN decode(near) END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
      FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS further FROM f
          UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON chain.further = f.word)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n
FROM f JOIN chain ON chain.word = f.word AND chain.further IS NULL
"""

# op12: patterns, rules and words stated again, the fixed ones as the contract words them
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INT
         WHEN {_DIGITS}[-i]::INT > 4 THEN {_DIGITS}[-i]::INT * 2 - 9 ELSE {_DIGITS}[-i]::INT * 2 END)) % 10 = 0"""
_CODE = "replace(hit, ' ', '')"
_MOD97 = f"""list_reduce(list_prepend(0::BIGINT, list_transform(
    string_split(substr({_CODE}, 5) || left({_CODE}, 4), ''), lambda c:
    CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)),
    lambda m, v: CASE WHEN v < 10 THEN (m * 10 + v) % 97 ELSE (m * 100 + v) % 97 END) = 1"""
_CLEAR = "NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]')"
_PII = [   # name, pattern, rule, score, telling, misleading
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 90,
     "mail|contact|write|kontakt|correo|courriel", "example|noreply"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
     "list_max(list_transform(string_split(hit, '.'), lambda p: p::HUGEINT)) <= 255", 60,
     "ip|host|server|address|adresse|login", "version|release|section|chapter"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}", 70,
     "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte", "isbn|order|invoice|serial|tracking"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15", 70,
     "phone|tel|call|mobile|cell|fax|telefon|whatsapp", "version|build|score"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
     f"{_CLEAR} AND {_MOD97}", 80, "iban|account|bank|konto|cuenta|compte", "token|hash|serial"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
     f"{_CLEAR} AND right(before, 1) <> '-' AND left(after, 1) <> '-' AND left(hit, 3) NOT IN ('000', '666') "
     "AND left(hit, 1) <> '9' AND hit[5:6] <> '00' AND right(hit, 4) <> '0000'", 30,
     "ssn|social security|tax id|taxpayer", "order|invoice|part|serial"),
    ("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
     f"{_CLEAR} AND NOT regexp_matches(before, '[+0-9][ ().-]*$') AND NOT regexp_matches(after, '^[.-]?[0-9]')",
     30, "phone|tel|call|mobile|cell|fax|telefon|whatsapp", "order|invoice|serial|isbn"),
]


def _pii_kind(no: int, pattern: str, rule: str, score: int, telling: str, misleading: str) -> str:
    return rf"""
    SELECT uid, {no} AS kind, stop - length(hit) AS start, stop,
           greatest(0, least(100, {score}
             + CASE WHEN regexp_matches(before || ' ' || after, '(?i)(^|[^a-z])({telling})') THEN 35 ELSE 0 END
             - CASE WHEN regexp_matches(before || ' ' || after, '(?i)(^|[^a-z])({misleading})') THEN 30 ELSE 0 END)) AS score
    FROM (SELECT uid, hit, right(piece, 48) AS before, left(after, 24) AS after,
                 sum(length(piece) + length(hit)) OVER (PARTITION BY uid ORDER BY no) AS stop
          FROM (SELECT uid, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS piece, unnest(pieces[2:]) AS after,
                       unnest(range(len(hits))) AS no
                FROM (SELECT uid, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS pieces
                      FROM d)))
    WHERE {rule}"""


_PII_NAMES = "[" + ", ".join(f"'{k[0]}'" for k in _PII) + "]"
OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, {_PII_NAMES}[kind] || ':' || start || ':' || stop AS said
      FROM ({" UNION ALL ".join(_pii_kind(no, *k[1:]) for no, k in enumerate(_PII, 1))})
      WHERE kind <= 4 OR score >= 50)
SELECT doc_id, count(*) FILTER (kind = 1) AS n_email, count(*) FILTER (kind = 2) AS n_ip,
       count(*) FILTER (kind = 3) AS n_card, count(*) FILTER (kind = 4) AS n_phone,
       sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind <= 4), '')) AS base_sha256,
       coalesce(string_agg(said, ',' ORDER BY start, kind), '') AS spans,
       coalesce(string_agg(score::VARCHAR, ',' ORDER BY start, kind), '') AS scores
FROM d LEFT JOIN s USING (uid) GROUP BY uid, doc_id
"""

OP13 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.lab = r.lab AS same,
             list_inner_product(a.v, r.v)::BIGINT AS score
      FROM r AS a, r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10, "op11_spelling": OP11, "op12_pii": OP12, "op13_hard_negatives": OP13}
