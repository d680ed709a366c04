"""The conversation operators in plain DuckDB SQL."""

from __future__ import annotations


def _nibbles() -> list[int]:
    """CRC-32 of each half byte."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, two half bytes at a time."""
    table = str(_nibbles()) + "::BIGINT[]"

    def half(c: str) -> str:
        return f"xor(({c}) >> 4, ({table})[(({c}) & 15) + 1])"

    letters = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {letters}), lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"


TRIE_SQL = rf"""WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
seq AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, md5(text)) AS s FROM given GROUP BY conv_id),
heads AS (SELECT conv_id, s, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM seq),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM heads a LEFT JOIN seq b ON b.conv_id = a.base),
member AS (SELECT conv_id, s[1:d] AS p, d, len(s) AS n FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM member GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
val AS (SELECT n.*, coalesce(k.n, 0) AS n_children,
    CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.p[d].text, '[^\x20\x09-\x0D]+')) END AS own FROM node n LEFT JOIN kids k ON k.p = n.p),
sub AS (SELECT p[1:k] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(d + 1)) AS k FROM val) GROUP BY 1)
SELECT v.conv_id, v.d::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, s.n_leaves,
    s.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM val v JOIN sub s ON s.p = v.p LEFT JOIN node q ON v.d > 0 AND q.p = v.p[1:v.d - 1]"""


#: Rows of the weight (cost, audit): DuckDB compares structs field by field.
_NONE = "struct_pack(c := 1000000000000, a := '')"


def _plus(rest: str, cost: str, letter: str) -> str:
    return f"struct_pack(c := {rest}.c + {cost}, a := '{letter}' || {rest}.a)"


def _gap() -> str:
    return ", ".join(f"list_min([u{q}, {_plus(f'u{n}', '3', 'I')}]) AS v{q}" for q, n in enumerate((2, 2, 3, 2)))


def _used(q: int, after: int, keeps: dict[str, int]) -> str:
    stay = "CASE WHEN truncated THEN 3 ELSE 0 END"
    kept = " ".join(f"WHEN initial = '{i}' THEN {_plus(f'v{s}', stay, 'K')}" for i, s in keeps.items())
    kept = f"CASE WHEN must_go THEN {_NONE} {kept} ELSE {_NONE} END"
    other = f"CASE WHEN must_go THEN {_NONE} ELSE {_plus(f'v{after}', f'3 + {stay}', 'R')} END"
    return f"list_min([{_plus(f'v{q}', '4', 'D')}, {kept}, {other}]) AS u{q}"


_STATES = ((2, {"s": 1, "u": 2}), (2, {"u": 2}), (3, {"a": 3}), (2, {"u": 2}))

REPAIR_SQL = rf"""WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
picked AS (SELECT *, {crc32_sql("name")} % 20 AS k FROM given),
damaged AS (SELECT conv_id, turn, role AS was_role, md5(text) AS was_text, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM picked),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, was_role, was_text, copy) AS i, left(role, 1) AS initial FROM damaged),
judged AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM placed),
line AS (SELECT *, blank OR again AS must_go FROM judged),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (truncated AND NOT must_go) AS truncated,
    count(*) FILTER (i > 1 AND was || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM line GROUP BY conv_id),
ends AS (SELECT struct_pack(c := 0, a := '') AS u0, {_NONE} AS u1, {_NONE} AS u2, struct_pack(c := 0, a := '') AS u3),
dp AS (SELECT conv_id, n AS i, {_gap()} FROM facts, ends
    UNION ALL
    SELECT conv_id, i, {_gap()} FROM (SELECT d.conv_id, d.i - 1 AS i, {", ".join(_used(q, n, k) for q, (n, k) in enumerate(_STATES))}
        FROM dp d JOIN line l ON l.conv_id IS NOT DISTINCT FROM d.conv_id AND l.i = d.i)),
best AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM dp WHERE i = 0),
walk AS (SELECT conv_id, audit, 0 AS pos, 0 AS i, 0 AS q, [] :: VARCHAR[] AS said FROM best
    UNION ALL
    SELECT w.conv_id, audit, pos + 1, w.i + CASE WHEN letter = 'I' THEN 0 ELSE 1 END,
        CASE letter WHEN 'D' THEN q WHEN 'K' THEN CASE l.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN q = 2 THEN 3 ELSE 2 END END,
        CASE letter WHEN 'D' THEN said WHEN 'K' THEN list_append(said, l.role || ':' || l.text)
            ELSE list_append(said, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN letter = 'R' THEN l.text ELSE '' END) END
    FROM (SELECT *, substring(audit, pos + 1, 1) AS letter FROM walk WHERE pos < length(audit)) w
    LEFT JOIN line l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1),
told AS (SELECT conv_id, audit, sha256(array_to_string(said, chr(10))) AS digest FROM walk WHERE pos = length(audit))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(t.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""
