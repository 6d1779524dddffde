"""DuckDB SQL of the operators 11 to 13, built from the same definitions."""

from __future__ import annotations


def _nibbles() -> list[int]:
    """CRC-32 of each half byte (reflected polynomial)."""
    out = list(range(16))
    for _ in range(4):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of the SQL expression ``text``, half a byte a step."""
    digit = "strpos('0123456789ABCDEF', p[{}]) - 1"
    halves = (f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), "
              f"lambda p: [{digit.format(2)}, {digit.format(1)}]))")
    step = f"xor(list_extract({_nibbles()}, CAST(xor(c, n) & 15 AS INT) + 1), c >> 4)"
    return f"xor(list_reduce({halves}, lambda c, n: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


# --- 13: minimax contiguous partition: capacity by dynamic programming over the groups' ends ---------

SHARDS = 16


def _sharding() -> str:
    first = "f1 AS MATERIALIZED (SELECT e, e AS c FROM g)"
    levels = [f"f{k} AS MATERIALIZED (SELECT g.e, min(greatest(p.c, g.e - p.e)) AS c FROM g JOIN (SELECT e, c FROM f{k - 1} "
              f"UNION ALL SELECT 0, 0) p ON p.e <= g.e GROUP BY g.e)" for k in range(2, SHARDS + 1)]
    cap = f"cap AS MATERIALIZED (SELECT (SELECT max(e) FROM g) AS t, (SELECT c FROM f{SHARDS} ORDER BY e DESC LIMIT 1) AS c)"
    ends = "(SELECT e FROM g UNION ALL SELECT 0)"
    early = [f"l{k} AS MATERIALIZED (SELECT min(x.e) AS e FROM {ends} x, {'cap' if k == SHARDS - 1 else f'cap, l{k + 1} n'} "
             f"WHERE x.e >= {'cap.t' if k == SHARDS - 1 else 'n.e'} - cap.c)" for k in range(SHARDS - 1, 0, -1)]
    late = [f"u{k} AS MATERIALIZED (SELECT max(x.e) AS e FROM g x, cap, {'(SELECT 0 AS e)' if k == 1 else f'u{k - 1}'} p "
            f"WHERE x.e <= p.e + cap.c)" for k in range(1, SHARDS)]
    share = ("k AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS k, sum(size) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS a FROM g), "
             f"share AS MATERIALIZED (SELECT coalesce((SELECT (cap.t - k.a) // ({SHARDS} - k.k) FROM k WHERE k.k < {SHARDS} AND NOT EXISTS (SELECT 1 FROM k j "
             f"WHERE j.k <= k.k AND j.size <= (cap.t - j.a + j.size) // ({SHARDS} + 1 - j.k)) ORDER BY k.k DESC LIMIT 1), cap.t // {SHARDS}) AS w FROM cap), "
             "h AS MATERIALIZED (SELECT e, s, sum(least(size, w)) OVER (ORDER BY e) AS z FROM g, share), "
             "zt AS MATERIALIZED (SELECT max(z) AS z FROM h)")
    cuts = ["c0 AS (SELECT 0::HUGEINT AS e, 0::HUGEINT AS z)"] + [
        f"c{k} AS MATERIALIZED (SELECT coalesce(min_by(x.e, abs(x.z - want) * 1e15::HUGEINT + x.e), max(cap.t)) AS e, "
        f"coalesce(min_by(x.z, abs(x.z - want) * 1e15::HUGEINT + x.e), max(zt.z)) AS z FROM cap, zt, "
        f"(SELECT p.e AS p, p.z + (zt.z - p.z) // {SHARDS + 1 - k} AS want FROM c{k - 1} p, zt) w LEFT JOIN h x "
        f"ON x.e > w.p AND x.e >= (SELECT e FROM l{k}) AND x.e <= (SELECT e FROM u{k}) AND x.e <= w.p + (SELECT c FROM cap))"
        for k in range(1, SHARDS)]
    shard = " + ".join(f"CAST(g.s >= (SELECT e FROM c{k}) AS INT)" for k in range(1, SHARDS))
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS x, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
r AS (SELECT x, min(doc_id) AS f, sum(size) AS size FROM d GROUP BY x),
g AS MATERIALIZED (SELECT x, size, sum(size) OVER (ORDER BY f, x) AS e, sum(size) OVER (ORDER BY f, x) - size AS s FROM r),
{", ".join([first, *levels, cap, *early, *late, share, *cuts])},
p AS (SELECT g.x, g.e, {shard} AS shard FROM g)
SELECT doc_id, size, {crc32("d.x")} AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY p.e, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM d JOIN p ON d.x = p.x
"""


OP13_SQL = _sharding()


# --- 12: importance resampling -------------------------------------------------------------------------

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
_RUNS = ("SELECT {id}, array_to_string(w[s:s + n - 1], ' ') AS f FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s "
         "FROM {t}, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)")

OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS MATERIALIZED ({_RUNS.format(id="doc_id", t="d")}), bf AS MATERIALIZED ({_RUNS.format(id="1 AS one", t="b")}),
u AS (SELECT f FROM df UNION SELECT f FROM bf),
k AS MATERIALIZED (SELECT f, {crc32("f")} % 10000 AS bucket FROM u),
s AS (SELECT bucket, count(*) AS n FROM df JOIN k ON df.f = k.f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN k ON bf.f = k.f GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM df) AS sa, (SELECT count(*) FROM bf) AS ta),
g AS (SELECT z.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sa + 10000)::DOUBLE
      / ((coalesce(s.n, 0) + 1)::DOUBLE * (ta + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM (SELECT unnest(range(10000)) AS bucket) z CROSS JOIN sums LEFT JOIN s ON s.bucket = z.bucket LEFT JOIN t ON t.bucket = z.bucket),
w AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM df JOIN k ON df.f = k.f JOIN g ON g.bucket = k.bucket GROUP BY doc_id),
x AS (SELECT d.doc_id, len(d.w) >= 20 AS ok, coalesce(w.n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
      CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id) AS k, count(*) FILTER (ok) OVER () AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND k <= 5 * n // 100 THEN k END AS rank FROM r
"""


# --- 11: conversation prefix trie ------------------------------------------------------------------------

OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
q AS MATERIALIZED (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS s, CAST({crc32("CAST(conv_id AS VARCHAR)")} % 9 AS INT) AS h FROM t GROUP BY conv_id),
b AS (SELECT k, max(CAST(strlen(x) AS BIGINT)) AS bytes FROM t GROUP BY k),
r AS MATERIALIZED (SELECT q.conv_id AS c, list_concat(coalesce(list_slice(z.s, 1, q.h), []), list_slice(q.s, q.h + 1, len(q.s))) AS s
      FROM q LEFT JOIN q z ON z.conv_id = q.conv_id - q.conv_id % 5),
p AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS depth FROM r),
n AS MATERIALIZED (SELECT array_to_string(s[1:depth], ',') AS path, depth, any_value(s[1:depth]) AS s, min(c) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = depth), '')) AS ends
      FROM p GROUP BY 1, 2),
u AS MATERIALIZED (SELECT n.*, array_to_string(s[1:depth - 1], ',') AS parent, coalesce((n_convs - 1) * bytes, 0) AS saved
      FROM n LEFT JOIN b ON depth > 0 AND b.k = n.s[depth]),
ch AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM u WHERE depth > 0 GROUP BY 1, 2),
v AS (SELECT u.*, coalesce(ch.n, 0) AS n_children FROM u LEFT JOIN ch ON ch.parent = u.path AND ch.depth = u.depth),
a AS (SELECT array_to_string(s[1:d], ',') AS path, d AS depth, sum(CAST(n_children = 0 AS BIGINT)) AS leaves, sum(saved) AS saved
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM v) GROUP BY 1, 2)
SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(a.leaves AS BIGINT) AS n_leaves,
       CAST(a.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN a ON a.path = v.path AND a.depth = v.depth LEFT JOIN n o ON v.depth > 0 AND o.path = v.parent AND o.depth = v.depth - 1
"""
