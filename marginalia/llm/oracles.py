"""DuckDB SQL that says what the operators' queries return."""

from __future__ import annotations

from .common import RANK_BUCKETS
from .merkle import FANOUT
from .mixing import BUDGET_SHARE, HASH_BITS, LEVELS, MAX_EPOCHS, SEED, WEIGHTS
from .quality_rules import LEAST_LEFT, LEAST_WORDS, LINE_TEXTS, MOST_REMOVED
from .resampling import BUCKETS, LEAST_WORDS as RESAMPLED_WORDS, SEED as RESAMPLING_SEED, SHARE
from .sharding import MULTIPLIER, SHARDS


def crc32(blob: str, table: str = "crc.t") -> str:
    """The unsigned CRC-32 of a BLOB; ``table``: the list of its 256 steps."""
    return f"""xor(coalesce(list_reduce(list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT)"""


#: One row, t: CRC-32 of each byte, by the rule of its polynomial.
CRC_TABLE = """crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
)"""

OP1 = f"""
WITH RECURSIVE {CRC_TABLE},
leap(doc_id, key, jump, shard, grown) AS (
    SELECT DISTINCT doc_id, (CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END), 0::BIGINT, 0::BIGINT, 0::BIGINT
    FROM documents
    UNION ALL
    SELECT doc_id, k, floor((jump + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT,
        CASE WHEN jump < {SHARDS} THEN jump ELSE shard END, jump
    FROM (SELECT *, (key * {MULTIPLIER} + 1) % 18446744073709551616 AS k FROM leap WHERE jump <= {SHARDS})
),
placed AS (SELECT doc_id, max(shard)::INTEGER AS shard, max(grown)::INTEGER AS grown_shard FROM leap GROUP BY doc_id),
sized AS (
    SELECT d.doc_id, (octet_length(encode(coalesce(d.text, ''))) + 8)::BIGINT AS size, {crc32("encode(coalesce(d.text, ''))")}::BIGINT AS text_crc32
    FROM documents d, crc
)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, p.shard, p.grown_shard,
    row_number() OVER (PARTITION BY p.shard ORDER BY ('0x' || substr(md5(concat_ws('|', s.doc_id, s.text_crc32, s.size)), 1, 8))::BIGINT % {RANK_BUCKETS},
        s.doc_id NULLS FIRST, s.text_crc32, s.size) - 1 AS slot
FROM sized s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""

OP5 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
pairs AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) a JOIN v b ON a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs) WHERE rank <= 20
"""

OP3 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('h' || source, '') AS host FROM documents),
texts AS (SELECT DISTINCT text FROM t),
w AS (SELECT text, unnest(list_zip(ws, range(len(ws)))) AS x FROM (SELECT text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM texts)),
pos AS (SELECT text, x[1] AS word, x[2] AS i FROM w),
win AS (
    SELECT text, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY text ORDER BY i)
),
twice AS (SELECT text, i FROM (SELECT *, count(*) OVER (PARTITION BY text, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT text, count(DISTINCT i + d)::BIGINT AS n FROM twice, range(3) AS r(d) GROUP BY text),
lines AS (SELECT text, unnest(string_split(text, chr(10))) AS line FROM texts),
full_lines AS (SELECT text, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT text, (count(*) - count(DISTINCT line))::BIGINT AS n FROM full_lines GROUP BY text),
host_texts AS (SELECT DISTINCT host, text FROM t),
often AS (
    SELECT d.host, f.norm FROM (SELECT DISTINCT host, doc_id, text FROM t) d JOIN (SELECT DISTINCT text, norm FROM full_lines) f USING (text)
    GROUP BY d.host, f.norm HAVING count(*) > {LINE_TEXTS}
),
gone AS (
    SELECT h.host, h.text, count(*)::BIGINT AS lines, sum(len(string_split(f.norm, ' ')))::BIGINT AS words
    FROM host_texts h JOIN full_lines f USING (text) JOIN often o ON o.host = h.host AND o.norm = f.norm GROUP BY h.host, h.text
),
base AS (
    SELECT t.doc_id, t.host, t.text, (SELECT count(*) FROM pos WHERE pos.text = t.text)::BIGINT AS n_words,
        length(regexp_replace(t.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t.text) - length(translate(t.text, '#*$%&|<>', '')))::BIGINT AS n_symbols
    FROM t
),
joined AS (
    SELECT b.*, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(g.lines, 0)::BIGINT AS n_removed_lines, coalesce(g.words, 0)::BIGINT AS n_removed_words
    FROM base b LEFT JOIN dup USING (text) LEFT JOIN rep USING (text) LEFT JOIN gone g ON g.text = b.text AND g.host = b.host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, n_removed_words,
    (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words)
        AND n_removed_words <= n_words * {MOST_REMOVED}::DOUBLE AND n_words - n_removed_words >= {LEAST_LEFT} AS kept
FROM joined
"""


def _level(i: int) -> str:
    """CTEs nodes_i and given_i: the nodes of a level of the tree, and what each is given of its parent's budget."""
    here, parents, name = ", ".join(LEVELS[: i + 1]), ", ".join(LEVELS[:i]), LEVELS[i]
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[name].items())
    weight = f"CASE {name} {case} ELSE 1 END" if case else "1"
    budget = "(SELECT budget FROM total)" if i == 0 else f"(SELECT g.given FROM given_{i - 1} g WHERE {' AND '.join(f'g.{x} = n.{x}' for x in LEVELS[:i])})"
    by = f"PARTITION BY {parents}" if i else ""
    return f"""
nodes_{i} AS (SELECT n.*, {budget}::HUGEINT AS budget FROM (SELECT {here}, (sum(held) * {MAX_EPOCHS})::HUGEINT AS cap, {weight}::HUGEINT AS weight FROM leaves GROUP BY {here}) n),
open_{i} AS (
    SELECT *, cap * weight_on <= weight * (budget - cap_before) AS is_full FROM (
        SELECT *, coalesce(sum(cap) OVER before_it, 0)::HUGEINT AS cap_before, (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER before_it, 0))::HUGEINT AS weight_on
        FROM nodes_{i} WINDOW before_it AS ({by} ORDER BY cap::DOUBLE / weight::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
),
given_{i} AS (
    SELECT {here}, CASE WHEN is_full THEN cap ELSE
        (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}))::HUGEINT * weight // (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}))::HUGEINT END AS given
    FROM open_{i}
)"""


OP4 = f"""
WITH k AS (
    SELECT doc_id, lang, source AS src, coalesce(text, '') AS text, coalesce(lang, '') AS l, coalesce(source, '') AS s, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens,
        'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 4) AS domain FROM documents
),
leaves AS (SELECT domain, l AS lang, s AS source, sum(tokens)::BIGINT AS held FROM k GROUP BY ALL),
total AS (SELECT least(floor(sum(held) * {BUDGET_SHARE}::DOUBLE), sum(held) * {MAX_EPOCHS})::BIGINT AS budget FROM leaves),
{_level(0)},
{_level(1)},
{_level(2)},
plan AS (
    SELECT domain, lang, source, coalesce(given // nullif(held, 0), 0)::INTEGER AS epochs, (given - coalesce(given // nullif(held, 0), 0) * held)::BIGINT AS rest
    FROM leaves JOIN given_2 USING (domain, lang, source)
),
placed AS (
    SELECT k.*, p.epochs, p.rest, ('0x' || substr(md5(concat_ws('|', '{SEED}', p.epochs, k.doc_id, md5(k.text))), 1, {HASH_BITS // 4}))::BIGINT AS place
    FROM k JOIN plan p ON p.domain = k.domain AND p.lang = k.l AND p.source = k.s
),
used AS (
    SELECT *, epochs + CASE WHEN sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY place, doc_id, tokens ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS uses FROM placed
)
SELECT doc_id, domain, lang, src AS source, tokens, unnest(range(uses))::INTEGER AS epoch FROM used WHERE uses > 0
"""


def _runs(table: str) -> str:
    """Each run of one or two words of the texts of a table, by doc."""
    return f"""SELECT doc, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS run
        FROM (SELECT doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {table})"""


OP12 = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT 0 AS doc, coalesce(text, '') AS text FROM benchmark),
source_runs AS ({_runs("d")}),
target_runs AS ({_runs("b")}),
hashed AS (SELECT run, ({crc32("encode(run)")} % {BUCKETS})::BIGINT AS bucket FROM (SELECT run FROM source_runs UNION SELECT run FROM target_runs), crc),
found AS (SELECT doc, bucket FROM source_runs JOIN hashed USING (run)),
wanted AS (SELECT bucket FROM target_runs JOIN hashed USING (run)),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM found) + {BUCKETS})
        / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {BUCKETS}))))::BIGINT AS gain
    FROM (SELECT bucket, count(*) AS s FROM found GROUP BY bucket) LEFT JOIN (SELECT bucket, count(*) AS t FROM wanted GROUP BY bucket) USING (bucket)
),
weighed AS (
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(CASE WHEN total < 0 THEN -((-total + n - 1) // n) ELSE total // n END, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('{RESAMPLING_SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM d LEFT JOIN (SELECT doc, count(*)::BIGINT AS n, sum(gain)::BIGINT AS total FROM found JOIN gain USING (bucket) GROUP BY doc) USING (doc)
),
scored AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM weighed),
-- n words make 2 n - 1 features
placed AS (
    SELECT *, n_features >= {2 * RESAMPLED_WORDS - 1} AS able,
        row_number() OVER (PARTITION BY n_features >= {2 * RESAMPLED_WORDS - 1} ORDER BY score DESC, doc_id)::BIGINT AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {SHARE} * (SELECT count(*) FROM placed WHERE able) // 100 THEN place END AS rank FROM placed
"""

#: Levels of the SQL's trees: FANOUT to this power leaves.
_HEIGHT = 8


def _tree(name: str, leaves: str) -> str:
    """CTEs name_0 (tree, i, h, n: nodes of the tree at the level; key, leaf) to name_8 and name_path: siblings (left, right) of each leaf at each level."""
    out = [f"{name}_0 AS ({leaves})"]
    for k in range(1, _HEIGHT + 1):
        out.append(f"""{name}_{k} AS (
    SELECT tree, i // {FANOUT} AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY {name}_{k - 1}.i)) END AS h,
        (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n
    FROM {name}_{k - 1} GROUP BY tree, i // {FANOUT})""")
    steps = " UNION ALL ".join(
        f"""SELECT a.tree, a.key, {k} AS level, (SELECT coalesce(string_agg(b.h, '' ORDER BY b.i), '') FROM {name}_{k} b WHERE b.tree = a.tree AND b.i // {FANOUT} = (a.i // {FANOUT**k}) // {FANOUT} AND b.i < a.i // {FANOUT**k}) AS l,
        (SELECT coalesce(string_agg(b.h, '' ORDER BY b.i), '') FROM {name}_{k} b WHERE b.tree = a.tree AND b.i // {FANOUT} = (a.i // {FANOUT**k}) // {FANOUT} AND b.i > a.i // {FANOUT**k}) AS r
        FROM {name}_0 a WHERE a.n > {FANOUT**k}"""
        for k in range(_HEIGHT)
    )
    out.append(f"{name}_path AS (SELECT tree, key, list(struct_pack(l := l, r := r) ORDER BY level) AS path FROM ({steps}) GROUP BY tree, key)")
    return ",\n".join(out)


def _framed(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"


_HEAD = " || ".join(map(_framed, ("doc_id", "source", "lang", "n_chars")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = f"""
WITH {CRC_TABLE},
d AS (
    SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256({_HEAD} || {_framed("text")})) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
        coalesce('=' || lang, '') AS tree, doc_id, sha256({_HEAD} || {_framed("text")}) AS leaf,
        CASE WHEN coalesce({crc32("encode(doc_id::VARCHAR)")} % 3 = 0, false) THEN sha256({_HEAD} || {_framed(_LOWER)}) ELSE sha256({_HEAD} || {_framed("text")}) END AS after
    FROM documents, crc
),
{_tree("low", "SELECT tree, i, leaf AS h, n, i AS key FROM d")},
subroots AS (SELECT tree, h AS subroot FROM low_{_HEIGHT}),
{_tree("top", "SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, subroot AS h, count(*) OVER () AS n, tree AS key FROM subroots")},
ways AS (
    SELECT d.doc_id, d.leaf, d.after, s.subroot, (SELECT h FROM top_{_HEIGHT}) AS root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path
    FROM d JOIN subroots s USING (tree) LEFT JOIN low_path p ON p.tree = d.tree AND p.key = d.i LEFT JOIN top_path q ON q.key = d.tree
),
folded AS (
    SELECT *, sha256(coalesce(list_reduce(list_transform(path, lambda x: x.l || x.r), lambda a, b: a || b), '')) AS proof_sha256,
        list_reduce(list_prepend(struct_pack(l := after, r := ''), path), lambda a, x: struct_pack(l := sha256(x.l || a.l || x.r), r := '')).l AS folded_root
    FROM ways
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
