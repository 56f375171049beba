"""DuckDB SQL for the queries that SQL can express.

Left out: op3, op6 (tokenizer files), op5, op12 (fitted), op9 and op10 (Spark's hash decides order and bounds), and
the pipeline, which holds them; tests compare these with plain versions.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[\x20\x09-\x0D]*|[^.!?\n]+') AS s FROM documents),
norm AS (SELECT doc_id, s, list_transform(s, lambda x: trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS n FROM cut WHERE text IS NOT NULL),
counted AS (SELECT *, list_transform(n, lambda x: CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, ' ', '')) + 1 END) AS w FROM norm),
places AS (SELECT *, unnest(range(1, len(n) + 1)) AS p FROM counted),
spans AS (SELECT doc_id, n, p AS b, list_min(list_filter(range(p + 1, least(len(n), p + 21) + 1), lambda q: list_sum(w[p:q]) >= 20)) AS e FROM places
  UNION ALL SELECT doc_id, n, list_max(list_filter(range(greatest(1, p - 21), p), lambda q: list_sum(w[q:p]) >= 20)), p FROM places),
runs AS (SELECT DISTINCT doc_id, b, e, array_to_string(n[b:e], chr(1)) AS run FROM spans WHERE b IS NOT NULL AND e IS NOT NULL),
again AS (SELECT doc_id, b, e FROM (SELECT doc_id, b, e, row_number() OVER (PARTITION BY run ORDER BY doc_id, b) AS k FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(b - 1, e)) AS i FROM again),
sent AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM cut),
islands AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g),
removed AS (SELECT doc_id, '[' || string_agg('{{"start":' || a || ',"end":' || b || '}}', ',' ORDER BY a) || ']' AS removed, CAST(sum(b - a) AS BIGINT) AS n FROM islands GROUP BY doc_id),
kept AS (SELECT s.doc_id, coalesce(string_agg(s.s, '' ORDER BY s.i) FILTER (g.i IS NULL), '') AS text FROM sent s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i GROUP BY s.doc_id)
SELECT c.doc_id, CASE WHEN r.n IS NULL THEN c.text ELSE k.text END AS text, CAST(coalesce(len(c.s), 0) AS BIGINT) AS n_sentences, coalesce(r.n, 0) AS n_removed, coalesce(r.removed, '[]') AS removed
FROM cut c LEFT JOIN removed r ON r.doc_id = c.doc_id LEFT JOIN kept k ON k.doc_id = c.doc_id"""

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS nb FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * nb >= 75 * (x.n + y.n - nb)),
e AS (SELECT a AS src, b AS dst FROM links UNION ALL SELECT b, a FROM links),
cc(id, lab) USING KEY (id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.dst, min(cc.lab) FROM cc JOIN e ON e.src = cc.id JOIN recurring.cc r ON r.id = e.dst WHERE cc.lab < r.lab GROUP BY e.dst)
SELECT id AS doc_id, coalesce(n.n, 0) AS n_shingles, lab AS component_id FROM cc LEFT JOIN n ON n.doc_id = id"""

_TURN = "'<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)"


def _side(side: str) -> str:
    return f"""coalesce(array_to_string(list_transform({side}[k + 1:], lambda t: {_TURN}), ''), '')"""


def _mask(side: str) -> str:
    """Spans of assistant turns: running lengths by a window over the turns."""
    return f"""{side}m AS (SELECT pair_id, string_agg(CAST(pos + 13 + length(coalesce(role, '')) AS VARCHAR) || '-' || CAST(pos + size - 1 AS VARCHAR), ',' ORDER BY i) AS m
  FROM (SELECT pair_id, i, role, size, coalesce(sum(size) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM (SELECT pair_id, i, t.role AS role, 24 + length(coalesce(t.role, '')) + length(coalesce(t.text, '')) AS size FROM (SELECT pair_id, unnest({side}[k + 1:]) AS t, unnest(range(len({side}[k + 1:]))) AS i FROM cut)))
  WHERE role = 'assistant' GROUP BY 1)"""


OP4 = f"""
WITH t AS (SELECT conv_id AS pair_id, struct_pack(turn := turn, role := role, text := text) AS t FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT pair_id, list_sort(list(t)) AS c FROM t GROUP BY 1),
placed AS (SELECT *, list_max(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant')) AS last FROM whole),
answers AS (SELECT pair_id, struct_pack(text := c[last].text) AS a FROM placed WHERE last IS NOT NULL),
other AS (SELECT p.*, coalesce(n.a, f.a).text AS answer FROM placed p LEFT JOIN answers n ON n.pair_id = p.pair_id + 1 CROSS JOIN (SELECT arg_min(a, pair_id) AS a FROM answers) f),
sides AS (SELECT pair_id, c, list_transform(c, lambda t, i: CASE WHEN i = last THEN struct_pack(turn := t.turn, role := t.role, text := answer) ELSE t END) AS r FROM other),
cut AS (SELECT *, coalesce((SELECT min(i) FROM range(1, 1 + least(len(c), len(r))) g(i) WHERE c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text) - 1, least(len(c), len(r))) AS k FROM sides),
{_mask('c')}, {_mask('r')}
SELECT cut.pair_id, CAST(k AS BIGINT) AS n_common, CAST(len(c) AS BIGINT) AS n_chosen, CAST(len(r) AS BIGINT) AS n_rejected, coalesce(array_to_string(list_transform(c[:k], lambda t: {_TURN}), ''), '') AS prompt,
  {_side('c')} AS chosen, {_side('r')} AS rejected, coalesce(cm.m, '') AS chosen_mask, coalesce(rm.m, '') AS rejected_mask
FROM cut LEFT JOIN cm ON cm.pair_id = cut.pair_id LEFT JOIN rm ON rm.pair_id = cut.pair_id"""

_FIT = "len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0"
OP7 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {_FIT}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP8 = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND {_FIT} AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9::DOUBLE),
n AS (SELECT src, count(*) AS n FROM links GROUP BY 1),
cc(id, lab) USING KEY (id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.dst, min(cc.lab) FROM cc JOIN links e ON e.src = cc.id JOIN recurring.cc r ON r.id = e.dst WHERE cc.lab < r.lab GROUP BY e.dst)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, lab AS component_id, lab = id AS kept FROM cc LEFT JOIN n ON src = id"""


OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) g(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= 10),
inner_ AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(f) AS most FROM f, range(1, 3) g(i) WHERE k = 3 GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN inner_ i USING (lang, phrase) WHERE k > 1 AND (most IS NULL OR 100 * most < 50 * f.f)),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, g.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN range(1, 3) g(cut) ON g.cut < c.k JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:g.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[g.cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM best JOIN n USING (lang)
QUALIFY rank <= 2000"""


def _part(v: str) -> str:
    return f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


def _levels(name: str, base: str) -> str:
    return f"""{name}(tree, lev, pos, node, n) AS ({base} UNION ALL SELECT tree, lev + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY tree, lev, pos // 8)"""


_CRC = """xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT)),
  lambda c, b: list_reduce(range(8)::UBIGINT[], lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::UBIGINT) ELSE d >> 1 END, xor(c, b)), 4294967295::UBIGINT))"""
OP13 = f"""
WITH RECURSIVE l AS (SELECT doc_id, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf('text')} END AS met, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
{_levels('a', 'SELECT tree, 0, pos, leaf, n FROM p')},
s AS MATERIALIZED (SELECT tree, node AS subroot FROM a WHERE n = 1),
{_levels('b', 'SELECT -1, 0, tree, subroot, (SELECT count(*) FROM s) FROM s')},
every AS MATERIALIZED (SELECT * FROM a WHERE n > 1 UNION ALL SELECT * FROM b WHERE n > 1),
runs AS MATERIALIZED (SELECT tree, lev, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM every GROUP BY ALL),
h AS (SELECT tree, coalesce(max(lev) + 1, 0) AS height FROM every GROUP BY tree),
path AS (SELECT p.tree, p.pos, g.lev AS step, r.nodes, p.pos // CAST(8 ** g.lev AS BIGINT) % 8 AS place FROM p JOIN h USING (tree), range(height) g(lev) JOIN runs r ON r.tree = p.tree AND r.lev = g.lev AND r.run = p.pos // CAST(8 ** (g.lev + 1) AS BIGINT)
  UNION ALL SELECT p.tree, p.pos, 1000 + g.lev, r.nodes, p.tree // CAST(8 ** g.lev AS BIGINT) % 8 FROM p JOIN h ON h.tree = -1, range(height) g(lev) JOIN runs r ON r.tree = -1 AND r.lev = g.lev AND r.run = p.tree // CAST(8 ** (g.lev + 1) AS BIGINT)),
proof AS (SELECT tree, pos, list(struct_pack(nodes := nodes, place := place) ORDER BY step) AS path FROM path GROUP BY ALL),
f AS (SELECT p.*, s.subroot, (SELECT node FROM b WHERE n = 1) AS root, coalesce(path, []) AS path FROM p JOIN s USING (tree) LEFT JOIN proof q ON q.tree = p.tree AND q.pos = p.pos),
g AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: array_to_string(list_concat(x.nodes[:x.place], x.nodes[x.place + 2:]), '')), ''), '')) AS proof_sha256,
  list_reduce(path, lambda v, x: struct_pack(nodes := [sha256(array_to_string(list_concat(x.nodes[:x.place], [v.nodes[1]], x.nodes[x.place + 2:]), ''))], place := 0::BIGINT), struct_pack(nodes := [met], place := 0::BIGINT)).nodes[1] AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op2_ngram_jaccard_join": OP2, "op4_preference_format": OP4, "op7_exact_topk": OP7, "op8_embedding_near_dedup": OP8, "op11_phrase_collocations": OP11, "op13_merkle_manifest": OP13}
