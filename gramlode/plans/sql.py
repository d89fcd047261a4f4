"""SQL of the registered queries, in DuckDB's dialect."""

from __future__ import annotations

from ..functions.hashing import MIX_1, MIX_2, MIX_SHIFT, place_values
from ..functions.sequences import LETTERS, NUCLEOTIDES
from .queries import SAMPLED, SPEC, THETA, TREE_BITS, TWO, VECTOR_BITS

_WRAP = "18446744073709551616::UHUGEINT"


def _core(mer: str, values: tuple[tuple[int, ...], ...]) -> str:
    out = ""
    for i, row in enumerate(values):
        cases = " ".join(f"WHEN '{c}' THEN {v}::UBIGINT" for c, v in zip("ACGT", row, strict=True))
        term = f"CASE substr({mer}, {i + 1}, 1) {cases} END"
        out = f"xor({out}, {term})" if out else term
    return out


def hashed(source: str, k: int, seed: int = 0, name: str = "h", canonical: bool = True) -> str:
    """source with a column name: the unsigned hash of its column m."""
    f, b = place_values(k, seed)
    total = f"(({_core('m', f)})::UHUGEINT + ({_core('m', b)})::UHUGEINT) % {_WRAP}" if canonical else _core("m", f)
    u0 = f"SELECT *, ({total})::UBIGINT AS u0 FROM {source}"
    mixes = u0
    for i, m in enumerate((MIX_1, MIX_2)):
        mixes = f"SELECT * EXCLUDE (u{i}), ((xor(u{i}, u{i} >> {MIX_SHIFT})::UHUGEINT * {m}::UHUGEINT) % {_WRAP})::UBIGINT AS u{i + 1} FROM ({mixes})"
    return f"SELECT * EXCLUDE (u2), greatest(xor(u2, u2 >> {MIX_SHIFT}), 1::UBIGINT) AS {name} FROM ({mixes})"


def _nt(text: str) -> str:
    return rf"translate(lower(regexp_replace({text}, '[ \n\t\r.,;:!?]', '', 'g')), '{LETTERS}', '{NUCLEOTIDES}')"


def _mers(key: str, table: str, k: int = 20, alias: str = "") -> str:
    alias = alias or key
    return f"""SELECT {alias}, m FROM (SELECT {alias}, substr(p, i, {k}) AS m FROM (SELECT {key} AS {alias}, p, unnest(range(1, greatest(length(p) - {k - 2}, 1))) AS i FROM (SELECT *, {_nt("text")} AS p FROM {table})))
 WHERE regexp_full_match(m, '[ACGT]{{{k}}}')"""


DM = f"dm AS ({_mers('source', 'documents', alias='filter_id')})"
QM = f"qm AS ({_mers('item_id', 'benchmark')})"


def _positions(num_bits: int, modulus: int) -> str:
    """Positions of the documents' and the queries' k-mers: db (filter_id, pos), qp (item_id, pos, c), qn (item_id, n)."""
    return f"""{DM}, {QM}, allm AS (SELECT m FROM dm UNION SELECT m FROM qm),
hm AS MATERIALIZED (SELECT m, (h % {modulus})::BIGINT AS pos FROM ({hashed("allm", 20)}) WHERE h % {modulus} < {num_bits}),
db AS MATERIALIZED (SELECT DISTINCT filter_id, pos FROM (SELECT DISTINCT filter_id, m FROM dm) JOIN hm USING (m)),
qp AS (SELECT item_id, pos, count(*) AS c FROM qm JOIN hm USING (m) GROUP BY item_id, pos),
qn AS (SELECT item_id, sum(c)::BIGINT AS n, count(*) AS n_distinct FROM qp GROUP BY item_id)"""


def _hits(c: str = "sum(c)::BIGINT") -> str:
    return f"SELECT item_id, filter_id, {c} AS hits FROM qp JOIN db USING (pos) GROUP BY item_id, filter_id"


def _search(spec, theta: float, distinct: bool = False) -> str:
    n = "n_distinct" if distinct else "n"
    return f"""WITH {_positions(spec.num_bits, spec.range)}, h AS ({_hits("count(*)" if distinct else "sum(c)::BIGINT")})
SELECT item_id::INTEGER AS batch_ix, 'item' || item_id AS name, filter_id, hits, {n} AS n FROM h JOIN qn USING (item_id) WHERE hits >= ceil({theta}::DOUBLE * {n})"""


_SIZES = "sz AS (SELECT filter_id, count(DISTINCT least(m, reverse(translate(m, 'ACGT', 'TGCA')))) AS set_size FROM dm GROUP BY filter_id), sizes AS (SELECT source AS filter_id, coalesce(set_size, 0) AS set_size FROM (SELECT DISTINCT source FROM documents) LEFT JOIN sz ON source = filter_id)"

_V = f"v AS (SELECT DISTINCT 'y' || year(l_shipdate) AS vec, (l_partkey % {VECTOR_BITS}) AS pos FROM lineitem)"
_A, _B = "(SELECT pos FROM v WHERE vec = 'y1995')", "(SELECT pos FROM v WHERE vec = 'y1996')"
_ALL = f"(SELECT range AS pos FROM range({VECTOR_BITS}))"


def _pairs(where: str = "true", on: str = "a.vec < b.vec") -> str:
    return f"""WITH {_V}, w AS (SELECT * FROM v WHERE {where}), ids AS (SELECT DISTINCT vec FROM v), n AS (SELECT ids.vec, count(w.pos) AS ones FROM ids LEFT JOIN w ON ids.vec = w.vec GROUP BY ids.vec),
c AS (SELECT a.vec AS u, b.vec AS v, count(*) AS common FROM w a JOIN w b ON a.pos = b.pos WHERE {on} GROUP BY ALL),
p AS (SELECT a.vec AS u, b.vec AS v, a.ones AS ones_u, b.ones AS ones_v, coalesce(common, 0) AS common FROM n a JOIN n b ON {on} LEFT JOIN c ON c.u = a.vec AND c.v = b.vec)
"""


def _under(s: str) -> str:
    return f"replace({s}, ' ', '_')"


_TREE = f"""nodes AS (SELECT 'root' AS node, NULL AS parent, 0 AS depth, false AS is_leaf, [0] AS o UNION ALL SELECT 'R_' || {_under("r_name")}, 'root', 1, false, [0, r_regionkey] FROM region
 UNION ALL SELECT 'N_' || {_under("n_name")}, 'R_' || {_under("r_name")}, 2, true, [0, r_regionkey, n_nationkey] FROM nation JOIN region ON n_regionkey = r_regionkey),
pre AS (SELECT *, (row_number() OVER (ORDER BY o) - 1)::INTEGER AS node_ix FROM nodes),
closure AS (SELECT node, node AS leaf FROM nodes WHERE is_leaf UNION ALL SELECT parent, node FROM nodes WHERE is_leaf UNION ALL SELECT 'root', node FROM nodes WHERE is_leaf),
anc AS (SELECT node, parent AS ancestor FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT node, 'root' FROM nodes WHERE depth = 2),
lb AS (SELECT DISTINCT 'N_' || {_under("n_name")} AS leaf, (l_partkey * 7 % {TREE_BITS}) AS pos FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
ln AS (SELECT node, count(*) AS n_leaves FROM closure GROUP BY node),
cn AS (SELECT node, pos, count(*) AS c, any_value(n_leaves) AS n_leaves FROM lb JOIN closure USING (leaf) JOIN ln USING (node) GROUP BY node, pos)"""
_ACT = f"""{_TREE}, act AS (SELECT x.node, x.pos, coalesce(cn.c, 0) AS c, ln.n_leaves FROM (
 SELECT n.node, u.pos FROM nodes n JOIN cn u ON u.node = n.parent WHERE u.c < u.n_leaves UNION ALL SELECT 'root', range FROM range({TREE_BITS})) x LEFT JOIN cn ON cn.node = x.node AND cn.pos = x.pos JOIN ln ON ln.node = x.node)"""
_RATIO = f"""op AS (SELECT node, count(*) FILTER (WHERE c < n_leaves) AS o FROM cn GROUP BY node),
ratio AS (SELECT n.node, n.is_leaf, (CASE WHEN n.parent IS NULL THEN {TREE_BITS} ELSE coalesce(u.o, 0) END)::BIGINT AS n_informative, coalesce(s.o, 0) AS o FROM nodes n LEFT JOIN op s ON s.node = n.node LEFT JOIN op u ON u.node = n.parent)"""


def _node_stats(complete: bool) -> str:
    early = "is_leaf" if complete else "true"
    return f"""{_TREE}, br AS (SELECT regexp_extract(p_brand, '[0-9]+')::INTEGER AS p_brand, (p_partkey * 7 % {TREE_BITS}) AS pos, count(*) AS cq FROM part GROUP BY ALL),
bn AS (SELECT p_brand, sum(cq)::BIGINT AS n FROM br GROUP BY p_brand),
hs AS (SELECT p_brand, node, sum(cq)::BIGINT AS some_, (sum(CASE WHEN c = n_leaves THEN cq ELSE 0 END))::BIGINT AS n_pass FROM br JOIN cn USING (pos) GROUP BY ALL),
st AS (SELECT bn.p_brand, nodes.node, n - coalesce(some_, 0) AS n_fail, coalesce(n_pass, 0) AS n_pass, coalesce(some_, 0) - coalesce(n_pass, 0) AS n_unresolved,
 {early} AND coalesce(n_pass, 0) >= ceil(0.9::DOUBLE * n) AS passed, n - coalesce(some_, 0) >= n - ceil(0.9::DOUBLE * n) + 1 AS failed
 FROM bn CROSS JOIN nodes LEFT JOIN hs ON hs.p_brand = bn.p_brand AND hs.node = nodes.node),
hid AS (SELECT DISTINCT p_brand, anc.node FROM st JOIN anc ON st.node = anc.ancestor WHERE passed OR failed),
qs AS (SELECT st.*, hid.node IS NULL AS examined FROM st LEFT JOIN hid ON hid.p_brand = st.p_brand AND hid.node = st.node)"""


ORACLE_SQL = {
    "kmer_counts": f"WITH {DM} SELECT filter_id, count(*) AS kmers, count(DISTINCT m) AS distinct_kmers FROM dm GROUP BY filter_id",
    "kmer_min_abundance": f"WITH {DM}, c AS (SELECT filter_id, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS m, count(*) AS n FROM dm GROUP BY ALL) SELECT filter_id, count(*) AS kept, sum(n)::BIGINT AS occurrences, max(n) AS most FROM c WHERE n >= 2 GROUP BY filter_id",
    "kmer_hashes": f"WITH {QM}, a AS ({hashed('qm', 20)}), b AS ({hashed('a', 20, 1, 'h1')}), c AS ({hashed('b', 20, 0, 'hf', False)}) SELECT item_id::INTEGER AS batch_ix, m AS mer, lpad(hex(h), 16, '0') AS h, (h % {SPEC.range})::BIGINT AS pos, lpad(hex(h1), 16, '0') AS h_seed1, lpad(hex(hf), 16, '0') AS h_forward FROM c",
    "filter_positions": f"WITH {_positions(SPEC.num_bits, SPEC.range)} SELECT filter_id, count(*) AS ones, min(pos) AS lowest, max(pos) AS highest, sum(pos)::BIGINT AS total FROM db GROUP BY filter_id",
    "filter_stats": f"WITH {DM}, {_SIZES} SELECT filter_id || '.bf' AS filename, 1 AS num_hashes, {SPEC.range}::BIGINT AS num_bits, set_size AS kmers_added, round(1 - exp(-set_size / {SPEC.range}::DOUBLE), 9) AS bf_fp_rate FROM sizes",
    "theta_query": _search(SPEC, THETA),
    "theta_query_distinct": _search(SPEC, THETA, True),
    "theta_query_sampled": _search(SAMPLED, THETA),
    "theta_query_adjusted": f"""WITH {_positions(SPEC.num_bits, SPEC.range)}, {_SIZES}, h AS ({_hits()}), m AS (SELECT item_id, filter_id, hits, n, 1 - exp(-set_size / {SPEC.num_bits}::DOUBLE) AS r FROM h JOIN qn USING (item_id) JOIN sizes USING (filter_id) WHERE hits >= ceil(0.5::DOUBLE * n)),
a AS (SELECT *, round(greatest(0, (hits / n::DOUBLE - r) / (1 - r)) * n)::BIGINT AS adjusted_hits FROM m)
SELECT item_id::INTEGER AS batch_ix, 'item' || item_id AS name, filter_id, hits, n, adjusted_hits, row_number() OVER (PARTITION BY item_id ORDER BY adjusted_hits DESC, filter_id)::INTEGER AS rank FROM a""",
    "theta_query_counts": f"WITH m AS ({_search(SPEC, THETA)}), c AS (SELECT batch_ix, count(*) AS k FROM m GROUP BY batch_ix) SELECT item_id::INTEGER AS batch_ix, 'item' || item_id AS name, coalesce(k, 0) AS n_matches FROM benchmark LEFT JOIN c ON item_id = batch_ix",
    "count_all_hits": f"WITH {_positions(SPEC.num_bits, SPEC.range)}, h AS ({_hits()}) SELECT qn.item_id::INTEGER AS batch_ix, 'item' || qn.item_id AS name, s.source AS filter_id, coalesce(hits, 0) AS hits, n, coalesce(hits, 0) >= ceil({THETA}::DOUBLE * n) AS is_hit FROM qn CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN h ON h.item_id = qn.item_id AND h.filter_id = s.source",
    "query_kmer_counts": f"WITH {QM}, n AS (SELECT item_id, count(*) AS n FROM qm GROUP BY item_id) SELECT b.item_id::INTEGER AS batch_ix, 'item' || b.item_id AS name, coalesce(n, 0) AS n FROM benchmark b LEFT JOIN n USING (item_id)",
    "query_filter_kmers": f"WITH {_positions(SPEC.num_bits, SPEC.range)} SELECT f.filter_id, 'item' || item_id AS name, qm.m AS mer, db.pos IS NOT NULL AS present, count(*) AS n FROM qm JOIN hm USING (m) CROSS JOIN (SELECT unnest(['src1', 'src2']) AS filter_id) f LEFT JOIN db ON db.filter_id = f.filter_id AND db.pos = hm.pos GROUP BY ALL",
    "multi_hash_contains": f"WITH {DM}, {QM}, allm AS (SELECT m FROM dm UNION SELECT m FROM qm), a AS ({hashed('allm', 20)}), b AS ({hashed('a', 20, 1, 'h1')}), hm AS MATERIALIZED (SELECT m, unnest([h % {TWO.range}, h1 % {TWO.range}]) AS pos FROM b), db AS (SELECT DISTINCT filter_id, pos FROM dm JOIN hm USING (m)), q AS (SELECT DISTINCT m, pos FROM hm WHERE m IN (SELECT m FROM qm)), need AS (SELECT m, count(*) AS k FROM q GROUP BY m), got AS (SELECT filter_id, m, count(*) AS k FROM q JOIN db USING (pos) GROUP BY ALL) SELECT filter_id, count(*) AS contained FROM got JOIN need USING (m, k) GROUP BY filter_id",
    "exact_theta_query": f"WITH d AS ({_mers('doc_id', 'documents')}), {QM}, q AS (SELECT item_id, m, count(*) AS c FROM qm GROUP BY ALL), n AS (SELECT item_id, sum(c)::BIGINT AS n FROM q GROUP BY item_id), h AS (SELECT item_id, doc_id, sum(c)::BIGINT AS hits FROM q JOIN (SELECT DISTINCT doc_id, m FROM d WHERE m IN (SELECT m FROM qm)) USING (m) GROUP BY ALL) SELECT item_id::INTEGER AS batch_ix, 'item' || item_id AS name, doc_id AS filter_id, hits, n FROM h JOIN n USING (item_id) WHERE hits >= ceil({THETA}::DOUBLE * n)",
    "sequence_functions": f"WITH {QM}, r AS (SELECT *, reverse(translate(m, 'ACGT', 'TGCA')) AS rc FROM qm) SELECT item_id::INTEGER AS batch_ix, m AS mer, rc, least(m, rc) AS canonical, list_reduce(list_transform(string_split(translate(m, 'ACGT', '0123'), ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b) AS packed, true AS ok FROM r",
    "name_functions": "SELECT page_id, 'x.detbrief.rrr.unity.bf' AS file, 'x' AS name, url || '/x.detbrief.rrr.unity' AS no_suffix, regexp_replace(url, '^https://', '') || '/x.detbrief.rrr.unity.bf' AS no_prefix, 3 AS n_fields FROM pages",
    "position_checksum": f"WITH {QM}, h AS ({hashed('qm', 20)}), p AS (SELECT item_id, (h % {SPEC.range})::BIGINT AS pos FROM h) SELECT item_id::INTEGER AS batch_ix, (xor(sum(pos % 536870912)::BIGINT, bit_xor(pos)) & 536870911) AS checksum FROM p GROUP BY item_id",
    "bits_and": f"WITH {_V} SELECT pos FROM v WHERE vec IN ('y1995', 'y1996', 'y1997') GROUP BY pos HAVING count(*) = 3",
    "bits_or": f"WITH {_V} SELECT DISTINCT pos FROM v WHERE vec IN ('y1995', 'y1996', 'y1997')",
    "bits_xor": f"WITH {_V} SELECT pos FROM v WHERE vec IN ('y1995', 'y1996', 'y1997') GROUP BY pos HAVING count(*) % 2 = 1",
    "bits_eq": f"WITH {_V} SELECT pos FROM {_ALL} a WHERE (pos IN {_A}) = (pos IN {_B})",
    "bits_not": f"WITH {_V} SELECT pos FROM {_ALL} a WHERE pos NOT IN {_A}",
    "bits_mask": f"WITH {_V} {_A[1:-1]} EXCEPT {_B[1:-1]}",
    "bits_ornot": f"WITH {_V} SELECT pos FROM {_ALL} a WHERE pos IN {_A} OR pos NOT IN {_B}",
    "bits_squeeze": f"WITH {_V}, r AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k FROM {_B} b) SELECT k AS pos FROM r WHERE pos IN {_A}",
    "bits_unsqueeze": f"WITH {_V}, r AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k FROM {_B} b) SELECT pos FROM r WHERE k IN {_A}",
    "bits_rank": f"WITH {_V}, n AS (SELECT range AS n FROM range(0, {VECTOR_BITS + 1}, 64)), r AS (SELECT n, (SELECT count(*) FROM {_A} a WHERE a.pos < n.n) AS rank1 FROM n) SELECT n, rank1, n - rank1 AS rank0 FROM r",
    "bits_select1": f"WITH {_V} SELECT vec, row_number() OVER (PARTITION BY vec ORDER BY pos) - 1 AS r, pos FROM v",
    "bits_select0": f"WITH {_V} SELECT row_number() OVER (ORDER BY pos) - 1 AS r, pos FROM {_ALL} a WHERE pos NOT IN {_A}",
    "bits_simplify": f"WITH {_V} SELECT vec, CASE WHEN count(*) = {VECTOR_BITS} THEN 'ones' ELSE 'mixed' END AS kind FROM v GROUP BY vec",
    "bits_density": f"WITH {_V} SELECT vec, count(*) AS ones, count(*) / 1000.0::DOUBLE AS density FROM v WHERE pos >= 100 AND pos < 1100 GROUP BY vec",
    "bits_counts": f"WITH {_V}, f AS (SELECT pos, (pos IN {_A})::INT AS a, (pos IN {_B})::INT AS b FROM {_ALL} x) SELECT sum(a)::BIGINT AS ones_a, sum(b)::BIGINT AS ones_b, sum(a * b)::BIGINT AS n_and, sum(greatest(a, b))::BIGINT AS n_or, sum(abs(a - b))::BIGINT AS n_xor, sum(a * (1 - b))::BIGINT AS n_mask, sum(greatest(a, 1 - b))::BIGINT AS n_or_not FROM f",
    "bits_bitmaps": f"WITH {_V} SELECT count(DISTINCT pos) AS ones FROM v WHERE vec IN ('y1995', 'y1996')",
    "bits_dump": f"WITH {_V} SELECT i.vec, string_agg(CASE WHEN v.pos IS NULL THEN '0' ELSE '1' END, '' ORDER BY p.range) AS bits FROM (SELECT DISTINCT vec FROM v) i CROSS JOIN range(100) p LEFT JOIN v ON v.vec = i.vec AND v.pos = p.range GROUP BY i.vec",
    "bits_integers": f"WITH {_V} SELECT vec, row_number() OVER (PARTITION BY vec ORDER BY pos) - 1 AS r, pos FROM v",
    "distance_hamming": _pairs() + "SELECT u, v, ones_u + ones_v - 2 * common AS hamming FROM p",
    "distance_intersection": _pairs("pos >= 8 AND pos < 2000") + "SELECT u, v, common AS intersection FROM p",
    "distance_union": _pairs() + 'SELECT u, v, ones_u + ones_v - common AS "union" FROM p',
    "distance_jaccard": _pairs() + "SELECT u, v, common AS numerator, ones_u + ones_v - common AS denominator, round(common / (ones_u + ones_v - common)::DOUBLE, 9) AS jaccard FROM p",
    "distance_theta": _pairs(on="a.vec = 'y1995'") + "SELECT u, v, common AS numerator, ones_u AS denominator, round(common / ones_u::DOUBLE, 9) AS theta FROM p",
    "node_union": f"WITH {_TREE} SELECT node, pos FROM cn",
    "node_intersection": f"WITH {_TREE} SELECT node, pos FROM cn WHERE c = n_leaves",
    "node_allsome": f"WITH {_TREE} SELECT c.node, 'all' AS vector, c.pos FROM cn c JOIN nodes n ON n.node = c.node LEFT JOIN cn u ON u.node = n.parent AND u.pos = c.pos AND u.c = u.n_leaves WHERE c.c = c.n_leaves AND u.node IS NULL UNION ALL SELECT node, 'some', pos FROM cn WHERE c < n_leaves",
    "node_determined": f"WITH {_ACT} SELECT node, 'det' AS vector, pos FROM act WHERE c = n_leaves OR c = 0 UNION ALL SELECT node, 'how', pos FROM act WHERE c = n_leaves",
    "node_brief": f"WITH {_ACT}, o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pos) - 1 AS k FROM act), e AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pos) - 1 AS j FROM o WHERE c = n_leaves OR c = 0) SELECT node, 'det' AS vector, k AS pos FROM e UNION ALL SELECT node, 'how', j FROM e WHERE c = n_leaves",
    "brief_lengths": f"WITH {_ACT} SELECT node, count(*) AS det_length, count(*) FILTER (WHERE c = n_leaves OR c = 0) AS how_length FROM act GROUP BY node",
    "tree_lookup": f"WITH {_TREE} SELECT n.node, r.range AS pos, CASE WHEN c IS NULL THEN 0 WHEN c = n_leaves THEN 1 ELSE -1 END AS state FROM nodes n CROSS JOIN range({TREE_BITS}) r LEFT JOIN cn ON cn.node = n.node AND cn.pos = r.range",
    "tree_search": f"WITH {_node_stats(False)} SELECT DISTINCT p_brand AS batch_ix, leaf FROM qs JOIN closure USING (node) WHERE examined AND passed",
    "nodes_examined": f"WITH {_node_stats(False)} SELECT p_brand AS batch_ix, count(*) AS nodes_examined FROM qs WHERE examined GROUP BY p_brand",
    "node_query_stats": f"WITH {_node_stats(True)} SELECT a.p_brand AS batch_ix, a.node, a.examined, a.examined AND a.passed AS passed, a.examined AND a.failed AS failed, a.n_pass, a.n_fail, a.n_unresolved, a.n_pass - coalesce(b.n_pass, 0) AS local_pass, a.n_fail - coalesce(b.n_fail, 0) AS local_fail FROM qs a JOIN nodes n ON n.node = a.node LEFT JOIN qs b ON b.node = n.parent AND b.p_brand = a.p_brand",
    "det_ratio": f"WITH {_TREE}, {_RATIO} SELECT node, n_informative - o AS n_det, n_informative FROM ratio",
    "cull_threshold": f"WITH {_TREE}, {_RATIO}, x AS (SELECT (n_informative - o) / n_informative::DOUBLE AS x FROM ratio WHERE NOT is_leaf AND n_informative > 0) SELECT round(greatest(0, least(1, avg(x) - stddev_pop(x))), 9) AS threshold FROM x",
    "node_stats": f"WITH {_TREE}, fam AS (SELECT n.node, n.parent, (SELECT count(*) FROM nodes k WHERE k.parent = n.node) AS kids FROM nodes n) SELECT n.node, n.depth + 1 AS depth, 3 - n.depth AS height, 1 + (SELECT count(*) FROM anc WHERE anc.ancestor = n.node) AS subtree, (SELECT count(*) - 1 FROM nodes s WHERE s.parent IS NOT DISTINCT FROM n.parent) AS siblings, (SELECT coalesce(sum(kids), 0)::BIGINT FROM fam f WHERE f.parent IS NOT DISTINCT FROM n.parent AND f.node <> n.node) AS niblings, ln.n_leaves AS leaves FROM nodes n JOIN ln ON ln.node = n.node",
    "bit_stats": f"WITH {_ACT} SELECT pos, count(*) AS det_active, count(*) FILTER (WHERE c = n_leaves OR c = 0) AS how_active, count(*) FILTER (WHERE c = n_leaves) AS how_one FROM act GROUP BY pos",
    "allsome_stats": f"WITH {_ACT} SELECT node, count(*) AS bits, count(*) FILTER (WHERE c = n_leaves) AS present, count(*) FILTER (WHERE c = 0) AS absent, count(*) FILTER (WHERE c > 0 AND c < n_leaves) AS unresolved FROM act GROUP BY node",
    "forest_stats": f"WITH {_TREE} SELECT n.node AS root, (SELECT count(*) FROM nodes k WHERE k.parent = n.node) + 1 AS size, ln.n_leaves AS leaves, 2 AS max_depth FROM nodes n JOIN ln ON ln.node = n.node WHERE depth = 1",
    "topology_lines": f"WITH {_TREE} SELECT node_ix, repeat('*', depth) || node AS line FROM pre",
    "depth_histogram": f"WITH {_TREE} SELECT depth, count(*) AS n FROM nodes GROUP BY depth",
    "tree_validation": f"""WITH {_TREE}, have AS (SELECT node, pos FROM cn WHERE node <> 'R_ASIA' OR pos % 5 <> 0), inner_ AS (SELECT DISTINCT parent AS node FROM nodes WHERE parent IS NOT NULL),
want AS (SELECT DISTINCT n.parent AS node, pos FROM have JOIN nodes n USING (node) WHERE n.parent IS NOT NULL), own AS (SELECT node, pos FROM have JOIN inner_ USING (node))
(SELECT * FROM want EXCEPT SELECT * FROM own) UNION ALL (SELECT * FROM own EXCEPT SELECT * FROM want)""",
    "tree_names": "SELECT unnest(['R_AFRICA', 'R_EUROPE', 'N_ATLANTIS']) AS name, unnest(['repeated', 'no filter', 'no node']) AS problem",
    "lonely_nodes": f"WITH {_TREE}, k AS (SELECT n_regionkey AS r, any_value('N_' || {_under('n_name')}) AS name FROM nation WHERE n_nationkey % 7 < 2 GROUP BY n_regionkey HAVING count(*) = 1) SELECT name FROM k",
    "theta_query_stored": _search(SPEC, THETA),
    "theta_query_in_tree_order": f"SELECT *, row_number() OVER (PARTITION BY batch_ix ORDER BY filter_id DESC)::INTEGER AS rank FROM ({_search(SPEC, THETA)})",
    "theta_zero": f"WITH {_positions(SPEC.num_bits, SPEC.range)}, h AS ({_hits()}) SELECT qn.item_id::INTEGER AS batch_ix, 'item' || qn.item_id AS name, s.source AS filter_id, coalesce(hits, 0) AS hits, n FROM qn CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN h ON h.item_id = qn.item_id AND h.filter_id = s.source",
    "min_abundance_positions": f"""WITH {DM}, c AS (SELECT filter_id, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS m FROM dm GROUP BY ALL HAVING count(*) >= 2), u AS (SELECT DISTINCT m FROM c),
p AS (SELECT DISTINCT filter_id, (h % {SPEC.range})::BIGINT AS pos FROM c JOIN ({hashed("u", 20)}) USING (m)) SELECT filter_id, count(*) AS ones, min(pos) AS lowest, max(pos) AS highest, sum(pos)::BIGINT AS total FROM p GROUP BY filter_id""",
    "max_depth": f"WITH {_TREE} SELECT max(depth) AS max_depth FROM nodes",
    "renumbered_tree": f"WITH {_TREE}, r AS (SELECT node, 'node' || row_number() OVER (ORDER BY depth, node_ix) AS name FROM pre WHERE NOT is_leaf) SELECT node_ix, repeat('*', depth) || coalesce(r.name, pre.node) AS line FROM pre LEFT JOIN r ON r.node = pre.node",
    "sibling_groups": f"WITH {_TREE} SELECT string_agg(node, ' ' ORDER BY node_ix) AS names FROM pre GROUP BY parent",
    "subtree_nodes": f"WITH {_TREE} SELECT node AS name FROM nodes WHERE node = 'R_EUROPE' OR parent = 'R_EUROPE'",
    "bit_stats_view": f"WITH {_ACT}, s AS (SELECT pos, count(*) AS det_active, count(*) FILTER (WHERE c = n_leaves) AS how_one FROM act GROUP BY pos) SELECT pos AS x, det_active AS n_x, round(how_one / ((det_active + 1) // 2)::DOUBLE, 9) AS s_x FROM s",
    "allsome_totals": f"WITH {_ACT}, s AS (SELECT count(*) FILTER (WHERE c = n_leaves) AS present, count(*) FILTER (WHERE c = 0) AS absent FROM act) SELECT present, absent, round(100.0::DOUBLE * present / (present + absent), 6) AS present_pct, round(100.0::DOUBLE * absent / (present + absent), 6) AS absent_pct FROM s",
    "node_stat_items": f"""WITH {_ACT}, i AS (SELECT leaf AS node, count(*) AS items FROM lb GROUP BY leaf), a AS (SELECT node, count(*) FILTER (WHERE c = n_leaves) AS n_all, count(*) FILTER (WHERE c > 0 AND c < n_leaves) AS n_some FROM act GROUP BY node)
SELECT n.node, items, round(1 - exp(-items / {TREE_BITS}::DOUBLE), 9) AS fp_rate, coalesce(n_all, 0) AS n_all, coalesce(n_some, 0) AS n_some FROM nodes n JOIN i USING (node) LEFT JOIN a USING (node)""",
    "constant_filters": f"WITH {_V} SELECT vec, count(*) AS ones, count(*) / {VECTOR_BITS}::DOUBLE AS density FROM v GROUP BY vec UNION ALL SELECT 'full', {VECTOR_BITS}, 1.0::DOUBLE",
    "random_vector_exact": "SELECT 'random' AS vec, 12345::BIGINT AS ones, 0.12345::DOUBLE AS density",
    "filter_size": "WITH n AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source) SELECT source, ceil(-n / ln(0.9::DOUBLE))::BIGINT AS bits_1, ceil(-3 * n / ln(1 - pow(0.1::DOUBLE, 1.0::DOUBLE / 3)))::BIGINT AS bits_3 FROM n",
    "query_fp_bound": f"WITH {QM}, n AS (SELECT b.item_id, count(m) AS n FROM benchmark b LEFT JOIN qm USING (item_id) GROUP BY b.item_id) SELECT item_id::INTEGER AS batch_ix, round(exp(-n * pow(0.2::DOUBLE - 0.1::DOUBLE, 2) / (3 * 0.1::DOUBLE)), 12) AS bound, ceil({THETA}::DOUBLE * n)::BIGINT AS need, (n - ceil({THETA}::DOUBLE * n) + 1)::BIGINT AS need_fail FROM n",
}

_LOW = _search(SPEC, 0.5)
_HIGH = _search(SAMPLED, 0.6)
ORACLE_SQL["compare_results"] = f"SELECT query, count(*) FILTER (WHERE x AND y) AS in_both, count(*) FILTER (WHERE y IS NULL) AS in_1_only, count(*) FILTER (WHERE x IS NULL) AS in_2_only FROM (SELECT coalesce(a.name, b.name) AS query, a.name IS NOT NULL OR NULL AS x, b.name IS NOT NULL OR NULL AS y FROM ({_LOW}) a FULL OUTER JOIN ({_HIGH}) b ON a.name = b.name AND a.filter_id = b.filter_id) GROUP BY query"
