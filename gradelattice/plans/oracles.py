"""The registered queries in plain SQL, written from the definitions.

Contexts are rebuilt in long form; closures are tabulated over all subsets;
covers are pairs with nothing between.  Nothing here shares code with the
DataFrame operators.
"""

from __future__ import annotations

ALPHA, TOP_LEVEL, SAMPLE_BUDGET, SAMPLE_LINES, QUOTA = 7, 9, 120, 20, 200


def _case(col: str, values: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{v}' THEN {i}" for i, v in enumerate(values)) + " END"


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
FACTS = {
    "brand_size": (10, "SELECT p_brand obj, (p_size - 1) // 5 attr FROM part"),
    "type_size": (50, "SELECT p_type obj, p_size - 1 attr FROM part"),
    "seg_month": (12, "SELECT c_mktsegment || '|' || o_orderstatus obj, month(o_orderdate) - 1 attr "
                      "FROM orders JOIN customer ON o_custkey = c_custkey"),
    "region_bucket": (10, "SELECT n_regionkey obj, o_custkey % 10 attr FROM orders JOIN customer ON o_custkey = c_custkey "
                          "JOIN nation ON c_nationkey = n_nationkey"),
    "supplier_month": (12, "SELECT l_suppkey obj, month(l_shipdate) - 1 attr FROM lineitem"),
    "nation_month": (12, "SELECT s_nationkey obj, month(l_shipdate) - 1 attr FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "supplier_flag": (3, f"SELECT l_suppkey obj, {_case('l_returnflag', ('A', 'N', 'R'))} attr FROM lineitem"),
    "customer_priority": (5, "SELECT o_custkey obj, " + _case("o_orderpriority", (
        "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " attr FROM orders"),
    "user_event": (5, f"SELECT user_id obj, {_case('event_type', ('click', 'error', 'purchase', 'signup', 'view'))} attr FROM events"),
    "nation_status": (3, f"SELECT c_nationkey obj, {_case('o_orderstatus', ('F', 'O', 'P'))} attr "
                         "FROM orders JOIN customer ON o_custkey = c_custkey"),
    "customer_status": (3, f"SELECT o_custkey obj, {_case('o_orderstatus', ('F', 'O', 'P'))} attr FROM orders"),
    "source_lang": (4, f"SELECT source obj, {_case('lang', ('de', 'en', 'es', 'fr'))} attr FROM documents"),
}


def ctx(name: str, out: str | None = None) -> str:
    """CTEs ending in ``out(obj, attr, q)``: dense graded context."""
    m, facts = FACTS[name]
    out = out or name
    return f"""{out}_n AS (SELECT obj, attr::INT attr, count(*) n FROM ({facts}) GROUP BY 1, 2),
{out}_d AS (SELECT o.obj, a.attr, coalesce(c.n, 0) n FROM (SELECT DISTINCT obj FROM {out}_n) o
  CROSS JOIN (SELECT range::INT attr FROM range({m})) a LEFT JOIN {out}_n c ON c.obj = o.obj AND c.attr = a.attr),
{out} AS (SELECT obj, attr, ((10 * n) // max(n) OVER (PARTITION BY obj))::INT q FROM {out}_d)"""


def wide(name: str, out: str) -> str:
    return f"{out} AS (SELECT obj, list(q ORDER BY attr) g FROM {name} GROUP BY obj)"


def text(name: str, cols: str = "obj") -> str:
    return f"string_agg(q::VARCHAR, ',' ORDER BY attr)"


def closures(name: str, m: int) -> str:
    """``cltab(mask, cl)``: the modal closure of every subset."""
    full = (1 << m) - 1
    return f"""need AS (SELECT DISTINCT a.attr, bit_or(CASE WHEN b.q >= a.q THEN 1::BIGINT << b.attr ELSE 0 END) gm
  FROM {name} a JOIN {name} b USING (obj) WHERE a.q > 0 GROUP BY a.obj, a.attr),
subsets AS (SELECT range::BIGINT mask FROM range({1 << m})),
kept_out AS (SELECT DISTINCT mask, attr FROM subsets JOIN need ON (gm & mask) = 0),
cltab AS (SELECT s.mask, {full} - coalesce(sum(1::BIGINT << k.attr), 0)::BIGINT cl
  FROM subsets s LEFT JOIN kept_out k USING (mask) GROUP BY s.mask),
closed AS (SELECT mask FROM cltab WHERE cl = mask)"""


CRISP = f"{ctx('brand_size')}, crisp AS (SELECT obj, attr, (q >= {ALPHA})::INT q FROM brand_size)"
CRISP_CLOSED = f"{CRISP}, {closures('crisp', 10)}"
SEG_CLOSED = f"{ctx('seg_month')}, {closures('seg_month', 12)}"


def below(a: str, b: str) -> str:
    return f"({a} & ~{b}) = 0 AND {a} <> {b}"


def covers(family: str) -> str:
    return f"""pairs AS (SELECT a.mask child, b.mask parent FROM {family} a JOIN {family} b ON {below('a.mask', 'b.mask')}),
covers AS (SELECT child, parent FROM pairs p WHERE NOT EXISTS (
  SELECT 1 FROM {family} c WHERE {below('p.child', 'c.mask')} AND {below('c.mask', 'p.parent')}))"""


LEVELS = """lv(id, d) AS (SELECT mask, 0 FROM closed UNION SELECT parent, d + 1 FROM lv JOIN covers ON child = id),
levels AS (SELECT id, max(d) AS level FROM lv GROUP BY id)"""
CRISP_COVERS = f"{CRISP_CLOSED}, {covers('closed')}"
MEMBERS = "(SELECT list(j ORDER BY j) FROM range(62) t(j) WHERE ((mask >> j) & 1) = 1)"


def members(mask: str, m: int) -> str:
    return f"list_filter(range({m}), lambda j: (({mask} >> j::INT) & 1) = 1)"


def ranked(m: int) -> str:
    return f"""listed AS (SELECT mask, {members('mask', m)} attrs FROM closed),
ranked AS (SELECT mask, attrs, row_number() OVER (ORDER BY attrs) - 1 AS rank FROM listed)"""


RANKED_EDGES = f"""{CRISP_COVERS}, {ranked(10)},
edges AS (SELECT a.rank child, b.rank parent FROM covers c JOIN ranked a ON a.mask = c.child JOIN ranked b ON b.mask = c.parent)"""


def luk(a: str, b: str) -> str:
    return f"least(10, 10 - {a} + {b})"


def goguen(a: str, b: str) -> str:
    return f"CASE WHEN {a} <= {b} THEN 10 ELSE (10 * {b}) // {a} END"


def goguen_nearest(a: str, b: str) -> str:
    return f"CASE WHEN {a} <= {b} THEN 10 ELSE (20 * {b} + {a} - 1) // (2 * {a}) END"


def goguen_real(a: str, b: str) -> str:
    x, y = f"({a} / 10.0::DOUBLE)", f"({b} / 10.0::DOUBLE)"
    return f"CASE WHEN {x} <= {y} + 1e-6 OR {x} < 1e-6 THEN 1.0::DOUBLE ELSE {y} / {x} END"


def fixpoints(name: str, imp) -> str:
    """``fixed(y0, y1, ...)``: closed intents of a context with few attributes, by testing every level vector."""
    m = FACTS[name][0]
    def cols(fmt: str, sep: str = ", ") -> str:
        return sep.join(fmt.format(j=j, p=11 ** (m - 1 - j)) for j in range(m))
    down = ", ".join(imp(f"y{j}", f"a{j}") for j in range(m))
    up = ", ".join(f"min({imp('d', f'a{j}')}) u{j}" for j in range(m))
    return f"""{ctx(name)}, rws AS (SELECT DISTINCT {cols('a{j}')} FROM (SELECT obj, {cols('max(q) FILTER (attr = {j}) a{j}')}
  FROM {name} GROUP BY obj)),
grid AS (SELECT {cols('(range // {p} % 11)::INT y{j}')} FROM range({11 ** m})),
dwn AS (SELECT {cols('y{j}')}, {cols('a{j}')}, least({down}) d FROM grid CROSS JOIN rws),
ups AS (SELECT {cols('y{j}')}, {up} FROM dwn GROUP BY {cols('y{j}')}),
fixed AS (SELECT {cols('y{j}')} FROM ups WHERE {cols('u{j} = y{j}', ' AND ')})"""


# The closure of every grade vector, and the intent each nation generates.
NATION_INTENTS = f"""{fixpoints('nation_status', luk)},
cl AS (SELECT g.y0 x0, g.y1 x1, g.y2 x2, min(f.y0) c0, min(f.y1) c1, min(f.y2) c2
  FROM grid g JOIN fixed f ON f.y0 >= g.y0 AND f.y1 >= g.y1 AND f.y2 >= g.y2 GROUP BY ALL),
gens AS (SELECT r.obj, c0, c1, c2 FROM (SELECT obj, max(q) FILTER (attr = 0) a0, max(q) FILTER (attr = 1) a1, max(q) FILTER (attr = 2) a2
  FROM nation_status GROUP BY obj) r JOIN cl ON x0 = a0 AND x1 = a1 AND x2 = a2)"""

JOINED3 = "y0 || ',' || y1 || ',' || y2"
FUZZY_ORDER = "row_number() OVER (ORDER BY y0, y1, y2) - 1"


NATION_COVERS = f"""f AS (SELECT y0, y1, y2, {JOINED3} t,
  ((1::BIGINT << y0) - 1) + (((1::BIGINT << y1) - 1) << 10) + (((1::BIGINT << y2) - 1) << 20) mask FROM fixed),
{covers('f')}"""


def _closed_at(name: str, x0: str, x1: str, x2: str) -> str:
    return f"JOIN cl {name} ON {name}.x0 = {x0} AND {name}.x1 = {x1} AND {name}.x2 = {x2}"


# What the canonical search tries: a raise fails if it changes an attribute before its own, and then all higher ones do.
NATION_TRIES = f"""{NATION_INTENTS},
gen AS (SELECT y0, y1, y2, CASE WHEN (z.c0, z.c1, z.c2) = (y0, y1, y2) THEN -1 WHEN (p.c0, p.c1, p.c2) = (y0, y1, y2) THEN 0
    WHEN (q.c0, q.c1, q.c2) = (y0, y1, y2) THEN 1 ELSE 2 END y
  FROM fixed {_closed_at('z', '0', '0', '0')} {_closed_at('p', 'y0', '0', '0')} {_closed_at('q', 'y0', 'y1', '0')}),
lost AS (SELECT count(*) FILTER (y < 1 AND y1 < 10 AND p.c0 <> y0) + count(*) FILTER (y < 2 AND y2 < 10 AND (q.c0, q.c1) <> (y0, y1)) n
  FROM gen {_closed_at('p', 'y0', '10', 'y2')} {_closed_at('q', 'y0', 'y1', '10')}),
counters AS (SELECT count(*) concepts, count(*) + max(n) tried, max(n) rejected FROM gen, lost)"""


def pair(q: str, a: int, fmt: str = "%.3f") -> str:
    return f"CASE WHEN {q} > 0 THEN printf('{fmt}', {q} / 10.0::DOUBLE) || '/{a}' END"


INTENT3 = "concat_ws(' ', " + ", ".join(pair(f"y{j}", j) for j in range(3)) + ")"
SUPPLIER_WIDE = f"{ctx('supplier_month')}, {wide('supplier_month', 'sup')}"
NEIGHBOURS = (f"{ctx('supplier_month')}, nb AS (SELECT a.obj, a.attr, a.q a, b.q b FROM supplier_month a "
              "JOIN supplier_month b ON a.obj = b.obj AND b.attr = a.attr + 1)")
SUP_NATION = (f"{ctx('supplier_month')}, {ctx('nation_month')}, sn AS (SELECT a.obj, a.attr, a.q a, b.q b FROM supplier_month a "
              "JOIN supplier ON s_suppkey = a.obj JOIN nation_month b ON b.obj = s_nationkey AND b.attr = a.attr)")
DOWN = f"{ctx('supplier_month')}, {ctx('nation_month')}"
UP = f"{ctx('supplier_month')}, {ctx('supplier_flag')}"
NATION_SETS = f"sets AS (SELECT obj set_id, attr FROM nation_month WHERE q >= {TOP_LEVEL})"
EXTENTS = (f"{DOWN}, {NATION_SETS}, ext AS (SELECT s.set_id, c.obj, max(c.q) ext FROM sets s "
           "JOIN supplier_month c USING (attr) GROUP BY 1, 2)")


def down_sql(imp) -> str:
    return (f"WITH {DOWN} SELECT y.obj set_id, c.obj, min({imp('y.q', 'c.q')}) ext FROM nation_month y "
            "JOIN supplier_month c USING (attr) GROUP BY 1, 2")


def up_sql(imp) -> str:
    return (f"WITH {UP}, u AS (SELECT x.attr set_id, c.attr, min({imp('x.q', 'c.q')}) q FROM supplier_flag x "
            "JOIN supplier_month c USING (obj) GROUP BY 1, 2) "
            "SELECT set_id, string_agg(q::VARCHAR, ',' ORDER BY attr) grades FROM u GROUP BY set_id")


def close_sql(imp) -> str:
    return f"""WITH {ctx('supplier_month')},
sharp AS (SELECT obj, attr, CASE WHEN q >= {TOP_LEVEL} THEN 10 ELSE 0 END y FROM supplier_month),
dwn AS (SELECT s.obj sid, c.obj g, min({imp('s.y', 'c.q')}) d FROM sharp s JOIN supplier_month c USING (attr) GROUP BY 1, 2),
ups AS (SELECT sid obj, c.attr, min({imp('d', 'c.q')}) q FROM dwn JOIN supplier_month c ON c.obj = g GROUP BY 1, 2)
SELECT obj, string_agg(q::VARCHAR, ',' ORDER BY attr) closure FROM ups GROUP BY obj"""


def object_masks(name: str, level: int) -> str:
    return f"SELECT obj, sum(CASE WHEN q >= {level} THEN 1::BIGINT << attr ELSE 0 END)::BIGINT mask FROM {name} GROUP BY obj"


def scaled(name: str) -> str:
    return f"""{ctx(name)}, smap AS (SELECT (row_number() OVER (ORDER BY attr, q) - 1)::INT crisp_attr, attr fuzzy_attr, q AS value
  FROM (SELECT DISTINCT attr, q FROM {name} WHERE q > 0))"""


EMBED = """emb AS (SELECT vec_id obj, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings),
emb2 AS (SELECT obj, v, list_min(v) lo, list_max(v) hi FROM emb),
emb_ctx AS (SELECT obj, j::INT attr, floor(10 * (v[j + 1] - lo) / (hi - lo))::INT q FROM emb2, range(64) r(j))"""
USER_STEPS = f"""{ctx('user_event')}, steps AS (SELECT DISTINCT mask FROM (SELECT obj,
  sum(((1::BIGINT << q) - 1) << (10 * attr))::BIGINT mask FROM user_event GROUP BY obj))"""
CARD = "bit_count(mask)::INT"


def _six(fmt: str, sep: str = ", ") -> str:
    return sep.join(fmt.format(i=i) for i in range(6))


# Concepts by their extents: over six objects, every join of column extents is one concept.
TYPE_CONCEPTS = f"""{ctx('type_size')}, numbered AS (SELECT dense_rank() OVER (ORDER BY obj) - 1 o, attr, q FROM type_size),
cols AS (SELECT attr, {_six('coalesce(max(q) FILTER (o = {i}), 0) c{i}')} FROM numbered GROUP BY attr),
exts({_six('e{i}')}) AS (SELECT {_six('0')} UNION SELECT {_six('greatest(e{i}, c{i})')} FROM exts, cols),
closed AS (SELECT {_six('e{i}')}, sum(CASE WHEN {_six('c{i} <= e{i}', ' AND ')} THEN 1::BIGINT << attr ELSE 0 END)::BIGINT mask
  FROM exts, cols GROUP BY {_six('e{i}')})"""
TYPE_COVERS = f"""{TYPE_CONCEPTS}, steps AS (SELECT DISTINCT mask, {_six('greatest(e{i}, c{i}) s{i}')} FROM closed, cols
  WHERE NOT ({_six('c{i} <= e{i}', ' AND ')})),
least_steps AS (SELECT mask, {_six('s{i}')} FROM steps a WHERE NOT EXISTS (SELECT 1 FROM steps b WHERE b.mask = a.mask
  AND {_six('b.s{i} <= a.s{i}', ' AND ')} AND ({_six('b.s{i} < a.s{i}', ' OR ')}))),
covers AS (SELECT l.mask child, c.mask parent FROM least_steps l JOIN closed c ON {_six('s{i} = e{i}', ' AND ')})"""


def real(m: int) -> str:
    """``real(obj, attr, q)``: the first components of the vectors, as they are."""
    return f"real AS (SELECT vec_id obj, j::INT attr, embedding[j + 1]::DOUBLE q FROM embeddings, range({m}) r(j))"


# Nominal scaling of the types' sizes: concepts by the set of six objects their attributes reach.
WIDE = f"""{scaled('type_size')}, numbered AS (SELECT obj, dense_rank() OVER (ORDER BY obj) - 1 o FROM (SELECT DISTINCT obj FROM type_size)),
cols AS (SELECT crisp_attr, sum(1::BIGINT << o)::BIGINT ext FROM type_size JOIN smap ON attr = fuzzy_attr AND q = value JOIN numbered USING (obj) GROUP BY 1),
reach AS (SELECT o.range, bit_or(ext) mask, string_agg(crisp_attr::VARCHAR, ',' ORDER BY crisp_attr) attrs, count(crisp_attr)::INT card
  FROM range(64) o LEFT JOIN cols ON (ext & ~o.range) = 0 GROUP BY 1),
closed AS (SELECT DISTINCT coalesce(mask, 0) mask, coalesce(attrs, '') attrs, card FROM reach)"""


def sample(rows: str, m: int, maxn: int, key: str) -> str:
    """``sampled``: the selection among ``rows`` (mask, card, key), one step for each cardinality.

    ``quotas`` first takes a share for each stratum, then places from the largest one, the smallest card first, until they fit.
    """
    out = f"""h AS (SELECT card, count(*) n FROM {rows} GROUP BY 1),
share AS (SELECT card, (CASE WHEN card = 0 THEN 1 ELSE least(n, greatest(1, floor(sqrt(n) / total * budget))) END)::BIGINT q
  FROM h, (SELECT sum(sqrt(n)) FILTER (card > 0) total, {maxn} - max((card = 0)::INT) budget FROM h)),
trimmed(c, q) AS (SELECT list(card ORDER BY card), list(q ORDER BY card) FROM share
  UNION ALL SELECT c, list_transform(q, lambda x, i: x - (i = list_position(list_transform(q, lambda y, k: CASE WHEN c[k] = 0 THEN 0 ELSE y END),
    list_max(list_transform(q, lambda y, k: CASE WHEN c[k] = 0 THEN 0 ELSE y END))))::BIGINT)
  FROM trimmed WHERE list_sum(q) > {maxn} AND list_max(list_transform(q, lambda y, k: CASE WHEN c[k] = 0 THEN 0 ELSE y END)) > 1),
quotas AS (SELECT unnest(c) card, unnest(q) quota FROM (SELECT * FROM trimmed ORDER BY list_sum(q) LIMIT 1)),
keyed AS MATERIALIZED (SELECT *, md5('42:' || card || ':' || {key}) ord FROM {rows}),
sampled_0 AS MATERIALIZED (SELECT *, 0::BIGINT links FROM keyed WHERE card = 0
  QUALIFY row_number() OVER (ORDER BY ord, mask, {key}) <= (SELECT coalesce(max(quota), 0) FROM quotas WHERE card = 0)),"""
    for c in range(1, m + 1):
        out += f"""
linked_{c} AS (SELECT k.*, count(p.mask) FILTER (p.card > l.top - 1) l1, count(p.mask) FILTER (p.card > l.top - 2) l2,
    count(p.mask) FILTER (p.card > l.top - 3) l3
  FROM (SELECT * FROM keyed WHERE card = {c}) k CROSS JOIN (SELECT max(card) top FROM sampled_{c - 1}) l
    LEFT JOIN sampled_{c - 1} p ON (p.mask & ~k.mask) = 0 GROUP BY ALL),
sampled_{c} AS MATERIALIZED (SELECT * FROM sampled_{c - 1} UNION ALL
  SELECT * EXCLUDE (l1, l2, l3), CASE WHEN l1 > 0 THEN l1 WHEN l2 > 0 THEN l2 ELSE l3 END links FROM linked_{c}
  QUALIFY row_number() OVER (ORDER BY CASE WHEN l1 > 0 THEN 0 WHEN l2 > 0 THEN 1 WHEN l3 > 0 THEN 2 ELSE 3 END, links DESC, ord, mask, {key})
    <= (SELECT coalesce(max(quota), 0) FROM quotas WHERE card = {c})),"""
    return out + f" sampled AS (SELECT * FROM sampled_{m})"


def graph_select(body: str) -> str:
    return f"WITH RECURSIVE {CRISP_COVERS}, {LEVELS} {body}"


METRICS = """SELECT (SELECT count(*) FROM closed) n_vertices, (SELECT count(*) FROM covers) n_edges,
  round((SELECT count(*) FROM covers) / (SELECT count(*) FROM closed), 6) avg_degree, (max(level) + 1)::BIGINT height,
  (SELECT max(n) FROM (SELECT count(*) n FROM levels GROUP BY level)) width_levels FROM levels"""


def oracle_sql() -> dict[str, str]:
    long = "SELECT obj, attr, q FROM"
    fuzzy_covers = f"""WITH {fixpoints('nation_status', luk)}, {NATION_COVERS} SELECT a.t child, b.t parent FROM covers JOIN f a ON a.mask = child JOIN f b ON b.mask = parent"""
    deg = f"""WITH {CRISP_COVERS}, d AS (
  SELECT 'out' side, mask, (SELECT count(*) FROM covers WHERE child = mask) d FROM closed
  UNION ALL SELECT 'in', mask, (SELECT count(*) FROM covers WHERE parent = mask) FROM closed),
o AS (SELECT side, d, row_number() OVER (PARTITION BY side ORDER BY d) - 1 pos, count(*) OVER (PARTITION BY side) n FROM d)
SELECT side, round(avg(d), 6) avg_degree, max(CASE WHEN pos = n // 2 THEN d END) median_degree, max(d) max_degree
FROM o GROUP BY side"""
    dot_label = "list_transform(attrs, lambda a: (a + 1)::VARCHAR)"
    set_text = "'{' || array_to_string(list_transform(attrs, lambda a: 'a' || (a + 1)), ', ') || '}'"
    dot = f"""WITH {RANKED_EDGES}
SELECT 0::INT section, pos::BIGINT pos, 0::BIGINT sub, value FROM (VALUES (0, 'graph Hasse {{'), (1, 'rankdir=BT;'), (2, 'node [shape=box];')) t(pos, value)
UNION ALL SELECT 1, rank, 0, rank || ' [label="{{' || array_to_string({dot_label}, ',') || '}}"];' FROM ranked
UNION ALL SELECT 2, child, parent, child || ' -- ' || parent || ';' FROM edges
UNION ALL SELECT 3, 0, 0, '}}'"""
    dot_directed = f"""WITH {RANKED_EDGES}
SELECT 0::INT section, pos::BIGINT pos, 0::BIGINT sub, value FROM (VALUES (0, 'digraph fuzzy_lattice {{'), (1, '    rankdir=BT;'), (2, '    node [shape=circle];')) t(pos, value)
UNION ALL SELECT 1, child, parent, '    ' || child || ' -> ' || parent || ';' FROM edges
UNION ALL SELECT 2, 0, 0, '}}'"""
    listing = f"""WITH {SEG_CLOSED}, {ranked(12)},
objs AS (SELECT obj, row_number() OVER (ORDER BY obj) - 1 AS o FROM (SELECT DISTINCT obj FROM seg_month)),
ext AS (SELECT rank, o, max(CASE WHEN ((mask >> attr) & 1) = 1 THEN q ELSE 0 END) q FROM ranked, seg_month JOIN objs USING (obj) GROUP BY 1, 2)
SELECT rank AS pos, -3::BIGINT sub, 'FDMConcept ' || (rank + 1) || ':' AS value FROM ranked
UNION ALL SELECT rank, -2, 'Attributes: ' || {set_text} FROM ranked
UNION ALL SELECT rank, -1, 'Objects:' FROM ranked
UNION ALL SELECT rank, {1 << 62}, '' FROM ranked
UNION ALL SELECT rank, o, '  o' || (o + 1) || ': ' || printf('%.1f', q / 10.0::DOUBLE) FROM ext"""
    context_text = f"""WITH {SUPPLIER_WIDE}
SELECT 0::INT section, 0::BIGINT pos, count(*) || ' 12' AS value FROM sup
UNION ALL SELECT 1, row_number() OVER (ORDER BY obj) - 1,
  array_to_string(list_transform(g, lambda q: printf('%.1f', q / 10.0::DOUBLE)), ' ') FROM sup"""
    intents = f"""WITH {fixpoints('nation_status', luk)}, t AS (SELECT y0, y1, y2, {INTENT3} txt FROM fixed)
SELECT 0::INT section, 0::BIGINT pos, (SELECT count(DISTINCT obj) FROM nation_status) || ' 3 ' || count(*) AS value FROM t
UNION ALL SELECT 1, {FUZZY_ORDER}, 'I' || CASE WHEN txt = '' THEN '' ELSE ' ' || txt END FROM t"""
    def raw(q, a):
        return f"CASE WHEN {q} > 0 THEN '  ' || regexp_replace(({q} / 10.0::DOUBLE)::VARCHAR, '\\.0$', '') || '/{a}' ELSE '' END"
    index = f"""WITH {fixpoints('nation_status', luk)}
SELECT 0::INT section, pos::BIGINT pos, 0::BIGINT sub, value FROM (VALUES (0, '# index -> fuzzy intent'),
  (1, '# format: idx  val/attr val/attr ...')) t(pos, value)
UNION ALL SELECT 1, p, 0, p || {raw('y0', 0)} || {raw('y1', 1)} || {raw('y2', 2)} FROM (SELECT *, {FUZZY_ORDER} p FROM fixed)"""
    joins = f"""WITH RECURSIVE {SEG_CLOSED}, gens AS (SELECT DISTINCT cl g FROM ({object_masks('seg_month', TOP_LEVEL)}) s JOIN cltab USING (mask)),
j(mask) AS (SELECT g FROM gens UNION SELECT c.cl FROM j CROSS JOIN gens JOIN cltab c ON c.mask = (j.mask | g))
SELECT mask FROM j"""
    modal_edges = f"WITH {SEG_CLOSED}, {covers('closed')} SELECT child mask, parent sup_mask FROM covers"
    concept_rows = f"SELECT mask, {CARD} card FROM closed"
    grades3 = f"SELECT {JOINED3} grades FROM fixed"
    return {
        "context_long": f"WITH {ctx('supplier_month')} {long} supplier_month",
        "context_alpha_cut": f"WITH {ctx('supplier_month')} SELECT obj, attr, (q >= {ALPHA})::INT q FROM supplier_month",
        "context_nominal_scaling": f"WITH {scaled('customer_priority')} SELECT obj, crisp_attr attr, (q = value)::INT q "
                                   "FROM customer_priority JOIN smap ON attr = fuzzy_attr",
        "context_ordinal_scaling": f"WITH {scaled('user_event')} SELECT obj, crisp_attr attr, (q >= value)::INT q "
                                   "FROM user_event JOIN smap ON attr = fuzzy_attr",
        "context_scaled_cells": f"WITH {scaled('supplier_month')} SELECT obj, crisp_attr FROM supplier_month "
                                "JOIN smap ON attr = fuzzy_attr AND q = value",
        "scaling_map": f"WITH {scaled('customer_priority')} SELECT crisp_attr, fuzzy_attr, value FROM smap",
        "scaling_explain": f"WITH {scaled('brand_size')} SELECT obj, crisp_attr, fuzzy_attr, value, q, q = value held "
                           "FROM brand_size JOIN smap ON attr = fuzzy_attr",
        "context_stats": f"""WITH {scaled('supplier_month')}, s AS (SELECT count(DISTINCT obj) n, count(*) cells, sum(q) total,
  count(*) FILTER (q > 0) pos, count(*) FILTER (q = 10) ones, (SELECT count(*) FROM smap) sa FROM supplier_month)
SELECT n n_objects, 12::BIGINT n_attrs, round(total / (cells * 10), 6) avg_grade, round(pos / cells, 6) density, ones n_ones,
  sa scaled_attrs, round(pos / (n * sa), 6) scaled_density, round(sa / 12, 6) expansion FROM s""",
        "context_clarified": f"WITH {ctx('customer_priority')}, r AS (SELECT obj, string_agg(q::VARCHAR, ',' ORDER BY attr) grades "
                             "FROM customer_priority GROUP BY obj) SELECT grades, count(*) n_objects FROM r GROUP BY grades",
        "context_embedding": f"WITH {EMBED} {long} emb_ctx",
        "context_documents": f"WITH {ctx('source_lang')} {long} source_lang",
        "implication_luk": f"WITH {NEIGHBOURS} SELECT obj, attr, {luk('a', 'b')} grade FROM nb",
        "implication_goguen": f"WITH {NEIGHBOURS} SELECT obj, attr, {goguen('a', 'b')} floor_grade, {goguen_nearest('a', 'b')} nearest_grade, "
                              f"round({goguen_real('a', 'b')}, 6) real_grade FROM nb",
        "quantize_levels": "SELECT " + ", ".join(
            f"least({s}, greatest(0, ceil(l_discount * 10 * {s} - 0.5::DOUBLE)))::INT level_{n}"
            for n, s in (("l1", 10), ("l2", 100), ("l3", 1000))) + ", count(*) n FROM lineitem GROUP BY 1, 2, 3",
        "pack_tenths": "SELECT least(10, greatest(0, floor(l_quantity / 50 * 10 + 0.5::DOUBLE)))::INT tenths, count(*) n FROM lineitem GROUP BY 1",
        "fuzzy_intersection": f"WITH {SUP_NATION} SELECT obj, string_agg(least(a, b)::VARCHAR, ',' ORDER BY attr) grades FROM sn GROUP BY obj",
        "fuzzy_union": f"WITH {SUP_NATION} SELECT obj, string_agg(greatest(a, b)::VARCHAR, ',' ORDER BY attr) grades FROM sn GROUP BY obj",
        "fuzzy_compare": f"WITH {SUP_NATION} SELECT obj, bool_and(a = b) same, bool_and(a <= b) inside, bool_or(a < b) meet_below, "
                         "sum(a)::BIGINT total, (count(*) FILTER (a > 0))::INT card FROM sn GROUP BY obj",
        "direct_sum": f"WITH {ctx('nation_month')}, {wide('nation_month', 'w')} SELECT obj, j::INT attr, CASE WHEN g[j + 1] < {TOP_LEVEL} THEN "
                      f"array_to_string(g[1:j] || [{TOP_LEVEL}] || list_transform(range(11 - j), lambda x: 0), ',') ELSE 'none' END grades "
                      "FROM w, range(12) r(j)",
        "lectic_order": f"WITH {ctx('supplier_month')} SELECT obj, attr, q < 10 AS before FROM supplier_month",
        "intent_text": f"WITH {ctx('supplier_month')} SELECT obj, coalesce(string_agg(CASE WHEN q > 0 THEN printf('%.3f', q / 10.0::DOUBLE) "
                       "|| '/' || attr END, ' ' ORDER BY attr), '') intent FROM supplier_month GROUP BY obj",
        "modal_extent": f"WITH {EXTENTS} SELECT set_id, obj, ext FROM ext",
        "modal_intent": f"""WITH {EXTENTS}, ok AS (SELECT e.set_id, c.attr, bool_and(c.q <= e.ext) fits FROM ext e
  JOIN supplier_month c USING (obj) GROUP BY 1, 2)
SELECT set_id, sum(CASE WHEN fits THEN 1::BIGINT << attr ELSE 0 END)::BIGINT mask FROM ok GROUP BY set_id""",
        "modal_closure": f"WITH {SEG_CLOSED} SELECT obj, mask, cl closure FROM ({object_masks('seg_month', TOP_LEVEL)}) JOIN cltab USING (mask)",
        "modal_closure_suppliers": f"WITH {ctx('supplier_month')}, {closures('supplier_month', 12)} SELECT obj, mask, cl closure "
                                   f"FROM ({object_masks('supplier_month', TOP_LEVEL)}) JOIN cltab USING (mask)",
        "dm_closure_crisp": f"WITH {CRISP_CLOSED} SELECT obj, mask, cl closure FROM ({object_masks('brand_size', TOP_LEVEL)}) JOIN cltab USING (mask)",
        "modal_closure_wide": f"""WITH {EMBED}, sets AS (SELECT obj sid, attr FROM emb_ctx WHERE q >= 8),
ext AS (SELECT sid, obj, max(q) ext FROM sets JOIN emb_ctx USING (attr) GROUP BY 1, 2),
cl AS (SELECT sid, attr FROM ext JOIN emb_ctx USING (obj) GROUP BY 1, 2 HAVING bool_and(q <= ext))
SELECT sid obj, string_agg(attr::VARCHAR, ',' ORDER BY attr) attrs, count(*)::INT card FROM cl GROUP BY sid""",
        "derive_down_luk": down_sql(luk),
        "derive_down_goguen": down_sql(goguen),
        "derive_down_goguen_nearest": down_sql(goguen_nearest),
        "derive_down_goguen_real": f"SELECT set_id, obj, round(ext, 6) ext FROM ({down_sql(goguen_real)})",
        "derive_up_luk": up_sql(luk),
        "derive_up_goguen": up_sql(goguen),
        "closure_luk": close_sql(luk),
        "closure_goguen": close_sql(goguen),
        "concept_join": f"""WITH {SEG_CLOSED}, a AS (SELECT obj, cl a FROM ({object_masks('seg_month', 10)}) JOIN cltab USING (mask)),
b AS (SELECT obj, cl b FROM ({object_masks('seg_month', 8)}) JOIN cltab USING (mask))
SELECT obj, a, b, cl joined FROM a JOIN b USING (obj) JOIN cltab ON mask = (a | b)""",
        "concepts_powerset": f"WITH {SEG_CLOSED} {concept_rows}",
        "concepts_cbo": f"WITH {SEG_CLOSED} {concept_rows}",
        "concepts_region": f"WITH {ctx('region_bucket')}, {closures('region_bucket', 10)} {concept_rows}",
        "concepts_crisp": f"WITH {CRISP_CLOSED} {concept_rows}",
        "concepts_suppliers": f"WITH {ctx('supplier_month')}, {closures('supplier_month', 12)} {concept_rows}",
        "concepts_types": f"WITH RECURSIVE {TYPE_CONCEPTS} {concept_rows}",
        "hasse_edges_types": f"WITH RECURSIVE {TYPE_COVERS} SELECT child mask, parent sup_mask FROM covers",
        "lattice_metrics_types": f"WITH RECURSIVE {TYPE_COVERS}, {LEVELS} {METRICS}",
        "link_score_types": f"WITH RECURSIVE {TYPE_CONCEPTS} SELECT b.mask, count(*) links FROM closed a JOIN closed b ON (a.mask & ~b.mask) = 0 GROUP BY b.mask",
        "enumeration_counters": f"""WITH {SEG_CLOSED}, gen AS (SELECT c.mask, CASE WHEN c.mask = (SELECT min(cl) FROM cltab WHERE mask = 0) THEN -1
  ELSE min(j) END y FROM closed c, range(12) r(j) JOIN cltab t ON true
  WHERE t.mask = (c.mask & ((1::BIGINT << (j::INT + 1)) - 1)) AND t.cl = c.mask GROUP BY c.mask),
tries AS (SELECT count(*) n FROM gen, range(12) r(j) WHERE j > y AND ((mask >> j::INT) & 1) = 0)
SELECT (SELECT count(*) FROM gen) concepts, n closures, n - (SELECT count(*) FROM gen) + 1 rejected FROM tries""",
        "concepts_scaled": f"""WITH {scaled('region_bucket')}, cells AS (SELECT crisp_attr, obj FROM region_bucket JOIN smap ON attr = fuzzy_attr AND q = value),
cols AS (SELECT crisp_attr, sum(1::BIGINT << obj)::BIGINT ext FROM cells GROUP BY 1), sub AS (SELECT range::BIGINT o FROM range(32)),
closed AS (SELECT DISTINCT mask FROM (SELECT o, coalesce(sum(1::BIGINT << crisp_attr), 0)::BIGINT mask FROM sub
  LEFT JOIN cols ON (ext & ~o) = 0 GROUP BY o)) {concept_rows}""",
        "concepts_with_bottom": f"WITH {CRISP_CLOSED} SELECT mask, {CARD} card FROM (SELECT mask FROM closed UNION SELECT 0::BIGINT)",
        "canonical_generator": f"""WITH {SEG_CLOSED} SELECT c.mask, (CASE WHEN c.mask = (SELECT min(cl) FROM cltab WHERE mask = 0) THEN -1
  ELSE min(j) END)::INT y FROM closed c, range(12) r(j) JOIN cltab t ON true
  WHERE t.mask = (c.mask & ((1::BIGINT << (j::INT + 1)) - 1)) AND t.cl = c.mask GROUP BY c.mask""",
        "concept_extents": f"WITH {SEG_CLOSED} SELECT mask, obj, max(CASE WHEN ((mask >> attr) & 1) = 1 THEN q ELSE 0 END) ext "
                           "FROM closed, seg_month GROUP BY mask, obj",
        "card_histogram": f"WITH {SEG_CLOSED} SELECT {CARD} card, count(*) n FROM closed GROUP BY 1",
        "concept_order": f"WITH {SEG_CLOSED}, {ranked(12)} SELECT mask, rank FROM ranked",
        "fuzzy_concepts_luk": f"WITH {fixpoints('customer_status', luk)} {grades3}",
        "fuzzy_concepts_goguen": f"WITH {fixpoints('customer_status', goguen)} {grades3}",
        "fuzzy_concepts_flags": f"WITH {fixpoints('supplier_flag', luk)} {grades3}",
        "fuzzy_concepts_users": f"WITH {fixpoints('user_event', luk)} SELECT {JOINED3} || ',' || y3 || ',' || y4 grades FROM fixed",
        "fuzzy_fixpoints_nearest": f"WITH {fixpoints('nation_status', goguen_nearest)} {grades3}",
        "fuzzy_concepts_quota": f"WITH {fixpoints('user_event', luk)} SELECT {JOINED3} || ',' || y3 || ',' || y4 grades FROM fixed "
                                f"ORDER BY y0, y1, y2, y3, y4 LIMIT {QUOTA}",
        "fuzzy_counters": f"WITH {NATION_TRIES} SELECT concepts, tried, rejected FROM counters",
        "metrics_log": f"""WITH RECURSIVE {NATION_TRIES}, {NATION_COVERS},
lv(id, d) AS (SELECT mask, 0 FROM f UNION SELECT parent, d + 1 FROM lv JOIN covers ON child = id),
levels AS (SELECT id, max(d) AS level FROM lv GROUP BY id),
d AS (SELECT 'out_' side, mask, (SELECT count(*) FROM covers WHERE child = mask) d FROM f
  UNION ALL SELECT 'in_', mask, (SELECT count(*) FROM covers WHERE parent = mask) FROM f),
o AS (SELECT side, d, row_number() OVER (PARTITION BY side ORDER BY d) - 1 pos, count(*) OVER (PARTITION BY side) n FROM d),
s AS (SELECT side, round(avg(d), 6) a, max(CASE WHEN pos = n // 2 THEN d END) m, max(d) t FROM o GROUP BY side)
SELECT metric, value::DOUBLE AS value FROM (SELECT side || 'avg_degree' metric, a AS value FROM s UNION ALL SELECT side || 'median_degree', m FROM s
  UNION ALL SELECT side || 'max_degree', t FROM s UNION ALL SELECT 'concepts', concepts FROM counters UNION ALL SELECT 'tried', tried FROM counters
  UNION ALL SELECT 'rejected', rejected FROM counters UNION ALL SELECT 'n_vertices', count(*) FROM f UNION ALL SELECT 'n_edges', count(*) FROM covers
  UNION ALL SELECT 'height', max(level) + 1 FROM levels
  UNION ALL SELECT 'width_levels', max(n) FROM (SELECT count(*) n FROM levels GROUP BY level))""",
        "next_closure_order": f"WITH {fixpoints('nation_status', luk)} SELECT {JOINED3} grades, {FUZZY_ORDER} AS position FROM fixed",
        "forced_bounds": f"""WITH {fixpoints('supplier_flag', luk)} SELECT 'min_intent' bound, {JOINED3} grades FROM (
  SELECT min(a0) y0, min(a1) y1, min(a2) y2 FROM rws)
UNION ALL SELECT 'max_intent', u0 || ',' || u1 || ',' || u2 FROM ups WHERE y0 = 10 AND y1 = 10 AND y2 = 10""",
        "crisp_subset_pairs": f"WITH {CRISP_CLOSED} SELECT a.mask, b.mask sup_mask FROM closed a JOIN closed b ON {below('a.mask', 'b.mask')}",
        "fuzzy_subset_pairs": f"WITH {USER_STEPS} SELECT a.mask, b.mask sup_mask FROM steps a JOIN steps b ON {below('a.mask', 'b.mask')}",
        "hasse_edges_crisp": f"WITH {CRISP_COVERS} SELECT child mask, parent sup_mask FROM covers",
        "hasse_edges_modal": modal_edges,
        "hasse_edges_family": f"WITH {ctx('supplier_month')}, fam AS (SELECT DISTINCT mask FROM ({object_masks('supplier_month', ALPHA)})), "
                              f"{covers('fam')} SELECT child mask, parent sup_mask FROM covers",
        "hasse_edges_fuzzy": fuzzy_covers,
        "hasse_rows_fuzzy": f"WITH {USER_STEPS}, {covers('steps')} SELECT child mask, parent sup_mask FROM covers",
        "degree_stats": deg,
        "lattice_levels": graph_select("SELECT id, level::INT AS level FROM levels"),
        "topological_order": graph_select("SELECT id, level::INT AS level, row_number() OVER (ORDER BY level, id) - 1 AS position FROM levels"),
        "topological_order_types": f"WITH RECURSIVE {TYPE_COVERS}, {LEVELS} SELECT level::INT AS level, count(*) n, true each_edge_once FROM levels GROUP BY level",
        "lattice_height": graph_select("SELECT (max(level) + 1)::BIGINT height FROM levels"),
        "width_levels": graph_select("SELECT max(n) width_levels FROM (SELECT count(*) n FROM levels GROUP BY level)"),
        "lattice_metrics": graph_select(METRICS),
        "join_closure": joins,
        "width_exact_languages": f"""WITH {ctx('source_lang')}, {closures('source_lang', 4)},
numbered AS (SELECT mask, row_number() OVER (ORDER BY mask) - 1 AS i FROM closed),
related AS (SELECT (1::BIGINT << a.i) | (1::BIGINT << b.i) AS ends FROM numbered a JOIN numbered b ON {below('a.mask', 'b.mask')}),
choices AS (SELECT range AS s FROM range((1::BIGINT << (SELECT count(*) FROM closed))::BIGINT))
SELECT max(bit_count(s))::BIGINT AS width_exact FROM choices WHERE NOT EXISTS (SELECT 1 FROM related WHERE (s & ends) = ends)""",
        "fuzzy_join_closure": f"""WITH RECURSIVE {NATION_INTENTS}, reach AS (SELECT c0, c1, c2 FROM gens
  UNION SELECT j.c0, j.c1, j.c2 FROM reach r CROSS JOIN (SELECT DISTINCT c0, c1, c2 FROM gens) g JOIN cl j
    ON j.x0 = greatest(r.c0, g.c0) AND j.x1 = greatest(r.c1, g.c1) AND j.x2 = greatest(r.c2, g.c2))
SELECT c0 || ',' || c1 || ',' || c2 AS grades FROM reach""",
        "fuzzy_concept_join": f"""WITH {NATION_INTENTS}
SELECT a.obj, a.c0 || ',' || a.c1 || ',' || a.c2 AS a, b.c0 || ',' || b.c1 || ',' || b.c2 AS b, j.c0 || ',' || j.c1 || ',' || j.c2 AS joined
FROM gens a JOIN gens b ON b.obj = a.obj + 1 JOIN cl j
  ON j.x0 = greatest(a.c0, b.c0) AND j.x1 = greatest(a.c1, b.c1) AND j.x2 = greatest(a.c2, b.c2)""",
        "incremental_hasse": modal_edges,
        "incremental_hasse_fuzzy": fuzzy_covers,
        "dominance_lookup": f"""WITH {ctx('user_event')}, {ctx('customer_priority')}, {wide('user_event', 'u')}, {wide('customer_priority', 'c')},
rows_ AS (SELECT DISTINCT g FROM u)
SELECT c.obj, array_to_string(r.g, ',') AS parent FROM c JOIN rows_ r ON {' AND '.join(f'r.g[{j}] >= c.g[{j}]' for j in range(1, 6))} AND r.g <> c.g""",
        "incremental_hasse_restart": modal_edges,
        "sqrt_quota": f"""WITH {SEG_CLOSED}, h AS (SELECT {CARD} card, count(*) n FROM closed GROUP BY 1),
t AS (SELECT sum(sqrt(n)) FILTER (card > 0) total, {SAMPLE_BUDGET} - max((card = 0)::INT) budget FROM h)
SELECT card, n, (CASE WHEN card = 0 THEN 1 ELSE least(n, greatest(1, floor(sqrt(n) / total * budget))) END)::BIGINT quota FROM h, t""",
        "link_score": f"WITH {SEG_CLOSED} SELECT b.mask, count(*) links FROM closed a JOIN closed b ON (a.mask & ~b.mask) = 0 GROUP BY b.mask",
        "quota_sample": f"""WITH RECURSIVE {SEG_CLOSED}, sized AS (SELECT mask, {CARD} card FROM closed),
{sample('sized', 12, SAMPLE_BUDGET, 'mask')} SELECT mask, card, ord, links FROM sampled""",
        "quota_sample_types": f"""WITH RECURSIVE {TYPE_CONCEPTS}, sized AS (SELECT mask, {CARD} card FROM closed),
{sample('sized', 50, 5000, 'mask')} SELECT mask, card, ord, links FROM sampled""",
        "sample_lines": f"""WITH RECURSIVE {fixpoints('nation_status', luk)}, t AS (SELECT *, {FUZZY_ORDER} p, {INTENT3} txt FROM fixed),
listed AS (SELECT (y0 > 0)::BIGINT + 2 * (y1 > 0)::BIGINT + 4 * (y2 > 0)::BIGINT mask, p + 1 AS line,
  'I' || CASE WHEN txt = '' THEN '' ELSE ' ' || txt END AS value, ((y0 > 0)::INT + (y1 > 0)::INT + (y2 > 0)::INT)::INT card FROM t),
{sample('listed', 3, SAMPLE_LINES, 'line')} SELECT line, value, mask, card, links FROM sampled""",
        "concepts_real": f"WITH {real(10)}, {closures('real', 10)} {concept_rows}",
        "closure_real": f"""WITH {real(10)}, {closures('real', 10)} SELECT obj, mask, cl closure
FROM (SELECT obj, sum(CASE WHEN q >= 0.1::DOUBLE THEN 1::BIGINT << attr ELSE 0 END)::BIGINT mask FROM real GROUP BY obj) JOIN cltab USING (mask)""",
        "extents_real": f"""WITH {real(4)}, {closures('real', 4)}
SELECT mask, obj, max(CASE WHEN ((mask >> attr) & 1) = 1 AND q > 0 THEN q ELSE 0 END)::DOUBLE ext FROM closed, real GROUP BY mask, obj""",
        "scaling_map_real": f"""WITH {real(4)} SELECT row_number() OVER (ORDER BY attr, q) - 1 AS crisp_attr, attr fuzzy_attr, q AS value
FROM (SELECT DISTINCT attr, q FROM real WHERE q > 1e-9::DOUBLE)""",
        "scan_real": f"""WITH {real(6)} SELECT dense_rank() OVER (ORDER BY obj) - 1 AS obj, attr, (q >= 0.0625::DOUBLE)::INT q FROM real""",
        "concepts_wide": f"WITH {WIDE} SELECT attrs, card FROM closed",
        "hasse_edges_wide": f"WITH {WIDE}, {covers('closed')} SELECT a.attrs child, b.attrs parent FROM covers JOIN closed a ON a.mask = child "
                            "JOIN closed b ON b.mask = parent",
        "lattice_metrics_wide": f"WITH RECURSIVE {WIDE}, {covers('closed')}, {LEVELS} {METRICS}",
        "windowed_context": f"""WITH e AS (SELECT (epoch(ts)::BIGINT // 604800) * 604800 AS start, user_id obj, {_case('event_type', EVENT_TYPES)} attr FROM events),
n AS (SELECT start, obj, attr, count(*) n FROM e GROUP BY ALL),
d AS (SELECT o.start, o.obj, a.attr, coalesce(n.n, 0) n FROM (SELECT DISTINCT start, obj FROM e) o CROSS JOIN (SELECT range::INT attr FROM range(5)) a
  LEFT JOIN n ON n.start = o.start AND n.obj = o.obj AND n.attr = a.attr),
q AS (SELECT start, obj, attr, (10 * n) // max(n) OVER (PARTITION BY start, obj) q FROM d)
SELECT start, obj, string_agg(q::INT::VARCHAR, ',' ORDER BY attr) grades FROM q GROUP BY start, obj""",
        "closure_large": f"WITH {ctx('supplier_month')}, {closures('supplier_month', 12)} SELECT obj, mask, cl closure "
                         f"FROM ({object_masks('supplier_month', TOP_LEVEL)}) JOIN cltab USING (mask)",
        "fuzzy_closure_large": f"""WITH {DOWN}, dwn AS (SELECT y.obj sid, c.obj g, min({luk('y.q', 'c.q')}) d FROM nation_month y JOIN supplier_month c USING (attr) GROUP BY 1, 2),
ups AS (SELECT sid, c.attr, min({luk('d', 'c.q')}) q FROM dwn JOIN supplier_month c ON c.obj = g GROUP BY 1, 2)
SELECT sid set_id, string_agg(q::VARCHAR, ',' ORDER BY attr) closure FROM ups GROUP BY sid""",
        "dot_lines": dot,
        "dot_directed_lines": dot_directed,
        "edge_list": f"WITH {RANKED_EDGES} SELECT child pos, parent sub, child || ' ' || parent AS value FROM edges",
        "hasse_input_lines": f"WITH {SEG_CLOSED}, {ranked(12)} SELECT rank pos, {set_text} || ',' AS value FROM ranked",
        "concept_listing": listing,
        "intent_lines": intents,
        "index_lines": index,
        "context_lines": context_text,
        "scan_context": f"""WITH {ctx('supplier_month')}, o AS (SELECT obj, row_number() OVER (ORDER BY obj) - 1 AS pos FROM (SELECT DISTINCT obj FROM supplier_month))
SELECT pos obj, attr, q FROM supplier_month JOIN o USING (obj)""",
        "scan_context_lenient": f"""WITH {ctx('supplier_month')}, o AS (SELECT obj, row_number() OVER (ORDER BY obj) - 1 AS pos FROM (SELECT DISTINCT obj FROM supplier_month))
SELECT pos obj, attr, (CASE WHEN pos > (SELECT max(pos) FROM o) - 3 OR pos % 7 = 3 AND attr = 0 THEN 0 ELSE q END)::INT q
FROM supplier_month JOIN o USING (obj)""",
        "scan_crisp_context": f"""WITH {CRISP}, o AS (SELECT obj, row_number() OVER (ORDER BY obj) - 1 AS pos FROM (SELECT DISTINCT obj FROM crisp))
SELECT pos obj, attr, q FROM crisp JOIN o USING (obj)""",
        "scan_concept_sets": f"WITH {SEG_CLOSED} SELECT mask FROM closed",
        "scan_intents": f"WITH {fixpoints('nation_status', luk)} SELECT {FUZZY_ORDER} id, {JOINED3} grades, "
                        "((y0 > 0)::INT + (y1 > 0)::INT + (y2 > 0)::INT)::INT card FROM fixed",
        "scan_sample_input": f"""WITH {fixpoints('nation_status', luk)}, t AS (SELECT *, {FUZZY_ORDER} p, {INTENT3} txt FROM fixed)
SELECT (y0 > 0)::BIGINT + 2 * (y1 > 0)::BIGINT + 4 * (y2 > 0)::BIGINT mask, p + 1 AS line,
  'I' || CASE WHEN txt = '' THEN '' ELSE ' ' || txt END AS value, ((y0 > 0)::INT + (y1 > 0)::INT + (y2 > 0)::INT)::INT card FROM t""",
    }
