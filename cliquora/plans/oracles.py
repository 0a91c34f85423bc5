"""The registered queries in SQL, as chains of common table expressions."""

from __future__ import annotations

TRADE = """
t as (select year(o_orderdate)::int as year, l_returnflag = 'R' as flag, least(c_nationkey, s_nationkey)::bigint as u, greatest(c_nationkey, s_nationkey)::bigint as v, count(*) as n
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
      where c_nationkey <> s_nationkey group by all),
nw as (select u, v, sum(n)::bigint as n from t group by u, v)"""

NATIONS = TRADE + """,
ge as (select 0 as g, u, v, n from (select *, avg(n) over () as mean from nw) where n > mean),
gv as (select 0 as g, n_nationkey::bigint as vertex from nation)"""

YEARLY = TRADE + """,
ys as (select case when flag then 'returned' else 'kept' end as grp, year as sample, u, v from (select *, avg(n) over (partition by year, flag) as mean from t) where n > mean),
ns as (select case when flag then 'returned' else 'kept' end as grp, count(distinct year) as n from t group by flag),
agreed as (select ys.grp, u, v from ys join ns on ys.grp = ns.grp group by ys.grp, u, v, ns.n having count(*) / ns.n > 0.95)"""

CONSENSUS = YEARLY + """,
ge as (select grp as g, u, v from agreed),
gv as (select grp as g, n_nationkey::bigint as vertex from ns, nation)"""

SAMPLES = YEARLY + """,
ge as (select grp || ' ' || sample as g, u, v from ys),
gv as (select g, n_nationkey::bigint as vertex from (select distinct g from ge), nation)"""

CLIQUES = """,
adj as (select g, u as a, v as b from ge union all select g, v, u from ge),
nb as (select g, a, list_sort(list(b)) as l from adj group by g, a),
cl as (select g, [a] as m, l as common, list_filter(l, lambda x: x > a) as cand from nb
       union all
       select c.g, list_append(c.m, c.x), list_intersect(c.common, nb.l), list_filter(list_intersect(c.common, nb.l), lambda y: y > c.x)
       from (select *, unnest(cand) as x from cl) c join nb on nb.g = c.g and nb.a = c.x),
mc as (select g, m from cl where len(common) = 0
       union all select g, [vertex] from gv where not exists (select 1 from nb where nb.g = gv.g and nb.a = gv.vertex))"""

COMPLEX = CLIQUES + """,
k as (select g, row_number() over (partition by g order by m) - 1 as sid, m from mc)"""

CONNECTED = """,
inc as (select g, sid, unnest(m) as vertex from k),
pr as (select a.g, a.sid as i, b.sid as j, count(*) as shared from inc a join inc b on a.g = b.g and a.vertex = b.vertex and a.sid <> b.sid group by all),
lv as (select g, unnest(range(0, max(len(m)))) as q from k group by g),
reach as (select lv.g, q, sid as a, sid as b from k join lv on lv.g = k.g and len(m) > q
          union
          select r.g, r.q, r.a, pr.j from reach r join pr on pr.g = r.g and pr.i = r.b and pr.shared > r.q),
comp as (select g, q, a as sid, min(b) as component from reach group by g, q, a)"""

VECTORS = CONNECTED + """,
sc as (select lv.g, lv.q, count(k.sid) as n from lv left join k on k.g = lv.g and len(k.m) - 1 = lv.q group by lv.g, lv.q),
sv as (select g, q, sum(n) over (partition by g order by q desc) as n from sc),
fv as (select g, q, count(distinct component) as n from comp group by g, q),
fc as (select lv.g, lv.q, count(pr.i) as n from lv left join pr on pr.g = lv.g and pr.i < pr.j and pr.shared - 1 = lv.q group by lv.g, lv.q),
oc as (select k.g, len(k.m) - 1 as q, vertex, count(*) as c from k join inc on inc.g = k.g and inc.sid = k.sid group by all),
en as (select g, q, case when count(*) > 1 then -sum(p * log10(p)) / log10(count(*)) end as n from (select *, c / sum(c) over (partition by g, q) as p from oc) group by g, q),
vec as (select g, q, 'simplices' as vector, n::double as value from sc union all select g, q, 'ssv', n::double from sv union all select g, q, 'fsv', n::double from fv
        union all select sv.g, sv.q, 'tsv', case when sv.n = 0 then 0 else 1 - fv.n / sv.n end from sv join fv on sv.g = fv.g and sv.q = fv.q
        union all select g, q, 'faces', n::double from fc union all select lv.g, lv.q, 'entropy', en.n from lv left join en on en.g = lv.g and en.q = lv.q)"""

K_ORDER = "k as (select 0 as g, l_orderkey::bigint as sid, list_sort(list(distinct l_suppkey::bigint)) as m from lineitem group by l_orderkey)"
K_SUPP = "k as (select 0 as g, l_suppkey::bigint as sid, list_sort(list(distinct l_partkey::bigint)) as m from lineitem group by l_suppkey)"
PAIRS = """,
inc as (select sid, unnest(m) as vertex from k),
pr as (select a.sid as i, b.sid as j, count(*) as shared from inc a join inc b on a.vertex = b.vertex and a.sid < b.sid group by all)"""
LEVELS = """,
lv as (select unnest(range(0, max(len(m)))) as q from k)"""


def with_(*parts: str, recursive: bool = True) -> str:
    return f"with {'recursive ' if recursive else ''}" + "".join(parts)


def persistence(edges: str, max_q: int) -> str:
    """Intervals of the edges `e` (u, v, w): q, birth, death, size, members."""
    return f"""with recursive {edges},
cl as (select [u, v] as m, w as birth, 2 as size from e
       union all
       select list_append(m, x), greatest(birth, mw), size + 1 from (
         select c.m, c.birth, c.size, e.v as x, count(*) as n, max(e.w) as mw from cl c join e on list_contains(c.m, e.u) and e.v > c.m[c.size] where c.size < {max_q + 2} group by 1, 2, 3, 4) where n = size),
ob as (select 0 as q, [x] as a, min(w) as birth from (select u as x, w from e union all select v, w from e) group by x
       union all select size - 1, m, birth from cl where size <= {max_q + 1}),
li as (select size - 2 as q, birth as w, list_filter(m, lambda x, i: i <> 1) as a, list_filter(m, lambda x, i: i <> p) as b from (select *, unnest(range(2, size + 1)) as p from cl)),
lb as (select q, w, a, b from li union all select q, w, b, a from li),
ts as (select t, lead(t) over (order by t) as after from (select distinct w as t from e)),
reach as (select t, q, a, a as b from ob join ts on birth <= t
          union
          select r.t, r.q, r.a, lb.b from reach r join lb on lb.q = r.q and lb.a = r.b and lb.w <= r.t),
la as (select t, q, a, min(b) as label from reach group by t, q, a),
co as (select la.t, la.q, label, min(birth) as birth, list_sort(list_distinct(flatten(list(la.a)))) as members from la join ob on ob.q = la.q and ob.a = la.a group by la.t, la.q, label),
go as (select co.*, ts.after, la.label as goes from co join ts on ts.t = co.t left join la on la.t = ts.after and la.q = co.q and la.a = co.label),
rk as (select *, row_number() over (partition by q, t, goes order by birth, len(members) desc, members) as rn from go)
select q::int as q, birth, case when after is null then 'Infinity'::double else after end as death, len(members)::int as size, array_to_string(members, ' ') as members
from rk where after is null or rn > 1"""


#: The order of intervals, members as numbers; rows that this leaves open are equal.
DIAGRAM_ORDER = "order by q, birth, death, list_transform(string_split(members, ' '), lambda x: x::bigint) rows unbounded preceding"
NATION_STEPS = TRADE.strip() + """,
e as (select u, v, (((top - n) * 8) // (top - low + 1))::double as w from (select *, max(n) over () as top, min(n) over () as low from nw))"""
REGIONS = TRADE.strip() + """,
e as (select least(a.n_regionkey, b.n_regionkey)::bigint as u, greatest(a.n_regionkey, b.n_regionkey)::bigint as v, -sum(n)::double as w
      from nw join nation a on nw.u = a.n_nationkey join nation b on nw.v = b.n_nationkey where a.n_regionkey <> b.n_regionkey group by 1, 2)"""
LABELS = """me as (select label, d, avg(x::double) as x from (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as d from embeddings where label is not null) group by label, d),
no as (select label, row_number() over (order by label) - 1 as i from (select distinct label from me)),
e as (select a.i as u, b.i as v, round(sum((x.x - y.x) ** 2), 3) as w from me x join me y on x.d = y.d join no a on a.label = x.label join no b on b.label = y.label where a.i < b.i group by a.i, b.i)"""

#: Components of every level by the widest paths between simplices, doubled until paths of any length are in.
WIDEST = K_SUPP + PAIRS + """,
w0 as (select i, j, shared as w from pr union all select j, i, shared from pr union all select sid, sid, len(m) from k),
""" + ",\n".join(f"w{n + 1} as materialized (select a.i, b.j, max(least(a.w, b.w)) as w from w{n} a join w{n} b on a.j = b.i group by a.i, b.j)" for n in range(7)) + """,
lv as (select sid, unnest(range(0, len(m))) as q from k),
comp as (select q, sid, min(j) as component from lv join w7 on w7.i = sid and w7.w > q group by q, sid)"""

#: The difference of two groups under 10 000 exchanges of their labels; a team is a set of samples that some exchange deals to a group.
PERMUTED = YEARLY + """,
sa as (select distinct case when flag then 'returned' else 'kept' end as grp, (case when flag then 'returned' else 'kept' end) || ' ' || year as sample_id from t),
la as (select grp, row_number() over (order by grp, sample_id) as place from sa),
de as (select r, sample_id, row_number() over (partition by r order by md5('0:' || r || ':' || sample_id), sample_id) as place from sa cross join range(1, 10001) x(r)),
dl as (select 0 as r, sample_id, grp from sa union all select r, sample_id, la.grp from de join la on la.place = de.place),
tm as (select r, grp, list_sort(list(sample_id)) as own from dl group by r, grp),
ti as (select own, row_number() over (order by own) as g from (select distinct own from tm)),
tn as (select ti.g, len(own) as n, unnest(own) as sample_id from ti),
ge as (select g, u, v from tn join ys on tn.sample_id = ys.grp || ' ' || ys.sample group by g, u, v, n having count(*) / n > 0.95),
gv as (select g, n_nationkey::bigint as vertex from ti, nation)"""

SUPPLIERS = """pl as (select distinct l_orderkey as o, l_suppkey as s from lineitem),
pn as (select a.s as u, b.s as v, count(*) as n from pl a join pl b on a.o = b.o and a.s <> b.s group by all),
e as (select distinct least(u, v)::bigint as u, greatest(u, v)::bigint as v, -n::double as w from (select *, row_number() over (partition by u order by n desc, v) as place from pn) where place <= 3)"""

STARS = """,
k as (select grp || ' ' || sample as g, u as sid, list_sort(list(distinct v)) as m from ys group by all)"""

#: Core numbers by peeling one layer at a time: the vertices of the least degree go, and k is the largest least degree so far.
CORES = """,
pe as (select 0 as step, 0 as k, list(distinct x) as own, []::bigint[] as gone, [0]::bigint[] as ks from (select u as x from e union all select v from e)
       union all
       select step + 1, greatest(k, low), list_filter(own, lambda x: not list_contains(out, x)), list_concat(gone, out), list_concat(ks, list_transform(out, lambda x: greatest(k, low)::bigint))
       from (select *, (select min(n) from (select x, count(y) as n from unnest(own) o(x) left join (select u as a, v as y from e union all select v, u from e) on a = x and list_contains(own, y) group by x)) as low from pe where len(own) > 0) p,
       lateral (select list(x) as out from (select x, count(y) as n from unnest(p.own) o(x) left join (select u as a, v as y from e union all select v, u from e) on a = x and list_contains(p.own, y) group by x) where n = p.low) q),
la as (select gone, ks[2:] as ks from pe where len(own) = 0)
select unnest(gone) as vertex, unnest(ks) as core from la"""

ORACLES = {
    "simplex_count": with_(K_ORDER, LEVELS, " select lv.q::int as q, count(k.sid) as value from lv left join k on len(m) - 1 = lv.q group by lv.q"),
    "ssv": with_(K_ORDER, LEVELS, " select lv.q::int as q, count(k.sid) as value from lv left join k on len(m) - 1 >= lv.q group by lv.q"),
    "order": with_(K_ORDER, " select (max(len(m)) - 1)::int as value from k"),
    "counts": with_(K_ORDER, " select count(*) as num_simplices, max(list_max(m)) + 1 as num_vertices from k"),
    "vertices": "select distinct l_suppkey::bigint as vertex from lineitem",
    "dims": with_(K_ORDER, " select sid, (len(m) - 1)::int as dim from k"),
    "occupation": with_(K_ORDER, " select q, vertex, count(*) as value from (select (len(m) - 1)::int as q, unnest(m) as vertex from k) group by all"),
    "occupation_probability": with_(K_ORDER, ", oc as (select q, vertex, count(*) as c from (select (len(m) - 1)::int as q, unnest(m) as vertex from k) group by all) select q, vertex, round(c / sum(c) over (partition by q), 9) as value from oc"),
    "entropy": with_(K_ORDER, LEVELS, """, oc as (select q, vertex, count(*) as c from (select len(m) - 1 as q, unnest(m) as vertex from k) group by all),
        en as (select q, case when count(*) > 1 then -sum(p * log10(p)) / log10(count(*)) end as n from (select *, c / sum(c) over (partition by q) as p from oc) group by q)
        select lv.q::int as q, round(n, 6) as value from lv left join en on en.q = lv.q"""),
    "dimensionality": with_(K_ORDER, " select vertex, count(*) as value from (select unnest(m) as vertex from k) group by all"),
    "skeleton": with_(K_ORDER, " select sid, array_to_string(m, ' ') as members from k where len(m) > 3"),
    "incidence": with_(K_ORDER, " select sid, unnest(m) as vertex from k"),
    "incidence_matrix": with_(NATIONS, COMPLEX, " select k.sid, " + ", ".join(f"max((list_contains(m, {v}))::int)::int as v{v}" for v in range(25)) + " from k group by k.sid"),
    "shared_faces": with_(K_SUPP, PAIRS, LEVELS, " select lv.q::int as q, count(pr.i) as value from lv left join pr on pr.shared - 1 = lv.q group by lv.q"),
    "overlaps": with_(K_SUPP, PAIRS, " select i, j, shared from pr where shared >= 3"),
    "shared_faces_words": with_(K_SUPP, PAIRS, LEVELS, " select lv.q::int as q, count(pr.i) as value from lv left join pr on pr.shared - 1 = lv.q group by lv.q"),
    "served_overlaps": """with inc as (select distinct l_suppkey::bigint as sid, c_nationkey as vertex from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)
        select a.sid as i, b.sid as j, count(*) as shared from inc a join inc b on a.vertex = b.vertex and a.sid < b.sid group by all""",
    "vertex_words": """with inc as (select distinct l_orderkey::bigint as sid, l_suppkey::bigint as v from lineitem)
        select sid, v // 64 as bucket, bit_or(case when v % 64 = 63 then -9223372036854775808 else 1::bigint << (v % 64)::int end)::bigint as word from inc group by all""",
    "word_sets": """with a as (select distinct l_suppkey::bigint as sid, l_partkey as v from lineitem where l_returnflag = 'R'),
        b as (select distinct l_suppkey::bigint as sid, l_partkey as v from lineitem where l_returnflag <> 'R'),
        m as (select coalesce(a.sid, b.sid) as sid, a.sid is not null as ra, b.sid is not null as rb from a full join b on a.sid = b.sid and a.v = b.v)
        select sid, 'both' as op, count(*) as value from m where ra and rb group by sid union all select sid, 'either', count(*) from m group by sid
        union all select sid, 'returned', count(*) from m where ra and not rb group by sid""",
    "connectivity": with_(K_SUPP, PAIRS, """ select i, j, (shared - 1)::bigint as value from pr union all select j, i, (shared - 1)::bigint from pr union all select sid, sid, (len(m) - 1)::bigint from k"""),
    "connectivity_dense": with_(NATIONS, COMPLEX, PAIRS, """ select a.sid as i, b.sid as j, case when a.sid = b.sid then len(a.m) - 1 else coalesce(shared, 0) - 1 end::bigint as value
        from k a cross join k b left join pr on pr.i = least(a.sid, b.sid) and pr.j = greatest(a.sid, b.sid)"""),
    "eccentricity": with_(K_SUPP, PAIRS, ", bo as (select i, j, shared from pr union all select j, i, shared from pr) select i, j, round(1 - shared / len(m), 6) as value from bo join k on k.sid = i"),
    "family_eccentricity": with_(K_SUPP, PAIRS, """, bo as (select i, shared from pr union all select j, shared from pr), lo as (select i, max(shared) as s from bo group by i)
        select sid, case when (select count(*) from k) > 1 then round(1 - coalesce(s, 0) / len(m), 6) end as value from k left join lo on i = sid"""),
    "maximal_cliques": with_(NATIONS, CLIQUES, " select array_to_string(m, ' ') as members, len(m)::int as size from mc"),
    "core_numbers": "with recursive " + SUPPLIERS + CORES,
    "hub_cliques": "with recursive " + SUPPLIERS + """, ge as (select 0 as g, u, v from e), gv as (select 0 as g, u as vertex from e where false)""" + CLIQUES + " select array_to_string(m, ' ') as members, len(m)::int as size from mc",
    "k_cliques": with_(NATIONS, CLIQUES, " select array_to_string(m, ' ') as members, len(m)::int as size from cl where len(m) <= 5"),
    "edge_cliques": with_(NATIONS, CLIQUES, " select array_to_string(m, ' ') as members from mc where list_contains(m, (select min(u) from ge)) and list_contains(m, (select min(v) from ge where u = (select min(u) from ge)))"),
    "components": with_(NATIONS, COMPLEX, CONNECTED, " select q::int as q, sid, component from comp"),
    "fsv": with_(NATIONS, COMPLEX, CONNECTED, " select q::int as q, count(distinct component) as value from comp group by q"),
    "tsv": with_(NATIONS, COMPLEX, CONNECTED, " select q::int as q, round(1 - count(distinct component) / count(*), 6) as value from comp group by q"),
    "bundle": with_(NATIONS, COMPLEX, VECTORS, " select q::int as q, vector, round(value, 6) as value from vec"),
    "full_characterisation": with_(NATIONS, COMPLEX, VECTORS, """ select 'graded' as kind, q::bigint as at, vector as name, round(value, 6) as value from vec
        union all select 'vertex', vertex, 'dimensionality', count(*)::double from inc group by vertex union all select 'order', 0, 'order', (max(len(m)) - 1)::double from k"""),
    "graph_components": with_(NATIONS, COMPLEX, CONNECTED, " select comp.q::int as q, array_to_string(list_sort(list(distinct vertex)), ' ') as vertices from comp join inc on inc.sid = comp.sid group by comp.q, component"),
    "graph_components_capped": with_(NATIONS, COMPLEX, CONNECTED, """, low as (select comp.q::int as q, array_to_string(list_sort(list(distinct vertex)), ' ') as vertices from comp join inc on inc.sid = comp.sid where comp.q < 2 group by comp.q, component)
        select * from low union all select 2, array_to_string(m, ' ') from cl where len(m) = 3"""),
    "projection": with_(NATIONS, COMPLEX, ", inc as (select sid, unnest(m) as vertex from k where len(m) > 2) select distinct a.vertex as u, b.vertex as v, 1::bigint as value from inc a join inc b on a.sid = b.sid and a.vertex < b.vertex"),
    "projection_weighted": with_(NATIONS, COMPLEX, ", inc as (select sid, unnest(m) as vertex from k where len(m) > 2) select a.vertex as u, b.vertex as v, count(*) as value from inc a join inc b on a.sid = b.sid and a.vertex < b.vertex group by all"),
    "clique_filter": with_(NATIONS, COMPLEX, ", inc as (select sid, unnest(m) as vertex from k where len(m) > 4), pj as (select distinct a.vertex as u, b.vertex as v from inc a join inc b on a.sid = b.sid and a.vertex < b.vertex) select ge.u, ge.v, ge.n from ge join pj on ge.u = pj.u and ge.v = pj.v"),
    "edge_cleaning": "select least(l_suppkey, l_partkey)::bigint as u, greatest(l_suppkey, l_partkey)::bigint as v, min(l_extendedprice)::double as w from lineitem where l_suppkey <> l_partkey and isfinite(l_extendedprice) group by 1, 2",
    "persistence": persistence(REGIONS, 4),
    "persistence_capped": persistence(NATION_STEPS, 1),
    "persistence_q0": persistence(NATION_STEPS, 0),
    "persistence_matrix": persistence(LABELS, 2),
    "persistence_quantised": persistence(REGIONS + ", e0 as (select 1)", 4).replace("-sum(n)::double as w", "round(-sum(n)::double, -2) as w"),
    "diagram_sizes": f"select q, size, count(*) as value from ({persistence(REGIONS, 4)}) group by q, size",
    "consensus": with_(YEARLY, " select grp, u, v from agreed"),
    "consensus_vectors": with_(CONSENSUS, COMPLEX, VECTORS, " select g as grp, q::int as q, vector, round(value, 6) as value from vec"),
    "consensus_difference": with_(CONSENSUS, COMPLEX, VECTORS, """, top as (select max(q) as o from vec), sc2 as (select unnest(range(0, o + 1)) as q from top), nm as (select distinct vector from vec),
        a as (select * from vec where g = 'kept'), b as (select * from vec where g = 'returned')
        select sc2.q::int as q, nm.vector, round(coalesce(a.value - b.value, 0), 6) as value from sc2 cross join nm left join a on a.q = sc2.q and a.vector = nm.vector left join b on b.q = sc2.q and b.vector = nm.vector"""),
    "padded_vectors": with_(SAMPLES, COMPLEX, VECTORS, """, top as (select max(q) as o from vec), sc2 as (select unnest(range(0, o + 1)) as q from top), nm as (select distinct g, vector from vec)
        select nm.g, sc2.q::int as q, nm.vector, round(value, 6) as value from sc2 cross join nm left join vec on vec.g = nm.g and vec.q = sc2.q and vec.vector = nm.vector"""),
    "long_to_wide": with_(NATIONS, COMPLEX, VECTORS, " select q::int as q, " + ", ".join(f"round(max(case when vector = '{n}' then value end), 6) as {n}" for n in ("fsv", "ssv", "tsv", "entropy", "simplices", "faces")) + " from vec group by q"),
    "median_panel": with_(SAMPLES, COMPLEX, VECTORS, " select split_part(g, ' ', 1) as grp, q::int as q, vector, round(median(value), 6) as value from vec group by all"),
    "permutation_test": with_(PERMUTED, COMPLEX, VECTORS, """, top as (select max(q) as o from vec), nm as (select distinct vector from vec), sc2 as (select unnest(range(0, o + 1)) as q from top),
        st as (select a.r, sc2.q, nm.vector, coalesce(x.value - y.value, 0) as value
               from (select r, g from tm join ti on ti.own = tm.own where grp = 'kept') a join (select r, g from tm join ti on ti.own = tm.own where grp = 'returned') b on a.r = b.r cross join sc2 cross join nm
               left join vec x on x.g = a.g and x.q = sc2.q and x.vector = nm.vector left join vec y on y.g = b.g and y.q = sc2.q and y.vector = nm.vector)
        select o.q::int as q, o.vector, round(o.value, 6) as value,
               round(least(1.0::double, 2.0::double * (least(count(*) filter (st.value >= o.value - 1e-9), count(*) filter (st.value <= o.value + 1e-9)) + 1) / 10001), 9) as p_value
        from st o join st on st.q = o.q and st.vector = o.vector and st.r > 0 where o.r = 0 group by o.q, o.vector, o.value"""),
    "suppliers_fsv": with_(WIDEST, " select q::int as q, count(distinct component)::bigint as value from comp group by q"),
    "suppliers_tsv": with_(WIDEST, " select q::int as q, round(1 - count(distinct component) / count(*), 6) as value from comp group by q"),
    "suppliers_components": with_(WIDEST, " select q::int as q, sid, component from comp"),
    "suppliers_components_at": with_(WIDEST, " select sid, component from comp where q = 2"),
    "adjacency": with_(NATIONS, COMPLEX, " select sid, array_to_string(m, ' ') as members from k"),
    "edge_rows": persistence(NATION_STEPS, 1),
    "edge_pairs": "select distinct least(l_suppkey, l_partkey)::bigint as u, greatest(l_suppkey, l_partkey)::bigint as v from lineitem where l_suppkey <> l_partkey",
    "coauthors": """select year(o_orderdate)::int as year, row_number() over (order by o_orderkey) - 1 as sid, coalesce(vs, '') as vertices
        from orders left join (select l_orderkey, string_agg(l_suppkey::varchar, ' ' order by l_linenumber, l_suppkey) as vs from lineitem group by l_orderkey) on l_orderkey = o_orderkey""",
    "scale_free": "select x::bigint as complex_id, 60::bigint as vertices, (3 * 57)::bigint as edges, 3::bigint as least, 3::bigint as most from range(20) r(x)",
    "degree_graph": with_(NATIONS, " select vertex, count(*) as degree from (select u as vertex from ge union all select v from ge) group by vertex"),
    "components_at": with_(NATIONS, COMPLEX, CONNECTED, " select sid, component from comp where q = 2"),
    "graded_named": with_(NATIONS, COMPLEX, VECTORS, " select q::int as q, vector, round(value, 6) as value from vec where vector in ('ssv', 'entropy', 'fsv')"),
    "vectors_at": with_(NATIONS, COMPLEX, VECTORS, " select q::int as q, vector, round(value, 6) as value from vec where q = 1"),
    "vector_named": with_(NATIONS, COMPLEX, VECTORS, " select q::int as q, vector, round(value, 6) as value from vec where vector = 'entropy'"),
    "eccentricity_of": with_(NATIONS, COMPLEX, """ select round(min(1 - len(list_intersect(a.m, b.m)) / len(a.m)), 6) as value from k a join k b on b.sid <> 0 where a.sid = 0
        union all select round(min(1 - len(list_intersect([0, 1, 2], m)) / 3), 6) from k"""),
    "absorbed": with_(YEARLY, STARS, """ select g as complex_id, sid, array_to_string(m, ' ') as members from k
        where not exists (select 1 from k b where b.g = k.g and b.sid <> k.sid and len(list_intersect(k.m, b.m)) = len(k.m) and (len(b.m) > len(k.m) or b.sid < k.sid))"""),
    "union_of_rows": with_(YEARLY, STARS, " select g as complex_id, array_to_string(list_sort(list_distinct(flatten(list(m)))), ' ') as members from k group by g"),
    "persistence_suppliers": persistence(SUPPLIERS, 12),
    "persistence_ranges": persistence(SUPPLIERS, 12),
    "diagram_access": f"select row_number() over (order by q, birth, death, list_transform(string_split(members, ' '), lambda x: x::bigint)) - 1 as i, * from ({persistence(NATION_STEPS, 1)})",
    "diagram_offsets": f"select row_number() over o - 1 as i, q, birth, death, (sum(size) over o - size)::bigint as first, (sum(size) over o)::bigint as last from ({persistence(NATION_STEPS, 1)}) window o as ({DIAGRAM_ORDER})",
    "diagram_members": f"""with d as (select members, sum(size) over ({DIAGRAM_ORDER}) - size as first from ({persistence(NATION_STEPS, 1)})),
        x as (select first, unnest(range(len(string_split(members, ' ')))) as k, unnest(string_split(members, ' ')::bigint[]) as vertex from d)
        select (first + k)::bigint as position, vertex from x""",
    "projection_rows": with_(NATIONS, COMPLEX, """, inc as (select sid, unnest(m) as vertex from k where len(m) > 2), pj as (select a.vertex as i, b.vertex as j, count(*) as value from inc a join inc b on a.sid = b.sid and a.vertex <> b.vertex group by all),
        n as (select unnest(range(0, max(list_max(m)) + 1)) as x from k)
        select a.x as i, string_agg(coalesce(value, 0)::varchar, ' ' order by b.x) as row from n a cross join n b left join pj on pj.i = a.x and pj.j = b.x group by a.x"""),
    "component_labels": with_(NATIONS, COMPLEX, CONNECTED, " select sid, component from comp where q = 1"),
    "graded_transformer": with_(SAMPLES, COMPLEX, VECTORS, """, sc2 as (select unnest(range(0, 7)) as q), nm as (select distinct g, vector from vec where vector in ('fsv', 'ssv', 'entropy'))
        select nm.g as complex_id, sc2.q::int as q, nm.vector, round(coalesce(value, -1), 6) as value from sc2 cross join nm left join vec on vec.g = nm.g and vec.q = sc2.q and vec.vector = nm.vector"""),
    "graded_fitted": with_(SAMPLES, COMPLEX, VECTORS, """, sc2 as (select unnest(range(0, max(q) + 1)) as q from vec), nm as (select distinct g, vector from vec where vector in ('fsv', 'ssv', 'entropy'))
        select nm.g as complex_id, sc2.q::int as q, nm.vector, round(coalesce(value, -1), 6) as value from sc2 cross join nm left join vec on vec.g = nm.g and vec.q = sc2.q and vec.vector = nm.vector"""),
    "occupation_array": with_(NATIONS, COMPLEX, """, n as (select unnest(range(0, max(list_max(m)) + 1)) as vertex from k) select n.vertex, count(k.sid) as value from n left join k on len(m) = 6 and list_contains(m, n.vertex) group by n.vertex"""),
    "set_functions": with_(K_ORDER, """, x as (select sid, m, list_filter(m, lambda x: x in (1, 2, 3)) as few, list_filter(m, lambda x: x not in (1, 2, 3)) as rest from k)
        select sid, array_to_string(rest, ' ') as less, array_to_string(list_sort(list_distinct(list_concat(m, [1, 2, 3]))), ' ') as more, array_to_string(few, ' ') as both,
        array_to_string(list_sort(list_distinct(list_append(m, 0))), ' ') as with_zero, array_to_string(m[2:], ' ') as without_first, (len(few) - 1)::bigint as face, round(len(rest) / len(m), 6) as value,
        (case when len(m) > 1 then len(m) else 0 end)::bigint as n_faces, (len(m) * (len(m) - 1) * (len(m) - 2) // 6)::bigint as n_triples from x"""),
    "vertex_ids": "select l_extendedprice = floor(l_extendedprice) and l_extendedprice between 0 and 4294967295 as is_id, count(*) as n from lineitem group by 1",
}
ORACLES |= {"projection_transformer": ORACLES["projection_weighted"], "filter_transformer": ORACLES["clique_filter"]}
