"""The registered raster queries in DuckDB's SQL, written apart from the DataFrame code and from the definitions alone."""

from __future__ import annotations

from .catalog import OUT, as_type

SMALL, MIDDLE = (24, 16, 16), (40, 32, 32)
BREAKS = ["-inf", "0.001", "0.00325", "0.0065", "0.0125", "0.025", "0.1", "inf"]


def raw(shape) -> str:
    t, h, w = shape
    return f"""lines as (select floor(date_diff('day', date '1995-01-01', l_shipdate::date) * {t} / 2500)::int as t,
  (l_partkey % {h})::int as h, (l_orderkey % {w})::int as w, l_quantity from lineitem),
occupied as (select t, h, w, floor(min(l_quantity) * min(l_quantity) / 12)::int as raw0, count(*) as n from lines group by all),
rawvox as (select t, h, w, n, case when (t::bigint * 7919 + h * 104729 + w * 1299709) % 97 = 0 then 65535 else raw0 end as raw,
  case when (t * 31 + h * 17 + w * 13 + (t * h * w) % 7) % 10 < 2 then 2 when (t + h + w) % 5 = 0 then 1 else 0 end as quality from occupied)"""


def vox(shape) -> str:
    t, h, w = shape
    return f"""{raw(shape)},
spine as (select a.i::int as t, b.i::int as h, c.i::int as w from range({t}) a(i), range({h}) b(i), range({w}) c(i)),
vox as (select s.t, s.h, s.w, r.raw, r.quality, r.n,
  cast(case when r.quality > 1 then null else nullif(r.raw, 65535) end::double / 10.0::double / 100.0::double as float) as value
  from spine s left join rawvox r using (t, h, w))"""


def inside(shape, e=(6, 6, 6)) -> str:
    return " and ".join(f"{c} >= {m} and {c} < {n - m}" for c, n, m in zip("thw", shape, e, strict=True))


def centers(kind: str, shape=SMALL) -> str:
    return f"centers as (select ((t * {shape[1]} + h) * {shape[2]} + w)::bigint as graph_id, t, h, w, value from vox where {inside(shape)}" + (" and value is null)" if kind == "gaps" else ")")


def quad(a="dt", b="dh", c="dw") -> str:
    x, y, z = f"abs({a})", f"abs({b})", f"abs({c})"
    # the four sign cases of each space axis, spelt out
    case = lambda n, cond, own, others, signs, tests: " ".join(
        f"when {cond} and {s} and {own} {p} {others[0]} and {own} {q} {others[1]} then {n}" for s, (p, q) in zip(signs, tests, strict=True)
    )
    tw = [f"({a} > 0 and {c} > 0)", f"({a} > 0 and {c} <= 0)", f"({a} <= 0 and {c} > 0)", f"({a} <= 0 and {c} <= 0)"]
    th = [f"({a} > 0 and {b} > 0)", f"({a} > 0 and {b} <= 0)", f"({a} <= 0 and {b} > 0)", f"({a} <= 0 and {b} <= 0)"]
    loose = [(">=", ">="), (">=", ">"), (">", ">="), (">", ">")]
    strict = [(">", ">"), (">", ">="), (">=", ">"), (">=", ">=")]
    return f"""case when {a} < 0 and {x} >= {y} and {x} >= {z} then 1 when {a} > 0 and {x} >= {y} and {x} >= {z} then 2
  {case(3, f'{b} < 0', y, (x, z), tw, loose)} {case(4, f'{b} > 0', y, (x, z), tw, strict)}
  {case(5, f'{c} < 0', z, (x, y), th, strict)} {case(6, f'{c} > 0', z, (x, y), th, loose)} else 0 end"""


def reg(a="dt", b="dh", c="dw") -> str:
    return f"""case when abs({a}) >= abs({b}) and abs({a}) >= abs({c}) then case when {a} < 0 then 1 else 0 end
  when abs({b}) >= abs({a}) and abs({b}) >= abs({c}) then case when {b} < 0 then 3 else 2 end else case when {c} < 0 then 5 else 4 end end"""


def cells(r: int, center=False) -> str:
    keep = "" if center else " and not (v.t = c.t and v.h = c.h and v.w = c.w)"
    return f"""near as (select c.graph_id, c.t, c.h, c.w, v.t - c.t as dt, v.h - c.h as dh, v.w - c.w as dw, v.value from centers c join vox v
  on v.t between c.t - {r} and c.t + {r} and v.h between c.h - {r} and c.h + {r} and v.w between c.w - {r} and c.w + {r} and v.value is not null{keep}),
cells as (select *, dt * dt + dh * dh + dw * dw as d2, greatest(abs(dt), abs(dh), abs(dw)) as cheb, {quad()} as quadrant from near)"""


def nodes(ext: int, most: int, n="32", source="cells") -> str:
    """Nodes by growing the cube one step at a time: per radius the counts of every quadrant."""
    quota = f"(({n}) // 6 + case when quadrant <= ({n}) % 6 then 1 else 0 end)"
    return f"""steps as (select r.i::int as radius from range({ext}, {ext + most} + 1) r(i)),
counts as (select graph_id, radius, quadrant, count(*) >= any_value({quota}) as enough from {source} join steps on cheb <= radius where quadrant > 0 group by 1, 2, 3),
grown as (select graph_id, min(radius) as radius from (select graph_id, radius from counts group by 1, 2 having count(*) = 6 and bool_and(enough)) group by 1),
ranked as (select c.*, g.radius, {quota} as quota, row_number() over (partition by c.graph_id, quadrant order by d2, dt, dh, dw) as k
  from {source} c join grown g on c.graph_id = g.graph_id and c.cheb <= g.radius where quadrant > 0),
nodes as (select graph_id, (k - 1) * 6 + quadrant as idx, dt, dh, dw, d2, quadrant, radius, value from ranked where k <= quota
  and t >= radius and t + radius < 24 and h >= radius and h + radius < 16 and w >= radius and w + radius < 16)"""


#: The line from a node to the centre: step k of n moves an axis by (2 |a| k + n) div 2 n.
PATHS = """paths as (select graph_id, idx, step, dt - sign(dt)::int * ((2 * abs(dt) * step + cheb) // (2 * cheb))::int as pt,
  dh - sign(dh)::int * ((2 * abs(dh) * step + cheb) // (2 * cheb))::int as ph, dw - sign(dw)::int * ((2 * abs(dw) * step + cheb) // (2 * cheb))::int as pw
  from (select *, greatest(abs(dt), abs(dh), abs(dw)) as cheb, unnest(range(1, greatest(abs(dt), abs(dh), abs(dw)))) as step from nodes))"""
EDGE_A = PATHS + """,
hits as (select p.graph_id, p.idx, arg_min(n.idx, step) as dst from paths p join nodes n on n.graph_id = p.graph_id and n.dt = pt and n.dh = ph and n.dw = pw and n.idx < p.idx group by 1, 2),
full_nodes as (select graph_id, idx, dt, dh, dw, d2 from nodes union all select distinct graph_id, 0, 0, 0, 0, 0 from nodes),
edge_a as (select n.graph_id, n.idx as src, m.idx as dst, n.dt - m.dt as et, n.dh - m.dh as eh, n.dw - m.dw as ew from nodes n left join hits h on h.graph_id = n.graph_id and h.idx = n.idx
  join full_nodes m on m.graph_id = n.graph_id and m.idx = coalesce(h.dst, 0))"""
EDGE_B = """edge_b as (select a.graph_id, a.idx as src, b.idx as dst, a.dt - b.dt as et, a.dh - b.dh as eh, a.dw - b.dw as ew from full_nodes a join full_nodes b on a.graph_id = b.graph_id and b.idx < a.idx and a.d2 > b.d2
  where ((a.dt = b.dt and (a.dh <> b.dh or a.dw <> b.dw)) or (a.dt <> b.dt and (a.dh = b.dh or a.dw = b.dw)))
  and not exists (select 1 from edge_a e where e.graph_id = a.graph_id and e.src = a.idx and e.dst = b.idx))"""
EDGES = EDGE_A + ",\n" + EDGE_B + """,
edges as (select *, 'A' as kind, 0 as turn from edge_a union all select *, 'B', case when et = 0 then 1 else 2 end from edge_b union all select graph_id, idx, idx, 0, 0, 0, 'C', 3 from nodes)"""
SUMS = """summary as (select graph_id, n + 1 as n_nodes, e as n_edges from (select graph_id, count(*) as n from nodes group by 1) join (select graph_id, count(*) as e from edges group by 1) using (graph_id))"""
#: 60 bits of the md5 over a seed and keys; its top six bits are the range that is ranked apart.
DRAW = "('0x' || substr(md5({}), 1, 15))::bigint"


def sample(rows: str, size: int, seed: int, replace: bool) -> str:
    key = DRAW.format(f"'{seed},' || t || ',' || h || ',' || w")
    body = f"""drawn as (select class, t, h, w, row_number() over (partition by class order by {key}, t, h, w) as ordinal, count(*) over (partition by class) as population from ({rows})),
sampled as (select class, ordinal as sample_id, t, h, w from drawn where ordinal <= {size} and (population >= {size} or not {replace})"""
    if replace:
        slot = DRAW.format(f"'{seed},' || class || ',' || slot")
        body += f"""
  union all select s.class, slot, t, h, w from (select distinct class, population, unnest(range(1, {size + 1})) as slot from drawn where population < {size}) s
  join drawn d on d.class = s.class and d.ordinal = {slot.replace('class', 's.class')} % s.population + 1"""
    return body + ")"


def klass(low=">") -> str:
    parts = []
    for n, (a, b) in enumerate(zip(BREAKS, BREAKS[1:], strict=False), 1):
        parts.append(f"when value {'>' if a == '-inf' else low} '{a}'::float and value < '{b}'::float then {n}")
    return "case when value is null then null " + " ".join(parts) + " else 0 end"


GRAPH_ALL = f"{vox(SMALL)}, {centers('all')}, {cells(6)}, {nodes(3, 3)}"
GRAPH_WIDE = f"{vox(SMALL)}, {centers('all')}, {cells(6)}, {nodes(2, 4)}"
GRAPH_GAPS = f"{vox(SMALL)}, {centers('gaps')}, {cells(6)}, {nodes(3, 3)}"
PIXELS = f"{vox(SMALL)}, pixels as (select h, w, count(value) as n, avg(value::double) as mean, stddev_pop(value::double) as deviation from vox group by 1, 2)"
DENSITY = "rho as (select a.h, a.w, count_if(b.n > 0) / count(*)::double as rho from pixels a join pixels b on b.h between a.h - 5 and a.h + 5 and b.w between a.w - 5 and a.w + 5 group by 1, 2)"
CONTINUITY = """cont as (select a.h, a.w, case count(b.mean) when 0 then 0.0 when 1 then 1.0 else exp(-10 * var_pop(b.mean)) end::double as s from pixels a
  left join (select * from pixels where n > 0) b on b.h between a.h - 5 and a.h + 5 and b.w between a.w - 5 and a.w + 5 group by 1, 2)"""
STABILITY = "stab as (select h, w, case n when 0 then 0.0 when 1 then 1.0 else 1 / (1 + case when abs(mean) > 1e-8 then deviation / abs(mean) else 1.0 end) end::double as tstab from pixels)"
QUALITY = f"{PIXELS}, {DENSITY}, {CONTINUITY}, {STABILITY}, qual as (select h, w, pow(rho, 0.5) * pow(s, 0.3) * pow(tstab, 0.2) as q from rho join cont using (h, w) join stab using (h, w))"
COUNTED = """raw_n as (select c.*, round_even(30 * (0.5 + greatest(0, least(1, q))), 0)::int as n0 from centers c join qual using (h, w)),
counted as (select graph_id, t, h, w, case when n1 + n1 % 2 > 54 then n1 + n1 % 2 - 2 else n1 + n1 % 2 end as n from (select *, greatest(18, least(54, n0)) as n1 from raw_n))"""
HET = f"""{vox(SMALL)}, {centers('all')}, {cells(3, True)},
means as (select graph_id, dh, dw, avg(value::double) as m from near group by all),
het as (select c.graph_id, coalesce(p, 0) as pixels, case when p >= 8 and mean >= 1e-6 then dev / mean else -1.0 end::double as het from centers c
  left join (select graph_id, count(*) as p, avg(m) as mean, stddev_pop(m) as dev from means group by 1) using (graph_id)),
weights as (select *, case when het < 0 then 0.5 when (het - 0.25) * 10 > 20 then 1.0 when (het - 0.25) * 10 < -20 then 0.0 else 1 / (1 + exp(-(het - 0.25) * 10)) end::double as w_spatial from het)"""
DYN_MAIN = f"""{GRAPH_GAPS}, {PATHS},
turned as (select p.*, g.cheb - p.step as turn, c.graph_id is not null as held from paths p join (select graph_id, idx, greatest(abs(dt), abs(dh), abs(dw)) as cheb from nodes) g using (graph_id, idx)
  left join cells c on c.graph_id = p.graph_id and c.dt = pt and c.dh = ph and c.dw = pw),
opened as (select *, bool_and(held) over (partition by graph_id, idx order by turn) as open from turned),
hits as (select o.graph_id, o.idx, arg_min(n.idx, turn) as dst from opened o join nodes n on n.graph_id = o.graph_id and n.dt = pt and n.dh = ph and n.dw = pw and n.idx <> o.idx where open group by 1, 2),
full_nodes as (select graph_id, idx, dt, dh, dw, d2 from nodes union all select distinct graph_id, 0, 0, 0, 0, 0 from nodes),
mains as (select n.graph_id, n.idx as src, m.idx as dst, n.dt - m.dt as et, 0.75 * (n.dh - m.dh) as eh, 0.75 * (n.dw - m.dw) as ew from nodes n left join hits h on h.graph_id = n.graph_id and h.idx = n.idx
  join full_nodes m on m.graph_id = n.graph_id and m.idx = coalesce(h.dst, 0))"""
POOL = f"""{vox(SMALL)}, {centers('gaps')}, near0 as (select 1), {cells(6)},
located as (select *, {reg()} as region from cells),
csteps as (select r.i::int as radius from range(3, 7) r(i)),
cgrown as (select graph_id, min(radius) as radius from (select graph_id, radius from (select graph_id, radius, region, count(*) as n from located join csteps on cheb <= radius group by 1, 2, 3)
  group by 1, 2 having count(*) = 6 and min(n) >= __LEAST__) group by 1),
pooled as (select l.*, g.radius, row_number() over (partition by l.graph_id, region order by d2, dt, dh, dw) > (case when region < __LOOSE__ then __CAP__ + 2 else __CAP__ end) as over_cap from located l join cgrown g on g.graph_id = l.graph_id and cheb <= g.radius),
pool as (select * from (select *, row_number() over (partition by graph_id order by over_cap, d2, dt, dh, dw) as rank from pooled) where rank <= __POOL__)"""
POOL64 = POOL.replace("__LEAST__", "11").replace("__LOOSE__", "4").replace("__CAP__", "15").replace("__POOL__", "64")
VECTORS = "vectors as (select (vec_id // 32)::bigint as graph_id, (vec_id % 32)::int as idx, embedding::double[] as v from embeddings)"
NEAR = f"""{VECTORS}, sims as (select a.graph_id, a.idx as i, b.idx as j, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) as similarity
  from vectors a join vectors b using (graph_id)),
knn as (select * from (select *, row_number() over (partition by graph_id, i order by similarity desc, j) as place from sims) where place <= 5)"""
SCORES = f"{VECTORS}, scores as (select graph_id, idx, round(list_sum(v), 9) as score, list_dot_product(v, v) as x from vectors)"
SOFT = "soft as (select *, exp(score - max(score) over (partition by graph_id)) / sum(exp(score)) over (partition by graph_id) * exp(max(score) over (partition by graph_id)) as weight from scores)"
SPLIT = f"parts as (select *, case when row_number() over (order by {DRAW.format('$$42,$$ || o_orderkey')}, o_orderkey) <= floor(count(*) over () * 0.8) then 'train' else 'val' end as part from orders)"
HISTORY = "history as (select (o_orderkey % 40)::int as epoch, (count(*) % 9 + 1)::double as val_loss from orders group by 1)"

DYN_NEAR = """select a.graph_id, a.idx as src, b.idx as dst, 0.75 * (b.dt - a.dt) as et, 0.75 * (b.dh - a.dh) as eh, 0.75 * (b.dw - a.dw) as ew
  from nodes a join full_nodes b on a.graph_id = b.graph_id and abs(a.dt - b.dt) + abs(a.dh - b.dh) + abs(a.dw - b.dw) = 1
  where not exists (select 1 from mains m where m.graph_id = a.graph_id and m.src = a.idx and m.dst = b.idx)"""
DYN_ALL = f"""{DYN_MAIN}, nears as ({DYN_NEAR}),
every as (select graph_id, src, dst, et, eh, ew, 'main' as kind from mains union all select *, 'near' from nears),
placed as (select *, row_number() over (partition by graph_id order by src, kind, abs(et), et desc, dst) as ordinal from every),
capped as (select p.* from placed p join (select graph_id, 4 * (count(*) + 1) as most from nodes group by 1) using (graph_id) where ordinal <= most)"""


def dense(x: list[str], n_out: int, seed: int) -> list[str]:
    """Each output of a dense transform of the expressions x, with the catalog's fixed weights."""
    shift = [((7 * j + seed) % 5 - 2) / 10 for j in range(n_out)]
    return ["(" + " + ".join([f"({b})::double"] + [f"({((5 * i + 3 * j + seed) % 11 - 5) / 10})::double * {v}" for i, v in enumerate(x)]) + ")" for j, b in enumerate(shift)]


def attended(source: str, to: str, seed: int) -> str:
    """The tables of one layer of two heads and width 4, from x0..x3 of ``source`` to those of ``to``."""
    gelu_free = lambda v: f"case when {v} > 0 then {v} else 0.2 * {v} end"
    x = [f"x{i}" for i in range(4)]
    listed = lambda exprs, name: ", ".join(f"{e} as {name}{j}" for j, e in enumerate(exprs))
    vector = [0.5, -0.3, 0.2, 0.4]
    part = lambda j: f"({vector[j]}) * ({gelu_free(f'(a.l{j} + b.r{j} + k{j})')})"
    mixed = [f"sum(exp(s{j // 2} - m{j // 2}) * r{j}) / sum(exp(s{j // 2} - m{j // 2})) as h{j}" for j in range(4)]
    mean = "((o0 + o1 + o2 + o3) / 4)"
    normal = [f"((o{j} - {mean}) / sqrt(((o0 - {mean}) ** 2 + (o1 - {mean}) ** 2 + (o2 - {mean}) ** 2 + (o3 - {mean}) ** 2) / 4 + 1e-5) * {a} + ({b}))" for j, (a, b) in enumerate(((1.0, 0.0), (0.9, 0.1), (1.1, -0.1), (1.2, 0.05)))]
    return f"""{to}_sides as (select graph_id, idx, {listed(dense(x, 4, seed), "l")}, {listed(dense(x, 4, seed + 1), "r")} from {source}),
{to}_moved as (select graph_id, src, dst, {listed(dense(["e0", "e1", "e2"], 4, seed + 2), "k")} from links),
{to}_scored as (select e.graph_id, e.dst, b.*, {part(0)} + {part(1)} as s0, {part(2)} + {part(3)} as s1 from {to}_moved e
  join {to}_sides a on a.graph_id = e.graph_id and a.idx = e.dst join (select graph_id as g, idx as i, r0, r1, r2, r3 from {to}_sides) b on b.g = e.graph_id and b.i = e.src),
{to}_best as (select *, max(s0) over (partition by graph_id, dst) as m0, max(s1) over (partition by graph_id, dst) as m1 from {to}_scored),
{to}_heard as (select graph_id, dst as idx, {", ".join(mixed)} from {to}_best group by 1, 2),
{to}_sum as (select graph_id, idx, {", ".join(f"h{j} + x{j} as o{j}" for j in range(4))} from {to}_heard join {source} using (graph_id, idx)),
{to} as (select graph_id, idx, {", ".join(f"case when {n} > 0 then {n} else exp({n}) - 1 end as x{j}" for j, n in enumerate(normal))} from {to}_sum)"""


def gelu(v: str) -> str:
    return f"(0.5 * ({v}) * (1 + (exp(2 * 0.7978845608028654 * (({v}) + 0.044715 * ({v}) ** 3)) - 1) / (exp(2 * 0.7978845608028654 * (({v}) + 0.044715 * ({v}) ** 3)) + 1)))"


MODEL = f"""{GRAPH_GAPS}, {EDGES},
inputs as (select graph_id, idx, value::double as x0, dt / 8.0::double as x1, dh / 8.0::double as x2, dw / 8.0::double as x3 from nodes union all select distinct graph_id, 0, -1.0, 0, 0, 0 from nodes),
links as (select graph_id, src, dst, -et / 8.0::double as e0, -eh / 8.0::double as e1, -ew / 8.0::double as e2 from edges union all select distinct graph_id, 0, 0, 0, 0, 0 from nodes),
{attended("inputs", "one", 1)}"""
SCORED = f"""{POOL64}, fars as (select *, greatest(1.0::double, max(greatest(abs(dt), abs(dh), abs(dw))) over (partition by graph_id)) as far from pool),
inner_ as (select *, {", ".join(f"{gelu(v)} as i{j}" for j, v in enumerate(dense(["(dt / far)", "(dh / far)", "(dw / far)"], 2, 2)))} from fars),
coded as (select *, {", ".join(f"{v} as c{j}" for j, v in enumerate(dense(["i0", "i1"], 4, 3)))} from inner_),
gated as (select *, {", ".join(f"c{j} / (1 + exp(-{v})) as g{j}" for j, v in enumerate(dense(["c0", "c1", "c2", "c3", "dt", "dh", "dw", "value::double"], 4, 4)))} from coded)"""

def named(exprs: list[str], name: str) -> str:
    return ", ".join(f"{e} as {name}{j}" for j, e in enumerate(exprs))


def every(name: str, n: int, of: str = "") -> list[str]:
    return [f"{of}{name}{j}" for j in range(n)]


def softened(table: str, to: str, normal: bool) -> str:
    """One layer of the structure model from h-less x0..x3 of a table to those of another."""
    plain = [v.replace(v[1 : v.index(" + ")], "0.0") for v in dense(every("x", 4), 4, 8)]
    leaky = lambda v: f"case when {v} > 0 then {v} else 0.2 * {v} end"
    mixed = ", ".join(f"sum(exp(s{j // 2} - m{j // 2}) * h{j}) / sum(exp(s{j // 2} - m{j // 2})) + any_value(x{j}) as o{j}" for j in range(4))
    mean = "((o0 + o1 + o2 + o3) / 4)"
    spread = f"sqrt(((o0 - {mean}) ** 2 + (o1 - {mean}) ** 2 + (o2 - {mean}) ** 2 + (o3 - {mean}) ** 2) / 4 + 1e-5)"
    out = [f"(o{j} - {mean}) / {spread} * {a} + ({b})" for j, (a, b) in enumerate(((1.0, 0.0), (0.9, 0.1), (1.1, -0.1), (1.2, 0.05)))] if normal else every("o", 4)
    return f"""{to}_h as (select *, {named(plain, "h")} from {table}),
{to}_sides as (select *, 0.5 * h0 - 0.3 * h1 as f0, 0.2 * h2 + 0.4 * h3 as f1, -0.2 * h0 + 0.6 * h1 as g0, 0.3 * h2 + 0.1 * h3 as g1 from {to}_h),
{to}_scored as (select e.graph_id, e.src, {", ".join(f"a.x{j}, b.h{j}" for j in range(4))}, {leaky("(a.f0 + b.g0 + 0.1)")} as s0, {leaky("(a.f1 + b.g1 - 0.1)")} as s1
  from soft e join {to}_sides a on a.graph_id = e.graph_id and a.idx = e.src join {to}_sides b on b.graph_id = e.graph_id and b.idx = e.dst where weight > 0.05),
{to}_best as (select *, max(s0) over (partition by graph_id, src) as m0, max(s1) over (partition by graph_id, src) as m1 from {to}_scored),
{to}_sum as (select graph_id, src as idx, {mixed} from {to}_best group by 1, 2),
{to} as (select graph_id, idx, {named(out, "x")} from {to}_sum)"""


def read_out(table: str) -> str:
    return f"""pooling as (select *, {dense([f"tanh({v})" for v in dense(every("x", 4), 2, 9)], 1, 10)[0]} as score from {table}),
shares as (select *, exp(score - max(score) over (partition by graph_id)) as e from pooling)"""


CHOSEN = f"""{POOL64}, scaled as (select graph_id, rank - 1 as idx, dt / 8.0::double as dt, dh / 8.0::double as dh, dw / 8.0::double as dw, value::double as value from pool),
fars as (select *, greatest(1.0::double, max(greatest(abs(dt), abs(dh), abs(dw))) over (partition by graph_id)) as far from scaled),
inner_ as (select *, {named([gelu(v) for v in dense(["(dt / far)", "(dh / far)", "(dw / far)"], 2, 2)], "i")} from fars),
coded as (select *, {named(dense(every("i", 2), 4, 3), "c")} from inner_),
gated as (select *, {", ".join(f"c{j} / (1 + exp(-{v})) as g{j}" for j, v in enumerate(dense([*every("c", 4), "dt", "dh", "dw", "value"], 4, 4)))} from coded),
weighed as (select graph_id, idx, dt, dh, dw, value, {dense(every("g", 4), 1, 6)[0]} as score from gated),
chosen as (select * exclude (idx), (row_number() over (partition by graph_id order by round(score, 9) desc, idx) - 1)::int as idx from weighed qualify row_number() over (partition by graph_id order by round(score, 9) desc, idx) <= 12)"""
SOFT_EDGES = f"""{CHOSEN}, first_code as (select *, {named([gelu(v) for v in dense(["value"], 4, 1)], "q")} from chosen),
codes as (select *, {named(dense(every("q", 4), 4, 2), "p")} from first_code),
met as (select a.graph_id, a.idx as src, b.idx as dst, {named(every("p", 4, "a."), "a")}, {named(every("p", 4, "b."), "b")}, a.dt - b.dt as mt, a.dh - b.dh as mh, a.dw - b.dw as mw from codes a join codes b using (graph_id)),
likened as (select *, (a0 * b0 + a1 * b1 + a2 * b2 + a3 * b3) / (sqrt(a0 ** 2 + a1 ** 2 + a2 ** 2 + a3 ** 2) * sqrt(b0 ** 2 + b1 ** 2 + b2 ** 2 + b3 ** 2)) as alike from met),
ranked_near as (select *, row_number() over (partition by graph_id, src order by round(alike, 9) desc, dst) as near_place, {named([gelu(v) for v in dense(["mt", "mh", "mw"], 2, 3)], "n")} from likened),
hidden as (select *, {named([gelu(v) for v in dense([*every("a", 4), *every("b", 4), *every("n", 2)], 4, 4)], "k")} from ranked_near),
one_way as (select graph_id, src, dst, case when near_place <= 5 then 1 / (1 + exp(-{dense(every("k", 4), 1, 5)[0]})) * (0.5 + 0.5 * alike) else 0 end + case when src = dst then 1 else 0 end as w from hidden),
soft as (select x.graph_id, x.src, x.dst, (x.w + y.w) / 2 as weight from one_way x join one_way y on x.graph_id = y.graph_id and x.src = y.dst and x.dst = y.src where (x.w + y.w) / 2 > 1e-6)"""
DEEP = f"""{SOFT_EDGES}, start_code as (select *, {named([gelu(v) for v in dense(["value"], 4, 6)], "q")} from chosen),
starts as (select graph_id, idx, {named(dense(every("q", 4), 4, 7), "x")} from start_code),
{softened("starts", "deep1", True)}, {softened("deep1", "deep2", False)}, {read_out("deep2")},
vectors as (select graph_id, {", ".join(f"sum(e * x{j}) / sum(e) as x{j}" for j in range(4))} from shares group by 1)"""
LOSSES = f"""{SOFT_EDGES}, choice as (select graph_id, exp(score - max(score) over (partition by graph_id)) as e from weighed),
choice_share as (select graph_id, e / sum(e) over (partition by graph_id) as w from choice),
entropies as (select graph_id, -sum(w * ln(w + 1e-10)) / nullif(ln(count(*)), 0) as entropy from choice_share group by 1),
edge_sums as (select s.graph_id, sum(abs(weight)) as sparsity, sum(weight * (a.value - b.value) ** 2) as smoothness from soft s join chosen a on a.graph_id = s.graph_id and a.idx = s.src join chosen b on b.graph_id = s.graph_id and b.idx = s.dst group by 1)"""

#: Leaves by a rule apart from the tree's: a box is one if it holds few and every wider box around its centres holds many.
LEAVES = f"""{vox(MIDDLE)}, bare as (select ((t * 32 + h) * 32 + w)::bigint as graph_id, t, h, w from vox where {inside(MIDDLE)} and value is null),
crowd as (select * from bare union all select graph_id + 1000000 * r.i, t, h, w from bare, range(1, 8) r(i) where h < 10 and w < 10 and t < 12),
boxed as (select c.*, s.side, t // s.side * s.side as t0, h // s.side * s.side as h0, w // s.side * s.side as w0 from crowd c, (values (16), (8), (4), (2)) s(side)),
filled as (select *, count(*) over (partition by side, t0, h0, w0) as n from boxed),
placed as (select * from (select *, max(case when n <= 25 then side end) over (partition by graph_id) as wide from filled) where side = coalesce(wide, 2))"""

#: Query -> (common table expressions, final select).
PARTS = {
    "clean_voxels": (vox(SMALL), "select * from vox"),
    "clean_voxels_single": (raw(SMALL), "select t, h, w, cast(cast(case when quality > 1 then null else raw end::float / 10::float as float) / 100::float as float) as value from rawvox"),
    "joined_quality": (f"{raw(SMALL)}, spine as (select a.i::int as t, b.i::int as h, c.i::int as w from range(24) a(i), range(16) b(i), range(16) c(i))", "select t, h, w, q as quality, cast(case when q > 1 then null else nullif(raw, 65535) end::double / 10 / 100 as float) as value from (select s.*, raw, case when quality = 1 then null else quality end as q from spine s left join rawvox using (t, h, w))"),
    "dataset_stats": (vox(SMALL), "select count(*) as cells, count(value) as valid, count(*) - count(value) as missing, count(value) / count(*) as valid_ratio, min(value) as least, max(value) as most, avg(value::double) as mean, median(value::double) as median, quantile_cont(value::double, 0.999) as p999 from vox"),
    "class_histogram": (vox(MIDDLE), f"select {klass()} as class, count(*) as n from vox where value is not null group by 1"),
    "class_histogram_left_closed": (vox(MIDDLE), f"select {klass('>=')} as class, count(*) as n from vox where value is not null group by 1"),
    "calendar_spine": ("frames as (select dayofyear(ts) as doy, (user_id % 3)::int as h, (event_id % 2)::int as w, max(case when user_id % 11 = 0 then 65535 else event_id % 1000 end)::int as raw from events group by 1, 2, 3)",
        "select d.doy - 1 as t, date '2024-01-01' + (d.doy - 1)::int as day, a.i as h, b.i as w, raw, case when raw <> 65535 then raw * 0.1::double end as radiance from range(1, 367) d(doy), range(3) a(i), range(2) b(i) left join frames f on f.doy = d.doy and f.h = a.i and f.w = b.i"),
    "effective_regions": ("", f"select 'margins' as kind, {(40 - 12) * (32 - 12) * (32 - 12)} as n union all select 'buffers', {(40 - 20) * (32 - 24) * (32 - 24)}"),
    "missing_positions": (vox(MIDDLE), f"select * from vox where {inside(MIDDLE)} and value is null"),
    "valid_positions": (vox(SMALL), f"select * from vox where {inside(SMALL)} and value is not null"),
    "missing_by_day": (vox(MIDDLE), f"select t - 6 as day, count_if(value is null) as n from vox where {inside(MIDDLE)} group by 1"),
    "stratified_sample": (f"{vox(MIDDLE)}, {sample(f'select {klass()} as class, t, h, w from vox where {inside(MIDDLE)} and {klass()} > 0', 400, 0, True)}", "select * from sampled"),
    "downsample": (f"{vox(SMALL)}, {sample(f'select {klass(chr(62) + chr(61))} as class, t, h, w from vox where {inside(SMALL)} and value is not null', 15, 3, False)}", "select * from sampled"),
    "train_val_split": (SPLIT, "select * from parts"),
    "benchmark_sample": (vox(MIDDLE), f"select t, h, w from vox where {inside(MIDDLE)} and value is null order by {DRAW.format('$$0,$$ || t || $$,$$ || h || $$,$$ || w')}, t, h, w limit 100"),
    "offset_dim": (f"{vox(SMALL)}, {centers('gaps')}, {cells(6)}", f"select dt, dh, dw, dt * dt + dh * dh + dw * dw as d2, greatest(abs(dt), abs(dh), abs(dw)) as cheb, {quad()} as quadrant, {reg()} as region, count(*) as n from near group by dt, dh, dw"),
    "direction_partition": (f"{vox(SMALL)}, {centers('gaps')}, {cells(6)}", f"select {quad()} as quadrant, {reg()} as region, count(distinct (dt * 100 + dh) * 100 + dw) as offsets, count(*) as n, max(dt * dt + dh * dh + dw * dw) as far from near group by 1, 2"),
    "line_paths": (f"{GRAPH_GAPS}, {PATHS}", "select * from paths"),
    "frame_names": ("names as (select strftime(ts, '%Y') || lpad(dayofyear(ts)::varchar, 3, '0') || '_50KM.tif' as name, count(*) as n from events group by 1)",
        "select name, doy, make_date(y, 1, 1) + (doy - 1)::int as day, dayofyear(make_date(y, 12, 31)) as days, lpad(doy::varchar, 3, '0') as padded, n from (select name, n, substr(name, 1, 4)::int as y, substr(name, 5, 3)::int as doy from names)"),
    "quantised_keys": (vox(SMALL), "select (t // 5) || '_' || (h // 5) || '_' || (w // 5) as key, count(*) as n from vox group by 1"),
    "tile_assign": (vox(MIDDLE), f"select h // 10 as tile_h, w // 10 as tile_w, count(*) as n, min(h) as first_h, max(w) as last_w from vox where {inside(MIDDLE)} and value is null group by 1, 2"),
    "tile_halo": (f"{vox(SMALL)}, tiles as (select a.i as th, b.i as tw from range(3) a(i), range(3) b(i))", "select th as tile_h, tw as tile_w, count(*) as cells, count_if(h // 6 = th and w // 6 = tw) as core, min(h) as low_h, max(h) as high_h, min(w) as low_w, max(w) as high_w from vox join tiles on h between th * 6 - 4 and th * 6 + 9 and w between tw * 6 - 4 and tw * 6 + 9 group by 1, 2"),
    "tile_build_report": (GRAPH_WIDE, "select count(*) as tiles, sum(c) as centers, sum(g) as graphs, sum(g) / sum(c)::double as success from (select h // 2, w // 2, count(*) as c, count(g) as g from centers left join (select distinct graph_id, 1 as g from nodes) using (graph_id) group by 1, 2)"),
    "adaptive_tiles": (LEAVES, "select t0, h0, w0, side, count(*) as n from placed group by 1, 2, 3, 4"),
    "adaptive_tile_halo": (f"{LEAVES}, shares as (select *, (row_number() over (partition by t0, h0, w0, side order by graph_id) - 1) // 25 as share from placed), sized as (select t0, h0, w0, side, share, count(*) as centers from shares group by all)",
        "select t0, h0, w0, side, share, any_value(centers) as centers, count(*) as cells, avg(value::double) as mean from sized join vox on t between t0 - 3 and t0 + side + 2 and h between h0 - 3 and h0 + side + 2 and w between w0 - 3 and w0 + side + 2 and value is not null group by 1, 2, 3, 4, 5"),
    "cube_extract": (f"{vox(SMALL)}, {centers('gaps')}, {cells(3, True)}", "select * from near"),
    "clamped_crop": (f"{vox(SMALL)}, centers as (select ((t * 16 + h) * 16 + w)::bigint as graph_id, t, h, w from vox where value is null ), {cells(5)}", "select graph_id, count(*) as cells, count_if(abs(dh) <= 1) as near from near group by 1"),
    "quadrant_counts": (f"{vox(SMALL)}, {centers('all')}, {cells(6)}", "select graph_id, q as quadrant, count(quadrant) as valid, 5 + (q <= 2)::int as quota, count(quadrant) >= 5 + (q <= 2)::int as enough from centers cross join range(1, 7) r(q) left join cells using (graph_id) where quadrant = q or quadrant is null group by 1, 2"),
    "adaptive_radius": (GRAPH_WIDE, "select * from grown"),
    "select_nodes": (GRAPH_WIDE, "select * from nodes"),
    "edges_occlusion": (f"{GRAPH_ALL}, {EDGE_A}", "select * from edge_a"),
    "edges_aux": (f"{GRAPH_ALL}, {EDGE_A}, {EDGE_B}", "select * from edge_b"),
    "edges_all": (f"{GRAPH_GAPS}, {EDGES}", "select graph_id, row_number() over (partition by graph_id order by src, turn, dst) as ordinal, src, dst, kind, (et / 8.0)::float as et, (eh / 8.0)::float as eh, (ew / 8.0)::float as ew from edges"),
    "graph_summary": (f"{GRAPH_WIDE}, {EDGES}, {SUMS}", "select * from summary"),
    "prediction_graphs_by_day": (f"{GRAPH_GAPS}, {EDGES}, {SUMS}", "select t - 6 as day, 'graph_forPred_' || lpad((t - 6)::varchar, 3, '0') as file, count(*) as graphs, sum(n_edges) as edges from summary join centers using (graph_id) group by 1, 2"),
    "training_graphs_by_class": (f"{vox(SMALL)}, {sample(f'select {klass()} as class, t, h, w from vox where {inside(SMALL)} and {klass()} > 0', 12, 0, True)}, centers as (select class * 1000000000::bigint + sample_id as graph_id, s.*, v.value from sampled s join vox v using (t, h, w)), {cells(6)}, {nodes(3, 3)}, {EDGES}, {SUMS}",
        "select class, count(*) as graphs, sum(n_edges) as edges, avg(value::double) as target from summary join centers using (graph_id) group by 1"),
    "packed_nodes": (GRAPH_ALL, "select graph_id, idx, value as feature, value as truth from nodes union all select graph_id, 0, -1.0, value from centers where graph_id in (select graph_id from nodes)"),
    "graph_targets": (GRAPH_ALL, "select graph_id, value as target from centers where graph_id in (select graph_id from nodes)"),
    "harmonised_graphs": (f"{HET.replace(centers('all'), centers('gaps')).replace('near as', 'hnear as').replace('from near', 'from hnear').replace(cells(3, True).split('cells as')[1], cells(3, True).split('cells as')[1].replace('from near', 'from hnear')).replace('cells as', 'hcells as')}, {cells(6)}, {nodes(3, 3)}, {EDGES}, {SUMS}",
        "select 'plain' as scheme, graph_id, n_nodes, null as het from summary union all select 'weighted', graph_id, n_nodes, het from summary join het using (graph_id)"),
    "integral_image": (PIXELS, "select a.h, a.w, sum(b.n) as total from pixels a join pixels b on b.h <= a.h and b.w <= a.w group by 1, 2"),
    "density": (f"{PIXELS}, {DENSITY}", "select * from rho"),
    "continuity": (f"{PIXELS}, {CONTINUITY}", "select * from cont"),
    "stability": (f"{PIXELS}, {STABILITY}", "select * from stab"),
    "quality_map": (QUALITY, "select * from qual"),
    "adaptive_node_count": (f"{QUALITY}, {centers('all')}, {COUNTED}", "select * from counted"),
    "node_count_histogram": (f"{QUALITY}, {centers('all')}, {COUNTED}", "select n, count(*) as graphs, count(*) / sum(count(*)) over () as share from counted group by 1"),
    "select_nodes_adaptive": (f"{QUALITY}, {centers('gaps')}, {COUNTED}, {cells(6)}, sized as (select c.*, k.n from cells c join counted k using (graph_id)), {nodes(3, 3, 'n', 'sized')}", "select * from nodes"),
    "heterogeneity_index": (HET, "select * from het"),
    "st_weights": (HET, "select *, 1 - w_spatial as w_temporal from weights"),
    "het_tallies": (HET, "select count_if(het > 0.25) as high, count_if(het between 0 and 0.25) as low, count_if(het < 0) as undefined, count(*) as graphs from weights"),
    "het_report": (HET, "select count(*) as graphs, count(h) as defined, " + ", ".join(f"coalesce({f}(h), -1) as het_{n}, coalesce({f}(w_spatial), 0) as w_{n}" for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"), ("median", "median"))) + " from (select *, case when het >= 0 then het end as h from weights)"),
    "dyn_edges_main": (DYN_MAIN, "select * from mains"),
    "dyn_edges_temporal": (f"{GRAPH_GAPS}, full_nodes as (select graph_id, idx, dt, dh, dw from nodes union all select distinct graph_id, 0, 0, 0, 0 from nodes)",
        "select a.graph_id, a.idx as src, b.idx as dst, 0.75 * (b.dt - a.dt) as et, 0 as eh, 0 as ew from nodes a join full_nodes b on a.graph_id = b.graph_id and a.dh = b.dh and a.dw = b.dw and abs(a.dt - b.dt) between 1 and 3"),
    "dyn_edges_neighbor": (DYN_MAIN, DYN_NEAR),
    "mean_graph_size": (f"{GRAPH_WIDE}, {EDGES}, {SUMS}", "select count(*) as graphs, avg(n_nodes) as mean_nodes, avg(n_edges) as mean_edges from summary"),
    "gathered_values": (f"{GRAPH_GAPS}, {EDGES}", "select e.graph_id, row_number() over (partition by e.graph_id order by src, turn, dst) - 1 as ordinal, coalesce(n.value, -1.0) as value from edges e left join nodes n on n.graph_id = e.graph_id and n.idx = e.src"),
    "tiled_edges": (f"{GRAPH_WIDE}, {EDGES}", "select graph_id, row_number() over (partition by graph_id order by src, turn, dst) as ordinal, src, dst, kind from edges"),
    "dynamic_edges": (DYN_ALL, "select * from capped"),
    "dynamic_edge_report": (DYN_ALL, "select kind, count(*) as graphs, sum(n) as edges, avg(n) as mean, max(n) as most from (select graph_id, kind, count(*) as n from capped group by 1, 2) group by 1"),
    "attention_layer": (MODEL, "select graph_id, idx, place, value from (select graph_id, idx, unnest([0, 1, 2, 3]) as place, unnest([x0, x1, x2, x3]) as value from one)"),
    "attention_estimates": (f"{MODEL}, {attended('one', 'two', 4)}", f"select graph_id, {dense([gelu(v) for v in dense(['x0', 'x1', 'x2', 'x3'], 2, 3)], 1, 5)[0]} as estimate from two where idx = 0"),
    "gated_scores": (SCORED, f"select graph_id, rank - 1 as idx, {dense(['g0', 'g1', 'g2', 'g3'], 1, 6)[0]} as score from gated"),
    "soft_edges": (SOFT_EDGES, "select * from soft"),
    "structure_estimates": (DEEP, f"select graph_id, {dense([f'greatest(0, {v})' for v in dense(every('x', 4), 2, 11)], 1, 12)[0]} as estimate from vectors"),
    "structure_losses": (LOSSES, "select graph_id, entropy, sparsity, smoothness, coalesce(entropy, 0) + 0.01 * sparsity + 0.005 * smoothness as loss from entropies join edge_sums using (graph_id)"),
    "readout_vectors": (f"{MODEL}, {read_out('one')}", " union all ".join(f"select graph_id, '{how}' as how, unnest([0, 1, 2, 3]) as place, unnest([{', '.join(f.format(j) for j in range(4))}]) as value from shares group by 1"
        for how, f in (("attention", "sum(e * x{0}) / sum(e)"), ("mean", "avg(x{0})"), ("max", "max(x{0})"), ("sum", "sum(x{0})")))),
    "activations": ("xs as (select vec_id, i as place, embedding[i + 1]::double * 4 as x from (select *, unnest(range(len(embedding))) as i from embeddings))", f"select vec_id, place, case when x > 0 then x else 0.2 * x end as leaky, case when x > 0 then x else exp(x) - 1 end as elu, {gelu('x')} as gelu from xs"),
    "region_counts": (f"{vox(SMALL)}, {centers('gaps')}, {cells(4)}", f"select graph_id, {reg()} as region, count(*) as valid from cells group by 1, 2"),
    "candidate_pool": (POOL64, "select * from pool"),
    "knn_edges": (f"{POOL64}, picked as (select graph_id, rank - 1 as idx, dt, dh, dw from pool where rank <= 36), pairs as (select a.graph_id, a.idx as src, b.idx as dst, a.dt - b.dt as et, a.dh - b.dh as eh, a.dw - b.dw as ew, row_number() over (partition by a.graph_id, a.idx order by (a.dt - b.dt) ** 2 + (a.dh - b.dh) ** 2 + (a.dw - b.dw) ** 2, b.idx) as place from picked a join picked b on a.graph_id = b.graph_id and a.idx <> b.idx)",
        "select graph_id, src, dst, 'knn' as kind, (et / 8.0)::float as et, (eh / 8.0)::float as eh, (ew / 8.0)::float as ew from pairs where src = 0 or place <= 4 union all select graph_id, idx, idx, 'loop', 0, 0, 0 from picked"),
    "padded_candidates": (f"{POOL64}, places as (select graph_id, r.i as place from (select distinct graph_id from pool), range(64) r(i))", "select graph_id, place, rank is not null as held, coalesce(dt, 0) as dt, coalesce(dh, 0) as dh, coalesce(dw, 0) as dw, coalesce(value, 0) as value from places left join (select *, rank - 1 as place from pool) using (graph_id, place)"),
    "cosine_knn": (NEAR, "select * from knn"),
    "softmax_scores": (SCORES.replace("round(list_sum(v), 9) as score", "round(list_sum(v), 9) / 0.5 as score") + f", {SOFT}", "select * from soft"),
    "top_scores": (SCORES, "select * from (select *, row_number() over (partition by graph_id order by score desc, idx) as place from scores) where place <= 5"),
    "selection_entropy": (f"{SCORES}, {SOFT}", "select graph_id, -sum(weight * ln(weight + 1e-10)) / nullif(ln(count(*)), 0) as entropy from soft group by 1"),
    "row_normalize": (NEAR, "select graph_id, i, j, similarity / sum(similarity) over (partition by graph_id, i) as weight from knn where similarity > 0.05"),
    "graph_regularisers": (f"{NEAR}, scores as (select graph_id, idx, list_dot_product(v, v) as x from vectors)", "select k.graph_id, sum(greatest(0, similarity)) as sparsity, sum(greatest(0, similarity) * (a.x - b.x) ** 2) as smoothness from knn k join scores a on a.graph_id = k.graph_id and a.idx = i join scores b on b.graph_id = k.graph_id and b.idx = j group by 1"),
    "readout_pooling": (f"{SCORES}, {SOFT}", "select graph_id, avg(x) as mean, max(x) as most, sum(x) as total, sum(weight * x) / sum(weight) as attended from soft group by 1"),
    "regression_metrics": (f"{SPLIT}, rows as (select part, o_totalprice / 1000 as target, o_totalprice / 1000 + (o_orderkey % 7 - 3) as predicted from parts)", "select part, count(*) as n, avg((target - predicted) ** 2) as mse, avg(abs(target - predicted)) as mae, 1 - sum((target - predicted) ** 2) / (var_pop(target) * count(*)) as r2 from rows group by 1"),
    "best_epoch": (HISTORY, "select epoch, val_loss from history order by val_loss, epoch limit 1"),
    "early_stop": (f"{HISTORY}, bests as (select *, min(val_loss) over (order by epoch rows between unbounded preceding and 1 preceding) as best from history), lasts as (select *, max(case when best is null or val_loss < best then epoch end) over (order by epoch) as last from bests)", "select epoch, val_loss, epoch - last as stale, epoch - last >= 5 as stopped from lasts"),
    "idw_fill": (f"{GRAPH_GAPS}, est as (select graph_id, sum(value::double / d2) / sum(1.0::double / d2) as estimate from nodes group by 1)", "select v.t, v.h, v.w, v.value is null as was_gap, coalesce(v.value::double, estimate) as filled from vox v left join (centers join est using (graph_id)) c on c.t = v.t and c.h = v.h and c.w = v.w"),
    "same_pixel_fill": (vox(MIDDLE), f"select a.t, a.h, a.w, avg(b.value::double) as estimate from (select * from vox where {inside(MIDDLE)} and value is null) a join vox b on a.h = b.h and a.w = b.w and b.t between a.t - 3 and a.t + 3 and b.value is not null group by 1, 2, 3"),
    "gap_neighbours_by_day": (GRAPH_GAPS, "select t - 6 as day, count(distinct graph_id) as gaps, count(*) as neighbours, avg(n.value::double) as mean from nodes n join (select graph_id, t from centers) using (graph_id) group by 1"),
}


def sql(name: str) -> str:
    ctes, final = PARTS[name]
    columns = ", ".join(as_type(n, k) for n, k in OUT[name].items())
    return (f"with {ctes}\n" if ctes else "") + f"select {columns} from ({final}) as result"


SQL = {name: sql(name) for name in PARTS}
