"""The event and trade graphs as common table expressions for DuckDB, written apart from the DataFrame code."""

from __future__ import annotations

import re

from graphloom.model import CATALOG, DAYLIGHT, NOISE, ROOM_TYPES, ZONES
from graphloom.sources.fixtures import ROLES


def _spec() -> str:
    rows = []
    for event, (room, density, exits) in ROLES.items():
        zone, a0, a1, _, _, day, noise, tol, *_ = CATALOG[room]
        rows.append(f"('{event}', '{room}', {ROOM_TYPES.index(room)}, '{zone}', {ZONES.index(zone)}, {a0}::double, {a1}::double, {DAYLIGHT[day]}, {NOISE[noise]}, {NOISE[tol]}, {density}::double, {exits})")
    return "(values " + ", ".join(rows) + ") as t(event_type, room_type, type_idx, zone, zone_idx, area_min, area_max, daylight, noise, tolerance, density, exits)"


def u(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint / 4294967296.0::double)"


DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"

#: name: (SQL, the names it uses)
CTES: dict[str, str] = {
    "spec": f"select * from {_spec()}",
    "raw": "select e.user_id as graph_id, e.event_id as room_id, row_number() over (partition by user_id order by ts, event_id) as ord, s.*, e.value as area, date_diff('second', timestamp '2024-01-01 00:00:00', ts) / 86400.0::double as x, e.value as y from events e join spec s using (event_type)",
    "nodes": "select *, least(2, greatest(0, floor(x / 10)))::int as floor, greatest(1, floor(area / density))::int as occupancy, case when floor(x / 10) < 1 then 'ground' when floor(x / 10) < 2 then 'teaching' else 'top' end as typical_floor from raw",
    "graphs": "select distinct graph_id from nodes",
    "env": "select graph_id, -1::bigint as env_id, 15.0::double as x, 500.0::double as y from graphs",
    "hall": "select * from nodes where room_type = 'corridor'",
    "p1c": f"select a.graph_id, a.room_id as src, b.room_id as dst, {DIST} as dist, b.ord as bo, a.occupancy, a.floor = b.floor as shared, bool_or(a.floor = b.floor) over (partition by a.graph_id, a.room_id) as any_shared from nodes a join hall b on a.graph_id = b.graph_id where a.room_type <> 'corridor'",
    "p1": "select graph_id, src, dst, dist from (select *, row_number() over (partition by graph_id, src order by dist, bo) as k from p1c where shared or not any_shared) where k <= case when occupancy >= 50 then 2 else 1 end",
    "p2w": "select graph_id, room_id as src, lead(room_id) over w as dst, x as ax, y as ay, lead(x) over w as bx, lead(y) over w as by_ from hall window w as (partition by graph_id, floor order by x, ord)",
    "p2": "select graph_id, src, dst, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) as dist from p2w where dst is not null",
    "same": f"select a.graph_id, a.room_id as src, a.room_type as src_type, a.daylight, b.room_id as dst, {DIST} as dist, row_number() over (partition by a.graph_id, a.room_id order by {DIST}, b.ord) as k from nodes a join hall b on a.graph_id = b.graph_id and a.floor = b.floor and a.room_type <> 'corridor'",
    "p7": "select graph_id, src, dst, dist from same where k = 1 and src_type = 'toilet'",
    "near": f"select a.graph_id, a.room_id as src, b.room_id as dst, a.room_type as ta, b.room_type as tb, a.noise - b.tolerance as gab, b.noise - a.tolerance as gba, {DIST} as dist from nodes a join nodes b on a.graph_id = b.graph_id and a.ord < b.ord and a.floor = b.floor where {DIST} <= 15",
    "a1": "select graph_id, src, dst, case when (ta = 'music_room' and tb = 'classroom') or (tb = 'music_room' and ta = 'classroom') then 55.0 else 45.0 end::double as db from near where gab >= 2 or gba >= 2",
    "s1": f"select graph_id, src, dst, dist, case when dist < 1e-9 then 0.0 else (by_ - ay) / dist end as orientation from (select a.graph_id, a.room_id as src, b.env_id as dst, {DIST} as dist, a.y as ay, b.y as by_ from nodes a join env b on a.graph_id = b.graph_id where a.daylight >= 3)",
    "s2": f"select graph_id, src, dst, dist, case when daylight >= 3 then 0.4 else 0.5 end::double as transparency from same where k = 1 and daylight >= 2 and (daylight < 3 or {u('42', 'graph_id', 'src', chr(39) + 'sight' + chr(39))} < 0.6)",
    "phys": "select graph_id, src, dst, dist, 'P1' as rule from p1 union all select graph_id, src, dst, dist, 'P2' from p2 union all select graph_id, src, dst, dist, 'P7' from p7",
    "edges": "select graph_id, 'physical' as rel, 'room' as dst_kind, src, dst, rule from phys union all select graph_id, 'acoustic', 'room', src, dst, 'A1' from a1 union all select graph_id, 'sight', 'environment', src, dst, 'S1' from s1 union all select graph_id, 'sight', 'room', src, dst, 'S2' from s2",
    "door": "select graph_id, src as node, dst as nbr from phys where src <> dst union select graph_id, dst, src from phys where src <> dst",
    "pair": "select graph_id, least(src, dst) as a, greatest(src, dst) as b, max(case when rel = 'physical' then 1 when rel = 'acoustic' then 2 when dst_kind = 'room' then 3 else 4 end) as p from edges where src <> dst group by all",
    "simple": "select graph_id, a, b, case p when 1 then 'physical' when 2 then 'acoustic' else 'sight' end as etype from pair",
    "links": "select graph_id, a as node, b as nbr from simple union all select graph_id, b, a from simple",
    "pdoor": "select graph_id, a as node, b as nbr from simple where etype = 'physical' union all select graph_id, b, a from simple where etype = 'physical'",
    "ddeg": "select graph_id, node as room_id, count(*) as degree from door group by all",
    "mdeg": "select graph_id, room_id, count(*) as d from (select graph_id, src as room_id from phys union all select graph_id, dst from phys) group by all",
    "tri": "select a.graph_id, a.node as x, a.nbr as y, b.nbr as z from door a join door b on a.graph_id = b.graph_id and a.nbr = b.node and a.node < a.nbr and b.node < b.nbr join door c on c.graph_id = a.graph_id and c.node = a.node and c.nbr = b.nbr",
}
USES = {
    "raw": ["spec"], "nodes": ["raw"], "graphs": ["nodes"], "env": ["graphs"], "hall": ["nodes"], "p1c": ["nodes", "hall"], "p1": ["p1c"], "p2w": ["hall"], "p2": ["p2w"], "same": ["nodes", "hall"],
    "p7": ["same"], "near": ["nodes"], "a1": ["near"], "s1": ["nodes", "env"], "s2": ["same"], "phys": ["p1", "p2", "p7"], "edges": ["phys", "a1", "s1", "s2"], "door": ["phys"], "pair": ["edges"],
    "simple": ["pair"], "links": ["simple"], "pdoor": ["simple"], "ddeg": ["door"], "mdeg": ["phys"], "tri": ["door"],
}


def _walk(names: list[str], own: dict[str, str]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        for d in USES.get(n, []):
            add(d)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def sql(uses: str, select: str, **own: str) -> str:
    """`select` over the named tables and those of `own`, which may use them in order. r_ names are recursive."""
    parts = [f"{n} as materialized ({CTES[n]})" for n in _walk(uses.split(), own)]
    parts += [f"{n} as ({text})" for n, text in own.items()]
    parts, select = [re.sub(r"\bconstraint\b", '"constraint"', t) for t in parts], re.sub(r"\bconstraint\b", '"constraint"', select)
    return ("with recursive " if any(n.startswith("r_") for n in own) else "with ") + ", ".join(parts) + " " + select


def hops(table: str = "door", p: str = "") -> dict[str, str]:
    """hops(graph_id, a, b, hops): first arrivals of a breadth-first search from every node, a <> b; names end in p."""
    r = f"r_hops{p}"
    return {
        f"{r}(graph_id, a, b, d) using key (graph_id, a, b)": f"select distinct graph_id, node, node, 0 from {table} union select r.graph_id, r.a, t.nbr, r.d + 1 from {r} r join {table} t on t.graph_id = r.graph_id and t.node = r.b"
        f" left join recurring.{r} o on o.graph_id = r.graph_id and o.a = r.a and o.b = t.nbr where o.d is null",
        f"hops{p}": f"select graph_id, a, b, d::bigint as hops from {r} where a <> b",
    }
