"""SQL for the steps that depend on those before: recursive common table expressions over lists. Cleaning, decoding, short stops, matching, and the
whole diary out of them. All CTEs may use those of the catalogue."""

from __future__ import annotations

from ..functions import geo
from ..params import Params
from .sql_geometry import RHO, THETA, course_sql, metres_sql

P = Params()


def whole_turn(a: str, b: str) -> str:
    return f"(({course_sql(a, b)} + 360) % 360)"


def seen_at(tag: str, at: str) -> str:
    """Columns for the point at a place of list q, as it sees its neighbours there: the last different one before and the first one after."""
    other = f"lambda z: q[z].lat <> q[{at}].lat or q[z].lon <> q[{at}].lon"
    return f"""list_max(list_filter(range(1, {at}), {other})) as j{tag}, list_min(list_filter(range({at} + 1, len(q) + 1), {other})) as k{tag},
      case when j{tag} is null then 0.0::double else {metres_sql(f'q[{at}]', f'q[j{tag}]')} end as da{tag}, case when k{tag} is null then 0.0::double else {metres_sql(f'q[{at}]', f'q[k{tag}]')} end as dp{tag},
      case when da{tag} * dp{tag} = 0 then 180.0::double else abs({whole_turn(f'q[{at}]', f'q[j{tag}]')} - {whole_turn(f'q[{at}]', f'q[k{tag}]')}) end as u{tag},
      case when {at} between 2 and len(q) - 1 then struct_pack(ord := q[{at}].ord, t := q[{at}].t, lat := q[{at}].lat, lon := q[{at}].lon, acc := q[{at}].acc, rep := q[{at}].rep, da := da{tag}, dp := dp{tag}, ang := least(u{tag}, 360 - u{tag}),
        inter := q[{at}].inter or (q[{at} - 1].lat = q[{at}].lat and q[{at} - 1].lon = q[{at}].lon and q[{at} + 1].lat = q[{at}].lat and q[{at} + 1].lon = q[{at}].lon)) else q[{at}] end as new{tag}"""


def listed(test: str) -> str:
    """The numbers of the points that pass, last first."""
    return f"list_reverse(list_transform(list_filter(pts, lambda x: {test}), lambda x: x.ord))"


WHY = "case phase when 1 then 'repeated' when 2 then 'error' when 4 then 'outlier' else 'sequence' end"

#: Cleaning: a round removes one point and looks around the gap, or lists what the next step removes.
CLEANING = {
    "f0": "select user_id, t, ord, lat, lon, acc, row_number() over (partition by user_id, lat, lon, t order by ord) > 1 as rep, row_number() over (partition by user_id order by t, ord) as i from gps",
    "f1": "select *, lag(i) over w as before, lead(i) over w as after, case when lag(lat) over w = lat and lag(lon) over w = lon then 0 else 1 end as fresh from f0 window w as (partition by user_id order by i)",
    "f2": "select *, sum(fresh) over (partition by user_id order by i) as run from f1",
    "f3": "select user_id, run, any_value(lat) as lat, any_value(lon) as lon, count(*) as n from f2 group by all",
    "f4": "select user_id, run, lat, lon, n, lag(struct_pack(lat := lat, lon := lon)) over w as p, lead(struct_pack(lat := lat, lon := lon)) over w as n2 from f3 window w as (partition by user_id order by run)",
    "f5": f"""select f2.*, coalesce({metres_sql('f2', 'f4.p')}, 0.0) as da, coalesce({metres_sql('f2', 'f4.n2')}, 0.0) as dp, case when f4.p is null or f4.n2 is null then 180.0::double else abs({whole_turn('f2', 'f4.p')} - {whole_turn('f2', 'f4.n2')}) end as u,
      before is not null and after is not null as inside, lead(fresh) over (partition by f2.user_id order by i) = 0 and fresh = 0 as mid from f2 join f4 using (user_id, run)""",
    "f6": """select user_id, list(struct_pack(ord := ord, t := t, lat := lat, lon := lon, acc := acc, rep := rep, da := case when inside then da end, dp := case when inside then dp end, ang := case when inside then least(u, 360 - u) end, inter := coalesce(inside and mid, false)) order by i) as pts
      from f5 group by user_id having count(*) > 100""",
    "cleaning": f"""select user_id, 0 as phase, cast([] as bigint[]) as todo, pts, null::bigint as gone, null::varchar as why from f6 union all
      select user_id, case when took then phase else next end, case when took then todo[2:] when next = 1 then {listed('x.rep')} when next = 2 then {listed('x.acc > 100')} when next in (3, 5) then {listed('x.inter')} when next = 4 then [worst] else todo end,
        case when took then list_transform(q, lambda x, i: case when i = pos - 1 then newa when i = pos then newb else x end) else pts end, case when took then todo[1] end, case when took then {WHY} end
      from (select *, {seen_at('a', '(pos - 1)')}, {seen_at('b', 'pos')} from (select *, case when took then pts[:pos - 1] || pts[pos + 1:] else cast([] as struct(ord bigint, t bigint, lat double, lon double, acc double, rep boolean, da double, dp double, ang double, inter boolean)[]) end as q,
          case when phase < 3 then phase + 1 when phase < 5 and worst is not null then 4 when phase < 5 then 5 else 6 end as next from (
        select *, len(todo) > 0 as took, list_position(list_transform(pts, lambda x: x.ord), todo[1]) as pos, list_min(list_filter(range(1, len(pts) + 1), lambda z: pts[z].ang = 0)) as flat,
          case when flat is not null then case when flat > 1 then pts[flat].ord end else pts[list_min(list_filter(range(2, len(pts)), lambda z: pts[z].ang < 15 and least(pts[z].da, pts[z].dp) > 100))].ord end as worst
        from cleaning where phase < 6)))""",
    "removed": "select user_id, gone as ord, why from cleaning where gone is not null",
    "clean": "select g.user_id, g.t, g.ord, g.acc, g.lon, g.lat, r.why from gps g join f6 using (user_id) left join removed r on r.user_id = g.user_id and r.ord = g.ord",
}

MOVE = "case when a = 1 and b = 1 then ln(0.95::double) when a = 1 then ln(0.05::double / len(v)) when b = 1 or a = b then ln(0.5::double) else -100.0::double end"


def viterbi_sql(tag: str, emissions: str) -> dict[str, str]:
    """path{tag} (user_id, seg, n, state) from emissions (user_id, seg, n from 1, e: a list by state). Of equal paths the one through the highest state."""
    states = "range(1, len(v) + 1)"
    return {
        f"forward{tag}": f"""select user_id, seg, n, list_transform(e, lambda x, i: x + case when i = 1 then ln(0.5::double) else ln(0.5::double / len(e)) end) as v, cast([] as bigint[]) as back from {emissions} where n = 1 union all
          select user_id, seg, n, list_transform(best, lambda x, i: x.p + e[i]), list_transform(best, lambda x: x.s) from (
            select e.user_id, e.seg, e.n, e.e, list_transform({states}, lambda b: list_max(list_transform({states}, lambda a: struct_pack(p := v[a] + {MOVE}, s := a)))) as best
            from forward{tag} f join {emissions} e on e.user_id = f.user_id and e.seg = f.seg and e.n = f.n + 1)""",
        f"ends{tag}": f"select user_id, seg, n, list_max(list_transform({states}, lambda a: struct_pack(p := v[a], s := a))).s as s, back from forward{tag} qualify row_number() over (partition by user_id, seg order by n desc) = 1",
        f"walk{tag}": f"select user_id, seg, n, s, back[s] as prev from ends{tag} union all select f.user_id, f.seg, f.n, w.prev, f.back[w.prev] from walk{tag} w join forward{tag} f on f.user_id = w.user_id and f.seg = w.seg and f.n = w.n - 1",
        f"path{tag}": f"select user_id, seg, n, s - 1 as state from walk{tag}",
    }


def collapse_sql(tag: str, source: str) -> dict[str, str]:
    """stays{tag} from episodes (user_id, sequence, start, location_id, unknown, type): the first short stop dissolves until none is left."""
    return {
        f"lists{tag}": f"select user_id, list(start order by sequence) as starts, list(type order by sequence) as types, range(1, count(*) + 1) as live, false as done from {source} group by user_id",
        f"rounds{tag}": f"""select user_id, starts, types, live, done from lists{tag} union all
          select user_id, case when pos > 1 and types[l[pos - 1]] <> types[l[pos + 1]] then list_transform(starts, lambda x, i: case when i = l[pos + 1] then x + (x - starts[l[pos]]) / 2 else x end) else starts end, types,
            case when pos is null then l when pos > 1 and types[l[pos - 1]] = types[l[pos + 1]] then l[:pos - 1] || l[pos + 2:] else l[:pos - 1] || l[pos + 1:] end, pos is null
          from (select *, list_min(list_filter(range(1, len(l)), lambda z: types[l[z]] not in ('unknown', 'travel') and starts[l[z + 1]] - starts[l[z]] < {P.minimum_activity})) as pos from (
            select user_id, starts, types, list_transform(list_sort(list_transform(live, lambda e, i: struct_pack(s := starts[e], i := i, e := e))), lambda x: x.e) as l from rounds{tag} where not done))""",
        f"left{tag}": f"select user_id, starts, unnest(live) as e, unnest(range(len(live))) as sequence from rounds{tag} where done",
        f"stays{tag}": f"""select l.user_id, l.sequence, starts[e] as start, s.location_id, s.unknown, s.type, lead(starts[e]) over (partition by l.user_id order by l.sequence) - starts[e] as duration, starts[e + 1] - starts[e] as linked_duration
          from left{tag} l join {source} s on s.user_id = l.user_id and s.sequence = l.e - 1""",
    }


def matching_sql(tag: str, pairs: str, skips: bool) -> dict[str, str]:
    """matched{tag} (user_id, m): the distances of a greedy matching of pairs (user_id, m, c, t). With skips, the pair after each one struck is passed
    over: of pairs in a row that conflict, every other one goes."""
    clash = "rest[z].c = best.c or rest[z].t = best.t"
    kept = f"not ({clash})"
    if skips:
        # how far back the row of conflicting pairs began decides
        free = f"coalesce(list_max(list_filter(range(1, z), lambda y: not ({clash.replace('[z]', '[y]')}))), 0)"
        kept = f"not ({clash}) or (z - {free}) % 2 = 0"
    return {
        f"pairs{tag}": f"select user_id, list(struct_pack(m := m, c := c::varchar, t := t::varchar) order by m, c::varchar, t::varchar) as rest, least(count(distinct c), count(distinct t)) as want, null::double as m from {pairs} group by user_id",
        f"match{tag}": f"""select user_id, rest, want, m from pairs{tag} union all
          select user_id, list_transform(list_filter(range(1, len(rest) + 1), lambda z: {kept}), lambda z: rest[z]), want - 1, best.m from (select user_id, rest[2:] as rest, rest[1] as best, want from match{tag} where want > 0 and len(rest) > 0)""",
        f"matched{tag}": f"select user_id, m from match{tag} where m is not null",
    }


_ES = f"({geo.ECCENTRICITY!r}::double * sin(PHI))"
_NEXT = f"{geo.math.pi / 2!r}::double - 2*atan(tt * pow((1-{_ES})/(1+{_ES}), {geo.ECCENTRICITY / 2!r}::double))"
#: Longitude and latitude of x, y, by six rounds.
UNPROJECT = f"""x - {geo.FALSE_EAST!r}::double as east, {geo.RHO_ORIGIN!r}::double - (y - {geo.FALSE_NORTH!r}::double) as north, pow(sqrt(east*east + north*north) / {geo.AXIS * geo.SCALE!r}::double, {1 / geo.CONE!r}::double) as tt,
  {geo.math.pi / 2!r}::double - 2*atan(tt) as p0, {', '.join(f"{_NEXT.replace('PHI', f'p{i}')} as p{i + 1}" for i in range(6))},
  degrees(atan2(east, north)) / {geo.CONE!r}::double + ({geo.LON_ORIGIN!r})::double as lon, degrees(p6) as lat"""

KEY = "t, synthetic, ord, j"
SEGMENT = f"(partition by user_id, seg order by {KEY})"
STRUCT = "struct_pack(t := t, acc := acc, lon := lon, lat := lat, x := x, y := y)"


def added_sql(steps: str, stage: int, time: str, parts: str) -> str:
    return f"""select user_id, seg, t2 as t, ord, a2 as acc, lon, lat, x, y, true as synthetic, {stage * 1_000_000} + j*1000 + j2 as j from (select *, {UNPROJECT} from (
      select user_id, seg, ord, j, j2, {time} as t2, (acc + n.acc)/2 as a2, x + (j2/parts)*(n.x - x) as x, y + (j2/parts)*(n.y - y) as y from (select *, unnest({parts}) as j2 from {steps})))"""


def near_station(point: str) -> str:
    return f"exists (select 1 from stations s where {metres_sql(point, 's')} < {P.subway_radius})"


_WALK = f"{P.walking_speed!r}::double"
_SPEED = {s: f"{metres_sql('p', s)} / case when abs(p.t - {s}.t) = 0 then 1 else abs(p.t - {s}.t) end" for s in ("b", "n")}
_HALF = {s: f"case when abs(f.t - {s}.t) < 500 or not f.synthetic or not {s}.synthetic then abs(f.t - {s}.t)/2 else 0 end" for s in ("b", "n")}

#: The whole diary, each step as the plan has it.
DIARY = {
    "g1": "select *, lag(struct_pack(lat := lat, lon := lon, ord := ord)) over (partition by user_id order by t, ord) as p from clean where why is null",
    "stop": f"select user_id, ord from clean c where why is null and {near_station('c')}",
    "g2": f"select g.*, coalesce({metres_sql('p', 'g')} > 1000 and not (a.ord is not null and b.ord is not null), false) as gap from g1 g left join stop a on a.user_id = g.user_id and a.ord = g.ord left join stop b on b.user_id = g.user_id and b.ord = g.p.ord",
    "g3": "select *, sum(gap::int) over (partition by user_id order by t, ord) as s from g2",
    "g4": "select user_id, s, row_number() over (partition by user_id order by s) - 1 as seg from (select user_id, s from g3 group by all having count(*) >= 5 and max(t) - min(t) > 3600)",
    "g5": f"select user_id, seg, t::double as t, ord, acc, lon, lat, {geo.FALSE_EAST!r}::double + {RHO}*sin{THETA} as x, {geo.FALSE_NORTH + geo.RHO_ORIGIN!r}::double - {RHO}*cos{THETA} as y, false as synthetic, 0::bigint as j from g3 join g4 using (user_id, s)",
    "g6": f"select *, lead({STRUCT}) over {SEGMENT} as n from g5",
    "g7": f"select *, cast(ceil(d/30) as bigint) as parts from (select *, {metres_sql('g', 'n')} as d from g6 g where n is not null) where d > 30",
    "g8": "select user_id, seg, t, ord, acc, lon, lat, x, y, synthetic, j from g5 union all "
    + added_sql("g7", 1, f"case when d >= (n.t - t)*{_WALK} then t + (j2/parts)*(n.t - t) else n.t - (1 - j2/parts)*d/{_WALK} end", "case when parts > 5 then [1, 2, parts-2, parts-1] else range(1, parts) end"),
    "g9": f"select f.* exclude (b, n), coalesce(case when b is not null then {_HALF['b']} end, 0) + coalesce(case when n is not null then {_HALF['n']} end, 0) as weight from (select *, lag(struct_pack(t := t, synthetic := synthetic)) over {SEGMENT} as b, lead(struct_pack(t := t, synthetic := synthetic)) over {SEGMENT} as n from g8) f",
    "h1": "select user_id, lon, lat, any_value(x) as x, any_value(y) as y, sum(weight) as w, min(struct_pack(seg := seg, t := t, synthetic := synthetic, ord := ord, j := j)) as first from g9 group by user_id, lon, lat",
    "h2": "select user_id, total, exp(-0.25::double/(rms*rms + 625)) / (2*pi()*(rms*rms + 625)) * 600::double / total as threshold from (select user_id, sqrt(avg(acc*acc)) as rms from clean where why is null group by all) join (select user_id, sum(weight) as total from g9 group by all) using (user_id) where total > 600",
    "h3": "select a.user_id, a.lon, a.lat, any_value(a.first) as first, sum(b.w * exp(-(pow(a.x-b.x, 2) + pow(a.y-b.y, 2)) / 1250)) / (any_value(l.total) * 2 * pi() * 625) as kde from h1 a join h1 b using (user_id) join (select user_id, sum(weight) as total from g9 group by all) l using (user_id) where abs(a.x-b.x) <= 250 and abs(a.y-b.y) <= 250 group by all",
    "h4": "select d.*, round(kde * 1e9, 6) as h from h3 d join h2 using (user_id) where kde >= threshold",
    "h5": f"select *, row_number() over (partition by user_id order by first) as location_id from h4 a where not exists (select 1 from h4 b where b.user_id = a.user_id and b.h > a.h and {metres_sql('a', 'b')} <= 100)",
    "h6": f"""select user_id, name, location_id from (select c.user_id, ['home', 'work', 'school'][c.location_id] as name, l.location_id, round({metres_sql('c', 'l')}, 6) as m from homes c join h5 l using (user_id))
      where true qualify row_number() over (partition by user_id, name order by m, location_id) = 1 and m <= 200""",
    "h7": "select user_id, location_id, string_agg(name, '/' order by case name when 'home' then 1 when 'work' then 2 else 3 end) as names from h6 group by all",
    "i1": f"select *, cast(ceil((n.t - t)/600) as bigint) as parts from (select *, lead({STRUCT}) over {SEGMENT} as n from g9) where n is not null and n.t - t > 600",
    "i2": "select user_id, seg, t, ord, acc, lon, lat, x, y, synthetic, j, weight from g9 union all select *, 0.0::double as weight from (" + added_sql("i1", 2, "t + (j2/parts)*(n.t - t)", "range(1, parts)") + ")",
    "i3": f"""select p.* exclude (before, after, v), row_number() over {SEGMENT} as n, case when before is null or after is null then ln(0.25::double) when v > 0 then ln(1 - exp(-v/2)) else -100.0::double end as travel from (
      select p.* exclude (b, n), b as before, n as after, ({_SPEED['b']} + {_SPEED['n']})/2 as v from (select *, lag({STRUCT}) over {SEGMENT} as b, lead({STRUCT}) over {SEGMENT} as n from i2) p) p""",
    "i4": f"select p.user_id, p.seg, p.n, [any_value(p.travel)] || coalesce(list(-pow({metres_sql('p', 'l')}, 2)/11250 order by l.location_id) filter (l.location_id is not null), []) as e from i3 p left join h5 l using (user_id) group by all",
    **viterbi_sql("_d", "i4"),
    "j1": "select i3.*, state from i3 join path_d using (user_id, seg, n)",
    "j2": f"select *, lag(state) over {SEGMENT} as before, lag(t) over {SEGMENT} as t0, lead(t) over {SEGMENT} is null as last from j1 p",
    "j3": "select user_id, case when before is null then t else t0 + (t - t0)/2 end as start, nullif(state, 0) as location_id, false as unknown from j2 where before is null or before <> state union all select user_id, t, null, true from j2 where last",
    "j4": """select e.user_id, row_number() over (partition by e.user_id order by start, unknown, location_id nulls first) - 1 as sequence, start, location_id, unknown,
      case when unknown then 'unknown' when location_id is null then 'travel' when names like 'home%' then 'home' when names like 'work%' then 'work' when names = 'school' then 'school' else 'other' end as type from j3 e left join h7 using (user_id, location_id)""",
    **collapse_sql("_d", "j4"),
}
