"""DuckDB statements that must give the same rows as the registered queries."""

from __future__ import annotations

from bindings.queries import BATCH
from bindings.views import with_views

ORACLE: dict[str, str] = {}


def _add(name: str, sql: str, *views: str) -> None:
    ORACLE[name] = with_views(sql, *views) if views else sql


_FULL = "case when local then base_path || '/' || path else path end"

# --- re-linking --------------------------------------------------------------

_add(
    "relink_ranked",
    """+ o as (select md5hash, path, row_number() over (
        partition by md5hash order by coalesce(base_path, ''), path) rn
      from fx_photo p left join fx_import i on p.dt_import = i.import_date
      where md5hash is not null),
    n as (select md5hash, path, row_number() over (partition by md5hash order by path) rn
      from fx_scan where md5hash is not null)
    select o.md5hash, o.path as old_path, n.path as new_path
    from o join n on o.md5hash = n.md5hash and o.rn = n.rn""",
    "fx_photo", "fx_import", "fx_scan",
)

_add(
    "reconnect_ranked",
    f"""+ o as (select p.*, row_number() over (
        partition by md5hash order by coalesce(base_path, ''), path) rn
      from fx_photo p left join fx_import i on p.dt_import = i.import_date),
    n as (select md5hash, path as new_path,
        row_number() over (partition by md5hash order by path) rn
      from fx_scan where md5hash is not null)
    select case when new_path is null then path when starts_with(new_path, '/new/')
        then substr(new_path, 6) else regexp_replace(new_path, '^/', '') end as path,
      case when new_path is null then fname
           else regexp_extract(new_path, '([^/]*)$', 1) end as fname,
      o.md5hash, case when new_path is null then dt_import else '{BATCH}' end as dt_import
    from o left join n on o.md5hash = n.md5hash and o.rn = n.rn""",
    "fx_photo", "fx_import", "fx_scan",
)

_UNIQUE = """+ one as (select md5hash, max(path) as old_path from fx_photo
      where md5hash is not null group by md5hash having count(*) = 1),
    last as (select md5hash, max(path) as new_path from fx_scan
      where md5hash is not null group by md5hash),
    u as (select one.md5hash, old_path, new_path from one join last on one.md5hash = last.md5hash)
"""
_add("relink_unique", _UNIQUE + "select * from u", "fx_photo", "fx_scan")
_add(
    "relink_apply",
    _UNIQUE
    + f"""select coalesce(new_path, path) as path,
      case when new_path is null then fname
           else regexp_extract(new_path, '([^/]*)$', 1) end as fname,
      ftype, p.md5hash, dt_orig, dt_mod,
      case when new_path is null then dt_import else '{BATCH}' end as dt_import
    from fx_photo p left join u on u.old_path = p.path""",
    "fx_photo", "fx_scan",
)
_add(
    "relink_ambiguous_hashes",
    """select md5hash, count(*) as n from fx_photo
    where md5hash in (select md5hash from fx_scan) group by md5hash having count(*) > 1""",
    "fx_photo", "fx_scan",
)

_MOVED = """+ amb as (select md5hash from fx_photo
      where md5hash in (select md5hash from fx_scan) group by md5hash having count(*) > 1),
    old as (select md5hash, path as old_path from fx_photo p where md5hash in (select * from amb)
      and not exists (select 1 from fx_scan s where s.md5hash = p.md5hash and s.path = p.path)),
    new as (select md5hash, path as new_path from fx_scan s where md5hash in (select * from amb)
      and not exists (select 1 from fx_photo p where s.md5hash = p.md5hash and s.path = p.path))
"""
# All pairs of a hash: the shorter path over every window of the longer one.
_PAIRS = _MOVED + """, po as (select *, row_number() over (partition by md5hash order by old_path) as i from old),
    pn as (select *, row_number() over (partition by md5hash order by new_path) as j from new),
    pairs as (select md5hash, old_path, new_path, abs(i - j) as gap,
      case when length(new_path) > length(old_path) then old_path else new_path end as s,
      case when length(new_path) > length(old_path) then new_path else old_path end as l
      from po join pn using (md5hash))
"""
# Longest common subsequences by bits: a one for every character of s not yet matched.
_RATIOS = _PAIRS + """, masks as (select *, (1::hugeint << length(s)) - 1 as ones,
      list_transform(string_split(l, ''), lambda c: list_reduce(list_prepend(0::hugeint,
        list_transform(range(1, length(s) + 1),
          lambda k: case when s[k] = c then 1::hugeint << (k - 1) else 0::hugeint end)),
        lambda a, b: a | b)) as m
      from pairs),
    windows as (select * exclude (m, l), unnest(list_transform(range(1, length(l) - length(s) + 2),
      lambda i: list_reduce(list_prepend(ones, m[i : i + length(s) - 1]),
        lambda v, k: ((v + (v & k)) | (v & (ones - k))) & ones))) as v from masks),
    scored as (select md5hash, old_path, new_path, gap,
      cast(floor((200 * max(length(s) - bit_count(v)) + length(s)) / (2 * length(s))) as int) as ratio
      from windows group by md5hash, old_path, new_path, gap, s)
"""
_FIRST = """qualify row_number() over (
      partition by md5hash, new_path order by {0} desc, gap, old_path) = 1"""
_add(
    "relink_best_levenshtein",
    _PAIRS
    + """, windows as (select *, unnest(generate_series(1, length(l) - length(s) + 1)) as i from pairs),
    scored as (select md5hash, old_path, new_path, gap,
      max(1 - cast(levenshtein(substr(l, i, length(s)), s) as double) / length(s)) as exact
      from windows group by md5hash, old_path, new_path, gap)
    select md5hash, old_path, new_path, round(exact, 6) as ratio from scored """
    + _FIRST.format("exact"),
    "fx_photo", "fx_scan",
)
_add(
    "relink_best_partial_ratio",
    _RATIOS + "select md5hash, old_path, new_path, ratio from scored " + _FIRST.format("ratio"),
    "fx_photo", "fx_scan",
)
# One pair of every hash at a time: the first whose paths are both free.
_GREEDY = _RATIOS + """, taken as (
      select md5hash, []::varchar[] as olds, []::varchar[] as news, null::int as ratio
      from (select distinct md5hash from scored)
      union all
      select md5hash, list_append(olds, old_path), list_append(news, new_path), ratio from (
        select t.md5hash, olds, news, old_path, new_path, s.ratio, gap
        from taken t join scored s on t.md5hash = s.md5hash
        where not list_contains(olds, old_path) and not list_contains(news, new_path))
      qualify row_number() over (
        partition by md5hash order by ratio desc, gap, new_path, old_path) = 1),
    matched as (select md5hash, olds[len(olds)] as old_path, news[len(news)] as new_path, ratio
      from taken where ratio is not null)
"""


def _trailing_path(depth: int) -> str:
    """One numbering and one join per level, as in the definition."""
    parts, old, new = [], "old", "new"
    for steps in range(depth, -1, -1):
        def tail(path: str, n: int = steps) -> str:
            return f"lower(regexp_extract({path}, '(([^/]*/){{0,{n - 1}}}[^/]*)$', 1))" if n else "''"

        for side, source in (("o", old), ("n", new)):
            path = "old_path" if side == "o" else "new_path"
            parts.append(
                f"{side}{steps} as (select md5hash, {path}, {tail(path)} as tail, row_number() over "
                f"(partition by md5hash, {tail(path)} order by {path}) as rn from {source})"
            )
        parts.append(
            f"m{steps} as (select o.md5hash, old_path, new_path from o{steps} o join n{steps} n "
            f"on o.md5hash = n.md5hash and o.tail = n.tail and o.rn = n.rn)"
        )
        for side, path in (("o", "old_path"), ("n", "new_path")):
            parts.append(
                f"{side}left{steps} as (select md5hash, {path} from {side}{steps} "
                f"where {path} not in (select {path} from m{steps}))"
            )
        old, new = f"oleft{steps}", f"nleft{steps}"
    found = " union all ".join(f"select * from m{steps}" for steps in range(depth, -1, -1))
    return ", " + ", ".join(parts) + f", matched as ({found}) "


# No path of the views has more than eight steps.
_MATCHED = _MOVED + _trailing_path(8)
_add("relink_trailing_path", _MATCHED + "select * from matched", "fx_photo", "fx_scan")
_add(
    "relink_ambiguous",
    _GREEDY + "select * from matched",
    "fx_photo", "fx_scan",
)
_add(
    "reconnect_similar",
    _GREEDY
    + """, one as (select md5hash, max(path) as old_path from fx_photo
      where md5hash is not null group by md5hash having count(*) = 1),
    last as (select md5hash, max(path) as new_path from fx_scan group by md5hash),
    c as (select old_path, new_path from one join last using (md5hash)
      union all select old_path, new_path from matched)
    select case when new_path is null then path when starts_with(new_path, '/new/')
        then substr(new_path, 6) else regexp_replace(new_path, '^/', '') end as path,
      case when new_path is null then fname
           else regexp_extract(new_path, '([^/]*)$', 1) end as fname,
      case when new_path is null then ftype else 'png' end as ftype, md5hash,
      case when new_path is null then dt_import else '2024-03-01T12:00:00Z' end as dt_import
    from fx_photo p left join c on c.old_path = p.path""",
    "fx_photo", "fx_scan",
)
_add(
    "reconnect_same_second",
    """+ o as (select p.*, row_number() over (
        partition by md5hash order by coalesce(base_path, ''), path) rn
      from fx_photo p left join fx_import i on p.dt_import = i.import_date),
    n as (select md5hash, row_number() over (partition by md5hash order by path) rn
      from fx_scan where md5hash is not null),
    after as (select case when n.md5hash is null then dt_import else '2024-03-01T12:00:01Z' end as k
      from o left join n on o.md5hash = n.md5hash and o.rn = n.rn),
    batches as (select * from fx_import union all
      select '2024-03-01T12:00:00Z', '/other', true, 'import' union all
      select '2024-03-01T12:00:01Z', '/new', false, 'update')
    select b.*, count(k) as photo_rows from batches b left join after on k = import_date group by all""",
    "fx_photo", "fx_import", "fx_scan",
)
_add(
    "register_batch_taken",
    """select * from fx_import union all select '2024-03-01T12:00:00Z', '/new', false, 'update'
    union all select '2024-03-01T12:00:01Z', '/next', true, 'import'""",
    "fx_import",
)
# --- look-ups ----------------------------------------------------------------

_EXISTING = f"select {_FULL} as path from fx_photo p join fx_import i on p.dt_import = i.import_date"
_add("existing_paths", _EXISTING, "fx_photo", "fx_import")
_add(
    "new_files_only",
    f"select path, md5hash from fx_scan where path not in ({_EXISTING})",
    "fx_photo", "fx_import", "fx_scan",
)
_add(
    "known_hashes",
    "select path, md5hash from fx_photo where md5hash in (select md5hash from fx_scan)",
    "fx_photo", "fx_scan",
)
_JOINED = "fx_photo p left join fx_import i on p.dt_import = i.import_date"
_add(
    "attach_batch",
    f"select path, dt_import, base_path, local from {_JOINED}",
    "fx_photo", "fx_import",
)
_GPS = ("Longitude", "LongitudeRef", "Latitude", "LatitudeRef", "Altitude", "AltitudeRef")
_GPS_TAGS = ", ".join(f"""meta->>'$."GPS GPS{n}"' as GPS{n}""" for n in _GPS)
_add(
    "attach_tags",
    f"""select ftype, p.md5hash, dt_orig, {_GPS_TAGS}
    from fx_photo p left join fx_tag t on t.md5hash = p.md5hash""",
    "fx_photo", "fx_tag",
)
_add(
    "ordered_catalog",
    f"select base_path, path from {_JOINED} order by base_path nulls first, path",
    "fx_photo", "fx_import",
)

# --- catalog changes ---------------------------------------------------------

_add(
    "register_batch",
    f"select * from fx_import union all select '{BATCH}', '/new', false, 'update'",
    "fx_import",
)
_add("insert_hashes", "select * from fx_hash union select md5hash from fx_scan", "fx_hash", "fx_scan")
_add(
    "insert_photos",
    f"""select path, fname, ftype, md5hash, dt_import from fx_photo
    union all
    select path, regexp_extract(path, '([^/]*)$', 1), lower(regexp_extract(path, '\\.([^.]*)$', 1)),
      md5hash, '{BATCH}' from fx_scan where path not in (select path from fx_photo)""",
    "fx_photo", "fx_scan",
)
_add(
    "insert_tags",
    """select md5hash, meta, width, height from fx_tag
    union all
    select md5hash, '{"path":"' || min(path) || '"}', cast(length(min(path)) as int), 1 from fx_scan
    where md5hash not in (select md5hash from fx_tag) group by md5hash""",
    "fx_tag", "fx_scan",
)


def _degrees(name: str) -> str:
    """Decimal degrees of a tag with one to three parts."""
    def part(n: int) -> str:
        item = f"trim(string_split(trim({name}, '[]'), ',')[{n}])"
        top, bottom = f"split_part({item}, '/', 1)", f"split_part({item}, '/', 2)"
        return f"(cast({top} as double) / cast(coalesce(nullif({bottom}, ''), '1') as double))"

    size = f"len(string_split({name}, ','))"
    value = (
        f"case {size} when 1 then {part(1)} when 2 then {part(1)} + {part(2)} / 60 "
        f"else {part(1)} + ({part(2)} + {part(3)} / 60) / 60 end"
    )
    return f"({value}) * case when {name}Ref in ('W', 'S', '1') then -1 else 1 end"


_POINTS = f"""+ g as (select md5hash, {_GPS_TAGS} from fx_tag),
    points as (select md5hash, {_degrees("GPSLatitude")} as lat, {_degrees("GPSLongitude")} as long,
      coalesce({_degrees("GPSAltitude")}, 0) as elev_m from g where md5hash in
      (select md5hash from fx_photo))
"""
_ROUNDED = "md5hash, round(lat, 9) as lat, round(long, 9) as long, round(elev_m, 9) as elev_m"
_add(
    "gps_location",
    _POINTS + f"select {_ROUNDED} from points where lat <> 0 and long <> 0",
    "fx_tag", "fx_photo",
)
_add("insert_locations", _POINTS + f"select {_ROUNDED} from points", "fx_tag", "fx_photo")
_add(
    "drop_empty_batches",
    "select * from fx_import where import_date in (select dt_import from fx_photo)",
    "fx_import", "fx_photo",
)
_add(
    "orphans",
    """select h.md5hash from fx_hash h left join fx_photo p on h.md5hash = p.md5hash
    where p.md5hash is null""",
    "fx_hash", "fx_photo",
)
# A location belongs to each tag with a position; a longitude of exactly 0 has none.
_LOCATED = """loc as (select md5hash from fx_tag
      where meta->>'$."GPS GPSLongitude"' not like '[0, 0, 0/%')"""
_LEFT = """select 'hash' as name, md5hash as key from fx_hash where md5hash in (select md5hash from p)
    union all select 'tag', md5hash from fx_tag where md5hash in (select md5hash from p)
    union all select 'location', md5hash from loc where md5hash in (select md5hash from p)"""
_add(
    "prune_orphan_hashes",
    f"+ {_LOCATED}, p as (select * from fx_photo) {_LEFT}",
    "fx_photo", "fx_hash", "fx_tag",
)
_add(
    "cascade_delete_batch",
    f"""+ {_LOCATED}, i as (select * from fx_import where not local),
    p as (select * from fx_photo where dt_import in (select import_date from i))
    {_LEFT} union all select 'import', import_date from i union all select 'photo', path from p""",
    "fx_import", "fx_photo", "fx_hash", "fx_tag",
)
_add(
    "cascade_delete_hashes",
    f"""+ {_LOCATED}, gone as (
      select md5(text) as md5hash from documents d join labels l on l.doc_id = d.doc_id and l.toxic = 1),
    p as (select md5hash from fx_hash where md5hash not in (select md5hash from gone))
    {_LEFT} union all
    select 'photo', path from fx_photo where md5hash not in (select md5hash from gone)""",
    "fx_photo", "fx_hash", "fx_tag",
)
_add(
    "wipe_counts",
    f"""+ {_LOCATED}, n as (select 'import' as name, count(*) as n from fx_import
      union all select 'hash', count(*) from fx_hash union all select 'photo', count(*) from fx_photo
      union all select 'tag', count(*) from fx_tag union all select 'location', count(*) from loc)
    select name, n as rows_before, 0 as rows_after from n""",
    "fx_import", "fx_photo", "fx_hash", "fx_tag",
)
_add("batch_counts", "select dt_import, count(*) as photo_rows from fx_photo group by 1", "fx_photo")
_add(
    "batch_is_empty",
    """select import_date, count(p.path) as photo_rows, count(p.path) = 0 as is_empty
    from fx_import i left join fx_photo p on p.dt_import = i.import_date group by import_date""",
    "fx_import", "fx_photo",
)
_add("hash_multiplicity", "select md5hash, count(*) as n from fx_photo group by 1", "fx_photo")

# --- renaming ----------------------------------------------------------------

_EXT = r"regexp_extract(fname, '(\.[^.]*)$', 1)"
_DIR = """regexp_replace(case when local then regexp_replace(path, '/?[^/]*$', '')
      else substr(regexp_replace(path, '/?[^/]*$', ''), length(base_path) + 1) end, '^/', '')"""
_TOKENS = """cast(year(dt_orig) as int) as year, cast(month(dt_orig) as int) as month,
      strftime(dt_orig, '%Y%m%d_%H%M%S') as timestamp, cast(isoyear(dt_orig) as int) as isoyear,
      cast(week(dt_orig) as int) as isoweek, cast(isodow(dt_orig) as int) as isoday"""
_add(
    "rename_plan",
    f"""+ r as (select p.*, base_path, local, {_DIR} as old_dir, {_TOKENS},
      case when regexp_matches(path, '[A-Z]+ \\d+')
           then regexp_extract(path, '([A-Z]+) (\\d+)', 2) || '_'
                || regexp_extract(path, '([A-Z]+) (\\d+)', 1) end as regex from {_JOINED}),
    n as (select *, coalesce(regex, '') || '_' || timestamp || '_'
        || lpad(cast(month as varchar), 2, '0') || {_EXT} as new_name,
      regexp_replace(string_split(old_dir, '/')[1] || strftime(dt_orig, '/%Y/%b'), '^/', '')
        as new_dir from r)
    select md5hash, '/sorted' as new_base, year, month, base_path as old_base, path as old_path,
      local as old_local, old_dir, fname as old_name, timestamp, isoyear, isoweek, isoday, regex,
      new_name, new_dir, new_dir || '/' || new_name as new_path,
      '/sorted/' || new_dir || '/' || new_name as new_full_path,
      case when dt_orig is null then 'missing_date' when regex is null then 'no_match'
           else 'ok' end as status
    from n""",
    "fx_photo", "fx_import",
)

_WEEKLY = f"""+ w as (select md5hash, path as old_path, base_path as old_base,
      regexp_replace(string_split({_DIR}, '/')[1] || '/' || cast(isoyear(dt_orig) as varchar) || '_'
        || cast(week(dt_orig) as varchar) || {_EXT}, '^/', '') as new_path from {_JOINED}),
    dup as (select new_path, count(*) as n from w
      where new_path is not null group by new_path having count(*) > 1),
    width as (select length(cast(max(n) as varchar)) as digits from dup)
"""
_add(
    "rename_dedupe",
    _WEEKLY
    + r""", r as (select w.*, n, row_number() over (partition by w.new_path order by old_path) as rn
      from w left join dup on dup.new_path = w.new_path),
    t as (select old_base, old_path, case when n is null then new_path
      else regexp_replace(new_path, '(\.[^.]*)$', '') || '-'
        || lpad(cast(rn as varchar), cast((select digits from width) as int), '0')
        || regexp_extract(new_path, '(\.[^.]*)$', 1) end as new_path from r)
    select *, '/sorted/' || new_path as new_full_path from t""",
    "fx_photo", "fx_import",
)
_add("duplicate_targets", _WEEKLY + "select new_path, n from dup", "fx_photo", "fx_import")
_add(
    "colliding_rows",
    _WEEKLY + "select old_path, new_path from w where new_path in (select new_path from dup)",
    "fx_photo", "fx_import",
)
_add("pad_width", _WEEKLY + "select digits as width from width", "fx_photo", "fx_import")
_add(
    "duplicate_paths",
    """select strftime(dt_orig, '%Y/') || fname as path, count(*) as n from fx_photo
    where dt_orig is not null group by 1 having count(*) > 1""",
    "fx_photo",
)
_add(
    "sample_plan",
    f"""+ s as (select path as old_path, regexp_replace({_DIR} || '/' || fname, '^/', '') as new_path
      from {_JOINED})
    select old_path, new_path from s order by md5('7:' || old_path), old_path, new_path limit 5""",
    "fx_photo", "fx_import",
)
_add("distinct_bases", f"select distinct base_path as new_base from {_JOINED}", "fx_photo", "fx_import")

_MOVES = f"""+ mv as (select md5hash, path, {_FULL} as old_full, base_path,
      regexp_replace(string_split({_DIR}, '/')[1] || '/' || regexp_replace(fname, '\\s+', '_', 'g'),
        '^/', '') as new_path from {_JOINED}),
    moves as (select *, base_path || '/' || new_path as new_full from mv)
"""
_add("move_plan", _MOVES + "select old_full, new_full from moves", "fx_photo", "fx_import")
_RENAMED = f"""+ bases as (select base_path, row_number() over (order by base_path) - 1 as k
      from (select distinct base_path from fx_photo p
            join fx_import i on p.dt_import = i.import_date) b),
    batches as (select base_path, strftime(
      timestamp '2024-03-01 12:00:00' + to_seconds(k), '%Y-%m-%dT%H:%M:%SZ') as import_date from bases)
"""
_add(
    "apply_rename",
    _MOVES + ", " + _RENAMED.lstrip("+ ")
    + """select new_full as path, regexp_extract(new_full, '([^/]*)$', 1) as fname, md5hash,
      import_date as dt_import from moves join batches using (base_path)""",
    "fx_photo", "fx_import",
)
_add(
    "apply_rename_batches",
    _RENAMED
    + """select import_date, base_path, local, type from fx_import
    union all select import_date, base_path, false, 'rename' from batches""",
    "fx_photo", "fx_import",
)
_add(
    "vacated_dirs",
    _MOVES
    + r""", dirs as (select distinct regexp_replace(old_full, '/[^/]*$', '') as dir from moves
      union select distinct regexp_replace(new_full, '/[^/]*$', '') from moves),
    up as (select distinct array_to_string(list_slice(string_split(dir, '/'), 1, n), '/') as dir
      from dirs, (select unnest(generate_series(3, 12)) as n) s
      where n <= len(string_split(dir, '/')))
    select dir, false as only_thumbs from up
    where not exists (select 1 from moves where starts_with(new_full, up.dir || '/'))""",
    "fx_photo", "fx_import",
)

# --- scalar functions --------------------------------------------------------

_add(
    "date_tokens",
    """select event_id, strftime(ts, '%Y%m%d_%H%M%S %a %j %V %y%%') as timestamp,
      cast(year(ts) as int) as year, cast(month(ts) as int) as month,
      cast(isoyear(ts) as int) as isoyear, cast(week(ts) as int) as isoweek,
      cast(isodow(ts) as int) as isoday from events""",
)
_add(
    "date_subdir",
    """select o_orderkey, o_orderpriority || '/' || strftime(o_orderdate, '%Y/%b') as dir
    from orders""",
)
_add(
    "exif_datetime",
    """select event_id, case when event_type in ('error', 'view') then null
      else date_trunc('second', ts) end as dt_orig from events""",
)
_add("localize_utc", "select event_id, ts + interval 8 hour as dt_utc from events")
# Summer time in central Europe: last Sunday of March, 02:00, to last Sunday of
# September (until 1995) or October, 03:00; the hour before its end comes twice
# and counts as winter time, the hour after its start does not exist.
_add(
    "localize_orders",
    """with o as (select o_orderkey, o_orderdate + to_hours(o_orderkey % 24) as t from orders),
    e as (select *, make_date(year(t), 3, 31) as m,
      case when year(t) < 1996 then make_date(year(t), 9, 30) else make_date(year(t), 10, 31) end as s
      from o),
    b as (select *, cast(m - cast(dayofweek(m) as int) as timestamp) + interval 3 hour as starts,
      cast(s - cast(dayofweek(s) as int) as timestamp) + interval 2 hour as ends from e)
    select o_orderkey, case when t >= starts and t < ends then t - interval 2 hour
      else t - interval 1 hour end as dt_utc from b""",
)
_add(
    "url_path_parts",
    r"""select page_id, regexp_replace(url, '/[^/]*$', '') as dirname,
      regexp_extract(url, '([^/]*)$', 1) as basename,
      regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^\.*[^.].*(\.[^.]*)$', 1) as extension
    from pages""",
)
_add(
    "url_captures",
    r"""select page_id, case when regexp_matches(url, '\w+\.example\.[a-z]+/')
        then regexp_extract(url, '(\w+)\.example\.([a-z]+)/', 1) || '_'
          || regexp_extract(url, '(\w+)\.example\.([a-z]+)/', 2) end as joined,
      case when regexp_matches(url, '/\d+\?page=\d+')
        then regexp_extract(url, '/(\d+)\?page=(\d+)', 2) || '_of_'
          || regexp_extract(url, '/(\d+)\?page=(\d+)', 1) end as expanded
    from pages""",
)
_add(
    "path_cleanup",
    r"""select page_id, 'x/' || rtrim(replace(url, '://', ':/'), '/') || '/c  d' as normal,
      array_to_string(list_slice(string_split(url, '/'), 1, 4), '/') as flat,
      'x/./y//../' || url || '/a$_b/../c$_d' as filled, url as slashed,
      case when starts_with(url, 'https://') then substr(url, 9) else url end as relative
    from pages""",
)
_add("content_hash", "select doc_id, md5(text) as md5hash from documents")
_add(
    "sniff_documents",
    """select doc_id, case lang when 'en' then 'gif' when 'fr' then 'bmp' when 'de' then 'pgm'
      else case when starts_with(text, 'MM') or starts_with(text, 'II') then 'tiff'
                when starts_with(text, 'BM') then 'bmp' end end as ftype
    from documents""",
)
_add("json_tag_events", "select event_id, props->>'$.k' as k from events")
_add(
    "tags_long",
    """select md5hash, key, meta->>('$."' || key || '"') as value
    from (select md5hash, meta, unnest(json_keys(meta)) as key from fx_tag) t""",
    "fx_tag",
)
_add(
    "tags_wide",
    """select md5hash, meta->>'$."Image Model"' as model, meta->>'$."GPS GPSAltitude"' as altitude
    from fx_tag""",
    "fx_tag",
)
_add(
    "tags_to_json",
    """select event_id, cast(user_id as varchar) as user, event_type as kind, props as note, value
    from events""",
)
_add(
    "rational_arrays",
    """with r as (select *, cast(l_linenumber as double) as a,
      case when floor(l_tax * 100) = 0 then cast(l_partkey as double)
           else l_partkey / cast(floor(l_tax * 100) as double) end as b from lineitem)
    select l_orderkey, l_linenumber, a as first, round(b, 6) as second,
      round(a + b / 60, 6) as degrees from r""",
)

_add(
    "stamp_zones",
    """with z as (select event_id, ts, ['MST', 'CEST', 'UTC', 'EDT', 'EST', 'JST', 'AEDT', 'PDT',
        'HST', 'IST', 'CST', 'NZDT', 'XYZ'][1 + event_id % 13] as zone from events),
    o as (select *, case zone when 'MST' then -420 when 'CEST' then 120 when 'UTC' then 0
      when 'EDT' then -240 when 'EST' then -300 when 'JST' then 540 when 'AEDT' then 660
      when 'PDT' then -420 when 'HST' then -600 when 'IST' then 330 when 'CST' then -360
      when 'NZDT' then 780 end as off from z)
    select event_id,
      strftime(ts, '%Y-%m-%d %H:%M:%S') || case when off < 0 then '-' else '+' end
        || lpad(cast(abs(off) // 60 as varchar), 2, '0') || ':'
        || lpad(cast(abs(off) % 60 as varchar), 2, '0') as dt_iso,
      case when off is not null
        then strftime(ts - to_minutes(off), '%Y-%m-%d %H:%M:%S') end as dt_utc
    from o""",
)
_add(
    "typed_tags",
    """select md5hash, cast(meta->>'$."EXIF ISOSpeedRatings"' as bigint) as iso,
      cast(meta->>'$."EXIF ISOSpeedRatings"' as double) as iso_real,
      meta->>'$."Image Model"' as model, cast(null as bigint) as model_number,
      meta->>'$."GPS GPSAltitude"' as altitude, meta->>'$."EXIF LensModel"' as lens
    from fx_tag""",
    "fx_tag",
)

_ZONE = r"regexp_extract(ocr, '\d{2}:\d{2}:\d{2} ([A-Z]+)', 1)"
# The zones that the view has.
_OFFSET = f"case {_ZONE} when 'MST' then -420 when 'CEST' then 120 when 'UTC' then 0 end"
_add(
    "stamp_parse",
    rf"""+ s as (select *, regexp_split_to_array(ocr, '\s*-\s*|\n') as parts,
      strptime(regexp_extract(ocr, '([A-Z][a-z]{{2}} \d{{2}} \d{{4}} \d{{2}}:\d{{2}}:\d{{2}})', 1),
        '%b %d %Y %H:%M:%S') as t, {_OFFSET} as off from fx_stamp)
    select substr(path, 7) as path,
      case when len(parts) >= 4 then regexp_replace(parts[1], '^\[*(.+?)\]*$', '\1') end as camera_name,
      case when len(parts) >= 4 then parts[2] end as camera_type,
      case when len(parts) >= 4 then strftime(t, '%Y-%m-%d %H:%M:%S')
        || case when off < 0 then '-' else '+' end
        || lpad(cast(abs(off) // 60 as varchar), 2, '0') || ':'
        || lpad(cast(abs(off) % 60 as varchar), 2, '0') end as dt_iso,
      case when len(parts) >= 4 then t - to_minutes(off) end as dt_utc,
      case when len(parts) >= 4
        then cast(regexp_extract(ocr, '[Ee][Xx][A-Za-z]+[:;]\s*(\d+)', 1) as int) end as exposure
    from s""",
    "fx_stamp",
)
_add(
    "stamp_exposure",
    r"""select event_id,
      cast(regexp_extract(ocr, '[Ee][Xx][A-Za-z]+[:;]\s*(\d+)', 1) as int) as exposure
    from fx_stamp""",
    "fx_stamp",
)
_add(
    "union_records",
    """select c_name as name, c_acctbal as balance, c_mktsegment, cast(null as int) as s_nationkey
    from customer
    union all select s_name, s_acctbal, null, s_nationkey from supplier""",
)
_add(
    "distinct_files",
    f"select path from fx_scan union ({_EXISTING})",
    "fx_scan", "fx_photo", "fx_import",
)
_add(
    "incremental_ingest",
    r"""with t as (select 'GIF89a' || regexp_replace(html, '[\r\n]', ' ', 'g') as v from pages)
    select 'gif' as ftype, 'first' as dir, md5(v || chr(10)) as md5hash,
      '2024-03-01T12:00:00Z' as dt_import from t
    union all
    select 'gif', 'second', md5(v || chr(10)), '2024-03-01T12:00:01Z' from t where length(v) % 2 = 0""",
)
_CONTENTS = """with f as (select '/d/' || source || '/' || cast(doc_id as varchar) as path, source, doc_id,
      case when lang = 'en' then 'gif' end as ftype,
      md5(case when lang = 'en' then 'GIF89a' || chr(cast(doc_id % 100 + 1 as int)) || chr(1)
        || chr(cast(doc_id % 90 + 2 as int)) || chr(2) || text else '#' || text end) as md5hash
    from documents) """
_add(
    "scan_contents",
    _CONTENTS
    + """select path, '/d/' || source as root, cast(doc_id as varchar) as fname, ftype, md5hash,
      timestamp '1970-01-01' + to_seconds(doc_id * 4000 + 1700000000 + 32400) as dt_mod,
      path || '|read success' as msg, cast(doc_id % 100 + 257 as int) as width,
      cast(doc_id % 90 + 514 as int) as height from f where ftype is not null""",
)
_add(
    "scan_contents_update",
    _CONTENTS + "select path, ftype, md5hash, cast(null as int) as width from f",
)
_add(
    "scan_status",
    _CONTENTS
    + """select path, path || case when ftype is null then '|type failure' else '|read success' end as msg
    from f""",
)
_add("event_wall_clock", "select event_id, date_trunc('second', ts) - interval 5 hour as dt_mod from events")
_add(
    "csv_stamps",
    ORACLE["stamp_parse"].rpartition("select substr(path, 7)")[0]
    + r"""select substr(path, 7) as path,
      case when len(parts) >= 4 then regexp_replace(parts[1], '^\[*(.+?)\]*$', '\1') end as camera_name,
      case when len(parts) >= 4 then strftime(t, '%Y-%m-%d %H:%M:%S')
        || case when off < 0 then '-' else '+' end || lpad(cast(abs(off) // 60 as varchar), 2, '0')
        || ':' || lpad(cast(abs(off) % 60 as varchar), 2, '0') end as dt_iso,
      case when len(parts) >= 4 then regexp_extract(ocr, 'Exposure: (\d+)', 1) end as exposure, ocr
    from s""",
)
_add(
    "csv_plan",
    f"""+ s as (select md5hash, path as old_path,
      regexp_replace({_DIR} || '/' || fname, '^/', '') as new_path from {_JOINED})
    select *, 'ok' as status from s""",
    "fx_photo", "fx_import",
)
for _name in ("pipe_wide", "parquet_wide"):
    ORACLE[_name] = ORACLE["tags_wide"]
_add(
    "filter_name",
    r"""select path from fx_photo
    where regexp_matches(regexp_extract(path, '([^/]*)$', 1), '.JPG|[13]\d.jpg')""",
    "fx_photo",
)
_add(
    "filter_extension",
    r"select path from fx_scan where regexp_matches(lower(path), '\.jpe?g$')",
    "fx_scan",
)
