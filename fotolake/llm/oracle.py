"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {}

ORACLE["op1_redirect_filter"] = r"""
with recursive
rules(rhost, rpath, verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
         ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
tags as (
  select url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)[\s/][^<>]*')) as tag
  from pages),
attributes as (
  select url, tag, list_transform(regexp_extract_all(tag,
    '[\s"''/][^\s"''/<>=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''<>]+)'),
    lambda a: {'name': lower(regexp_extract(a, '^[\s"''/]([^\s=]+)', 1)),
               'value': trim(regexp_replace(regexp_extract(a, '=\s*([\s\S]*)$', 1), '^["'']|["'']$', '', 'g'))}) as own
  from tags where regexp_matches(tag, '(?i)canonical|refresh|og:url')),
named as (
  select url, lower(tag[2:5]) as element,
    list_filter(own, lambda a: a.name = 'rel')[1].value as rel, list_filter(own, lambda a: a.name = 'href')[1].value as href,
    lower(list_filter(own, lambda a: a.name = 'http-equiv')[1].value) as equiv,
    lower(list_filter(own, lambda a: a.name = 'property')[1].value) as property,
    lower(list_filter(own, lambda a: a.name = 'name')[1].value) as name,
    list_filter(own, lambda a: a.name = 'content')[1].value as content
  from attributes),
raw as (
  select url, replace(coalesce(case when element = 'link' then
      case when regexp_matches(rel, '(?i)(^|\s)canonical(\s|$)') then href end
    when equiv = 'refresh' then regexp_extract(content, '(?i)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?\s*([^\s"'']+)', 1)
    when property = 'og:url' or name = 'og:url' then content end, ''), '&amp;', '&') as t
  from named),
links as (
  select url, case when t like '%://%' then t
    when t like '//%' then split_part(url, '://', 1) || ':' || t
    when t like '/%' then split_part(url, '://', 1) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || t
    else split_part(url, '://', 1) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1))
         || regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^(.*/)?') || t end as target
  from raw where t <> '' and url like '%://%'),
urls as (
  select distinct url from pages union select url from links union select target from links),
parts as (
  select url,
    case when url like '%://%' then translate(regexp_extract(url, '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when url like '%://%' then regexp_extract(url, '://[^/?#]*([^?#]*)', 1) else '' end as path,
    regexp_extract(url, '://[^?#]*\?([^#]*)', 1) as query
  from urls),
nodes as (
  select url, host, path, case when host <> '' then
    regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || '?'
    || array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> ''
       and not regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|ref|source)(=|$)'))), '&') end as node
  from parts),
ruled as (
  select url, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
         arg_max(verdict, length(rhost || rpath)) as verdict
  from nodes join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by url),
pairs as (
  select distinct a.node as a, b.node as b from links l
  join nodes a on a.url = l.url join nodes b on b.url = l.target
  where a.node <> b.node),
reach(a, b) as (
  select a, b from pairs union select b, a from pairs
  union select r.a, p.b from reach r join (select a, b from pairs union select b, a from pairs) p on r.b = p.a),
classes as (
  select n.node, least(n.node, coalesce(min(r.b), n.node)) as class
  from (select distinct node from nodes where node is not null) n left join reach r on r.a = n.node group by n.node),
decided as (
  select class, bool_or(verdict = 'block') and not bool_or(verdict = 'allow') as blocked
  from nodes join ruled using (url) join classes using (node) group by class)
select p.page_id, coalesce(n.host, '') as host, coalesce(n.path, '') as path, r.rule,
       coalesce(r.verdict, case when d.blocked then 'block' else 'allow' end) as verdict
from pages p left join nodes n on n.url = p.url left join ruled r on r.url = p.url
left join classes c on c.node = n.node left join decided d on d.class = c.class
"""

ORACLE["op2_decontaminate"] = f"""
with docs as (select doc_id, {_WORDS} as w from documents),
items as (select item_id, {_WORDS} as w from benchmark),
phrases as (
  select distinct item_id, array_to_string(w[i : i + 9], ' ') as phrase, least(len(w), 10) as size
  from items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
windows as (
  select doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') as phrase
  from docs, (select distinct size from phrases), unnest(range(1, len(w) - size + 2)) t(i)),
found as (select doc_id, i, size, item_id from windows join phrases using (phrase, size)),
hits as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + size)) as p from found) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (doc_id) left join named using (doc_id)
"""

ORACLE["op5_chunked_warc"] = """
with p as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages),
d as (
  select page_id, payload, min(page_id) over (partition by payload) as first,
    array_to_string(list_transform(range(0, 8), lambda i: list_reduce(list_transform([15, 10, 5, 0],
      lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((cast('0x' || substr(hex, cast(5 * i + 1 as int), 5) as bigint) >> s) & 31), 1)),
      lambda a, b: a || b)), '') as payload_digest
  from p)
select page_id, strlen(payload) as payload_bytes, payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from d
"""

ORACLE["op6_winnow_lines"] = f"""
with pieces as (
  select doc_id, i, piece, trim(piece, {_BLANKS}) as line
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as piece,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
lines as (
  select doc_id, i, line, n, row_number() over d as k, sum(n) over d as total
  from (select *, len({_PLAIN.format("line")}) as n from pieces where line <> '')
  window d as (partition by doc_id order by i)),
ends as (
  select a.doc_id, a.k, min(b.k) as last
  from lines a join lines b on a.doc_id = b.doc_id and b.k between a.k and a.k + 2
  where b.k = a.k + 2 or b.total - a.total + a.n >= 50 group by a.doc_id, a.k),
windows as (
  select e.doc_id, e.k, e.last, list(l.line order by l.k) as content
  from ends e join lines l on l.doc_id = e.doc_id and l.k between e.k and e.last
  group by e.doc_id, e.k, e.last),
later as (
  select doc_id, k, last from (
    select *, row_number() over (partition by content order by doc_id, k) as place from windows)
  where place > 1),
gone as (select distinct doc_id, unnest(range(k, last + 1)) as k from later),
marked as (
  select p.doc_id, p.i, p.piece, l.k, g.k is not null as drop
  from pieces p left join lines l using (doc_id, i) left join gone g on g.doc_id = p.doc_id and g.k = l.k)
select doc_id, count(k) as n_lines, count(k) filter (where drop) as n_removed,
       sha256(coalesce(string_agg(piece, chr(10) order by i) filter (where not drop), '')) as kept_sha256
from marked group by doc_id
"""

ORACLE["op7_mix"] = f"""
with sized as (
  select doc_id, coalesce('s' || source, '') as source_key, len({_PLAIN.format("coalesce(text, '')")}) as size,
         cast('0x' || substr(md5(concat_ws(':', '20240229', doc_id, text)), 1, 15) as bigint) as ord
  from documents),
sources as (
  select source_key, cast(sum(size) as bigint) as source_size,
         [5.0, 2.0, 1.0][cast((row_number() over (order by source_key = '', source_key) - 1) % 3 + 1 as int)]::double as weight
  from sized group by source_key),
ratios as (
  select *, source_size * 3 as cap, sum(source_size) over () as total, source_size * 3 / weight as ratio from sources),
levels as (
  select *, (total - coalesce(sum(cap) over (order by ratio, source_key rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by ratio, source_key rows between current row and unbounded following) as own_level
  from ratios),
targets as (
  select source_key, source_size, source_size // 4194304 + 1 as n_shards,
    case when ratio > own_level then weight * level
         else cap end::double as target
  from levels, (select arg_min(own_level, ratio) filter (where ratio > own_level) as level from levels)),
quotients as (
  select source_key, k, target / (2 * k + 1) as q
  from targets, unnest(range(0, (select cast(round(sum(target) / 64) as bigint) + 1 from targets))) t(k)
  where target > 0),
seats as (
  select source_key, count(*) as seats from (
    select source_key, row_number() over (order by q desc, source_key, k) as place from quotients)
  where place <= (select round(sum(target) / 64) from targets) group by source_key),
placed as (select s.*, ord % n_shards as shard from sized s join targets using (source_key)),
shards as (
  select source_key, shard, sum(size) as shard_size from placed group by source_key, shard),
cells as (
  select h.*, t.target * h.shard_size / t.source_size as share, coalesce(s.seats, 0) as n_blocks
  from shards h join targets t using (source_key) left join seats s using (source_key)),
won as (
  select source_key, shard, count(*) as won from (
    select source_key, shard, n_blocks,
           row_number() over (partition by source_key order by share / (2 * k + 1) desc, shard, k) as place
    from cells, unnest(range(0, n_blocks + 1)) t(k) where share > 0)
  where place <= n_blocks group by source_key, shard),
words as (
  select source_key, shard, cast(shard_size as bigint) as shard_size,
         cast(least(coalesce(won, 0) * 64, shard_size * 3) as bigint) as words
  from cells left join won using (source_key, shard)),
starts as (
  select *, coalesce(sum(size) over (partition by source_key, shard order by ord, doc_id, size
                     rows between unbounded preceding and 1 preceding), 0) as start
  from placed)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(case when shard_size > 0 then words // shard_size * size
    + least(greatest(words % shard_size - start, 0), size) else 0 end as bigint) as taken
from starts join words using (source_key, shard) join targets using (source_key)
"""

ORACLE["op8_chosen_path_join"] = f"""
with recursive
docs as (select doc_id, {_WORDS} as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 10 * k >= 8 * (x.n + y.n - k)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
classes as (select a as doc_id, min(b) as low from reach group by a),
numbers as (select a as doc_id, count(*) as n_links from links group by a)
select doc_id, least(doc_id, coalesce(low, doc_id)) as class_id, coalesce(n_links, 0) as n_links
from docs left join classes using (doc_id) left join numbers using (doc_id)
"""

ORACLE["op9_preference_format"] = """
with own as (select conv_id as pair_id, turn, role, text from conversations),
ends as (
  select pair_id, max({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}) as e from own group by pair_id),
rejected as (
  select o.pair_id, o.turn, o.role, o.text from own o join ends using (pair_id) where o.turn < e.turn
  union all
  select x.pair_id, x.e.turn, y.e.role, y.e.text from ends x join ends y on y.pair_id = xor(x.pair_id, 1)),
sides as (
  select 0 as side, pair_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from own
  union all
  select 1, pair_id, turn, coalesce(role, ''), coalesce(text, '') from rejected),
messages as (
  select pair_id, turn, role, text, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1,
         row_number() over (partition by pair_id, turn order by role, text) as message
  from sides group by pair_id, turn, role, text),
forks as (
  select pair_id, min(turn) filter (n0 <> n1) as fork, bool_or(n0 > 0) and bool_or(n1 > 0) as complete
  from messages group by pair_id),
parts as (
  select m.*, complete, p.part, unnest(range(1, p.n + 1)) as copy
  from messages m join forks using (pair_id),
    lateral (select unnest(case when fork is null or turn < fork then [{'part': 'prompt', 'n': n0}]
      else [{'part': 'chosen', 'n': n0}, {'part': 'rejected', 'n': n1}] end) as p) t),
rendered as (
  select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as whole,
         part <> 'prompt' and role = 'assistant' as trained
  from parts)
select pair_id, part, turn, message, copy, whole as text, length(whole) as n_chars,
       case when trained then length('<|' || role || '|>') + 1 else length(whole) end as loss_start,
       length(whole) as loss_end, complete
from rendered
"""

ORACLE["op10_suffix_dedup"] = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
  select doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) as w
  from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as p from docs)),
later as (
  select doc_id, p from (
    select doc_id, p, row_number() over (partition by w order by doc_id, p) as place from windows)
  where place > 1),
fresh as (
  select doc_id, p, case when p <= lag(p) over d + 100 then 0 else 1 end as new
  from later window d as (partition by doc_id order by p)),
runs as (
  select doc_id, min(p) as a, max(p) + 100 as b
  from (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from fresh)
  group by doc_id, run),
gaps as (
  select doc_id, coalesce(lag(b) over d, 0) as x, a as y from runs window d as (partition by doc_id order by a)
  union all
  select doc_id, coalesce(max(b), 0), any_value(length(h) // 2) from docs left join runs using (doc_id) group by doc_id),
kept as (
  select doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as k
  from gaps join docs using (doc_id) group by doc_id),
numbers as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from runs group by doc_id)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256
from docs left join kept using (doc_id) left join numbers using (doc_id)
"""


def _merkle_sql(source_levels: int = 6, top_levels: int = 5) -> str:
    """Levels one by one: enough for 16 ** 6 leaves of a source and 16 ** 5 sources."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def leaf(text):
        fields = ["doc_id", "source", "lang", "n_chars", text]
        parts = (f"coalesce(strlen({f}::varchar) || ':' || {f}::varchar, '-')" for f in fields)
        return f"sha256({' || '.join(parts)})"

    ctes = [
        """bits(i, k, c) as (select i, 0, i from range(256) t(i) union all
             select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end
             from bits where k < 8)""",
        "crc(t) as (select list(c order by i) from bits where k = 8)",
        f"""docs as (select doc_id, source, {leaf("text")} as leaf,
             case when xor(list_reduce(list_prepend(4294967295, list_transform(
                    string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
                    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 5 = 0
               then {leaf(f"translate(text, '{upper}', '{lower}')")} end as changed
             from documents, crc)""",
        """rows_ as (select doc_id, leaf, coalesce(changed, leaf) as used,
             dense_rank() over (order by source nulls first) - 1 as tree,
             row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx,
             count(*) over (partition by source) as n from docs)""",
        "s0 as (select tree, idx, n, leaf as digest from rows_)",
    ]

    def climb(name, levels):
        for k in range(levels):
            ctes.append(
                f"{name}g{k} as (select tree, idx // 16 as run, max(n) as n, "
                f"list(digest order by idx) as d from {name}{k} where n > 1 group by all)"
            )
            ctes.append(
                f"{name}{k + 1} as (select tree, run as idx, (n + 15) // 16 as n, "
                f"sha256(array_to_string(d, '')) as digest from {name}g{k})"
            )

    climb("s", source_levels)
    last = " union all ".join(
        f"select tree, digest from s{k} where n = 1" for k in range(source_levels + 1)
    )
    ctes.append(f"subroots as ({last})")
    ctes.append(
        "t0 as (select -1 as tree, tree as idx, count(*) over () as n, digest from subroots)"
    )
    climb("t", top_levels)
    last = " union all ".join(f"select digest from t{k} where n = 1" for k in range(top_levels + 1))
    ctes.append(f"root as ({last})")
    ctes.append("p0 as (select *, '' as proof, used as folded from rows_)")
    steps = [("s", k, "p.tree", "p.idx") for k in range(source_levels)]
    steps += [("t", k, "-1", "p.tree") for k in range(top_levels)]
    for i, (name, k, tree, idx) in enumerate(steps):
        at = f"({idx} // {16**k}) % 16"
        left = f"array_to_string(d[1 : {at}], '')"
        right = f"array_to_string(d[{at} + 2 : 16], '')"
        ctes.append(
            f"p{i + 1} as (select p.* replace ("
            f"proof || case when d is null then '' else {left} || {right} end as proof, "
            f"case when d is null then folded else sha256({left} || folded || {right}) end as folded) "
            f"from p{i} p left join {name}g{k} g on g.tree = {tree} and g.run = {idx} // {16 ** (k + 1)})"
        )
    return (
        "with recursive "
        + ",\n".join(ctes)
        + f"""
select doc_id, leaf, s.digest as subroot, root.digest as root, sha256(proof) as proof_sha256,
       folded as folded_root, folded = root.digest as verified
from p{len(steps)} p join subroots s using (tree), root"""
    )


ORACLE["op11_merkle_manifest"] = _merkle_sql()

ORACLE["op12_phrase_collocations"] = f"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents)),
sizes as (select lang, sum(len(w)) as n from pieces group by lang),
grams as (
  select lang, w[i : i + k - 1] as g, count(*) as f
  from (select lang, w, unnest(range(1, 6)) as k from pieces), unnest(range(1, len(w) - k + 2)) t(i)
  group by all having count(*) >= 100),
cuts as (
  select c.lang, c.g, c.f as a, k, x.f as l, y.f as r, s.n,
         (1000::hugeint * c.f * s.n) // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, len(g))) as k from grams) c
  join grams x on x.lang = c.lang and x.g = c.g[1 : k]
  join grams y on y.lang = c.lang and y.g = c.g[k + 1 :]
  join sizes s on s.lang = c.lang),
lowest as (
  select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
inner_ as (
  select lang, g[i : i + k - 1] as g, max(f) as longer
  from (select *, unnest(range(2, len(g))) as k from grams where len(g) > 2),
       unnest(range(1, len(g) - k + 2)) t(i)
  group by all),
ranked as (
  select lang, array_to_string(g, ' ') as phrase, a, l, r, n, score
  from lowest left join inner_ using (lang, g) where longer is null or 100 * longer < 100 * a)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from (select *, row_number() over (
        partition by lang order by score desc, a desc, phrase) as rank from ranked)
where rank <= 2000
"""
