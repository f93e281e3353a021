"""DuckDB SQL for those operators whose results SQL can express."""

MIX = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
  from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from sized group by source),
w as (select *, (rank - 1) % 3 + 1 as w, 3 * source_size as cap, (3 * source_size)::double / ((rank - 1) % 3 + 1) as ratio from s),
l as (
  select *, ((sum(source_size) over ())::bigint - coalesce(sum(cap) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0)::bigint)::double
            / (sum(w) over (order by ratio, rank rows between current row and unbounded following))::bigint as level from w),
t as (
  select source, rank, source_size, least(cap::double, coalesce((select arg_min(level, (ratio, rank)) from l where level <= ratio) * w, cap::double)) as target from l),
q as (
  select doc_id, size, key, rank, source_size, target,
         (sum(size) over (partition by rank order by key, doc_id, size rows unbounded preceding))::bigint as cum
  from sized d join t on d.source is not distinct from t.source),
e as (
  select doc_id, key, rank, size, cum, (e * source_size + cum)::double / target as f
  from q, (select unnest([0, 1, 2]) as e) where size > 0 and target > 0),
r as (select doc_id, rank, cum, sum(size) over (order by f, rank rows unbounded preceding) as running from e),
c as (select doc_id, rank, cum, count(*) as copies from r where running <= (select sum(size) from sized) group by all)
select q.doc_id, q.size::bigint as size, q.source_size, q.target, (q.size * coalesce(c.copies, 0))::bigint as taken, coalesce(c.copies, 0)::bigint as copies
from q left join c on q.doc_id = c.doc_id and q.rank = c.rank and q.cum = c.cum and q.size > 0
"""

DECONTAMINATE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w
  from benchmark),
bw as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[j : j + least(10, len(w)) - 1], ' ') as k
  from b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as u(j) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (
  select doc_id, j, n, array_to_string(w[j : j + n - 1], ' ') as k
  from d, sizes, unnest(range(1, len(w) - n + 2)) as u(j) where len(w) >= n),
hit as (select dw.doc_id, dw.j, dw.n, bw.item_id from dw join bw using (n, k)),
words as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, j, n from hit), unnest(range(j, j + n)) as u(p) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

EMBEDDINGS = r"""
with recursive v as (
  select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings),
ok as (
  select r, vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v
  where label is not null and vec_id is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
link as (
  select a.r as a, b.r as b, a.vec_id as x, b.vec_id as y from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach as (select x, y from link union select reach.x, link.y from reach join link on reach.y = link.x)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(c, vec_id)) as component_id, coalesce(vec_id = least(vec_id, coalesce(c, vec_id)), false) as kept
from v left join (select a, count(*) as n from link group by a) l on v.r = l.a left join (select x, min(y) as c from reach group by x) k on v.vec_id = k.x
"""

SUFFIXES = r"""
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
p as (select doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) as s from d, unnest(range(0, len(h) // 2 - 49)) as u(p) where len(h) >= 100),
f as (select s, min(doc_id) as first from p group by s),
gone as (select doc_id, p from p join f using (s) where doc_id > first),
b as (select doc_id, p, max(p) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding) as before from gone),
r as (select doc_id, p, sum((before is null or p > before + 50)::int) over (partition by doc_id order by p) as run from b),
s as (select doc_id, run, min(p) as a, max(p) + 50 as z from r group by all),
k as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as from_, lead(a) over (partition by doc_id order by a) as next from s),
t as (
  select k.doc_id, sum(z - a)::bigint as n_removed, count(*) as n_spans,
         string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)) || case when next is null then substr(h, 2 * z + 1) else '' end, '' order by a) as kept
  from k join d using (doc_id) group by k.doc_id)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join t on d.doc_id = t.doc_id
"""

_CODES_ROUND = r"""
d{k} as (
  select p.r, p.part, c.entry, sum((p.x - c.x) * (p.x - c.x))::bigint as d from p join c{k} c using (part, pos) group by all),
a{k} as (select r, part, min(entry) as entry, min(d) as d from (select *, min(d) over (partition by r, part) as least from d{k}) where d = least group by r, part)"""
_CODES_MOVE = r""",
s{k} as (select part, pos, entry, sum(x)::bigint as s, count(*) as n from p join a{k} using (r, part) group by all),
c{next} as (
  select c.part, c.pos, c.entry, coalesce((s - (s % n + n) % n) // n, c.x) as x from c{k} c left join s{k} s using (part, pos, entry))"""

CODES = (
    r"""
with v as (
  select row_number() over (order by vec_id nulls last, embedding::double[]) - 1 as r, vec_id, label, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
w as (select ((max(len(e)) + 15) // 16)::bigint as w from v),
p as (
  select r, i // w as part, i % w as pos, greatest(-16777216, least(16777216, floor(256 * coalesce(e[i + 1], 0))))::bigint as x
  from v, w, unnest(range(16 * w)) as u(i)),
c0 as (select part, pos, r as entry, x from p where r < 64),"""
    + "".join(_CODES_ROUND.format(k=k) + (_CODES_MOVE.format(k=k, next=k + 1) + "," if k < 2 else "") for k in range(3))
    + r""",
o as (select r, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a2 group by r),
b as (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from c2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from o join v using (r), b
"""
)

PHRASES = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from documents, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as u(piece)),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from pieces, unnest([1, 2, 3]) as s(k), unnest(range(1, len(w) - k + 2)) as u(i)),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
cuts as (
  select c.lang, c.k, c.phrase, a, x.f as l, y.f as r, cut, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score
  from c, unnest(range(1, c.k)) as u(cut)
  join f x on x.lang = c.lang and x.phrase = array_to_string(w[1:cut], ' ') and x.k = cut
  join f y on y.lang = c.lang and y.phrase = array_to_string(w[cut + 1:], ' ') and y.k = c.k - cut),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (
  select lang, part, max(a) as longer from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from c where k = 3) group by all),
kept as (select b.* from best b left join inside i on i.lang = b.lang and i.part = b.phrase where longer is null or 100 * longer < 50 * a),
ranks as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranks join n using (lang) where rank <= 2000
"""
