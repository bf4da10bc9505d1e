"""SQL of the queries for DuckDB."""

# CRC-32 byte by byte with the usual table, which is made by the rule itself.
_CRC = """
crc_table as (
  select list(v order by n) as t from (
    select n, list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from (select unnest(range(256)) as n)))
"""

SHARDING = f"""
with recursive {_CRC},
keys as (select distinct coalesce(doc_id, 0) as id from documents),
jumps(id, k, b24, b25, j) as (
  select id, case when id < 0 then id::hugeint + 18446744073709551616 else id::hugeint end, 0::bigint, 0::bigint, 0::bigint from keys
  union all
  select id, k2, b24, b25, floor((j + 1) * (2147483648.0::double / ((k2 // 8589934592)::bigint + 1)::double))::bigint
  from (
    select id, (k * 2862933555777941757 + 1) % 18446744073709551616 as k2, case when j < 24 then j else b24 end as b24, j as b25, j
    from jumps where j < 25)),
placed as (
  select d.doc_id, octet_length(encode(coalesce(d.text, '')))::bigint + 8 as size,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(d.text, ''))), '..'),
      lambda x: ('0x' || x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::bigint as text_crc32,
    j.b24::int as shard, j.b25::int as grown_shard, md5(coalesce(d.doc_id::varchar, 'null')) as m
  from documents d join jumps j on j.id = coalesce(d.doc_id, 0) and j.j >= 25, crc_table)
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by m, doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard
from placed
"""

MIXING = """
with recursive docs as (
  select doc_id, source, coalesce('=' || source, '-') as s, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens,
    md5(coalesce('=' || source, '-') || ':' || coalesce(doc_id::varchar, 'null')) as m
  from documents),
sizes as (select s, sum(tokens)::bigint as n from docs group by s),
big as (select max(n) as largest, count(*) filter (n > 0) as k from sizes),
logs as (select ln(n / largest::double) as x from sizes, big where n > 0),
-- bisection on a grid of 2^20 steps: lo keeps the condition, hi does not
by_entropy(lo, hi) as (
  select 0, 1048577
  union all
  select case when good then mid else lo end, case when good then hi else mid end
  from (select lo, hi, (lo + hi) // 2 as mid,
          (select ln(sum(exp(x * (mid / 1048576.0)))) - (mid / 1048576.0) * sum(exp(x * (mid / 1048576.0)) * x) / sum(exp(x * (mid / 1048576.0)))
             >= 0.95 * ln(k) - 1e-12 from logs, big group by k) as good
        from (select lo, hi, (lo + hi) // 2 as mid from by_entropy) where hi - lo > 1)),
by_repeats(lo, hi) as (
  select -1, 1048576
  union all
  select case when bad then mid else lo end, case when bad then hi else mid end
  from (select lo, hi, mid, (select max(exp(x * (mid / 1048576.0 - 1))) > 4 from logs) as bad
        from (select lo, hi, (lo + hi) // 2 as mid from by_repeats) where hi - lo > 1)),
chosen as (select greatest((select max(lo) from by_entropy), (select min(hi) from by_repeats)) / 1048576.0 as a),
powers as (select s, n, case when n > 0 then exp(ln(n / largest::double) * a) else 0 end as p, largest from sizes, big, chosen),
plan as (
  select s, n, p / sum(p) over () as weight, floor(p * largest + 1e-6)::bigint as budget from powers),
dealt as (
  select d.*, p.n, p.weight, p.budget, case when n > 0 then budget // n else 1 end as whole, case when n > 0 then budget % n else 0 end as rest,
    sum(d.tokens) over (partition by d.s order by d.m, d.tokens rows unbounded preceding)::bigint as upto
  from docs d join plan p using (s)),
copies as (
  select *, unnest(range(case when upto <= rest then whole + 1 else whole end)) as epoch from dealt),
placed as (
  select *, (epoch * n + upto - tokens)::bigint as start_token from copies),
blocked as (
  select *, case when budget > 0 then least(63, (start_token * 64) // budget) else 0 end::int as block from placed)
select doc_id, source, tokens, weight, epoch::bigint as epoch, start_token, block, md5(block || ':' || epoch || ':' || m) as block_key
from blocked
"""

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
items as (
  select item_id::varchar as item, w, least(10, len(w)) as size from (select item_id, {_WORDS.format("text")} as w from benchmark)
  where len(w) > 0),
windows as (
  select distinct item, size, array_to_string(w[s:s + size - 1], ' ') as words
  from (select item, w, size, unnest(range(1, len(w) - size + 2)) as s from items)),
places as (
  select rid, size, s, array_to_string(w[s:s + size - 1], ' ') as words
  from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as s
        from docs, (select distinct size from windows) where len(w) >= size)),
found as (select distinct p.rid, p.s, p.size, x.item from places p join windows x on x.size = p.size and x.words = p.words),
hit as (select rid, count(distinct spot) as n from (select rid, unnest(range(s, s + size)) as spot from found) group by rid),
listed as (select rid, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct rid, item from found where item is not null) group by rid)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(l.n, 0)::bigint as n_items,
  sha256(coalesce(l.items, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from docs d left join hit h using (rid) left join listed l using (rid)
"""

RESAMPLING = f"""
with recursive {_CRC},
docs as (select row_number() over () as rid, doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
items as (select coalesce({_WORDS.format("text")}, []) as w from benchmark),
doc_features as (
  select rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from docs),
item_features as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from items),
hashed as (
  select f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(f)), '..'),
      lambda x: ('0x' || x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::bigint % 10000 as bucket
  from (select f from doc_features union select f from item_features), crc_table),
in_docs as (select bucket, count(*) as s from doc_features join hashed using (f) group by bucket),
in_items as (select bucket, count(*) as t from item_features join hashed using (f) group by bucket),
whole as (select (select coalesce(sum(s), 0) from in_docs)::double as sn, (select coalesce(sum(t), 0) from in_items)::double as tn),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (sn + 10000) / ((s + 1)::double * (tn + 10000))))::bigint as gain
  from in_docs left join in_items using (bucket), whole),
weights as (
  select rid, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight
  from doc_features join hashed using (f) join gains using (bucket) group by rid),
scored as (
  select rid, doc_id, len(w) as n_words, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::varchar, 'null')), 8))::bigint + 0.5::double)
      / 4294967296::double))))::bigint as score
  from docs left join weights using (rid)),
ranked as (
  select rid, row_number() over (order by score desc, doc_id nulls last, n_features) as place, count(*) over () as able
  from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= 25 * able // 100 then place end::bigint as rank
from scored left join ranked using (rid)
"""
