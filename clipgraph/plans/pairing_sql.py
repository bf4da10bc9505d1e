"""SQL of an optimal pairing, by dynamic programming over the set of right units that are taken."""


def pairing(name: str, left: str, right: str, cost: str, keys: str, partial: int | None = None) -> str:
    """CTEs that end in ``name``: (keys, i, j) of the first optimal pairing, line by line.

    ``left`` has (keys, i) with i from 1, ``right`` has (keys, j, prev) with j from 0 and prev the
    unit before of the same kind, ``cost`` has (keys, i, j, ic) with whole costs. Units of one kind are
    taken in order. With ``partial`` any left unit may stay alone at that cost, else only as many
    as the left side has more, at no cost.
    """
    joined = " and ".join(f"d.{k} = o.{k}" for k in keys.split(", "))
    spare = "n - m" if partial is None else "n"
    return f"""
{name}_n as (select {keys}, n, coalesce(m, 0) as m from (select {keys}, count(*) as n from {left} group by all) a
  left join (select {keys}, count(*) as m from {right} group by all) b using ({keys})),
{name}_o as materialized (
  select {keys}, i, j, coalesce(prev, -1) as prev, ic from {cost} join {right} using ({keys}, j)
  union all select {keys}, i, 999, -1, {partial or 0} from {left} join {name}_n using ({keys}) where {spare} > 0),
{name}_dp as (
  select {keys}, cast(0 as bigint) as i, cast(0 as hugeint) as mask, {{'c': cast(0 as hugeint), 'p': cast([] as smallint[])}} as best from {name}_n
  union all
  select {', '.join('d.' + k for k in keys.split(', '))}, d.i + 1, case when o.j = 999 then d.mask else d.mask + (cast(1 as hugeint) << o.j) end as mask2,
    min({{'c': d.best.c + o.ic, 'p': list_append(d.best.p, cast(o.j as smallint))}})
  from {name}_dp d join {name}_o o on {joined} and o.i = d.i + 1 join {name}_n s on {joined.replace('d.', 's.')}
  where (o.j = 999 or (d.mask >> o.j) % 2 = 0) and (o.prev < 0 or (d.mask >> o.prev) % 2 = 1)
    and (o.j < 999 or d.i - bit_count(d.mask) < {'s.n - s.m' if partial is None else 's.n'})
  group by all),
{name}_best as (select {keys}, min(best) as best from {name}_dp join {name}_n using ({keys}) where i = n group by all),
{name} as (select {keys}, i, j from (select {keys}, unnest(best.p) as j, generate_subscripts(best.p, 1) as i from {name}_best) b where j < 999)
"""
