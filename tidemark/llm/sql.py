"""DuckDB SQL for the rows of the operator queries, where SQL can express them."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, unnest(range(1, greatest(len(w) - 12, 0) + 1)) as p, w from d),
seq as (select doc_id, p, list_slice(w, p, p + 12) as s from win),
least as (select s, min(doc_id) as m from seq group by s),
hit as (select doc_id, p from seq join least using (s) where m < doc_id),
gone as (select distinct doc_id, unnest(range(p, p + 13)) as q from hit),
lists as (select doc_id, list(q) as g from gone group by doc_id),
kept as (
  select d.doc_id, len(w) as n, w, coalesce(g, []) as g from d left join lists using (doc_id)
)
select doc_id, cast(n as bigint) as n_words, cast(len(g) as bigint) as n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(g, i)), ' ')) as kept_sha256
from kept
"""

OP8 = rf"""
with recursive d as (select doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as s from d
),
n as (select doc_id, len(s) as n from sets),
sh as (select doc_id, unnest(s) as g from sets),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (
  select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)
),
reach as (select doc_id, doc_id as c from n union select link.b, reach.c from reach join link on link.a = reach.doc_id)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(c) as component_id, min(c) = n.doc_id as kept
from n join reach using (doc_id) group by n.doc_id, n.n
"""

_ITEM_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = rf"""
with d as (select doc_id, {_ITEM_WORDS.format(_LOWER)} as w from documents),
b as (select item_id, {_ITEM_WORDS.format(_LOWER)} as w from benchmark),
win as (
  select distinct item_id, list_slice(w, p, p + 9) as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from b where len(w) > 0)
),
sizes as (select distinct len(s) as n from win),
places as (select doc_id, n, w, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) as p from d, sizes),
hit as (select doc_id, p, n, item_id from places join win on win.s = list_slice(w, p, p + n - 1)),
words as (select doc_id, count(distinct q) as h from (select doc_id, unnest(range(p, p + n)) as q from hit) group by 1),
items as (select doc_id, count(distinct item_id) as k, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as i from hit group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(h, 0) as bigint) as n_hit, cast(coalesce(k, 0) as bigint) as n_items,
  sha256(coalesce(i, '')) as items_sha256, coalesce(h, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""


def _op9() -> str:
    """The mix in SQL: the same draws and permutation, a nested query for each round."""
    from tidemark.llm.mixing import ROUNDS

    def bits(x: str, digits: int) -> str:
        return f"cast('0x' || substr(md5({x}), 1, {digits}) as bigint)"

    def shuffled(rel: str, number: str, size: str, key: str, name: str) -> str:
        """Materialized steps, so that no step's expression is repeated in the next; the last is called `name`, with the place as x."""
        steps = [f"{name}0 as materialized (select *, {number} as x from {rel})"]
        for i in range(ROUNDS):
            tag = f"{key} || ':{i}:'"
            mirror = f"((({bits(tag + " || 'point'", 12)} - x) % {size}) + {size}) % {size}"
            swap = f"substr(md5({tag} || cast(greatest(m, x) as varchar)), 1, 1)"
            steps.append(f"{name}m{i} as materialized (select *, {mirror} as m from {name}{i})")
            steps.append(f"{name}{i + 1} as materialized (select * exclude (m, x), case when {swap} < '8' then m else x end as x from {name}m{i})")
        return ", ".join(steps) + f", {name} as (select * from {name}{ROUNDS})"

    blocks = shuffled("dealt", "idx", "blocks", "'1:' || cast(rank as varchar) || ':' || cast(epoch as varchar)", "picked")
    draw = bits("'1:draw:' || cast(slot as varchar)", 12)
    spread = bits("coalesce(cast(doc_id as varchar), '') || ':' || cast(size as varchar)", 8)
    return rf"""
with sized as (select doc_id, source, cast(len(WORDS) as bigint) as size from documents),
s0 as (select source, sum(size) as source_size from sized group by 1),
s1 as (select *, row_number() over (order by source nulls last) as rank from s0),
s2 as (select *, cast([5, 2, 1][(rank - 1) % 3 + 1] as double) as weight, cast(source_size * 2 as double) as lim from s1),
s3 as (select *, lim / weight as fill from s2),
s4 as (
  select *, coalesce(sum(lim) over (order by fill, rank rows between unbounded preceding and 1 preceding), 0) as below,
    sum(weight) over (order by fill, rank rows between current row and unbounded following) as rest
  from s3
),
s5 as (select *, (sum(source_size) over () * 1.5::double - below) / rest as lvl from s4),
s6 as (select *, max(case when lvl <= fill then lvl end) over () as level from s5),
aims as (select source, cast(source_size as bigint) as source_size, rank, least(lim, coalesce(level * weight, lim)) as target from s6),
c0 as (select rank, source_size, target, cast(ceil(source_size / 128) as bigint) as blocks from aims),
c1 as (select rank, blocks, case when blocks > 0 then cast(least(floor(target * blocks / source_size + 0.5), blocks * 2) as bigint) else 0 end as slots from c0),
c2 as (select rank, blocks, slots, cast(sum(slots) over (order by rank) as bigint) as stop from c1),
slots as materialized (select slot, slot // 4096 as shard, {draw} / 281474976710656.0::double as u from (select unnest(range(cast(sum(slots) as bigint))) as slot from c1)),
ends as (select rank, cast(stop - slots as double) / max(stop) over () as lo, cast(stop as double) / max(stop) over () as hi from c2),
draws as materialized (select shard, rank, count(*) as n from slots join ends on u >= lo and u < hi group by 1, 2),
off as (select rank, coalesce(got, 0) as got, coalesce(got, 0) - slots as over_ from c2 left join (select rank, cast(sum(n) as bigint) as got from draws group by 1) using (rank)),
above as (select shard, rank, n, cast(sum(n) over (partition by rank order by shard) as hugeint) as upto, over_, got from draws join off using (rank) where over_ > 0),
given as materialized (select shard, rank, cast(upto * over_ // got - (upto - n) * over_ // got as bigint) as given from above),
freed as (select shard, f, sum(f) over (order by shard) - f as since from (select shard, sum(given) as f from given group by 1)),
needs as (select rank, sum(-over_) over (order by rank) as upto, -over_ as m from off where over_ < 0),
taken as (select shard, rank, least(upto, since + f) - greatest(upto - m, since) as n from freed join needs on since < upto and upto - m < since + f),
counts as (
  select shard, rank, cast(sum(n) as bigint) as n from (
    select shard, rank, n from draws union all select shard, rank, -given from given union all select shard, rank, n from taken) group by 1, 2
),
firsts as (select *, cast(sum(n) over (partition by rank order by shard) as bigint) - n as begun from counts),
each as (select rank, begun + i as k from (select rank, begun, unnest(range(n)) as i from firsts)),
dealt as (select rank, blocks, k // blocks as epoch, k % blocks as idx from each join c2 using (rank)),
{blocks},
times as (select rank, x as block, count(*) as times from picked group by 1, 2),
g as (select greatest(1, cast(ceil(sqrt(count(*))) as bigint)) as g from sized),
laid as (
  select doc_id, size, rank, source_size, target, sum(size) over (
    partition by rank order by {spread} % g, doc_id, size rows between unbounded preceding and current row) - size as start
  from sized join aims on sized.source is not distinct from aims.source, g
),
cut as (
  select doc_id, rank, block, least((block + 1) * 128 - start, size) - greatest(block * 128 - start, 0) as n
  from (select *, unnest(range(cast(start // 128 as bigint), cast((start + size - 1) // 128 as bigint) + 1)) as block from laid where size > 0)
),
took as (select doc_id, sum(n * times) as taken from cut join times using (rank, block) group by 1)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken from laid left join took using (doc_id)
""".replace("WORDS", _WORDS)


OP9 = _op9()

OP4 = r"""
with d as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null),
e as (select doc_id, l, unnest(range(1, len(l) + 1)) as p from d),
one as (select doc_id, p, l[p] as x from e),
long as (select doc_id, p from (select *, row_number() over (partition by x order by doc_id, p) as k from one where length(x) >= 100) where k > 1),
two as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by l[p], l[p + 1] order by doc_id, p) as k from e where p < len(l)) where k > 1
),
gone as (
  select doc_id, p from long union select doc_id, p from two union select doc_id, p + 1 from two
),
lists as (select doc_id, list(p) as g from gone group by 1)
select documents.doc_id, cast(coalesce(len(l), 0) as bigint) as n_lines, cast(coalesce(len(g), 0) as bigint) as n_removed,
  sha256(array_to_string(list_filter(coalesce(l, ['']), lambda x, i: not list_contains(coalesce(g, []), i)), chr(10))) as kept_sha256
from documents left join d using (doc_id) left join lists using (doc_id)
"""


OP11 = r"""
with d as (
  select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
),
t as (select k, lang, source, unnest(w) as term from d),
kept as (select lang, term from t group by 1, 2 having count(distinct k) >= 30),
v as (select lang, cast(count(term) as hugeint) as v from (select distinct lang from d) left join kept using (lang) group by 1),
c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by 1, 2, 3),
g as (
  select lang, source, cast(coalesce(sum(n), 0) as hugeint) as total
  from (select distinct lang, source from d) left join c using (lang, source) group by 1, 2
),
p as (
  select lang, source, term, coalesce(n, 0) as n, 1 + (cast(1000000000 as hugeint) * (coalesce(n, 0) + 5)) // (total + 5 * v) as p
  from g join v using (lang) join kept using (lang) left join c using (lang, source, term)
),
q as (
  select lang, term, 1 + (cast(1000000000 as hugeint) * (n + 5)) // (total + 5 * v) as q
  from (select lang, term, sum(n) as n from c group by 1, 2) join (select lang, cast(sum(total) as hugeint) as total from g group by 1) using (lang) join v using (lang)
),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (p x join p y on x.lang = y.lang and x.term = y.term) on x.lang = a.lang and x.source = a.source and y.source = b.source
  group by 1, 2, 3
),
found as (
  select lang, source, 'pair' as part, item, value from pairs
  union all
  select lang, source, 'term', term, p - q from p join q using (lang, term) where n > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value, rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
where part = 'pair' or rank <= 50
"""

OP13 = """
with r as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, cast(list_dot_product(a.v, b.v) as bigint) as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
),
pos as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from s where label = own qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
from pos join s using (anchor_id)
where label <> own and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5
"""
