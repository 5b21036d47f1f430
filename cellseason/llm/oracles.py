"""DuckDB SQL of the queries that SQL can express on whole tables."""

URL_FILTER = r"""
with rules(h, p, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u as (select page_id,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
      from pages),
fits as (select distinct u.host, u.path, rules.h, rules.p, rules.verdict from u join rules
         on (u.host = rules.h or ends_with(u.host, '.' || rules.h)) and starts_with(u.path, rules.p)),
best as (select host, path, h || p as rule, verdict from fits
         qualify row_number() over (partition by host, path order by length(h) + length(p) desc, length(h) desc) = 1)
select u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') as verdict
from u left join best on u.host = best.host and u.path = best.path
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = rf"""
with items as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
windows as (select distinct item_id, least(len(w), 13) as k, array_to_string(list_slice(w, i, i + 12), ' ') as t
            from items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as r(i) where len(w) > 0),
docs as (select doc_id, {_WORDS} as w from documents),
lengths as (select distinct k from windows),
runs as (select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as t from docs, lengths, unnest(range(1, len(w) - k + 2)) as r(i)),
found as (select runs.doc_id, runs.i, runs.k, windows.item_id from runs join windows on runs.k = windows.k and runs.t = windows.t),
hit as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, i, k from found), unnest(range(i, i + k)) as q(p) group by doc_id),
own as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from found) group by doc_id)
select docs.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit on docs.doc_id = hit.doc_id left join own on docs.doc_id = own.doc_id
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LEXICAL_SEARCH = rf"""
with docs as (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
sizes as (select r, doc_id, cast(len(w) as bigint) as n from docs where len(w) > 0),
total as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from sizes),
tf as (select r, t, cast(count(*) as bigint) as tf from (select r, unnest(w) as t from docs) group by r, t),
df as (select t, cast(count(*) as bigint) as df from tf group by t),
impact as (select tf.r, tf.t, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint)
                  * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))) as part
           from tf join df on tf.t = df.t join sizes on tf.r = sizes.r, total),
item as (select distinct item_id, text from benchmark),
wanted as (select distinct item_id, text, t from (select item_id, text, unnest({_TERMS}) as t from item)),
scores as (select item_id, text, r, cast(sum(part) as bigint) as score from wanted join impact on wanted.t = impact.t group by item_id, text, r having sum(part) > 0),
ranked as (select item_id, cast(row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
           from scores join sizes on scores.r = sizes.r)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""

MIXING = r"""
with docs as (select doc_id, source, text, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                     cast(('0x' || substr(md5('12:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15)) as bigint) as draw from documents),
own as (select source, cast(sum(size) as bigint) as source_size from docs group by source),
weighed as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from own),
total as (select cast(sum(source_size) as hugeint) as words from own),
-- by rising ratio of size to weight: a source is clamped if its share of what those before it leave is above its cap
laid as (select *, 3 * cast(source_size as hugeint) as cap, coalesce(sum(3 * cast(source_size as hugeint)) over up, 0) as taken_before, sum(weight) over rest as free
         from weighed window up as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding),
                             rest as (order by source_size / weight, source nulls last rows between current row and unbounded following)),
clamp as (select *, weight * (words - cast(taken_before as hugeint)) > cap * cast(free as hugeint) as clamped from laid, total),
left_over as (select any_value(words) - coalesce(sum(cap) filter (clamped), 0) as words, sum(weight) filter (not clamped) as weight from clamp),
filled as (select source, source_size, case when clamped then cast(cap as double) else clamp.weight * cast(left_over.words as double) / cast(left_over.weight as double) end as target
           from clamp, left_over),
parted as (select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end as whole from filled),
drawn as (select docs.*, source_size, target, whole, target - whole * source_size as rest,
                 coalesce(sum(size) over (partition by docs.source order by draw rows between unbounded preceding and 1 preceding), 0) as before
          from docs join parted on docs.source is not distinct from parted.source)
select doc_id, size, source_size, target, cast((whole + case when rest > 0 and size > 0 and before + size / 2 <= rest then 1 else 0 end) * size as bigint) as taken from drawn
"""

# Start, polynomial and parity of crc32.
MERKLE_MANIFEST = r"""
with recursive cells as (
    select row_number() over () as r, doc_id, case when source is null then '0' else '1' || source end as tree, text, cast(doc_id as varchar) as id, source, lang, cast(n_chars as varchar) as n_chars,
           list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda d: cast(ascii(d) as bigint))), lambda c, d:
               list_reduce(list_prepend(xor(c, d), range(8)), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) as crc
    from documents),
headed as (
    select *, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
              || coalesce(strlen(n_chars) || ':' || n_chars, '-') as head, case when crc % 2 = 1 then replace(text, chr(10), '') else text end as shown_text from cells),
leaves as (
    select r, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(shown_text) || ':' || shown_text, '-')) as shown from headed),
laid as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as idx, count(*) over (partition by tree) as n from leaves),
nodes as (
    select tree, 0 as level, idx, leaf as hash, n from laid
    union all
    select tree, level + 1, idx // 3, sha256(string_agg(hash, '' order by idx)), (n + 2) // 3 from nodes where n > 1 group by tree, level, idx // 3, n),
subroots as (select tree, hash, row_number() over (order by tree) - 1 as idx, count(*) over () as n from nodes where n = 1),
tops as (
    select 0 as level, idx, hash, n from subroots
    union all
    select level + 1, idx // 3, sha256(string_agg(hash, '' order by idx)), (n + 2) // 3 from tops where n > 1 group by level, idx // 3, n),
runs as (select tree, level, idx // 3 as up, list(hash order by idx) as run from nodes where n > 1 group by tree, level, idx // 3),
top_runs as (select level, idx // 3 as up, list(hash order by idx) as run from tops where n > 1 group by level, idx // 3),
heights as (select tree, max(level) as height from nodes group by tree),
walk as (
    select r, laid.tree, 0 as level, laid.idx, shown as hash, '' as proof, height, subroots.idx as tree_idx from laid join heights on laid.tree = heights.tree join subroots on laid.tree = subroots.tree
    union all
    select w.r, w.tree, w.level + 1, case when w.level + 1 = w.height then w.tree_idx else w.idx // 3 end,
           sha256(array_to_string(run[: w.idx % 3], '') || w.hash || array_to_string(run[w.idx % 3 + 2 :], '')),
           w.proof || array_to_string(run[: w.idx % 3], '') || array_to_string(run[w.idx % 3 + 2 :], ''), w.height, w.tree_idx
    from walk w join runs on w.tree = runs.tree and w.level = runs.level and w.idx // 3 = runs.up where w.level < w.height),
climb as (
    select r, 0 as level, tree_idx as idx, hash, proof from walk where level = height
    union all
    select c.r, c.level + 1, c.idx // 3, sha256(array_to_string(run[: c.idx % 3], '') || c.hash || array_to_string(run[c.idx % 3 + 2 :], '')),
           c.proof || array_to_string(run[: c.idx % 3], '') || array_to_string(run[c.idx % 3 + 2 :], '')
    from climb c join top_runs on c.level = top_runs.level and c.idx // 3 = top_runs.up),
root as (select hash, level from tops where n = 1)
select doc_id, leaf, subroots.hash as subroot, root.hash as root, sha256(climb.proof) as proof_sha256, climb.hash as folded_root, climb.hash = root.hash as verified
from laid join subroots on laid.tree = subroots.tree join climb on laid.r = climb.r join root on climb.level = root.level
"""
