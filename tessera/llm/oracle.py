"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_BLANK = r"\x20\x09-\x0D"
_SIZE = lambda keep: f"length(regexp_replace(text, '[^{keep}]', '', 'g'))"
_COMPONENTS = """reach as (
  select id, id as other from nodes union select r.id, e.b from reach r join edges e on e.a = r.other),
component as (select id, min(other) as component_id from reach group by id)"""

OP1 = rf"""with recursive words as (
  select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_BLANK}]+') as w from documents),
sets as (
  select id, case len(w) when 0 then [] when 1 then w else list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end as s from words),
nodes as (select id, cast(len(s) as bigint) as n from sets),
flat as (select id, unnest(s) as shingle from sets),
edges as (
  select a, b from (select x.id as a, y.id as b, count(*) as common from flat x join flat y on x.shingle = y.shingle and x.id <> y.id group by all) p
  join nodes na on na.id = a join nodes nb on nb.id = b where 100 * common >= 80 * (na.n + nb.n - common)),
{_COMPONENTS}
select n.id as doc_id, n.n as n_shingles, c.component_id, n.id = c.component_id as kept from nodes n join component c using (id)"""

OP7 = f"""with recursive good as (
  select vec_id as id, label, [cast(x as double) for x in embedding] as v from embeddings
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
nodes as (select vec_id as id from embeddings),
edges as (select x.id as a, y.id as b from good x join good y on x.label = y.label and x.id <> y.id where list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v)) >= 0.93),
links as (select a as id, count(*) as n from edges group by a),
{_COMPONENTS}
select c.id as vec_id, coalesce(l.n, 0) as n_links, c.component_id, c.id = c.component_id as kept from component c left join links l using (id)"""

OP9 = rf"""with docs as (select doc_id, coalesce(text, '') as text from documents),
split as (
  select *, regexp_extract_all(text, '[^{_BLANK}]+') as w, [line for line in string_split(text, chr(10)) if regexp_matches(line, '[^{_BLANK}]')] as l from docs),
places as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from split),
windows as (select doc_id, i, w[i] as word, case when i + 7 <= len(w) then array_to_string(w[i : i + 7], ' ') end as g from places),
marked as (select *, g is not null and count(*) over (partition by doc_id, g) > 1 as twice, lag(word) over (partition by doc_id order by i) = word as echo from windows),
covered as (select doc_id, echo, bool_or(twice) over (partition by doc_id order by i rows between 7 preceding and current row) as again from marked),
sums as (select doc_id, count(*) filter (again) as n_repeat_words, count(*) filter (echo) as n_echo_words from covered group by doc_id),
measured as (
  select doc_id, cast(len(w) as bigint) as n_words, length(regexp_replace(text, '[{_BLANK}]+', '', 'g')) as word_chars, {_SIZE('#*$%&|<>')} as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_echo_words, 0) as n_echo_words,
    len(l) as n_lines, {_SIZE('A-Z')} as n_upper, {_SIZE('A-Za-z')} as n_letters, {_SIZE('!')} as n_exclamations
  from split left join sums using (doc_id)),
failed as (
  select *, (n_words < 20) or (100 * n_repeat_words > 30 * n_words) as base_failed,
    cast((n_words < 20)::int + 2 * (100 * n_repeat_words > 30 * n_words)::int + 4 * (100 * n_symbols > 25 * n_words)::int + 8 * (n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines)::int
      + 16 * (n_letters >= 40 and 100 * n_upper > 50 * n_letters)::int + 32 * (100 * n_exclamations > 50 * n_words)::int + 64 * (100 * n_echo_words > 30 * n_words)::int + 128 * (word_chars > 40 * n_words)::int as bigint) as failed
  from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = 0 as kept, failed from failed"""

_SQUARED = "cast(list_sum([({0}[i] - {1}[i]) * ({0}[i] - {1}[i]) for i in range(1, 65)]) as bigint)"


def _rounds(n: int) -> str:
    """Centroids c0 and assignments a0, then n times new centroids and assignments."""
    assigned = lambda r: f"a{r} as (select row, id, v, c, d from (select k.*, c{r}.c, {_SQUARED.format('k.v', f'c{r}.v')} as d, row_number() over (partition by row order by d, c) as place from k, c{r}) where place = 1)"
    steps = [assigned(0)]
    for r in range(1, n + 1):
        mean = f"select c, list(m order by i) as v from (select c, i, cast(floor(sum(v[i]) / count(*)) as bigint) as m from (select c, v, unnest(range(1, 65)) as i from a{r - 1}) group by c, i) group by c"
        steps += [f"m{r} as ({mean})", f"c{r} as (select o.c, coalesce(m.v, o.v) as v from c{r - 1} o left join m{r} m using (c))", assigned(r)]
    return ",\n".join(steps)


OP11 = f"""with numbered as (select row_number() over () as row, vec_id as id, embedding from embeddings),
k as (
  select row, id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v from numbered
  where embedding is not null and len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
c0 as (select c, v from (select v, row_number() over (order by sha256('1:' || id) nulls last, v) - 1 as c from k) where c < 16),
{_rounds(3)},
sums as (select c, cast(sum(d) as bigint) as s from a3 group by c)
select id as vec_id, cast(a3.c as integer) as cluster, d as distance, s as cluster_inertia, cast((select sum(d) from a3) as bigint) as inertia,
  sha256(array_to_string(c3.v, ',')) as centroid_sha256
from a3 join sums using (c) join c3 using (c)"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""with docs as (select row_number() over () as row, doc_id, {_TERMS} as w from documents),
whole as (select count(*) as n, sum(len(w)) as l from docs where len(w) > 0),
items as (select row_number() over () as item, item_id, unnest(list_distinct({_TERMS})) as term from benchmark),
flat as (select row, doc_id, len(w) as n, unnest(w) as term from docs),
tf as (select row, doc_id, n, term, count(*) as tf from flat where term in (select term from items) group by all),
weights as (select term, cast(floor(1000 * ln((2 * whole.n + 2) / (2 * count(*) + 1))) as bigint) as weight from tf, whole group by term, whole.n),
parts as (select row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * tf.n * whole.n) // cast(whole.l as bigint)))) as part from tf join weights using (term), whole),
scores as (select item, item_id, row, doc_id, cast(sum(part) as bigint) as score from items join parts using (term) group by all),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from scores where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10"""

SQL: dict[str, str] = {"op1_minhash": OP1, "op7_embeddings": OP7, "op9_rules": OP9, "op11_centroids": OP11, "op13_search": OP13}
