"""Common table expressions that the oracles share, in DuckDB's SQL."""

#: Elements of documents as blocks of sections.
BLOCKS = """
lines as (
  select doc_id, i - 1 as elem_index, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as text, contains(line, '|') as piped, length(line) as n
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
el as (
  select doc_id, elem_index, text, case when piped then 'Table' when n <= 40 then 'Title' else 'NarrativeText' end as elem_type, cast(floor(elem_index / 10) as int) + 1 as page
  from lines where text <> ''),
grouped as (select *, sum((elem_type = 'Title')::int) over (partition by doc_id order by elem_index rows unbounded preceding) as g from el),
numbered as (select *, cast(dense_rank() over (partition by doc_id order by g) as int) as section_no from grouped),
ordered as (select *, cast(row_number() over (partition by doc_id, section_no order by elem_index) as int) as ord from numbered),
b as (
  select doc_id, section_no, doc_id || '_doc#2024-01-01#' || doc_id || '_' || lpad(cast(section_no as varchar), 4, '0') as section_id, elem_index, ord, page, text,
    case elem_type when 'Title' then 'title' when 'Table' then 'table' else 'paragraph' end as type,
    case elem_type when 'Title' then 'title_t' when 'Table' then 'tbl_' else 'para_p' end || ord as elem_id
  from ordered)"""

SECTIONS = (
    BLOCKS
    + """,
s as (
  select doc_id, section_no, section_id, coalesce(max(text) filter (ord = 1 and type = 'title'), '文档内容') as title, min(page) as page_start, max(page) as page_end,
    string_agg(text, chr(10) order by ord) as full_text, cast(count(*) as int) as n_blocks
  from b group by all)"""
)

CATALOGUE = """
cat as (
  select d.doc_id as id, 'doc_' || d.doc_id || '.' || d.lang as filename, d.lang as file_type, d.n_chars as file_size, timestamp '2024-01-01' + d.doc_id * interval 1 minute as upload_time,
    case when l.quality = 1 then 'completed' when l.quality = 0 then 'extract_failed' else 'pending' end as process_status, sha256(d.text) as content_hash, d.source as metadata
  from documents d left join labels l using (doc_id))"""


def ENCODED(name: str, source: str, key: str, text: str, columns: str = "") -> str:  # noqa: N802
    """Tables that end in `name` (key, vector): the hashed vectors of a table's texts."""
    return f"""{name}_g as (select {key}, list_transform(range(1, greatest(length(x) - 2, 1) + 1), lambda i: (ord(x[i:i]) * 961 + case when length(x) > 1 then ord(x[i+1:i+1]) else 0 end * 31 + case when length(x) > 2 then ord(x[i+2:i+2]) else 0 end) % 64) as g from (select {key}, {text} as x from (select {columns or "*"} from {source})) where x <> ''),
{name}_c as (select {key}, list_transform(range(64), lambda k: cast(len(list_filter(g, lambda y: y = k)) as double)) as c from {name}_g),
{name} as (select {key}, list_transform(c, lambda y: y / sqrt(list_dot_product(c, c))) as vector from {name}_c)"""
