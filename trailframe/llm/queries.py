"""Registered queries of the text operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trailframe.llm.conversation_repair import damaged, repair_conversations
from trailframe.llm.exact_dedup import exact_dedup
from trailframe.llm.html_text import main_text
from trailframe.llm.language_id import identify
from trailframe.llm.mixing import mix_sources
from trailframe.llm.packing import pack
from trailframe.llm.quality import quality
from trailframe.llm.secret_scan import scan_report, secret_spans
from trailframe.llm.sharding import assign_shards
from trailframe.llm.simhash import near_dedup
from trailframe.llm.token_binary import token_files
from trailframe.llm.token_counts import token_counts
from trailframe.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("copies")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(_table(spark, sf_dir, "conversations")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return scan_report(secret_spans(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_token_binary": op5_token_binary,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_secret_scan": op12_secret_scan,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_BLANKS = r"[\x20\x09-\x0D]"


def _edit(state: str, cost: str, letter: str, line: str) -> str:
    """A state ``cost audit chr(1) text`` after one more edit; null if the state cannot be reached."""
    return (
        f"lpad(cast(cast(substr({state}, 1, 8) as bigint) + {cost} as varchar), 8, '0') "
        f"|| substr({state}, 9, strpos({state}, chr(1)) - 9) || '{letter}' || substr({state}, strpos({state}, chr(1))) || {line}"
    )


def _repair_sql() -> str:
    """One row after the other, with the least state per place of the pattern (z start, s, u, a)."""
    user, helper = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

    def keep(state: str, initial: str) -> str:
        return f"case when not gone and initial = '{initial}' then {_edit(state, 'cut', 'K', 'chr(10) || line')} end"

    def rerole(state: str, role: str) -> str:
        return f"case when not gone then {_edit(state, '3 + cut', 'R', f'{role} || text')} end"

    def drop(state: str) -> str:
        return _edit(state, "4", "D", "''")

    def insert(state: str, role: str) -> str:
        return _edit(state, "3", "I", role)

    def least(*options: str) -> str:
        return "list_min([" + ", ".join(options) + "])"

    inserted = f"""z, s, {least('u', insert('z', user), insert('s', user), insert('a', user))} as u,
         {least('a', insert('u', helper))} as a"""
    return rf"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_reduce(flatten(list_transform(
             string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''),
             lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda c, e: case when e >= 0 then xor(c, e)
                             else xor(c >> 1, 3988292384 * (c & 1)) end, 4294967295::bigint) as crc
  from conversations),
kinds as (select *, xor(crc, 4294967295::bigint) % 20 as kind from named),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from kinds where kind <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text), copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as seen,
         substr(role, 1, 1) as initial, regexp_replace(text, '{_BLANKS}+$', '') as bare
  from damaged),
faults as (
  select *, case when bare = '' then 'blank' when seen then 'duplicate'
                 when right(bare, 1) not in ('.', '!', '?') then 'truncated' end as fault,
         lag(initial) over (partition by conv_id order by i) || initial as pair
  from placed),
facts as (
  select conv_id, i, initial, text, role || ':' || text as line, coalesce(fault in ('blank', 'duplicate'), false) as gone,
         case when fault = 'truncated' then 3 else 0 end as cut from faults),
states as (
  select conv_id, 0 as i, '00000000' || chr(1) as z, cast(null as varchar) as s,
         '00000003I' || chr(1) || {user} as u, '00000006II' || chr(1) || {user} || {helper} as a
  from (select distinct conv_id from conversations)
  union all
  select conv_id, i, {inserted} from (select conv_id, i, {inserted} from (
    select q.conv_id, f.i, {drop('z')} as z, {least(drop('s'), keep('z', 's'))} as s,
           {least(drop('u'), *[x for p in 'zsa' for x in (keep(p, 'u'), rerole(p, user))])} as u,
           {least(drop('a'), keep('u', 'a'), rerole('u', helper))} as a
    from states q join facts f on q.conv_id is not distinct from f.conv_id and f.i = q.i + 1))),
ends as (
  select conv_id, arg_max({least('z', 'a')}, i) as best from states group by conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id)
select e.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       cast(substr(best, 1, 8) as bigint) as cost, substr(best, 9, strpos(best, chr(1)) - 9) as audit,
       sha256(substr(best, strpos(best, chr(1)) + 2)) as repaired_sha256
from ends e left join counts c on e.conv_id is not distinct from c.conv_id
"""


ORACLES: dict[str, str] = {
    "op1_exact_dedup": rf"""
with plain as (
  select doc_id, length(coalesce(text, '')) as n_points,
         regexp_replace(coalesce(text, ''), '{_BLANKS}', '', 'g') as plain
  from documents),
ranked as (
  select doc_id, n_points, plain,
         first_value(doc_id) over g as keep_id,
         count(*) over (partition by plain) as group_size,
         row_number() over g as n
  from plain window g as (partition by plain order by n_points desc, doc_id nulls last))
select doc_id, keep_id, group_size, n = 1 as kept, sha256(plain) as text_sha256 from ranked
""",
    "op3_quality_rules": rf"""
with docs as (
  select doc_id, source, coalesce(text, '') as text from documents),
split_up as (
  select doc_id, source, text, md5(text) as md5,
         list_filter(string_split_regex(text, '{_BLANKS}+'), lambda x: x <> '') as words,
         string_split(text, chr(10)) as lines
  from docs),
windows as (
  select md5, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
  from (select distinct md5, words, unnest(range(1, len(words) - 1)) as i from split_up)),
repeated as (
  select md5, i from windows qualify count(*) over (partition by md5, w) > 1),
repeat_words as (
  select md5, count(distinct i + d) as n from repeated, (select unnest([0, 1, 2]) as d) group by md5),
texts as (
  select distinct source, md5, words,
         list_filter(list_transform(lines, lambda x: lower(trim(regexp_replace(x, '{_BLANKS}+', ' ', 'g')))),
                     lambda x: x <> '') as lines
  from split_up),
line_rows as (
  select source, md5, line, sum(length(line) - length(replace(line, ' ', '')) + 1) as n
  from (select source, md5, unnest(lines) as line from texts) group by source, md5, line),
hits as (
  select * from line_rows qualify count(*) over (partition by source, line) > 25),
depleted as (
  select t.source, t.md5, t.words
  from (select source, md5, sum(n) as n from hits group by source, md5) h
  join texts t on t.source is not distinct from h.source and t.md5 = h.md5 where 100 * h.n > 70 * len(t.words)),
shingles as (
  select distinct source, md5,
         cast('0x' || substr(md5(lower(array_to_string(words[i:i + 4], ' '))), 1, 15) as bigint) as w
  from (select *, unnest(range(1, len(words) - 3)) as i from depleted)),
counted as (
  select *, count(*) over (partition by source, w) as texts from shingles),
shares as (
  select source, md5, count(*) as n, count(*) filter (texts > 1) as shared,
         count(*) filter (texts between 2 and 25) as rare, min(w) filter (texts between 2 and 25) as rare_name,
         min(w) filter (texts > 25) as common_name
  from counted group by source, md5),
names as (
  select source, md5, cast(case when 9 * rare >= n then rare_name else common_name end as varchar) as name
  from shares where 9 * shared >= 8 * n),
frequent as (
  select h.source, h.line
  from hits h left join names n on h.source is not distinct from n.source and h.md5 = n.md5
  group by h.source, h.line having count(distinct coalesce(n.name, h.md5)) > 25),
lost as (
  select h.source, h.md5, sum(h.n) as lost
  from hits h join frequent f on h.source is not distinct from f.source and h.line = f.line
  group by h.source, h.md5),
facts as (
  select s.doc_id, cast(len(words) as bigint) as n_words,
         cast(length(regexp_replace(text, '{_BLANKS}', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) -
              len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint)
           as n_dup_lines,
         coalesce(r.n, 0) as n_repeat_words, cast(coalesce(l.lost, 0) as bigint) as lost_words
  from split_up s left join repeat_words r on s.md5 = r.md5
  left join lost l on s.md5 = l.md5 and s.source is not distinct from l.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_words <= 70 * n_words as kept,
       lost_words
from facts
""",
    "op7_mixing": rf"""
with rows as (
  select doc_id, source,
         cast(len(list_filter(string_split_regex(coalesce(text, ''), '{_BLANKS}+'), lambda x: x <> '')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as h
  from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from rows group by source),
weighed as (
  select *, ([3.0, 1.0, 2.0]::double[])[1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from sources),
limits as (
  select *, 2.0::double * source_size as lim, (2.0::double * source_size) / weight as ratio,
         sum(source_size) over () * 1.5::double as budget from weighed),
levels as (
  select *, (budget - coalesce(sum(lim) over (order by ratio, source nulls last
                               rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level
  from limits),
targets as (
  select source, source_size,
         least(lim, coalesce(max(level) filter (level <= ratio) over () * weight, lim)) as target from levels),
plan as (
  select *, case when target >= source_size then 1 else 0 end as base,
         case when target >= source_size then target - source_size else target end as rest from targets),
sums as (
  select r.source, r.h, sum(r.size) as words from rows r group by r.source, r.h),
running as (
  select s.source, s.h, s.words, sum(s.words) over (partition by s.source order by s.h) as upto, p.rest
  from sums s join plan p on s.source is not distinct from p.source),
cuts as (
  select source, min_by(case when upto - rest < rest - (upto - words) then h + 1 else h end, h) as cut
  from running where upto > rest group by source)
select r.doc_id, r.size, p.source_size, p.target,
       cast(r.size * (p.base + case when c.cut is null or r.h < c.cut then 1 else 0 end) as bigint) as taken
from rows r join plan p on r.source is not distinct from p.source
left join cuts c on r.source is not distinct from c.source
""",
    "op11_conversation_repair": _repair_sql(),
}
