"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import audit, chat, decontaminate, jaccard, langid, linededup, mixing, prefix_trie, quality, token_count, token_output, toxicity, urls

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Links of sets in any table ``s (doc_id, g)`` of shingle lists, and the classes they make.
CLASSES = """
, u as (select doc_id, unnest(g) as x, len(g) as n from s)
, l as (select a.doc_id as a, b.doc_id as b from u a join u b on a.x = b.x and a.doc_id < b.doc_id
        group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*)))
, e as (select a, b from l union all select b, a from l)
, r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
, c as (select a as doc_id, min(least(a, b)) as component_id from r group by a)
"""

OP2_SQL = rf"""
with recursive w as (select doc_id, {WORDS.format(LOWER)} as w from documents)
, s as (select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as g from w)
{CLASSES}
select s.doc_id, len(s.g)::bigint as n_shingles, coalesce(c.component_id, s.doc_id) as component_id from s left join c using (doc_id)
"""

OP3_SQL = rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null)
, w as (select *, {WORDS.format('line')} as ws from l where regexp_matches(line, '[^\x20\x09-\x0D]'))
, f as (select array_to_string(ws, ' ') as norm, any_value(ws) as ws, len(any_value(ws)) as n, min((doc_id, line_no)) as first from w group by 1)
, g as (select * from f where n >= 5)
, d as (select norm, n, first, i, array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ') as s from (select *, unnest(range(1, n + 1)) as i from g))
, m as (select s, i, n, min(first) as of from d group by all)
, p as (select d.first as first, m.of as of from d join m using (s, i, n) where m.of < d.first
        union all select g.first, d.first from g join d on g.norm = d.s where d.first < g.first
        union all select d.first, g.first from d join g on g.norm = d.s where g.first < d.first)
, near as (select first, min(of) as of from p group by first)
, gone as (select w.doc_id, w.line_no from w join f on f.norm = array_to_string(w.ws, ' ') left join near using (first)
           where near.of is not null or f.first < (w.doc_id, w.line_no))
, kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.line_no) as text from l left join gone using (doc_id, line_no) where gone.doc_id is null group by 1)
, n as (select doc_id, count(*) as n_dropped from gone group by 1)
select d.doc_id, coalesce(n.n_dropped, 0)::bigint as n_dropped, case when d.text is not null then length(coalesce(kept.text, '')) end::bigint as kept_chars,
       case when d.text is not null then md5(coalesce(kept.text, '')) end as kept_md5
from documents d left join kept using (doc_id) left join n using (doc_id)
"""

STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
MEASURES = {"n_words": ("n_words", "1"), "mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "stop_word_ratio": ("n_stop", f"(n_words - {quality.FREE_WORDS})")}
VERDICT = " and ".join(f"{MEASURES[m][0]} {op} {MEASURES[m][1]} * {x}::double" for m, lo, hi in quality.RULES for op, x in ((">=", lo), ("<=", hi)) if x is not None)

OP4_SQL = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents)
, w as (select doc_id, text, {WORDS.format('text')} as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t)
, g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w))
, r as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 5)) as k from (select *, count(*) over (partition by doc_id, x) as c from g) where c > 1) group by 1)
, m as (select w.doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls) as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(r.n, 0)::bigint as n_repeat_words, len(list_filter(w, lambda x: lower(trim(x, '.,;:!?')) in ({STOPS}))) as n_stop from w left join r using (doc_id))
, b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {VERDICT} as kept from b
"""

#: Documents are taken from the front while they fit what is missing, and again from those left that are no larger than what is then missing.
ROUNDS = "\n, z00 as (select *, false as in00, rest as m0 from x)" + "".join(
    f"""
, y{r} as (select *, size > 0 and not {"in00" if r == 0 else f"in{r - 1}"} and size <= m{r} as may{r} from {"z00" if r == 0 else f"z{r - 1}"})
, s{r} as (select *, may{r} and sum(size) over (partition by source, may{r} order by before rows unbounded preceding) <= m{r} as new{r} from y{r})
, z{r} as (select *, {"in00" if r == 0 else f"in{r - 1}"} or new{r} as in{r}, m{r} - coalesce(sum(case when new{r} then size end) over (partition by source), 0) as m{r + 1} from s{r})"""
    for r in range(mixing.ROUNDS + 1)
)
OP7_SQL = rf"""
with d as (select doc_id, source, coalesce(len({WORDS.format('text')}), 0)::bigint as size, coalesce(md5(doc_id::varchar), md5(coalesce(text, ''))) as k, md5(coalesce(text, '')) as tie from documents)
, s as (select source, sum(size)::bigint as source_size from d group by 1)
, w as (select *, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, [-0.8, 0.0, 0.8][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as slope, 3 * source_size as cap from s)
, c as (select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as before_cap, sum(weight) over (o rows between current row and unbounded following) as from_weight,
        sum(source_size) over () as total from w window o as (order by cap::double / weight, source nulls last))
, v as (select *, (total - before_cap)::double / from_weight::double as level0 from c)
, t as (select source, source_size, slope, least((select coalesce(min_by(level0, (cap::double / weight, source is null, source)), 0.0) from v where level0 * weight <= cap) * weight, cap::double) as target from v)
, p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from t)
, q as (select *, floor(target)::bigint - passes * source_size as rest from p)
, x as (select d.*, q.source_size, q.target, q.slope, q.passes, q.rest, (coalesce(sum(d.size) over (partition by d.source order by k, d.doc_id nulls first, size, tie rows between unbounded preceding and 1 preceding), 0))::bigint as before from d join q on d.source is not distinct from q.source)
{ROUNDS}
, z as (select *, m{mixing.ROUNDS + 1} as missing, in{mixing.ROUNDS} as front from z{mixing.ROUNDS})
, f as (select *, row_number() over (partition by source, size > 0 and not front and abs(missing - size) < missing order by abs(missing - size), k, doc_id, size, tie, before) as nth from z)
, a as (select *, case when size = 0 then 0 else passes + case when front or (not front and abs(missing - size) < missing and nth = 1) then 1 else 0 end end as copies from f)
select doc_id, size, source_size, target, (copies * size)::bigint as taken,
       case when copies > 0 then case when slope = 0 then least(1.0, before / target) else (-(1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * least(1.0, before / target))) / (2 * slope) + 0.0 end end as position
from a
"""

ESCAPED = r"length({0}) + length({0}) - length(replace(replace(replace({0}, '\', ''), '<', ''), '[', ''))"
OP8_SQL = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
, a as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
        coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
        sum({ESCAPED.format('role')} + {ESCAPED.format('text')} + {len(chat.TURN) + len(chat.END) + 1}) as formatted_chars from t group by 1)
select conv_id, n_turns::bigint as n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars::bigint as formatted_chars from a
"""

#: Unsigned crc32 of ASCII text, a bit at a time; 256 stands for no new byte.
CRC32 = """xor(4294967295::ubigint, list_reduce(list_transform(range(8 * len({0})), lambda k: case when k % 8 = 0 then ord(substr({0}, k // 8 + 1, 1))::ubigint else 256::ubigint end),
    lambda a, b: xor(xor(a, b % 256::ubigint) >> 1, 3988292384::ubigint * (xor(a, b % 256::ubigint) & 1::ubigint)), 4294967295::ubigint))"""

OP11_SQL = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
           from conversations where conv_id is not null)
, n as (select conv_id, count(*) as n from t group by 1)
, c as (select n.conv_id, n.n, n.conv_id - n.conv_id % 100 as base, ({CRC32.format("n.conv_id::varchar")} % 6)::bigint as h from n)
, d as (select c.*, least(c.h, coalesce(n.n, 0)) as taken, least(c.h, coalesce(n.n, 0)) + greatest(c.n - c.h, 0) as total from c left join n on n.conv_id = c.base)
, r as (select conv_id, total, pos - h + taken as depth, role, text from t join d using (conv_id) where pos > h
        union all select d.conv_id, total, pos, role, text from d join t on t.conv_id = d.base where pos <= h)
, p as (select conv_id, total, depth, length(text) as chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' order by depth) over (partition by conv_id order by depth)) as k from r
        union all select conv_id, total, 0, 0, '' from d)
, q as (select *, lag(k) over (partition by conv_id order by depth) as up from p)
, m as (select depth, k, min(up) as up, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(chars) as own, sha256(coalesce(string_agg(case when depth = total then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from q group by 1, 2)
, ch as (select up as k, depth - 1 as depth, count(*) as n_children from m where depth > 0 group by 1, 2)
, f as (select m.*, coalesce(n_children, 0) as n_children from m left join ch using (depth, k))
, s as (select q.depth, q.k, sum(f.own) as saved, count(*) filter (f.n_children = 0) as n_leaves from f join q on q.conv_id = f.conv_id and q.depth <= f.depth group by 1, 2)
select f.conv_id, f.depth::bigint as depth, u.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, f.ends_sha256
from f join s using (depth, k) left join m u on u.depth = f.depth - 1 and u.k = f.up
"""

OP13_SQL = rf"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, {WORDS.format("coalesce(text, '')")} as w from documents)
, e as (select text, min(doc_id) as first from t group by 1)
, l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1)
, m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, len(w) < 100 as "A", 100 * len(list_distinct(w)) < 80 * len(w) as "B", 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) as "C",
        regexp_matches(text, '[#$%&*|]') as "D", coalesce(doc_id > first, false) as "E" from t join e using (text) left join l using (doc_id))
, h as (select part, concat(case when "A" then 'A' else '' end, case when "B" then 'B' else '' end, case when "C" then 'C' else '' end, case when "D" then 'D' else '' end, case when "E" then 'E' else '' end) as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by 1, 2)
, x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x)
, o as (select a.x || b.x || c.x || d.x || e.x as o from x a, x b, x c, x d, x e where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x)
, s as (select o, step, o[step] as f, o[:step - 1] as before from o, (select unnest(range(1, 6)) as step))
, r as (select part, o, step, f, n, good, toxic, contains(fails, f) as bad, fails = f as only_one, length(translate(fails, before, '')) < length(fails) as gone from h, s)
, g as (select part, o as filter_order, step, f, sum(case when not gone and not bad then n else 0 end) as kept, sum(case when bad and not gone then n else 0 end) as removed, sum(case when bad and gone then n else 0 end) as redundant,
        sum(case when only_one then n else 0 end) as unique_fails, sum(case when bad and not gone then good else 0 end) as good_lost, sum(case when bad and not gone then toxic else 0 end) as toxic_lost from r group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       sum(removed) over (partition by part, f)::bigint as shapley from g
"""


def queries() -> dict:
    return {
        "op1_token_output": token_output.op1_token_output,
        "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
        "op3_line_dedup": linededup.op3_line_dedup,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
        "op7_source_mixing": mixing.op7_source_mixing,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_url_filters": urls.op9_url_filters,
        "op10_token_count": token_count.op10_token_count,
        "op11_conversation_trie": prefix_trie.op11_conversation_trie,
        "op12_language_id": langid.op12_language_id,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op7_source_mixing": OP7_SQL, "op8_chat_formatting": OP8_SQL, "op11_conversation_trie": OP11_SQL, "op13_filter_audit": OP13_SQL}
