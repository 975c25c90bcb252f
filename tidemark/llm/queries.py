"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm.chat_tree import op5_reply_trees
from tidemark.llm.digest import op6_canonical_digest
from tidemark.llm.itq import op7_itq_hamming
from tidemark.llm.line_spread import ORACLE as LINE_SPREAD
from tidemark.llm.line_spread import op3_line_spread
from tidemark.llm.mixing import op2_soft_mixing
from tidemark.llm.overlap_join import op10_divide_skip
from tidemark.llm.packing import op9_best_fit_packing
from tidemark.llm.quality import op1_bradley_terry
from tidemark.llm.style_tree import op8_site_style_tree
from tidemark.llm.toxicity import op4_pattern_grammar

QUERIES = {
    "op1_bradley_terry": op1_bradley_terry,
    "op2_soft_mixing": op2_soft_mixing,
    "op3_line_spread": op3_line_spread,
    "op4_pattern_grammar": op4_pattern_grammar,
    "op5_reply_trees": op5_reply_trees,
    "op6_canonical_digest": op6_canonical_digest,
    "op7_itq_hamming": op7_itq_hamming,
    "op8_site_style_tree": op8_site_style_tree,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_divide_skip": op10_divide_skip,
}

ORACLES = {
    "op3_line_spread": LINE_SPREAD,
    "op5_reply_trees": r"""
with rows as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k
  from rows where conv_id is not null),
esc as (
  select *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#') as etext,
         replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), ': ', ':\ ') as erole
  from turns)
select conv_id, cast(count(*) as bigint) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(4 + length(erole) + 2 + length(etext) + 8) as bigint) as formatted_chars
from esc group by conv_id
""",
}
