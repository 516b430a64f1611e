"""The full scoring of texts as SQL, written from the rules: phrases one after the other, then words in their order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from tidewright.functions import wordlists as W


def values(pairs: Mapping[str, float], name: str, columns: str) -> str:
    """A table of words or phrases with a number each."""
    rows = ", ".join("('" + k.replace("'", "''") + f"', cast({v} as double))" for k, v in pairs.items())
    return f"{name}({columns}) as (values {rows})"


def _listed(words: Sequence[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: Whitespace that separates words, as Java's \s knows it.
_SPACE = r"[ \t\n\x0b\x0c\r]"
#: Whitespace of every kind, for stripping.
ALL_SPACE = ("e' \\t\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f' || " + " || ".join(
    f"chr({c})" for c in (133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))


def scored(source: str, words: Mapping[str, float], phrases: Mapping[str, float], weight: float = 0.3) -> str:
    """Tables up to ``scored(id, base, adjustment, n_phrases, score)`` of a table with id and text; needs WITH RECURSIVE."""
    numbered = ", ".join(f"({i + 1}, '{p}', cast({v} as double))" for i, (p, v) in enumerate(phrases.items()))
    return f"""
{values(words, 'lexicon', 'word, v')},
phrase_table(k, phrase, a) as (values {numbered}),
fold(k, id, text, adj, hits) as (
  select 0, id, text, cast(0 as double), 0 from {source} s where exists (select 1 from phrase_table where contains(lower(s.text), phrase))
  union all
  select k + 1, id, case when hit then regexp_replace(text, phrase, repeat(' ', length(phrase)), 'gi') else text end,
         adj + case when hit then case when turned then -a else a end else 0 end, hits + cast(hit as int)
  from (select f.*, p.phrase, p.a, contains(lower(f.text), p.phrase) as hit,
          list_has_any(list_reverse(regexp_extract_all(split_part(lower(f.text), p.phrase, 1), '[a-z]+'))[1:6], {_listed(W.NEGATORS)}) as turned
        from fold f join phrase_table p on p.k = f.k + 1)),
blanked as (select id, text, adj, hits from fold where k = {len(phrases)}
  union all select id, text, 0, 0 from {source} where id not in (select id from fold)),
pieces as (select id, unnest(ws) as w, generate_subscripts(ws, 1) as i
  from (select id, regexp_split_to_array(trim(text, {ALL_SPACE}), '{_SPACE}+') as ws from blanked)),
bare as (select id, i, case when length(b) <= 2 then w else b end as w from (select *, regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') as b from pieces)),
toks as (select id, w, lower(w) as l, row_number() over (partition by id order by i) as i from bare where w <> ''),
known as (select t.*, coalesce(v, 0) as v, coalesce(list_contains({_listed(W.NEGATORS)}, l) or l like '%n''t', false) as turns,
    case when list_contains({_listed(W.NEGATORS)}, l) or l like '%n''t' then 0 when list_contains({_listed(W.INTENSIFIERS)}, l) then {W.INTENSITY}
         when list_contains({_listed(W.DAMPENERS)}, l) then -{W.INTENSITY} else 0 end as scale, w = upper(w) and w <> lower(w) as capital
  from toks t left join lexicon on l = word),
around as (select *, case when v > 0 then 1.0 else -1.0 end as side, bool_or(capital) over (partition by id) and not bool_and(capital) over (partition by id) as mixed,
    coalesce(lag(scale, 1) over o, 0) + coalesce(lag(scale, 2) over o, 0) * 0.95 + coalesce(lag(scale, 3) over o, 0) * 0.9 as scales,
    coalesce(lag(turns, 1) over o, false) or coalesce(lag(turns, 2) over o, false) or coalesce(lag(turns, 3) over o, false) as turned,
    min(case when l = 'but' then i end) over (partition by id) as but
  from known window o as (partition by id order by i)),
summed as (select id, sum(case when v = 0 then 0 else
      (v + case when mixed and capital then side * {W.CAPITALS} else 0 end + scales * side) * case when turned then {W.NEGATION} else 1 end
      * case when but is null or i = but then 1 when i < but then 0.5 else 1.5 end end) as s from around group by id),
marks as (select id, adj, hits, coalesce(s, 0) as s, least(length(text) - length(replace(text, '!', '')), 4) * {W.EXCLAMATION}
    + case when asks > 3 then {W.QUESTIONS} when asks > 1 then asks * {W.QUESTION} else 0 end as loud
  from (select *, length(text) - length(replace(text, '?', '')) as asks from blanked) left join summed using (id)),
total as (select *, s + case when s > 0 then loud when s < 0 then -loud else 0 end as t from marks),
parts as (select id, hits, t / sqrt(t * t + {W.ALPHA}) as base, case when hits > 0 then adj / hits * {weight} else 0 end as adjustment from total),
scored as (select id, base, adjustment, hits as n_phrases, greatest(-1, least(1, base + adjustment)) as score from parts)"""
