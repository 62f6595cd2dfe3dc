"""Queries: mentions, references and captions in the driver's documents; patterns of the invented prose are added, so that rules are met."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import span_rules as R
from papyrine.operators import spans as S
from papyrine.plans.registry import register
from papyrine.sources.tables import read, spread

MENTIONS: R.Patterns = (*R.MENTIONS, ("figure", r"(?:that|pour|with)\s+(th[a-z]+|[0-9]+)"), ("table", r"(?:of|de)\s+(?:that|pour|with)\s+[a-z]+"), ("dataset", r"th[a-z]+"))
REFERENCES: R.Patterns = (*R.SUPPLEMENTS, ("phone", r"([0-9]{3})[-. ][0-9]{4}"), ("phrase", r"(?:that|pour)\s+([a-z]+)"))
STARTS = r"\s(?:the|of|que|die)\s+([a-z]{2,6})\s*\."
BARE = r"\s(?:und|los)\s+([a-z]{2,6})"


def _texts(spark, sf):
    return spread(read(spark, sf, "documents").select("doc_id", "text"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(i: int, pattern: str) -> str:
    """Matches of a pattern with their places, which follow from the pieces between them."""
    p = _q("(?i)" + pattern)
    return f"""select doc_id, {i} as i, m[j] as found, list_sum([len(x) for x in pieces[1:j]]) + coalesce(list_sum([len(x) for x in m[1:j - 1]]), 0) as start from
(select doc_id, m, pieces, unnest(range(1, len(m) + 1)) as j from (select doc_id, regexp_extract_all(text, {p}, 0) as m, string_split_regex(text, {p}) as pieces from documents))"""


_KINDS = " ".join(f"when {i} then '{kind}'" for i, (kind, _) in enumerate(MENTIONS))


@register("tx13_mention_spans", f"""with s as materialized ({" union all ".join(_spans(i, p) for i, (_, p) in enumerate(MENTIONS))}),
p as materialized (select doc_id, i, found, start::int as start, (start + len(found))::int as stop from s)
select doc_id, case i {_KINDS} end as kind, start, stop as "end", trim(found) as found from p where not exists (select 1 from p q where q.doc_id = p.doc_id and q.i < p.i and q.start <= p.start and q.stop >= p.stop)""")
def tx13(spark, sf):
    """Mentions of several patterns with their places; one inside an earlier pattern's is left out."""
    return S.mentions(_texts(spark, sf), "doc_id", "text", rules=MENTIONS, context=False).select("doc_id", "kind", "start", "end", "found")


#: RE2 has no look-behind; what stands before the word is then part of the match, which is not compared.
_RE2 = {r"(?:^|(?<=[\s(]))": r"(?:^|[\s(])"}


def _numbers(kind: str, pattern: str) -> str:
    for old, new in _RE2.items():
        pattern = pattern.replace(old, new)
    group = 1 if "(" in pattern.replace("(?:", "") else 0
    numbers = f"[trim(x) for x in regexp_extract_all(text, {_q('(?i)' + pattern)}, 1)]" if group else f"['' for x in regexp_extract_all(text, {_q('(?i)' + pattern)}, 0)]"
    return f"select doc_id, '{kind}' as ref_type, unnest(list_distinct({numbers})) as number from documents"


@register("tx14_references", " union all ".join(_numbers(k, p) for k, p in REFERENCES))
def tx14(spark, sf):
    return S.supplement_references(_texts(spark, sf), "doc_id", "text", rules=REFERENCES).select("doc_id", "ref_type", "number")


_STOPS = _q("(?is)(?:" + "|".join(f"(?:{p})" for p in R.CAPTION_STOPS["figure"]) + ").*$")
_TX15 = f"""with s as (select doc_id, text, [trim(x) for x in regexp_extract_all(text, {_q("(?i)" + STARTS)}, 1)] as n, regexp_extract_all(text, {_q("(?i)" + STARTS)}, 0) as m, string_split_regex(text, {_q("(?i)" + STARTS)}) as pieces from documents where text <> ''),
e as (select doc_id, n[j] as number, rtrim(trim(m[j], ' ' || chr(10) || chr(9)), '.') as label, j, case when j = len(n) then substr(pieces[j + 1], 1, {R.MOST_CAPTION}) else pieces[j + 1] end as raw from (select *, unnest(range(1, len(n) + 1)) as j from s)),
o as (select *, row_number() over (partition by doc_id, upper(number) order by j) as copy from e),
c as (select doc_id, number, label, trim(regexp_replace(regexp_replace(trim(raw, ' ' || chr(10) || chr(9)), {_STOPS}, ''), '\\s+', ' ', 'g')) as caption from o where copy = 1),
k as (select * from c where length(caption) >= {R.LEAST_CAPTION}),
b as (select doc_id, unnest(list_distinct(regexp_extract_all(text, {_q("(?i)" + BARE)}, 1))) as number from documents where doc_id not in (select doc_id from k))
select doc_id, label, number, substr(caption, 1, {R.MOST_CAPTION}) as caption, case when length(caption) < {R.FAIR_CAPTION} then 'low' when length(caption) < {R.GOOD_CAPTION} then 'medium' else 'high' end as quality, 'plain_text_caption' as source from k
union all select doc_id, 'Figure ' || number, number, '', 'none', 'reference_only' from b"""


@register("tx15_captions", _TX15)
def tx15(spark, sf):
    """Captions of all documents, or their bare references."""
    return S.captions(_texts(spark, sf), "doc_id", "text", "figure", starts=STARTS, references=BARE).select("doc_id", "label", "number", "caption", "quality", "source")
