"""Stand-in views: the driver's tables in the shapes of the jobs' inputs.

The same SQL text runs in Spark and in DuckDB. Files that the jobs read are written from these.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_facts": r"""
select b.*,
  case when m=0 then 'missing' when m in (1,2) then 'error' else 'ok' end as status,
  case when m=1 then case k%8 when 0 then 'HTTP 413: no' when 1 then 'HTTP 400: payload over the limit' when 2 then 'HTTP 400: Download multimodal file timed out'
    when 3 then 'Connection reset by peer' when 4 then 'HTTP 404: image size' when 5 then 'HTTP 400: failed to fetch the text' when 6 then 'HTTP 503: Broken pipe' else 'HTTP 400: maximum request size' end
   when m=2 then 'HTTP 429: slow down' end as error,
  case when m<3 or (k+s)%23=0 then cast(null as boolean)
       else (label='DeepFake') = ((s*13+k*7+ln*3)%10 >= 1+s%4) end as is_ai_modified,
  case when m<3 or (k+ln)%19=0 then cast(null as double) else ((k*37+s*11)%101)/100.0e0 end as confidence
from (select
  l_orderkey as k, l_suppkey as s, cast(l_linenumber as bigint) as ln,
  concat('cat', lpad(cast(l_orderkey%29 as varchar(9)),2,'0')) as category,
  case when l_orderkey%29=27 then 'hotel' when l_orderkey%29=28 then 'grabfood' else 'amazon' end as platform,
  case cast(floor(l_orderkey/203) as bigint)%8 when 0 then 'SingleImage-NoReview' when 1 then 'SingleImage-withReview'
    when 2 then 'MultiStep-NoReview' when 3 then 'MultiStep-withReview' when 4 then 'MultiImage-NoReview'
    when 5 then 'MultiImage-withReview' when 6 then 'MultiTurn-NoReview' else 'MultiTurn-withReview' end as mode,
  case when cast(floor(l_orderkey/29) as bigint)%7=0 then 'Negative' else 'DeepFake' end as label,
  case when cast(floor(l_orderkey/29) as bigint)%7=0 then null else concat('gen', cast(cast(floor(l_orderkey/29) as bigint)%7 as varchar(9))) end as generator,
  concat('Review_', cast(l_orderkey as varchar(20))) as review_id,
  1+l_orderkey%5 as num_images,
  concat('det', cast(l_suppkey%10 as varchar(9))) as detector,
  l_shipdate as written_at,
  (l_orderkey*31+l_suppkey*17+l_linenumber*7)%20 as m
 from lineitem) b
""",
    "fx_replies": r"""
select doc_id, case doc_id%12
 when 0 then concat('{"is_ai_modified": true, "confidence": 0.', cast(doc_id%90+10 as varchar(9)), ', "reason": "', said, '"}')
 when 1 then concat('```json', chr(10), '{"is_ai_modified": false, "confidence": 0.75, "reason": "clean"}', chr(10), '```')
 when 2 then 'Sure. Here it is: {"is_ai_modified": true, "confidence": "0.5", "reason": ["a"," b ",""]} Done.'
 when 3 then '{"is_ai_generated": "Yes", "confidence": 1}'
 when 4 then concat('{"is_ai_modified": "no", "reasoning": "', said, '"}')
 when 5 then '{"is_ai_modified": 1, "explanation": {"x": 1}}'
 when 6 then '{"is_ai_modified": null, "confidence": "high"}'
 when 7 then '{"is_ai_modified": true, "confidence": 0.9'
 when 8 then ''
 when 9 then concat('I cannot tell. ', said)
 when 10 then '{"is_ai_modified": false, "confidence": 0.2, "reason": "", "reasoning": "x", "per_image": [{"index": 1, "is_ai_modified": false, "confidence": 0.3, "notes": "n1"}, {"index": 2, "is_ai_modified": true, "confidence": 0.4, "notes": "n2"}]}'
 when 11 then case when doc_id%24=11 then '[1, 2]' else concat('{"is_ai_modified": false, "confidence": 0.1, "reason": "', said, '", "is_ai_modified": "yes"}') end
 end as raw_response
from (select doc_id, translate(coalesce(text, ''), concat(chr(34), chr(92), chr(10), chr(13), chr(9), chr(96)), '      ') as said from documents) t
""",
    "fx_paths": r"""
select distinct concat('cat', lpad(cast(l_orderkey%29 as varchar(9)),2,'0'),
  case when cast(floor(l_orderkey/29) as bigint)%7=0 then '/Negative' else concat('/DeepFake/gen', cast(cast(floor(l_orderkey/29) as bigint)%7 as varchar(9))) end,
  case when l_orderkey%13=0 then '' else concat('/Review_', cast(l_orderkey as varchar(20))) end,
  '/Image_', cast(l_orderkey as varchar(20)), '_0', cast(l_linenumber as varchar(9)),
  case l_linenumber%7 when 0 then '.txt' when 1 then '.JPG' when 2 then '.png' when 3 then '.gif' when 4 then '.webp' else '.jpg' end) as path
from lineitem
""",
    "fx_reviews": r"""
select source as category, concat('Review_', cast(doc_id as varchar(20))) as review_id, doc_id as num,
 case when doc_id%7=0 then '' else substr(text,1,20) end as title,
 case when doc_id%11=0 then '   ' else substr(text,21) end as body
from documents
""",
    "fx_edit_comments": r"""
select source as category, doc_id as num, concat('Image_', cast(doc_id as varchar(20)), '_0', cast(i as varchar(2)), '.jpg') as image, i as pos,
 case when (doc_id+i)%5=0 then '' when doc_id%2=0 then 'same remark' else concat('remark ', cast(i as varchar(2))) end as reviewer_comment
from documents cross join (select 1 as i union all select 2 union all select 3) x where i<=1+doc_id%3
""",
    "fx_turns": r"""
select conv_id, turn, role, text from conversations
""",
    "fx_turn_verdicts": r"""
select conv_id, turn, case when (conv_id+turn)%6=0 then null else (conv_id*7+turn*5)%3=0 end as is_ai_modified,
 case when (conv_id+turn)%6=0 then null else ((conv_id*13+turn*29)%101)/100.0e0 end as confidence,
 1+(conv_id+turn)%3 as attempts, case when conv_id%9=0 and turn=2 then 'HTTP 500: upstream' end as error,
 case when conv_id%3=0 then 'c0' when turn%4=0 then null else concat('c', cast(turn%2 as varchar(2))) end as comment
from conversations
""",
    "fx_classic": r"""
select concat('cat', lpad(cast(l_partkey%29 as varchar(9)),2,'0')) as category,
 concat('classic', cast(l_suppkey%4 as varchar(9))) as detector,
 case when l_partkey%7=0 then 'Negative' when l_partkey%2=0 then 'Deepfake' else 'DeepFake' end as folder,
 case when l_partkey%7=0 then null else concat('gen', cast(l_partkey%7 as varchar(9))) end as generator,
 l_orderkey as item_no,
 case when (l_orderkey+l_linenumber)%17=0 then null when (l_orderkey*3+l_suppkey)%5<2 then ' fake ' else 'real' end as prediction,
 case when l_orderkey%13=0 then 'n/a' else cast((l_orderkey*7+l_suppkey)%101/100.0e0 as varchar(20)) end as score
from lineitem
""",
    "fx_human_log": r"""
select user_id as evaluator, case event_id%4 when 0 then 'cat01' when 1 then 'cat02' else 'All' end as scope, event_id as seq, ts as decided_at,
  case when event_type='error' then 'undo' else 'submit' end as action,
  case when event_type='error' then null else cast(regexp_extract(props,'([0-9]+)',1) as bigint) end as image_no,
  case when event_type='error' then null when event_type in ('click','view') then 'real' else 'fake' end as choice
from events
""",
    "fx_human_images": r"""
select p_partkey as image_no, concat('cat', lpad(cast(p_partkey%4 as varchar(9)),2,'0')) as category, case when p_partkey%7=0 then 'real' else 'fake' end as true_label from part
""",
}
#: Category to platform, a dimension.
PLATFORMS = [(f"cat{i:02d}", {27: "hotel", 28: "grabfood"}.get(i, "amazon")) for i in range(29)]
TABLES = ["lineitem", "documents", "conversations", "events", "part"]

DETECTORS = [f"det{i}" for i in range(10)]
GENERATORS = [f"gen{i}" for i in range(1, 7)]
CLASSIC = [f"classic{i}" for i in range(4)]
MODES = [f"{a}-{b}" for a in ("SingleImage", "MultiStep", "MultiImage", "MultiTurn") for b in ("NoReview", "withReview")]


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view over sf_dir's tables, or over the given ones (streams)."""
    for t in TABLES:
        if re.search(rf"from {t}\b", VIEWS[name]):
            table = tables[t] if tables and t in tables else base(spark, sf_dir, t)
            table.createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])
