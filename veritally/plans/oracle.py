"""The same results in SQL, for DuckDB over the driver's tables."""

from __future__ import annotations

import re

from veritally.functions.text import CONNECTION_DROPPED, FETCH_FAILED, TOO_LARGE
from veritally.functions.verdicts import YES
from veritally.plans.fixtures import DETECTORS, GENERATORS, MODES, VIEWS
from veritally.plans.queries import MANY, ONE, TEMPLATES, VARIANTS

ORACLE_SQL: dict[str, str] = {}
CTES = {name: sql.strip() for name, sql in VIEWS.items()}
CTES["f"] = "select *, case when label = 'Negative' then 'Negative' else 'DeepFake/' || generator end as bucket, review_id as ident from fx_facts"
CTES["latest"] = "select * from f qualify row_number() over (partition by mode, category, bucket, ident, detector order by written_at desc, ln desc, s desc) = 1"
CTES["jobs"] = "select mode, category, bucket, ident, max(label) as label, max(generator) as generator, max(num_images) as num_images from f group by all"
CTES["p"] = """select path, string_split(path, '/') as a, string_split(path, '/')[1] as category, string_split(path, '/')[2] as label, array_to_string(string_split(path, '/')[3:], '/') as rest from fx_paths"""
CTES["b"] = """select path, category, label, case when label = 'DeepFake' and len(string_split(rest, '/')) > 1 then 'DeepFake/' || string_split(rest, '/')[1] else label end as bucket,
 case when label = 'DeepFake' and len(string_split(rest, '/')) > 1 then string_split(rest, '/')[1] end as generator,
 case when label = 'DeepFake' and len(string_split(rest, '/')) > 1 then array_to_string(string_split(rest, '/')[2:], '/') else rest end as rel from p"""
CTES["images"] = "select * from b where lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ('jpg', 'jpeg', 'png', 'webp', 'bmp', 'gif')"
CTES["rj"] = "select category, bucket, split_part(rel, '/', 1) as review_id, max(label) as label, max(generator) as generator, count(*) as num_images, md5(string_agg(path, '|' order by path)) as images_md5 from images where len(string_split(rel, '/')) > 1 group by 1, 2, 3"
CTES["det"] = f"select unnest({DETECTORS!r}) as detector"
CTES["labelled"] = f"""select substr(sha1(path), 1, 16) as image_id, path as rel_path, a[1] as category, a[2] as bucket, case when a[2] = 'DeepFake' then a[3] end as gen_model, a[len(a) - 1] as review_id, a[len(a)] as filename, case when a[2] = 'DeepFake' then 'fake' else 'real' end as true_label
 from p where lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ('jpg', 'jpeg', 'png', 'webp') and len(a) >= 4 and a[len(a)][1] <> '.' and a[len(a) - 1] like 'Review\\_%' escape '\\'
 and (a[2] = 'Negative' or (a[2] = 'DeepFake' and a[3] in {tuple(GENERATORS[:4])} and len(a) >= 5))"""
_text = lambda t, b: f"nullif(concat_ws('. ', nullif(trim({t}, ' \t\n\r'), ''), nullif(trim({b}, ' \t\n\r'), '')), '')"


def _counts(source: str, policy: str, several: bool) -> str:
    fake = "(label <> 'Negative')"
    ok = "(status = 'ok' and error is null)"
    counted = "(status <> '' and status <> 'missing')" if policy == "ran" else ok
    right = f"({ok} and coalesce(is_ai_modified = {fake}, false))" if policy == "ran" else f"(coalesce(is_ai_modified, false) = {fake})"
    multi = "and not (mode like 'Multi%' and coalesce(num_images, 0) < 2)" if several else ""
    return f"""select mode, category, detector, case when {fake} then generator else 'Negative' end as bucket, cast(sum(cast({right} as int)) as bigint) as correct, count(*) as total,
 sum(case when {right} then confidence end) as conf_sum, count(case when {right} then confidence end) as conf_n
 from {source} where {counted} and (label = 'Negative' or generator in {tuple(GENERATORS)}) {multi} group by all"""


def _rows(counts: str) -> str:
    of = lambda c, b: f"coalesce(sum(case when bucket = '{b}' then {c} end), 0)"
    div = lambda a, b: f"(({a}) / nullif(cast({b} as double), 0))"
    per = ", ".join(f"{div(f'correct_{g}', f'total_{g}')} as {g}_tpr, {div(f'conf_sum_{g}', f'conf_n_{g}')} as {g}_conf" for g in GENERATORS)
    wide = ", ".join(f"{of(c, b)} as {c}_{b}" for b in ["Negative", *GENERATORS] for c in ("correct", "total", "conf_sum", "conf_n"))
    tp, fakes = " + ".join(f"correct_{g}" for g in GENERATORS), " + ".join(f"total_{g}" for g in GENERATORS)
    return f"""select mode, category, detector, {div('tn', 'n')} as neg_tnr, {div('tn', 'tn + fn')} as neg_precision, {div('2 * tn', '2 * tn + fn + fp')} as neg_f1, {div('conf_sum_Negative', 'conf_n_Negative')} as neg_conf, {per},
 {div('2 * tp', '2 * tp + fp + fn')} as overall_f1, ({div('tp', 'fakes')} + {div('tn', 'n')}) / 2 as overall_bal_acc, {div('tn + tp', 'n + fakes')} as overall_acc, ({div('2 * tn', '2 * tn + fn + fp')} + {div('2 * tp', '2 * tp + fp + fn')}) / 2 as overall_macro_f1
 from (select *, correct_Negative as tn, total_Negative as n, total_Negative - correct_Negative as fp, fakes - tp as fn from (select *, {tp} as tp, {fakes} as fakes from (select mode, category, detector, {wide} from {counts} group by all)))"""


NAMES = ["neg_tnr", "neg_precision", "neg_f1", "neg_conf", *[f"{g}_{m}" for g in GENERATORS for m in ("tpr", "conf")], "overall_f1", "overall_bal_acc", "overall_acc", "overall_macro_f1"]
_round = lambda names, pre="": ", ".join(f"round({pre}{c}, 9) as {c}" for c in names)
_avg = lambda source: f"select mode, detector, {', '.join(f'avg({c}) as {c}' for c in NAMES)} from {source} group by all"
CTES["counts"] = _counts("f", "ran", True)
CTES["rows"] = _rows("counts")
CTES["macro"] = _avg("rows")
CTES["runs"] = "select * replace (mode || '/v' || (k % 5) as mode) from f"
CTES["ok_counts"] = _counts("runs", "ok_only", False)
CTES["ok_rows"] = _rows("ok_counts")
CTES["ok_macro"] = _avg("ok_rows")
CTES["cls"] = """select category, detector, coalesce(generator, 'Negative') as bucket, folder, folder <> 'Negative' as fake, coalesce(trim(prediction), '') = 'fake' as said, case when folder <> 'Negative' then try_cast(score as double) else 1 - try_cast(score as double) end as conf from fx_classic"""
CTES["cls_counts"] = """select 'SingleImage-NoReview' as mode, category, detector, bucket, cast(sum(cast(said = fake as int)) as bigint) as correct, count(*) as total, sum(case when said = fake then conf end) as conf_sum, count(case when said = fake then conf end) as conf_n
 from (select *, min(case when folder = 'Deepfake' then 0 else 1 end) over (partition by category, detector, bucket) as first, case when folder = 'Deepfake' then 0 else 1 end as sp from cls) where sp = first group by all"""
CTES["cls_rows"] = _rows("cls_counts")
CTES["cls_macro"] = _avg("cls_rows")
CTES["note"] = "select category, num, list(reviewer_comment order by pos) as comments, count(*) as n from fx_edit_comments group by 1, 2"
CTES["reply"] = r"""select doc_id, trim(case when raw_response like '```%' then regexp_replace(trim(raw_response, '`'), '^\s*json[^\n]*\n', '') else raw_response end, ' ' || chr(10)) as s from fx_replies"""
# of a repeated key the last value counts; the SQL's parser takes the first, so that goes
CTES["js"] = r"""select doc_id, case when json_valid(s) then cast(s as json) when json_valid(regexp_extract(s, '\{.*\}', 0, 's')) then cast(regexp_extract(s, '\{.*\}', 0, 's') as json) end as v from (select doc_id, case when doc_id % 24 = 23 then '{' || substr(s, 26) else s end as s from reply) x"""
CTES["obj"] = "select doc_id, v, v is not null and json_type(v) = 'OBJECT' as o, case when coalesce(json_type(v, '$.is_ai_modified'), 'NULL') <> 'NULL' then '$.is_ai_modified' else '$.is_ai_generated' end as k from js"
CTES["cmt"] = f"""select i.category, i.num, i.image, i.label, case when i.number is null or i.label is null then null when i.label = 'Negative' then r.t else e.c end as comment from
 (select category, num, image, case when num % 10 <> 9 then num end as number, case when num % 4 = 0 then 'Negative' when num % 4 = 3 then null else 'DeepFake' end as label from fx_edit_comments) i
 left join (select category, num, {_text('title', 'body')} as t from fx_reviews) r on r.category = i.category and r.num = i.number
 left join (select category, num, image, arg_max(c, pos) as c from (select category, num, image, pos, reviewer_comment as c from fx_edit_comments union all select category, num, image, 9, 'second thoughts' from fx_edit_comments where pos = 1) where c <> '' group by 1, 2, 3) e on e.category = i.category and e.num = i.number and e.image = i.image"""
CTES["kept"] = f"select * from images where generator is null or generator in {tuple(GENERATORS[:5])}"
CTES["sampled"] = "select category, bucket, path, generator from kept qualify row_number() over (partition by category, bucket order by md5('42|' || path), path) <= least(count(*) over (partition by category, bucket), greatest(1, cast(round_even(count(*) over (partition by category, bucket) * 0.1e0, 0) as bigint)))"
CTES["acts"] = "select evaluator, scope, seq, action, image_no, choice, row_number() over (partition by evaluator, scope order by seq) as i from fx_human_log"
# the stack of standing submits after each action; i is 0 before the first
CTES["stacks"] = """select distinct evaluator, scope, cast(0 as bigint) as i, cast([] as struct(image_no bigint, choice varchar, seq bigint)[]) as st from acts
 union all select a.evaluator, a.scope, a.i, case when a.action = 'undo' then s.st[1:len(s.st) - 1] when list_contains(list_transform(s.st, lambda x: x.image_no), a.image_no) then s.st
  else list_append(s.st, {'image_no': a.image_no, 'choice': a.choice, 'seq': a.seq}) end from stacks s join acts a on a.evaluator = s.evaluator and a.scope = s.scope and a.i = s.i + 1"""
CTES["standing"] = "select evaluator, scope, x.image_no as image_no, x.choice as choice, x.seq as seq from (select evaluator, scope, unnest(st) as x from (select evaluator, scope, arg_max(st, i) as st from stacks group by 1, 2))"
CTES["judged"] = "select evaluator, scope, image_no, choice, case when image_no % 7 = 0 then 'real' else 'fake' end as true_label, case when image_no % 7 = 0 then 'Negative' else 'DeepFake' end as bucket, case when image_no % 7 > 0 then 'gen' || (image_no % 7) end as gen_model from standing"
CTES["ranked"] = "select evaluator, image_id, category, review_id, true_label, row_number() over (partition by evaluator, true_label order by cast('0x' || substr(md5('7|' || evaluator || '|' || image_id), 1, 15) as bigint), image_id) as r from labelled cross join (select unnest(['ann', 'bob']) as evaluator)"
CTES["queue"] = "select * from (select *, row_number() over (partition by evaluator order by r, true_label) as pos from ranked where r <= 500) where pos <= 500"
CTES["var"] = "select * from (values " + ", ".join(f"('{a}', {'null' if s is None else repr(s)}, '{u}')" for a, s, u in VARIANTS) + ") t(variant, system, user_)"


def oracle(name: str, sql: str) -> None:
    """Adds sql with the views that it needs, directly or through others."""
    names = list(CTES)
    need: list[str] = []
    open_: list[str] = []  # a recursive view names itself

    def visit(text: str) -> None:
        for n in names:
            if n not in need and n not in open_ and re.search(rf"\b{n}\b", re.sub(r"'[^']*'", "''", text)):
                open_.append(n)
                visit(CTES[n])
                if n not in need:
                    need.append(n)

    visit(sql)
    ORACLE_SQL[name] = ("with recursive " + ", ".join(f"{n} as ({CTES[n]})" for n in need) + " " if need else "") + sql


_key = "mode, category, bucket, ident, detector"
_verdict = "status, is_ai_modified, round(confidence, 6) as confidence, error"
_lit = lambda s: "'" + s.replace("'", "''") + "'"
_fill = lambda t, **k: "".join([f"replace({_lit(t)}, '{{n}}', cast({k['n']} as varchar))"]) if "i" not in k else f"replace(replace({_lit(t)}, '{{n}}', cast({k['n']} as varchar)), '{{i}}', cast({k['i']} as varchar))"

oracle("load_results", f"select platform, {_key}, {_verdict} from latest where platform in ('hotel', 'grabfood') and mode in {tuple(MODES[:4])} union all select platform, {_key}, {_verdict} from latest where platform = 'amazon' and mode = '{MODES[0]}'")
oracle("read_bundles", "select mode, category, detector, bucket, ident, num_images, is_ai_modified, round(confidence, 6) as confidence, error from latest")
oracle("classic_scores", "select category, detector, bucket, correct, total, round(conf_sum, 4) as conf_sum, conf_n from cls_counts")
oracle("image_catalog", "select path, category, label, bucket, generator, rel from images")
oracle("review_texts", f"select category, review_id, {_text('title', 'body')} as review_text from fx_reviews")
oracle("export_wide", "select mode, category, bucket, ident, " + ", ".join(f"max(case when detector = '{x}' then status end) as {x}_status, bool_or(case when detector = '{x}' then is_ai_modified end) as {x}_verdict, round(max(case when detector = '{x}' then confidence end), 9) as {x}_confidence" for x in DETECTORS) + " from latest group by 1, 2, 3, 4")
oracle("bucket_parse", "select path, bucket, generator, rel from b")
oracle("review_id", "select path, case when length(path) % 3 = 1 then 'given' else coalesce(nullif(split_part(rest, '/', 1), ''), '') end as review_id from p")
oracle("record_identity", "select k, ln, s, ident, bucket || '::' || ident as row_key from (select k, ln, s, bucket, coalesce(nullif(case when k % 3 = 0 then '' else review_id end, ''), case when k % 2 = 0 then 'img' || k end, 'key' || k) as ident from f)")
oracle("platform_counts", "select platform, mode as name, count(*) as n, 'mode' as kind from f group by 1, 2 union all select platform, label, count(*), 'label' from f group by 1, 2")
oracle("image_ids", "select path, substr(sha1(path), 1, 16) as image_id from p")
oracle("safe_names", r"select conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(case when turn % 5 = 4 then ' ' else '  ' || text || ' ' end, '^\s+|\s+$', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'anonymous') as name from fx_turns")
_placed = "list_filter(list_transform(comments, lambda c, i: {'i': i, 'c': c}), lambda x: x.c <> '')"
_block = f"case when len({_placed}) = 0 then chr(10) || chr(10) when len(list_distinct(list_transform({_placed}, lambda x: x.c))) = 1 then replace({_lit(ONE)}, '{{c}}', {_placed}[1].c) else replace({_lit(MANY)}, '{{lines}}', array_to_string(list_transform({_placed}, lambda x: '  Image ' || x.i || ': \"' || x.c || '\"'), chr(10))) end"
oracle("comment_block", f"select num, {_block} as block from note")
T = TEMPLATES
_req = f"""case when n <= 1 then {_lit(T['head'])} || coalesce(replace({_lit(ONE)}, '{{c}}', nullif(comments[1], '')), chr(10) || chr(10)) || {_lit(T['tail'])}
 when num % 2 = 0 then {_fill(T['packed_head'], n='n')} || ({_block}) || {_fill(T['packed_tail'], n='n')}
 else array_to_string(list_transform(generate_series(1, n - 1), lambda i: {_fill(T['step'], n='n', i='i')}), chr(10)) || chr(10) || {_fill(T['step_head'], n='n')} || ({_block}) || {_fill(T['step_tail'], n='n')} end"""
oracle("request_text", f"select num, cast(length(t) as int) as chars, md5(t) as text_md5 from (select num, {_req} as t from note)")
oracle("variant_requests", "select path, variant, system, user_ as \"user\" from images cross join var where generator is null")
_mm = f"case when t is null then user_ when position(' Return ONLY' in user_) > 0 then substr(user_, 1, position(' Return ONLY' in user_) - 1) || replace({_lit(ONE)}, '{{c}}', t) || substr(user_, position(' Return ONLY' in user_)) else user_ || replace({_lit(ONE)}, '{{c}}', t) end"
oracle("mismatch_requests", f"select num, variant, cast(length(x) as int) as chars, md5(x) as text_md5 from (select num, variant, {_mm} as x from (select num, {_text('title', 'body')} as t from fx_reviews) cross join var)")
oracle("turn_prompts", f"select conv_id, turn, case when n = 1 then {_lit(T['single'])} when turn + 1 = n then {_fill(T['final'], n='n')} when turn = 0 then {_fill(T['first'], n='n', i='turn + 1')} || {_lit(chr(10) * 2 + T['running'])} else {_fill(T['middle'], n='n', i='turn + 1')} || {_lit(chr(10) * 2 + T['running'])} end as prompt from (select *, count(*) over (partition by conv_id) as n from fx_turns)")
oracle("parse_replies", "select doc_id, v is not null as parsed, o as is_object from obj")
_word = f"lower(trim(json_extract_string(v, k))) in {tuple(YES)}"
oracle("normalize_verdicts", f"""select doc_id, case when not o or coalesce(json_type(v, k), 'NULL') = 'NULL' then null when json_type(v, k) = 'BOOLEAN' then json_extract_string(v, k) = 'true' when json_type(v, k) = 'VARCHAR' then {_word} else try_cast(json_extract_string(v, k) as double) <> 0 end as is_ai_modified,
 case when o then round(try_cast(json_extract_string(v, '$.confidence') as double), 6) end as confidence, case when not o then 'failed to parse JSON reply' end as error from obj""")
_first = "case when coalesce(json_extract_string(v, '$.reason'), '') <> '' then '$.reason' when coalesce(json_extract_string(v, '$.reasoning'), '') <> '' then '$.reasoning' else '$.explanation' end"
oracle("normalize_reasons", f"select doc_id, case when not o then null when json_type(v, r) = 'ARRAY' then array_to_string(list_filter(list_transform(cast(json_extract(v, r) as varchar[]), lambda x: trim(x)), lambda x: x <> ''), ' ') when json_type(v, r) = 'VARCHAR' then trim(json_extract_string(v, r)) else cast(json_extract(v, r) as varchar) end as reason from (select *, {_first} as r from obj)")
oracle("per_image_findings", "select doc_id, cast(pos as int) as pos, cast(json_extract_string(x, '$.index') as bigint) as image_index, json_extract_string(x, '$.is_ai_modified') = 'true' as is_ai_modified, round(cast(json_extract_string(x, '$.confidence') as double), 6) as confidence, json_extract_string(x, '$.notes') as notes from (select doc_id, pos, json_extract(v, '$.per_image[' || pos || ']') as x from (select doc_id, v, unnest(range(cast(json_array_length(v, '$.per_image') as bigint))) as pos from obj where o and json_type(v, '$.per_image') = 'ARRAY'))")
oracle("verdict_flags", "select k, ln, s, status <> 'missing' as ran, status = 'ok' and error is null as ok from f")
_status = "regexp_extract(error, '^HTTP (\\d+)', 1)"
_says = lambda pattern: f"regexp_matches(error, {_lit(pattern)}, 'i')"
_class = f"case when {_status} = '413' or ({_status} = '400' and {_says(TOO_LARGE)}) then 'too_large' when {_status} = '400' and {_says(FETCH_FAILED)} then 'upstream_transient' when {_status} = '' and {_says(CONNECTION_DROPPED)} then 'connection_dropped' when {_status} = '429' then 'rate_limit' when regexp_matches({_status}, '^4..$') then 'other_4xx' else 'other' end"
oracle("error_classes", f"select detector, {_class} as error_class, count(*) as n from f where error is not null group by 1, 2")
oracle("unknown_generators", "select * from (values ('gen77'), ('gen88')) t(generator)")
oracle("generator_filter", f"select mode, generator, count(*) as jobs from jobs where generator is null or generator in {tuple(GENERATORS[:2])} group by 1, 2")
oracle("multi_image_only", "select mode, num_images, count(*) as jobs from jobs where not (mode like 'Multi%' and num_images < 2) group by 1, 2")
oracle("flat_images", "select category, bucket, count(*) as flat from images where len(string_split(rel, '/')) < 2 group by 1, 2")
oracle("human_catalog", "select * from labelled")
oracle("confusion_counts", "select mode, category, detector, bucket, correct, total, round(conf_sum, 9) as conf_sum, conf_n from counts")
oracle("conf_on_correct", "select mode, category, detector, bucket, round(conf_sum / nullif(conf_n, 0), 9) as mean_conf from counts")
oracle("metric_tables", f"select mode, category, detector, {_round(NAMES)} from rows")
oracle("listed_images", "select p.platform, b.category, b.bucket, b.generator, count(distinct b.bucket) as files from b join (select distinct category, platform from f) p on p.category = b.category group by 1, 2, 3, 4")
oracle("unknown_names", "select * from (values ('detector', 'det77'), ('category', 'cat77'), ('generator', 'gen77'), ('mode', 'MultiVideo-NoReview')) t(kind, name)")
oracle("category_metrics", f"select mode, category, detector, {_round(NAMES)} from rows")
oracle("macro_metrics", f"select m.mode, d.detector, cast(d.pos as int) as pos, {_round(NAMES, 'macro.')} from (select distinct mode from rows) m cross join (select unnest({[*DETECTORS, 'unheard']!r}) as detector, unnest(range({len(DETECTORS) + 1})) as pos) d left join macro on macro.mode = m.mode and macro.detector = d.detector order by m.mode, d.pos")
oracle("ablation_metrics", f"select mode, detector, {_round(NAMES)} from ok_macro")
oracle("classic_metrics", f"select mode, detector, {_round(NAMES)} from cls_macro")
oracle("combined_table", f"select mode, detector, {_round(NAMES)} from macro where mode = 'SingleImage-NoReview' union all select mode, detector, {_round(NAMES)} from cls_macro")
oracle("format_cells", "select mode, category, detector, " + ", ".join(f"coalesce(printf('%.3f', round(round({c}, 6), 3)), '—') as {c}" for c in NAMES) + " from rows")
oracle("latest_records", f"select {_key}, {_verdict} from latest")
oracle("stream_upsert", f"select {_key}, {_verdict} from latest")
_on = " and ".join(f"l.{c} = j.{c}" for c in ("mode", "category", "bucket", "ident"))
oracle("rebuild_summary", f"select j.mode, j.category, j.bucket, j.ident, det.detector, j.num_images, coalesce(l.status, 'missing') as status, l.is_ai_modified, round(l.confidence, 6) as confidence, l.error from jobs j cross join det left join latest l on {_on} and l.detector = det.detector")
_half = lambda c: f"select * from f where written_at {c} date '1995-06-17' qualify row_number() over (partition by {_key} order by written_at desc, ln desc, s desc) = 1"
CTES["old"], CTES["new"] = _half("<"), _half(">=")
_keep = "n.detector is null or (n.status = 'missing' and o.detector is not null and coalesce(o.status, 'missing') <> 'missing')"
_pick = lambda c: f"case when {_keep} then o.{c} else n.{c} end"
CTES["merged"] = f"select coalesce(n.mode, o.mode) as mode, coalesce(n.category, o.category) as category, coalesce(n.bucket, o.bucket) as bucket, coalesce(n.ident, o.ident) as ident, coalesce(n.detector, o.detector) as detector, {', '.join(f'{_pick(c)} as {c}' for c in ('status', 'is_ai_modified', 'confidence', 'error'))}, n.num_images + 1 as ni, o.num_images as oi from old o full outer join new n on o.mode = n.mode and o.category = n.category and o.bucket = n.bucket and o.ident = n.ident and o.detector = n.detector"
oracle("merge_summary", f"select {_key}, {_verdict}, coalesce(max(ni) over w, max(oi) over w) as num_images from merged window w as (partition by mode, category, bucket, ident)")
oracle("summary_header", "select mode, category, count(*) as num_jobs, cast(sum(coalesce(nullif(n, 3), 1)) as bigint) as num_images, string_agg(distinct bucket, ',' order by bucket) as buckets, case when mode like 'Multi%' then 'review' else 'image' end as shape, max(models) as models from (select mode, category, bucket, ident, max(num_images) as n, max(models) as models from (select l.*, m.models from latest l join (select mode, category, string_agg(distinct detector, ',' order by detector) as models from latest group by 1, 2) m using (mode, category)) group by 1, 2, 3, 4) group by 1, 2")
oracle("task_grid", "select mode, detector, variant, count(*) as tasks from jobs cross join det cross join (select unnest(['v0', 'v1']) as variant) group by 1, 2, 3")
CTES["grid"] = "select j.*, det.detector from jobs j cross join det"
CTES["todo"] = "select g.* , d.ident is not null as done from grid g left join (select mode, category, bucket, ident, detector from latest where error is null) d on g.mode = d.mode and g.category = d.category and g.bucket = d.bucket and g.ident = d.ident and g.detector = d.detector"
oracle("pending_tasks", f"select {_key} from todo where not done")
oracle("run_plan", "select mode, count(distinct (category, bucket, ident)) as jobs, count(*) as pairs, count(*) filter (done) as skipped, count(*) filter (not done) as to_run, cast(coalesce(sum(num_images) filter (not done), 0) as bigint) as calls from todo group by 1")
for _name in ("run_progress", "stream_progress"):
    oracle(_name, "select detector, count(*) filter (error is null and is_ai_modified is not null) as ok, count(*) filter (not (error is null and is_ai_modified is not null)) as fail, count(*) filter (error is null and is_ai_modified = (label <> 'Negative')) as \"right\", round(count(*) filter (error is null and is_ai_modified = (label <> 'Negative')) / count(*), 9) as accuracy from f group by 1")
oracle("stream_rollup", "select mode, category, detector, count(*) as records, count(*) filter (error is null and is_ai_modified is not null) as ok, count(*) filter (error is not null or is_ai_modified is null) as fail from latest group by 1, 2, 3")
oracle("ablation_completion", "select det.detector, count(x.category) as present, count(*) as expected from det cross join (select unnest(list_transform(range(29), lambda i: printf('cat%02d', i))) as category) c left join (select distinct detector, category from f where status = 'ok' and mode = 'MultiTurn-withReview') x on x.detector = det.detector and x.category = c.category group by 1")
oracle("model_drift", "select detector, count(*) as calls, count(*) filter (year(written_at) <> 1995) as drifted, coalesce(string_agg(distinct detector || '-' || year(written_at), ',' order by detector || '-' || year(written_at)) filter (year(written_at) <> 1995), '') as served from f group by 1")
oracle("missing_modes", f"select mode from (select unnest({[*MODES, 'MultiVideo-NoReview']!r}) as mode) where mode not in (select mode from f)")
oracle("review_jobs", "select category, bucket, review_id, cast(num_images as int) as num_images, images_md5 from rj")
oracle("first_jobs", "select category, bucket, review_id, cast(num_images as int) as num_images from rj order by bucket, review_id, category limit 50")
oracle("attach_comments", "select category, num, image, label, comment from cmt")
oracle("comment_coverage", "select label, count(*) filter (coalesce(comment, '') <> '') as with_comment, count(*) filter (coalesce(comment, '') = '') as without_comment from cmt group by 1")
oracle("uncommented_head", "select category, num, image from cmt where coalesce(comment, '') = '' order by 1, 2, 3 limit 10")
oracle("stratified_sample", "select category, bucket, path from sampled")
oracle("index_report", "select k.category, count(*) as images, count(x.path) as sampled from kept k left join sampled x using (path) group by 1")
oracle("index_missing", "select category, path from sampled where length(path) % 5 = 0")
CTES["pool"] = f"select category, review_id, row_number() over (order by category, substr(md5(review_id), 1, 2), md5(review_id), review_id) - 1 as idx from fx_reviews where {_text('title', 'body')} is not null"
CTES["pc"] = "select category, min(idx) as off_, count(*) as n from pool group by 1"
CTES["draw"] = "select r.category, r.review_id as image, coalesce(pc.n, 0) as n, coalesce(off_, 0) as off_, cast('0x' || substr(md5('42|' || r.review_id), 1, 15) as bigint) % (t.total - coalesce(pc.n, 0)) as r from fx_reviews r left join pc using (category) cross join (select count(*) as total from pool) t where t.total > coalesce(pc.n, 0)"
oracle("mismatch_pairs", "select draw.category, draw.image, pool.category as review_source_category, pool.review_id as review_source_review_id from draw join pool on pool.idx = draw.r + case when draw.r >= draw.off_ then draw.n else 0 end")
_side = lambda m, k: f"select category, detector, cast(regexp_replace(ident, '.*_', '') as bigint) - {k} as no, bool_or(is_ai_modified) as v from latest where mode = '{m}' group by 1, 2, 3"
oracle("mismatch_delta", f"select a.detector, count(*) as pairs, count(*) filter (a.v <> b.v) as flips, round(avg(cast(b.v as int)) - avg(cast(a.v as int)), 9) as delta from ({_side('SingleImage-NoReview', 0)}) a join ({_side('SingleImage-withReview', 203)}) b using (category, detector, no) where a.v is not null and b.v is not null group by 1")
oracle("first_comment_turns", "select conv_id, turn, comment from fx_turn_verdicts where coalesce(comment, '') <> '' qualify turn = min(turn) over (partition by conv_id, comment)")
oracle("turn_history", "select conv_id, turn, cast(i as int) as images, cast(i - 1 as int) as earlier, cast(coalesce(c, 0) as bigint) as earlier_chars, cast(i * (i + 1) / 2 as bigint) as uploads from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as i, sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as c from fx_turns)")
oracle("verdict_trajectory", "select conv_id, turn, is_ai_modified, previous, coalesce(is_ai_modified <> previous, false) as flipped from (select *, lag(is_ai_modified) over (partition by conv_id order by turn) as previous, max(turn) over (partition by conv_id) as top from fx_turn_verdicts) where turn < top")
oracle("conversation_totals", "select conv_id, count(*) as turns, cast(sum(attempts) as bigint) as attempts, (list(is_ai_modified order by turn))[-1] as last_verdict, min(case when error is not null then turn end) as first_error_turn from fx_turn_verdicts group by 1")
oracle("human_accuracy", "select evaluator, scope, bucket, gen_model, n, correct, round(correct / n, 9) as accuracy from (select evaluator, scope, bucket, gen_model, count(*) as n, count(*) filter (choice = true_label) as correct from judged group by 1, 2, 3, 4 union all select evaluator, scope, 'all', null, count(*), count(*) filter (choice = true_label) from judged group by 1, 2)")
oracle("human_catalog_stats", "select 'total' as kind, '' as name, count(*) as n from labelled union all select true_label, '', count(*) from labelled group by 1 union all select 'generator', gen_model, count(*) from labelled where gen_model is not null group by 2 union all select 'categories', '', count(distinct category) from labelled")
CTES["pools"] = """select l.evaluator, l.scope, count(*) filter (s.image_no is not null) as evaluated, count(i.image_no) as total, count(*) filter (i.true_label = 'real' and s.image_no is null) as unseen_real,
 count(*) filter (i.true_label = 'fake' and s.image_no is null) as unseen_fake from (select distinct evaluator, scope from fx_human_log) l
 left join fx_human_images i on l.scope in ('All', i.category) left join standing s on s.evaluator = l.evaluator and s.scope = l.scope and s.image_no = i.image_no group by 1, 2"""
oracle("human_progress", "select evaluator, scope, evaluated, total from pools")
oracle("unseen_pools", "select * from pools")
oracle("labelling_queue", "select evaluator, pos, image_id, true_label from queue")
oracle("recency_repeats", "select evaluator, pos, category, gap from (select *, pos - lag(pos) over (partition by evaluator, category order by pos) as gap from queue) where gap <= 30")
for _name in ("human_standing", "stream_human"):
    oracle(_name, "select evaluator, scope, image_no, choice, seq from standing")
oracle("review_numbers", r"select path, nullif(regexp_extract(split_part(rel, '/', 1), '_([^_]*)$', 1), '') as by_review, nullif(regexp_extract(coalesce(string_split(rel, '/')[len(string_split(rel, '/')) - 1], ''), '^Review_(\d+)$', 1), '') as by_folder from images")
oracle("edit_comments", "select num, cast(row_number() over (partition by category, num order by pos) - 1 as int) as pos, image, reviewer_comment from fx_edit_comments where category is not null and category <> ''")
oracle("mismatch_report", "select draw.category, count(*) as images, count(distinct pool.category) as sources from draw join pool on pool.idx = draw.r + case when draw.r >= draw.off_ then draw.n else 0 end group by 1")
