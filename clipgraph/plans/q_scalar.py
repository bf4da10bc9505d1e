"""Scalar functions and filters (P rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgraph.functions import arrays, boxes, ids, prompts, times
from clipgraph.operators import compact, decode, validate, windows
from clipgraph.plans.registry import query
from clipgraph.vocab import ATTRIBUTES

_START = "strptime(substr(video_id, 1, 15), '%Y%m%d_%H%M%S')"
_STEP = "cast(greatest(1, round_even(source_fps, 0)) as int)"


def _r6(c):
    return F.round(c, 6)


@query("parse_start_time", f"""
select video_id, strftime({_START}, '%Y-%m-%dT%H:%M:%S') as start_time from v_videos
""")
def parse_start_time(v):
    return v["v_videos"].select(
        "video_id", times.iso(times.parse_start_time(F.col("video_id"))).alias("start_time")
    )


# Clock digits of an ISO time as a number. Numbers add up in a hash aggregate; the least and
# greatest text would need a sort of all clips.
CLOCK_SQL = "cast(replace(substr({c}, 12), ':', '') as bigint)"


def clock(c):
    return F.translate(F.substring(c, 12, 8), ":", "").cast("bigint")


@query("offset_to_iso", f"""
select video_id, cast(sum(case when s < e then 1 else 0 end) as bigint) as n_spans, cast(sum({CLOCK_SQL.format(c='s')}) as bigint) as start_clock, cast(sum({CLOCK_SQL.format(c='e')}) as bigint) as end_clock
from (select video_id,
    strftime({_START} + to_microseconds(cast(round(start_pos * step / source_fps * 1000000) as bigint)), '%Y-%m-%dT%H:%M:%S') as s,
    strftime({_START} + to_microseconds(cast(round((start_pos + 15) * step / source_fps * 1000000) as bigint)), '%Y-%m-%dT%H:%M:%S') as e
  from v_clips) c group by video_id
""")
def offset_to_iso(v):
    clips = windows.clip_windows(windows.with_start_time(v["v_videos"]))
    begin = F.col("start_ts")
    at = F.col("start_pos") * F.col("step") / F.col("source_fps")
    end = (F.col("start_pos") + 15) * F.col("step") / F.col("source_fps")
    spans = clips.select(
        "video_id", times.offset_to_iso(begin, at).alias("s"), times.offset_to_iso(begin, end).alias("e")
    )
    return spans.groupBy("video_id").agg(
        F.count_if(F.col("s") < F.col("e")).alias("n_spans"),
        F.sum(clock(F.col("s"))).alias("start_clock"),
        F.sum(clock(F.col("e"))).alias("end_clock"),
    )


@query("frame_to_time", f"""
select video_id, strftime({_START} + to_microseconds(cast(round((total_frames - 1) / source_fps * 1000000) as bigint)), '%Y-%m-%dT%H:%M:%S.%f') as last_frame_time
from v_videos
""")
def frame_to_time(v):
    at = times.frame_to_time(
        times.parse_start_time(F.col("video_id")), F.col("total_frames") - 1, F.col("source_fps")
    )
    return v["v_videos"].select("video_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("last_frame_time"))


@query("sample_frames", f"""
select video_id, count(*) as n_frames, cast(sum(frame_index) as bigint) as sum_index, round(max(frame_index / source_fps), 6) as last_sec
from (select video_id, source_fps, unnest(range(0, total_frames, {_STEP})) as frame_index from v_videos) f group by video_id
""")
def sample_frames(v):
    frames = windows.sample_frames(v["v_videos"])
    return frames.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.sum("frame_index").alias("sum_index"),
        _r6(F.max("timestamp_sec")).alias("last_sec"),
    )


@query("sample_clip_at", f"""
select video_id, array_to_string(list_filter(list_transform(range(16), lambda i: cast(total_frames // 2 + i * {_STEP} as int)), lambda x: x < total_frames), ',') as frames
from v_videos
""")
def sample_clip_at(v):
    start = F.expr("total_frames div 2").cast("int")
    frames = windows.frames_from(start, times.frame_step(F.col("source_fps")), 16, F.col("total_frames"))
    return v["v_videos"].select("video_id", arrays.csv(frames).alias("frames"))


@query("video_info", f"""
select video_id, round(source_fps, 2) as source_fps, total_frames, round(total_frames / greatest(source_fps, 1e-6), 1) as duration_sec,
  strftime({_START} + to_microseconds(cast(round(total_frames / greatest(source_fps, 1e-6) * 1000000) as bigint)), '%Y-%m-%dT%H:%M:%S') as video_end_time
from v_videos
""")
def video_info(v):
    duration = times.duration_sec(F.col("total_frames"), F.col("source_fps"))
    begin = times.parse_start_time(F.col("video_id"))
    return v["v_videos"].select(
        "video_id",
        F.round("source_fps", 2).alias("source_fps"),
        "total_frames",
        F.round(duration, 1).alias("duration_sec"),
        times.offset_to_iso(begin, duration).alias("video_end_time"),
    )


@query("clip_status", """
select video_id, clip_index, case when n_objects = 0 and n_events = 0 then 'motion_filtered' else 'annotated' end as status from v_ann_clips
""")
def clip_status(v):
    status = ids.clip_status(F.col("n_objects"), F.col("n_events"))
    return v["v_ann_clips"].select("video_id", "clip_index", status.alias("status"))


@query("category_from_id", """
select c_name as name, regexp_replace(replace(c_name, '#', '_'), '_[0-9]+$', '') as category from customer
union all select s_name, regexp_replace(replace(s_name, '#', '_'), '_[0-9]+$', '') from supplier
""")
def category_from_id(v):
    names = v["customer"].select(F.col("c_name").alias("name")).unionAll(v["supplier"].select("s_name"))
    return names.select("name", ids.category_from_id(F.replace(F.col("name"), F.lit("#"), F.lit("_"))).alias("category"))


@query("clamp_frame", """
select event_seq, greatest(0, least(frame, 15)) as frame from v_ann_events
""")
def clamp_frame(v):
    return v["v_ann_events"].select("event_seq", ids.clamp_frame(F.col("frame")).alias("frame"))


@query("alias_fields", """
select event_seq, action, agent, target, source, destination, cast(frame as varchar) as frame from v_ann_events
""")
def alias_fields(v):
    """Records that carry the older or the newer field names, read through one rule."""
    old = F.col("event_seq") % 2 == 0

    def pick(new_name, old_name, value):
        return F.when(old, F.create_map(F.lit(old_name), value)).otherwise(F.create_map(F.lit(new_name), value))

    fields = F.map_concat(
        pick("action", "action_type", F.col("action")),
        pick("agent", "agent_id", F.col("agent")),
        pick("target", "target_id", F.col("target")),
        pick("source", "source_id", F.col("source")),
        pick("destination", "dest_id", F.col("destination")),
        pick("frame_index", "frame", F.col("frame").cast("string")),
    )
    raw = v["v_ann_events"].select("event_seq", fields.alias("fields"))
    names = ["action", "agent", "target", "source", "destination", "frame"]
    return raw.select("event_seq", *[ids.first_present(F.col("fields"), ids.ALIASES[n]).alias(n) for n in names])


@query("normalize_frame", """
select event_seq, cast(case when f <= 15 then f else list_position(d, list_min(d)) - 1 end as int) as local
from (select event_seq, f, list_transform(frame_indices, lambda x: abs(x - f)) as d
      from (select e.event_seq, c.frame_indices, case when e.frame < 8 then e.frame else e.clip_index * 160 + e.frame * 23 end as f
            from v_doc_events e join v_doc_clips c on c.video_id = e.video_id and c.clip_index = e.clip_index) a) b
""")
def normalize_frame(v):
    """Event frames, some local and some of the source video, against the frames of their clip."""
    clips = v["v_doc_clips"].select("video_id", "clip_index", "frame_indices")
    source = F.col("clip_index") * 160 + F.col("frame") * 23
    events = v["v_doc_events"].withColumn("f", F.when(F.col("frame") < 8, F.col("frame")).otherwise(source))
    joined = events.join(clips, ["video_id", "clip_index"])
    return joined.select("event_seq", ids.normalize_frame(F.col("f"), F.col("frame_indices")).alias("local"))


@query("boxes_to_pixels", """
select video_id, frame_index, track_id, round(score, 6) as score, round(b[1] * 400, 6) as x1, round(b[2] * 400, 6) as y1,
  round((b[1] + b[3]) * 400, 6) as x2, round((b[2] + b[4]) * 400, 6) as y2
from (select video_id, frame_index, unnest(ids) as track_id, unnest(probs) as score, unnest(boxes) as b from v_raw_boxes) u
""")
def boxes_to_pixels(v):
    out = decode.boxes_to_pixels(v["v_raw_boxes"], 400, 400)
    return out.select(
        "video_id", "frame_index", "track_id", *[_r6(F.col(c)).alias(c) for c in ("score", "x1", "y1", "x2", "y2")]
    )


@query("box_to_cxcywh", """
select video_id, frame_index, track_id, round((x1 + x2) / 2 / 400, 6) as cx, round((y1 + y2) / 2 / 400, 6) as cy,
  round((x2 - x1) / 400, 6) as w, round((y2 - y1) / 400, 6) as h from v_detections
""")
def box_to_cxcywh(v):
    cols = boxes.to_center(boxes.box(), 400, 400)
    return v["v_detections"].select(
        "video_id", "frame_index", "track_id", *[_r6(c).alias(n) for c, n in zip(cols, ("cx", "cy", "w", "h"))]
    )


_PAIRS_SQL = """
from (select a.video_id, a.frame_index, a.track_id as track_i, b.track_id as track_j,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
  (a.x2 - a.x1) * (a.y2 - a.y1) as area_i, (b.x2 - b.x1) * (b.y2 - b.y1) as area_j
from v_detections a join v_detections b on a.video_id = b.video_id and a.frame_index = b.frame_index and a.track_id < b.track_id) p
"""


def _frame_pairs(v):
    a, b = v["v_detections"].alias("a"), v["v_detections"].alias("b")
    same = (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.frame_index") == F.col("b.frame_index"))
    return a.join(b, same & (F.col("a.track_id") < F.col("b.track_id")))


def _pair_ids():
    return [
        F.col("a.video_id").alias("video_id"),
        F.col("a.frame_index").alias("frame_index"),
        F.col("a.track_id").alias("track_i"),
        F.col("b.track_id").alias("track_j"),
    ]


@query("box_iou", f"""
select video_id, frame_index, track_i, track_j,
  case when area_i + area_j - inter <= 0 then 0 else inter / (area_i + area_j - inter) end as iou,
  inter / greatest(area_i + area_j - inter, 1e-6) as iou_eps {_PAIRS_SQL}
""")
def box_iou(v):
    a, b = boxes.box("a."), boxes.box("b.")
    return _frame_pairs(v).select(
        *_pair_ids(), boxes.box_iou(a, b).alias("iou"), boxes.box_iou(a, b, 1e-6).alias("iou_eps")
    )


@query("box_containment", f"""
select video_id, frame_index, track_i, track_j, inter / greatest(area_i, 1e-6) as cont_ij,
  inter / greatest(area_j, 1e-6) as cont_ji {_PAIRS_SQL}
""")
def box_containment(v):
    a, b = boxes.box("a."), boxes.box("b.")
    return _frame_pairs(v).select(
        *_pair_ids(),
        boxes.box_containment(a, b).alias("cont_ij"),
        boxes.box_containment(b, a).alias("cont_ji"),
    )


@query("active_queries", """
select sample_id, q, round(1 / (1 + exp(-interaction)), 6) as score, 1 / (1 + exp(-interaction)) > 0.5 as above_half
from v_pred where 1 / (1 + exp(-interaction)) >= 0.3
""")
def active_queries(v):
    out = decode.active_queries(v["v_pred"], 0.3)
    return out.select("sample_id", "q", _r6(F.col("score")).alias("score"), (F.col("score") > 0.5).alias("above_half"))


_HEADS = ["action", "agent_ptr", "target_ptr", "source_ptr", "dest_ptr", "frame"]
_ARGMAX_SQL = ", ".join(f"cast(list_position({h}, list_max({h})) - 1 as int) as {h}" for h in _HEADS)


@query("argmax_decode", f"select sample_id, q, {_ARGMAX_SQL} from v_pred")
def argmax_decode(v):
    return decode.argmax_heads(v["v_pred"]).select("sample_id", "q", *_HEADS)


@query("label_lookup", f"""
select sample_id, q, case when action < 3 then (['pick', 'place', 'open'])[action + 1] else concat('action_', action) end as action_name
from (select sample_id, q, {_ARGMAX_SQL} from v_pred) p
""")
def label_lookup(v):
    names = v.spark.createDataFrame([(0, "pick"), (1, "place"), (2, "open")], "id int, name string")
    heads = decode.argmax_heads(v["v_pred"])
    return decode.label_lookup(heads, "action", names, "action_name", "action_").select("sample_id", "q", "action_name")


# Slots 0..3 map to tracks 10..40, the last two are unmapped.
_SLOT_MAP = {0: 10, 1: 20, 2: 30, 3: 40}


@query("pointer_decode", f"""
select sample_id, q, case when agent_ptr < 4 then (agent_ptr + 1) * 10 else agent_ptr end as agent_track_id,
  case when target_ptr < 4 then (target_ptr + 1) * 10 else target_ptr end as target_track_id,
  case when source_ptr < 4 then (source_ptr + 1) * 10 end as source_track_id,
  case when dest_ptr < 4 then (dest_ptr + 1) * 10 end as destination_track_id
from (select sample_id, q, {_ARGMAX_SQL} from v_pred) p
""")
def pointer_decode(v):
    out = decode.decode_pointers(decode.argmax_heads(v["v_pred"]), decode.slot_literal(_SLOT_MAP), 6)
    return out.select("sample_id", "q", "agent_track_id", "target_track_id", "source_track_id", "destination_track_id")


@query("frame_decode", f"""
select sample_id, q, case when frame < 6 then frame * 5 else frame end as frame
from (select sample_id, q, {_ARGMAX_SQL} from v_pred) p
""")
def frame_decode(v):
    heads = decode.argmax_heads(v["v_pred"])
    frames = F.array(*[F.lit(i * 5) for i in range(6)])
    return heads.select("sample_id", "q", decode.decode_frame(F.col("frame"), frames).alias("frame"))


_CLEAN = """
select doc_id, case when json_valid(t) then t end as body
from (select doc_id, case
        when contains(s, '```json') then regexp_extract(s, '```json\\s*(.*?)```', 1, 's')
        when starts_with(trim(s), '```') then regexp_replace(regexp_replace(trim(s), '^```[^\n]*\n', ''), '\\s*```$', '')
        else trim(s) end as t
      from (select doc_id, case when contains(raw, '</think>') then split_part(raw, '</think>', 2) else raw end as s from v_vlm_raw) a) b
"""


@query("parse_vlm_text", f"""
select doc_id, body is not null as parsed, json_extract_string(body, '$.objects[0].obj_id') as obj_id,
  json_extract_string(body, '$.events[0].event_id') as event_id from ({_CLEAN}) c
""")
def parse_vlm_text(v):
    out = validate.parse_annotation(v["v_vlm_raw"], "raw")
    return out.select(
        "doc_id",
        "parsed",
        F.get(F.col("objects"), F.lit(0))["obj_id"].alias("obj_id"),
        F.get(F.col("events"), F.lit(0))["event_id"].alias("event_id"),
    )


@query("schema_validate", f"""
select doc_id, ok as valid, case when ok then 1 else 0 end as n_objects, case when ok then 1 else 0 end as n_events
from (select doc_id, coalesce(regexp_full_match(json_extract_string(body, '$.objects[0].obj_id'), '[a-z_]+_[0-9]+'), false) as ok from ({_CLEAN}) c) d
""")
def schema_validate(v):
    out = validate.schema_validate(validate.parse_annotation(v["v_vlm_raw"], "raw"))
    return out.select("doc_id", "valid", F.size("objects").alias("n_objects"), F.size("events").alias("n_events"))


@query("attributes_coerce", f"""
select doc_id, case when doc_id % 7 = 0 then 0 else 2 end as n_attributes, case when doc_id % 7 = 0 then null else 'red' end as color
from ({_CLEAN}) c where body is not null
""")
def attributes_coerce(v):
    out = validate.parse_annotation(v["v_vlm_raw"], "raw").where("parsed")
    attrs = F.get(F.col("objects"), F.lit(0))["attributes"]
    return out.select("doc_id", F.size(attrs).alias("n_attributes"), F.element_at(attrs, "color").alias("color"))


@query("attribute_vocab_fix", """
select clip_id, obj_id, case when color = 'mauve' then null else color end as color, material,
  2 as n_axes, 1 + case when color = 'mauve' then 1 else 0 end as n_warnings from v_ann_objects
""")
def attribute_vocab_fix(v):
    attrs = F.create_map(
        F.lit("color"), F.col("color"), F.lit("material"), F.col("material"), F.lit("shape"), F.lit("round")
    )
    fixed = validate.fix_attributes(v["v_ann_objects"].withColumn("attributes", attrs))
    return fixed.select(
        "clip_id",
        "obj_id",
        F.element_at("attributes", "color").alias("color"),
        F.element_at("attributes", "material").alias("material"),
        F.size("attributes").alias("n_axes"),
        F.size("warnings").alias("n_warnings"),
    )


ACTION_RULES = """
(select event_type as action, row_number() over (order by event_type) - 1 as action_id, event_type in ('click', 'purchase') as requires_source,
   event_type in ('purchase', 'signup') as requires_destination from (select distinct event_type from events where event_type <> 'error') d)
"""


def action_rules(v):
    """The event types but ``error`` as actions, some of which need a source or a destination."""
    from clipgraph.vocab import vocab_from_table

    known = v["events"].where("event_type <> 'error'")
    ranked = vocab_from_table(known, "event_type", "action", "action_id")
    return ranked.select(
        "action",
        "action_id",
        F.col("action").isin("click", "purchase").alias("requires_source"),
        F.col("action").isin("purchase", "signup").alias("requires_destination"),
    )


VALIDATED = f"""
select e.clip_id, e.event_seq, e.frame, r.action is not null and a.obj_id is not null and (e.target is null or t.obj_id is not null)
    and (e.source is null or s.obj_id is not null) and (e.destination is null or d.obj_id is not null) as keep,
  concat_ws('; ', case when r.action is null then concat('Event ', e.event_id, ': unknown action ''', e.action, '''') end,
    case when a.obj_id is null then concat('Event ', e.event_id, ': agent ''', e.agent, ''' not in objects') end,
    case when e.target is not null and t.obj_id is null then concat('Event ', e.event_id, ': target ''', e.target, ''' not in objects') end,
    case when e.source is not null and s.obj_id is null then concat('Event ', e.event_id, ': source ''', e.source, ''' not in objects') end,
    case when e.destination is not null and d.obj_id is null then concat('Event ', e.event_id, ': destination ''', e.destination, ''' not in objects') end,
    case when r.action is not null and a.obj_id is not null and (e.target is null or t.obj_id is not null)
      and (e.source is null or s.obj_id is not null) and (e.destination is null or d.obj_id is not null)
      and r.requires_source and e.source is null then concat('Event ', e.event_id, ': action ''', e.action, ''' requires source but none provided') end,
    case when r.action is not null and a.obj_id is not null and (e.target is null or t.obj_id is not null)
      and (e.source is null or s.obj_id is not null) and (e.destination is null or d.obj_id is not null)
      and r.requires_destination and e.destination is null then concat('Event ', e.event_id, ': action ''', e.action, ''' requires destination but none provided') end) as warnings
from v_ann_events e left join {ACTION_RULES} r on r.action = e.action
left join v_ann_objects a on a.clip_id = e.clip_id and a.obj_id = e.agent
left join v_ann_objects t on t.clip_id = e.clip_id and t.obj_id = e.target
left join v_ann_objects s on s.clip_id = e.clip_id and s.obj_id = e.source
left join v_ann_objects d on d.clip_id = e.clip_id and d.obj_id = e.destination
"""


@query("validate_events", f"select event_seq, keep, warnings from ({VALIDATED}) x")
def validate_events(v):
    out = validate.validate_events(v["v_ann_events"], v["v_ann_objects"], action_rules(v), "clip_id")
    return out.select("event_seq", "keep", F.array_join("warnings", "; ").alias("warnings"))



def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


@query("prompt_build", f"""
select video_id, count(*) as n_prompts, cast(sum(strlen(u)) as bigint) as n_bytes,
  md5({_quoted(prompts.system_prompt())}) as system_md5
from (select video_id, concat(cast(length as varchar), ' frames sampled at ', case when clip_index % 2 = 0 then '1.0' else '12.5' end,
        ' frames per second; the frame number is drawn at the top left of each.', chr(10),
        'Answer in this form:', chr(10), {_quoted(prompts.example_json(list(ATTRIBUTES)))}) as u from v_clips) p group by video_id
""")
def prompt_build(v):
    """Prompts of all clips (every second one at 12.5 fps), summed up per video."""
    clips = windows.clip_windows(v["v_videos"]).select("video_id", "clip_index", "length")
    fps = F.when(F.col("clip_index") % 2 == 0, F.lit(1.0)).otherwise(F.lit(12.5))
    made = prompts.build_prompts(clips, "length", fps)
    return made.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.sum(F.octet_length("user_prompt")).alias("n_bytes"),
    ).withColumn("system_md5", F.md5(F.lit(prompts.system_prompt())))


def attributed_objects(v):
    return v["v_ann_objects"].withColumn(
        "attributes", F.create_map(F.lit("color"), F.col("color"), F.lit("material"), F.col("material"))
    )


@query("attrs_sparse", """
select clip_id, obj_id, concat_ws(',', case when color is not null then concat('color=', color) end, case when material is not null then concat('material=', material) end) as attributes
from v_ann_objects
""")
def attrs_sparse(v):
    entries = F.map_entries(compact.sparse(F.col("attributes")))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return attributed_objects(v).select("clip_id", "obj_id", text.alias("attributes"))


@query("attrs_expand", """
select clip_id, obj_id, 7 as n_axes, concat(coalesce(color, '-'), ',', coalesce(material, '-'), ',-,-,-,-,-') as attributes from v_ann_objects
""")
def attrs_expand(v):
    full = compact.expand(compact.sparse(F.col("attributes")))
    text = F.array_join(F.transform(F.map_values(full), lambda x: F.coalesce(x, F.lit("-"))), ",")
    return attributed_objects(v).select("clip_id", "obj_id", F.size(full).alias("n_axes"), text.alias("attributes"))


@query("event_pack", """
select event_seq, case when destination is not null then 7 when source is not null then 6 when target is not null then 5 else 4 end as n_fields,
  concat(event_id, ',', frame, ',', action, ',', agent, case when coalesce(target, source, destination) is not null then concat(',', coalesce(target, 'null')) else '' end,
    case when coalesce(source, destination) is not null then concat(',', coalesce(source, 'null')) else '' end,
    case when destination is not null then concat(',', destination) else '' end) as packed
from v_ann_events
""")
def event_pack(v):
    packed = compact.pack_event()
    return v["v_ann_events"].select("event_seq", F.size(packed).alias("n_fields"), arrays.csv(packed).alias("packed"))


@query("event_unpack", "select event_seq, event_id, frame, action, agent, target, source, destination from v_ann_events")
def event_unpack(v):
    packed = v["v_ann_events"].select("event_seq", compact.pack_event().alias("e"))
    return packed.select("event_seq", *[c.alias(n) for n, c in compact.unpack_event(F.col("e")).items()])


@query("frame_indices_rebuild", """
select video_id, count(*) as n_clips, cast(sum(list_sum(list_transform(range(16), lambda j: clip_index * 8 * step + j * step))) as bigint) as sum_frames,
  cast(count(*) as bigint) as n_equal from v_clips group by video_id
""")
def frame_indices_rebuild(v):
    clips = windows.with_frame_indices(windows.clip_windows(v["v_videos"]))
    made = windows.rebuild_frame_indices(F.col("clip_index"), F.col("step") * 8, F.col("step"), F.col("length"))
    rebuilt = clips.select("video_id", "frame_indices", made.alias("made"))
    total = F.aggregate("made", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return rebuilt.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.sum(total).alias("sum_frames"),
        F.count_if(F.col("made") == F.col("frame_indices")).alias("n_equal"),
    )


@query("id_format", """
select event_seq, printf('evt_%04d', event_seq) as event_id, printf('%s_clip_%04d', video_id, frame) as sample_id from v_edges
""")
def id_format(v):
    return v["v_edges"].select(
        "event_seq",
        ids.event_id(F.col("event_seq")).alias("event_id"),
        ids.sample_id(F.col("video_id"), F.col("frame")).alias("sample_id"),
    )


@query("no_event_filter", """
select clip_id, event_seq, action from v_ann_events where action <> 'error'
""")
def no_event_filter(v):
    return v["v_ann_events"].where(F.col("action") != "error").select("clip_id", "event_seq", "action")


@query("pad_and_mask", """
select video_id, frame_index, cast(least(len(s), 4) as int) as n, array_to_string(list_transform(range(1, 5), lambda i: coalesce(s[i], 0)), ',') as tracks,
  array_to_string(list_transform(range(4), lambda i: i < least(len(s), 4)), ',') as mask
from (select video_id, frame_index, ids as s from v_raw_boxes) r
""")
def pad_and_mask(v):
    n = F.least(F.size("ids"), F.lit(4))
    return v["v_raw_boxes"].select(
        "video_id",
        "frame_index",
        n.alias("n"),
        arrays.csv(arrays.pad_to(F.col("ids"), 4, F.lit(0))).alias("tracks"),
        arrays.csv(arrays.valid_mask(n, 4)).alias("mask"),
    )


@query("pointer_mask", """
select sample_id, q, cast(list_position(a, list_max(a)) - 1 as int) as agent_ptr, cast(list_position(s, list_max(s)) - 1 as int) as source_ptr,
  cast(4 as int) as n_valid_agent, cast(5 as int) as n_valid_source
from (select sample_id, q, list_transform(range(6), lambda i: case when i < 4 then cast(agent_ptr[i + 1] as double) else cast('-inf' as double) end) as a,
  list_transform(range(7), lambda i: case when i < 4 or i = 6 then cast(source_ptr[i + 1] as double) else cast('-inf' as double) end) as s from v_pred) m
""")
def pointer_mask(v):
    mask = arrays.valid_mask(F.lit(4), 6)
    agent = arrays.mask_logits(F.col("agent_ptr"), mask)
    source = arrays.mask_logits(F.col("source_ptr"), mask, none_slot=True)

    def finite(a):
        return F.size(F.filter(a, lambda x: x > F.lit(float("-inf"))))

    return v["v_pred"].select(
        "sample_id", "q",
        arrays.argmax(agent).alias("agent_ptr"),
        arrays.argmax(source).alias("source_ptr"),
        finite(agent).alias("n_valid_agent"),
        finite(source).alias("n_valid_source"),
    )


@query("temporal_token_frames", """
select video_id, count(*) as n_clips, cast(sum(list_sum(list_transform(range(9), lambda t: (start_pos + least(2 * t, 15)) * step))) as bigint) as sum_frames
from v_clips group by video_id
""")
def temporal_token_frames(v):
    clips = windows.with_frame_indices(windows.clip_windows(v["v_videos"]))
    tokens = windows.token_frames(F.col("frame_indices"), 9)
    total = F.aggregate(tokens, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return clips.select("video_id", total.alias("s")).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_clips"), F.sum("s").alias("sum_frames")
    )
