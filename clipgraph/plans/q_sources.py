"""Sources, sinks and document compaction (S rows and A8 to A14 of the survey)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clipgraph.functions import arrays, times
from clipgraph.operators import compact, ordering, validate, windows
from clipgraph.plans.q_scalar import ACTION_RULES, VALIDATED, action_rules
from clipgraph.plans.registry import query
from clipgraph.session import checkpoint_dir, settle
from clipgraph.sources import annotations, datasets, inventory, vocabulary
from clipgraph.sources import compact_docs as codec
from clipgraph.vocab import vocab_from_table


def _folder(v, name: str) -> str:
    return f"{checkpoint_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def doc_rows(v):
    attrs = F.create_map(F.lit("color"), F.col("color"), F.lit("material"), F.col("material"))
    objects = v["v_doc_objects"].withColumn("attributes", attrs).drop("color", "material")
    return v["v_doc_clips"], objects, v["v_doc_events"]


def documents(v):
    return annotations.nest_documents(*doc_rows(v), "event_seq")


@query("scan_annotations", """
select cast(c.video_id as varchar) as video_id, cast(count(*) as int) as n_clips, cast(sum((select count(*) from v_doc_objects o where o.video_id = c.video_id and o.clip_index = c.clip_index)) as bigint) as n_objects,
  cast(sum((select count(*) from v_doc_events e where e.video_id = c.video_id and e.clip_index = c.clip_index)) as bigint) as n_events from v_doc_clips c group by c.video_id
""")
def scan_annotations(v):
    path = _folder(v, "documents")
    annotations.write_annotation_docs(documents(v), path)
    docs = annotations.scan_annotations(v.spark, path, multi_line=False)

    def total(field):
        return F.aggregate("clips", F.lit(0).cast("bigint"), lambda acc, c: acc + F.size(c[field]))

    return docs.select("video_id", F.size("clips").alias("n_clips"), total("objects").alias("n_objects"), total("events").alias("n_events"))


@query("explode_clips", """
select video_id, clip_index, cast(row_number() over (partition by video_id, clip_index order by event_seq) - 1 as int) as event_pos, event_id, frame, action, agent, target, destination
from v_doc_events
""")
def explode_clips(v):
    events = annotations.explode_events(annotations.explode_clips(documents(v)))
    return events.select("video_id", "clip_index", "event_pos", "event_id", "frame", "action", "agent", "target", "destination")


@query("explode_objects", """
select video_id, clip_index, obj_pos, obj_id, category, first_seen_frame, color, material from v_doc_objects
""")
def explode_objects(v):
    objects = annotations.explode_objects(annotations.explode_clips(documents(v)))
    return objects.select(
        "video_id", "clip_index", "obj_pos", "obj_id", "category", "first_seen_frame",
        F.element_at("attributes", "color").alias("color"), F.element_at("attributes", "material").alias("material"),
    )


@query("vocab_index", """
select 'part' as vocab, p_type as name, cast(row_number() over (order by p_type) - 1 as int) as id from (select distinct p_type from part) a
union all select 'event', event_type, cast(row_number() over (order by event_type) - 1 as int) from (select distinct event_type from events) b
""")
def vocab_index(v):
    a = vocab_from_table(v["part"], "p_type", "name", "id").select(F.lit("part").alias("vocab"), "name", "id")
    b = vocab_from_table(v["events"], "event_type", "name", "id").select(F.lit("event").alias("vocab"), "name", "id")
    return a.unionByName(b)


@query("media_inventory", """
select page_id, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') as stem from pages where regexp_matches(lower(url), '\\.(html|mp4|avi)$')
""")
def media_inventory(v):
    files = v["pages"].select("page_id", F.col("url").alias("path"))
    return inventory.media_files(files, ["html", "mp4", "avi"]).select("page_id", "stem")


@query("feature_inventory", """
select source as video_id, count(*) as n_clips, cast(sum(n_chars) as bigint) as n_bytes, cast(max(doc_id) as int) as last_clip from documents group by 1
""")
def feature_inventory(v):
    files = v["documents"].select(
        F.col("source").alias("video_id"), F.format_string("%s/clip_%06d.pt", "source", "doc_id").alias("path"), F.col("n_chars").alias("length")
    )
    return inventory.feature_inventory(files, "video_id")


@query("resume_filter", "select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def resume_filter(v):
    done = v["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"))
    return inventory.pending(v["orders"].select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("shard_assign", "select video_id, cast((row_number() over (order by video_id) - 1) % 7 as int) as shard from v_videos")
def shard_assign(v):
    return datasets.shard_assign(v["v_videos"].select("video_id"), "video_id", 7)


@query("write_annotation_docs", """
select cast(video_id as varchar) as video_id, string_agg(cast(clip_index as varchar), ',' order by clip_index) as clips, string_agg(status, ',' order by clip_index) as statuses,
  cast(sum(list_sum(frame_indices)) as bigint) as sum_frames from v_doc_clips group by video_id
""")
def write_annotation_docs(v):
    path = _folder(v, "documents")
    annotations.write_annotation_docs(documents(v), path)
    docs = annotations.scan_annotations(v.spark, path, multi_line=False)
    meta = F.transform("clips", lambda c: c["clip_metadata"])
    frames = F.flatten(F.transform(meta, lambda m: m["frame_indices"]))
    return docs.select(
        "video_id", arrays.csv(F.transform(meta, lambda m: m["clip_index"])).alias("clips"),
        arrays.csv(F.transform(meta, lambda m: m["status"])).alias("statuses"),
        F.aggregate(frames, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("sum_frames"),
    )


_RUNS = """
(select video_id, string_agg(concat(a, '/', b), ',' order by first) as ranges from (
  select video_id, min(clip_index) as first, strftime(timestamp '2026-01-01 12:00:00' + to_microseconds(cast(min(frame_indices[1]) * 50000 as bigint)), '%Y-%m-%dT%H:%M:%S') as a,
    strftime(timestamp '2026-01-01 12:00:00' + to_microseconds(cast(max(frame_indices[16]) * 50000 as bigint)), '%Y-%m-%dT%H:%M:%S') as b
  from (select *, place - row_number() over (partition by video_id order by clip_index) as run
        from (select *, row_number() over (partition by video_id order by clip_index) as place from v_doc_clips) p where status = 'motion_filtered') q group by video_id, run) r group by video_id)
"""


@query("annotation_docs", f"""
select cast(c.video_id as varchar) as video_id, concat('/videos/', c.video_id, '.mp4') as video_path, 20.0e0 as source_fps, cast(72000 + c.video_id as int) as total_frames,
  round_even((72000 + c.video_id) / 20.0e0, 1) as duration_sec, concat('2026-01-01T12:00:00 ~ ', strftime(timestamp '2026-01-01 12:00:00' + to_microseconds(cast((72000 + c.video_id) * 50000::bigint as bigint)), '%Y-%m-%dT%H:%M:%S')) as time_range,
  cast(count(*) as int) as total_clips, cast(count(*) filter (where status = 'annotated') as int) as annotated_clips, cast(count(*) filter (where status = 'motion_filtered') as int) as motion_filtered_clips,
  cast(count(*) filter (where exists (select 1 from v_doc_events e where e.video_id = c.video_id and e.clip_index = c.clip_index)) as int) as clips_with_events, coalesce(any_value(r.ranges), '') as ranges,
  cast(any_value(s.a) as int) as total_annotations, cast(any_value(s.n) as int) as total_events_input, cast(any_value(s.k) as int) as total_events_output, cast(any_value(s.n - s.k) as int) as total_events_discarded,
  any_value(round((s.n - s.k) / s.n, 4)) as discard_rate, cast(any_value(s.w) as int) as total_warnings
from v_doc_clips c left join {_RUNS} r on r.video_id = c.video_id
left join (select clip_id, 1 as a, count(*) as n, count(*) filter (where keep) as k, sum(case when warnings = '' then 0 else len(string_split(warnings, '; ')) end)
    + max(case when keep and before > frame then 1 else 0 end) as w
  from (select *, lag(frame) over (partition by clip_id, keep order by event_seq) as before from ({VALIDATED}) x) y group by clip_id) s on s.clip_id = c.video_id
group by c.video_id
""")
def annotation_docs(v):
    """Whole documents, written and read back: users are videos of an hour at 20 fps, validated as one annotation each."""
    clips, objects, events = doc_rows(v)
    start = F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")
    first, last = F.get("frame_indices", F.lit(0)) / 20.0, F.element_at("frame_indices", -1) / 20.0
    timed = clips.withColumns({
        "start_offset_sec": F.round(first, 3), "end_offset_sec": F.round(last, 3),
        "start_time": times.offset_to_iso(start, first), "end_time": times.offset_to_iso(start, last)})
    users = clips.select("video_id").distinct()
    frames = (F.lit(72000) + F.col("video_id")).cast("int")
    videos = users.select(
        "video_id", F.format_string("/videos/%d.mp4", "video_id").alias("video_path"), start.alias("start_ts"), F.lit(20.0).alias("source_fps"),
        F.lit(1.0).alias("target_fps"), frames.alias("total_frames"), times.duration_sec(frames, F.lit(20.0)).alias("duration_sec"))
    checked = validate.validate_events(v["v_ann_events"], v["v_ann_objects"], action_rules(v), "clip_id")
    # read three times: by the sample and the order of events, and by the totals
    checked = settle(checked.select("clip_id", "frame", "event_seq", "keep", F.size("warnings").alias("n_warnings")))
    moved = validate.clips_out_of_order(checked.where("keep"), "clip_id", "frame", "event_seq")
    stats = validate.validation_stats_by(checked, v["v_ann_events"].select("clip_id").distinct(), ["clip_id"], moved)
    docs = annotations.annotation_documents(timed, objects, events, "event_seq", videos, stats.withColumnRenamed("clip_id", "video_id"))
    path = _folder(v, "documents")
    annotations.write_annotation_docs(docs, path)
    read = annotations.scan_annotations(v.spark, path, multi_line=False)
    ranges = F.array_join(F.transform("coverage.motion_filtered_ranges", lambda r: F.concat(r["start"], F.lit("/"), r["end"])), ",")
    return read.select(
        "video_id", "video_path", "video_metadata.source_fps", "video_metadata.total_frames", "video_metadata.duration_sec", "coverage.time_range",
        *[f"coverage.{c}" for c in ("total_clips", "annotated_clips", "motion_filtered_clips", "clips_with_events")], ranges.alias("ranges"), "validation_stats.*")


@query("ordered_ids", """
select split, row_number() over (partition by split order by sample_id) - 1 as pos, sample_id from (
  select sample_id, case when pos < floor(n * 0.8e0) then 'train' when pos < floor(n * 0.8e0) + floor(n * 0.1e0) then 'val' else 'test' end as split
  from (select sample_id, row_number() over (order by md5(concat(sample_id, '|42')), sample_id) - 1 as pos, (select count(*) from documents) as n from v_samples) s) t
""")
def ordered_ids(v):
    """Three sorted id lists, read back with each id's place."""
    path = _folder(v, "ids")
    split = ordering.seeded_split(v["v_samples"].select("sample_id"), "sample_id")
    datasets.write_ordered_ids(split, path, "sample_id")
    return datasets.read_ordered_ids(v.spark, path, "sample_id")


@query("vocab_files", f"""
select 'category' as part, p_type as name, cast(row_number() over (order by p_type) - 1 as int) as id, false as requires_source, false as requires_destination, count(*) as n from part group by p_type
union all select 'action', r.action, cast(r.action_id as int), r.requires_source, r.requires_destination, (select count(*) from v_ann_events e where e.action = r.action) from {ACTION_RULES} r
""")
def vocab_files(v):
    """Vocabularies of the tables, written as a file, loaded from it and joined to the rows that use them."""
    types = v["part"].groupBy().agg(F.sort_array(F.collect_set("p_type")).alias("categories"))
    rules = action_rules(v).select("action_id", F.col("action").alias("name"), "requires_source", "requires_destination")
    actions = rules.groupBy().agg(F.sort_array(F.collect_list(F.struct("action_id", "name", "requires_source", "requires_destination"))).alias("actions"))
    whole = types.select(F.to_json(F.struct("categories", actions.scalar().alias("actions"))).alias("value"))
    path = f"{_folder(v, 'vocabulary')}.json"
    whole.coalesce(1).write.text(path)
    (file,) = v.spark.read.text(path).select(F.col("_metadata.file_path").alias("path")).first()
    known = vocabulary.load(v.spark, file.replace("file:///", "/"), "category").where("category <> 'unknown'")
    used = v["part"].groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    a = known.join(used, "category", "left").select(
        F.lit("category").alias("part"), F.col("category").alias("name"), F.col("category_id").alias("id"), F.lit(False).alias("requires_source"),
        F.lit(False).alias("requires_destination"), "n")
    done = v["v_ann_events"].groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    b = vocabulary.load(v.spark, file.replace("file:///", "/"), "action").join(done, "action", "left").select(
        F.lit("action").alias("part"), F.col("action").alias("name"), F.col("action_id").alias("id"), "requires_source", "requires_destination", "n")
    return a.unionByName(b)


@query("write_splits", """
select sample_id, case when pos < floor(n * 0.8e0) then 'train' when pos < floor(n * 0.8e0) + floor(n * 0.1e0) then 'val' else 'test' end as split
from (select sample_id, row_number() over (order by md5(concat(sample_id, '|42')), sample_id) - 1 as pos, (select count(*) from documents) as n from v_samples) s
""")
def write_splits(v):
    path = _folder(v, "splits")
    split = ordering.seeded_split(v["v_samples"].select("sample_id"), "sample_id")
    datasets.write_splits(split.select("sample_id", "split"), path, "sample_id")
    return v.spark.read.parquet(path).select("sample_id", F.col("split").cast("string").alias("split"))


@query("relational_tables", """
select 'videos' as part, (select count(distinct video_id) from v_edges) as n_rows, 0 as n_duplicates
union all select 'tracked_objects', (select count(*) from v_nodes), 0 union all select 'events', (select count(*) from v_edges), 0
""")
def relational_tables(v):
    path = _folder(v, "graph")
    videos = v["v_edges"].select("video_id").distinct()
    datasets.write_graph_tables(videos, v["v_nodes"], v["v_edges"], path)
    out = None
    keys = {"videos": ["video_id"], "tracked_objects": ["video_id", "track_id"], "events": ["event_seq"]}
    for (name, key), table in zip(keys.items(), datasets.read_graph_tables(v.spark, path)):
        n = table.agg(F.count(F.lit(1)).alias("n_rows"))
        d = datasets.duplicate_keys(table, key).agg(F.count(F.lit(1)).cast("int").alias("n_duplicates"))
        row = n.withColumn("n_duplicates", d.scalar()).select(F.lit(name).alias("part"), "n_rows", "n_duplicates")
        out = row if out is None else out.unionByName(row)
    return out


@query("dataset_manifest", """
with p as (select d.source as video_id, count(*) as n_clips, count(l.doc_id) as n_annotated, count(*) filter (where l.quality = 1) as n_with_events, sum(n_chars) as b
  from documents d left join labels l on l.doc_id = d.doc_id group by 1)
select video_id, n_clips, n_annotated, n_with_events, round(b / 1e6, 1) as size_mb, (select count(*) from p) as total_videos, (select cast(sum(n_clips) as bigint) from p) as total_clips,
  round((select sum(b) from p) / 1e9, 2) as total_gb, (select count(*) from p) < 1000 as is_subset from p
""")
def dataset_manifest(v):
    joined = v["documents"].select("doc_id", F.col("source").alias("video_id"), "n_chars").join(
        v["labels"].select("doc_id", "quality"), "doc_id", "left"
    )
    clips = joined.withColumn("annotated", F.col("quality").isNotNull()).withColumn(
        "with_events", F.coalesce(F.col("quality") == 1, F.lit(False))
    )
    return inventory.dataset_manifest(clips, "video_id", "n_chars", "annotated", "with_events", published=1000)


@query("sample_list_scan", "select sample_id, n_bytes from v_samples where lang = 'en'")
def sample_list_scan(v):
    path = _folder(v, "ids")
    wanted = F.when(F.col("lang") == "en", F.col("sample_id")).otherwise(F.lit("  "))
    datasets.write_id_list(v["v_samples"].select(wanted.alias("sample_id")), path, "sample_id")
    return datasets.sample_list_scan(v.spark, path, v["v_samples"].select("sample_id", "n_bytes"), "sample_id")


ORDER = ["clip_index", "obj_pos"]


@query("object_defs", """
select video_id, obj_id, arg_min(category, clip_index * 1000 + obj_pos) as category from v_doc_objects group by 1, 2
""")
def object_defs(v):
    return compact.object_defs(v["v_doc_objects"], "video_id", ORDER)


_PROFILES = """
(select video_id, profile, row_number() over (partition by video_id order by first) - 1 as profile_id from (
  select video_id, concat_ws(',', case when color is not null then concat('color=', color) end, case when material is not null then concat('material=', material) end) as profile,
    min(clip_index * 1000 + obj_pos) as first from v_doc_objects group by 1, 2) p)
"""


@query("attribute_profiles", f"select video_id, profile, profile_id from {_PROFILES} q")
def attribute_profiles(v):
    out = compact.attribute_profiles(doc_rows(v)[1], "video_id", ORDER)
    entries = F.map_entries(F.from_json("profile", "map<string,string>"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("video_id", text.alias("profile"), "profile_id")


@query("frame_index_params", """
select video_id, cast(step as int) as step, cast(step * 8 as int) as stride, 16 as length from v_clips group by video_id, step
""")
def frame_index_params(v):
    clips = windows.with_frame_indices(windows.clip_windows(v["v_videos"], by="video_id"))
    return compact.frame_params(clips.select("video_id", "clip_index", "frame_indices"), "video_id")


_IRREGULAR = """
(select c.video_id, c.clip_index, c.frame_indices from v_doc_clips c
 join (select video_id, max(case when rn = 1 then frame_indices[2] - frame_indices[1] end) as step, max(case when rn = 2 then frame_indices[1] end) - max(case when rn = 1 then frame_indices[1] end) as stride
       from (select *, row_number() over (partition by video_id order by clip_index) as rn from v_doc_clips) r where rn <= 2 group by video_id) p on p.video_id = c.video_id
 where c.frame_indices <> list_transform(range(16), lambda j: cast(c.clip_index * p.stride + j * p.step as int)))
"""


@query("irregular_clips", f"select video_id, clip_index, array_to_string(frame_indices, ',') as frame_indices from {_IRREGULAR} i")
def irregular_clips(v):
    clips = v["v_doc_clips"]
    params = compact.frame_params(clips, "video_id")
    out = compact.irregular_clips(clips, params, "video_id")
    return out.withColumn("frame_indices", arrays.csv(F.col("frame_indices")))


def compacted(v):
    clips, objects, events = doc_rows(v)
    return compact.compact(clips, objects, events, "video_id", ORDER, "event_seq")


@query("compact_docs", f"""
select 'params' as part, (select count(distinct video_id) from v_doc_clips) as n, cast(0 as bigint) as marked
union all select 'defs', (select count(*) from (select distinct video_id, obj_id from v_doc_objects) d), 0
union all select 'profiles', (select count(*) from {_PROFILES} p), 0
union all select 'clips', (select count(*) from v_doc_clips), (select count(*) from {_IRREGULAR} i)
union all select 'objects', (select count(*) from v_doc_objects), (select count(*) from v_doc_objects o join (select video_id, obj_id, arg_min(category, clip_index * 1000 + obj_pos) as c from v_doc_objects group by 1, 2) d
  on d.video_id = o.video_id and d.obj_id = o.obj_id where o.category <> d.c)
union all select 'events', (select count(*) from v_doc_events), (select cast(sum(case when destination is not null then 7 when target is not null then 5 else 4 end) as bigint) from v_doc_events)
""")
def compact_docs(v):
    """Row counts of the compacted tables and how many rows carry an exception."""
    marks = {"clips": F.count("fi"), "objects": F.count("override"), "events": F.sum(F.size("e"))}
    out = None
    for name, df in compacted(v).items():
        row = df.agg(F.count(F.lit(1)).alias("n"), marks.get(name, F.lit(0)).cast("bigint").alias("marked")).select(
            F.lit(name).alias("part"), "n", "marked"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("expand_docs", "select video_id, clip_index, obj_pos, obj_id, category, first_seen_frame, color, material from v_doc_objects")
def expand_docs(v):
    objects = compact.restore(compacted(v), "video_id")["objects"]
    return objects.select(
        "video_id", "clip_index", "obj_pos", "obj_id", "category", "first_seen_frame",
        F.element_at("attributes", "color").alias("color"), F.element_at("attributes", "material").alias("material"),
    )


@query("expand_doc_clips", """
select video_id, clip_index, status, array_to_string(frame_indices, ',') as frame_indices, round(frame_indices[1] / 20.0e0, 6) as start_offset_sec,
  strftime(timestamp '2026-01-01 12:00:00' + to_microseconds(cast(frame_indices[16] * 50000 as bigint)), '%Y-%m-%dT%H:%M:%S.%f') as end_time from v_doc_clips
""")
def expand_doc_clips(v):
    """Restored clips with their frames, and times recomputed with the fraction kept."""
    clips = compact.restore(compacted(v), "video_id")["clips"]
    timed = clips.withColumn("_start", F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")).withColumn("_fps", F.lit(20.0))
    out = compact.restored_times(timed, "_start", "_fps")
    return out.select(
        "video_id", "clip_index", "status", arrays.csv(F.col("frame_indices")).alias("frame_indices"),
        F.round("start_offset_sec", 6).alias("start_offset_sec"),
        F.date_format("end_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("end_time"),
    )


@query("roundtrip_check", "select cast(0 as bigint) as n_differences")
def roundtrip_check(v):
    clips, objects, events = doc_rows(v)
    before = {"clips": clips, "objects": objects, "events": events}
    after = compact.restore(compact.compact(clips, objects, events, "video_id", ORDER, "event_seq"), "video_id")
    axes = [F.element_at("attributes", a).alias(a) for a in compact.AXES]
    columns = {
        "clips": ["video_id", "clip_index", "status", F.to_json("frame_indices").alias("frame_indices")],
        "objects": ["video_id", *ORDER, "obj_id", "category", "first_seen_frame", *axes],
        "events": ["video_id", "clip_index", "event_seq", *compact.EVENT_FIELDS],
    }
    return compact.roundtrip_differences(before, after, columns).agg(F.count(F.lit(1)).alias("n_differences"))


def _documents_in_sql(clip: str) -> str:
    return f"(select video_id, string_agg({clip}, ',' order by clip_index) as body from cl group by video_id)"


# The two texts put together by hand: all values are numbers or names without marks.
_TEXTS = f"""
q as (select *, concat('"', obj_id, '"') as qo from v_doc_objects),
d as (select video_id, obj_id, arg_min(category, clip_index * 1000 + obj_pos) as cat from v_doc_objects group by 1, 2),
pf as (select video_id, profile, profile_id from {_PROFILES} p),
ob as (select q.video_id, q.clip_index, string_agg(concat('{{"obj_id":', qo, ',"category":"', category, '","first_seen_frame":', first_seen_frame, ',"attributes":{{"color":', coalesce('"' || color || '"', 'null'),
      ',"material":', coalesce('"' || material || '"', 'null'), '}}}}'), ',' order by obj_pos) as full_o,
    string_agg(concat('[', qo, ',', first_seen_frame, ',', profile_id, case when category <> cat then concat(',"', category, '"') else '' end, ']'), ',' order by obj_pos) as short_o
  from q join d on d.video_id = q.video_id and d.obj_id = q.obj_id
  join pf on pf.video_id = q.video_id and pf.profile = concat_ws(',', case when color is not null then concat('color=', color) end, case when material is not null then concat('material=', material) end)
  group by 1, 2),
ev as (select video_id, clip_index, string_agg(concat('{{"event_id":"', event_id, '","frame":', frame, ',"action":"', action, '","agent":"', agent, '","target":', coalesce('"' || target || '"', 'null'),
      ',"source":null,"destination":', coalesce('"' || destination || '"', 'null'), '}}'), ',' order by event_seq) as full_e,
    string_agg(concat('["', event_id, '",', frame, ',"', action, '","', agent, '"', case when destination is not null then concat(',', coalesce('"' || target || '"', 'null'), ',null,"', destination, '"')
      when target is not null then concat(',"', target, '"') else '' end, ']'), ',' order by event_seq) as short_e
  from v_doc_events group by 1, 2),
cl as (select c.video_id, c.clip_index, c.status, concat('[', array_to_string(c.frame_indices, ','), ']') as fr, i.frame_indices is not null as odd, coalesce(full_o, '') as full_o, short_o, coalesce(full_e, '') as full_e, short_e
  from v_doc_clips c left join ob on ob.video_id = c.video_id and ob.clip_index = c.clip_index left join ev on ev.video_id = c.video_id and ev.clip_index = c.clip_index
  left join {_IRREGULAR} i on i.video_id = c.video_id and i.clip_index = c.clip_index),
fullt as (select video_id, concat('{{"video_id":"', video_id, '","num_clips":', (select count(*) from v_doc_clips c where c.video_id = f.video_id), ',"clips":[', body, ']}}') as t from {_documents_in_sql("""concat('{"objects":[', full_o, '],"events":[', full_e,
      '],"clip_metadata":{"clip_index":', clip_index, ',"frame_indices":', fr, ',"start_time":null,"end_time":null,"start_offset_sec":null,"end_offset_sec":null,"status":"', status, '"}}')""")} f),
shortt as (select f.video_id, concat('{{"format_version":1,"video_id":"', f.video_id, '","video_path":null,"video_metadata":null,"coverage":null,"num_clips":', (select count(*) from v_doc_clips c where c.video_id = f.video_id),
    ',"validation_stats":null,"frame_index_params":{{"step":', p.step, ',"stride":', p.stride, ',"length":16}},"object_defs":{{', coalesce(dd.t, ''), '}},"attribute_profiles":[', coalesce(pp.t, ''), '],"clips":[', body, ']}}') as t
  from {_documents_in_sql("""concat('{"i":', clip_index, ',"s":"', left(status, 1), '"', coalesce(',"o":[' || short_o || ']', ''), coalesce(',"e":[' || short_e || ']', ''), case when odd then concat(',"fi":', fr) else '' end, '}')""")} f
  left join (select video_id, max(case when rn = 1 then frame_indices[2] - frame_indices[1] end) as step, max(case when rn = 2 then frame_indices[1] end) - max(case when rn = 1 then frame_indices[1] end) as stride
    from (select *, row_number() over (partition by video_id order by clip_index) as rn from v_doc_clips) r where rn <= 2 group by video_id) p on p.video_id = f.video_id
  left join (select video_id, string_agg(concat('"', obj_id, '":"', cat, '"'), ',' order by obj_id) as t from d group by 1) dd on dd.video_id = f.video_id
  left join (select video_id, string_agg(concat('{{', case when profile = '' then '' else concat('"', replace(replace(profile, '=', '":"'), ',', '","'), '"') end, '}}'), ',' order by profile_id) as t from pf group by 1) pp on pp.video_id = f.video_id)
"""


@query("compact_document", f"with {_TEXTS} select cast(video_id as varchar) as video_id, t as value from shortt")
def compact_document(v):
    """Compact documents as they are written, read as plain text."""
    path = _folder(v, "compact")
    codec.write(codec.encode(documents(v)), path)
    text = v.spark.read.text(path)
    return text.select(F.get_json_object("value", "$.video_id").alias("video_id"), "value")


@query("expand_document", "select cast(video_id as varchar) as video_id, clip_index, obj_pos, obj_id, category, first_seen_frame, color, material, 7 as n_axes from v_doc_objects")
def expand_document(v):
    """Objects of compact documents that were written and read back."""
    path = _folder(v, "compact")
    codec.write(codec.encode(documents(v)), path)
    docs = codec.decode(codec.read(v.spark, path))
    objects = annotations.explode_objects(annotations.explode_clips(docs))
    return objects.select(
        "video_id", "clip_index", "obj_pos", "obj_id", "category", "first_seen_frame", F.element_at("attributes", "color").alias("color"),
        F.element_at("attributes", "material").alias("material"), F.size("attributes").alias("n_axes"))


@query("compression_ratio", f"""
with {_TEXTS} select a.video_id, octet_length(encode(a.t)) as before, octet_length(encode(b.t)) as after, round(100.0e0 * (octet_length(encode(a.t)) - octet_length(encode(b.t))) / octet_length(encode(a.t)), 3) as saved_pct
from fullt a join shortt b on a.video_id = b.video_id
""")
def compression_ratio(v):
    """Bytes of each annotation document before and after compaction, and the percentage saved."""
    docs = documents(v)
    full = annotations.to_json(docs).select("video_id", F.octet_length("value").cast("bigint").alias("before"))
    short = codec.encode(docs).select("video_id", F.octet_length("value").cast("bigint").alias("after"))
    b, a, saved = compact.compression(F.col("before"), F.col("after"))
    return full.join(short, "video_id").select("video_id", b.alias("before"), a.alias("after"), F.round(saved, 3).alias("saved_pct"))
