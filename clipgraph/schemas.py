"""Schemas of annotation documents and event graphs."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, DBL = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


OBJECT = _struct(obj_id=STR, category=STR, first_seen_frame=INT, attributes=T.MapType(STR, STR))
EVENT = _struct(event_id=STR, frame=INT, action=STR, agent=STR, target=STR, source=STR, destination=STR)
CLIP_METADATA = _struct(
    clip_index=INT, frame_indices=T.ArrayType(INT), start_time=STR, end_time=STR,
    start_offset_sec=DBL, end_offset_sec=DBL, status=STR,
)
CLIP_BODY = _struct(objects=T.ArrayType(OBJECT), events=T.ArrayType(EVENT))
CLIP = _struct(objects=T.ArrayType(OBJECT), events=T.ArrayType(EVENT), clip_metadata=CLIP_METADATA)
VIDEO_METADATA = _struct(
    video_start_time=STR, source_fps=DBL, target_fps=DBL, total_frames=INT, duration_sec=DBL, video_end_time=STR
)
COVERAGE = _struct(
    total_clips=INT, annotated_clips=INT, motion_filtered_clips=INT, clips_with_events=INT, time_range=STR,
    motion_filtered_ranges=T.ArrayType(_struct(start=STR, end=STR)),
)
VALIDATION_STATS = _struct(
    total_annotations=INT, total_events_input=INT, total_events_output=INT, total_events_discarded=INT,
    discard_rate=DBL, total_warnings=INT,
)
ANNOTATION_DOC = _struct(
    video_id=STR, video_path=STR, video_metadata=VIDEO_METADATA, coverage=COVERAGE, num_clips=INT,
    validation_stats=VALIDATION_STATS, clips=T.ArrayType(CLIP),
)
