"""The canonical tables: videos, images, detections, topology, claims, similarity."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _L, _I, _S, _B = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PITCH_BOX = _struct(x_bottom_left=_D, y_bottom_left=_D, x_bottom_middle=_D, y_bottom_middle=_D, x_bottom_right=_D, y_bottom_right=_D)
IMAGE_BOX = _struct(x=_D, y=_D, w=_D, h=_D, x_center=_D, y_center=_D)
ATTRIBUTES = _struct(role=_S, team=_S, jersey=_S)
VIDEOS = _struct(video_id=_S, name=_S, split=_S, n_frames=_L, frame_rate=_D, im_width=_I, im_height=_I, game_id=_S)
IMAGES = _struct(video_id=_S, image_id=_S, frame=_L, file_path=_S, is_labeled=_B, h=T.ArrayType(T.ArrayType(_D)))
DETECTIONS = _struct(
    video_id=_S, image_id=_S, det_id=_L, track_id=_L, bbox_ltwh=T.ArrayType(_D), bbox_conf=_D, category_id=_I, bbox_pitch=PITCH_BOX,
    role=_S, team=_S, jersey_number=_S,
)
#: What the topology operators read: one row for each detection, in metres from the centre.
POSITIONS = _struct(frame=_L, track_id=_L, team=_S, role=_S, jersey_number=_I, x=_D, y=_D)
SPAN = _struct(start_s=_D, end_s=_D)
ASSESSMENT = _struct(tactic_id=_S, verdict=_S, confidence=_D, evidence_spans=T.ArrayType(SPAN))
CLAIMS = _struct(clip_uid=_S, tactic_id=_S, gt_verdict=_S, window=SPAN, score_set=_S)
RUNS = _struct(clip_uid=_S, assessments=T.ArrayType(ASSESSMENT))
SIMILARITY = _struct(seq=_S, t=_L, gt_id=_L, tracker_id=_L, sim=_D)
LABELS = _struct(
    info=_struct(id=_S, name=_S, game_id=_S, version=_S, frame_rate=_D, seq_length=_L, im_dir=_S),
    images=T.ArrayType(_struct(image_id=_S, file_name=_S, width=_I, height=_I, is_labeled=_B)),
    annotations=T.ArrayType(
        _struct(id=_S, image_id=_S, track_id=_L, supercategory=_S, category_id=_I, bbox_image=IMAGE_BOX, bbox_pitch=PITCH_BOX, attributes=ATTRIBUTES)
    ),
    categories=T.ArrayType(_struct(id=_I, name=_S)),
)
