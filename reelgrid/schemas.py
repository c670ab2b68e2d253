"""Explicit schemas of every table; nothing is inferred."""

POINT = "struct<x:double,y:double,v:int,src_conf:double>"
POINTS = f"array<{POINT}>"
ORIENTATION = "struct<schema_version:string,north_convention:string,anchor_frame_id:string,method:string,locked_at:string,declared_end:string>"
SCHEMA_REF = "struct<schema_name:string,schema_version:string>"

CLIP_FIELDS = (
    "filename string, path string, fps double, width int, height int, frame_count long, interval_s double, file_size long, "
    f"file_mtime double, extracted_at string, orientation {ORIENTATION}, done boolean"
)
CLIPS = f"clip_id string, {CLIP_FIELDS}"
FRAME_FIELDS = "clip_id string, frame_index long, timestamp_s double, image string, thumb string, triage string, label_status string"
FRAMES = f"frame_id string, {FRAME_FIELDS}"
LABELS = (
    f"frame_id string, image_w int, image_h int, num_keypoints int, schema {SCHEMA_REF}, orientation {ORIENTATION}, "
    f"visible_ends string, keypoints {POINTS}, saved_at string"
)

DETECTION = "struct<xyxy:array<double>,cls:int,name:string,conf:double,track_id:bigint>"
COURT = "struct<visible_keypoints:int,homography:array<array<double>>,used_keypoint_ids:array<string>,keypoints:array<array<double>>>"
PLAYER = "struct<track_id:bigint,cls:int,name:string,conf:double,bbox:array<double>,foot_px:array<double>,court_ft:array<double>>"
BALL = "struct<conf:double,bbox:array<double>,center_px:array<double>,court_ft:array<double>>"
RECORD = f"frame_index bigint, timestamp_s double, shot_id int, scene_cut boolean, court {COURT}, players array<{PLAYER}>, ball {BALL}, error string"
SEGMENT = "struct<index:int,start_frame:bigint,end_frame:bigint,n_records:bigint,errors:bigint,path:string,status:string>"
RUN_MANIFEST = (
    "schema_version string, record_schema_version string, video string, resume_key string, profile string, "
    "video_info struct<fps:double,width:int,height:int,frame_count:bigint>, config string, last_shot_id int, "
    f"segments array<{SEGMENT}>, summary struct<frames_processed:bigint,frames_with_homography:bigint,errors:bigint,shots:bigint,unique_tracks:bigint>, status string"
)
RECORD_VERSION = "frames-1.0.0"
MANIFEST_VERSION = "run-1.0.0"

TRIAGE = ("pending", "keep", "skip")
VISIBLE_ENDS = ("north", "south", "both")
ORIENTATION_MODES = ("both_ends_visible", "declared")
NORTH_CONVENTION = "image_left_basket"
