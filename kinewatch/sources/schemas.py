"""Declared schemas of every file source. Nothing is inferred."""

CORRUPT = "_corrupt_record"

DETECTION = (
    "detection_id string, frame_id long, timestamp_seconds double, bbox_xyxy array<double>, "
    "frame_width int, frame_height int, class_id int, class_name string, confidence double, "
    "source_id string, session_id string")
TRACKED = DETECTION + ", track_id int"
FRAME = (
    "frame_id long, timestamp_seconds double, frame_width int, frame_height int, "
    "source_id string, session_id string")
COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,"
    "area:double,iscrowd:int>>, "
    "categories array<struct<id:bigint,name:string,supercategory:string>>")
CLIP = (
    "subject_id int, location_id int, label string, partition string, "
    "small_validation_subset boolean, video_id string, relative_path string, bytes long, "
    "sha256 string, fps double, frames long, duration_seconds double, width int, height int")
METRICS = (
    "struct<clips:bigint,true_positive_clips:bigint,false_positive_clips:bigint,"
    "false_negative_clips:bigint,true_negative_clips:bigint,precision:double,recall:double,"
    "specificity:double,f1:double>")
REPORT_ROW = (
    "struct<video_id:string,subject_id:int,partition:string,expected_fall:boolean,"
    "predicted_fall:boolean,predicted_event_count:bigint,first_event_start_seconds:double>")
REPORT = (
    "validation_kind string, implementation_git_commit string, "
    "pipeline_implementation_sha256 string, partition string, model_variant string, "
    "weights_sha256 string, weights_path string, config_sha256 string, manifest_sha256 string, "
    f"selected_video_ids array<string>, metrics_by_partition map<string,{METRICS}>, "
    f"rows array<{REPORT_ROW}>")
IMAGE_REF = "struct<path:string,sha256:string,width:int,height:int,kind:string,retained:boolean>"
TARGET = (
    "struct<decision:string,confidence:double,reason:string,attempt_to_stand:boolean,"
    "risk_level:string,provider:string,model:string,input_mode:string,latency_ms:double,"
    "schema_valid:boolean,provider_success:boolean,model_recommends_alert:boolean,"
    "fallback_reason:string,input_tokens:bigint,output_tokens:bigint,ground_truth_verified:boolean>")
SAMPLE = (
    "sample_id string, source_id string, session_id string, event_id string, person_id string, "
    f"image_refs array<{IMAGE_REF}>, text_context string, target {TARGET}, split_group string")
