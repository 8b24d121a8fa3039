"""Schemas of the canonical tables."""

from __future__ import annotations

BOX = "struct<top:double,left:double,bottom:double,right:double>"
REGION = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"

TABLES: dict[str, str] = {
    "templates": "template_id bigint, name string, description string, field_schema string, "
                 "sample_image_url string, is_active boolean, created_at timestamp, updated_at timestamp",
    "template_fields": "template_id bigint, field_pos int, name string, label string, type string, "
                       "required boolean, options array<string>, hint string, section string, number string, "
                       f"strategy string, anchor_labels array<string>, region {REGION}, "
                       "ai_prompt_hint string, value_postprocess string",
    "entries": "entry_id bigint, template_id bigint, uploaded_by bigint, device_id string, verified_by bigint, "
               "image_url string, status string, raw_ocr_data string, verified_data map<string,string>, "
               "confidence_score double, processing_time double, created_at timestamp, updated_at timestamp",
    "fields": "entry_id bigint, field_name string, ocr_value string, verified_value string, confidence double, "
              "was_corrected boolean, created_at timestamp, source string, unresolved boolean, "
              "context_lines array<string>",
    "users": "user_id bigint, email string, full_name string, role string, is_active boolean, created_at timestamp",
    "audit_log": "user_id bigint, action string, entity_type string, entity_id bigint, "
                 "changes map<string,string>, description string, created_at timestamp",
    "ocr_lines": f"entry_id bigint, page int, line_no bigint, text string, confidence double, box {BOX}",
    "detections": f"entry_id bigint, det_no bigint, name string, state string, confidence double, box {BOX}, "
                  "anchor_text string",
    "visual_boxes": "entry_id bigint, box_no bigint, x double, y double, width double, height double, "
                    "fill_percentage double, is_checked boolean, confidence double",
    "model_responses": "entry_id bigint, pass_no int, response_text string, ts timestamp",
    "progress_events": "form_id bigint, status string, confidence_score double, message string, ts timestamp",
    "verifications": "entry_id bigint, verifier_id bigint, verified_fields map<string,string>, ts timestamp",
    "images": "path string, entry_id string, md5 string, length bigint, mime string, year int, month int",
    "errors": "entry_id bigint, stage string, error_type string, message string, attempt int, ts timestamp",
}

# JSON text of one template: flat fields, each with optional extraction directives.
FIELD_JSON = (
    "struct<name:string,label:string,type:string,required:boolean,options:array<string>,hint:string,"
    "section:string,number:string,extraction:struct<strategy:string,anchor_labels:array<string>,"
    f"search_region:{REGION},ai_prompt_hint:string,value_postprocess:string>>"
)
TEMPLATE_JSON = f"struct<fields:array<{FIELD_JSON}>>"
SECTIONS_JSON = f"struct<sections:array<struct<title:string,fields:array<{FIELD_JSON}>>>>"
