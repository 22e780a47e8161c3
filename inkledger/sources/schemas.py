"""Explicit schemas of the entities that are read and written. Nothing is inferred."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
POLYGON = f"array<{POINT}>"
FIELD = f"struct<field_name:string,text:string,handwritten:boolean,quad:{POLYGON},bbox_clipped:array<double>,visible_fraction:double>"
CANONICAL = "struct<amount_cents:bigint,date_iso:string,check_number:string,payee_canonical:string,layout_family:string,handwriting_font_id:string,signature_font_id:string>"
CHECK = (
    f"struct<check_index:int,template_id:string,size_kind:string,corners:{POLYGON},outline:{POLYGON},rotation_degrees_clockwise:double,orientation_class:int,"
    f"fully_in_frame:boolean,in_frame_fraction:double,visible_fraction:double,deformation:map<string,string>,fields:array<{FIELD}>,canonical:{CANONICAL}>"
)
SCENE = f"scene_id string, image_file string, image_width int, image_height int, background_id string, layout_mode string, harmonized boolean, jpeg_quality int, effects string, checks array<{CHECK}>"
OCR_ROW = (
    "scene_id string, split string, check_index int, field_name string, text string, handwritten boolean, status string, usable boolean, visible_fraction double, check_visible_fraction double, "
    "check_width_in_photo_px double, text_height_in_photo_px double, check_crop string, field_crop string, box_in_check_crop array<double>, field_crop_window array<int>, check_crop_size array<int>, "
    "template_id string, layout_family string, size_kind string, orientation_class int, pen_font_id string, handwriting_font_id string, signature_font_id string, background_id string, deformed boolean"
)
PREDICTION = "row_key string, scene_id string, check_index int, field_name string, method string, localization string, pred_text string, confidence double, pred_box array<double>, latency_ms double"
BOX_PREDICTION = "row_key string, scene_id string, check_index int, field_name string, pred_box array<double>, confidence double"
DETECTIONS = f"detector_name string, split string, scenes map<string,array<struct<corners:{POLYGON},score:double,orientation_known:boolean>>>"
HISTORY = "check_number string, payer string, date string, batch_date string"
SETTINGS = "date_display_format string, copy_columns array<struct<key:string,included:boolean>>, handwriting_reader_enabled boolean"
