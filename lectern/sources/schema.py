"""Schemas of the stored artifacts."""

from __future__ import annotations

_GEOMETRY = "struct<precision:string,space:string,polygon:array<array<double>>,transform_ids:array<string>,basis:string>"

#: A report; unknown members are found by the strict scan, not here.
REPORT = (
    "report_id string,"
    "document struct<sha256:string,byte_length:long,page_count:int,display_name:string,source_asset_id:string>,"
    "readers array<struct<id:string,name:string,version:string,settings:map<string,string>>>,"
    "pages array<struct<index:int,media_box:array<double>,crop_box:array<double>,effective_view_box:array<double>,user_unit:double,"
    "rotation:int,canonical_size_pt:array<double>,raw_to_canonical_transform_id:string>>,"
    "transforms array<struct<id:string,page_index:int,from_space:string,to_space:string,matrix:array<double>,inverse:array<double>,operation:string>>,"
    "plan struct<selected_pages:array<int>,"
    f"regions:array<struct<id:string,page_index:int,geometry:{_GEOMETRY}>>,"
    "checks:array<struct<id:string,page_index:int,capability:string,reader_ids:array<string>,region_id:string>>>,"
    "occurrences array<struct<id:string,reader_id:string,page_index:int,ordinal:int,raw_text:string,normalized_text:string,"
    "normalization_map:array<struct<raw_start:int,raw_end:int,normalized_start:int,normalized_end:int,operation:string>>,"
    f"geometry:{_GEOMETRY},engine_score:struct<value:double,scale_min:double,scale_max:double,meaning:string>,source_asset_id:string,raw_source_locator:string>>,"
    "checks array<struct<id:string,status:string,reason:string,produced_occurrence_count:int,retained_occurrence_ids:array<string>>>,"
    "findings array<struct<id:string,kind:string,page_index:int,occurrence_ids:array<string>,check_ids:array<string>,alignment:string,region_id:string,priority:string>>,"
    "annotations array<struct<id:string,page_index:int,finding_id:string,text:string>>,"
    "execution struct<status:string,run_key:string>,"
    "assets array<struct<id:string,media_type:string,purpose:string,page_index:int,sha256:string,byte_length:long,pixel_size:array<int>,data_base64:string>>,"
    "export struct<mode:string,replay:string,included:array<string>>"
)

OCCURRENCES = (
    "document_sha256 string, page_index int, reader_id string, id string, ordinal int, raw_text string, precision string, polygon array<array<double>>, locator string"
)
MESSAGES = "arrival long, generation int, run_key string, document_sha256 string, job_id string, seq long, event string, terminal boolean, payload string"
