"""Schemas of the documents that stages exchange."""

from __future__ import annotations

BOX = "array<array<double>>"
ENTRY = f"struct<box:{BOX},text:string,confidence:double,tile_index:bigint>"
WINDOW = (
    "struct<window_index:bigint,crop:struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint,width:bigint,height:bigint>,processed_width:bigint,processed_height:bigint,"
    "scale:double,tile_count:bigint,entry_count:bigint,tiles:array<struct<tile_index:bigint,x:bigint,y:bigint,width:bigint,height:bigint>>,text:string>"
)
METADATA = (
    "struct<source_image:string,source_width:bigint,source_height:bigint,lang:string,window_width:bigint,window_height:bigint,step_x:bigint,step_y:bigint,"
    "max_side:bigint,tile_size:bigint,tile_overlap:bigint,max_tiles:bigint,windows_scanned:bigint>"
)
LINE_RESULT = "struct<line_image:string,selected_variant:string,selected_mean_score:double,selected_heuristic_score:double,selected_by:string,text:string,segments:array<string>>"
MODELS = f"map<string,struct<available:boolean,reason:string,text:string,line_results:array<{LINE_RESULT}>>>"

PAGE_SCAN = f"metadata {METADATA}, windows array<{WINDOW}>, entries array<{ENTRY}>"
#: Either kind of recognition result: a scan has entries, a model comparison has models.
RECOGNITION = f"source_image string, metadata {METADATA}, entries array<{ENTRY}>, models {MODELS}"
CHUNK_ENTRY = f"struct<text:string,line_index:int,line_image:string,segments:array<string>,box:{BOX}>"
CHUNK = f"chunk_index int, line_count int, char_count int, bounds struct<x1:double,y1:double,x2:double,y2:double>, text string, entries array<{CHUNK_ENTRY}>, phase2_tasks array<string>"
ANNOTATION = "line_index int, reviewer string, verdict string, final_text string, notes string, updated_at string"
