"""Schemas of the library's tables, as DDL; production reads declare them and never infer."""

CELLS = "grid_id bigint, x int, y int, v int"
COLOUR_CELLS = "grid_id bigint, x int, y int, r int, g int, b int"
BOXES = "grid_id bigint, line_id bigint, box_id bigint, x int, y int, w int, h int"
READINGS = "part_id bigint, reading_id bigint, template string, raw string"
SETTINGS = "line_no bigint, text string"
INSPECTIONS = "part_id bigint, run_ts timestamp, point_id int, ok boolean, unsure boolean"
CAPTURE_EVENTS = "event_id bigint, ts timestamp, camera_id bigint, kind string, value double"
DETECTIONS = "scan_id bigint, variant int, code string"
FRAMES = "path string, modificationTime timestamp, length bigint, content binary"
