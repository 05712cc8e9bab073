"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

PHOTO_FILE = "id string, path string, seq int, sha1 string, bytes long"
CACHE_MANIFEST = "path string, size long, mtime_ms double, sha1 string"
ANALYSIS_CACHE = "sha1 string, fingerprint string, status string, error string, result string"
BOX = "struct<x:int,y:int,w:int,h:int>"
FACE = f"face_idx int, face_id string, photo_id string, box {BOX}, score double, native_width int, frontality double, sharpness double, refined boolean, descriptor array<double>"
PHOTO = "id string, w int, h int, c string, dg int"
LEDGER_PERSON = "id string, ordinal int"
LEDGER_ANCHOR = "id string, face_id string"
LEDGER_ALIAS = "from_id string, to_id string"
LEDGER_COUNTER = "next_id int, next_ordinal int"
DECISION = "pair_key string, a string, b string, name_a string, name_b string, decision string, decided_at timestamp, applied_at timestamp"
REVIEW_PAIR = "a string, b string, distance double, reason string"
ATTRIBUTES = "struct<name:string,featured:boolean,`order`:int,cover:string,hidden:boolean>"
OVERRIDES = f"people map<string,{ATTRIBUTES}>, merge array<array<string>>, split map<string,struct<moveFaces:array<string>,`to`:string>>, include map<string,array<string>>, ignoreFaces array<string>, ignorePhotos array<string>, doNotMerge array<array<string>>"
PERSON = "id string, ordinal int, name string, featured boolean, photoCount int, photos array<string>"
PHOTO_FACES = "photo string, faces array<struct<p:string,b:array<double>>>"
