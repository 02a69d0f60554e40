"""Explicit schemas of the library's tables, as DDL text (readable before a session exists)."""

from __future__ import annotations

SAMPLES = (
    "stream_id string, epoch bigint, seq bigint, pts_value bigint, pts_scale int, pts_ns bigint, "
    "arrival_ns bigint, width int, height int, pixel_format string, plane_count int, "
    "stride_bytes int, attrs map<string,string>, content_hash bigint, payload binary, status string")
PACKETS = (
    "session_id string, packet_no bigint, pts_ns bigint, duration_s double, n_samples bigint, "
    "sample_rate double")
LEDGER = ("session_id string, pts_ns bigint, status string")
SESSIONS = (
    "session_id string, width int, height int, start_ns bigint, stop_ns bigint, idle_primed boolean")
INGRESS = (
    "stream_id string, arrival_s double, pts_ns bigint, generation bigint, token bigint, "
    "accepted_seq bigint, accepted_epoch bigint")
PRESENTATIONS = (
    "stream_id string, epoch bigint, seq bigint, generated boolean, presented_s double")
COSTS = (
    "stream_id string, epoch bigint, seq bigint, kind string, cpu_s double, gpu_s double, span_s double")
EVIDENCE = (
    "stream_id string, epoch bigint, seq bigint, end_ns bigint, content_fps double, strict boolean")
FORMATS = (
    "device_id string, format_idx int, width int, height int, pixel_format string, "
    "rates array<struct<lo:double,hi:double>>")
DEVICES = (
    "device_id string, kind string, name string, transport string, external boolean")
WINDOWS = (
    "window_id bigint, owner string, owner_id string, title string, x double, y double, w double, h double")
DISPLAYS = (
    "display_id bigint, x double, y double, w double, h double, scale double, refresh int")
TILES = ("stream_id string, seq bigint, bx int, by int, luma double")
# Stored settings: fields added later are missing from older records.
SETTINGS = (
    "brightness double, contrast double, saturation double, sharpness double, vibrance double, "
    "low_latency boolean, enhancement boolean, strength double, target string, method string, "
    "mode string, preferred_mode string, force boolean, skip_duplicates boolean")
# What a missing setting means.
SETTING_DEFAULTS = {
    "brightness": 0.0, "contrast": 1.0, "saturation": 1.0, "sharpness": 0.0, "vibrance": 0.0,
    "low_latency": True, "enhancement": True, "strength": 0.6, "target": "native", "method": "metalfx",
    "mode": "off", "preferred_mode": "flow", "force": False, "skip_duplicates": True,
}
