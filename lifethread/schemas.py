"""Record schemas, declared once; readers never infer."""

from __future__ import annotations

_SEGMENTS = "array<struct<start_time double, end_time double>>"
_SCORES = "struct<text_similarity double, vision_similarity double>"
_MATCH = (
    "struct<is_new boolean, text_similarity double, vision_similarity double, final_score double, error string, "
    f"unmatched_candidates map<string, {_SCORES}>>"
)
_OBJECT = (
    "struct<name string, description string, action string, location string, first_appearance_time double, "
    f"interaction_segments {_SEGMENTS}, bbox array<array<double>>, timestep array<double>, score array<double>, "
    f"event_id string, global_name string, match_info {_MATCH}>"
)
_SPEECH = (
    "struct<start_time double, end_time double, speaker string, text string, description string, reason string, global_voice string>"
)

EVENT = (
    "event_id string, timestamp string, video_path string, caption string, "
    f"attributes struct<interaction_object: array<{_OBJECT}>, interaction_action: string, interaction_language: array<{_SPEECH}>, "
    "interaction_state: string, interaction_location: string, interaction_time: string>, "
    "relations array<struct<related_event_id string, type string, reason string, time_diff_seconds double>>, "
    "linked_entities struct<persons array<string>, objects array<string>>, "
    "features struct<caption_embedding_path string, vision_feature_path string, audio_feature_path string>, "
    "metadata struct<created_at string, person_name string, day int>"
)
ASR = (
    "event_id string, audio_path string, duration double, language string, "
    "speech_segments array<struct<start_time double, end_time double, speaker string, text string>>"
)
TRACK = (
    "event_id string, video_path string, objects array<struct<object_name string, object_info struct<name string, description string, "
    "action string>, bbox array<array<double>>, timestep array<double>, score array<double>, initial_detections array<struct<frame_idx int, "
    "timestamp_sec double, bbox array<double>, score double>>, image_paths array<string>, metadata struct<num_frames int>>>, "
    "metadata struct<created_at string, num_objects int>"
)
# A description may be written as an object or as a JSON string of one; both are read as text first.
ENTITY = (
    "global_name string, descriptions array<string>, related_events array<struct<event_id string, local_name string, "
    "match_score struct<is_new boolean, text_similarity double, vision_similarity double, final_score double>>>, "
    f"representative_images array<string>, unmatched_candidates map<string, {_SCORES}>, "
    "metadata struct<created_at string, last_updated string, match_count int>"
)
DESCRIPTION = "text string, action string, source_event string, timestamp string"
VOICE = (
    "voice_id string, name string, register_event string, register_time string, feature_path string, "
    "history_features array<struct<event_id string, row_index int, match_score double, duration double>>, "
    "related_events array<struct<event_id string, speaker_label string, language string, duration double, match_score double>>, "
    "related_descriptions array<struct<event_id string, descriptions array<string>>>, "
    "related_person map<string, struct<event_ids array<string>, count int>>, "
    "related_action array<struct<event_id string, action string>>, register_score array<struct<voice_id string, match_score double>>"
)
QA = (
    "ID string, question string, type string, need_name boolean, need_audio boolean, query_time struct<date string, time string>, "
    "target_time struct<date string, time string, time_list array<string>>"
)
NODE = "id string, label string, meta_id bigint, timestamp string, t_sec double, name string, text string"
EDGE = "src string, dst string, type string, props map<string, string>"
