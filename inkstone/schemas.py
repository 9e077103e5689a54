"""Schemas and fixed vocabularies of the data model."""

from __future__ import annotations

ENTRY = "id string, title string, collection string, category string, subcategory string, author string, filename string, size long, line_count int, preview string, ord long"
BLOCK = "book_id string, block_seq int, block_id string, type string, content string, level int, source_start int, source_end int, confidence double, parser string"
OVERRIDE = "book_id string, key string, type string, level int, reviewed_at long"
ILLUSTRATION = "book_id string, key string, image string, caption string, position string, ai_generated boolean"
PROGRESS = "user_id string, book_id string, data_json string, updated_at long"
QUOTA = "quota_key string, day string, count long"
USER = "id string, email string, name string, created_at long"
EVENT = "event string, user_id string, session_id string, book_id string, platform string, extra_json string, created_at long"
STORED_EVENT = f"id string, batch_id string, {EVENT}"
JOB = "id string, book_id string, block_id string, type string, source_text string, status string, error string, prompt string, image_url string, created_at long, updated_at long"
IMAGE_ASSET = "id string, source string, copyright string, ai_generated boolean, is_verified boolean"

#: The types of blocks, those that a reviewer may assign, and the names of events.
BLOCK_TYPES = (
    "heading", "subheading", "paragraph", "quote", "annotation", "commentary", "list", "verse", "formula", "table",
    "image", "image-caption", "separator", "original-note", "editor-note", "ai-explanation",
)
REVIEW_TYPES = ("heading", "subheading", "paragraph", "quote", "verse", "annotation", "commentary", "original-note", "separator")
EVENT_NAMES = (
    "page_view", "book_open", "chapter_open", "reading_progress", "reading_page_turn", "text_select",
    "bookmark_create", "note_create", "search", "ai_question", "ai_explanation", "music_play", "music_pause",
    "share", "recommendation_click", "illustration_generate", "illustration_view",
)
LOW_CONFIDENCE = 0.7
PARSER_VERSION = "rule-v3"
HUMAN_REVIEW = "human-review"
