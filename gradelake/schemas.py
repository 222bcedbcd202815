"""Schemas of the stored tables. ``!`` in the comments below marks what must not be null."""

from __future__ import annotations

CHUNK = "struct<id:int,text:string,tokens:int,page:int,grounding_score:double,title:string>"
TOPIC = "struct<id:string,title:string,description:string,chunk_indices:array<int>,concepts:array<string>>"
MODULE = f"struct<id:string,title:string,description:string,topics:array<{TOPIC}>,chunk_indices:array<int>,weight:double>"

TABLES = {
    "documents": f"id long, title string, original_name string, content string, chunks array<{CHUNK}>, status string, uploaded_at timestamp, syllabus_analysis variant, module_structure array<{MODULE}>",
    "question_sets": "id long, document_id long, total_questions int, created_at timestamp, question_types map<string,int>, module_filter array<string>, document_weights map<bigint,double>, is_published boolean, published_at timestamp, due_date timestamp, time_limit_minutes int",
    "questions": "id long, set_id long, document_id long, question_text string, question_type string, options string, correct_answer string, concept_tag string, difficulty string, explanation string, grounding_chunk string, points int, created_at timestamp",
    "students": "id long, name string, email string, avatar string, created_at timestamp",
    "profiles": "id string, email string, name string, role string, avatar string, created_at timestamp",
    "submissions": "id long, student_id long, set_id long, document_id long, answers array<struct<question_id:bigint,student_answer:string,max_score:int>>, score int, total int, status string, submitted_at timestamp",
    "answers": "id long, submission_id long, question_id long, student_answer string, is_correct boolean, score int, max_score int, feedback string, conceptual_gap string, created_at timestamp",
    "study_materials": "id long, title string, description string, file_name string, file_type string, file_size long, file_data string, file_url string, category string, is_published boolean, published_at timestamp, created_at timestamp, updated_at timestamp",
}

#: Columns that must hold a value, and the values that a column may hold.
REQUIRED = {
    "documents": ["id", "title"],
    "question_sets": ["id"],
    "questions": ["id", "question_text", "question_type", "correct_answer"],
    "students": ["id", "name", "email"],
    "profiles": ["id", "email"],
    "submissions": ["id", "answers"],
    "answers": ["id"],
    "study_materials": ["id", "title", "file_name"],
}
ALLOWED = {
    "questions": {"question_type": ["mcq", "short", "conceptual"], "difficulty": ["Easy", "Medium", "Hard"]},
    "profiles": {"role": ["teacher", "student"]},
}
#: Values that a null takes when a row is inserted.
DEFAULTS = {
    "documents": {"status": "parsed"},
    "question_sets": {"total_questions": 0, "is_published": False},
    "questions": {"points": 10},
    "submissions": {"status": "pending"},
    "answers": {"is_correct": False, "score": 0, "max_score": 10},
    "study_materials": {"category": "syllabus", "is_published": False},
}
#: Child table and its column for each parent, in the order of deletion.
CHILDREN = {
    "documents": [("question_sets", "document_id"), ("questions", "document_id"), ("submissions", "document_id")],
    "question_sets": [("questions", "set_id"), ("submissions", "set_id")],
    "students": [("submissions", "student_id")],
    "submissions": [("answers", "submission_id")],
    "questions": [("answers", "question_id")],
}
