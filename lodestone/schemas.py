"""Schemas of records, as DDL: lists and maps are columns, times are UTC."""

from __future__ import annotations

OFFER = {
    "source": "string", "source_job_id": "string", "source_url": "string", "title": "string", "company": "string", "location": "string", "city": "string", "country": "string", "description": "string",
    "employment_type": "string", "job_type": "string", "remote_type": "string", "salary_min": "double", "salary_max": "double", "salary_currency": "string", "salary_period": "string", "experience_level": "string",
    "skills": "array<string>", "posted_at": "timestamp", "priority": "int",
}
USAGE_EVENT = {"id": "string", "user_id": "string", "kind": "string", "meta": "map<string,string>", "created_at": "timestamp"}
MESSAGE = {"id": "string", "conversation_id": "string", "user_id": "string", "role": "string", "content": "string", "created_at": "timestamp"}
SOURCE_RUN = {"source": "string", "ts": "timestamp", "state": "string", "offers": "int", "duration_ms": "int"}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())
