"""Edits of structured documents: a closed list of operations, folded over each document in order.

A document is a struct of ``STATE``, an edit one of ``EDIT``; an edit that can't be done changes
nothing and leaves the reason.  Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.profile import let

STATE = (
    "struct<professional_summary:string,career_objective:string,language:string,skills:array<struct<category:string,skills:array<string>>>,additional_skills:array<string>,"
    "experience:array<struct<position:string,bullets:array<string>>>,body:string,recipient:string>"
)
EDIT = "struct<op:string,value:string,skill:string,category:string,from_name:string,to_name:string,role_index:int,bullet_index:int,order:array<int>,recipient:string>"
LANGUAGES = ["fr", "en"]


def _strip(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")


def _either(a: Column, b: Column) -> Column:
    """``a``, or ``b`` where ``a`` is null or empty; trimmed."""
    return _strip(F.coalesce(F.nullif(a, F.lit("")), b))


def _list(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.array().cast(f"array<{kind}>"))


def _inside(i: Column, xs: Column) -> Column:
    return F.coalesce((i >= 0) & (i < F.size(xs)), F.lit(False))


def _replaced(xs: Column, at: Column, new) -> Column:
    return F.transform(xs, lambda x, i: F.when(i == at, new(x)).otherwise(x))


def _pick(op: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for name, value in reversed(cases.items()):
        out = F.when(op == name, value).otherwise(out)
    return out


def _refusal(kind: Column, s: Column, e: Column) -> Column:
    """Why the edit can't be done; null if it can."""
    op, none = e["op"], F.lit(None).cast("string")
    when = lambda wrong, why: F.when(wrong, F.lit(why))
    categories, roles = _list(s["skills"], "struct<category:string,skills:array<string>>"), _list(s["experience"], "struct<position:string,bullets:array<string>>")
    skill, order = _either(e["skill"], e["value"]), F.array_sort(_list(e["order"], "int"))
    same = lambda x: F.lower(x) == F.lower(skill)
    places = F.transform(roles, lambda r, i: i)
    role = ~_inside(e["role_index"], roles)
    bullets = _list(F.get(roles, e["role_index"])["bullets"], "string")
    paragraph = F.coalesce(e["role_index"], e["bullet_index"])
    cv = {
        "set_summary": none,
        "set_career_objective": none,
        "set_language": when(~F.lower(_strip(e["value"])).isin(LANGUAGES), "language"),
        "add_skill": when(skill == "", "skill"),
        "accept_suggested_skill": F.coalesce(when(skill == "", "skill"), when(~F.exists(_list(s["additional_skills"], "string"), same), "suggestion")),
        "remove_skill": when(~F.exists(categories, lambda c: F.exists(c["skills"], same)), "skill"),
        "rename_skill_category": when(~F.exists(categories, lambda c: F.lower(c["category"]) == F.lower(_strip(e["from_name"]))), "category"),
        "reorder_experience": when(order != places, "order"),
        "add_bullet": F.coalesce(when(role, "role"), when(_strip(e["value"]) == "", "text")),
        "edit_bullet": F.coalesce(when(role, "role"), when(~_inside(e["bullet_index"], bullets), "bullet")),
        "remove_bullet": F.coalesce(when(role, "role"), when(~_inside(e["bullet_index"], bullets), "bullet")),
    }
    letter = {"set_letter_body": none, "set_recipient": none, "replace_letter_paragraph": when(~_inside(paragraph, _paragraphs(s)), "paragraph")}
    unknown = F.coalesce(when(role, "role"), F.lit("operation"))
    return F.when(kind == "cv", _pick(op, cv, unknown)).otherwise(_pick(op, letter, F.lit("operation")))


def _paragraphs(s: Column) -> Column:
    return F.split(F.coalesce(s["body"], F.lit("")), "\n\n")


def _edited(s: Column, e: Column) -> Column:
    """The document after an edit that can be done."""
    op, value = e["op"], _strip(e["value"])
    categories, roles = _list(s["skills"], "struct<category:string,skills:array<string>>"), _list(s["experience"], "struct<position:string,bullets:array<string>>")
    skill = _either(e["skill"], e["value"])
    differs = lambda x: F.lower(x) != F.lower(skill)
    group = lambda name, skills: F.struct(name.alias("category"), skills.alias("skills"))
    wanted = F.coalesce(F.nullif(_strip(e["category"]), F.lit("")), F.get(categories, F.lit(0))["category"], F.lit("Skills"))
    place = lambda name: (F.array_position(F.transform(categories, lambda c: F.lower(c["category"])), F.lower(name)) - 1).cast("int")
    more = lambda c: group(c["category"], F.when(F.array_contains(c["skills"], skill), c["skills"]).otherwise(F.concat(c["skills"], F.array(skill))))
    added = F.when(place(wanted) < 0, F.concat(categories, F.array(group(wanted, F.array(skill))))).otherwise(_replaced(categories, place(wanted), more))
    fewer = F.filter(F.transform(categories, lambda c: group(c["category"], F.filter(c["skills"], differs))), lambda c: F.size(c["skills"]) > 0)
    renamed = _replaced(categories, place(_strip(e["from_name"])), lambda c: group(_either(e["to_name"], e["value"]), c["skills"]))

    def with_bullets(new) -> Column:
        return _replaced(roles, e["role_index"], lambda r: F.struct(r["position"].alias("position"), new(_list(r["bullets"], "string")).alias("bullets")))

    ordered = F.transform(_list(e["order"], "int"), lambda i: F.get(roles, i))
    body = F.array_join(_replaced(_paragraphs(s), F.coalesce(e["role_index"], e["bullet_index"]), lambda p: value), "\n\n")
    accepted = F.filter(_list(s["additional_skills"], "string"), differs)
    fields = {
        "professional_summary": {"set_summary": value},
        "career_objective": {"set_career_objective": value},
        "language": {"set_language": F.lower(value)},
        "skills": {"add_skill": added, "accept_suggested_skill": added, "remove_skill": fewer, "rename_skill_category": renamed},
        "additional_skills": {"accept_suggested_skill": accepted},
        "experience": {
            "reorder_experience": ordered,
            "add_bullet": with_bullets(lambda b: F.concat(b, F.array(value))),
            "edit_bullet": with_bullets(lambda b: _replaced(b, e["bullet_index"], lambda x: value)),
            "remove_bullet": with_bullets(lambda b: F.filter(b, lambda x, i: i != e["bullet_index"])),
        },
        "body": {"set_letter_body": value, "replace_letter_paragraph": body},
        "recipient": {"set_recipient": _either(e["recipient"], e["value"])},
    }
    return F.struct(*[_pick(op, cases, s[name]).alias(name) for name, cases in fields.items()])


def edited(kind: Column, source: Column, edits: Column) -> Column:
    """struct<source, refused>: the document after all edits in order, and the reason (null if done) of each.

    ``kind`` is "cv" or "letter"; null edits or an empty list change nothing; positions count from 0.
    """
    start = F.struct(source.cast(STATE).alias("source"), F.array().cast("array<string>").alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        new = lambda why: F.struct(F.when(why["w"].isNull(), _edited(acc["source"], e)).otherwise(acc["source"]).cast(STATE).alias("source"), F.concat(acc["refused"], F.array(why["w"])).alias("refused"))
        return let(F.struct(_refusal(kind, acc["source"], e).alias("w")), new)

    return F.aggregate(_list(edits.cast(f"array<{EDIT}>"), EDIT), start, step)


def apply_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, kind, source) after the edits (doc_id, seq, edit) of each document, with the reasons of those that were refused."""
    todo = edits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "edit"))), lambda x: x["edit"]).alias("__e"))
    done = documents.join(todo, "doc_id", "left").withColumn("__r", edited(F.col("kind"), F.col("source"), F.col("__e")))
    return done.select("doc_id", "kind", "__r.source", "__r.refused")
