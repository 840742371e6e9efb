"""Names and edits of people's documents beside results labelled by hand, and document bytes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import roles as R
from ..functions import names as N
from ..operators import edits as D
from ..sources import files as W
from ..storage import ship
from .labelled import _part, labelled
from .queries import query

_SOURCE = {"skills": [{"category": "Languages", "skills": ["Python", "Go"]}, {"category": "Tools", "skills": ["git"]}], "additional_skills": ["Rust", "Helm"], "language": "en", "experience": [{"position": "Cook", "bullets": ["a", "b"]}, {"position": "Baker", "bullets": []}], "body": "Dear all,\n\nfirst\n\nlast"}


def _e(op: str, value: str | None = None, **more) -> dict:
    return {"op": op, "value": value} | more


def _folded(t):
    kind = F.when(t.startswith("L"), "letter").otherwise("cv")
    source = F.from_json(F.lit(json.dumps(_SOURCE)), D.STATE)
    return D.edited(kind, source, F.from_json(F.substr(t, F.lit(2)), f"array<{D.EDIT}>"))


def _skills(t):
    shown = F.transform(_folded(t)["source"]["skills"], lambda c: F.concat(c["category"], F.lit("="), F.array_join(c["skills"], "+")))
    return F.array_join(shown, ";")


def _jobs(t):
    shown = F.transform(_folded(t)["source"]["experience"], lambda r: F.concat(r["position"], F.lit("="), F.array_join(r["bullets"], "+")))
    return F.array_join(shown, ";")


_S, _J, _B = "Languages=Python+Go;Tools=git", "Cook=a+b;Baker=", "Dear all,\n\nfirst\n\nlast"


def register() -> None:
    labelled(
        "person_names",
        [
            ("MARIE\nO'NEIL\nData Engineer\nmo@firm.org|", "Marie O'Neil"),
            ("Resume\n+33 6 12 34 56 78\nJean-Pierre Dupont\nLyon|", "Jean-Pierre Dupont"),
            ("lyon, france\nJEAN-PIERRE D'ARC\nx|", "Jean-Pierre D'Arc"),
            ("hello there {n}\nAda\nLovelace\nok|", "Ada Lovelace"),
            ("PROFILE\nKIM|some words\nSKILLS\nKIM\nLEE\nBaker", "Kim Lee"),
            ("one {n}\ntwo\nthree\nfour\nfive\nsix\nAda Lovelace|nothing", None),
            ("|", None),
        ],
        {"name": lambda t: N.person_name(_part(t, 1), _part(t, 2))},
    )
    cases = [
        ("C", [], _S, _J, _B, "en", []),
        ("C", [_e("add_skill", "SQL{n}"), _e("add_skill", "SQL{n}", category="tools"), _e("add_skill", " ")], "Languages=Python+Go+SQL{n};Tools=git+SQL{n}", _J, _B, "en", ["-", "-", "skill"]),
        ("C", [_e("accept_suggested_skill", skill="rust"), _e("accept_suggested_skill", "Rust"), _e("add_skill", "Vim", category="Other")], "Languages=Python+Go+rust;Tools=git;Other=Vim", _J, _B, "en", ["-", "suggestion", "-"]),
        ("C", [_e("remove_skill", "GIT"), _e("remove_skill", "git"), _e("rename_skill_category", "Code", from_name="languages")], "Code=Python+Go", _J, _B, "en", ["-", "skill", "-"]),
        ("C", [_e("reorder_experience", order=[1, 0]), _e("reorder_experience", order=[0, 0]), _e("add_bullet", "c{n}", role_index=0), _e("add_bullet", "c")], _S, "Baker=c{n};Cook=a+b", _B, "en", ["-", "order", "-", "role"]),
        ("C", [_e("edit_bullet", " z ", role_index=0, bullet_index=1), _e("remove_bullet", role_index=0, bullet_index=0), _e("remove_bullet", role_index=0, bullet_index=1), _e("set_language", "FR"), _e("set_language", "de")], _S, "Cook=z;Baker=", _B, "fr", ["-", "-", "bullet", "-", "language"]),
        ("C", [_e("set_letter_body", "x"), _e("set_letter_body", "x", role_index=0)], _S, _J, _B, "en", ["role", "operation"]),
        ("L", [_e("replace_letter_paragraph", "mid", role_index=1), _e("replace_letter_paragraph", "x", bullet_index=3), _e("add_skill", "x")], _S, _J, "Dear all,\n\nmid\n\nlast", "en", ["-", "paragraph", "operation"]),
        ("L", [_e("set_letter_body", " new {n} ")], _S, _J, "new {n}", "en", ["-"]),
    ]
    labelled(
        "document_edits",
        [(kind + json.dumps(edits), *rest) for kind, edits, *rest in cases],
        {
            "skills": _skills,
            "experience": _jobs,
            "body": lambda t: _folded(t)["source"]["body"],
            "language": lambda t: _folded(t)["source"]["language"],
            "refused": lambda t: F.transform(_folded(t)["refused"], lambda r: F.coalesce(r, F.lit("-"))),
        },
    )


register()


@query(
    r"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+(\n|$)', '\1', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') END AS text,
    CASE WHEN doc_id % 7 = 0 THEN 'unsupported file type' END AS error FROM documents"""
)
def file_texts(spark, sf):
    """The documents as bytes of text files, every seventh under a name that is not read."""
    ship(spark)
    docs = R.read(spark, sf, "documents")
    name = F.concat(F.lit("cv."), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".odt").otherwise(".TXT"))
    got = docs.select("doc_id", W.file_text(name, F.encode(F.col("text"), "utf-8")).alias("f"))
    return got.select("doc_id", W.tidy(F.col("f.text")).alias("text"), "f.error")
