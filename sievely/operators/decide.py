"""Typed questions about any rows, and typed columns of answers: yes or no, a choice between labels, a graded score.

    asked = {"spam": YesNo("Is this spam?"), "kind": Choice.labels("What is it?", "mail", "chat"), "tone": Score("How polite?", "rude", "plain", "kind")}
    decided = decide(rows, ["subject", "body"], asked, make, Ledger(spark))

Each row's columns are one request, asked once through the ledger. A reply that lacks an answer or holds one that the
question does not allow is an error of its row: its answers are null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.backends import DecisionBackend, DecisionError
from ..sources.ledger import Ledger
from .questions import in_lanes

#: Labels of a choice at most, levels of a score at least and at most.
MOST_LABELS, LEAST_LEVELS, MOST_LEVELS = 255, 2, 10


def _share(x: object) -> float:
    if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x) or not 0 <= x <= 1:
        raise ValueError(f"{x!r} is no probability")
    return float(x)


@dataclass(frozen=True)
class YesNo:
    """Answered by the probability of yes."""

    text: str
    yes: str | None = None
    no: str | None = None
    column = "double"

    def wire(self) -> dict:
        meanings = {k: v for k, v in (("true", self.yes), ("false", self.no)) if v is not None}
        return {"type": "noul", "instructions": self.text} | ({"criteria": meanings} if meanings else {})

    def read(self, answer: dict) -> object:
        return _share(answer["noul"])


@dataclass(frozen=True)
class Choice:
    """Answered by one of the labels, with a distribution over all of them. options: (label, what it means or None), in order."""

    text: str
    options: tuple[tuple[str, str | None], ...]
    column = "struct<choice:string,confidence:double,probabilities:map<string,double>>"

    def __post_init__(self) -> None:
        if not 1 <= len(dict(self.options)) == len(self.options) <= MOST_LABELS:
            raise ValueError(f"1 to {MOST_LABELS} different labels")

    @classmethod
    def labels(cls, text: str, *names: str) -> Choice:
        return cls(text, tuple((name, None) for name in names))

    def option(self, name: str, meaning: str | None = None) -> Choice:
        return Choice(self.text, (*self.options, (name, meaning)))

    def wire(self) -> dict:
        return {"type": "choice", "instructions": self.text, "criteria": dict(self.options)}

    def read(self, answer: dict) -> object:
        shares, names = answer["probabilities"], dict(self.options)
        if answer["choice"] not in names or not set(shares) <= set(names):
            raise ValueError("a label that is none of the choice's")
        return {"choice": answer["choice"], "confidence": _share(answer["confidence"]), "probabilities": {n: _share(shares.get(n, 0.0)) for n in names}}


@dataclass(frozen=True)
class Score:
    """Answered by a place between ordered levels, from 0."""

    text: str
    levels: tuple[str, ...]
    column = "struct<score:double,confidence:double,probabilities:array<double>>"

    def __init__(self, text: str, *levels: str):
        object.__setattr__(self, "text", text)
        object.__setattr__(self, "levels", levels)
        if not LEAST_LEVELS <= len(levels) <= MOST_LEVELS:
            raise ValueError(f"{LEAST_LEVELS} to {MOST_LEVELS} levels")

    def wire(self) -> dict:
        return {"type": "score", "instructions": self.text, "criteria": list(self.levels)}

    def read(self, answer: dict) -> object:
        score, shares = answer["score"], answer.get("probabilities") or {}
        if isinstance(score, bool) or not isinstance(score, int | float) or not 0 <= score <= len(self.levels) - 1:
            raise ValueError(f"{score!r} is between no levels")
        if not set(shares) <= {str(k) for k in range(len(self.levels))}:
            raise ValueError("a level that is none of the score's")
        return {"score": float(score), "confidence": _share(answer["confidence"]), "probabilities": [_share(shares.get(str(k), 0.0)) for k in range(len(self.levels))]}


Question = YesNo | Choice | Score
#: Answers as JSON by question, so that one ledger holds those of any questions.
_COLUMNS = {"request": ("string", pa.string()), "said": ("map<string,string>", pa.map_(pa.string(), pa.string())), "error_kind": ("string", pa.string()), "error": ("string", pa.string())}


def decide(rows: DataFrame, about: list[str], asked: dict[str, Question], make: Callable[[], DecisionBackend], ledger: Ledger, jobs: int = 32, model: str = "") -> DataFrame:
    """rows with a typed column for each question (null if the row's request failed), error_kind and error. about: the columns that a service sees."""
    if not asked or not about:
        raise ValueError("something must be asked about something")
    taken = {c.lower() for c in rows.columns}
    if clash := [c for c in [*asked, "request", "said", "error_kind", "error"] if c.lower() in taken]:
        raise ValueError(f"the rows have columns named {', '.join(clash)}")
    wired = {name: q.wire() for name, q in asked.items()}
    key = F.sha2(F.concat(F.lit(json.dumps([model, wired])), F.to_json(F.struct(*about), {"ignoreNullFields": "false"})), 256)

    def one(backend: DecisionBackend, row: dict) -> tuple:
        try:
            got = backend.ask({c: row[c] for c in about}, wired)
            said = [(name, json.dumps(q.read(got[name]))) for name, q in asked.items()]
            return row["request"], said, None, None
        except DecisionError as e:
            if e.kind == "auth":
                raise
            return row["request"], [], e.kind, e.message
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            return row["request"], [], "api", f"not the answers that were asked for: {e}"

    answered = ledger.answered(rows.withColumn("request", key), lambda new: in_lanes(new.select("request", *about), make, _COLUMNS, one, jobs))
    told = lambda name, q: F.try_element_at("said", F.lit(name)).cast("double") if q.column == "double" else F.from_json(F.try_element_at("said", F.lit(name)), q.column)
    return answered.select(*rows.columns, *(told(name, q).alias(name) for name, q in asked.items()), "error_kind", "error")
