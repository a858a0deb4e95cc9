"""Parsing and validation of request parameters."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any

from lodestack.functions.scores import RecencyRule


class BadRequest(ValueError):
    """A parameter or body that is not valid; the message names it."""


def _number(text: str) -> float:
    text = text.strip()
    if not text:
        return 0.0
    try:
        return float(text)
    except ValueError:
        return math.nan


def kind_weights(raw: str | None) -> dict[str, float] | None:
    """`kind:weight,kind:weight`; a kind may hold colons, later repeats win, an empty parameter counts as none."""
    if not raw:
        return None
    out = {}
    for part in raw.split(","):
        kind, colon, weight = part.rpartition(":")
        value = _number(weight)
        if not colon or not kind.strip() or not math.isfinite(value) or value < 0:
            raise BadRequest(f"invalid kind_weights: {part}")
        out[kind.strip()] = value
    return out


def recency(raw: str | None) -> RecencyRule | None:
    """`kind,kind:half_life_days:floor`."""
    if not raw:
        return None
    kinds, half_life, floor = ([""] * 3 + raw.rsplit(":", 2))[-3:]
    names = tuple(k.strip() for k in kinds.split(",") if k.strip())
    days, low = _number(half_life), _number(floor)
    if not names or not math.isfinite(days) or days <= 0 or not 0 <= low <= 1:
        raise BadRequest(f"invalid recency: {raw}")
    return RecencyRule(names, days, low)


def kinds(raw: str | None) -> tuple[str, ...] | None:
    """`kind,kind`; absent means no filter, present but empty is an error."""
    if raw is None:
        return None
    names = tuple(k.strip() for k in raw.split(",") if k.strip())
    if not names:
        raise BadRequest("kinds must name at least one kind")
    return names


Rule = Callable[[Any, str], None]


def typed(kind: type | tuple[type, ...], min: float | None = None, non_empty: bool = False, one_of: tuple = ()) -> Rule:  # noqa: A002
    """A value of a type (a boolean is no number), perhaps with a least value, not blank, or one of a few."""

    def rule(value: Any, path: str) -> None:
        if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
            raise BadRequest(f"{path} has the wrong type")
        if non_empty and not value.strip():
            raise BadRequest(f"{path} must not be empty")
        if min is not None and value < min:
            raise BadRequest(f"{path} must be at least {min}")
        if one_of and value not in one_of:
            raise BadRequest(f"{path} must be one of {', '.join(map(str, one_of))}")

    return rule


def array(item: Rule, non_empty: bool = False) -> Rule:
    def rule(value: Any, path: str) -> None:
        if not isinstance(value, list):
            raise BadRequest(f"{path} must be an array")
        if non_empty and not value:
            raise BadRequest(f"{path} must not be empty")
        for i, x in enumerate(value):
            item(x, f"{path}[{i}]")

    return rule


def schema(fields: dict[str, Rule]) -> Rule:
    """An object; a key that ends in ? may be absent. The first error is raised, with the path of its value."""

    def rule(value: Any, path: str = "") -> None:
        if not isinstance(value, dict):
            raise BadRequest(f"{path or 'body'} must be an object")
        for key, check in fields.items():
            name, optional = key.removesuffix("?"), key.endswith("?")
            at = f"{path}.{name}" if path else name
            if value.get(name) is None:
                if not optional:
                    raise BadRequest(f"{at} is required")
            else:
                check(value[name], at)

    return rule


TEXT, NUMBER = typed(str, non_empty=True), typed((int, float))
DOCUMENT = schema({"external_id": TEXT, "title": TEXT, "body": TEXT, "kind?": TEXT, "metadata?": schema({})})
RETRIEVAL = schema(
    {
        "mode": typed(str, one_of=("hybrid", "semantic", "lexical")), "limit": typed(int, min=1), "max_chunks_per_doc": typed(int, min=1),
        "min_lexical_score": NUMBER, "min_vector_score": NUMBER,
    }
)
PROMPT = schema({"system": TEXT, "response_format": TEXT, "model": TEXT, "max_tokens": typed(int, min=1), "temperature": NUMBER, "retrieval": RETRIEVAL})
MESSAGE = schema({"role": typed(str, one_of=("user", "assistant")), "content": TEXT})
RAG = schema({"question": TEXT, "messages?": array(MESSAGE)})
MODEL_ID = re.compile(r"^(?:[a-z]+\.)?anthropic\.")
