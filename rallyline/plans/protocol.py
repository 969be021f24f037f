"""The query surface over JSON-RPC lines: initialize, ping, tools/list, tools/call."""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterable, Iterator
from typing import Any

from rallyline.plans.envelope import BadRequest
from rallyline.plans.tools import League

#: The protocol's versions, newest first, and its error codes.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
INSTRUCTIONS = "Read-only questions about a season. Ask describe_warehouse first; quarantined games are left out unless asked for."
TOOLS = ("describe_warehouse", "shot_data", "find_games", "game", "team_stats", "player_stats", "lineup_stats", "player_on_off", "possessions", "play_by_play")
_TYPES = {"str": "string", "int": "integer", "bool": "boolean"}


def listed() -> list[dict[str, Any]]:
    tools = []
    for name in TOOLS:
        args = [p for p in inspect.signature(getattr(League, name)).parameters.values() if p.name != "self"]
        properties = {p.name: {"type": _TYPES[str(p.annotation).split(" ")[0]]} for p in args}
        required = [p.name for p in args if p.default is p.empty]
        tools.append({
            "name": name, "title": name.replace("_", " ").capitalize(), "description": inspect.getdoc(getattr(League, name)) or name,
            "inputSchema": {"type": "object", "properties": properties, "required": required}, "annotations": {"readOnlyHint": True},
        })
    return tools


class Refused(Exception):
    """A request that gets an error instead of a result."""

    def __init__(self, code: int, text: str) -> None:
        super().__init__(text)
        self.code = code


def begin(league: League, protocolVersion: Any = None, **_: Any) -> dict[str, Any]:  # noqa: N803 - the wire's name
    version = next((v for v in VERSIONS if v == protocolVersion), VERSIONS[0])
    server = {"name": "rallyline", "version": "1"}
    return {"protocolVersion": version, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": server, "instructions": INSTRUCTIONS}


def call(league: League, name: Any = None, arguments: Any = None, **_: Any) -> dict[str, Any]:
    """Run a tool; what it finds wrong itself is its result, told as such."""
    if name not in TOOLS:
        raise Refused(PARAMS, f"unknown tool {name}; known: {', '.join(TOOLS)}")
    tool = getattr(league, name)
    try:
        bound = inspect.signature(tool).bind(**arguments if isinstance(arguments, dict) else {})
    except TypeError as error:
        raise Refused(PARAMS, f"{name}: {error}") from None
    try:
        text, wrong = json.dumps(tool(*bound.args, **bound.kwargs), default=str), False
    except BadRequest as error:
        text, wrong = str(error), True
    except Exception as error:  # noqa: BLE001 - a tool that fails, also in Spark, mustn't end the server
        text, wrong = f"{type(error).__name__}: {error}", True
    return {"content": [{"type": "text", "text": text}], "isError": wrong}


#: What answers each method: a function of the league and the request's parameters by name.
METHODS = {
    "initialize": begin,
    "ping": lambda league, **_: {},
    "tools/list": lambda league, **_: {"tools": listed()},
    "tools/call": call,
}


def answer(league: League, message: dict[str, Any]) -> dict[str, Any]:
    named = message.get("method")
    if not isinstance(named, str):
        raise Refused(REQUEST, "a request names its method")
    if named not in METHODS:
        raise Refused(METHOD, f"unknown method {named}")
    params = message.get("params")
    return METHODS[named](league, **(params if isinstance(params, dict) else {}))


def handle(league: League, message: Any) -> dict[str, Any] | None:
    """The reply to one message; None for a notification."""
    known = isinstance(message, dict)
    if known and message.get("id") is None:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"] if known else None}
    try:
        if not known:
            raise Refused(REQUEST, "a message is an object")
        return reply | {"result": answer(league, message)}
    except Refused as refused:
        return reply | {"error": {"code": refused.code, "message": str(refused)}}
    except Exception as error:  # noqa: BLE001 - a fault of the server's own mustn't end it either
        return reply | {"error": {"code": INTERNAL, "message": f"{type(error).__name__}: {error}"}}


def serve(league: League, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "not JSON"}})
            continue
        if (reply := handle(league, message)) is not None:
            yield json.dumps(reply)
