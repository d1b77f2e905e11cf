"""What column expressions can't do: saving what broken replies of models hold, and compression of blocks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

_OPEN = {"{": "}", "[": "]"}


def json_values(text: str, opens: str = "{") -> list[str]:
    """The outermost objects, or lists, of a text, each as it stands; one that never closes runs to the end."""
    closes, found, depth, start, quoted, escaped = _OPEN[opens], [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted = c != '"' or escaped
            escaped = c == "\\" and not escaped
        elif c == '"' and depth:
            quoted = True
        elif c == opens:
            start = i if not depth else start
            depth += 1
        elif c == closes and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
    return found + ([text[start:]] if depth else [])


def requoted(text: str) -> str:
    """Quotes within strings escaped: a quote ends a string only if what follows, blanks aside, can follow a string."""
    out, quoted, escaped = [], False, False
    for i, c in enumerate(text):
        if c != '"' or escaped:
            out.append(c)
        elif not quoted:
            quoted = True
            out.append(c)
        else:
            ends = text[i + 1 : i + 200].lstrip()[:1] in ("", ",", ":", "}", "]")
            out.append(c if ends else '\\"')
            quoted = not ends
        escaped = quoted and c == "\\" and not escaped
    return "".join(out)


def _closed(text: str) -> Iterator[str]:
    """The text with what is open closed, whole, then without what comes after its last comma or bracket, and so on."""
    ends, stack, quoted, escaped = [], [], False, False
    for i, c in enumerate(text):
        if quoted:
            quoted = c != '"' or escaped
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in _OPEN:
            stack.append(_OPEN[c])
            ends.append((i + 1, "".join(reversed(stack))))
        elif c in "}]" and stack:
            stack.pop()
        elif c == ",":
            ends.append((i, "".join(reversed(stack))))
    yield re.sub(r",\s*$", "", text) + '"' * quoted + "".join(reversed(stack))
    for i, rest in reversed(ends[-CUTS:]):
        yield text[:i] + rest


#: Commas and brackets back from the end at which a truncated text is cut: what was left unfinished is within the last few fields.
CUTS = 40


def repaired(text: str) -> object:
    """The value of a JSON text that may have commas before closing brackets, quotes within strings, or lack its end; None where nothing helps."""
    plain = re.sub(r",(\s*[}\]])", r"\1", text)
    whole = (plain, requoted(plain))
    for candidate in (*whole, *(c for t in reversed(whole) for c in _closed(t))):
        try:
            return json.loads(re.sub(r",(\s*[}\]])", r"\1", candidate), strict=False)
        except ValueError:
            pass
    return None


_ENTITY = re.compile(W.ENTITY_LINE, re.I)
_RELATION = re.compile(f"{W.RELATION_LINE}({'|'.join([*W.CORE_RELATIONS, *sorted(W.RELATION_WORDS, key=len, reverse=True)])})", re.I)


def _from_text(reply: str) -> tuple[list[dict], list[dict]]:
    """Entities and relations of a reply that reasons in lines: each named with its type, or two with what is between them."""
    entities, relations = [], []
    bare = lambda x: x.strip().strip("`'\"")[: W.NAME_LENGTH]
    for line in reply.splitlines():
        if one := _ENTITY.search(line.strip()):
            entities.append({"name": bare(one[1]), "type": one[2].lower()})
        if two := _RELATION.search(line.strip()):
            relations.append({"source": bare(two[1]), "target": bare(two[2]), "type": W.RELATION_WORDS.get(two[3].lower(), two[3].lower())})
    return entities[: W.TEXT_ENTITIES], relations[: W.TEXT_RELATIONS]


def broken_graph(payload: str | None, reply: str | None) -> tuple[str, str]:
    """(outcome, JSON object of entities and relations in any of their shapes) of a reply that is no sound JSON."""
    for candidate in json_values(payload or ""):
        value = repaired(candidate)
        if isinstance(value, dict) and any(isinstance(value.get(k), list) for k in GRAPH_KEYS):
            return "repaired", json.dumps(value)
    entities, relations = _from_text(reply or "")
    if entities or relations:
        return "text", json.dumps({"entities": entities, "relations": relations})
    return "failed", "{}"


#: Names under which a reply gives entities and relations.
GRAPH_KEYS = ("entities", "relations", "nodes", "edges", "triples")


def broken_atoms(reply: str | None) -> list[str]:
    """The objects, as JSON, of a reply that should be a list of them and is no sound JSON."""
    for candidate in json_values(reply or "", "["):
        value = repaired(candidate)
        if isinstance(value, list) and any(isinstance(x, dict) for x in value):
            return [json.dumps(x) for x in value]
    return []


def saved_graph(payload: Column, reply: Column) -> Column:
    """Struct of what `broken_graph` gives; of nulls where the reply is null."""

    @F.pandas_udf("struct<outcome:string,graph:string>")
    def saved(payloads: pd.Series, replies: pd.Series) -> pd.DataFrame:
        found = [(None, None) if r is None else broken_graph(p, r) for p, r in zip(payloads, replies, strict=True)]
        return pd.DataFrame(found, columns=["outcome", "graph"], dtype=object)

    return saved(payload, reply)


@F.udtf(returnType="place int, atom string")
class BrokenAtoms:
    """A row for each object that is saved from a broken list."""

    def eval(self, reply: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(broken_atoms(reply))


def compress(text: str, longest: int = 10_240) -> tuple[str, str]:
    """(text, strategy): long tool output loses its middle, then long code blocks, then the whole text."""
    if len(text) <= longest:
        return text, "none"

    def tool(m: re.Match) -> str:
        body = m[1]
        cut = body if len(body) <= 3072 else f"{body[:2048]}\n\n... [compressed: {len(body) - 3072} bytes omitted] ...\n\n{body[-1024:]}"
        return f"<function_results>{cut}</function_results>"

    def code(m: re.Match) -> str:
        lines = m[2].split("\n")
        if len(lines) > 15:
            lines = [*lines[:10], "", f"... [compressed: {len(lines) - 15} lines omitted] ...", "", *lines[-5:]]
        return f"```{m[1]}\n" + "\n".join(lines) + "\n```"

    for strategy, pattern, cut in (("tool_output", r"(?s)<function_results>(.*?)</function_results>", tool), ("code_block", r"(?s)```(\w*)\n(.*?)\n```", code)):
        shorter = re.sub(pattern, cut, text)
        if shorter != text and len(shorter) <= longest:
            return shorter, strategy
        text = shorter
    head = int((longest - 100) * 0.8)
    tail = longest - 100 - head
    return f"{text[:head]}\n\n... [truncated: {len(text) - head - tail} bytes omitted] ...\n\n{text[-tail:]}", "truncation"


def compressed(rows: DataFrame, content: str) -> DataFrame:
    """Replaces content by its compressed form and adds strategy. Only texts over the limit reach Python."""

    @F.pandas_udf("struct<content:string,strategy:string>")
    def shortened(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compress(t) for t in texts], columns=["content", "strategy"])

    long = F.length(content) > 10_240
    short = F.struct(F.col(content).alias("content"), F.lit("none").alias("strategy"))
    out = rows.withColumn("_c", F.when(long, shortened(F.when(long, F.col(content)).otherwise(""))).otherwise(short))
    return out.withColumns({content: F.col("_c.content"), "strategy": F.col("_c.strategy")}).drop("_c")

