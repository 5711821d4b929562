"""Chat formatting that can always be read back.

Grammar of a rendered conversation, with every mark a control string:

    conversation = turn*
    turn         = "[SYS]" text "[/SYS]" | "[INST]" text "[/INST]" | "<s>" text "</s>"
                 | "[ROLE]" text "[TEXT]" text "[/ROLE]"

A control string that follows an odd run of backslashes is text; such a run stands for half
as many backslashes, and so does an even run before a mark. All other text stands for itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of each role.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, MIDDLE, OTHER_END = "[ROLE]", "[TEXT]", "[/ROLE]"
CONTROL = (*[m for pair in MARKS.values() for m in pair], OTHER, MIDDLE, OTHER_END)
_MARK = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROL)) + ")")
_RUN = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROL)) + r"|\Z)")
OPENS = {opening: role for role, (opening, _) in MARKS.items()}


def escaped(text: str) -> str:
    """Backslashes before a control string or the end are doubled, and control strings get one more."""
    return _RUN.sub(lambda m: m[1] * 2 + ("\\" if m[2] else "") + m[2], text) if _conflicts(text) else text


def _conflicts(text: str) -> bool:
    return text.endswith("\\") or _MARK.search(text) is not None


class Unreadable(ValueError):
    """The rendered text is no conversation."""


def _text(rendered: str, at: int, closing: str) -> tuple[str, int, int]:
    """The text from ``at`` to its closing mark, where that mark begins, and where it ends."""
    parts, begun = [], at
    for match in _MARK.finditer(rendered, at):
        slashes, mark = match[1], match[2]
        parts += [rendered[begun : match.start()], "\\" * (len(slashes) // 2)]
        begun = match.end()
        if len(slashes) % 2:
            parts.append(mark)
        elif mark == closing:
            return "".join(parts), match.start(2), match.end()
        else:
            raise Unreadable(f"{mark} inside a text that ends with {closing}")
    raise Unreadable(f"no {closing}")


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and where the rendered text begins and ends, of each turn."""
    turns, at = [], 0
    while at < len(rendered):
        opening = next((m for m in (*OPENS, OTHER) if rendered.startswith(m, at)), None)
        if opening is None:
            raise Unreadable(f"no turn begins at {at}")
        at += len(opening)
        role, closing = OPENS.get(opening), OTHER_END
        if role is None:
            role, _, at = _text(rendered, at, MIDDLE)
        else:
            closing = MARKS[role][1]
        text, end, after = _text(rendered, at, closing)
        turns.append((role, text, at, end))
        at = after
    return turns


def _turn(role: str, text: str, escape: bool) -> str:
    text = escaped(text) if escape else text
    if role in MARKS:
        return f"{MARKS[role][0]}{text}{MARKS[role][1]}"
    return f"{OTHER}{escaped(role) if escape else role}{MIDDLE}{text}{OTHER_END}"


def _same(rendered: str, source: list[tuple[str, str]]) -> bool:
    try:
        return [turn[:2] for turn in parse(rendered)] == source
    except Unreadable:
        return False


def render(source: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """A conversation's text that parses to exactly its turns, and which turns were escaped.

    Turns are written plainly first. While the text does not read back identical, the turns
    that do not read back alone are escaped; at last, all are.
    """
    chosen: set[int] = set()
    for _ in range(3):
        rendered = "".join(_turn(role, text, i in chosen) for i, (role, text) in enumerate(source))
        if _same(rendered, source):
            return rendered, sorted(chosen)
        more = {i for i, turn in enumerate(source) if i not in chosen and not _same(_turn(*turn, False), [turn])}
        chosen = chosen | more if more else set(range(len(source)))
    raise AssertionError("an escaped conversation reads back identical")


FORMATTED = (
    "formatted string, escaped_turns array<int>, loss_spans array<struct<begin: int, end: int>>, "
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _formatted(turns: list) -> tuple:
    source = [(t["role"] or "", t["text"] or "") for t in turns]
    rendered, chosen = render(source)
    read, whole, loss, loss_chars, spans = parse(rendered), hashlib.sha256(), hashlib.sha256(), 0, []
    for role, text, begin, end in read:
        whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role == "assistant":
            loss.update(text.encode("utf-8", "surrogatepass"))
            loss_chars += len(text)
            spans.append({"begin": begin, "end": end})
    return rendered, chosen, spans, len(read), whole.hexdigest(), loss_chars, loss.hexdigest(), len(rendered)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: its rendered text, the mask of assistant texts and digests read back from it.

    ``turns`` has conv_id, turn, role, text; further columns are ignored. Turns are ordered by
    number, then role, then text (nulls first), so ties and repeated rows give one result.
    Null roles and texts count as empty; null conversation ids form one conversation. A
    conversation is one string by nature, so it alone must fit a row; a busy speaker, role
    or text is spread over conversations. An empty table gives no rows.
    """
    gathered = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    names = [part.split()[0] for part in FORMATTED.split(", ") if not part.startswith("end:")]
    shape = gathered.select("conv_id").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ", 1)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = pd.DataFrame([_formatted(list(t)) for t in frame["turns"]], columns=names)
            found.insert(0, "conv_id", frame["conv_id"].array)
            yield found

    return gathered.mapInPandas(rows, f"{shape}, {FORMATTED}")
