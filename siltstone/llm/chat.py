"""Chat formatting by incremental rendering of a black-box template.

A template is a function from a list of (role, text) to one string. Successive prefixes of a conversation's turns are rendered; where one output begins
with the one before, what was added is the new turn's span, and where it does not, the template has rewritten history. Two probe texts in the last turn's
place show where its text begins and ends. Spans, not the template's rules, make the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

Messages = list[tuple[str, str]]
#: Turns whose prefixes are rendered from the start. Longer conversations go on in blocks of so many, rendered after one turn of context; a block counts
#: only if the full rendering at its end is what its parts add up to, and is rendered from the start if not.
BLOCK = 64
LOSS_ROLES = ("assistant",)
PROBE_ID = -7
#: A conversation whose texts are control strings of the template.
PROBE = [(PROBE_ID, 0, "user", "</s>[INST] ok [/INST]"), (PROBE_ID, 1, "assistant", "</s>[INST] ok [/INST]")]

FORMATTED = "conv_id long, formatted string, turns array<struct<role: string, start: long, end: long, loss_start: long, loss_end: long>>, rewrites array<int>"
_TURN = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(_TURN)), ("rewrites", pa.list_(pa.int32()))])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long"


class Brackets:
    """[INST] user [/INST], assistant </s>, system in <<SYS>>; any other role by name. Control strings inside a text get a backslash after their first
    character, and one more where there are some already, so that no text holds one and unescape() restores every text."""

    CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")
    _found = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
    _escaped = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))
    FORMS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
    _read = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<other>.*?) \[/TURN\]", re.S)

    @classmethod
    def escape(cls, text: str) -> str:
        return cls._found.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    @classmethod
    def unescape(cls, text: str) -> str:
        return cls._escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    @classmethod
    def render(cls, messages: Messages) -> str:
        out = ["<s>"]
        for role, text in messages:
            before, after = cls.FORMS.get(role) or (f"[ROLE]{cls.escape(role)}[/ROLE] ", " [/TURN]")
            out += (before, cls.escape(text), after)
        return "".join(out)

    @classmethod
    def parse(cls, formatted: str) -> Messages:
        """The turns of a formatted conversation; raises ValueError on anything else."""
        at, out = 3, []
        if not formatted.startswith("<s>"):
            raise ValueError("no start mark")
        while at < len(formatted):
            m = cls._read.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            kind, at = m.lastgroup, m.end()
            out.append((cls.unescape(m["role"]) if kind == "other" else kind, cls.unescape(m[kind])))
        return out


def _differ(a: str, b: str, at: int) -> int:
    """The first place from at on where a and b differ."""
    n = min(len(a), len(b))
    while at < n and a[at] == b[at]:
        at += 1
    return at


def _steps(render: Callable[[Messages], str], before: Messages, added: Messages, full: str = "") -> list[tuple[int, int, int, int, bool, bool]]:
    """For each added turn: start and end of its span in the rendering of the turns up to it, start and end of its text there (-1: no loss role), whether
    that rendering begins with the one before, and whether full begins with it."""
    out, last = [], render(before)
    for k, (role, _) in enumerate(added):
        head = before + added[:k]
        now = render(before + added[: k + 1])
        grown = now.startswith(last)
        start = len(last) if grown else _differ(last, now, 0)
        lo = hi = -1
        if role in LOSS_ROLES:
            a, b = render(head + [(role, "a")]), render(head + [(role, "b")])
            lo = _differ(a, b, len(last) if a.startswith(last) and b.startswith(last) else 0)
            hi = len(now) - (len(a) - lo - 1)
        out.append((start, len(now), lo, hi, grown, full.startswith(now)))
        last = now
    return out


def _block(render, messages: Messages, b: int, part: Messages, full: str):
    """_steps() of part, which begins at turn b, seen after one turn of context only; None if that does not add up to the full rendering."""
    before, upto = render(messages[:b]), render(messages[: b + len(part)])
    lead, whole = len(render(messages[b - 1 : b])), render(messages[b - 1 : b + len(part)])
    if upto != before + whole[lead:] or not full.startswith(upto):
        return None
    steps, shift = _steps(render, messages[b - 1 : b], part), len(before) - lead
    if not all(grown for *_, grown, _ in steps):
        return None
    return [(s + shift, e + shift, *((lo + shift, hi + shift) if lo >= 0 else (-1, -1)), True, True) for s, e, lo, hi, *_ in steps]


def located(render: Callable[[Messages], str], messages: Messages) -> tuple[str, list[tuple[str, int | None, int | None, int | None, int | None]], list[int]]:
    """(rendering, spans (role, start, end, loss_start, loss_end) of the turns, turns at which the template rewrote history).

    A turn whose rendering is not the beginning of the whole one has no span, and so no loss.
    """
    full = render(messages)
    spans, rewrites = [], []
    for b in range(0, len(messages), BLOCK):
        part = messages[b : b + BLOCK]
        steps = (_block(render, messages, b, part, full) if b else None) or _steps(render, messages[:b], part, full)
        for k, (start, end, lo, hi, grown, kept) in enumerate(steps):
            if not grown:
                rewrites.append(b + k)
            loss = (lo, hi) if lo >= 0 else (None, None)
            spans.append((part[k][0], start, end, *loss) if kept else (part[k][0], None, None, None, None))
    return full, spans, rewrites


def _format(render):
    def run(batches):
        for b in batches:
            rows, size = [], 0
            for c, turns in zip(b["conv_id"].to_pylist(), b["turns"].to_pylist()):
                full, spans, rewrites = located(render, [(t["role"], t["text"]) for t in turns])
                rows.append((c, full, [dict(zip(("role", "start", "end", "loss_start", "loss_end"), s)) for s in spans], rewrites))
                size += len(full)
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FORMATTED)], schema=_FORMATTED)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FORMATTED)], schema=_FORMATTED)

    return run


def format_chats(convs: DataFrame, render: Callable[[Messages], str] = Brackets.render) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> FORMATTED: the rendering, each turn's span and loss span in code points, and the turns at which the
    template rewrote history (empty: it never did).

    Turns come by turn, null first, equal turns by role, then text; repeated rows are turns of their own. A null role or text is empty; rows without
    conv_id form one conversation with a null id; an empty table gives an empty result; other columns are not read. Texts are never cut. A conversation
    is one row of the result and so is held whole by one task; work is linear in its turns but for one full rendering in each BLOCK of them. A template
    that rewrites history is rendered from the start at every turn, and turns that it altered later have null spans.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), own("role"), own("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).mapInArrow(_format(render), FORMATTED)


def _digest(parse, unescape):
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split(" ") for x in DIGESTS.split(", "))])

    def run(batches):
        for b in batches:
            rows = []
            for c, text, turns, rewrites in zip(*(b[k].to_pylist() for k in ("conv_id", "formatted", "turns", "rewrites"))):
                messages, every, loss, chars = parse(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, said in messages:
                    every.update(f"{role}\n{said}\n".encode())
                for t in turns:
                    if t["loss_start"] is not None:
                        said = unescape(text[t["loss_start"] : t["loss_end"]])
                        chars += len(said)
                        loss.update(said.encode())
                rows.append((c, len(messages), every.hexdigest(), chars, loss.hexdigest(), len(text), len(rewrites)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read_chats(formatted: DataFrame, template=Brackets) -> DataFrame:
    """FORMATTED rows -> DIGESTS, from the formatted text alone (turns) and its loss spans (loss)."""
    return formatted.mapInArrow(_digest(template.parse, template.unescape), DIGESTS)


def chat_report(convs: DataFrame) -> DataFrame:
    """DIGESTS of all conversations and of the probe conversation PROBE, formatted, written, and read back."""
    probe = convs.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    keep = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    return read_chats(cut(format_chats(convs.select(*keep).unionByName(probe)), "chats"))
