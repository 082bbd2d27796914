"""Chat formatting with a grammar round trip, in built-in column expressions only.

A conversation is rendered as ``<s>`` and its turns: ``[INST]`` text ``[/INST]`` for a user, ``[SYSTEM_PROMPT]`` text
``[/SYSTEM_PROMPT]`` for a system prompt, text ``</s>`` for an assistant, ``[TURN]`` role ``[ROLE]`` text ``[/TURN]``
for anybody else. The parser cuts behind closing marks and recovers a turn only if no control string is left inside it.

Each turn is first rendered as it is and parsed again. Where the recovered turn differs from the source, its content
conflicts with the grammar: every control string in it gets a backslash behind its first character (one more, if it has
some already), and the turn is parsed once more. The conversation is then parsed as a whole and must give the turns its
pieces give. No control string holds its own first characters again, so none can arise where a text and a mark meet.
A turn that still differs stops the job; none can.

The loss mask are byte spans of the rendered text (UTF-8, from 0, end exclusive): the assistant texts, without marks.

Edge cases: a null text or role is empty; rows come by turn, null turns first, equal ones by role and text; repeated
rows are turns like any other; rows without conv_id form one conversation without id; further columns are passed over;
an empty table gives an empty result. A conversation is one text and so has to fit into one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN = "<s>"
#: role, opening and closing mark; any other role is written between NAMED and its close, up to NAME_END.
MARKS = (("user", "[INST]", "[/INST]"), ("system", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]"), ("assistant", "", "</s>"))
NAMED, NAME_END, NAMED_END = "[TURN]", "[ROLE]", "[/TURN]"
LEARNED = "assistant"
CONTROLS = tuple(c for c in (BEGIN, *(m for row in MARKS for m in row[1:]), NAMED, NAME_END, NAMED_END) if c)

_FIRSTS = sorted({c[0] for c in CONTROLS})
if any(f in c[1:] for f in _FIRSTS for c in CONTROLS):
    raise ValueError("a control string may hold the first characters of control strings only at its start")


def _any(strings) -> str:
    return "|".join(re.escape(s) for s in strings)


def _rest(first: str) -> str:
    return rf"(?:{_any(c[1:] for c in CONTROLS if c[0] == first)})"


# The patterns begin with single characters, so that a scan passes over plain text quickly.
CONTROL = "|".join(re.escape(f) + _rest(f) for f in _FIRSTS)
INSERT = "|".join(rf"(?<={re.escape(f)})(?=\\*{_rest(f)})" for f in _FIRSTS)
REMOVE = r"\\(?:" + "|".join(rf"(?<={re.escape(f)}\\)(?=\\*{_rest(f)})" for f in _FIRSTS) + ")"
CLOSED = (*(m[2] for m in MARKS), NAMED_END)
AFTER_CLOSE = rf"(?<=[{re.escape(''.join(sorted({c[-1] for c in CLOSED})))}])(?<={_any(CLOSED)})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, INSERT, r"\\")


def unescape(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, REMOVE, "")).otherwise(text)


def _plain(text: Column) -> Column:
    """Text without escapes; null where a control string is left in it."""
    marked = F.lit(False)
    for first in _FIRSTS:
        marked = marked | text.contains(first)
    return F.when(~(marked & text.rlike(CONTROL)), unescape(text))


def _by_role(role: Column, place: int, other: Column) -> Column:
    found = other
    for row in MARKS:
        found = F.when(role == row[0], F.lit(row[place])).otherwise(found)
    return found


def render_turn(role: Column, text: Column, safe: bool = False) -> Column:
    """One turn as marks and text; ``safe`` escapes its control strings."""
    kept = escape if safe else lambda c: c
    opening = _by_role(role, 1, F.concat(F.lit(NAMED), kept(role), F.lit(NAME_END)))
    return F.concat(opening, kept(text), _by_role(role, 2, F.lit(NAMED_END)))


def parse_turn(piece: Column) -> Column:
    """(role, text) of one rendered turn, null fields where it is not one: other marks, or control strings inside."""

    def between(opening: str, closing: str) -> Column:
        inner = F.substring(piece, F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))
        return F.when(piece.startswith(opening), inner)

    named = between(NAMED, NAMED_END)
    cut = F.instr(named, NAME_END)
    role = F.when(piece.endswith(NAMED_END) & (cut > 0), _plain(F.substring(named, F.lit(1), cut - 1)))
    text = F.when(cut > 0, F.substring(named, cut + len(NAME_END), F.length(named)))
    for name, opening, closing in MARKS:
        role = F.when(piece.endswith(closing), F.when(piece.startswith(opening), F.lit(name))).otherwise(role)
        text = F.when(piece.endswith(closing), between(opening, closing)).otherwise(text)
    return F.struct(role.alias("role"), _plain(text).alias("text"))


def parse_turns(rendered: Column) -> Column:
    """array of (role, text) read from rendered turns; null if something follows the last closing mark."""
    pieces = F.split(rendered, AFTER_CLOSE, -1)
    return F.when(F.element_at(pieces, -1) == "", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse_turn))


def parse(formatted: Column) -> Column:
    """array of (role, text) of a rendered conversation."""
    return F.when(formatted.startswith(BEGIN), parse_turns(F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted))))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    data = formatted.cast("binary")
    return F.transform(spans, lambda s: unescape(F.substring(data, s["start"] + 1, s["stop"] - s["start"]).cast("string")))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans, turns, n_escaped) of every conversation, ``turns`` as parsed from ``formatted``."""
    source = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                         *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    same = lambda piece: F.coalesce(parse_turn(F.col(piece)) == F.struct("role", "text"), F.lit(False))
    tried = source.withColumn("piece", render_turn(F.col("role"), F.col("text"))).withColumn("plain", same("piece"))
    mended = tried.withColumn("piece", F.when(F.col("plain"), F.col("piece")).otherwise(render_turn(F.col("role"), F.col("text"), True)))
    lost = F.raise_error(F.lit("a turn does not survive its escapes"))
    mended = mended.withColumn("piece", F.when(F.col("plain") | same("piece"), F.col("piece")).otherwise(lost))

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum(F.octet_length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    closing = F.octet_length(_by_role(F.col("role"), 2, F.lit(NAMED_END)))
    placed = mended.select("conv_id", "piece", (~F.col("plain")).alias("escaped"), (F.col("role") == LEARNED).alias("learned"),
                           F.row_number().over(order).alias("n"), (F.lit(len(BEGIN)) + before - closing).alias("stop"),
                           (F.lit(len(BEGIN)) + before - F.octet_length("piece")).alias("start"))
    turns = F.sort_array(F.collect_list(F.struct("n", "piece", "escaped", "learned", "start", "stop"))).alias("turns")
    whole = placed.groupBy("conv_id").agg(turns)
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.col("turns.piece"), ""))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop")))
    whole = whole.select("conv_id", "turns", formatted.alias("formatted"), spans.alias("loss_spans"))
    whole = whole.withColumn("again", parse(F.col("formatted")))
    same = F.coalesce(F.col("again") == F.transform("turns", lambda t: parse_turn(t["piece"])), F.lit(False))
    lost = F.raise_error(F.lit("a conversation does not parse into its turns"))
    return whole.select("conv_id", F.when(same, F.col("formatted")).otherwise(lost).alias("formatted"), "loss_spans",
                        F.col("again").alias("turns"), F.size(F.filter("turns", lambda t: t["escaped"])).alias("n_escaped"))


def digest_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the rendered texts."""
    made = format_conversations(rows)
    read = made.select("conv_id", "formatted", "turns",
                       F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"), "n_escaped")
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), F.col("n_escaped").cast("long").alias("n_escaped"))
