r"""Conversations as training texts, by a finite-state machine over roles and a declarative template.

Native: DataFrame functions only. The template says what opens and closes a turn
of each role, whether its text is learned from, and which role may follow which.
A conversation becomes segments: markers and texts, each with a loss flag; joined
they are the formatted text. Control strings inside texts are escaped by one
backslash behind their first character (`[INST]` becomes `[\INST]`, `[\INST]`
becomes `[\\INST]`), so none is left there and the text can be read back.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
#: Where the machine starts, and where it stays behind a turn out of order.
START, STUCK = "start", "stuck"


@dataclass(frozen=True)
class Turn:
    """What stands before and behind a turn's text (each a control string, and what may follow it), and whether the text is learned from."""

    opens: str
    closes: str
    learned: bool = False


@dataclass(frozen=True)
class Template:
    """turns: by role. other: for roles without an entry; their name stands between other.opens and `named`. controls: the
    strings that mean something to the tokenizer. moves: from a state (START or the role before) to the roles that may follow."""

    turns: dict[str, Turn]
    other: Turn
    named: str
    controls: tuple[str, ...]
    moves: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        first = {c[:1] for c in self.controls}
        if "" in first or any(x in c[1:] for c in self.controls for x in first) or any(len(c) < 2 or ESCAPE in c for c in self.controls):
            raise ValueError("a control string has two characters or more, no backslash, and no control string's first character further on")
        opens = [t.opens for t in (*self.turns.values(), self.other)]
        if any(a != b and a.startswith(b) for a in opens for b in opens) or len(set(opens)) < len(opens):
            raise ValueError("what opens a turn must tell the roles apart")
        for marker in (self.named, *(m for t in (*self.turns.values(), self.other) for m in (t.opens, t.closes))):
            if not marker.startswith(self.controls) or any(x in marker[1:] for x in first):
                raise ValueError(f"{marker!r} isn't one control string and what follows it")
        if {self.control(m) for m in opens} & {self.control(m) for m in (self.named, *(t.closes for t in (*self.turns.values(), self.other)))}:
            raise ValueError("a control string opens turns or closes them, not both")

    def control(self, marker: str) -> str:
        """The control string that leads a marker."""
        return max((c for c in self.controls if marker.startswith(c)), key=len)

    def _after_first(self, between: str) -> str:
        """A pattern of what follows a control string's first character: `between`, then the rest of it."""
        by_first: dict[str, list[str]] = {}
        for c in self.controls:
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(f"(?<={re.escape(a)}){between}(?=\\\\*(?:{'|'.join(rest)}))" for a, rest in by_first.items())

    def escape(self, text: Column) -> Column:
        """The text without control strings; `unescape` gives it back."""
        return F.regexp_replace(text, self._after_first(""), ESCAPE * 2)

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._after_first("\\\\"), "")


#: The markers of the template that the query uses.
BRACKETS = Template(
    turns={"system": Turn("[SYS] ", "[/SYS]\n"), "user": Turn("[INST] ", "[/INST]\n"), "assistant": Turn("<s>", "</s>\n", learned=True)},
    other=Turn("[ROLE] ", "[/TURN]\n"),
    named="[/ROLE] ",
    controls=("[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]", "<s>", "</s>"),
    moves={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def _by_role(role: Column, template: Template, of_turn: Callable[[Turn], object]) -> Column:
    """The template's value for each role, and for all others that of `other`."""
    out = F.lit(of_turn(template.other))
    for name, turn in template.turns.items():
        out = F.when(role == name, of_turn(turn)).otherwise(out)
    return out


def first_out_of_order(roles: Column, template: Template) -> Column:
    """The place (int, from 0) of the first role that may not stand there; null if all may: the machine's walk over an array of roles."""
    def step(at: Column, role: Column) -> Column:
        allowed = F.lit(False)
        for state, following in template.moves.items():
            allowed = F.when(at["state"] == state, role.isin(*following)).otherwise(allowed)
        good = (at["state"] != STUCK) & F.coalesce(allowed, F.lit(False))
        return F.struct(F.when(good, role).otherwise(F.lit(STUCK)).alias("state"), (at["n"] + F.when(good, 1).otherwise(0)).alias("n"))

    walked = F.aggregate(roles, F.struct(F.lit(START).alias("state"), F.lit(0).alias("n")), step)
    return F.when(walked["state"] == STUCK, walked["n"])


def format_chat(df: DataFrame, template: Template = BRACKETS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: its id, `segments` (array of text and loss), `valid` (boolean) and `bad_turn` (int: the
    place of the first turn that the machine doesn't allow there, from 0; null if valid).

    Turns stand by number; those without one come first, equal numbers by role, then text (null before
    all). All turns are formatted, also those out of order, repeated rows too. Null texts and roles are
    empty ones; roles without an entry of their own are named in the text. Rows without an id are one conversation.
    Other columns are left out; an empty table gives an empty one. A conversation becomes one row,
    so it must fit into one (Spark holds 2 GB in a value); its rows are escaped before they meet.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    known = role.isin(*template.turns)
    opens = F.when(known, _by_role(role, template, lambda t: t.opens)).otherwise(F.concat(F.lit(template.other.opens), template.escape(role), F.lit(template.named)))
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).isNotNull().alias("given"), opens.alias("opens"), template.escape(text).alias("text"),
        _by_role(role, template, lambda t: t.closes).alias("closes"), _by_role(role, template, lambda t: t.learned).alias("learned"),
    )
    whole = df.select(F.col(id_col).alias("_id"), turn.alias("_turn")).groupBy("_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("_turns", lambda t: F.array(segment(t["opens"], F.lit(False)), segment(t["text"], t["learned"]), segment(t["closes"], F.lit(False)))))
    bad = first_out_of_order(F.transform("_turns", lambda t: F.coalesce(t["role"], F.lit(""))), template)
    return whole.select(F.col("_id").alias(id_col), segments.alias("segments"), bad.isNull().alias("valid"), bad.alias("bad_turn"))


def formatted(segments: Column) -> Column:
    """The text that the segments make up."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned_text(segments: Column, template: Template = BRACKETS) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def read_turns(text: Column, template: Template = BRACKETS) -> Column:
    """The turns (array of role and text) of a formatted text, read from its markers alone."""
    opening = "|".join(re.escape(t.opens) for t in (*template.turns.values(), template.other))
    pieces = F.filter(F.split(text, f"(?={opening})"), lambda p: p != "")

    def inner(piece: Column, turn: Turn) -> Column:
        return F.substring(piece, F.lit(len(turn.opens) + 1), F.length(piece) - len(turn.opens) - len(turn.closes))

    def read(piece: Column) -> Column:
        named = inner(piece, template.other)
        at = F.instr(named, template.named)
        role, said = F.substring(named, F.lit(1), at - 1), F.substring(named, at + len(template.named), F.length(named))
        for name, turn in template.turns.items():
            own = F.startswith(piece, F.lit(turn.opens))
            role, said = F.when(own, F.lit(name)).otherwise(role), F.when(own, inner(piece, turn)).otherwise(said)
        return F.struct(template.unescape(role).alias("role"), template.unescape(said).alias("text"))

    return F.transform(pieces, read)


#: DuckDB: what the query returns. The markers are those of BRACKETS, with # for the line end behind a turn.
SQL = r"""
    WITH said AS (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), turns AS (
        SELECT conv_id, turn, role AS given, coalesce(role, '') AS role, text IS NOT NULL AS has, coalesce(text, '') AS text,
               regexp_replace(coalesce(text, ''), '(\[)(\\*/?(?:SYS|INST|ROLE)\]|\\*/TURN\])|(<)(\\*/?s>)', '\1\3\\\2\4', 'g') AS safe,
               regexp_replace(coalesce(role, ''), '(\[)(\\*/?(?:SYS|INST|ROLE)\]|\\*/TURN\])|(<)(\\*/?s>)', '\1\3\\\2\4', 'g') AS safe_role FROM said
    ), marked AS (
        SELECT *, CASE role WHEN 'system' THEN '[SYS] ' || safe || '[/SYS]#' WHEN 'user' THEN '[INST] ' || safe || '[/INST]#'
                            WHEN 'assistant' THEN '<s>' || safe || '</s>#' ELSE '[ROLE] ' || safe_role || '[/ROLE] ' || safe || '[/TURN]#' END AS piece FROM turns
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, given NULLS FIRST, has, safe)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, given NULLS FIRST, has, safe) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length(piece))::BIGINT AS formatted_chars,
           regexp_full_match(string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN left(role, 1) ELSE '?' END, '' ORDER BY turn NULLS FIRST, given NULLS FIRST, has, safe), 's?(ua)*u?') AS valid
    FROM marked GROUP BY conv_id
"""
