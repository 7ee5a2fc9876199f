"""Conversations as training text, checked by reading them back.

Grammar of a formatted conversation, which is a row of turns and nothing else:

    turn := "### " role ": " text LF "</turn>" LF
    role := System | User | Assistant | "=" and the hexadecimal UTF-8 bytes of any other role

Control strings are "### " and "</turn>". Within a text a control string is only allowed behind a backslash, and the
reader takes one backslash away from those before it, so a text may be written raw or escaped (one backslash more
before each control string and the backslashes before it). Reading is deterministic: turns end at the end mark, which
no text can hold unescaped, and a turn that isn't in the grammar is an error.

Texts are written raw first. Each turn is read again by itself; where the reader finds no turn, several or another role
or text than the source's, the content conflicts and is escaped, and the result is read again. Escaping once more is
undone by the reader whatever the text, so this ends after two rounds; a turn that differed still would stop the job.
A turn is in the grammar whatever stands before or behind it, so what holds for each turn holds for their sequence, and
turns are formatted and checked where they lie: only ``conversations`` brings those of one id together.

Defined cases: a null text is an empty one, a null role a role without letters; turns stand in the order of turn, role and text,
nulls first, and repeated rows are turns each; a null id is a conversation of its own; an empty table gives no rows.
A conversation is one row of the result, so its text is bounded by what a row can hold (2 GB); who has longer ones keeps
the rows of ``formatted_turns``. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums

#: Words of the template.
OPEN, CLOSE, ROLES = "### ", "</turn>", {"system": "System", "user": "User", "assistant": "Assistant"}
END = f"\n{CLOSE}\n"
CONTROL = f"(?:{OPEN}|{CLOSE})"
TRAINED = "assistant"
#: Runs of backslashes are taken whole, from their first one, so that long ones cost no more than others.
_TO_ESCAPE, _ESCAPED, _BARE = rf"(?<!\\)(\\*+{CONTROL})", rf"(?<!\\)\\(\\*+{CONTROL})", rf"(?<!\\){CONTROL}"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _TO_ESCAPE, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _role_name(role: Column) -> Column:
    named = F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in ROLES.items()])
    return F.coalesce(named, F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8"))))


def _role_of(name: Column) -> Column:
    known = F.coalesce(*[F.when(name == v, F.lit(k)) for k, v in ROLES.items()])
    return F.coalesce(known, F.when(name.startswith("="), F.decode(F.unhex(F.substr(name, F.lit(2))), "UTF-8")))


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), _role_name(role), F.lit(": "))


def _turn(segment: Column) -> Column:
    """What a turn without its end mark says; null if it isn't in the grammar."""
    name = F.regexp_extract(segment, rf"^{OPEN}(System|User|Assistant|=[0-9A-F]*): ", 1)

    def of(name: Column) -> Column:
        body = F.substr(segment, F.length(name) + len(OPEN) + 3)  # behind the colon and the blank
        return let(body, lambda b: F.when((name != "") & ~b.rlike(_BARE), F.struct(_role_of(name).alias("role"), unescaped(b).alias("text"))))

    return let(name, of)


def segments(formatted: Column) -> Column:
    """The turns of a formatted text without their end marks; null where something stands behind the last."""
    parts = F.split(formatted, END)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text; null if it isn't in the grammar."""
    turns = F.transform(segments(formatted), _turn)
    return let(turns, lambda t: F.when(~F.exists(t, lambda x: x.isNull()), t))


def _conflicts(role: Column, text: Column) -> Column:
    """Whether a text written raw is read back as anything else than the source; stops if escaping doesn't mend that."""
    same = lambda body: F.coalesce(parsed(_written(role, body)) == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("a turn can't be read back: "), F.substr(text, F.lit(1), F.lit(100)))).cast("boolean")
    return F.when(same(text), F.lit(False)).otherwise(let(escaped(text), lambda b: F.when(same(b), F.lit(True)).otherwise(failed)))


def _written(role: Column, body: Column) -> Column:
    return F.concat(_head(role), body, F.lit(END))


def _checked_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """id, turn, role, text and whether the text has to be escaped."""
    out = turns.select(F.col(id_col), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return out.withColumn("escaped", _conflicts(F.col("role"), F.col("text")))


def _body(text: Column, is_escaped: Column) -> Column:
    return F.when(is_escaped, escaped(text)).otherwise(text)


def formatted_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: id, turn, role, text, escaped, its formatted text, and in that the start and length of what is trained
    on (code points; the length is 0 in turns of others than the assistant)."""
    out = _checked_turns(turns, id_col, turn_col, role_col, text_col)
    role, text = F.col("role"), F.col("text")
    cells = let(_body(text, F.col("escaped")), lambda b: F.struct(_written(role, b).alias("formatted"), F.length(_head(role)).alias("start"), F.when(role == TRAINED, F.length(b)).otherwise(0).alias("length")))
    return out.withColumn("_cells", cells).select(id_col, "turn", "role", "text", "escaped", "_cells.*")


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: id, formatted, and loss, the spans (turn, start, length; code points, turns from 0) that
    a model is trained on: each assistant text as it is written, without marks. What travels is each text once."""
    own = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "escaped")))
    rows = _checked_turns(turns, id_col, turn_col, role_col, text_col).groupBy(id_col).agg(own.alias("_turns"))
    parts = F.transform("_turns", lambda t: _written(t["role"], _body(t["text"], t["escaped"])))

    def cells(parts: Column) -> Column:
        ends = prefix_sums(F.transform(parts, lambda p: F.length(p).cast("bigint")))

        def spans(ends: Column) -> Column:
            def span(t: Column, i: Column) -> Column:
                head = F.length(_head(t["role"]))
                size = F.length(F.get(parts, i))
                return F.struct(i.alias("turn"), (F.get(ends, i) - size + head).alias("start"), (size - head - len(END)).cast("bigint").alias("length"), t["role"].alias("role"))

            return F.transform("_turns", span)

        loss = F.transform(F.filter(let(ends, spans), lambda s: s["role"] == TRAINED), lambda s: s.dropFields("role"))
        return F.struct(F.array_join(parts, "").alias("formatted"), loss.alias("loss"))

    return rows.select(id_col, let(parts, cells).alias("_cells")).select(id_col, "_cells.*")


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Of rows of ``conversations``: id, formatted, turns (role, text) as they are read, and trained, the unescaped texts under
    the loss spans. Stops where a text isn't in the grammar or a span lies outside of its turn."""
    rows = formatted.select(id_col, "formatted", "loss", parsed(F.col("formatted")).alias("turns"))
    turns = F.coalesce("turns", F.raise_error(F.lit("a text is not in the grammar of conversations")))

    def trained(parts: Column) -> Column:
        ends = prefix_sums(F.transform(parts, lambda p: F.length(p).cast("bigint") + len(END)))
        return let(ends, lambda e: F.transform("loss", lambda span: under(F.get(parts, span["turn"]), F.get(e, span["turn"]) - len(END), span)))

    def under(part: Column, end: Column, span: Column) -> Column:
        begin = end - F.length(part)
        inside = (span["start"] >= begin) & (span["start"] + span["length"] <= end)
        text = F.substr(part, (span["start"] - begin + 1).cast("int"), span["length"].cast("int"))
        return F.when(inside, unescaped(text)).otherwise(F.raise_error(F.lit("a span lies outside of its turn")).cast("string"))

    return rows.select(id_col, "formatted", turns.alias("turns"), let(segments(F.col("formatted")), trained).alias("trained"))
