"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``### role: text</turn>`` and a line feed. A deterministic parser reads the
rendered text back; turns that it does not recover as they were are rendered again in the escaped
form ``###\\ role: text</turn>``, in which the control strings of the grammar cannot occur inside a
text, and the parse is compared again. The escapes are reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, MARK, PLAIN, ESCAPED = "</turn>", "###", "### ", "###\\ "
#: What each control string becomes inside an escaped text; the backslash comes first.
ESCAPES = (("\\", "\\0"), (END, "\\1"), (MARK, "\\2"), (":", "\\3"))


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def render_turn(turn: Column, escaped: Column) -> Column:
    """One turn of struct(role, text) as text, without the line feed that follows."""
    return F.when(escaped, F.concat(F.lit(ESCAPED), escape(turn["role"]), F.lit(": "), escape(turn["text"]), F.lit(END))).otherwise(
        F.concat(F.lit(PLAIN), turn["role"], F.lit(": "), turn["text"], F.lit(END))
    )


def read_turn(piece: Column) -> Column:
    """struct(role, text, escaped, body_start, body_chars) of one rendered turn without its end mark; null if the grammar rejects it."""
    escaped = piece.startswith(F.lit(ESCAPED))
    head = F.when(escaped, F.lit(len(ESCAPED))).otherwise(F.lit(len(PLAIN)))
    rest = F.substr(piece, head + 1)
    colon = F.position(F.lit(": "), rest)
    role, body = F.substr(rest, F.lit(1), colon - 1), F.substr(rest, colon + 2)
    valid = (escaped | piece.startswith(F.lit(PLAIN))) & (colon > 0) & ~F.contains(rest, F.lit(MARK)) & ~F.contains(rest, F.lit(END))
    return F.when(
        valid,
        F.struct(
            F.when(escaped, unescape(role)).otherwise(role).alias("role"),
            F.when(escaped, unescape(body)).otherwise(body).alias("text"),
            escaped.alias("escaped"),
            (head + colon + 1).alias("body_start"),
            F.char_length(body).alias("body_chars"),
        ),
    )


def parse(formatted: Column) -> Column:
    """All turns of a rendered conversation, by read_turn()."""
    pieces = F.split(formatted, END + "\n", -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), read_turn)


def _said(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per conversation: conv_id, turns (as recovered by the parser), formatted, loss_mask, exact.

    Turns are ordered by (turn, role, text), null turns first; equal rows stay as repeated turns. A null
    role or text counts as empty; a null conversation id is a conversation of its own. An empty table
    gives no rows. Other columns are ignored. loss_mask has, for each assistant turn, its index and the
    span of its text (code points, from 0) in the rendered turn. One conversation's text is one value,
    so it has to fit one string.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("src"))
    grouped = grouped.select("conv_id", _said(F.col("src")).alias("src"))

    def fails(t: Column) -> Column:
        back = read_turn(F.concat(F.lit(PLAIN), t["role"], F.lit(": "), t["text"]))
        return ~(F.coalesce(back["role"] == t["role"], F.lit(False)) & F.coalesce(back["text"] == t["text"], F.lit(False)))

    def rendered(conflict) -> Column:
        return F.concat(F.array_join(F.transform("src", lambda t: F.concat(render_turn(t, conflict(t)), F.lit("\n"))), ""))

    tried = grouped.withColumn("first", rendered(lambda t: F.lit(False)))
    tried = tried.withColumn("same", F.coalesce(_said(parse(F.col("first"))) == F.col("src"), F.lit(False)))
    tried = tried.withColumn("second", F.when(F.col("same"), F.col("first")).otherwise(rendered(fails)))
    tried = tried.withColumn("same", F.col("same") | F.coalesce(_said(parse(F.col("second"))) == F.col("src"), F.lit(False)))
    done = tried.withColumn("formatted", F.when(F.col("same"), F.col("second")).otherwise(rendered(lambda t: F.lit(True))))
    done = done.withColumn("turns", parse(F.col("formatted")))
    mask = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("turn_index"), t["body_start"].alias("start"), t["body_chars"].alias("chars"), t["escaped"].alias("escaped"), (t["role"] == "assistant").alias("on"))),
        lambda m: m["on"],
    )
    return done.select("conv_id", "turns", "formatted", mask.alias("loss_mask"), (_said(F.col("turns")) == F.col("src")).alias("exact"))


def loss_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the mask, in order, nothing between."""
    pieces = F.split(formatted, END + "\n", -1)

    def one(m: Column) -> Column:
        body = F.substr(F.get(pieces, m["turn_index"]), m["start"] + 1, m["chars"])
        return F.when(m["escaped"], unescape(body)).otherwise(body)

    return F.array_join(F.transform(mask, one), "")


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of query op1: counts and hashes of what is read back from the rendered text."""
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = formatted.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(read, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
