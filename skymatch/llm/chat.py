"""Chat formatting from a declarative template, in DataFrame functions only.

A template gives the text before and after each turn and the roles whose text
carries loss. A finite-state machine over roles marks the turns that may not
follow the one before. Control characters inside roles and texts are escaped
by two-character codes, so a marker can never arise inside a text and the
output can be read back exactly.

`segments` returns one row per piece of output and never holds more than a turn
in a row. Turns are numbered and follow each other by way of blocks of turns,
so a conversation with very many turns is dealt over tasks. `conversations`
joins the pieces of each conversation into one string, which must fit a row.

Turns are ordered by turn (nulls first), role and text. Defined results: a null
text or role is empty; a null conversation id is one conversation; repeated
rows are turns of their own; an empty table gives no rows; an unknown role is
formatted, carries no loss and is marked out of order; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that are ordered together.
BLOCK = 512


@dataclass(frozen=True)
class Template:
    """``before`` has the role's place as ``{role}``; ``follows`` maps a role to those that may come next, '' to the first."""

    before: str = "### {role}: "
    after: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: Characters that the markers use and texts may not; each with its code after a backslash.
    codes: tuple[tuple[str, str], ...] = (("\\", "s"), ("#", "h"), ("<", "l"), (":", "c"))

    def escape(self, text: Column) -> Column:
        for sign, code in self.codes:
            text = F.replace(text, F.lit(sign), F.lit("\\" + code))
        return text

    def unescape(self, text: Column) -> Column:
        for sign, code in reversed(self.codes):
            text = F.replace(text, F.lit("\\" + code), F.lit(sign))
        return text

    def head(self, role: Column) -> Column:
        left, right = self.before.split("{role}")
        return F.concat(F.lit(left), self.escape(role), F.lit(right))

    def read(self, formatted: Column) -> Column:
        """The turns in ``formatted``: an array of structs with role and text."""
        left, right = self.before.split("{role}")
        turns = F.split(formatted, F.lit("\\Q" + self.after + "\\E"))
        turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

        def parse(turn: Column) -> Column:
            at = F.position(F.lit(right), turn)
            role = F.substr(turn, F.lit(len(left) + 1), at - len(left) - 1)
            return F.struct(self.unescape(role).alias("role"), self.unescape(F.substr(turn, at + len(right))).alias("text"))

        return F.transform(turns, parse)


def turns(rows: DataFrame, template: Template) -> DataFrame:
    """``(conv_id, turn, role, text, number, in_order)``: numbered turns with the state machine's verdict.

    The last role and the size of each block of turns are found first (as many
    rows as blocks), so no window spans a whole conversation of turns.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text")
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.max_by("role", order).alias("last"))
    along = Window.partitionBy("conv_id").orderBy("block")
    before = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lag("last").over(along).alias("last"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("i", F.row_number().over(inside) - 1).withColumn("ahead", F.lag("role").over(inside))
    before = before.withColumnsRenamed({"conv_id": "c", "block": "b"})
    joined = numbered.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    state = F.when(F.col("i") > 0, F.col("ahead")).otherwise(F.coalesce("last", F.lit("")))
    moves = F.array(*[F.lit(f"{a}\n{b}") for a, after in template.follows.items() for b in after])
    return joined.select("conv_id", "turn", "role", "text", (F.col("base") + F.col("i")).alias("number"), F.array_contains(moves, F.concat_ws("\n", state, "role")).alias("in_order"))


def segments(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, number, part, piece, loss, in_order)``: pieces of output; ``part`` is 0 head, 1 text, 2 end."""
    made = turns(rows, template)
    loss = F.col("role").isin(*template.loss_roles)
    pieces = F.array(
        F.struct(template.head(F.col("role")).alias("piece"), F.lit(False).alias("loss")),
        F.struct(template.escape(F.col("text")).alias("piece"), loss.alias("loss")),
        F.struct(F.lit(template.after).alias("piece"), F.lit(False).alias("loss")),
    )
    return made.select("conv_id", "number", "in_order", F.posexplode(pieces).alias("part", "s")).select("conv_id", "number", "part", "s.piece", "s.loss", "in_order")


def conversations(pieces: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_parts, valid)`` from `segments`; ``loss_parts`` are the escaped texts with loss, in order."""
    joined = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("number", "part", "piece", "loss"))).alias("all"), F.every("in_order").alias("valid"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x["piece"]), "")
    return joined.select("conv_id", text(F.col("all")).alias("formatted"), F.transform(F.filter("all", lambda x: x["loss"]), lambda x: x["piece"]).alias("loss_parts"), "valid")


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Figures on each conversation, read back from the output."""
    rows = formatted.withColumn("turns", template.read(F.col("formatted"))).withColumn("lost", F.array_join(F.transform("loss_parts", template.unescape), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
