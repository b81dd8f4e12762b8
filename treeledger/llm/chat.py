"""Chat formatting: typed content parts flattened into a marked-up conversation string.

A message is a list of typed parts (text, image, audio, document). A visitor, one expression for
each kind, flattens the parts in order: a text part becomes its escaped text, an attachment
becomes a placeholder, and its reference and its expanded token count are recorded beside the
string. Messages are wrapped in turn marks and joined per conversation. Everything is a
DataFrame expression; there is one exchange, on the conversation.

The escape is reversible: ``<|`` inside a text becomes ``<||``, so no mark can be read inside a
text and each ``<||`` of the output is one ``<|`` of the input. Text parts that follow one another are
escaped as one text, so that no mark can be put together from several. A line break inside a role is
written as ``<|n|>``.

Defined cases: null text is the empty text; null parts are left out, a null list has no parts; a part whose kind
is null or unknown has the placeholder ``<|other|>`` and stands with its own kind among the attachments, as one
token for each unit; null role is the empty role; null turns come first;
equal turns are ordered by role, then text, and repeated rows stay repeated; a null conv_id is a
conversation of its own; an empty table gives an empty table; other columns are ignored. A
conversation is one row of the output, so one conversation has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, PLACE_CLOSE = "<|im_start|>", "<|im_end|>\n", "|>"
END_PATTERN = r"<\|im_end\|>\n"
#: Tokens that one unit of an attachment expands to: an image tile, a second of sound, a page.
EXPANDED = {"image": 256, "audio": 25, "document": 512}
#: What stands for an attachment of another kind.
OTHER = "other"
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units"))
    ).cast(PARTS)


def visit(parts: Column) -> Column:
    """The flattened string of a list of parts."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))

    def step(s: Column, p: Column) -> Column:
        mark = F.concat(F.lit("<|"), F.when(p["kind"].isin(*EXPANDED), p["kind"]).otherwise(F.lit(OTHER)), F.lit(PLACE_CLOSE))
        is_text = F.coalesce(p["kind"] == "text", F.lit(False))
        done = F.when(is_text, s["done"]).otherwise(F.concat(s["done"], escape(s["run"]), mark))
        return F.struct(done.alias("done"), F.when(is_text, F.concat(s["run"], F.coalesce(p["text"], F.lit("")))).otherwise(F.lit("")).alias("run"))

    return F.aggregate(present(parts), start, step, lambda s: F.concat(s["done"], escape(s["run"])))


def present(parts: Column) -> Column:
    return F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())


def attachments(parts: Column, expanded: Mapping[str, int] = EXPANDED) -> Column:
    """(kind, ref, tokens) of the parts that are not text, in order."""
    rate = F.create_map(*[F.lit(x) for kv in expanded.items() for x in kv])
    return F.transform(
        F.filter(present(parts), lambda p: F.coalesce(p["kind"] != "text", F.lit(True))),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), (F.coalesce(p["units"], F.lit(1)) * F.coalesce(rate[p["kind"]], F.lit(1))).cast("bigint").alias("tokens")),
    )


def format_conversations(turns: DataFrame, parts: str | None = None, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask, attachments.

    ``turns`` has conv_id, turn, role and text, or a column of parts named by ``parts``. ``mask``
    has (skip, take) for each turn: of the turn's segment, the code points before those that
    the loss covers, and their number.
    """
    content = F.col(parts) if parts else text_parts(F.col("text"))
    flat = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("parts")
    ).select("conv_id", "turn", "role", visit(F.col("parts")).alias("body"), attachments(F.col("parts")).alias("attached"))
    row = F.struct(
        F.coalesce("turn", F.lit(-(2**63))).alias("turn"),
        "role",
        "body",
        "attached",
    )
    grouped = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    head = lambda r: F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: F.concat(head(r), r["body"], F.lit(END))), "").alias("formatted"),
        F.transform(
            "rows", lambda r: F.struct(F.length(head(r)).alias("skip"), F.when(r["role"] == trained_role, F.length(r["body"])).otherwise(F.lit(0)).alias("take"))
        ).alias("mask"),
        F.flatten(F.transform("rows", lambda r: r["attached"])).alias("attachments"),
    )


def segments(formatted: Column) -> Column:
    """The segment of each turn, without its end mark."""
    cut = F.split(formatted, END_PATTERN, -1)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def read_turns(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: array of (role, text)."""

    def turn(segment: Column) -> Column:
        at = F.instr(segment, F.lit("\n"))
        role = F.substring(segment, F.lit(len(START) + 1), at - F.lit(len(START) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(segment, at + 1, F.length(segment))).alias("text"))

    return F.transform(segments(formatted), turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped, joined with nothing between."""
    taken = F.zip_with(segments(formatted), mask, lambda s, m: F.when(m["take"] > 0, unescape(F.substring(s, m["skip"] + 1, m["take"]))).otherwise(F.lit("")))
    return F.array_join(taken, "")


def digest(conversations: DataFrame) -> DataFrame:
    """The columns that the query returns, read back from the formatted strings."""
    turns = read_turns(F.col("formatted"))
    loss = masked_text(F.col("formatted"), F.col("mask"))
    said = conversations.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return said.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
