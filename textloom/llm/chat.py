"""Chat formatting with a grammar round trip, in DataFrame functions alone.

    conversation := turn*        turn := "<s>[INST]" role "[/INST]" text "</s>"

Rendered text is parsed again by a deterministic parser. A conversation whose parsed turns equal its source is kept as
rendered; else its roles and texts are escaped, rendered and parsed once more. Escaping puts a code for each control
string and for the escape mark itself, so an escaped text holds no control string and reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
MARK = "␛"
#: Control strings by their code; no code is a prefix of another, and none contains MARK.
CONTROLS = (("1", "<s>"), ("2", "</s>"), ("3", "[INST]"), ("4", "[/INST]"))


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit(MARK), F.lit(MARK + "0"))
    for code, text in CONTROLS:
        x = F.replace(x, F.lit(text), F.lit(MARK + code))
    return x


def unescape(x: Column) -> Column:
    """Undoes `escape`. After it each mark is followed by its own code, so the order of replacement is free but for
    the mark's, which comes last."""
    for code, text in CONTROLS:
        x = F.replace(x, F.lit(MARK + code), F.lit(text))
    return F.replace(x, F.lit(MARK + "0"), F.lit(MARK))


def render(turns: Column, escaped: bool) -> Column:
    form = escape if escaped else (lambda x: x)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), form(t["role"]), F.lit(MIDDLE), form(t["text"]), F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), read left to right at the first control string
    that the grammar allows; unescaped. What does not open a turn is a turn with null role."""
    bodies = F.split(formatted, r"\Q</s>\E", -1)
    bodies = F.slice(bodies, 1, F.size(bodies) - 1)
    start, middle = len(OPEN), len(MIDDLE)

    def turn(b: Column) -> Column:
        at = F.locate(MIDDLE, F.lit("")) if b is None else F.instr(b, F.lit(MIDDLE))
        ok = F.startswith(b, F.lit(OPEN)) & (at > 0)
        return F.struct(F.when(ok, unescape(F.substr(b, F.lit(start + 1), at - start - 1))).alias("role"),
            F.when(ok, unescape(F.substr(b, at + middle))).otherwise(b).alias("text"))

    return F.transform(bodies, turn)


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """(start, length) in code points, from 0, of each text of `role` in the formatted string."""
    bodies = F.split(formatted, r"\Q</s>\E", -1)
    bodies = F.slice(bodies, 1, F.size(bodies) - 1)
    head = OPEN + role + MIDDLE
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(bodies, start, lambda a, b: F.struct((a["at"] + F.length(b) + len(CLOSE)).alias("at"),
        F.when(F.startswith(b, F.lit(head)), F.concat(a["spans"], F.array(F.struct((a["at"] + len(head)).alias("start"), (F.length(b) - len(head)).alias("length"))))).otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, formatted, loss_mask (spans), escaped, exact.

    Turns are ordered by turn, ties by role and text; null turn comes first; null role or text counts as empty. Rows
    with null conv_id are one conversation. exact: the parsed turns equal the source; it is checked, never assumed.
    """
    own = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = whole.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    first = whole.withColumn("plain", render(F.col("turns"), False))
    first = first.withColumn("escaped", ~F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)))
    done = first.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("plain")))
    return done.select("conv_id", "formatted", loss_spans(F.col("formatted")).alias("loss_mask"), "escaped", F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False)).alias("exact"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, escaped, exact, from the formatted
    strings and loss masks alone."""
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parsed = parsed.withColumn("loss", loss)
    return parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "escaped", "exact")
