"""Chat formatting with prefix-target expansion, in DataFrame expressions only.

A turn is written ``<s>[INST]role\\ntext[/INST]``, a trainable role's turn ``<s>role\\ntext</s>``.
Inside roles and texts ``\\``, ``<`` and ``[`` become the pairs ``\\s``, ``\\l`` and ``\\b`` (and a
line feed in a role ``\\n``), so no control string can occur in them and the pairs can be undone
one after the other.  Every trainable turn becomes an example of its own: all turns before it as
context, then the turn itself, whose text alone is under the loss mask.  Turns after the last
trainable one (a whole conversation without one, too) make a last example with an empty mask, so
the longest example of a conversation always holds all its turns.

Defined cases: null text is empty, a null role is the empty role (not trainable); turns with equal
numbers are ordered by their written form, repeated rows are turns of their own; a null turn number
comes first; rows with a null conversation id form one conversation; an empty table gives no
example; other columns are ignored.  One conversation is one row of text by the operator's nature;
its turns are gathered once and the examples are cut from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, INST, INST_END, REPLY_END = "<s>", "[INST]", "[/INST]", "</s>"
TRAINABLE = "assistant"


def escape(c: Column) -> Column:
    """Reversible: the result holds neither ``<`` nor ``[``."""
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(c, F.lit("\\s"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_examples(conversations: DataFrame, trainable: str = TRAINABLE, id_col: str = "conv_id",
                    turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_length): examples count from 0, code points from 0."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    body = escape(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    train = role == F.lit(trainable)
    written = F.when(train, F.concat(F.lit(OPEN), _escape_role(role), F.lit("\n"), body, F.lit(REPLY_END))).otherwise(
        F.concat(F.lit(OPEN + INST), _escape_role(role), F.lit("\n"), body, F.lit(INST_END)))
    turns = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), written.alias("written"), train.alias("train"),
                 F.char_length(body).alias("n")).alias("t"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    last = F.size("ts") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("ts", i)["train"] | (i == last))
    targets = gathered.select("conv_id", "ts", F.posexplode(ends).alias("example", "at"))
    target = F.get("ts", F.col("at"))
    context = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("at") + 1), lambda t: t["written"]), "")
    text = targets.select("conv_id", F.col("example").cast("long").alias("example"), context.alias("text"),
                          target["train"].alias("train"), target["n"].alias("n"))
    length = F.when(F.col("train"), F.col("n")).otherwise(F.lit(0)).cast("long")
    return text.select("conv_id", "example", "text",
                       F.when(F.col("train"), F.char_length("text") - F.col("n") - len(REPLY_END))
                       .otherwise(F.char_length("text")).cast("long").alias("loss_start"),
                       length.alias("loss_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: turns (role, text) in order, trained texts, characters."""
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))
    per = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.sum(F.char_length("text")).cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"))
    parts = F.slice(F.split("longest", OPEN), 2, F.greatest(F.size(F.split("longest", OPEN)) - 1, F.lit(0)))
    whole = F.transform(parts, lambda p: F.when(
        p.startswith(INST), F.substring(p, F.lit(len(INST) + 1), F.char_length(p) - len(INST) - len(INST_END)))
        .otherwise(F.substring(p, F.lit(1), F.char_length(p) - len(REPLY_END))))
    split = F.transform(whole, lambda p: F.struct(
        _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.char_length(p))).alias("text")))
    return per.select("conv_id", split.alias("turns"),
                      F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"),
                      "formatted_chars")


def digests(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the examples."""
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(examples).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(turn, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
