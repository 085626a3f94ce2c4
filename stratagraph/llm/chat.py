"""Chat formatting that is read back.

A conversation is rendered turn by turn:

    <|im_start|>ROLE newline TEXT <|im_end|> newline

The grammar is regular and its parser deterministic: a turn ends at the first end mark after its start
mark, its role ends at the first newline, and in a text every ``<``, backslashes, ``|`` with at least
one backslash stands for one backslash less. A turn is first rendered as it is and parsed again; if
that doesn't give the same role and text (it holds a mark, or something that looks escaped), each
``<``, backslashes, ``|`` in it gets one more backslash, after which no mark is left and the round
trip is exact. The assembled conversation is parsed once more and compared with its source.

In roles, ``%``, newlines and ``|`` are written as ``%25``, ``%0A`` and ``%7C``.

A conversation of any number of turns is put together in two steps, blocks of turns first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
_END = r"<\|im_end\|>"
#: Turns that are put together first.
BLOCK = 32


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _body(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), _role_out(role), F.lit("\n"), text)


def parse(formatted: Column) -> Column:
    """Turns as an array of ``role, text`` and the ``raw`` length of the text as it stands; null where
    the text is not of the grammar."""
    parts = F.split(formatted, _END, -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(x: Column, i: Column) -> Column:
        x = F.when(i > 0, F.substring(x, F.lit(2), F.length(x))).otherwise(x)  # the newline after an end mark
        x = F.substring(x, F.lit(len(BEGIN) + 1), F.length(x))
        cut = F.locate("\n", x)
        raw = F.substring(x, cut + 1, F.length(x))
        return F.struct(_role_in(F.substring(x, F.lit(1), cut - 1)).alias("role"), _unescaped(raw).alias("text"), F.length(raw).alias("raw"))

    def good(x: Column, i: Column) -> Column:
        head = F.when(i > 0, F.lit("\n" + BEGIN)).otherwise(F.lit(BEGIN))
        rest = F.substring(x, F.length(head) + 1, F.length(x))
        return F.startswith(x, head) & F.contains(rest, F.lit("\n")) & ~F.contains(rest, F.lit(BEGIN))

    last = F.element_at(parts, -1)
    ok = F.forall(F.transform(turns, good), lambda x: x) & ((F.size(turns) == 0) & (last == "") | (F.size(turns) > 0) & (last == "\n"))
    return F.when(ok, F.transform(turns, turn))


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, source``: each conversation's text, and the hashes of its source turns.

    Turns are in the order of ``turn``, equal ones in that of role and text (nulls first); null
    roles and texts are empty. Rows without a ``conv_id`` are one conversation, without a name.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = F.concat(_body(F.col("role"), F.col("text")), F.lit(END + "\n"))
    rows = rows.withColumn("plain", plain)
    back = parse(F.col("plain"))
    same = F.coalesce((F.size(back) == 1) & (F.get(back, 0)["role"] == F.col("role")) & (F.get(back, 0)["text"] == F.col("text")), F.lit(False))
    # Only such a sequence can fail the round trip, and most texts have none: no need to try.
    safe = ~F.col("text").rlike(r"<\\*\|")
    rows = rows.withColumn("out", F.when(safe | same, F.col("plain")).otherwise(F.concat(_body(F.col("role"), _escaped(F.col("text"))), F.lit(END + "\n"))))
    one = F.struct("turn", "role", "text", "out", F.xxhash64("role", "text").alias("hash"))
    block = rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    block = block.select("conv_id", F.struct(F.col("block"), F.array_join("t.out", "").alias("out"), F.col("t.hash").alias("hash")).alias("b"))
    whole = block.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return whole.select("conv_id", F.array_join("b.out", "").alias("formatted"), F.flatten("b.hash").alias("source"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` as parsed from ``formatted``, ``identical`` (to the source) and ``loss``: the loss
    mask as runs of ``n, learn`` code points over the formatted text, learned in assistant texts."""
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    learn = lambda x: x["role"] == "assistant"

    def runs(x: Column) -> Column:
        before = F.length(_role_out(x["role"])) + len(BEGIN) + 1
        return F.array(F.struct(before.alias("n"), F.lit(False).alias("learn")), F.struct(x["raw"].alias("n"), learn(x).alias("learn")), F.struct(F.lit(len(END) + 1).alias("n"), F.lit(False).alias("learn")))

    same = F.transform("turns", lambda x: F.xxhash64(x["role"], x["text"])) == F.col("source")
    return parsed.withColumns({"identical": F.coalesce(same, F.lit(False)), "loss": F.flatten(F.transform("turns", runs))})


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, identical``, read
    back from the formatted texts. No rows give no conversations."""
    back = read_back(render(turns))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    back = back.withColumn("learned", learned)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
