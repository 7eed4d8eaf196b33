"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans that fit a budget. Tokens are counted in what is
emitted, markers and escapes included, by TOKEN: pieces of words and numbers, and each other character but white space.
No token reaches over the end of a turn, so a window's tokens are the sum of its turns'. Every window after
the first repeats the conversation's opening system turn and a limited stretch of history; the loss mask
covers only the assistant texts that are new in a window, so each is a target once. A turn is `<s>role`, a
line break, its text (in `[INST]`..`[/INST]` unless it is the assistant's) and `</s>`; control strings in
texts get a backslash after their first character, reversibly.

Cases: a null text or role is empty; a null conv_id is a conversation; turns are ordered by (turn, role,
text), nulls first, so ties and repeated rows keep a defined place; a turn larger than the budget is never cut
and stands alone beside the system turn; other columns are ignored. A conversation is one row by contract
(its digest covers all its turns), so it must fit into a task; conversations are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BUDGET = 512  # tokens of a window
HISTORY_TURNS = 2
HISTORY_TOKENS = 128
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
OPEN, SHUT, INST, END_INST = "<s>", "</s>", "[INST]", "[/INST]"
PLAIN = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def windows(rows: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """rows(conv_id, turn, role, text) -> conv_id, window_no, formatted, n_repeated (turns shown before), loss array<struct<start,end>>."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), F.when(F.col("role") == "assistant", "").otherwise(INST))
    tail = F.concat(F.when(F.col("role") == "assistant", "").otherwise(END_INST), F.lit(SHUT))
    clean = clean.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"), tail.alias("tail"))
    clean = clean.withColumn("tokens", F.regexp_count(F.concat("head", "body", "tail"), F.lit(TOKEN)).cast("bigint"))
    clean = clean.select("conv_id", F.struct((F.row_number().over(order) - 1).alias("i"), "role", "head", "body", "tail", "tokens", (F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("upto")).alias("t"))
    convs = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = F.col("turns")
    has_system = (turns[0]["role"] == "system").cast("int")
    convs = convs.withColumn("sys", has_system).withColumn("sys_tokens", F.col("sys") * turns[0]["tokens"])

    def opened(t: Column) -> Column:
        """A window that begins with turn t: struct(first, n_hist, base), base being the prefix sum that its budget counts from."""
        before = t["upto"] - t["tokens"]
        lo = F.greatest(t["i"] - history_turns, F.col("sys"))
        near = F.filter(F.slice(turns, lo + 1, F.greatest(t["i"] - lo, F.lit(0))), lambda h: before - h["upto"] + h["tokens"] <= history_tokens)
        held = F.aggregate(near, F.lit(0).cast("bigint"), lambda a, h: a + h["tokens"])
        sys = F.when(t["i"] > 0, F.col("sys_tokens")).otherwise(0)
        fits = sys + held + t["tokens"] <= budget
        return F.struct(t["i"].alias("first"), F.when(fits, F.size(near)).otherwise(0).alias("n_hist"), (before - sys - F.when(fits, held).otherwise(0)).alias("base"))

    empty = F.array().cast("array<struct<first:int,n_hist:int,base:bigint>>")
    starts = F.aggregate(turns, empty, lambda acc, t: F.when((F.size(acc) == 0) | (t["upto"] - F.coalesce(F.try_element_at(acc, F.lit(-1))["base"], F.lit(0)) > budget), F.concat(acc, F.array(opened(t)))).otherwise(acc))
    convs = convs.withColumn("starts", starts)

    def window(s: Column, k: Column) -> Column:
        """A window with its own turns only, so that no window carries the whole conversation."""
        end = F.coalesce(F.try_element_at(F.col("starts"), k + 2)["first"], F.size(turns))
        system = F.when((F.col("sys") == 1) & (s["first"] > 0), F.slice(turns, 1, 1)).otherwise(F.slice(turns, 1, 0))
        old = F.concat(system, F.slice(turns, s["first"] - s["n_hist"] + 1, s["n_hist"]))
        return F.struct(k.alias("window_no"), old.alias("old"), F.slice(turns, s["first"] + 1, end - s["first"]).alias("new"))

    one = convs.select("conv_id", F.inline(F.transform("starts", window)))
    shown = F.concat("old", "new")
    one = one.withColumn("shown", shown)
    formatted = F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"], t["tail"])), "")
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + F.length(t["tail"])
    loss = F.aggregate(
        "new",
        F.struct(F.aggregate("old", F.lit(0), lambda a, t: a + size(t)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct((a["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).alias("start"), (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    return one.select("conv_id", "window_no", formatted.alias("formatted"), F.size("old").alias("n_repeated"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted window."""
    pieces = F.split(formatted, SHUT)

    def turn(piece: Column) -> Column:
        cut = F.locate("\n", piece)
        role = unescape_role(piece.substr(F.lit(len(OPEN) + 1), cut - len(OPEN) - 1))
        body = piece.substr(cut + 1, F.length(piece))
        inner = F.when(role == "assistant", body).otherwise(body.substr(F.lit(len(INST) + 1), F.length(body) - len(INST) - len(END_INST)))
        return F.struct(role.alias("role"), unescape(inner).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_back(out: DataFrame) -> DataFrame:
    """windows() -> a row a conversation, from the formatted strings and loss masks alone."""
    turns = F.slice(parse(F.col("formatted")), F.col("n_repeated") + 1, 1 << 30)
    learned = F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"])))
    parts = out.select(
        "conv_id",
        F.struct(
            "window_no",
            F.size(turns).alias("n"),
            F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.array_join(learned, "").alias("learned"),
            F.length("formatted").alias("chars"),
        ).alias("w"),
    )
    convs = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    said, got = F.array_join("w.said", ""), F.array_join("w.learned", "")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return convs.select("conv_id", total("w.n").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(got).cast("bigint").alias("loss_chars"), F.sha2(got, 256).alias("loss_sha256"), total("w.chars").alias("formatted_chars"), F.size("w").alias("n_windows"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return read_back(windows(rows.unionByName(probe)))


QUERIES = {"op2_chat": op2_chat}
