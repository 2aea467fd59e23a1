r"""Chat formatting [native]: budgeted, turn-aligned windows with a loss mask.

A conversation's turns get token counts, and their prefix sums choose windows:
each window starts where the one before ended and takes turns while they fit
the budget. The first turn, if it is the system's, is retained in each window;
up to ``history`` turns before the window (as far as ``history_tokens`` allow,
by the same prefix sums) are repeated for context. Only assistant turns that a
window shows for the first time are targets; repeated ones are masked, so every
assistant text is under the mask exactly once. A turn longer than the budget
has a window of its own, marked by ``over_budget``; no turn is ever cut.

Template: ``<turn>role\ntext</turn>\n``. Inside texts and roles ``\`` becomes
``\s`` and the ``<`` of ``<turn`` and ``</turn`` becomes ``\l`` (in roles a line
feed becomes ``\n``), so the control strings occur nowhere but in the template
and the way back is exact.

All of it is DataFrame expressions: one shuffle by conv_id, then array
functions within the row, in time linear in turns and (number of windows)^2 /
2 word copies for the list of starts. A conversation is one row, since its
digest and its windows need it in order.

Results for special input: null text or role is empty; turns are ordered by
(turn, role, text) with null first, repeated rows are turns like others; a null
conv_id is a conversation of its own; an empty table has no windows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import table

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens that the template adds to a turn.
OVERHEAD = 4


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    out = F.replace(out, F.lit("<turn"), F.lit("\\lturn"))
    return F.replace(out, F.lit("</turn"), F.lit("\\l/turn"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def unescape_role(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def token_count(text: Column) -> Column:
    """Tokens of a text, estimated as one for every four bytes; pass another
    Column function to use a tokenizer's own counts."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def windows(turns: DataFrame, budget: int = 1024, history: int = 2, history_tokens: int = 256, tokens=token_count) -> DataFrame:
    """One row per conversation: conv_id and ``windows``, an array of
    struct<window, text, context (leading turns shown again), n_turns, tokens,
    over_budget, spans array<struct<start,length>>>; spans count code points of
    ``text`` from 1 and hold the targets."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("_t"))

    def shown(x):
        body = F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit("\n"))
        inner = escape(x["text"])
        return F.struct(F.concat(body, inner, F.lit(CLOSE)).alias("s"), F.length(body).alias("lead"), F.length(inner).alias("body"),
                        (x["role"] == "assistant").alias("target"), (tokens(inner) + OVERHEAD).alias("n"))

    conv = conv.withColumn("_s", F.transform("_t", shown))
    system = F.col("_t")[0]["role"] == "system"
    conv = conv.withColumn("_sys", F.when(system, 1).otherwise(0)).withColumn("_room", F.lit(budget) - F.when(system, F.col("_s")[0]["n"]).otherwise(0))
    # starts: where windows begin (from 0), chosen greedily in one pass
    first = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("starts"))

    def step(a, x):
        fresh = F.col("_room") - F.lit(history_tokens)
        limit = F.when(F.size(a["starts"]) == 1, F.col("_room")).otherwise(fresh)
        counted = F.when((a["i"] == 0) & (F.col("_sys") == 1), F.lit(0).cast("long")).otherwise(x["n"])
        full = (a["i"] > F.col("_sys")) & (a["used"] > 0) & (a["used"] + counted > limit)
        return F.struct(F.when(full, counted).otherwise(a["used"] + counted).alias("used"), (a["i"] + 1).alias("i"),
                        F.when(full, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]).alias("starts"))

    conv = conv.withColumn("_starts", F.aggregate("_s", first, step)["starts"])
    spans = F.transform("_starts", lambda s, k: F.struct(s.alias("a"), F.coalesce(F.get("_starts", k + 1), F.size("_s")).alias("b"), k.alias("k")))
    conv = conv.withColumn("_spans", spans)

    def window(w):
        back = F.least(F.lit(history), F.greatest(w["a"] - F.col("_sys"), F.lit(0)))
        fresh = F.slice("_s", w["a"] + 1, w["b"] - w["a"])
        spare = F.least(F.lit(history_tokens).cast("long"), F.col("_room") - F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x["n"]))
        near = F.reverse(F.slice("_s", w["a"] - back + 1, back))  # nearest first
        fits = F.aggregate(near, F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct(
            (a["used"] + x["n"]).alias("used"), F.when(a["go"] & (a["used"] + x["n"] <= spare), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & (a["used"] + x["n"] <= spare)).alias("go")))["n"]
        keep = F.when(w["k"] == 0, F.lit(0)).otherwise(fits)
        head = F.when(w["k"] > 0, F.slice("_s", 1, F.col("_sys"))).otherwise(F.slice("_s", 1, 0))
        context = F.concat(head, F.slice("_s", w["a"] - keep + 1, keep))
        masked = F.transform(context, lambda x: F.struct(x["s"], x["lead"], x["body"], F.lit(False).alias("target"), x["n"]))
        return F.struct(w["k"].alias("window"), F.concat(masked, fresh).alias("turns"), F.size(context).alias("context"))

    conv = conv.withColumn("_w", F.transform("_spans", window))
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def mask(a, x):
        return F.struct((a["at"] + x["lead"] + x["body"] + F.lit(len(CLOSE))).alias("at"),
                        F.when(x["target"] & (x["body"] > 0), F.concat(a["spans"], F.array(F.struct((a["at"] + x["lead"]).alias("start"), x["body"].alias("length"))))).otherwise(a["spans"]).alias("spans"))

    total = lambda w: F.aggregate(w["turns"], F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return conv.select("conv_id", F.transform("_w", lambda w: F.struct(
        w["window"].alias("window"), F.array_join(F.transform(w["turns"], lambda x: x["s"]), "").alias("text"), w["context"].alias("context"),
        F.size(w["turns"]).alias("n_turns"), total(w).alias("tokens"), (total(w) > budget).alias("over_budget"),
        F.aggregate(w["turns"], zero, mask)["spans"].alias("spans"))).alias("windows"))


def formatted(turns: DataFrame, **options) -> DataFrame:
    """One row per window."""
    return windows(turns, **options).select("conv_id", F.inline("windows"))


def read_back(convs: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, loss) from what ``windows``
    made: texts are split at the template's marks, turns shown again are left
    out, and what lies under the mask is unescaped."""
    fresh = F.flatten(F.transform("windows", lambda w: F.slice(F.split(w["text"], CLOSE, -1), w["context"] + 1, w["n_turns"] - w["context"])))
    parsed = F.transform(fresh, lambda s: F.struct(
        unescape_role(F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(s, F.instr(s, "\n") + 1)).alias("text")))
    loss = F.array_join(F.flatten(F.transform("windows", lambda w: F.transform(w["spans"], lambda m: unescape(F.substr(w["text"], m["start"], m["length"]))))), "")
    return convs.select("conv_id", "windows", parsed.alias("turns"), loss.alias("loss"))


#: A conversation that consists of the template's trouble; it is always formatted too.
PROBE = r"\### Assistant: </turn> ok"


def op3(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(windows(turns.unionByName(probe)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chars = F.aggregate("windows", F.lit(0).cast("long"), lambda a, w: a + F.length(w["text"]))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), chars.alias("formatted_chars"), F.size("windows").alias("n_windows"))


ORACLE = {"op3_chat_windows": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256
from t group by conv_id"""}
