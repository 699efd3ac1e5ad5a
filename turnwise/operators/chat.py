"""Conversations: from raw chat or instruction rows to one canonical form.

Two shapes are supported. *Nested*: one row per conversation with an array of
turns, as read from JSON; every step is local to the row. *Long*: one row per
message, keyed by (conv_id, turn); ``turn`` counts from 0 without gaps. The long
form never gathers a conversation, so its length is not limited by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.scale import lookup, number_rows, running_sums

# The chat markers.
OPEN = "<|im_start|>"
CLOSE = "<|im_end|>\n"

ROLE_OF_SPEAKER = {"human": "user", "gpt": "assistant", "system": "system"}


# --- nested form ---------------------------------------------------------------


def conversation_of(turns: Column) -> Column:
    return turns.cast("array<struct<from:string,value:string>>").alias("conversations")


def from_instructions(df: DataFrame) -> DataFrame:
    """instruction, input, output -> a two-turn conversation. The line break stays
    even when the input is empty."""
    asked = F.concat("instruction", F.lit("\n"), "input")
    turns = F.array(
        F.struct(F.lit("human").alias("from"), asked.alias("value")),
        F.struct(F.lit("gpt").alias("from"), F.col("output").alias("value")),
    )
    rest = [c for c in df.columns if c not in ("instruction", "input", "output")]
    return df.select(*rest, conversation_of(turns))


def from_messages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages (array of role, content) -> (conversations, rejects).

    A leading system message is put in front of the next message without a
    separator, one leading message that is not from the user is dropped, and
    conversations left without turns are dropped. An empty list, or a system
    message alone, cannot be converted and goes to the rejects.
    """
    m = F.col("messages")
    first = F.get(m, F.lit(0))
    system_first = F.coalesce(first["role"] == "system", F.lit(False))
    bad = m.isNull() | (F.size(m) == 0) | (system_first & (F.size(m) == 1))
    folded = F.when(
        system_first,
        F.transform(
            m,
            lambda x, i: F.struct(
                x["role"].alias("role"),
                F.when(i == 1, F.concat(first["content"], x["content"]))
                .otherwise(x["content"])
                .alias("content"),
            ),
        ),
    ).otherwise(m)
    kept = F.when(
        F.coalesce(first["role"] != "user", F.lit(True)), F.slice(folded, 2, F.size(m))
    ).otherwise(folded)
    turns = F.transform(
        kept,
        lambda x: F.struct(
            F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"),
            x["content"].alias("value"),
        ),
    )
    rest = [c for c in df.columns if c != "messages"]
    good = df.filter(~bad).select(*rest, conversation_of(turns))
    return good.filter(F.size("conversations") > 0), df.filter(bad)


def assign_ids(df: DataFrame, order: list[str], offset: int = 0) -> DataFrame:
    """id = position in the input as text. Call it before rows are dropped, so that
    dropped rows leave gaps."""
    return number_rows(df, order, "_i").withColumn(
        "id", (F.col("_i") + F.lit(offset)).cast("string")
    ).drop("_i")


def unnest(df: DataFrame, key: str = "id") -> DataFrame:
    """Nested conversations -> (key, j, speaker, value)."""
    at = df.select(key, F.posexplode("conversations").alias("j", "m"))
    return at.select(
        key,
        F.col("j").cast("bigint").alias("j"),
        F.col("m.from").alias("speaker"),
        F.col("m.value").alias("value"),
    )


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def role_of(speaker: Column) -> Column:
    """The chat role of a speaker; an unknown one is an error, for its turn would vanish."""
    known = F.create_map(*[F.lit(x) for kv in ROLE_OF_SPEAKER.items() for x in kv])
    unknown = F.raise_error(F.concat(F.lit("unknown speaker: "), F.coalesce(speaker, F.lit("null"))))
    return F.coalesce(F.try_element_at(known, speaker), unknown)


def render_nested(turns: str = "conversations", add_generation_prompt: bool = False) -> Column:
    """The whole conversation of a row as one text."""
    body = F.array_join(
        F.transform(turns, lambda x: turn_text(role_of(x["from"]), x["value"])), ""
    )
    if add_generation_prompt:
        body = F.concat(body, F.lit(OPEN + "assistant\n"))
    return body


def contexts_nested(df: DataFrame, key: str = "id") -> DataFrame:
    """One prompt per user turn: all earlier turns and answers, then the question."""
    at = df.select(key, "conversations", F.posexplode("conversations").alias("j", "m"))
    at = at.filter(F.col("m.from") == "human")
    upto = at.withColumn("conversations", F.slice("conversations", F.lit(1), F.col("j") + 1))
    return upto.select(
        key,
        F.col("j").cast("bigint").alias("j"),
        render_nested(add_generation_prompt=True).alias("prompt"),
    )


def split_turns(df: DataFrame, text: str = "rendered") -> DataFrame:
    """Cut a rendered conversation back into rounds.

    The text is split before every user header but the first, then each round at
    its assistant header. A round that does not fall into exactly two pieces ends
    the scan of that conversation.
    """
    user = f"{CLOSE}{OPEN}user\n"
    answer = f"{CLOSE}{OPEN}assistant\n"
    rounds = F.split(text, "\\Q" + user + "\\E")
    pieces = F.transform(
        rounds,
        lambda r, i: F.struct(
            i.cast("bigint").alias("round"), F.split(r, "\\Q" + answer + "\\E").alias("p")
        ),
    )
    first_bad = F.array_position(F.transform(pieces, lambda p: F.size(p["p"]) == 2), False)
    sound = F.when(first_bad > 0, F.slice(pieces, 1, (first_bad - 1).cast("int"))).otherwise(pieces)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(sound).alias("p")).select(
        *rest,
        F.col("p.round").alias("round"),
        F.get("p.p", F.lit(0)).alias("asked"),
        F.get("p.p", F.lit(1)).alias("answered"),
    )


# --- long form -----------------------------------------------------------------


def number_turns(messages: DataFrame, order: list[str]) -> DataFrame:
    """Replace ``turn`` by a gap-free count from 0, for sources that only have an order
    (a time stamp, or numbers with gaps)."""
    kept = messages.select("conv_id", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                           *[c for c in messages.columns if c not in ("conv_id", "turn")])
    keys = [f"_o{i}" for i in range(len(order))]
    numbered = running_sums(kept, ["conv_id"], keys, {"turn": F.lit(1).cast("bigint")})
    return numbered.drop(*keys)


def conversation_heads(messages: DataFrame) -> DataFrame:
    """Number of messages of each conversation, and whether its first one is to be
    dropped because it is not from the user."""
    drops = (F.col("turn") == 0) & (F.col("role") != "user")
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.bool_or(drops).alias("drops_first")
    )


def heads_with_system(messages: DataFrame) -> DataFrame:
    """``conversation_heads`` and the text of a leading system message, if there is one; of
    several in the same place the least."""
    leading = messages.filter("turn = 0 and role = 'system'")
    system = leading.groupBy("conv_id").agg(F.min("text").alias("_system"))
    return conversation_heads(messages).join(system, "conv_id", "left")


def _folded() -> Column:
    first = (F.col("turn") == 1) & F.col("_system").isNotNull()
    return F.when(first, F.concat("_system", "text")).otherwise(F.col("text"))


def fold_system(messages: DataFrame) -> DataFrame:
    """Put a leading system text in front of the next message, without separator."""
    marked = lookup(messages, heads_with_system(messages), ["conv_id"], ["conv_id", "turn"], weight="n_messages")
    return marked.withColumn("text", _folded()).select(*messages.columns)


def drop_leading_nonuser(messages: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Drop one leading message that is not from the user; ``j`` counts the rest."""
    heads = conversation_heads(messages) if heads is None else heads
    marked = lookup(messages, heads, ["conv_id"], ["conv_id", "turn"], weight="n_messages")
    j = F.col("turn") - F.col("drops_first").cast("bigint")
    return marked.withColumn("j", j).filter("j >= 0").drop("drops_first")


def speaker_of(role) -> Column:
    return F.when(F.col(role) == "user", "human").otherwise("gpt")


def normalize(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, j, speaker, value).

    The messages are read once and meet one row per conversation, which tells the system
    text and whether the first message goes.
    """
    marked = lookup(messages, heads_with_system(messages), ["conv_id"], ["conv_id", "turn"], weight="n_messages")
    j = F.col("turn") - F.col("drops_first").cast("bigint")
    return marked.select("conv_id", j.alias("j"), speaker_of("role").alias("speaker"), _folded().alias("value")).filter(
        "j >= 0"
    )


def alternation_faults(messages: DataFrame, speaker: str, at: str, roles=("human", "gpt")) -> DataFrame:
    """Messages whose role is unknown or is not the one their position asks for."""
    wanted = F.when(F.pmod(F.col(at), F.lit(2)) == 0, roles[0]).otherwise(roles[1])
    fault = F.when(
        F.coalesce(~F.col(speaker).isin(*roles), F.lit(True)), "unknown role"
    ).when(F.col(speaker) != wanted, "out of turn")
    return messages.withColumn("fault", fault)


def _rejects(marked: DataFrame, at: str) -> DataFrame:
    per_conversation = marked.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.count("fault").alias("n_faults"),
        F.min(F.when(F.col("fault").isNotNull(), F.struct(at, "fault"))).alias("first"),
    )
    return per_conversation.filter("n_faults > 0").select(
        "conv_id",
        F.col(f"first.{at}").cast("bigint").alias("first_fault_at"),
        F.col("first.fault").alias("reason"),
        F.col("n_faults").cast("bigint").alias("n_faults"),
        "n_messages",
    )


def split_valid(
    messages: DataFrame,
    speaker: str = "speaker",
    at: str = "j",
    roles=("human", "gpt"),
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(messages of well-formed conversations, one reject row per faulty conversation).

    With ``strict`` the first fault stops the job instead.
    """
    marked = alternation_faults(messages, speaker, at, roles)
    if strict:
        stop = F.raise_error(F.concat(F.lit("bad turn in conversation "), F.col("conv_id").cast("string")))
        sound = F.when(F.col("fault").isNotNull(), stop.cast("boolean")).otherwise(F.lit(True))
        return marked.filter(sound).drop("fault"), _rejects(marked.filter(F.lit(False)), at).drop("n_messages")
    rejects = _rejects(marked, at)
    ok = lookup(messages, rejects.select("conv_id", "n_messages"), ["conv_id"], ["conv_id", at],
                weight="n_messages", how="anti")
    return ok, rejects.drop("n_messages")


def inject_system(messages: DataFrame, text: str) -> DataFrame:
    """Put the same system message in front of every conversation."""
    moved = F.struct(
        (F.col("j") + 1).alias("j"), F.col("speaker").alias("speaker"), F.col("value").alias("value")
    )
    system = F.struct(
        F.lit(0).cast("bigint").alias("j"), F.lit("system").alias("speaker"), F.lit(text).alias("value")
    )
    return messages.select(
        "conv_id", F.inline(F.when(F.col("j") == 0, F.array(system, moved)).otherwise(F.array(moved)))
    )


def render(messages: DataFrame, add_generation_prompt: bool = False) -> DataFrame:
    """Rendered pieces in order; a conversation's text is its pieces put together.

    With ``add_generation_prompt`` every user turn also gets the open assistant
    header that a model would continue.
    """
    piece = turn_text(role_of(F.col("speaker")), F.col("value"))
    out = messages.select("conv_id", "j", "speaker", piece.alias("piece"))
    if add_generation_prompt:
        header = F.when(F.col("speaker") == "human", F.lit(OPEN + "assistant\n")).otherwise(F.lit(""))
        out = out.withColumn("generation_header", header)
    return out


def contexts(messages: DataFrame) -> DataFrame:
    """The prompt of each user turn in linear space.

    The prompt for turn j is the first ``prompt_chars`` characters of the rendered
    conversation: everything said before (``context_chars`` characters in
    ``context_turns`` turns), then this question. Writing every prompt out would
    repeat the history once per turn; ``contexts_nested`` does so for nested rows.
    """
    pieces = render(messages).withColumn("_len", F.length("piece").cast("bigint"))
    at = running_sums(
        pieces,
        ["conv_id"],
        ["j"],
        {"context_chars": F.col("_len"), "context_turns": F.lit(1).cast("bigint")},
    )
    return at.filter("speaker = 'human'").select(
        "conv_id",
        "j",
        F.col("piece").alias("question"),
        "context_turns",
        "context_chars",
        (F.col("context_chars") + F.col("_len")).alias("prompt_chars"),
    )
