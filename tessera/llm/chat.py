"""Operator 4, chat formatting: DataFrame functions only.

A declarative template gives the marks of each role. A finite-state machine over the
roles checks the order of turns. The output is text segments with a loss flag each;
their concatenation is the formatted conversation. Texts are escaped: where a text has
a control string, one more backslash goes behind its first character, so no control
string stands in an escaped text, and taking one backslash out gives the text back.

Defined results: a null text or role counts as empty; turns with equal numbers are
ordered by role, then text, and null turns come first; repeated rows are turns of
their own; conversations in an order that the machine doesn't know are formatted as
well, with valid = false. A null conv_id is a conversation. The rows of one
conversation come together in one task, for a conversation is one output text; what
they hold otherwise never meets. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read

#: Role: what opens and closes its turn, and whether its text is under the loss mask.
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Any other role stands, escaped, between the first two of these; its text follows up to the third.
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: State, role and next state; all else leads to "bad", which stays.
MOVES = (("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"), ("user", "assistant", "assistant"), ("assistant", "user", "user"))
FINAL = ("assistant",)

#: A control string, cut behind its first character, with the backslashes that escape it.
_CUT = r"(<|\[)(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|TEXT\])"
_ESCAPED = r"(<|\[)\\(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|TEXT\])"
#: A turn in the formatted text.
_TURN = r"(?s)(<<SYS>>|\[INST\]|<s>|\[ROLE\])(.*?)(<</SYS>>|\[/INST\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CUT), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def _by_role(role: Column, known: dict, other: Column) -> Column:
    out = other
    for name, value in known.items():
        out = F.when(role == name, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def _segments(turn: Column) -> Column:
    """Mark, text and mark of a turn."""
    role = turn["role"]
    before = _by_role(role, {k: v[0] for k, v in TEMPLATE.items()}, F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])))
    after = _by_role(role, {k: v[1] for k, v in TEMPLATE.items()}, F.lit(OTHER[2]))
    loss = _by_role(role, {k: F.lit(v[2]) for k, v in TEMPLATE.items()}, F.lit(False))

    def segment(text: Column, flag: Column) -> Column:
        return F.struct(text.alias("text"), flag.alias("loss"))

    return F.array(segment(before, F.lit(False)), segment(escape(turn["text"]), loss), segment(after, F.lit(False)))


def _next(state: Column, role: Column) -> Column:
    out = F.lit("bad")
    for a, r, b in MOVES:
        out = F.when((state == a) & (role == r), F.lit(b)).otherwise(out)
    return out


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, valid, segments (text and loss) and formatted, a row per conversation."""
    rows = df.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).alias("row"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    state = F.aggregate("turns", F.lit("start"), lambda s, t: _next(s, t["role"]))
    return (
        turns.withColumn("segments", F.flatten(F.transform("turns", _segments)))
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*FINAL).alias("valid"), "segments")
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_chats(df: DataFrame) -> DataFrame:
    """From format_chats(): conv_id, n_turns, valid, formatted, turns (role and text) and loss_text, read back from the output."""

    def turn(found: Column) -> Column:
        # Escaped texts hold no marks, so the first mark opens the turn and the last one closes it.
        def between(a: str, b: str) -> Column:
            return F.substring(found, F.lit(len(a) + 1), F.length(found) - len(a) - len(b))

        known = {k: F.struct(F.lit(k).alias("role"), unescape(between(*v[:2])).alias("text")) for k, v in TEMPLATE.items()}
        body = between(OTHER[0], OTHER[2])
        out = F.struct(unescape(F.substring_index(body, OTHER[1], 1)).alias("role"), unescape(F.substring(body, F.instr(body, OTHER[1]) + len(OTHER[1]), F.length(body))).alias("text"))
        for k, v in TEMPLATE.items():
            out = F.when(F.startswith(found, F.lit(v[0])), known[k]).otherwise(out)
        return out

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return df.select("conv_id", "n_turns", "valid", "formatted", F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0)), turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and conversation -7, whose texts look like marks."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)


def _hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_chats(format_chats(conversations(spark, sf_dir)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _hex(told).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        _hex(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def sql() -> str:
    marks = " ".join(f"WHEN '{k}' THEN {len(v[0]) + len(v[1])}" for k, v in TEMPLATE.items())
    cut = _CUT.replace("'", "''")
    esc = f"length(regexp_replace(text, '{cut}', '\\1\\\\\\2\\3', 'g'))"
    role = f"length(regexp_replace(role, '{cut}', '\\1\\\\\\2\\3', 'g'))"
    moves = " ".join(f"WHEN coalesce(before, 'start') = '{a}' AND role = '{r}' THEN true" for a, r, _ in MOVES)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum({esc} + CASE role {marks} ELSE {sum(map(len, OTHER))} + {role} END) AS BIGINT) AS formatted_chars,
       bool_and(CASE {moves} ELSE false END) AND bool_or(last AND role = 'assistant') AS valid
FROM ordered GROUP BY conv_id"""
