"""Conversations as one formatted text each, with a loss mask, by relational formatting.

Turns are collected as structs and sorted, adjacent turns of one role are merged into a block by
aggregating slices of that array, and blocks are concatenated; all of it in Spark expressions. A
template marks where blocks and turns begin and end. What looks like a mark inside a text is escaped
by one more backslash behind its first character, so `<s>` becomes `<\\s>` and `<\\s>` becomes
`<\\\\s>`: what is read back is what was said. The loss mask names the assistant's texts, without marks.

Defined cases: null text counts as empty, a null role as "". Turns are ordered by turn (null first),
then role, then text, so ties and repeated rows have one order; repeated rows are turns of their own.
Rows with a null conv_id are one conversation. Any role may occur. An empty table gives an empty
table. Other columns are ignored, whatever their names. A conversation is one value of the result, so
its turns meet in one task: what bounds a conversation is the size of a string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turns whose lengths are added up one by one; sums of such runs are added up once more.
RUN = 256


@dataclass(frozen=True)
class Template:
    """Marks of a formatted conversation: begin, then for each block role_open role role_close turn (between turn)* end."""

    begin: str = "<s>"
    role_open: str = "[INST]"
    role_close: str = "[/INST]"
    between: str = "[TURN]"
    end: str = "</s>"
    loss_role: str = "assistant"

    def __post_init__(self) -> None:
        firsts = {m[:1] for m in self.marks}
        if any(len(m) < 2 or "\\" in m or firsts & set(m[1:]) for m in self.marks):
            raise ValueError("a mark has two characters at least, no backslash, and its first character begins marks only")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.begin, self.role_open, self.role_close, self.between, self.end)

    def inside(self) -> tuple[str, str]:
        """Patterns of the first character of a mark, and of the rest of one."""
        firsts, rests = (list(dict.fromkeys(part(m) for m in self.marks)) for part in (lambda m: m[0], lambda m: m[1:]))
        return f"(?:{'|'.join(map(re.escape, firsts))})", f"(?:{'|'.join(map(re.escape, rests))})"

    def escape(self, text: Column) -> Column:
        first, rest = self.inside()
        return F.regexp_replace(text, rf"({first}\\*)({rest})", r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        first, rest = self.inside()
        return F.regexp_replace(text, rf"({first})\\(\\*{rest})", "$1$2")


def _sum(costs: Column) -> Column:
    return F.aggregate(costs, F.lit(0), lambda a, x: a + x["lead"] + x["size"])


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (start and length, in characters of `formatted`, of each assistant text).

    One shuffle, by conv_id. Work is linear in a conversation's text; places of texts come from sums of runs of turns.
    """
    t, own = template, ("conv_id", "turn", "role", "text")
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(*[F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c) if c in ("role", "text") else conversations[c].alias(c) for c in own[1:]]).alias("turn"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("said"))
    turns = turns.select("conv_id", F.transform("said", lambda x: F.struct(x["role"].alias("raw"), t.escape(x["role"]).alias("role"), t.escape(x["text"]).alias("text"))).alias("said"))

    said = F.col("said")
    opens = lambda i: (i == 0) | (F.get(said, i)["raw"] != F.get(said, i - 1)["raw"])
    firsts = F.filter(F.sequence(F.lit(0), F.size(said) - 1), opens)
    header = lambda role: F.concat(F.lit(t.role_open), role, F.lit(t.role_close))
    lead = lambda x, i: F.when(opens(i), F.length(header(x["role"])) + F.when(i == 0, len(t.begin)).otherwise(len(t.end))).otherwise(len(t.between))
    costs = F.transform(said, lambda x, i: F.struct((x["raw"] == t.loss_role).alias("loss"), lead(x, i).cast("int").alias("lead"), F.length(x["text"]).alias("size")))
    turns = turns.select("conv_id", "said", firsts.alias("firsts"), costs.alias("costs"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("costs") - 1) / RUN).cast("int")), lambda k: _sum(F.slice(F.col("costs"), k * RUN + 1, F.lit(RUN))))

    def block(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get(F.col("firsts"), k + 1), F.size(said))
        body = F.array_join(F.transform(F.slice(said, first + 1, after - first), lambda x: x["text"]), t.between)
        return F.concat(header(F.get(said, first)["role"]), body, F.lit(t.end))

    def place(x: Column, i: Column, sums: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        before = F.aggregate(F.slice(sums, F.lit(1), run), F.lit(0), lambda a, s: a + s) + _sum(F.slice(F.col("costs"), run * RUN + 1, i % RUN))
        return F.when(x["loss"], F.struct((before + x["lead"]).alias("start"), x["size"].alias("length")))

    # A variable of its own keeps the sums of runs from being made again for each turn.
    places = F.transform(F.array(runs), lambda sums: F.transform("costs", lambda x, i: place(x, i, sums)))[0]
    return turns.select(
        "conv_id",
        F.concat(F.lit(t.begin), F.array_join(F.transform("firsts", block), "")).alias("formatted"),
        F.filter(places, lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, turns (role and text of each, unescaped) and learned (the texts under the loss mask, unescaped), read from formatted texts."""
    t = template
    cut_at = lambda c, mark: F.split(c, rf"\Q{mark}\E", -1)
    blocks = cut_at(F.substring("formatted", len(t.begin) + 1, 2**31 - 1), t.end)

    def spoken(b: Column) -> Column:
        head = F.substring_index(b, t.role_close, 1)
        body = F.substring(b, F.length(head) + len(t.role_close) + 1, F.lit(2**31 - 1))
        role = t.unescape(F.substring(head, F.lit(len(t.role_open) + 1), F.lit(2**31 - 1)))
        return F.transform(cut_at(body, t.between), lambda x: F.struct(role.alias("role"), t.unescape(x).alias("text")))

    return formatted.select(
        "conv_id", "formatted",
        F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), spoken)).alias("turns"),
        F.transform("loss", lambda s: t.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("learned"),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are marks."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What a reader finds in formatted conversations: turns and learned text by their counts and SHA-256."""
    read = read_back(formatted.select("conv_id", "formatted", "loss"), template).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.array_join("learned", "").alias("_learned"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("_learned").cast("long").alias("loss_chars"), F.sha2("_learned", 256).alias("loss_sha256"), "formatted_chars")


#: With the default template: an opening mark has 3 characters, role marks 13, an end mark 4, a mark between turns 6.
SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens,
    length(regexp_replace(text, '([<\[]\\*)(s>|INST\]|/INST\]|TURN\]|/s>)', '\1\\\2', 'g')) AS chars,
    length(regexp_replace(role, '([<\[]\\*)(s>|INST\]|/INST\]|TURN\]|/s>)', '\1\\\2', 'g')) AS role_chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + CASE WHEN opens THEN 13 + role_chars + 4 ELSE 6 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
