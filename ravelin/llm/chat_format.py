"""Chat formatting with DataFrame functions only.

A finite-state machine over the roles validates the turn order; a declarative template says which strings open
and close a turn and which segments carry loss. Every control string starts with the template's sigil, and the
sigil never survives inside a role or a text, so the output can be read back without doubt.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import table


@dataclass(frozen=True)
class Template:
    """``open`` role ``middle`` text ``close`` for each turn; all three start with ``sigil``.

    ``trained``: roles whose text segments carry loss. ``moves``: state and role to the next state; what is not
    listed leads to the state ``bad``. A conversation is valid if it ends in one of ``final``.
    """

    sigil: str = "<|"
    open: str = "<|turn|>"
    middle: str = "<|text|>"
    close: str = "<|end|>"
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    def __post_init__(self):
        if len(self.escape) != 1 or self.escape in self.open + self.middle + self.close:
            raise ValueError("the escape is one character that no control string holds")
        for mark in (self.open, self.middle, self.close):
            if not mark.startswith(self.sigil) or self.sigil in mark[1:]:
                raise ValueError(f"{mark!r} does not start with the sigil, or holds it twice")

    def escaped(self, text: Column) -> Column:
        own = F.replace(text, F.lit(self.escape), F.lit(self.escape + "b"))
        return F.replace(own, F.lit(self.sigil), F.lit(self.escape + "s"))

    def unescaped(self, text: Column) -> Column:
        own = F.replace(text, F.lit(self.escape + "s"), F.lit(self.sigil))
        return F.replace(own, F.lit(self.escape + "b"), F.lit(self.escape))


def ends_in(roles: Column, template: Template) -> Column:
    """The state in which the machine ends after these roles."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(roles, F.lit(template.start), lambda state, role: F.coalesce(F.element_at(moves, F.concat_ws("\n", state, role)), F.lit("bad")))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text): conv_id, n_turns, valid, segments, formatted, loss_spans.

    ``segments`` holds kind, text (as it stands in the output) and its loss flag; ``loss_spans`` holds 1-based
    start and length, in code points, of the output under the loss mask. A null role or text counts as empty.
    Turns stand by turn (null first), then role, then text, so ties and repeated rows have one order and each
    row stays a turn. Rows with a null conv_id form one conversation. Other columns are ignored. One shuffle by
    conv_id; a task holds one conversation at a time, which is the row that it returns, however long its texts or many
    its turns. An empty table stays empty.
    """
    t = template or Template()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def parts(x: Column) -> Column:
        trained = x["role"].isin(*t.trained)
        piece = lambda kind, text, loss: F.struct(F.lit(kind).alias("kind"), text.alias("text"), loss.alias("loss"))
        return F.array(
            piece("header", F.concat(F.lit(t.open), t.escaped(x["role"]), F.lit(t.middle)), F.lit(False)),
            piece("text", t.escaped(x["text"]), trained),
            piece("close", F.lit(t.close), F.lit(False)),
        )

    chats = chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        ends_in(F.col("turns.role"), t).isin(*t.final).alias("valid"),
        F.flatten(F.transform("turns", parts)).alias("segments"),
    )
    nothing = "cast(array() AS array<struct<start:long,length:long>>)"
    spans = F.expr(f"""aggregate(segments, struct(1L AS at, {nothing} AS spans), (s, x) -> struct(
        s.at + length(x.text) AS at,
        if(x.loss AND length(x.text) > 0, concat(s.spans, array(struct(s.at AS start, cast(length(x.text) AS long) AS length))), s.spans) AS spans)).spans""")
    return chats.select("*", F.array_join("segments.text", "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: an array of role and text, unescaped."""
    t = template or Template()
    quoted = lambda s: "\\Q" + s + "\\E"
    split = F.split(formatted, quoted(t.open))
    pieces = F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0)))
    return F.transform(
        pieces,
        lambda p: F.struct(
            t.unescaped(F.substring_index(p, t.middle, 1)).alias("role"),
            t.unescaped(F.substring_index(F.substring_index(p, t.middle, -1), t.close, 1)).alias("text"),
        ),
    )


def under_mask(formatted: Column, spans: Column, template: Template | None = None) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    t = template or Template()
    return F.transform(spans, lambda s: t.unescaped(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int"))))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from every formatted conversation, and of conversation -7."""
    added = spark.sql(r"""SELECT * FROM VALUES (-7L, 0L, 'user', r'\### Assistant: </turn> ok'),
        (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    template = Template(sigil="</", open="</turn>### ", middle="</role>", close="</end>\n")
    chats = format_chats(turns, template)
    read = chats.select("conv_id", "formatted", "valid", read_back(F.col("formatted"), template).alias("turns"), F.array_join(under_mask(F.col("formatted"), F.col("loss_spans"), template), "").alias("loss"))
    nl = F.lit("\n")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], nl, x["text"], nl)), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: A turn has 25 code points of control strings (11, 7 and 7); escaping adds one to each backslash, none to each "</".
OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
s AS (
  SELECT r.*, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY k), '^') AS before FROM r),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(25 + length(role) + length(text)
        + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))) AS chars,
    bool_and((before = '^' AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user')
             OR (before = 'user' AND role = 'assistant')) AND max_by(role, k) = 'assistant' AS valid
  FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, valid
FROM c
"""
