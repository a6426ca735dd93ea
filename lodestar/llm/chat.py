"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

The machine reads a conversation's turns in order: an optional system turn, then user and assistant in turn, from user on. It says whether the order is valid and where it first isn't; invalid conversations are formatted all the same, for the caller to drop. Each turn becomes three segments, its role's mark, its text and its end mark; only texts of roles that the template trains on have the loss flag. Control strings inside texts (and the escape sign itself) are escaped, so that marks stand only where the template puts them and texts can be restored.

Rows stream through tasks sorted by conversation and turn, with a constant state, so conversations may have any number of turns; one conversation's turns are digested in order, hence by one task.

Null texts and roles are empty; roles that the template doesn't know get marks that name them (and are invalid). Rows of one turn number follow by role and text; null turns come first; rows without conv_id are one conversation. Repeated rows are turns of their own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Template:
    """Marks around the texts of each role, control strings that texts must not hold, roles under the loss, and the machine's moves."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")})
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    accept: tuple[str, ...] = ("asked", "answered")

    def escape(self, text: str) -> str:
        r"""Control string i becomes \ and the i-th letter, the escape sign \\."""
        if "\\" not in text and "<" not in text and "[" not in text:
            return text
        return re.sub("|".join(map(re.escape, ("\\", *self.control))), lambda m: "\\\\" if m[0] == "\\" else "\\" + chr(97 + self.control.index(m[0])), text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else self.control[ord(m[1]) - 97], text) if "\\" in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [(before, False), (self.escape(text), role in self.trained), (after, False)]

    def read(self, before: str) -> str:
        """The role that a mark stands for."""
        for role, (mark, _) in self.marks.items():
            if mark == before:
                return role
        return self.unescape(before[len(self.other[0]) : -len(self.other[1])])


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conversations (conv_id, turn, role, text) to segments (conv_id, segment, text, loss, invalid_at): invalid_at, in a conversation's last segment, is the first turn that the machine refuses, or the number of turns if it ends too early."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        out: list[tuple] = []
        conv, n, state, invalid = (), 0, template.start, None

        def ended():
            if conv != () and invalid is None and state not in template.accept:
                out[-1] = (*out[-1][:4], n // 3)
            elif conv != ():
                out[-1] = (*out[-1][:4], invalid)

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "segment", "text", "loss", "invalid_at"])

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if (conv_id,) != conv:
                    ended()
                    conv, n, state, invalid = (conv_id,), 0, template.start, None
                if invalid is None and (state := template.moves.get((state, role))) is None:
                    invalid = n // 3
                for s, loss in template.segments(role, text):
                    out.append((conv_id, n, s, loss, None))
                    n += 1
            if len(out) > 1:
                yield batch_of(out[:-1])
                out = out[-1:]
        ended()
        if out:
            yield batch_of(out)

    return _sorted(rows, "turn", "role", "text").mapInArrow(run, "conv_id long, segment long, text string, loss boolean, invalid_at long")


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Of each conversation, from its segments alone: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid)."""

    def run(batches):
        conv, turns, under, n, loss_chars, chars, invalid, role = (), None, None, 0, 0, 0, None, ""
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        for batch in batches:
            out: list[tuple] = []
            for conv_id, segment, text, loss, at in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "text", "loss", "invalid_at")), strict=True):
                if (conv_id,) != conv:
                    if conv != ():
                        out.append((*conv, n, turns.hexdigest(), loss_chars, under.hexdigest(), chars, invalid is None))
                    conv, turns, under, n, loss_chars, chars, invalid = (conv_id,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0, None
                chars += len(text)
                invalid = at if at is not None else invalid
                if loss:
                    plain = template.unescape(text)
                    loss_chars += len(plain)
                    under.update(plain.encode("utf-8"))
                if segment % 3 == 0:
                    role = template.read(text)
                elif segment % 3 == 1:
                    turns.update(f"{role}\n{template.unescape(text)}\n".encode())
                else:
                    n += 1
            if out:
                yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), names)
        if conv != ():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array([v], k) for v, k in zip((*conv, n, turns.hexdigest(), loss_chars, under.hexdigest(), chars, invalid is None), kinds, strict=True)], names)

    return _sorted(segments, "segment").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


#: A conversation whose texts are control strings, beside those of the table.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(common.saved(format_conversations(rows.union(more)), "segments"))


#: Marks of system, user and assistant have 8 + 11, 10 + 8 and 1 + 5 characters; an escaped string has two.
OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 END
      + length(regexp_replace(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role\|>|<\|text\|>|<\|end\|>', '..', 'g'))) AS BIGINT) AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, regexp_full_match(roles, 's?u(au)*a?') AS valid FROM g
"""
