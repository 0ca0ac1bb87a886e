"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only
that reply is trainable.  A conversation that ends with other turns gets one more example that
holds the whole conversation and trains nothing, so that nothing is lost.

Template: ``<|role|>\\n`` text ``<|end|>\\n`` for every turn.  Inside texts each ``<`` or ``[`` that
starts a control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) gets a backslash behind it,
after any backslashes already there; removing one undoes it, so the escape is reversible.  Roles
are percent-coded for ``%``, ``|`` and line ends.

Conversations are dealt by id and read in turn order, so a task holds the formatted text of one
conversation at a time.  The output of this method is by its nature the sum of the prefixes.

Defined results: a null text or role counts as empty; rows are ordered by turn (null first), ties by
role and text; a null conversation id is a conversation of its own; no rows give no examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])(\\*)\\(?=\||/?s>|/?INST\])")
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
_END = "<|end|>\n"
_BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _head(role: str) -> str:
    return "<|" + role.replace("%", "%25").replace("|", "%7C").replace("\n", "%0A") + "|>\n"


def _role(head: str) -> str:
    return head.replace("%0A", "\n").replace("%7C", "|").replace("%25", "%")


_EXAMPLE = "conv_id long, example long, n_turns long, formatted string, loss_start long, loss_end long"


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example: formatted text and the code-point range of it that is trainable.

    Rows of a conversation follow one another, in order, inside one partition.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        state = {"size": 0}

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=[c.split()[0] for c in _EXAMPLE.split(", ")])
            made["conv_id"] = made["conv_id"].astype("Int64")
            out.clear()
            state["size"] = 0
            return made

        conv, text, turns, number, open_turns = None, "", 0, 0, False

        def close() -> None:
            if open_turns:
                out.append((conv, number, turns, text, len(text), len(text)))
                state["size"] += len(text)

        started = False
        for batch in batches:
            ids = batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None)
            for conv_id, role, body in zip(ids, batch["role"], batch["text"]):
                if not started or conv_id != conv:
                    close()
                    conv, text, turns, number, open_turns, started = conv_id, "", 0, 0, False, True
                text += _head(role)
                begin = len(text)
                text += escape(body)
                end = len(text)
                text += _END
                turns += 1
                open_turns = role != "assistant"
                if not open_turns:
                    out.append((conv, number, turns, text, begin, end))
                    state["size"] += len(text)
                    number += 1
                if state["size"] > _BATCH_CHARS:
                    yield frame()
        close()
        if out:
            yield frame()

    return dealt.mapInPandas(run, _EXAMPLE)


_SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its examples say: turns from the longest, losses from all, in order.

    Expects the order that ``examples`` leaves; runs in the same tasks, without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        current: dict | None = None

        def close() -> None:
            sha, n = hashlib.sha256(), 0
            for head, body in _TURN.findall(current["last"]):
                sha.update(f"{_role(head)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                n += 1
            out.append((current["id"], n, sha.hexdigest(), current["loss"], current["sha"].hexdigest(), current["chars"]))

        for batch in batches:
            ids = batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None)
            for conv_id, text, begin, end in zip(ids, batch["formatted"], batch["loss_start"], batch["loss_end"]):
                if current is None or current["id"] != conv_id:
                    if current is not None:
                        close()
                    current = {"id": conv_id, "loss": 0, "sha": hashlib.sha256(), "chars": 0}
                target = unescape(text[begin:end])
                current["last"] = text
                current["loss"] += len(target)
                current["chars"] += len(text)
                current["sha"].update(target.encode("utf-8", "surrogatepass"))
            if len(out) >= 5000:
                yield _summary(out)
                out.clear()
        if current is not None:
            close()
        if out:
            yield _summary(out)

    return formatted.mapInPandas(run, _SUMMARY)


def _summary(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=[c.split()[0] for c in _SUMMARY.split(", ")])
    made["conv_id"] = made["conv_id"].astype("Int64")
    return made


def with_control_conversation(conversations: DataFrame) -> DataFrame:
    """Add conversation -1: two turns whose text is made of control strings."""
    literal = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", literal), (-1, 1, "assistant", literal)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    ).unionByName(extra)


ORACLE = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS turns, sum(
      length('<|' || replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A') || '|>' || chr(10))
      + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\])')) + length('<|end|>' || chr(10))) OVER w AS prefix
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(prefix) FILTER (role = 'assistant' OR nth = turns), 0)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
