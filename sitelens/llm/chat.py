"""Chat formatting at token level.

One conversation becomes, turn after turn::

    <turn> role <says> text </turn>

The three marks are reserved ids after the vocabulary; role and text are encoded
separately as ordinary text, so no content can yield a mark.  In the rendered
string the marks could also occur in a content, so contents are escaped: a
backslash is doubled, and a mark gets a backslash after its "<".  Dropping one
backslash wherever one stands restores the content.

The loss mask is the running sum of +1 after an assistant's <says> and -1 at its
</turn>.  The formatted table has one row per turn (conv_id, position, ids, mask
and the token offset within the conversation), so a conversation of any length
is never held as one row; encoding runs on evenly dealt rows before any shuffle.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import stored, text_or_empty
from sitelens.llm.wordbpe import text_groups, word_encoder

TURN, SAYS, CLOSE = "<turn>", "<says>", "</turn>"
_MARK = re.compile(r"<(turn>|says>|/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_chats(turns: DataFrame, tokenizer: str, vocabulary: int = 50_257) -> DataFrame:
    """Rows (conv_id, turn, role, text) to rows (conv_id, pos, offset, ids, mask).

    Null role or text: empty.  Turns are ordered by turn (nulls first), equal ones
    by role and text; repeated rows stay separate turns.  Null conv_id is a
    conversation of its own.
    """
    says, close = vocabulary + 1, vocabulary + 2
    rows = turns.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))

    def task(batches):
        enc = word_encoder(tokenizer, plain_specials=True)
        for batch in batches:
            ids, masks = [], []
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for a, b in text_groups(texts):
                names = enc.encode([escape(r) for r in roles[a:b]])
                bodies = enc.encode([escape(t) for t in texts[a:b]])
                for role, name, body in zip(roles[a:b], names, bodies):
                    one = np.concatenate([[vocabulary], name, [says], body, [close]]).astype(np.int32)
                    step = np.zeros(len(one) + 1, np.int32)
                    if role == ASSISTANT:
                        step[len(name) + 2] += 1
                        step[len(one) - 1] -= 1
                    ids.append(one)
                    masks.append(np.cumsum(step[:-1]).astype(bool))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(i) for i in ids], pa.int64()),
                 pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))],
                [*batch.schema.names, "n", "ids", "mask"])

    kinds = dict(turns.dtypes)
    encoded = rows.mapInArrow(task, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, "
                                    "n long, ids array<int>, mask array<boolean>")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return encoded.select(
        "conv_id", (F.row_number().over(order) - 1).alias("pos"),
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        "ids", "mask")


def read_chats(formatted: DataFrame, tokenizer: str, vocabulary: int = 50_257) -> DataFrame:
    """Parse formatted rows back: one digest row per conversation.

    Streams rows sorted by conversation and position; hashes are updated turn by
    turn, so memory does not grow with a conversation.
    """
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, n_tokens long, loss_tokens long")
    rows = formatted.select("conv_id", "pos", "ids", "mask").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "pos")
    says, close = vocabulary + 1, vocabulary + 2
    marks = len(TURN) + len(SAYS) + len(CLOSE)

    def task(batches):
        lib = word_encoder(tokenizer, plain_specials=True).lib

        class Open:
            def __init__(self, conv):
                self.conv, self.all, self.loss = conv, hashlib.sha256(), hashlib.sha256()
                self.n = self.chars = self.shown = self.tokens = self.loss_tokens = 0

        def row(o):
            return {"conv_id": o.conv, "n_turns": o.n, "turns_sha256": o.all.hexdigest(), "loss_chars": o.chars,
                    "loss_sha256": o.loss.hexdigest(), "formatted_chars": o.shown, "n_tokens": o.tokens,
                    "loss_tokens": o.loss_tokens}

        fields = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in (
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens",
            "loss_tokens")])
        now = None
        for batch in batches:
            out = []
            convs, ids = batch.column("conv_id").to_pylist(), batch.column("ids").to_pylist()
            parts = []
            for one, mask in zip(ids, batch.column("mask").to_pylist()):
                mid = one.index(says)
                if one[0] != vocabulary or one[-1] != close:
                    raise ValueError("a formatted turn lacks its marks")
                parts += [one[1:mid], one[mid + 1:-1], [i for i, m in zip(one, mask) if m]]
            texts = lib.decode_batch(parts, skip_special_tokens=False)
            for i, conv in enumerate(convs):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(row(now))
                    now = Open(conv)
                role, text, loss = texts[3 * i:3 * i + 3]
                now.n += 1
                now.shown += marks + len(role) + len(text)
                now.tokens += len(ids[i])
                now.loss_tokens += len(parts[3 * i + 2])
                now.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                loss = unescape(loss)
                now.chars += len(loss)
                now.loss.update(loss.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)
        if now is not None:
            yield pa.RecordBatch.from_pylist([row(now)], fields)

    return rows.mapInArrow(task, schema)


def chat_digests(turns: DataFrame, tokenizer: str, vocabulary: int = 50_257) -> DataFrame:
    """Format, write the formatted table to the shared folder, and read it back."""
    return read_chats(stored(format_chats(turns, tokenizer, vocabulary), "chats"), tokenizer, vocabulary)
