"""Packing of examples into training sequences (operator 4).

Vector bin packing: an example is a demand vector (tokens, one segment, loss-bearing tokens), a sequence a
vector of what is left of three limits. The open sequence takes the waiting example whose demand has the
largest dot product with what is left, both as shares of the limits, among those that fit. When none fits,
the longest waiting example is cut to fill the rest. Every task packs the examples it reads, from a window
of bounded size, so nothing is shuffled and no group of examples has to come together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.bpe import encode, load, tokenizer_broadcast
from procurelake.llm.shared import quoted, slices, text_or_empty

#: Pieces that wait in a task while a sequence is filled.
WINDOW = 768
PIECE = "start long, length long, loss_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Packs one task's examples. ``feed`` and ``finish`` yield rows (example, start, length, loss, sequence, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int, window: int = WINDOW):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits are at least 1")
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.window = window
        # waiting pieces in the order they came: example, start, length, prompt tokens of the example (its first tokens, which bear no loss), loss tokens
        self.wait = np.zeros((5, 2 * window), np.int64)
        self.n = 0
        self.sequence = 0
        self.open: list[tuple[int, int, int, int]] = []
        self.left = self.limits.copy()

    @staticmethod
    def loss_of(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    def feed(self, example: int, length: int, prompt: int):
        """Full sequences are cut off a long example at once; the rest waits."""
        start = 0
        whole = int(self.limits[0])
        while length - start > whole or self.loss_of(start, length - start, prompt) > self.limits[2]:
            # as many tokens as both limits allow from here
            take = min(whole, max(prompt - start, 0) + int(self.limits[2]), length - start)
            if take == whole:
                yield self.row(example, start, take, prompt, self.next_sequence(), 0)
            else:
                self.push(example, start, take, prompt)
            start += take
        if start < length:
            self.push(example, start, length - start, prompt)
        while self.n > self.window:
            yield from self.step()

    def push(self, example: int, start: int, length: int, prompt: int) -> None:
        if self.n == self.wait.shape[1]:
            self.wait = np.concatenate([self.wait, np.zeros_like(self.wait)], 1)
        self.wait[:, self.n] = example, start, length, prompt, self.loss_of(start, length, prompt)
        self.n += 1

    def next_sequence(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def row(self, example: int, start: int, length: int, prompt: int, sequence: int, offset: int) -> tuple:
        return example, start, length, self.loss_of(start, length, prompt), sequence, offset

    def step(self):
        """Place one piece in the open sequence, or close it."""
        if self.left[0] < 1 or self.left[1] < 1 or not self.n:
            yield from self.close()
            return
        length, loss = self.wait[2, : self.n], self.wait[4, : self.n]
        tokens, segments, loss_left = self.left.tolist()
        fits = (length <= tokens) & (loss <= loss_left)
        if segments > 1 or not (length > tokens).any():
            # the segment's own share is the same for all, so it moves no choice
            share = self.left / self.limits / self.limits
            gain = (length * share[0] + loss * share[2] + 1.0) * fits
            at = int(gain.argmax())
            if gain[at] > 0:
                self.take(at, int(length[at]))
                return
        # nothing fits whole, or this is the last segment: cut the piece that can give most
        wait = self.wait[:, : self.n]
        room = np.minimum(np.minimum(length, tokens), np.maximum(wait[3] - wait[1], 0) + loss_left)
        at = int(room.argmax())
        if room[at] < 1:
            yield from self.close()
            return
        self.take(at, int(room[at]))

    def take(self, at: int, length: int) -> None:
        example, start, whole, prompt, _ = self.wait[:, at].tolist()
        self.open.append((example, start, length, prompt))
        self.left -= (length, 1, self.loss_of(start, length, prompt))
        if length < whole:
            start, whole = start + length, whole - length
            self.wait[1:, at] = start, whole, prompt, self.loss_of(start, whole, prompt)
        else:
            # the rest moves up, so that ties go to the piece that waits first
            self.wait[:, at : self.n - 1] = self.wait[:, at + 1 : self.n]
            self.n -= 1

    def close(self, powers: bool = False):
        """Emit the open sequence; with ``powers``, as sequences whose lengths are powers of two, which need no padding."""
        pieces, self.open, self.left = self.open, [], self.limits.copy()
        total = sum(p[2] for p in pieces)
        while pieces:
            room = 1 << (total.bit_length() - 1) if powers else total
            total -= room
            sequence, offset, rest = self.next_sequence(), 0, []
            for example, start, length, prompt in pieces:
                take = min(length, room - offset)
                if take:
                    yield self.row(example, start, take, prompt, sequence, offset)
                    offset += take
                if take < length:
                    rest.append((example, start + take, length - take, prompt))
            pieces = rest

    def finish(self):
        """Pack all that waits. The last sequence, if short, is cut at powers of two."""
        while self.n:
            yield from self.step()
        short = self.left[0] >= 1
        yield from self.close(powers=bool(short))


def pack(
    df: DataFrame,
    ids: str = "ids",
    *,
    max_tokens: int = 2048,
    max_segments: int = 128,
    max_loss_tokens: int = 2048,
    prompt: str | None = None,
    end_id: int | None = None,
    tokenizer: str | None = None,
) -> DataFrame:
    """Pack each row's ids (binary, little-endian unsigned 32-bit) into sequences; one output row per piece.

    ``prompt`` names a column with the number of leading tokens that bear no loss (null or absent: 0);
    ``end_id`` is appended to every example. With ``tokenizer``, the column ``ids`` holds whole texts instead,
    which are encoded in the same pass (null text: empty). Output: the other columns of ``df``, example_tokens (with the
    end id), start, length, loss_tokens, sequence_id, offset and the piece's ids. Names that clash with these
    are replaced. An example without ids and end id has no piece; null ids count as none; equal rows are
    packed each on its own; an empty table gives an empty result. Sequence ids are unique in the result and
    the same when a task runs again. Ties go to the piece that waits first. Sequences never exceed a limit;
    a task's last sequence is dealt out over powers of two.
    """
    made = T.StructType([T.StructField("example_tokens", T.LongType())] + T._parse_datatype_string(PIECE).fields)
    outs = {c.lower() for c in (*made.names, ids, prompt or ids)}
    keep = [F.col(quoted(c)) for c in df.columns if c.lower() not in outs]
    n_prompt = F.coalesce(F.col(quoted(prompt)).cast("long"), F.lit(0)) if prompt else F.lit(0).cast("long")
    spec = tokenizer_broadcast(df, tokenizer) if tokenizer else None
    source = text_or_empty(ids) if tokenizer else F.col(quoted(ids))
    sent = df.select(*[c.alias(f"c{i}") for i, c in enumerate([*keep, source, n_prompt])])
    schema, passed = T.StructType([*df.select(*keep).schema.fields, *made.fields]), len(keep)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches):
        packer, task = Packer(max_tokens, max_segments, max_loss_tokens), TaskContext.get()
        bpe = load(spec.value) if spec else None
        first = (task.partitionId() if task else 0) << 36
        held: dict[int, list] = {}  # example -> [batch, row, ids, tokens not yet packed]
        seen = 0

        def rows(placed):
            out = [[] for _ in made.names]
            kept: list[tuple[pa.RecordBatch, int]] = []
            for example, start, length, loss, sequence, offset in placed:
                batch, at, raw, left = held[example]
                kept.append((batch, at))
                for column, value in zip(out, (len(raw) // 4, start, length, loss, first + sequence, offset, raw[4 * start : 4 * (start + length)]), strict=True):
                    column.append(value)
                held[example][3] = left - length
                if left == length:
                    del held[example]
                if len(kept) >= 4096:
                    yield build(kept, out)
                    out, kept = [[] for _ in made.names], []
            if kept:
                yield build(kept, out)

        def build(kept, out):
            columns = []
            for k in range(passed):
                columns.append(pa.array([b.column(k)[i].as_py() for b, i in kept], kept[0][0].column(k).type))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays(columns + [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=schema.names)

        def feed(batch):
            nonlocal seen
            small = batch.select(range(passed))
            values, prompts = batch.column(passed).to_pylist(), batch.column(passed + 1).to_pylist()
            encoded = bpe.encode_texts(values) if bpe else values
            for i, (raw, n) in enumerate(zip(encoded, prompts, strict=True)):
                raw = (raw or b"") + end
                if raw:
                    held[seen] = [small, i, raw, len(raw) // 4]
                    yield from packer.feed(seen, len(raw) // 4, max(0, n))
                    seen += 1

        for batch in batches:
            for part in slices(batch):
                yield from rows(feed(part))
        yield from rows(packer.finish())

    return sent.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Tokenise documents (null text: empty), end each with id 1, and pack them; one row per piece with doc_id, its checksum and place."""
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    packed = pack(docs.select("doc_id", "text"), "text", tokenizer=tokenizer, end_id=1)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset", "loss_tokens"
    )


def instruction_examples(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, ids, prompt_tokens): each answer of ``conversations(conv_id, turn, role, text)`` behind the turn before it, which bears no loss.

    Answers are turns of the role ``assistant``; one that opens a conversation has no prompt. Turns meet by
    conversation and number, so a conversation with a third of all turns is no group of one task; repeated
    turns make an example for each pair. Null texts are empty; rows without a conversation or number have no prompt.
    """
    turns = conversations.select("conv_id", "turn", "role", text_or_empty("text").alias("text"))
    asked = turns.where("role is distinct from 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    both = turns.where("role = 'assistant'").drop("role").join(asked, ["conv_id", "turn"], "left").withColumn("asked", F.coalesce("asked", F.lit("")))
    coded = encode(encode(both, "asked", "prompt_ids", tokenizer=tokenizer, packed=True, drop=["asked"]), "text", "answer_ids", tokenizer=tokenizer, packed=True, drop=["text"])
    return coded.select("conv_id", "turn", F.concat("prompt_ids", "answer_ids").alias("ids"), (F.octet_length("prompt_ids") / 4).cast("long").alias("prompt_tokens"))


def pack_conversations(conversations: DataFrame, tokenizer: str | None = None, *, max_tokens: int = 2048, max_segments: int = 64, max_loss_tokens: int = 1024) -> DataFrame:
    """Pack instruction data under all three limits; one row per piece, with conv_id and turn. An empty table gives an empty result."""
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    examples = instruction_examples(conversations, tokenizer)
    return pack(examples, max_tokens=max_tokens, max_segments=max_segments, max_loss_tokens=max_loss_tokens, prompt="prompt_tokens", end_id=1)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of 2048 tokens; one row per piece."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
