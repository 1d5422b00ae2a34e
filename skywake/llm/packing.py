"""Packing by vector bin packing with the dot-product heuristic.

An example asks for tokens, one segment, and loss-bearing tokens (those from ``loss_from`` on). A sequence has room for so
many of each. It takes, again and again, the example that fits and whose demand has the largest dot product with the room
left, both as shares of the limits. Where none fits, the largest one is cut to fill the room. A sequence that can't be filled
(at the end of a task's rows, or at the segment limit) keeps the largest power of two of its tokens, which needs no padding,
and gives the rest back.

Every task packs its own rows, in bounded buffers, so nothing is shuffled and only the sequences at the end of a task are
short. A sequence's id is that of its task and its number there; files are read in the same way again if a task is lost.

Null texts count as empty. Empty texts have the end id alone. Rows that repeat are packed each for itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.llm.common import slices, table

if TYPE_CHECKING:
    from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
TOKENS, SEGMENTS = 4_096, 256
#: Examples that wait for a place: filled up to the first number, packed down to the second.
BUFFER = (1_024, 512)
#: Characters of the texts that are encoded together.
CHARACTERS = 1 << 20
#: New words after which the older ones are forgotten.
WORDS = 500_000

PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, n_loss long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                   ("n_loss", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


@cache
def tokenizer(path: str) -> Tokenizer:
    from tokenizers import Tokenizer  # in the tasks alone, the driver has no use for it

    held = Tokenizer.from_file(path)
    held.encode_special_tokens = True
    return held


class WordIds:
    """Ids of texts. A word between blanks is tokenised once, as no token spans a blank and blanks have no tokens.

    The tokenizer lowers case letter by letter, so A-Z can be lowered before; a comma or full stop behind ASCII letters is a token
    of its own (behind others it need not be: some are turned into a letter and a mark, which joins the stop). Words met lately are
    remembered: those of the last `WORDS` new ones and, until as many more came, those before.
    """

    MARK = "\x01"

    def __init__(self, path: str, end_id: int):
        self.tokens, self.known, self.before = tokenizer(path), {}, {}
        self.end = self.bytes_of([end_id])
        vocabulary = self.tokens.get_vocab()
        self.ends, self.marks = np.zeros((2, max(vocabulary.values()) + 1), bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks[self.tokens.encode(self.MARK, add_special_tokens=False).ids[0]] = True
        self.stops = {c: self.bytes_of(self.tokens.encode(c, add_special_tokens=False).ids) for c in ",."}

    @staticmethod
    def bytes_of(ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def cut(self, text: str, ends: np.ndarray, behind: int) -> list[bytes]:
        """The ids of `text` up to, and with `behind` not with, each id that `ends` marks."""
        ids = np.asarray(self.tokens.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(ends[ids]) * 4).tolist()
        held = ids.tobytes()
        return [held[i : k + 4 - behind] for i, k in zip([0, *(c + 4 for c in cuts)], cuts, strict=False)]

    def tokenise(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word, from one text of them all.

        A word of Latin-1 letters alone is one pre-token, whose last id is an end of a word; behind others stands a mark with an id of its own.
        """
        latin = [w for w in words if w.isalpha() and max(w) <= "ÿ"]
        rest = set(words).difference(latin)
        other = [w for w in rest if self.MARK not in w]
        found = dict(zip(latin, self.cut(" ".join(latin), self.ends, 0), strict=True))
        found.update(zip(other, self.cut("".join(f"{w} {self.MARK} " for w in other), self.marks, 4), strict=True))
        found.update((w, self.bytes_of(self.tokens.encode(w, add_special_tokens=False).ids)) for w in rest.difference(other))
        return found

    def learn(self, new: set[str]) -> None:
        known, before = self.known, self.before
        again = {w for w in new if w in before}
        known.update((w, before[w]) for w in again)
        new -= again
        stopped = [w for w in new if w[-1:] in self.stops and w.isascii() and w[:-1].isalpha()]
        bare = (new.difference(stopped) | {w[:-1] for w in stopped}).difference(known)
        asked = list(bare)
        for start in range(0, len(asked), 1 << 16):
            known.update(self.tokenise(asked[start : start + (1 << 16)]))
        known.update((w, known[w[:-1]] + self.stops[w[-1]]) for w in stopped)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            words = (text or "").encode().lower().decode().replace("\n", " ").split(" ")
            parts = []
            for start in range(0, len(words), WORDS):
                block = words[start : start + WORDS]
                if len(self.known) > WORDS:
                    self.known, self.before = {}, self.known
                new = set(block).difference(self.known)
                if new:
                    self.learn(new)
                parts.append(b"".join(map(self.known.__getitem__, block)))
            out.append(b"".join(parts) + self.end)
        return out


@cache
def word_ids(path: str, end_id: int) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path, end_id)


class Item(NamedTuple):
    key: int | None
    ids: bytes
    base: int
    start: int
    stop: int
    loss_from: int
    total: int

    def held(self) -> bytes:
        return self.ids[4 * (self.start - self.base) : 4 * (self.stop - self.base)]


class Packer:
    """Bins for one task's examples.

    An item is a stretch of an example, from `start` to `stop`. It holds the ids of that stretch from `base` on, and no others:
    what waits for a place is bounded by the number of items and the token limit, however long the examples are.
    """

    def __init__(self, tokens: int, segments: int, loss: int):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits are positive")
        self.limits, self.items, self.done, self.sequence = (tokens, segments, loss), [], [], 0

    @staticmethod
    def loss(item: Item, end: int | None = None) -> int:
        return max(0, (item.stop if end is None else end) - max(item.start, item.loss_from))

    def cut(self, item: Item, tokens: int, loss: int) -> int:
        """The end of the longest beginning of `item` within `tokens` and `loss`."""
        return min(item.stop, item.start + tokens, max(item.start, item.loss_from) + loss)

    def close(self, held: list[Item]) -> None:
        offset = 0
        for item in held:
            self.done.append((item, self.sequence, offset))
            offset += item.stop - item.start
        self.sequence += 1

    def add(self, key, ids: bytes, loss_from: int = 0) -> None:
        total, start = len(ids) // 4, 0
        waits = False
        while start < total:
            whole = Item(key, ids, 0, start, total, loss_from, total)
            end = self.cut(whole, self.limits[0], self.limits[2])
            item = Item(key, ids[4 * start : 4 * end], start, start, end, loss_from, total)
            waits = waits or end - start < self.limits[0]
            if waits:  # what is left in parts that fit an empty sequence
                self.items.append(item)
            else:  # a whole sequence
                self.close([item])
            start = end

    def pack(self, until: int) -> None:
        """Fill sequences until at most `until` examples wait."""
        if len(self.items) <= until:
            return
        most = np.array(self.limits, float)
        need = np.array([(i.stop - i.start, 1, self.loss(i)) for i in self.items], float).reshape(-1, 3)
        free = np.ones(len(self.items), bool)
        left = len(self.items)
        while left > until:
            room, held = most.copy(), []
            while room[0] >= 1 and room[1] >= 1:
                fits = free & (need <= room).all(axis=1)
                if fits.any():
                    best = int(np.argmax(np.where(fits, (need / most) @ (room / most), -1)))
                    held.append(self.items[best])
                    room -= need[best]
                    free[best], left = False, left - 1
                    continue
                best = int(np.argmax(np.where(free, need[:, 0], -1))) if left else 0
                end = self.cut(self.items[best], int(room[0]), int(room[2])) if left else 0
                if not left or end <= self.items[best].start:
                    break
                head = self.items[best]._replace(stop=end)
                self.items[best] = self.items[best]._replace(start=end)
                held.append(head)
                room -= (end - head.start, 1, self.loss(head))
                need[best] = (self.items[best].stop - end, 1, self.loss(self.items[best]))
            total = sum(i.stop - i.start for i in held)
            if total < self.limits[0] and total & (total - 1):
                rest = total - (1 << total.bit_length() - 1)
                back = []
                while rest:
                    item = held.pop()
                    size = min(rest, item.stop - item.start)
                    if item.stop - item.start > size:
                        held.append(item._replace(stop=item.stop - size))
                    back.append(item._replace(start=item.stop - size))
                    rest -= size
                self.items += back
                need = np.vstack([need, [(i.stop - i.start, 1, self.loss(i)) for i in back]])
                free = np.append(free, np.ones(len(back), bool))
                left += len(back)
            self.close(held)
        self.items = [item for item, f in zip(self.items, free, strict=True) if f]

    def rows(self, task: int) -> Iterator[pa.RecordBatch]:
        """The pieces placed since the last call."""
        for at in range(0, len(self.done), 1_024):
            part = self.done[at : at + 1_024]
            columns = list(zip(*((i.key, i.start, i.stop - i.start, i.held(), i.total, self.loss(i), (task << 33) + s, o) for i, s, o in part), strict=True))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)
        self.done = []


def portions(texts: list[str | None]) -> Iterator[slice]:
    """Neighbouring texts of about `CHARACTERS` at most together, or a longer one alone."""
    start = held = 0
    for place, text in enumerate(texts):
        size = len(text or "")
        if place > start and held + size > CHARACTERS:
            yield slice(start, place)
            start, held = place, 0
        held += size
    if texts:
        yield slice(start, len(texts))


def pack(
    examples: DataFrame,
    tokens: int = TOKENS,
    segments: int = SEGMENTS,
    loss: int = TOKENS,
    encoder: Callable[[], Callable[[list[str | None]], list[bytes]]] | None = None,
) -> DataFrame:
    """Pieces of the examples and their places.

    `examples` has doc_id, text, and may have loss_from, the number of an example's ids that bear no loss (null: none).
    `ids` is a piece's ids as little-endian unsigned 32-bit integers, `start` its place in the example, `offset` that in the sequence.
    """
    make = encoder or (lambda: word_ids(VOCABULARY, END_ID))
    prompt = F.col("loss_from").cast("long") if "loss_from" in examples.columns else F.lit(None).cast("long")
    chosen = examples.select("doc_id", "text", F.greatest(F.lit(0), F.coalesce(prompt, F.lit(0))).alias("loss_from"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, packer = TaskContext.get().partitionId(), make(), Packer(tokens, segments, loss)
        for part in slices(batches):
            for rows in portions(part["text"]):
                for key, ids, start in zip(part["doc_id"][rows], encode(part["text"][rows]), part["loss_from"][rows], strict=True):
                    packer.add(key, ids, start)
                if len(packer.items) >= BUFFER[0]:
                    packer.pack(BUFFER[1])
                yield from packer.rows(task)
        packer.pack(0)
        yield from packer.rows(task)

    return chosen.mapInArrow(run, PACKED)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens."""
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "n_loss")
