"""Best-fit packing of tokenised documents into sequences of a fixed length.

The plan is made from the histogram of piece lengths, at most ``capacity`` counts, not from documents: lengths are
placed from the longest to the shortest, each into the open sequences with the least room that still fits, many equal
pieces and equal sequences at a time.  A planned run says "pieces of this length with ranks a..b go to sequences s.. at
this offset"; documents take their slots by joining on length and rank.  Ranks come from counts per (length, bucket), so
a length that a third of the pieces share is still numbered in many tasks.

Defined cases: ids are those of the tokenizer as loaded, so an added token's string in a text is that token; null text is empty and is one piece of one token (the end token); documents longer than the capacity are
cut into full pieces, the first piece taking the rest; repeated rows and null ids are packed like any other row; an empty table gives no
rows; only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.tables import keyed, prepare_workers, stored

CAPACITY = 2048
END_TOKEN = 0
# Pieces of one length that are numbered together.
BUCKET_ROWS = 500
# Ranks of one length that meet the planned runs under one join key.
RANK_BLOCK = 1024
# Chunks that a Python worker keeps at hand, and as many used before them.
MEMO_CHUNKS = 700_000

_DOUBLE = re.compile(r"\s\s")
_MARKS = ".,;:!?$%&*#\"()"
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Characters that Python counts as white space and the tokenizer's pattern may not.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")


def _is_word(c: str) -> bool:
    """Letters only, of scripts that every Unicode version in use knows."""
    return c.isalpha() and max(c) < "\u2000"


class _Memo(dict):
    """Chunk -> ids; a chunk that isn't there yet is learnt."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        return self.learn(chunk)


class ChunkEncoder:
    """Token ids of texts as little-endian 32-bit bytes; an added token's string is ordinary text (``ContractEncoder`` doesn't send it here).

    Byte-level pre-tokens never cross a space except as their first character, so a text may be encoded chunk by chunk (a
    space and the run after it) and chunks repeat; each is encoded once while it stays in the memo, which forgets what
    wasn't used lately.  A chunk of a word and marks after it is put together from the two.

    A chunk is known by its text without the leading space; one that has none gets a space in front instead.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.model, self.letters = tokenizer.model, _byte_letters()
        self.bytes = [n.to_bytes(4, "little") for n in range(tokenizer.get_vocab_size())]
        self.memo, self.older = _Memo(self._learn), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        out = []
        for t in texts:
            out.append(b"".join(map(self.memo.__getitem__, self._chunks(t))))
            if len(self.memo) > MEMO_CHUNKS:
                self.memo, self.older = _Memo(self._learn), self.memo
        return out

    def _learn(self, c: str) -> bytes:
        memo = self.memo
        found = self.older[c] if c in self.older else None
        if found is None:
            word = c.rstrip(_MARKS)
            if word != c and word and _is_word(word[-1]):
                # letters end a pre-token, and the marks after them are one
                found = memo[word] + memo[" " + c[len(word):]]
            elif _is_word(c):
                # a space and letters are one pre-token, which the model takes as it is
                tokens = self.model.tokenize((" " + c).encode().decode("latin-1").translate(self.letters))
                found = b"".join([self.bytes[t.id] for t in tokens])
            else:
                ids = self.tokenizer.encode(c[1:] if c[:1] == " " else " " + c, add_special_tokens=False).ids
                found = b"".join([self.bytes[i] for i in ids])
        memo[c] = found
        return found

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return [" " + text]
        if _DOUBLE.search(text):
            return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else " " + c for c in _CHUNK.findall(text)]
        chunks = text.split(" ")
        chunks[0] = " " + chunks[0]
        return chunks


class ContractEncoder:
    """Token ids as the tokenizer gives them as loaded: a text that holds an added token's string is encoded whole by it, any other in chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = ChunkEncoder(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {k for k, t in enumerate(texts) if any(a in t for a in self.added)}
        done = iter(self.chunks.encode([t for k, t in enumerate(texts) if k not in whole]))
        self.tokenizer.encode_special_tokens = False
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if k in whole else next(done) for k, t in enumerate(texts)]


_ENCODERS: dict[str, ContractEncoder] = {}


def encoder_at(path: str) -> ContractEncoder:
    """The encoder of a vocabulary file, loaded once in a Python worker; the tasks it runs one after the other share the memo."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ContractEncoder(path)
    return _ENCODERS[path]


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    out = {b: chr(b) for b in plain}
    out.update((b, chr(256 + k)) for k, b in enumerate(b for b in range(256) if b not in out))
    return out


def token_pieces(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY,
                 end_token: int = END_TOKEN, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32 and, if asked for, ids (array of int)."""
    spark = docs.sparkSession
    prepare_workers(spark)
    id_type = docs.schema[id_col].dataType
    end = np.array([end_token], "<u4").tobytes()

    def cut(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the one to use
        encoder = encoder_at(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cols: list[list] = [[], [], [], [], []]
                ids = []
                for row, data in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    data += end
                    total = len(data) // 4
                    start, piece = 0, 0
                    while start < total:
                        length = total % capacity if piece == 0 and total % capacity else capacity
                        own = data[4 * start:4 * (start + length)]
                        for col, value in zip(cols, (row, piece, start, length, zlib.crc32(own))):
                            col.append(value)
                        if keep_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                        start, piece = start + length, piece + 1
                out = [part.column(0).take(pa.array(cols[0], pa.int64())).cast(to_arrow_type(id_type)), pa.array(cols[1], pa.int32())]
                out += [pa.array(c, pa.int64()) for c in cols[2:]]
                names = ["doc", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, end rank, first sequence, offset).

    The work depends on the number of different lengths, not on how many pieces have them.
    """
    rooms: dict[int, list[list[int]]] = {}  # room -> runs of open sequences [first, end)
    order: list[int] = []  # the rooms that have runs, sorted
    runs: list[tuple[int, int, int, int, int]] = []
    used = 0

    def leave(room: int, first: int, end: int) -> None:
        if room and end > first:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append([first, end])

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):  # open new sequences, filled with as many pieces of this length as they take
                fit = capacity // length
                full = left // fit
                if full:
                    for slot in range(fit):
                        runs.append((length, rank, rank + full, used, slot * length))
                        rank += full
                    leave(capacity - fit * length, used, used + full)
                    used += full
                    left -= full * fit
                for slot in range(left):
                    runs.append((length, rank, rank + 1, used, slot * length))
                    rank += 1
                if left:
                    leave(capacity - left * length, used, used + 1)
                    used += 1
                break
            room = order[at]
            first, end = rooms[room][-1]
            n = min(left, end - first)
            runs.append((length, rank, rank + n, first, capacity - room))
            rank, left = rank + n, left - n
            if first + n == end:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                rooms[room][-1][0] = first + n
            leave(room - length, first, first + n)
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored ``pieces`` (key, doc, piece, start, length, ...)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    # a common length is numbered in several buckets
    shares = [(n, -(-count // BUCKET_ROWS)) for n, count in histogram.items()]
    shares = F.broadcast(spark.createDataFrame(shares or [(0, 1)], "length long, buckets long"))
    spread = F.pmod(F.xxhash64("key"), F.col("buckets"))
    pieces = pieces.join(shares, "length").withColumn("bucket", spread).drop("buckets")
    counts = stored(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = Window.partitionBy("length", "bucket").orderBy("key")
    ranked = pieces.withColumn("rank", F.row_number().over(number) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")
    runs = plan_runs(histogram, capacity)
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, low long, high long, first long, offset long")
    # A run covers some blocks of ranks; a piece looks only at the runs of its own block.
    blocks = F.explode(F.sequence(F.expr(f"low div {RANK_BLOCK}"), F.expr(f"(high - 1) div {RANK_BLOCK}")))
    plan = plan.filter("high > low").withColumn("block", blocks)
    placed = ranked.withColumn("block", F.expr(f"rank div {RANK_BLOCK}")).join(plan, ["length", "block"])
    placed = placed.filter("low <= rank AND rank < high")
    return placed.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low")).drop(
        "block", "low", "high", "first", "rank")


def pack(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY,
         end_token: int = END_TOKEN, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    pieces = stored(keyed(token_pieces(docs, tokenizer, text_col, id_col, capacity, end_token, keep_ids)), "pack-pieces")
    out = place(pieces, capacity)
    ids = ["ids"] if keep_ids else []
    return out.select(F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32", *ids, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence (sequence_id, ids) from ``pack(keep_ids=True)``; a sequence has at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
