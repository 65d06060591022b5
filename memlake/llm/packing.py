"""Best-fit packing of token sequences with bound-certified repacking.

Tokenised documents become pieces of at most ``capacity`` tokens. Pieces are
dealt by hash into groups of bounded size; each group is packed best-fit
decreasing, and a dual-feasible-function lower bound certifies its number of
bins. Groups that use more bins than their bound have a gap: they give the
pieces of their emptiest bins to a pool, the pool is dealt into new groups
and packed again, and so on until no gap is left, a round saves nothing, or
the pool is one group. Full bins never move again.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 1024
END_ID = 2
#: Pieces in a group that one task packs.
GROUP_ROWS = 50_000
#: Bits of a bin's number within its group; a group may grow to 2**BIN_BITS pieces.
BIN_BITS = 24
#: Rounds that a sequence's number has room for; each has a quarter of the groups at most, so the last group comes long before.
TURNS = 127
#: Distinct chunks of text whose ids a worker remembers at once.
CACHE_CHUNKS = 600_000
#: Longest chunk that is remembered, in characters.
CACHE_CHARS = 64

#: The public splitting rule of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space before a space: there the text isn't cut.
SPACE_THEN_SPACE = re.compile(r"\s ")

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class KnownChunks(dict):
    """Ids of chunks as bytes; what isn't known is encoded, and remembered if it is short. Emptied when it has CACHE_CHUNKS chunks."""

    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, chunk: str) -> bytes:
        out = np.array(self.ids(chunk), "<u4").tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = out
        return out


class ChunkEncoder:
    """Ids of whole texts by a byte-level BPE tokenizer, as little-endian uint32 bytes.

    The tokenizer never joins characters across the place before a space that
    follows a non-space character. Texts are cut there, equal chunks are
    encoded once and remembered, and the ids of a text are its chunks' ids in
    a row.

    Where each token's id is its rank among the merges (checked on loading),
    chunks go through tiktoken with the same vocabulary, which gives the same
    ids for less time a call; any other tokenizer file encodes them itself.
    A text that holds one of the file's added tokens is encoded whole by the
    tokenizer, which gives them their own ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        spec = json.loads(tokenizer.to_str())
        self.whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        ranks = self.ranks(spec)
        if ranks:
            import tiktoken

            self.ids = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.known = KnownChunks(self.ids)

    @staticmethod
    def ranks(spec: dict) -> dict[bytes, int] | None:
        """Bytes to rank of a byte-level BPE whose ids follow the order of merges; None for any other tokenizer."""
        model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not model.get("byte_fallback") and not model.get("dropout") and spec.get("normalizer") is None
        if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        # the public byte-to-character rule: printable bytes stand for themselves, the others follow from U+0100
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        return {bytes(to_byte[c] for c in t): i for t, i in vocab.items()}

    @staticmethod
    def chunks(text: str) -> list[str]:
        parts = text.split(" ")
        out = [parts[0]]
        for part in parts[1:]:
            last = out[-1]
            if last and not last[-1].isspace():
                out.append(" " + part)
            else:
                out[-1] = last + " " + part
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        ids_of = self.known.__getitem__
        out = []
        for text in texts:
            if self.added.search(text):
                out.append(self.whole(text))
                continue
            if SPACE_THEN_SPACE.search(text):
                chunks = self.chunks(text)
            else:
                chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.chunks(text)
            out.append(b"".join(map(ids_of, chunks)))
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder a worker, kept over its tasks."""
    return ChunkEncoder(path)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document's ids; only the first may be short."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    ends = range(first, n + 1, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(starts, ends, strict=True)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids_crc32`` of all documents; a null text is empty (one piece, the end id)."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(at, 256).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                rows = [(i, k, *p) for i, e in zip(ids, encoder.encode(texts), strict=True) for k, p in enumerate(cut(e + end, capacity))]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual feasible functions u_k (Fekete and Schepers 2001) and the threshold function of Martello and Toth."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    for k in range(1, 21):  # u_k: exact multiples stay, others round down to 1/k
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    large = counts * size
    for t in range(0, capacity // 2 + 1):  # items over capacity - t count whole, under t not at all
        whole = counts[capacity - t + 1 :].sum()
        rest = large[t : capacity - t + 1].sum()
        best = max(best, int(whole) + -(-int(rest) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin; equal lengths in the order given."""
    order = np.argsort(-lengths, kind="stable")
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has exactly r tokens of room
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> length
        if fits:
            room = length + ((fits & -fits).bit_length() - 1)
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, own, n = capacity, n, n + 1
        where[i], offset[i] = own, capacity - room
        left = room - length
        if left:
            by_room[left].append(own)
            rooms |= 1 << left
    fill = np.bincount(where, weights=lengths, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
    return where, offset, fill


PACKED = "doc_id long, piece int, start long, length int, ids_crc32 long, bin long, offset long, bins int, bound int, fill int"


def _pack_group(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy().astype(np.int64)
        where, offset, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        n = len(lengths)
        more = {"bin": where, "offset": offset, "bins": np.full(n, len(fill), np.int32), "bound": np.full(n, bound, np.int32), "fill": fill[where].astype(np.int32)}
        for k, v in more.items():
            table = table.append_column(k, pa.array(v))
        return table.cast(pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("bins", pa.int32()), ("bound", pa.int32()), ("fill", pa.int32())]))

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``: bins of at most capacity tokens, filled without gaps from 0.

    Pieces as long as the capacity are bins of their own. The others go
    through rounds of grouped best-fit decreasing; see the module's text.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # numbers of bins: those of full pieces below 2**56, then round, group and bin
    full = pieces.where(F.col("length") == capacity).select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = [full]
    pool, last_groups, turn, before = pieces.where(F.col("length") < capacity), None, 0, None
    while True:
        rows = pool.count()
        if rows == 0:
            break
        groups = -(-rows // group_rows)
        if last_groups is not None:
            groups = min(groups, max(1, last_groups // 4))
        dealt = pool.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(turn)), F.lit(groups)).alias("_group"))
        packed = written(dealt.groupBy("_group").applyInArrow(_with_group(_pack_group(capacity)), PACKED + ", _group long"), f"packed-{turn}")
        bins = packed.where("offset = 0").count()
        # bins with room of groups above their bound could still take something: they are what gaps consist of
        open_bin = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
        # the pool came from ``before`` bins
        last = groups == 1 or turn == TURNS - 1 or (before is not None and bins >= before)
        closed = packed if last else packed.where(~open_bin)
        number = F.lit((turn + 1) << 56) + F.shiftleft(F.col("_group"), BIN_BITS) + F.col("bin")
        done.append(closed.select(*columns, number.alias("sequence_id"), "offset"))
        if last:
            break
        pool, last_groups, turn = packed.where(open_bin), groups, turn + 1
        before = pool.where("offset = 0").count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def _with_group(pack):
    def run(key, table):
        out = pack(table)
        return out.append_column("_group", pa.array(np.full(out.num_rows, key[0].as_py(), np.int64)))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in sequences: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and one end id. Only documents of more than
    ``capacity`` ids are cut, from the end into pieces of full capacity; the
    first piece is what remains. A null or empty text is a piece of the end
    id alone. Rows that repeat an id are packed one by one; a null id stays
    null. An empty table gives no rows; other columns are not looked at.
    ``sequence_id`` is made of the round, the group and the bin, so no two bins share one.
    """
    return pack_pieces(written(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), capacity)
