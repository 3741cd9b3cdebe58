"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers with the characters up to the next marker. No
piece holds a marker behind another character (checked when a model is loaded), so no
merge crosses a chunk's edge, and a text's ids are its chunks' ids in order.

1. One pass over the texts cuts them into chunks. Consecutive rows of about
   ``BLOCK_CHUNKS`` chunks form a block; a row becomes the numbers of its chunks in the
   block's own list of distinct chunks. Rows and lists are written once, packed, so a block
   is the same for every later task; the texts themselves don't move any more.
2. The lists are dealt out by the chunks' hashes. Each share of the chunk table holds its
   distinct chunks, about ``TABLE_CHUNKS`` listed ones, segments each once, and answers every
   block in its order.
3. A block's ids meet its rows and every row reads its ids by position. The rows are a table
   bucketed by block, so only the ids are shuffled.

A task holds one block's list and ids or one share of the table, whatever the size of the
corpus; a chunk that stands in every block is one entry of each block's list, and equal
texts, ids or sources don't gather.

Edge cases: a null text is empty and gives no ids; repeated rows and null ids each give
their row; an empty table gives an empty table; marker characters in a text are spaces, as
the library reads them. Only the id and the text are read, so other columns may clash.
"""

from __future__ import annotations

import codecs
import heapq
import os
import re
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augmill.sources.tables import load, spread

from .common import SpanHash, byte_values, shared_path
from .registry import register

#: Chunks of the rows of a block; a longer text is a block of its own.
BLOCK_CHUNKS = 2_000_000
#: Listed chunks that a share of the table answers.
TABLE_CHUNKS = 200_000

#: Fixed values of the format: the white-space marker, and what an unknown id decodes to.
MARK, UNKNOWN = "▁", " ⁇ "

#: Up to this many characters the best pair is looked for anew after each merge, beyond by a heap.
SHORT = 48

_NONE = 1 << 40  # no piece: behind every rank


class Pieces:
    """A BPE model with byte fallback: its pieces, the order in which they are made, their bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  a\tb 　 ﬁ "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model's normaliser changes texts")
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = [sp.unk_id()] * 256
        self.silent = np.zeros(len(names), bool)
        self.symbol: dict[str, int] = {}
        text = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte[int(name[1:-1], 16)] = i
                text.append(bytes([int(name[1:-1], 16)]))
            elif sp.is_control(i):
                self.silent[i] = True
                text.append(b"")
            elif sp.is_unknown(i):
                text.append(UNKNOWN.encode())
            else:
                if re.search(f"[^{MARK}]{MARK}", name) or sp.is_unused(i):
                    raise ValueError("a piece crosses a white-space marker, or is unused")
                self.symbol[name] = i
                text.append(name.replace(MARK, " ").encode())
        self.last = len(names)  # higher numbers: characters of pieces that are none themselves
        order = {score: k for k, score in enumerate(sorted({sp.get_score(i) for i in self.symbol.values()}, reverse=True))}
        pieces = list(self.symbol.items())
        for name, _ in pieces:
            for c in name:
                self.symbol.setdefault(c, len(names) + len(self.symbol))
        # every way in which two symbols make a piece: (left, right) -> its rank, and its id
        self.rank, self.made = {}, {}
        for name, i in pieces:
            for k in range(1, len(name)):
                x, y = self.symbol.get(name[:k]), self.symbol.get(name[k:])
                if x is not None and y is not None:
                    self.rank[x << 32 | y], self.made[x << 32 | y] = order[sp.get_score(i)], i
        self.spaced = np.array([x.startswith(MARK) for x in names])
        self.size = np.array([len(t) for t in text], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(text), np.uint8)

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk: join the two neighbours whose piece scores highest, the leftmost of
        equals, until no two make a piece; what is no piece falls back to its bytes."""
        ids = list(map(self.symbol.get, chunk, range(-1, -1 - len(chunk), -1)))  # below 0: no symbol at all
        ids = self._few(ids) if len(ids) <= SHORT else self._many(ids)
        if not ids or (min(ids) >= 0 and max(ids) < self.last):
            return ids
        out, at = [], 0
        for i in ids:
            if 0 <= i < self.last:
                out.append(i)
                at += len(self.names(i))
            else:
                out += [self.byte[b] for b in chunk[at].encode()]
                at += 1
        return out

    def names(self, i: int) -> str:
        return self.flat[self.start[i] : self.start[i] + self.size[i]].tobytes().decode()

    def _few(self, ids: list[int]) -> list[int]:
        rank, made, none = self.rank.get, self.made, _NONE
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            new = ids[i] = made[ids[i] << 32 | ids[i + 1]]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, none)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], none)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank.get
        right, left, live = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue  # one of the two has grown meanwhile
            ids[i], live[j] = self.made[a << 32 | b], 0
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(i, right[i])
            offer(left[i], i)
        return [x for x, keep in zip(ids, live) if keep]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of the id lists that end at ``ends``. The marker of a text's first piece goes;
        bytes that aren't UTF-8 are U+FFFD each."""
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        size, start = self.size[ids], self.start[ids]
        silent = self.silent[ids]
        heads = begins[begins < ends]
        if silent.any():  # the first id that says something
            said = np.append(np.flatnonzero(~silent), len(ids))
            heads = said[np.searchsorted(said, begins)]
            heads = heads[heads < ends]
        heads = heads[self.spaced[ids[heads]]]
        size[heads] -= 1
        start[heads] += 1
        stop = np.cumsum(size)
        data = self.flat[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        at = np.concatenate([[0], stop])[np.concatenate([begins[:1], ends])]
        try:
            if not silent.any() and not ((data[at[:-1][at[:-1] < len(data)]] & 0xC0) == 0x80).any():
                data.tobytes().decode()
                return pa.StringArray.from_buffers(len(ends), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes()))
        except UnicodeDecodeError:
            pass
        edge = np.concatenate([[0], stop])
        return pa.array([self._pieced(data, edge, silent, a, z) for a, z in zip(begins, ends)], pa.string())

    @staticmethod
    def _pieced(data, edge, silent, a, z) -> str:
        cuts = [a, *(a + np.flatnonzero(silent[a:z])), z]  # bytes don't join across control ids
        return "".join(data[edge[x] : edge[y]].tobytes().decode(errors="each-byte") for x, y in zip(cuts, cuts[1:]))


codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


@lru_cache(maxsize=2)
def _loaded(path: str) -> Pieces:
    """Once per worker process, which serves many tasks."""
    return Pieces(path)


class Numbers(dict):
    """Numbers of what was met, in the order of meeting."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


_SPACED = re.compile(" ( *[^ ]+| *)").findall


def cut(text: str) -> list[str]:
    """Chunks of a text, each without its first marker and with spaces for the others."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _SPACED(" " + text)
    return text.split(" ")


def _lists(values: np.ndarray, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _pack(values) -> bytes:
    """32-bit integers, all their lowest bytes first, compressed."""
    return zstandard.compress(np.ascontiguousarray(np.asarray(values, np.int32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _pack_texts(texts: list[bytes]) -> bytes:
    return zstandard.compress(b"".join(texts), 1)


def _blocks(size: int):
    """Rows (block, n, id array, chunks per row, chunk numbers, -) of some texts each and, behind them, the
    block's list (block, n, null, length of each chunk, -, chunks)."""

    def work(batches):
        task, made = TaskContext.get().partitionId(), 0
        numbers, held = Numbers(), 0

        def listed():
            raw = [c.encode() for c in numbers]
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | made], pa.int64()), pa.array([len(raw)], pa.int64()), pa.nulls(1, pa.list_(kind)),
                 pa.array([_pack([len(c) for c in raw])], pa.binary()), pa.nulls(1, pa.binary()), pa.array([_pack_texts(raw)], pa.binary())],
                names=["block", "n", "ids", "sizes", "places", "chunks"])

        for batch in batches:
            kind = batch.column(0).type
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                flat, sizes = [], []
                for text in part.column(1).to_pylist():
                    chunks = cut(text or "")
                    flat += map(numbers.__getitem__, chunks)
                    sizes.append(len(chunks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | made], pa.int64()), pa.array([len(flat)], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0)),
                     pa.array([_pack(sizes)], pa.binary()), pa.array([_pack(flat)], pa.binary()), pa.nulls(1, pa.binary())],
                    names=["block", "n", "ids", "sizes", "places", "chunks"])
                held += len(flat)
                if held >= size:
                    yield listed()
                    numbers, held, made = Numbers(), 0, made + 1
        if held or numbers:
            yield listed()

    return work


def _listed(sizes: bytes, chunks: bytes, shares: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A block's list: the chunks' bytes, where each begins and ends, and the share of the table that holds it."""
    ends = np.cumsum(_unpack(sizes), dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    raw = zstandard.decompress(chunks)
    return raw, begins, ends, SpanHash(np.frombuffer(raw, np.uint8), byte_values(13))(begins, ends) % np.uint64(shares)


def _dealt(shares: int):
    """Lists (block, sizes, chunks) -> their part in each share of the table (share, block, sizes, chunks)."""

    def work(batches):
        for batch in batches:
            for block, sizes, chunks in zip(*(c.to_pylist() for c in batch.columns)):
                raw, begins, ends, share = _listed(sizes, chunks, shares)
                order = np.argsort(share, kind="stable")
                for places in np.split(order, np.flatnonzero(np.diff(share[order])) + 1) if len(order) else ():
                    own = [raw[a:z] for a, z in zip(begins[places].tolist(), ends[places].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(share[places[0]])], pa.int64()), pa.array([block], pa.int64()),
                         pa.array([_pack([len(c) for c in own])], pa.binary()), pa.array([_pack_texts(own)], pa.binary())],
                        names=["share", "block", "sizes", "chunks"])

    return work


class Table(dict):
    """A share of the chunk table: chunk -> ids, each chunk segmented when it is first asked for."""

    def __init__(self, model: Pieces):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: bytes) -> array:
        ids = self[chunk] = array("i", self.model.segment(MARK + chunk.decode().replace(" ", MARK)))
        return ids


def _answered(path: str):
    """A share of the table: what each block asks -> (block, share, ids per chunk, ids), in the order asked."""

    def work(part: pa.Table) -> pa.Table:
        table, rows = Table(_loaded(path)), []
        for share, block, sizes, chunks in zip(*(c.to_pylist() for c in part.columns)):
            ends = np.cumsum(_unpack(sizes), dtype=np.int64).tolist()
            raw = zstandard.decompress(chunks)
            ids = [table[raw[a:z]] for a, z in zip([0, *ends], ends)]
            rows.append((block, share, _pack([len(x) for x in ids]), _pack(np.frombuffer(b"".join(ids), np.int32))))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["block", "share", "sizes", "value"])

    return work


def _met(id_col: str, shares: int, path: str | None):
    """A block's rows and list, and its ids from all shares -> (id, token_ids), and the text that the ids stand
    for if a model is named."""

    names = [id_col, "token_ids", "decoded"][: 3 if path else 2]

    def work(rows: pa.Table, answers: pa.Table) -> pa.Table:
        lists = rows.filter(rows.column("chunks").is_valid())
        rows = rows.filter(rows.column("chunks").is_null())
        # where the ids of each chunk begin, and how many they are
        flat, start, size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        if lists.num_rows:
            *_, share = _listed(lists.column("sizes")[0].as_py(), lists.column("chunks")[0].as_py(), shares)
            named = np.argsort(share, kind="stable")  # the order in which the shares, one after the other, answer
            answers = answers.sort_by("share")
            count, flat = (np.concatenate([_unpack(x) for x in answers.column(c).to_pylist()]) for c in ("sizes", "value"))
            start, size = np.zeros(len(named), np.int64), np.zeros(len(named), np.int64)
            start[named], size[named] = np.cumsum(count, dtype=np.int64) - count, count
        out = []
        for ids, places, sizes in zip(rows.column("ids"), rows.column("places").to_pylist(), rows.column("sizes").to_pylist()):
            chosen, per_row = _unpack(places), _unpack(sizes)
            n = size[chosen]
            stop = np.cumsum(n)
            found = flat[np.repeat(start[chosen] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
            counts = np.bincount(np.repeat(np.arange(len(per_row)), per_row), weights=n, minlength=len(per_row)).astype(np.int64)
            cols = [ids.values, _lists(found, counts)]
            if path:
                cols.append(_loaded(path).decode(found, np.cumsum(counts)))
            out.append(pa.RecordBatch.from_arrays(cols, names=names))
        kinds = [rows.schema.field("ids").type.value_type, pa.list_(pa.int32()), pa.string()]
        return pa.Table.from_batches(out, pa.schema(list(zip(names, kinds))))

    return work


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           block: int = BLOCK_CHUNKS, table: int = TABLE_CHUNKS, decoded: bool = False) -> DataFrame:
    """(id, token_ids array<int>) of every row, with ``decoded``, what :func:`decode` makes of the ids,
    if asked for. ``path``: a model file that every executor has. The call itself writes the
    blocks to the shared folder."""
    kind = df.schema[id_col].dataType.simpleString()
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    _loaded(path)  # a model that doesn't fit is refused here, not in a task
    spark, name = df.sparkSession, f"augmill_blocks_{uuid.uuid4().hex}"
    schema = f"block bigint, n bigint, ids array<{kind}>, sizes binary, places binary, chunks binary"
    cut_up = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_blocks(block), schema)
    # bucketed by block, so that the rows needn't move again when their ids come
    cut_up.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", shared_path(spark, "blocks")).saveAsTable(name)
    blocks = spark.table(name)
    lists = blocks.where("chunks IS NOT NULL")
    shares = max(1, -(-(lists.agg(F.sum("n")).first()[0] or 0) // table))
    asked = lists.select("block", "sizes", "chunks").mapInArrow(
        _dealt(shares), "share bigint, block bigint, sizes binary, chunks binary")
    answers = asked.groupBy("share").applyInArrow(_answered(path), "block bigint, share bigint, sizes binary, value binary")
    rows = blocks.select("block", "ids", "sizes", "places", "chunks")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _met(id_col, shares, path if decoded else None), f"`{id_col}` {kind}, token_ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, token_ids, decoded): the text that the ids stand for. Null ids give an empty text."""

    def work(batches):
        model = _loaded(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                col = part.column(1).fill_null(pa.scalar([], pa.list_(pa.int32()))) if part.column(1).null_count else part.column(1)
                ids = col.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), model.decode(ids, ends)],
                                                 names=[id_col, "token_ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col("token_ids")).mapInArrow(work, f"`{id_col}` {kind}, token_ids array<int>, decoded string")


@register("op13_pieces")
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("piece_bpe_32k.model")
    coded = encode(spread(load(spark, sf_dir, "documents"), "doc_id"), path, decoded=True)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
